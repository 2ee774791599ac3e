"""Problem 9: texts decoded with a wrong character encoding.

Method: an unknown swap of code pages is a substitution cipher. Words that can't
be text of their surroundings are found by their characters; for the others the
letter of each byte or character is learnt by source: expectation-maximization
over pairs of neighbours, against the letter bigrams of all sound Arabic text of
the corpus. What is learnt is a cipher for each source and start, applied with
``translate()``; of these, a document is found by a cipher that was learnt, never
by a page as it is listed.

Passages that a pair of listed pages explains (``SHOWN`` x ``WRITTEN``) only start
there: their counts are kept apart by that pair, so that ciphers don't mix. All
others are counted by source and script, and learnt from the likeliest pairs of an
``ALL_SHOWN`` with a ``WRITTEN`` page and from no page at all: many random starts
at once, of which the likeliest end wins (marks are letters of their own there).
A cipher counts if the text reads as sound text does, less what its choice costs
and what it leaves open where several characters stand for one letter.

Bytes that are UTF-8 prove themselves: a letter is two of them there, so no cipher
of single characters can give it, and what they say needs no learning. They are
decoded at once, also where encoded twice, unless they came about by chance in
text of another swap.

A document is found, too, if it holds replacement characters (there the original
is lost: ``restored`` keeps them, and ``whole`` is false).

Text in Latin letters keeps most of its letters in any swap, so its ciphers need
no learning: each word with other letters is read under the pairs of pages and
kept if bigrams of the whole corpus make it far more likely that way.

Defined cases: null and '' are never found; a null source is a source of its own;
a source without evidence has no cipher. Text outside the garbled words is kept.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riwaya.llm import codes as C

# ---- fixed values -------------------------------------------------------
#: Code pages in which garbled text is shown, and in which Arabic is written.
SHOWN = ("cp1252", "latin-1", "mac_roman", "cp1256", "cp1251", "cp437", "cp850")
WRITTEN = ("cp1256", "iso8859_6", "cp864", "cp720", "mac_arabic")
#: Code pages from which ciphers of characters are started.
ALL_SHOWN = tuple("""cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1257 cp1258 cp437 cp737 cp775 cp850 cp852 cp855 cp857 cp858 cp860 cp861 cp862 cp863 cp865 cp866 cp869 cp1125
koi8_r koi8_u koi8_t ptcp154 kz1048 latin-1 iso8859_2 iso8859_3 iso8859_4 iso8859_5 iso8859_7 iso8859_8 iso8859_9 iso8859_10 iso8859_11 iso8859_13 iso8859_14 iso8859_15 iso8859_16 mac_roman mac_cyrillic mac_greek mac_latin2 mac_turkish mac_iceland hp_roman8""".split())
#: Letters of the Arabic model, behind the word boundary.
LETTERS = " ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي"
#: Marks that stand in Arabic words besides letters, and punctuation around them.
MARKS = "ًٌٍَُِّْـ"
ARABIC_PUNCTUATION = "،؛؟«»"
#: Pages in which text in Latin letters is written, and its letters and signs behind the word boundary.
LATIN_WRITTEN = ("cp1252", "mac_roman", "cp850", "cp437")
LATIN = " abcdefghijklmnopqrstuvwxyz" + "àâäçèéêëîïñóôöùúûüßáíãõåøæœğışÀÂÄÇÈÉÊËÎÏÑÓÔÖÙÚÛÜÁÍÃÕÅØÆŒĞİŞ’“”„—"
#: What UTF-8 passages may turn out to be besides Arabic.
SOUND = "àâäçèéêëîïñóôöùúûüßáíìòãõåøæœğİıŞşĞÀÂÇÈÉÊÎÖÜÑÁÍÓÚÄÔŒ¿¡«»“”„‘’‚–—…•·°²³½§±×÷ﷺ€£¥©®™ ‌‍‎‏­"
# -------------------------------------------------------------------------

#: Stands for the shown page where none is known; its start is the script.
OTHER = "other"
LOST = "�"
N = len(LETTERS)
#: Letters and marks, each a letter of its own, for ciphers of which nothing is known.
MARKED = LETTERS + MARKS
K = len(MARKED)
#: The number behind the last Latin letter stands for all other characters that aren't ASCII or Arabic.
M = len(LATIN) + 1
#: How much likelier (natural logarithm) a Latin word and all such words of a text must be under another page.
WORD_GAIN, TEXT_GAIN = 3.0, 6.0
#: A learnt cipher must make this share of a passage Arabic letters, over so many letters.
LEAST_SHARE, LEAST_LETTERS = 0.9, 5
#: Mean log probability of a letter pair, relative to sound text, below which a passage isn't Arabic.
LEAST_SCORE = -1.6
#: The same for words that stand alone, and how much better than as shown they must read where they are shown as Arabic.
ALONE_SCORE, ALONE_GAIN = 0.5, 0.5


@functools.cache
def byte_tables() -> dict[str, dict[str, int]]:
    """For each shown page: character -> byte. Undefined bytes of cp1252 show as control characters."""
    out = {}
    for page in SHOWN:
        table = {}
        for b in range(128, 256):
            try:
                table[bytes([b]).decode(page)] = b
            except UnicodeDecodeError:
                table[chr(b)] = b
        out[page] = table
    return out


@functools.cache
def written_tables() -> dict[str, str]:
    """For each written page the 128 characters of the upper bytes; '\\0' where undefined."""
    out = {}
    for page in WRITTEN:
        got = []
        for b in range(128, 256):
            try:
                got.append(bytes([b]).decode(page))
            except (UnicodeDecodeError, LookupError):
                got.append("\0")
        out[page] = "".join(got)
    return out


@functools.cache
def utf8_patterns() -> dict[str, re.Pattern]:
    """For each shown page a run of characters whose bytes are sequences of UTF-8."""
    out = {}
    for page, table in byte_tables().items():
        of = lambda a, b, table=table: "[" + "".join(re.escape(c) for c, x in table.items() if a <= x <= b) + "]"
        tail = of(0x80, 0xBF)
        one = f"{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{{2}}|{of(0xF0, 0xF4)}{tail}{{3}}"
        out[page] = re.compile(f"(?:{one})+")
    return out


@functools.cache
def utf8_ends() -> dict[str, tuple[frozenset[str], frozenset[str]]]:
    """For each shown page the characters that begin and that continue sequences of UTF-8."""
    tables = byte_tables().items()
    return {p: (frozenset(c for c, b in t.items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in t.items() if b <= 0xBF)) for p, t in tables}


@functools.cache
def sound() -> frozenset[str]:
    return frozenset(SOUND + LETTERS + MARKS + ARABIC_PUNCTUATION + "٠١٢٣٤٥٦٧٨٩٪٫٬")


def _is_sound(c: str) -> bool:
    return c in sound() or ord(c) < 128 or 0x1F000 <= ord(c) < 0x1FB00


def _is_likely(c: str) -> bool:
    """Characters that a text may hold which has proven passages of UTF-8 elsewhere."""
    return _is_sound(c) or unicodedata.category(c)[0] in "LNPSM" or c in "\u200c\u200d\u200e\u200f\u00ad\ufeff\u3000"


#: So many sound characters prove a page, so that its other sequences are decoded too.
PROVEN = 3


def from_utf8(text: str, depth: int = 3) -> tuple[str, int]:
    """The text with UTF-8 passages decoded, and the number of sound characters that came out of them."""
    best, most, widest = text, 0, 0
    there = set(text)
    for page, pattern in utf8_patterns().items():
        if any(there.isdisjoint(x) for x in utf8_ends()[page]):
            continue
        table, got, used, fine = byte_tables()[page], 0, 0, _is_sound

        def put(m: re.Match, table=table, page=page) -> str:
            nonlocal got, used
            raw = m.group()
            try:
                made = bytes(table[c] for c in raw).decode("utf-8")
            except UnicodeDecodeError:
                return raw
            if page == "cp1256" and len(made) < 2 and raw[-1] in ARABIC_PUNCTUATION + "…“”‘’—–":
                return raw  # a letter before a punctuation mark
            again, more = from_utf8(made, depth - 1) if depth and any(c in "ÃÂØÙÄÅâÐ" for c in made) else (made, 0)
            if not all(map(fine, again)) or (not more and any(c in "ÃÂ" for c in made)):
                return raw
            got += sum(map(_is_sound, again))
            used += len(raw)
            return again

        made = pattern.sub(put, text)
        if got >= PROVEN:
            got, used, fine = 0, 0, _is_likely
            made = pattern.sub(put, text)
        if used > widest:
            best, most, widest = made, got, used
    return best, most


SUSPECT = re.compile(r"[^\x00-\x7f؀-ۿ«»“”„‘’—–…]")
ASCII_LETTER = re.compile("[A-Za-z]")
ARABIC = re.compile("[ء-ي]")
#: Without two such characters in a row no word is shown in another script.
HIGH_RUN = re.compile(r"[^\x00-\x7f؀-ۿ«»“”„‘’—–…]{2}")
FOREIGN = re.compile("[ -ª¬-º¼-ÿŒœƒٹپچڈڑژکگںھہے†-•‰‹›€™ˆ]")


def passages(text: str, page: str) -> list[tuple[int, int]]:
    """Ranges of words that may be bytes shown in ``page``."""
    table, out = byte_tables()[page], []
    if page == "cp1256":  # Arabic shown as other Arabic: foreign letters within its words
        spots = [m for m in re.finditer(r"\S+", text) if ARABIC.search(m.group()) and FOREIGN.search(m.group()) and not ASCII_LETTER.search(m.group())]
        words = list(re.finditer(r"\S+", text)) if spots else []
        if words:
            at = [k for k, w in enumerate(words) if any(s.start() == w.start() for s in spots)]
            groups, last = [[at[0], at[0]]], at[0]
            for k in at[1:]:
                if k - last <= 8:
                    groups[-1][1] = k
                else:
                    groups.append([k, k])
                last = k
            groups = [g for g in groups if g[1] > g[0]] or groups
            out = [(words[a].start(), words[b].end()) for a, b in groups]
        return out
    return _joined(text, high_words(page))


#: Within a word of other letters: neither white space nor letters of the surroundings.
INSIDE = "[^\\sA-Za-zء-ي]"


def _two_of(characters: str) -> re.Pattern:
    """Words without letters of the surroundings that hold two of the characters (the inside of a class) at least."""
    return re.compile(rf"(?<!\S){INSIDE}*?[{characters}]{INSIDE}*?[{characters}]{INSIDE}*(?!\S)")


@functools.cache
def high_words(page: str) -> re.Pattern:
    return _two_of("".join(re.escape(c) for c in byte_tables()[page] if ord(c) > 0xBF))


def _joined(text: str, words: re.Pattern) -> list[tuple[int, int]]:
    """Ranges of the words a pattern finds; those with only white space between are one."""
    out: list[tuple[int, int]] = []
    for m in words.finditer(text):
        if out and text[out[-1][1] : m.start()].isspace():
            out[-1] = (out[-1][0], m.end())
        else:
            out.append(m.span())
    return out


class _Bytes(dict):
    """Character -> byte as a character; all others are 0."""

    def __missing__(self, key: int) -> str:
        return "\0"


@functools.cache
def _shown(page: str) -> _Bytes:
    return _Bytes({ord(c): chr(b) for c, b in byte_tables()[page].items()})


def shown_bytes(piece: str, page: str) -> bytes:
    """Bytes of a passage; everything that isn't a byte of the page is a word boundary (0)."""
    return piece.translate(_shown(page)).encode("latin-1")


@functools.lru_cache(100_000)
def letter_numbers(cipher: str) -> np.ndarray:
    """By byte: the number of its letter, -1 for what is no letter, -2 for marks; 0 bounds words."""
    out = np.full(256, -1, np.int64)
    out[:128] = 0
    for b, c in enumerate(cipher):
        k = LETTERS.find(c)
        out[128 + b] = k if k >= 0 else -2 if c in MARKS else 0 if c in ARABIC_PUNCTUATION else -1
    return out


def score(raw: bytes, cipher: str, model: np.ndarray) -> tuple[float, float, int]:
    """(mean log probability of letter pairs, share of letters, letters) of a passage under a cipher."""
    num = letter_numbers(cipher)[np.frombuffer(raw, np.uint8)]
    num = num[num != -2]
    high = int((num != 0).sum())
    letters = int((num > 0).sum())
    if not letters:
        return -99.0, 0.0, 0
    num = np.where(num < 0, 0, num)
    num = np.concatenate([[0], num, [0]])
    pair = np.log(model[num[:-1], num[1:]])[(num[:-1] > 0) | (num[1:] > 0)]
    return float(pair.mean()), letters / max(high, 1), letters


def _numbers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter numbers by code point for the Arabic model (-1, a mark, is passed over), for that with marks, and for the Latin one."""
    arabic, marked = np.zeros(0x110000, np.int16), np.zeros(0x110000, np.int16)
    for k, c in enumerate(MARKED):
        arabic[ord(c)], marked[ord(c)] = k if k < N else -1, k
    latin = np.full(0x110000, M - 1, np.int16)
    latin[:128] = latin[0x0600:0x0700] = 0
    for k, c in enumerate(LATIN):
        latin[ord(c)] = k
        if "a" <= c <= "z":
            latin[ord(c.upper())] = k
    return arabic, marked, latin


class Models(NamedTuple):
    """Joint probabilities of neighbouring letters, word boundaries among them."""

    arabic: np.ndarray
    marked: np.ndarray
    latin: np.ndarray


def bigram_models(df: DataFrame, text: str) -> Models:
    """The models of all texts: N x N for Arabic letters, K x K for letters and marks, M x M for Latin letters."""
    ends = np.cumsum([0, N * N, K * K, M * M])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _numbers()
        total = np.zeros(ends[-1], np.int64)
        for batch in batches:
            codes, _ = C.to_codes(batch.column(0))
            for table, size, at in zip(tables, (N, K, M), ends, strict=False):
                num = table[codes].astype(np.int32)
                num = num[num >= 0]
                if len(num) > 1:
                    total[at : at + size * size] += np.bincount(num[:-1] * size + num[1:], minlength=size * size)
        total[ends[:-1]] = 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    counts = np.full(ends[-1], 0.5)
    for row in df.select(text).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # N * N + K * K + M * M rows at most
        counts[row.pair] += row.n
    parts = [counts[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    parts[2][-1] = 0.5  # other characters in a row are mostly garbled text of another script
    return Models(*[(x / x.sum()).reshape(n, n) for x, n in zip(parts, (N, K, M), strict=True)])


LATIN_WORD = re.compile(r"\S*[^\x00-\x7f]\S*")


class LatinWords:
    """Readings of single words under other pages; words come again, so they are remembered."""

    def __init__(self, model: np.ndarray):
        self.logs = np.log(model)
        self.known: dict[str, dict[tuple[str, str], tuple[float, str]]] = {}

    def _score(self, word: str) -> float:
        num = [0, *(LATIN.find(c.lower() if c < "\x80" else c) for c in word), 0]
        num = [n if n >= 0 else M - 1 if ord(c) > 127 else 0 for n, c in zip(num, " " + word + " ", strict=True)]
        return float(sum(self.logs[a, b] for a, b in zip(num[:-1], num[1:], strict=True)))

    def readings(self, word: str) -> dict[tuple[str, str], tuple[float, str]]:
        """By (shown, written): how much likelier the word is that way, and how it reads."""
        found = self.known.get(word)
        if found is None:
            found = {}
            if len(word) > 2 and ASCII_LETTER.search(word) and not ARABIC.search(word):
                own = self._score(word)
                for shown in SHOWN:
                    table = byte_tables()[shown]
                    if any(ord(c) > 127 and c not in table for c in word):
                        continue
                    for written in LATIN_WRITTEN:
                        made = "".join(c if c < "\x80" else bytes([table[c]]).decode(written, "replace") for c in word)
                        if made != word and all(c < "\x80" or c in LATIN for c in made) and (gain := self._score(made) - own) >= WORD_GAIN:
                            found[shown, written] = gain, made
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = found
        return found

    def restore(self, text: str) -> str | None:
        """The text with its words read under the best pair of pages; None if that isn't likelier by TEXT_GAIN."""
        total: dict[tuple[str, str], float] = {}
        for m in LATIN_WORD.finditer(text):
            for pages, (gain, _) in self.readings(m.group()).items():
                total[pages] = total.get(pages, 0.0) + gain
        if not total or max(total.values()) < TEXT_GAIN:
            return None
        best = max(total, key=lambda k: (total[k], k))
        return LATIN_WORD.sub(lambda m: self.readings(m.group()).get(best, (0.0, m.group()))[1], text)


def learn(pairs: np.ndarray, start: str, model: np.ndarray, rounds: int = 15) -> tuple[str, float]:
    """Expectation-maximization of P(byte | letter) over counts of byte pairs; returns the cipher and its log likelihood.

    ``pairs`` is 129 x 129: index 0 bounds words, 1 + b is the upper byte b.
    """
    emit = np.full((N, 129), 0.02 / 129)
    first = np.array([LETTERS.find(c) for c in start])
    for b, k in enumerate(first):
        if k > 0:
            emit[k, 1 + b] += 1.0
    emit[0] = 1e-9
    emit[0, 0] = 1.0
    emit[1:, 0] = 1e-9
    outside = [1 + b for b, c in enumerate(start) if LETTERS.find(c) <= 0 and c not in "\0"]
    emit[0, outside] += 0.02  # marks and punctuation of the page
    emit /= emit.sum(1, keepdims=True)
    like = -np.inf
    for _ in range(rounds):
        seen = np.maximum(emit.T @ model @ emit, 1e-300)
        like = float((pairs * np.log(seen)).sum())
        ratio = pairs / seen
        expected = emit * (model @ emit @ ratio.T + model.T @ emit @ ratio)
        expected += 0.05 * emit
        emit = expected / np.maximum(expected.sum(1, keepdims=True), 1e-300)
    letter = (model.sum(1)[:, None] * emit).argmax(0)
    seen_bytes = pairs.sum(0) + pairs.sum(1)
    out = [LETTERS[letter[1 + b]] if letter[1 + b] > 0 and seen_bytes[1 + b] > 2 and first[b] != 0 and start[b] not in MARKS + ARABIC_PUNCTUATION else start[b] for b in range(128)]
    return "".join(out), like / max(pairs.sum(), 1)


#: Random starts of a cipher of which nothing is known, rounds for each, and further ones for the likeliest.
TRIES, ROUNDS, MORE, KEPT = 20, 60, 120, 4


def learn_freely(pairs: np.ndarray, model: np.ndarray) -> np.ndarray:
    """By symbol the number of its letter (0: none), learnt by expectation-maximization from no page at all.

    ``pairs`` are counts as in :func:`learn`. All starts run at once; they favour
    letters that are as frequent as the symbol. The likeliest end wins.
    """
    often, letters = pairs.sum(0) + pairs.sum(1), model.sum(0) + model.sum(1)
    dead = often == 0
    apart = np.abs(np.log(letters / letters.sum() + 1e-9)[:, None] - np.log(often / often.sum() + 1e-9)[None, :])
    emit = np.exp(-2 * apart)[None] * np.random.default_rng(11).gamma(1.0, 1.0, (TRIES, len(model), len(pairs)))
    emit[:, 0, 1:] *= 1e-3  # few symbols are boundaries besides those that show as such

    def closed(x: np.ndarray) -> np.ndarray:
        x[:, 1:, 0] = 0
        x[:, :, dead] = 0
        return x / np.maximum(x.sum(2, keepdims=True), 1e-300)

    def seen(x: np.ndarray) -> np.ndarray:
        return np.maximum(np.swapaxes(x, 1, 2) @ model @ x, 1e-300)

    def run(x: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            ratio = pairs / seen(x)
            x = closed(x * (model @ x @ np.swapaxes(ratio, 1, 2) + model.T @ x @ ratio) + 1e-6)
        return x

    likely = lambda x: (pairs * np.log(seen(x))).sum((1, 2))
    emit = run(closed(emit), ROUNDS)
    emit = run(emit[np.argsort(-likely(emit), kind="stable")[:KEPT]], MORE)
    best = emit[int(likely(emit).argmax())]
    return np.where(dead, 0, (model.sum(1)[:, None] * best).argmax(0))


def _foreign(c: str) -> bool:
    """A character of a script that single-byte pages show, other than Arabic."""
    return "\xbf" < c < "\u2e80" and not "\u0600" <= c <= "\u06ff" and not "\u2000" <= c <= "\u20cf"


#: Words of such characters, and words that may stand among them: with any character that is neither ASCII nor Arabic.
OTHER_WORDS = _two_of("\u00c0-\u05ff\u0700-\u1fff\u20d0-\u2e7f")
AMONG = re.compile(rf"(?<!\S){INSIDE}*?[\u0080-\u05ff\u0700-\u2e7f\uf8ff]{INSIDE}*(?!\S)")


def other_passages(text: str) -> list[tuple[int, int]]:
    """Ranges of words in other letters than their surroundings, whatever page shows them."""
    if not OTHER_WORDS.search(text):
        return []
    return [(a, b) for a, b in _joined(text, AMONG) if OTHER_WORDS.search(text, a, b)]


def by_chance(text: str, decoded: str, got: int) -> bool:
    """True if sequences of UTF-8 came about by chance: they explain little of the text in other letters, and most words that they changed still hold such letters."""
    high = sum(c > "\x7f" for a, b in other_passages(text) for c in text[a:b])
    new = set(decoded.split()) - set(text.split())
    return 8 * got < high and 2 * sum(not ASCII_LETTER.search(w) and any(map(_foreign, w)) for w in new) > len(new)


def script(piece: str) -> str:
    """The block of most of its characters; Latin letters are one."""
    blocks = [max(ord(c) >> 8, 2) for c in piece if _foreign(c)]
    return str(max(sorted(set(blocks)), key=blocks.count))


@functools.cache
def all_starts() -> tuple[dict[str, str], ...]:
    """For each pair of a shown and a written page: character -> character."""
    out = []
    for page in ALL_SHOWN:
        for written in written_tables().values():
            table = {}
            for b in range(128, 256):
                try:
                    table[bytes([b]).decode(page)] = written[b - 128]
                except UnicodeDecodeError:
                    table[chr(b)] = written[b - 128]
            out.append(table)
    return tuple(out)


#: So many of the likeliest starts are followed.
STARTS = 4
#: For ciphers of characters: mean log probability of a pair, relative to sound text, less what the choice of the cipher itself costs
#: by different pair of letters (foreign text that a cipher has fitted itself to stays below).
LEAST_LEARNT = -0.42
#: A cipher whose choice costs more by pair isn't learnt: no text reads so well.
MOST_COST = 1.5


def learn_characters(pairs: dict[tuple[int, int], int], model: np.ndarray, marked: np.ndarray) -> list[Learnt]:
    """Ciphers for counts of neighbouring characters (0 bounds words), learnt from the likeliest pages and from none.

    Each comes as character -> letter, its cost by pair, and the logarithm of each character's share of its letter.
    """
    often: dict[int, int] = {}
    for (a, b), n in pairs.items():
        for c in (a, b):
            often[c] = often.get(c, 0) + n
    often.pop(0, None)
    chars = sorted(often, key=lambda c: (-often[c], c))[:128]  # a single-byte page shows no more
    at = {0: 0} | {c: 1 + k for k, c in enumerate(chars)}
    table = np.zeros((129, 129))
    for (a, b), n in pairs.items():
        table[at.get(a, 0), at.get(b, 0)] += n
    table[0, 0] = 0
    logs = np.log(model)

    def value(start: str) -> float:
        num = np.array([0, *(max(LETTERS.find(c), 0) for c in start)])
        return float((table * logs[num[:, None], num[None, :]])[(num > 0)[:, None] & (num > 0)[None, :]].sum() + np.log(1e-5) * table[(num == 0)[:, None] | (num == 0)[None, :]].sum())

    starts = {"".join(t.get(chr(c), "\0") for c in chars).ljust(128, "\0") for t in all_starts()}
    best = sorted(starts, key=lambda x: (-value(x), x))[:STARTS]
    out: list[Learnt] = []
    size = max(len(pairs), 1)  # a phrase that comes again is no further evidence
    free = len(chars) * np.log(N)
    ciphers = []
    for start in best:
        learnt = learn(table, start, model)[0]
        moved = sum(a != b for a, b in zip(start, learnt, strict=True))
        ciphers.append((learnt, min(np.log(len(starts)) + moved * np.log(128 * N), free)))  # what tells a start, and where it was left
    if free / size <= MOST_COST:
        ciphers.append(("".join(MARKED[k] if k else "\0" for k in learn_freely(table, marked)[1:]), free))
    for cipher, cost in ciphers:
        made = {chr(c): x for c, x in zip(chars, cipher, strict=False) if x != "\0"}
        # a letter that several characters stand for doesn't tell which: what is left open counts against the cipher
        whole: dict[str, int] = {}
        for c, x in made.items():
            whole[x] = whole.get(x, 0) + often[ord(c)]
        told = {c: float(np.log(often[ord(c)] / whole[x])) for c, x in made.items()}
        if all(made != x[0] for x in out):
            out.append((made, float(cost / size), told))
    return out


Learnt = tuple[dict[str, str], float, dict[str, float]]


def best_characters(pieces: list[str], ciphers: list[Learnt], model: np.ndarray, usual: float) -> dict[str, str] | None:
    """The cipher under which the passages are most Arabic, if one makes them so."""
    best, most = None, -np.inf
    for cipher, cost, told in ciphers:
        words = [w for piece in pieces for w in piece.split()]
        made = " ".join("".join(cipher.get(c, c) for c in w) for w in words)
        num = np.array([0, *(LETTERS.find(c) if c in LETTERS else 0 if c < "\x80" or c in ARABIC_PUNCTUATION else -1 for c in made if c not in MARKS), 0])
        letters, high = int((num > 0).sum()), int((num != 0).sum())
        if letters < LEAST_LETTERS or letters < LEAST_SHARE * high:
            continue
        num = np.maximum(num, 0)
        logs = np.log(model[num[:-1], num[1:]])[(num[:-1] > 0) | (num[1:] > 0)]
        value = float(logs.mean()) + sum(told.get(c, 0.0) for w in words for c in w) / len(logs) - cost
        if value - usual >= LEAST_LEARNT and value > most:
            best, most = cipher, value
    return best


def widened(text: str, spans: list[tuple[int, int]], cipher: str, model: np.ndarray) -> list[tuple[int, int]]:
    """Passages of Arabic shown as other Arabic, with the words beside them that read better under the cipher."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    starts = {a: k for k, (a, _) in enumerate(words)}
    inside = set()
    for a, b in spans:
        k = first = starts[a]
        while k < len(words) and words[k][0] < b:
            inside.add(k)
            k += 1
        for step, at in ((-1, first - 1), (1, k)):
            while 0 <= at < len(words) and at not in inside:
                raw = shown_bytes(text[slice(*words[at])], "cp1256")
                if score(raw, cipher, model)[::2] <= score(raw, written_tables()["cp1256"], model)[::2]:
                    break
                inside.add(at)
                at += step
    out: list[tuple[int, int]] = []
    for k in sorted(inside):
        if out and k - 1 in inside:
            out[-1] = (out[-1][0], words[k][1])
        else:
            out.append(words[k])
    return out


def _best(text: str, model: np.ndarray, base: float, ciphers: dict[tuple[str, str], str] | None = None) -> tuple[str, str, float, int] | None:
    """The page and start under which the document's passages are most Arabic, with the score and the number of letters.

    With ``ciphers`` only these count, without them the starts as they are.
    """
    best = None
    other, mixed = HIGH_RUN.search(text), FOREIGN.search(text) and ARABIC.search(text)
    for page in SHOWN if ciphers is None else sorted({p for p, _ in ciphers}):
        if not (mixed if page == "cp1256" else other):
            continue
        spans = passages(text, page)
        raw = b"\0".join(shown_bytes(text[a:b], page) for a, b in spans)
        if not raw:
            continue
        words = [len(text[a:b].split()) for a, b in spans]
        alone = max(words) == 1 if page == "cp1256" else sum(words) == 1
        for start in WRITTEN:
            if page == start or (ciphers is not None and (page, start) not in ciphers):
                continue
            value, share, letters = score(raw, (ciphers or {}).get((page, start), written_tables()[start]), model)
            if share < LEAST_SHARE or letters < LEAST_LETTERS or value - base < (ALONE_SCORE if alone else LEAST_SCORE):
                continue
            if alone and (share < 1 or (page in WRITTEN and value - score(raw, written_tables()[page], model)[0] < ALONE_GAIN)):
                continue
            if page in WRITTEN and share <= score(raw, written_tables()[page], model)[1]:
                continue
            if best is None or value > best[2] + 1e-9:
                best = (page, start, value, letters)
    return best


def repair(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, found, whole, restored) for each document with a suspicious character.

    ``found``: it holds a passage decoded wrongly; ``whole``: nothing of it is
    lost; ``restored``: the text with the passages restored.
    """
    models = bigram_models(df, text)
    model, latin_model = models.arabic, models.latin
    known = model.sum(1)
    base = float((model * np.log(model))[1:, 1:].sum() / model[1:, 1:].sum()) if known.sum() else -9.0
    inside = np.where(np.arange(N * N) > 0, model.ravel(), 0.0)  # pairs of sound text, but for two boundaries
    usual = float((inside * np.log(model.ravel())).sum() / inside.sum())
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(source), F.lit("\0")).alias("source"), F.col(text).alias("text")).filter("text is not null")

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latin = LatinWords(latin_model)
        for batch in batches:
            out: list[tuple] = []
            for i, s, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not SUSPECT.search(t):
                    continue
                plain, got = from_utf8(t)
                best = _best(t, model, base)
                if best and best[3] > 2 * got:
                    plain, got = t, 0  # sequences of UTF-8 came about by chance
                elif got and by_chance(t, plain, got):
                    plain, got = t, 0
                elif got:
                    best = _best(plain, model, base)
                lost = LOST in t
                if not best and (read := latin.restore(plain)):
                    plain, got = read, got + 1
                other = other_passages(plain) if not best and HIGH_RUN.search(plain) else []
                if got or best or lost or other:
                    page, start = best[:2] if best else (None, None)
                    raw = b"\0".join(shown_bytes(plain[a:b], page) for a, b in passages(plain, page)) if page else None
                    if other:
                        piece = " ".join(plain[a:b] for a, b in other)
                        page, start, raw = OTHER, script(piece), piece.encode("utf-8", "replace")
                    out.append((i, s, plain, got, lost, page, start, raw))
            kinds = [batch.schema.types[0], pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.binary()]
            names = ["id", "source", "text", "got", "lost", "page", "start", "raw"]
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    kind = df.schema[id_column].dataType.simpleString()
    found = rows.mapInArrow(suspects, f"id {kind}, source string, text string, got long, lost boolean, page string, start string, raw binary").checkpoint()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables: dict[tuple, np.ndarray] = {}
            signs: dict[tuple, int] = {}
            for s, page, start, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if page == OTHER:
                    n = [0, *(ord(c) if c > "\x7f" else 0 for c in raw.decode("utf-8")), 0]
                    for a, b in zip(n[:-1], n[1:], strict=True):
                        if a or b:
                            signs[s, page, start, (a << 21) + b] = signs.get((s, page, start, (a << 21) + b), 0) + 1
                    continue
                marks = [128 + b for b, c in enumerate(written_tables()[start]) if c in MARKS]
                b = np.frombuffer(raw, np.uint8)
                b = b[~np.isin(b, marks)]
                n = np.where(b >= 128, b.astype(np.int64) - 127, 0)
                n = np.concatenate([[0], n, [0]])
                tables.setdefault((s, page, start), np.zeros(129 * 129, np.int64))
                tables[s, page, start] += np.bincount(n[:-1] * 129 + n[1:], minlength=129 * 129)
            out = [(*key, int(k), int(t[k])) for key, t in tables.items() for k in np.flatnonzero(t) if k]
            out += [(*key, n) for key, n in signs.items()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["source", "page", "start", "pair", "n"])

    pairs = found.filter("page is not null").select("source", "page", "start", "raw").mapInArrow(counts, "source string, page string, start string, pair long, n long")
    pairs = pairs.groupBy("source", "page", "start", "pair").agg(F.sum("n").alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        if group.page.iloc[0] == OTHER:
            made = learn_characters({(k >> 21, k & 0x1FFFFF): n for k, n in zip(group.pair.tolist(), group.n.tolist(), strict=True)}, model, models.marked)
            return pd.DataFrame({"source": [group.source.iloc[0]], "page": [OTHER], "start": [group.start.iloc[0]], "cipher": [json.dumps(made)]})
        table = np.zeros(129 * 129)
        table[group.pair.to_numpy()] = group.n.to_numpy()
        start = group.start.iloc[0]
        cipher, _ = learn(table.reshape(129, 129), written_tables()[start], model)
        return pd.DataFrame({"source": [group.source.iloc[0]], "page": [group.page.iloc[0]], "start": [start], "cipher": [cipher]})

    # one group holds 129 x 129 counts at most (or the pairs of characters of one script), however large its source is
    ciphers = pairs.groupBy("source", "page", "start").applyInPandas(fit, "source string, page string, start string, cipher string")
    joined = found.join(ciphers, ["source", "page", "start"], "left").select("id", "source", "text", "got", "lost", "page", "start", "cipher")

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, list[Learnt]] = {}
        for batch in batches:
            out: list[tuple] = []
            for i, s, t, got, lost, page, start, cipher in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                fits = False
                if page == OTHER:
                    spans = other_passages(t)
                    if cipher not in read:
                        read[cipher] = json.loads(cipher)
                    best = best_characters([t[a:b] for a, b in spans], read[cipher], model, usual)
                    fits = best is not None
                    if fits:
                        table = str.maketrans(best)
                        for a, b in reversed(spans):
                            t = t[:a] + t[a:b].translate(table) + t[b:]
                elif page:
                    best = _best(t, model, base, {(page, start): cipher})
                    fits = best is not None
                    if fits:
                        table = str.maketrans({c: cipher[b - 128] for c, b in byte_tables()[page].items() if cipher[b - 128] != "\0"})
                        spans = passages(t, page)
                        for a, b in reversed(widened(t, spans, cipher, model) if page == "cp1256" else spans):
                            t = t[:a] + t[a:b].translate(table) + t[b:]
                out.append((i, None if s == "\0" else s, bool(got or lost or fits), not lost, t))
            kinds = [batch.schema.types[0], pa.string(), pa.bool_(), pa.bool_(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["id", "source", "found", "whole", "restored"])

    return joined.mapInArrow(restore, f"id {kind}, source string, found boolean, whole boolean, restored string")
