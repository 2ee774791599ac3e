"""Problem 1: variant spellings of the names of persons and books.

Method: merge-and-rematch. What the words of a column are is learnt from the
column itself. A word that stands beside a patronymic particle or behind «abu» in
a good part of its spellings is a personal name. Of the others a word is common
if it stands with many different rarest words (trades, kinds of books, titles),
otherwise it is distinguishing; a common word that opens names is a title and
says nothing. Typing errors are words at one edit (symmetric deletes) from far
more frequent ones.

Each spelling is read into a profile: the distinguishing name N and the facts
G (given name, kind of book), F (father, subject), K (kunya), T (by-name), known
in full or by initial only. Profiles are blocked by N together with one or two
facts. A block whose members don't contradict each other is merged; merged
profiles unite their facts and initials, and the richer profiles enter the
blocks again, until no merge occurs. Where a misspelt fact may stand for several
words, the profile joins only if all lead to one entity. Names of one N that
stand in the same statement (the same ruling on the same page) are blocked too,
if the caller gives such a context.

A spelling that holds a kunya or by-name only, which no other spelling explains,
joins a person of its N by elimination (the only one without it) or if its number
of rows makes that person likelier than all others together (``SURE``): how the
rows of such spellings relate to those of the full name is learnt from the
entities that are known by then.

Blocks never span two distinguishing names, so names of one N are resolved where
they lie, one N at a time. An N with more than ``LARGE`` different profiles isn't
brought into one task; it is resolved by the same rounds as grouped aggregates,
joining by number of rows included, and with the same result.
Work is on distinct profiles, so a hot name costs one row.

Defined cases: nulls are left out; values without any letter match only values
that differ in formatting; repeated values count once.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riwaya.llm import codes as C
from riwaya.llm.forms import consistent

# ---- fixed values -------------------------------------------------------
#: Particles of Arabic names: «son of» in full and short, and «father of».
SON, FATHER = ("بن", "ابن", "ب"), "ابو"
#: The article.
THE = "ال"
#: Letters unified for comparison: seats of hamza, alef maksura, teh marbuta.
FOLD = str.maketrans("أإآٱىةؤئ", "ااااي" + "هوي")
# -------------------------------------------------------------------------

MARKS = re.compile("[ؐ-ًؚ-ٰٟۖ-ۭـ]")
WORD = re.compile(r"[^\W_]+")
TURNED = re.compile(r"(.*\S)،\s+(\S.*)", re.S)  # a name whose first or last part was put behind or before a comma

#: A word with so many different rarest words around it is common.
COMMON = 4
#: Share of a word's spellings in which it must stand as a personal name, or open a name, to be taken for one or for a title.
NAMED, OPENING = 0.25, 0.3
#: A word is taken for a misspelt name if the name is so many times as frequent.
TIMES = 6
#: Two distinguishing words at one edit are one if the rarer stands in so few spellings, or the other is so many times as frequent.
FEW, OFTENER = 5, 3
#: Profiles of one N that are resolved in one task.
LARGE = 50_000
#: Least probability at which a spelling joins a person by its number of rows.
SURE = 0.6
#: Digits of such a probability that count; the order in which numbers are added up changes later ones.
DIGITS = 9


def near(a: str, b: str) -> bool:
    """True if one insertion, deletion, substitution or swap of neighbours at most separates the words."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


def words(text: str) -> list[str]:
    return WORD.findall(MARKS.sub("", text).translate(FOLD).lower())


def tokens(value: str, title: bool) -> list[str]:
    """Words of a spelling in their usual order: a part before a comma goes to the end of a name, and behind the first word of a title.

    No name ends in a particle: the word that belongs behind it was put in front.
    """
    turned = TURNED.fullmatch(value.strip())
    head, tail = (words(turned[1]), words(turned[2])) if turned else ([], words(value))
    if title:
        return tail[:1] + head + tail[1:]
    out = tail + head
    return out[1:] + out[:1] if len(out) > 2 and out[-1] in (*SON, FATHER) else out


def spellings(values: DataFrame, titles: tuple[str, ...]) -> DataFrame:
    """``values`` (field, name, rows) with ``same`` (equal for mere differences of formatting) and ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = C.to_arrow(*consistent(*C.to_codes(batch.column(1)))).to_pylist()
            names, fields = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            made = [tokens(v, f in titles) for v, f in zip(form, fields, strict=True)]
            same = [" ".join(t) or v for t, v in zip(made, names, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.string()), pa.array(made, pa.list_(pa.string()))], names=["field", "name", "rows", "same", "words"])

    return values.select("field", "name", "rows").mapInArrow(run, "field string, name string, rows long, same string, words array<string>")


# ---- what the words of a column are --------------------------------------


def _at(k: Column | int) -> Column:
    """The word at a place of ``words``, '' outside."""
    place = F.lit(k) if isinstance(k, int) else k
    return F.coalesce(F.get("words", place), F.lit(""))


def word_counts(forms: DataFrame) -> DataFrame:
    """(kind, word, df, is_name, is_title) of all words but particles, single letters and numbers, from (kind, words)."""
    at = forms.select("kind", "words", F.posexplode("words").alias("pos", "word")).filter((F.length("word") > 1) & ~F.col("word").isin(*SON, FATHER) & ~F.col("word").rlike("[0-9٠-٩]"))
    before, behind = _at(F.col("pos") - 1), _at(F.col("pos") + 1)
    named = before.isin(*SON, FATHER) | behind.isin(SON[0], SON[2])
    opens = (F.col("pos") == 0) & (F.col("kind") == "name") & ((_at(1) == FATHER) | _at(2).isin(*SON))
    counts = at.groupBy("kind", "word").agg(F.count("*").alias("df"), F.sum(named.cast("int")).alias("named"), F.sum(opens.cast("int")).alias("opens"))
    is_name = (F.col("kind") == "name") & (F.col("named") >= NAMED * F.col("df"))
    return counts.select("kind", "word", "df", is_name.alias("is_name"), (F.col("opens") >= OPENING * F.col("df")).alias("is_title"))


def near_words(counts: DataFrame) -> DataFrame:
    """``counts`` beside each other word at one edit (``to``, ``of``, ``to_name``), and beside the same word with the article.

    Two words are at one edit if deleting a letter of each at the same place, the
    same letter at neighbouring places, or a letter of one only leaves the same.
    """
    word = F.col("word")
    cuts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.struct(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))).alias("key"), i.alias("cut")))
    own = F.array(F.struct(word.alias("key"), F.lit(0).alias("cut")))
    bare = F.when(word.startswith(THE) & (F.length(word) > 4), F.array(F.struct(F.substring(word, F.lit(3), F.length(word)).alias("key"), F.lit(-1).alias("cut"))))
    keyed = counts.withColumn("k", F.explode(F.concat(own, cuts, F.coalesce(bare, F.array().cast("array<struct<key:string,cut:int>>")))))
    a = keyed.select("*", "k.key", F.col("k.cut").alias("a")).drop("k").filter("a >= 0")
    b = keyed.select("kind", "k.key", F.col("k.cut").alias("b"), F.col("word").alias("to"), F.col("df").alias("of"), F.col("is_name").alias("to_name"))
    swap = (F.abs(F.col("a") - F.col("b")) == 1) & (F.substring("word", F.col("a"), F.lit(1)) == F.substring("to", F.col("b"), F.lit(1)))
    edit = (F.length("word") == F.length("to")) & (F.col("a") > 0) & (F.col("b") > 0) & ((F.col("a") == F.col("b")) | swap)
    edit |= (F.abs(F.length("word") - F.length("to")) == 1) & ((F.col("a") == 0) | (F.col("b") == 0)) & (F.col("b") >= 0)
    the = (F.col("a") == 0) & (F.col("b") == -1)
    pairs = a.join(b, ["kind", "key"]).filter((F.col("word") != F.col("to")) & (edit | the))
    return pairs.groupBy("kind", "word", "to").agg(*[F.first(c).alias(c) for c in ("df", "is_name", "of", "to_name")], F.max((F.col("b") == -1).cast("int")).alias("the"))


def vocabulary(forms: DataFrame) -> DataFrame:
    """(kind, word, alts, is_name, is_title, df): for each word what it is read as.

    ``alts`` are the names that a misspelt name may stand for, the most frequent
    first, or the one distinguishing or common word that it is a variant of.
    """
    counts = word_counts(forms).checkpoint()
    pairs = near_words(counts).checkpoint()
    names = pairs.filter((F.col("of") >= TIMES * F.col("df")) & F.col("to_name") & (F.col("the") == 0))
    names = names.groupBy("kind", "word").agg(F.sort_array(F.collect_list(F.struct("of", "to")), asc=False).alias("x")).select("kind", "word", F.col("x.to").alias("alts"))
    # the other words: each points to its most frequent neighbour, always upwards, so pointers have an end
    alike = ~F.col("is_name") & ~F.col("to_name") & (F.length("word") >= 4)
    rank = lambda word, df: F.struct(F.col(word).startswith(THE).alias("the"), F.col(df).alias("df"), F.col(word).alias("word"))
    close = (F.col("df") <= FEW) | (F.col("of") >= OFTENER * F.col("df")) | (F.col("the") == 1)
    up = pairs.filter(alike & close & (rank("to", "of") > rank("word", "df"))).join(names.select("kind", "word"), ["kind", "word"], "left_anti")
    at = up.groupBy("kind", "word").agg(F.max(rank("to", "of")).getField("word").alias("root")).checkpoint()
    while True:
        over = at.select("kind", F.col("word").alias("root"), F.col("root").alias("further"))
        joined = at.join(over, ["kind", "root"], "left").select("kind", "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).checkpoint()
        at = joined.select("kind", "word", "root")
        if joined.filter("moved").isEmpty():
            break
    read = counts.join(at, ["kind", "word"], "left").join(names, ["kind", "word"], "left")
    read = read.select("kind", "word", "is_name", "is_title", "df", F.coalesce("alts", F.array(F.coalesce("root", "word"))).alias("alts"), F.col("alts").isNotNull().alias("misspelt"))
    # a word is as frequent as all words that are read as it
    read = read.withColumn("root", F.col("alts")[0])
    whole = read.groupBy("kind", "root").agg(F.sum("df").alias("df"), F.max_by("is_title", "df").alias("is_title"))
    return read.drop("df", "is_title").join(whole, ["kind", "root"]).select("kind", "word", "alts", (F.col("is_name") | F.col("misspelt")).alias("is_name"), "is_title", "df")


def read_words(forms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``forms`` (field, same, kind, rows, words) with ``read``: the words by place with what is known of them."""
    form = ["field", "same"]
    at = forms.select(*form, "kind", F.posexplode("words").alias("pos", "word"))
    known = at.join(vocabulary, ["kind", "word"], "left")
    known = known.withColumn("root", F.when(~F.col("is_name"), F.col("alts")[0])).checkpoint()
    rarest = known.filter("root is not null and df > 1").groupBy(*form).agg(F.min(F.struct("df", "root")).getField("root").alias("rarest"))
    spread = known.filter("root is not null").select(*form, "kind", "root").join(rarest, form).groupBy("kind", "root").agg(F.count_distinct("rarest").alias("r"))
    common = spread.filter(F.col("r") >= COMMON).select("kind", "root", F.lit(True).alias("common"))
    joined = known.join(common, ["kind", "root"], "left")
    whole = joined.groupBy(*form).agg(F.sort_array(F.collect_list(F.struct("pos", "word", "alts", "is_name", "is_title", "df", F.coalesce("common", F.lit(False)).alias("common")))).alias("read"))
    return forms.join(whole, form)


# ---- profiles ------------------------------------------------------------


def _distinguishing(read: list[dict], place: list[bool]) -> int | None:
    """The place of the distinguishing word: the most frequent one that isn't common, else the rarest; the later one of equals."""
    able = [k for k, w in enumerate(read) if w["alts"] and not w["is_name"] and not place[k]]
    rare = [k for k in able if not read[k]["common"]]
    if rare:
        return max(rare, key=lambda k: (read[k]["df"], k))
    return min(able, key=lambda k: (read[k]["df"], -k), default=None)


def _word(w: dict) -> list[str]:
    return w["alts"] or [w["word"]]


def profile_name(read: list[dict]) -> dict:
    """N, G, F, K, T of a person's name; each a list of possible words or None. G and F may be initials of one letter."""
    got: dict = dict.fromkeys("NGFKT")
    prev = ["", *(w["word"] for w in read[:-1])]
    place = [p in SON[:2] or (p == SON[2] and k > 1) or p == FATHER for k, p in enumerate(prev)]
    n = _distinguishing(read, place)
    if n is None:
        return got
    got["N"] = _word(read[n])
    names: list[list[str]] = []
    fresh = True
    for k, w in enumerate(read):
        if k == n or w["word"] == FATHER and k + 1 < len(read):
            continue
        if w["word"] == SON[0] or (w["word"] in SON and names):
            continue
        if w["word"] == SON[1]:
            fresh = False
        elif prev[k] == FATHER:
            got["K"] = _word(w)
        elif place[k] or w["is_name"] or len(w["word"]) == 1:
            names.append(_word(w))
        elif not w["is_title"] and (w["common"] or w["word"].startswith(THE)):
            got["T"] = got["T"] or _word(w)[:1]
        elif not w["is_title"] and not w["common"]:
            names.append(_word(w))
    if fresh:
        got["G"], got["F"] = ([*names, None, None])[:2]
    else:
        got["F"] = names[0] if names else None
    return got


def profile_title(read: list[dict]) -> dict:
    """N, G (the word before N, or its initial) and F (the last distinguishing word behind N) of a book's title."""
    got: dict = dict.fromkeys("NGFKT")
    n = _distinguishing(read, [False] * len(read))
    if n is None:
        return got
    got["N"] = _word(read[n])
    if n and not (len(read[n - 1]["word"]) > 1 and not read[n - 1]["alts"]):
        g = _word(read[n - 1])[0]
        got["G"] = [g[2:] if g.startswith(THE) and len(g) > 4 else g]
    behind = [w for w in read[n + 1 :] if w["alts"] and not w["common"]]
    if behind:
        got["F"] = _word(behind[-1])[:1]
    return got


FACTS = ("G", "F", "K", "T")
PROFILE = "field string, same string, kind string, rows long, N string, G array<string>, F array<string>, K array<string>, T array<string>"


def profiles(forms: DataFrame) -> DataFrame:
    """(field, same, kind, rows, N, G, F, K, T) of ``forms`` (field, same, kind, rows, read)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.list_(pa.string())
        for batch in batches:
            kinds, reads = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            rows = [profile_title(r) if k == "title" else profile_name(r) for k, r in zip(kinds, reads, strict=True)]
            made = [pa.array([r["N"][0] if r["N"] else None for r in rows], pa.string()), *(pa.array([r[k] for r in rows], texts) for k in FACTS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], names=["field", "same", "kind", "rows", "N", *FACTS])

    return forms.select("field", "same", "kind", "rows", "read").mapInArrow(run, PROFILE)


# ---- merging -------------------------------------------------------------

#: The facts that are certain, and the initials of given name and father.
CERTAIN = ("cg", "cf", "ck", "ct", "ig", "if")


class Profile:
    """A profile as the rounds see it: certain facts, initials, and the words that doubtful facts may stand for."""

    __slots__ = ("node", "n", "own", "doubt", "full", "initial", "met", "title", "label")

    def __init__(self, node: int, n: int, facts: list[list[str] | None], met: list[str] | None, title: bool):
        single = [x[0] if x and len(x) == 1 and len(x[0]) > 1 else None for x in facts]
        self.node, self.n, self.title, self.met, self.label = node, n, title, met or [], node
        self.own = (*single, *(x[0][:1] if x else None for x in facts[:2]))
        self.full = [[w for w in x or [] if len(w) > 1] for x in facts]
        self.initial = facts[0][0][:1] if facts[0] else None
        self.doubt = any(x and len(x) > 1 for x in facts[:3])


def certain_keys(c: tuple, title: bool, final: bool) -> list[tuple[str, str]]:
    """Block keys from certain facts and initials (in the order of CERTAIN)."""
    g, f, k, t, gi, fi = c
    out = []
    if g and f:
        out.append(("gf", g + "|" + f))
    if gi and f:
        out.append(("if", gi + "|" + f))
    if g and fi:
        out.append(("gi", g + "|" + fi))
    out += [(kind, x) for kind, x in (("g", g), ("f", f), ("k", k)) if x]
    if title:
        out.append(("n", ""))
    elif t:
        out.append(("t", t))
    if final:  # by elimination: the only full profile of a name that has no kunya (by-name) yet, and the only kunya without a person
        full, bare = bool(g and f), not gi and not fi
        if (full and not k) or (bare and k):
            out.append(("no k", ""))
        if (full and not t) or (bare and t and not k):
            out.append(("no t", ""))
    return out


def doubtful_keys(p: Profile) -> list[tuple[int, str, str]]:
    """Block keys of a profile in doubt with their level, the finest first."""
    g, f, k, t = p.full
    out = [(1, "gf", x + "|" + y) for x in g for y in f]
    if p.initial:
        out += [(2, "if", p.initial + "|" + y) for y in f]
    out += [(3, kind, x) for kind, xs in (("g", g), ("f", f), ("k", k)) for x in xs]
    return out + [(4, "t", x) for x in t]


def united(people: list[Profile]) -> dict[int, tuple]:
    """By label what all of an entity's profiles together know; a fact on which they differ is unknown."""
    seen: dict[int, list[set]] = {}
    for p in people:
        for s, x in zip(seen.setdefault(p.label, [set() for _ in CERTAIN]), p.own, strict=True):
            if x is not None:
                s.add(x)
    return {a: tuple(next(iter(s)) if len(s) == 1 else None for s in sets) for a, sets in seen.items()}


def enriched(p: Profile, known: dict[int, tuple]) -> tuple:
    more = known[p.label]
    c = [a or b for a, b in zip(p.own[:4], more[:4], strict=True)]
    return (*c, *((c[k][:1] if c[k] else p.own[4 + k] or more[4 + k]) for k in range(2)))


def merge_round(people: list[Profile], final: bool) -> bool:
    """Unite the facts of merged profiles, block them again, merge the blocks without contradiction; True if any label moved."""
    known = united(people)
    rich = [enriched(p, known) for p in people]
    blocks: dict[tuple[str, str], list] = {}
    keys = []
    for p, c in zip(people, rich, strict=True):
        own = [*certain_keys(c, p.title, final), *(("met", m) for m in p.met)]
        keys.append(own)
        for key in own:
            b = blocks.setdefault(key, [p.label, c, True])
            b[0] = min(b[0], p.label)
            if b[2]:
                b[2] = all(x is None or y is None or x == y for x, y in zip(b[1], c, strict=True))
                b[1] = tuple(x if x is not None else y for x, y in zip(b[1], c, strict=True))
    whole = {key: b[0] for key, b in blocks.items() if b[2] or key[0] == "gf"}
    to: dict[int, int] = {}
    for p, own in zip(people, keys, strict=True):
        ends = [whole[key] for key in own if key in whole]
        if p.doubt:
            levels: dict[int, set[int]] = {}
            for level, *key in doubtful_keys(p):
                if tuple(key) in whole:
                    levels.setdefault(level, set()).add(whole[tuple(key)])
            # of the keys in doubt the finest level counts, and only if all of it leads to one entity
            if levels and len(finest := levels[min(levels)]) == 1:
                ends += finest
        end = min([p.label, *ends])
        if end < p.label:
            to[p.label] = min(end, to.get(p.label, end))
    for p in people:
        p.label = to.get(p.label, p.label)
    return bool(to)


def merge(people: list[Profile]) -> None:
    """Rounds until nothing moves; then rounds with elimination, again until nothing moves."""
    for final in (False, True):
        while merge_round(people, final):
            pass


def is_whole(p: Profile) -> bool:
    """A full name and nothing else."""
    return bool(p.own[0] and p.own[1] and not p.full[2] and not p.full[3])


def is_bare(p: Profile) -> bool:
    """A kunya or by-name only."""
    return p.initial is None and not p.own[5] and bool(p.full[2] or p.full[3])


def attach(people: list[Profile], mean: float, deviation: float) -> None:
    """Entities of mere kunyas or by-names go to the person that their number of rows makes likelier than all others together."""
    while True:
        known = united(people)
        whole: dict[int, int] = {}
        named: set[int] = set()
        bare: dict[int, int] = {}
        for p in people:
            if is_whole(p):
                whole[p.label] = whole.get(p.label, 0) + p.n
            if not is_bare(p):
                named.add(p.label)
            else:
                bare[p.label] = bare.get(p.label, 0) + p.n
        persons = sorted(whole)
        size = np.log([whole[x] for x in persons])
        found = []
        for b in sorted(set(bare) - named):
            k, t = known[b][2:4]
            able = [i for i, x in enumerate(persons) if all(a is None or c is None or a == c for a, c in zip((k, t), known[x][2:4], strict=True))]
            if able:
                z = (math.log(bare[b]) - size[able] - mean) / deviation
                w = np.exp(-0.5 * (z * z - (z * z).min()))
                sure = round(float(w.max() / w.sum()), DIGITS)
                if sure >= SURE:
                    found.append((sure, b, persons[able[int(w.argmax())]]))
        to: dict[int, int] = {}
        for _, b, x in sorted(found, key=lambda f: (-f[0], f[1])):
            if x not in to.values():  # one at a time for each person, whose facts then grow
                to[b] = x
        if not to:
            return
        for p in people:
            p.label = to.get(p.label, p.label)


NODE = ["node", "field", "N", "kind", "rows", *FACTS]


def _by_block(rows: DataFrame, extra: str, work) -> DataFrame:
    """``work`` on all profiles of each N (field, N), one N at a time; (node, label, whole, bare) come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block: list[tuple]) -> pa.RecordBatch:
            people = work(block)
            columns = [[p.node for p in people], [p.label for p in people], [p.n if is_whole(p) else 0 for p in people], [p.n if is_bare(p) else 0 for p in people]]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["node", "label", "whole", "bare"])

        key, block = None, []
        done: list[pa.RecordBatch] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1:3] != key:
                    if block:
                        done.append(out(block))
                    key, block = row[1:3], []
                    if len(done) > 500:
                        yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                        done = []
                block.append(row)
        if block:
            done.append(out(block))
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    rows = rows.select(*NODE, extra).repartition("field", "N").sortWithinPartitions("field", "N", "node")
    return rows.mapInArrow(run, "node long, label long, whole long, bare long")


def _people(block: list[tuple], met: bool) -> list[Profile]:
    return [Profile(r[0], r[4], list(r[5:9]), r[9] if met else None, r[3] == "title") for r in block]


def _merged(block: list[tuple]) -> list[Profile]:
    people = _people(block, True)
    merge(people)
    return people


def _attached(mean: float, deviation: float):
    def work(block: list[tuple]) -> list[Profile]:
        people = _people(block, False)
        for p, r in zip(people, block, strict=True):
            p.label = r[9]
        if block[0][3] == "name":
            attach(people, mean, deviation)
        return people

    return work


def _met(context: DataFrame, read: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, value): pairs of profiles with one distinguishing name that meet under a key of ``context``; each pair is a block.

    Profiles under a key are chained in the order of their facts, and each is paired with the first.
    """
    seen = context.filter("name is not null and key is not null").select("field", "name", "key").distinct()
    at = seen.join(read.select("field", "name", "same"), ["field", "name"]).join(nodes.select("field", "same", "N", "node", *FACTS), ["field", "same"])
    at = at.groupBy("field", "N", "key", "node").agg(*[F.first(x).alias(x) for x in FACTS])
    order = Window.partitionBy("field", "N", "key").orderBy(*[F.coalesce(F.col(x)[0], F.lit("")) for x in FACTS], "node")
    at = at.select("node", F.lag("node").over(order).alias("last"), F.first("node").over(order).alias("first"))
    ends = at.select("node", F.explode(F.array("last", "first")).alias("other"))
    pairs = ends.filter("other is not null and other <> node").select(F.least("node", "other").alias("low"), F.greatest("node", "other").alias("high")).distinct()
    return pairs.select(F.explode(F.array("low", "high")).alias("node"), F.concat_ws("-", "low", "high").alias("value"))


def resolve(values: DataFrame, context: DataFrame | None = None, titles: tuple[str, ...] = ("book",), large: int = LARGE) -> DataFrame:
    """(field, name, entity): spellings of one entity get the same ``entity``. ``values`` has (field, name).

    ``titles`` are the fields that hold titles, the others hold persons' names.
    ``context`` (field, name, key) may tell where names stand: two names with one
    distinguishing name under the same key are one entity, unless they contradict
    each other. A key is as fine as one statement about one thing.
    """
    counted = values.filter("name is not null").groupBy("field", "name").agg(F.count("*").alias("rows"))
    read = spellings(counted, titles).checkpoint()
    kind = F.when(F.col("field").isin(*titles), "title").otherwise("name")
    forms = read.groupBy("field", "same").agg(F.first("words").alias("words"), F.sum("rows").alias("rows")).withColumn("kind", kind).checkpoint()
    # spellings with equal profiles are one node from the start
    sign = F.xxhash64("field", "N", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FACTS])
    nodes = profiles(read_words(forms, vocabulary(forms))).filter("N is not null").withColumn("node", sign).checkpoint()
    base = nodes.groupBy("node").agg(*[F.first(c).alias(c) for c in ("field", "N", "kind")], F.sum("rows").alias("rows"), *[F.first(c).alias(c) for c in FACTS])
    met = _met(context, read, nodes) if context is not None else None
    base = base.join(met.groupBy("node").agg(F.collect_set("value").alias("met")), "node", "left") if met is not None else base.withColumn("met", F.lit(None).cast("array<string>"))
    base = base.checkpoint()
    heavy = base.groupBy("field", "N").agg(F.count("*").alias("m")).filter(F.col("m") > large).select("field", "N")
    merged = _by_block(base.join(heavy, ["field", "N"], "left_anti"), "met", _merged).checkpoint()
    many = None if heavy.isEmpty() else _merged_by_rounds(base.join(heavy, ["field", "N"], "left_semi"))
    # what rows of mere kunyas and by-names are to rows of full names, in logarithms
    counts = merged.select("label", "whole", "bare")
    counts = counts if many is None else counts.unionByName(many.select("label", _whole_rows().alias("whole"), _bare_rows().alias("bare")))
    both = counts.groupBy("label").agg(F.sum("whole").alias("whole"), F.sum("bare").alias("bare")).filter("whole > 0 and bare > 0")
    size, mean, deviation = both.agg(F.count("*"), F.avg(F.log(F.col("bare") / F.col("whole"))), F.stddev(F.log(F.col("bare") / F.col("whole")))).first()
    ends = merged.select("node", "label")
    if size > 10 and deviation:
        ends = _by_block(base.join(ends, "node"), "label", _attached(mean, deviation)).select("node", "label")
        many = many if many is None else _attached_by_rounds(many, mean, deviation)
    ends = ends if many is None else ends.unionByName(many.select("node", "label"))
    named = read.join(nodes.select("field", "same", "node"), ["field", "same"], "left").join(ends, "node", "left")
    # a spelling without a distinguishing name goes with those that differ in formatting only
    return named.select("field", "name", F.coalesce("label", F.xxhash64("field", "same")).alias("entity"))


# ---- the same rounds as grouped aggregates, for names of very many profiles ----


def _single(k: str) -> Column:
    """A fact that is known in full and not in doubt."""
    return F.when((F.size(k) == 1) & (F.length(F.col(k)[0]) > 1), F.col(k)[0])


def _keys(final: bool) -> Column:
    """As :func:`certain_keys`: kind and value; null values are no keys."""
    g, f, k, t, gi, fi = (F.col(x) for x in CERTAIN)
    bar, title = F.lit("|"), F.col("kind") == "title"
    made = [
        ("gf", F.concat(g, bar, f)), ("if", F.concat(gi, bar, f)), ("gi", F.concat(g, bar, fi)),
        ("g", g), ("f", f), ("k", k), ("t", F.when(~title, t)), ("n", F.when(title, F.lit(""))),
    ]
    if final:
        full, bare = g.isNotNull() & f.isNotNull(), gi.isNull() & fi.isNull()
        made += [("no k", F.when((full & k.isNull()) | (bare & k.isNotNull()), F.lit(""))), ("no t", F.when((full & t.isNull()) | (bare & t.isNotNull() & k.isNull()), F.lit("")))]
    return F.filter(F.array(*[F.struct(F.lit(a).alias("way"), b.alias("value")) for a, b in made]), lambda x: x.value.isNotNull())


def _full(k: str) -> Column:
    """The possible words of a fact, without initials; [] if there is none."""
    return F.coalesce(F.filter(k, lambda x: F.length(x) > 1), F.array().cast("array<string>"))


def _key(level: int, way: str, value: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(way).alias("way"), value.alias("value"))


def _single_keys(k: str) -> Column:
    return F.transform(_full(k), lambda x: _key(4 if k == "T" else 3, k.lower(), x))


def _one(name: str) -> Column:
    return F.coalesce(F.min(name) == F.max(name), F.lit(True))


def _merged_by_rounds(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their label, as :func:`merge`; a label moves down only, so the rounds come to an end."""
    base = nodes.withColumns({f"c{k.lower()}0": _single(k) for k in FACTS} | {f"i{k.lower()}0": F.substring(F.col(k)[0], 1, 1) for k in "GF"})
    doubt = F.greatest(*[F.coalesce(F.size(k), F.lit(0)) for k in "GFK"]) > 1
    base = base.withColumn("doubt", doubt).withColumn("label", F.col("node")).checkpoint()
    for final in (False, True):
        while True:
            state = _round(base, final).checkpoint()
            base = state.drop("before")
            if state.filter("label <> before").isEmpty():
                break
    return base


def _round(base: DataFrame, final: bool) -> DataFrame:
    """As :func:`merge_round`."""
    known = base.groupBy("label").agg(*[F.when(F.min(x + "0") == F.max(x + "0"), F.min(x + "0")).alias(x) for x in CERTAIN])
    rich = base.join(known, "label")
    rich = rich.withColumns({x: F.coalesce(x + "0", x) for x in CERTAIN[:4]})
    rich = rich.withColumns({f"i{x}": F.coalesce(F.substring(f"c{x}", 1, 1), f"i{x}0", f"i{x}") for x in "gf"})
    # level 0: certain keys; above: keys of profiles in doubt, the finest first
    pairs = F.flatten(F.transform(_full("G"), lambda g: F.transform(_full("F"), lambda f: _key(1, "gf", F.concat(g, F.lit("|"), f)))))
    half = F.concat(
        F.transform(_full("F"), lambda f: _key(2, "if", F.concat(F.substring(F.col("G")[0], 1, 1), F.lit("|"), f))),
        *[_single_keys(k) for k in "GFKT"],
    )
    own = F.transform(_keys(final), lambda x: F.struct(F.lit(0).alias("level"), x.way.alias("way"), x.value.alias("value")))
    soft = F.filter(F.concat(pairs, half), lambda x: x.value.isNotNull())
    keyed = rich.withColumn("key", F.explode(F.when(F.col("doubt"), F.concat(own, soft)).otherwise(own))).select("node", "label", "field", "N", "key.level", "key.way", "key.value", *CERTAIN)
    met = rich.select("*", F.explode("met").alias("value")).withColumns({"level": F.lit(0), "way": F.lit("met")})
    keyed = keyed.unionByName(met.select(*keyed.columns))
    block = ["field", "N", "way", "value"]
    whole = keyed.filter("level = 0").groupBy(*block).agg(F.min("label").alias("to"), *[_one(x).alias("one_" + x) for x in CERTAIN])
    # given and father together decide alone; otherwise nothing may contradict
    whole = whole.filter("way = 'gf' or (" + " and ".join("one_" + x for x in CERTAIN) + ")").select(*block, "to")
    of = lambda f, k: f(F.when(F.col("level") == k, F.col("to")))
    ends = [of(F.min, k).alias(f"low{k}") for k in range(5)] + [of(F.max, k).alias(f"high{k}") for k in range(1, 5)]
    found = keyed.select("node", "level", *block).join(whole, block).groupBy("node").agg(*ends)
    # of the keys in doubt the finest level counts, and only if all of it leads to one entity
    finest = F.coalesce(*[F.when(F.col(f"low{k}").isNotNull(), F.struct(F.col(f"low{k}").alias("to"), F.col(f"high{k}").alias("high"))) for k in range(1, 5)])
    found = found.select("node", F.col("low0").alias("firm"), finest.alias("x"))
    joined = base.join(found, "node", "left").withColumn("before", F.col("label"))
    end = F.least("before", "firm", F.when(F.col("x.to") == F.col("x.high"), F.col("x.to")))
    # all members of a label go where the least of their ends is
    moved = joined.filter(end < F.col("before")).groupBy(F.col("before").alias("old")).agg(F.min(end).alias("new"))
    return joined.join(moved, F.col("before") == F.col("old"), "left").withColumn("label", F.coalesce("new", "before")).drop("firm", "x", "old", "new")


def _whole_rows() -> Column:
    """The rows of a full name and nothing else, as :func:`is_whole`; else 0."""
    whole = F.col("cg0").isNotNull() & F.col("cf0").isNotNull() & (F.size(_full("K")) == 0) & (F.size(_full("T")) == 0)
    return F.when(whole, F.col("rows")).otherwise(0)


def _bare_rows() -> Column:
    """The rows of a mere kunya or by-name, as :func:`is_bare`; else 0."""
    bare = F.col("G").isNull() & F.col("F").isNull() & ((F.size(_full("K")) > 0) | (F.size(_full("T")) > 0))
    return F.when(bare, F.col("rows")).otherwise(0)


def _attached_by_rounds(nodes: DataFrame, mean: float, deviation: float) -> DataFrame:
    """As :func:`attach`. Persons of one N with equal kunya, by-name and number of rows are weighed once."""
    base = nodes
    one = lambda x: F.when(F.min(x) == F.max(x), F.min(x)).alias(x)
    alike = lambda x: F.col("b." + x).isNull() | F.col("p." + x).isNull() | (F.col("b." + x) == F.col("p." + x))
    while True:
        rows = base.filter("kind = 'name'").withColumns({"whole": _whole_rows(), "bare": _bare_rows()})
        known = rows.groupBy("field", "N", "label").agg(one("ck0"), one("ct0"), F.sum("whole").alias("whole"), F.sum("bare").alias("bare"), F.bool_or(F.col("bare") == 0).alias("named")).checkpoint()
        persons = known.filter("whole > 0").groupBy("field", "N", "ck0", "ct0", "whole").agg(F.count("*").alias("m"), F.min("label").alias("person"))
        bare = known.filter("not named")
        kinds = bare.groupBy("field", "N", "ck0", "ct0", "bare").agg(F.min("label").alias("kind"))
        z = (F.log("b.bare") - F.log("p.whole") - F.lit(mean)) / F.lit(deviation)
        able = (F.col("b.field") == F.col("p.field")) & (F.col("b.N") == F.col("p.N")) & alike("ck0") & alike("ct0")
        pairs = kinds.alias("b").join(persons.alias("p"), able).select("kind", "m", "person", (z * z).alias("z2"))
        least = pairs.groupBy("kind").agg(F.min("z2").alias("low"), F.min_by("person", "z2").alias("to"))
        sure = F.round(1 / F.sum(F.col("m") * F.exp(-0.5 * (F.col("z2") - F.col("low")))), DIGITS)
        likely = pairs.join(least, "kind").groupBy("kind", "to").agg(sure.alias("sure")).filter(F.col("sure") >= SURE)
        same = [F.col("x." + c).eqNullSafe(F.col("k." + c)) for c in ("field", "N", "ck0", "ct0", "bare")]
        found = bare.alias("x").join(kinds.alias("k"), same).select("x.label", "k.kind").join(likely, "kind")
        # one at a time for each person, whose facts then grow
        to = found.groupBy("to").agg(F.min_by("label", F.struct(-F.col("sure"), "label")).alias("old")).checkpoint()
        if to.isEmpty():
            return base
        base = base.join(to, F.col("label") == F.col("old"), "left").withColumn("label", F.coalesce("to", "label")).drop("to", "old").checkpoint()


def variant_pairs(values: DataFrame, context: DataFrame | None = None, titles: tuple[str, ...] = ("book",)) -> DataFrame:
    """Pairs (field, name_a, name_b), name_a < name_b by code point, of distinct spellings of one entity."""
    found = resolve(values, context, titles).checkpoint()
    a = found.select("field", "entity", F.col("name").alias("name_a"))
    b = found.select("field", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["field", "entity"]).filter("name_a < name_b").select("field", "name_a", "name_b")
