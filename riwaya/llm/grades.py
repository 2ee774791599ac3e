"""Problem 2: freely typed values to the entries of a reference list.

Method: a symmetric-delete dictionary of the reference phrases is broadcast (its
size follows from the reference list alone). Every run of words of a value is
looked up within a bounded edit distance; candidates are ranked by the number of
words explained, by weighted Damerau-Levenshtein distance and by the frequency
of the entry in the data. The words around a phrase are judged one by one, with
no least number of entries or values: an exact phrase counts unless a word beside
it stands in more rows without any phrase than around exact phrases; an edited
one (or an abbreviation) counts if each word beside it is of ``FRAME_WORDS`` or
stands around exact phrases at least as often as elsewhere. A phrase right behind
a negation that isn't part of it doesn't count. Values without a candidate are
reported with the entry 0.

Other expressions of an entry follow from the list by the morphology of Arabic: the
indefinite accusative of a word, «in it» with a noun of an entry's root, a verb of
the root with its object, a degree adjective with a noun of the root (for the entry
that has the root and the degree adverb), and, for an entry that begins with a
negation, any negation before a word of the same root. A root is what remains of a
word without its weak letters, prefixes and endings.

Defined cases: null values are left out; '' and values without letters give 0;
ties go to the more frequent entry, then to the smaller ref_id.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from riwaya.llm import codes as C
from riwaya.llm.forms import consistent

# ---- fixed values -------------------------------------------------------
#: Words that say nothing against a phrase beside them, in any table.
FRAME_WORDS = """هو وهو هي وهي هذا هذه وهذا بهذا إنه وإنه قلت قال وقال قالوا حديث الحديث حديثه خبر الخبر أثر رواية إسناد الإسناد إسناده وإسناده سند السند سنده
وسنده متن المتن متنه طريق الطريق السياق اللفظ الوجه فيه وفيه في من على عن عند عندي إن شاء الله فيما يظهر الأرجح الظاهر الصواب والله أعلم كله جدا""".split()
#: Words that turn the phrase behind them into its contrary.
NEGATIONS = "لا ولا غير وغير ليس وليس ليست لم ولم ما وما بلا".split()
#: «In it», before a noun that tells what a text has.
IN_IT = ("فيه", "وفيه")
#: «Very», behind an adjective, and before a noun.
VERY, VERY_OF = "جدا", "شديد"
#: Weak letters, which the forms of a root change.
WEAK = "اويىء"
#: Letters that are taken for one another: a substitution costs half.
CLOSE = ("صس", "ضظ", "تط", "ثس", "ذد", "ذز", "زر", "حخ", "جح", "جخ", "عغ", "قف", "بتثني", "كل", "sz", "gj", "qk", "dt", "iy", "uw")
FOLD = str.maketrans("أإآٱىةؤئ", "ااااي" + "هوي")
# -------------------------------------------------------------------------

MARKS = re.compile("[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED\u0640]")
WORD = re.compile(r"[^\W_]+")
#: A phrase has at most this many words.
MOST_WORDS = 4


def words(text: str) -> list[str]:
    text = unicodedata.normalize("NFC", text).replace("'", "").replace("’", "").replace("ʿ", "")
    return WORD.findall(MARKS.sub("", text).translate(FOLD).lower())


def allowed(phrase: str) -> int:
    """Edits allowed: none for abbreviations, one up to eight letters, two beyond."""
    return 0 if len(phrase) < 3 else 1 if len(phrase) <= 8 else 2


def deletes(phrase: str, most: int) -> set[str]:
    out = level = {phrase}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


@functools.cache
def _close() -> frozenset[str]:
    """Pairs of different letters that are taken for one another."""
    return frozenset(x + y for s in CLOSE for x in s for y in s if x != y)


def distance(a: str, b: str) -> float:
    """Weighted Damerau-Levenshtein: letters often confused and doubled letters cost half, swaps 0.75."""
    pair = _close()
    d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = float(i + j)
                continue
            x, y = a[i - 1], b[j - 1]
            put = 0.0 if x == y else 0.5 if x + y in pair else 1.0
            d[i][j] = min(d[i - 1][j - 1] + put, d[i - 1][j] + (0.5 if i > 1 and a[i - 2] == x else 1.0), d[i][j - 1] + (0.5 if j > 1 and b[j - 2] == y else 1.0))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 0.75)
    return d[-1][-1]


def edits(a: str, b: str) -> int:
    """Plain Damerau-Levenshtein (optimal string alignment)."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def root(word: str) -> str:
    """What the forms of a root have in common: no article, no weak letters, no prefix or ending, doubled letters once."""
    word = word[2:] if word.startswith("ال") and len(word) > 4 else word
    word = word[:-1] if word.endswith("ه") and len(word) > 3 else word  # a feminine ending or a pronoun
    word = word[1:] if word.startswith("م") and len(word) > 3 else word
    strong = "".join(c for c in word if c not in WEAK)
    strong = strong[1:] if strong.startswith("ت") and len(strong) > 3 else strong
    return "".join(c for k, c in enumerate(strong) if not k or c != strong[k - 1])


@dataclass
class Entries:
    """What is looked up: phrases by their deletions, entries by root, by root with a degree, and by the root of what they deny."""

    phrases: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    roots: dict[str, int] = field(default_factory=dict)
    very: dict[str, int] = field(default_factory=dict)
    denied: dict[str, int] = field(default_factory=dict)


#: Keys of the dictionary at most; a longer reference list isn't one to broadcast.
MOST_KEYS = 5_000_000
#: Words that turn the phrase behind them into its contrary, as typed words are read.
DENY = frozenset(w for x in NEGATIONS for w in words(x))


def dictionary(reference: Iterable[Row]) -> Entries:
    """The symmetric-delete dictionary (each deletion of each phrase -> (phrase, ref_id)) and the roots of the entries."""
    out, keys = Entries(), 0

    def put(phrase: str, most: int, ref: int) -> None:
        nonlocal keys
        keys += len(phrase) ** most
        if keys > MOST_KEYS:
            raise ValueError("the reference list is too long to be broadcast as a dictionary")
        for key in deletes(phrase, most):
            out.phrases.setdefault(key, []).append((phrase, ref))

    for row in reference:
        ref, name = row["ref_id"], words(row["grade_ar"] or "")
        for phrase in dict.fromkeys(" ".join(words(x or "")) for x in (row["grade_ar"], row["grade_latin"])):
            if phrase:
                put(phrase, allowed(phrase), ref)
        if row["abbrev"]:
            put(" ".join(words(row["abbrev"])), 0, ref)
        if len(name) == 1:
            put(name[0] + "ا", 0, ref)  # the indefinite accusative
            if len(root(name[0])) > 1:
                out.roots.setdefault(root(name[0]), ref)
        elif len(name) == 2 and name[1] == VERY:
            out.very.setdefault(root(name[0]), ref)
        elif len(name) > 1 and name[0] in DENY:
            out.denied.setdefault(root(name[1]), ref)
    return out


class Candidate(NamedTuple):
    """A run of words that may mean an entry, and what stands around it."""

    before: str
    after: str
    ref: int
    words: int
    distance: float
    exact: bool
    phrase: str


class Lookup:
    """Candidates of values; runs of words come again, so what they match is remembered."""

    def __init__(self, entries: Entries):
        self.entries = entries
        self.known: dict[str, list[tuple[int, float, bool, str]]] = {}

    def matches(self, run: str) -> list[tuple[int, float, bool, str]]:
        """(ref_id, distance, exact, phrase) of the phrases within the allowed distance of a run."""
        found = self.known.get(run)
        if found is None:
            found = []
            for phrase, ref in sorted({hit for key in deletes(run, 2 if len(run) > 7 else 1 if len(run) > 2 else 0) for hit in self.entries.phrases.get(key, ())}):
                most = allowed(phrase)
                if run == phrase or (most and edits(run, phrase) <= most):
                    found.append((ref, distance(run, phrase), run == phrase, phrase))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[run] = found
        return found

    def by_root(self, w: list[str]) -> Iterator[tuple[int, int, int]]:
        """(first word, end, ref_id) of expressions that share the root of an entry."""
        e = self.entries
        for k, word in enumerate(w):
            follow = w[k + 1] if k + 1 < len(w) else None
            if word in IN_IT and follow and root(follow) in e.roots:
                yield k, k + 2, e.roots[root(follow)]
            if word == VERY_OF and follow and root(follow) in e.very:
                yield k, k + 2, e.very[root(follow)]
            if word.endswith("ه") and len(word) > 3 and not set(word) & set(WEAK) and root(word) in e.roots:
                yield k, k + 1, e.roots[root(word)]
            if word in DENY:
                for j in range(k + 1, min(k + 3, len(w))):  # a pronoun may stand between
                    bare = w[j][1:] if w[j].startswith("ب") else w[j]
                    ref = e.denied.get(root(bare), e.denied.get(root(w[j])))
                    if ref is not None and (j == k + 1 or len(w[k + 1]) < 3):
                        yield k, j + 1, ref
                        break

    def candidates(self, value: str) -> list[Candidate]:
        """All runs of words that are within the allowed distance of a phrase, or share a root as an expression of an entry does."""
        w, out = words(value), []
        around = lambda k, j: (" ".join(w[:k]), " ".join(w[j:]))
        for n in range(1, min(MOST_WORDS, len(w)) + 1):
            for k in range(len(w) - n + 1):
                out += [Candidate(*around(k, k + n), ref, n, far, exact, phrase) for ref, far, exact, phrase in self.matches(" ".join(w[k : k + n]))]
        out += [Candidate(*around(k, j), ref, j - k, 0.0, True, " ".join(w[k:j])) for k, j, ref in self.by_root(w)]
        return out


def candidates(value: str, entries: Entries) -> list[Candidate]:
    """The candidates of one value."""
    return Lookup(entries).candidates(value)


def map_values(values: DataFrame, reference: DataFrame, column: str = "grade") -> DataFrame:
    """(<column>, ref_id, distance) for each distinct non-null value; ref_id 0 and null where nothing is meant.

    ``reference`` (ref_id, grade_ar, grade_latin, abbrev) is a list kept by hand;
    it is collected to build the dictionary.
    """
    spark = values.sparkSession
    entries = spark.sparkContext.broadcast(dictionary(reference.select("ref_id", "grade_ar", "grade_latin", "abbrev").orderBy("ref_id").limit(MOST_KEYS).collect()))
    # a given number, so that few values aren't put into few tasks: what costs is Python, not bytes
    distinct = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).repartition(spark.sparkContext.defaultParallelism, "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(entries.value)
        for batch in batches:
            made: list[tuple] = []
            form = C.to_arrow(*consistent(*C.to_codes(batch.column(0)))).to_pylist()
            for value, plain, n in zip(batch.column(0).to_pylist(), form, batch.column(1).to_pylist(), strict=True):
                found = lookup.candidates(plain)
                made += [(value, n, *x) for x in found] or [(value, n, " ".join(words(plain)), "", None, None, None, None, None)]
            names = ["value", "n", "before", "after", "ref_id", "words", "distance", "exact", "phrase"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.string()]
            columns = zip(*made, strict=True) if made else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    found = distinct.mapInArrow(run, "value string, n long, before string, after string, ref_id int, words int, distance double, exact boolean, phrase string").checkpoint()
    frame, beside = F.concat_ws(" ", "before", "after"), F.explode(F.array_distinct(F.split(F.concat_ws(" ", "before", "after"), " "))).alias("word")
    exact = found.filter("exact")
    # by word: rows where it stands around an exact phrase, in a value without one, and in a value without any phrase
    full = F.coalesce(F.col("exact") & (F.length(F.translate(F.col("phrase"), " ", "")) > 2), F.lit(False))
    kind = found.withColumn("full", full).withColumn("has", F.max("full").over(Window.partitionBy("value")))
    seen = kind.filter("full or not has").select("value", "n", "has", F.col("ref_id").isNull().alias("none"), beside).filter("word != ''").distinct()
    rows = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    words_seen = seen.groupBy("word").agg(rows(F.col("has")).alias("pro"), rows(~F.col("has")).alias("con"), rows(F.col("none")).alias("con_none"))
    fixed = F.col("word").isin(sorted({w for x in FRAME_WORDS for w in words(x)})) | (F.col("word") == "")
    frames = found.select(frame.alias("frame"), beside).distinct().join(words_seen, "word", "left").groupBy("frame").agg(
        F.bool_and(fixed | F.coalesce((F.col("pro") > 0) & (F.col("pro") >= F.col("con")), F.lit(False))).alias("usual"),
        F.bool_or(~fixed & F.coalesce(F.col("con_none") > F.col("pro"), F.lit(False))).alias("against"),
    )
    denied = F.element_at(F.split("before", " "), -1).isin(sorted(DENY))
    known = kind.filter("ref_id is not null").withColumn("frame", frame).join(frames, "frame").filter(~denied & F.expr("usual or (full and not against)"))
    often = exact.groupBy("ref_id").agg(F.sum("n").alias("often"))
    rank = Window.partitionBy("value").orderBy(F.desc("words"), "distance", F.desc("often"), "ref_id")
    best = known.join(often, "ref_id", "left").withColumn("often", F.coalesce("often", F.lit(0))).withColumn("r", F.row_number().over(rank)).filter("r = 1").select("value", "ref_id", "distance")
    out = found.select("value").distinct().join(best, "value", "left")
    return out.select(F.col("value").alias(column), F.coalesce("ref_id", F.lit(0)).cast("int").alias("ref_id"), "distance")
