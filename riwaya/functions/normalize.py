"""Normalisation for matching, as column expressions without UDFs.

Three profiles: ``link`` for linking, ``search`` for the search index and
``latin`` for texts in Latin script. The first two differ on purpose: ``search``
knows neither Persian letters nor zero-width characters.

Spark has no NFKC. As everything but 36 Arabic letters becomes a space, NFKC
can be replaced by a table of single characters, made here from the Unicode
data: characters that become one letter go through ``translate``, the few that
become several are looked up only in texts that hold one.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------
#: Deleted before matching, by profile, as the inside of a character class.
STRIP = {
    "link": "\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED\u0640\u200B-\u200F\u202A-\u202E\uFEFF",
    "search": "\u064B-\u0652\u0670\u0640\u06D6-\u06ED",
}
#: Letters unified, by profile.
FOLD_FROM = {"link": "أإآٱٲٳىئةؤکگی", "search": "أإآٱىئةؤ"}
FOLD_TO = {"link": "ااااااييهوككي", "search": "ااااييهو"}
# -------------------------------------------------------------------------


@functools.cache
def compatibility(profile: str) -> tuple[str, str, dict[str, str]]:
    """Characters that NFKC turns into Arabic text: one-to-one (from, to), and those with several characters."""
    keep = re.compile(f"[ء-ي{STRIP[profile]}{FOLD_FROM[profile]}]")
    one_from, one_to, many = [], [], {}
    for c in (*range(0x00A0, 0x3100), *range(0xA640, 0xAC00), *range(0xF900, 0xFFF0), *range(0x1D400, 0x1F300)):
        made = unicodedata.normalize("NFKC", chr(c))
        if made == chr(c) or not keep.search(made):
            continue
        if len(made) == 1:
            one_from.append(chr(c))
            one_to.append(made)
        else:
            many[chr(c)] = made
    return "".join(one_from), "".join(one_to), many


def ranges(characters: str) -> str:
    """Characters as the inside of a character class, neighbours drawn together: long lists of single ones are slow."""
    out, points = [], sorted(map(ord, characters))
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def normalize(text: Column | str, profile: str = "link") -> Column:
    """The text in matching form; null and '' give ''."""
    c = F.coalesce(_column(text), F.lit(""))
    if profile == "latin":
        return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.replace(c, F.lit("İ"), F.lit("i"))), r"[^\p{L}\p{N} ]+", " "), " +", " "))
    one_from, one_to, many = compatibility(profile)
    c = F.translate(c, one_from, one_to)
    lookup = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(lookup[x], x)), "")
    c = F.when(c.rlike(f"[{ranges(''.join(many))}]"), spelled).otherwise(c)
    c = F.regexp_replace(c, f"[{STRIP[profile]}]", "")
    c = F.translate(c, FOLD_FROM[profile], FOLD_TO[profile])
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^ء-ي ]+", " "), " +", " "))


def tokens_of(normal: Column) -> Column:
    """Words of a text in matching form; '' has none."""
    return F.filter(F.split(normal, " "), lambda w: w != "")


def tokens(text: Column | str, profile: str = "link") -> Column:
    return tokens_of(normalize(text, profile))


def sql_normalize(expression: str, profile: str = "link") -> str:
    """The same in SQL of DuckDB."""
    if profile == "latin":
        return rf"trim(regexp_replace(regexp_replace(lower(replace(coalesce({expression}, ''), 'İ', 'i')), '[^\p{{L}}\p{{N}} ]+', ' ', 'g'), ' +', ' ', 'g'))"
    one_from, one_to, many = compatibility(profile)
    e = f"translate(coalesce({expression}, ''), '{one_from}', '{one_to}')"
    # the ligatures of lam and alef and the word ligatures; the other ligatures don't occur in the tables
    for a, b in many.items():
        if 0xFEF5 <= ord(a) <= 0xFEFC or a == "ﷺ":
            e = f"replace({e}, '{a}', '{b}')"
    e = f"regexp_replace({e}, '[{STRIP[profile]}]', '', 'g')"
    e = f"translate({e}, '{FOLD_FROM[profile]}', '{FOLD_TO[profile]}')"
    return f"trim(regexp_replace(regexp_replace({e}, '[^ء-ي ]+', ' ', 'g'), ' +', ' ', 'g'))"
