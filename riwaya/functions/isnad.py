"""Chains of transmission: splitting a report into chain and text, and a chain into its links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riwaya.functions.text import WHITE, trim_white

# ---- fixed values -------------------------------------------------------
COMMA = "،"
#: Marks passed over within a verb of transmission.
INNER = "[\u0640\u064B-\u0652\u0670]*"
#: A segment with one of these belongs to the chain.
LINKS = ("حدثنا", "حدثني", "أخبرنا", "أخبرني", "أنبأنا", "أنبأني", "سمعت", f"عن[{WHITE}]", "قرأت على", "وحدثنا", "وحدثني", f"نا[{WHITE}]", f"ثنا[{WHITE}]")
#: Verbs of transmission, longer ones first.
VERBS = ("وحدثنا", "وحدثني", "حدثنا", "حدثني", "أخبرنا", "أخبرني", "أنبأنا", "أنبأني", "سمعت", "قرأت على", "عن")
#: «He said» at the end of a name.
SAID = f"[،{WHITE}]*" + r"ق\p{M}*ا\p{M}*ل\p{M}*" + f"[{WHITE}،]*$"
# -------------------------------------------------------------------------

#: Marks dropped before a segment is tested.
STRIPPED = "[\u064B-\u0652\u0670\u0640\u06D6-\u06ED]"
LINK = "(" + "|".join(LINKS) + ")"
#: A verb whose letters may carry marks, and the white space after it.
VERB = "(?:" + "|".join("".join(ch + INNER for ch in v) for v in VERBS) + f")(?:[{WHITE}]{INNER})+"
TAIL = f"[،{WHITE}]+$"


def split_isnad(text: Column) -> tuple[Column, Column]:
    """(isnad, matn): the longest run of leading segments that carry a verb of transmission, and the rest.

    isnad is null, and matn the whole text, if no or every segment does, if
    there is one segment only, or if the rest is empty.
    """
    parts = F.split(text, COMMA)
    flags = F.transform(parts, lambda p: F.regexp_replace(p, STRIPPED, "").rlike(LINK))
    chain = F.when(F.array_contains(flags, False), F.array_position(flags, F.lit(False)) - 1).otherwise(F.size(parts)).cast("int")
    rest = trim_white(F.array_join(F.slice(parts, chain + 1, F.greatest(F.size(parts) - chain, F.lit(0))), COMMA))
    ok = (F.size(parts) > 1) & (chain > 0) & (chain < F.size(parts)) & (rest != "")
    isnad = trim_white(F.concat(F.array_join(F.slice(parts, 1, chain), COMMA), F.lit(COMMA)))
    return F.when(ok, isnad), F.when(ok, rest).otherwise(text)


def chain_names(isnad: Column) -> Column:
    """Names between the verbs of a chain, in order, with their marks; [] for null."""
    source = F.regexp_replace(F.coalesce(isnad, F.lit("")), TAIL, "")
    pieces = F.split(source, VERB)
    names = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: trim_white(F.regexp_replace(trim_white(F.regexp_replace(x, TAIL, "")), SAID, "")))
    return F.filter(names, lambda x: x != "")


def chain_verbs(isnad: Column) -> Column:
    """Verbs of a chain in order, without marks."""
    source = F.regexp_replace(F.coalesce(isnad, F.lit("")), TAIL, "")
    return F.transform(F.regexp_extract_all(source, F.lit(f"({VERB})"), F.lit(1)), lambda v: trim_white(F.regexp_replace(v, STRIPPED, "")))
