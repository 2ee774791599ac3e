"""Rule-based classes of grades, narrators and generations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riwaya.functions.normalize import normalize

# ---- fixed values -------------------------------------------------------
GRADES = (("موضوع|منكر|متروك|شاذ", "bad"), ("ضعيف", "bad"), ("حسن", "mid"), ("صحيح", "ok"))
NARRATORS = (("صحاب", "ok"), ("متروك|كذاب|وضع", "bad"), ("ضعيف|لين|مجهول", "bad"), ("صدوق|مقبول", "mid"), ("ثقه|حجه|حافظ|امام|ثبت", "ok"))
GENERATIONS = (
    ("companion|sahaba|صحاب", "صحابي"),
    (r"follower.*2nd|tabi'?\)?\s*\[2nd", "تابعي — الطبقة الثانية"),
    ("follower|tabi'", "تابعي"),
    (r"succ.*taba'?\s*tabi'|taba' tabi", "تابع التابعين"),
    (r"(\d)(st|nd|rd|th)\s*century\s*ah", "من القرن $2 الهجري"),
    (r"(\d+)(st|nd|rd|th)\s*generation", "الطبقة $2"),
    ("rasool allah|prophet", "النبي ﷺ"),
)
# -------------------------------------------------------------------------


def _first(c: Column, rules: tuple) -> Column:
    out = F.lit("na")
    for pattern, name in reversed(rules):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def grade_class(grade: Column) -> Column:
    """bad, mid, ok or na; the first rule that matches decides."""
    return _first(normalize(grade, "search"), GRADES)


def narrator_class(grade: Column) -> Column:
    return _first(normalize(grade, "search"), NARRATORS)


def generation_label(c: Column) -> Column:
    """Arabic label of a generation; null gives '', Arabic and unknown labels stay."""
    out = c
    for pattern, name in reversed(GENERATIONS):
        # only the first occurrence is replaced: what stands before it is caught and kept
        put = F.regexp_replace(c, f"(?is)^(.*?)(?:{pattern})", "$1" + name)
        put = F.trim(F.regexp_replace(F.regexp_replace(put, r"\[.*?\]", ""), r"\s+", " "))
        out = F.when(c.rlike(f"(?i){pattern}"), put).otherwise(out)
    return F.when(c.isNull() | (c == ""), "").when(c.rlike(r"^[\x{0600}-\x{06FF}\s—،]+$"), c).otherwise(out)
