import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from riwaya.functions.normalize import compatibility, normalize, tokens

STRIP = re.compile("[ؐ-ًؚ-ٰٟۖ-ۭـ​-‏‪-‮﻿]")
FOLD = str.maketrans({**dict.fromkeys("أإآٱٲٳ", "ا"), **dict.fromkeys("ىئی", "ي"), "ة": "ه", "ؤ": "و", "ک": "ك", "گ": "ك"})


def stated(text):
    """The link profile as SURVEY states it, with the library's NFKC."""
    if not text:
        return ""
    t = STRIP.sub("", unicodedata.normalize("NFKC", text)).translate(FOLD)
    return re.sub(r"\s+", " ", re.sub("[^ء-ي ]+", " ", t)).strip()


def run(spark, values, profile="link"):
    df = spark.createDataFrame(list(enumerate(values)), "k int, t string")
    return [r.n for r in df.select("k", normalize("t", profile).alias("n")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, ""), ("", ""), ("كِتَابٌ", "كتاب"), ("أإآٱ", "اااا"), ("رحمة", "رحمه"), ("لا\n12 إله", "لا اله"), ("ﷺ", "صلي الله عليه وسلم"), ("کگی", "ككي"), ("كِتَابࣰي", "كتاب ي"), ("ﻻ", "لا")],
)
def test_link_profile(spark, text, want):
    assert run(spark, [text]) == [want]


def test_search_profile_differs_on_purpose(spark):
    assert run(spark, ["کگی", "لیس الخبر کالمعاینة", "قا​ل"], "search") == ["", "ل س الخبر المعا نه", "قا ل"]


def test_equals_nfkc_on_random_strings(spark):
    random.seed(4)
    one, _, many = compatibility("link")
    pool = list(one) + list(many) * 2 + list("ابتثيكهوأإآةؤئىٌَُِّْٰٔٓـ ءabc12.،‌​ﷲ﷽é")
    values = ["".join(random.choice(pool) for _ in range(random.randint(0, 12))) for _ in range(4000)]
    assert run(spark, values) == [stated(v) for v in values]


def test_tokens_of_nothing(spark):
    df = spark.createDataFrame([("",), (None,), ("قال كَتب",)], "t string")
    assert [r.n for r in df.select(F.size(tokens("t")).alias("n")).collect()] == [0, 0, 2]


def test_latin(spark):
    assert run(spark, ["Été, À 3!", "İlk"], "latin") == ["été à 3", "ilk"]
