import base64
import random
from pathlib import Path

import pyarrow as pa
import pytest

from riwaya.llm import codes as C
from riwaya.llm import tokens as tk

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not Path(tk.DEFAULT_VOCABULARY).exists(), reason="no vocabulary file here")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tk.DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def mine(texts):
    ids, ends = tk.encode(*C.to_codes(pa.array(texts)), tk.vocabulary(tk.DEFAULT_VOCABULARY))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_equals_the_public_library(reference):
    random.seed(1)
    letters = "ab 's'treveml ldd\n\t  　é文1٢'’.!<|>كتاب ں🙂"
    texts = ["", " ", "  ", "\n", "'s", "don't I'll", "a  b", "<|endoftext|>", "x's y't\n'd"]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    assert mine(texts) == [reference.encode_ordinary(t) for t in texts]


def test_very_long_words(reference):
    random.seed(2)
    texts = ["a" * 5000, "ab" * 2000, "ا" * 3000, "".join(random.choice("abcdeé") for _ in range(4000))]
    assert mine(texts) == [reference.encode_ordinary(t) for t in texts]


def test_decodes_back(reference):
    texts = ["كتاب ​🙂 x", "  \n a'b "]
    assert [reference.decode(i) for i in mine(texts)] == texts


def test_frame_nulls_clashes_and_counts(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, None), (3, "", "y"), (1, "a b", "x")], "doc_id long, text string, ids string")
    got = [(r.doc_id, len(r.ids)) for r in tk.encode_texts(df).collect()]
    assert sorted(got) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    counted = tk.count_tokens(df.withColumnRenamed("ids", "n_tokens"))
    assert sorted((r.doc_id, r.n_tokens) for r in counted.collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert tk.encode_texts(df.filter("doc_id < 0")).count() == 0
