import os
import random

import pyarrow as pa
import pytest

from folioscope.llm.tokenise import DEFAULT_RANKS, ForcedBoundaryEncoder, encode_texts

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_RANKS), reason="vocabulary files absent")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_equals_plain_encoding_on_awkward_strings(reference):
    parts = ["'", "s", "'ll", "'re", " ", "  ", "\n", "\t", " ", "　", "a", "Zirconium", "é", "é", "1", "²", "…", "!'", "’", "中", "🙂", "\x85", "​", "<|endoftext|>", "-", "_", "\x1c", "\r\n", "漢字", "Ω", "x" * 50]
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(5000)]
    assert ForcedBoundaryEncoder().encode_column(pa.array(texts)).to_pylist() == reference(texts)


def test_rows_nulls_repeats_and_clashing_columns(spark, reference):
    long = "acetonitrile was exchanged, " * 20000
    data = [(1, None, "x"), (2, "", "y"), (3, " \n ", "z"), (4, "ab cd", "w"), (4, "ab cd", "w"), (5, long, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in encode_texts(df).collect())
    assert got == sorted((k, ids) for (k, t, _), ids in zip(data, reference([t or "" for _, t, _ in data])))
    assert got[0][1] == got[1][1] == []
    assert encode_texts(df.limit(0)).count() == 0


def test_sliced_columns(reference):
    texts = pa.array(["drop", None, "keep this one", "", "and  this"]).slice(1, 3)
    assert ForcedBoundaryEncoder().encode_column(texts).to_pylist() == reference(["", "keep this one", ""])
