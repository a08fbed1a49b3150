from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import counts
from tests.llm.fixtures import folder, none, odd  # noqa: F401


def brute(docs, name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return Counter((doc, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for doc, t in docs)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("share", [1e-6, 0.02, 2.0])
def test_counts_equal_the_library(odd, name, share):
    """Whatever share of the pre-tokens is looked up and whatever goes through the join."""
    got = counts.count_tokens(odd, name, share=share).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == brute(docs, name)


def test_each_pre_token_is_counted_once(spark):
    rows = spark.createDataFrame([("a b a b a",), ("a\nb",)], "text string").repartition(2)
    found = counts.distinct_pieces(rows, "byte_bpe_50k.json")
    assert found.count() == found.select("piece").distinct().count()
    assert found.agg(F.sum("n")).first()[0] == 8


def test_no_rows(none):
    assert counts.count_tokens(none, "byte_bpe_50k.json").collect() == []


def test_query(spark, folder):
    rows = [(1, "x " * 1024), (2, "x " * 1025), (3, None)]
    path = folder(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in counts.op9_token_counts(spark, path).collect()}
    for doc, n_bytes, n in brute(rows, "byte_bpe_50k.json"):
        assert (got[doc]["n_bytes"], got[doc]["n_tokens"], got[doc]["over_limit"]) == (n_bytes, n, n > 1024)
