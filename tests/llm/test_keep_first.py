import random

import pytest

from ledgerloom.llm import jaccard, simhash

WAYS = [lambda docs: simhash.keep_first(docs, words=5, limit=7), lambda docs: jaccard.keep_first(docs, words=5)]


@pytest.mark.parametrize("keep", WAYS)
def test_a_row_of_each_group_stays_whatever_its_id(spark, keep):
    """Unrelated texts without an id all stay; of (5, A), (5, B), (7, B) one row of each text."""
    rng = random.Random(2)
    a, b, *others = (" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(80)) for _ in range(6))
    rows = [(5, a), (5, b), (7, b), (5, a), *((None, t) for t in others), (None, others[0])]
    kept = keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(5, a), (5, b), *((0, t) for t in others)])
