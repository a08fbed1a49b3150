import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import negatives
from tests.llm.fixtures import folder  # noqa: F401

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, most=5):
    """rows: (id, vector, label)."""
    held = []
    for row, (d, v, label) in enumerate(rows):
        if d is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((d, (label + 1) % 10 if d % 7 == 0 else label, [math.floor(256 * x) for x in v], row))
    out = []
    for anchor, label, a, own in held:
        if anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v)), d, row, l) for d, l, v, row in held if row != own]
        firsts = sorted(s for s in scored if s[3] == label)[:most]
        others = sorted(s for s in scored if s[3] != label)
        for p, positive, _, _ in firsts:
            fit = [s for s in others if 80 * -p <= 100 * -s[0] <= 100 * -p][:most]
            out += [(anchor, positive, k, s[1], -p, -s[0]) for k, s in enumerate(fit, 1)]
    return sorted(out)


def result(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in df.select(*names).collect())


def some(rng, count, width=4, step=20):
    """Few values, so that scores tie; every `step`-th id is an anchor's."""
    return [(k * 100 // step, [rng.choice((-0.5, 0.0, 0.25, 0.5)) for _ in range(width)], rng.randrange(3)) for k in range(count)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "AT_ONCE", 3)


def test_against_brute_force_over_many_tiles(spark, folder, small):
    rows = some(random.Random(4), 200)
    rows += [rows[0], rows[0], (100, rows[5][1], 1)]  # repeated ids, also of anchors
    path = folder(embeddings=spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("key", F.lit("x")).withColumn("row", F.lit(1)))
    want = brute(rows)
    assert len(want) > 100
    assert result(negatives.op13_hard_negatives(spark, path)) == want


def test_odd_rows(spark, folder):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1), (100, [], 1), (1, [0.5, 0.25], 1), (2, [0.5], 1), (3, [0.5, 0.25, 9.0], 2), (4, None, 1), (5, [nan, 0.5], 2),
            (6, [inf, 0.5], 2), (8, [None, 0.5], 2), (9, [0.5, 0.125], None), (None, [0.5, 0.5], 2), (11, [0.5, 0.125], 2), (-100, [0.25, 0.5], 2),
            (12, [0.5, 0.25], 2), (200, [-0.5, 0.0], 3), (201, [0.5, 0.0], 3)]
    path = folder(embeddings=spark.createDataFrame(rows, VECTORS))
    assert result(negatives.op13_hard_negatives(spark, path)) == brute(rows) != []


def test_large_components_stay_whole(spark):
    rows = [(0, [1e5, 2e5], 1), (1, [2e5, 1e5], 1), (2, [2e5, 0.9e5], 2), (3, [1e30, -1e30], 2)]
    got = result(negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("label")))
    want = [(a, p, k, n, ps, ns) for a, p, k, n, ps, ns in got if n == 2]
    assert want == [(0, 1, 1, 2, 256**2 * 4 * 10**10, 256**2 * 38 * 10**9)]


def test_empty(spark, folder):
    assert negatives.op13_hard_negatives(spark, folder(embeddings=spark.createDataFrame([], VECTORS))).collect() == []


def test_a_window_never_reaches_over_its_positive(spark):
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([], VECTORS), F.col("label"), high=101)
