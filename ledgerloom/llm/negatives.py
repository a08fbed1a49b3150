"""Hard negatives by a secondary-sort shuffle.

An anchor's positives are its best rows of the same label; each opens a window of scores, and the best rows of other labels
within it are its hard negatives. Pairs travel as one packed key (anchor, descending score, kind, id): dealt by anchor and
sorted within partitions by Spark, they pass a streaming iterator that opens a window at each positive, hands each
negative to the windows it fits, and holds no more of an anchor than its open windows.

Scores are made in tiles of `ROWS` rows by `ANCHORS` anchors, each a matrix product in a task; rows are spread over tiles
by a hash, so neither a common vector nor a common label meets in one task. A tile keeps of each anchor only what can
count: first its best rows of the label, out of which the windows follow, then the best of each window, since the best
of all tiles are among the best of each. So the shuffle carries a few keys for an anchor and tile, not all its pairs.

A component x counts as floor(256 * x); beyond 2**26 in size it counts as that, so that scores fit a long. Rows without an
id, a label or a vector, or with a null or non-finite component, take no part. A shorter vector goes on in zeros. Ties in
the score go by id. Rows that repeat an id are rows of their own: each can be another's positive or negative, and as
anchors they give their rows each. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import spread, stored, table

ROWS = 1024  # of a tile
ANCHORS = 4096  # of a tile
AT_ONCE = 256  # anchors scored together
LARGEST = 1 << 26  # size of a component
EXACT = 1 << 53  # products below this are exact in floating point
KEY = np.dtype([("anchor", ">u8"), ("anchor_row", ">u8"), ("score", ">u8"), ("negative", "u1"), ("id", ">u8"), ("row", ">u8")])
TOP = (1 << 63) - 1
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """row, id, label, vector of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = lambda x: F.floor(F.lit(256.0) * x)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), label.cast("long").alias("label"),
                          vectors[vector_col].cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))
    near = F.transform("vector", lambda x: F.least(F.greatest(whole(x), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", near.alias("vector"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy().astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max((x for c in columns for x in c.combine_chunks().value_lengths().to_pylist()), default=0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < EXACT else a @ b.T


def _packed(anchor, anchor_row, score, negative, id_, row) -> pa.Array:
    keys = np.empty(len(score), KEY)
    keys["anchor"], keys["anchor_row"] = anchor.astype(np.uint64) + np.uint64(1 << 63), anchor_row
    keys["score"] = np.uint64(TOP) - score.astype(np.uint64)
    keys["negative"], keys["id"], keys["row"] = negative, id_.astype(np.uint64) + np.uint64(1 << 63), row
    return pa.Array.from_buffers(pa.binary(KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def _opened(keys: pa.Array) -> Iterator[tuple]:
    found = np.frombuffer(b"".join(keys.to_pylist()), KEY)
    whole = lambda x: (x.astype(np.uint64) - np.uint64(1 << 63)).astype(np.int64).tolist()
    scores = (np.uint64(TOP) - found["score"].astype(np.uint64)).astype(np.int64).tolist()
    return zip(whole(found["anchor"]), found["anchor_row"].tolist(), scores, found["negative"].tolist(), whole(found["id"]), found["row"].tolist())


def _tiles(rows: DataFrame, anchors: DataFrame, pick: Callable) -> DataFrame:
    """Keys that `pick` finds in each tile. pick(scores, rows' labels, row numbers, anchors) gives places (anchor, row)."""
    count, known = rows.count(), anchors.count()
    across, down = spread(count, ROWS), spread(known, ANCHORS)
    left = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(across))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = (anchors.withColumn("of", F.pmod(F.xxhash64("anchor_row"), F.lit(down)).cast("int"))
             .withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long")))))

    def tile(near: pa.Table, given: pa.Table) -> pa.Table:
        near = near.sort_by([("id", "ascending"), ("row", "ascending")])  # so that ties go by id
        ids, numbers, labels = (near[c].to_numpy() for c in ("id", "row", "label"))
        width, out = _width(near["vector"], given["given"]), []
        vectors = _matrix(near["vector"], width)
        for start in range(0, given.num_rows if near.num_rows else 0, AT_ONCE):
            some = given.slice(start, AT_ONCE)
            score = products(_matrix(some["given"], width), vectors)
            a, r, negative = pick(score, labels, numbers, some)
            out.append(_packed(some["anchor"].to_numpy()[a], some["anchor_row"].to_numpy()[a], score[a, r], negative, ids[r], numbers[r]))
        return pa.table([pa.chunked_array(out, pa.binary())], names=["key"])

    return left.groupBy("block", "part").cogroup(right.groupBy("of", "share")).applyInArrow(tile, "key binary")


def _best(score: np.ndarray, fit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (anchor, row) of the `most` first fitting rows of each anchor, by descending score, then by place."""
    order = np.argsort(np.where(fit, -score, TOP), axis=1, kind="stable")[:, :most]
    a, at = np.nonzero(np.take_along_axis(fit, order, axis=1))
    return a, order[a, at]


def _streamed(keys: DataFrame, each: Callable, schema: str) -> DataFrame:
    """`each`(keys of a partition, anchor after anchor, each in order) gives rows, over the packed keys dealt by anchor."""
    dealt = keys.repartition(F.substring("key", 1, 16)).sortWithinPartitions("key")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = pa.schema([(n, pa.int32() if f.split()[1] == "int" else pa.binary() if f.split()[1] == "binary" else pa.int64())
                       for n, f in zip(names, schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            found = list(each(state, zip(batch["key"].to_pylist(), _opened(batch["key"]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*found), kinds)], names=names)

    return dealt.mapInArrow(run, schema)


def positives(rows: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """key, anchor_row, score: the first `most` rows of each anchor's label, itself aside."""

    def pick(score, labels, numbers, some):
        fit = (labels == some["own"].to_numpy()[:, None]) & (numbers != some["anchor_row"].to_numpy()[:, None])
        a, r = _best(score, fit, most)
        return a, r, np.zeros(len(a), np.uint8)

    def first(state, keys):
        for key, (_, anchor_row, score, _, _, _) in keys:
            if state.get("anchor") != anchor_row:
                state.update(anchor=anchor_row, seen=0)
            state["seen"] += 1
            if state["seen"] <= most:
                yield key, anchor_row, score

    return _streamed(_tiles(rows, anchors, pick), first, "key binary, anchor_row long, score long")


def mine(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", anchor_step: int = 100,
         most: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the rows whose id `anchor_step`
    divides; a window is low * positive <= 100 * negative <= high * positive, high at most 100."""
    if high > 100:
        raise ValueError("a window must end at its positive's score")
    rows = stored(usable(vectors, id_col, label, vector_col), "vectors")
    anchors = rows.filter(F.col("id") % anchor_step == 0).select(F.col("id").alias("anchor"), F.col("row").alias("anchor_row"),
                                                               F.col("label").alias("own"), F.col("vector").alias("given"))
    firsts = stored(positives(rows, anchors, most), "positives")
    windows = firsts.groupBy("anchor_row").agg(F.collect_list("score").alias("windows"))  # `most` of an anchor

    def pick(score, labels, numbers, some):
        other, found = labels != some["own"].to_numpy()[:, None], []
        opened = _matrix_of(some["windows"], most)
        for k in range(most):
            given, at = opened[:, k, None], opened[:, k, None] != TOP
            fit = other & at & (low * given <= 100 * score) & (100 * score <= high * given)
            found.append(np.stack(_best(score, fit, most)))
        a, r = np.unique(np.concatenate(found, axis=1), axis=1)
        return a, r, np.ones(len(a), np.uint8)

    def meet(state, keys):
        for _, (anchor, anchor_row, score, negative, id_, _) in keys:
            if state.get("anchor") != anchor_row:
                state.update(anchor=anchor_row, open=[])
            if not negative:
                state["open"].append([id_, score, 0])
                continue
            for window in state["open"]:
                positive, given, n = window
                if n < most and low * given <= 100 * score <= high * given:
                    window[2] += 1
                    yield anchor, positive, n + 1, id_, given, score

    negatives = _tiles(rows, anchors.join(windows, "anchor_row"), pick)
    return _streamed(firsts.select("key").union(negatives), meet, _OUT)


def _matrix_of(windows: pa.ChunkedArray, most: int) -> np.ndarray:
    """Scores of the positives, a row for each anchor, TOP where there are fewer."""
    out = np.full((len(windows), most), TOP)
    for k, given in enumerate(windows.to_pylist()):
        out[k, :len(given)] = given
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five negatives within each of the first five positives' windows of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(vectors, label)


SQL = """
WITH shares AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
  FROM (SELECT * FROM shares WHERE id % 100 = 0) AS a JOIN shares AS r ON a.id <> r.id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, n.id AS negative_id, positive_score, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id)::INTEGER AS rank
FROM positives AS p JOIN pairs AS n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY rank <= 5
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op13_hard_negatives": SQL}
