"""Best-fit packing of documents into sequences, planned on counts of lengths.

A document's demand is a vector: its tokens, one document, and its attention cost (tokens squared). All three
follow from its length, and a length is at most the capacity, so the whole packing problem is a table of
at most `tokens` counts, however many documents there are. The plan places the lengths from the longest
down: sequences with equal residual capacities form one group, a length goes to the group that scores best
among those it fits in every dimension, and as many copies move at once as the length and the group have. A score
is either the weighted norm of the residual left behind (smallest first) or the weighted dot product of demand
and residual (largest first). The plan is a list of slots (a run of ranks of one length to a run of sequences, at
one offset); Spark ranks the pieces of each length, in buckets so that no length meets in one task, and looks
each piece's slot up. Only counts and slots pass through the driver, both bounded by the capacity.

A null text counts as empty and is packed as its end id alone. Rows that repeat a doc_id, or repeat whole, are packed
one by one; a null doc_id is kept. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_slices, record, slices, spread, stored, table, text_rows
from ledgerloom.llm.tokens import encoder

PER_BUCKET = 100_000  # pieces of one length that are ranked in one task


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds; 0 documents or attention: no limit beyond what the tokens allow."""

    tokens: int = 4096
    documents: int = 0
    attention: int = 0

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or 1, self.attention or 1], float)

    def demand(self, length: int) -> np.ndarray:
        """What a piece takes; nothing of what has no limit, so that residuals which differ there alone are one."""
        return np.array([length, 1.0 if self.documents else 0.0, float(length) ** 2 if self.attention else 0.0])


@dataclass(frozen=True)
class Slots:
    """Sorted by length and first rank: pieces of `length` ranked from `rank` go, one each, to sequences from
    `sequence`, at `offset`."""

    length: list[int]
    rank: list[int]
    sequence: list[int]
    offset: list[int]
    sequences: int


def plan(counts: dict[int, int], capacity: Capacity = Capacity(), weights: tuple = (1.0, 0.0, 0.0),
         score: str = "norm") -> Slots:
    """Vector best-fit decreasing over counts of lengths."""
    limits, weight = capacity.limits(), np.array(weights)
    groups: dict[tuple, list[list[int]]] = {}  # residual: runs [first sequence, sequences]
    slots, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, need = counts[length], 0, capacity.demand(length)
        if (need > limits).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        known = np.array(list(groups)).reshape(-1, len(limits))
        known = known[(known >= need).all(axis=1)]
        fits = sorted(zip(_score(known, need, limits, weight, score).tolist(), map(tuple, known.tolist())))
        while left:
            if not fits:
                each = int((limits[need > 0] // need[need > 0]).min())
                fresh = -(-left // each)
                residual = tuple(limits.tolist())
                groups.setdefault(residual, []).append([opened, fresh])
                opened += fresh
                fits = [(0.0, residual)]
            residual = fits[0][1]
            runs = groups[residual]
            first, size = runs[0]
            taken = min(size, left)
            slots.append((length, rank, first, int(limits[0] - residual[0])))
            if taken == size:
                runs.pop(0)
            else:
                runs[0] = [first + taken, size - taken]
            rank, left = rank + taken, left - taken
            after = tuple((np.array(residual) - need).tolist())
            if not runs:
                del groups[residual]
                fits.pop(0)
            if after not in groups:
                groups[after] = []
                if (np.array(after) >= need).all():
                    insort(fits, (float(_score(np.array(after), need, limits, weight, score)), after))
            groups[after].append([first, taken])
    slots.sort()
    return Slots(*([s[k] for s in slots] for k in range(4)), opened)


def _score(residual: np.ndarray, need: np.ndarray, limits: np.ndarray, weight: np.ndarray, score: str) -> np.ndarray:
    """Lower is better; the residuals lie along the last axis."""
    if score == "norm":
        return (weight * ((residual - need) / limits) ** 2).sum(axis=-1)
    if score == "dot":
        return -(weight * (need / limits) * (residual / limits)).sum(axis=-1)
    raise ValueError(f"unknown score {score!r}")


def cut(docs: DataFrame, vocabulary: str, end_id: int, tokens: int, id_col: str = "doc_id",
        text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end id, cut at every `tokens` ids."""

    def one(part):
        encode, rows = encoder(vocabulary), []
        for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
            ids = np.append(encode.ids(text), encode.kind.type(end_id)).astype("<u4")
            rows += [(doc, k, start, len(ids[start:start + tokens]), zlib.crc32(ids[start:start + tokens].tobytes()))
                     for k, start in enumerate(range(0, len(ids), tokens))]
        doc, piece, start, length, crc = zip(*rows)
        return record(doc_id=pa.array(doc, pa.int64()), piece=pa.array(piece, pa.int32()),
                      start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()),
                      ids_crc32=pa.array(crc, pa.int64()))

    return map_slices(text_rows(docs, id_col, text_col), one,
                      "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """`pieces` with `rank`, from 0 within each length. Buckets are ranked apart and put end to end."""
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread(rows, PER_BUCKET)))
    dealt = pieces.withColumn("bucket", bucket)
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (dealt.groupBy("length", "bucket").agg(F.count("*").alias("size"))
            .select("length", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base")))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (dealt.withColumn("place", F.row_number().over(inside) - 1).join(base, ["length", "bucket"])
            .withColumn("rank", F.col("base") + F.col("place")).drop("bucket", "base", "place"))


def place(pieces: DataFrame, slots: Slots) -> DataFrame:
    """Ranked pieces with sequence_id and offset."""
    keys = list(zip(slots.length, slots.rank))
    sequence, offset, first = slots.sequence, slots.offset, slots.rank

    def run(batches):
        for part in slices(batches, 4096):
            ranks = part["rank"].to_pylist()
            at = [bisect_right(keys, x) - 1 for x in zip(part["length"].to_pylist(), ranks)]
            yield record(doc_id=part["doc_id"], piece=part["piece"], start=part["start"], length=part["length"],
                         ids_crc32=part["ids_crc32"],
                         sequence_id=pa.array([sequence[k] + r - first[k] for k, r in zip(at, ranks)], pa.int64()),
                         offset=pa.array([offset[k] for k in at], pa.int64()))

    return pieces.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                  "sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: Capacity = Capacity(),
         weights: tuple = (1.0, 0.0, 0.0), score: str = "norm", id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row a piece: where it begins in its document, its length and digest, its sequence and its place there."""
    pieces = stored(cut(docs, vocabulary, end_id, capacity.tokens, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `tokens` rows at most
    slots = plan(counts, capacity, weights, score)
    return place(ranked(pieces, sum(counts.values())), slots)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 1)


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLE: dict[str, str] = {}
