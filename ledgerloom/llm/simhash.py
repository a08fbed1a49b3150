"""SimHash near-duplicates: 64-bit fingerprints linked by the generalised pigeonhole principle.

Equal fingerprints are one node, so copies never form pairs. The 64 bits are dealt into m partitions, each with a
threshold t_i of its own, -1 for none; if the thresholds add up to limit - m + 1, two fingerprints within `limit` bits
differ in at most t_i bits of some partition i. A bounded sample of fingerprints tells how bits go together:
correlated bits share a partition, and dynamic programming over the partitions takes the thresholds with the least
estimated cost of probes and candidates. The sample sets only the cost; every choice of it finds every link.

A fingerprint stands in a bucket for its bits of each partition with t_i >= 0 and probes the buckets of all values within
t_i bits. Candidates in a bucket are verified on all 64 bits, and a bucket gives a spanning forest of its links, never all
pairs. Buckets of more than `BUCKET` rows are left to an exact way for the rest: their fingerprints go to every
value within half the limit of them. Two fingerprints within the limit share such a value, no value has more of
them than its ball holds, and all that share it hang on one.

A null text counts as empty; without words the fingerprint is zero and links like any other. Repeated rows give a row
each; the id of a group is its least doc_id that is not null. An empty table gives an empty result. Further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_slices, numbered, record, slices, stored, table, text_rows
from ledgerloom.llm.components import components

BITS = 64
SAMPLE = 4000  # fingerprints that the partitions are fitted on
BUCKET = 4000  # rows of a bucket that are compared in one task
BALL = 5000  # values that the ball of a fingerprint may hold
DENSE = 1024  # rows up to which a bucket is compared in one array
VERIFY = 0.002  # cost of a candidate in a bucket, a probe's being 1, as measured


def fingerprint(text: str, words: int, seed: int = 42) -> int:
    """Bits set in over half the hashes of the text's shingles, A-Z lowered, as a signed 64-bit number."""
    found = text.encode().lower().split()
    if not found:
        return 0
    size = min(words, len(found))
    line = b" ".join(found)
    ends = list(accumulate(map(len, found), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[size - 1:])]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at:at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def one(part):
        found = [fingerprint(t, words) for t in part["text"].to_pylist()]
        return record(doc_id=part["doc_id"], fp=pa.array(found, pa.int64()))

    return map_slices(text_rows(docs, id_col, text_col), one, "doc_id long, fp long")


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    within: int  # threshold

    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> np.ndarray:
        """What to flip to reach every value within the threshold, the value itself first."""
        return np.array([sum(1 << b for b in x) for k in range(self.within + 1) for x in combinations(self.bits, k)],
                        np.uint64)


def deal_bits(bits: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Partitions of about equal size, each grown from one bit by the bit that correlates most with those it has."""
    spread = bits.std(axis=0)
    scaled = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    related = np.abs(scaled.T @ scaled) / max(1, len(bits))
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        chosen = [max(left, key=lambda b: (related[b, sorted(left)].sum(), -b))]
        left.remove(chosen[0])
        while len(chosen) < size:
            best = max(left, key=lambda b: (related[b, chosen].sum(), -b))
            left.remove(best)
            chosen.append(best)
        out.append(tuple(sorted(chosen)))
    return out


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one a partition, that add up to `total` at the least cost. costs[i][t]: of threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, taken) in best.items():
            for t in range(-1, len(own)):
                new = (cost + (own[t] if t >= 0 else 0.0), [*taken, t])
                if spent + t not in following or new < following[spent + t]:
                    following[spent + t] = new
        best = following
    return best[total]


def fit(sample: np.ndarray, rows: int, limit: int) -> list[Partition]:
    """Partitions and thresholds for `rows` fingerprints, from a sample of them (uint64)."""
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    half = len(sample) // 2
    differ = (sample[:half, None][:1000] ^ sample[None, half:][:, :1000]).ravel()
    choices = []
    for parts in range(1, limit + 2):
        groups = deal_bits(bits, parts)
        costs = []
        for group in groups:
            apart = np.bitwise_count(differ & np.uint64(sum(1 << b for b in group)))
            costs.append([])
            for t in range(limit + 1):
                ball = sum(comb(len(group), j) for j in range(t + 1))
                share = max((apart <= t).mean() if len(apart) else 0, ball / 2.0 ** len(group))
                costs[-1].append(ball + VERIFY * rows * share)
        cost, within = allot(costs, limit - parts + 1)
        choices.append((cost, [Partition(g, t) for g, t in zip(groups, within) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def _probes(nodes: DataFrame, parts: list[Partition]) -> DataFrame:
    """part, key, fp, own: a row for each bucket that a fingerprint stands in (own) or probes."""
    masks, flips = [np.uint64(p.mask()) for p in parts], [p.flips() for p in parts]

    def run(batches):
        for piece in slices(batches, 1 << 10):
            fps = piece["fp"].to_numpy().view(np.uint64)
            for k, (mask, flip) in enumerate(zip(masks, flips)):
                keys = ((fps & mask)[:, None] ^ flip[None, :]).ravel()
                yield record(part=pa.array(np.full(len(keys), k, np.int32)), key=pa.array(keys.view(np.int64)),
                             fp=pa.array(np.repeat(fps, len(flip)).view(np.int64)),
                             own=pa.array(np.tile(np.arange(len(flip)) == 0, len(fps))))

    return nodes.select("fp").mapInArrow(run, "part int, key long, fp long, own boolean")


def _forest(fps: np.ndarray, own: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between rows of a bucket of which one at least stands in it."""
    if len(fps) <= DENSE:  # mostly without a link, which one comparison of all shows
        close = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= limit) & (own[:, None] | own[None, :])
        if close.sum() == np.count_nonzero(own):
            return
    todo = np.ones(len(fps), bool)
    for start in range(len(fps)):
        if not todo[start]:
            continue
        todo[start], reached = False, [start]
        for at in reached:  # grows while it is walked
            near = todo & (np.bitwise_count(fps ^ fps[at]) <= limit) & (own | own[at])
            for x in np.flatnonzero(near).tolist():
                yield at, x
                reached.append(x)
            todo &= ~near


def _bucket_links(buckets: DataFrame, limit: int) -> DataFrame:
    def run(batches):
        for piece in slices(batches, 1 << 12):
            a, b = [], []
            for fps, own in zip(piece["fps"].to_pylist(), piece["owns"].to_pylist()):
                values, owns = np.array(fps, np.int64).view(np.uint64), np.array(own, bool)
                for x, y in _forest(values, owns, limit):
                    a.append(fps[x])
                    b.append(fps[y])
            yield record(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    return buckets.mapInArrow(run, "a long, b long")


def _ball_links(nodes: DataFrame, limit: int) -> DataFrame:
    """Links through the values within half the limit: who is within its lower half there hangs all others on itself."""
    far, near = Partition(tuple(range(BITS)), -(-limit // 2)).flips(), limit // 2
    close = np.bitwise_count(far) <= near

    def run(batches):
        for piece in slices(batches, 1 << 8):
            fps = piece["fp"].to_numpy().view(np.uint64)
            keys = (fps[:, None] ^ far[None, :]).ravel()
            yield record(key=pa.array(keys.view(np.int64)), fp=pa.array(np.repeat(fps, len(far)).view(np.int64)),
                         near=pa.array(np.tile(close, len(fps))))

    around = nodes.mapInArrow(run, "key long, fp long, near boolean")
    hubs = (around.groupBy("key").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"),
                                      F.collect_set("fp").alias("fps"))  # a ball's size at most
            .filter("hub IS NOT NULL AND size(fps) > 1"))
    return hubs.select(F.explode("fps").alias("a"), F.col("hub").alias("b")).filter("a <> b")


def links(nodes: DataFrame, limit: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to connect whatever is within `limit` bits."""
    rows = nodes.count()
    sample = nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    probes = _probes(nodes, fit(sample.view(np.uint64), rows, limit))
    large = probes.groupBy("part", "key").count().filter(F.col("count") > bucket)
    buckets = (probes.join(large, ["part", "key"], "left_anti").groupBy("part", "key")
               .agg(F.collect_list("fp").alias("fps"), F.collect_list("own").alias("owns"))
               .filter("size(fps) > 1 AND array_contains(owns, true)"))
    found = _bucket_links(buckets, limit)
    if sum(comb(BITS, j) for j in range(-(-limit // 2) + 1)) <= BALL:
        rest = probes.join(large, ["part", "key"], "left_semi").select("fp").distinct()
        return found.union(_ball_links(rest, limit))
    blocks = F.ceil(F.col("count") / (bucket / 2)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = (probes.join(large, ["part", "key"]).withColumn("blocks", blocks).withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .groupBy("part", "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
             .agg(F.collect_list("fp").alias("fps"), F.collect_list("own").alias("owns")))
    return found.union(_bucket_links(pairs, limit))


def groups(docs: DataFrame, words: int, limit: int, id_col: str = "doc_id", text_col: str = "text",
           bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id, one row for each row of `docs`."""
    found = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes, limit, bucket)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.join(named.join(least, "root").select("fp", "component_id"), "fp")


def keep_first(docs: DataFrame, words: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group one row: that of the least id (a null id is least), and of rows with that id the one of the least
    fingerprint and hash of the text."""
    held, rows = numbered(docs, id_col, text_col)
    found = groups(rows, words, limit, id_col="row").withColumnRenamed("doc_id", "row")
    firsts = (found.join(rows.select("row", "rank", "tie"), "row").groupBy("component_id")
              .agg(F.min(F.struct("rank", "fp", "tie", "row")).alias("first")))
    return held.join(firsts.select(F.col("first.row").alias("_row")), "_row", "left_semi").select(*docs.columns)


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and their groups at 2 bits or fewer."""
    found = groups(table(spark, sf_dir, "documents"), words=3, limit=2)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_groups": op10_simhash_groups}
ORACLE: dict[str, str] = {}
