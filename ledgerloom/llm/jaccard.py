"""Near-duplicates by SimHash, and by the exact Jaccard similarity of their word shingles, 0.8 or more.

SimHash comes first: the fingerprints of the texts are linked within `BITS` bits by the generalised pigeonhole principle, and
each link is verified on both whole sets of shingles. What it links is one component from the start. Of two texts with J of 0.8
about ten bits differ, so SimHash cannot name every such pair at a bearable cost; prefix filtering gives those that are left.

Prefix filtering misses none: two sets with J >= 0.8 share at least four fifths of either,
so in any one order of all shingles, the first |S| - ceil(0.8 |S|) + 1 of both have one in common. The order puts
shingles that are frequent in a sample last and else goes by hash; the sample sets only the cost.

Texts of equal words are one node, so copies never form pairs. The nodes that share a prefix shingle are a bucket. Round
after round the next nodes of each bucket, one at first and eight times as many each time, meet the others of it that
are not in their component yet. In a large bucket a pair is made only if the sets differ in few enough of their odd
counts; each pair that counts of the sets' hashes do not rule out is verified on both whole sets. A bucket leaves when all of
it is one component or each of its nodes had its turn, so that at the end every pair was compared or is connected already.
A large bucket costs the square of its rows in comparisons of 64 bytes only where these are dissimilar although their rarest
shingles are common.

Shingles count as equal where their 64-bit hashes are. A text of fewer words than a shingle is one shingle; texts
without words are one group. A null text counts as empty, and an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.llm.common import dropped, map_slices, numbered, record, stored
from ledgerloom.llm.components import components

SAMPLE = 4000  # nodes that frequent shingles are counted in at least, and
SHARE = 12  # one of so many nodes, so that a shingle counts as frequent from about as many nodes on at any size
FREQUENT = 100_000  # shingles that the order puts last
LARGE = 32  # rows of a bucket from which on pairs are held against the odd bits before they are made
GROWTH = 8  # times as many nodes of a bucket take their turn in each round
BITS = 3  # bits within which SimHash fingerprints are linked


def shingles(text: str, words: int, seed: int = 42) -> np.ndarray:
    """The hashes of the distinct shingles, A-Z lowered, in ascending order."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.int64)
    size, line = min(words, len(found)), b" ".join(found)
    ends = list(accumulate(map(len, found), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[size - 1:])], np.uint64).view(np.int64))


def prefix(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which one at least is among the first of any set with J >= 0.8 to it."""
    late = np.isin(found, frequent, assume_unique=True)
    return np.concatenate([found[~late], found[late]])[:len(found) - -(-4 * len(found) // 5) + 1]


def _nodes(rows: DataFrame) -> DataFrame:
    """rank, tie, row: of the rows with the same words the least one."""

    def one(part):
        data = b"".join(xxhash.xxh3_128_digest(b" ".join(t.encode().lower().split())) for t in part["text"].to_pylist())
        halves = np.frombuffer(data, "<i8").reshape(-1, 2)
        return record(row=part["row"], rank=part["rank"], tie=part["tie"],
                      high=pa.array(halves[:, 0].copy()), low=pa.array(halves[:, 1].copy()))

    least = (map_slices(rows, one, "row long, rank long, tie long, high long, low long")
             .groupBy("high", "low").agg(F.min(F.struct("rank", "tie", "row")).alias("first")))
    return least.select("first.*")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """row, found."""

    def one(part):
        return record(row=part["row"], found=pa.array([shingles(t, words) for t in part["text"].to_pylist()], pa.list_(pa.int64())))

    return map_slices(rows.select("row", "text"), one, "row long, found array<long>")


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """row, size, sketch, odd. The sketch counts the set's hashes by their first byte, two bytes each; none for sets it
    cannot count. `odd` has a bit for each of the hashes' first nine bits, set where an odd number of the set's hashes has them."""

    def one(part):
        sets = [shingles(t, words) for t in part["text"].to_pylist()]
        counts = [np.bincount(s.view(np.uint64) >> np.uint64(55), minlength=512) for s in sets]
        sketches = [c.reshape(256, 2).sum(axis=1).astype("<u2").tobytes() if len(s) < 1 << 16 else b"" for s, c in zip(sets, counts)]
        odd = [np.packbits(c & 1 == 1).view("<i8") for c in counts]
        return record(row=part["row"], size=pa.array([len(s) for s in sets], pa.int64()), sketch=pa.array(sketches, pa.binary()),
                      odd=pa.array(odd, pa.list_(pa.int64())))

    return map_slices(rows.select("row", "text"), one, "row long, size long, sketch binary, odd array<long>")


def _frequent(rows: DataFrame, nodes: int, words: int) -> np.ndarray:
    sample = rows.filter(F.pmod(F.xxhash64("row"), F.lit(min(SHARE, max(1, nodes // SAMPLE)))) == 0)
    counts = _sets(sample, words).select(F.explode("found").alias("shingle")).groupBy("shingle").count().filter("count > 2")
    top = counts.orderBy(F.desc("count"), "shingle").limit(FREQUENT).select("shingle").toPandas()
    return np.sort(top["shingle"].to_numpy(np.int64))


def _buckets(rows: DataFrame, nodes: int, words: int) -> DataFrame:
    """shingle, row, size, place, most: the prefix shingles that several nodes share."""
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, nodes, words))

    def one(part):
        sets = [shingles(t, words) for t in part["text"].to_pylist()]
        firsts = [prefix(s, frequent.value) if len(s) else s for s in sets]
        held, sizes = [len(f) for f in firsts], np.array([len(s) for s in sets], np.int32)
        return record(shingle=pa.array(np.concatenate(firsts)), row=pa.array(np.repeat(part["row"].to_numpy(), held)),
                      size=pa.array(np.repeat(sizes, held)))

    found = map_slices(rows.select("row", "text"), one, "shingle long, row long, size int")
    bucket = Window.partitionBy("shingle")
    place = F.row_number().over(bucket.orderBy(F.xxhash64("row"), "row"))  # mostly the same one first in like buckets
    return found.withColumn("place", place).withColumn("most", F.count("*").over(bucket)).filter("most > 1")


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs that sketches do not rule out: sets share no more than the lesser count of each byte."""

    def one(part):
        sizes = part["hub_size"].to_numpy() + part["size"].to_numpy()
        left, right = part["hub_sketch"].to_pylist(), part["sketch"].to_pylist()
        known = np.array([bool(a and b) for a, b in zip(left, right)], bool)
        most = np.full(len(known), np.iinfo(np.int64).max // 16)
        if known.any():
            a, b = (np.frombuffer(b"".join(x for x, k in zip(side, known) if k), "<u2").reshape(-1, 256) for side in (left, right))
            most[known] = np.minimum(a, b).sum(axis=1)
        return part.select(["hub", "member", "size"]).filter(pa.array(9 * most >= 4 * sizes))

    own = sketches.select("row", "size", "sketch")
    both = (pairs.join(own.withColumnRenamed("row", "member"), "member")
            .join(own.select(F.col("row").alias("hub"), F.col("size").alias("hub_size"), F.col("sketch").alias("hub_sketch")), "hub"))
    return map_slices(both, one, "hub long, member long, size long")


def _verified(pairs: DataFrame, rows: DataFrame, words: int, sketches: DataFrame, total: int) -> DataFrame:
    """(a, b): the pairs (hub, member; stored; they go) whose sets have J >= 0.8.

    Whole sets are made of those rows only whose pairs the sketches leave. A pair moves one whole set to the other, so pairs
    are taken in slices that move a quarter of `total`, the size of all nodes' sets, at most.
    """
    near = stored(_possible(pairs, sketches), "possible")
    named = near.select(F.col("hub").alias("row")).union(near.select(F.col("member").alias("row"))).distinct()
    sets = stored(_sets(rows.join(named, "row", "left_semi"), words), "sets")
    count = max(1, -(-4 * (near.agg(F.sum("size")).first()[0] or 0) // max(1, total)))
    out = []
    for k in range(count):
        some = near.filter(F.pmod(F.xxhash64("member"), F.lit(count)) == k)
        hubs = sets.join(some.select(F.col("hub").alias("row")).distinct(), "row", "left_semi")
        both = (some.select("hub", "member").join(hubs.select(F.col("row").alias("hub"), F.col("found").alias("fa")), "hub")
                .join(sets.filter(F.pmod(F.xxhash64("row"), F.lit(count)) == k)
                      .select(F.col("row").alias("member"), F.col("found").alias("fb")), "member"))
        shared = F.size(F.array_intersect("fa", "fb"))  # J >= 4/5 where 9 times this is 4 times both sizes or more
        alike = both.filter(9 * shared >= 4 * (F.size("fa") + F.size("fb")))
        out.append(stored(alike.select(F.col("hub").alias("a"), F.col("member").alias("b")), "links"))
    dropped(pairs, sets, near)
    return reduce(DataFrame.union, out)


def _fingerprint_pairs(rows: DataFrame, words: int) -> DataFrame:
    """hub, member: nodes whose SimHash fingerprints are equal, or linked within `BITS` bits, in a spanning forest."""
    found = stored(simhash.fingerprints(rows, words, id_col="row").withColumnRenamed("doc_id", "row"), "fingerprints")
    first = stored(found.groupBy("fp").agg(F.min("row").alias("hub")), "hubs")
    equal = found.join(first, "fp").filter("row <> hub").select("hub", F.col("row").alias("member"))
    near = (simhash.links(first, BITS).join(first.withColumnRenamed("fp", "a"), "a")
            .join(first.select(F.col("fp").alias("b"), F.col("hub").alias("member")), "b").select("hub", "member"))
    pairs = stored(equal.union(near).distinct(), "pairs")
    dropped(found, first)
    return pairs


def _rooted(nodes: DataFrame, found: list[DataFrame]) -> DataFrame:
    """`nodes` with the root of each row's component."""
    roots = components(reduce(DataFrame.union, found)).select(F.col("node").alias("row"), "root")
    return nodes.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))


def _marked(live: DataFrame, sketches: DataFrame) -> DataFrame:
    """`live` with the sketches' odd bits, in buckets of over `LARGE` rows; null in the others, whose pairs are few."""
    large = live.filter(F.col("most") > LARGE).select("row").distinct().join(sketches.select("row", "odd"), "row")
    return live.join(large.withColumnRenamed("row", "_of"), (F.col("row") == F.col("_of")) & (F.col("most") > LARGE), "left").drop("_of")


def links(rows: DataFrame, nodes: int, words: int) -> DataFrame:
    """(a, b): pairs of nodes with J >= 0.8, enough of them to connect whatever such pairs connect."""
    sketches = stored(_sketches(rows, words), "sketches")
    total = sketches.agg(F.sum("size")).first()[0] or 0
    found, done, upto = [_verified(_fingerprint_pairs(rows, words), rows, words, sketches, total)], 0, 1
    shared = stored(_buckets(rows, nodes, words), "shared")
    live = stored(_marked(_rooted(shared, found), sketches), "buckets")
    dropped(shared)
    while not live.isEmpty():
        hubs = live.filter(F.col("place").between(done + 1, upto)).select(
            "shingle", F.col("row").alias("hub"), F.col("root").alias("top"), F.col("place").alias("turn"), F.col("size").alias("own"),
            F.col("odd").alias("other"))
        # sets with J >= 4/5 differ in a ninth of both sizes at most, and in as many odd counts at most
        near = ("place > turn AND root <> top AND 5L * least(size, own) >= 4L * greatest(size, own) AND "
                f"coalesce(9L * ({' + '.join(f'bit_count(odd[{k}] ^ other[{k}])' for k in range(8))}) <= 1L * size + own, true)")
        pairs = live.join(hubs, "shingle").filter(near).select("hub", F.col("row").alias("member"))
        found.append(_verified(stored(pairs.distinct(), "pairs"), rows, words, sketches, total))
        done, upto = upto, GROWTH * upto
        left = live.filter(F.col("most") > done + 1).drop("root")  # the last of a bucket has met all others
        if left.isEmpty():
            break
        left = _rooted(left, found)
        several = left.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        last, live = live, stored(left.join(several.select("shingle"), "shingle", "left_semi"), "buckets")
        dropped(last)
    dropped(live, sketches)
    return reduce(DataFrame.union, found)


def keep_first(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group one row: that of the least id, a null id being least, and among rows of that id of the least hash of
    the text."""
    held, rows = numbered(docs, id_col, text_col)
    nodes = stored(_nodes(rows), "nodes")
    texts = stored(rows.join(nodes, "row", "left_semi").select("row", "text"), "texts")  # read often, dealt once
    linked = links(texts, nodes.count(), words)
    dropped(texts)
    nodes = (_rooted(nodes, [linked]).groupBy("root")
             .agg(F.min(F.struct("rank", "tie", "row")).alias("first")).select("first.*"))
    name = held.columns[-1]
    return held.join(nodes.select(F.col("row").alias(name)), name, "left_semi").select(*docs.columns)
