"""Repeated byte strings by merging the Burrows-Wheeler transforms of shards.

Every string of `length` bytes that starts at least twice is found, and every byte that such a string covers is removed,
whichever texts the copies stand in. Strings never reach over the end of a text, and all are judged on the input.

A shard is a few megabytes of texts. Its transform lists suffixes in byte order, each with the context that precedes it.
Only sampled suffixes are listed: each string names one, the place of the least hash of an eight-byte gram among its first
bytes, so equal strings name it alike and none is lost. A sample stands for the run of strings that name it; `core` is
what all of them have in common, and neighbours that agree on the whole run, context included, are one class.

Shards are never sorted again together: their transforms are interleaved by rounds of refinement. A block of the interleave
holds the suffixes of all shards that agree on the bytes compared so far, each shard giving one row for a class of its
own, with the number of its members; what classes of several cover in their shard is put together there. Each round compares more bytes within the live blocks, 64 first and then the whole core; a block that is left
with one suffix is settled, shares no more than those bytes with any other, and leaves. What stays live are the
repeated intervals. If a class there has two members, all of its strings repeat. Blocks of several classes
differ somewhere before or behind the core; of each class there one member hands in a hash for each of its strings, so
that those which cross the difference are told from those that do not.

Groups are counts with partial sums; a passage that many rows share reaches the shuffle once for each shard. Longer texts
than `PIECE` are sampled in overlapping pieces. Hashes have 64 bits, and two of them must agree.

Null texts count as empty. Every row is a text of its own, whether or not its doc_id is null or repeated. Rows with equal
texts of `length` bytes or more lose all of them. An empty table gives an empty result. Only id and text are read, so
further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import dropped, map_slices, record, slices, stored, table, text_rows

LENGTH = 400
GRAM = 8  # bytes whose hash picks the sample
FIRST = 64  # bytes compared in the first round
SHARD = 8 << 20  # bytes of a shard
PIECE = 1 << 20  # bytes sampled at once
_digest = xxhash.xxh3_64_intdigest


def reach(length: int) -> int:
    """Places a string chooses its sample from: the core is then two thirds of it."""
    if length < 2 * GRAM:
        raise ValueError(f"strings must have {2 * GRAM} bytes or more")
    return max(1, (length - GRAM + 1) // 3)


def samples(blob: bytes, ends: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sample, first string, last string) of each run of strings that name one sample, over texts laid end to end."""
    data, width = np.frombuffer(blob, np.uint8).astype(np.uint32), reach(length)
    fits = np.zeros(len(data) + 1, np.int8)  # 1 where strings begin to fit into their text, -1 where they end to
    edges = np.array([0, *ends])
    long = np.diff(edges) >= length
    fits[edges[:-1][long]] += 1
    fits[edges[1:][long] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(fits[:-1], dtype=np.int8))
    if not len(starts):
        return starts, starts, starts
    four = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    count = len(data) - GRAM + 1
    mixed = four[:count] * np.uint32(0x9E3779B1) + four[4:4 + count] * np.uint32(0x85EBCA77)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(13)
    least = mixed.astype(np.uint64) << np.uint64(32) | np.arange(count, dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[:size - width], least[width - size:])
    named = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.diff(named, prepend=-1).astype(bool) | (np.diff(starts, prepend=-2) != 1))
    return named[new], starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)]


class Shard:
    """Sampled suffixes of a few megabytes of texts, one for each class; what a class has more of is counted."""

    def __init__(self, length: int):
        self.length, self.size = length, 0
        self.numbers: dict[tuple[int, int], int] = {}  # of the classes, by core and full
        self.suffixes: list[bytes] = []
        self.classes: list[tuple] = []  # first, core, full, width
        self.members: list[tuple] = []  # arrays: class, row, start

    def add(self, texts: list[tuple[int, int, bytes]]) -> None:
        """texts: (row, offset, bytes)."""
        blob, core = b"".join(t for _, _, t in texts), self.length - reach(self.length) + 1
        ends = np.cumsum([len(t) for _, _, t in texts])
        at, low, high = samples(blob, ends.tolist(), self.length)
        of = np.searchsorted(ends, low, side="right")
        base = (np.concatenate([[0], ends[:-1]]) - [o for _, o, _ in texts])[of]
        rows, named = np.array([r for r, _, _ in texts], np.int64)[of], np.empty(len(at), np.int64)
        for k, (place, begin, end) in enumerate(zip(at.tolist(), low.tolist(), (high + self.length).tolist())):
            key = _digest(blob[place:place + core]), _digest(blob[begin:end], place - begin)
            number = self.numbers.setdefault(key, len(self.classes))
            if number == len(self.classes):
                self.classes.append((_digest(blob[place:place + min(FIRST, core)]), *key, end - begin))
                self.suffixes.append(blob[place:min(place + self.length, end)])
            named[k] = number
        self.members.append((named, rows, low - base))
        self.size += len(blob)

    def transform(self) -> pa.RecordBatch | None:
        """A row for each class, in the order of the suffixes; then the stretches that classes of several members cover."""
        if not self.classes:
            return None
        of, row, start = (np.concatenate(x) for x in zip(*self.members))
        first, core, full, width = np.array(self.classes, np.uint64).T
        counts, (_, heads) = np.bincount(of), np.unique(of, return_index=True)
        order = np.array(sorted(range(len(self.classes)), key=self.suffixes.__getitem__))
        again = np.flatnonzero(counts[of] > 1)
        spans = covered(row[again], start[again], start[again] + width[of[again]].astype(np.int64))
        none, whole = [None] * len(spans[0]), lambda x: x.view(np.int64).tolist()
        return record(first=pa.array(whole(first[order]) + none, pa.int64()), core=pa.array(whole(core[order]) + none, pa.int64()),
                      full=pa.array(whole(full[order]) + none, pa.int64()), width=pa.array(width[order].tolist() + none, pa.int32()),
                      members=pa.array(counts[order].tolist() + none, pa.int64()),
                      row=pa.array(np.concatenate([row[heads][order], spans[0]])),
                      start=pa.array(np.concatenate([start[heads][order], spans[1]])),
                      end=pa.array([None] * len(order) + spans[2].tolist(), pa.int64()))


def covered(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of rows put together where they overlap or touch."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    apart = np.cumsum(np.diff(row, prepend=row[:1]) != 0) * (int(end.max()) + 1)  # no row reaches into the next one
    reached = np.maximum.accumulate(end + apart)
    new = np.flatnonzero(np.concatenate([[True], start[1:] + apart[1:] > reached[:-1]]))
    last = np.append(new[1:] - 1, len(row) - 1)
    return row[new], start[new], reached[last] - apart[last]


def _pieces(row: int, text: bytes, length: int) -> Iterator[tuple[int, int, bytes]]:
    for at in range(0, max(1, len(text) - length + 1), PIECE):
        yield row, at, text[at:at + PIECE + length - 1]


def transforms(texts: DataFrame, length: int) -> DataFrame:
    """first, core, full, width, members, row, start (of one of them): the classes of every shard; and, without these
    digests, row, start, end: what classes with several members in a shard cover. texts: row, text."""

    def run(batches):
        shard, held, size = Shard(length), [], 0
        for part in slices(batches):
            for row, text in zip(part["row"].to_pylist(), part["text"].cast(pa.binary()).to_pylist()):
                for piece in _pieces(row, text, length):
                    if len(piece[2]) >= length:
                        held.append(piece)
                        size += len(piece[2])
                    if size >= PIECE:
                        shard.add(held)
                        held, size = [], 0
                    if shard.size >= SHARD:
                        yield shard.transform()
                        shard = Shard(length)
        if held:
            shard.add(held)
        rest = shard.transform()
        if rest is not None:
            yield rest

    return texts.mapInArrow(run, "first long, core long, full long, width int, members long, row long, start long, end long")


def interleaved(classes: DataFrame) -> DataFrame:
    """The classes in blocks that hold two suffixes or more once their cores are compared; stored."""
    live, last = classes, None
    for compared in ("first", "core"):
        blocks = live.groupBy(compared).agg(F.sum("members").alias("suffixes")).filter("suffixes > 1")
        live = stored(live.join(blocks.select(compared), compared, "left_semi"), f"live-{compared}")
        if last is not None:
            dropped(last)
        last = live
    return live


def repeated(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, spans: of each text (row, text; stored) stretches in which every string of `length` bytes is repeated; all such
    strings lie in one of them."""
    found = stored(transforms(texts, length), "transforms")
    inner = stored(found.filter("core IS NULL").select("row", "start", "end"), "spans")
    live = interleaved(found.filter("core IS NOT NULL").drop("end"))
    dropped(found)
    classes = stored(live.groupBy("core", "full", "width").agg(F.sum("members").alias("members"), F.min(F.struct("row", "start")).alias("one")),
                     "classes")
    several = classes.filter("members > 1").select("core", "full", "width")
    whole = (live.filter("members = 1").join(several, ["core", "full", "width"], "left_semi")
             .select("row", "start", (F.col("start") + F.col("width")).alias("end")).union(inner))
    mixed = classes.groupBy("core").agg(F.count("*").alias("classes"), F.min("members").alias("least")).filter("classes > 1 AND least = 1")
    asked = classes.join(mixed.select("core"), "core").select("one.*", "core", "width", (F.col("members") == 1).alias("alone"))
    hashes = stored(_hashed(texts, asked, length), "strings")
    # equal strings name their sample alike, so a class hands in each of its strings once
    shared = hashes.groupBy("core", "string").agg(F.count("*").alias("times")).filter("times > 1")
    crossing = hashes.filter("alone").join(shared.select("core", "string"), ["core", "string"], "left_semi")
    spans = whole.union(crossing.select("row", "start", (F.col("start") + length).alias("end")))
    found = stored(spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")  # of one text
    dropped(inner, live, classes, hashes)
    return found


def _hashed(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """row, alone, core, start, string: a hash of each string of the classes asked for."""
    lists = asked.groupBy("row").agg(F.collect_list(F.struct("start", "width", "core", "alone")).alias("asked"))  # of one text

    def run(batches):
        for part in slices(batches, 64):
            columns = [[] for _ in range(5)]
            for row, text, given in zip(part["row"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), part["asked"].to_pylist()):
                for g in given:
                    low, count = g["start"], g["width"] - length + 1
                    for column, values in zip(columns, ([row] * count, [g["alone"]] * count, [g["core"]] * count, range(low, low + count),
                                                        (_digest(text[at:at + length]) for at in range(low, low + count)))):
                        column += values
            row, alone, core, start, string = columns
            yield record(row=pa.array(row, pa.int64()), alone=pa.array(alone, pa.bool_()), core=pa.array(core, pa.int64()),
                         start=pa.array(start, pa.int64()), string=pa.array(np.array(string, np.uint64).view(np.int64)))

    return texts.join(lists, "row").select("row", "text", "asked").mapInArrow(
        run, "row long, alone boolean, core long, start long, string long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay, end to end), removed (array of (start, end), maximal): a row for each row."""
    held = stored(text_rows(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "texts")
    spans = repeated(held.select("row", "text"), length)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one(part):
        sizes, kept, removed = [], [], []
        for text, given in zip(part["text"].cast(pa.binary()).to_pylist(), part["spans"].to_pylist()):
            runs = merged([(g["start"], g["end"]) for g in given or ()])
            edges = [0, *(x for r in runs for x in r), len(text)]
            sizes.append(len(text))
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            removed.append([{"start": a, "end": b} for a, b in runs])
        return record(doc_id=part["doc_id"], n_bytes=pa.array(sizes, pa.int64()), kept=pa.array(kept, pa.binary()), removed=pa.array(removed, span))

    return map_slices(held.join(spans, "row", "left").select("doc_id", "text", "spans"), one,
                      "doc_id long, n_bytes long, kept binary, removed array<struct<start: long, end: long>>")


def op12_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its bytes in 400-byte strings that start elsewhere too."""
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_bwt_dedup": op12_bwt_dedup}
ORACLE: dict[str, str] = {}
