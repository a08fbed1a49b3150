"""Token ids as wavelet matrices: one compressed, self-contained binary file for each shard of documents.

A shard holds whole documents in ascending doc_id order. Its ids are stored as bit planes from the highest
bit down: each plane keeps one bit of every id, and after each plane the ids with a 0 go, in order, before
those with a 1. With a directory of running bit counts, a plane answers rank in constant time and select by
bisection, so the file gives any id, the count of an id in any stretch, and its k-th place, without the ids
themselves being kept. `encode_shards` makes the files in one pass over the sorted texts, `write` stores them
through Spark's writer in a folder that the cluster shares, one file a row, and `decode` reads ids back.

A null text counts as empty: its document has the end id alone. Rows that repeat a doc_id are documents of
their own, ordered by their text; a null doc_id sorts first. Very long texts make one longer shard.
An empty table gives an empty folder. Further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import record, scratch, slices, table, text_rows
from ledgerloom.llm.tokens import encoder

MAGIC = b"WMX1"
HEADER = struct.Struct("<4sBQQ")  # magic, planes, ids, documents
WORD = 512  # bits between two entries of a plane's directory
SHARD = 1 << 20  # ids after which a shard is closed at the next end of a document


class Plane:
    """One bit of every id, packed, with the ones before each block of WORD bits."""

    def __init__(self, packed: np.ndarray, size: int):
        self.packed, self.size = packed, size

    @cached_property
    def before(self) -> np.ndarray:
        blocks = np.pad(self.packed, (0, -len(self.packed) % (WORD // 8))).reshape(-1, WORD // 8)
        return np.concatenate([[0], np.cumsum(np.bitwise_count(blocks).sum(axis=1, dtype=np.int64))])

    @cached_property
    def zeros(self) -> int:
        return self.size - int(self.before[-1])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.size, bitorder="little").view(bool)

    def bit(self, at: int) -> int:
        return int(self.packed[at >> 3]) >> (at & 7) & 1

    def rank(self, bit: int, at: int) -> int:
        """Bits equal to `bit` before `at`."""
        block, byte = at // WORD, at >> 3
        ones = int(self.before[block]) + int(np.bitwise_count(self.packed[block * (WORD // 8):byte]).sum())
        if at & 7:
            ones += (int(self.packed[byte]) & (1 << (at & 7)) - 1).bit_count()
        return ones if bit else at - ones

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit equal to `bit`."""
        low, high = 0, self.size
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.rank(bit, mid + 1) > k else (mid + 1, high)
        return low


class WaveletMatrix:
    def __init__(self, planes: list[Plane], size: int):
        self.planes, self.size = planes, size

    @classmethod
    def of(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        planes, rest = [], ids
        for level in range(width - 1, -1, -1):
            bits = rest & rest.dtype.type(1 << level) != 0
            planes.append(Plane(np.packbits(bits, bitorder="little"), len(ids)))
            rest = np.concatenate([np.compress(~bits, rest), np.compress(bits, rest)])
        return cls(planes, len(ids))

    def ids(self) -> np.ndarray:
        """All ids: the partings of the planes undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        rest = np.zeros(self.size, kind)
        for level, plane in enumerate(reversed(self.planes)):
            bits, out = plane.bits(), np.empty(self.size, kind)
            out[np.flatnonzero(~bits)] = rest[:plane.zeros]
            out[np.flatnonzero(bits)] = rest[plane.zeros:] | kind(1 << level)
            rest = out
        return rest

    def _down(self, plane: Plane, bit: int, at: int) -> int:
        return plane.rank(bit, at) + (plane.zeros if bit else 0)

    def access(self, at: int) -> int:
        found = 0
        for plane in self.planes:
            bit = plane.bit(at)
            found = found << 1 | bit
            at = self._down(plane, bit, at)
        return found

    def _path(self, token: int) -> list[tuple[Plane, int]]:
        width = len(self.planes)
        return [(p, token >> (width - 1 - k) & 1) for k, p in enumerate(self.planes)]

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often `token` occurs in [start, end)."""
        end = self.size if end is None else end
        if token >> len(self.planes):
            return 0
        for plane, bit in self._path(token):
            start, end = self._down(plane, bit, start), self._down(plane, bit, end)
        return end - start

    def find(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) `token`; -1 if there are fewer."""
        if not 0 <= k < self.count(token):
            return -1
        first = 0
        for plane, bit in self._path(token):
            first = self._down(plane, bit, first)
        at = first + k
        for plane, bit in reversed(self._path(token)):
            at = plane.select(bit, at - (plane.zeros if bit else 0))
        return at


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    """A shard's file. ids: of all its documents, end to end."""
    matrix = WaveletMatrix.of(ids, width)
    index = np.array([[0 if d is None else d for d in doc_ids], [d is None for d in doc_ids], lengths], "<i8")
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [squeeze(index.tobytes()), *(squeeze(p.packed.tobytes()) for p in matrix.planes)]
    sizes = struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return b"".join([HEADER.pack(MAGIC, width, len(ids), len(doc_ids)), sizes, *parts])


class Shard:
    """A file opened: `doc_ids`, `starts` (one more than documents), `matrix`."""

    def __init__(self, data: bytes):
        magic, width, size, documents = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        sizes = struct.unpack_from(f"<{width + 1}Q", data, HEADER.size)
        ends = np.cumsum([HEADER.size + 8 * (width + 1), *sizes]).tolist()
        expand = zstandard.ZstdDecompressor().decompress
        index, *planes = (expand(data[a:b]) for a, b in zip(ends, ends[1:]))
        ids, missing, lengths = np.frombuffer(index, "<i8").reshape(3, documents)
        self.doc_ids = [None if m else int(d) for d, m in zip(ids, missing)]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.matrix = WaveletMatrix([Plane(np.frombuffer(p, np.uint8), size) for p in planes], size)

    def document(self, k: int) -> np.ndarray:
        return np.array([self.matrix.access(i) for i in range(self.starts[k], self.starts[k + 1])], np.uint32)


def encode_shards(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                  shard: int = SHARD) -> DataFrame:
    """part, shard, before (ids of the part's earlier shards), n_tokens, file. Parts and shards ascend with doc_id."""
    rows = text_rows(docs, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        width = max(1, (max(encode.library.get_vocab_size(), end_id + 1) - 1).bit_length())
        end = np.array([end_id], encode.kind)
        names, held, size, number, before = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            data = pack(names, [len(x) + 1 for x in held[::2]], np.concatenate(held), width)
            return record(part=pa.array([part], pa.int32()), shard=pa.array([number], pa.int32()),
                          before=pa.array([before], pa.int64()), n_tokens=pa.array([size], pa.int64()),
                          file=pa.array([data], pa.binary()))

        for piece in slices(batches):
            for doc, text in zip(piece["doc_id"].to_pylist(), piece["text"].to_pylist()):
                names.append(doc)
                held += [encode.ids(text), end]
                size += len(held[-2]) + 1
                if size >= shard:
                    yield closed()
                    names, held, number, before, size = [], [], number + 1, before + size, 0
        if names:
            yield closed()

    return ordered.mapInArrow(run, "part int, shard int, before long, n_tokens long, file binary")


def write(shards: DataFrame, folder: str) -> None:
    shards.write.option("compression", "uncompressed").parquet(folder)


def decode(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a folder."""
    files = spark.read.schema("part int, shard int, before long, n_tokens long, file binary").parquet(folder)
    totals = sorted(files.groupBy("part").agg(F.sum("n_tokens")).collect())  # a row a partition of the writer
    first = dict(zip((p for p, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist()))

    def run(batches):
        for row in slices(batches, 1):
            part, before, data = (row[c][0].as_py() for c in ("part", "before", "file"))
            shard = Shard(data)
            ids, base = shard.matrix.ids().astype("<u4"), first[part] + before
            cuts = list(zip(shard.starts, shard.starts[1:]))
            yield record(doc_id=pa.array(shard.doc_ids, pa.int64()),
                         start=pa.array([int(base + a) for a, _ in cuts], pa.int64()),
                         n_tokens=pa.array([int(b - a) for a, b in cuts], pa.int64()),
                         ids_crc32=pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in cuts], pa.int64()))

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to token files and read back from them."""
    folder = scratch(spark, "token-files")
    write(encode_shards(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 2), folder)
    return decode(spark, folder)


QUERIES = {"op8_wavelet_shards": op8_wavelet_shards}
ORACLE: dict[str, str] = {}
