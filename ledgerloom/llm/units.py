"""Substring dedup by hashing lines and the sentences within them.

A text is cut into lines, and a line of several sentences also into these, so that a passage which was pasted into a
longer line is met sentence by sentence. A unit is normalised (lower case, white space as single spaces) and hashed to
128 bits; every unit with a word is compared, short ones too, and sentences also end at the full stops of scripts
without spaces. Digests are grouped over the whole table, and of each the occurrence ranked first stays: the least
doc_id, of rows with that id the one stored first, and in it the first place. All others are cut from their texts, and
what stays keeps its offsets in the original.
Only within one text may a unit stand again that has under `LEAST` words and under `CHARS` characters.

Only digests and ids are shuffled to find copies; a digest that many documents share is counted before the shuffle,
and the join that brings it back to its documents is split by adaptive execution. Each text then meets the digests
that it has to give up, a list no longer than its own units.

Null texts count as empty and stay null. Every row is a text of its own, whether or not its doc_id is repeated or null; a
null doc_id ranks before all others. An empty table gives an empty result. Operators return the id and their own
columns alone, so further columns never clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_slices, record, slices, stored, table

LEAST = 5  # words, or
CHARS = 25  # characters, from which a unit does not stand twice in its own text
FIRST = -(1 << 63)  # rank of a null doc_id
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_SENTENCE = re.compile(r".*?(?:[.!?]+(?:\s+|$)|[。！？]+\s*)|.+", re.S)


def stretches(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of every line, each followed by its sentences if it has several. Ends reach to the next unit."""
    for line in _LINE.finditer(text):
        whole, base = line.group(), line.start()
        words = whole.lower().split()
        if not words:
            continue
        yield base, line.end(), _digest(words)
        cut = list(_SENTENCE.finditer(whole))
        for m in cut if len(cut) > 1 else ():
            words = m.group().lower().split()
            if words:
                yield base + m.start(), base + m.end(), _digest(words)


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).encode())


def cut(text: str, copies: set[bytes], least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches to remove: those whose digest is in `copies`, and those of `least` words or `CHARS` characters that repeat
    an earlier one of the text."""
    out: list[tuple[int, int]] = []
    seen: dict[bytes, int] = {}
    for start, end, digest in stretches(text):
        # a sentence of a line that goes says nothing new, and stands for no first occurrence
        if out and end <= out[-1][1]:
            continue
        again = seen.setdefault(digest, start) != start
        if digest in copies or again and _long(text[start:end], least):
            if out and out[-1][1] == start:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return out


def _long(unit: str, least: int) -> bool:
    return len(unit.strip()) >= CHARS or len(unit.split()) >= least


def kept(size: int, removed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    ends = [0, *(e for _, e in removed)]
    starts = [*(s for s, _ in removed), size]
    return [(a, b) for a, b in zip(ends, starts) if a < b]


def _ranked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a number of its own for each), rank, text; stored, so that numbers stay."""
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(FIRST)).alias("rank"),
                       docs[text_col].cast("string").alias("text"), docs[id_col].cast("long").alias("doc_id"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "texts")


def digests(ranked: DataFrame) -> DataFrame:
    """rank, row, high, low: the distinct digests of each text."""

    def run(batches):
        for part in slices(batches):
            counts, data = [], []
            for text in part["text"].to_pylist():
                found = {d for _, _, d in stretches(text or "")}
                counts.append(len(found))
                data += found
            both = pa.py_buffer(b"".join(data))
            halves = pa.Array.from_buffers(pa.int64(), 2 * len(data), [None, both])
            pairs = halves.to_numpy().reshape(-1, 2)
            yield record(rank=pa.array(np.repeat(part["rank"].to_numpy(), counts)), row=pa.array(np.repeat(part["row"].to_numpy(), counts)),
                         high=pa.array(pairs[:, 0].copy()), low=pa.array(pairs[:, 1].copy()))

    return ranked.select("rank", "row", "text").mapInArrow(run, "rank long, row long, high long, low long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, text (what stays of it), kept and removed (arrays of (start, end) in the original), a row for each row."""
    ranked = _ranked(docs, id_col, text_col)
    found = stored(digests(ranked), "digests")
    place = F.struct("rank", "row")
    shared = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    copies = (found.join(shared, ["high", "low"]).filter(place > F.col("first"))
              .groupBy("row").agg(F.collect_list(F.struct("high", "low")).alias("copies")))  # a text's units at most
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def spans(rows):
        return pa.array([[dict(zip(("start", "end"), x)) for x in r] for r in rows], span)

    def one(part):
        texts, stays, goes = [], [], []
        for text, given in zip(part["text"].to_pylist(), part["copies"].to_pylist()):
            gone = {g["high"].to_bytes(8, "little", signed=True) + g["low"].to_bytes(8, "little", signed=True)
                    for g in given or ()}
            goes.append(cut(text or "", gone, least))
            stays.append(kept(len(text or ""), goes[-1]))
            texts.append(text if text is None else "".join(text[a:b] for a, b in stays[-1]))
        return record(doc_id=part["doc_id"], text=pa.array(texts, pa.string()), kept=spans(stays), removed=spans(goes))

    pairs = "array<struct<start: long, end: long>>"
    joined = ranked.select("row", "doc_id", "text").join(copies, "row", "left").select("doc_id", "text", "copies")
    return map_slices(joined, one, f"doc_id long, text string, kept {pairs}, removed {pairs}")


def op2_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document, and the stretches that go, as start:end, comma-joined."""
    found = dedup(table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select("doc_id", "text", listed("kept").alias("kept"), listed("removed").alias("removed"),
                        F.size("removed").cast("long").alias("n_removed"))


QUERIES = {"op2_unit_dedup": op2_unit_dedup}
ORACLE: dict[str, str] = {}
