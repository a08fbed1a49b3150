"""I-Match fingerprints over randomised lexicons.

Document frequencies of all terms are counted, and the lexicon keeps the terms of a band of inverse document frequency:
not those that over `COMMON` of the documents use, and not those that fewer than `LEAST` do or that make up under `SHARE` of all
(document, term) pairs. Shares add up to one, so the lexicon has 1/SHARE terms at most at any size and can be broadcast.
A fingerprint is one hash for each of several random subsets of the lexicon: the text's distinct terms in that subset are sorted,
and their sequence is hashed. Subsets differ in how many terms they keep, from a quarter down to a 512th, so that small changes
leave most of the sparse subsets' hashes alone. The likeness of two fingerprints is the share of equal hashes among the
subsets in which either text has a term. A text without terms of the lexicon has the hash of its whole text, with
another seed for each subset.

Terms are white-space separated words, lowered, without signs at their ends; they are known by 64-bit hashes.

Null texts count as empty. Equal texts have equal fingerprints, empty ones too. Rows that repeat a doc_id give a row each; a
null doc_id sorts first. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import record, slices, stored, table, text_rows

COMMON = 0.1
LEAST = 2
SHARE = 2e-6
KEEP = tuple(2.0**-k for k in range(2, 10) for _ in range(8))  # share of the lexicon in each subset
DIGITS = 4  # hexadecimal digits of a subset's hash
EMPTY = "." * DIGITS
HELD = 1_000_000  # distinct terms that a task adds up before it passes them on
WORDS = 200_000  # words whose terms one Python worker keeps
FIRST = -(1 << 63)  # rank of a null doc_id
_SIGNS = re.compile(r"^[\W_]+|[\W_]+$")
_PLAIN = string.punctuation  # what is left without these is mostly letters and digits, and needs no pattern


class _Terms(dict):
    """The hash of a word's term, 0 for a word without letter or digit."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        term = word.strip(_PLAIN)
        if not term.isalnum():
            term = _SIGNS.sub("", word)
        found = self[word] = xxhash.xxh64_intdigest(term) or 1 if term else 0
        return found


_TERMS = _Terms()


def terms(text: str) -> set[int]:
    found = set(map(_TERMS.__getitem__, set(text.lower().split())))
    found.discard(0)
    return found


def document_frequencies(rows: DataFrame) -> DataFrame:
    """term, df of every term."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def made():
            keys = np.fromiter(held.keys(), np.uint64, len(held)).view(np.int64)
            return record(term=pa.array(keys), df=pa.array(np.fromiter(held.values(), np.int64, len(held))))

        for part in slices(batches):
            for text in part["text"].to_pylist():
                held.update(terms(text))
            if len(held) > HELD:
                yield made()
                held.clear()
        yield made()

    return rows.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(rows: DataFrame, common: float = COMMON, share: float = SHARE, least: int = LEAST) -> np.ndarray:
    """Sorted hashes of the terms in the band, 1/share at most."""
    found = stored(document_frequencies(rows), "document-frequencies")
    pairs = found.agg(F.sum("df")).first()[0] or 0
    low, high = max(least, share * pairs), max(least, common * rows.count())
    kept = found.filter((F.col("df") >= low) & (F.col("df") <= high)).select("term").toPandas()["term"]
    return np.sort(kept.to_numpy(np.int64).view(np.uint64))


def subsets(found: np.ndarray, keep: tuple[float, ...] = KEEP) -> np.ndarray:
    """By term and subset, whether the subset keeps the term: a mixed hash of both, under its share. A bit each."""
    salts = np.array([k * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for k in range(1, len(keep) + 1)], np.uint64)
    limits = np.array([min(share, 1.0) * (2.0**64 - 2**12) for share in keep]).astype(np.uint64)
    out = []
    for start in range(0, max(1, len(found)), 4096):
        x = found[start:start + 4096, None] ^ salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(np.packbits((x ^ (x >> np.uint64(31))) < limits, axis=1))
    return np.concatenate(out)


class Fingerprinter:
    """band: the lexicon's terms in order; bits: `subsets` of them, made once for all texts."""

    def __init__(self, band: np.ndarray, keep: tuple[float, ...] = KEEP, bits: np.ndarray | None = None):
        self.band, self.keep = band, keep
        self.bits = subsets(band, keep) if bits is None else bits

    def of(self, text: str) -> str:
        found = terms(text)
        found = np.fromiter(found, np.uint64, len(found))
        at = np.searchsorted(self.band, found)
        inside = at < len(self.band)
        at, found = at[inside], found[inside]
        at = np.sort(at[self.band[at] == found])
        if not len(at):
            return "".join(xxhash.xxh64_hexdigest(text, k)[:DIGITS] for k in range(len(self.keep)))
        held = np.unpackbits(self.bits[at], axis=1, count=len(self.keep)).T
        columns = np.flatnonzero(held) % len(at)
        data = self.band[at][columns].tobytes()
        ends = (8 * np.cumsum(held.sum(axis=1, dtype=np.int64))).tolist()
        return "".join(xxhash.xxh64_hexdigest(data[a:b])[:DIGITS] if a < b else EMPTY for a, b in zip([0, *ends], ends))


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the subsets in which either has a term."""
    pairs = [(a[k:k + DIGITS], b[k:k + DIGITS]) for k in range(0, len(a), DIGITS)]
    some = [x == y for x, y in pairs if x != EMPTY or y != EMPTY]
    return sum(some) / len(some) if some else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[float, ...] = KEEP) -> DataFrame:
    """doc_id, fingerprint, one row for each row of `docs`."""
    rows = text_rows(docs, id_col, text_col)
    held = lexicon(rows)
    band = docs.sparkSession.sparkContext.broadcast((held, keep, subsets(held, keep)))

    def run(batches):
        make = Fingerprinter(*band.value)
        for part in slices(batches):
            yield record(doc_id=part["doc_id"], fingerprint=pa.array([make.of(t) for t in part["text"].to_pylist()]))

    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def with_next(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) dealt into ranges of doc_id and sorted in each; a range ends with a copy of the row that begins the
    next one, the last range with that of the first. Columns: part, halo, rank, text."""
    spark = rows.sparkSession
    count = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select(F.coalesce("doc_id", F.lit(FIRST)).alias("rank"))
    cuts = ids.approxQuantile("rank", [k / count for k in range(1, count)], 1 / (4 * count)) or []
    cuts = np.array(sorted(set(map(int, cuts))), np.int64)

    def deal_ids(batches):
        for batch in batches:
            part = np.searchsorted(cuts, batch["rank"].to_numpy(), side="right")
            yield record(part=pa.array(part.astype(np.int32)), rank=batch["rank"])

    starts = (ids.mapInArrow(deal_ids, "part int, rank long").groupBy("part").agg(F.min("rank").alias("rank"))
              .orderBy("part").collect())  # a row a range
    before = {r["rank"]: starts[k - 1]["part"] for k, r in enumerate(starts)}

    def deal(batches):
        for part in slices(batches):
            ranks, texts = part["rank"].to_pylist(), part["text"]
            parts = np.searchsorted(cuts, part["rank"].to_numpy(), side="right").tolist()
            again = [k for k, r in enumerate(ranks) if r in before]
            take = pa.array([*range(len(ranks)), *again], pa.int32())
            yield record(part=pa.array([*parts, *(before[ranks[k]] for k in again)], pa.int32()),
                         halo=pa.array([False] * len(ranks) + [True] * len(again)),
                         rank=pa.array([*ranks, *(ranks[k] for k in again)], pa.int64()), text=texts.take(take))

    dealt = (rows.select(F.coalesce("doc_id", F.lit(FIRST)).alias("rank"), "text")
             .mapInArrow(deal, "part int, halo boolean, rank long, text string"))
    return dealt.repartition("part").sortWithinPartitions("part", "halo", "rank", "text")


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of the next."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def op7_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like they and the next document's are."""
    rows = text_rows(table(spark, sf_dir, "documents"))
    held = lexicon(rows)
    band = spark.sparkContext.broadcast((held, KEEP, subsets(held)))

    def run(batches):
        make, before = Fingerprinter(*band.value), None
        for part in slices(batches):
            out = []
            for key, halo, rank, text in zip(*(part[c].to_pylist() for c in ("part", "halo", "rank", "text"))):
                own = make.of(text)
                if before and before[0] == key:
                    out.append(compared(make, *before[1:], text, own))
                before = None if halo else (key, rank, text, own)
            if out:
                yield record(**{n: pa.array(c, k) for (n, k), c in zip(kinds, zip(*out))})

    def compared(make, rank, text, own, following, other):
        new = edited(text, following)
        changed = make.of(new)
        return (None if rank == FIRST else rank, len(text), hashlib.sha256(new.encode()).hexdigest(), own, changed,
                likeness(own, changed), likeness(own, other))

    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
             ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    return with_next(rows).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                           "edited_fingerprint string, near_edited double, near_next double")


QUERIES = {"op7_imatch_fingerprints": op7_imatch_fingerprints}
ORACLE: dict[str, str] = {}
