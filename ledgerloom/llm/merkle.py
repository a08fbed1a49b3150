"""A Merkle manifest of a table whose parents keep the hash states before each of their children.

Rows are leaves; per language, in ascending doc_id, runs of eight become parents until one is left, the subroot, and the
subroots in order of language give the root likewise. A parent is stored with its children and with a copy of the hash
state before each child slot. Folding a changed leaf resumes, parent by parent, the state before its slot with the
replacement and the siblings to its right; nothing to the left is hashed again.

The tree grows in strata of `LEVELS` levels: a group holds at most 8**LEVELS consecutive nodes of a language, so that no
task ever holds more, however large a language is. Places come from one range sort of digests and ids, whose partitions
are counted; a language or id that many rows share is split like any other stretch. On the way down, each group meets its
stored parents and the one path that leads from it to the root. Texts are read once and never shuffled.

A null value counts as `-`, and a null doc_id or language comes first. Rows that repeat a doc_id are leaves of their own,
ordered by their digest; a row without doc_id is never taken as tampered. An empty table has no root and gives no rows.
Only the named columns are read, so further ones never clash.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_slices, record, stored, table
from ledgerloom.llm.midstate import DIGEST, WIDTH, fold, parents

LEVELS = 4  # of a stratum
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<above: boolean, slot: int, states: binary, run: binary>"
_NODE = "key string, index long, total long, digest binary"
_PARENT = "key string, block long, level int, place long, states binary, run binary, digest binary, top boolean, total long"


def _packed(value: bytes | None) -> bytes:
    return b"-" if value is None else b"%d:%s" % (len(value), value)


def tampered(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(b"%d" % doc_id) % 3 == 0


def leaves(docs: DataFrame) -> DataFrame:
    """key (orders languages, null first), doc_id, digest, changed (the leaf after tampering, null without)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
                       docs["lang"].cast("string").alias("lang"), docs["n_chars"].cast("long").alias("n_chars"),
                       docs["text"].cast("string").alias("text"))

    def one(part):
        ids, counts = part["doc_id"].to_pylist(), part["n_chars"].to_pylist()
        source, lang, text = (part[c].cast(pa.binary()).to_pylist() for c in ("source", "lang", "text"))
        digests, changed = [], []
        for d, s, la, n, t in zip(ids, source, lang, counts, text):
            head = _packed(None if d is None else b"%d" % d) + _packed(s) + _packed(la) + _packed(None if n is None else b"%d" % n)
            state = sha256(head)
            other = state.copy() if tampered(d) else None
            state.update(_packed(t))
            digests.append(state.digest())
            if other is not None:
                other.update(_packed(None if t is None else t.lower()))
            changed.append(other and other.digest())
        return record(key=pa.array(["" if la is None else "." + la.decode() for la in lang], pa.string()), doc_id=part["doc_id"],
                      digest=pa.array(digests, pa.binary()), changed=pa.array(changed, pa.binary()))

    return map_slices(rows, one, "key string, doc_id long, digest binary, changed binary")


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """`nodes` with index (place in its key by `order`) and total (nodes of the key)."""
    by = ["key", *order, "spread"]
    ranges = nodes.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    held = stored(ranges.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
                  .drop("spread"), "places")
    key = Window.partitionBy("key")
    counts = (held.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
              .withColumn("before", F.sum("n").over(key.orderBy("part")) - F.col("n"))
              .withColumn("total", F.sum("n").over(key)))
    return (held.join(counts, ["key", "part"]).withColumn("index", F.col("at") - F.col("first") + F.col("before"))
            .drop("at", "part", "n", "first", "before"))


def _digests(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIGEST)


def _levels(total: int, levels: int) -> int:
    """Levels that a group of a language with so many nodes has of its own."""
    up = 0
    while total > 1 and up < levels:
        total, up = -(-total // WIDTH), up + 1
    return up


def grown(nodes: DataFrame, levels: int) -> DataFrame:
    """The parents of a stratum, by group; those marked top are the nodes of the next."""

    def grow(group: pa.Table) -> pa.Table:
        group = group.sort_by("index")
        key, total = group["key"][0].as_py(), group["total"][0].as_py()
        block = group["block"][0].as_py()
        rows, value, own = [], _digests(group["digest"]), _levels(total, levels)
        for level in range(own):
            value, before, runs, sizes = parents(value)
            rows += [(key, block, level, at, before[at].astype("<u4").tobytes(), runs[at, :sizes[at]].tobytes(),
                      value[at].tobytes(), level == own - 1, -(-total // WIDTH**levels)) for at in range(len(value))]
        return _table(rows, _PARENT)

    several = nodes.filter("total > 1").select("key", "index", "total", "digest", _block(levels))
    return several.groupBy("key", "block").applyInArrow(grow, _PARENT)


def _block(levels: int):
    return F.floor(F.col("index") / F.lit(WIDTH**levels)).cast("long").alias("block")


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


class _Group:
    """What a group needs to fold its nodes: its own parents by level, and the steps that all of them share above."""

    def __init__(self, kept: pa.Table):
        rows = kept.to_pylist()
        self.steps = next(r["path"] for r in rows if r["level"] is None)
        own = [r for r in rows if r["level"] is not None]
        self.levels = []
        for level in range(1 + max((r["level"] for r in own), default=-1)):
            at = sorted((r for r in own if r["level"] == level), key=lambda r: r["place"])
            self.levels.append([(r["states"], r["run"]) for r in at])

    def path(self, at: int) -> list[dict]:
        """The steps from the group's node `at` to the root."""
        out = []
        for level in self.levels:
            slot, at = at % WIDTH, at // WIDTH
            out.append({"above": False, "slot": slot, "states": level[at][0], "run": level[at][1]})
        return out + self.steps

    def siblings(self, count: int) -> list[bytes]:
        """For each of the group's nodes, the hex digests of its siblings up to the root."""
        parts = [b""] * count
        for depth, level in enumerate(self.levels):
            for at in range(-(-count // WIDTH**depth)):
                run, slot = level[at // WIDTH][1], at % WIDTH
                rest = (run[:DIGEST * slot] + run[DIGEST * (slot + 1):]).hex().encode()
                for leaf in range(at * WIDTH**depth, min(count, (at + 1) * WIDTH**depth)):
                    parts[leaf] += rest
        tail = b"".join((s["run"][:DIGEST * s["slot"]] + s["run"][DIGEST * (s["slot"] + 1):]).hex().encode() for s in self.steps)
        return [p + tail for p in parts]

    def folded(self, values: np.ndarray, above: bool = True) -> np.ndarray:
        """The root (or, not `above`, the subroot) for each value in the place of the node of its number."""
        count = len(values)
        at = np.arange(count)
        for level in self.levels:
            states = np.frombuffer(b"".join(s for s, _ in level), "<u4").reshape(-1, WIDTH, 8)
            sizes = np.array([len(r) // DIGEST for _, r in level])
            runs = np.frombuffer(b"".join(r.ljust(WIDTH * DIGEST, b"\0") for _, r in level), np.uint8).reshape(-1, WIDTH, DIGEST)
            up, slot = at // WIDTH, at % WIDTH
            values = fold(values, slot, states[up, slot], runs[up], sizes[up])
            at = up
        for step in self.steps:
            if step["above"] and not above:
                break
            size, slot = len(step["run"]) // DIGEST, step["slot"]
            state = np.frombuffer(step["states"], "<u4").reshape(WIDTH, 8)[slot]
            run = np.frombuffer(step["run"].ljust(WIDTH * DIGEST, b"\0"), np.uint8).reshape(1, WIDTH, DIGEST)
            values = fold(values, np.full(count, slot), np.repeat(state[None], count, axis=0).astype(np.uint32),
                          np.repeat(run, count, axis=0), np.full(count, size))
        return values


class Tree:
    """The strata of the trees of all keys: nodes with their places, parents with their states."""

    def __init__(self, nodes: DataFrame, levels: int = LEVELS):
        self.levels, self.strata = levels, []
        while True:
            most = nodes.agg(F.max("total")).first()[0] or 0
            up = stored(grown(nodes, levels), "parents") if most > 1 else None
            self.strata.append((nodes, up))
            if up is None:
                break
            nodes = up.filter("top").select("key", F.col("block").alias("index"), "total", "digest")

    def roots(self) -> DataFrame:
        """key, digest: of each key the node that was left."""
        ends = [n.filter("total = 1").select("key", "digest") for n, _ in self.strata]
        out = ends[0]
        for e in ends[1:]:
            out = out.union(e)
        return out

    def _met(self, stratum: int, above: DataFrame | None):
        """Groups of a stratum beside their parents and the path above them. above: key, path of the keys' roots."""
        nodes, up = self.strata[stratum]
        alone = nodes.filter("total = 1").select("key", F.lit(0).cast("long").alias("block"))
        alone = (alone.join(above, "key") if above is not None
                 else alone.withColumn("path", F.expr(f"cast(array() as array<{_STEP}>)")))
        paths = alone.select("key", "block", "path")
        if up is not None:
            paths = paths.union(self.paths(stratum + 1, above).select("key", F.col("index").alias("block"), "path"))
        kept = paths.select(F.col("key").alias("of"), F.col("block").alias("group"), F.lit(None).cast("int").alias("level"),
                            F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("states"), F.lit(None).cast("binary").alias("run"), "path")
        if up is not None:
            kept = kept.union(up.select(F.col("key").alias("of"), F.col("block").alias("group"), "level", "place",
                                        "states", "run", F.lit(None).cast(f"array<{_STEP}>").alias("path")))
        own = nodes.withColumn("block", _block(self.levels))
        return own.groupBy("key", "block").cogroup(kept.groupBy("of", "group"))

    def paths(self, stratum: int, above: DataFrame | None = None) -> DataFrame:
        """key, index, path: the steps from each node of a stratum to the root."""
        kind = pa.list_(pa.struct([("above", pa.bool_()), ("slot", pa.int32()), ("states", pa.binary()), ("run", pa.binary())]))

        def walk(nodes: pa.Table, kept: pa.Table) -> pa.Table:
            nodes, group = nodes.sort_by("index"), _Group(kept)
            paths = [group.path(at) for at in range(nodes.num_rows)]
            return pa.table([nodes["key"], nodes["index"], pa.array(paths, kind)], names=["key", "index", "path"])

        return self._met(stratum, above).applyInArrow(walk, f"key string, index long, path array<{_STEP}>")

    def folds(self, above: DataFrame) -> DataFrame:
        """doc_id, digest, subroot, proof, folded of each leaf; leaves have doc_id and changed beside the columns of nodes."""

        def walk(nodes: pa.Table, kept: pa.Table) -> pa.Table:
            nodes, group = nodes.sort_by("index"), _Group(kept)
            values = [c or d for c, d in zip(nodes["changed"].to_pylist(), nodes["digest"].to_pylist())]
            folded = group.folded(np.frombuffer(b"".join(values), np.uint8).reshape(-1, DIGEST))
            subroot = group.folded(_digests(nodes["digest"][:1]), above=False)[0].tobytes()
            proofs = [sha256(p).digest() for p in group.siblings(nodes.num_rows)]
            return pa.table([nodes["doc_id"], nodes["digest"], pa.array([subroot] * nodes.num_rows, pa.binary()),
                             pa.array(proofs, pa.binary()), pa.array([f.tobytes() for f in folded], pa.binary())],
                            names=["doc_id", "digest", "subroot", "proof", "folded"])

        return self._met(0, above).applyInArrow(walk, "doc_id long, digest binary, subroot binary, proof binary, folded binary")


class Manifest:
    """The trees of the languages and the one above them. root: None for an empty table."""

    def __init__(self, docs: DataFrame, levels: int = LEVELS):
        self.tree = Tree(placed(stored(leaves(docs), "leaves"), "doc_id", "digest"), levels)
        subroots = self.tree.roots().select(F.lit("").alias("key"), F.col("key").alias("name"), "digest")
        named = placed(subroots, "name")
        self.names = named.select("name", "index")
        self.above = Tree(named.drop("name"), levels)
        last = self.above.roots().first()
        self.root = last and bytes(last["digest"])

    def folds(self) -> DataFrame:
        """doc_id, digest, subroot, proof, folded of each row."""
        steps = self.above.paths(0).withColumn("path", F.transform("path", lambda s: s.withField("above", F.lit(True))))
        return self.tree.folds(self.names.join(steps, "index").select(F.col("name").alias("key"), "path"))


def op11_midstate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, proof and the root that its tampered or original leaf folds to."""
    manifest = Manifest(table(spark, sf_dir, "documents"))
    text = lambda c: F.lower(F.hex(c))
    root = F.lit(manifest.root and manifest.root.hex()).cast("string")
    return manifest.folds().select(
        "doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"),
        text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (text("folded") == root).alias("verified"))


SQL = """
WITH RECURSIVE bits AS (  -- the CRC needs a number of each row
  SELECT doc_id, source, lang, n_chars, text, doc_id::VARCHAR AS d, row_number() OVER () AS n FROM documents
), crc AS (
  SELECT n, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(d, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c
  FROM bits
), leaves AS (
  SELECT doc_id, lang, head || coalesce(strlen(text) || ':' || text, '-') AS own,
    head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
    xor(c, 4294967295) % 3 = 0 AS tampered
  FROM (SELECT *, coalesce(strlen(d) || ':' || d, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM bits)
  JOIN crc USING (n)
), ranked AS (
  SELECT doc_id, coalesce('.' || lang, '') AS k, sha256(own) AS leaf,
    CASE WHEN tampered THEN sha256(low) ELSE sha256(own) END AS value,
    row_number() OVER (PARTITION BY coalesce('.' || lang, '') ORDER BY doc_id NULLS FIRST, sha256(own)) - 1 AS i
  FROM leaves
), nodes AS (
  SELECT k, 0 AS level, i, leaf AS digest, count(*) OVER (PARTITION BY k) AS total FROM ranked
  UNION ALL
  SELECT k, level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (any_value(total) + 7) // 8
  FROM nodes WHERE total > 1 GROUP BY k, level, i // 8
), subroots AS (SELECT k, digest, row_number() OVER (ORDER BY encode(k)) - 1 AS i FROM nodes WHERE total = 1
), tops AS (
  SELECT 0 AS level, i, digest, count(*) OVER () AS total FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (any_value(total) + 7) // 8
  FROM tops WHERE total > 1 GROUP BY level, i // 8
), runs AS (
  SELECT k, level, i // 8 AS up, list(digest ORDER BY i) AS run FROM nodes WHERE total > 1 GROUP BY ALL
  UNION ALL
  SELECT s.k, 1000 + t.level, t.up, t.run FROM subroots AS s
  JOIN (SELECT level, i // 8 AS up, list(digest ORDER BY i) AS run FROM tops WHERE total > 1 GROUP BY ALL) AS t
    ON t.up = s.i // (8 ** (t.level + 1))::BIGINT
), walk AS (
  SELECT r.k, r.doc_id, r.leaf, r.i AS row, r.i AS at, 0 AS level, r.value, '' AS proof, 0 AS step FROM ranked AS r
  UNION ALL
  SELECT w.k, w.doc_id, w.leaf, w.row, CASE WHEN u.run IS NULL THEN (SELECT s.i FROM subroots AS s WHERE s.k = w.k) ELSE w.at // 8 END,
    CASE WHEN u.run IS NULL THEN 1000 ELSE w.level + 1 END,
    CASE WHEN u.run IS NULL THEN w.value ELSE sha256(array_to_string(list_concat(u.run[:w.at % 8], [w.value], u.run[w.at % 8 + 2:]), '')) END,
    CASE WHEN u.run IS NULL THEN w.proof ELSE w.proof || array_to_string(list_concat(u.run[:w.at % 8], u.run[w.at % 8 + 2:]), '') END,
    w.step + 1
  FROM walk AS w LEFT JOIN runs AS u ON u.k = w.k AND u.level = w.level AND u.up = w.at // 8
  WHERE u.run IS NOT NULL OR w.level < 1000
), ends AS (SELECT * FROM walk QUALIFY step = max(step) OVER (PARTITION BY k, row))
SELECT e.doc_id, e.leaf, s.digest AS subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.value AS folded_root,
  e.value = t.digest AS verified
FROM ends AS e JOIN subroots AS s USING (k), (SELECT digest FROM tops WHERE total = 1) AS t
"""


QUERIES = {"op11_midstate_manifest": op11_midstate_manifest}
ORACLE = {"op11_midstate_manifest": SQL}
