import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import merkle, midstate
from tests.llm.fixtures import folder, none, odd  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def packed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(d, source, lang, n, text):
    return h(*map(packed, (d, source, lang, n, text)))


def tree(nodes):
    """All levels, from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k:k + 8]) for k in range(0, len(last), 8)])
    return levels


def up(levels, at):
    """(siblings left, siblings right) of each level."""
    out = []
    for level in levels[:-1]:
        run, slot = level[at // 8 * 8:at // 8 * 8 + 8], at % 8
        out.append((run[:slot], run[slot + 1:]))
        at //= 8
    return out


def brute(docs):
    """docs: rows with the fields. (doc_id, leaf, subroot, root, proof, folded, verified)."""
    by = {}
    for r in docs:
        by.setdefault((r["lang"] is not None, (r["lang"] or "").encode()), []).append(
            (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]), r))
    langs = {k: tree([x[2] for x in sorted(v, key=lambda x: x[:3])]) for k, v in by.items()}
    names = sorted(langs)
    top = tree([langs[k][-1][0] for k in names])
    out = []
    for k in names:
        for at, (_, _, own, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            path = up(langs[k], at) + up(top, names.index(k))
            value = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                value = leaf(r["doc_id"], r["source"], r["lang"], r["n_chars"], low)
            for left, right in path:
                value = h(*left, value, *right)
            proof = h(*(x for left, right in path for x in left + right))
            out.append((r["doc_id"], own, langs[k][-1][0], top[-1][0], proof, value, value == top[-1][0]))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_states_are_those_of_sha256():
    rng = np.random.default_rng(3)
    for count in (1, 2, 7, 8, 9, 64, 65):
        children = rng.integers(0, 256, (count, 32), np.uint8)
        digests, before, runs, sizes = midstate.parents(children)
        hexed = [c.tobytes().hex() for c in children]
        assert [d.tobytes().hex() for d in digests] == [h(*hexed[k:k + 8]) for k in range(0, count, 8)]
        at = np.arange(count)
        other = rng.integers(0, 256, (count, 32), np.uint8)
        folded = midstate.fold(other, at % 8, before[at // 8, at % 8], runs[at // 8], sizes[at // 8])
        for k in range(count):
            run = hexed[k // 8 * 8:k // 8 * 8 + 8]
            run[k % 8] = other[k].tobytes().hex()
            assert folded[k].tobytes().hex() == h(*run)


def test_several_strata_against_brute_force(spark):
    """One level a stratum, so that small trees cross many of them."""
    rows = [(k, f"Text {k} WITH Capitals", lang, "web", k) for lang, n in (("en", 80), ("de", 9), ("fr", 8), ("", 1), (None, 3))
            for k in range(hash(n) % 7, n + hash(n) % 7)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    found = merkle.Manifest(docs, levels=1).folds().collect()
    got = [(r["doc_id"], *(bytes(r[c]).hex() for c in ("digest", "subroot", "proof", "folded"))) for r in found]
    want = [(d, own, sub, proof, folded) for d, own, sub, _, proof, folded, _ in brute(docs.collect())]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query_against_brute_force(spark, odd, folder):
    docs = odd.withColumn("source", F.lit("run")).withColumn("key", F.lit("x")).withColumn("index", F.lit(7))
    assert result(merkle.op11_midstate_manifest(spark, folder(documents=docs))) == brute(docs.collect())


def test_every_third_is_found_tampered(spark, folder):
    rows = [(k, "Written With Capitals", "en", "web", 21) for k in range(300)]
    found = merkle.op11_midstate_manifest(spark, folder(documents=spark.createDataFrame(rows, DOCS))).collect()
    assert {r["doc_id"] for r in found if not r["verified"]} == {k for k in range(300) if zlib.crc32(str(k).encode()) % 3 == 0}


def test_one_row_and_none(spark, folder, none, tmp_path):
    one = spark.createDataFrame([(5, None, None, None, None)], DOCS)
    assert result(merkle.op11_midstate_manifest(spark, folder(documents=one))) == brute(one.collect())
    none.withColumn("source", F.lit("x")).write.parquet(str(tmp_path / "empty/documents.parquet"))
    assert merkle.op11_midstate_manifest(spark, str(tmp_path / "empty")).collect() == []
