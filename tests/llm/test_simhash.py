import random
import re

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components
from tests.llm.fixtures import folder, none, odd  # noqa: F401


def signed(x):
    return int(np.uint64(x).astype(np.int64))


def brute_fingerprint(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[k:k + words]) for k in range(len(found) - words + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, limit):
    """The least reachable value of each."""
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = sorted(values)
    for k, a in enumerate(held):
        for b in held[k + 1:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def family(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(120):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.append(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    return sorted({signed(x) for x in [*out, *((0xABC << 40) | rng.getrandbits(40) for _ in range(150)), 0, 1, 3, 7]})


@pytest.mark.parametrize("limit,bucket", [(2, 4000), (2, 3), (3, 4), (0, 5), (1, 2), (7, 4000), (9, 40)])
def test_links_connect_what_is_within_the_limit(spark, limit, bucket):
    values = family(limit)
    nodes = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "first long, fp long")
    got = dict(map(tuple, components(simhash.links(nodes, limit, bucket)).collect()))
    assert {v: got.get(v, v) for v in values} == brute_roots(values, limit)


def test_thresholds():
    assert simhash.allot([[1.0, 5.0, 9.0], [1.0, 50.0, 90.0], [2.0, 9.0, 14.0]], 0) == (4.0, [0, 0, 0])
    assert simhash.allot([[9.0, 9.5], [100.0, 200.0]], 0) == (9.5, [1, -1])
    bits = simhash.deal_bits(np.random.default_rng(1).integers(0, 2, (200, 64)).astype(float), 3)
    assert sorted(b for g in bits for b in g) == list(range(64)) and max(map(len, bits)) - min(map(len, bits)) <= 1


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2, (500, 4))
    bits = np.concatenate([np.repeat(base[:, [k]], 16, axis=1) ^ (rng.random((500, 16)) < 0.02) for k in range(4)], axis=1)
    assert {tuple(g) for g in simhash.deal_bits(bits.astype(float), 4)} == {tuple(range(k, k + 16)) for k in range(0, 64, 16)}


def test_fitted_partitions_cover_the_limit():
    sample = np.random.default_rng(3).integers(0, 1 << 63, 300).astype(np.uint64)
    for limit in range(9):
        parts = simhash.fit(sample, 10**6, limit)
        held = [b for p in parts for b in p.bits]
        assert len(held) == len(set(held))
        assert sum(p.within + 1 for p in parts) == limit + 1  # whatever is within the limit is within one of them


def brute_groups(docs, words, limit):
    fps = [signed(brute_fingerprint(t, words)) for _, t in docs]
    roots, least = brute_roots(set(fps), limit), {}
    for (doc, _), fp in zip(docs, fps):
        if doc is not None:
            least[roots[fp]] = min(doc, least.get(roots[fp], doc))
    return [(doc, f"{fp & (1 << 64) - 1:016x}", least.get(roots[fp])) for (doc, _), fp in zip(docs, fps)]


def test_query_against_brute_force(spark, odd, folder):
    rng = random.Random(8)
    text = " ".join(rng.choice("alpha beta Gamma delta éta zeta".split()) for _ in range(80))
    more = [(100 + k, text if k < 4 else text.replace("beta", "b" * k, 1) if k < 20 else f"{k} {text[k:]}") for k in range(40)]
    rows = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    docs = [(r["doc_id"], r["text"]) for r in rows.collect()]
    got = simhash.op10_simhash_groups(spark, folder(documents=rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_groups(docs, 3, 2)))


def test_keep_first(spark, odd, none):
    kept = simhash.keep_first(odd, words=5, limit=7)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and not {1, 2, 3, 6} & set(ids)  # texts without words are one group
    assert simhash.keep_first(none, words=5, limit=7).collect() == []
    assert simhash.groups(none, 3, 2).collect() == []


def test_components_of_chains_and_loops(spark):
    links = [(k, k + 1) for k in range(100)] + [(200, 201), (201, 200), (300, 300), (202, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(101)}, 200: 200, 201: 200, 202: 200}
