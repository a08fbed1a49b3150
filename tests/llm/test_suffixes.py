import random
from hashlib import sha256

import numpy as np
import pytest

from ledgerloom.llm import suffixes
from tests.llm.fixtures import folder, none, odd  # noqa: F401


def brute(docs, length):
    """docs: (doc_id, text). (doc_id, n_bytes, n_removed, n_spans, digest of the rest)."""
    texts, places = [(t or "").encode() for _, t in docs], {}
    for k, t in enumerate(texts):
        for at in range(len(t) - length + 1):
            places.setdefault(t[at:at + length], []).append((k, at))
    gone = [np.zeros(len(t) + 2, bool) for t in texts]
    for found in places.values():
        for k, at in found if len(found) > 1 else ():
            gone[k][at + 1:at + 1 + length] = True
    out = []
    for (d, _), t, g in zip(docs, texts, gone):
        kept = np.frombuffer(t, np.uint8)[~g[1:-1]].tobytes()
        out.append((d, len(t), len(t) - len(kept), int((np.diff(g.astype(int)) == 1).sum()), sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["removed"]), sha256(r["kept"]).hexdigest()) for r in df.collect()), key=str)


def test_every_string_names_one_sample_whatever_surrounds_it():
    rng = random.Random(1)
    for alphabet in (b"ab", bytes(range(97, 117))):
        inner = bytes(rng.choice(alphabet) for _ in range(90))
        for _ in range(20):
            left, right = (bytes(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2))
            blob = left + inner + right
            at, low, high = suffixes.samples(blob, [len(blob)], 60)
            assert (low[1:] == high[:-1] + 1).all() and low[0] == 0 and high[-1] == len(blob) - 60
            named = np.concatenate([a - np.arange(x, y + 1) for a, x, y in zip(at, low, high)])
            alone, x, y = suffixes.samples(inner, [90], 60)
            want = np.concatenate([a - np.arange(p, q + 1) for a, p, q in zip(alone, x, y)])
            assert (named[len(left):len(left) + 31] == want).all()


def corpus(rng, count, alphabet, size):
    """Texts that share passages, whole or cut, of few different characters."""
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [word(size) for _ in range(6)]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randrange(5)):
            passage = rng.choice(shared)
            a, b = sorted(rng.randrange(size + 1) for _ in range(2))
            parts += [word(rng.randrange(size // 2)), passage[a:b] if rng.random() < 0.7 else passage]
        texts.append("".join(parts))
    return texts + texts[:3] + [shared[0], "a" * size * 2, word(3) * size, None, "", "short"]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnopé日"])
def test_against_brute_force(spark, monkeypatch, alphabet):
    monkeypatch.setattr(suffixes, "SHARD", 4000)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    docs = list(enumerate(corpus(random.Random(len(alphabet)), 60, alphabet, 150)))
    docs += [docs[5], (None, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs, 40)
    assert sum(x[2] > 0 for x in want) > 20
    assert result(suffixes.dedup(df, 40)) == want


def test_query_against_brute_force(spark, odd, folder):
    path, docs = folder(documents=odd), [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r) for r in suffixes.op12_bwt_dedup(spark, path).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute(docs, 400)


def test_odd_rows(spark, none):
    assert suffixes.dedup(none).collect() == []
    text = "x" * 399
    assert result(suffixes.dedup(spark.createDataFrame([(1, text), (1, text), (2, text + "x")], "doc_id long, text string")))[0][2] == 0
    with pytest.raises(ValueError):
        suffixes.reach(15)


def test_texts_of_few_different_strings_stay_small():
    """Every string of such a text names a sample of its own; they are one class, and one stretch."""
    shard = suffixes.Shard(400)
    text = b"a" * 300_000
    shard.add([(7, 0, text)])
    rows = shard.transform().to_pylist()
    assert len(shard.suffixes) == 1 and [r["members"] for r in rows] == [len(text) - 399, None]
    assert (rows[1]["row"], rows[1]["start"], rows[1]["end"]) == (7, 0, len(text))


def test_stretches_are_put_together():
    rng = np.random.default_rng(0)
    row, start = rng.integers(0, 5, 200), rng.integers(0, 300, 200)
    end = start + rng.integers(1, 9, 200)
    want = [(r, a, b) for r in range(5) for a, b in suffixes.merged(list(zip(start[row == r].tolist(), end[row == r].tolist())))]
    assert list(zip(*(x.tolist() for x in suffixes.covered(row, start, end)))) == want
