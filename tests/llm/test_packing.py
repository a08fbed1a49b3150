import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from tests.llm.fixtures import folder, none, odd  # noqa: F401

CASES = [(packing.Capacity(64), "norm", (1, 0, 0)), (packing.Capacity(64, 3), "norm", (1, 0.2, 0)),
         (packing.Capacity(64, 5, 1500), "norm", (1, 0.1, 0.1)), (packing.Capacity(64, 5, 1500), "dot", (1, 0.1, 0.1))]


def bins(counts, slots):
    out = defaultdict(list)
    for k, length in enumerate(slots.length):
        last = k + 1 == len(slots.length) or slots.length[k + 1] != length
        for j in range((counts[length] if last else slots.rank[k + 1]) - slots.rank[k]):
            out[slots.sequence[k] + j].append((slots.offset[k], length))
    return out


@pytest.mark.parametrize("capacity,score,weights", CASES)
def test_plans_hold_under_every_constraint(capacity, score, weights):
    rng = random.Random(1)
    for size in (0, 1, 7, 500, 20_000):
        counts = Counter(min(38, max(1, int(rng.lognormvariate(2, 1)))) for _ in range(size))
        slots = packing.plan(counts, capacity, weights, score)
        held = bins(counts, slots)
        assert sum(map(len, held.values())) == size and len(held) == slots.sequences
        for found in held.values():
            at = 0
            for offset, length in sorted(found):
                assert offset == at
                at += length
            assert at <= capacity.tokens and len(found) <= (capacity.documents or at)
            assert sum(n * n for _, n in found) <= (capacity.attention or 10**9)


def test_near_the_lower_bound():
    rng = random.Random(2)
    counts = Counter(min(4096, max(1, int(rng.lognormvariate(6.5, 1)))) for _ in range(20_000))
    slots = packing.plan(counts)
    assert slots.sequences <= 1.002 * sum(n * c for n, c in counts.items()) / 4096 + 1


def test_as_good_as_best_fit_one_by_one():
    rng = random.Random(3)
    items = sorted((rng.randint(1, 60) for _ in range(600)), reverse=True)
    left = []
    for n in items:
        fits = [k for k, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(64 - n)
    assert packing.plan(Counter(items), packing.Capacity(64)).sequences == len(left)


def test_a_piece_beyond_the_capacity():
    with pytest.raises(ValueError):
        packing.plan({65: 1}, packing.Capacity(64))


def check(rows, docs, tokens):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), tokens)):
            piece = np.array(ids[start:start + tokens], "<u4")
            want[doc, k, start, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in held.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= tokens


def test_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(packing, "PER_BUCKET", 2)  # several buckets a length
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(packing.pack(odd, "word_bpe_49k.json", 1, packing.Capacity(100)).collect(), docs, 100)
    assert packing.pack(none, "word_bpe_49k.json", 1).collect() == []


def test_query(spark, odd, folder):
    path = folder(documents=odd)
    check(packing.op4_best_fit_packing(spark, path).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], 4096)
