import random

import corpus_pipeline
from ledgerloom.llm import jaccard
from ledgerloom.llm.simhash import fingerprint
from tests.llm.fixtures import none, odd  # noqa: F401

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, words=5):
    """The (id, text) that stays of each group, by all pairs of texts."""

    def cut(text):
        found = (text or "").lower().split()
        size = min(words, len(found))
        return frozenset(tuple(found[k:k + size]) for k in range(len(found) - size + 1)) if found else frozenset()

    sets, root = [cut(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(top(k), []).append(-(1 << 63) if i is None else i)
    return sorted(min(x) for x in least.values())


def edited(rng, words, changes):
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = f"x{rng.randrange(10 ** 9)}"
    return out


def corpus():
    """Edits of some texts, more and fewer than 0.8 allows, chains of them, one shared passage, short and empty texts."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    texts, passage = [], fresh(60)
    for _ in range(25):
        base = fresh(rng.randrange(20, 160))
        texts += [base, *(edited(rng, base, rng.randrange(0, 1 + len(base) // 30)) for _ in range(4))]
    base = fresh(150)
    texts += [edited(rng, base, rng.randrange(1, 4)) for _ in range(40)]  # one large group, of which many pairs fail
    texts += [passage + fresh(rng.randrange(5, 12)) for _ in range(40)]
    chain = fresh(120)
    for _ in range(12):
        chain = edited(rng, chain, 2)
        texts.append(chain)
    texts += [["a"], ["A"], ["a", "b"], ["b", "a"], [], [], fresh(5), ["k", "l"] * 30, ["k", "l"] * 40]
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)] + [(len(texts), None)]


def test_keep_first_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    expected = brute(rows)
    docs = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA).repartition(3)
    for sample in (10 ** 6, 1):  # the order of shingles sets only the cost
        monkeypatch.setattr(jaccard, "SAMPLE", sample)
        kept = jaccard.keep_first(docs, words=5)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == expected


def test_stage_links_by_similarity_and_not_by_bits(spark):
    """A copy over 0.8 goes though it is more than 7 bits away, a text under 0.8 stays."""
    rng = random.Random(1)
    far, close = None, None
    while not (far and close):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(100)]
        over, under = edited(rng, base, 2), edited(rng, base[:60], 4) + base[60:]
        texts = [" ".join(t) for t in (base, over, under)]
        bits = [(fingerprint(texts[0], 5) ^ fingerprint(t, 5)).bit_count() for t in texts]
        if bits[1] > 7:
            far = texts[0], texts[1]
        if len(set(brute([(0, texts[0]), (1, texts[2])]))) == 2 and close is None:
            close = texts[0], texts[2]
    rows = list(enumerate([*far, *close]))
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(*r, "en") for r in rows], SCHEMA), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == brute(rows) and 1 not in brute(rows) and 3 in brute(rows)


def test_odd_rows(spark, odd, none):
    kept = jaccard.keep_first(odd, words=5)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and None in ids and not {1, 2, 3, 6} & set(ids)
    assert jaccard.keep_first(none, words=5).collect() == []


def test_columns_named_like_our_own_stay(spark):
    rows = [(1, "a b c d e f", 10, 5), (2, "a b c d e f", 20, 6), (3, "other words than those", 30, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, row long")
    assert sorted(tuple(r) for r in jaccard.keep_first(docs, words=5).collect()) == [rows[0], rows[2]]


def test_simhash_links_are_a_step_of_near_dedup(spark, monkeypatch):
    """Fingerprints of all distinct texts are linked, and what they link is verified on the whole sets."""
    rng, seen = random.Random(4), []
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
    rows = [(k, " ".join(t)) for k, t in enumerate([base, base[1:], base[::-1], base])]
    linked = jaccard.simhash.links

    def watched(nodes, limit):
        seen.extend(r["fp"] for r in nodes.collect())
        return linked(nodes, limit)

    monkeypatch.setattr(jaccard.simhash, "links", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute(rows) == [0, 2]
    assert set(seen) == {fingerprint(t, 5) for _, t in rows}


def test_a_large_bucket_of_unlike_texts_makes_few_pairs(spark, monkeypatch):
    rng, made = random.Random(5), []
    passage = [f"p{k}" for k in range(120)]
    rows = [(k, " ".join(passage + [f"w{rng.randrange(10 ** 6)}" for _ in range(45)])) for k in range(150)]
    stored = jaccard.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), words=5)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute(rows) == list(range(150))
    assert sum(made) < 300  # of 11175 pairs
