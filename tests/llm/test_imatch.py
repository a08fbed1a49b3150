import hashlib
from collections import Counter

import numpy as np

from ledgerloom.llm import imatch
from tests.llm.fixtures import folder, none, odd  # noqa: F401


def brute(docs):
    """docs: (doc_id, text) in order."""
    texts = [t or "" for _, t in docs]
    df = Counter(x for t in texts for x in imatch.terms(t))
    low, high = max(2, imatch.SHARE * sum(df.values())), max(2, imatch.COMMON * len(texts))
    make = imatch.Fingerprinter(np.array(sorted(t for t, n in df.items() if low <= n <= high), np.uint64))
    own = [make.of(t) for t in texts]
    out = []
    for k, (doc, _) in enumerate(docs):
        after = (k + 1) % len(docs)
        new = imatch.edited(texts[k], texts[after])
        out.append((doc, len(texts[k]), hashlib.sha256(new.encode()).hexdigest(), own[k], make.of(new),
                    round(imatch.likeness(own[k], make.of(new)), 9), round(imatch.likeness(own[k], own[after]), 9)))
    return out


def test_query_against_brute_force(spark, odd, folder):
    words = [f"w{k % 37}x{k % 11}" for k in range(400)]
    more = [(100 + k, " ".join(words[k:k + 20 + k % 50])) for k in range(300)]
    rows = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    path = folder(documents=rows.repartition(5))
    docs = sorted(((r["doc_id"], r["text"]) for r in rows.collect()), key=lambda x: (imatch.FIRST if x[0] is None else x[0], x[1] or ""))
    got = [(*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in imatch.op7_imatch_fingerprints(spark, path).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)


def test_one_document_follows_itself(spark, folder):
    path = folder(documents=spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string"))
    (row,) = imatch.op7_imatch_fingerprints(spark, path).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdabcd").hexdigest() and row["near_next"] == 1


def test_edited_text():
    assert imatch.edited("abcdefg", "XY") == "abcdXY" and imatch.edited("a", "XY") == "a" and imatch.edited("", "XY") == ""


def test_likeness_follows_the_change(spark):
    rows = [(k, " ".join(f"t{(k * 30 + j) % 3000}" for j in range(200))) for k in range(100)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1].replace("t200 ", "changed ")), (1002, rows[5][1][:len(rows[5][1]) // 2])]
    got = dict(imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().itertuples(index=False, name=None))
    like = [imatch.likeness(got[5], got[k]) for k in (1000, 1001, 1002, 60)]  # equal, one word, half, other
    assert like[0] == 1 and like[0] > like[1] > like[2] > like[3]


def test_odd_rows(odd, none):
    rows = imatch.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    empties = {r["fingerprint"] for r in rows if r["doc_id"] in (0, 1)}
    assert len(empties) == 1 and all(len(r["fingerprint"]) == imatch.DIGITS * len(imatch.KEEP) for r in rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert imatch.fingerprints(none).collect() == []


def test_empty_table(spark, none, folder):
    assert imatch.op7_imatch_fingerprints(spark, folder(documents=none)).collect() == []


def test_texts_without_lexicon_terms_differ_in_every_subset(spark):
    docs = spark.createDataFrame([(k, f"alone{k}") for k in range(2000)] + [(2000, "alone7")], "doc_id long, text string")
    got = dict(imatch.fingerprints(docs).toPandas().itertuples(index=False, name=None))
    assert len(set(got.values())) == 2000 and got[7] == got[2000]
    assert max(imatch.likeness(got[0], got[k]) for k in range(1, 2000)) < 0.1
    parts = [got[3][k:k + imatch.DIGITS] for k in range(0, len(got[3]), imatch.DIGITS)]
    assert len(set(parts)) > 60


def test_subset_hashes_against_the_plain_way():
    rng = np.random.default_rng(2)
    band = np.unique(rng.integers(1, 1 << 63, 300, np.uint64))
    words = [f"w{k}" for k in range(40)]
    own = np.unique(np.array([imatch._TERMS[w] for w in words[:25]], np.uint64))
    make = imatch.Fingerprinter(np.unique(np.concatenate([band, own])))
    held = np.array(sorted(set(own.tolist())), np.uint64)
    kept = np.unpackbits(imatch.subsets(held), axis=1).T.astype(bool)
    import xxhash

    want = "".join(xxhash.xxh64_hexdigest(held[row].tobytes())[:imatch.DIGITS] if row.any() else imatch.EMPTY for row in kept)
    assert make.of(" ".join(words)) == want
