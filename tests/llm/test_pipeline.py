import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import tokenizers

from ledgerloom.llm import decontam, langid, secrets
from tests.llm.test_decontam import ITEM, distances
from tests.llm.test_langid import LANGS
from tests.llm.test_langid import brute as brute_languages
from tests.llm.fixtures import folder  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark):
    rng = random.Random(6)
    rows = [[k, " ".join(rng.choice(LANGS[lang]) + rng.choice("abcdefghij") for _ in range(120)), lang] for k, lang in
            enumerate(rng.choice(sorted(LANGS)) for _ in range(60))]
    rows[7][1] = rows[3][1]
    rows[9][1] = rows[4][1] + " " + rows[4][1].split()[0]
    rows[11][1] += " " + ITEM.lower()
    rows[13][1] += " token = 'abcdefgh123'"
    rows += [[60, None, None], [61, "", "en"], [62, "12 34 !!", "en"]]
    return spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_take_effect(spark, folder):
    docs = corpus(spark)
    path = folder(documents=docs, benchmark=spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    kept = [set(range(63))]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, path), name)
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
        if name == "secret_scan":
            text = docs.filter("doc_id = 13").first()
            assert "[assign]" in text["text"] and len(text["text"]) == text["n_chars"]
    language, copies, leaks, secret, packed = kept[1:]
    assert language == set(range(60))
    assert copies == language - {7, 9}
    assert leaks == copies - {11}
    assert secret == leaks == packed
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "best_fit_packing"]


def test_run_equals_the_stages(spark, folder):
    path = folder(documents=corpus(spark), benchmark=spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in rows} == set(range(60)) - {7, 9, 11}
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 4096 for x in held.values())


def brute(docs):
    """docs: (doc_id, text, lang). The five stages in plain Python; the digests of the pieces that are packed."""
    ids = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    known = {d: (lang, score) for d, _, lang, score in brute_languages(docs, learn_from_all=True)}
    docs = [(d, t) for d, t, _ in docs if known[d][0] != "und" and known[d][1] >= 0.5]
    sets = {}
    for d, t in docs:
        words = t.encode().lower().split()
        sets[d] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}
    stays = []
    root = {d: d for d, _ in docs}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, _ in docs:
        for b, _ in docs:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    stays = [(d, t) for d, t in docs if top(d) == d]
    item = decontam.normal(ITEM)
    clean = [(d, t) for d, t in stays if min(distances(item, decontam.normal(t))) > int(0.1 * len(item))]
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
    out = []
    for d, t in clean:
        t = assign.sub(lambda m: "[assign]" if len(m.group(2)) >= 6 else m.group(), t)
        whole = [*ids.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(whole), 4096):
            piece = whole[k:k + 4096]
            out.append((d, k // 4096, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    return sorted(out)


def test_run_against_brute_force(spark, folder):
    docs = corpus(spark)
    path = folder(documents=docs, benchmark=spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    rows = corpus_pipeline.run(spark, path).collect()
    want = brute([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()])
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    room = []  # first fit in descending order
    for length in sorted((r["length"] for r in rows), reverse=True):
        k = next((k for k, left in enumerate(room) if left >= length), None)
        if k is None:
            room.append(4096 - length)
        else:
            room[k] -= length
    assert len(held) <= len(room)


def test_empty_tables(spark, folder):
    docs = corpus(spark).limit(0)
    path = folder(documents=docs, benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, path).collect() == []


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_|pipeline", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert langid.SAMPLE > 0 and secrets.BASE[0].kind == "assign"
