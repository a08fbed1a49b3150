import itertools
import random
import zlib

import numpy as np

from ledgerloom.llm import langid
from tests.llm.fixtures import folder, none, odd  # noqa: F401

LANGS = {"en": "the and of to in is that it was for on with as his they".split(),
         "fr": "le la les des et en un une est que pour dans qui sur pas".split(),
         "ru": "и в не на я быть он с что а по это она этот к".split()}


def texts(rng, n):
    return [(k, " ".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(8, 60))), lang)
            for k, lang in enumerate(rng.choice(sorted(LANGS)) for _ in range(n))]


def test_best_path():
    rng = np.random.default_rng(0)
    held = [-rng.exponential(rng.choice([1, 5, 15]), (rng.integers(1, 6), 3)) for _ in range(200)]

    def cost(scores, path):
        return sum(scores[k, s] for k, s in enumerate(path)) - langid.SWITCH * sum(a != b for a, b in zip(path, path[1:]))

    for scores, path in zip(held, langid.viterbi(held, langid.SWITCH)):
        best = max(cost(scores, p) for p in itertools.product(range(3), repeat=len(scores)))
        assert abs(cost(scores, path.tolist()) - best) < 1e-9


def test_held_out_documents(spark, folder):
    rows = texts(random.Random(1), 300)
    path = folder(documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.op3_language_id(spark, path).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _, _ in rows)
    right = [got[k]["lang_pred"] == lang for k, _, lang in rows if got[k]["held_out"]]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_held_out_documents_are_not_learnt(spark, folder):
    rows = [(k, t, "zz" if zlib.crc32(str(k).encode()) % 3 == 1 else lang) for k, t, lang in texts(random.Random(2), 90)]
    path = folder(documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "zz" not in {r["lang_pred"] for r in langid.op3_language_id(spark, path).collect()}


def test_spans_of_mixed_text(spark):
    model = langid.train(spark.createDataFrame(texts(random.Random(3), 200), "doc_id long, text string, lang string"))
    text = "the and of to in is that it was — " + "le la les des et en un une est, " + "это она быть он"
    assert [lang for _, _, lang in model.spans(text)] == ["en", "fr", "ru"]
    assert [text[a:b].split()[0] for a, b, _ in model.spans(text)] == ["the", "le", "это"]
    assert model.spans(None) == [] and model.spans("12 !") == []


def test_scripts_narrow_candidates(spark):
    model = langid.train(spark.createDataFrame(texts(random.Random(3), 200), "doc_id long, text string, lang string"))
    assert model.predict(["неслыханное"])[0][0] == "ru"


def test_odd_rows(odd, none, spark):
    model = langid.train(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2, 3)} == {"und"}
    assert langid.identify(none, model).collect() == []
    unlearnt = langid.train(none)
    assert {r["lang_pred"] for r in langid.identify(odd, unlearnt).collect()} == {"und"}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.filter("text IS NULL").count() == 0 < kept.count()


def test_the_sample_is_bounded(spark):
    rows = [(k, "word", "en") for k in range(3000)] + [(None, "null number", "en"), (7, "a", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = {r["lang"]: r["count"] for r in langid.labelled_sample(docs, "doc_id", "text", "lang", 50).groupBy("lang").count().collect()}
    assert sizes == {"en": 50, "fr": 1}


def test_constant_paths_are_the_best_ones():
    rng = np.random.default_rng(1)
    held = [-rng.exponential(rng.choice([1, 3, 9]), (rng.integers(1, 40), 3)) * rng.choice([0.2, 1, 1], 3) for _ in range(600)]
    sizes = np.array(list(map(len, held)))
    found = langid.constant(np.concatenate(held), sizes, langid.SWITCH)
    assert 100 < (found >= 0).sum() < 600
    for one, path in zip(found, langid.viterbi(held, langid.SWITCH)):
        assert one < 0 or (path == one).all()


def test_numbers_are_no_letters(spark):
    model = langid.train(spark.createDataFrame(texts(random.Random(3), 50), "doc_id long, text string, lang string"))
    assert model.predict(["½ ²", "12", "x½y", "ⅷ 一"])[:2] == [("und", 0.0), ("und", 0.0)]
    assert [langid._WORD.findall(t) for t in ("½ ²", "x½y", "a1b_c", "一二")] == [[], ["x", "y"], ["a", "b", "c"], ["一二"]]


def test_rare_languages_are_learnt(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}zq word", f"l{k}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.labelled_sample(docs, "doc_id", "text", "lang").select("lang").distinct().count() == 600


def brute(docs, learn_from_all=False):
    """docs: (doc_id, text, lang), few enough that the sample holds all. (doc_id, held_out, lang, score)."""
    import math

    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, _, _ in docs}
    words = {d: langid._WORD.findall((t or "").lower()) for d, t, _ in docs}
    counts, scripts = {}, {}
    for d, t, lang in docs:
        if lang is not None and t is not None and (learn_from_all or not held[d]):
            for w in words[d]:
                for g in langid.grams(w):
                    counts.setdefault(g, {}).setdefault(lang, 0)
                    counts[g][lang] += 1
                scripts.setdefault(langid.script(w), {}).setdefault(lang, 0)
                scripts[langid.script(w)][lang] += 1
    langs = sorted({x for c in counts.values() for x in c})
    total = {(n, x): sum(c.get(x, 0) for g, c in counts.items() if len(g) == n) + langid.SMOOTH * len(counts) for n in (1, 2, 3) for x in langs}
    every = {x: sum(c.get(x, 0) for c in scripts.values()) for x in langs}
    out = []
    for d, _, _ in docs:
        rated = []
        for w in words[d]:
            row = {x: sum(math.log((counts[g].get(x, 0) + langid.SMOOTH) / total[len(g), x]) if g in counts
                          else math.log(langid.SMOOTH / total[3, x]) for g in langid.grams(w)) for x in langs}
            uses = [x for x in langs if scripts.get(langid.script(w), {}).get(x, 0) > 0.001 * every[x]]
            if uses and len(uses) < len(langs):
                least = min(row[x] for x in uses) - langid.ALIEN
                row = {x: row[x] if x in uses else least for x in langs}
            rated.append({x: row[x] - max(row.values()) for x in langs})
        if not rated:
            out.append((d, held[d], "und", 0.0))
            continue
        best, back = dict(rated[0]), []
        for row in rated[1:]:
            top = max(langs, key=lambda x: best[x])
            back.append({x: x if best[x] >= best[top] - langid.SWITCH else top for x in langs})
            best = {x: max(best[x], best[top] - langid.SWITCH) + row[x] for x in langs}
        path = [max(langs, key=lambda x: best[x])]
        for step in reversed(back):
            path.append(step[path[-1]])
        letters = {x: sum(len(w) for w, y in zip(words[d], reversed(path)) if x == y) for x in langs}
        lang = max(langs, key=lambda x: letters[x])
        out.append((d, held[d], lang, round(letters[lang] / sum(letters.values()), 9)))
    return sorted(out)


def test_query_against_brute_force(spark, folder):
    rng = random.Random(8)
    docs = texts(rng, 120)
    docs += [(200 + k, f"{a[1]} {b[1]}", None) for k, (a, b) in enumerate(zip(docs[:40], docs[40:80]))]
    docs += [(300, None, "en"), (301, "½ 12", None), (302, "İstanbul ǅ Ünïcode", None)]
    path = folder(documents=spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3))
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in langid.op3_language_id(spark, path).collect()]
    assert sorted(got) == brute(docs)
