from ledgerloom.llm import units
from tests.llm.fixtures import folder, none, odd  # noqa: F401


def brute(docs):
    """docs: (doc_id, text), rows of one doc_id in the order in which they are stored. What is removed of each row."""
    first, places = {}, [((doc is not None, doc or 0), k) for k, (doc, _) in enumerate(docs)]
    for place, (_, text) in zip(places, docs):
        for _, _, d in units.stretches(text or ""):
            first[d] = min(first.get(d, place), place)
    return [(doc, units.cut(text or "", {d for _, _, d in units.stretches(text or "") if first[d] < place}))
            for place, (doc, text) in zip(places, docs)]


PASSAGE = "It was a passage of several plain words here. And then it went on for some more. The end of it came at last."


def test_the_first_occurrence_stays(spark):
    docs = [(3, f"own words of the third text.\n{PASSAGE}\nmore words that only this has."), (1, PASSAGE),
            (2, f"pasted into a line of its own words {PASSAGE} and on it goes in here."), (4, "short one.\nshort one.")]
    rows = {r["doc_id"]: r for r in units.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1]["removed"] == [] and rows[1]["text"] == PASSAGE
    assert PASSAGE not in rows[3]["text"] and rows[3]["text"].startswith("own words of the third")
    assert "And then it went on" not in rows[2]["text"] and rows[2]["text"].startswith("pasted into")
    assert rows[4]["removed"] == []  # too short to say anything
    for doc, removed in brute(docs):
        assert [tuple(x) for x in rows[doc]["removed"]] == removed


def test_offsets_are_the_original_ones(spark):
    text = f"alpha beta gamma delta epsilon.\n{PASSAGE}\nomega psi chi phi upsilon."
    docs = [(1, PASSAGE), (2, text)]
    row = units.dedup(spark.createDataFrame(docs, "doc_id long, text string")).filter("doc_id = 2").first()
    assert row["text"] == "".join(text[a:b] for a, b in row["kept"])
    assert sum(b - a for a, b in [*row["kept"], *row["removed"]]) == len(text)


def test_repeats_within_a_text():
    line = "five words are enough here.\n"
    assert units.cut(line * 3, set()) == [(len(line), 3 * len(line))]


def test_normalised_alike(spark):
    docs = [(1, "Some words that  are WRITTEN twice."), (2, "some words that are written\ttwice.")]
    rows = units.dedup(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == [docs[0][1], ""]


def test_odd_rows(odd, none):
    rows = units.dedup(odd).collect()
    assert len(rows) == odd.count()
    twins = [r for r in rows if r["doc_id"] == 5]
    assert sorted(len(r["removed"]) for r in twins) == [0, 1]  # of repeated rows one keeps its text
    assert [r["text"] for r in rows if r["doc_id"] == 6] == [""]
    assert [r["text"] for r in rows if r["doc_id"] == 0] == [None]
    assert units.dedup(none).collect() == []


def test_query_against_brute_force(spark, odd, folder):
    path = folder(documents=odd)
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted(((d, ",".join(f"{a}:{b}" for a, b in x)) for d, x in brute(docs)), key=str)
    got = units.op2_unit_dedup(spark, path)
    assert sorted(((r["doc_id"], r["removed"]) for r in got.collect()), key=str) == want


def test_rows_without_or_with_the_same_id_are_compared(spark):
    line = "one long line of words that stands in several rows of the table.\n"
    docs = [(None, line + "own words here."), (None, line + "other words there."), (3, line), (3, line + "more of it.")]
    rows = units.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    kept = [r["text"] for r in rows if line in r["text"]]
    assert len(kept) == 1 and len(rows) == 4
    assert {r["text"].replace(line, "") for r in rows} == {"own words here.", "other words there.", "", "more of it."}
