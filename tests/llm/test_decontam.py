import random

from ledgerloom.llm import decontam
from tests.llm.fixtures import folder, none, odd  # noqa: F401

ITEM = "What is the name of the river that flows through the old town, and in which year was its bridge built?"


def distances(pattern, text):
    """Least edits of the pattern against any stretch that ends at each place."""
    before = [0] * (len(text) + 1)
    for k, c in enumerate(pattern, 1):
        row = [k]
        for j, x in enumerate(text, 1):
            row.append(min(before[j - 1] + (c != x), before[j] + 1, row[j - 1] + 1))
        before = row
    return before


def whole(a, b):
    before = list(range(len(b) + 1))
    for k, c in enumerate(a, 1):
        row = [k]
        for j, x in enumerate(b, 1):
            row.append(min(before[j - 1] + (c != x), before[j] + 1, row[j - 1] + 1))
        before = row
    return before[-1]


def edits(rng, text, n):
    out = list(text)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(out))
        if kind == 0:
            out[at] = rng.choice("abcd")
        elif kind == 1:
            out.insert(at, rng.choice("abd"))
        else:
            out.pop(at)
    return "".join(out)


def test_matches_equal_dynamic_programming():
    rng = random.Random(4)
    for _ in range(300):
        item = decontam.normal("".join(rng.choice("ab c") for _ in range(rng.randint(20, 60))))
        around = ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 50))) for _ in range(2)]
        text = decontam.normal(around[0] + edits(rng, item, rng.randint(0, 8)) + around[1])
        matcher, best = decontam.Matcher([(1, item)], least=1), min(distances(item, text))
        found = matcher.matches(text)
        assert bool(found) == (best <= int(0.1 * len(item))) == matcher.touches(text)
        if found:
            assert min(d for *_, d in found) == best
        for _, start, end, distance in found:
            assert whole(item, text[start:end]) == distance


def test_places_point_into_the_original():
    text = f"Äxİ — “{ITEM.upper().replace(' ', '  ')}” end"
    ((item, start, end, distance),) = decontam.Matcher([(7, ITEM)]).find(text)
    assert (item, distance) == (7, 0) and decontam.normal(text[start:end]) == decontam.normal(ITEM)


def test_every_occurrence_is_found():
    found = decontam.Matcher([(1, ITEM)]).find(f"{ITEM} and again: {ITEM}")
    assert [d for *_, d in found] == [0, 0] and found[0][2] <= found[1][1]


def test_edited_copies_and_clean_texts(spark):
    rng = random.Random(1)
    docs = [(1, f"words {ITEM} words"), (2, f"x {edits(rng, ITEM.lower(), 6)} y"), (3, "What is the name of the river? Which year?"),
            (4, ITEM[:60]), (5, None), (6, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(9, ITEM), (10, "too short"), (11, None), (12, ""), (None, ITEM)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, items).collect()} == {(1, 9), (2, 9), (1, None), (2, None)}
    assert sorted(r["doc_id"] for r in decontam.decontaminate(df, items).collect()) == [3, 4, 5, 6]


def test_blocks_change_nothing(spark):
    rng = random.Random(2)
    items = [(k, " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(12))) for k in range(30)]
    docs = [(k, f"{items[k][1]} and {edits(rng, items[k + 1][1], 4)}") for k in range(20)]
    df, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = [sorted(map(tuple, decontam.contaminated(df, held, block=size).collect())) for size in (10**6, 500)]
    assert rows[0] == rows[1] and {(k, k) for k in range(20)} <= {r[:2] for r in rows[0]}
    assert decontam.decontaminate(df, held, block=500).count() == 0


def test_odd_rows(odd, none, spark):
    items = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    nothing = items.limit(0)
    assert decontam.contaminated(odd, items).collect() == [] == decontam.contaminated(none, items).collect()
    for held in (items, nothing):
        kept = decontam.decontaminate(odd, held)
        assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontam.contaminated(odd, nothing).collect() == []


def test_query(spark, odd, folder):
    more = spark.createDataFrame([(50, "a " + ITEM)], "doc_id long, text string")
    path = folder(documents=odd.select("doc_id", "text").union(more), benchmark=spark.createDataFrame([(3, ITEM)], "item_id long, text string"))
    assert [tuple(r) for r in decontam.op6_pigeonhole_decontamination(spark, path).collect()] == [(50, 3, 2, 1 + len(ITEM), 0)]


def test_repetitive_texts_take_time_in_proportion():
    import time

    matcher = decontam.Matcher([(1, "ab " * 20)])
    matcher.find("ab " * 500)
    took = []
    for n in (4000, 32000):
        begun = time.process_time()
        found = matcher.find("ab " * n)
        took.append(time.process_time() - begun)
        assert len(found) == n // 20
    assert took[1] < 16 * max(took[0], 0.05)


def test_matches_kept_are_those_of_the_plain_way():
    rng = random.Random(4)
    item = decontam.normal("abc abd abc abd abc abd abc abd abc abd")
    matcher = decontam.Matcher([(1, item)], 0.2, 0)
    for _ in range(40):
        text = decontam.normal("".join(rng.choice(("abc ", "abd ", "x ")) for _ in range(60)))
        it, kept = matcher.items[0], []
        ends = sorted((d, e) for e, d in enumerate(distances(it.text, text)) if d <= it.budget and e)
        for distance, end in ends:
            start = it.start(text, end, distance)
            if not any(start < b and end > a for a, b, _ in kept):
                kept.append((start, end, distance))
        assert [m[1:] for m in matcher.matches(text)] == sorted(kept)
