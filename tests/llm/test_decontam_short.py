from ledgerloom.llm import decontam


def test_short_items_and_spaceless_scripts_are_sought(spark):
    spaceless = "今日は天気がいいので友達と一緒に公園へ散歩に行き美味しい弁当を食べました"
    items = spark.createDataFrame([(1, "Cat sat"), (2, spaceless), (3, "..."), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the cat, sat there"), (2, "a bobcat sat there"), (3, "cat sats"), (4, f"昨日と{spaceless[:9]}X{spaceless[10:]}また"),
                                  (5, "cat sat"), (6, "")], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.contaminated(docs, items).collect()}
    assert found == {(1, 1, 0), (5, 1, 0), (4, 2, 1)}
    assert {r["doc_id"] for r in decontam.decontaminate(docs, items).collect()} == {2, 3, 6}
