from ledgerloom.llm import units


def test_short_units_and_spaceless_scripts_are_compared(spark):
    docs = [(1, "Read more\nown words of the first text.\nend"), (2, "Read more\nother words of the second text.\nend"),
            (3, "今日は天気がいいです。明日は雨が降るでしょう。"), (4, "明日は雨が降るでしょう。別の文がここにあります。"),
            (5, "today\ntomorrow"), (6, "today\ntomorrow")]
    rows = {r["doc_id"]: r["text"] for r in units.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[k] for k in (1, 3, 5)] == [docs[0][1], docs[2][1], docs[4][1]]
    assert (rows[2], rows[4], rows[6]) == ("other words of the second text.\n", "別の文がここにあります。", "")


def test_a_long_line_without_spaces_stands_once():
    line = "今日は天気がいいですし明日も天気がいいと思いますので散歩に行きます\n"
    assert units.cut(line * 2, set()) == [(len(line), 2 * len(line))]
    assert units.cut("no\nno\n", set()) == []
