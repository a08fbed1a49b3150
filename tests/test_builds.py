from datetime import date, datetime
from decimal import Decimal

from ledgerloom.catalog import build
from ledgerloom.operators import diff, enrich, ingest
from ledgerloom.plans import lineage, netting
from ledgerloom.sources import sinks, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def feed(make):
    return make({"transaction_id": "1-1", "pending": True}, {"transaction_id": "1-2", "pending_transaction_id": "1-1"},
                {"transaction_id": "2-1", "pending": True, "name": "OLD"}, {"transaction_id": "2-1", "pending": True},
                {"transaction_id": None}, {"transaction_id": "3-1"})


def test_given_a_narrow_query_when_built_then_nothing_is_stored_and_other_columns_stay_behind(make, monkeypatch):
    monkeypatch.setattr(tables, "feed", lambda spark, sf: feed(make))
    monkeypatch.setattr(lineage, "stored", lambda df, name: 1 / 0)
    df = build.settled(None, "nowhere").select("transaction_id", "amount")
    assert sorted(r[0] for r in df.collect()) == ["1-2", "2-1", "3-1"]
    above = [line for line in plan(df).splitlines() if "Scan " not in line]
    assert any("Window" in line for line in above) and not any("original_description" in line for line in above)


def test_given_a_store_of_settled_rows_when_its_sides_meet_then_no_row_moves(spark, make, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(tables, "feed", lambda s, sf: feed(make))
        kept = build.settled_store(spark, str(tmp_path))
        assert sorted(r[0] for r in kept.collect()) == ["1-2", "2-1", "3-1"]
        assert "Exchange" not in plan(diff.reconcile(tables.local_store(kept), tables.remote_store(kept)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_given_dealt_rows_when_a_keyed_store_is_written_then_they_are_not_dealt_again(spark, make, tmp_path):
    store = sinks.KeyedStore(spark, str(tmp_path / "s"), buckets=3)
    rows = ingest.dedupe_last(feed(make).repartition(3, "transaction_id"))
    store.write(rows, dealt=True)
    files = [f.name for f in (tmp_path / "s" / "version=1").glob("*.parquet")]
    assert len(files) <= 3 and store.read().count() == 4


def test_given_cells_when_they_look_for_partners_then_none_goes_through_the_driver(spark):
    ddl = "person string, abs_amount decimal(18,2), day date, account_id string, n long, used long"
    out, back = (spark.createDataFrame([("p", Decimal(5), date(2024, 1, k), a, 1, 0)], ddl) for k, a in ((1, "a"), (2, "b")))
    offers = netting._best(out, back, 5)
    assert "Broadcast" not in plan(offers) and [r["account2"] for r in offers.collect()] == ["b"]


def test_given_a_feed_when_settled_then_records_are_made_after_rows_are_dealt_and_sorted(spark, monkeypatch):
    ddl = {"lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                       "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
           "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
           "part": "p_partkey long, p_name string, p_size int", "customer": "c_custkey long, c_nationkey int",
           "nation": "n_nationkey int, n_name string, n_regionkey int", "region": "r_regionkey int, r_name string"}
    day = datetime(2024, 1, 2)
    held = {"lineitem": [(1, 5, 7, 1, 1.0, price, 0.0, 0.0, "N", "F", day) for price in (10.0, 12.5)],
            "orders": [(1, 3, "F", day, "1-URGENT")], "part": [(5, "tea", 1)], "customer": [(3, 0)],
            "nation": [(0, "PERU", 1)], "region": [(1, "AMERICA")]}
    monkeypatch.setattr(tables, "read", lambda s, sf, name: spark.createDataFrame(held[name], ddl[name]))
    df = build.settled(spark, "nowhere")
    rows = {r["transaction_id"]: r for r in df.collect()}
    line, bill = rows["1-1"], rows["bill-3-11"]
    assert len(rows) == 13 and line["amount"] == Decimal("12.50") and line["original_description"] == "COT*FLT TEA #1 CARD XXXX5"
    assert line["location"]["country"] == "US" and line["counterparties"][0]["entity_id"] == "ent_7"
    assert line["personal_finance_category"]["version"] == "v2" and line["seq"]["l_extendedprice"] == 12.5
    assert bill["name"] == "BILL d" and bill["personal_finance_category"]["confidence_level"] == "VERY_HIGH"
    assert bill["amount"] == Decimal("25.00") and bill["counterparties"] is None
    text = plan(df.select("transaction_id", "original_description"))
    assert "CARD XXXX" in text and "CARD XXXX" not in text[text.index("Window"):]


def test_given_rows_with_a_key_when_enriched_then_the_same_rows_and_only_keys_meet_accounts_and_merchants(spark, make):
    days = ["2024-01-01", "2024-01-31", "2024-03-01", "2024-03-31"]
    rows = make(*[{"transaction_id": f"{m}{k}{a}", "authorized_date": day, "merchant_entity_id": m or None, "merchant_name": m or None, "parties": None,
                   "account_id": a, "amount": 9 + (k if m == "x" else 0) * 50}
                  for m in ("s", "x", "") for a in ("a", "off") for k, day in enumerate(days) if (m, a) != ("", "off")])
    rows = ingest.canonicalize(ingest.dedupe_last(rows))
    accounts = spark.createDataFrame([("a", "p", "credit", "n", "i", True), ("a", "q", "credit", "n", "i", True),
                                      ("off", "p", "credit", "n", "i", False)],
                                     "account_id string, person string, type string, name string, institution string, include boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = enrich.enrich(rows, accounts)  # an account that comes twice doubles its rows
        keyed = enrich.enrich(rows, accounts, key="transaction_id", with_recurrence=False)
        found = enrich.recurrence(keyed, "transaction_id").select(*plain.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
        moved = [line for line in plan(enrich.account_facets(rows, accounts, "transaction_id")).splitlines() if "hashpartitioning(account_id" in line]
        assert moved and "recurring" in {r["recurrence"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_given_keys_that_repeat_beside_the_lines_when_a_feed_is_deduplicated_then_no_line_is_multiplied(spark, monkeypatch):
    ddl = {"lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                       "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
           "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
           "part": "p_partkey long, p_name string, p_size int", "customer": "c_custkey long, c_nationkey int",
           "nation": "n_nationkey int, n_name string, n_regionkey int", "region": "r_regionkey int, r_name string"}
    day = datetime(2024, 1, 2)
    lines = [(1, 5, 7, k, 1.0, price, 0.0, 0.0, "N", "F", day) for k in (1, 2) for price in (10.0, 12.5)]
    # of a repeated key the rows that find no partner do not count: (3, 9) has no nation, (0, 'GONE', 4) no region
    held = {"lineitem": [*lines, (1, 6, 7, 3, 1.0, 1.0, 0.0, 0.0, "N", "F", day), (None, 5, 7, 4, 1.0, 1.0, 0.0, 0.0, "N", "F", day)],
            "orders": [(1, 3, "F", day, "1-URGENT")] * 20 + [(1, 8, "P", day, "5-LOW"), (None, 3, "F", day, None)],
            "part": [(5, "tea", 1)] * 20, "customer": [(3, 0)] * 20 + [(3, 9)], "nation": [(0, "PERU", 1)] * 20 + [(0, "ZZ", 4)],
            "region": [(1, "AMERICA")] * 20}
    monkeypatch.setattr(tables, "read", lambda s, sf, name: spark.createDataFrame(held[name], ddl[name]))
    feed = tables.feed(spark, "nowhere").filter("NOT is_bill")
    assert feed.count() == len(lines)
    held |= {"orders": held["orders"][19:], "customer": held["customer"][19:], "nation": held["nation"][19:],
             "part": held["part"][:1], "region": held["region"][:1]}
    raw = tables.raw_feed(spark, "nowhere").filter("NOT is_bill")
    both = [ingest.dedupe_last(x).select(*raw.columns).collect() for x in (feed, raw)]
    assert raw.count() == len(lines) and sorted(map(str, both[0])) == sorted(map(str, both[1])) and len(both[0]) == 2
    line, = build.settled(spark, "nowhere").filter("transaction_id = '1-2'").collect()
    assert line["amount"] == Decimal("12.50") and line["location"]["country"] == "US"
