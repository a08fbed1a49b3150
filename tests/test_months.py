import time
from datetime import datetime
from decimal import Decimal

from conftest import rows

from ledgerloom.operators import ingest
from ledgerloom.plans import lineage
from ledgerloom.sources import tables
from ledgerloom.sources.sinks import KeyedStore, MonthStore, SnapshotStore

DDL = {"lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                   "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
       "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
       "part": "p_partkey long, p_name string, p_size int", "customer": "c_custkey long, c_nationkey int",
       "nation": "n_nationkey int, n_name string, n_regionkey int", "region": "r_regionkey int, r_name string"}


def packed(spark, monkeypatch):
    day = datetime(2024, 1, 2)
    held = {"lineitem": [(k, 5, 7, 1, 1.0, 10.0 + k, 0.0, 0.0, "N", "F", None if k == 4 else datetime(2024, k, 3)) for k in range(1, 8)],
            "orders": [(k, 3, "F", day, "1-URGENT") for k in range(1, 8)], "part": [(5, "tea", 1)], "customer": [(3, 0)],
            "nation": [(0, "PERU", 1)], "region": [(1, "AMERICA")]}
    monkeypatch.setattr(tables, "read", lambda s, sf, name: spark.createDataFrame(held[name], DDL[name]))
    return ingest.dedupe_last(tables.feed(spark, "nowhere"))


def test_given_packed_rows_when_written_by_month_then_records_are_made_after_they_are_dealt(spark, tmp_path, monkeypatch):
    feed = packed(spark, monkeypatch)
    plain, late = (MonthStore(spark, str(tmp_path / name)) for name in ("plain", "late"))
    plain.write(tables.local_store(tables.records(feed)).drop("seq"))
    seen = []

    def made(dealt):
        seen.append(dealt.columns)
        return tables.local_store(tables.records(dealt, late.MONTH)).drop("seq")

    late.write(tables.dated(feed), made)
    assert seen and "date" in seen[0] and not {"name", "original_description", "location"} & set(seen[0])
    assert set(late.months()) == set(plain.months()) and "none" in late.months()
    assert late.read().columns == plain.read().columns
    assert rows(late.read()) == rows(plain.read())
    assert tables.dated(tables.records(feed)).columns == tables.records(feed).columns


def test_given_what_stores_write_when_done_then_no_shuffle_files_are_left(spark, make, tmp_path):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    df = make({"transaction_id": "a", "date": "2026-01-05"}, {"transaction_id": "b", "date": "2026-02-05"})
    before = files()
    lineage.stored(df.repartition(3, "transaction_id"), "rows")
    KeyedStore(spark, str(tmp_path / "k"), buckets=2).write(df)
    MonthStore(spark, str(tmp_path / "m")).write(df)
    SnapshotStore(spark, str(tmp_path / "s")).write(df)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before


def test_given_rows_that_a_query_reads_several_times_when_asked_then_they_are_made_once(spark, monkeypatch):
    from ledgerloom.catalog import categorize, enrichment

    made = "transaction_id string, date_resolved string, merchant string, atom string, abs_amount decimal(18,2), flow string, tier1 string, " \
           "category_update_step string, category_update_reason string, review_pending boolean, category_path array<string>, spend decimal(18,2)"
    held = [(f"t{k}", "2024-01-02", "Tea", "TRAVEL_FLIGHTS", k, "spend", "Travel", "mechanical", "", False, ["a", f"b{k % 2}"], k) for k in range(6)]
    cube = spark.createDataFrame([(*r[:4], Decimal(r[4]), *r[5:11], Decimal(r[11])) for r in held], made)
    monkeypatch.setattr(enrichment.build, "cube", lambda s, sf: cube)
    monkeypatch.setattr(categorize, "ccube", lambda s, sf: cube)
    detail, buckets = categorize.txn_detail(spark, "nowhere"), enrichment.frontier_assign(spark, "nowhere")
    assert [(r["transaction_id"], r["abs_amount"]) for r in detail.collect()] == [(f"t{k}", float(k)) for k in range(5, -1, -1)]
    assert rows(buckets) == [("a/b0", 6.0, 3), ("a/b1", 9.0, 3)]
    for df in (detail, buckets):
        assert "ExistingRDD[transaction_id" not in df._jdf.queryExecution().executedPlan().toString()
