import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom import catalog

TABLES = "/root/testdata/sf0.001"
SAMPLE = ["ingest_counts", "rollup", "tie_out", "recurring_next", "trailing_avg", "rule_cascade",
          "reconcile", "match_intents", "sync_counts", "transfer_netting", "audit_run", "overfetch_log"]


def text(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_given_tables_when_queried_then_equal_to_the_sql_twin(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, TABLES)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(text(v) for v in r) for r in cur.fetchall())
    got = sorted(tuple(text(r[c]) for c in names) for r in df.collect())
    assert got == want and got


def test_given_the_catalog_when_listed_then_every_query_has_a_twin():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) <= set(entry.queries())


def test_given_a_changed_input_when_asked_again_then_the_store_is_built_anew(spark, tmp_path):
    from ledgerloom.catalog import build

    def ids():
        return sorted(r[0] for r in build.kept(spark, str(tmp_path), "ids", lambda: spark.read.parquet(str(tmp_path / "a.parquet"))).collect())

    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    assert ids() == ids() == [0, 1, 2]
    spark.range(2).write.mode("append").parquet(str(tmp_path / "a.parquet"))
    assert ids() == [0, 0, 1, 1, 2]
