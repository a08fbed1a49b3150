from conftest import rows
from pyspark.sql import functions as F

from ledgerloom import schema, session
from ledgerloom.operators import diff, enrich, intents, project, rules, sieve
from ledgerloom.sources import sinks, tables


def test_given_conflicts_when_counted_then_their_keys_are_told(spark, make):
    extra = ["category_audited_at"]
    local = make({"transaction_id": "same"}, {"transaction_id": "l"}, {"transaction_id": "c1", "amount": 1},
                 {"transaction_id": "c2", "amount": 1}, {"transaction_id": None}, extra=extra).drop("seq")
    remote = make({"transaction_id": "same"}, {"transaction_id": "c1", "amount": 2}, {"transaction_id": "c2", "amount": 3},
                  extra=extra).drop("seq")
    counts = diff.reconcile_counts(diff.reconcile(local, remote, metadata=schema.METADATA_COLUMNS))
    assert counts.columns == ["sync_class", "n", "transaction_id"]
    assert rows(counts) == [("conflict", 1, "c1"), ("conflict", 1, "c2"), ("conflict", 2, None), ("in_sync", 1, None),
                            ("local_only", 2, None)]


def test_given_a_session_of_somebody_else_when_prepared_then_its_own_limit_stays(spark):
    other = spark.newSession()
    other.conf.unset("spark.sql.codegen.hugeMethodLimit")
    other.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    session.compiled(other)
    assert other.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    other.conf.set("spark.sql.codegen.hugeMethodLimit", "4000")
    session.compiled(other)
    assert other.conf.get("spark.sql.codegen.hugeMethodLimit") == "4000"


def test_given_a_sieve_when_asked_then_no_key_of_the_table_is_lost(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(300)] + [(None,), ("k1",)], "k string")
    asked = spark.createDataFrame([(f"k{i}",) for i in range(300)] + [(f"other {i}",) for i in range(3000)] + [(None,)], "a string")
    told = [r["a"] for r in asked.filter(sieve.among(keys, "k", F.col("a"))).collect()]
    assert {f"k{i}" for i in range(300)} <= set(told) and None not in told and len(told) < 330
    assert asked.filter(sieve.among(keys.filter("false"), "k", F.col("a"))).count() == 0


def test_given_rows_with_an_id_when_looked_up_then_as_without_and_whole_rows_stay(spark, make, tmp_path):
    df = make({"transaction_id": "e", "merchant_entity_id": "ent_1"}, {"transaction_id": "n", "merchant_entity_id": None,
              "merchant_name": "Acme 12"}, {"transaction_id": "none", "merchant_entity_id": "", "merchant_name": None},
              {"transaction_id": "both", "merchant_entity_id": "ent_2", "merchant_name": "ACME"})
    memory = spark.createDataFrame([("ent:ent_1", "TRAVEL", "TRAVEL_FLIGHTS"), ("name:acme", "INCOME", "INCOME_WAGES"),
                                    ("ent:ent_2", "NO", "SUCH"), ("ent:ent_2", "TRAVEL", "TRAVEL_FLIGHTS")],
                                   "key string, primary string, detailed string")
    want = rows(rules.memory_lookup(df, memory), "transaction_id", "_mem")
    assert rows(rules.memory_lookup(df, memory, "transaction_id"), "transaction_id", "_mem") == want and len(want) == 5
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    try:
        store = sinks.KeyedStore(spark, str(tmp_path / "s"), buckets=4)
        store.write(df)
        plan = rules.memory_lookup(store.read(), memory, "transaction_id")._jdf.queryExecution().executedPlan().toString()
        nodes = plan.split("\n\n")[0].splitlines()
        # below an exchange only ids and keys are read of the store: its one whole scan has none above it
        whole = [k for k, line in enumerate(nodes) if "FileScan" in line and "location" in line.split("Batched")[0]]
        assert len(whole) == 1
        depth = len(nodes[whole[0]]) - len(nodes[whole[0]].lstrip(" :+-*()0123456789"))
        above = []
        for line in reversed(nodes[:whole[0]]):
            at = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if at < depth:
                above.append(line)
                depth = at
        assert above and not any("Exchange" in line for line in above)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_given_ids_that_repeat_when_keyed_then_accounts_and_intents_as_without(spark, make):
    once = make({"transaction_id": "a", "account_id": "A", "merchant_entity_id": "ent_1"},
                {"transaction_id": "b", "account_id": "B", "merchant_entity_id": None, "merchant_name": "Acme 12"},
                {"transaction_id": "c", "account_id": None, "merchant_entity_id": "ent_9", "merchant_name": None})
    twice = once.unionByName(once.filter("transaction_id <> 'c'")).withColumn("owner", F.lit(None).cast("string"))
    accounts = spark.createDataFrame([("A", "p", "t", "n", "i", True), ("B", "q", "t", "n", "i", False), ("A", "p2", "t", "n", "i", None)],
                                     "account_id string, person string, type string, name string, institution string, include boolean")
    want = rows(enrich.account_facets(twice, accounts), "transaction_id", "person", "account_name")
    assert rows(enrich.account_facets(twice, accounts, "transaction_id", once), "transaction_id", "person", "account_name") == want
    assert len(want) == 5

    log = spark.createDataFrame(
        [(1, "m1", "merchant", None, "ent_1", None), (2, "m2", "merchant", None, None, "acme"), (3, "t", "transaction", "c", None, None)],
        "seq long, id string, scope string, match_transaction_id string, match_entity_id string, match_name string")
    for c in tables.INTENT_COLUMNS:
        log = log if c in log.columns else log.withColumn(c, F.lit("TRAVEL" if c == "set_primary" else "TRAVEL_FLIGHTS").cast("string"))
    want = rows(intents.match_intents(twice, log), "transaction_id", "intent.id")
    assert rows(intents.match_intents(twice, log, once), "transaction_id", "intent.id") == want
    assert want == [("a", "m1"), ("a", "m1"), ("b", "m2"), ("b", "m2"), ("c", "t")]


def test_given_rows_with_an_id_when_flattened_with_accounts_then_as_without(spark, make):
    df = make({"transaction_id": "a", "account_id": "A"}, {"transaction_id": "b", "account_id": None}, {"transaction_id": "c", "account_id": "C"})
    meta = spark.createDataFrame([("A", "i", "n", None, "o", "t", "s"), ("", "blank", "n", None, None, "t", "s")],
                                 "account_id string, " + ", ".join(f"{n} string" for n in project.ACCOUNT_META))
    want = project.flatten_with_account(df, meta)
    got = project.flatten_with_account(df, meta, "transaction_id")
    assert got.columns == want.columns and rows(got) == rows(want)
    assert rows(got, "transaction_id", "institution") == [("a", "i"), ("b", "blank"), ("c", "")]
