"""Two stores, change feeds and human intents."""

from pyspark.sql import functions as F

from ledgerloom import dims, schema
from ledgerloom.catalog import build
from ledgerloom.catalog.base import cte, d, entity_sql, merchant_sql, n, norm_sql, query, slot_sql
from ledgerloom.catalog.categorize import RUN, audited, rule_table
from ledgerloom.operators import diff, intents
from ledgerloom.plans import audit, lineage
from ledgerloom.sources import sinks, tables

TODAY = "2001-11-05"
KEY = "coalesce(try_cast(split_part(transaction_id, '-', 1) AS BIGINT), 1)"


def _copy(name, divisor, shift, amount, owner):
    cte(name, ["settled"], f"""
SELECT * EXCLUDE (amount, txn_owner), k, {amount} AS amount, {owner} AS txn_owner,
  CASE WHEN k % 5 <> 0 THEN '2001-01-0' || ((k * {shift + 1}) % 9 + 1) || 'T00:00:00' ELSE '' END
    AS category_audited_at
FROM (SELECT *, {KEY} AS k FROM settled) WHERE k % {divisor} <> 0""")


_copy("local_", 7, 0, "amount", "txn_owner")
_copy("remote_", 11, 3, "CASE WHEN k % 13 = 0 THEN amount + 1 ELSE amount END", "NULL")
cte("report", ["local_", "remote_"], """
SELECT coalesce(l.transaction_id, r.transaction_id) AS transaction_id,
  CASE WHEN r.transaction_id IS NULL THEN 'local_only' WHEN l.transaction_id IS NULL THEN 'remote_only'
    WHEN l.amount = r.amount THEN 'in_sync' ELSE 'conflict' END AS sync_class,
  l.amount AS la, r.amount AS ra, l.category_audited_at AS ls, r.category_audited_at AS rs,
  l.txn_owner AS lo FROM local_ l FULL JOIN remote_ r ON l.transaction_id = r.transaction_id""")


def sides(spark, sf):
    s = build.settled_store(spark, sf)
    return tables.local_store(s), tables.remote_store(s)


def report(spark, sf):
    return diff.reconcile(*sides(spark, sf), metadata=schema.METADATA_COLUMNS)


def adopted(spark, sf):
    return diff.adopt_head(*sides(spark, sf))


def shown(df):
    return df.select("transaction_id", "sync_class",
                     F.col("merged.amount").cast("double").alias("amount"),
                     F.col("merged.category_audited_at").alias("stamp"),
                     F.col("merged.txn_owner").alias("txn_owner"))


LOCAL = "sync_class IN ('in_sync', 'local_only')"


@query("reconcile", ["report"], f"""
SELECT transaction_id, sync_class, {d(f"CASE WHEN {LOCAL} THEN la ELSE ra END")} AS amount,
  CASE WHEN {LOCAL} THEN ls ELSE rs END AS stamp, CASE WHEN {LOCAL} THEN lo END AS txn_owner FROM report""")
def reconcile(spark, sf):
    return shown(report(spark, sf))


NEWER = f"({LOCAL} OR (sync_class = 'conflict' AND ls > rs))"


@query("newest_audit_wins", ["report"], f"""
SELECT transaction_id, CASE WHEN ls > rs THEN 'local' ELSE 'remote' END AS kept, ls, rs FROM report
WHERE sync_class = 'conflict'""")
def newest_audit_wins(spark, sf):
    log = diff.conflict_log(adopted(spark, sf), "t")
    return log.select("transaction_id", "kept", F.col("local.category_audited_at").alias("ls"),
                      F.col("remote.category_audited_at").alias("rs"))


@query("adopt_head", ["report"], f"""
SELECT transaction_id, sync_class, {d(f"CASE WHEN {NEWER} THEN la ELSE ra END")} AS amount,
  CASE WHEN {NEWER} THEN ls ELSE rs END AS stamp, CASE WHEN {NEWER} THEN lo END AS txn_owner FROM report""")
def adopt_head(spark, sf):
    return shown(adopted(spark, sf))


@query("reconcile_counts", ["report"], f"""
SELECT sync_class, {n()} AS n, NULL::VARCHAR AS transaction_id FROM report GROUP BY 1
UNION ALL SELECT sync_class, {n()}, transaction_id FROM report WHERE sync_class = 'conflict' GROUP BY 1, 3""")
def reconcile_counts(spark, sf):
    return diff.reconcile_counts(report(spark, sf))


@query("reconcile_conflicts", ["report"], """
SELECT transaction_id, 'amount' AS fields FROM report WHERE sync_class = 'conflict'""")
def reconcile_conflicts(spark, sf):
    return diff.conflict_keys(report(spark, sf))


@query("reconcile_log", ["report"], f"""
SELECT 't' AS ts, 'reconcile' AS event, count(*) FILTER (sync_class = 'in_sync') AS in_sync,
  count(*) FILTER (sync_class = 'local_only') AS local_only, count(*) FILTER (sync_class = 'remote_only') AS remote_only,
  count(*) FILTER (sync_class = 'conflict') AS conflict FROM report""")
def reconcile_log(spark, sf):
    return diff.reconcile_log(report(spark, sf), "t")


@query("sorted_id_sample", ["report"], """
SELECT sync_class, transaction_id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY sync_class ORDER BY transaction_id) AS rn FROM report) WHERE rn <= 20""")
def sorted_id_sample(spark, sf):
    return diff.sorted_id_sample(report(spark, sf))


@query("unresolved_gate", ["report"], f"""
SELECT transaction_id FROM report WHERE sync_class = 'conflict' AND {KEY} % 3 = 0""")
def unresolved_gate(spark, sf):
    golden = build.settled(spark, sf).filter(tables._order_key() % 3 != 0)
    return diff.unresolved_conflicts(report(spark, sf), golden)


MERGED = """SELECT transaction_id, amount, pending, pending_transaction_id, 'fresh' AS side FROM remote_
UNION ALL SELECT transaction_id, amount, pending, pending_transaction_id, 'base' FROM local_
WHERE transaction_id NOT IN (SELECT transaction_id FROM remote_)"""
cte("preferred", ["local_", "remote_"], MERGED)


@query("union_prefer", ["preferred"], f"""
SELECT transaction_id, {d('amount')} AS amount FROM preferred""")
def union_prefer(spark, sf):
    return diff.union_prefer(*sides(spark, sf)).select(
        "transaction_id", F.col("amount").cast("double").alias("amount"))


@query("merge_golden", ["preferred"], f"""
SELECT transaction_id, {d('amount')} AS amount FROM preferred WHERE NOT (pending AND transaction_id IN (
  SELECT pending_transaction_id FROM preferred WHERE NOT pending AND pending_transaction_id IS NOT NULL))""")
def merge_golden(spark, sf):
    return diff.merge_golden(*sides(spark, sf)).select(
        "transaction_id", F.col("amount").cast("double").alias("amount"))


@query("keys_removed", ["report"], "SELECT transaction_id FROM report WHERE sync_class = 'local_only'")
def keys_removed(spark, sf):
    return diff.keys_removed(*sides(spark, sf))


def hashed(store):
    """A store whose rows have their content hash, but for every tenth order's."""
    return store.withColumn(schema.HASH_COLUMN, F.when(tables._order_key() % 10 != 0, diff.source_hash(store)))


def delta(spark, sf):
    prior, source = sides(spark, sf)
    return diff.incremental_classify(source, hashed(prior))


DELTA = f"""CASE sync_class WHEN 'local_only' THEN 'removed' WHEN 'remote_only' THEN 'new'
  WHEN 'in_sync' THEN 'carryover' ELSE CASE WHEN {KEY} % 10 = 0 THEN 'carryover' ELSE 'changed' END END"""


@query("incremental_classify", ["report"],
       f"SELECT transaction_id, {DELTA} AS delta_class FROM report")
def incremental_classify(spark, sf):
    return delta(spark, sf).select("transaction_id", "delta_class")


@query("prune_gate", ["report", "local_"], """
SELECT transaction_id FROM report WHERE sync_class = 'local_only'
  AND transaction_id NOT IN (SELECT transaction_id FROM local_ WHERE pending)""")
def prune_gate(spark, sf):
    return diff.bad_prunes(delta(spark, sf), sides(spark, sf)[0])


@query("audit_run", ["audited"], f"""
SELECT transaction_id, CASE WHEN done THEN pfc_primary ELSE before_primary END AS pfc_primary,
  CASE WHEN done THEN pfc_detailed ELSE before_detailed END AS pfc_detailed,
  CASE WHEN done THEN category_update_step ELSE '' END AS category_update_step,
  CASE WHEN done THEN category_review_flag ELSE '' END AS category_review_flag,
  CASE WHEN done THEN '{RUN}' WHEN k % 5 <> 0 THEN '2001-01-0' || (k % 9 + 1) || 'T00:00:00' ELSE '' END
    AS category_audited_at, {d("CASE WHEN done AND k % 13 = 0 THEN amount + 1 ELSE amount END")} AS amount, TRUE AS hashed
FROM (SELECT *, k % 7 = 0 OR (k % 13 = 0 AND k % 10 <> 0) AS done FROM (SELECT *, {KEY} AS k FROM audited))""")
def audit_run(spark, sf):
    """The whole run: a store kept by key meets an input with new rows and changed amounts."""
    settled = build.settled_store(spark, sf)
    key = tables._order_key()
    source = settled.withColumn("amount", F.when(key % 13 == 0, F.col("amount") + 1).otherwise(F.col("amount"))
                                .cast("decimal(18,2)"))
    store = sinks.KeyedStore(spark, lineage.scratch(spark, "audit-store"), buckets=build.buckets(spark, sf))
    store.write(diff.ensure_hash(hashed(tables.local_store(settled)).drop("seq")), dealt=True)  # as the settled rows lie
    out = audit.audit_run(source, store.read(), RUN, tables.memory(spark, sf), keyword_table=rule_table(spark, sf),
                          row="transaction_id").store
    pfc = F.col("personal_finance_category")
    return out.select("transaction_id", pfc["primary"].alias("pfc_primary"), pfc["detailed"].alias("pfc_detailed"),
                      "category_update_step", "category_review_flag", "category_audited_at",
                      F.col("amount").cast("double").alias("amount"), F.col(schema.HASH_COLUMN).isNotNull().alias("hashed"))


cte("overfetched", ["local_", "remote_"], f"""
WITH f AS (SELECT *, k % 3 <> 0 AS item_ok FROM remote_
    WHERE date >= CAST(DATE '{TODAY}' - 90 AS VARCHAR)),
cov AS (SELECT DISTINCT account_id FROM f WHERE item_ok)
SELECT f.transaction_id, CASE WHEN l.transaction_id IS NULL THEN 'added' ELSE 'changed' END AS change
FROM f LEFT JOIN local_ l USING (transaction_id) WHERE l.transaction_id IS NULL OR l.amount <> f.amount
UNION ALL SELECT transaction_id, 'stale' FROM local_ WHERE NOT pending
  AND transaction_id NOT IN (SELECT transaction_id FROM f)
  AND account_id IN (SELECT account_id FROM cov) AND date >= CAST(DATE '{TODAY}' - 90 AS VARCHAR)
  AND date <= CAST(DATE '{TODAY}' - 3 AS VARCHAR)""")


def overfetched(spark, sf):
    """A store in months met by a window of the other copy."""
    other = sides(spark, sf)[1]
    fresh = other.filter(F.col("date") >= F.date_sub(F.to_date(F.lit(TODAY)), 90).cast("string")) \
        .withColumn("item_ok", tables._order_key() % 3 != 0).drop("category_audited_at", "txn_owner")
    store = sinks.MonthStore(spark, lineage.scratch(spark, "overfetch-store"))
    store.write(tables.dated(build.settled_packed(spark, sf)),
                lambda dealt: tables.local_store(tables.records(dealt, store.MONTH)).drop("seq"))
    return diff.overfetch_months(store, fresh, TODAY)


@query("overfetch_reconcile", ["overfetched"], "SELECT * FROM overfetched")
def overfetch_reconcile(spark, sf):
    return overfetched(spark, sf)


@query("overfetch_log", ["overfetched"], """
SELECT 't' AS ts, 'overfetch' AS event, change, count(*) AS n,
  array_to_string(list(transaction_id ORDER BY transaction_id)[:20], ',') AS first_ids FROM overfetched GROUP BY change""")
def overfetch_log(spark, sf):
    return diff.overfetch_log(lineage.stored(overfetched(spark, sf), "overfetched"), "t")


@query("overfetch_id_sample", ["overfetched"], """
SELECT change, transaction_id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY change ORDER BY transaction_id) AS rn FROM overfetched) WHERE rn <= 20""")
def overfetch_id_sample(spark, sf):
    return diff.sorted_id_sample(overfetched(spark, sf), by="change")


@query("repair_window", ["local_", "report"], f"""
SELECT CAST(least(max(CASE WHEN NOT pending THEN CAST(date AS DATE) END) - 7,
    min(CASE WHEN pending OR transaction_id IN (SELECT transaction_id FROM report
      WHERE sync_class = 'conflict') THEN CAST(date AS DATE) END)) AS VARCHAR) AS start_date,
  '{TODAY}' AS end_date, count(*) FILTER (pending) AS n_pending FROM local_""")
def repair_window(spark, sf):
    extra = report(spark, sf).filter("sync_class = 'conflict'")
    return diff.repair_window(sides(spark, sf)[0], TODAY, extra)


cte("feed_ops", [], """
SELECT event_id AS seq, 'u' || user_id AS transaction_id, CASE event_type WHEN 'signup' THEN 'added'
  WHEN 'error' THEN 'removed' ELSE 'modified' END AS op, CAST(value AS DECIMAL(18,2)) AS amount,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")


def sync_base(spark, sf):
    return tables.read(spark, sf, "customer").selectExpr(
        "concat('u', c_custkey) AS transaction_id", "CAST(c_acctbal AS DECIMAL(18,2)) AS amount",
        "CAST(NULL AS BIGINT) AS k")


@query("apply_sync_deltas", ["feed_ops"], f"""
SELECT transaction_id, {d('amount')} AS amount, k FROM (SELECT *, row_number() OVER (
  PARTITION BY transaction_id ORDER BY seq DESC) AS rn FROM feed_ops) WHERE rn = 1 AND op <> 'removed'
UNION ALL SELECT 'u' || c_custkey, {d('CAST(c_acctbal AS DECIMAL(18,2))')}, NULL FROM customer
WHERE 'u' || c_custkey NOT IN (SELECT transaction_id FROM feed_ops)""")
def apply_sync_deltas(spark, sf):
    feed = tables.sync_events(tables.read(spark, sf, "events")).drop("ts")
    return diff.apply_sync_deltas(sync_base(spark, sf), feed).withColumn(
        "amount", F.col("amount").cast("double"))


@query("sync_counts", ["feed_ops"], f"""
SELECT op, {n()} AS n FROM feed_ops WHERE op <> 'removed' GROUP BY 1
UNION ALL SELECT 'removed', {n()} FROM (SELECT *, lag(op) OVER (PARTITION BY transaction_id ORDER BY seq)
  AS prev FROM feed_ops) WHERE op = 'removed' AND (prev IN ('added', 'modified') OR (prev IS NULL
  AND transaction_id IN (SELECT 'u' || c_custkey FROM customer)))""")
def sync_counts(spark, sf):
    feed = tables.sync_events(tables.read(spark, sf, "events"))
    return diff.sync_counts(sync_base(spark, sf), feed, bucket=1000)


@query("owner_backfill", ["settled"], """
SELECT transaction_id, coalesce(txn_owner, 'owner_1') AS txn_owner, CASE WHEN txn_owner IS NULL THEN 'stamped'
  WHEN txn_owner = 'owner_1' THEN 'kept' ELSE 'other owner' END AS outcome FROM settled""")
def owner_backfill(spark, sf):
    return diff.owner_stamps(build.settled(spark, sf), "owner_1").select("transaction_id", "txn_owner", "outcome")


@query("owner_filter", ["settled"], "SELECT transaction_id FROM settled WHERE txn_owner = 'owner_2'")
def owner_filter(spark, sf):
    return diff.owner_filter(build.settled(spark, sf), "owner_2").select("transaction_id")


# intents ---------------------------------------------------------------------------------------

_W = "(o_custkey % 30)"
cte("log", [], f"""
SELECT s_suppkey * 10 AS seq, 'm' || s_suppkey AS id,
  CASE WHEN s_suppkey % 41 = 40 THEN 'merge' ELSE 'edit' END AS action,
  CASE WHEN s_suppkey % 2 = 0 THEN 'ui' ELSE 'cli' END AS source,
  CASE WHEN s_suppkey % 37 = 36 THEN 'galaxy' ELSE 'merchant' END AS scope, NULL AS mt,
  CASE WHEN s_suppkey % 3 <> 2 THEN {entity_sql('s_suppkey')} END AS me,
  nullif({norm_sql(merchant_sql('s_suppkey'))}, '') AS mn,
  CASE WHEN s_suppkey % 43 = 42 THEN 'region' END AS mo,
  {slot_sql('s_suppkey % 24', 0)} AS sp, {slot_sql('s_suppkey % 24', 1)} AS sd, NULL AS revokes,
  {merchant_sql('s_suppkey')} AS snm, {entity_sql('s_suppkey')} AS sne,
  CASE WHEN s_suppkey % 4 = 0 THEN 'mechanical' END AS bs,
  CASE WHEN s_suppkey % 8 = 0 THEN 'keyword:uber' END AS br, NULL AS pp, NULL AS pd,
  CASE WHEN s_suppkey % 3 = 0 THEN 'LOW' END AS sc FROM supplier
UNION ALL SELECT o_orderkey * 10 + 5, 't' || o_orderkey, 'edit',
  CASE WHEN o_orderkey % 3 = 0 THEN 'ui' ELSE 'cli' END, 'transaction',
  CASE WHEN o_orderkey % 60 <> 43 THEN o_orderkey || '-' || (o_orderkey % 8 + 1) END, NULL, NULL, NULL,
  {slot_sql('o_custkey % 4', 0)}, {slot_sql('o_custkey % 4', 1)}, NULL, {merchant_sql(_W)},
  {entity_sql(_W)}, NULL, NULL, CASE WHEN o_orderkey % 9 = 0 THEN 'TRAVEL' WHEN o_orderkey % 9 < 5
  THEN 'FOOD_AND_DRINK' END, {slot_sql('o_orderkey % 4', 1)}, NULL FROM orders
UNION ALL SELECT s_suppkey * 10 + 7, 'r' || s_suppkey, 'revoke', 'ui', NULL, NULL, NULL, NULL, NULL,
  NULL, NULL, 'm' || s_suppkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier
WHERE s_suppkey % 11 = 4""")
cte("judged_log", ["log", "menu"], """
SELECT *, CASE WHEN action = 'revoke' THEN 'revoke' WHEN action <> 'edit' THEN 'unknown action'
  WHEN id IN (SELECT revokes FROM log WHERE revokes IS NOT NULL) THEN 'revoked'
  WHEN scope NOT IN ('transaction', 'merchant') THEN 'unknown scope'
  WHEN mo IS NOT NULL THEN 'unknown match key'
  WHEN scope = 'transaction' AND mt IS NULL THEN 'no transaction id'
  WHEN scope = 'merchant' AND me IS NULL AND mn IS NULL THEN 'no merchant key'
  WHEN NOT EXISTS (SELECT 1 FROM menu WHERE primary_ = sp AND detailed = sd) THEN 'invalid category'
  END AS reject FROM log""")
cte("resolved", ["judged_log"], "SELECT * FROM judged_log WHERE reject IS NULL")


def matched_sql(store):
    return f"""
WITH a AS (SELECT s.*, t.id AS ti, t.seq AS ts, e.id AS ei, e.seq AS es,
  CASE WHEN n.me IS NOT NULL AND s.merchant_entity_id IS NOT NULL AND n.me <> s.merchant_entity_id
    THEN NULL ELSE n.id END AS ni, n.seq AS ns
FROM (SELECT *, nullif({norm_sql('merchant_name')}, '') AS norm FROM {store}) s
LEFT JOIN (SELECT * FROM resolved WHERE scope = 'transaction' QUALIFY row_number() OVER (
  PARTITION BY mt ORDER BY seq DESC) = 1) t ON t.mt = s.transaction_id
LEFT JOIN (SELECT * FROM resolved WHERE scope = 'merchant' AND me IS NOT NULL QUALIFY row_number() OVER (
  PARTITION BY me ORDER BY seq DESC) = 1) e ON e.me = s.merchant_entity_id
LEFT JOIN (SELECT * FROM resolved WHERE scope = 'merchant' AND mn IS NOT NULL QUALIFY row_number() OVER (
  PARTITION BY mn ORDER BY seq DESC) = 1) n ON n.mn = s.norm)
SELECT *, coalesce(ti, CASE WHEN ei IS NULL THEN ni WHEN ni IS NULL THEN ei WHEN ns > es THEN ni
  ELSE ei END) AS intent_id FROM a"""


cte("matched", ["settled", "resolved"], matched_sql("settled"))


def log(spark, sf):
    return tables.intents(spark, sf)


def resolved(spark, sf):
    return intents.resolve_intents(log(spark, sf), dims.category_menu(spark))


@query("resolve_intents", ["judged_log"], """
SELECT seq, id, scope, coalesce(reject, '') AS reject FROM judged_log""")
def resolve_intents(spark, sf):
    return intents.judge_intents(log(spark, sf), dims.category_menu(spark)).select(
        "seq", "id", "scope", F.coalesce("reject", F.lit("")).alias("reject"))


@query("match_intents", ["matched"], "SELECT transaction_id, intent_id FROM matched")
def match_intents(spark, sf):
    return intents.match_intents(build.settled(spark, sf), resolved(spark, sf)).select(
        "transaction_id", F.col("intent.id").alias("intent_id"))


@query("intent_coverage", ["resolved", "matched"], f"""
SELECT r.id, r.scope, {n('m.transaction_id')} AS n_rows FROM resolved r
LEFT JOIN matched m ON m.intent_id = r.id GROUP BY 1, 2""")
def intent_coverage(spark, sf):
    return intents.intent_coverage(build.settled(spark, sf), resolved(spark, sf))


MANUAL = "s2 % 11 = 0"
cte("edited", ["audited"], f"""
SELECT * REPLACE (CASE WHEN {MANUAL} THEN 'manual' ELSE category_update_step END AS category_update_step)
FROM audited""")
cte("replay_base", ["edited", "resolved"], matched_sql("edited"))


def replayed(spark, sf):
    store = audited(spark, sf).drop("decision", "applied", "flagged", "before_primary",
                                    "before_detailed")
    store = store.withColumn("category_update_step", F.when(
        F.col("seq.l_partkey") % 11 == 0, "manual").otherwise(F.col("category_update_step")))
    return intents.replay_intents(store, resolved(spark, sf), "later", build.settled_store(spark, sf))


@query("replay_intents", ["replay_base", "resolved"], """
SELECT m.transaction_id, CASE WHEN ch THEN 'applied' WHEN cov THEN 'already' WHEN back THEN 'reverted' END AS replay,
  CASE WHEN ch THEN sp WHEN back THEN original_pf_category_primary ELSE pfc_primary END AS pfc_primary,
  CASE WHEN ch THEN sd WHEN back THEN original_pf_category_detailed ELSE pfc_detailed END AS pfc_detailed,
  CASE WHEN ch THEN 'manual' WHEN back THEN '' ELSE category_update_step END AS category_update_step,
  CASE WHEN ch THEN 'manual:' || rscope || ':' || intent_id WHEN back THEN '' ELSE category_update_reason END
    AS category_update_reason, CASE WHEN cov THEN '' ELSE category_review_flag END AS category_review_flag,
  CASE WHEN back THEN NULL WHEN ch AND original_pf_category_primary IS NULL AND
    original_pf_category_detailed IS NULL THEN pfc_primary ELSE original_pf_category_primary END
    AS original_pf_category_primary,
  CASE WHEN ch OR (cov AND category_review_flag = '1') THEN 'later' ELSE category_audited_at END
    AS category_audited_at,
  CASE WHEN back THEN 'pending:manual-edit-revoked' END AS source_content_hash
FROM (SELECT b.*, r.sp, r.sd, r.scope AS rscope, r.id IS NOT NULL AS cov,
  r.id IS NOT NULL AND (sp IS DISTINCT FROM pfc_primary OR sd IS DISTINCT FROM pfc_detailed) AS ch,
  r.id IS NULL AND category_update_step = 'manual' AS back
  FROM replay_base b LEFT JOIN resolved r ON r.id = b.intent_id) m""")
def replay_intents(spark, sf):
    pfc = F.col("personal_finance_category")
    return replayed(spark, sf).select(
        "transaction_id", "replay", pfc["primary"].alias("pfc_primary"),
        pfc["detailed"].alias("pfc_detailed"), "category_update_step", "category_update_reason",
        "category_review_flag", "original_pf_category_primary", "category_audited_at",
        schema.HASH_COLUMN)


@query("orphan_intents", ["resolved", "settled"], """
SELECT id, mt AS transaction_id FROM resolved WHERE scope = 'transaction'
  AND mt NOT IN (SELECT transaction_id FROM settled)""")
def orphan_intents(spark, sf):
    return intents.orphan_intents(build.settled(spark, sf), resolved(spark, sf))


@query("intent_log_merge", ["log"], """
SELECT id, action, CASE WHEN seq % 3 <> 0 THEN 0 ELSE 1 END AS part, seq FROM log""")
def intent_log_merge(spark, sf):
    both = log(spark, sf)
    remote = both.filter("seq % 3 <> 0")
    local = both.filter("seq % 3 = 0 OR seq % 2 = 0")
    return intents.intent_log_merge(local, remote).select("id", "action", "part", "seq")


LBL = f"coalesce(nullif({norm_sql('snm')}, ''), sne, '(unknown)')"


@query("edit_mining", ["resolved"], f"""
WITH per AS (SELECT {LBL} AS key, sp || '/' || sd AS t, {n()} AS n FROM resolved
  WHERE scope = 'transaction' GROUP BY 1, 2),
w AS (SELECT key, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, min(t) AS t FROM per GROUP BY 1 HAVING sum(n) >= 2)
SELECT 'promote' AS section, key, t AS detail, n FROM w WHERE k = 1
UNION ALL SELECT 'conflicted', key, t, n FROM per WHERE key IN (SELECT key FROM w WHERE k > 1)
UNION ALL SELECT 'demote', bs || ': ' || coalesce(br, ''), '', {n()} FROM resolved WHERE bs IS NOT NULL GROUP BY 2
UNION ALL SELECT 'scorecard', CASE WHEN pp IS NULL THEN 'no_flag' WHEN pp = sp AND pd = sd THEN 'flag_right'
  ELSE 'flag_wrong' END, '', {n()} FROM resolved GROUP BY 2
UNION ALL SELECT 'confidence', coalesce(sc, 'UNKNOWN'), '', {n()} FROM resolved GROUP BY 2
UNION ALL SELECT 'scope', scope, '', {n()} FROM resolved GROUP BY 2
UNION ALL SELECT 'source', source, '', {n()} FROM resolved GROUP BY 2""".replace("WITH per AS", ", per AS"))
def edit_mining(spark, sf):
    return intents.edit_mining(log(spark, sf), dims.category_menu(spark))


@query("build_intent", ["settled", "menu"], f"""
SELECT p.id, p.scope, CASE WHEN p.scope = 'transaction' THEN s.transaction_id END AS match_transaction_id,
  CASE WHEN p.scope = 'merchant' THEN merchant_entity_id END AS match_entity_id,
  CASE WHEN p.scope = 'merchant' THEN nullif({norm_sql('merchant_name')}, '') END AS match_name,
  s.pfc_primary AS snap_before_primary, s.pfc_confidence AS snap_source_confidence,
  CASE WHEN m.detailed IS NULL THEN 'invalid category' WHEN s.transaction_id IS NULL THEN 'no such row'
    WHEN p.scope NOT IN ('transaction', 'merchant') THEN 'unknown scope'
    WHEN p.scope = 'merchant' AND merchant_entity_id IS NULL AND nullif({norm_sql('merchant_name')}, '') IS NULL
    THEN 'no merchant key' END AS reject
FROM (SELECT 'b' || o_orderkey AS id, o_orderkey || '-' || (o_orderkey % 7 + 1) AS tid,
  list_extract(['transaction', 'merchant', 'planet'], (o_custkey % 3) + 1) AS scope,
  {slot_sql('o_custkey % 24', 0)} AS pp, {slot_sql('o_custkey % 24', 1)} AS pd FROM orders) p
LEFT JOIN settled s ON s.transaction_id = p.tid
LEFT JOIN menu m ON m.primary_ = pp AND m.detailed = pd""")
def build_intent(spark, sf):
    index = f"o_custkey % {len(tables.SLOTS)}"
    picks = tables.read(spark, sf, "orders").selectExpr(
        "o_orderkey AS seq", "concat('b', o_orderkey) AS id",
        "concat(o_orderkey, '-', o_orderkey % 7 + 1) AS transaction_id",
        "get(array('transaction', 'merchant', 'planet'), int(o_custkey % 3)) AS scope",
        f"{tables.slot(index, 0)} AS primary", f"{tables.slot(index, 1)} AS detailed",
        "'' AS note")
    return intents.build_intents(picks, build.settled(spark, sf).drop("seq"),
                                 dims.category_menu(spark), "t").select(
        "id", "scope", "match_transaction_id", "match_entity_id", "match_name",
        "snap_before_primary", "snap_source_confidence", "reject")


cte("notes", [], f"""
SELECT *, sd IS NOT NULL AND sd <> coalesce(od, '') AS c0, s1 <> 'Dining Out' AS c1,
  s2 IS NOT NULL AND s2 <> 'Other' AS c2 FROM (
SELECT 'c' || s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 1 THEN {merchant_sql('s_suppkey')} END AS merchant,
  {merchant_sql('s_suppkey')} AS om, {slot_sql('s_suppkey % 24', 1)} AS od,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Groceries' ELSE 'Dining Out' END AS s1,
  CASE WHEN s_suppkey % 5 = 0 THEN 'Groceries' END AS s2,
  CASE WHEN s_suppkey % 7 = 2 THEN 'FOOD_AND_DRINK_COFFEE' END AS sd FROM supplier)""")


@query("correction_notes", ["notes"], """
SELECT id, CASE WHEN c0 THEN 'upstream' ELSE 'local' END AS layer, concat_ws(',',
  CASE WHEN c0 THEN 'pfc_detailed' END, CASE WHEN c1 THEN 'tier1' END, CASE WHEN c2 THEN 'tier2' END)
  AS changed_fields, concat_ws(', ', CASE WHEN c0 THEN 'pfc_detailed: ' || coalesce(od, '∅') || ' → ' || sd END,
  CASE WHEN c1 THEN 'tier1: Dining Out → ' || s1 END, CASE WHEN c2 THEN 'tier2: Other → ' || s2 END) AS diff
FROM notes""")
def correction_notes(spark, sf):
    return intents.correction_notes(tables.corrections(spark, sf)).select(
        "id", "layer", F.array_join("changed_fields", ",").alias("changed_fields"), "diff")


@query("correction_overrides", ["notes"], """
SELECT '(?i)' || coalesce(merchant, om) AS regex, s1 AS tier1, s2 AS tier2 FROM notes
WHERE NOT c0 AND coalesce(merchant, om) IS NOT NULL""")
def correction_overrides(spark, sf):
    return intents.override_rows(intents.correction_notes(tables.corrections(spark, sf)))
