"""Enrichment operators and the cube."""

from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.catalog import build
from ledgerloom.catalog.base import cte, d, n, query
from ledgerloom.operators import cube as cb
from ledgerloom.operators import enrich, ingest
from ledgerloom.operators.cube import GroupingSpec
from ledgerloom.plans import cube_store, lineage
from ledgerloom.sources import tables


def picked(key, cols, needs=("cube",), source="cube"):
    """A query that is a plain selection of enriched columns."""
    return query(key, needs, f"SELECT transaction_id, {', '.join(cols)} FROM {source}")


@picked("resolve_taxonomy", ["atom", "tier0", "tier1", "tier2", "unmapped"])
def resolve_taxonomy(spark, sf):
    return _sel(spark, sf, "atom", "tier0", "tier1", "tier2", "unmapped")


def _sel(spark, sf, *cols):
    return build.cube(spark, sf).select("transaction_id", *cols)


@query("merchant_override", ["settled"], """
SELECT transaction_id, CASE WHEN regexp_matches(merchant_entity_id, '^(ent_1\\d|bill_2)$')
  THEN 'Picked' WHEN regexp_matches(merchant_name, '(?i)^store [a-c]|NETFLIX') THEN 'Found'
  ELSE 'None' END AS tier1, CASE WHEN regexp_matches(merchant_entity_id, '^(ent_1\\d|bill_2)$')
  THEN 'By id' WHEN regexp_matches(merchant_name, '(?i)^store [a-c]|NETFLIX') THEN 'None'
  ELSE 'None' END AS tier2 FROM settled""")
def merchant_override(spark, sf):
    rules = [(r"ent_1\d|bill_2", "Picked", "By id"), (r"(bad", "x", "y"),
             (r"(?i)^store [a-c]|NETFLIX", "Found", None)]
    base = build.canon(spark, sf).withColumns({"tier1": F.lit("None"), "tier2": F.lit("None")})
    return enrich.merchant_override(base, rules).select("transaction_id", "tier1", "tier2")


@query("exclude_flow", ["cube"], f"""
SELECT transaction_id, flow, {d('spend')} AS spend, {d('income')} AS income,
  {d('abs_amount')} AS abs_amount FROM cube""")
def exclude_flow(spark, sf):
    return _sel(spark, sf, "flow", *[F.col(c).cast("double").alias(c)
                                     for c in ("spend", "income", "abs_amount")])


@query("time_dims", ["cube"], """SELECT transaction_id, date_resolved, year, quarter, month, week,
  dow FROM cube""")
def time_dims(spark, sf):
    return _sel(spark, sf, "date_resolved", "year", "quarter", "month", "week", "dow")


@picked("geo_dims", ["geo_scope", "geo_country", "geo_city"])
def geo_dims(spark, sf):
    return _sel(spark, sf, "geo_scope", "geo_country", "geo_city")


@picked("merchant_dims", ["merchant_id", "merchant", "merchant_brand"])
def merchant_dims(spark, sf):
    return _sel(spark, sf, "merchant_id", "merchant", "merchant_brand")


@picked("account_facets", ["person", "channel", "account_type", "account_name", "institution"])
def account_facets(spark, sf):
    return _sel(spark, sf, "person", "channel", "account_type", "account_name", "institution")


@query("account_include", ["settled", "accounts"], """
SELECT transaction_id FROM settled WHERE account_id NOT IN
  (SELECT account_id FROM accounts WHERE NOT include)""")
def account_include(spark, sf):
    return enrich.account_include(build.settled(spark, sf), tables.accounts(spark, sf)) \
        .select("transaction_id")


@query("category_path", ["cube"], """
SELECT transaction_id, tier0 || '|' || tier1 || '|' || tier2 || '|' || merchant AS category_path,
  geo_scope || '|' || geo_country || '|' || geo_city AS geo_path,
  coalesce(year || '|' || quarter || '|' || month || '|' || week || '|' || dow, '') AS time_path
FROM cube""")
def category_path(spark, sf):
    return _sel(spark, sf, *[F.array_join(c, "|").alias(c)
                             for c in ("category_path", "geo_path", "time_path")])


@query("recurrence", ["cube"], "SELECT transaction_id, merchant_id, recurrence FROM cube")
def recurrence(spark, sf):
    return build.cube(spark, sf, True).select("transaction_id", "merchant_id", "recurrence")


@query("gap_lag", ["cube"], """
SELECT merchant_id, CAST(day AS VARCHAR) AS day,
  CAST(day - lag(day) OVER (PARTITION BY merchant_id ORDER BY day) AS INTEGER) AS gap
FROM (SELECT DISTINCT merchant_id, day FROM cube WHERE flow = 'spend' AND day IS NOT NULL
  AND merchant_id NOT IN ('', 'unknown'))""")
def gap_lag(spark, sf):
    return enrich.gap_lag(build.cube(spark, sf)).filter("day IS NOT NULL").select(
        "merchant_id", F.col("day").cast("string").alias("day"), "gap")


@query("atom_tiers_gen", ["settled", "atoms"], f"""
SELECT a.atom, tier0, tier1, tier2, {n()} AS n_rows FROM settled s JOIN atoms a
  ON a.atom = s.pfc_detailed GROUP BY ALL""")
def atom_tiers_gen(spark, sf):
    known = dims.atoms(spark).select(F.col("atom").alias("detailed"))
    used = (build.canon(spark, sf).groupBy(F.col("pfc_primary").alias("primary"),
                                           F.col("pfc_detailed").alias("detailed"))
            .agg(F.count(F.lit(1)).alias("n_rows")).join(known, "detailed", "left_semi"))
    tiers = dims.with_tiers(used.select("primary", "detailed").distinct())
    return tiers.join(used.select(F.col("detailed").alias("atom"), "n_rows"), "atom")


@query("accounts_scaffold", ["settled"], f"""
SELECT account_id, {n()} AS n, coalesce(arg_max(txn_owner, (date, transaction_id))
  FILTER (txn_owner IS NOT NULL), 'Unknown') AS person FROM settled GROUP BY 1""")
def accounts_scaffold(spark, sf):
    return enrich.accounts_scaffold(build.canon(spark, sf))


BUILD_COLS = """transaction_id, account_id, flow, tier0, tier1, tier2, atom, merchant_id, merchant,
  unmapped, confidence, geo_scope, geo_country, geo_city, date_resolved, year, quarter, month,
  week, dow, person, channel, account_type, account_name, institution, pending,
  category_update_step, review_pending, recurrence"""


@query("build_cube", ["cube"], f"""
SELECT {BUILD_COLS}, {d('amount')} AS amount, {d('spend')} AS spend, {d('income')} AS income
FROM cube""")
def build_cube(spark, sf):
    return build.cube(spark, sf, True).select(
        *[c.strip() for c in BUILD_COLS.split(",")],
        *[F.col(c).cast("double").alias(c) for c in ("amount", "spend", "income")])


# the cube ------------------------------------------------------------------------------------


def M(sql):
    return sql.replace("SPEND", d("sum(spend)")).replace("INCOME", d("sum(income)")).replace(
        "COUNT", "CAST(sum(count) AS BIGINT)")


@query("rollup", ["cube"], M("""
SELECT tier1, month, SPEND AS spend, COUNT AS count, SPEND / COUNT AS avg_ticket
FROM cube GROUP BY 1, 2"""))
def rollup(spark, sf):
    return cb.rollup(build.cube(spark, sf), GroupingSpec(group_by=["tier1", "month"]))


@query("grand_total", ["cube"], f"""
SELECT {d('sum(spend)')} AS spend, {d('sum(income)')} AS income, {d('sum(count)')} AS count,
  {d('sum(income) - sum(spend)')} AS net FROM cube
WHERE person IN ('owner_1', 'owner_2') AND tier1 <> 'Travel'
  AND date_resolved >= '1997-01-01' AND date_resolved <= '1999-12-31'""")
def grand_total(spark, sf):
    df = cb.hidden_mask(build.cube(spark, sf), [("tier1", "Travel"), ("nope", "x")])
    return cb.grand_total(df, GroupingSpec(
        filters={"person": ["owner_1", "owner_2", "All", None], "channel": "All"},
        date_from="1997-01-01", date_to="1999-12-31", include_hidden=True))


def kept_cube(spark, sf):
    """A stored cube that lacked every seventh order and had old sums of every thirteenth, brought up to date."""
    named = ["transaction_id", "day", "month", *cube_store.DIMENSIONS, *cube_store.SUMS]  # what its sums are made of
    rows = lineage.stored(build.cube_of_store(spark, sf).select(*named), "cube")  # written twice and compared with itself
    key = tables._order_key()
    store = cube_store.CubeStore(spark, lineage.scratch(spark, "cube-store"))
    old = F.when(key % 13 == 0, F.col("spend") * 2).otherwise(F.col("spend")).cast(rows.schema["spend"].dataType)
    store.build(rows.filter(key % 7 != 0).withColumn("spend", old))
    store.refresh(rows.filter((key % 7 == 0) | (key % 13 == 0)))
    return store


@query("rollup_kept", ["cube"], M("""
SELECT tier1, month, SPEND AS spend, COUNT AS count, SPEND / COUNT AS avg_ticket
FROM cube GROUP BY 1, 2"""))
def rollup_kept(spark, sf):
    return kept_cube(spark, sf).rollup(GroupingSpec(group_by=["tier1", "month"]))


@query("distinct_values", ["cube"], "SELECT DISTINCT geo_city FROM cube WHERE geo_city IS NOT NULL")
def distinct_values(spark, sf):
    return cb.distinct_values(build.cube(spark, sf), "geo_city")


@query("date_bounds", ["cube"], """
SELECT min(date_resolved) AS date_min, max(date_resolved) AS date_max FROM cube""")
def date_bounds(spark, sf):
    return cb.date_bounds(build.cube(spark, sf))


@query("facet_filter", ["cube"], f"""
SELECT transaction_id, {d('spend')} AS spend FROM cube WHERE channel IN ('online', 'other')
  AND geo_scope = 'Domestic' AND date_resolved >= '1998-01-01'""")
def facet_filter(spark, sf):
    spec = GroupingSpec(filters={"channel": ["online", "other", None], "geo_scope": "Domestic",
                                 "person": "All", "atom": "", "tier0": ["All"]},
                        date_from="1998-01-01")
    return cb.facet_filter(build.cube(spark, sf), spec).select(
        "transaction_id", F.col("spend").cast("double").alias("spend"))


@query("filtered_rows", ["cube"], f"""
SELECT transaction_id, merchant_id, tier1, month, {d('spend')} AS spend FROM cube
WHERE flow = 'spend' AND account_type = 'credit'""")
def filtered_rows(spark, sf):
    spec = GroupingSpec(filters={"flow": "spend", "account_type": "credit"})
    return cb.facet_filter(build.cube(spark, sf), spec).select(
        "transaction_id", "merchant_id", "tier1", "month",
        F.col("spend").cast("double").alias("spend"))


@query("drill_filter", ["cube"], """
SELECT transaction_id, atom, merchant FROM cube WHERE tier0 = 'Discretionary' AND tier1 = 'Dining Out'
  AND tier2 = 'Coffee'""")
def drill_filter(spark, sf):
    return cb.drill_filter(build.cube(spark, sf), ["Discretionary", "Dining Out", "Coffee"]) \
        .select("transaction_id", "atom", "merchant")


HIDE = [("tier1", "Dining Out"), ("person", "owner_3"), ("no_such_dim", "x")]


@query("hidden_mask", ["cube"], """
SELECT transaction_id, coalesce(tier1 = 'Dining Out' OR person = 'owner_3', FALSE) AS hidden
FROM cube""")
def hidden_mask(spark, sf):
    return cb.hidden_mask(build.cube(spark, sf), HIDE).select("transaction_id", "hidden")


@query("hidden_mask_table", ["cube"], """
SELECT transaction_id, merchant_id IN (SELECT 'ent_' || s_suppkey FROM supplier WHERE s_acctbal < 0)
  OR geo_city IN (SELECT 'City_' || s_nationkey FROM supplier WHERE s_acctbal > 9000) AS hidden
FROM cube""")
def hidden_mask_table(spark, sf):
    sup = tables.read(spark, sf, "supplier")
    rules = sup.filter("s_acctbal < 0").select(
        F.lit("merchant_id").alias("dim"),
        F.concat(F.lit("ent_"), F.col("s_suppkey").cast("string")).alias("value")).unionByName(
        sup.filter("s_acctbal > 9000").select(
            F.lit("geo_city").alias("dim"),
            F.concat(F.lit("City_"), F.col("s_nationkey").cast("string")).alias("value")))
    return cb.hidden_mask(build.cube(spark, sf).select("transaction_id", "merchant_id",
                                                       "geo_city"), rules) \
        .select("transaction_id", "hidden")


@query("top_groups", ["cube"], M("""
SELECT merchant, INCOME AS income, COUNT AS count FROM cube GROUP BY 1
ORDER BY income ASC NULLS LAST, merchant LIMIT 25"""))
def top_groups(spark, sf):
    return cb.rollup(build.cube(spark, sf), GroupingSpec(
        group_by=["merchant"], measures=["income", "bogus"], order_by="income",
        descending=False, limit=25))


def tie_sql():
    parts = [f"""SELECT '{c}' AS grouping, {d('sum(spend)')} AS sum, TRUE AS ties_out
FROM cube WHERE flow = 'spend'""" for c in cb.TIE_OUT]
    return "\nUNION ALL ".join(parts)


@query("tie_out", ["cube"], tie_sql())
def tie_out(spark, sf):
    return cb.tie_out(build.cube(spark, sf), GroupingSpec())


@query("tie_out_kept", ["cube"], tie_sql())
def tie_out_kept(spark, sf):
    return cb.tie_out(kept_cube(spark, sf).sums.read(), GroupingSpec())


@query("qc_metrics", ["cube"], f"""
SELECT {d('sum(spend)')} AS spend_total, {d('sum(income)')} AS income_total,
  {d('sum(income) - sum(spend)')} AS net_total, {n()} FILTER (flow = 'excluded') AS n_excluded,
  {d("sum(abs_amount) FILTER (flow = 'excluded')")} AS excluded_sum,
  (SELECT string_agg(atom, ',' ORDER BY atom) FROM (SELECT DISTINCT atom FROM cube WHERE unmapped))
    AS unmapped_atoms, {n()} FILTER (unmapped) AS n_unmapped_rows,
  {d("sum(spend) FILTER (tier1 = 'Other')")} / {d('sum(spend)')} * 100 AS pct_spend_other,
  CAST(count(DISTINCT merchant_id) FILTER (recurrence = 'recurring') AS BIGINT)
    AS n_recurring_merchants FROM cube""".replace("CAST(count(*) AS BIGINT) FILTER", "count(*) FILTER"))
def qc_metrics(spark, sf):
    return cb.qc_metrics(build.cube(spark, sf, True))


cte("nodes", ["cube"], """
SELECT list_slice(path, 1, i) AS node, sum(spend) AS total FROM (
  SELECT [tier0, tier1, tier2, merchant] AS path, spend FROM cube WHERE flow = 'spend') p,
  range(1, 5) r(i) GROUP BY 1""")


@query("hierarchy_totals", ["cube"], f"""
SELECT array_to_string(node, '/') AS id, array_to_string(list_slice(node, 1, len(node) - 1), '/')
  AS parent, CASE WHEN len(node) = 3 THEN replace(node[-1], '_', ' ') ELSE node[-1] END AS label,
  {d('sum(spend)')} AS value, 'Necessary/' || array_to_string(node, '/') AS path
FROM (SELECT list_slice([tier1, tier2, atom, merchant], 1, i) AS node, spend
  FROM cube, range(1, 5) r(i) WHERE flow = 'spend' AND tier0 = 'Necessary') GROUP BY node""")
def hierarchy_totals(spark, sf):
    rows = build.cube(spark, sf).filter("flow = 'spend'")
    return cb.hierarchy_totals(rows, ["Necessary"]).withColumn("path", F.array_join("path", "/"))


K = 30
cte("frontier", ["nodes"], f"""
SELECT node, total FROM (
WITH fan AS (SELECT list_slice(node, 1, len(node) - 1) AS node, count(*) AS kids FROM nodes GROUP BY 1),
inner_ AS (SELECT node, total, (SELECT kids FROM fan WHERE len(node) = 0) + coalesce(
    sum(kids - 1) OVER (ORDER BY total DESC, len(node), node ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS size FROM fan JOIN nodes USING (node)),
ex AS (SELECT node FROM inner_ WHERE size < {K})
SELECT node, total FROM nodes WHERE node NOT IN (SELECT node FROM ex)
  AND (len(node) = 1 OR list_slice(node, 1, len(node) - 1) IN (SELECT node FROM ex)))""")


@query("topk_frontier", ["frontier"], f"""
SELECT array_to_string(node, '/') AS node, {d('total')} AS total FROM frontier""")
def topk_frontier(spark, sf):
    rows = build.cube(spark, sf).filter("flow = 'spend'")
    return cb.topk_frontier(rows, K).select(F.array_join("node", "/").alias("node"),
                                            F.col("total").cast("double").alias("total"))


@query("frontier_assign", ["cube", "frontier"], f"""
SELECT bucket, {d('sum(spend)')} AS spend, {n()} AS n_rows FROM (
  SELECT spend, (SELECT array_to_string(node, '/') FROM frontier f WHERE
    list_slice([tier0, tier1, tier2, merchant], 1, len(f.node)) = f.node) AS bucket
  FROM cube WHERE flow = 'spend') GROUP BY 1""")
def frontier_assign(spark, sf):
    rows = build.cube(spark, sf).filter("flow = 'spend'").select("category_path", "spend")
    rows = lineage.stored(rows, "paths")  # for the frontier, the paths and the rows themselves
    out = cb.frontier_assign(rows, cb.topk_frontier(rows, K))
    return out.groupBy(F.array_join("bucket", "/").alias("bucket")).agg(
        F.sum("spend").cast("double").alias("spend"), F.count(F.lit(1)).alias("n_rows"))


@query("taxonomy_coverage_diff", ["cube", "atoms", "menu"], """
SELECT atom, 'unmapped in data' AS finding FROM (SELECT DISTINCT atom FROM cube
  WHERE atom NOT IN (SELECT atom FROM atoms))
UNION ALL SELECT atom, 'not on menu' FROM atoms WHERE atom NOT IN (SELECT detailed FROM menu)""")
def taxonomy_coverage_diff(spark, sf):
    known, menu = dims.atoms(spark).select("atom"), dims.category_menu(spark)
    used = build.cube(spark, sf).select("atom").distinct()
    missing = used.join(known, "atom", "left_anti").withColumn("finding",
                                                               F.lit("unmapped in data"))
    legal = menu.select(F.col("detailed").alias("atom"))
    return missing.unionByName(known.join(legal, "atom", "left_anti")
                               .withColumn("finding", F.lit("not on menu")))
