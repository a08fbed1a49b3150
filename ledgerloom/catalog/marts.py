"""Marts: cash flow, budget, merchants, recurring charges, scorecards."""

from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.catalog import build
from ledgerloom.catalog.base import BLANK_PROVENANCE, cte, cube_sql, d, n, query
from ledgerloom.catalog.enrichment import M
from ledgerloom.catalog.ingest import budget
from ledgerloom.operators import cube as cb, enrich, ingest
from ledgerloom.operators.cube import GroupingSpec
from ledgerloom.plans import marts, netting
from ledgerloom.sources import files, tables

ALL = GroupingSpec()


@query("cash_flow", ["cube"], M("""
SELECT month, INCOME AS income, SPEND AS spend, CAST(sum(income) - sum(spend) AS DOUBLE) AS savings,
  CAST(sum(sum(income) - sum(spend)) OVER (ORDER BY month NULLS LAST) AS DOUBLE) AS cumulative_net
FROM cube GROUP BY 1"""))
def cash_flow(spark, sf):
    return marts.cash_flow(build.cube(spark, sf), ALL)


cte("sums", ["cube"], """
SELECT tier1, month, sum(spend) AS spend FROM cube WHERE flow = 'spend' AND month IS NOT NULL
GROUP BY 1, 2""")
cte("months", ["sums"], "SELECT month, row_number() OVER (ORDER BY month DESC) AS rn "
                        "FROM (SELECT DISTINCT month FROM sums)")


def sums(spark, sf, level="tier1", flow="spend"):
    return marts.month_sums(build.cube(spark, sf), ALL, level, flow)


@query("monthly_pivot", ["sums", "months"], f"""
SELECT c.tier1, m.month, coalesce({d('s.spend')}, 0.0) AS spend
FROM (SELECT DISTINCT tier1 FROM sums) c CROSS JOIN months m
LEFT JOIN sums s ON s.tier1 = c.tier1 AND s.month = m.month""")
def monthly_pivot(spark, sf):
    grid = marts.monthly_pivot(sums(spark, sf))
    return grid.unpivot("tier1", [c for c in grid.columns if c != "tier1"], "month", "spend")


@query("budget_grid_export", ["sums", "months"], f"""
SELECT c.tier1 AS "Category", m.month, coalesce(round_even({d('s.spend')}, 2), 0.0) AS spend
FROM (SELECT DISTINCT tier1 FROM sums) c CROSS JOIN months m
LEFT JOIN sums s ON s.tier1 = c.tier1 AND s.month = m.month""")
def budget_grid_export(spark, sf):
    grid = marts.grid_export(sums(spark, sf))
    return grid.unpivot("Category", [c for c in grid.columns if c != "Category"], "month", "spend")


def trailing_sql(window, table="sums", months="months", level="tier1"):
    return f"""SELECT {level}, coalesce({d(f'sum(spend) FILTER (month IN (SELECT month FROM {months} WHERE rn <= {window}))')},
  0.0) / (SELECT count(*) FROM {months} WHERE rn <= {window}) AS avg FROM {table} GROUP BY 1"""


@query("trailing_avg", ["sums", "months"], trailing_sql(12))
def trailing_avg(spark, sf):
    return marts.trailing_avg(sums(spark, sf), "tier1", 12)


YTD = f"""SELECT tier1, coalesce({d('sum(spend) FILTER (left(month, 4) = (SELECT max(left(month, 4)) FROM sums))')}, 0.0)
  / (SELECT count(*) FROM months WHERE left(month, 4) = (SELECT max(left(month, 4)) FROM sums))
  AS ytd_avg FROM sums GROUP BY 1"""


@query("ytd_avg", ["sums", "months"], YTD)
def ytd_avg(spark, sf):
    return marts.ytd_avg(sums(spark, sf), "tier1")


@query("rolling_total", ["sums"], f"""
SELECT month, total, avg(total) OVER (ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
  AS trailing FROM (SELECT month, {d('sum(spend)')} AS total FROM sums
  WHERE tier1 <> 'Travel' GROUP BY 1)""")
def rolling_total(spark, sf):
    return marts.rolling_total(sums(spark, sf), 6, ["Travel"])


@query("heat_scale", ["cube"], M("""
SELECT tier1, spend, (spend - min(spend) OVER ()) / (max(spend) OVER () - min(spend) OVER ())
  AS intensity, (spend - 1000000.0) / greatest(abs(max(spend) OVER () - 1000000.0),
  abs(min(spend) OVER () - 1000000.0)) AS diverging
FROM (SELECT tier1, SPEND AS spend FROM cube GROUP BY 1)"""))
def heat_scale(spark, sf):
    table = cb.rollup(build.cube(spark, sf), GroupingSpec(group_by=["tier1"])) \
        .select("tier1", "spend")
    return marts.heat_scale(marts.heat_scale(table, "spend"), "spend", 1e6, "diverging")


cte("atom_sums", ["cube"], """
SELECT atom, month, sum(spend) AS spend FROM cube WHERE month IS NOT NULL GROUP BY 1, 2""")
cte("atom_months", ["atom_sums"], "SELECT month, row_number() OVER (ORDER BY month DESC) AS rn "
                                  "FROM (SELECT DISTINCT month FROM atom_sums)")


@query("spend_table", ["cube", "atom_sums", "atom_months"], f"""
SELECT c.atom, {d('sum(spend)')} AS actual, CAST(sum(count) AS BIGINT) AS txns,
  coalesce(any_value(a.avg), 0.0) AS avg_12m, coalesce(any_value(b.avg), 0.0) AS avg_3m
FROM cube c LEFT JOIN ({trailing_sql(12, 'atom_sums', 'atom_months', 'atom')}) a ON a.atom = c.atom
LEFT JOIN ({trailing_sql(3, 'atom_sums', 'atom_months', 'atom')}) b ON b.atom = c.atom GROUP BY 1""")
def spend_table(spark, sf):
    return marts.spend_table(build.cube(spark, sf), ALL, "atom")


@query("drill_metrics", ["cube"], f"""
SELECT t AS total, t / m * 12 AS annualized, t - mort AS less_mortgage,
  t - mort - house AS less_mortgage_home FROM (
SELECT coalesce({d("sum(spend) FILTER (flow = 'spend' AND NOT h)")}, 0.0) AS t,
  coalesce({d("sum(spend) FILTER (flow = 'spend' AND NOT h AND tier1 = 'Mortgage')")}, 0.0) AS mort,
  coalesce({d("sum(spend) FILTER (flow = 'spend' AND NOT h AND tier1 = 'House')")}, 0.0) AS house,
  greatest(count(DISTINCT month), 1) AS m
FROM (SELECT *, person = 'owner_3' OR tier1 = 'House' AS h FROM cube))""")
def drill_metrics(spark, sf):
    return marts.drill_metrics(cb.hidden_mask(build.cube(spark, sf), [
        ("person", "owner_3"), ("tier1", "House")]), ALL)


cte("bva", ["sums", "months", "budget"], f"""
SELECT * FROM (SELECT coalesce(a.tier1, b.category) AS category, coalesce(y.ytd_avg, 0.0) AS ytd_avg,
  coalesce(a.avg, 0.0) AS avg, goal, CASE WHEN goal <> 0 THEN coalesce(a.avg, 0.0) / goal * 100 END
  AS pct_of_goal, coalesce(a.avg, 0.0) - goal AS budget_diff
FROM ({trailing_sql(12)}) a JOIN ({YTD}) y ON y.tier1 = a.tier1
FULL JOIN budget b ON b.category = a.tier1) WHERE avg > 0 OR ytd_avg > 0 OR goal IS NOT NULL""")


def bva(spark, sf):
    return marts.budget_vs_actual(sums(spark, sf), budget(spark, sf), 12)


@query("budget_vs_actual", ["bva"], "SELECT * FROM bva")
def budget_vs_actual(spark, sf):
    return bva(spark, sf)


@query("budget_cuts", ["bva"], """
WITH s AS (SELECT sum(avg) AS a_t, coalesce(sum(avg) FILTER (category = 'Mortgage'), 0) AS am,
  coalesce(sum(avg) FILTER (category = 'House'), 0) AS ah, sum(goal) AS gt,
  coalesce(sum(goal) FILTER (category = 'Mortgage'), 0) AS gm,
  coalesce(sum(goal) FILTER (category = 'House'), 0) AS gh FROM bva WHERE category <> 'Other')
SELECT 'Total (monthly)' AS cut, a_t AS actual, gt AS goal FROM s
UNION ALL SELECT 'Annualized', a_t * 12, gt * 12 FROM s
UNION ALL SELECT 'Less Mortgage', (a_t - am) * 12, (gt - gm) * 12 FROM s
UNION ALL SELECT 'Less Mortgage & Home', (a_t - am - ah) * 12, (gt - gm - gh) * 12 FROM s""".replace(
    "WITH s AS", ", s AS"))
def budget_cuts(spark, sf):
    return marts.budget_cuts(bva(spark, sf), ["Other"])


cte("lsums", ["ledger_raw"], """
SELECT category AS tier1, strftime(day, '%Y-%m') AS month, sum(spend) AS spend FROM ledger_raw
WHERE day IS NOT NULL AND spend IS NOT NULL AND spend <> 0
  AND Source IN ('person_1', 'person_2') AND strftime(day, '%Y-%m') >= '1996-01' GROUP BY 1, 2""")
cte("lmonths", ["lsums"], "SELECT month, row_number() OVER (ORDER BY month DESC) AS rn "
                          "FROM (SELECT DISTINCT month FROM lsums)")


@query("ledger_budget", ["lsums", "lmonths"], f"""
SELECT tier1 AS category, avg, CAST(500 AS DOUBLE) AS goal, avg / 500.0 * 100 AS pct_of_goal, avg - 500.0 AS budget_diff
FROM ({trailing_sql(6, 'lsums', 'lmonths')})""")
def ledger_budget(spark, sf):
    ledger = files.parse_ledger(tables.ledger(spark, sf))
    per = files.ledger_sums(ledger, persons=["person_1", "person_2"], date_from="1996-01-15")
    goals = per.select("category").distinct().withColumn("goal", F.lit(500.0))
    return marts.budget_vs_actual(per, goals, 6, "category").drop("ytd_avg")


def first_sql(c):
    return f"arg_min({c}, (date_resolved, transaction_id)) FILTER ({c} IS NOT NULL)"


@query("merchant_table", ["cube"], f"""
SELECT merchant_id, {first_sql('merchant')} AS merchant, coalesce({first_sql('logo_url')}, '') AS logo_url,
  {first_sql('tier1')} AS tier1, {d('sum(spend)')} AS total, CAST(sum(count) AS BIGINT) AS visits,
  min(date_resolved) AS first_date, max(date_resolved) AS last_date,
  round_even({d('sum(spend)')} / sum(count), 2) AS avg
FROM cube WHERE flow = 'spend' GROUP BY 1 HAVING sum(spend) > 0
ORDER BY sum(spend) DESC, merchant_id LIMIT 40""")
def merchant_table(spark, sf):
    return marts.merchant_table(build.cube(spark, sf), ALL)


@query("top_merchants", ["cube"], f"""
SELECT merchant_id, {d('sum(spend)')} AS total FROM cube WHERE flow = 'spend' GROUP BY 1
HAVING sum(spend) > 0 ORDER BY sum(spend) DESC, merchant_id LIMIT 40""")
def top_merchants(spark, sf):
    return marts.merchant_table(build.cube(spark, sf), ALL).select("merchant_id", "total")


@query("recurring_table", ["cube"], f"""
WITH rec AS (SELECT * FROM cube WHERE flow = 'spend' AND recurrence = 'recurring'),
burden AS (SELECT merchant, round_even(avg(s), 2) AS est_monthly FROM (
  SELECT merchant, month, {d('sum(spend)')} AS s FROM rec WHERE month IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT p.*, coalesce(est_monthly, 0.0) AS est_monthly FROM (
SELECT merchant_id, {first_sql('merchant')} AS merchant, {first_sql('tier1')} AS tier1,
  CAST(sum(count) AS BIGINT) AS charges, {d('sum(spend)')} AS total, max(date_resolved) AS last_date,
  round_even({d('sum(spend)')} / sum(count), 2) AS avg_charge FROM rec GROUP BY 1) p
LEFT JOIN burden USING (merchant)""".replace("WITH rec AS", ", rec AS", 1))
def recurring_table(spark, sf):
    return marts.recurring_table(build.cube(spark, sf, True), ALL)


@query("merchant_series", ["cube"], f"""
SELECT month, {d('sum(spend)')} AS spend FROM cube WHERE flow = 'spend' AND merchant = 'Netflix.com'
  AND month IS NOT NULL GROUP BY 1""")
def merchant_series(spark, sf):
    return marts.merchant_series(build.cube(spark, sf), ALL, "Netflix.com")


@query("recurring_next", ["cube"], """
WITH g AS (SELECT merchant_id, day, day - lag(day) OVER (PARTITION BY merchant_id ORDER BY day) AS gap
  FROM (SELECT DISTINCT merchant_id, day FROM cube WHERE recurrence = 'recurring' AND day IS NOT NULL))
SELECT merchant_id, CAST(max(day) AS VARCHAR) AS last_seen,
  CAST(max(day) + CAST(round(median(gap)) AS INTEGER) AS VARCHAR) AS next_expected
FROM g GROUP BY 1""".replace("WITH g AS", ", g AS"))
def recurring_next(spark, sf):
    return marts.recurring_next(build.cube(spark, sf))


@query("necessity_facet", ["cube", "atoms"], f"""
SELECT 'tier0' AS lens, tier0 AS bucket, {d('sum(spend)')} AS spend FROM cube WHERE flow = 'spend'
GROUP BY 2 UNION ALL
SELECT 'necessity', coalesce(l, 'Unknown'), {d('sum(spend)')} FROM (SELECT c.spend,
  CASE WHEN a.tier1 IN ('Mortgage', 'Groceries', 'Healthcare') THEN 'Essential'
    WHEN a.atom IS NOT NULL THEN a.tier0 END AS l
  FROM cube c LEFT JOIN atoms a ON a.atom = c.atom WHERE flow = 'spend') GROUP BY 2""")
def necessity_facet(spark, sf):
    atoms = dims.atoms(spark)
    lens = atoms.select("atom", F.when(F.col("tier1").isin("Mortgage", "Groceries", "Healthcare"),
                                       "Essential").otherwise(F.col("tier0")).alias("necessity"))
    return marts.necessity_lens(build.cube(spark, sf), lens)


@query("synthesized_category", ["cube"], M("""
SELECT geo_scope, geo_country, SPEND AS spend, COUNT AS count, SPEND / COUNT AS avg_ticket
FROM cube WHERE tier1 = 'Travel' AND flow = 'spend' GROUP BY 1, 2"""))
def synthesized_category(spark, sf):
    return cb.rollup(build.cube(spark, sf), GroupingSpec(
        group_by=["geo_scope", "geo_country"], filters={"tier1": "Travel", "flow": "spend"}))


@query("trailing_window_rows", ["cube"], f"""
SELECT transaction_id, {d('spend')} AS spend FROM cube
WHERE day >= (SELECT max(day) FROM cube) - 365""")
def trailing_window_rows(spark, sf):
    return cb.trailing_window_rows(build.cube(spark, sf), 365).select(
        "transaction_id", F.col("spend").cast("double").alias("spend"))


cte("moves", [], """
SELECT 'mv-' || o_orderkey || '-' || leg AS transaction_id, 'acct_' || CASE WHEN leg = 'in' AND o_orderkey % 11 <> 0
    THEN o_custkey + 4 ELSE o_custkey END AS account_id, 'owner_' || (o_custkey % 4) AS txn_owner, FALSE AS pending,
  CAST(CAST(o_orderdate AS DATE) + CAST(CASE WHEN leg = 'in' THEN o_orderkey % 9 ELSE 0 END AS INTEGER) AS VARCHAR) AS date,
  NULL AS authorized_date, 'ONLINE TRANSFER' AS name, NULL AS merchant_name, NULL AS merchant_entity_id,
  NULL AS website, NULL AS logo_url, CASE WHEN leg = 'in' THEN -1 ELSE 1 END * CASE WHEN o_orderkey % 2 = 0
    THEN CAST(100000 * (1 + floor(o_totalprice / 100000)) AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END
    AS amount, 'USD' AS iso_currency_code, NULL AS unofficial_currency_code, 'online' AS payment_channel,
  CASE WHEN leg = 'in' THEN 'TRANSFER_IN' ELSE 'TRANSFER_OUT' END AS pfc_primary,
  CASE WHEN leg = 'in' THEN 'TRANSFER_IN_DEPOSIT' ELSE 'TRANSFER_OUT_SAVINGS' END AS pfc_detailed,
  'HIGH' AS pfc_confidence, NULL AS loc_city, 'US' AS loc_country, NULL AS cp_name
FROM orders, (VALUES ('out'), ('in')) l(leg)""")
cte("move_cube", ["moves", "accounts", "atoms"], cube_sql("moves", BLANK_PROVENANCE))


@query("transfer_netting", ["cube", "move_cube"], """
WITH t AS (SELECT transaction_id AS id, account_id AS a, person, abs_amount, day,
    starts_with(atom, 'TRANSFER_OUT_') AS outgoing
  FROM (SELECT transaction_id, account_id, person, abs_amount, day, atom, flow FROM cube UNION ALL
    SELECT transaction_id, account_id, person, abs_amount, day, atom, flow FROM move_cube)
  WHERE flow = 'excluded' AND starts_with(atom, 'TRANSFER_') AND day IS NOT NULL),
legal AS (SELECT o.person, o.abs_amount, [{'o': o.id, 'i': i.id}] AS pair,
    (abs(o.day - i.day), o.day, i.day, o.a, i.a, o.id, i.id) AS place
  FROM (FROM t WHERE outgoing) o JOIN (FROM t WHERE NOT outgoing) i ON o.person = i.person
    AND o.abs_amount = i.abs_amount AND o.a <> i.a AND o.day BETWEEN i.day - 5 AND i.day + 5),
greedy AS (SELECT person, abs_amount, list_reduce(list(pair ORDER BY place), lambda taken, p:
    CASE WHEN len(list_filter(taken, lambda x: x.o = p[1].o OR x.i = p[1].i)) > 0 THEN taken
      ELSE list_concat(taken, p) END) AS pairs
  FROM legal GROUP BY ALL)
SELECT p.o AS out_id, p.i AS in_id, person, CAST(abs_amount AS DOUBLE) AS amount
FROM (SELECT person, abs_amount, unnest(pairs) AS p FROM greedy)""".replace("WITH t AS", ", t AS"))
def transfer_netting(spark, sf):
    return netting.transfer_netting(transfers(spark, sf))


def transfers(spark, sf):
    """The cube and, enriched like it, the legs of transfers between accounts."""
    legs = enrich.enrich(ingest.canonicalize(tables.move_feed(spark, sf)), tables.accounts(spark, sf), with_recurrence=False)
    return build.cube(spark, sf).unionByName(legs)


@query("label_scorecard", [], f"""
WITH p AS (SELECT lang AS confidence, CASE WHEN toxic = 1 THEN 'repicked' WHEN quality = 1
    THEN 'accepted' ELSE 'not_applied' END AS outcome, n_chars % 3 = 0 AS si
  FROM labels JOIN documents USING (doc_id))
SELECT coalesce(confidence, 'ALL') AS confidence, {n()} AS n,
  count(*) FILTER (outcome = 'accepted') AS n_accepted,
  count(*) FILTER (outcome = 'repicked') AS n_repicked,
  count(*) FILTER (outcome = 'not_applied') AS n_not_applied,
  count(*) FILTER (outcome = 'accepted') / count(*) AS precision,
  count(*) FILTER (si) AS n_sign_impossible FROM p GROUP BY GROUPING SETS ((confidence), ())""")
def label_scorecard(spark, sf):
    rows = tables.read(spark, sf, "labels").join(
        tables.read(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    outcome = (F.when(F.col("toxic") == 1, "repicked").when(F.col("quality") == 1, "accepted")
               .otherwise("not_applied"))
    return marts.label_scorecard(rows.select(
        F.col("lang").alias("confidence"), outcome.alias("outcome"),
        (F.col("n_chars") % 3 == 0).alias("sign_impossible")))
