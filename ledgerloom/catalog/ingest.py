"""Sources, ingest, projections and predicates."""

from pyspark.sql import functions as F

from ledgerloom import dims, fixed, schema
from ledgerloom.catalog import build
from ledgerloom.catalog.base import cte, d, lit, n, query, title_sql, values
from ledgerloom.functions import text
from ledgerloom.operators import ingest, project
from ledgerloom.sources import files, tables

RAW = ["transaction_id", "account_id", "txn_owner", "pending", "date", "authorized_date", "name",
       "merchant_name", "merchant_entity_id"]


def raw_view(df):
    pfc = F.col("personal_finance_category")
    return df.select(*RAW, F.col("amount").cast("double").alias("amount"),
                     pfc["primary"].alias("pfc_primary"), pfc["detailed"].alias("pfc_detailed"))


RAW_SQL = ", ".join(RAW) + f", {d('amount')} AS amount, pfc_primary, pfc_detailed"


@query("scan_multi", ["feed"], f"SELECT {RAW_SQL} FROM feed")
def scan_multi(spark, sf):
    return raw_view(files.union_sources([tables.line_feed(spark, sf),
                                         tables.bill_feed(spark, sf)]))


@query("scan_bytes", [], f"""
SELECT 'u' || user_id AS transaction_id, {d('max(CAST(value AS DECIMAL(18,2)))')} AS top_amount,
  {n()} AS n_rows FROM events GROUP BY 1""")
def scan_bytes(spark, sf):
    """Events packed into text payloads of JSON lines and parsed back; bad lines are counted."""
    e = tables.read(spark, sf, "events")
    line = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string"))
                              .alias("transaction_id"),
                              F.col("value").cast("decimal(18,2)").alias("amount")))
    payloads = e.select(F.concat(line, F.lit("\n\nnot json\n[1]\n")).alias("payload"))
    rows = files.parse_payloads(payloads, "payload", "transaction_id string, amount decimal(18,2)")
    good = rows.filter("parsed.transaction_id IS NOT NULL")
    return good.groupBy(F.col("parsed.transaction_id").alias("transaction_id")).agg(
        F.max("parsed.amount").cast("double").alias("top_amount"),
        F.count(F.lit(1)).alias("n_rows"))


@query("dim_taxonomy", ["cube", "atoms"], f"""
SELECT a.atom, a.tier0, a.tier1, a.tier2, {n('c.atom')} AS n_rows
FROM atoms a LEFT JOIN cube c ON c.atom = a.atom GROUP BY ALL""")
def dim_taxonomy(spark, sf):
    used = build.cube(spark, sf).groupBy("atom").agg(F.count(F.lit(1)).alias("n_rows"))
    return dims.atoms(spark).join(used, "atom", "left").select(
        "atom", "tier0", "tier1", "tier2", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("dim_category", ["settled", "menu"], f"""
SELECT primary_ AS "primary", m.detailed, {n('s.transaction_id')} AS n_rows FROM menu m
LEFT JOIN settled s ON s.pfc_primary = m.primary_ AND s.pfc_detailed = m.detailed GROUP BY ALL""")
def dim_category(spark, sf):
    pfc = F.col("personal_finance_category")
    used = (build.settled(spark, sf).groupBy(pfc["primary"].alias("primary"),
                                             pfc["detailed"].alias("detailed"))
            .agg(F.count(F.lit(1)).alias("n_rows")))
    return dims.category_menu(spark).join(used, ["primary", "detailed"], "left").select(
        "primary", "detailed", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("dim_accounts", ["accounts"], "SELECT * FROM accounts")
def dim_accounts(spark, sf):
    return dims.assert_unique(tables.accounts(spark, sf), "account_id", "accounts")


cte("budget", ["cube"], """
SELECT tier1 AS category, CAST(round(sum(spend) / 80) * 2 AS DOUBLE) AS goal
FROM cube WHERE flow = 'spend' AND tier1 <> 'Travel' GROUP BY 1
UNION ALL SELECT 'Pets' || (c_nationkey % 2), CASE WHEN c_nationkey % 2 = 0 THEN 0.0 ELSE 75.0 END
FROM customer GROUP BY c_nationkey % 2""")


def budget(spark, sf):
    """Monthly goals from the spend itself, with a zero goal, a missing and an unspent one."""
    spend = build.cube(spark, sf).filter((F.col("flow") == "spend") & (F.col("tier1") != "Travel"))
    goals = spend.groupBy(F.col("tier1").alias("category")).agg(
        (F.round(F.sum("spend") / 80) * 2).cast("double").alias("goal"))
    key = F.col("c_nationkey") % 2
    pets = tables.read(spark, sf, "customer").select(key.alias("k")).distinct().select(
        F.concat(F.lit("Pets"), F.col("k").cast("string")).alias("category"),
        F.when(F.col("k") == 0, 0.0).otherwise(75.0).alias("goal"))
    return goals.unionByName(pets)


@query("dim_budget", ["budget"], "SELECT * FROM budget")
def dim_budget(spark, sf):
    return dims.assert_unique(budget(spark, sf), "category", "budget")


cte("rules", [], f"""
SELECT 0 AS part, kind, s_suppkey AS ord, pattern, primary_, detailed, trust, 'personal' AS origin
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 23 = 9 THEN 'shape' ELSE 'keyword' END AS kind,
    CASE WHEN s_suppkey % 29 <> 7 THEN CASE WHEN s_suppkey % 12 = 6 THEN 'acme ' ELSE 'store ' END || translate(CAST(s_suppkey AS VARCHAR),
      '0123456789', 'abcdefghij') END AS pattern,
    list_extract([{', '.join(lit(p[0]) for p in tables.SLOTS)}], (s_suppkey % 24) + 1) AS primary_,
    list_extract([{', '.join(lit(p[1]) for p in tables.SLOTS)}], (s_suppkey % 24) + 1) AS detailed,
    CASE WHEN s_suppkey % 3 = 0 THEN 'auto' ELSE 'flag' END AS trust
  FROM supplier)
WHERE kind = 'keyword' AND pattern IS NOT NULL AND primary_ IS NOT NULL AND detailed IS NOT NULL
UNION ALL SELECT 1, kind, ord, pattern, primary_, detailed, trust, 'built-in' FROM (
{values([(k, i, p, c[0], c[1], t) for i, (k, p, c, t) in enumerate(fixed.RULES)],
        "kind, ord, pattern, primary_, detailed, trust")})""")


def rules(spark, sf):
    return dims.overlay_rules(tables.overlay(spark, sf), dims.rule_table(spark))


@query("dim_rules", ["rules"],
       'SELECT kind, pattern, primary_ AS "primary", detailed, trust, origin FROM rules')
def dim_rules(spark, sf):
    return rules(spark, sf).select("kind", "pattern", "primary", "detailed", "trust", "origin")


@query("canonicalize", ["settled"], f"""
SELECT transaction_id, account_id, txn_owner AS owner, date AS posted_date, authorized_date,
  {d('coalesce(amount, 0)')} AS amount,
  coalesce(nullif(iso_currency_code, ''), unofficial_currency_code) AS currency, pfc_primary,
  pfc_detailed, pfc_confidence, pending, CASE WHEN amount < 0 THEN 'in' ELSE 'out' END AS direction
FROM settled""")
def canonicalize(spark, sf):
    return build.canon(spark, sf).select(
        "transaction_id", "account_id", "owner", "posted_date", "authorized_date",
        F.col("amount").cast("double").alias("amount"), "currency", "pfc_primary",
        "pfc_detailed", "pfc_confidence", "pending", "direction")


def blanks(names):
    return ", ".join(f"'' AS {x}" for x in names.split())


FLAT_SQL = f"""coalesce(txn_owner, '') AS txn_owner, s.account_id, transaction_id,
  CAST(pending AS VARCHAR) AS pending, coalesce(pending_transaction_id, '') AS pending_transaction_id,
  date, coalesce(authorized_date, '') AS authorized_date,
  {blanks('datetime authorized_datetime transaction_code check_number account_owner')},
  s.name, coalesce(original_description, '') AS original_description,
  coalesce(merchant_name, '') AS merchant_name,
  coalesce(merchant_entity_id, '') AS merchant_entity_id, coalesce(website, '') AS website,
  coalesce(logo_url, '') AS logo_url, {d('amount')} AS amount,
  coalesce(iso_currency_code, '') AS iso_currency_code,
  coalesce(unofficial_currency_code, '') AS unofficial_currency_code,
  coalesce(payment_channel, '') AS payment_channel, transaction_type,
  coalesce(pfc_primary, '') AS pf_category_primary,
  coalesce(pfc_detailed, '') AS pf_category_detailed,
  coalesce(pfc_confidence, '') AS pf_category_confidence, pfc_version AS pf_category_version,
  {blanks('pf_category_icon_url location_address location_region location_postal_code')},
  {blanks('location_lat location_lon location_store_number payment_reference_number')},
  {blanks('payment_ppd_id payment_payee payment_by_order_of payment_payer payment_method')},
  {blanks('payment_processor payment_reason')},
  coalesce(loc_city, '') AS location_city, coalesce(loc_country, '') AS location_country,
  coalesce(cp_name, '') AS counterparty_name, coalesce(cp_type, '') AS counterparty_type,
  coalesce(cp_entity, '') AS counterparty_entity_id,
  coalesce(cp_confidence, '') AS counterparty_confidence,
  CASE WHEN has_cp THEN '[{{"name":' || coalesce('"' || cp_name || '"', 'null') ||
    ',"type":"merchant","entity_id":' || coalesce('"' || cp_entity || '"', 'null') ||
    ',"confidence_level":"LOW"}}]' ELSE '' END AS counterparties_json"""
META_BLANK = blanks("institution account_name account_mask account_official_name account_type "
                    "account_subtype")


@query("flatten_record", ["settled"], f"SELECT {FLAT_SQL}, {META_BLANK} FROM settled s")
def flatten_record(spark, sf):
    return project.flatten_record(build.settled(spark, sf)).withColumn(
        "amount", F.col("amount").cast("double"))


def account_meta(spark, sf):
    return tables.accounts(spark, sf).select(
        "account_id", "institution", F.col("name").alias("account_name"),
        F.lit(None).cast("string").alias("account_mask"),
        F.col("person").alias("account_official_name"), F.col("type").alias("account_type"),
        F.col("subtype").alias("account_subtype"))


@query("flatten_with_account", ["settled", "accounts"], f"""
SELECT {FLAT_SQL}, coalesce(a.institution, '') AS institution, coalesce(a.name, '') AS account_name,
  '' AS account_mask, coalesce(a.person, '') AS account_official_name,
  coalesce(a.type, '') AS account_type, coalesce(a.subtype, '') AS account_subtype
FROM settled s LEFT JOIN accounts a ON s.account_id = a.account_id""")
def flatten_with_account(spark, sf):
    return project.flatten_with_account(build.settled_store(spark, sf), account_meta(spark, sf), "transaction_id") \
        .withColumn("amount", F.col("amount").cast("double"))


@query("reviewer_export", ["settled"], f"""
SELECT transaction_id, date, merchant_name, name, original_description, website,
  {d('amount')} AS amount, payment_channel, coalesce(cp_name, '') AS counterparties,
  pfc_primary AS current_primary, pfc_detailed AS current_detailed,
  pfc_confidence AS current_confidence FROM settled""")
def reviewer_export(spark, sf):
    return project.reviewer_export(build.settled(spark, sf)).withColumns({
        "amount": F.col("amount").cast("double"),
        "counterparties": F.array_join("counterparties", "|")})


@query("select_confidence", ["settled"], """
SELECT transaction_id, pfc_confidence FROM settled
WHERE coalesce(upper(pfc_confidence), 'UNKNOWN') IN ('LOW', 'UNKNOWN')""")
def select_confidence(spark, sf):
    return project.select_confidence(build.settled(spark, sf), ("LOW", "UNKNOWN")).select(
        "transaction_id",
        F.col("personal_finance_category")["confidence_level"].alias("pfc_confidence"))


@query("text_search", ["settled"], f"""
SELECT transaction_id, date, {d('amount')} AS amount FROM settled
WHERE contains(lower(coalesce(merchant_name, '') || ' ' || coalesce(name, '') || ' ' ||
  coalesce(original_description, '')), 'starbucks #2')
ORDER BY date, transaction_id LIMIT 10""")
def text_search(spark, sf):
    return project.text_search(build.settled(spark, sf), " STARBUCKS #2 ").select(
        "transaction_id", "date", F.col("amount").cast("double").alias("amount"))


@query("category_valid", ["settled", "menu"], """
SELECT transaction_id, EXISTS (SELECT 1 FROM menu m WHERE m.primary_ = s.pfc_primary
  AND m.detailed = s.pfc_detailed) AS valid FROM settled s""")
def category_valid(spark, sf):
    return project.category_valid(build.canon(spark, sf), dims.category_menu(spark),
                                  "pfc_primary", "pfc_detailed").select("transaction_id", "valid")


cte("other_leaf", ["menu"], """
SELECT primary_ AS op, coalesce(
  min_by(detailed, ord) FILTER (contains(detailed, '_OTHER_') OR ends_with(detailed, '_OTHER')),
  max_by(detailed, ord)) AS other_detailed FROM menu GROUP BY 1""")


@query("snap_to_other", ["lines", "menu", "other_leaf"], """
SELECT v.l_orderkey || '-' || v.l_linenumber AS transaction_id, p AS "primary",
  CASE WHEN m.detailed IS NOT NULL THEN m.detailed ELSE other_detailed END AS detailed
FROM (SELECT *, list_extract(['TRAVEL', 'INCOME', 'NOWHERE', 'MEDICAL', 'LOAN_PAYMENTS'],
    (l_partkey % 5) + 1) AS p,
  list_extract(['TRAVEL_FLIGHTS', 'INCOME_WAGES', 'MEDICAL_WINGS'], (l_suppkey % 3) + 1) AS dd
  FROM lineitem) v LEFT JOIN menu m ON m.primary_ = p AND m.detailed = dd
LEFT JOIN other_leaf ON op = p""")
def snap_to_other(spark, sf):
    c = F.col
    rows = tables.read(spark, sf, "lineitem").select(
        F.concat(c("l_orderkey").cast("string"), F.lit("-"), c("l_linenumber").cast("string"))
        .alias("transaction_id"),
        F.get(F.array(*[F.lit(x) for x in ("TRAVEL", "INCOME", "NOWHERE", "MEDICAL",
                                           "LOAN_PAYMENTS")]),
              (c("l_partkey") % 5).cast("int")).alias("primary"),
        F.get(F.array(*[F.lit(x) for x in ("TRAVEL_FLIGHTS", "INCOME_WAGES", "MEDICAL_WINGS")]),
              (c("l_suppkey") % 3).cast("int")).alias("detailed"))
    return project.snap_to_other(rows, dims.category_menu(spark))


@query("sign_guard", ["settled"], """
SELECT transaction_id, coalesce(amount > 0 AND pfc_primary IN ('INCOME', 'TRANSFER_IN'), FALSE)
  AS violation FROM settled""")
def sign_guard(spark, sf):
    return build.canon(spark, sf).select(
        "transaction_id", project.sign_violation("amount", "pfc_primary").alias("violation"))


@query("dedupe_last", ["deduped"], f"SELECT {RAW_SQL} FROM deduped")
def dedupe_last(spark, sf):
    return raw_view(build.deduped(spark, sf))


@query("drop_settled_pending", ["settled"], f"SELECT {RAW_SQL} FROM settled")
def drop_settled_pending(spark, sf):
    return raw_view(build.settled(spark, sf))


@query("ingest_counts", ["feed", "deduped", "settled"], f"""
SELECT {n()} AS n_loaded, (SELECT {n()} FROM feed) - (SELECT {n()} FROM deduped)
    AS n_duplicate_ids_dropped,
  (SELECT {n()} FROM deduped) - (SELECT {n()} FROM settled) AS n_settled_pending_dropped,
  (SELECT {n()} FROM settled) AS n_transactions,
  (SELECT {n()} FROM settled WHERE pending) AS n_pending_remaining FROM feed""")
def ingest_counts(spark, sf):
    return ingest.ingest_counts(tables.raw_feed(spark, sf))


@query("last_per_key", [], f"""
SELECT 'u' || user_id AS transaction_id, arg_max(event_type, event_id) AS event_type,
  max(event_id) AS event_id FROM events GROUP BY user_id""")
def last_per_key(spark, sf):
    e = tables.read(spark, sf, "events").select("event_id", "event_type", "user_id")
    return ingest.last_per_key(e, "user_id", "event_id").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("transaction_id"),
        "event_type", "event_id")


# scalar functions ---------------------------------------------------------------------------


@query("fn_null_safe_get", ["settled"], """
SELECT transaction_id, loc_city AS city, cp_name AS party FROM settled""")
def fn_null_safe_get(spark, sf):
    return build.settled(spark, sf).select(
        "transaction_id", F.col("location")["city"].alias("city"),
        F.get("counterparties", F.lit(0))["name"].alias("party"))


@query("fn_blank", ["settled"], """
SELECT transaction_id, coalesce(website, '') AS website, CASE WHEN lower(trim(v)) IN
  ('none', 'nan', '') OR v IS NULL THEN '' ELSE v END AS shown
FROM (SELECT *, CASE WHEN s3 % 5 = 0 THEN 'None' WHEN s3 % 5 = 1 THEN ' NaN ' ELSE logo_url END AS v
  FROM settled)""")
def fn_blank(spark, sf):
    k = F.col("seq.l_suppkey") % 5
    v = F.when(k == 0, "None").when(k == 1, " NaN ").otherwise(F.col("logo_url"))
    return build.settled(spark, sf).select("transaction_id", text.blank("website").alias("website"),
                                           text.blank_if_missing(v).alias("shown"))


@query("fn_slug", ["settled"], """
SELECT DISTINCT name, coalesce(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'),
  '^_+|_+$', '', 'g'), '') AS slug FROM settled""")
def fn_slug(spark, sf):
    return build.settled(spark, sf).select("name", text.slug("name").alias("slug")).distinct()


@query("fn_title", ["settled"], f"""
SELECT DISTINCT pfc_detailed, {title_sql('pfc_detailed')} AS title,
  replace(coalesce(pfc_detailed, ''), '_', ' ') AS shown FROM settled""")
def fn_title(spark, sf):
    return build.canon(spark, sf).select(
        "pfc_detailed", text.title("pfc_detailed").alias("title"),
        text.humanize_atom("pfc_detailed").alias("shown")).distinct()


@query("fn_humanize_atom", ["cube"], """
SELECT atom, replace(atom, '_', ' ') AS shown, CAST(count(*) AS BIGINT) AS n_rows
FROM cube GROUP BY 1""")
def fn_humanize_atom(spark, sf):
    return build.cube(spark, sf).groupBy("atom").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "atom", text.humanize_atom("atom").alias("shown"), "n_rows")


@query("fn_humanize_tier2", ["settled", "atoms"], """
SELECT DISTINCT pfc_detailed, tier2 FROM settled JOIN atoms ON atom = pfc_detailed""")
def fn_humanize_tier2(spark, sf):
    known = dims.atoms(spark).select(F.col("atom").alias("pfc_detailed"))
    return (build.canon(spark, sf).join(known, "pfc_detailed", "left_semi")
            .select("pfc_primary", "pfc_detailed").distinct()
            .select("pfc_detailed", text.humanize_tier2("pfc_detailed", "pfc_primary")
                    .alias("tier2")))


@query("fn_glob", ["settled"], """
SELECT transaction_id, coalesce(regexp_matches(pfc_detailed, '^(TRANSFER_.*|.*_PAYMENT|INCOME_.AGES)$'),
  FALSE) AS hit FROM settled""")
def fn_glob(spark, sf):
    return build.canon(spark, sf).select("transaction_id", text.glob_match(
        "pfc_detailed", ["TRANSFER_*", "*_PAYMENT", "INCOME_?AGES"]).alias("hit"))


@query("fn_iso_week", [], """
SELECT DISTINCT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, strftime(l_shipdate, '%G-W%V') AS week,
  strftime(l_shipdate, '%a') AS dow FROM lineitem""")
def fn_iso_week(spark, sf):
    day = tables.read(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    return day.distinct().select(F.col("d").cast("string").alias("day"),
                                 text.iso_week("d").alias("week"),
                                 F.date_format("d", "E").alias("dow"))


@query("fn_last_complete_month", [], """
SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
  strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m') AS month FROM orders""")
def fn_last_complete_month(spark, sf):
    day = tables.read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return day.distinct().select(F.col("d").cast("string").alias("day"),
                                 text.last_complete_month("d").alias("month"))


@query("fn_csv_safe", ["settled"], f"""
SELECT transaction_id, CASE WHEN left(v, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || v ELSE v END AS cell,
  {d('amount')} AS amount
FROM (SELECT *, list_extract(['=cmd()', '+1', 'safe', '-2', '@x', '\t', NULL], (s3 % 7) + 1) AS v
  FROM settled)""")
def fn_csv_safe(spark, sf):
    v = F.get(F.array(*[F.lit(x) for x in ("=cmd()", "+1", "safe", "-2", "@x", "\t", None)]),
              (F.col("seq.l_suppkey") % 7).cast("int"))
    return text.csv_safe_frame(build.settled(spark, sf).select(
        "transaction_id", v.alias("cell"), F.col("amount").cast("double").alias("amount")))


cte("ledger_raw", [], """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 <> 0 THEN 'person_' || (o_custkey % 4) END AS Source,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day,
  o_orderpriority AS category,
  CASE WHEN o_orderkey % 23 = 0 THEN 0.00 WHEN o_orderkey % 29 = 0 THEN NULL
    WHEN o_orderkey % 3 = 0 THEN -CAST(o_totalprice AS DECIMAL(18,2))
    ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS spend FROM orders""")


@query("fn_money_parse", ["ledger_raw"], f"""
SELECT 'order ' || k AS description, {d('spend')} AS spend FROM ledger_raw""")
def fn_money_parse(spark, sf):
    return tables.ledger(spark, sf).select(
        F.col("Description").alias("description"),
        text.money("Debit Less Credit").cast("double").alias("spend"))


@query("scan_ledger_csv", ["ledger_raw"], f"""
SELECT coalesce(Source, '') AS person, strftime(day, '%Y-%m') AS month, category, {d('spend')} AS spend
FROM ledger_raw WHERE day IS NOT NULL AND spend IS NOT NULL AND spend <> 0""")
def scan_ledger_csv(spark, sf):
    return files.parse_ledger(tables.ledger(spark, sf)).withColumn(
        "spend", F.col("spend").cast("double"))


@query("fn_parse_date", ["settled"], """
SELECT DISTINCT authorized_date AS value,
  CAST(CAST(try_strptime(substr(authorized_date, 1, 10), '%Y-%m-%d') AS DATE) AS VARCHAR) AS day
FROM settled""")
def fn_parse_date(spark, sf):
    return build.settled(spark, sf).select(
        F.col("authorized_date").alias("value"),
        text.parse_date("authorized_date").cast("string").alias("day")).distinct()


CANON_SQL = """'"' || replace(replace({0}, '\\', '\\\\'), '"', '\\"') || '"'"""


def _c(x):
    return f"coalesce({CANON_SQL.format(x)}, 'null')"


def hash_sql():
    """Canonical text of one feed row, columns by name."""
    null = "'null'"
    parts = {n: null for n in schema.TXN_COLUMNS if n not in schema.NON_SOURCE_COLUMNS}
    for x in ("transaction_id account_id pending_transaction_id date authorized_date name "
              "original_description merchant_name merchant_entity_id website logo_url "
              "iso_currency_code unofficial_currency_code payment_channel "
              "transaction_type").split():
        parts[x] = _c(x)
    parts["pending"] = "CAST(pending AS VARCHAR)"
    parts["amount"] = "CAST(amount AS VARCHAR)"
    parts["personal_finance_category"] = (
        "'{' || 'confidence_level:' || " + _c("pfc_confidence") + " || ',detailed:' || "
        + _c("pfc_detailed") + " || ',primary:' || " + _c("pfc_primary") + " || ',version:' || "
        + _c("pfc_version") + " || '}'")
    parts["location"] = ("'{address:null,city:' || " + _c("loc_city") + " || ',country:' || "
                         + _c("loc_country") + " || ',lat:null,lon:null,postal_code:null,"
                         "region:null,store_number:null}'")
    parts["counterparties"] = (
        "CASE WHEN has_cp THEN '[{confidence_level:' || " + _c("cp_confidence")
        + " || ',entity_id:' || " + _c("cp_entity") + " || ',name:' || " + _c("cp_name")
        + " || ',type:' || " + _c("cp_type") + " || '}]' ELSE 'null' END")
    body = " || ',' || ".join(f"'{x}:' || {parts[x]}" for x in sorted(parts))
    return f"sha256({body})"


@query("content_hash", ["settled"], f"SELECT transaction_id, {hash_sql()} AS h FROM settled")
def content_hash(spark, sf):
    df = build.settled(spark, sf)
    cols = [c for c in schema.TXN_COLUMNS if c not in schema.NON_SOURCE_COLUMNS]
    return df.select("transaction_id", text.content_hash(df, cols).alias("h"))


@query("fn_sha256_canonical", [], """
SELECT event_id, sha256('event_type:"' || event_type || '",user_id:' || user_id) AS h FROM events""")
def fn_sha256_canonical(spark, sf):
    e = tables.read(spark, sf, "events")
    return e.select("event_id", text.content_hash(e, ["user_id", "event_type"]).alias("h"))


@query("fn_avg_or_zero", [], """
SELECT o_orderkey, CASE WHEN sz <> 0 THEN o_totalprice / sz ELSE 0.0 END AS ratio
FROM (SELECT *, o_custkey % 5 AS sz FROM orders)""")
def fn_avg_or_zero(spark, sf):
    return tables.read(spark, sf, "orders").select("o_orderkey", text.ratio_or_zero(
        F.col("o_totalprice"), F.col("o_custkey") % 5).alias("ratio"))
