"""Registry of queries, each with an equivalent SQL text over the same tables."""

from ledgerloom import fixed
from ledgerloom.sources import tables

QUERIES = {}
ORACLES = {}
CTES = {}
KEPT = ("deduped", "settled", "cube")  # wide results that several parts of a statement read


def cte(name, needs, sql):
    CTES[name] = (needs, sql)


def with_ctes(needs, sql):
    """The statement with every common table expression it needs, in dependency order."""
    order = []

    def visit(name):
        if name not in order:
            for dep in CTES[name][0]:
                visit(dep)
            order.append(name)

    for name in needs:
        visit(name)
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}(\n{CTES[n][1].strip()}\n)" for n in order)
    body = sql.strip()
    glue = "" if body.startswith(",") else "\n"
    return f"WITH {head}{glue}{body}" if order else body


def query(name, needs=(), sql=None):
    """Registers a (spark, sf_dir) -> DataFrame function, with its SQL twin if there is one."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(list(needs), sql)
        return fn

    return register


def lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def values(rows, columns):
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


def slot_sql(index, part):
    body = ", ".join(lit(p[part]) for p in tables.SLOTS)
    return f"list_extract([{body}]::VARCHAR[], ({index})::BIGINT + 1)"


N = len(tables.SLOTS)


def letters_sql(k):
    return f"translate(CAST({k} AS VARCHAR), '0123456789', 'abcdefghij')"


def label_sql(k):
    return f"""(CASE {k} % 12 WHEN 0 THEN 'Uber Eats' WHEN 1 THEN 'UBER'
      WHEN 2 THEN 'STARBUCKS #' || {k} WHEN 3 THEN 'DoorDash' WHEN 4 THEN 'Shell Oil ' || {k}
      WHEN 5 THEN 'Netflix.com' WHEN 6 THEN 'Acme ' || {letters_sql(k)} || ' LLC'
      ELSE 'Store ' || {letters_sql(k)} END)"""


def merchant_sql(k):
    return f"(CASE WHEN {k} % 7 = 0 THEN NULL ELSE {label_sql(k)} END)"


def entity_sql(k):
    return f"(CASE WHEN {k} % 5 = 0 THEN NULL ELSE 'ent_' || {k} END)"


def norm_sql(x):
    s = f"lower(coalesce({x}, ''))"
    s = f"regexp_replace({s}, '(^|[^a-z])x{{2,}}', '\\1 ', 'g')"
    s = (f"regexp_replace({s}, '(\\d{{2,}}|#\\w+|\\*|\\bna\\b|\\bllc\\b|\\binc\\b|"
         f"\\bending in.*|\\bpay date.*|\\breg shs.*|\\bid:.*|\\bref:.*)', ' ', 'g')")
    s = f"regexp_replace({s}, '[^a-z\\s]', ' ', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def slug_sql(x):
    return (f"coalesce(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'),"
            f" '^_+|_+$', '', 'g'), '')")


def title_sql(x):
    return (f"array_to_string(list_transform(string_split(lower(replace({x}, '_', ' ')), ' '), "
            f"lambda w: upper(w[1]) || w[2:]), ' ')")


def d(x):
    return f"CAST({x} AS DOUBLE)"


def n(x="*"):
    return f"CAST(count({x}) AS BIGINT)"


_IDX = f"(CASE WHEN l_suppkey % 6 = 1 THEN l_suppkey % {N} ELSE (l_partkey*7 + l_linenumber) % {N} END)"

cte("lines", [], f"""
SELECT l_orderkey || '-' || l_linenumber AS transaction_id, 'acct_' || o_custkey AS account_id,
  CASE WHEN o_custkey % 10 <> 0 THEN 'owner_' || (o_custkey % 4) END AS txn_owner,
  (l_linestatus = 'O' AND l_linenumber = 1) AS pending,
  CASE WHEN l_linenumber = 2 THEN l_orderkey || '-1' END AS pending_transaction_id,
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN l_orderkey % 17 = 0 THEN ''
       WHEN l_orderkey % 997 = 1 THEN 'not a date'
       ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS authorized_date,
  (CASE p_size % 10 WHEN 0 THEN 'TST* ' WHEN 1 THEN 'COT*FLT ' WHEN 2 THEN 'COT*HTL ' ELSE '' END)
    || upper(p_name) || ' #' || l_orderkey AS name,
  CASE WHEN l_linenumber <> 3 THEN
  (CASE p_size % 10 WHEN 0 THEN 'TST* ' WHEN 1 THEN 'COT*FLT ' WHEN 2 THEN 'COT*HTL ' ELSE '' END)
    || upper(p_name) || ' #' || l_orderkey || ' CARD XXXX' || (l_partkey % 100) END
    AS original_description,
  {merchant_sql('l_suppkey')} AS merchant_name, {entity_sql('l_suppkey')} AS merchant_entity_id,
  CASE l_suppkey % 12 WHEN 1 THEN 'uber.com' WHEN 3 THEN 'www.DoorDash.com'
    WHEN 5 THEN 'netflix.com' WHEN 7 THEN 'amazon.com' WHEN 8 THEN '' END AS website,
  CASE WHEN l_suppkey % 4 = 0 THEN 'https://logo.test/' || l_suppkey END AS logo_url,
  CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2))
       ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount,
  CASE WHEN n_nationkey % 3 <> 0 THEN CASE WHEN r_name = 'AMERICA' THEN 'USD' ELSE 'eur' END END
    AS iso_currency_code,
  CASE WHEN n_nationkey % 3 = 0 THEN 'usd' END AS unofficial_currency_code,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'in store'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'online'
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'other' END AS payment_channel,
  'place' AS transaction_type, {slot_sql(_IDX, 0)} AS pfc_primary, {slot_sql(_IDX, 1)} AS pfc_detailed,
  list_extract(['LOW','MEDIUM','HIGH','VERY_HIGH',NULL,'low'], (l_partkey % 6)::BIGINT + 1)
    AS pfc_confidence, 'v2' AS pfc_version,
  CASE WHEN o_custkey % 9 <> 0 THEN 'City_' || (o_custkey % 50) END AS loc_city,
  CASE WHEN r_name = 'AMERICA' THEN 'US' WHEN r_name = 'AFRICA' THEN NULL
       WHEN n_nationkey = 2 THEN '' ELSE n_name END AS loc_country,
  l_suppkey % 7 = 0 AS has_cp,
  CASE WHEN l_suppkey % 7 = 0 AND l_suppkey % 2 = 0 THEN 'CP ' || {letters_sql('l_suppkey')} END
    AS cp_name,
  CASE WHEN l_suppkey % 7 = 0 THEN 'merchant' END AS cp_type,
  CASE WHEN l_suppkey % 7 = 0 THEN {entity_sql('l_suppkey')} END AS cp_entity,
  CASE WHEN l_suppkey % 7 = 0 THEN 'LOW' END AS cp_confidence,
  l_shipdate AS s1, l_partkey AS s2, l_suppkey AS s3, l_quantity AS s4, l_extendedprice AS s5,
  l_discount AS s6, l_tax AS s7, l_returnflag AS s8, l_linestatus AS s9
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""")

_BIDX = "(CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE 17 END)"

cte("bills", [], f"""
SELECT 'bill-' || c_custkey || '-' || k AS transaction_id, 'acct_' || c_custkey AS account_id,
  CASE WHEN c_custkey % 10 <> 0 THEN 'owner_' || (c_custkey % 4) END AS txn_owner,
  FALSE AS pending, NULL AS pending_transaction_id,
  CAST(DATE '2000-01-01' + CAST(c_custkey % 28 + k * (CASE c_custkey % 4 WHEN 1 THEN 14
    WHEN 2 THEN 7 WHEN 3 THEN 50 ELSE 30 END) AS INTEGER) AS VARCHAR) AS date,
  NULL AS authorized_date, 'BILL ' || {letters_sql('c_custkey')} AS name,
  NULL AS original_description, 'Utility ' || {letters_sql('c_custkey')} AS merchant_name,
  'bill_' || c_custkey AS merchant_entity_id, NULL AS website, NULL AS logo_url,
  CAST(20 + c_custkey % 80 + (CASE WHEN c_custkey % 5 = 0 THEN k * k * 40 ELSE k % 3 END)
    AS DECIMAL(18,2)) AS amount, 'USD' AS iso_currency_code, NULL AS unofficial_currency_code,
  'online' AS payment_channel, 'special' AS transaction_type, {slot_sql(_BIDX, 0)} AS pfc_primary,
  {slot_sql(_BIDX, 1)} AS pfc_detailed, 'VERY_HIGH' AS pfc_confidence, 'v2' AS pfc_version,
  NULL AS loc_city, 'US' AS loc_country, FALSE AS has_cp, NULL AS cp_name, NULL AS cp_type,
  NULL AS cp_entity, NULL AS cp_confidence, NULL AS s1, NULL AS s2, NULL AS s3, NULL AS s4,
  NULL AS s5, NULL AS s6, NULL AS s7, NULL AS s8, NULL AS s9
FROM customer, range({tables.BILL_MONTHS}) r(k)""")

cte("feed", ["lines", "bills"], "SELECT * FROM lines UNION ALL SELECT * FROM bills")

cte("deduped", ["feed"], """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
  ORDER BY s1 DESC, s2 DESC, s3 DESC, s4 DESC, s5 DESC, s6 DESC, s7 DESC, s8 DESC, s9 DESC) AS rn
  FROM feed) WHERE rn = 1""")

cte("settled", ["deduped"], """
SELECT d.* FROM deduped d LEFT JOIN (SELECT DISTINCT pending_transaction_id AS ref FROM deduped
  WHERE NOT pending AND pending_transaction_id IS NOT NULL) r
  ON d.pending AND d.transaction_id = r.ref WHERE r.ref IS NULL""")

cte("atoms_base", [], values([(p, a) for p, a in fixed.atom_pairs()], "primary_, atom"))
cte("menu", [], values([(i, p, a) for i, (p, a) in enumerate(fixed.menu_pairs())],
                       "ord, primary_, detailed"))
_t0 = " ".join(f"WHEN {lit(p)} THEN {lit(t[0])}" for p, t in fixed.PRIMARY_TIERS.items())
_t1 = " ".join(f"WHEN {lit(p)} THEN {lit(t[1])}" for p, t in fixed.PRIMARY_TIERS.items())
_o0 = " ".join(f"WHEN {lit(p)} THEN {lit(t[0])}" for p, t in fixed.ATOM_TIERS.items())
_o1 = " ".join(f"WHEN {lit(p)} THEN {lit(t[1])}" for p, t in fixed.ATOM_TIERS.items())
cte("atoms", ["atoms_base"], f"""
SELECT atom, CASE atom {_o0} ELSE CASE primary_ {_t0} ELSE 'Discretionary' END END AS tier0,
  CASE atom {_o1} ELSE CASE primary_ {_t1} ELSE 'Other' END END AS tier1,
  CASE WHEN suffix LIKE 'OTHER\\_%' ESCAPE '\\' OR suffix = 'OTHER' THEN 'Other' ELSE
    array_to_string(list_transform(list_filter(string_split(replace(suffix, '_AND_', ' & '), '_'),
      lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS tier2
FROM (SELECT *, CASE WHEN starts_with(atom, primary_ || '_') THEN substr(atom, length(primary_) + 2)
      ELSE atom END AS suffix FROM atoms_base)""")

cte("accounts", [], """
SELECT 'acct_' || c_custkey AS account_id,
  CASE WHEN c_custkey % 20 <> 0 THEN 'person_' || (c_custkey % 4) END AS person,
  'Account ' || c_custkey AS name,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'credit' ELSE 'depository' END AS type,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'credit card' ELSE 'checking' END AS subtype,
  'Bank ' || c_nationkey AS institution, c_custkey % 25 <> 3 AS include
FROM customer WHERE c_custkey % 30 <> 7""")

_fb0 = "CASE pfc_primary " + " ".join(f"WHEN {lit(p)} THEN {lit(t)}" for p, t in
                                      fixed.UNMAPPED_TIER0.items()) + " ELSE 'Discretionary' END"


def cube_sql(source, extra):
    """Enriched rows of a settled source that carries the provenance columns of `extra`."""
    name = "coalesce(nullif(s.merchant_name, ''), nullif(cp_name, ''))"
    return f"""
WITH t AS (
  SELECT s.transaction_id, s.account_id, s.name, s.amount, abs(s.amount) AS abs_amount,
    pfc_primary, pfc_detailed, coalesce(nullif(pfc_confidence, ''), 'UNKNOWN') AS confidence,
    CASE WHEN pfc_detailed LIKE 'TRANSFER\\_IN\\_%' ESCAPE '\\'
           OR pfc_detailed LIKE 'TRANSFER\\_OUT\\_%' ESCAPE '\\'
           OR pfc_detailed = 'LOAN_PAYMENTS_CREDIT_CARD_PAYMENT' THEN 'excluded'
         WHEN s.amount < 0 THEN 'income' ELSE 'spend' END AS flow,
    coalesce(pfc_detailed, 'OTHER_OTHER') AS atom, a.atom IS NULL AS unmapped,
    coalesce(a.tier0, {_fb0}) AS tier0,
    CASE WHEN regexp_matches(coalesce(s.merchant_name, ''), '(?i)uber\\s*eats|doordash|grubhub')
      THEN 'Dining Out' ELSE coalesce(a.tier1, {title_sql("coalesce(pfc_primary, 'OTHER')")})
      END AS tier1,
    CASE WHEN regexp_matches(coalesce(s.merchant_name, ''), '(?i)uber\\s*eats|doordash|grubhub')
      THEN 'Restaurant' ELSE coalesce(a.tier2, 'Other') END AS tier2,
    coalesce({name}, nullif(s.name, ''), 'Unknown') AS merchant, {name} AS merchant_brand,
    coalesce(nullif(merchant_entity_id, ''), nullif({slug_sql(name)}, ''), 'unknown') AS merchant_id,
    (loc_country IS NOT NULL AND loc_country <> 'US')
      OR upper(coalesce(nullif(iso_currency_code, ''), nullif(unofficial_currency_code, ''), 'USD')) <> 'USD'
      AS abroad, loc_country, coalesce(nullif(loc_city, ''), 'Unknown') AS geo_city,
    coalesce(nullif(authorized_date, ''), date) AS date_resolved,
    coalesce(nullif(txn_owner, ''), ac.person, 'Unknown') AS person,
    coalesce(nullif(payment_channel, ''), 'unknown') AS channel,
    coalesce(ac.type, 'unknown') AS account_type,
    coalesce(ac.name, substr(s.account_id, 1, 8)) AS account_name,
    coalesce(ac.institution, 'Unknown') AS institution, logo_url, website, pending, {extra}
  FROM {source} s LEFT JOIN accounts ac ON s.account_id = ac.account_id
  LEFT JOIN atoms a ON a.atom = coalesce(pfc_detailed, 'OTHER_OTHER')
  WHERE coalesce(ac.include, TRUE)),
u AS (SELECT *, CAST(try_strptime(substr(date_resolved, 1, 10), '%Y-%m-%d') AS DATE) AS day,
    CASE WHEN flow = 'spend' THEN abs_amount ELSE 0 END AS spend,
    CASE WHEN flow = 'income' THEN abs_amount ELSE 0 END AS income, 1 AS count,
    CASE WHEN abroad THEN 'International' ELSE 'Domestic' END AS geo_scope,
    coalesce(nullif(loc_country, ''), CASE WHEN abroad THEN 'Unknown' ELSE 'US' END) AS geo_country
  FROM t),
dated AS (SELECT *, CAST(year(day) AS INTEGER) AS year, 'Q' || quarter(day) AS quarter,
    strftime(day, '%Y-%m') AS month, strftime(day, '%G-W%V') AS week, strftime(day, '%a') AS dow,
    tier0 AS necessity FROM u),
g AS (SELECT merchant_id, day, day - lag(day) OVER (PARTITION BY merchant_id ORDER BY day) AS gap
  FROM (SELECT DISTINCT merchant_id, day FROM dated WHERE flow = 'spend' AND day IS NOT NULL
        AND merchant_id NOT IN ('', 'unknown'))),
gm AS (SELECT merchant_id, count(gap) AS n_gaps, median(gap) AS med, max(gap) - min(gap) AS spread,
    max(day) AS last_day FROM g GROUP BY merchant_id),
am AS (SELECT merchant_id, count(*) AS n, count(day) AS nd,
    CASE WHEN sum(abs_amount) <> 0 THEN stddev_samp(CAST(abs_amount AS DOUBLE)) /
      (CAST(sum(abs_amount) AS DOUBLE) / count(*)) ELSE 1.0 END AS cv
  FROM dated WHERE flow = 'spend' GROUP BY merchant_id),
rec AS (SELECT gm.merchant_id FROM gm JOIN am USING (merchant_id)
  WHERE n >= 3 AND nd >= 3 AND n_gaps >= 2 AND spread <= med AND cv < 0.35 AND
    (abs(med - 7) <= 3 OR abs(med - 14) <= 4 OR abs(med - 30) <= 6 OR abs(med - 90) <= 12))
SELECT dated.*, CASE WHEN flow = 'spend' AND merchant_id IN (SELECT merchant_id FROM rec)
  THEN 'recurring' ELSE 'one-off' END AS recurrence FROM dated"""


BLANK_PROVENANCE = ", ".join(
    [f"'' AS {c}" for c in ("category_update_step", "category_update_reason",
                            "category_update_confidence", "review_primary", "review_detailed",
                            "review_reason", "review_source")]
    + ["NULL::VARCHAR AS original_pf_primary", "NULL::VARCHAR AS original_pf_detailed",
       "FALSE AS review_pending"])

cte("cube", ["settled", "accounts", "atoms"], cube_sql("settled", BLANK_PROVENANCE))
