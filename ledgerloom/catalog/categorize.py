"""Rules, authority, provenance, review and audit sweeps."""

from pyspark.sql import functions as F

from ledgerloom import dims, fixed
from ledgerloom.catalog import build
from ledgerloom.catalog.base import (BLANK_PROVENANCE, cte, cube_sql, d, entity_sql, label_sql, lit, n,
                                     norm_sql, query, slot_sql)
from ledgerloom.catalog.ingest import rules as rule_dim
from ledgerloom.functions import text
from ledgerloom.operators import authority, enrich, ingest, project, rules, sweeps
from ledgerloom.plans import lineage
from ledgerloom.sources import tables

RUN = "2026-01-01T00:00:00.000000+00:00"
TODAY = "2001-12-01"


def _kind(kind):
    return [(p, pair, t) for k, p, pair, t in fixed.RULES if k == kind]


def _number(kind, test):
    """SQL text: which rule of a kind is the first that matches, from 1."""
    return "CASE " + " ".join(f"WHEN {test(p)} THEN {i}" for i, (p, _, _) in enumerate(_kind(kind), 1)) + " END"


def _looked_up(kind, number):
    """SQL texts: primary, detailed, rule name and trust of a rule by its number."""
    mine, shown = _kind(kind), (lambda p: "pos:" + p.lower().rstrip("*")) if kind == "pos_prefix" else (lambda p: f"{kind}:{p}")
    parts = zip(*[(pair[0], pair[1], shown(p), t) for p, pair, t in mine])
    return [f"list_extract([{', '.join(lit(x) for x in part)}], {number})" for part in parts]


cte("memory", [], f"""
SELECT 'ent:' || {entity_sql('s_suppkey')} AS key, {slot_sql('(s_suppkey * 5 + 3) % 24', 0)} AS mp,
  {slot_sql('(s_suppkey * 5 + 3) % 24', 1)} AS md FROM supplier
WHERE s_suppkey % 5 <> 0 AND s_suppkey % 4 = 1
UNION ALL SELECT key, {slot_sql('(k * 5 + 3) % 24', 0)}, {slot_sql('(k * 5 + 3) % 24', 1)} FROM (
  SELECT 'name:' || {norm_sql(label_sql('s_suppkey'))} AS key, max(s_suppkey) AS k FROM supplier
  WHERE s_suppkey % 7 <> 0 AND s_suppkey % 9 = 2 GROUP BY 1)""")

_POS, _WEB, _KW = _looked_up("pos_prefix", "n2"), _looked_up("website", "n3"), _looked_up("keyword", "n4")

# the regular expression runs only where the plain word occurs
cte("hits", ["settled", "memory", "rules", "menu"], f"""
WITH norms AS (SELECT merchant_name, 'name:' || nullif({norm_sql('merchant_name')}, '') AS nk
  FROM (SELECT DISTINCT merchant_name FROM settled)),
t AS (SELECT s.*, nk, lower(coalesce(name, '')) || ' ' || lower(coalesce(original_description, '')) AS pos_text,
    lower(concat_ws(' ', nullif(s.merchant_name, ''), nullif(name, ''), nullif(original_description, ''))) AS word_text
  FROM settled s LEFT JOIN norms ON s.merchant_name = norms.merchant_name),
words AS (SELECT transaction_id, word_text, unnest(list_distinct(
    string_split(regexp_replace(word_text, '[^a-z0-9]+', ' ', 'g'), ' '))) AS word FROM t),
over_ AS (SELECT transaction_id, arg_min(primary_, ord) AS kp, arg_min(detailed, ord) AS kd,
    arg_min('keyword:' || pattern, ord) AS kr, arg_min(trust, ord) AS kt
  FROM words JOIN (SELECT *, string_split(pattern, ' ')[-1] AS last FROM rules WHERE part = 0) r ON word = last
  WHERE contains(word_text, pattern) AND regexp_matches(word_text, '(^|[^a-z0-9])' || pattern || '([^a-z0-9]|$)') GROUP BY 1),
c AS (SELECT t.*, coalesce(e.mp, m.mp) AS p1, coalesce(e.md, m.md) AS d1,
    CASE WHEN e.key IS NOT NULL THEN 'memory:entity_id' WHEN m.key IS NOT NULL THEN 'memory:name'
      END AS r1, CASE WHEN e.key IS NOT NULL THEN 'auto' WHEN m.key IS NOT NULL THEN 'flag' END AS t1,
    e.key AS e_key, m.key AS m_key, kp, kd, kr, kt,
    {_number("pos_prefix", lambda p: f"contains(pos_text, {lit(p.lower())})")} AS n2,
    {_number("website", lambda p: f"contains(lower(coalesce(website, '')), {lit(p)})")} AS n3,
    CASE WHEN kr IS NULL THEN {_number("keyword", lambda p: f"CASE WHEN contains(word_text, {lit(p)}) THEN "
                                       f"regexp_matches(word_text, '(^|[^a-z0-9]){p}([^a-z0-9]|$)') END")} END AS n4
  FROM t LEFT JOIN memory e ON e.key = 'ent:' || t.merchant_entity_id
  LEFT JOIN memory m ON m.key = t.nk LEFT JOIN over_ ON over_.transaction_id = t.transaction_id),
k AS (SELECT *, {_POS[0]} AS p2, {_POS[1]} AS d2, {_POS[2]} AS r2, {_POS[3]} AS t2,
    {_WEB[0]} AS p3, {_WEB[1]} AS d3, {_WEB[2]} AS r3, {_WEB[3]} AS t3,
    coalesce(kp, {_KW[0]}) AS p4, coalesce(kd, {_KW[1]}) AS d4, coalesce(kr, {_KW[2]}) AS r4,
    coalesce(kt, {_KW[3]}) AS t4 FROM c),
v AS (SELECT *, EXISTS (SELECT 1 FROM menu WHERE primary_ = p1 AND detailed = d1) AND r1 IS NOT NULL AS v1,
  r2 IS NOT NULL AS v2, r3 IS NOT NULL AS v3,
  EXISTS (SELECT 1 FROM menu WHERE primary_ = p4 AND detailed = d4) AND r4 IS NOT NULL AS v4 FROM k)
SELECT *, CASE WHEN v1 THEN r1 WHEN v2 THEN r2 WHEN v3 THEN r3 WHEN v4 THEN r4 END AS rule,
  CASE WHEN v1 THEN p1 WHEN v2 THEN p2 WHEN v3 THEN p3 WHEN v4 THEN p4 END AS hp,
  CASE WHEN v1 THEN d1 WHEN v2 THEN d2 WHEN v3 THEN d3 WHEN v4 THEN d4 END AS hd,
  CASE WHEN v1 THEN t1 WHEN v2 THEN t2 WHEN v3 THEN t3 WHEN v4 THEN t4 END AS ht,
  CASE WHEN v1 AND r1 = 'memory:entity_id' THEN 'HIGH' ELSE 'MEDIUM' END AS hc FROM v""")


def hits(spark, sf):
    return rules.rule_cascade(build.settled_store(spark, sf), tables.memory(spark, sf),
                              keyword_table=rule_table(spark, sf), row="transaction_id")


def rule_table(spark, sf):
    return rule_dim(spark, sf).filter("origin = 'personal'")


@query("normalize_merchant", ["feed"], f"""
SELECT DISTINCT merchant_name, {norm_sql('merchant_name')} AS norm FROM feed""")
def normalize_merchant(spark, sf):
    return tables.records(tables.raw_feed(spark, sf)).select("merchant_name").distinct().select(
        "merchant_name", text.normalize_merchant("merchant_name").alias("norm"))


@query("fn_normalize_merchant", ["feed"], f"""
SELECT DISTINCT original_description, {norm_sql('original_description')} AS norm FROM feed""")
def fn_normalize_merchant(spark, sf):
    return tables.records(tables.raw_feed(spark, sf)).select("original_description").distinct().select(
        "original_description", text.normalize_merchant("original_description").alias("norm"))


@query("fn_contains_word", [], """
SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') AS has_the,
  regexp_matches(lower(text), '(^|[^a-z0-9])of the([^a-z0-9]|$)') AS has_of_the FROM documents""")
def fn_contains_word(spark, sf):
    body = F.lower("text")
    return tables.read(spark, sf, "documents").select(
        "doc_id", text.contains_word(body, "the").alias("has_the"),
        text.contains_word(body, "of the").alias("has_of_the"))


@query("keyword_match", ["hits"], """
SELECT transaction_id, r4 AS rule, p4 AS "primary", d4 AS detailed FROM hits WHERE r4 IS NOT NULL""")
def keyword_match(spark, sf):
    df = build.settled_store(spark, sf)
    long = rules.keyword_table_match(df, rule_table(spark, sf))
    out = df.select("transaction_id", rules.keyword_match(fixed.RULES).alias("h"))
    hit = F.coalesce("_kw", "h")
    return out.join(long, "transaction_id", "left").select(
        "transaction_id", hit["rule_name"].alias("rule"), hit["primary"].alias("primary"),
        hit["detailed"].alias("detailed")).filter("rule IS NOT NULL")


@query("pos_prefix_match", ["hits"], "SELECT transaction_id, r2 AS rule FROM hits")
def pos_prefix_match(spark, sf):
    return build.settled(spark, sf).select("transaction_id", rules.pos_prefix_match(fixed.RULES)[
        "rule_name"].alias("rule"))


@query("website_match", ["hits"], "SELECT transaction_id, r3 AS rule FROM hits")
def website_match(spark, sf):
    return build.settled(spark, sf).select("transaction_id", rules.website_match(fixed.RULES)[
        "rule_name"].alias("rule"))


@query("memory_lookup", ["hits"], """
SELECT transaction_id, r1 AS rule, p1 AS "primary", d1 AS detailed FROM hits WHERE r1 IS NOT NULL""")
def memory_lookup(spark, sf):
    m = F.col("_mem")
    return rules.memory_lookup(build.settled(spark, sf), tables.memory(spark, sf)).filter(
        "_mem IS NOT NULL").select("transaction_id", m["rule_name"].alias("rule"),
                                   m["primary"].alias("primary"), m["detailed"].alias("detailed"))


@query("rule_cascade", ["hits"], """
SELECT transaction_id, rule, hp AS "primary", hd AS detailed, ht AS trust,
  CASE WHEN rule IS NOT NULL THEN hc END AS confidence FROM hits""")
def rule_cascade(spark, sf):
    h = F.col("hit")
    return hits(spark, sf).select(
        "transaction_id", h["rule_name"].alias("rule"), h["primary"].alias("primary"),
        h["detailed"].alias("detailed"), h["trust"].alias("trust"),
        h["confidence"].alias("confidence"))


# reviewer of record: the last verdict per row with a legal or snapped pair ---------------------

_T = "(l_partkey + l_suppkey * 3) % 24"
cte("verdicts", [], f"""
SELECT l_partkey AS q1, l_suppkey AS q2, l_quantity AS q3, l_extendedprice AS q4,
  (CASE WHEN l_partkey % 101 = 5 THEN 'gone-' ELSE '' END) || l_orderkey || '-' || l_linenumber
    AS transaction_id,
  CASE WHEN (l_partkey + l_suppkey) % 9 IN (0, 5, 6, 7, 8) THEN 'ok' ELSE 'flag' END AS verdict,
  {slot_sql(_T, 0)} AS vp, CASE (l_partkey + l_suppkey) % 9 WHEN 3 THEN 'NO_SUCH_LEAF'
    ELSE {slot_sql(_T, 1)} END AS vd0, CASE (l_partkey + l_suppkey) % 9 WHEN 2 THEN ''
    ELSE 'looks like ' || (l_partkey % 10) END AS reason
FROM lineitem""")
cte("snapped", ["verdicts", "menu", "other_leaf"], """
SELECT v.*, CASE WHEN m.detailed IS NOT NULL THEN m.detailed ELSE other_detailed END AS vd
FROM verdicts v LEFT JOIN menu m ON m.primary_ = vp AND m.detailed = vd0
LEFT JOIN other_leaf ON op = vp""")
cte("reviewer", ["snapped"], """
SELECT transaction_id, vp, vd, reason, CASE WHEN q2 % 2 = 0 THEN 'HIGH' ELSE 'low' END AS vc
FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY q1 DESC, q2 DESC, q3 DESC,
  q4 DESC) AS rn FROM snapped WHERE verdict = 'flag' AND vd IS NOT NULL) WHERE rn = 1""")


def reviewer(spark, sf):
    """The outside reviewer's last legal suggestion per row, as a table."""
    said = project.snap_to_other(tables.verdicts(spark, sf), dims.category_menu(spark)).filter(
        (F.lower("verdict") == "flag") & F.col("detailed").isNotNull())
    return ingest.last_per_key(said, "transaction_id", "seq").select(
        "transaction_id", "primary", "detailed", text.blank("reason").alias("reason"),
        F.when(F.col("seq.l_suppkey") % 2 == 0, "HIGH").otherwise("low").alias("confidence"))


def decide_sql(authority_level, with_reviewer):
    may = {"flag": "FALSE", "final": "TRUE", "apply_when_high": "upper(vc) = 'HIGH'"}[authority_level]
    src = "hits LEFT JOIN reviewer r USING (transaction_id)" if with_reviewer else \
        "(SELECT *, NULL AS vp, NULL AS vd, NULL AS vc, NULL AS reason FROM hits)"
    has = "vp IS NOT NULL" if with_reviewer else "FALSE"
    return f"""
SELECT *, CASE act WHEN 'apply_m' THEN hp WHEN 'flag_m' THEN hp WHEN 'apply_r' THEN vp
    WHEN 'flag_r' THEN vp ELSE pfc_primary END AS dp,
  CASE act WHEN 'apply_m' THEN hd WHEN 'flag_m' THEN hd WHEN 'apply_r' THEN vd
    WHEN 'flag_r' THEN vd ELSE pfc_detailed END AS dd,
  split_part(act, '_', 1) AS action, CASE WHEN act LIKE '%m' THEN 'mechanical' WHEN act LIKE '%r'
    THEN 'llm' ELSE '' END AS dsource, CASE WHEN act LIKE '%m' THEN rule WHEN act LIKE '%r' THEN reason
    ELSE '' END AS dreason, CASE WHEN act LIKE '%m' THEN hc WHEN act LIKE '%r' THEN vc ELSE '' END AS dconf
FROM (SELECT *, CASE
  WHEN rule IS NOT NULL AND ht = 'auto' AND (hp IS DISTINCT FROM pfc_primary OR hd IS DISTINCT FROM pfc_detailed)
    THEN 'apply_m'
  WHEN {has} AND rd AND coalesce(upper(pfc_confidence), '') NOT IN ('HIGH', 'VERY_HIGH') AND {may}
    THEN 'apply_r'
  WHEN {has} AND rd AND vp IS DISTINCT FROM pfc_primary THEN 'flag_r'
  WHEN NOT {has} AND rule IS NOT NULL AND hp IS DISTINCT FROM pfc_primary THEN 'flag_m'
  ELSE 'none' END AS act
FROM (SELECT *, (vp IS DISTINCT FROM pfc_primary OR vd IS DISTINCT FROM pfc_detailed)
    AND NOT (amount > 0 AND vp IN ('INCOME', 'TRANSFER_IN')) AS rd FROM {src}))"""


for _level in ("flag", "apply_when_high", "final"):
    cte(f"decided_{_level}", ["hits", "reviewer"], decide_sql(_level, True))

    @query("decide_authority" if _level == "flag" else f"decide_authority_{_level}",
           [f"decided_{_level}"], """SELECT transaction_id, action, dp AS "primary", dd AS detailed,
  dsource AS source, dreason AS reason, dconf AS confidence FROM decided_""" + _level)
    def decide_authority(spark, sf, level=_level):
        r = reviewer(spark, sf).select("transaction_id", F.struct(
            "primary", "detailed", "reason", "confidence").alias("reviewer"))
        out = authority.decide(hits(spark, sf).join(r, "transaction_id", "left"), level)
        return out.select("transaction_id", "decision.*")


cte("decided", ["hits"], decide_sql("flag", False))
cte("audited", ["decided"], f"""
SELECT * EXCLUDE (pfc_primary, pfc_detailed, pfc_confidence), pfc_primary AS before_primary,
  pfc_detailed AS before_detailed, pfc_confidence AS before_confidence,
  CASE WHEN action = 'apply' THEN dp ELSE pfc_primary END AS pfc_primary,
  CASE WHEN action = 'apply' THEN dd ELSE pfc_detailed END AS pfc_detailed,
  CASE WHEN action = 'apply' THEN 'CORRECTED' ELSE pfc_confidence END AS pfc_confidence,
  CASE WHEN action = 'apply' THEN pfc_primary END AS original_pf_category_primary,
  CASE WHEN action = 'apply' THEN pfc_detailed END AS original_pf_category_detailed,
  CASE WHEN action = 'apply' THEN pfc_confidence END AS original_pf_category_confidence,
  CASE WHEN action = 'apply' THEN dsource ELSE '' END AS category_update_step,
  CASE WHEN action = 'apply' THEN dreason ELSE '' END AS category_update_reason,
  CASE WHEN action = 'apply' THEN dconf ELSE '' END AS category_update_confidence,
  CASE WHEN action = 'flag' THEN '1' ELSE '' END AS category_review_flag,
  CASE WHEN action = 'flag' THEN dp ELSE '' END AS category_review_primary,
  CASE WHEN action = 'flag' THEN dd ELSE '' END AS category_review_detailed,
  CASE WHEN action = 'flag' THEN dreason ELSE '' END AS category_review_reason,
  CASE WHEN action = 'flag' THEN dconf ELSE '' END AS category_review_confidence,
  CASE WHEN action = 'flag' THEN dsource ELSE '' END AS category_review_source,
  CASE WHEN action IN ('apply', 'flag') THEN '{RUN}' ELSE '' END AS category_audited_at,
  '' AS reviewer_audited_at FROM decided""")

PROV = """original_pf_category_primary, original_pf_category_detailed,
  original_pf_category_confidence, category_update_step, category_update_reason,
  category_update_confidence, category_review_flag, category_review_primary,
  category_review_detailed, category_review_reason, category_review_confidence,
  category_review_source, category_audited_at, reviewer_audited_at"""
PROV_COLS = [c.strip() for c in PROV.split(",")]
PFC = ["primary", "detailed", "confidence_level"]


def audited(spark, sf):
    return authority.audit_transform(build.settled_store(spark, sf), RUN, tables.memory(spark, sf),
                                     keyword_table=rule_table(spark, sf), row="transaction_id")


def shown(df, *cols):
    pfc = F.col("personal_finance_category")
    return df.select("transaction_id", pfc["primary"].alias("pfc_primary"),
                     pfc["detailed"].alias("pfc_detailed"),
                     pfc["confidence_level"].alias("pfc_confidence"), *cols)


@query("audit_transform", ["audited"], f"""
SELECT transaction_id, pfc_primary, pfc_detailed, pfc_confidence, {PROV} FROM audited""")
def audit_transform(spark, sf):
    return shown(audited(spark, sf), *PROV_COLS)


@query("apply_provenance", ["audited"], f"""
SELECT '{RUN}' AS timestamp, transaction_id, before_primary AS original_primary,
  before_detailed AS original_detailed, dp AS new_primary, dd AS new_detailed, dsource AS step,
  dreason AS reason FROM audited WHERE action = 'apply'""")
def apply_provenance(spark, sf):
    return authority.change_rows(audited(spark, sf), RUN)


@query("raise_flag", ["audited"], """
SELECT transaction_id, before_primary AS current_primary, before_detailed AS current_detailed,
  dp AS suggested_primary, dd AS suggested_detailed, dsource AS source, dreason AS reason,
  dconf AS confidence FROM audited WHERE action = 'flag'""")
def raise_flag(spark, sf):
    return authority.flag_rows(audited(spark, sf))


@query("clear_flag", ["audited"], f"""
SELECT transaction_id, CASE WHEN s2 % 2 = 0 THEN '' ELSE category_review_flag END AS category_review_flag,
  CASE WHEN s2 % 2 = 0 THEN '' ELSE category_review_primary END AS category_review_primary,
  CASE WHEN s2 % 2 = 0 AND category_review_flag = '1' THEN 'later' ELSE category_audited_at END
    AS category_audited_at FROM audited""")
def clear_flag(spark, sf):
    out = authority.clear_review_flag(audited(spark, sf), F.col("seq.l_partkey") % 2 == 0, "later")
    return out.select("transaction_id", "category_review_flag", "category_review_primary",
                      "category_audited_at")


@query("worklist_projection", ["audited"], f"""
SELECT transaction_id, coalesce(txn_owner, '') AS txn_owner, date,
  coalesce(merchant_name, '') AS merchant_name, name, {d('amount')} AS amount,
  coalesce(pfc_primary, '') AS current_primary, coalesce(pfc_detailed, '') AS current_detailed,
  coalesce(pfc_confidence, '') AS current_confidence, category_review_primary AS suggested_primary,
  category_review_detailed AS suggested_detailed, category_review_source AS review_source,
  category_review_confidence AS review_confidence, category_review_reason AS review_reason
FROM audited WHERE category_review_flag = '1'""")
def worklist_projection(spark, sf):
    return project.worklist(audited(spark, sf)).withColumn("amount",
                                                           F.col("amount").cast("double"))


@query("sink_worklist", ["audited"], f"""
SELECT category_review_source AS review_source, category_review_reason AS review_reason, {n()} AS n_rows
FROM audited WHERE category_review_flag = '1' GROUP BY 1, 2""")
def sink_worklist(spark, sf):
    return project.worklist(audited(spark, sf)).groupBy("review_source", "review_reason").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("reviewer_prompt", ["hits"], f"""
SELECT transaction_id, '[row ' || transaction_id || ']' || chr(10) || '    merchant_name  : ' ||
  left(coalesce(merchant_name, ''), 60) || chr(10) || '    name           : ' || left(coalesce(name, ''), 80)
  || chr(10) || '    original_desc  : ' || left(coalesce(original_description, ''), 80) || chr(10) ||
  '    counterparties : ' || left(coalesce(cp_name, ''), 60) || chr(10) || '    website        : ' ||
  left(coalesce(website, ''), 40) || chr(10) || '    payment_channel: ' || left(coalesce(payment_channel, ''), 20)
  || chr(10) || '    amount         : ' || CAST(amount AS VARCHAR) || chr(10) || '    current pf     : ' ||
  coalesce(pfc_primary, 'None') || ' / ' || coalesce(pfc_detailed, 'None') || ' (' ||
  coalesce(pfc_confidence, 'None') || ')' || chr(10) || CASE WHEN rule IS NOT NULL THEN
  '    mechanical suggestion : ' || hp || ' / ' || hd || chr(10) ELSE '' END AS prompt FROM hits""")
def reviewer_prompt(spark, sf):
    df = hits(spark, sf).withColumns({"suggested_primary": F.col("hit.primary"),
                                      "suggested_detailed": F.col("hit.detailed")})
    return project.reviewer_prompt(df)


@query("memory_learn", ["audited", "memory"], f"""
WITH k AS (SELECT 'ent:' || merchant_entity_id AS key, date, transaction_id, dp, dd FROM audited
    WHERE action = 'apply' AND merchant_entity_id IS NOT NULL
  UNION ALL SELECT nk, date, transaction_id, dp, dd FROM audited WHERE action = 'apply' AND nk IS NOT NULL),
l AS (SELECT key, arg_max(dp, (date, transaction_id)) AS p, arg_max(dd, (date, transaction_id)) AS dt
  FROM k GROUP BY 1)
SELECT key, p AS "primary", dt AS detailed FROM l UNION ALL
SELECT key, mp, md FROM memory WHERE key NOT IN (SELECT key FROM l)""".replace("WITH k AS", ", k AS"))
def memory_learn(spark, sf):
    return authority.memory_learn(tables.memory(spark, sf),
                                  authority.learned(audited(spark, sf)))


cte("adjudicated", ["audited", "menu"], f"""
WITH x AS (SELECT a.*, decision, pp, pd, EXISTS (SELECT 1 FROM menu WHERE primary_ = pp AND detailed = pd)
    AS legal FROM audited a LEFT JOIN (SELECT o_orderkey || '-' || (o_orderkey % 7 + 1) AS transaction_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'repick' END AS decision,
    {slot_sql('o_custkey % 24', 0)} AS pp, {slot_sql('o_custkey % 24', 1)} AS pd FROM orders) o
    USING (transaction_id)),
y AS (SELECT *, CASE WHEN category_review_flag <> '1' THEN NULL WHEN decision = 'accept' THEN 'a'
    WHEN decision = 'reject' THEN 'r' WHEN decision = 'repick' AND legal THEN 'p' END AS ac FROM x),
z AS (SELECT *, CASE ac WHEN 'a' THEN category_review_primary WHEN 'p' THEN pp END AS np,
  CASE ac WHEN 'a' THEN category_review_detailed WHEN 'p' THEN pd END AS nd FROM y),
w AS (SELECT *, ac IN ('a', 'p') AND (np IS DISTINCT FROM pfc_primary OR nd IS DISTINCT FROM pfc_detailed)
  AS ch FROM z)
SELECT transaction_id, coalesce(ch, FALSE) AS applied,
  CASE WHEN ch THEN np ELSE pfc_primary END AS pfc_primary,
  CASE WHEN ch THEN nd ELSE pfc_detailed END AS pfc_detailed,
  CASE WHEN ch THEN 'CORRECTED' ELSE pfc_confidence END AS pfc_confidence,
  CASE WHEN ch THEN 'review' ELSE category_update_step END AS category_update_step,
  CASE WHEN ch THEN CASE ac WHEN 'a' THEN 'accepted ' || category_review_source || ': ' ||
    category_review_reason ELSE 'manual re-pick' END ELSE category_update_reason END AS category_update_reason,
  CASE WHEN ac IS NOT NULL THEN '' ELSE category_review_flag END AS category_review_flag,
  CASE WHEN ac IS NOT NULL THEN 'later' ELSE category_audited_at END AS category_audited_at FROM w""")


@query("review_adjudicate", ["adjudicated"], "SELECT * FROM adjudicated")
def review_adjudicate(spark, sf):
    out = authority.review_adjudicate(audited(spark, sf).drop("applied", "decision"),
                                      tables.decisions(spark, sf), dims.category_menu(spark),
                                      "later")
    return shown(out, "applied", "category_update_step", "category_update_reason",
                 "category_review_flag", "category_audited_at")


cte("judged", ["snapped", "audited"], """
SELECT v.*, CASE WHEN a.transaction_id IS NULL THEN 'unknown' WHEN verdict = 'flag' AND v.vd IS NULL
  THEN 'invalid' WHEN verdict = 'flag' AND (v.vp IS DISTINCT FROM pfc_primary OR v.vd IS DISTINCT FROM pfc_detailed)
  THEN 'flagged' ELSE 'ok' END AS outcome, NOT (a.category_review_flag = '1'
    AND category_review_primary = v.vp AND category_review_detailed = v.vd AND category_review_reason = v.reason
    AND category_review_confidence = '' AND category_review_source = 'reviewer') AS moves
FROM snapped v LEFT JOIN audited a USING (transaction_id)""")


def judged(spark, sf):
    return authority.judge_verdicts(audited(spark, sf).drop("applied", "flagged", "decision"),
                                    tables.verdicts(spark, sf), dims.category_menu(spark))


@query("reviewer_verdict_counts", ["judged"], f"""
SELECT outcome, {n()} AS n_verdicts, CAST(count(DISTINCT transaction_id) AS BIGINT) AS n_rows FROM judged GROUP BY 1""")
def reviewer_verdict_counts(spark, sf):
    return judged(spark, sf).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n_verdicts"), F.countDistinct("transaction_id").alias("n_rows"))


@query("reviewer_verdicts", ["audited", "judged"], f"""
WITH l AS (SELECT transaction_id, bool_or(outcome = 'flagged') AS any_,
    bool_or(outcome = 'flagged' AND moves) AS moved,
    arg_max(vp, (q1, q2, q3, q4)) FILTER (outcome = 'flagged') AS lp,
    arg_max(vd, (q1, q2, q3, q4)) FILTER (outcome = 'flagged') AS ld,
    arg_max(reason, (q1, q2, q3, q4)) FILTER (outcome = 'flagged') AS lr
  FROM judged WHERE outcome IN ('flagged', 'ok') GROUP BY 1)
SELECT transaction_id, CASE WHEN any_ THEN '1' ELSE category_review_flag END AS category_review_flag,
  CASE WHEN any_ THEN lp ELSE category_review_primary END AS category_review_primary,
  CASE WHEN any_ THEN ld ELSE category_review_detailed END AS category_review_detailed,
  CASE WHEN any_ THEN lr ELSE category_review_reason END AS category_review_reason,
  CASE WHEN any_ THEN 'reviewer' ELSE category_review_source END AS category_review_source,
  CASE WHEN moved THEN 'later' ELSE category_audited_at END AS category_audited_at,
  CASE WHEN any_ IS NOT NULL THEN 'later' ELSE '' END AS reviewer_audited_at
FROM audited LEFT JOIN l USING (transaction_id)""".replace("WITH l AS", ", l AS"))
def reviewer_verdicts(spark, sf):
    out = authority.apply_verdicts(audited(spark, sf).drop("applied", "flagged", "decision"),
                                   judged(spark, sf), "later")
    return out.select("transaction_id", "category_review_flag", "category_review_primary",
                      "category_review_detailed", "category_review_reason",
                      "category_review_source", "category_audited_at", "reviewer_audited_at")


@query("reviewer_queue", ["audited", "judged"], """
SELECT transaction_id, date FROM audited WHERE NOT pending AND transaction_id NOT IN
  (SELECT transaction_id FROM judged WHERE outcome IN ('flagged', 'ok'))""")
def reviewer_queue(spark, sf):
    out = authority.apply_verdicts(audited(spark, sf).drop("applied", "flagged", "decision"),
                                   judged(spark, sf), "later")
    return project.reviewer_queue(out).select("transaction_id", "date")


# categorized cube ------------------------------------------------------------------------------

cte("ccube", ["audited", "accounts", "atoms"], cube_sql("audited", """category_update_step,
  category_update_reason, category_update_confidence, original_pf_category_primary AS original_pf_primary,
  original_pf_category_detailed AS original_pf_detailed, category_review_flag = '1' AS review_pending,
  category_review_primary AS review_primary, category_review_detailed AS review_detailed,
  category_review_reason AS review_reason, category_review_source AS review_source"""))


def ccube(spark, sf):
    return enrich.enrich(ingest.canonicalize(audited(spark, sf).drop("applied", "flagged",
                                                                     "decision")),
                         tables.accounts(spark, sf), with_recurrence=False, key="transaction_id",
                         keyed=build.settled_store(spark, sf))  # where memory has a key twice, audited rows repeat


CARRY = """category_update_step, category_update_reason, category_update_confidence,
  original_pf_primary, original_pf_detailed, review_pending, review_primary, review_detailed,
  review_reason, review_source"""


@query("provenance_carry", ["ccube"], f"SELECT transaction_id, {CARRY} FROM ccube")
def provenance_carry(spark, sf):
    return ccube(spark, sf).select("transaction_id", *[c.strip() for c in CARRY.split(",")])


_BADGE = "CASE category_update_step " + " ".join(
    f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fixed.STEP_BADGES.items()) + " END"
WHY = f"""concat_ws('  ', CASE WHEN {_BADGE} IS NOT NULL AND category_update_reason <> '' THEN {_BADGE}
  || ' · ' || category_update_reason ELSE {_BADGE} END, CASE WHEN review_pending THEN
  {lit(fixed.PENDING_BADGE)} END)"""


@query("provenance_why", ["ccube"], f"SELECT transaction_id, {WHY} AS why FROM ccube")
def provenance_why(spark, sf):
    return ccube(spark, sf).select("transaction_id", authority.provenance_why().alias("why"))


@query("txn_detail", ["ccube"], f"""
SELECT transaction_id, date_resolved, merchant, replace(atom, '_', ' ') AS atom_display,
  {d('abs_amount')} AS abs_amount, {WHY} AS why FROM ccube WHERE flow = 'spend' AND tier1 = 'Travel'""")
def txn_detail(spark, sf):
    from ledgerloom.operators import cube as cb
    rows = cb.facet_filter(ccube(spark, sf), cb.GroupingSpec(
        filters={"flow": "spend", "tier1": "Travel"}))
    rows = lineage.stored(rows.select(
        "transaction_id", "date_resolved", "merchant", text.humanize_atom("atom").alias("atom_display"), "abs_amount",
        authority.provenance_why().alias("why")), "detail")  # a sort over the whole table reads its rows twice
    return rows.orderBy(F.desc("abs_amount"), "transaction_id").withColumn("abs_amount", F.col("abs_amount").cast("double"))


cte("catalog", ["rules"], """
SELECT CASE WHEN kind = 'pos_prefix' THEN 'pos:' || rtrim(lower(pattern), '*') ELSE kind || ':' || pattern END
  AS rule_id, kind, pattern, primary_, detailed, trust, origin FROM rules
UNION ALL SELECT 'memory:entity_id', 'merchant memory',
  'exact merchant_entity_id remembered from a past resolution', '(per merchant)', '(per merchant)', 'auto', 'memory'
UNION ALL SELECT 'memory:name', 'merchant memory',
  'normalized merchant-name remembered from a past resolution', '(per merchant)', '(per merchant)', 'flag', 'memory'""")


@query("rule_catalog", ["catalog"], """
SELECT rule_id, kind, pattern, primary_ AS "primary", detailed, trust, origin FROM catalog""")
def rule_catalog(spark, sf):
    return rules.rule_catalog(rule_dim(spark, sf))


@query("provenance_explain", ["ccube", "catalog"], """
SELECT transaction_id, category_update_reason, s.pattern AS set_pattern, s.trust AS set_trust,
  w.pattern AS suggested_pattern, w.kind AS suggested_kind FROM ccube
LEFT JOIN catalog s ON s.rule_id = category_update_reason AND category_update_step <> ''
LEFT JOIN catalog w ON w.rule_id = review_reason AND review_pending""")
def provenance_explain(spark, sf):
    out = authority.provenance_explain(ccube(spark, sf), rules.rule_catalog(rule_dim(spark, sf)))
    return out.select("transaction_id", "category_update_reason",
                      F.col("set_by.pattern").alias("set_pattern"),
                      F.col("set_by.trust").alias("set_trust"),
                      F.col("suggested_by.pattern").alias("suggested_pattern"),
                      F.col("suggested_by.kind").alias("suggested_kind"))


@query("rule_match_scan", ["hits"], f"""
SELECT rule AS rule_id, {n()} AS matches_now FROM hits WHERE rule IS NOT NULL GROUP BY 1""")
def rule_match_scan(spark, sf):
    return rules.rule_match_scan(hits(spark, sf))


@query("rule_matched_rows", ["hits"], f"""
SELECT rule AS rule_id, transaction_id, date, coalesce(merchant_name, name) AS description,
  {d('amount')} AS amount, coalesce(pfc_primary, 'None') || ' / ' || coalesce(pfc_detailed, 'None')
  AS current_category FROM hits WHERE rule IS NOT NULL""")
def rule_matched_rows(spark, sf):
    return rules.matched_rows(hits(spark, sf)).withColumn("amount", F.col("amount").cast("double"))


@query("rule_usage", ["catalog", "hits", "audited"], f"""
SELECT c.rule_id, c.kind, c.pattern, coalesce(m.k, 0) AS matches_now, coalesce(a.k, 0) AS applied_now,
  coalesce(f.k, 0) AS flags_pending FROM (SELECT * FROM catalog WHERE origin <> 'memory') c
LEFT JOIN (SELECT rule, count(*) AS k FROM hits GROUP BY 1) m ON m.rule = c.rule_id
LEFT JOIN (SELECT category_update_reason AS r, count(*) AS k FROM audited
  WHERE category_update_step = 'mechanical' GROUP BY 1) a ON a.r = c.rule_id
LEFT JOIN (SELECT category_review_reason AS r, count(*) AS k FROM audited
  WHERE category_review_flag = '1' AND category_review_source = 'mechanical' GROUP BY 1) f
  ON f.r = c.rule_id""")
def rule_usage(spark, sf):
    return rules.rule_usage(rule_dim(spark, sf), hits(spark, sf), audited(spark, sf)).select(
        "rule_id", "kind", "pattern", "matches_now", "applied_now", "flags_pending")


@query("memory_usage", ["memory", "hits"], """
SELECT m.key, CASE WHEN starts_with(m.key, 'ent:') THEN 'entity id (auto)' ELSE 'name (flag)' END AS "match",
  substr(m.key, strpos(m.key, ':') + 1) AS merchant, mp AS "primary", md AS detailed,
  coalesce(k, 0) AS matches_now FROM memory m LEFT JOIN (
  SELECT CASE rule WHEN 'memory:entity_id' THEN 'ent:' || merchant_entity_id ELSE nk END AS key,
    count(*) AS k FROM hits WHERE starts_with(rule, 'memory:') GROUP BY 1) u ON u.key = m.key""")
def memory_usage(spark, sf):
    return rules.memory_usage(tables.memory(spark, sf), hits(spark, sf))


PINNED = [("Streaming", ["netflix", "spotify"]), ("Coffee", ["starbucks"])]
DROP_P, DROP_D = ["TRANSFER_IN", "TRANSFER_OUT"], ["LOAN_PAYMENTS_CREDIT_CARD_PAYMENT"]
DETAILED_MAP = {"FOOD_AND_DRINK_GROCERIES": "Groceries", "RENT_AND_UTILITIES_RENT": "Housing",
                "LOAN_PAYMENTS_MORTGAGE_PAYMENT": "Housing"}
PRIMARY_MAP = {"FOOD_AND_DRINK": "Dining", "TRAVEL": "Fun", "ENTERTAINMENT": "Fun",
               "MEDICAL": "Health", "GENERAL_MERCHANDISE": "Shopping"}


@query("budget_category_map", ["settled"], f"""
SELECT mapped_by, budget_category, {n()} AS n_rows, {d('sum(amount)')} AS net FROM (
SELECT amount, CASE WHEN pin IS NOT NULL THEN 'pinned' WHEN dr THEN 'dropped' WHEN dc IS NOT NULL
    THEN 'detailed' WHEN pc IS NOT NULL THEN 'primary' ELSE 'unmapped' END AS mapped_by,
  coalesce(pin, CASE WHEN NOT dr THEN coalesce(dc, pc) END) AS budget_category FROM (
SELECT *, CASE WHEN contains(b, 'netflix') OR contains(b, 'spotify') THEN 'Streaming'
    WHEN contains(b, 'starbucks') THEN 'Coffee' END AS pin,
  coalesce(pfc_primary IN ('TRANSFER_IN', 'TRANSFER_OUT'), FALSE)
    OR coalesce(pfc_detailed = 'LOAN_PAYMENTS_CREDIT_CARD_PAYMENT', FALSE) AS dr,
  CASE pfc_detailed {' '.join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in DETAILED_MAP.items())} END AS dc,
  CASE pfc_primary {' '.join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in PRIMARY_MAP.items())} END AS pc
FROM (SELECT *, lower(concat_ws(' ', merchant_name, name, original_description)) AS b FROM settled)))
GROUP BY 1, 2""")
def budget_category_map(spark, sf):
    out = rules.budget_category_map(build.canon(spark, sf), PINNED, DROP_P, DROP_D, DETAILED_MAP,
                                    PRIMARY_MAP)
    return out.groupBy("mapped_by", "budget_category").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("amount").cast("double").alias("net"))


@query("legacy_category_migration", ["settled"], """
SELECT transaction_id, CASE pfc_detailed WHEN 'INCOME_SALARY' THEN 'INCOME' ELSE pfc_primary END AS pfc_primary,
  CASE pfc_detailed WHEN 'INCOME_SALARY' THEN 'INCOME_WAGES' ELSE pfc_detailed END AS pfc_detailed FROM settled""")
def legacy_category_migration(spark, sf):
    return rules.legacy_category_migration(build.canon(spark, sf)).select(
        "transaction_id", "pfc_primary", "pfc_detailed")


# sweeps ---------------------------------------------------------------------------------------

CAT = "coalesce(pfc_primary, 'None') || '/' || coalesce(pfc_detailed, 'None')"


@query("audit_scan", ["hits", "menu"], f"""
SELECT 'uncategorized' AS sweep, transaction_id AS id, '' AS detail FROM settled WHERE pfc_primary IS NULL
UNION ALL SELECT 'taxonomy_invalid', transaction_id, {CAT} FROM settled s WHERE pfc_primary IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM menu WHERE primary_ = pfc_primary AND detailed = pfc_detailed)
UNION ALL SELECT 'sign_violations', transaction_id, {CAT} FROM settled WHERE amount > 0
  AND pfc_primary IN ('INCOME', 'TRANSFER_IN')
UNION ALL SELECT 'stale_pending', transaction_id, '' FROM settled WHERE pending
  AND DATE '{TODAY}' - CAST(date AS DATE) > 14
UNION ALL SELECT 'memory_conflicts', transaction_id, r1 || ' ' || coalesce(p1, 'None') || '/' ||
  coalesce(d1, 'None') || ' <> ' || {CAT} FROM hits WHERE r1 IS NOT NULL
  AND (p1 IS DISTINCT FROM pfc_primary OR d1 IS DISTINCT FROM pfc_detailed)
UNION ALL SELECT 'entity_inconsistent', merchant_entity_id, string_agg(c, ',' ORDER BY c) FROM (
  SELECT DISTINCT merchant_entity_id, {CAT} AS c FROM settled WHERE merchant_entity_id IS NOT NULL
  AND pfc_primary IS NOT NULL) GROUP BY merchant_entity_id HAVING count(*) > 1
UNION ALL SELECT * FROM (SELECT 'amount_outliers', transaction_id, CAST(abs(amount) AS VARCHAR) FROM settled
  ORDER BY abs(amount) DESC, transaction_id DESC LIMIT 10)""")
def audit_scan(spark, sf):
    return sweeps.audit_scan(build.settled(spark, sf), TODAY, tables.memory(spark, sf))


@query("amount_outliers", ["settled"], f"""
SELECT transaction_id, {d('abs(amount)')} AS abs_amount FROM settled
ORDER BY abs(amount) DESC, transaction_id DESC LIMIT 10""")
def amount_outliers(spark, sf):
    return sweeps.amount_outliers(build.settled(spark, sf)).withColumn(
        "abs_amount", F.col("abs_amount").cast("double"))
