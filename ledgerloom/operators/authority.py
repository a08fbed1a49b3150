"""Who may change a category: decisions, provenance, review flags, verdicts, adjudication."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed, schema
from ledgerloom.functions import text
from ledgerloom.operators import project, rules

DECISION = ("struct<action:string,primary:string,detailed:string,source:string,reason:string,"
            "confidence:string>")


def ensure_columns(df: DataFrame) -> DataFrame:
    """Every provenance column present: null for originals, '' for the rest."""
    add = {}
    for c in schema.PROVENANCE_COLUMNS:
        if c in df.columns:
            if c not in schema.ORIGINAL_COLUMNS:
                add[c] = text.blank(c)
        else:
            add[c] = F.lit(None if c in schema.ORIGINAL_COLUMNS else "").cast("string")
    return df.withColumns(add) if add else df


def current():
    pfc = F.col("personal_finance_category")
    return pfc["primary"], pfc["detailed"]


def same_pair(primary, detailed) -> Column:
    cur = current()
    return cur[0].eqNullSafe(primary) & cur[1].eqNullSafe(detailed)


def decision_column(hit="hit", reviewer="reviewer", authority="flag",
                    flag_laterals=False) -> Column:
    """What to do with a row under the authority model: apply, flag or none.

    An auto rule that differs applies. Else the reviewer, when there is one, is the only source of
    a suggestion; a loose rule speaks only when there is no reviewer verdict. On rows whose own
    label is not trusted, the authority level may let the reviewer apply. A suggestion inside the
    current primary is not worth a flag.
    """
    h, r = F.col(hit), F.col(reviewer)
    cur = current()
    differs_h = h.isNotNull() & ~same_pair(h["primary"], h["detailed"])
    differs_r = ~same_pair(r["primary"], r["detailed"]) & ~project.sign_violation(
        "amount", r["primary"])

    def made(action, source, s, reason):
        return F.struct(F.lit(action).alias("action"), s["primary"].alias("primary"),
                        s["detailed"].alias("detailed"), F.lit(source).alias("source"),
                        s[reason].alias("reason"), s["confidence"].alias("confidence")).cast(
            DECISION)

    nothing = F.struct(F.lit("none").alias("action"), cur[0].alias("primary"),
                       cur[1].alias("detailed"), F.lit("").alias("source"),
                       F.lit("").alias("reason"), F.lit("").alias("confidence")).cast(DECISION)
    trusted = F.upper(F.coalesce(F.col("personal_finance_category")["confidence_level"],
                                 F.lit(""))).isin(*fixed.TRUSTED_LEVELS)
    may = {"flag": F.lit(False), "final": F.lit(True),
           "apply_when_high": F.upper(F.coalesce(r["confidence"], F.lit(""))) == "HIGH"}[authority]

    def lateral(s):
        return F.lit(not flag_laterals) & s["primary"].eqNullSafe(cur[0])

    return (F.when(differs_h & (h["trust"] == "auto"), made("apply", "mechanical", h, "rule_name"))
            .when(r.isNotNull() & differs_r & ~trusted & may, made("apply", "llm", r, "reason"))
            .when(r.isNotNull() & differs_r & ~lateral(r), made("flag", "llm", r, "reason"))
            .when(r.isNull() & differs_h & ~lateral(h), made("flag", "mechanical", h, "rule_name"))
            .otherwise(nothing))


def decide(df: DataFrame, authority="flag", flag_laterals=False) -> DataFrame:
    """Adds `decision` from `hit` and, when present, `reviewer`."""
    if "reviewer" not in df.columns:
        df = df.withColumn("reviewer", F.lit(None).cast(
            "struct<primary:string,detailed:string,reason:string,confidence:string>"))
    return rules.compute_once(df, "decision", decision_column(authority=authority,
                                                              flag_laterals=flag_laterals))


def set_provenance(df: DataFrame, when, primary, detailed, step, reason, confidence,
                   run_ts: str) -> DataFrame:
    """Where `when` holds and the pair differs: overwrite the category and record who did it.

    Originals are written once: only while both are still null.
    """
    changed = F.coalesce(when, F.lit(False)) & ~same_pair(primary, detailed)
    pfc = F.col("personal_finance_category")
    df = df.withColumn("_ch", changed)
    ch = F.col("_ch")
    fresh = ch & F.col("original_pf_category_primary").isNull() \
        & F.col("original_pf_category_detailed").isNull()

    def either(cond, value, name):
        return F.when(cond, value).otherwise(F.col(name))

    out = df.withColumns({
        "original_pf_category_primary": either(fresh, pfc["primary"],
                                               "original_pf_category_primary"),
        "original_pf_category_detailed": either(fresh, pfc["detailed"],
                                                "original_pf_category_detailed"),
        "original_pf_category_confidence": either(fresh, pfc["confidence_level"],
                                                  "original_pf_category_confidence"),
        "personal_finance_category": F.when(ch, F.struct(
            primary.alias("primary"), detailed.alias("detailed"),
            F.lit(fixed.CORRECTED).alias("confidence_level"), pfc["version"].alias("version")))
        .otherwise(pfc),
        "category_update_step": either(ch, step, "category_update_step"),
        "category_update_reason": either(ch, reason, "category_update_reason"),
        "category_update_confidence": either(ch, confidence, "category_update_confidence"),
        "category_audited_at": either(ch, F.lit(run_ts), "category_audited_at"),
    })
    return out.withColumnRenamed("_ch", "applied")


def set_review_flag(df: DataFrame, when, primary, detailed, reason, confidence, source,
                    run_ts: str) -> DataFrame:
    """Where `when` holds and the pair differs: write the suggestion; an identical flag that is
    already there keeps its stamp."""
    raised = F.coalesce(when, F.lit(False)) & ~same_pair(primary, detailed)
    new = {"category_review_flag": F.lit("1"), "category_review_primary": primary,
           "category_review_detailed": detailed, "category_review_reason": reason,
           "category_review_confidence": confidence, "category_review_source": source}
    same = F.lit(True)
    for c, v in new.items():
        same = same & F.col(c).eqNullSafe(v)
    df = df.withColumns({"flagged": raised, "_new": raised & ~same})
    out = {c: F.when(F.col("flagged"), v).otherwise(F.col(c)) for c, v in new.items()}
    out["category_audited_at"] = F.when(F.col("_new"), run_ts).otherwise(
        F.col("category_audited_at"))
    return df.withColumns(out).drop("_new")


def clear_review_flag(df: DataFrame, when, run_ts: str) -> DataFrame:
    """Where `when` holds: blank the review columns, stamping only rows that had any."""
    had = F.lit(False)
    for c in schema.REVIEW_COLUMNS:
        had = had | (text.blank(c) != "")
    df = df.withColumn("_cl", F.coalesce(when, F.lit(False)))
    out = {c: F.when(F.col("_cl"), "").otherwise(F.col(c)) for c in schema.REVIEW_COLUMNS}
    out["category_audited_at"] = F.when(F.col("_cl") & had, run_ts).otherwise(
        F.col("category_audited_at"))
    return df.withColumns(out).drop("_cl")


def audit_transform(df: DataFrame, run_ts: str, memory=None, overlay=(), keyword_table=None,
                    reviewer: DataFrame | None = None, levels=tuple(fixed.CONFIDENCE_LEVELS),
                    authority="flag", covered: str | None = None, row: str | None = None) -> DataFrame:
    """Rules, reviewer, decision and provenance in one plan; `decision`, `applied`, `flagged` tell.

    Rows outside `levels`, or covered by a human intent (boolean column `covered`), are left as
    they are. `reviewer` is (transaction_id, primary, detailed, reason, confidence). `row`: a column that is never
    null and never repeats, if there is one that the rows lie by.
    """
    picked = project.confidence_of().isin(*levels)
    if covered:
        picked = picked & ~F.coalesce(F.col(covered), F.lit(False))
    out = ensure_columns(df).withColumn("_sel", picked)
    before = current()
    out = out.withColumns({"before_primary": before[0], "before_detailed": before[1]})
    out = rules.rule_cascade(out, memory, overlay, keyword_table, row)
    if reviewer is not None:
        verdict = reviewer.select("transaction_id", F.struct(
            "primary", "detailed", "reason", "confidence").alias("reviewer"))
        out = out.join(verdict, "transaction_id", "left")
    out = decide(out, authority)
    out = out.withColumn("decision", F.when(F.col("_sel"), F.col("decision")))
    d = F.col("decision")
    out = set_provenance(out, d["action"] == "apply", d["primary"], d["detailed"], d["source"],
                         d["reason"], d["confidence"], run_ts)
    out = set_review_flag(out, d["action"] == "flag", d["primary"], d["detailed"], d["reason"],
                          d["confidence"], d["source"], run_ts)
    return out.drop("_sel", "hit", "reviewer")


def change_rows(audited: DataFrame, run_ts: str) -> DataFrame:
    """One log row per applied change."""
    d = F.col("decision")
    return audited.filter("applied").select(
        F.lit(run_ts).alias("timestamp"), "transaction_id",
        F.col("before_primary").alias("original_primary"),
        F.col("before_detailed").alias("original_detailed"), d["primary"].alias("new_primary"),
        d["detailed"].alias("new_detailed"), d["source"].alias("step"), d["reason"].alias("reason"))


def flag_rows(audited: DataFrame) -> DataFrame:
    d = F.col("decision")
    return audited.filter("flagged").select(
        "transaction_id", F.col("before_primary").alias("current_primary"),
        F.col("before_detailed").alias("current_detailed"),
        d["primary"].alias("suggested_primary"), d["detailed"].alias("suggested_detailed"),
        d["source"].alias("source"), d["reason"].alias("reason"),
        d["confidence"].alias("confidence"))


def memory_learn(memory: DataFrame, resolved: DataFrame) -> DataFrame:
    """Old memory with the pairs of resolved rows under both keys, last row by (date, id) wins."""
    ent, name = rules.memory_keys()
    taught = resolved.select(F.explode(F.array(ent, name)).alias("key"), F.struct(
        "date", "transaction_id").alias("at"), "new_primary", "new_detailed")
    new = taught.filter("key IS NOT NULL").groupBy("key").agg(
        F.max_by(F.struct(F.col("new_primary").alias("primary"),
                          F.col("new_detailed").alias("detailed")), "at").alias("v"))
    new = new.select("key", "v.primary", "v.detailed")
    return memory.join(new, "key", "left_anti").select("key", "primary", "detailed") \
        .unionByName(new)


def learned(audited: DataFrame) -> DataFrame:
    """Applied rows in the form memory_learn takes."""
    return audited.filter("applied").withColumns({
        "new_primary": F.col("personal_finance_category")["primary"],
        "new_detailed": F.col("personal_finance_category")["detailed"]})


def review_adjudicate(df: DataFrame, decisions: DataFrame, menu: DataFrame,
                      run_ts: str) -> DataFrame:
    """Human decisions on flagged rows: accept, reject, or re-pick (an illegal pick is refused).

    Adds `applied`; applied rows are what memory_learn is taught from.
    """
    picks = project.category_valid(decisions, menu, "pick_primary", "pick_detailed", "_legal")
    out = ensure_columns(df).join(picks.select("transaction_id", "decision", "pick_primary",
                                               "pick_detailed", "_legal"), "transaction_id", "left")
    waits = F.col("category_review_flag") != ""
    accept = waits & (F.col("decision") == "accept")
    repick = waits & (F.col("decision") == "repick") & F.col("_legal")
    reject = waits & (F.col("decision") == "reject")
    source = F.coalesce(text.or_null("category_review_source"), F.lit("llm"))
    reason = F.trim(F.concat(F.lit("accepted "), source, F.lit(": "),
                             text.blank("category_review_reason")))
    out = out.withColumns({"_ac": F.coalesce(accept, F.lit(False)),
                           "_rp": F.coalesce(repick, F.lit(False)),
                           "_rj": F.coalesce(reject, F.lit(False))})
    ac, rp = F.col("_ac"), F.col("_rp")
    out = set_provenance(
        out, ac | rp, F.when(ac, F.col("category_review_primary")).otherwise(F.col("pick_primary")),
        F.when(ac, F.col("category_review_detailed")).otherwise(F.col("pick_detailed")),
        F.lit("review"), F.when(ac, reason).otherwise(F.lit("manual re-pick")),
        F.when(ac, text.blank("category_review_confidence")).otherwise(F.lit("HIGH")), run_ts)
    out = clear_review_flag(out, ac | rp | F.col("_rj"), run_ts)
    return out.drop("decision", "pick_primary", "pick_detailed", "_legal", "_ac", "_rp", "_rj")


def judge_verdicts(store: DataFrame, verdicts: DataFrame, menu: DataFrame,
                   source="reviewer") -> DataFrame:
    """One row per verdict with its outcome (flagged, ok, invalid, unknown) and whether it would
    change the flag that is on the row now."""
    said = verdicts.withColumn("verdict", F.lower(F.coalesce("verdict", F.lit("")))) \
        .withColumn("reason", text.blank("reason"))
    said = project.snap_to_other(said, menu)
    cur = current()
    there = F.struct(*[F.col(c) for c in schema.REVIEW_COLUMNS])
    known = ensure_columns(store).select("transaction_id", cur[0].alias("_cp"),
                                         cur[1].alias("_cd"), there.alias("_there"))
    out = said.join(known, "transaction_id", "left")
    is_flag = F.col("verdict") == "flag"
    same = F.col("_cp").eqNullSafe(F.col("primary")) & F.col("_cd").eqNullSafe(F.col("detailed"))
    outcome = (F.when(F.col("_there").isNull(), "unknown")
               .when(is_flag & F.col("detailed").isNull(), "invalid")
               .when(is_flag & ~same, "flagged").otherwise("ok"))
    raised = F.struct(F.lit("1"), F.col("primary"), F.col("detailed"), F.col("reason"), F.lit(""),
                      F.lit(source))
    now = F.struct(*[F.col("_there")[c] for c in schema.REVIEW_COLUMNS])
    return out.withColumns({"outcome": outcome, "changes_flag": ~now.eqNullSafe(raised)}).drop(
        "_cp", "_cd", "_there")


def apply_verdicts(store: DataFrame, judged: DataFrame, run_ts: str,
                   source="reviewer") -> DataFrame:
    """The store after all verdicts in order: last differing flag stands, ok leaves flags alone.

    The audit stamp moves when any flag along the way differs from the flag that was there.
    """
    flag = F.col("outcome") == "flagged"
    per = judged.filter(F.col("outcome").isin("flagged", "ok")).groupBy("transaction_id").agg(
        F.max_by(F.struct("primary", "detailed", "reason"), F.when(flag, F.col("seq")))
        .alias("_f"), F.max(flag).alias("_any"),
        F.max(flag & F.col("changes_flag")).alias("_moved"))
    out = ensure_columns(store).join(per, "transaction_id", "left")
    f = F.col("_f")
    any_flag = F.coalesce("_any", F.lit(False))

    def put(value, name):
        return F.when(any_flag, value).otherwise(F.col(name))

    return out.withColumns({
        "category_audited_at": F.when(F.coalesce("_moved", F.lit(False)), run_ts)
        .otherwise(F.col("category_audited_at")),
        "category_review_flag": put(F.lit("1"), "category_review_flag"),
        "category_review_primary": put(f["primary"], "category_review_primary"),
        "category_review_detailed": put(f["detailed"], "category_review_detailed"),
        "category_review_reason": put(f["reason"], "category_review_reason"),
        "category_review_confidence": put(F.lit(""), "category_review_confidence"),
        "category_review_source": put(F.lit(source), "category_review_source"),
        "reviewer_audited_at": F.when(F.col("_any").isNotNull(), run_ts)
        .otherwise(F.col("reviewer_audited_at")),
    }).drop("_f", "_any", "_moved")


def provenance_why(step="category_update_step", reason="category_update_reason",
                   pending="review_pending") -> Column:
    """Badge of the step that set the category, its reason, and a pending marker."""
    badge = F.lit(None).cast("string")
    for name, shown in fixed.STEP_BADGES.items():
        badge = F.when(F.col(step) == name, shown).otherwise(badge)
    told = F.when(badge.isNotNull() & (text.blank(reason) != ""),
                  F.concat(badge, F.lit(" · "), F.col(reason))).otherwise(badge)
    wait = F.when(F.col(pending), F.lit(fixed.PENDING_BADGE))
    return F.concat_ws("  ", told, wait)


def provenance_explain(cube: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows with the definition of the rule that set them and of the one that waits."""
    cols = ["kind", "origin", "trust", "pattern", "primary", "detailed"]
    setter = catalog.select(F.col("rule_id").alias("category_update_reason"),
                            F.struct(*cols).alias("set_by"))
    waits = catalog.select(F.col("rule_id").alias("review_reason"),
                           F.struct(*cols).alias("suggested_by"))
    out = cube.join(setter, "category_update_reason", "left").join(waits, "review_reason", "left")
    return out.withColumns({
        "set_by": F.when(F.col("category_update_step") != "", F.col("set_by")),
        "suggested_by": F.when(F.col("review_pending"), F.col("suggested_by"))})
