import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom import dims, schema
from ledgerloom.operators import authority, diff, intents, project, rules, sweeps
from ledgerloom.plans import audit
from ledgerloom.plans.lineage import cut
from ledgerloom.sources import files

RUN = "2026-02-01T00:00:00"
RIDE = ("TRANSPORTATION", "TRANSPORTATION_TAXIS_AND_RIDE_SHARES")
COFFEE = ("FOOD_AND_DRINK", "FOOD_AND_DRINK_COFFEE")
MEAL = ("FOOD_AND_DRINK", "FOOD_AND_DRINK_RESTAURANT")
WAGES = ("INCOME", "INCOME_WAGES")
GOODS = ("GENERAL_MERCHANDISE", "GENERAL_MERCHANDISE_OTHER_GENERAL_MERCHANDISE")


def memory(spark, *entries):
    return spark.createDataFrame([(k, *p) for k, p in entries],
                                 "key string, primary string, detailed string")


def hit_of(df, **kw):
    return {r["transaction_id"]: r["hit"] and (r["hit"]["rule_name"], r["hit"]["trust"])
            for r in rules.rule_cascade(df, **kw).select("transaction_id", "hit").collect()}


def test_given_signals_when_cascaded_then_memory_pos_website_keyword(spark, make):
    df = make(
        {"transaction_id": "mem", "merchant_entity_id": "e1", "name": "TST* x"},
        {"transaction_id": "memname", "merchant_entity_id": "e9", "merchant_name": "Corner Shop"},
        {"transaction_id": "pos", "name": "tst* cafe", "website": "uber.com"},
        {"transaction_id": "web", "website": "WWW.UBER.COM"},
        {"transaction_id": "kw", "merchant_name": "Uber Eats"},
        {"transaction_id": "part", "merchant_name": "Hubertize"},
        {"transaction_id": "badmem", "merchant_entity_id": "e2", "website": "lyft.com"})
    got = hit_of(df, memory=memory(spark, ("ent:e1", COFFEE), ("ent:e2", ("TRAVEL", "TRAVEL_MOON")),
                                   ("name:corner shop", COFFEE)))
    assert got == {"mem": ("memory:entity_id", "auto"), "memname": ("memory:name", "flag"),
                   "pos": ("pos:tst", "flag"), "web": ("website:uber.com", "flag"),
                   "kw": ("keyword:uber", "flag"), "part": None,
                   "badmem": ("website:lyft.com", "flag")}


def test_given_invalid_first_keyword_when_cascaded_then_no_later_keyword(spark, make):
    df = make({"transaction_id": "a", "merchant_name": "uber shell"})
    assert hit_of(df, overlay=[("keyword", "uber", ("TRAVEL", "NOPE"), "auto")]) == {"a": None}
    assert hit_of(df, overlay=[("keyword", "SHELL", COFFEE, "auto"), ("broken",)]) == {
        "a": ("keyword:uber", "flag")}


def test_given_a_rule_table_when_matched_then_equal_to_the_literal_chain(spark, make):
    words = ["corner shop", "shop", "co-op", "a b c", "x2", "deli's", "shop 7"]
    overlay = [("keyword", w, COFFEE, "auto") for w in words]
    table = spark.createDataFrame([("keyword", i, w, *COFFEE, "auto") for i, w in enumerate(words)],
                                  "kind string, ord int, pattern string, primary string, "
                                  "detailed string, trust string")
    texts = ["Corner Shop", "the CO-OP!", "coop", "a  b c", "a b c", "x2x", "x2", "deli's", "delis",
             "workshop", "shop 7", "corner-shop", "shop  7"]
    df = make(*[{"transaction_id": str(i), "merchant_name": t, "name": "zz",
                 "original_description": None} for i, t in enumerate(texts)])
    chain = {r[0]: r[1] for r in rows(df.select("transaction_id", rules.keyword_match(overlay)[
        "rule_name"]))}
    long = {r[0]: r[1] for r in rows(rules.keyword_table_match(df, table).select(
        "transaction_id", "_kw.rule_name"))}
    assert long == {k: v for k, v in chain.items() if v}


def test_given_all_kinds_in_a_rule_table_when_cascaded_then_equal_to_the_list(spark, make):
    rules_ = [("pos_prefix", "SQX*", COFFEE, "auto"), ("pos_prefix", "q", GOODS, "flag"), ("website", "shop.test", COFFEE, "auto"),
              ("keyword", "!!", COFFEE, "auto"), ("keyword", r"a\\Eb", GOODS, "auto"), ("keyword", "plain", COFFEE, "flag")]
    table = spark.createDataFrame([(k, i, p, *c, t) for i, (k, p, c, t) in enumerate(rules_)],
                                  "kind string, ord int, pattern string, primary string, detailed string, trust string")
    df = make(*[{"transaction_id": str(i), "merchant_name": m, "name": n, "original_description": None, "website": w}
                for i, (m, n, w) in enumerate([("zz", "SQX* STORE", None), ("zz", "zq", ""), ("zz", "z", "www.shop.test/x"),
                                               ("wow !! yes", "z", None), ("wow!!yes", "z", None), (r"a\\Eb", "z", None),
                                               ("plain", "z", None), ("none", "z", None)])])
    listed = rows(rules.rule_cascade(df, overlay=rules_).select("transaction_id", "hit.rule_name", "hit.primary"))
    assert sorted(map(str, listed)) == sorted(map(str, rows(
        rules.rule_cascade(df, keyword_table=table).select("transaction_id", "hit.rule_name", "hit.primary"))))
    assert sum(r[1] is not None for r in listed) >= 5


def test_given_a_log_merged_twice_when_ordered_then_later_entries_stay_later(spark):
    def log(*entries):
        return spark.createDataFrame(entries, "id string, seq long, action string")

    once = intents.intent_log_merge(log(("b", 1, "edit"), ("c", 2, "edit")), log(("a", 5, "edit")))
    twice = intents.intent_log_merge(log(("d", 1, "edit"), ("a", 5, "edit")), once)
    assert [r[0] for r in twice.orderBy("part", "seq", "id").collect()] == ["a", "b", "c", "d"]


CASES = [
    # rule, reviewer, confidence, amount, authority, current -> action, source
    ((COFFEE, "auto"), None, "HIGH", 5, "flag", GOODS, "apply", "mechanical"),
    ((COFFEE, "auto"), (*RIDE, "HIGH"), "LOW", 5, "final", GOODS, "apply", "mechanical"),
    ((COFFEE, "auto"), None, "LOW", 5, "flag", COFFEE, "none", ""),
    ((COFFEE, "flag"), None, "LOW", 5, "final", GOODS, "flag", "mechanical"),
    ((COFFEE, "flag"), None, "LOW", 5, "flag", MEAL, "none", ""),
    ((COFFEE, "flag"), (*GOODS, "HIGH"), "LOW", 5, "flag", GOODS, "none", ""),
    ((COFFEE, "flag"), (*RIDE, "HIGH"), "LOW", 5, "flag", GOODS, "flag", "llm"),
    (None, (*RIDE, "HIGH"), "LOW", 5, "apply_when_high", GOODS, "apply", "llm"),
    (None, (*RIDE, "LOW"), "LOW", 5, "apply_when_high", GOODS, "flag", "llm"),
    (None, (*RIDE, "HIGH"), "VERY_HIGH", 5, "apply_when_high", GOODS, "flag", "llm"),
    (None, (*RIDE, "LOW"), "LOW", 5, "final", GOODS, "apply", "llm"),
    (None, (*RIDE, "LOW"), "high", 5, "final", GOODS, "flag", "llm"),
    (None, (*WAGES, "HIGH"), "LOW", 5, "final", GOODS, "none", ""),
    (None, (*WAGES, "HIGH"), "LOW", -5, "final", GOODS, "apply", "llm"),
    (None, (*WAGES, "HIGH"), "LOW", None, "flag", GOODS, "flag", "llm"),
    ((COFFEE, "flag"), (*WAGES, "HIGH"), "LOW", 5, "flag", GOODS, "none", ""),
    (None, (*MEAL, "HIGH"), "LOW", 5, "flag", COFFEE, "none", ""),
    (None, (*MEAL, "HIGH"), "LOW", 5, "final", COFFEE, "apply", "llm"),
]


@pytest.mark.parametrize("level", ["flag", "apply_when_high", "final"])
def test_given_authority_matrix_when_decided_then_action(spark, make, level):
    cases = [(i, c) for i, c in enumerate(CASES) if c[4] == level]
    df = make(*[{"transaction_id": str(i), "confidence": c[2], "amount": c[3],
                 "primary": c[5][0], "detailed": c[5][1]} for i, c in cases])
    extra = [(str(i), (*c[0][0], "r", "MEDIUM", c[0][1], True) if c[0] else None,
              (*c[1][:2], "why", c[1][2]) if c[1] else None) for i, c in cases]
    side = spark.createDataFrame(
        extra, f"transaction_id string, hit {rules.HIT}, reviewer struct<primary:string,"
               "detailed:string,reason:string,confidence:string>")
    out = authority.decide(df.join(side, "transaction_id"), level)
    got = {r[0]: (r[1], r[2]) for r in rows(out, "transaction_id", "decision.action",
                                            "decision.source")}
    assert got == {str(i): (c[6], c[7]) for i, c in cases}


def test_given_a_second_correction_when_applied_then_originals_stay(make):
    df = authority.ensure_columns(make({}))
    one = authority.set_provenance(df, F.lit(True), F.lit(COFFEE[0]), F.lit(COFFEE[1]),
                                   F.lit("mechanical"), F.lit("r1"), F.lit("HIGH"), "t1")
    two = authority.set_provenance(one.drop("applied"), F.lit(True), F.lit(RIDE[0]),
                                   F.lit(RIDE[1]), F.lit("review"), F.lit("r2"), F.lit(""), "t2")
    r = two.first()
    assert (r["original_pf_category_primary"], r["original_pf_category_confidence"]) == (
        GOODS[0], "LOW")
    assert r["personal_finance_category"]["confidence_level"] == "CORRECTED"
    assert (r["category_update_step"], r["category_audited_at"]) == ("review", "t2")
    same = authority.set_provenance(two.drop("applied"), F.lit(True), F.lit(RIDE[0]),
                                    F.lit(RIDE[1]), F.lit("x"), F.lit("x"), F.lit("x"), "t3")
    assert (same.first()["applied"], same.first()["category_audited_at"]) == (False, "t2")


def test_given_flags_when_raised_again_then_stamp_stays_and_clear_is_idempotent(make):
    args = [F.lit(x) for x in (*RIDE, "why", "LOW", "llm")]
    one = authority.set_review_flag(authority.ensure_columns(make({})), F.lit(True), *args, "t1")
    two = authority.set_review_flag(one.drop("flagged"), F.lit(True), *args, "t2").first()
    assert (two["flagged"], two["category_audited_at"]) == (True, "t1")
    gone = authority.clear_review_flag(one, F.lit(True), "t3")
    again = authority.clear_review_flag(gone, F.lit(True), "t4").first()
    assert (again["category_review_flag"], again["category_audited_at"]) == ("", "t3")


def verdicts(spark, *vs):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(vs)],
                                 "seq long, transaction_id string, verdict string, "
                                 "primary string, detailed string, reason string")


def test_given_verdicts_when_applied_then_outcomes_and_last_differing_flag(spark, make):
    store = make(*[{"transaction_id": t} for t in "abcde"])
    vs = verdicts(spark, ("a", "flag", *COFFEE, "one"), ("a", "Flag", *RIDE, None),
                  ("a", "ok", None, None, None), ("b", "ok", None, None, None),
                  ("c", "flag", *GOODS, "same"), ("d", "flag", "FOOD_AND_DRINK", "MOON", "x"),
                  ("e", "flag", "NOWHERE", "MOON", "x"), ("zz", "flag", *COFFEE, "x"))
    menu = dims.category_menu(spark)
    judged = authority.judge_verdicts(store, vs, menu)
    got = [r[1] for r in sorted((r["seq"], r["outcome"]) for r in judged.collect())]
    assert got == ["flagged", "flagged", "ok", "ok", "ok", "flagged", "invalid", "unknown"]
    out = {r["transaction_id"]: r for r in authority.apply_verdicts(store, judged, RUN).collect()}
    assert (out["a"]["category_review_detailed"], out["a"]["category_review_reason"]) == (
        RIDE[1], "")
    assert out["d"]["category_review_detailed"] == "FOOD_AND_DRINK_OTHER_FOOD_AND_DRINK"
    assert [out[t]["reviewer_audited_at"] for t in "abcde"] == [RUN] * 4 + [""]
    kept = authority.apply_verdicts(
        authority.apply_verdicts(store, judged, RUN),
        authority.judge_verdicts(store, verdicts(spark, ("a", "ok", None, None, None)), menu),
        "later").filter("transaction_id = 'a'").first()
    assert (kept["category_review_flag"], kept["category_audited_at"],
            kept["reviewer_audited_at"]) == ("1", RUN, "later")
    assert [r[0] for r in rows(project.reviewer_queue(
        authority.apply_verdicts(store, judged, RUN)), "transaction_id")] == ["e"]


def intent(seq, id, **kw):
    base = {"seq": seq, "id": id, "action": "edit", "source": "ui"}
    return {**base, **kw}


def txn(seq, id, tid, pair=COFFEE, **kw):
    return intent(seq, id, scope="transaction", match={"transaction_id": tid},
                  set=dict(zip(("primary", "detailed"), pair)), **kw)


def shop(seq, id, pair=COFFEE, ent=None, name=None, **kw):
    match = {k: v for k, v in (("merchant_entity_id", ent), ("merchant_name_normalized", name))
             if v}
    return intent(seq, id, scope="merchant", match=match,
                  set=dict(zip(("primary", "detailed"), pair)), **kw)


def log(spark, tmp_path, *entries):
    f = tmp_path / "log.jsonl"
    f.write_text("\n".join([json.dumps(e) for e in entries] + ["{corrupt", ""]))
    return files.read_intents(spark, str(f))


def test_given_a_log_when_resolved_then_only_applicable_intents(spark, tmp_path):
    entries = log(spark, tmp_path, txn(1, "a", "t1"), shop(2, "b", ent="e"),
                  intent(3, "r", action="revoke", revokes="b"), intent(4, "c", action="merge"),
                  intent(5, "d", scope="galaxy"), shop(6, "e"), txn(7, "f", None),
                  shop(8, "g", ("TRAVEL", "MOON"), ent="e"),
                  intent(9, "h", scope="merchant", match={"merchant_entity_id": "e", "city": "x"},
                         set={"primary": COFFEE[0], "detailed": COFFEE[1]}))
    judged = intents.judge_intents(entries, dims.category_menu(spark))
    assert {r["id"]: r["reject"] for r in judged.collect()} == {
        "a": None, "b": "revoked", "r": "revoke", "c": "unknown action", "d": "unknown scope",
        "e": "no merchant key", "f": "no transaction id", "g": "invalid category",
        "h": "unknown match key"}


def test_given_intents_when_matched_then_specific_then_latest_with_veto(spark, make, tmp_path):
    df = make({"transaction_id": "t1", "merchant_entity_id": "e1", "merchant_name": "Shop"},
              {"transaction_id": "t2", "merchant_entity_id": "e1", "merchant_name": "Shop"},
              {"transaction_id": "t3", "merchant_entity_id": "e2", "merchant_name": "Shop"},
              {"transaction_id": "t4", "merchant_entity_id": None, "merchant_name": "Shop"},
              {"transaction_id": "t5", "merchant_entity_id": None, "merchant_name": None})
    entries = log(spark, tmp_path, txn(1, "own", "t1"), shop(2, "old", ent="e1", name="shop"),
                  shop(3, "free", name="shop"), shop(4, "new", ent="e1", name="shop"))
    out = intents.match_intents(df, intents.resolve_intents(entries, dims.category_menu(spark)))
    assert {r[0]: r[1] for r in rows(out, "transaction_id", "intent.id")} == {
        "t1": "own", "t2": "new", "t3": None, "t4": "new", "t5": None}


def test_given_replay_when_revoked_then_reverted_and_replay_is_idempotent(spark, make, tmp_path):
    menu = dims.category_menu(spark)
    df = authority.ensure_columns(make({"transaction_id": "t1"}, {"transaction_id": "t2"}))
    one = intents.resolve_intents(log(spark, tmp_path, txn(1, "a", "t1"), txn(2, "gone", "zz")),
                                  menu)
    first = intents.replay_intents(df, one, "r1")
    assert rows(first, "transaction_id", "replay") == [("t1", "applied"), ("t2", None)]
    again = intents.replay_intents(first.drop("intent", "replay"), one, "r2")
    assert rows(again, "transaction_id", "replay", "category_audited_at")[0] == (
        "t1", "already", "r1")
    assert rows(intents.orphan_intents(df, one)) == [("gone", "zz")]
    none = one.limit(0)
    back = intents.replay_intents(first.drop("intent", "replay"), none, "r3").filter(
        "transaction_id = 't1'").first()
    assert back["replay"] == "reverted"
    assert back["personal_finance_category"]["detailed"] == GOODS[1]
    assert back[schema.HASH_COLUMN] == "pending:manual-edit-revoked"


def test_given_two_copies_when_reconciled_then_classes_and_winners(spark, make):
    extra = ["category_audited_at"]
    local = make({"transaction_id": "same", "txn_owner": "x", "category_audited_at": "3"},
                 {"transaction_id": "l"},
                 {"transaction_id": "newer", "amount": 1, "category_audited_at": "2"},
                 {"transaction_id": "tie", "amount": 1, "category_audited_at": "2"},
                 {"transaction_id": "none", "amount": 1}, extra=extra).drop("seq")
    remote = make({"transaction_id": "same", "txn_owner": None, "category_audited_at": "9"},
                  {"transaction_id": "r"},
                  {"transaction_id": "newer", "amount": 2, "category_audited_at": "1"},
                  {"transaction_id": "tie", "amount": 2, "category_audited_at": "2"},
                  {"transaction_id": "none", "amount": 2, "category_audited_at": "1"},
                  extra=extra).drop("seq")
    out = diff.adopt_head(local, remote)
    got = {r[0]: (r[1], r[2], float(r[3])) for r in rows(
        out, "transaction_id", "sync_class", "merged.txn_owner", "merged.amount")}
    assert got == {"same": ("in_sync", "x", 7.25), "l": ("local_only", "u1", 7.25),
                   "r": ("remote_only", "u1", 7.25), "newer": ("conflict", "u1", 1.0),
                   "tie": ("conflict", "u1", 2.0), "none": ("conflict", "u1", 2.0)}
    with pytest.raises(diff.GateError):
        diff.unresolved_gate(out)
    diff.unresolved_gate(out, remote)
    plain = diff.reconcile(local, remote, metadata=schema.METADATA_COLUMNS)
    assert plain.filter("transaction_id = 'newer'").first()["merged"]["amount"] == 2


def test_given_no_settled_rows_when_windowed_then_backfill(make):
    df = make({"transaction_id": "a", "pending": True, "date": "2020-01-01"})
    assert diff.repair_window(df, "2026-01-31").first()["start_date"] == "2020-01-01"
    late = make({"transaction_id": "a", "pending": True, "date": "2026-01-30"})
    assert diff.repair_window(late, "2026-01-31").first()["start_date"] == "2024-02-01"


def test_given_failed_item_when_overfetched_then_merged_but_never_stale(spark, make):
    store = make({"transaction_id": "s1", "account_id": "A", "date": "2026-01-10"},
                 {"transaction_id": "s2", "account_id": "B", "date": "2026-01-10"},
                 {"transaction_id": "tail", "account_id": "A", "date": "2026-01-30"},
                 {"transaction_id": "old", "account_id": "A", "date": "2025-01-10"}).drop("seq")
    fresh = make({"transaction_id": "n1", "account_id": "A"},
                 {"transaction_id": "n2", "account_id": "B"}).drop("seq")
    fresh = fresh.withColumn("item_ok", F.col("account_id") == "A")
    assert rows(diff.overfetch_classify(store, fresh, "2026-01-31")) == [
        ("n1", "added"), ("n2", "added"), ("s1", "stale")]
    assert diff.overfetch_classify(store, fresh.withColumn("item_ok", F.lit(False)),
                                   "2026-01-31").count() == 0
    assert diff.overfetch_merge(store, fresh).count() == 6


def test_given_owner_mismatch_when_backfilled_then_abort(make):
    ok = make({"transaction_id": "a", "txn_owner": None}, {"transaction_id": "b"})
    assert {r[0] for r in diff.owner_backfill(ok, "u1").select("txn_owner").collect()} == {"u1"}
    with pytest.raises(diff.GateError):
        diff.owner_backfill(ok, "u2")
    with pytest.raises(ValueError, match="u1"):
        diff.owner_filter(ok, "nobody")


def test_given_runs_when_audited_then_delta_stamps_and_gates(spark, make, tmp_path):
    src = [{"transaction_id": "u", "merchant_name": "Uber"},
           {"transaction_id": "f", "name": "COT*FLT 12"}, {"transaction_id": "m"},
           {"transaction_id": "p", "pending": True}]
    empty = make(*src).limit(0).drop("seq")
    entries = log(spark, tmp_path, txn(1, "i1", "m"))
    one = audit.audit_run(make(*src), empty, "r1", log=entries, memory=memory(spark, ("ent:x", COFFEE)))
    got = {r[0]: r[1:] for r in rows(one.store, "transaction_id", "category_update_step",
                                     "category_review_flag", "category_audited_at")}
    assert got == {"u": ("", "1", "r1"), "f": ("mechanical", "", "r1"), "m": ("manual", "", "r1"),
                   "p": ("", "", "r1")}
    assert sorted(r[0] for r in rows(one.changes, "transaction_id")) == ["f", "m"]
    assert [r[0] for r in rows(one.worklist, "transaction_id")] == ["u"]
    assert one.memory.filter("key = 'ent:ent_harborlane'").first()["detailed"] == "TRAVEL_FLIGHTS"
    prior = cut(one.store)
    src[0]["amount"] = 9
    src[3] = {"transaction_id": "q", "pending_transaction_id": "p"}
    two = audit.audit_run(make(*src), prior, "r2", log=entries)
    assert {r[0]: r[1] for r in rows(two.delta, "transaction_id", "delta_class")} == {
        "u": "changed", "f": "carryover", "m": "carryover", "p": "removed", "q": "new"}
    again = audit.audit_run(make(*src), cut(two.store), "r3", log=entries, full=True)
    assert {r[1] for r in rows(again.store, "transaction_id", "category_audited_at")} <= {
        "r1", "r2", "r3"}
    stamps = dict(rows(again.store, "transaction_id", "category_audited_at"))
    assert stamps["f"] == "r1" and stamps["q"] == "r2"
    with pytest.raises(diff.GateError):
        audit.audit_run(make(src[0]), prior, "r4")
    with pytest.raises(diff.GateError):
        audit.audit_run(make(src[0]).limit(0), prior, "r4")


def test_given_a_scorer_when_applied_then_salvaged(spark, make):
    def scorer(frames):
        for f in frames:
            f["primary"] = ["FOOD_AND_DRINK", "NOWHERE"][:len(f)]
            f["detailed"], f["reason"], f["confidence"] = "MOON", "because", "LOW"
            yield f[["transaction_id", "primary", "detailed", "reason", "confidence"]]

    df = make({"transaction_id": "a"}, {"transaction_id": "b"}).coalesce(1)
    out = audit.reviewer_apply(df, scorer, dims.category_menu(spark))
    assert rows(out, "transaction_id", "detailed") == [
        ("a", "FOOD_AND_DRINK_OTHER_FOOD_AND_DRINK")]


def test_given_a_store_when_swept_then_findings(spark, make):
    df = make({"transaction_id": "none", "primary": None, "detailed": None},
              {"transaction_id": "bad", "detailed": "MOON"},
              {"transaction_id": "sign", "primary": WAGES[0], "detailed": WAGES[1]},
              {"transaction_id": "old", "pending": True, "date": "2026-01-01"},
              {"transaction_id": "new", "pending": True, "date": "2026-01-20"})
    got = sweeps.audit_scan(df, "2026-01-31", memory(spark, ("ent:ent_harborlane", GOODS)),
                            outliers=2)
    by = {}
    for sweep, id_, _ in rows(got):
        by.setdefault(sweep, set()).add(id_)
    assert by == {"uncategorized": {"none"}, "taxonomy_invalid": {"bad"},
                  "sign_violations": {"sign"}, "stale_pending": {"old"},
                  "memory_conflicts": {"none", "bad", "sign"},
                  "entity_inconsistent": {"ent_harborlane"}, "amount_outliers": {"sign", "old"}}


def test_given_a_long_table_when_matched_by_rarest_run_then_as_one_by_one(spark, make):
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc*") for _ in range(n))
    texts = [{"transaction_id": f"t{k}", "name": word(12), "original_description": None} for k in range(40)]
    patterns = sorted({word(rng.randrange(1, 6)) for _ in range(60)} | {"nowhere", "ab"})
    table = spark.createDataFrame([("pos_prefix", i, p, "TRAVEL", "TRAVEL_FLIGHTS", "auto") for i, p in enumerate(patterns)],
                                  "kind string, ord int, pattern string, primary string, detailed string, trust string")
    got = rules.pos_table_match(make(*texts), table).select("transaction_id", "_pt.rule_name").collect()
    want = []
    for t in texts:
        first = next((p for p in patterns if p in t["name"] + " "), None)
        if first is not None:
            want.append((t["transaction_id"], "pos:" + first.rstrip("*")))
    assert sorted(tuple(r) for r in got) == sorted(want)
