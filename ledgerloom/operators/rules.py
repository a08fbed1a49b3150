"""Mechanical rules: merchant memory, text prefixes, websites and keywords, in that order."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import dims, fixed
from ledgerloom.functions import text
from ledgerloom.operators import sieve

HIT = ("struct<primary:string,detailed:string,rule_name:string,confidence:string,trust:string,"
       "ok:boolean>")
_MENU = set(fixed.menu_pairs())


def _sql(value):
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hit_sql(kind, pattern, pair, trust):
    shown = pattern.lower().rstrip("*") if kind == "pos" else pattern
    return (f"named_struct('primary', {_sql(pair[0])}, 'detailed', {_sql(pair[1])}, 'rule_name', "
            f"{_sql(f'{kind}:{shown}')}, 'confidence', 'MEDIUM', 'trust', {_sql(trust)}, 'ok', "
            f"{str(tuple(pair) in _MENU).lower()})")


def _chain(kind, rules, test) -> Column:
    """The first rule of an ordered table that matches, valid or not."""
    if not rules:
        return F.lit(None).cast(HIT)
    whens = " ".join(f"WHEN {test(p)} THEN {_hit_sql(kind, p, pair, trust)}"
                     for _, p, pair, trust in rules)
    return F.expr(f"CASE {whens} END").cast(HIT)


def _lower(c):
    return f"lower(coalesce({c}, ''))"


POS_TEXT = f"concat({_lower('name')}, ' ', {_lower('original_description')})"
WORD_TEXT = ("lower(concat_ws(' ', nullif(merchant_name, ''), nullif(name, ''), "
             "nullif(original_description, '')))")


def pos_prefix_match(rules, text_sql=POS_TEXT) -> Column:
    """First prefix, lower-cased, found anywhere in name and description."""
    mine = [r for r in rules if r[0] == "pos_prefix"]
    return _chain("pos", mine, lambda p: f"contains({text_sql}, {_sql(p.lower())})")


def website_match(rules) -> Column:
    """First domain found in the lower-cased website; the domain itself is taken as written."""
    mine = [r for r in rules if r[0] == "website"]
    return _chain("website", mine, lambda p: f"contains({_lower('website')}, {_sql(p)})")


def keyword_match(rules, text_sql=WORD_TEXT) -> Column:
    """First keyword standing as a whole token in merchant name, name and description."""
    mine = [r for r in rules if r[0] == "keyword"]

    def test(p):
        regex = r"(?<![a-z0-9])" + text.java_quote(p) + r"(?![a-z0-9])"
        return f"(contains({text_sql}, {_sql(p)}) AND {text_sql} RLIKE {_sql(regex)})"

    return _chain("keyword", mine, test)


def _tokens(c) -> Column:
    return F.filter(F.split(c, "[^a-z0-9]+"), lambda t: t != "")


def _grams(tokens, n) -> Column:
    """Every run of n tokens, joined by a space."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def keyword_table_match(df: DataFrame, rules: DataFrame, key="transaction_id") -> DataFrame:
    """(key, hit) of the first matching keyword of a rule table of any length.

    Texts and keywords meet in an equi-join on the keyword's run of tokens, so a row only ever
    sees rules whose tokens it holds; the exact boundary test then runs on those candidates. Runs that
    no keyword has are sieved out before they are dealt.
    Keywords without a letter or digit meet the texts by their rarest characters instead.
    """
    kw = rules.filter("kind = 'keyword'").withColumn(
        "_gram", F.array_join(_tokens(F.lower("pattern")), " ")).withColumn(
        "_n", F.size(_tokens(F.lower("pattern"))))
    signs = _substrings(df, kw.filter("_n = 0"), WORD_TEXT, F.col("pattern"), key)
    kw = kw.filter("_n > 0").select("_gram", "ord", "pattern", "primary", "detailed", "trust", "_n")
    sizes = [r[0] for r in kw.select("_n").distinct().collect()]  # a handful of phrase lengths
    words = df.select(key, F.expr(WORD_TEXT).alias("_text"))
    words = words.withColumn("_t", _tokens(F.col("_text")))
    grams = [_grams(F.col("_t"), n) for n in sorted(sizes)] or [F.array().cast("array<string>")]
    bag = F.explode(F.array_distinct(F.concat(*grams)))
    held = words.select(key, "_text", bag.alias("_gram"))
    found = (held.filter(sieve.among(kw, "_gram", F.col("_gram"))).join(kw, "_gram")
             .select(key, "_text", "ord", "pattern", "primary", "detailed", "trust"))
    meant = F.concat(F.lit(r"(?<![a-z0-9])\Q"),
                     F.replace("pattern", F.lit(r"\E"), F.lit(r"\E\\E\Q")),
                     F.lit(r"\E(?![a-z0-9])"))
    return _best(found.unionByName(signs).filter(F.regexp_like("_text", meant)), key,
                 F.concat(F.lit("keyword:"), F.col("_r.pattern"))).withColumnRenamed("_hit", "_kw")


LEAD = 3


def _runs(c, size, n) -> Column:
    """Every run of n characters; for n = 0 the empty one."""
    if n == 0:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), size - n + 1)
    return F.when(size >= n, F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))


def _substrings(df: DataFrame, rules: DataFrame, text_sql: str, needle: Column, key) -> DataFrame:
    """(key, _text, rule columns) where the text holds the needle.

    Each needle is indexed under its rarest run of `LEAD` characters (all of it, if it is shorter), by how many of the
    texts hold the run, so needles with a common beginning do not meet in one key and a text meets a needle only where it
    holds its least likely part.
    """
    own = rules.withColumn("_needle", needle).filter("_needle IS NOT NULL").select(
        "_needle", "ord", "pattern", "primary", "detailed", "trust")
    length = F.length("_needle")
    sizes = sorted(r[0] for r in own.select(F.least(length, F.lit(LEAD))).distinct().collect())  # 0 to LEAD
    words, size = df.select(key, F.expr(text_sql).alias("_text")), F.length("_text")
    runs = [_runs(F.col("_text"), size, n) for n in sizes] or [F.array().cast("array<string>")]
    each = words.select(key, "_text", F.explode(F.array_distinct(F.concat(*runs))).alias("_run"))
    parts = F.array().cast("array<string>")
    for n in sizes:
        parts = F.when(F.least(length, F.lit(LEAD)) == n, _runs(F.col("_needle"), length, n)).otherwise(parts)
    of = own.select("_needle").distinct().select("_needle", F.explode(F.array_distinct(parts)).alias("_run"))
    held = each.select("_run").join(of.select("_run").distinct(), "_run", "left_semi").groupBy("_run").agg(
        F.count(F.lit(1)).alias("_texts"))
    index = of.join(held, "_run").groupBy("_needle").agg(F.min_by("_run", F.struct("_texts", "_run")).alias("_run"))
    met = each.join(index, "_run").filter(F.contains("_text", "_needle")).select(key, "_text", "_needle")
    return met.join(own, "_needle").select(key, "_text", "ord", "pattern", "primary", "detailed", "trust")


def _best(found: DataFrame, key, rule_name: Column) -> DataFrame:
    """(key, _hit): the first of the found rules by `ord`."""
    best = found.groupBy(key).agg(F.min_by(
        F.struct("primary", "detailed", "pattern", "trust"), "ord").alias("_r"))
    legal = dims.category_menu(found.sparkSession).select(
        F.col("primary").alias("_mp"), F.col("detailed").alias("_md"), F.lit(True).alias("_ok"))
    best = best.join(F.broadcast(legal), (F.col("_r.primary") == F.col("_mp"))
                     & (F.col("_r.detailed") == F.col("_md")), "left")
    hit = F.struct(F.col("_r.primary").alias("primary"), F.col("_r.detailed").alias("detailed"),
                   rule_name.alias("rule_name"), F.lit("MEDIUM").alias("confidence"),
                   F.col("_r.trust").alias("trust"), F.coalesce("_ok", F.lit(False)).alias("ok"))
    return best.select(key, hit.cast(HIT).alias("_hit"))


def pos_table_match(df: DataFrame, rules: DataFrame, key="transaction_id") -> DataFrame:
    """(key, hit) of the first matching text prefix of a rule table."""
    found = _substrings(df, rules.filter("kind = 'pos_prefix'"), POS_TEXT, F.lower("pattern"), key)
    shown = F.regexp_replace(F.lower("_r.pattern"), r"\*+$", "")
    return _best(found, key, F.concat(F.lit("pos:"), shown)).withColumnRenamed("_hit", "_pt")


def website_table_match(df: DataFrame, rules: DataFrame, key="transaction_id") -> DataFrame:
    """(key, hit) of the first matching domain of a rule table."""
    found = _substrings(df, rules.filter("kind = 'website'"), _lower("website"), F.col("pattern"),
                        key)
    return _best(found, key, F.concat(F.lit("website:"), F.col("_r.pattern"))) \
        .withColumnRenamed("_hit", "_wt")


def memory_keys():
    """The two keys a row is remembered under; null where the row has none."""
    norm = text.normalize_merchant("merchant_name")
    ent = text.or_null("merchant_entity_id")
    return (F.concat(F.lit("ent:"), ent), F.concat(F.lit("name:"), text.or_null(norm)))


def spread(key, row="transaction_id") -> Column:
    """A join key whose nulls are spread over many values that match nothing."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(row), F.lit(4096))
                                    .cast("string")))


def memory_lookup(df: DataFrame, memory: DataFrame, row: str | None = None) -> DataFrame:
    """Adds `_mem`: the entity key's entry (HIGH, auto), else the name key's (MEDIUM, flag).

    Where `row` names a column that is never null and never repeats, only it and the keys that may be remembered move to the
    memory and back, so rows that lie by that column stay where they are.
    """
    legal = dims.category_menu(df.sparkSession).select("primary", "detailed",
                                                       F.lit(True).alias("ok"))
    entries = memory.join(legal, ["primary", "detailed"], "left").select(
        "key", "primary", "detailed", F.coalesce("ok", F.lit(False)).alias("ok"))

    def side(prefix, out, rule, confidence, trust):
        return entries.filter(F.startswith("key", F.lit(prefix))).select(
            F.col("key").alias(f"{out}_key"),
            F.struct("primary", "detailed", F.lit(rule).alias("rule_name"),
                     F.lit(confidence).alias("confidence"), F.lit(trust).alias("trust"), "ok")
            .cast(HIT).alias(out))

    ent, name = memory_keys()
    e = side("ent:", "_me", "memory:entity_id", "HIGH", "auto")
    m = side("name:", "_mn", "memory:name", "MEDIUM", "flag")
    if row is not None:
        out = df
        for own, entry, out_key, hit in ((ent, e, "_ek", "_me"), (name, m, "_nk", "_mn")):
            asked = df.select(F.col(row).alias(out_key), own.alias("_own")).filter(
                sieve.among(entry, f"{hit}_key", F.col("_own")))
            known = asked.join(entry, F.col("_own") == F.col(f"{hit}_key")).select(out_key, hit)
            out = out.join(known, F.col(row) == F.col(out_key), "left")
        return out.withColumn("_mem", F.coalesce("_me", "_mn")).drop("_ek", "_nk", "_me", "_mn")
    out = df.withColumns({"_ek": spread(ent), "_nk": spread(name)})
    out = out.join(e, F.col("_ek") == F.col("_me_key"), "left")
    out = out.join(m, F.col("_nk") == F.col("_mn_key"), "left")
    return out.withColumn("_mem", F.coalesce("_me", "_mn")).drop(
        "_ek", "_nk", "_me_key", "_mn_key", "_me", "_mn")


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later filters and projections refer to but never copy.

    The optimizer pastes a projected expression into every filter above it; a one-element
    explode is a boundary it does not push through, so a long rule chain runs once per row.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def rule_cascade(df: DataFrame, memory: DataFrame | None = None, overlay=(),
                 keyword_table: DataFrame | None = None, row: str | None = None) -> DataFrame:
    """Adds `hit`: the first valid one among the first matches of each table, in fixed order.

    A first match that is off the menu does not fall to the next rule of its table, only to the
    next table. `overlay` is a short rule list put in front; `keyword_table` a long one; `row` as in
    `memory_lookup`.
    """
    rules = [r for r in overlay if dims.well_formed(r)] + list(fixed.RULES)
    out = memory_lookup(df, memory, row) if memory is not None else df.withColumn(
        "_mem", F.lit(None).cast(HIT))
    # every rule looks at the same two texts, which are put together once a row
    out = compute_once(out, "_texts", F.struct(F.expr(POS_TEXT).alias("pos"), F.expr(WORD_TEXT).alias("word")))
    pos, web = pos_prefix_match(rules, "_texts.pos"), website_match(rules)
    word = keyword_match(rules, "_texts.word")
    if keyword_table is not None:
        kinds = {r[0] for r in keyword_table.select("kind").distinct().collect()}
        if "pos_prefix" in kinds:
            out = out.join(pos_table_match(df, keyword_table), "transaction_id", "left")
            pos = F.coalesce("_pt", pos)
        if "website" in kinds:
            out = out.join(website_table_match(df, keyword_table), "transaction_id", "left")
            web = F.coalesce("_wt", web)
        if "keyword" in kinds:
            out = out.join(keyword_table_match(df, keyword_table), "transaction_id", "left")
            word = F.coalesce("_kw", word)
    out = out.withColumns({"_pos": pos, "_web": web, "_word": word})
    first = F.coalesce(*[F.when(F.col(c)["ok"], F.col(c)) for c in ("_mem", "_pos", "_web",
                                                                   "_word")])
    return compute_once(out, "hit", first).drop("_mem", "_pos", "_web", "_word", "_pt", "_wt", "_kw",
                                             "_texts")


def rule_catalog(rules: DataFrame) -> DataFrame:
    """Rules with the id they leave on rows, plus the two memory ids."""
    told = rules.select(dims.rule_id().alias("rule_id"), "kind", "pattern", "primary", "detailed",
                        "trust", "origin")
    remembered = dims.literal(rules.sparkSession, [
        ("memory:entity_id", "merchant memory",
         "exact merchant_entity_id remembered from a past resolution", "(per merchant)",
         "(per merchant)", "auto", "memory"),
        ("memory:name", "merchant memory",
         "normalized merchant-name remembered from a past resolution", "(per merchant)",
         "(per merchant)", "flag", "memory")],
        "rule_id string, kind string, pattern string, primary string, detailed string, "
        "trust string, origin string")
    return told.unionByName(remembered)


def rule_match_scan(hits: DataFrame) -> DataFrame:
    """Rows per rule the cascade would hit now."""
    return hits.filter("hit IS NOT NULL").groupBy(F.col("hit.rule_name").alias("rule_id")).agg(
        F.count(F.lit(1)).alias("matches_now"))


def matched_rows(hits: DataFrame) -> DataFrame:
    """Summary of each matched row next to the rule that catches it."""
    pfc = F.col("personal_finance_category")
    shown = [F.coalesce(pfc[c], F.lit("None")) for c in ("primary", "detailed")]
    return hits.filter("hit IS NOT NULL").select(
        F.col("hit.rule_name").alias("rule_id"), "transaction_id", "date",
        F.coalesce(text.or_null("merchant_name"), F.col("name")).alias("description"), "amount",
        F.concat(shown[0], F.lit(" / "), shown[1]).alias("current_category"))


def rule_usage(rules: DataFrame, hits: DataFrame, store: DataFrame) -> DataFrame:
    """Per rule: rows it would hit, rows whose category it set, its flags that wait.

    Applied and pending counts come from one pass over the store.
    """
    told = store.select(F.explode(F.array(
        F.struct(F.when(F.col("category_update_step") == "mechanical",
                        F.col("category_update_reason")).alias("rule_id"),
                 F.lit(1).alias("a"), F.lit(0).alias("p")),
        F.struct(F.when((F.col("category_review_flag") == "1")
                        & (F.col("category_review_source") == "mechanical"),
                        F.col("category_review_reason")).alias("rule_id"),
                 F.lit(0).alias("a"), F.lit(1).alias("p")))).alias("u")).select("u.*")
    used = told.filter("rule_id IS NOT NULL").groupBy("rule_id").agg(
        F.sum("a").alias("applied_now"), F.sum("p").alias("flags_pending"))
    out = rules.withColumn("rule_id", dims.rule_id()).join(rule_match_scan(hits), "rule_id", "left")
    return out.join(used, "rule_id", "left").fillna(
        0, subset=["matches_now", "applied_now", "flags_pending"])


def memory_usage(memory: DataFrame, hits: DataFrame) -> DataFrame:
    """Memory entries with the rows each matches now."""
    ent, name = memory_keys()
    rule = F.col("hit.rule_name")
    key = F.when(rule == "memory:entity_id", ent).when(rule == "memory:name", name)
    used = (hits.filter(F.startswith(rule, F.lit("memory:"))).groupBy(key.alias("key"))
            .agg(F.count(F.lit(1)).alias("matches_now")))
    return memory.join(used, "key", "left").select(
        "key", F.when(F.startswith("key", F.lit("ent:")), "entity id (auto)")
        .otherwise("name (flag)").alias("match"),
        F.expr("substring(key, instr(key, ':') + 1)").alias("merchant"),
        "primary", "detailed", F.coalesce("matches_now", F.lit(0)).alias("matches_now"))


def budget_category_map(df: DataFrame, pinned, drop_primary, drop_detailed, detailed_map,
                        primary_map) -> DataFrame:
    """The second taxonomy: pinned description tokens, then drops, detailed map, primary map.

    Adds `budget_category` (null when dropped or unmapped) and `mapped_by`.
    """
    body = F.lower(F.concat_ws(" ", "merchant_name", "name", "original_description"))
    pin = F.lit(None).cast("string")
    for category, tokens in reversed(pinned):
        hit = dims.any_of([F.contains(body, F.lit(t.lower())) for t in tokens])
        pin = F.when(hit, category).otherwise(pin)
    p, d = F.col("pfc_primary"), F.col("pfc_detailed")
    dropped = F.coalesce(p.isin(*drop_primary), F.lit(False)) | F.coalesce(
        d.isin(*drop_detailed), F.lit(False))
    spark = df.sparkSession
    dm = dims.literal(spark, list(detailed_map.items()), "_d string, _dc string")
    pm = dims.literal(spark, list(primary_map.items()), "_p string, _pc string")
    out = (df.withColumns({"_pin": pin, "_drop": dropped})
           .join(F.broadcast(dm), d == F.col("_d"), "left")
           .join(F.broadcast(pm), p == F.col("_p"), "left"))
    by = (F.when(F.col("_pin").isNotNull(), "pinned").when(F.col("_drop"), "dropped")
          .when(F.col("_dc").isNotNull(), "detailed").when(F.col("_pc").isNotNull(), "primary")
          .otherwise("unmapped"))
    category = F.coalesce("_pin", F.when(~F.col("_drop"), F.coalesce("_dc", "_pc")))
    return out.withColumns({"mapped_by": by, "budget_category": category}).drop(
        "_pin", "_drop", "_d", "_dc", "_p", "_pc")


def legacy_category_migration(df: DataFrame, primary="pfc_primary",
                              detailed="pfc_detailed") -> DataFrame:
    """Retired leaves become their current pair; the rest stays."""
    remap = dims.literal(df.sparkSession, fixed.RETIRED_REMAP,
                         "_old string, _np string, _nd string")
    out = df.join(F.broadcast(remap), F.col(detailed) == F.col("_old"), "left")
    return out.withColumns({primary: F.coalesce("_np", primary),
                            detailed: F.coalesce("_nd", detailed)}).drop("_old", "_np", "_nd")
