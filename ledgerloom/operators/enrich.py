"""Enrichment: category tiers, flow, time, geography, merchant, account and recurrence."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import dims, fixed
from ledgerloom.functions import text


def resolve_taxonomy(df: DataFrame, atom_dim: DataFrame | None = None,
                     overrides=None) -> DataFrame:
    """atom, tier0..2 and `unmapped`, then merchant overrides of tier1 and tier2."""
    known = dims.atoms(df.sparkSession) if atom_dim is None else atom_dim
    known = known.select("atom", F.col("tier0").alias("_t0"), F.col("tier1").alias("_t1"),
                         F.col("tier2").alias("_t2"))
    atom = F.coalesce(text.or_null("pfc_detailed"), F.lit("OTHER_OTHER"))
    fallback0 = F.lit("Discretionary")
    for primary, tier in fixed.UNMAPPED_TIER0.items():
        fallback0 = F.when(F.col("pfc_primary") == primary, tier).otherwise(fallback0)
    fallback1 = text.title(F.coalesce(text.or_null("pfc_primary"), F.lit("OTHER")))
    # a left join on a small key set: size decides broadcast, skewed atoms never shuffle then
    out = df.withColumn("atom", atom).join(known, "atom", "left")
    out = out.withColumns({
        "unmapped": F.col("_t0").isNull(),
        "tier0": F.coalesce("_t0", fallback0),
        "tier1": F.coalesce("_t1", fallback1),
        "tier2": F.coalesce("_t2", F.lit("Other")),
    }).drop("_t0", "_t1", "_t2")
    return merchant_override(out, overrides)


def merchant_override(df: DataFrame, overrides=None) -> DataFrame:
    """First rule that fully matches the entity id or is found in the merchant name."""
    rules = dims.valid_overrides(
        df.sparkSession, fixed.MERCHANT_OVERRIDES if overrides is None else overrides)
    picked = F.lit(None).cast("struct<tier1:string,tier2:string>")
    for regex, one, two in reversed(rules):
        hit = (F.coalesce(F.col("merchant_name").rlike(regex)
                          & (F.col("merchant_name") != ""), F.lit(False))
               | F.coalesce(F.col("merchant_entity_id").rlike(f"^(?:{regex})\\z")
                            & (F.col("merchant_entity_id") != ""), F.lit(False)))
        spec = F.struct(F.lit(one).cast("string").alias("tier1"),
                        F.lit(two).cast("string").alias("tier2"))
        picked = F.when(hit, spec).otherwise(picked)
    return df.withColumn("_ov", picked).withColumns({
        "tier1": F.coalesce(F.col("_ov")["tier1"], "tier1"),
        "tier2": F.coalesce(F.col("_ov")["tier2"], "tier2")}).drop("_ov")


def exclude_flow(df: DataFrame, globs=None) -> DataFrame:
    """flow (excluded / income / spend) and the disjoint spend and income measures."""
    globs = fixed.EXCLUDE_GLOBS if globs is None else globs
    flow = (F.when(text.glob_match(text.or_null("pfc_detailed"), globs), "excluded")
            .when(F.col("direction") == "in", "income").otherwise("spend"))
    size, zero = F.abs("amount"), F.lit(0).cast("decimal(18,2)")
    return df.withColumns({"flow": flow, "abs_amount": size}).withColumns({
        "spend": F.when(F.col("flow") == "spend", size).otherwise(zero),
        "income": F.when(F.col("flow") == "income", size).otherwise(zero),
        "count": F.lit(1).cast("long"),
    })


def time_dims(df: DataFrame) -> DataFrame:
    """Resolved date (authorized, else posted; '' falls through) and its calendar levels."""
    iso = F.coalesce(text.or_null("authorized_date"), F.col("posted_date"))
    d = text.parse_date(iso)
    out = df.withColumns({"date_resolved": iso, "day": d})
    day = F.col("day")
    out = out.withColumns({
        "year": F.year(day),
        "quarter": F.concat(F.lit("Q"), F.quarter(day).cast("string")),
        "month": F.date_format(day, "yyyy-MM"),
        "week": text.iso_week(day),
        "dow": F.date_format(day, "E"),
    })
    path = F.array(F.col("year").cast("string"), "quarter", "month", "week", "dow")
    empty = F.array().cast("array<string>")
    return out.withColumn("time_path", F.when(day.isNotNull(), path).otherwise(empty))


def geo_dims(df: DataFrame) -> DataFrame:
    country = F.col("location")["country"]
    currency = F.upper(F.coalesce(text.or_null("currency"), F.lit("USD")))
    abroad = (country.isNotNull() & (country != "US")) | (currency != "USD")
    out = df.withColumns({
        "geo_scope": F.when(abroad, "International").otherwise("Domestic"),
        "geo_country": F.coalesce(text.or_null(country),
                                  F.when(abroad, "Unknown").otherwise("US")),
        "geo_city": F.coalesce(text.or_null(F.col("location")["city"]), F.lit("Unknown")),
    })
    return out.withColumn("geo_path", F.array("geo_scope", "geo_country", "geo_city"))


def merchant_dims(df: DataFrame) -> DataFrame:
    party = F.get("counterparties", F.lit(0))["name"]
    own = text.or_null("merchant_name")
    name = F.coalesce(own, text.or_null(party))
    return df.withColumns({
        "merchant": F.coalesce(name, text.or_null("name"), F.lit("Unknown")),
        "merchant_brand": name,
        "merchant_id": F.coalesce(text.or_null("merchant_entity_id"),
                                  text.or_null(text.slug(name)), F.lit("unknown")),
    })


def account_facets(df: DataFrame, accounts: DataFrame, key: str | None = None, keyed: DataFrame | None = None) -> DataFrame:
    """Left join on the account; the record's own owner wins over the account's person.

    Where `key` names a column that is never null and never repeats, only it and the account move to the accounts and
    back, so rows that lie by that key stay where they are. `keyed` has the key and the account of the same rows once each, where the
    key may repeat in `df` itself.
    """
    acct = accounts.select(
        F.col("account_id"), F.col("person").alias("_person"), F.col("type").alias("_type"),
        F.col("name").alias("_name"), F.col("institution").alias("_inst"),
        F.col("include").alias("_include"))
    side = df if key is None else (df if keyed is None else keyed).select(key, "account_id")
    out = side.join(acct, "account_id", "left").filter(F.coalesce("_include", F.lit(True)))
    if key is not None:
        out = df.join(out.drop("account_id"), key)
    return out.withColumns({
        "person": F.coalesce(text.or_null("owner"), "_person", F.lit("Unknown")),
        "channel": F.coalesce(text.or_null("payment_channel"), F.lit("unknown")),
        "account_type": F.coalesce("_type", F.lit("unknown")),
        "account_name": F.coalesce("_name", F.substring(
            F.coalesce(text.or_null("account_id"), F.lit("?")), 1, 8)),
        "institution": F.coalesce("_inst", F.lit("Unknown")),
    }).drop("_person", "_type", "_name", "_inst", "_include")


def account_include(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Drops the rows of accounts marked include = false."""
    out = accounts.filter(~F.coalesce("include", F.lit(True))).select("account_id")
    return df.join(out, "account_id", "left_anti")


def provenance_carry(df: DataFrame) -> DataFrame:
    """Update and review columns for the cube; '' where the source has none."""
    have = set(df.columns)

    def src(name):
        return F.col(name) if name in have else F.lit(None).cast("string")

    out = {c: text.blank(src(c)) for c in ("category_update_step", "category_update_reason",
                                           "category_update_confidence")}
    out["original_pf_primary"] = src("original_pf_category_primary")
    out["original_pf_detailed"] = src("original_pf_category_detailed")
    out["review_pending"] = F.coalesce(src("category_review_flag") == "1", F.lit(False))
    for c in ("primary", "detailed", "reason", "source"):
        out[f"review_{c}"] = text.blank(src(f"category_review_{c}"))
    return df.withColumns(out)


def paths(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "category_path": F.array("tier0", "tier1", "tier2", "merchant"),
        "necessity": F.col("tier0"),
    })


def merchant_days(df: DataFrame) -> DataFrame:
    """Spend rows as one row per (merchant, day): hot merchants shrink before any window."""
    size = F.col("abs_amount").cast("double")
    return (df.filter((F.col("flow") == "spend") & ~F.col("merchant_id").isin("", "unknown"))
            .groupBy("merchant_id", "day")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("abs_amount").alias("total"),
                 F.sum(size * size).alias("squares")))


def gap_lag(df: DataFrame) -> DataFrame:
    """Days between consecutive distinct charge days of a merchant."""
    w = Window.partitionBy("merchant_id").orderBy("day")
    return merchant_days(df).withColumn("gap", F.datediff("day", F.lag("day").over(w)))


def recurring_merchants(df: DataFrame) -> DataFrame:
    """Merchants charged at a steady gap near a known period with similar amounts."""
    dated = F.col("day").isNotNull()
    per = gap_lag(df).groupBy("merchant_id").agg(
        F.sum("n").alias("n"), F.sum(F.when(dated, F.col("n"))).alias("n_dated"),
        F.count("gap").alias("n_gaps"), F.median("gap").alias("median_gap"),
        (F.max("gap") - F.min("gap")).alias("spread"),
        F.sum("total").cast("double").alias("total"), F.sum("squares").alias("squares"),
        F.max("day").alias("last_day"))
    n, total = F.col("n"), F.col("total")
    variance = F.greatest((F.col("squares") - total * total / n) / (n - 1), F.lit(0.0))
    cv = F.when(total != 0, F.sqrt(variance) / (total / n)).otherwise(F.lit(1.0))
    near = dims.any_of([F.abs(F.col("median_gap") - p) <= tol
                        for p, tol in fixed.RECURRENCE_PERIODS])
    return (per.filter((n >= 3) & (F.col("n_dated") >= 3) & (F.col("n_gaps") >= 2))
            .filter(near & (F.col("spread") <= F.col("median_gap"))
                    & (cv < fixed.RECURRENCE_MAX_CV))
            .select("merchant_id", "median_gap", "last_day"))


def recurrence(df: DataFrame, key: str | None = None) -> DataFrame:
    """'recurring' on the spend rows of recurring merchants, else 'one-off'.

    Only the few recurring merchants are joined back, so the side that meets the facts is small. Where `key` names a
    column that is never null and whose rows have one flow and merchant, the merchants meet keys of spend rows only, and whole
    rows stay where they lie.
    """
    rec = recurring_merchants(df).select(F.col("merchant_id").alias("_rm"),
                                         F.lit(True).alias("_rec"))
    if key is not None:
        spent = df.filter((F.col("flow") == "spend") & ~F.col("merchant_id").isin("", "unknown"))
        marked = spent.select(F.col(key).alias("_rk"), "merchant_id").join(
            rec, F.col("merchant_id") == F.col("_rm")).select("_rk", "_rec").distinct()
        return df.join(marked, F.col(key) == F.col("_rk"), "left").withColumn(
            "recurrence", F.when(F.col("_rec"), "recurring").otherwise("one-off")).drop("_rec", "_rk")
    # rows without a merchant match nothing: they are spread, not sent to one task
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("transaction_id"), F.lit(4096)).cast("string"))
    key = F.when(F.coalesce("merchant_id", F.lit("")).isin("", "unknown"), spread).otherwise(F.col("merchant_id"))
    return df.withColumn("_mk", key).join(rec, F.col("_mk") == F.col("_rm"), "left").withColumn(
        "recurrence", F.when(F.col("_rec") & (F.col("flow") == "spend"), "recurring")
        .otherwise("one-off")).drop("_rec", "_mk", "_rm")


def enrich(txns: DataFrame, accounts: DataFrame, atom_dim=None, overrides=None, globs=None,
           with_recurrence=True, key: str | None = None, keyed: DataFrame | None = None) -> DataFrame:
    """Canonical transactions -> the flat cube table; `key`: a column that is never null and never repeats, if there is one
    that the rows lie by; `keyed` as in `account_facets`."""
    out = account_facets(txns, accounts, key, keyed)
    out = exclude_flow(resolve_taxonomy(out, atom_dim, overrides), globs)
    out = paths(merchant_dims(geo_dims(time_dims(out))))
    out = provenance_carry(out).withColumn("confidence", F.coalesce(
        text.or_null("pfc_confidence"), F.lit("UNKNOWN")))
    out = recurrence(out) if with_recurrence else out
    return out.select(*[c for c in CUBE_COLUMNS if c in out.columns])


CUBE_COLUMNS = [
    "transaction_id", "account_id", "name", "amount", "abs_amount", "flow", "spend", "income",
    "count", "tier0", "tier1", "tier2", "atom", "merchant_id", "merchant", "merchant_brand",
    "category_path", "necessity", "unmapped", "pfc_primary", "pfc_detailed", "confidence",
    "geo_scope", "geo_country", "geo_city", "geo_path", "date_resolved", "day", "year",
    "quarter", "month", "week", "dow", "time_path", "person", "channel", "account_type",
    "account_name", "institution", "logo_url", "website", "pending", "category_update_step",
    "category_update_reason", "category_update_confidence", "original_pf_primary",
    "original_pf_detailed", "review_pending", "review_primary", "review_detailed",
    "review_reason", "review_source", "recurrence",
]


def accounts_scaffold(txns: DataFrame) -> DataFrame:
    """Per account: row count and the last owner stamp, for a first account table."""
    stamped = F.when(F.col("owner").isNotNull() & (F.col("owner") != ""),
                     F.struct("posted_date", "transaction_id", "owner"))
    return txns.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max(stamped)["owner"], F.lit("Unknown")).alias("person"))
