"""Row projections and predicates over nested records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import dims, fixed, schema
from ledgerloom.functions import text


def _pfc(field):
    return F.col("personal_finance_category")[field]


def flatten_record(df: DataFrame, *also) -> DataFrame:
    """Nested record -> the flat text columns, plus its provenance columns when it has them, and those of `also`."""
    party = F.get("counterparties", F.lit(0))
    out = {n: F.lit("") for n in ("institution", "account_name", "account_mask",
                                  "account_official_name", "account_type", "account_subtype")}
    out["txn_owner"] = text.blank("txn_owner")
    out["account_id"] = text.blank("account_id")
    plain = ("transaction_id pending pending_transaction_id date authorized_date datetime "
             "authorized_datetime name original_description merchant_name merchant_entity_id "
             "website logo_url amount iso_currency_code unofficial_currency_code "
             "payment_channel transaction_type transaction_code check_number account_owner")
    for n in plain.split():
        out[n] = F.col("amount") if n == "amount" else text.blank(n)
    for n, field in (("primary", "primary"), ("detailed", "detailed"),
                     ("confidence", "confidence_level"), ("version", "version")):
        out[f"pf_category_{n}"] = text.blank(_pfc(field))
    out["pf_category_icon_url"] = text.blank("personal_finance_category_icon_url")
    for n in "address city region postal_code country lat lon store_number".split():
        out[f"location_{n}"] = text.blank(F.col("location")[n])
    for n, field in (("reference_number", "reference_number"), ("ppd_id", "ppd_id"),
                     ("payee", "payee"), ("by_order_of", "by_order_of"), ("payer", "payer"),
                     ("method", "payment_method"), ("processor", "payment_processor"),
                     ("reason", "reason")):
        out[f"payment_{n}"] = text.blank(F.col("payment_meta")[field])
    for n, field in (("name", "name"), ("type", "type"), ("entity_id", "entity_id"),
                     ("confidence", "confidence_level")):
        out[f"counterparty_{n}"] = text.blank(party[field])
    parties = F.col("counterparties")
    out["counterparties_json"] = F.when(F.size(parties) > 0, F.to_json(
        parties, {"ignoreNullFields": "false"})).otherwise("")
    for n in schema.PROVENANCE_COLUMNS:
        if n in df.columns:
            out[n] = text.blank(n)
    return df.select(*[c.alias(n) for n, c in out.items()], *also)


ACCOUNT_META = ["institution", "account_name", "account_mask", "account_official_name",
                "account_type", "account_subtype"]


def flatten_with_account(df: DataFrame, meta: DataFrame, row: str | None = None) -> DataFrame:
    """flatten_record with account metadata joined in; blank for an unknown account.

    Where `row` names a column that is never null and never repeats, only it and the metadata move to the accounts and back, so
    whole rows that lie by that column stay where they are.
    """
    told = ["_" + n for n in ACCOUNT_META]
    m = meta.select("account_id", *[F.col(n).alias("_" + n) for n in ACCOUNT_META])
    if row is not None:
        known = df.select(F.col(row).alias("_row"), text.blank("account_id").alias("account_id")).join(m, "account_id")
        out = flatten_record(df.join(known.drop("account_id"), F.col(row) == F.col("_row"), "left"), *told)
    else:
        out = flatten_record(df).join(m, "account_id", "left")
    return out.withColumns({n: text.blank("_" + n) for n in ACCOUNT_META}).select(*flatten_record(df).columns)


def worklist(df: DataFrame) -> DataFrame:
    """Rows that wait for review: current category against the suggestion."""
    return df.filter(F.col("category_review_flag") == "1").select(
        text.blank("transaction_id").alias("transaction_id"),
        text.blank("txn_owner").alias("txn_owner"), text.blank("date").alias("date"),
        text.blank("merchant_name").alias("merchant_name"), text.blank("name").alias("name"),
        "amount", text.blank(_pfc("primary")).alias("current_primary"),
        text.blank(_pfc("detailed")).alias("current_detailed"),
        text.blank(_pfc("confidence_level")).alias("current_confidence"),
        text.blank("category_review_primary").alias("suggested_primary"),
        text.blank("category_review_detailed").alias("suggested_detailed"),
        text.blank("category_review_source").alias("review_source"),
        text.blank("category_review_confidence").alias("review_confidence"),
        text.blank("category_review_reason").alias("review_reason"))


def party_names() -> Column:
    parties = F.coalesce("counterparties", F.array().cast(schema.COUNTERPARTIES))
    return F.filter(F.transform(parties, lambda p: p["name"]),
                    lambda n: n.isNotNull() & (n != ""))


def reviewer_export(df: DataFrame) -> DataFrame:
    """The compact view an outside reviewer gets: identity, amount, current category."""
    return df.select(
        "transaction_id", "date", "merchant_name", "name", "original_description", "website",
        "amount", "payment_channel", party_names().alias("counterparties"),
        _pfc("primary").alias("current_primary"), _pfc("detailed").alias("current_detailed"),
        _pfc("confidence_level").alias("current_confidence"))


def reviewer_queue(df: DataFrame, full=False) -> DataFrame:
    """Posted rows no reviewer has stamped; all posted rows when full."""
    posted = ~F.coalesce("pending", F.lit(False))
    if full:
        return df.filter(posted)
    return df.filter(posted & (text.blank("reviewer_audited_at") == ""))


def reviewer_prompt(df: DataFrame) -> DataFrame:
    """One labelled block of text per row, signals cut to fixed widths."""
    def cut(c, width):
        return F.substring(text.blank(c), 1, width)

    def shown(c):
        return F.coalesce(c.cast("string"), F.lit("None"))

    hint = F.when(F.col("suggested_primary").isNotNull(), F.concat(
        F.lit("    mechanical suggestion : "), F.col("suggested_primary"), F.lit(" / "),
        shown(F.col("suggested_detailed")), F.lit("\n"))).otherwise("")
    block = F.concat(
        F.lit("[row "), F.col("transaction_id"), F.lit("]\n    merchant_name  : "),
        cut("merchant_name", 60), F.lit("\n    name           : "), cut("name", 80),
        F.lit("\n    original_desc  : "), cut("original_description", 80),
        F.lit("\n    counterparties : "), F.substring(F.array_join(party_names(), ", "), 1, 60),
        F.lit("\n    website        : "), cut("website", 40),
        F.lit("\n    payment_channel: "), cut("payment_channel", 20),
        F.lit("\n    amount         : "), shown(F.col("amount")),
        F.lit("\n    current pf     : "), shown(_pfc("primary")), F.lit(" / "),
        shown(_pfc("detailed")), F.lit(" ("), shown(_pfc("confidence_level")), F.lit(")\n"), hint)
    return df.select("transaction_id", block.alias("prompt"))


def confidence_of() -> Column:
    """Upper-cased confidence; blank counts as UNKNOWN."""
    return F.coalesce(text.or_null(F.upper(_pfc("confidence_level"))), F.lit("UNKNOWN"))


def select_confidence(df: DataFrame, levels=tuple(fixed.CONFIDENCE_LEVELS)) -> DataFrame:
    unknown = sorted(set(levels) - set(fixed.CONFIDENCE_LEVELS))
    if unknown:
        raise ValueError(f"unknown confidence level(s): {', '.join(unknown)}")
    return df.filter(confidence_of().isin(*levels))


def text_search(df: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """'id:<id>' exactly, else a case-insensitive substring, first rows by (date, id)."""
    q = query.strip()
    if q.lower().startswith("id:"):
        return df.filter(F.col("transaction_id") == q[3:].strip())
    body = F.lower(F.concat_ws(" ", *[text.blank(c) for c in
                                      ("merchant_name", "name", "original_description")]))
    return df.filter(F.contains(body, F.lit(q.lower()))).orderBy("date", "transaction_id") \
             .limit(limit)


def category_valid(df: DataFrame, menu: DataFrame, primary="primary", detailed="detailed",
                   out="valid") -> DataFrame:
    """Adds whether (primary, detailed) is on the menu."""
    legal = menu.select(F.col("primary").alias("_mp"), F.col("detailed").alias("_md"),
                        F.lit(True).alias("_ok"))
    return (df.join(legal, (F.col(primary) == F.col("_mp")) & (F.col(detailed) == F.col("_md")),
                    "left")
            .withColumn(out, F.coalesce("_ok", F.lit(False))).drop("_mp", "_md", "_ok"))


def snap_to_other(df: DataFrame, menu: DataFrame, primary="primary",
                  detailed="detailed") -> DataFrame:
    """A bad leaf under a known primary becomes its OTHER leaf; unknown primary -> null."""
    other = dims.primary_other(menu).select(F.col("primary").alias("_op"), "other_detailed")
    out = category_valid(df, menu, primary, detailed, "_valid")
    out = out.join(other, F.col(primary) == F.col("_op"), "left")
    return out.withColumn(detailed, F.when(F.col("_valid"), F.col(detailed))
                          .otherwise(F.col("other_detailed"))).drop("_valid", "_op",
                                                                    "other_detailed")


def sign_violation(amount, primary) -> Column:
    """A positive amount under a primary that only ever receives money."""
    return F.coalesce((text.col(amount) > 0)
                      & text.col(primary).isin(*fixed.INFLOW_PRIMARIES), F.lit(False))
