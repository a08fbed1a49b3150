"""Ingest: keep-last deduplication, settled pendings, canonical form, counts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text


def last_per_key(df: DataFrame, key, order) -> DataFrame:
    """The last row per key by `order`; a row-number filter, so map tasks keep one row per key."""
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in orders])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dedupe_last(df: DataFrame, key="transaction_id", order="seq") -> DataFrame:
    """The last row per id; rows without an id are dropped."""
    return last_per_key(df.filter(F.col(key).isNotNull() & (F.col(key) != "")), key, order)


def references(df: DataFrame) -> DataFrame:
    """_ref: the ids that posted rows name in pending_transaction_id."""
    return (df.filter(~F.coalesce("pending", F.lit(False))
                      & F.col("pending_transaction_id").isNotNull()
                      & (F.col("pending_transaction_id") != ""))
            .select(F.col("pending_transaction_id").alias("_ref")))


def drop_settled_pending(df: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Drops pending rows that a posted row names in pending_transaction_id.

    The join key is the id the rows are already spread by after dedupe_last, so only the
    narrow list of references is shuffled for it; `refs` are the references of `df`, where they are stored already.
    """
    refs = references(df) if refs is None else refs
    return df.join(refs, (F.col("transaction_id") == F.col("_ref")) & F.col("pending"),
                   "left_anti")


def canonicalize(df: DataFrame) -> DataFrame:
    """Nested source record -> source-agnostic transaction; other columns ride along."""
    amount = F.coalesce("amount", F.lit(0).cast("decimal(18,2)"))
    pfc = F.col("personal_finance_category")
    return df.withColumns({
        "owner": F.col("txn_owner"),
        "posted_date": F.col("date"),
        "amount": amount,
        "currency": F.coalesce(text.or_null("iso_currency_code"), "unofficial_currency_code"),
        "pfc_primary": pfc["primary"],
        "pfc_detailed": pfc["detailed"],
        "pfc_confidence": pfc["confidence_level"],
        "pending": F.coalesce("pending", F.lit(False)),
        "direction": F.when(amount < 0, "in").otherwise("out"),
        "dedupe_key": F.col("transaction_id"),
    })


def ingest(feed: DataFrame) -> DataFrame:
    """Feed -> deduplicated, settled, canonical transactions."""
    return canonicalize(drop_settled_pending(dedupe_last(feed)))


def ingest_counts(feed: DataFrame) -> DataFrame:
    """One row: loaded, duplicates dropped, settled dropped, kept, still pending.

    One aggregate over the feed's ids and one over the kept rows, both over narrow columns; what
    is put together at the end is two rows.
    """
    narrow = feed.select("transaction_id", "seq", "pending", "pending_transaction_id")
    kept = drop_settled_pending(dedupe_last(narrow))
    one = F.lit(1)
    loaded = narrow.agg(F.count(one).alias("n_loaded"),
                        F.countDistinct(text.or_null("transaction_id")).alias("n_deduped"))
    left = kept.agg(F.count(one).alias("n_kept"),
                    F.count(F.when(F.col("pending"), one)).alias("n_pending"))
    v = loaded.unionByName(left, allowMissingColumns=True).agg(*[
        F.max(c).alias(c) for c in ("n_loaded", "n_deduped", "n_kept", "n_pending")])
    return v.select(
        "n_loaded", (F.col("n_loaded") - F.col("n_deduped")).alias("n_duplicate_ids_dropped"),
        (F.col("n_deduped") - F.col("n_kept")).alias("n_settled_pending_dropped"),
        F.col("n_kept").alias("n_transactions"),
        F.col("n_pending").alias("n_pending_remaining"))
