"""Store-wide audit sweeps: findings to look at, never applied."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import dims, fixed
from ledgerloom.functions import text
from ledgerloom.operators import authority, project, rules


def _category(primary, detailed):
    return F.concat(F.coalesce(primary, F.lit("None")), F.lit("/"),
                    F.coalesce(detailed, F.lit("None")))


def row_findings(store: DataFrame, today, stale_days=fixed.STALE_PENDING_DAYS,
                 memory: DataFrame | None = None) -> DataFrame:
    """The per-row sweeps, all flagged in one scan: (sweep, id, detail)."""
    cur = authority.current()
    df = store.withColumns({"_p": cur[0], "_d": cur[1]})
    df = project.category_valid(df, dims.category_menu(store.sparkSession), "_p", "_d", "_legal")
    has = text.blank("_p") != ""
    age = F.datediff(F.to_date(F.lit(today)), text.parse_date("date"))
    stored = _category(F.col("_p"), F.col("_d"))
    found = [
        F.when(~has, F.struct(F.lit("uncategorized").alias("sweep"), F.lit("").alias("detail"))),
        F.when(has & ~F.col("_legal"), F.struct(F.lit("taxonomy_invalid").alias("sweep"),
                                                stored.alias("detail"))),
        F.when(has & project.sign_violation("amount", "_p"),
               F.struct(F.lit("sign_violations").alias("sweep"), stored.alias("detail"))),
        F.when(F.col("pending") & (age > stale_days),
               F.struct(F.lit("stale_pending").alias("sweep"), F.lit("").alias("detail"))),
    ]
    if memory is not None:
        df = rules.memory_lookup(df, memory)
        m = F.col("_mem")
        says = _category(m["primary"], m["detailed"])
        found.append(F.when(m.isNotNull() & ~authority.same_pair(m["primary"], m["detailed"]),
                            F.struct(F.lit("memory_conflicts").alias("sweep"), F.concat(
                                m["rule_name"], F.lit(" "), says, F.lit(" <> "), stored)
                                .alias("detail"))))
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("f"),
                     F.col("transaction_id").alias("id")).select("f.sweep", "id", "f.detail")


def entity_inconsistent(store: DataFrame) -> DataFrame:
    """Merchant ids that carry more than one category; each distinct pair is kept once first."""
    cur = authority.current()
    pairs = (store.filter((text.blank("merchant_entity_id") != "") & (text.blank(cur[0]) != ""))
             .select("merchant_entity_id", _category(*cur).alias("c")).distinct())
    return pairs.groupBy("merchant_entity_id").agg(F.array_sort(F.collect_list("c")).alias("cs")) \
        .filter(F.size("cs") > 1).select(
        F.lit("entity_inconsistent").alias("sweep"), F.col("merchant_entity_id").alias("id"),
        F.array_join("cs", ",").alias("detail"))


def amount_outliers(store: DataFrame, n=fixed.OUTLIER_ROWS) -> DataFrame:
    """The n largest rows by size, larger id first on ties."""
    return (store.filter("amount IS NOT NULL")
            .select("transaction_id", F.abs("amount").alias("abs_amount"))
            .orderBy(F.desc("abs_amount"), F.desc("transaction_id")).limit(n))


def audit_scan(store: DataFrame, today, memory: DataFrame | None = None,
               stale_days=fixed.STALE_PENDING_DAYS, outliers=fixed.OUTLIER_ROWS) -> DataFrame:
    """All seven sweeps as (sweep, id, detail)."""
    top = amount_outliers(store, outliers).select(
        F.lit("amount_outliers").alias("sweep"), F.col("transaction_id").alias("id"),
        F.col("abs_amount").cast("string").alias("detail"))
    return row_findings(store, today, stale_days, memory).unionByName(
        entity_inconsistent(store)).unionByName(top)
