"""Places of rows within a key that no task has to hold or count whole."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans import lineage


def numbered(df: DataFrame, key, order, name="place") -> DataFrame:
    """Adds the place (from 0) of each row within its key by `order`.

    One range sort over key and order, whose partitions are counted and the counts summed, so a key that
    holds most rows is spread like any other. `order` must tell rows apart for places to be repeatable.
    """
    by = [*key, *order]
    held = lineage.stored(
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "places")
    counts = held.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_n")
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_part").alias("_p"), "_first",
                           before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return held.join(counts.hint("merge"), same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
