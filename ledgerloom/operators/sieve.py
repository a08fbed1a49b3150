"""Keys that may be among those of a table, told before they are dealt: a filter of fixed size (Bloom's) that a join can follow."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23  # a megabyte for any table; one key in 140 of others passes at 360,000 keys of the table, and more with more
WORD = 64


def _places(key: Column) -> list[Column]:
    """The two bits of a key."""
    h = F.xxhash64(key)
    return [F.pmod(h, F.lit(BITS)), F.pmod(F.shiftright(h, 32), F.lit(BITS))]


def among(keys: DataFrame, column: str, key: Column) -> Column:
    """True where `key` is in a column of `keys`, and now and then where it is not; a null is in none.

    The bits are one row that every task reads, so rows that an inner join with `keys` would drop mostly stay where they are.
    """
    spark = keys.sparkSession
    bits = keys.filter(F.col(column).isNotNull()).select(F.explode(F.array(*_places(F.col(column)))).alias("bit"))
    words = bits.groupBy(F.floor(F.col("bit") / WORD).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(bit % {WORD} AS INT))")).alias("bits"))
    held = spark.range(BITS // WORD).join(words, F.col("id") == F.col("word"), "left").select(
        "id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    table = held.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda w: w["bits"]).alias("table")).scalar()
    passes = [F.getbit(F.get(table, F.floor(at / WORD).cast("int")), (at % WORD).cast("int")) == 1 for at in _places(key)]
    return key.isNotNull() & passes[0] & passes[1]
