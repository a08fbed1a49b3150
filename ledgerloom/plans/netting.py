"""One-to-one netting of transfers by rounds of mutual best offers.

A legal pair is a transfer out and a transfer in of one person and exact size, on different accounts, at most `days`
apart. Pairs rank by distance in days, then the earlier out, the earlier in, the accounts, and the ids within an
account and day. Taking the first pair, striking both rows out and going on gives the result.

All pairs between the outs of one day and the ins of another follow each other in that order, so offers are made between such days
of a person and size: where two days are the best of each other, no earlier pair touches their rows, and all that they have
for each other is taken at once. So rounds go by days that wait for each other and not by how many rows a day has. A day that has no
legal partner left is dropped.

Rows of one person, size, account, day and side are alike but for their ids, so they are cells that carry a number of rows. The rows of
two days stand in the order of their accounts, and rows in the same place are a pair, until both are of the same account: there
the account's rows give way to those that come next on the other side, after which the places are level again (`_passed`).

Cells are as many as transfers, whatever their compressed tables look like, so every join asks for a merge: none sends a
side through the driver.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import ranks
from ledgerloom.plans import lineage

KEY = ["person", "abs_amount"]


def transfers(df: DataFrame) -> DataFrame:
    """transaction_id, account_id, person, abs_amount, day, side of the cube's dated transfers."""
    return df.filter((F.col("flow") == "excluded") & F.startswith("atom", F.lit("TRANSFER_")) & F.col("day").isNotNull()
                     & F.col("account_id").isNotNull() & F.col("person").isNotNull() & F.col("abs_amount").isNotNull()).select(
        "transaction_id", "account_id", *KEY, "day",
        F.when(F.startswith("atom", F.lit("TRANSFER_OUT_")), "out").otherwise("in").alias("side"))


def _days(cells: DataFrame) -> DataFrame:
    """The first and last account of a day."""
    return cells.groupBy(*KEY, "day").agg(F.min("account_id").alias("one"), F.max("account_id").alias("two"))


def _best(own: DataFrame, other: DataFrame, days: int) -> DataFrame:
    """Of each day of `own` that has a legal partner in `other` the nearest, and the first account it can take: key, day, day2,
    account2."""
    def block(day):
        return F.floor(F.unix_date(day) / (2 * days + 1))

    offered = _days(other).select(*KEY, F.col("day").alias("day2"), F.col("one").alias("one2"), F.col("two").alias("two2"),
                                  block("day").alias("block"))
    reach = F.array_distinct(F.array(block(F.date_sub("day", days)), block(F.date_add("day", days))))
    met = _days(own).withColumn("block", F.explode(reach)).join(offered.hint("merge"), [*KEY, "block"])
    alone = F.col("one") == F.col("two")  # the one account that all of the day's rows are of
    far, first = F.abs(F.datediff("day", "day2")), F.when(alone & (F.col("one2") == F.col("one")), F.col("two2")).otherwise(F.col("one2"))
    met = met.withColumns({"far": far, "account2": first}).filter((F.col("far") <= days) & ~(alone & (F.col("account2") == F.col("one"))))
    return met.groupBy(*KEY, "day").agg(F.min(F.struct("far", "day2", "account2")).alias("offer")).select(
        *KEY, "day", "offer.day2", "offer.account2")


def _marks(cells: DataFrame, days: int) -> DataFrame:
    """The days that have a partner: side, key, day, and `step`, the day of the outs, where two are the best of each other."""
    out, back = (cells.filter(F.col("side") == side) for side in ("out", "in"))
    offers = _best(out, back, days).select(*KEY, "day", "day2", F.lit(True).alias("asks"))
    answers = _best(back, out, days).select(*KEY, F.col("day").alias("day2"), F.col("day2").alias("day"), F.lit(True).alias("says"))
    step = F.when(F.col("asks") & F.col("says"), F.col("day")).alias("step")
    sides = F.array(F.when(F.col("asks"), F.struct(F.lit("out").alias("side"), "day", step)),
                    F.when(F.col("says"), F.struct(F.lit("in").alias("side"), F.col("day2").alias("day"), step)))
    return (offers.hint("merge").join(answers, [*KEY, "day", "day2"], "full").select(*KEY, F.explode(sides).alias("at"))
            .filter("at IS NOT NULL").select(*KEY, "at.*"))


def _passed(cells: DataFrame) -> DataFrame:
    """How many rows pass between the cells of each step: key, out and in cell, the first rank on either side, passed.

    Where the outs and the ins of an account `own` stand in the same places from `at` on, its outs take the ins that follow its own
    and its ins go to the outs that follow its own. Both sides are level again at `end`; what stands there waits for the next round.
    """
    step = [*KEY, "step"]
    place = F.sum("n").over(Window.partitionBy(*step, "side").orderBy("account_id"))
    cells = cells.withColumns({"lo": place - F.col("n"), "hi": place})
    mine = Window.partitionBy(*step, "account_id")
    outs, ins = ([F.max(F.when(F.col("side") == side, F.col(c))).over(mine) for c in ("lo", "hi")] for side in ("out", "in"))
    at = F.greatest(outs[0], ins[0])
    own = F.when((outs[0] < ins[1]) & (ins[0] < outs[1]), F.struct(at.alias("at"), (outs[1] - at).alias("outs"), (ins[1] - at).alias("ins")))
    cells = cells.withColumn("own", own).withColumn("own", F.min("own").over(Window.partitionBy(*step)))
    at, outs, ins = (F.col(f"own.{c}") for c in ("at", "outs", "ins"))
    end = at + outs + ins

    def part(first, last, shift):
        first, last = F.greatest("lo", first), F.least("hi", last)
        return F.when(first < last, F.struct((first + shift).alias("v"), (last + shift).alias("w"),
                                             (F.col("used") + first - F.col("lo")).alias("rank")))

    none = F.lit(0).cast("long")
    parts = (F.when(F.col("own").isNull(), F.array(part(F.col("lo"), F.col("hi"), none)))
             .when(F.col("side") == "out", F.array(part(none, end, none)))
             .otherwise(F.array(part(none, at, none), part(at, at + ins, outs), part(at + ins, end, -ins))))
    parts = cells.select(*step, "side", "day", "account_id", F.explode(parts).alias("part")).filter("part IS NOT NULL").select(
        *step, "side", "day", "account_id", "part.*")
    upto = Window.partitionBy(*step).orderBy("v", F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    o, i = (F.last(F.when(F.col("side") == side, F.struct("day", "account_id", "v", "w", "rank")), ignorenulls=True).over(upto)
            for side in ("out", "in"))
    met = parts.select(*KEY, "v", o.alias("o"), i.alias("i")).withColumn("passed", F.least("o.w", "i.w") - F.col("v"))
    return met.filter("o IS NOT NULL AND i IS NOT NULL AND passed > 0").select(
        *KEY, "o.day", "o.account_id", F.col("i.day").alias("day2"), F.col("i.account_id").alias("account2"),
        (F.col("o.rank") + F.col("v") - F.col("o.v")).alias("out_from"), (F.col("i.rank") + F.col("v") - F.col("i.v")).alias("in_from"),
        "passed")


def _left(cells: DataFrame, taken: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.lit("out").alias("side"), "day", "account_id"),
                   F.struct(F.lit("in").alias("side"), F.col("day2").alias("day"), F.col("account2").alias("account_id")))
    cell = [*KEY, "side", "day", "account_id"]
    gone = taken.select(*KEY, "passed", F.explode(both).alias("at")).select(*KEY, "at.*", "passed").groupBy(*cell).agg(
        F.sum("passed").alias("passed"))
    passed = F.coalesce("passed", F.lit(0))
    return cells.join(gone.hint("merge"), cell, "left").select(
        *cell, (F.col("n") - passed).alias("n"), (F.col("used") + passed).alias("used")).filter("n > 0")


def flows(cells: DataFrame, days: int) -> DataFrame:
    """How many rows pass between cells: key, out and in cell, the first rank on either side, passed."""
    cells = cells.select(*KEY, "side", "day", "account_id", "n", F.lit(0).cast("long").alias("used"))
    rounds = []
    while True:
        marks = lineage.stored(_marks(cells, days), "marks")
        waiting = cells.join(marks.hint("merge"), [*KEY, "side", "day"])
        taken = lineage.stored(_passed(waiting.filter("step IS NOT NULL")), "netted")
        if taken.isEmpty():
            break
        rounds.append(taken)
        cells = lineage.stored(_left(waiting, taken), "cells")
    return reduce(DataFrame.union, rounds) if rounds else taken


def transfer_netting(df: DataFrame, days=5) -> DataFrame:
    """out_id, in_id, person, amount of the netted pairs of a cube."""
    rows = lineage.stored(transfers(df), "transfers")
    cell = [*KEY, "day", "account_id"]
    cells = lineage.stored(rows.groupBy(*cell, "side").agg(F.count(F.lit(1)).alias("n")), "cells")
    passed = flows(cells, days).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passed") - 1)))
    pairs = passed.select(*KEY, "day", "account_id", "day2", "account2", (F.col("out_from") + F.col("k")).alias("out_rank"),
                          (F.col("in_from") + F.col("k")).alias("in_rank"))
    ranked = ranks.numbered(rows, ["side", *cell], ["transaction_id"], "rank")
    outs = ranked.filter("side = 'out'").select(*cell, F.col("rank").alias("out_rank"), F.col("transaction_id").alias("out_id"))
    ins = ranked.filter("side = 'in'").select(
        *KEY, F.col("day").alias("day2"), F.col("account_id").alias("account2"), F.col("rank").alias("in_rank"),
        F.col("transaction_id").alias("in_id"))
    return (pairs.join(outs.hint("merge"), [*cell, "out_rank"]).join(ins.hint("merge"), [*KEY, "day2", "account2", "in_rank"])
            .select("out_id", "in_id", "person", F.col("abs_amount").cast("double").alias("amount")))
