"""Marts over the cube: cash flow, budget, merchants, recurring charges, transfers, scorecards."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import cube as cb
from ledgerloom.operators import enrich
from ledgerloom.operators.cube import GroupingSpec, facet_filter
from ledgerloom.plans.lineage import cut


def _by_month():
    return Window.orderBy(F.asc_nulls_last("month"))


def _rows(df, spec, flow="spend"):
    """Filtered rows, hidden ones included, of one flow."""
    wide = GroupingSpec(filters={**spec.filters, **({"flow": flow} if flow else {})},
                        date_from=spec.date_from, date_to=spec.date_to, include_hidden=True)
    return facet_filter(df, wide)


def cash_flow(df: DataFrame, spec: GroupingSpec) -> DataFrame:
    """Income, spend, savings and running savings per month; the window sees months only."""
    flat = GroupingSpec(filters={k: v for k, v in spec.filters.items() if k != "flow"},
                        date_from=spec.date_from, date_to=spec.date_to)
    per = facet_filter(df, flat).groupBy("month").agg(F.sum("income").alias("income"),
                                                      F.sum("spend").alias("spend"))
    run = _by_month().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = per.withColumn("savings", F.col("income") - F.col("spend"))
    out = out.withColumn("cumulative_net", F.sum("savings").over(run))
    return out.select("month", *[F.col(c).cast("double").alias(c) for c in
                                 ("income", "spend", "savings", "cumulative_net")])


def month_sums(df: DataFrame, spec: GroupingSpec, level="tier1", flow="spend") -> DataFrame:
    """Spend per level value and month. What builds on it reads it several times (which months
    there are, then the sums), so it is computed once."""
    per = (_rows(df, spec, flow).filter(F.col("month").isNotNull() & F.col(level).isNotNull())
           .groupBy(level, "month").agg(F.sum("spend").alias("spend")))
    return cut(per)


def month_list(sums: DataFrame) -> list[str]:
    """The months present: at most one short text per calendar month comes to the driver."""
    return [r[0] for r in sums.select("month").distinct().orderBy("month").collect()]


def monthly_pivot(sums: DataFrame, level="tier1", months=None) -> DataFrame:
    """Level x month grid of spend, 0 where there is none."""
    months = month_list(sums) if months is None else months
    return sums.groupBy(level).pivot("month", months).agg(F.sum("spend").cast("double")) \
        .fillna(0.0, subset=months)


def grid_export(sums: DataFrame, level="tier1", months=None) -> DataFrame:
    """The grid with figures rounded to cents and text guarded for spreadsheets."""
    grid = monthly_pivot(sums, level, months).withColumnRenamed(level, "Category")
    return text.csv_safe_frame(grid.select("Category", *[
        F.bround(c, 2).alias(c) for c in grid.columns if c != "Category"]))


def trailing_avg(sums: DataFrame, level: str, window: int, out="avg") -> DataFrame:
    """Mean over the last `window` months present in the data, absent months counting as 0."""
    last = (sums.select("month").distinct().orderBy(F.desc("month")).limit(window)
            .agg(F.collect_list("month").alias("m")))
    months = last.scalar()
    inside = F.when(F.array_contains(months, F.col("month")), F.col("spend"))
    return sums.groupBy(level).agg(
        (F.coalesce(F.sum(inside).cast("double"), F.lit(0.0)) / F.first(F.size(months)))
        .alias(out))


def ytd_avg(sums: DataFrame, level: str, out="ytd_avg") -> DataFrame:
    """Mean over the months of the latest year present."""
    year = F.substring("month", 1, 4)
    months = (sums.select("month").distinct().groupBy(year.alias("y"))
              .agg(F.collect_list("month").alias("m")).orderBy(F.desc("y")).limit(1).select("m"))
    months = months.scalar()
    inside = F.when(F.array_contains(months, F.col("month")), F.col("spend"))
    return sums.groupBy(level).agg(
        (F.coalesce(F.sum(inside).cast("double"), F.lit(0.0)) / F.first(F.size(months)))
        .alias(out))


def rolling_total(sums: DataFrame, window: int, hidden=(), level="tier1") -> DataFrame:
    """Visible spend per month with its trailing mean over at most `window` months."""
    visible = sums.filter(~F.col(level).isin(*hidden)) if hidden else sums
    per = visible.groupBy("month").agg(F.sum("spend").cast("double").alias("total"))
    return per.withColumn("trailing", F.avg("total").over(
        _by_month().rowsBetween(-(window - 1), Window.currentRow)))


def heat_scale(df: DataFrame, column: str, midpoint=None, out="intensity") -> DataFrame:
    """Min-max intensity of a column of a result table, or signed distance from a midpoint."""
    lo, hi = df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()
    if midpoint is None:
        span = hi - lo
        t = (F.col(column) - lo) / F.when(span != 0, span).otherwise(1.0)
    else:
        far = F.greatest(F.abs(hi - midpoint), F.abs(lo - midpoint))
        t = (F.col(column) - midpoint) / F.when(far != 0, far).otherwise(1.0)
    return df.withColumn(out, t)


def spend_table(df: DataFrame, spec: GroupingSpec, level: str) -> DataFrame:
    """Per level value: actual spend, 12- and 3-month averages, transactions."""
    actual = _rows(df, spec, None).groupBy(level).agg(
        F.sum("spend").cast("double").alias("actual"), F.sum("count").cast("long").alias("txns"))
    sums = month_sums(df, spec, level, flow=None)
    out = (actual.join(trailing_avg(sums, level, 12, "avg_12m"), level, "left")
           .join(trailing_avg(sums, level, 3, "avg_3m"), level, "left"))
    return out.fillna(0.0, subset=["avg_12m", "avg_3m"])


def drill_metrics(df: DataFrame, spec: GroupingSpec) -> DataFrame:
    """Visible total, annualised total and the total less mortgage and house, in one pass."""
    rows = _rows(df, spec, None)
    seen = (F.col("flow") == "spend")
    if "hidden" in df.columns:
        seen = seen & ~F.col("hidden")
    total = F.coalesce(F.sum(F.when(seen, F.col("spend"))).cast("double"), F.lit(0.0))

    def tier(name):
        return F.coalesce(F.sum(F.when(seen & (F.col("tier1") == name), F.col("spend")))
                          .cast("double"), F.lit(0.0))

    months = F.greatest(F.countDistinct("month"), F.lit(1))
    return rows.agg(total.alias("total"), (total / months * 12).alias("annualized"),
                    (total - tier("Mortgage")).alias("less_mortgage"),
                    (total - tier("Mortgage") - tier("House")).alias("less_mortgage_home"))


def budget_vs_actual(sums: DataFrame, goals: DataFrame, window: int, level="tier1") -> DataFrame:
    """Year-to-date and trailing averages against goals; a goal of 0 has a diff but no percent."""
    avg = trailing_avg(sums, level, window, "avg").withColumnRenamed(level, "category")
    ytd = ytd_avg(sums, level).withColumnRenamed(level, "category")
    out = avg.join(ytd, "category").join(goals, "category", "full_outer")
    a, g = F.coalesce("avg", F.lit(0.0)), F.col("goal")
    out = out.select(
        "category", F.coalesce("ytd_avg", F.lit(0.0)).alias("ytd_avg"), a.alias("avg"), "goal",
        F.when(g != 0, a / g * 100.0).alias("pct_of_goal"),
        F.when(g.isNotNull(), a - g).alias("budget_diff"))
    return out.filter((F.col("avg") > 0) | (F.col("ytd_avg") > 0) | F.col("goal").isNotNull())


def budget_cuts(table: DataFrame, hidden=()) -> DataFrame:
    """Total, annualised, less mortgage, less mortgage and home, for actual and goal."""
    seen = table.filter(~F.col("category").isin(*hidden)) if hidden else table

    def s(column, *names):
        picked = F.when(F.col("category").isin(*names), F.col(column)) if names else F.col(column)
        return F.coalesce(F.sum(picked), F.lit(0.0))

    parts = []
    for c in ("avg", "goal"):
        parts += [s(c).alias(f"{c}_t"), s(c, "Mortgage").alias(f"{c}_m"),
                  s(c, "House").alias(f"{c}_h")]
    lines = ", ".join(f"'{label}', {' , '.join(expr.replace('X', c) for c in ('avg', 'goal'))}"
                      for label, expr in (("Total (monthly)", "X_t"), ("Annualized", "X_t * 12"),
                                          ("Less Mortgage", "(X_t - X_m) * 12"),
                                          ("Less Mortgage & Home", "(X_t - X_m - X_h) * 12")))
    return seen.agg(*parts).selectExpr(f"stack(4, {lines}) AS (cut, actual, goal)")


def _first(column):
    """The first non-null value in (date, id) order."""
    return F.min_by(column, F.when(F.col(column).isNotNull(),
                                   F.struct("date_resolved", "transaction_id")))


def merchant_table(df: DataFrame, spec: GroupingSpec, limit=40) -> DataFrame:
    """The largest merchants: name, logo, category, total, visits, average, first and last."""
    per = _rows(df, spec).groupBy("merchant_id").agg(
        _first("merchant").alias("merchant"), _first("logo_url").alias("logo_url"),
        _first("tier1").alias("tier1"), F.sum("spend").alias("total"),
        F.sum("count").cast("long").alias("visits"), F.min("date_resolved").alias("first_date"),
        F.max("date_resolved").alias("last_date"))
    out = per.filter("total > 0").orderBy(F.desc("total"), "merchant_id").limit(limit)
    return out.withColumns({
        "total": F.col("total").cast("double"), "logo_url": text.blank_if_missing("logo_url"),
        "avg": F.bround(F.col("total").cast("double") / F.col("visits"), 2)})


def recurring_table(df: DataFrame, spec: GroupingSpec) -> DataFrame:
    """Visible recurring merchants with their charges and estimated monthly burden.

    The burden is the mean of month sums by merchant name, so merchants that share a name share
    it; rows shrink to (merchant, month) before anything else happens.
    """
    rec = _rows(df, spec).filter("recurrence = 'recurring'")
    if "hidden" in df.columns:
        rec = rec.filter(~F.col("hidden"))
    per = rec.groupBy("merchant_id").agg(
        _first("merchant").alias("merchant"), _first("tier1").alias("tier1"),
        F.sum("count").cast("long").alias("charges"),
        F.sum("spend").cast("double").alias("total"), F.max("date_resolved").alias("last_date"))
    burden = (rec.filter("month IS NOT NULL").groupBy("merchant", "month")
              .agg(F.sum("spend").cast("double").alias("s")).groupBy("merchant")
              .agg(F.bround(F.avg("s"), 2).alias("est_monthly")))
    return per.join(burden, "merchant", "left").withColumns({
        "avg_charge": F.bround(F.col("total") / F.col("charges"), 2),
        "est_monthly": F.coalesce("est_monthly", F.lit(0.0))})


def merchant_series(df: DataFrame, spec: GroupingSpec, merchant: str) -> DataFrame:
    return (_rows(df, spec).filter((F.col("merchant") == merchant) & F.col("month").isNotNull())
            .groupBy("month").agg(F.sum("spend").cast("double").alias("spend")))


def recurring_next(df: DataFrame) -> DataFrame:
    """Last charge and the next expected one: the median gap later."""
    return enrich.recurring_merchants(df).select(
        "merchant_id", F.col("last_day").cast("string").alias("last_seen"),
        F.date_add("last_day", F.round("median_gap").cast("int")).cast("string")
        .alias("next_expected"))


def necessity_lens(df: DataFrame, facet_dim: DataFrame) -> DataFrame:
    """Spend by a per-atom facet that is independent of the category tree, next to tier0."""
    facet = facet_dim.select("atom", F.col("necessity").alias("lens"))
    rows = df.filter("flow = 'spend'").join(facet, "atom", "left")
    per = rows.withColumn("lens", F.coalesce("lens", F.lit("Unknown"))) \
        .groupingSets([[F.col("lens")], [F.col("tier0")]], "lens", "tier0") \
        .agg(F.sum("spend").cast("double").alias("spend"), F.grouping_id().alias("g"))
    return per.select(F.when(F.col("g") == 1, "necessity").otherwise("tier0").alias("lens"),
                      F.coalesce("lens", "tier0").alias("bucket"), "spend")


def label_scorecard(df: DataFrame) -> DataFrame:
    """Outcomes per stated confidence and overall: counts, precision, impossible signs.

    Needs outcome (accepted / repicked / not_applied), confidence and sign_impossible.
    """
    def n(name):
        return F.count(F.when(F.col("outcome") == name, 1))

    total = F.count(F.lit(1))
    return df.groupingSets([[F.col("confidence")], []], "confidence").agg(
        total.alias("n"), n("accepted").alias("n_accepted"), n("repicked").alias("n_repicked"),
        n("not_applied").alias("n_not_applied"), (n("accepted") / total).alias("precision"),
        F.count(F.when(F.col("sign_impossible"), 1)).alias("n_sign_impossible"),
        F.grouping_id().alias("_g")).select(
        F.when(F.col("_g") == 1, "ALL").otherwise(F.col("confidence")).alias("confidence"),
        "n", "n_accepted", "n_repicked", "n_not_applied", "precision", "n_sign_impossible")
