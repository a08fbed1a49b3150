"""The cube: declarative rollups, totals, facets, trees and tie-out over the enriched table."""

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions import text
from ledgerloom.plans.lineage import cut

MEASURES = ("spend", "income", "count", "net", "abs_amount")


@dataclass
class GroupingSpec:
    """A rollup request: grouping columns, facet filters, date bounds, measures, order, limit."""

    group_by: list[str] = field(default_factory=list)
    filters: dict[str, Any] = field(default_factory=dict)
    date_from: str | None = None
    date_to: str | None = None
    measures: list[str] = field(default_factory=lambda: ["spend", "count"])
    order_by: str | None = "spend"
    descending: bool = True
    limit: int | None = None
    include_hidden: bool = False


def facet_filter(df: DataFrame, spec: GroupingSpec) -> DataFrame:
    """Equality or membership per facet, inclusive date bounds, hidden rows left out."""
    if "hidden" in df.columns and not spec.include_hidden:
        df = df.filter(~F.col("hidden"))
    for name, wanted in spec.filters.items():
        if wanted is None or (isinstance(wanted, str) and wanted in ("", "All")):
            continue
        if isinstance(wanted, (list, tuple, set)):
            wanted = [v for v in wanted if v is not None and v != "All"]
            if wanted:
                df = df.filter(F.col(name).isin(*wanted))
        else:
            df = df.filter(F.col(name) == wanted)
    if spec.date_from:
        df = df.filter(F.col("date_resolved") >= spec.date_from)
    if spec.date_to:
        df = df.filter(F.col("date_resolved") <= spec.date_to)
    return df


def _measure(name):
    if name == "net":
        return (F.sum("income") - F.sum("spend")).cast("double").alias("net")
    kind = "long" if name == "count" else "double"
    return F.sum(name).cast(kind).alias(name)


def rollup(df: DataFrame, spec: GroupingSpec) -> DataFrame:
    """Grouped measures, ordered by one of them (ties by the keys), nulls last, avg_ticket."""
    wanted = [m for m in spec.measures if m in MEASURES] or ["spend", "count"]
    shown = wanted + ([] if "count" in wanted else ["count"])
    aggs = [_measure(m) for m in shown]
    rows = facet_filter(df, spec)
    out = rows.groupBy(*spec.group_by).agg(*aggs) if spec.group_by else rows.agg(*aggs)
    order = spec.order_by if spec.order_by in shown else wanted[0]
    first = F.desc_nulls_last(order) if spec.descending else F.asc_nulls_last(order)
    out = out.orderBy(first, *[F.asc_nulls_last(c) for c in spec.group_by])
    if spec.limit:
        out = out.limit(int(spec.limit))
    if "spend" in shown:
        out = out.withColumn("avg_ticket", text.ratio_or_zero("spend", "count"))
    return out


def grand_total(df: DataFrame, spec: GroupingSpec) -> DataFrame:
    """One row of totals for the filters; hidden rows never count here."""
    flat = GroupingSpec(filters=spec.filters, date_from=spec.date_from, date_to=spec.date_to)
    zero = F.lit(0.0)
    return facet_filter(df, flat).agg(
        F.coalesce(F.sum("spend").cast("double"), zero).alias("spend"),
        F.coalesce(F.sum("income").cast("double"), zero).alias("income"),
        F.coalesce(F.sum("count").cast("double"), zero).alias("count"),
        F.coalesce((F.sum("income") - F.sum("spend")).cast("double"), zero).alias("net"))


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(name)


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date_resolved").alias("date_min"),
                  F.max("date_resolved").alias("date_max"))


def hidden_mask(df: DataFrame, rules) -> DataFrame:
    """Adds `hidden`: the row equals any (dimension, value) rule; unknown dimensions ignored.

    `rules` is a short list of pairs, or a (dim, value) table of any length, which is joined one
    dimension at a time so that its size decides the join.
    """
    if not isinstance(rules, DataFrame):
        hit = F.lit(False)
        for dim, value in rules:
            if dim in df.columns:
                hit = hit | F.coalesce(F.col(dim) == value, F.lit(False))
        return df.withColumn("hidden", hit)
    names = [c for c in schema.CATEGORY_LEVELS + schema.GEO_LEVELS + schema.FACETS
             + ["merchant_id", "month", "flow"] if c in df.columns]
    # which of these few dimensions have rules at all: at most one short name per column
    used = [r[0] for r in rules.filter(F.col("dim").isin(*names)).select("dim").distinct()
            .orderBy("dim").collect()]
    out = df.withColumn("hidden", F.lit(False))
    for dim in used:
        wanted = (rules.filter(F.col("dim") == dim).select(F.col("value").alias(dim)).distinct()
                  .withColumn("_hit", F.lit(True)))
        out = out.join(wanted, dim, "left").withColumn(
            "hidden", F.col("hidden") | F.coalesce("_hit", F.lit(False))).drop("_hit")
    return out.select(*df.columns, "hidden")


TIE_OUT = schema.CATEGORY_LEVELS + ["person", "channel", "account_type"]


def tie_out(df: DataFrame, spec: GroupingSpec) -> DataFrame:
    """Every single grouping against the grand total, in one pass of grouping sets."""
    rows = facet_filter(df, spec).filter(F.col("flow") == "spend")
    sets = [[F.col(c)] for c in TIE_OUT] + [[]]
    per = rows.groupingSets(sets, *TIE_OUT).agg(F.sum("spend").alias("s"),
                                                F.grouping_id().alias("g"))
    everything = (1 << len(TIE_OUT)) - 1
    name = F.lit("total")
    for i, c in enumerate(TIE_OUT):
        name = F.when(F.col("g") == everything ^ (1 << (len(TIE_OUT) - 1 - i)), c).otherwise(name)
    sums = per.groupBy(name.alias("grouping")).agg(F.sum("s").cast("double").alias("sum"))
    total = F.max(F.when(F.col("grouping") == "total", F.col("sum")))
    one_window = Window.partitionBy(F.lit(1))
    return (sums.withColumn("total", F.coalesce(total.over(one_window), F.lit(0.0)))
            .filter(F.col("grouping") != "total")
            .select("grouping", F.coalesce("sum", F.lit(0.0)).alias("sum"),
                    (F.abs(F.coalesce("sum", F.lit(0.0)) - F.col("total")) < 0.01)
                    .alias("ties_out")))


def qc_metrics(df: DataFrame) -> DataFrame:
    """One row of quality figures; the atom list is bounded by the category codes."""
    spend = F.sum("spend").cast("double")
    other = F.sum(F.when((F.col("flow") == "spend") & (F.col("tier1") == "Other"),
                         F.col("spend"))).cast("double")
    excluded = F.col("flow") == "excluded"
    return df.agg(
        spend.alias("spend_total"), F.sum("income").cast("double").alias("income_total"),
        (F.sum("income") - F.sum("spend")).cast("double").alias("net_total"),
        F.count(F.when(excluded, 1)).alias("n_excluded"),
        F.coalesce(F.sum(F.when(excluded, F.col("abs_amount"))).cast("double"), F.lit(0.0))
        .alias("excluded_sum"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("unmapped"), F.col("atom")))), ",")
        .alias("unmapped_atoms"),
        F.count(F.when(F.col("unmapped"), 1)).alias("n_unmapped_rows"),
        F.when(spend != 0, F.coalesce(other, F.lit(0.0)) / spend * 100.0).otherwise(0.0)
        .alias("pct_spend_other"),
        F.countDistinct(F.when(F.col("recurrence") == "recurring", F.col("merchant_id")))
        .alias("n_recurring_merchants"))


def prefix_totals(df: DataFrame, levels, value="spend") -> DataFrame:
    """Total per path prefix. Full paths are summed first, so only their sums are expanded."""
    raw = F.array(*[F.col(c).cast("string") for c in levels])
    stop = F.array_position(F.transform(raw, lambda x: F.coalesce(x, F.lit("")) == ""), True)
    path = F.when(stop > 0, F.slice(raw, 1, (stop - 1).cast("int"))).otherwise(raw)
    per_path = df.groupBy(*levels).agg(F.sum(value).alias("v")).select(path.alias("p"), "v")
    return _expand(per_path)


def _expand(per_path: DataFrame) -> DataFrame:
    prefixes = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.slice("p", 1, i))
    return (per_path.filter(F.size("p") > 0).select(F.explode(prefixes).alias("node"), "v")
            .groupBy("node").agg(F.sum("v").alias("total")))


def drill_filter(df: DataFrame, root) -> DataFrame:
    """Rows under a path: level i equals element i."""
    for name, value in zip(schema.CATEGORY_LEVELS, root):
        df = df.filter(F.col(name) == value)
    return df


def hierarchy_totals(df: DataFrame, root=()) -> DataFrame:
    """Tree nodes under a root: id, parent id, label, value and absolute path."""
    levels = schema.CATEGORY_LEVELS[len(root):]
    nodes = prefix_totals(drill_filter(df, root), levels)
    depth = F.size("node")
    label = F.element_at("node", -1)
    if "atom" in levels:
        label = F.when(depth == levels.index("atom") + 1, text.humanize_atom(label)).otherwise(
            label)
    return nodes.select(
        F.array_join("node", "/").alias("id"),
        F.array_join(F.slice("node", F.lit(1), depth - 1), "/").alias("parent"),
        label.alias("label"), F.col("total").cast("double").alias("value"),
        F.concat(F.array(*[F.lit(r) for r in root]).cast("array<string>"), F.col("node"))
        .alias("path"))


def topk_frontier(df: DataFrame, k: int, path="category_path", value="spend") -> DataFrame:
    """Best-first expansion of the largest node until there are k buckets.

    With values >= 0 a parent never ranks below its child, so the expansion order is the order
    of non-leaf nodes by total, and the frontier size before each step is a running sum. Only
    non-leaf nodes meet in that one window: category tiers, not merchants.
    """
    per_path = df.groupBy(F.col(path).alias("p")).agg(F.sum(value).alias("v"))
    totals = cut(_expand(per_path))  # read four times below, and far smaller than the rows
    depth = F.size("node")
    parent = F.slice("node", F.lit(1), depth - 1)
    fan = totals.groupBy(parent.alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    roots = fan.filter(F.size("node") == 0).select("n_children")
    inner = fan.filter(F.size("node") > 0).join(totals, "node")
    order = Window.orderBy(F.desc("total"), F.size("node"), F.col("node"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = roots.scalar() + F.coalesce(F.sum(F.col("n_children") - 1).over(before), F.lit(0))
    expanded = (inner.withColumn("_size", size).filter(F.col("_size") < k)
                .select(F.col("node").alias("_e")))
    kids = totals.withColumn("_p", parent)
    open_kids = kids.filter(depth == 1).unionByName(
        kids.filter(depth > 1).join(expanded, F.col("_p") == F.col("_e"), "left_semi"))
    return (open_kids.join(expanded, F.col("node") == F.col("_e"), "left_anti")
            .select("node", "total"))


def frontier_assign(df: DataFrame, frontier: DataFrame, path="category_path") -> DataFrame:
    """Each row with the frontier bucket it falls under.

    Distinct paths, not rows, meet the frontier; the small result is joined back by path.
    """
    paths = df.select(path).distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, 1, i))
    chosen = (paths.select(path, F.explode(prefixes).alias("node"))
              .join(frontier.select("node"), "node").select(path, F.col("node").alias("bucket")))
    return df.join(chosen, path, "left")


def date_anchor(df: DataFrame, date_to: str | None = None):
    """The day trailing windows count back from: the upper bound, else the last date."""
    if date_to:
        return F.to_date(F.lit(date_to[:10]))
    return df.select(F.max("day")).scalar()


def trailing_window_rows(df: DataFrame, days: int, date_to: str | None = None) -> DataFrame:
    """Rows dated at most `days` before the anchor; the anchor is a scalar subquery."""
    return df.filter(F.col("day") >= F.date_sub(date_anchor(df, date_to), days))
