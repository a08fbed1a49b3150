"""Small dimension tables. Built-in ones have a fixed size; user tables keep their own."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions import text


def literal(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A constant table as a local relation, so its exact size is known to the optimizer."""
    fields = [c.strip().split(" ") for c in schema.split(",")]

    def cell(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    names = ", ".join(n for n, _ in fields)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")


def category_menu(spark) -> DataFrame:
    """Legal (primary, detailed) pairs with their menu position."""
    rows = [(i, p, d) for i, (p, d) in enumerate(fixed.menu_pairs())]
    return literal(spark, rows, "ord int, primary string, detailed string")


def load_category_menu(spark, path) -> DataFrame:
    """A menu CSV (PRIMARY, DETAILED, DESCRIPTION); refuses any but the known primaries."""
    raw = spark.read.csv(path, header=True,
                         schema="PRIMARY string, DETAILED string, DESCRIPTION string")
    menu = (raw.select(F.trim("PRIMARY").alias("primary"), F.trim("DETAILED").alias("detailed"),
                       F.coalesce(F.trim("DESCRIPTION"), F.lit("")).alias("description"))
            .filter((F.col("primary") != "") & (F.col("detailed") != "")))
    known = F.array_sort(F.array(*[F.lit(p) for p in fixed.MENU]))
    check = menu.agg(F.assert_true(F.array_sort(F.collect_set("primary")) == known,
                                   F.lit("menu primaries are not the known ones")))
    check.collect()
    return menu


def primary_other(menu: DataFrame) -> DataFrame:
    """Catch-all leaf per primary: the first OTHER leaf, else the last leaf."""
    is_other = F.contains("detailed", F.lit("_OTHER_")) | F.endswith("detailed", F.lit("_OTHER"))
    return menu.groupBy("primary").agg(
        F.coalesce(F.min_by(F.when(is_other, F.col("detailed")), F.when(is_other, F.col("ord"))),
                   F.max_by("detailed", "ord")).alias("other_detailed"))


def with_tiers(pairs: DataFrame) -> DataFrame:
    """(primary, detailed) -> atom, tier0, tier1, tier2 by override, else primary default."""
    spark = pairs.sparkSession
    defaults = literal(spark, [(p, *t) for p, t in fixed.PRIMARY_TIERS.items()],
                       "primary string, d0 string, d1 string")
    overrides = literal(spark, [(a, *t) for a, t in fixed.ATOM_TIERS.items()],
                        "detailed string, o0 string, o1 string")
    return (pairs.join(F.broadcast(defaults), "primary", "left")
            .join(F.broadcast(overrides), "detailed", "left")
            .select(F.col("detailed").alias("atom"),
                    F.coalesce("o0", "d0", F.lit("Discretionary")).alias("tier0"),
                    F.coalesce("o1", "d1", F.lit("Other")).alias("tier1"),
                    text.humanize_tier2("detailed", "primary").alias("tier2")))


def atoms(spark) -> DataFrame:
    return with_tiers(literal(spark, fixed.atom_pairs(), "primary string, detailed string"))


def valid_overrides(spark, rows):
    """Ordered (regex, tier1, tier2) without those that the engine which runs them refuses."""
    from pyspark.errors import IllegalArgumentException

    good = []
    for row in rows:
        try:
            spark._jvm.java.util.regex.Pattern.compile(row[0])
        except IllegalArgumentException:
            continue
        good.append(row)
    return good


def nesting_violations(atom_dim: DataFrame) -> DataFrame:
    """tier1 values under more than one (non-splitting) tier0; empty when strictly nested."""
    return (atom_dim.groupBy("tier1").agg(F.countDistinct("tier0").alias("n_tier0"))
            .filter("n_tier0 > 1"))


def rule_table(spark, overlay=()) -> DataFrame:
    """Built-in rules with the personal overlay in front; ord counts from 0 per kind."""
    good = [r for r in overlay if well_formed(r)]
    rows, seen = [], {}
    for origin, table in (("personal", good), ("built-in", fixed.RULES)):
        for kind, pattern, (primary, detailed), trust in table:
            seen[kind] = seen.get(kind, -1) + 1
            rows.append((kind, seen[kind], pattern, primary, detailed, trust, origin))
    return literal(spark, rows, "kind string, ord int, pattern string, primary string, "
                                "detailed string, trust string, origin string")


def well_formed(entry) -> bool:
    try:
        kind, pattern, (primary, detailed), trust = entry
    except (TypeError, ValueError):
        return False
    return kind in ("pos_prefix", "website", "keyword")


def overlay_rules(overlay: DataFrame, built_in: DataFrame) -> DataFrame:
    """Overlay rules before the built-in ones of each kind; malformed entries left out.

    `ord` is (part, position): part 0 is the overlay, so one of any size needs no sort.
    """
    cols = ["kind", "pattern", "primary", "detailed", "trust", "origin"]
    ok = overlay.filter(F.col("pattern").isNotNull() & F.col("primary").isNotNull()
                        & F.col("detailed").isNotNull() & F.col("trust").isNotNull()
                        & F.col("kind").isin("pos_prefix", "website", "keyword"))
    def placed(part):
        return F.struct(F.lit(part).alias("part"), F.col("ord").cast("long").alias("place"))

    return (ok.withColumn("origin", F.lit("personal")).select(placed(0).alias("ord"), *cols)
            .unionByName(built_in.select(placed(1).alias("ord"), *cols)))


def rule_id(kind="kind", pattern="pattern"):
    """The id a rule leaves on the rows it touches."""
    p = F.col(pattern)
    return (F.when(F.col(kind) == "pos_prefix",
                   F.concat(F.lit("pos:"), F.regexp_replace(F.lower(p), r"\*+$", "")))
            .otherwise(F.concat(F.col(kind), F.lit(":"), p)))


def assert_unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """Fails the job when a key repeats in a dimension table."""
    n = F.count(F.lit(1))
    df.groupBy(key).agg(n.alias("n")).agg(
        F.assert_true(F.coalesce(F.max("n"), F.lit(0)) <= 1,
                      F.lit(f"{what}: duplicate {key}"))).collect()
    return df


def any_of(conditions):
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
