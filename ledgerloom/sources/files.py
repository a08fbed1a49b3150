"""File sources and sinks: JSON lines, xz archives, payloads, ledgers, versioned stores."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schema
from ledgerloom.functions import text


def read_jsonl(spark: SparkSession, paths, ddl: str = schema.TXN_DDL) -> DataFrame:
    """JSON lines under a declared schema, with file name and the text of unreadable lines."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    packed = [p for p in paths if p.endswith(".xz")]
    if packed:
        raise ValueError(f"xz files need read_jsonl_xz: {packed[0]}")
    full = T.StructType.fromDDL(ddl).add("_corrupt_record", "string")
    return (spark.read.schema(full).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)
            .withColumn("_file", F.col("_metadata.file_path")))


def split_rejects(rows: DataFrame, key: str = "transaction_id"):
    """(good rows, quarantined rows): unreadable lines and rows without the key are set aside."""
    bad = F.col("_corrupt_record").isNotNull() | F.col(key).isNull() | (F.col(key) == "")
    return (rows.filter(~bad).drop("_corrupt_record"), rows.filter(bad))


def read_jsonl_xz(spark: SparkSession, paths, ddl: str = schema.TXN_DDL) -> DataFrame:
    """xz archives of JSON lines, a task for each block of their indexes; Spark has no codec for xz.

    Paths may be folders or patterns; only the names of files are listed here, and their indexes read.
    """
    from ledgerloom.sources.xz import XzLines

    paths = [paths] if isinstance(paths, str) else list(paths)
    names = [r[0] for r in spark.read.format("binaryFile").load(paths).select("path").collect()]
    spark.dataSource.register(XzLines)
    lines = spark.read.format(XzLines.name()).option("paths", "\n".join(sorted(names))).load()
    return parse_lines(lines, "value", ddl)


def parse_lines(lines: DataFrame, column: str, ddl: str) -> DataFrame:
    """One JSON object per line -> columns, with the text of unreadable lines kept."""
    struct = T.StructType.fromDDL(ddl).add("_corrupt_record", "string")
    body = F.trim(F.regexp_replace(column, r"[\r\n]+$", ""))
    parsed = F.from_json(body, struct, {"mode": "PERMISSIVE",
                                        "columnNameOfCorruptRecord": "_corrupt_record"})
    rest = [c for c in lines.columns if c != column]
    return (lines.filter(body != "").withColumn("_p", parsed).select("_p.*", *rest))


def parse_payloads(df: DataFrame, column: str, ddl: str) -> DataFrame:
    """Text payloads of JSON lines -> one row per non-blank line; unreadable lines parse to null."""
    line = F.explode(F.split(F.col(column), "\n"))
    lines = df.select(line.alias("line")).filter(F.trim("line") != "")
    is_object = F.startswith(F.trim("line"), F.lit("{"))
    return lines.withColumn("parsed", F.when(is_object, F.from_json("line", ddl)))


def union_sources(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "yyyy/M/d", "M-d-yyyy", "MMM d, yyyy", "d MMM yyyy"]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """An all-text ledger CSV -> person, month, category, spend; empty when not a ledger."""
    empty = spark.createDataFrame([], "person string, month string, category string, "
                                      "spend decimal(18,2)")
    try:
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    except Exception as e:  # a missing file is an empty ledger
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    if {"Date", "Category", "Debit Less Credit"} - set(raw.columns):
        return empty
    return parse_ledger(raw)


def parse_ledger(raw: DataFrame) -> DataFrame:
    """Rows with a readable date and a non-zero amount; dates may mix formats row by row."""
    day = F.coalesce(*[F.try_to_date("Date", f) for f in DATE_FORMATS])
    person = text.blank("Source") if "Source" in raw.columns else F.lit("")
    out = raw.select(person.alias("person"), F.date_format(day, "yyyy-MM").alias("month"),
                     F.trim("Category").alias("category"),
                     text.money("Debit Less Credit").alias("spend"))
    return out.filter(F.col("month").isNotNull() & F.col("spend").isNotNull()
                      & (F.col("spend") != 0))


def ledger_sums(ledger: DataFrame, persons=None, date_from=None, date_to=None) -> DataFrame:
    """Net spend per category and month; person and month bounds are the filters it can honor."""
    df = ledger
    if persons:
        df = df.filter(F.col("person").isin(*persons))
    if date_from:
        df = df.filter(F.col("month") >= date_from[:7])
    if date_to:
        df = df.filter(F.col("month") <= date_to[:7])
    return df.groupBy("category", "month").agg(F.sum("spend").alias("spend"))


VERDICT_DDL = ("seq long, transaction_id string, verdict string, primary string, "
               "detailed string, reason string")
INTENT_DDL = ("seq long, id string, created_at string, action string, source string, scope string, "
              "match map<string,string>, set struct<primary:string,detailed:string>, note string, "
              "revokes string, snapshot map<string,string>")


def read_verdicts(spark: SparkSession, paths) -> DataFrame:
    """Reviewer verdicts; `seq` in the data is their order."""
    good, _ = split_rejects(read_jsonl(spark, paths, VERDICT_DDL))
    return good.drop("_file")


def read_intents(spark: SparkSession, paths) -> DataFrame:
    """An intent log as flat columns; unreadable lines are left out, `seq` in the data is order."""
    rows = read_jsonl(spark, paths, INTENT_DDL).filter("_corrupt_record IS NULL")
    known = F.array(*[F.lit(k) for k in ("transaction_id", "merchant_entity_id",
                                         "merchant_name_normalized")])
    keys = F.coalesce(F.map_keys("match"), F.array().cast("array<string>"))
    other = F.array_join(F.array_except(keys, known), ",")
    snap = {"merchant_name": "merchant_name", "entity_id": "merchant_entity_id",
            "before_step": "before_step", "before_reason": "before_reason",
            "pending_primary": "review_pending_primary",
            "pending_detailed": "review_pending_detailed", "source_confidence": "source_confidence",
            "website": "website"}
    return rows.select(
        "seq", "id", "created_at", F.coalesce("action", F.lit("edit")).alias("action"), "source",
        "scope", F.col("match")["transaction_id"].alias("match_transaction_id"),
        F.col("match")["merchant_entity_id"].alias("match_entity_id"),
        F.col("match")["merchant_name_normalized"].alias("match_name"),
        text.or_null(other).alias("match_other"), F.col("set.primary").alias("set_primary"),
        F.col("set.detailed").alias("set_detailed"), "note", "revokes",
        *[F.col("snapshot")[k].alias(f"snap_{n}") for n, k in snap.items()])
