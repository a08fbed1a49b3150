"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from uuid import uuid4
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 512  # rows turned into Python objects at once
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names, whatever else the table has; a null text counts as empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_slices(df: DataFrame, one: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`one` over slices of a few hundred rows, so that a task holds few texts at a time."""

    def run(batches):
        for part in slices(batches):
            out = one(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def in_blocks(items: Iterable, size: int) -> Iterator[list]:
    items = iter(items)
    while block := list(islice(items, size)):
        yield block


def spread(rows: int | Column, per: int) -> int:
    """How many buckets keep each under about `per` rows."""
    return max(1, -(-int(rows) // per))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; one is made only where none is named."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage in the shared folder."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table below the shared folder and read again; the shuffle files that made it go when it is written."""
    folder, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        conf.set(_CLEAN, before)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    _FOLDERS[out] = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `stored` wrote, once all that was derived from them is stored itself."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(df))
        folder.getFileSystem(conf).delete(folder, True)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """`docs`, stored with a number of its own for each row in a last column, _row or a longer name that is free, and of it
    row, rank (a null id is least), tie, text."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    held = stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    return held, held.select(F.col(name).alias("row"), F.coalesce(held[id_col].cast("long"), F.lit(NULL_ID)).alias("rank"),
                             F.xxhash64(text_col).alias("tie"), F.coalesce(held[text_col].cast("string"), F.lit("")).alias("text"))
