"""Session settings that the jobs are written for."""

import os

from pyspark.sql import SparkSession

# A value already set by the cluster wins over each of these.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # wide records make stages whose generated method the JVM would never compile
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def compiled(spark: SparkSession) -> None:
    """The limit above in a session that somebody else made, unless it has one of its own."""
    if spark.conf.get(_LIMIT, None) in (None, "65535"):  # Spark's own
        spark.conf.set(_LIMIT, SETTINGS[_LIMIT])


def local_session(cpus: int | None = None) -> SparkSession:
    """A single-machine session for tests and the bench; its heap leaves room for Python beside it."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("ledgerloom")
               .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(cpus))
               .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC"))
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
