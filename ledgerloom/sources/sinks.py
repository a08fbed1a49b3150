"""Sinks: versioned stores, flat CSV, append-only logs."""

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.plans import lineage


class SnapshotStore:
    """A store kept as numbered snapshots; the newest complete one is current, none is deleted.

    A snapshot is complete once Spark's job commit has left its marker, so a reader never sees a
    half-written one, and writing the same number again after a failure replaces the remains.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _dir(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def versions(self) -> list[int]:
        """Complete snapshot numbers, oldest first; a listing of names, not of data."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("version=") and fs.exists(done):
                found.append(int(name.split("=", 1)[1]))
        return sorted(found)

    def _claim(self) -> int:
        """A number above all complete ones that no other writer has."""
        jvm = self.spark._jvm
        version = (self.versions() or [0])[-1] + 1
        claims = jvm.org.apache.hadoop.fs.Path(self.path, "_claims")
        fs = claims.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(claims)
        while not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(claims, str(version))):
            version += 1
        return version

    def read(self, version: int | None = None) -> DataFrame | None:
        """The store as of a snapshot number, or now; None when nothing was written yet."""
        known = self.versions()
        if version is None:
            return self.spark.read.parquet(self._dir(known[-1])) if known else None
        if version not in known:
            raise ValueError(f"no complete snapshot {version}; have {known}")
        return self.spark.read.parquet(self._dir(version))

    def write(self, df: DataFrame, version: int | None = None, sort=("date", "transaction_id")):
        """A new snapshot, its files ranged by date and sorted inside; returns its number.

        Without a number the next free one is claimed, so that two writers never share one.
        """
        version = self._claim() if version is None else version
        keys = [c for c in sort if c in df.columns]
        out = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
        with lineage.tidied(self.spark):
            out.write.mode("overwrite").parquet(self._dir(version))
        return version

    def restore(self, version: int) -> int:
        """Makes an old snapshot current by writing it again as the newest."""
        return self.write(self.read(version))


class MonthStore:
    """Rows by month of `date`; a change writes the months it touches anew and leaves all others as they are.

    Each write goes to a folder of its own number, and a manifest, a row a month, names the folder that holds each month.
    The manifest is a snapshot, so a change shows whole or not at all, whenever its job is lost; what older manifests name
    stays readable. Readers open only the months they ask for. Rows without a date share a month.
    """

    MONTH = "store_month"

    def __init__(self, spark: SparkSession, path: str, key="transaction_id", date="date"):
        self.spark, self.path, self.key, self.date = spark, path.rstrip("/"), key, date
        self.manifest = SnapshotStore(spark, f"{self.path}/manifest")

    def _dated(self, df: DataFrame) -> DataFrame:
        month = F.coalesce(F.date_format(F.col(self.date), "yyyy-MM"), F.lit("none"))
        return df.withColumn(self.MONTH, month)

    def months(self, version: int | None = None) -> dict[str, int]:
        """The number of the write that holds each month."""
        rows = self.manifest.read(version)
        return {} if rows is None else {r["month"]: r["number"] for r in rows.collect()}

    def _put(self, dated: DataFrame, number: int, made=None) -> list[str]:
        """Writes rows as a numbered folder; returns its months. Large months are dealt over several files."""
        folder = f"{self.path}/data/number={number}"
        dealt = dated.hint("rebalance", self.MONTH).sortWithinPartitions(self.MONTH, self.date, self.key)
        with lineage.tidied(self.spark):
            (made(dealt) if made else dealt).write.mode("overwrite").partitionBy(self.MONTH).parquet(folder)
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(folder)
        names = [s.getPath().getName() for s in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)]
        return [n.split("=", 1)[1] for n in names if n.startswith(f"{self.MONTH}=")]

    def _commit(self, held: dict[str, int], number: int) -> None:
        rows = self.spark.createDataFrame(sorted(held.items()), "month string, number long").coalesce(1)
        self.manifest.write(rows, number, sort=())

    def write(self, df: DataFrame, made=None) -> None:
        """Replaces the months that `df` has rows of. Where `made` is given, it makes the rows to keep, month included, of
        those of `df` once they are dealt and sorted, so that narrower ones move."""
        self._replace(self._dated(df), (), made)

    def replace(self, df: DataFrame, months) -> None:
        """Replaces the given months by what `df` has of them; months it has no rows of are emptied."""
        self._replace(self._dated(df), months)

    def _replace(self, dated: DataFrame, months, made=None) -> None:
        number = self.manifest._claim()
        written = self._put(dated, number, made)
        left = {m: n for m, n in self.months().items() if m not in months}
        self._commit({**left, **dict.fromkeys(written, number)}, number)

    def read(self, first: str | None = None, last: str | None = None, months=None, version: int | None = None) -> DataFrame:
        """The store, or its months from `first` to `last` (yyyy-MM, both included) or those named."""
        held = self.months(version)
        wanted = {m: n for m, n in held.items() if (first is None or m >= first) and (last is None or m <= last)
                  and (months is None or m in months)}
        chosen = wanted or held
        if not chosen:
            raise ValueError(f"nothing was written to {self.path} yet")
        folders = [f"{self.path}/data/number={n}/{self.MONTH}={m}" for m, n in sorted(chosen.items())]
        df = self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", "false").parquet(*folders)
        df = df.withColumn(self.MONTH, F.col(self.MONTH).cast("string")).drop("number")
        return df if wanted else df.filter("false")

    def months_of(self, keys: DataFrame) -> list[str]:
        """Months that hold rows of the given keys, from the store's key column alone."""
        if not self.months():
            return []
        found = self.read().select(self.key, self.MONTH).join(keys.select(self.key).distinct(), self.key, "left_semi")
        return sorted(r[0] for r in found.select(self.MONTH).distinct().collect())  # months, not rows

    def upsert(self, fresh: DataFrame) -> list[str]:
        """Rows of `fresh` over those with their key; returns the months that were written anew or emptied."""
        fresh = self._dated(lineage.stored(fresh, "fresh"))
        coming = [r[0] for r in fresh.select(self.MONTH).distinct().collect()]
        touched = sorted({*self.months_of(fresh), *coming})
        held, out = self.months(), fresh
        if set(touched) & set(held):
            kept = self.read(months=touched).join(fresh.select(self.key), self.key, "left_anti")
            out = kept.unionByName(fresh, allowMissingColumns=True)
        self._replace(out, touched)
        return touched


class KeyedStore:
    """Snapshots bucketed by key: joins on the key read a snapshot where it lies, without moving it.

    Rows are dealt by the key's hash into `buckets` sorted files, as many as a cluster has use for at once.
    """

    def __init__(self, spark: SparkSession, path: str, key="transaction_id", buckets=64):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.snapshots = SnapshotStore(spark, path)

    def _table(self, version: int) -> str:
        """Spark's name for a snapshot in this session."""
        return f"keyed_{md5(self.snapshots.path.encode()).hexdigest()}_{version}"

    def write(self, df: DataFrame, dealt=False) -> int:
        """A new snapshot; `dealt` rows are spread by the key's hash over `buckets` partitions already."""
        version = self.snapshots._claim()
        name = self._table(version)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        with lineage.tidied(self.spark):
            ((df if dealt else df.repartition(self.buckets, self.key)).write.bucketBy(self.buckets, self.key).sortBy(self.key).mode("overwrite")
             .option("path", self.snapshots._dir(version)).saveAsTable(name))
        return version

    def read(self, version: int | None = None) -> DataFrame:
        known = self.snapshots.versions()
        if version not in (known if version is not None else [None]) or not known:
            raise ValueError(f"no complete snapshot {version}; have {known}")
        version = known[-1] if version is None else version
        name = self._table(version)
        if not self.spark.catalog.tableExists(name):
            folder = self.snapshots._dir(version)
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(folder).schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return self.spark.table(name)


def write_flat_csv(df: DataFrame, path: str, columns, date="date") -> None:
    """Flat CSV in a fixed column order, text guarded against formulas, rows in a fixed order."""
    flat = text.csv_safe_frame(df.select(*columns))
    order = ([date] if date in columns else []) + [c for c in columns if c != date]
    flat.orderBy(*order).write.mode("overwrite").option("header", True) \
        .option("quoteAll", False).option("emptyValue", "").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to an append-only JSON log; nothing in it is ever rewritten."""
    df.write.mode("append").json(path)


def append_intents(log: DataFrame, path: str) -> None:
    """Adds intents; their order travels as `seq`, since file order is no contract."""
    log.filter(F.col("seq").isNotNull()).write.mode("append").parquet(path)
