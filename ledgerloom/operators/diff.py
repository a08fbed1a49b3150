"""Two copies of a keyed store: reconcile, merge, classify, repair windows, change feeds."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import fixed, schema
from ledgerloom.functions import text
from ledgerloom.operators import authority, ingest
from ledgerloom.plans import lineage


def align(a: DataFrame, b: DataFrame):
    """Both sides with the same columns in the same order; a missing column is null."""
    types = {f.name: f.dataType for f in b.schema.fields}
    types.update({f.name: f.dataType for f in a.schema.fields})

    def full(df):
        return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n)
                           for n, t in types.items()])

    return full(a), full(b)


def remote_wins(local, remote):
    return remote


def newest_audit_wins(local, remote):
    """The later audit stamp as text; a missing stamp is oldest and a tie keeps the remote."""
    blank = F.lit("")
    return F.when(F.coalesce(local["category_audited_at"], blank)
                  > F.coalesce(remote["category_audited_at"], blank), local).otherwise(remote)


def reconcile(local: DataFrame, remote: DataFrame, key="transaction_id", metadata=(),
              resolver=remote_wins) -> DataFrame:
    """Full outer join by key: (key, sync_class, local, remote, merged) with whole records.

    Records equal but for `metadata` are in sync and keep the local copy; a conflict keeps what
    `resolver(local, remote)` picks.
    """
    local, remote = align(local, remote)
    names = local.columns
    l = local.select(F.col(key).alias("_lk"), F.struct(*names).alias("local"))
    r = remote.select(F.col(key).alias("_rk"), F.struct(*names).alias("remote"))
    both = l.join(r, F.col("_lk") == F.col("_rk"), "full_outer")
    content = [n for n in names if n != key and n not in metadata]

    def body(side):
        return F.struct(*[F.col(side)[n] for n in content])

    sync = (F.when(F.col("_rk").isNull(), "local_only").when(F.col("_lk").isNull(), "remote_only")
            .when(body("local").eqNullSafe(body("remote")), "in_sync").otherwise("conflict"))
    out = both.withColumn("sync_class", sync)
    kind = F.col("sync_class")
    merged = (F.when(kind.isin("in_sync", "local_only"), F.col("local"))
              .when(kind == "remote_only", F.col("remote"))
              .otherwise(resolver(F.col("local"), F.col("remote"))))
    return out.select(F.coalesce("_lk", "_rk").alias(key), "sync_class", "local", "remote",
                      merged.alias("merged"))


def merged_store(report: DataFrame) -> DataFrame:
    return report.select("merged.*")


def reconcile_counts(report: DataFrame, key="transaction_id") -> DataFrame:
    """(sync_class, n, key): how many rows each class has, a row a class without a key, and each conflict's key, a row each.

    Both come of one pass; keys are rows and no list, so a store full of conflicts is spread like any other.
    """
    told = F.array(F.lit(None).cast(report.schema[key].dataType))
    told = F.when(F.col("sync_class") == "conflict", F.concat(told, F.array(key))).otherwise(told)
    return (report.select("sync_class", F.explode(told).alias(key)).groupBy("sync_class", key)
            .agg(F.count(F.lit(1)).alias("n")).select("sync_class", "n", key))


def sorted_id_sample(report: DataFrame, n=fixed.ID_SAMPLE, key="transaction_id", by="sync_class") -> DataFrame:
    """First n ids per class of a column; a row-number filter, so each map task passes on n rows at most."""
    w = Window.partitionBy(by).orderBy(key)
    return report.select(by, key).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def conflict_keys(report: DataFrame, key="transaction_id") -> DataFrame:
    """(key, what): each conflict's key and the fields, comma-joined, in which the copies differ."""
    names = [f.name for f in report.schema["local"].dataType.fields if f.name not in (key, *schema.METADATA_COLUMNS)]
    differing = F.array(*[F.when(~F.col("local")[c].eqNullSafe(F.col("remote")[c]), F.lit(c)) for c in names])
    return report.filter("sync_class = 'conflict'").select(key, F.array_join(differing, ",").alias("fields"))


def reconcile_log(report: DataFrame, run_ts: str) -> DataFrame:
    """The log row of a reconciliation: how many rows of each class there are."""
    def n(kind):
        return F.count(F.when(F.col("sync_class") == kind, 1)).alias(kind)

    return report.agg(*[n(k) for k in ("in_sync", "local_only", "remote_only", "conflict")]).select(
        F.lit(run_ts).alias("ts"), F.lit("reconcile").alias("event"), "in_sync", "local_only", "remote_only", "conflict")


def overfetch_log(changes: DataFrame, run_ts: str, key="transaction_id") -> DataFrame:
    """The log rows of a safety-net fetch: per kind of change how many rows and the first ids in order."""
    first = sorted_id_sample(changes, key=key, by="change").groupBy("change").agg(
        F.sort_array(F.collect_list(key)).alias("first_ids"))
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).join(first, "change").select(
        F.lit(run_ts).alias("ts"), F.lit("overfetch").alias("event"), "change", "n", F.array_join("first_ids", ",").alias("first_ids"))


def adopt_head(prior: DataFrame, remote: DataFrame) -> DataFrame:
    """Rebase on the other writer's head: the newest audit wins and metadata never conflicts."""
    return reconcile(prior, remote, metadata=schema.METADATA_COLUMNS, resolver=newest_audit_wins)


def conflict_log(report: DataFrame, run_ts: str, key="transaction_id") -> DataFrame:
    """Both versions of every conflict and which side was kept."""
    kept = F.when(F.col("merged").eqNullSafe(F.col("local")), "local").otherwise("remote")
    return report.filter("sync_class = 'conflict'").select(
        F.lit(run_ts).alias("ts"), key, kept.alias("kept"), "local", "remote")


def unresolved_conflicts(report: DataFrame, golden: DataFrame | None = None,
                         key="transaction_id") -> DataFrame:
    """Conflicts that no golden row confirms."""
    bad = report.filter("sync_class = 'conflict'").select(key)
    return bad if golden is None else bad.join(golden.select(key), key, "left_anti")


class GateError(Exception):
    """A check that must hold before anything is written does not; `rows` are those against it."""

    def __init__(self, message, rows=None):
        super().__init__(message)
        self.rows = rows


def gate_empty(bad: DataFrame, what: str, key="transaction_id") -> None:
    """Stops the job when `bad` has rows; tells how many and the first ids, and hands on them all."""
    first = [str(r[0]) for r in bad.select(key).orderBy(key).limit(5).collect()]
    if first:
        raise GateError(f"{what}: {bad.count()} rows, {', '.join(first)} first; nothing was written",
                        bad)


def unresolved_gate(report: DataFrame, golden: DataFrame | None = None) -> None:
    gate_empty(unresolved_conflicts(report, golden), "unresolved conflicts between the copies")


def union_prefer(base: DataFrame, fresh: DataFrame, key="transaction_id") -> DataFrame:
    """Keyed union in which the fresh side wins."""
    return base.join(fresh.select(key), key, "left_anti").unionByName(fresh,
                                                                      allowMissingColumns=True)


def merge_golden(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows overwrite by id, rows without an id are skipped, settled pendings go."""
    keyed = fresh.filter(text.blank("transaction_id") != "")
    return ingest.drop_settled_pending(union_prefer(base, keyed))


def keys_removed(prior: DataFrame, now: DataFrame, key="transaction_id") -> DataFrame:
    return prior.select(key).join(now.select(key), key, "left_anti")


def source_hash(df: DataFrame):
    """Content hash of a record without our own columns."""
    return text.content_hash(df, [c for c in df.columns if c not in schema.NON_SOURCE_COLUMNS
                                  and c != "seq"])


def incremental_classify(source: DataFrame, prior: DataFrame, full=False,
                         key="transaction_id") -> DataFrame:
    """(key, delta_class, hash): new, changed, carryover or removed.

    A prior row without a hash is adopted as the baseline; `full` sends every input row through. Only
    keys and hashes meet; a prior store that is bucketed by key stays where it is.
    """
    s = source.select(F.col(key).alias("_k"), source_hash(source).alias("hash"))
    p = prior.select(F.col(key).alias("_pk"), F.col(schema.HASH_COLUMN).alias("_old"))
    both = s.join(p, F.col("_k") == F.col("_pk"), "full_outer")
    kind = (F.when(F.col("_k").isNull(), "removed").when(F.col("_pk").isNull(), "new")
            .when(F.lit(full), "changed").when(F.col("_old").isNull() | (F.col("_old") == F.col("hash")), "carryover")
            .otherwise("changed"))
    return both.select(F.coalesce("_k", "_pk").alias(key), kind.alias("delta_class"), "hash")


def fetch_todo(delta: DataFrame, source: DataFrame, prior: DataFrame, key="transaction_id") -> DataFrame:
    """The whole source rows of new and changed keys, with _hash and _prior, the row they replace if any."""
    todo = delta.filter(F.col("delta_class").isin("new", "changed"))
    old = prior.join(todo.filter("delta_class = 'changed'").select(key), key, "left_semi")
    old = old.select(F.col(key).alias("_pk"), F.struct(*prior.columns).alias("_prior"))
    rows = source.join(todo.select(F.col(key).alias("_k"), F.col("hash").alias("_hash")), F.col(key) == F.col("_k"))
    return rows.join(old, F.col("_k") == F.col("_pk"), "left").drop("_k", "_pk")


def carried_over(delta: DataFrame, prior: DataFrame, key="transaction_id") -> DataFrame:
    """The prior rows that stay as they are; those without a hash get theirs."""
    known = delta.filter("delta_class = 'carryover'").select(F.col(key).alias("_k"), "hash")
    kept = prior.join(known, F.col(key) == F.col("_k"))
    return kept.withColumn(schema.HASH_COLUMN, F.coalesce(schema.HASH_COLUMN, "hash")).select(*prior.columns)


def bad_prunes(delta: DataFrame, prior: DataFrame, key="transaction_id") -> DataFrame:
    """Removed rows that were not pending: the input is stale or cut short."""
    gone = delta.filter("delta_class = 'removed'").select(key)
    return prior.filter(~F.coalesce("pending", F.lit(False))).join(gone, key, "left_semi").select(key)


def prune_gate(delta: DataFrame, prior: DataFrame) -> None:
    gate_empty(bad_prunes(delta, prior), "input lacks posted rows that the store has")


def audit_content_equal(a, b, columns):
    """Two records are equal but for stamps and collector metadata."""
    names = [c for c in columns if c not in schema.METADATA_COLUMNS]
    return F.struct(*[a[c] for c in names]).eqNullSafe(F.struct(*[b[c] for c in names]))


def overfetch_window(today: str):
    """First and last day, as text, of the window in which a row's absence counts."""
    now = F.to_date(F.lit(today))
    return (F.date_sub(now, fixed.OVERFETCH_WINDOW_DAYS).cast("string"), F.date_sub(now, fixed.STALE_TAIL_DAYS).cast("string"))


def overfetch_classify(store: DataFrame, fresh: DataFrame, today: str) -> DataFrame:
    """(transaction_id, change): rows of a golden window that are added or changed, and stale rows.

    Stale: posted, dated in the window but not in its tail, on an account that a fully fetched
    item covers, and absent from the window. `fresh` has item_ok; when no item is ok, nothing is
    reported. The store is met from the side of the window: rows with the window's ids are picked out of it first, and
    only its rows dated in the window are asked whether they are absent, so a store read by date opens no other months.
    """
    any_ok = fresh.filter("item_ok").limit(1).agg((F.count(F.lit(1)) > 0).alias("ok"))
    fresh = lineage.stored(fresh.filter(any_ok.scalar()), "fetched")
    covered = fresh.filter("item_ok").select("account_id").distinct()
    golden = fresh.drop("item_ok", "seq").filter(text.blank("transaction_id") != "")
    names = [c for c in golden.columns if c != "transaction_id" and c in store.columns]
    ids = golden.select("transaction_id").distinct()
    known = store.join(ids, "transaction_id", "left_semi").select(
        F.col("transaction_id").alias("_s"), F.struct(*names).alias("_sv"))
    met = golden.select("transaction_id", F.struct(*names).alias("_gv")).join(
        known, F.col("transaction_id") == F.col("_s"), "left")
    told = met.select("transaction_id", F.when(F.col("_s").isNull(), "added").when(
        ~F.col("_sv").eqNullSafe(F.col("_gv")), "changed").alias("change")).filter("change IS NOT NULL")
    first, last = overfetch_window(today)
    day = F.substring("date", 1, 10)
    stale = (store.filter((F.col("date") >= first) & (day <= last) & ~F.coalesce("pending", F.lit(False)))
             .select("transaction_id", "account_id").join(ids, "transaction_id", "left_anti")
             .join(covered, "account_id", "left_semi"))
    return told.unionByName(stale.select("transaction_id", F.lit("stale").alias("change")))


def overfetch_months(store, fresh: DataFrame, today: str) -> DataFrame:
    """`overfetch_classify` over a store in months: those of the window and those that hold the window's ids."""
    first, last = (str(day)[:7] for day in store.spark.range(1).select(*overfetch_window(today)).first())
    window = {m for m in store.months() if first <= m <= last}
    return overfetch_classify(store.read(months=window | set(store.months_of(fresh))).drop(store.MONTH), fresh, today)


def overfetch_merge(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Golden rows overwrite or add; nothing is deleted."""
    keyed = fresh.drop("item_ok").filter(text.blank("transaction_id") != "")
    return union_prefer(store, keyed)


def repair_window(store: DataFrame, today: str, extra: DataFrame | None = None) -> DataFrame:
    """One row: start and end of the repair window, and how many pendings it covers.

    A week before the last settled date, or a long backfill when nothing is settled; pending rows
    and the `extra` ids only ever widen it.
    """
    posted = ~F.coalesce("pending", F.lit(False))
    rows = store.select("transaction_id", "pending", text.parse_date("date").alias("d"))
    if extra is not None:
        wanted = extra.select("transaction_id").distinct().withColumn("_x", F.lit(True))
        rows = rows.join(wanted, "transaction_id", "left")
    else:
        rows = rows.withColumn("_x", F.lit(False))
    now = F.to_date(F.lit(today))
    widen = F.min(F.when(~posted | F.coalesce("_x", F.lit(False)), F.col("d")))
    last = F.max(F.when(posted, F.col("d")))
    start = F.coalesce(F.date_sub(last, fixed.BACKSTOP_DAYS),
                       F.date_sub(now, fixed.EMPTY_BACKFILL_DAYS))
    return rows.agg(F.least(start, widen).cast("string").alias("start_date"),
                    now.cast("string").alias("end_date"),
                    F.count(F.when(~posted, 1)).alias("n_pending"))


def pending_ids(store: DataFrame) -> DataFrame:
    return store.filter("pending").select("transaction_id")


UPSERTS = ("added", "modified")


def apply_sync_deltas(base: DataFrame, deltas: DataFrame, key="transaction_id") -> DataFrame:
    """The store after a change feed: the last op per key decides; removed keys go."""
    last = ingest.last_per_key(deltas, key, "seq")
    keep = last.filter(F.col("op").isin(*UPSERTS)).drop("op", "seq")
    return base.join(last.select(key), key, "left_anti").unionByName(keep,
                                                                     allowMissingColumns=True)


def sync_counts(base: DataFrame, deltas: DataFrame, key="transaction_id",
                bucket=1_000_000) -> DataFrame:
    """Ops per kind; a removal counts only when its key was there at that point of the feed.

    Whether it was there is the key's previous op. A hot key's ops are cut into ranges of seq:
    within a range by a window, across ranges through one last op per (key, range).
    """
    d = deltas.select(key, "op", "seq", F.floor(F.col("seq") / bucket).alias("_b"))
    within = d.withColumn("_prev", F.lag("op").over(
        Window.partitionBy(key, "_b").orderBy("seq")))
    ends = d.groupBy(key, "_b").agg(F.max_by("op", "seq").alias("_end"))
    carried = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(key).orderBy("_b")))
    opening = within.filter("op = 'removed' AND _prev IS NULL").join(
        carried.select(key, "_b", "_carry"), [key, "_b"]).join(
        base.select(key, F.lit(True).alias("_in")), key, "left").select(
        F.coalesce(F.col("_carry").isin(*UPSERTS), F.col("_in"), F.lit(False)).alias("hit"))
    inner = within.filter("op = 'removed' AND _prev IS NOT NULL").select(
        F.col("_prev").isin(*UPSERTS).alias("hit"))
    removed = opening.unionByName(inner).agg(F.count(F.when(F.col("hit"), 1)).alias("n")).select(
        F.lit("removed").alias("op"), "n")
    upserts = d.filter(F.col("op").isin(*UPSERTS)).groupBy("op").agg(
        F.count(F.lit(1)).alias("n"))
    return upserts.unionByName(removed)


def owner_stamps(df: DataFrame, owner: str) -> DataFrame:
    """Every row with the owner it would have and the outcome: stamped, kept or other owner."""
    outcome = (F.when(F.col("txn_owner").isNull(), "stamped").when(F.col("txn_owner") == owner, "kept")
               .otherwise("other owner"))
    return df.withColumn("outcome", outcome).withColumn("txn_owner", F.coalesce("txn_owner", F.lit(owner)))


def owner_backfill(df: DataFrame, owner: str) -> DataFrame:
    """Stamps the owner where there is none; stops before any write if another owner is there."""
    out = owner_stamps(df, owner)
    gate_empty(out.filter("outcome = 'other owner'"), f"rows that already belong to another owner than {owner}")
    return out.drop("outcome")


def owner_filter(df: DataFrame, owner: str | None) -> DataFrame:
    """Rows of one owner; an unknown owner is an error that names all others."""
    if owner is None:
        return df
    mine = df.filter(F.col("txn_owner") == owner)
    if mine.limit(1).count() == 0:
        known = [r[0] for r in df.filter(text.blank("txn_owner") != "").select("txn_owner")
                 .distinct().orderBy("txn_owner").collect()]
        raise ValueError(f"unknown owner {owner!r}; known owners: {', '.join(known)}")
    return mine


def ensure_hash(df: DataFrame) -> DataFrame:
    """A store with all provenance columns and the content hash column."""
    out = authority.ensure_columns(df)
    return out if schema.HASH_COLUMN in out.columns else out.withColumn(
        schema.HASH_COLUMN, F.lit(None).cast("string"))
