"""Spark side of the results that the registered queries start from.

Deduplicated rows, settled rows and the cube are plans: each query carries only the columns it asks for through them.
Rows stay packed until both checks are done. Queries in which whole settled rows meet each other, or which read them several
times, start from a store of them instead, bucketed by id, which is written once
a session and state of the input folder, so that no join on the id moves them again. A folder whose files change is built anew.
"""

from ledgerloom.operators import enrich, ingest
from ledgerloom.plans import lineage
from ledgerloom.sources import sinks, tables

_STORES = {}
FEW, BUCKET_BYTES = 16, 4 << 20  # buckets of a small input; of a large one, bytes of input a bucket


def state(spark, sf):
    """Name, size and time of every file of an input folder, whatever store it is in."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sf)
    found, files = [], root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def kept(spark, sf, name, build, stored=True):
    """The result of `build`, made when it is first asked for and written, unless `build` does that itself."""
    key = (spark.sparkContext.applicationId, sf, state(spark, sf), name)
    if key not in _STORES:
        _STORES[key] = lineage.stored(build(), name) if stored else build()
    return _STORES[key]


def deduped(spark, sf):
    return tables.records(ingest.dedupe_last(tables.feed(spark, sf)))


def settled(spark, sf):
    return tables.records(ingest.drop_settled_pending(ingest.dedupe_last(tables.feed(spark, sf))))


def buckets(spark, sf):
    """Buckets of the stores that whole rows of an input folder lie in."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(min(tasks, FEW), sum(f[1] for f in state(spark, sf)) // BUCKET_BYTES)


def settled_packed(spark, sf):
    """The settled rows, packed, from a store bucketed by id.

    It holds the deduplicated rows as they were dealt, packed, and beside them, in the same buckets, the references that the
    settled check asks for: both are made of the feed in one pass.
    """
    def build():
        n = buckets(spark, sf)
        # dealt once: the dedupe, the settled check and the store all go by the hash of the id
        dealt = tables.feed(spark, sf).repartition(n, "transaction_id")
        store = sinks.KeyedStore(spark, lineage.scratch(spark, "deduped"), buckets=n)
        store.write(ingest.dedupe_last(dealt), dealt=True)
        refs = sinks.KeyedStore(spark, lineage.scratch(spark, "references"), key="_ref", buckets=n)
        refs.write(ingest.references(store.read()))
        return ingest.drop_settled_pending(store.read(), refs.read())

    return kept(spark, sf, "settled", build, stored=False)


def settled_store(spark, sf):
    """The settled rows from that store, for joins of whole rows."""
    return tables.records(settled_packed(spark, sf))


def canon(spark, sf):
    return ingest.canonicalize(settled(spark, sf))


def cube(spark, sf, with_recurrence=False):
    """Recurrence reads the rows three times, so it starts from the store, whose ids are neither null nor repeated."""
    if not with_recurrence:
        return enrich.enrich(canon(spark, sf), tables.accounts(spark, sf), with_recurrence=False)
    return enrich.recurrence(cube_of_store(spark, sf), "transaction_id")


def cube_of_store(spark, sf):
    """The cube without recurrence, made of the stored rows: only their ids move to the accounts."""
    return enrich.enrich(ingest.canonicalize(settled_store(spark, sf)), tables.accounts(spark, sf), with_recurrence=False,
                         key="transaction_id")
