"""Queries that run a stream over the given tables to its end and read what it left."""

from pyspark.sql import functions as F

from fieldlab.plans.catalogue import _FOLD
from fieldlab.plans.paths import scratch
from fieldlab.sources.standins import OUTBOX_SQL, RECORDS_SQL, outbox, records, remote_batches
from fieldlab.streaming import catalogue as C
from fieldlab.streaming import keyed as K

QUERIES, SQL = {}, {}
BACKEND = "fieldlab.sources.push:BundleBackend"
_STATE = _FOLD.replace("FROM local\n", "FROM local WHERE false\n") + ", placed AS (SELECT *, min(seq) OVER (PARTITION BY uuid) AS first_seq, row_number() OVER (PARTITION BY uuid ORDER BY instant DESC, deleted DESC, seq) AS place FROM every), state AS (SELECT * FROM placed WHERE place = 1)"


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _followed(spark, d, root):
    """Follows the pulled rows, a change log of several files, with the record columns that statistics need."""
    rows = remote_batches(spark, d)[1].withColumn("address", F.col("texture_class"))
    rows.repartitionByRange(4, "seq").write.parquet(f"{root}/log")
    K.follow_catalogue(C.read_changes(spark, f"{root}/log", rows.schema, files_per_batch=2), root).awaitTermination()


@query("stream_live_catalogue", f"{_STATE} SELECT uuid, updated_at, texture_class, confidence_score FROM state WHERE NOT deleted")
def _(spark, d):
    root = scratch(spark, "stream")
    _followed(spark, d, root)
    return C.live_view(K.catalogue(spark, root)).select("uuid", "updated_at", "texture_class", "confidence_score")


@query("stream_home_stats", f"{_STATE} SELECT count(*) AS total, count(DISTINCT texture_class) AS addresses, round(avg(confidence_score), 9) AS mean_confidence FROM state WHERE NOT deleted")
def _(spark, d):
    root = scratch(spark, "stream")
    _followed(spark, d, root)
    K.follow_stats(spark, root).awaitTermination()
    return K.stats(spark, root).select("total", "addresses", F.round("mean_confidence", 9).alias("mean_confidence"))


@query("stream_outbox_drain", f"""WITH {RECORDS_SQL}, {OUTBOX_SQL}, todo AS (SELECT record_uuid, bool_or(operation = 'upsert') AS upserted FROM outbox WHERE status = 'pending' GROUP BY 1)
  SELECT o.id, o.record_uuid, o.operation, 'synced' AS status, r.uuid IS NULL AS orphan, CASE WHEN upserted THEN 'remote-' || r.uuid ELSE r.remote_id END AS remote_id,
    CASE WHEN upserted IS NOT NULL THEN 'synced' ELSE r.sync_status END AS sync_status
  FROM outbox o LEFT JOIN records r ON r.uuid = o.record_uuid LEFT JOIN todo t ON t.record_uuid = r.uuid""")
def _(spark, d):
    root = scratch(spark, "stream")
    ops, state = outbox(spark, d), records(spark, d)
    ops.repartitionByRange(4, "id").write.parquet(f"{root}/log")
    # two files at any size: a batch looks at all records once, so their number must not grow with the tables
    ops.where("id % 5 = 0").repartitionByRange(2, "id").write.mode("append").parquet(f"{root}/log")  # told twice
    C.follow_outbox(C.read_changes(spark, f"{root}/log", ops.schema, files_per_batch=2), state, root, BACKEND, f"{root}/backend").awaitTermination()
    after = C.drained_records(state, root).select(F.col("uuid").alias("record_uuid"), "remote_id", "sync_status", F.lit(False).alias("orphan"))
    now = C.drained_outbox(ops, root).join(after, "record_uuid", "left")
    return now.select("id", "record_uuid", "operation", "status", F.coalesce("orphan", F.lit(True)).alias("orphan"), "remote_id", "sync_status")
