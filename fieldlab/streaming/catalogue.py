"""Streams over the catalogue's change log: what a reader needs, and the outbox drain.

The catalogue itself and its statistics are in :mod:`fieldlab.streaming.keyed`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldlab.operators import catalogue as C
from fieldlab.operators import sync as S
from fieldlab.shipping import ship
from fieldlab.sources import push as P
from fieldlab.streaming.keyed import rocksdb


def read_changes(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The change log as it grows: Parquet files under ``path``."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def live_view(state: DataFrame, **filters) -> DataFrame:
    return C.filtered(state, **filters).orderBy(F.desc("id"))


def push_outbox(operations: DataFrame, records: DataFrame, root: str, backend: str, argument: str | None = None, run: str | None = None) -> None:
    """Pushes pending operations to a backend (see :mod:`fieldlab.sources.push`), each with its record as it is now.

    What was pushed is logged under ``root``.  Raises if an operation fails;
    what was not pushed stays pending, and a second call pushes only that.
    drained_outbox and drained_records are the tables after it.  With ``run``
    (a name) only what a write of that name pushed before is passed over.
    """
    spark = operations.sparkSession
    ship(spark)
    spark.dataSource.register(P.PushSink)
    rows = S.with_current_state(operations.where(F.col("status") == "pending"), records).drop("status")
    done = pushed_log(spark, root, run)
    if done is not None:
        rows = rows.join(done.select("id"), "id", "left_anti")
    first = ("id", "record_uuid", "operation", "orphan")
    rows = rows.select(*first, *(c for c in rows.columns if c not in first))
    # the operations of a record in one task, in their order; a number of parts that does not change when it is done again
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "record_uuid").sortWithinPartitions("record_uuid", "id")
    options = {"root": root, "backend": backend, "argument": argument, "run": run}
    rows.write.format(P.NAME).options(**{k: v for k, v in options.items() if v is not None}).mode("append").save()


def follow_outbox(operations: DataFrame, records: DataFrame, root: str, backend: str, argument: str | None = None) -> StreamingQuery:
    """Pushes pending operations as they arrive, each id once.

    The ids that were seen are keyed state, so a batch costs its operations and
    a look at their records.  A batch that fails stops the query; started again,
    it goes on behind what that batch has pushed.
    """
    fresh = operations.where(F.col("status") == "pending").dropDuplicates(["id"])
    with rocksdb(operations.sparkSession):
        return (
            fresh.writeStream.foreachBatch(lambda rows, batch: push_outbox(rows, records, root, backend, argument, f"batch-{batch}"))
            .option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        )


def pushed_log(spark: SparkSession, root: str, run: str | None = None) -> DataFrame | None:
    """What has been pushed (in the writes of one name), a row an operation; None before the first."""
    try:
        return spark.read.parquet(f"{root}/pushed" + (f"/run={run}" if run else "")).drop("run").dropDuplicates(["id"])
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None


def drained_outbox(operations: DataFrame, root: str) -> DataFrame:
    """``operations`` with status synced for all that were pushed."""
    done = pushed_log(operations.sparkSession, root)
    if done is None:
        return operations
    hit = operations.join(done.select("id", F.lit(True).alias("__done")), "id", "left")
    return hit.withColumn("status", F.when(F.col("__done"), "synced").otherwise(F.col("status"))).select(*operations.columns)


def drained_records(records: DataFrame, root: str) -> DataFrame:
    """``records`` after the pushes: synced, and with the remote id of the last upsert."""
    done = pushed_log(records.sparkSession, root)
    if done is None:
        return records
    of = done.where(~F.col("orphan")).groupBy(F.col("record_uuid").alias("uuid")).agg(F.max_by("remote_id", F.when(F.col("remote_id").isNotNull(), F.col("id"))).alias("__given"), F.lit(True).alias("__done"))
    after = records.join(of, "uuid", "left")
    return after.withColumns({"remote_id": F.coalesce("__given", "remote_id"), "sync_status": F.when(F.col("__done"), "synced").otherwise(F.col("sync_status"))}).select(*records.columns)
