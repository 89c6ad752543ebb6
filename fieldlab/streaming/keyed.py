"""Keyed state of the live catalogue and of its statistics.

The catalogue keeps one record a uuid in the state store (RocksDB), the winner
of last-write-wins so far; a batch costs the uuids that it changes.  Only
changed records leave the operator, with what they replaced, as an append-only
table; from it come the catalogue at any time and, as signed differences, its
statistics.  Those keep one reference count an address, so distinct addresses
stay exact when records move, vanish or come back.

Both queries write with the file sink, which names the files of each batch once:
after a failure a batch is done again and no reader sees it twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fieldlab.functions import records as R

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys over which records without a valid address are dealt; they need no count.
DEALT = 256
_BEFORE = "was_"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB; the session's setting is put back."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)


class Winner(StatefulProcessor):
    """The record of one uuid; tells it, and the one before, when a batch has changed it."""

    def __init__(self, payload: list[T.StructField]):
        self.payload = [f.name for f in payload]
        order = [T.StructField("at", T.LongType()), T.StructField("deleted", T.BooleanType()), T.StructField("seq", T.LongType()), T.StructField("id", T.LongType()), T.StructField("version", T.LongType())]
        self.schema = T.StructType([*order, *payload])
        self.told = Row("uuid", "id", "version", "deleted", *self.payload, f"{_BEFORE}deleted", *(f"{_BEFORE}{name}" for name in self.payload))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("winner", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else None
        best, first = None, None
        for r in rows:
            first = r.seq if first is None else min(first, r.seq)
            if best is None or (r.at, r.deleted, -r.seq) > (best.at, best.deleted, -best.seq):
                best = r
        if old is not None and (old[0], old[1], -old[2]) >= (best.at, best.deleted, -best.seq):
            return
        n = len(self.payload)
        record = [best[name] for name in self.payload]
        number, version = (first, 1) if old is None else (old[3], old[4] + 1)
        self.state.update((best.at, best.deleted, best.seq, number, version, *record))
        yield self.told(key[0], number, version, best.deleted, *record, *((None, *[None] * n) if old is None else (old[1], *old[5:])))

    def close(self) -> None:
        pass


def _comparable(rows: DataFrame) -> DataFrame:
    at = F.unix_micros(R.instant_or_epoch(F.col("updated_at")))
    return rows.withColumns({"at": at, "deleted": F.coalesce("deleted", F.lit(False))})


def follow_catalogue(changes: DataFrame, root: str) -> StreamingQuery:
    """Folds pulled rows (uuid, seq, updated_at, deleted, other columns) into the keyed catalogue.

    The later instant wins, a tombstone wins a tie, and of full ties the first
    ``seq`` stays.  A new uuid takes the smallest seq of the batch that brought
    it as its id; ``initial`` (with id) is what was there before the log, and
    wins full ties.  Each changed record is a row of ``{root}/changes``: uuid,
    id, version, the columns, and ``was_`` columns of the record before.
    """
    spark = changes.sparkSession
    payload = [f for f in changes.schema.fields if f.name not in ("uuid", "seq", "deleted")]
    own = [T.StructField(f.name, f.dataType) for f in payload]
    out = T.StructType([
        T.StructField("uuid", T.StringType()), T.StructField("id", T.LongType()), T.StructField("version", T.LongType()), T.StructField("deleted", T.BooleanType()), *own,
        T.StructField(f"{_BEFORE}deleted", T.BooleanType()), *(T.StructField(f"{_BEFORE}{f.name}", f.dataType) for f in payload),
    ])
    with rocksdb(spark):
        told = _comparable(changes).groupBy("uuid").transformWithState(Winner(own), out, "Append", "None")
        return told.writeStream.format("parquet").option("path", f"{root}/changes").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()


def changed_records(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{root}/changes")


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue now, tombstones included: the last version of each uuid."""
    rows = changed_records(spark, root)
    names = [c for c in rows.columns if not c.startswith(_BEFORE) and c not in ("uuid", "version")]
    return rows.groupBy("uuid").agg(F.max_by(F.struct(*names), "version").alias("r")).select("uuid", *(F.col(f"r.{c}").alias(c) for c in names))


# --- statistics ----------------------------------------------------------------

_DELTA = "address string, counts boolean, d_refs bigint, d_total bigint, d_scored bigint, d_confidence decimal(38,18)"
_TOLD = "d_total bigint, d_addresses bigint, d_scored bigint, d_confidence decimal(38,18)"


class AddressCount(StatefulProcessor):
    """Live records of one address; tells by how many distinct addresses a batch has changed the whole."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("refs", "refs bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        refs = total = scored = 0
        confidence = Decimal(0)
        for r in rows:
            refs, total, scored, confidence = refs + r.d_refs, total + r.d_total, scored + r.d_scored, confidence + r.d_confidence
        changed = 0
        if key[1] and refs:
            old = self.state.get()[0] if self.state.exists() else 0
            changed = int(old + refs > 0) - int(old > 0)
            if old + refs:
                self.state.update((old + refs,))
            else:
                self.state.clear()
        if total or changed or scored or confidence:
            yield Row(d_total=total, d_addresses=changed, d_scored=scored, d_confidence=confidence)

    def close(self) -> None:
        pass


def _difference(live: Column, address: Column, confidence: Column, uuid: Column, sign: int) -> Column:
    """What one image of a record adds to the statistics (or takes away)."""
    valid = F.coalesce((address != "") & (address != R.NO_ADDRESS), F.lit(False))
    here = F.coalesce(live, F.lit(False))
    number = F.lit(sign).cast("long")
    scored = here & confidence.isNotNull()
    key = F.when(valid, address).otherwise(F.pmod(F.xxhash64(uuid), F.lit(DEALT)).cast("string"))
    return F.when(here, F.struct(
        key.alias("address"), valid.alias("counts"), F.when(valid, number).otherwise(F.lit(0).cast("long")).alias("d_refs"), number.alias("d_total"),
        F.when(scored, number).otherwise(F.lit(0).cast("long")).alias("d_scored"),
        F.when(scored, confidence.cast("decimal(38,18)") * sign).otherwise(F.lit(0)).cast("decimal(38,18)").alias("d_confidence"),
    ))


def _sums(batches):
    """Differences of each address summed up before they move, so that a hot address costs a row a batch of rows."""
    for b in batches:
        sums = pa.Table.from_batches([b]).group_by(["address", "counts"]).aggregate([(c, "sum") for c in b.schema.names[2:]])
        columns = [sums.column(c).combine_chunks() for c in ("address", "counts")]
        columns += [sums.column(f"{f.name}_sum").cast(f.type).combine_chunks() for f in list(b.schema)[2:]]
        yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)


def follow_stats(spark: SparkSession, root: str) -> StreamingQuery:
    """Follows ``{root}/changes`` and keeps the differences of the catalogue's statistics in ``{root}/stats``."""
    schema = changed_records(spark, root).schema
    log = spark.readStream.schema(schema).parquet(f"{root}/changes")
    now = _difference(~F.col("deleted"), F.col("address"), F.col("confidence_score"), F.col("uuid"), 1)
    was = _difference(~F.col(f"{_BEFORE}deleted"), F.col(f"{_BEFORE}address"), F.col(f"{_BEFORE}confidence_score"), F.col("uuid"), -1)
    each = log.select(F.explode(F.array_compact(F.array(now, was))).alias("d")).select("d.*").mapInArrow(_sums, _DELTA)
    with rocksdb(spark):
        told = each.groupBy("address", "counts").transformWithState(AddressCount(), _TOLD, "Append", "None")
        return told.writeStream.format("parquet").option("path", f"{root}/stats").option("checkpointLocation", f"{root}/stats-checkpoint").outputMode("append").trigger(availableNow=True).start()


def stats(spark: SparkSession, root: str) -> DataFrame:
    """total, addresses, mean_confidence of the catalogue as far as follow_stats has come: a sum of differences."""
    d = spark.read.schema(_TOLD).parquet(f"{root}/stats")
    sums = d.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("d_total", "d_addresses", "d_scored", "d_confidence")))
    mean = F.when(F.col("d_scored") > 0, F.col("d_confidence").cast("double") / F.col("d_scored"))
    return sums.select(F.col("d_total").alias("total"), F.col("d_addresses").alias("addresses"), mean.alias("mean_confidence"))
