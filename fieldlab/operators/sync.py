"""Outbox, last-write-wins merge and state changes, each from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlab.functions.records import instant, instant_or_epoch


def with_current_state(pending: DataFrame, records: DataFrame) -> DataFrame:
    """Each pending operation with the record it speaks of as it is now, tombstones included; an orphan has none."""
    now = records.select(F.col("uuid").alias("record_uuid"), F.lit(True).alias("found"), "remote_id", "deleted", "texture_class", F.col("updated_at").alias("record_updated_at"))
    return pending.join(now, "record_uuid", "left").withColumn("orphan", F.col("found").isNull()).drop("found")


def compare_remote(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Each pulled row with its local counterpart: insert, remoteWins or localWins."""
    mine = local.select("uuid", instant_or_epoch(F.col("updated_at")).alias("l_at"), F.col("deleted").alias("l_deleted"))
    joined = remote.join(mine, "uuid", "left").withColumn("r_at", instant_or_epoch(F.col("updated_at")))
    wins = (F.col("r_at") > F.col("l_at")) | ((F.col("r_at") == F.col("l_at")) & F.col("deleted") & ~F.col("l_deleted"))
    return joined.withColumn("action", F.when(F.col("l_at").isNull(), "insert").when(wins, "remoteWins").otherwise("localWins"))


def _ranked(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local rows (seq 0) and pulled rows (their order of arrival) with what decides between them."""
    own = local.withColumn("seq", F.lit(0).cast("long")).withColumn("remote", F.lit(False))
    pulled = remote.withColumn("remote", F.lit(True)).withColumn("id", F.lit(None).cast("long"))
    if "timestamp" in pulled.columns:
        pulled = pulled.withColumn("updated_at", F.coalesce("updated_at", "timestamp"))
    both = own.unionByName(pulled, allowMissingColumns=True)
    return both.withColumn("wins", F.struct(instant_or_epoch(F.col("updated_at")).alias("at"), F.col("deleted").alias("gone"), (-F.col("seq")).alias("early")))


def lww_merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The catalogue after folding ``remote`` (with an arrival order ``seq``) into ``local``.

    The later instant wins, a tombstone wins a tie, and of full ties the first
    row stays: the maximum over a struct, one shuffle by uuid.  The local id
    stays; a remote winner is synced.
    """
    rows = _ranked(local, remote)
    keep = [c for c in rows.columns if c not in ("uuid", "id", "wins", "seq")]
    best = rows.groupBy("uuid").agg(F.max("id").alias("id"), F.max_by(F.struct(*keep), "wins").alias("w"))
    out = best.select("uuid", "id", *(F.col(f"w.{c}").alias(c) for c in keep))
    if "sync_status" in out.columns:
        out = out.withColumn("sync_status", F.when(F.col("remote"), "synced").otherwise(F.col("sync_status")))
    return out


def lww_merge_into(local: DataFrame, remote: DataFrame, buckets: int) -> DataFrame:
    """lww_merge where ``local`` is a table in ``buckets`` by uuid (one row each, see tables.write_bucketed).

    Only the pulled rows are shuffled: they are folded to one a uuid in as many
    parts as there are buckets, and meet the table where it lies.
    """
    ranked = _ranked(local.limit(0), remote).where("remote").repartition(buckets, "uuid")
    keep = [c for c in ranked.columns if c not in ("uuid", "id", "wins", "seq", "remote")]
    best = ranked.groupBy("uuid").agg(F.max_by(F.struct(*keep), "wins").alias("pulled"), F.max("wins").alias("pulled_wins"))
    own = _ranked(local, remote.limit(0)).where("NOT remote").select("uuid", "id", F.struct(*keep).alias("own"), F.col("wins").alias("own_wins"))
    both = own.join(best, "uuid", "full")
    remote_wins = F.col("own_wins").isNull() | F.coalesce(F.col("pulled_wins") > F.col("own_wins"), F.lit(False))
    both = both.withColumn("remote", remote_wins).withColumn("w", F.when(F.col("remote"), F.col("pulled")).otherwise(F.col("own")))
    out = both.select("uuid", "id", *(F.col(f"w.{c}").alias(c) for c in keep), "remote")
    return out.withColumn("sync_status", F.when(F.col("remote"), "synced").otherwise(F.col("sync_status"))) if "sync_status" in out.columns else out


def lww_applied(local: DataFrame, remote: DataFrame) -> DataFrame:
    """How many pulled rows changed a record while they were folded in, one after the other."""
    state = F.struct(F.col("wins.at"), F.col("wins.gone"))
    rows = _ranked(local, remote).withColumn("state", state)
    before = Window.partitionBy("uuid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("best", F.max("state").over(before))
    return rows.where(F.col("remote")).agg(F.count("*").alias("received"), F.count(F.when(F.col("best").isNull() | (F.col("state") > F.col("best")), 1)).alias("pulled"))


def drain_outbox(outbox: DataFrame, records: DataFrame, remote_id: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, outbox, pushed) after every pending operation was pushed.

    An upsert takes the remote id that the backend gave it, whatever it had; a
    delete, or a backend that gave none, leaves it.  Orphans push nothing but
    are synced as well.  ``pushed`` is the number of operations.
    """
    todo = outbox.where(F.col("status") == "pending")
    by_record = todo.groupBy(F.col("record_uuid").alias("uuid")).agg(F.max(F.col("operation") == "upsert").alias("upserted"))
    given = F.concat(F.lit("remote-"), "uuid") if remote_id is None else remote_id
    after = records.join(by_record, "uuid", "left")
    after = after.withColumn("remote_id", F.when(F.col("upserted"), F.coalesce(given, "remote_id")).otherwise(F.col("remote_id")))
    after = after.withColumn("sync_status", F.when(F.col("upserted").isNotNull(), "synced").otherwise(F.col("sync_status"))).select(*records.columns)
    return after, outbox.withColumn("status", F.lit("synced")), todo.agg(F.count("*").alias("pushed"))


def create_records(new: DataFrame, now: str, uuid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, outbox): new rows pending with one upsert each, all at the same instant."""
    made = new.withColumn("uuid", F.expr("uuid()") if uuid is None else uuid)
    made = made.withColumns({"remote_id": F.lit(None).cast("string"), "sync_status": F.lit("pending"), "updated_at": F.lit(now), "deleted": F.lit(False)})
    return made, made.select(F.col("uuid").alias("record_uuid"), F.lit("upsert").alias("operation"), F.lit("pending").alias("status"), F.lit(now).alias("created_at"))


def tombstone_records(records: DataFrame, ids: DataFrame | None, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, outbox, image paths to remove) after deleting ``ids`` (all if None); only live rows change."""
    hit = F.lit(True) if ids is None else F.col("__hit").isNotNull()
    rows = records if ids is None else records.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    rows = rows.withColumn("__gone", hit & ~F.col("deleted"))
    after = rows.withColumn("sync_status", F.when(F.col("__gone"), "pending").otherwise(F.col("sync_status")))
    after = after.withColumn("updated_at", F.when(F.col("__gone"), now).otherwise(F.col("updated_at"))).withColumn("deleted", F.col("deleted") | F.col("__gone"))
    gone = rows.where("__gone")
    ops = gone.select(F.col("uuid").alias("record_uuid"), F.lit("delete").alias("operation"), F.lit("pending").alias("status"), F.lit(now).alias("created_at"))
    return after.select(*records.columns), ops, gone.select("image_path")


def evolve_v1(old: DataFrame) -> DataFrame:
    """First schema: rows gain an empty class and confidence."""
    return old.withColumns({"texture_class": F.lit(None).cast("string"), "confidence_score": F.lit(None).cast("double")})


def backfill_v3(old: DataFrame, uuid: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, outbox, uuids given twice): sync columns for legacy rows.

    ``updated_at`` is the timestamp in UTC, or its text where it is unreadable.
    """
    at = F.date_format(instant(F.col("timestamp")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    new = old.withColumns({"uuid": uuid, "remote_id": F.lit(None).cast("string"), "sync_status": F.lit("pending"), "updated_at": F.coalesce(at, "timestamp"), "deleted": F.lit(False)})
    ops = new.select(F.col("uuid").alias("record_uuid"), F.lit("upsert").alias("operation"), F.lit("pending").alias("status"), F.col("updated_at").alias("created_at"))
    return new, ops, new.groupBy("uuid").count().where("count > 1")
