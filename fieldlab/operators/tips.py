"""The advisory cache: look-ups, work list, changes and attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.constants import MAX_ATTEMPTS
from fieldlab.functions import tips as T
from fieldlab.functions.records import has_classification, instant_or_epoch
from fieldlab.operators.catalogue import live


def for_records(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Live records with their cached payload, if there is one that reads."""
    kept = cache.select(F.col("record_uuid").alias("uuid"), T.parse_payload(F.col("payload_json")).alias("tips"), F.lit(True).alias("cached"))
    return live(records).join(kept, "uuid", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def work_list(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Live records that can be researched and have no cache entry."""
    able = live(records).where((F.col("uuid") != "") & has_classification())
    return able.join(cache.select(F.col("record_uuid").alias("uuid")), "uuid", "left_anti")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows replace those of their record_uuid; of several new ones the latest retrieved stays (of equals the one of greatest payload)."""
    rest = [c for c in new.columns if c not in ("record_uuid", "retrieved_at")]
    latest = F.struct(instant_or_epoch(F.col("retrieved_at")), "retrieved_at", *rest)
    one = new.groupBy("record_uuid").agg(F.max_by(F.struct(*new.columns), latest).alias("r")).select("r.*")
    return cache.join(one.select("record_uuid"), "record_uuid", "left_anti").unionByName(one)


def delete(cache: DataFrame, gone: DataFrame) -> DataFrame:
    return cache.join(gone.select("record_uuid"), "record_uuid", "left_anti")


def citations(cache: DataFrame) -> DataFrame:
    """A row for each tip and source it cites; a tip that cites none keeps a row."""
    payload = T.parse_payload(F.col("payload_json"))
    tips = cache.select("record_uuid", payload.alias("p")).where("p IS NOT NULL").select("record_uuid", "p.sources", F.posexplode(T.valid_citations(F.col("p"))).alias("tip_no", "tip"))
    cited = tips.select("record_uuid", "sources", "tip_no", F.explode_outer("tip.citations").alias("c"))
    return cited.select("record_uuid", "tip_no", (F.col("c") + 1).alias("label"), F.get("sources", F.col("c"))["title"].alias("title"))


def attempt_outcomes(log: DataFrame) -> DataFrame:
    """``log`` (status_code, transport, body of the answer) with the kind of each attempt and whether it is retried."""
    kind = T.outcome(F.col("status_code"), F.col("transport"), F.col("body"))
    return log.withColumn("outcome", kind).withColumn("retryable", T.retryable(F.col("outcome"), F.col("status_code")))


def final_results(log: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """A row a request: its first attempt that ends it (a success or a failure
    that is not retried), else its last within ``most``."""
    tried = attempt_outcomes(log).where(F.col("attempt") <= most)
    ends = ~F.col("retryable")
    pick = F.struct((~ends).cast("int").alias("open"), F.when(ends, F.col("attempt")).otherwise(-F.col("attempt")).alias("order"))
    return tried.groupBy("request").agg(F.min_by(F.struct("attempt", "outcome"), pick).alias("r")).select("request", "r.attempt", "r.outcome")
