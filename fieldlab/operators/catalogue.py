"""The record catalogue: scans, filters, top-k and summary statistics.

Every read but :func:`record_by_uuid` passes over tombstones; "most recent"
means the highest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.constants import HISTORY_CAP
from fieldlab.functions import records as R


def live(records: DataFrame) -> DataFrame:
    return records.where(~F.col("deleted"))


def newest_first(records: DataFrame) -> DataFrame:
    return live(records).orderBy(F.desc("id"))


def record_by_id(records: DataFrame, record_id: int) -> DataFrame:
    return live(records).where(F.col("id") == record_id)


def record_by_uuid(records: DataFrame, uuid: str) -> DataFrame:
    """Tombstones included: what sync reads."""
    return records.where(F.col("uuid") == uuid)


def filtered(records: DataFrame, texture_class: str | None = None, search: str | None = None) -> DataFrame:
    """Live rows that meet the given filters; a null or blank one is not applied."""
    out = live(records)
    if texture_class:
        out = out.where(F.col("texture_class") == texture_class)
    if search and search.strip():
        out = out.where(R.address_contains(search))
    return out


def history(records: DataFrame, cap: int = HISTORY_CAP, **filters) -> DataFrame:
    return filtered(records, **filters).orderBy(F.desc("id")).limit(cap)


def latest(records: DataFrame, classified: bool = False) -> DataFrame:
    out = live(records)
    return (out.where(R.has_classification()) if classified else out).orderBy(F.desc("id")).limit(1)


def pending(outbox: DataFrame) -> DataFrame:
    return outbox.where(F.col("status") == "pending").orderBy("id")


def home_stats(records: DataFrame) -> DataFrame:
    """Live rows, distinct valid addresses, mean confidence (null if there is none) and its whole percent."""
    return live(records).agg(
        F.count("*").alias("total"),
        F.countDistinct(F.when(R.has_valid_address(), F.col("address"))).alias("addresses"),
        F.avg("confidence_score").alias("mean_confidence"),
    ).withColumn("mean_percent", F.coalesce(F.concat(R.fixed(F.col("mean_confidence") * 100, 0), F.lit("%")), F.lit("-")))


def available_classes(records: DataFrame) -> DataFrame:
    return live(records).where(R.has_classification()).select("texture_class").distinct().orderBy("texture_class")
