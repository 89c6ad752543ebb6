"""Device tables as they are stored: Parquet with the fixed schemas of :mod:`fieldlab.schemas`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab.schemas import OUTBOX, RECORDS, TIPS


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """No schema is inferred: columns that a file lacks are null, and those it has besides are not read."""
    return spark.read.schema(schema).parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, RECORDS)


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, OUTBOX)


def read_tips(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TIPS)


def write_table(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Writes the schema's columns in its order and types; a null in a required one stops the job."""
    checked = (F.col(f.name) if f.nullable else F.coalesce(F.col(f.name), F.raise_error(F.lit(f"{f.name} is null"))) for f in schema.fields)
    df.select(*(c.cast(f.dataType).alias(f.name) for c, f in zip(checked, schema.fields))).write.mode("overwrite").parquet(path)


def write_bucketed(records: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Writes the catalogue as table ``name`` under ``path``, in ``buckets`` by uuid and sorted by it.

    Joins on uuid then read it without a shuffle.  A uuid that stands twice
    raises ValueError before anything is written: this check stands in for a
    unique index.
    """
    twice = records.groupBy("uuid").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"uuids in more than one row, {', '.join(str(r['uuid']) for r in twice)} among them")
    records.repartition(buckets, "uuid").write.bucketBy(buckets, "uuid").sortBy("uuid").option("path", path).mode("overwrite").saveAsTable(name)
    return records.sparkSession.table(name)
