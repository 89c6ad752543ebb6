"""Schemas of the device tables."""

from pyspark.sql import types as T

RECORDS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("uuid", T.StringType(), False),
    T.StructField("remote_id", T.StringType()),
    T.StructField("sync_status", T.StringType(), False),
    T.StructField("image_path", T.StringType(), False),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("address", T.StringType()),
    T.StructField("timestamp", T.StringType(), False),
    T.StructField("updated_at", T.StringType(), False),
    T.StructField("deleted", T.BooleanType(), False),
    T.StructField("texture_class", T.StringType()),
    T.StructField("confidence_score", T.DoubleType()),
])
OUTBOX = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("record_uuid", T.StringType(), False),
    T.StructField("operation", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("created_at", T.StringType(), False),
])
TIPS = T.StructType([
    T.StructField("record_uuid", T.StringType(), False),
    T.StructField("payload_json", T.StringType(), False),
    T.StructField("retrieved_at", T.StringType(), False),
])
#: The payload of a cached advisory; citations are 0-based indices into sources.
TIPS_PAYLOAD = (
    "status string, tips array<struct<text: string, citations: array<int>>>, "
    "sources array<struct<title: string, url: string, publisher: string, date: string>>, "
    "disclaimer string, model string, retrievedAt string"
)
