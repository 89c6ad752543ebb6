"""The library's logical tables, derived from the given star-schema and corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.constants import NO_ADDRESS

_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device records from events and nation; five event types stand for classes."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    e = e.join(n, F.col("user_id") % 25 == F.col("n_nationkey"), "left").withColumnRenamed("event_id", "id")
    every = lambda k: F.col("id") % k == 0
    stamp = F.date_format("ts", _STAMP)
    score = F.col("value") / 100.0
    return e.select(
        "id",
        F.concat(F.lit("rec-"), "id").alias("uuid"),
        F.when(every(4), F.concat(F.lit("srv-"), "id")).alias("remote_id"),
        F.when(every(4), "synced").otherwise("pending").alias("sync_status"),
        F.concat(F.lit("soil_images/rec-"), "id", F.lit(".jpg")).alias("image_path"),
        F.when(~every(7), -10.0 - F.col("user_id") / 10.0).alias("latitude"),
        F.when(~every(7), -40.0 - F.col("user_id") / 10.0).alias("longitude"),
        F.when(every(5), NO_ADDRESS).when(every(11), "").when(every(13), None).when(every(17), F.concat(F.lit("Lote 100%_"), "user_id")).otherwise(F.concat("n_name", F.lit(", "), "user_id")).alias("address"),
        F.when(every(23), "n/a").otherwise(F.concat(stamp, F.lit("Z"))).alias("timestamp"),
        F.when(every(23), "n/a").when(every(29), F.concat(stamp, F.lit("-05:00"))).otherwise(F.concat(stamp, F.lit("Z"))).alias("updated_at"),
        every(19).alias("deleted"),
        F.when(~every(3), F.col("event_type")).alias("texture_class"),
        F.when(~every(3), F.least(score, F.lit(1.0))).alias("confidence_score"),
    )


RECORDS_SQL = f"""records AS (
SELECT id, 'rec-' || id AS uuid, CASE WHEN id % 4 = 0 THEN 'srv-' || id END AS remote_id,
  CASE WHEN id % 4 = 0 THEN 'synced' ELSE 'pending' END AS sync_status,
  'soil_images/rec-' || id || '.jpg' AS image_path,
  CASE WHEN id % 7 <> 0 THEN -10.0::DOUBLE - user_id / 10.0::DOUBLE END AS latitude,
  CASE WHEN id % 7 <> 0 THEN -40.0::DOUBLE - user_id / 10.0::DOUBLE END AS longitude,
  CASE WHEN id % 5 = 0 THEN '{NO_ADDRESS}' WHEN id % 11 = 0 THEN '' WHEN id % 13 = 0 THEN NULL
       WHEN id % 17 = 0 THEN 'Lote 100%_' || user_id ELSE n_name || ', ' || user_id END AS address,
  CASE WHEN id % 23 = 0 THEN 'n/a' ELSE stamp || 'Z' END AS "timestamp",
  CASE WHEN id % 23 = 0 THEN 'n/a' WHEN id % 29 = 0 THEN stamp || '-05:00' ELSE stamp || 'Z' END AS updated_at,
  CASE WHEN id % 23 = 0 THEN TIMESTAMP '1970-01-01' WHEN id % 29 = 0 THEN ms + INTERVAL 5 HOUR ELSE ms END AS instant,
  id % 19 = 0 AS deleted,
  CASE WHEN id % 3 <> 0 THEN event_type END AS texture_class,
  CASE WHEN id % 3 <> 0 THEN least(value / 100.0::DOUBLE, 1.0::DOUBLE) END AS confidence_score
FROM (SELECT e.event_id AS id, e.user_id, e.event_type, e.value, n.n_name, date_trunc('millisecond', e.ts) AS ms,
        strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%g') AS stamp
      FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 25))"""


def remote_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(local, remote): per user the latest even event, and the odd events as pulled rows.

    Instants are cut to the day, so ties occur.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    rows = e.select(
        F.concat(F.lit("u-"), "user_id").alias("uuid"),
        F.col("event_id").alias("seq"),
        F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
        (F.col("event_id") % 10 == 1).alias("deleted"),
        F.col("event_type").alias("texture_class"),
        (F.col("value") / 100.0).alias("confidence_score"),
    )
    even = rows.where("seq % 2 = 0")
    local = even.groupBy("uuid").agg(F.max_by(F.struct("seq", "updated_at", "deleted", "texture_class", "confidence_score"), "seq").alias("r")).select("uuid", F.col("r.seq").alias("id"), "r.updated_at", F.lit(False).alias("deleted"), "r.texture_class", "r.confidence_score")
    return local, rows.where("seq % 2 = 1")


REMOTE_SQL = """rows AS (
SELECT 'u-' || user_id AS uuid, event_id AS seq, date_trunc('day', ts) AS instant,
  strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS updated_at, event_id % 10 = 1 AS deleted,
  event_type AS texture_class, value / 100.0::DOUBLE AS confidence_score FROM events),
local AS (SELECT uuid, max(seq) AS id, max_by(instant, seq) AS instant, max_by(updated_at, seq) AS updated_at, false AS deleted,
  max_by(texture_class, seq) AS texture_class, max_by(confidence_score, seq) AS confidence_score
  FROM rows WHERE seq % 2 = 0 GROUP BY uuid),
remote AS (SELECT * FROM rows WHERE seq % 2 = 1)"""


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One operation a record; every 97th belongs to no record."""
    r = records(spark, sf_dir)
    return r.select(
        "id",
        F.when(F.col("id") % 97 == 0, F.concat(F.lit("orphan-"), "id")).otherwise(F.col("uuid")).alias("record_uuid"),
        F.when(F.col("deleted"), "delete").otherwise("upsert").alias("operation"),
        F.when(F.col("id") % 3 == 0, "pending").otherwise("synced").alias("status"),
        F.col("updated_at").alias("created_at"),
    )


OUTBOX_SQL = """outbox AS (
SELECT id, CASE WHEN id % 97 = 0 THEN 'orphan-' || id ELSE uuid END AS record_uuid,
  CASE WHEN deleted THEN 'delete' ELSE 'upsert' END AS operation,
  CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'synced' END AS status, updated_at AS created_at FROM records)"""


def tips_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached advisory for each conversation; every 11th payload is broken.

    record_uuid, payload (the struct it was made of) and payload_json.
    """
    c = table(spark, sf_dir, "conversations")
    said = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))
    g = c.groupBy("conv_id").agg(said("assistant").alias("a"), said("user").alias("u"))
    payload = F.struct(
        F.when(F.size("a") == 0, "abstained").otherwise("grounded").alias("status"),
        F.transform("a", lambda x: F.struct(x["text"].alias("text"), F.array(x["turn"].cast("int"), (x["turn"] + 1).cast("int")).alias("citations"))).alias("tips"),
        F.transform("u", lambda x: F.struct(x["text"].alias("title"), F.concat(F.lit("https://example.org/"), x["turn"]).alias("url"), F.when(x["turn"] % 4 == 0, "Editora").alias("publisher"), F.lit(None).cast("string").alias("date"))).alias("sources"),
        F.when(F.col("conv_id") % 10 == 0, " \n\t").when(F.col("conv_id") % 5 == 0, " ").otherwise("Consulte um técnico.").alias("disclaimer"),
        F.lit("m1").alias("model"),
        F.lit("2026-01-01T00:00:00.000Z").alias("retrievedAt"),
    )
    body = F.to_json("payload", {"ignoreNullFields": "false"})
    out = g.select("conv_id", F.concat(F.lit("rec-"), "conv_id").alias("record_uuid"), payload.alias("payload"))
    return out.select("conv_id", "record_uuid", "payload", F.when(F.col("conv_id") % 11 == 0, '{"status":"grounded","tips":3').otherwise(body).alias("payload_json"), F.lit("2026-01-01T00:00:00.000Z").alias("retrieved_at"))


TIPS_SQL = """turns AS (SELECT conv_id, turn, role, text FROM conversations),
tips_cache AS (
SELECT conv_id, 'rec-' || conv_id AS record_uuid, conv_id % 11 = 0 AS broken,
  CASE WHEN count(*) FILTER (WHERE role = 'assistant') = 0 THEN 'abstained' ELSE 'grounded' END AS status,
  CASE WHEN conv_id % 10 = 0 THEN ' ' || chr(10) || chr(9) WHEN conv_id % 5 = 0 THEN ' ' ELSE 'Consulte um técnico.' END AS disclaimer,
  CAST(count(*) FILTER (WHERE role = 'assistant') AS INT) AS n_tips, CAST(count(*) FILTER (WHERE role = 'user') AS INT) AS n_sources
FROM turns GROUP BY conv_id),
tip AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS tip_no FROM turns WHERE role = 'assistant'),
source AS (SELECT conv_id, text AS title, 'https://example.org/' || turn AS url, CASE WHEN turn % 4 = 0 THEN 'Editora' END AS publisher,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS source_no FROM turns WHERE role = 'user')"""


def _answer(event: Column, user: Column) -> Column:
    """A body of an answer; every sixth breaks its contract, in one of eight ways."""
    good = F.concat(F.lit('{"status":"grounded","tips":[{"text":"tip '), event, F.lit('","citations":[0]}],"sources":[{"title":"t","url":"https://example.org/'), user, F.lit('"}],"disclaimer":"d","model":"m1","retrievedAt":"2026-01-01T00:00:00Z"}'))
    swap = lambda a, b: F.replace(good, F.lit(a), F.lit(b))
    broken = [swap('"text":"tip', '"text":7,"x":"tip'), swap('"disclaimer":"d"', '"disclaimer":{"a":1}'), swap('"model":"m1"', '"model":true'), swap('"title":"t"', '"title":"t","publisher":5'),
              F.concat(good, F.lit("}] trailing")), F.replace(good, F.lit('"'), F.lit("'")), swap("[0]", "[0.5]"), swap("2026-01-01T", "soon")]
    return F.when(event % 6 != 0, good).otherwise(F.get(F.array(*broken), (F.floor(event / 6) % len(broken)).cast("int")))


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request attempts: a request is a user and a day, its attempts in order of event_id."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    e = e.withColumn("request", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    nth = F.row_number().over(Window.partitionBy("request").orderBy("event_id"))
    t = F.col("event_type")
    code = F.when(t == "view", 200).when(t == "click", 503).when(t == "error", 401).when(t == "signup", 429)
    return e.select("event_id", "request", nth.alias("attempt"), code.alias("status_code"), F.when(t == "purchase", "timeout").alias("transport"), F.when(code == 200, _answer(F.col("event_id"), F.col("user_id"))).alias("body"))


ATTEMPTS_SQL = """log AS (
SELECT event_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS request,
  CAST(row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS INT) AS attempt,
  CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 503 WHEN 'error' THEN 401 WHEN 'signup' THEN 429 END AS status_code,
  CASE WHEN event_type = 'purchase' THEN 'timeout' END AS transport, event_id % 6 <> 0 AS well_formed FROM events),
outcomes AS (
SELECT *, CASE WHEN transport IS NOT NULL THEN transport WHEN status_code = 200 AND well_formed THEN 'success'
  WHEN status_code = 200 THEN 'malformedResponse' WHEN status_code = 401 THEN 'unauthenticated' WHEN status_code = 429 THEN 'rateLimited'
  ELSE 'upstreamUnavailable' END AS outcome FROM log),
judged AS (SELECT *, outcome IN ('timeout', 'network') OR (outcome = 'upstreamUnavailable' AND coalesce(status_code, 500) >= 500) AS retryable FROM outcomes)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset photos from documents: three photos a sample, class = lang."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.select(
        F.col("doc_id").alias("photo"),
        F.floor(F.col("doc_id") / 3).cast("string").alias("sample_id"),
        F.col("lang").alias("texture_class"),
        F.concat(F.col("lang"), F.lit("/"), F.floor(F.col("doc_id") / 3), F.lit(" ("), F.col("doc_id") % 3, F.lit(").jpg")).alias("path"),
        F.when(F.col("doc_id") % 40 == 3, "field").when(F.col("doc_id") % 2 == 0, "bench").otherwise("in_situ").alias("setting"),
        F.col("source").alias("site"),
        F.concat(F.lit("dev-"), F.col("doc_id") % 4).alias("device"),
        "n_chars",
    )


MANIFEST_SQL = """manifest AS (
SELECT doc_id AS photo, CAST(doc_id // 3 AS VARCHAR) AS sample_id, lang AS texture_class,
  lang || '/' || (doc_id // 3) || ' (' || (doc_id % 3) || ').jpg' AS path,
  CASE WHEN doc_id % 40 = 3 THEN 'field' WHEN doc_id % 2 = 0 THEN 'bench' ELSE 'in_situ' END AS setting,
  source AS site, 'dev-' || (doc_id % 4) AS device, n_chars FROM documents)"""


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 pixel rows (image_id, y, x, r, g, b) from embeddings."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    at = lambda k: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(127.5 + 400 * F.get("embedding", (F.col("p") + k) % 64).cast("double"))))
    p = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    grey = F.col("vec_id") % 3 == 0
    return p.select(F.col("vec_id").alias("image_id"), F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), at(0).alias("r"), F.when(grey, at(0)).otherwise(at(21)).alias("g"), F.when(grey, at(0)).otherwise(at(42)).alias("b"))


PLANES_SQL = """pixel AS (SELECT vec_id, embedding, unnest(range(64)) AS p FROM embeddings),
planes AS (SELECT vec_id AS image_id, CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x,
  least(255.0::DOUBLE, greatest(0.0::DOUBLE, round(127.5::DOUBLE + 400 * embedding[p + 1]::DOUBLE))) AS r,
  least(255.0::DOUBLE, greatest(0.0::DOUBLE, round(127.5::DOUBLE + 400 * embedding[(p + CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 21 END) % 64 + 1]::DOUBLE))) AS g,
  least(255.0::DOUBLE, greatest(0.0::DOUBLE, round(127.5::DOUBLE + 400 * embedding[(p + CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 42 END) % 64 + 1]::DOUBLE))) AS b
FROM pixel)"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel rows (image_id, y, x, r, g, b) of photos 8 or 16 wide and 8 or 16 high from embeddings."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    v = F.col("vec_id")
    e = e.withColumns({"w": F.when(v % 2 == 0, 8).otherwise(16), "h": F.when(F.floor(v / 2) % 2 == 0, 8).otherwise(16)})
    e = e.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    at = lambda k: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(127.5 + 400 * F.get("embedding", (F.col("y") * 9 + F.col("x") * 5 + k) % 64).cast("double"))))
    return e.select(v.alias("image_id"), "y", "x", at(0).alias("r"), at(21).alias("g"), at(42).alias("b"))


PHOTOS_SQL = """sized AS (SELECT vec_id, embedding, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 16 END AS w, CASE WHEN vec_id // 2 % 2 = 0 THEN 8 ELSE 16 END AS h FROM embeddings),
spot AS (SELECT *, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM sized)),
photos AS (SELECT vec_id AS image_id, w, h, x, y,
  least(255.0::DOUBLE, greatest(0.0::DOUBLE, round(127.5::DOUBLE + 400 * embedding[(y * 9 + x * 5) % 64 + 1]::DOUBLE))) AS r,
  least(255.0::DOUBLE, greatest(0.0::DOUBLE, round(127.5::DOUBLE + 400 * embedding[(y * 9 + x * 5 + 21) % 64 + 1]::DOUBLE))) AS g,
  least(255.0::DOUBLE, greatest(0.0::DOUBLE, round(127.5::DOUBLE + 400 * embedding[(y * 9 + x * 5 + 42) % 64 + 1]::DOUBLE))) AS b FROM spot)"""


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, version, truth (0 to 4), probabilities: softmax of two times the sums of every fifth dimension."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    dims = lambda k: F.aggregate(F.sequence(F.lit(k), F.lit(63), F.lit(5)), F.lit(0.0), lambda a, i: a + F.get("embedding", i).cast("double"))
    x = e.withColumn("x", F.array(*(F.exp(2 * dims(k)) for k in range(5))))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return x.select(F.col("vec_id").alias("item"), (F.col("vec_id") % 2).cast("int").alias("version"), (F.col("label") % 5).alias("truth"), F.transform("x", lambda v: v / total).alias("probabilities"))


PROBABILITIES_SQL = """logit AS (SELECT vec_id, label, list_transform(range(5), lambda k: exp(2 * list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(k, 64, 5), lambda i: embedding[i + 1]::DOUBLE)), lambda a, v: a + v))) AS x FROM embeddings),
probs AS (SELECT vec_id AS item, CAST(vec_id % 2 AS INT) AS version, label % 5 AS truth,
  list_transform(x, lambda v: v / (x[1] + x[2] + x[3] + x[4] + x[5])) AS p FROM logit),
cell AS (SELECT item, version, truth, unnest(p) AS p, unnest(range(5)) AS k FROM probs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, k) AS place FROM cell),
top AS (SELECT item, any_value(version) AS version, any_value(truth) AS truth, CAST(max(k) FILTER (WHERE place = 1) AS INT) AS predicted,
  max(p) FILTER (WHERE place = 1) AS top1, max(p) FILTER (WHERE place = 2) AS top2 FROM ranked GROUP BY item)"""
