"""Queries over the record catalogue, the outbox and the merge."""

from pyspark.sql import functions as F

from fieldlab.constants import ADDRESS_LABEL, CLASS_LABEL, COORDINATES_LABEL, HISTORY_CAP, NO_ADDRESS, SHARE_TITLE
from fieldlab.functions import records as R
from fieldlab.operators import catalogue as C
from fieldlab.operators import sync as S
from fieldlab.plans.paths import scratch
from fieldlab.sources.standins import OUTBOX_SQL, RECORDS_SQL, REMOTE_SQL, outbox, records, remote_batches, table
from fieldlab.sources.tables import write_bucketed

_ROW = ["id", "uuid", "sync_status", "address", "updated_at", "texture_class"]
_ROW_SQL = ", ".join(_ROW)
_W = f"WITH {RECORDS_SQL} "
_VALID = f"address IS NOT NULL AND address <> '' AND address <> '{NO_ADDRESS}'"
_STAMP = "CASE WHEN timestamp = 'n/a' THEN 'n/a' ELSE strftime(CAST(replace(timestamp, 'Z', '') AS TIMESTAMP), '{}') END"
_LONG, _SHORT = _STAMP.format("%d/%m/%Y às %H:%M"), _STAMP.format("%d/%m/%Y %H:%M")


def _fixed(x, digits):
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(24,10)), {digits}) AS DECIMAL(24,{digits})) AS VARCHAR)"


_BAND = "CASE WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.6 THEN 'moderate' ELSE 'low' END"
_LABEL = "CASE WHEN confidence_score >= 0.8 THEN 'Alta' WHEN confidence_score >= 0.6 THEN 'Moderada' ELSE 'Baixa' END"
_PLACE = f"CASE WHEN latitude IS NOT NULL THEN {_fixed('latitude', 6)} || ', ' || {_fixed('longitude', 6)} ELSE '{COORDINATES_LABEL}' END"
_PERCENT = f"coalesce({_fixed('confidence_score * 100', 1)} || '%', '-')"

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("scan_live_records", _W + f"SELECT {_ROW_SQL} FROM records WHERE NOT deleted ORDER BY id DESC")
def _(spark, d):
    return C.newest_first(records(spark, d)).select(*_ROW)


@query("record_by_id", _W + f"SELECT {_ROW_SQL} FROM records WHERE NOT deleted AND id = 42")
def _(spark, d):
    return C.record_by_id(records(spark, d), 42).select(*_ROW)


@query("record_by_uuid_any", _W + f"SELECT {_ROW_SQL}, deleted FROM records WHERE uuid = 'rec-38'")
def _(spark, d):
    return C.record_by_uuid(records(spark, d), "rec-38").select(*_ROW, "deleted")


@query("filter_records", _W + f"SELECT {_ROW_SQL} FROM records WHERE NOT deleted AND texture_class = 'click' AND contains(lower(address), 'lote 100%_')")
def _(spark, d):
    return C.filtered(records(spark, d), "click", "  LOTE 100%_ ").orderBy(F.desc("id")).select(*_ROW)


@query("search_address_literal", _W + "SELECT id, address FROM records WHERE NOT deleted AND contains(lower(address), '%_1')")
def _(spark, d):
    return C.filtered(records(spark, d), search="%_1").select("id", "address")


@query("record_flags", _W + f"SELECT id, latitude IS NOT NULL AND longitude IS NOT NULL AS has_coordinates, {_VALID} AS has_valid_address, coalesce(texture_class <> '', false) AS has_classification FROM records")
def _(spark, d):
    return records(spark, d).select("id", R.has_coordinates().alias("has_coordinates"), R.has_valid_address().alias("has_valid_address"), R.has_classification().alias("has_classification"))


@query("record_display", _W + f"""SELECT id, CASE WHEN {_VALID} THEN address ELSE '{ADDRESS_LABEL}' END AS address, coalesce(texture_class, '{CLASS_LABEL}') AS class,
  {_PLACE} AS coordinates, {_PERCENT} AS confidence, {_LONG} AS stamp, {_SHORT} AS stamp_compact,
  {_fixed('confidence_score * 100', 0)} || '% · ' || {_LABEL} AS chip FROM records""")
def _(spark, d):
    return records(spark, d).select("id", R.display_address().alias("address"), R.display_class().alias("class"), R.display_coordinates().alias("coordinates"), R.display_confidence().alias("confidence"), R.display_stamp(F.col("timestamp")).alias("stamp"), R.display_stamp(F.col("timestamp"), " ").alias("stamp_compact"), R.confidence_chip().alias("chip"))


@query("confidence_band", _W + f"SELECT id, {_BAND} AS band, {_LABEL} AS label FROM records")
def _(spark, d):
    band = R.confidence_band(F.col("confidence_score"))
    return records(spark, d).select("id", band.alias("band"), R.band_label(band).alias("label"))


@query("share_projection", _W + f"""SELECT id, concat_ws(chr(10), '{SHARE_TITLE}', 'Classe: ' || texture_class || ' (' || {_PERCENT} || ')', 'Data: ' || {_LONG}) AS caption,
  concat_ws(chr(10), '{SHARE_TITLE}', 'Classe: ' || texture_class || ' (' || {_PERCENT} || ')', CASE WHEN {_VALID} THEN 'Local: ' || address END,
    CASE WHEN latitude IS NOT NULL THEN 'Coordenadas: ' || {_PLACE} END, 'Data: ' || {_LONG}) AS caption_with_place FROM records WHERE NOT deleted""")
def _(spark, d):
    return C.live(records(spark, d)).select("id", R.share_caption().alias("caption"), R.share_caption(True).alias("caption_with_place"))


@query("compose_address", f"""SELECT s_suppkey, coalesce(nullif(concat_ws(', ', CASE WHEN s_suppkey % 3 > 0 THEN s_name END, CASE WHEN s_suppkey % 4 > 0 THEN n_name END,
  CASE WHEN s_suppkey % 5 = 1 THEN 'Área' END), ''), '{NO_ADDRESS}') AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    street, town = F.when(k % 3 > 0, F.col("s_name")).otherwise(""), F.when(k % 4 > 0, F.col("n_name"))
    return s.select("s_suppkey", R.compose_address(street, town, F.when(k % 5 == 1, "Área")).alias("address"))


@query("stored_image_path", _W + """SELECT id, CASE WHEN id % 31 = 0 THEN NULL ELSE 'soil_images/' || uuid || CASE id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' ELSE '.webp' END END AS path, id % 31 = 0 AS rejected FROM records""")
def _(spark, d):
    k = F.col("id")
    uuid = F.when(k % 31 == 0, F.concat(F.lit("../"), "uuid")).otherwise(F.col("uuid"))
    shot = F.when(k % 3 == 0, "/tmp/shot.PNG").when(k % 3 == 1, "/tmp.d/shot").otherwise("cam.0.webp")
    return records(spark, d).select("id", R.stored_image_path(uuid, shot).alias("path")).withColumn("rejected", F.col("path").isNull())


@query("history_top150", _W + f"SELECT {_ROW_SQL} FROM records WHERE NOT deleted AND texture_class = 'view' ORDER BY id DESC LIMIT {HISTORY_CAP}")
def _(spark, d):
    return C.history(records(spark, d), texture_class="view").select(*_ROW)


@query("latest_record", _W + f"SELECT {_ROW_SQL} FROM records WHERE NOT deleted ORDER BY id DESC LIMIT 1")
def _(spark, d):
    return C.latest(records(spark, d)).select(*_ROW)


@query("latest_classified", _W + f"SELECT {_ROW_SQL} FROM records WHERE NOT deleted AND texture_class <> '' ORDER BY id DESC LIMIT 1")
def _(spark, d):
    return C.latest(records(spark, d), classified=True).select(*_ROW)


@query("pending_operations", _W + f", {OUTBOX_SQL} SELECT id, record_uuid, operation, status, created_at FROM outbox WHERE status = 'pending' ORDER BY id")
def _(spark, d):
    return C.pending(outbox(spark, d))


_STATS = f"""SELECT count(*) AS total, count(DISTINCT CASE WHEN {_VALID} THEN address END) AS addresses, round(avg(confidence_score), 9) AS mean_confidence,
  {_fixed('avg(confidence_score) * 100', 0)} || '%' AS mean_percent FROM records WHERE NOT deleted"""


@query("home_stats", _W + _STATS)
def home_stats(spark, d):
    return C.home_stats(records(spark, d)).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query("available_classes", _W + "SELECT DISTINCT texture_class FROM records WHERE NOT deleted AND texture_class <> '' ORDER BY 1")
def _(spark, d):
    return C.available_classes(records(spark, d))


@query("outbox_join_records", _W + f""", {OUTBOX_SQL} SELECT o.id, o.record_uuid, o.operation, r.uuid IS NULL AS orphan, r.deleted, r.texture_class
  FROM outbox o LEFT JOIN records r ON r.uuid = o.record_uuid WHERE o.status = 'pending'""")
def _(spark, d):
    return S.with_current_state(outbox(spark, d).where("status = 'pending'"), records(spark, d)).select("id", "record_uuid", "operation", "orphan", "deleted", "texture_class")


@query("remote_join_local", f"""WITH {REMOTE_SQL} SELECT r.uuid, r.seq, CASE WHEN l.uuid IS NULL THEN 'insert'
  WHEN r.instant > l.instant OR (r.instant = l.instant AND r.deleted AND NOT l.deleted) THEN 'remoteWins' ELSE 'localWins' END AS action FROM remote r LEFT JOIN local l ON l.uuid = r.uuid""")
def _(spark, d):
    local, remote = remote_batches(spark, d)
    return S.compare_remote(remote, local).select("uuid", "seq", "action")


_FOLD = f"""WITH {REMOTE_SQL}, every AS (
  SELECT uuid, 0 AS seq, id, instant, updated_at, deleted, texture_class, confidence_score, false AS remote FROM local
  UNION ALL SELECT uuid, seq, NULL, instant, updated_at, deleted, texture_class, confidence_score, true FROM remote)"""


@query("lww_merge", _FOLD + """, placed AS (SELECT *, max(id) OVER (PARTITION BY uuid) AS own, row_number() OVER (PARTITION BY uuid ORDER BY instant DESC, deleted DESC, seq) AS place FROM every)
  SELECT uuid, coalesce(own, -1) AS id, updated_at, deleted, texture_class, confidence_score, remote FROM placed WHERE place = 1""")
def _(spark, d):
    return S.lww_merge(*remote_batches(spark, d)).select("uuid", F.coalesce("id", F.lit(-1)).alias("id"), "updated_at", "deleted", "texture_class", "confidence_score", "remote")


@query("lww_merge_bucketed", _FOLD + """, placed AS (SELECT *, max(id) OVER (PARTITION BY uuid) AS own, row_number() OVER (PARTITION BY uuid ORDER BY instant DESC, deleted DESC, seq) AS place FROM every)
  SELECT uuid, coalesce(own, -1) AS id, updated_at, deleted, texture_class, confidence_score, remote FROM placed WHERE place = 1""")
def _(spark, d):
    local, pulled = remote_batches(spark, d)
    root = scratch(spark, "bucketed")
    held = write_bucketed(local, f"catalogue_{root[-8:]}", root, 8)
    return S.lww_merge_into(held, pulled, 8).select("uuid", F.coalesce("id", F.lit(-1)).alias("id"), "updated_at", "deleted", "texture_class", "confidence_score", "remote")


@query("lww_applied_count", _FOLD + """, ranked AS (SELECT *, epoch(instant) * 2 + deleted::INT AS state FROM every),
  seen AS (SELECT *, max(state) OVER (PARTITION BY uuid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ranked)
  SELECT count(*) AS received, count(*) FILTER (WHERE best IS NULL OR state > best) AS pulled FROM seen WHERE remote""")
def _(spark, d):
    return S.lww_applied(*remote_batches(spark, d))


@query("drain_outbox", _W + f""", {OUTBOX_SQL}, todo AS (SELECT record_uuid, bool_or(operation = 'upsert') AS upserted FROM outbox WHERE status = 'pending' GROUP BY 1)
  SELECT uuid, CASE WHEN upserted THEN 'remote-' || uuid ELSE remote_id END AS remote_id,
    CASE WHEN upserted IS NOT NULL THEN 'synced' ELSE sync_status END AS sync_status, (SELECT count(*) FROM outbox WHERE status = 'pending') AS pushed
  FROM records LEFT JOIN todo ON record_uuid = uuid""")
def _(spark, d):
    after, _ops, pushed = S.drain_outbox(outbox(spark, d), records(spark, d))
    return after.select("uuid", "remote_id", "sync_status").crossJoin(F.broadcast(pushed))  # one row


_NOW = "2026-01-01T12:00:00.000Z"


@query("create_records", f"""SELECT 'new-' || event_id AS uuid, 'pending' AS sync_status, '{_NOW}' AS updated_at, false AS deleted, 'upsert' AS operation, 'pending' AS status FROM events""")
def _(spark, d):
    new = table(spark, d, "events").select("event_id", F.col("event_type").alias("texture_class"))
    made, ops = S.create_records(new, _NOW, F.concat(F.lit("new-"), "event_id"))
    return made.select("uuid", "sync_status", "updated_at", "deleted").join(ops.select(F.col("record_uuid").alias("uuid"), "operation", "status"), "uuid")


@query("tombstone_records", _W + f"""SELECT uuid, deleted OR id % 10 = 3 AS deleted, CASE WHEN id % 10 = 3 AND NOT deleted THEN 'pending' ELSE sync_status END AS sync_status,
  CASE WHEN id % 10 = 3 AND NOT deleted THEN '{_NOW}' ELSE updated_at END AS updated_at, CASE WHEN id % 10 = 3 AND NOT deleted THEN 'delete' END AS operation FROM records""")
def _(spark, d):
    r = records(spark, d)
    after, ops, _paths = S.tombstone_records(r, r.where("id % 10 = 3").select("id"), _NOW)
    return after.select("uuid", "deleted", "sync_status", "updated_at").join(ops.select(F.col("record_uuid").alias("uuid"), "operation"), "uuid", "left")


@query("backfill_v2_v3", _W + """SELECT id, 'legacy-' || id AS uuid, CASE WHEN timestamp = 'n/a' THEN 'n/a' ELSE timestamp END AS updated_at, 'pending' AS sync_status, false AS deleted, 'upsert' AS operation,
  CAST(0 AS BIGINT) AS repeated_uuids FROM records""")
def _(spark, d):
    old = records(spark, d).select("id", "image_path", "latitude", "longitude", "address", "timestamp", "texture_class", "confidence_score")
    new, ops, twice = S.backfill_v3(old, F.concat(F.lit("legacy-"), "id"))
    out = new.select("id", "uuid", "updated_at", "sync_status", "deleted").join(ops.select(F.col("record_uuid").alias("uuid"), "operation"), "uuid")
    return out.crossJoin(F.broadcast(twice.agg(F.count("*").alias("repeated_uuids"))))  # one row


@query("evolve_v1_v2", _W + "SELECT id, image_path, CAST(NULL AS VARCHAR) AS texture_class, CAST(NULL AS DOUBLE) AS confidence_score FROM records")
def _(spark, d):
    return S.evolve_v1(records(spark, d).select("id", "image_path"))
