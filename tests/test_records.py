import pytest
from pyspark.sql import functions as F

from fieldlab.functions import records as R
from fieldlab.operators import catalogue as C
from fieldlab.operators import sync as S

LOCAL = "uuid string, id long, updated_at string, deleted boolean, address string"
REMOTE = "uuid string, seq long, updated_at string, timestamp string, deleted boolean, address string"


def _merge(spark, local, remote):
    a = spark.createDataFrame(local, LOCAL).withColumn("timestamp", F.lit(None).cast("string"))
    return {r["uuid"]: r for r in S.lww_merge(a, spark.createDataFrame(remote, REMOTE)).collect()}


def test_search_is_literal(spark):
    rows = [(1, False, "Lote 100% da Serra"), (2, False, "Lote 1000 da Serra"), (3, False, "a_b"), (4, False, "axb"), (5, False, "c\\d"), (6, True, "a_b"), (7, False, None)]
    df = spark.createDataFrame(rows, "id long, deleted boolean, address string").withColumn("texture_class", F.lit("x"))
    ids = lambda **k: sorted(r["id"] for r in C.filtered(df, **k).collect())
    assert ids(search="100%") == [1] and ids(search="  A_B ") == [3] and ids(search="\\") == [5]
    assert ids(search="   ") == [1, 2, 3, 4, 5, 7] == ids(search=None, texture_class="")


def test_instants(spark):
    rows = [("2026-01-01T10:00:00.000-05:00",), ("2026-01-01T12:00:00.000Z",), ("2026-01-01T12:00:00",), ("nope",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(F.unix_timestamp(R.instant(F.col("t")))).collect()]
    assert got[0] - got[1] == 3 * 3600 and got[2] == got[1] and got[3:] == [None, None]


@pytest.mark.parametrize(("text", "want"), [
    ("2026-01-01T12:00Z", "2026-01-01 12:00:00"), ("2026-01-01 12:00:00Z", "2026-01-01 12:00:00"), ("2026-01-01T12:00:00+0000", "2026-01-01 12:00:00"),
    ("2026-01-01T12:00:00.123456789Z", "2026-01-01 12:00:00.123456"), ("20260101T120000Z", "2026-01-01 12:00:00"), ("2026-01-01 12:00:00.123456", "2026-01-01 12:00:00.123456"),
    ("20260101", "2026-01-01 00:00:00"), ("2026-01-01T12", "2026-01-01 12:00:00"), ("2026-01-01T12:00:00,5-05", "2026-01-01 17:00:00.5"), ("2026-01-01T12:00:00 +05:30", "2026-01-01 06:30:00"),
    ("2026-02-30T00:00:00Z", "2026-03-02 00:00:00"), ("2026-13-01T25:61:61Z", "2027-01-02 02:02:01"), ("+002026-01-01T00:00:00Z", "2026-01-01 00:00:00"), ("2026-01-01T12:00:00.1Z", "2026-01-01 12:00:00.1"),
    ("2026-1-1", None), ("2026-01-01T", None), ("2026-01-01T12:00:00Z\n", None), ("2026-01-01T12:00:00.Z", None), (" 2026-01-01", None), ("n/a", None), ("", None), ("999999-01-01", None), (None, None),
])
def test_stamps(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(R.instant(F.col("t")).cast("string")).first()[0]
    assert got == want


def test_stamps_without_zone_are_local(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        got = spark.createDataFrame([("2026-01-01 12:00:00.5",), ("2026-01-01T12:00:00.5-0300",)], "t string").select(R.instant(F.col("t")).cast("double")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[0][0] == got[1][0] == 1767279600.5


def test_drain_takes_the_given_remote_id(spark):
    records = spark.createDataFrame([("a", "srv-1", "pending"), ("b", "srv-2", "pending"), ("c", None, "pending"), ("d", None, "pending")], "uuid string, remote_id string, sync_status string")
    ops = spark.createDataFrame([(1, "a", "upsert", "pending"), (2, "b", "delete", "pending"), (3, "c", "upsert", "pending"), (4, "gone", "upsert", "pending"), (5, "d", "upsert", "synced")], "id long, record_uuid string, operation string, status string")
    given = F.when(F.col("uuid") == "a", "srv-NEW")
    after, outbox, pushed = S.drain_outbox(ops, records, given)
    assert {r["uuid"]: (r["remote_id"], r["sync_status"]) for r in after.collect()} == {"a": ("srv-NEW", "synced"), "b": ("srv-2", "synced"), "c": (None, "synced"), "d": (None, "pending")}
    assert pushed.first()[0] == 4 and outbox.where("status <> 'synced'").count() == 0


def test_merge_by_instant_then_tombstone(spark):
    local = [("a", 1, "2026-01-01T12:00:00.000Z", False, "Local")]
    assert _merge(spark, local, [("a", 1, "2026-01-02T00:00:00.000Z", "t", False, "Remote")])["a"]["address"] == "Remote"
    assert _merge(spark, local, [("a", 1, "2025-12-31T00:00:00.000Z", "t", False, "Remote")])["a"]["address"] == "Local"
    assert _merge(spark, local, [("a", 1, "2026-01-01T12:00:00.000Z", "t", True, "Remote")])["a"]["deleted"]
    assert _merge(spark, local, [("a", 1, "2026-01-01T10:00:00.000-05:00", "t", False, "Remote")])["a"]["address"] == "Remote"
    # a full tie keeps the local row; an unreadable updated_at is the epoch and does not fall back
    assert _merge(spark, local, [("a", 1, "2026-01-01T12:00:00.000Z", "t", False, "Remote")])["a"]["address"] == "Local"
    assert _merge(spark, local, [("a", 1, "bad", "2030-01-01T00:00:00.000Z", False, "Remote")])["a"]["address"] == "Local"
    # a missing updated_at takes the timestamp; the local id stays
    won = _merge(spark, local, [("a", 1, None, "2030-01-01T00:00:00.000Z", False, "Remote"), ("b", 2, None, "bad", False, "New")])
    assert won["a"]["address"] == "Remote" and won["a"]["id"] == 1 and won["b"]["id"] is None


def test_applied_counts_changes_during_the_fold(spark):
    local = spark.createDataFrame([("a", 1, "2026-01-01T00:00:00Z", False, "L")], LOCAL)
    remote = [("a", 1, "2026-01-02T00:00:00Z", "t", False, "x"), ("a", 2, "2026-01-03T00:00:00Z", "t", False, "y"), ("a", 3, "2026-01-02T12:00:00Z", "t", False, "z"), ("b", 4, "2026-01-01T00:00:00Z", "t", False, "n"), ("b", 5, "2026-01-01T00:00:00Z", "t", False, "n")]
    assert S.lww_applied(local, spark.createDataFrame(remote, REMOTE)).first().asDict() == {"received": 5, "pulled": 3}


def test_bands_and_display(spark):
    rows = [(0.8,), (0.79,), (0.6,), (0.1,), (None,), (float("nan"),), (0.4225,)]
    df = spark.createDataFrame(rows, "confidence_score double")
    assert [r[0] for r in df.select(R.confidence_band(F.col("confidence_score"))).collect()] == ["high", "moderate", "moderate", "low", "low", "low", "low"]
    assert [r[0] for r in df.select(R.confidence_chip()).collect()][-2:] == ["Baixa", "42% · Baixa"]
    stamp = spark.createDataFrame([("2026-04-01T14:30:00",), ("?",)], "t string")
    assert [r[0] for r in stamp.select(R.display_stamp(F.col("t"))).collect()] == ["01/04/2026 às 14:30", "?"]


def test_stored_path_refuses_separators(spark):
    rows = [("u", "/a.b/c"), ("u", "x.PNG"), ("a/b", "x.png"), ("a\\b", "x.png"), ("u", ".hidden")]
    got = [r[0] for r in spark.createDataFrame(rows, "u string, p string").select(R.stored_image_path(F.col("u"), F.col("p"))).collect()]
    assert got == ["soil_images/u.jpg", "soil_images/u.PNG", None, None, "soil_images/u.jpg"]


def test_tombstones_change_live_rows_only(spark):
    rows = [(1, "a", "synced", "p1", "t", False), (2, "b", "synced", "p2", "t", True), (3, "c", "synced", "p3", "t", False)]
    df = spark.createDataFrame(rows, "id long, uuid string, sync_status string, image_path string, updated_at string, deleted boolean")
    after, ops, paths = S.tombstone_records(df, spark.createDataFrame([(1,), (1,), (2,)], "id long"), "now")
    assert sorted((r["id"], r["deleted"], r["sync_status"]) for r in after.collect()) == [(1, True, "pending"), (2, True, "synced"), (3, False, "synced")]
    assert [r["record_uuid"] for r in ops.collect()] == ["a"] and [r[0] for r in paths.collect()] == ["p1"]
    assert S.tombstone_records(df, df.where("false").select("id"), "now")[1].count() == 0
    assert S.tombstone_records(df, None, "now")[1].count() == 2


def test_tables_keep_their_schemas(spark, sf_dir, tmp_path):
    from fieldlab import schemas
    from fieldlab.sources import standins, tables

    r, path = standins.records(spark, sf_dir), str(tmp_path / "records")
    tables.write_table(r.withColumn("more", F.lit(1)), path, schemas.RECORDS)
    back = tables.read_records(spark, path)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in schemas.RECORDS] and back.exceptAll(r.select(*back.columns)).count() == 0
    tables.write_table(standins.outbox(spark, sf_dir), str(tmp_path / "outbox"), schemas.OUTBOX)
    assert C.pending(tables.read_outbox(spark, str(tmp_path / "outbox"))).count() == C.pending(standins.outbox(spark, sf_dir)).count()
    tables.write_table(standins.tips_cache(spark, sf_dir), str(tmp_path / "tips"), schemas.TIPS)
    assert tables.read_tips(spark, str(tmp_path / "tips")).columns == ["record_uuid", "payload_json", "retrieved_at"]
    with pytest.raises(Exception, match="uuid is null"):
        tables.write_table(r.withColumn("uuid", F.lit(None).cast("string")), str(tmp_path / "bad"), schemas.RECORDS)
