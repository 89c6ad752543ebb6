"""Rows that joins used to lose, the bucketed merge, and counters as a stream."""

import pytest
from pyspark.sql import functions as F

from fieldlab.operators import dataset as D
from fieldlab.operators import evaluation as E
from fieldlab.operators import monitoring as M
from fieldlab.operators import sync as S
from fieldlab.sources.standins import remote_batches
from fieldlab.sources.tables import write_bucketed


def test_synthetic_rows_of_unknown_parents(spark):
    split = spark.createDataFrame([(1, "g1", "train"), (2, "g2", "test")], "photo long, sample_group string, split string")
    fake = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9), ("d", None)], "item string, parent long")
    of, bad = D.inherit_split(fake, split)
    assert {(r["item"], r["split"]) for r in of.collect()} == {("a", "train"), ("b", "test"), ("c", None), ("d", None)}
    assert {(r["item"], r["reason"]) for r in bad.collect()} == {("b", "parent in test"), ("c", "unknown parent"), ("d", "unknown parent")}


def test_photos_without_a_class_stop_a_split(spark):
    rows = [(i, f"en/s{i}.jpg", "en") for i in range(6)]
    kind = "photo long, path string, texture_class string"
    assert D.split_groups(spark.createDataFrame(rows, kind)).count() == 6
    for odd in ((6, "en/s6.jpg", None), (6, None, "en")):
        with pytest.raises(Exception, match="no class or no sample"):
            D.split_groups(spark.createDataFrame([*rows, odd], kind)).collect()


def test_drift_of_devices_of_one_version(spark):
    kind = "version int, device string, verdict string, blocked boolean"
    log = spark.createDataFrame([(0, "a", "ambiguous", False), (1, "a", "conclusive", True), (0, "gone", "conclusive", True), (1, "new", "conclusive", True)], kind)
    got = {r["device"]: (r["ambiguous_delta"], r["blocked_delta"], r["only_in"]) for r in M.drift(log, 0, 1).collect()}
    assert got == {"a": (-1.0, 1.0, None), "gone": (None, None, 0), "new": (None, None, 1)}


def test_parity_counts_items_of_one_model(spark):
    kind = "item long, truth int, predicted int, confidence double"
    a = spark.createDataFrame([(1, 0, 0, 0.9), (2, 1, 0, 0.8), (3, 1, 1, 0.7)], kind)
    b = spark.createDataFrame([(1, 0, 1, 0.9), (2, 1, 1, 0.8), (7, 1, 1, 0.7), (8, 1, 1, 0.7)], kind)
    r = E.parity(a, b).first()
    assert (r["items"], r["only_a"], r["only_b"], r["agreement"], r["accuracy_delta"]) == (2, 1, 2, 0.0, 0.0)
    assert E.parity(a, b.where("item > 6")).first()["items"] == 0


def test_bucketed_merge(spark, sf_dir, tmp_path):
    local, pulled = remote_batches(spark, sf_dir)
    local = local.withColumns({"sync_status": F.lit("pending"), "remote_id": F.lit(None).cast("string")})
    held = write_bucketed(local, "catalogue_of_test", str(tmp_path / "t"), 6)
    merged = S.lww_merge_into(held, pulled, 6)
    want = S.lww_merge(local, pulled).select(*merged.columns)
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, want.collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (S.lww_merge_into(held, pulled, 6), S.compare_remote(pulled.repartition(6, "uuid"), held), S.with_current_state(pulled.select(F.col("uuid").alias("record_uuid")).repartition(6, "record_uuid"), held.withColumns({"remote_id": F.lit("x")}))):
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert text.count("Exchange ") == 1 and "Bucketed: true" in text, text  # of the pulled rows only
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    with pytest.raises(ValueError, match="more than one row"):
        write_bucketed(local.union(local.limit(1)), "catalogue_twice", str(tmp_path / "u"), 2)
    spark.sql("DROP TABLE catalogue_of_test")


def test_counters_follow_the_log(spark, tmp_path):
    kind = "version int, label string, verdict string, flags array<string>, status string"
    parts = [[(0, "x", "conclusive", ["dark"], "ok"), (0, None, "notAnalysed", None, "failed:decode")], [(1, "x", "ambiguous", ["dark", "blur"], "ok")], [(0, "y", "conclusive", [], "ok"), (1, "x", "ambiguous", None, "failed:timeout")]]
    log, seen = str(tmp_path / "log"), []
    for k, rows in enumerate(parts):  # a trigger each, with a restart in between
        seen += rows
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(log)
        name = f"counters_{k}"
        M.follow_counters(spark.readStream.schema(kind).parquet(log), name, str(tmp_path / "checkpoint")).awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, M.counters(spark.createDataFrame(seen, kind)).collect()))
