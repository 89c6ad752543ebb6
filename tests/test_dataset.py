from pyspark.sql import functions as F
import pytest

from fieldlab.operators import dataset as D
from fieldlab.operators import evaluation as E
from fieldlab.sources import manifests as M

CLASSES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def photos(spark):
    rows = [(c, f"{c}/sample_{g} ({p}).jpg") for c in CLASSES for g in range(20) for p in range(3)]
    return spark.createDataFrame(rows, "texture_class string, path string")


def test_sample_ids(spark):
    names = ["x/100147,21 (6).JPG", "single_image.jpg", "x/a (1) (2).png", "x/(3).png", "a.b.jpg"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(D.sample_id(F.col("p"))).collect()]
    assert got == ["100147,21", "single_image", "a (1)", "(3)", "a.b"]


def test_split_keeps_groups_together(photos):
    s = D.split_groups(photos, seed=7).cache()
    assert s.count() == 180 and D.leakage(s).count() == 0
    per = {(r[0], r[1]): r[2] for r in s.groupBy("texture_class", "split").agg(F.countDistinct("sample_group")).collect()}
    assert all(per[(c, "test")] == 3 and per[(c, "val")] == 3 and per[(c, "train")] == 14 for c in CLASSES)
    key = lambda df: sorted((r["path"], r["split"]) for r in df.collect())
    assert key(D.split_groups(photos, seed=7)) == key(s) != key(D.split_groups(photos, seed=8))
    leak = s.withColumn("split", F.when(F.col("path") == "a/sample_0 (1).jpg", "val").otherwise("train"))
    assert [(r["split_a"], r["split_b"]) for r in D.leakage(leak).collect()] == [("train", "val")]


def test_few_groups_are_named(spark):
    few = spark.createDataFrame([("a", "a/1.jpg"), ("a", "a/2.jpg"), ("b", "b/1.jpg"), ("b", "b/2.jpg"), ("b", "b/3.jpg")], "texture_class string, path string")
    assert {r["texture_class"]: r["enough"] for r in D.group_counts(few).collect()} == {"a": False, "b": True}


def test_few_groups_stop_the_split(spark, photos):
    few = photos.unionByName(spark.createDataFrame([("rare", "rare/1.jpg"), ("rare", "rare/2.jpg")], "texture_class string, path string"))
    with pytest.raises(Exception, match=r"class rare has 2 sample group\(s\), a split needs at least 3"):
        D.split_groups(few).collect()


def test_a_changed_manifest_stops_the_load(spark, photos, tmp_path):
    photos.coalesce(2).write.option("header", True).csv(str(tmp_path / "m"))
    M.write_split(D.split_groups(photos), str(tmp_path / "s"), 1, 0.15, 0.15, CLASSES, manifest=str(tmp_path / "m/*.csv"))
    assert M.load_split(spark, str(tmp_path / "s"), manifest=str(tmp_path / "m/*.csv"))[0].count() == 180
    photos.limit(1).write.mode("append").option("header", True).csv(str(tmp_path / "m"))
    with pytest.raises(ValueError, match="manifest"):
        M.load_split(spark, str(tmp_path / "s"), manifest=str(tmp_path / "m/*.csv"))
    M.write_split(D.split_groups(photos), str(tmp_path / "t"), 1, 0.15, 0.15, CLASSES)
    with pytest.raises(ValueError):
        M.load_split(spark, str(tmp_path / "t"), manifest=str(tmp_path / "m/*.csv"))


def test_scan_names_what_is_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        M.scan_dataset(spark, str(tmp_path / "none"), CLASSES)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.JPG").write_text("x")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "notes.txt").write_text("x")
    with pytest.raises(ValueError, match="b, c"):
        M.scan_dataset(spark, str(tmp_path), CLASSES)
    assert M.scan_dataset(spark, str(tmp_path), ["a"]).count() == 1


def test_every_manifest_row_is_judged(spark):
    judged = spark.createDataFrame([(1, "ok", [], None), (2, "blocking", [("blur", True), ("contrast", False)], None), (3, "advisory", [("contrast", False)], None), (4, "unvalidated", None, "broken")], "photo long, verdict string, failures array<struct<criterion:string,blocking:boolean>>, error string")
    got = {r["photo"]: (r["admitted"], r["quality_flags"], r["reason"]) for r in D.admit(spark.range(1, 6).withColumnRenamed("id", "photo"), judged, "photo").collect()}
    assert got == {1: (True, "", None), 2: (False, "blur,contrast", "blur"), 3: (True, "contrast", None), 4: (False, None, "broken"), 5: (False, None, "no photo")}


def test_series_across_chunks(spark):
    rows = [(0, 1 + (e > 40), e, "loss", 0.5) for e in range(100)] + [(0, 2, 5, "late", 0.1)]
    h = spark.createDataFrame(rows, "version int, phase int, epoch int, metric string, value double")
    got = {r["epoch"]: r["step"] for r in M.concat_history(h, chunk=7).collect()}
    assert got == {e: e + 1 for e in range(100)}


def test_arms(spark):
    runs = spark.createDataFrame([("real", 1, 0.9), ("real", 2, 0.7), ("shuffled", 1, 0.2), ("shuffled", 2, 0.4)], "arm string, seed int, value double")
    got = {r["arm"]: r for r in D.compare_arms(runs).collect()}
    assert got["shuffled"]["mean"] == pytest.approx(0.3) and got["shuffled"]["delta"] == pytest.approx(-0.5) and got["real"]["spread"] == pytest.approx(0.02**0.5)


def test_rows_without_prediction_are_counted(spark):
    s = spark.createDataFrame([(0, 0), (0, None), (1, 1), (1, 7), (None, 1)], "truth int, predicted int")
    cells = E.confusion(s, 2)
    assert {(r["truth"], r["predicted"]): r["n"] for r in cells.collect()} == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1, (0, -1): 1, (1, -1): 1}
    assert E.summary(E.report(cells)).first()["accuracy"] == 0.5 and E.summary(E.report(cells)).first()["test_size"] == 4


def test_percentiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    groups = {"a": rng.random(3001).tolist(), "b": [0.5] * 700 + rng.integers(0, 4, 300).astype(float).tolist(), "c": [1.0], None: [2.0, 1.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double")
    at = [0.0, 0.05, 0.5, 0.9, 1.0]
    for r in E.percentiles(df, "v", at, ["g"], cuts=16).collect():
        assert [r[f"p{round(q * 100)}"] for q in at] == pytest.approx(np.quantile(groups[r["g"]], at).tolist()) if r["g"] else r["p50"] == 1.5
    whole = [v for vs in groups.values() for v in vs]
    assert E.percentiles(df, "v", [0.25]).first()[0] == pytest.approx(np.quantile(whole, 0.25))


def test_nearest_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(40, 8)), rng.normal(size=(300, 8))
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, vector array<double>")
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "item long, vector array<double>")
    away = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    for r in E.nearest_real(a, b, block=32).collect():
        assert r["nearest"] == away[r["item"]].argmin() and r["distance"] == pytest.approx(away[r["item"]].min(), rel=1e-12)


def test_weights(photos):
    w = {r[0]: r[1] for r in D.class_weights(photos.where("texture_class <> 'c'"), [*CLASSES, "d"]).collect()}
    assert w["a"] == pytest.approx(120 / (4 * 60)) and w["c"] == w["d"] == 1


def test_manifest_round_trip(spark, photos, tmp_path):
    M.write_split(D.split_groups(photos), str(tmp_path), 42, 0.15, 0.15, CLASSES)
    rows, settings = M.load_split(spark, str(tmp_path))
    assert rows.count() == 180
    active = spark.createDataFrame([("seed", "42"), ("val", "0.2"), ("classes", "a,b")], "name string, value string")
    assert {r["name"] for r in D.contract_violations(settings, active).collect()} == {"val", "classes"}
    with pytest.raises(Exception):
        M.load_split(spark, str(tmp_path / "none"))


def test_shuffled_labels_are_a_permutation(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).cast("string").alias("label"))
    out = D.shuffled_labels(df, "id", "label", 3)
    assert out.count() == 500 and out.select("id").distinct().count() == 500
    assert {r[0]: r[1] for r in out.groupBy("control").count().collect()} == {r[0]: r[1] for r in df.groupBy("label").count().collect()}


def test_argmax_and_ranking(spark):
    rows = [([0.2, 0.4, 0.4],), ([float("nan"), 0.1, 0.3],), ([],), (None,)]
    p = spark.createDataFrame(rows, "p array<double>")
    assert [r[0] for r in p.select(E.argmax(F.col("p"))).collect()] == [1, 2, None, None]
    assert [x["class"] for x in p.select(E.ranking(F.col("p"))).first()[0]] == [1, 2, 0]


@pytest.mark.parametrize(("p", "want"), [
    ([0.94, 0.03, 0.01, 0.01, 0.01], "conclusive"), ([0.60, 0.20, 0.10, 0.06, 0.04], "conclusive"), ([0.44, 0.39, 0.09, 0.05, 0.03], "ambiguous"),
    ([0.48, 0.44, 0.04, 0.02, 0.02], "ambiguous"), ([0.25, 0.24, 0.22, 0.15, 0.14], "insufficient"), ([0.48, 0.20, 0.14, 0.10, 0.08], "insufficient"), (None, "notAnalysed"),
])
def test_verdicts(spark, p, want):
    assert spark.createDataFrame([(p,)], "p array<double>").select(E.verdict(F.col("p"))).first()[0] == want


def test_report_with_empty_classes(spark):
    s = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "truth int, predicted int")
    cells = E.confusion(s, 3)
    assert cells.count() == 9
    r = {x["class"]: x for x in E.report(cells).collect()}
    assert r[2]["precision"] == r[2]["recall"] == r[2]["f1"] == 0 and r[0]["recall"] == 0.5 and r[1]["precision"] == 0.5
    assert E.summary(E.report(cells)).first()["accuracy"] == pytest.approx(2 / 3)


def test_temperature_recovers_scaling(spark):
    import math
    import random

    rng, rows = random.Random(1), []
    for _ in range(1500):
        z = [rng.gauss(0, 1.5) for _ in range(3)]
        true = [math.exp(v) for v in z]
        k = rng.choices(range(3), true)[0]
        sharp = [math.exp(2 * v) for v in z]
        rows.append(([v / sum(sharp) for v in sharp], k))
    t = E.fit_temperature(spark.createDataFrame(rows, "probabilities array<double>, truth int"))
    assert 1.7 < t < 2.4


def test_classifier_learns_weighted_classes(spark):
    import random

    rng, rows = random.Random(2), []
    for i in range(900):
        k = 0 if i % 10 else 1 + i // 10 % 2  # one class holds nine tenths
        rows.append((i, float(k), [rng.gauss(3.0 * (k == j), 1.0) for j in range(3)]))
    df = spark.createDataFrame(rows, "item long, label double, x array<double>")
    w = D.class_weights(df.select(F.col("label").cast("int").cast("string").alias("texture_class")), ["0", "1", "2"])
    w = w.select(F.col("texture_class").cast("double").alias("label"), "weight")
    plain, weighted = (E.train_classifier(df.where("item % 3 <> 0"), "x", "label", x) for x in (None, w))
    out = {}
    for name, model in (("plain", plain), ("weighted", weighted)):
        s = E.with_prediction(E.batch_score(model, df.where("item % 3 = 0").withColumn("truth", F.col("label").cast("int")), "x"), ("a", "b", "c"))
        assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in s.limit(20).collect())
        rep = {r["class"]: r for r in E.report(E.confusion(s, 3)).collect()}
        out[name] = min(rep[1]["recall"], rep[2]["recall"])
        assert rep[0]["recall"] > 0.9
    assert out["weighted"] > 0.8 and out["weighted"] >= out["plain"]


def test_user_model_in_batches(spark):
    out = E.score_with(spark.range(5).select("id", (F.col("id") * 1.0).alias("x")), ["x"], lambda f: [[v, 1 - v] for v in f["x"]], ["id"])
    assert {r["id"]: r["probabilities"] for r in out.collect()}[2] == [2.0, -1.0]
