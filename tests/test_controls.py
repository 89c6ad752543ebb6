import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.operators import controls as K
from fieldlab.operators import dataset as D
from fieldlab.operators import evaluation as E
from fieldlab.sources import manifests as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(3, 6))
    y = rng.integers(0, 3, 600)
    x = centers[y] + rng.normal(size=(600, 6)) * [1, 2, 0.5, 1, 3, 1]
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "item long, x array<double>, label int").cache()


def test_agrees_with_spark_ml(rows):
    """One model of many against Spark's own fit: weights up to a constant a class, probabilities to 1e-3."""
    both = rows.withColumn("labels", F.array(F.when(F.col("item") % 3 == 0, -1).otherwise(F.col("label")), F.lit(1), F.col("label")))
    w = K.fit_models(both, "x", "labels", 3, 3, iterations=90, tolerance=1e-6)
    model = E.train_classifier(rows.where("item % 3 <> 0"), "x", "label", iterations=300)
    scored = E.batch_score(model, rows, "x").collect()
    x = np.column_stack([np.array([r["x"] for r in scored]), np.ones(len(scored))])
    z = np.exp(x @ w[0].T)
    assert np.abs(z / z.sum(1, keepdims=True) - np.array([r["probabilities"] for r in scored])).max() < 1e-3
    assert np.abs(w[0] - w[2]).max() > 0.01 and (np.argmax(x @ w[1].T, axis=1) == 1).all()


def test_accuracy_by_hand(rows):
    w = np.zeros((2, 3, 7))
    w[0, 2, -1] = w[1, 0, -1] = 1
    asked = rows.withColumn("t", F.array("label", F.when(F.col("item") < 10, F.col("label")).otherwise(-1)))
    got = {r["model"]: (r["rows"], r["accuracy"]) for r in K.accuracy_of_models(asked, "x", "t", w).collect()}
    labels = [r["label"] for r in rows.orderBy("item").collect()]
    assert got == {0: (600, labels.count(2) / 600), 1: (10, labels[:10].count(0) / 10)}


def test_arms_over_five_seeds(rows, tmp_path):
    runs = K.train_arms(rows, "x", "item", "label", 3, [1, 2, 3, 4, 5], str(tmp_path / "arms"), iterations=25)
    c = {r["arm"]: r for r in D.compare_arms(runs).collect()}
    assert c["real"]["seeds"] == c["shuffled"]["seeds"] == 5 and c["real"]["spread"] > 0
    assert c["real"]["mean"] > 0.7 and abs(c["shuffled"]["mean"] - 1 / 3) < 0.12 and c["shuffled"]["delta"] < -0.3


def test_artifacts_of_a_fit(spark, rows, tmp_path):
    model = E.train_classifier(rows, "x", "label", iterations=8)
    scored = E.with_prediction(E.batch_score(model, rows, "x"), ("a", "b", "c")).select(F.col("item"), "predicted", "probabilities").join(rows.select("item", F.col("label").alias("truth")), "item")
    path = str(tmp_path / "runs")
    for note in ("first", "second"):
        M.write_run(M.run_artifacts("v1", scored, ["a", "b", "c"], {"note": note}, {"seed": "7"}, M.fit_history(model)), path)
    M.write_run(M.run_artifacts("v2", scored.limit(0), ["a", "b", "c"], {}, None), path)
    got = {r["version"]: r for r in spark.read.parquet(path).collect()}
    assert set(got) == {"v1", "v2"} and got["v1"]["config"] == {"note": "second"} and got["v1"]["runtime"] == {"seed": "7"} and got["v2"]["runtime"] is None
    m = got["v1"]["metrics"]
    pairs = [(r["truth"], r["predicted"]) for r in scored.collect()]
    assert m["test_size"] == 600 and m["accuracy"] == pytest.approx(sum(a == b for a, b in pairs) / 600)
    assert [[row[p] for p in range(3)] for row in m["confusion"]] == [[sum(x == (t, p) for x in pairs) for p in range(3)] for t in range(3)]
    assert [r["class"] for r in m["per_class"]] == ["a", "b", "c"] and sum(r["support"] for r in m["per_class"]) == 600
    assert got["v2"]["metrics"]["test_size"] == 0 and got["v2"]["history"] == []
    series = M.concat_history(M.run_history(spark, path)).orderBy("step").collect()
    assert [r["value"] for r in series] == [v for *_, v in M.fit_history(model)] and [r["step"] for r in series] == list(range(1, len(series) + 1))


def test_metadata_of_a_split(spark, tmp_path):
    path = str(tmp_path / "split")
    with pytest.raises(FileNotFoundError):
        M.load_split(spark, path)
    kind = "photo long, split string"
    M.write_split(spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], kind), path, 42, 0.15, 0.15, ["x", "y"])
    M.write_split(spark.createDataFrame([(1, "val")], kind), path, 43, 0.15, 0.15, ["x", "y"])
    rows, settings = M.load_split(spark, path)
    of = {r["name"]: r["value"] for r in settings.collect()}
    assert rows.count() == 1 and of["seed"] == "43"
    assert {k: v for k, v in of.items() if "." in k} == {"class_to_idx.x": "0", "class_to_idx.y": "1", "count.train": "0", "count.val": "1", "count.test": "0"}
