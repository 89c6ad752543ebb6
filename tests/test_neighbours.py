import numpy as np
import pytest

from fieldlab.operators import neighbours as N


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 8)) * 4
    x = (centers[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 8))).astype(np.float32)
    x[700:1200] = x[700]  # a third of all rows is one vector
    x[1300] = x[1301] = x[5]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)], "item long, vector array<float>")


def truth(x, ids, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        near = sorted((round(float(d[i]), 9), i) for i in ids if i != q)[:k]
        out[q] = [(i, n) for n, i in near]
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_exact_search_by_brute_force(spark, clustered, tmp_path, monkeypatch, k):
    x, rows = clustered
    monkeypatch.setattr(N, "SEGMENT", 64)
    monkeypatch.setattr(N, "QUERY_BLOCK", 16)
    index = N.write_index(rows, f"{tmp_path}/index")  # 39 lists, as the rows are more than a segment
    assert 30 < len(index.centroids) <= 39 and index.lists.agg({"n": "sum"}).first()[0] == len({v.tobytes() for v in x})
    queries = [q for q in range(1500) if q % 50 == 0] + [701, 5]
    found = N.nearest(rows.where("item % 50 = 0 OR item IN (701, 5, 9000)"), index, f"{tmp_path}/work", k=k, probes=2, exact=True).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r["nearest"], round(r["distance"], 9)))
    assert got == truth(x, range(1500), queries, k)


def test_recall_of_the_index(spark, clustered, tmp_path):
    _, rows = clustered
    N.write_index(rows, f"{tmp_path}/index", N.fit_centroids(rows, 30))
    index = N.open_index(spark, f"{tmp_path}/index")
    queries = rows.where("item % 50 = 0")
    few = N.nearest(queries, index, f"{tmp_path}/a", probes=4)
    all_ = N.nearest(queries, index, f"{tmp_path}/b", probes=4, exact=True)
    r = N.recall(few, all_).first()
    assert r["queries"] == 30 and r["recall"] >= 0.9
    assert N.recall(all_, all_).first()["recall"] == 1 and N.recall(few.where("false"), all_).first()["recall"] == 0


def test_index_of_nothing_and_odd_vectors(spark, tmp_path):
    kind = "item long, vector array<float>"
    none = spark.createDataFrame([], kind)
    some = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], kind)
    empty = N.write_index(none, f"{tmp_path}/none")
    assert N.nearest(some, empty, f"{tmp_path}/w0").count() == 0
    one = N.write_index(some, f"{tmp_path}/one")
    assert N.nearest(some, one, f"{tmp_path}/w1", exact=True).count() == 0  # nothing but itself
    far = spark.createDataFrame([(7, [3.0, 5.0])], kind)
    assert [tuple(r) for r in N.nearest(far, one, f"{tmp_path}/w2").collect()] == [(7, 1, 5.0, 1)]
    with pytest.raises(ValueError):
        N.nearest(far, one, f"{tmp_path}/w3", k=N.ITEMS)
    bad = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], kind)
    with pytest.raises(Exception, match="length"):
        N.write_index(bad, f"{tmp_path}/bad", centroids=np.zeros((1, 1)))


def test_measured_probes_reach_the_recall(spark, sf_dir, tmp_path):
    """Unit vectors without clusters, the hardest case: so many lists as needed, and the recall on all queries."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 16))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, vector array<float>")
    index, asked = N.write_index(rows, f"{tmp_path}/index", N.fit_centroids(rows, 45)), rows.where("item % 10 = 0")
    probes = N.probes_for(index, asked, f"{tmp_path}/probes", sample=100)
    found = N.nearest(asked, index, f"{tmp_path}/few", probes=probes)
    r = N.recall(found, N.nearest(asked, index, f"{tmp_path}/all", exact=True)).first()
    assert 1 < probes < len(index.centroids) and r["queries"] == 200 and 0.9 <= r["recall"] < 1
