"""Nearest neighbours of vectors: an index of inverted lists around coarse centroids, with exact distances.

Each vector stands in the list of its nearest centroid.  A query looks into the
lists of its ``probes`` nearest centroids (``probes_for`` measures how many a
recall takes) and gets exact distances to all that stands there; work is
(queries) x (probes) / (lists) of the product of both sides.  With ``exact`` a second round looks into all further lists that can hold
something nearer than what was found, by the triangle inequality over each
list's radius, so the result equals that of comparing everything.

Centroids come from k-means over a bounded sample; every vector is indexed.
Equal vectors are one entry of the index with their smallest items, so a vector
that a third of the rows share is compared once.  Long lists are cut into
segments and the queries of a popular list into blocks; a task holds one
segment and streams queries past it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors that centroids are fitted on, and centroids, at most.
SAMPLE, MOST_LISTS = 20_000, 4096
#: Entries of a segment of a list, queries of a block, and queries compared in a step.
SEGMENT, QUERY_BLOCK, STEP = 4096, 65_536, 512
#: Smallest items that an entry keeps of equal vectors; a search asks for fewer neighbours than that.
ITEMS = 16


@dataclass
class Index:
    """``vectors``: list, vector, items, away (from the centroid).  ``lists``: list, n, radius; ``centroids`` by list."""

    vectors: DataFrame
    lists: DataFrame
    centroids: np.ndarray


def _numbers(column: pa.Array) -> np.ndarray:
    """A matrix from an Arrow column of number lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and (len(flat) % len(column) or not (np.diff(column.offsets.to_numpy()) == len(flat) // len(column)).all()):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def fit_centroids(real: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centroids of at most ``sample`` distinct vectors, those of smallest hash.

    By default as many as the square root of the rows, and a single one for what fits into a segment.
    """
    rows = real.where("vector IS NOT NULL")
    if lists is None:
        n = rows.count()
        lists = 1 if n <= SEGMENT else min(MOST_LISTS, round(n**0.5))
    few = rows.select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(sample).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    few = few.cache()
    try:
        if few.isEmpty():
            return np.zeros((0, 0))
        model = KMeans(k=lists, seed=seed, maxIter=10, initMode="random").fit(few) if lists > 1 else None
        return np.array(model.clusterCenters() if model else [few.first()[0].toArray()], float)
    finally:
        few.unpersist()


def _to_lists(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of each row to each centroid."""
    squares = (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * (x @ centroids.T)
    return np.sqrt(np.maximum(squares, 0))


def write_index(real: DataFrame, path: str, centroids: np.ndarray | None = None) -> Index:
    """Indexes every row of ``real`` (item, vector) that has a vector, as tables under ``path``."""
    spark = real.sparkSession
    centers = fit_centroids(real) if centroids is None else centroids
    rows = real.where("vector IS NOT NULL").select("item", F.col("vector").cast("array<float>").alias("vector"))
    small = rows.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("item"))).where(F.col("place") <= ITEMS)
    entries = small.groupBy("vector").agg(F.array_sort(F.collect_list("item")).alias("items"))

    def assign(batches):
        for b in batches:
            if b.num_rows:
                x = _numbers(b.column("vector"))
                near = np.concatenate([_to_lists(x[lo : lo + STEP], centers).argmin(1) for lo in range(0, len(x), STEP)])
                away = np.sqrt(((x - centers[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column("vector"), b.column("items"), pa.array(away)], names=["list", "vector", "items", "away"])

    entries.mapInArrow(assign, "list int, vector array<float>, items array<bigint>, away double").write.parquet(f"{path}/vectors")
    vectors = spark.read.parquet(f"{path}/vectors")
    vectors.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius")).write.parquet(f"{path}/lists")
    at = [(i, c.tolist()) for i, c in enumerate(centers)]
    spark.createDataFrame(at, "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """At most ``MOST_LISTS`` centroids (or as many as were given) come to the driver."""
    centers = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return Index(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/lists"), np.array([r["centroid"] for r in centers], float))


def _probe(queries: DataFrame, index: Index, probes: int, further: bool) -> DataFrame:
    """(query, vector, list) of the lists that queries look into: the nearest ones, or with ``further`` those beyond
    them that may hold something within ``reach``."""
    centers = index.centroids
    info = {r["list"]: (r["n"], r["radius"]) for r in index.lists.collect()}  # a row a list
    radius = np.array([info.get(i, (0, -np.inf))[1] for i in range(len(centers))])

    def run(batches):
        for b in batches:
            x = _numbers(b.column("vector")) if b.num_rows else np.zeros((0, 0))
            reach = np.array([np.inf if r is None else r for r in b.column("reach").to_pylist()])
            for lo in range(0, len(x), STEP):
                d = _to_lists(x[lo : lo + STEP], centers)
                d[:, np.isinf(radius)] = np.inf  # empty lists
                order = np.argsort(d, axis=1, kind="stable")
                first = np.zeros(d.shape, bool)
                np.put_along_axis(first, order[:, :probes], True, axis=1)
                # a margin for rounding, far below any distance that counts
                wanted = ~first & (d - radius <= reach[lo : lo + STEP, None] + 1e-7 * (1 + d)) if further else first
                q, lists = np.nonzero(wanted & np.isfinite(d))
                yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(q + lo)), b.column("vector").take(pa.array(q + lo)), pa.array(lists, pa.int32())], names=["query", "vector", "list"])

    return queries.select("query", "vector", "reach").mapInArrow(run, "query long, vector array<float>, list int")


def _compare(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """(query, nearest, distance): at least the ``k`` nearest items of each segment that a query was sent to, itself aside."""
    spark = asked.sparkSession
    busy = asked.groupBy("list").agg(F.count("*").alias("asks"))
    plan = index.lists.join(busy, "list").select("list", F.ceil(F.col("n") / SEGMENT).cast("int").alias("segs"), F.ceil(F.col("asks") / QUERY_BLOCK).cast("int").alias("blocks"))
    plan = F.broadcast(plan)  # a row a list
    deal = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None)
    held = index.vectors.join(plan, "list").select("list", deal("vector", F.col("segs")).alias("seg"), every("blocks").alias("block"), F.lit(0).alias("side"), none.cast("long").alias("query"), "vector", "items")
    sent = asked.join(plan, "list").select("list", every("segs").alias("seg"), deal("query", F.col("blocks")).alias("block"), F.lit(1).alias("side"), "query", "vector", none.cast("array<bigint>").alias("items"))
    tile = ["list", "seg", "block"]
    rows = held.unionByName(sent).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *tile).sortWithinPartitions(*tile, "side")

    def nearest(y, items, x, queries):
        """Of each query the entries up to the k-th nearest that holds more than the query itself."""
        first, least = np.array([i[0] for i in items]), np.array([len(i) for i in items])
        alone = least == 1
        squares = (y * y).sum(1)
        out = []
        for lo in range(0, len(x), STEP):
            part = x[lo : lo + STEP]
            near = squares - 2 * (part @ y.T)
            for r, q in enumerate(queries[lo : lo + STEP]):
                row = near[r]
                row[alone & (first == q)] = np.inf
                usable = np.isfinite(row).sum()
                if not usable:
                    continue
                cut = np.partition(row, min(k, usable) - 1)[min(k, usable) - 1]
                slack = 1e-9 * (1 + squares.max() + float(part[r] @ part[r]))
                at = np.flatnonzero(row <= cut + slack)
                away = np.sqrt(((part[r] - y[at]) ** 2).sum(1))
                for i, d in zip(at.tolist(), away.tolist()):
                    out += [(q, item, d) for item in items[i] if item != q]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))] if out else [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query", "nearest", "distance"])

    def run(batches):
        at, y, items = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in (*tile, "side")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                piece, key = b.slice(lo, hi - lo), tuple(keys[lo][:3].tolist())
                if key != at:
                    at, y, items = key, [], []
                if keys[lo][3] == 0:
                    y.append(_numbers(piece.column("vector")))
                    items += piece.column("items").to_pylist()
                elif items:
                    if len(y) > 1:
                        y = [np.concatenate(y)]
                    yield nearest(y[0], items, _numbers(piece.column("vector")), piece.column("query").to_pylist())

    return rows.mapInArrow(run, "query long, nearest long, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "nearest")))
    return ranked.where(F.col("rank") <= k)


def nearest(queries: DataFrame, index: Index, path: str, k: int = 1, probes: int = 8, exact: bool = False) -> DataFrame:
    """query, nearest, distance, rank of the ``k`` nearest items of each query (item, vector), itself aside.

    Ties go to the smaller item.  A query without a vector, or with nothing to
    compare, has no row.  ``path`` is a new folder for intermediate tables.
    """
    if not 0 < k < ITEMS:
        raise ValueError(f"between 1 and {ITEMS - 1} neighbours")
    spark = queries.sparkSession
    asked = queries.where("vector IS NOT NULL").select(F.col("item").alias("query"), F.col("vector").cast("array<float>").alias("vector"), F.lit(None).cast("double").alias("reach"))
    if not len(index.centroids):
        return spark.createDataFrame([], "query long, nearest long, distance double, rank int")

    def written(df, name):
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    first = _best(_compare(written(_probe(asked, index, probes, False), "asked"), index, k), k)
    if not exact or probes >= len(index.centroids):
        return first
    first = written(first, "first")
    reach = first.where(F.col("rank") == k).select("query", F.col("distance").alias("reach"))
    second = _compare(written(_probe(asked.drop("reach").join(reach, "query", "left"), index, probes, True), "asked-further"), index, k)
    return _best(first.drop("rank").unionByName(second), k)


def probes_for(index: Index, queries: DataFrame, path: str, share: float = 0.95, sample: int = 500) -> int:
    """How many lists have to be looked into so that the nearest item of that share of queries is found.

    Measured on at most ``sample`` queries, those of smallest hash: where their
    true neighbours stand, by an exact search.  ``share`` is to lie above the
    recall that is wanted, as a sample only estimates it.
    """
    few = queries.where("vector IS NOT NULL").orderBy(F.xxhash64("item"), "item").limit(sample)
    few.select("item", "vector").write.parquet(f"{path}/sample")
    few = queries.sparkSession.read.parquet(f"{path}/sample")
    true = nearest(few, index, f"{path}/exact", exact=True).select(F.col("query").alias("item"), "nearest")
    where = index.vectors.select("list", F.explode("items").alias("nearest")).join(F.broadcast(true), "nearest").select("item", "list")  # a row a query
    found = few.join(where, "item").select("list", "vector").collect()  # at most ``sample``
    if not found:
        return 1
    d = _to_lists(np.array([r["vector"] for r in found], float), index.centroids)
    filled = np.isin(np.arange(len(index.centroids)), [r["list"] for r in index.lists.select("list").collect()])
    d[:, ~filled] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    ranks = np.sort((order == np.array([[r["list"]] for r in found])).argmax(1))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)]) + 1


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """queries, and the share of the true neighbours (query, distance, rank) whose distance was reached at their rank."""
    got = found.select("query", "rank", F.col("distance").alias("got"))
    hit = (F.col("got") <= F.col("distance") * (1 + 1e-9) + 1e-12).cast("double")
    both = truth.select("query", "rank", "distance").join(got, ["query", "rank"], "left")
    return both.agg(F.count_distinct("query").alias("queries"), F.avg(F.coalesce(hit, F.lit(0.0))).alias("recall"))
