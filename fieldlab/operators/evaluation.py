"""Scoring and evaluation of classifiers from probability arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CAUSES = ("modelAbsent", "emptyAsset", "decode", "timeout", "interpreter", "workerDeath")


def label_from_index(index: Column, n: Column, labels: tuple[str, ...]) -> Column:
    """The class at an index; null unless there are as many classes as labels and the index is one of them."""
    return F.when((n == len(labels)) & (index >= 0), F.get(F.array(*map(F.lit, labels)), index))


def argmax(p: Column) -> Column:
    """0-based place of the largest number, the first of equals; NaN never wins, null for an empty array."""
    best = F.array_max(F.filter(p, lambda v: ~F.isnan(v)))
    return F.when(best.isNotNull(), (F.array_position(p, best) - 1).cast("int"))


def with_prediction(scores: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """predicted (index), label and confidence of each ``probabilities``; null for a wrong number of classes."""
    p = F.col("probabilities")
    out = scores.withColumn("predicted", F.when(F.size(p) == len(labels), argmax(p)))
    return out.withColumns({"label": label_from_index(F.col("predicted"), F.size(p), labels), "confidence": F.get(p, F.col("predicted"))})


def confusion(scored: DataFrame, k: int) -> DataFrame:
    """All k x k cells: truth, predicted, n; rows without a prediction stand in cells of predicted -1, so none is lost.

    Rows whose truth is no class are not counted.
    """
    axis = scored.sparkSession.range(k)
    cells = axis.select(F.col("id").cast("int").alias("truth")).join(axis.select(F.col("id").cast("int").alias("predicted")), F.lit(True))  # k * k rows
    called = F.when(F.col("predicted").between(0, k - 1), F.col("predicted")).otherwise(-1).cast("int")
    n = scored.groupBy("truth", called.alias("predicted")).agg(F.count("*").alias("n"))
    found = n.where(F.col("truth").between(0, k - 1)).select(F.col("truth").cast("int").alias("truth"), "predicted", "n")
    return cells.withColumn("n", F.lit(0).cast("long")).unionByName(found).groupBy("truth", "predicted").agg(F.sum("n").alias("n"))


def report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where nothing is to divide by.

    Rows without a prediction count in the support, as misses."""
    mine, other = Window.partitionBy("truth"), Window.partitionBy("predicted")
    d = cells.withColumns({"support": F.sum("n").over(mine), "called": F.sum("n").over(other)}).where("truth = predicted")
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    d = d.select(F.col("truth").alias("class"), ratio(F.col("n"), F.col("called")).alias("precision"), ratio(F.col("n"), F.col("support")).alias("recall"), "support", "n")
    # the called count of a class stands in its own column of the matrix
    return d.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(rep: DataFrame) -> DataFrame:
    """Accuracy, F1 over all classes evenly, F1 by support, and the number of rows."""
    return rep.agg(F.try_divide(F.sum("n"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.sum("support").alias("test_size"))


def ranking(p: Column) -> Column:
    """All classes as (class, p), the likeliest first, equals in class order; never renormalised."""
    pairs = F.transform(p, lambda v, i: F.struct((-v).alias("minus"), i.cast("int").alias("class")))
    return F.transform(F.array_sort(pairs), lambda s: F.struct(s["class"].alias("class"), (-s["minus"]).alias("p")))


def verdict(p: Column, margin: float = 0.15, alone: float = 0.50, together: float = 0.65) -> Column:
    """conclusive, ambiguous, insufficient, or notAnalysed for null."""
    r = ranking(p)
    a, b = F.get(r, 0)["p"], F.get(r, 1)["p"]
    return F.when(p.isNull(), "notAnalysed").when((a - b >= margin) & (a >= alone), "conclusive").when((a - b < margin) & (a + b >= together), "ambiguous").otherwise("insufficient")


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Bin, rows, mean confidence and accuracy (truth, predicted, confidence)."""
    at = F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)).cast("int")
    hit = (F.col("truth") == F.col("predicted")).cast("double")
    return scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(hit).alias("accuracy"))


def calibration_error(table: DataFrame) -> DataFrame:
    return table.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))), F.sum("n")).alias("ece"))


def coverage(scored: DataFrame, thresholds: list[float], by: list[str] = []) -> DataFrame:
    """Coverage, rejection and accuracy among the accepted at each threshold.

    Each row goes to the highest threshold that it passes; running sums over
    the thresholds follow, so rows are read once however many there are.
    """
    t = sorted(thresholds)
    passed = sum(((F.col("confidence") >= x).cast("int") for x in t), F.lit(0))
    n = scored.groupBy(*by, passed.alias("passed")).agg(F.count("*").alias("n"), F.sum((F.col("truth") == F.col("predicted")).cast("long")).alias("right"))
    grid = scored.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(t)], "k int, threshold double")
    rows = n.join(F.broadcast(grid), F.lit(True))  # one row a threshold, on sums
    total, ok = F.sum("n"), F.col("passed") >= F.col("k")
    taken, right = F.sum(F.when(ok, F.col("n")).otherwise(0)), F.sum(F.when(ok, F.col("right")).otherwise(0))
    return rows.groupBy(*by, "threshold").agg((taken / total).alias("coverage"), (1 - taken / total).alias("rejection"), F.when(taken > 0, right / taken).alias("accuracy"))


def weighted_cost(cells: DataFrame, costs: DataFrame) -> DataFrame:
    """Total and mean cost of a confusion under a cost matrix (truth, predicted, cost)."""
    return cells.join(costs, ["truth", "predicted"]).agg(F.sum(F.col("n") * F.col("cost")).alias("total_cost"), F.try_divide(F.sum(F.col("n") * F.col("cost")), F.sum("n")).alias("mean_cost"))


def percentiles(rows: DataFrame, column: str, at: list[float], by: list[str] = [], cuts: int = 256) -> DataFrame:
    """Exact percentiles of each group, interpolated between neighbours; null values are passed over.

    Approximate quantiles cut each group's values into ranges; counts of the
    ranges say in which the wanted ranks lie, and only those ranges are summed
    up value by value.  So no task holds the values of a group, however hot.
    """
    rows = rows.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("__v"))
    group = [F.col(c) for c in by]
    bounds = rows.groupBy(*group).agg(F.percentile_approx("__v", [i / cuts for i in range(1, cuts)], 20 * cuts).alias("__bounds"))
    cut = F.size(F.filter("__bounds", lambda b: b < F.col("__v")))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by] or [F.lit(True)]
    every = lambda tests: reduce(Column.__and__, tests)
    alone = lambda df: df if by else F.broadcast(df)  # one row where there is one group
    counted = rows.groupBy(*group, "__v").agg(F.count("*").alias("__c"))
    cells = counted.alias("r").join(alone(bounds.alias("b")), every(same("r", "b"))).select("r.*", cut.alias("__cut"))
    sizes = cells.groupBy(*group, "__cut").agg(F.sum("__c").alias("__m"))
    upto = Window.partitionBy(*group).orderBy("__cut")  # at most ``cuts`` rows a group
    sizes = sizes.withColumns({"__before": F.sum("__m").over(upto) - F.col("__m"), "__n": F.sum("__m").over(Window.partitionBy(*group))})
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("__n") - 1) * q), F.ceil((F.col("__n") - 1) * q)) for q in at))))
    wanted = sizes.withColumn("__ranks", F.filter(ranks, lambda k: (k >= F.col("__before")) & (k < F.col("__before") + F.col("__m")))).where(F.size("__ranks") > 0)
    near = cells.alias("r").join(alone(wanted.alias("w")), every([*same("r", "w"), F.col("r.__cut") == F.col("w.__cut")])).select("r.*", "w.__before", "w.__n", "w.__ranks")
    inside = Window.partitionBy(*group, "__cut").orderBy("__v")
    near = near.withColumn("__upto", F.col("__before") + F.sum("__c").over(inside))
    hit = near.withColumn("__rank", F.explode(F.filter("__ranks", lambda k: (k < F.col("__upto")) & (k >= F.col("__upto") - F.col("__c")))))
    found = hit.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"), F.first("__n").alias("__n"))

    def value(q):
        place = (F.col("__n") - 1) * q
        low, high = F.element_at("__at", F.floor(place)), F.element_at("__at", F.ceil(place))
        return low + (high - low) * (place - F.floor(place))

    return found.select(*group, *(value(q).alias(f"p{q * 100:g}") for q in at))


def parity(a: DataFrame, b: DataFrame, bins: int = 10) -> DataFrame:
    """Two models on the same items (item, truth, predicted, confidence): agreement, accuracy and calibration deltas.

    All are over the items that both have; ``only_a`` and ``only_b`` count the
    others, which a comparison must not pass over in silence.
    """
    pairs = a.select("item", F.lit(1).alias("in_a"), *(F.col(c).alias(f"{c}_a") for c in ("truth", "predicted", "confidence"))).join(
        b.select("item", F.lit(1).alias("in_b"), *(F.col(c).alias(f"{c}_b") for c in ("truth", "predicted", "confidence"))), "item", "full"
    )
    both = pairs.where("in_a = 1 AND in_b = 1")
    counts = pairs.agg(
        F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1)).alias("items"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"),
        F.avg(F.when((F.col("in_a") == 1) & (F.col("in_b") == 1), (F.col("predicted_a") == F.col("predicted_b")).cast("double"))).alias("agreement"),
    )

    def one(n):
        x = both.select(*(F.col(f"{c}_{n}").alias(c) for c in ("truth", "predicted", "confidence")))
        right = x.agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias(f"accuracy_{n}"))
        return right.join(calibration_error(reliability(x, bins)).select(F.col("ece").alias(f"ece_{n}")), F.lit(True))

    out = counts.join(one("a"), F.lit(True)).join(one("b"), F.lit(True))  # one row each
    return out.select("items", "only_a", "only_b", "agreement", (F.col("accuracy_b") - F.col("accuracy_a")).alias("accuracy_delta"), (F.col("ece_b") - F.col("ece_a")).alias("ece_delta"))


def temperature_loss(scored: DataFrame, temperatures: list[float]) -> DataFrame:
    """Sum of -ln p(truth) at each temperature; logits are ln(p), so p becomes p^(1/T) over its sum."""
    p, t = F.col("probabilities"), F.explode(F.array(*(F.lit(float(x)) for x in temperatures))).alias("t")
    rows = scored.select(p, "truth", t)
    power = F.transform("probabilities", lambda v: F.pow(v, 1 / F.col("t")))
    total = F.aggregate(power, F.lit(0.0), lambda a, v: a + v)
    return rows.groupBy("t").agg(F.sum(-F.ln(F.get(power, F.col("truth")) / total)).alias("loss"))


def fit_temperature(validation: DataFrame, low: float = 0.25, high: float = 4.0, rounds: int = 3, steps: int = 16) -> float:
    """The temperature of least loss by a grid that narrows around its best point; a row a step comes to the driver."""
    best = 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / steps for i in range(steps + 1)]
        found = temperature_loss(validation, grid).orderBy("loss", "t").first()
        if found is None:
            return 1.0
        best, width = found["t"], (high - low) / steps
        low, high = max(0.05, best - width), best + width
    return best


def thresholds_by_class(scored: DataFrame, accept: float = 0.8) -> DataFrame:
    """For each predicted class the confidence and the margin that the share ``accept`` of its rows reach,
    beside the one confidence that the same share of all rows reach."""
    q = 1 - accept
    name = f"p{q * 100:g}"
    whole = percentiles(scored, "confidence", [q]).select(F.col(name).alias("global_threshold"))
    top1, margin = (percentiles(scored, c, [q], ["predicted"]).select("predicted", F.col(name).alias(f"{a}_threshold")) for c, a in (("confidence", "top1"), ("margin", "margin")))
    own = scored.groupBy("predicted").agg(F.count("*").alias("n")).join(top1, "predicted").join(margin, "predicted")
    return own.join(whole, F.lit(True))  # one row


def compare_thresholds(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Coverage and accuracy among the accepted under each rule (top1, margin, global) of thresholds_by_class,
    which all accept the same share of rows, up to ties."""
    rows = scored.join(F.broadcast(thresholds.drop("n")), "predicted")  # one row a class
    rules = {"top1": "confidence >= top1_threshold", "margin": "margin >= margin_threshold", "global": "confidence >= global_threshold"}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.expr(v).alias("taken")) for k, v in rules.items()))).alias("r")
    hit = (F.col("truth") == F.col("predicted")).cast("double")
    return rows.select(hit.alias("hit"), each).groupBy("r.rule").agg(F.avg(F.col("r.taken").cast("double")).alias("coverage"), F.avg(F.when(F.col("r.taken"), F.col("hit"))).alias("accuracy"))


def outcome_status(score: Column, cause: Column, ood: Column) -> Column:
    """ok, rejectedOod or failed(cause); an unknown cause is an interpreter failure."""
    named = F.when(cause.isin(*CAUSES), cause).otherwise("interpreter")
    return F.when(cause.isNotNull(), F.concat(F.lit("failed:"), named)).when(F.coalesce(ood, F.lit(False)), "rejectedOod").when(score.isNotNull(), "ok").otherwise("failed:interpreter")


def train_classifier(train: DataFrame, features: str, label: str, weights: DataFrame | None = None, iterations: int = 50):
    """Multinomial logistic regression over array<float> features, rows weighted by class (label, weight)."""
    rows = train.withColumn("vector", array_to_vector(F.col(features).cast("array<double>")))
    # a row of a class without a weight counts once
    rows = rows.join(F.broadcast(weights), label, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))) if weights is not None else rows.withColumn("weight", F.lit(1.0))  # one row a class
    model = LogisticRegression(featuresCol="vector", labelCol=label, weightCol="weight", family="multinomial", maxIter=iterations, regParam=1e-3)
    return Pipeline(stages=[model]).fit(rows)


def batch_score(model, rows: DataFrame, features: str) -> DataFrame:
    """``rows`` with the model's ``probabilities``."""
    out = model.transform(rows.withColumn("vector", array_to_vector(F.col(features).cast("array<double>"))))
    return out.withColumn("probabilities", vector_to_array("probability")).drop("vector", "rawPrediction", "probability", "prediction")


def score_with(rows: DataFrame, columns: list[str], predict, keep: list[str]) -> DataFrame:
    """``probabilities`` by a user's function from a pandas frame to a list of number lists, in Arrow batches."""

    def run(frames):
        for f in frames:
            out = f[keep].copy()
            out["probabilities"] = list(predict(f[columns]))
            yield out

    schema = rows.select(*keep).schema.add("probabilities", T.ArrayType(T.DoubleType()))
    return rows.select(*dict.fromkeys([*keep, *columns])).mapInPandas(run, schema)


def nearest_real(synthetic: DataFrame, real: DataFrame, block: int = 4096) -> DataFrame:
    """Each synthetic item's nearest real item (item, vector): exact, by blocks of the synthetic side.

    The nearest is found block against block by the scalar products of a matrix
    multiplication, and its distance then taken from the vectors; one row for
    each item and pair of blocks comes out, so no pair of items becomes a row.
    A pair of blocks is a task's unit; neither side is held whole.
    """
    import numpy as np
    import pyarrow as pa

    spark = synthetic.sparkSession
    n, m = synthetic.count(), real.count()
    rows, cols = max(1, -(-n // block)), max(1, -(-m // block))
    deal = lambda x, k: F.pmod(F.xxhash64("item"), F.lit(k)).cast("int")
    a = synthetic.select(deal("item", rows).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("j"), F.lit(0).alias("side"), "item", F.col("vector").cast("array<double>").alias("vector"))
    b = real.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"), deal("item", cols).alias("j"), F.lit(1).alias("side"), "item", F.col("vector").cast("array<double>").alias("vector"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = a.unionByName(b).repartition(parts, "i", "j").sortWithinPartitions("i", "j", "side")

    def nearest(batches):
        tile, held = None, ([], [], [], [])

        def best():
            x, y = np.array(held[1]), np.array(held[3])
            ids = np.array(held[2])
            order = np.argsort(ids, kind="stable")
            y, ids = y[order], ids[order]
            squares, items, near, far = (y * y).sum(axis=1), [], [], []
            for lo in range(0, len(x), 512):  # a step holds 512 x block numbers
                part = x[lo : lo + 512]
                k = (squares - 2 * (part @ y.T)).argmin(axis=1)
                items += held[0][lo : lo + 512]
                near += ids[k].tolist()
                far += np.sqrt(((part - y[k]) ** 2).sum(axis=1)).tolist()
            return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(near, pa.int64()), pa.array(far, pa.float64())], names=["item", "nearest", "distance"])

        for batch in batches:
            for i, j, side, item, v in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "side", "item", "vector"))):
                if (i, j) != tile:
                    if held[0] and held[2]:
                        yield best()
                    tile, held = (i, j), ([], [], [], [])
                held[2 * side].append(item)
                held[2 * side + 1].append(v)
        if held[0] and held[2]:
            yield best()

    found = both.mapInArrow(nearest, "item long, nearest long, distance double")
    return found.groupBy("item").agg(F.min(F.struct("distance", "nearest")).alias("n")).select("item", "n.nearest", "n.distance")
