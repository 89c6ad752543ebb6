"""Queries of scoring, evaluation and monitoring over softmax probabilities."""

from pyspark.sql import functions as F

from fieldlab.constants import CLASSES
from fieldlab.operators import controls as K
from fieldlab.operators import dataset as D
from fieldlab.operators import evaluation as E
from fieldlab.operators import monitoring as M
from fieldlab.operators import neighbours as N
from fieldlab.plans.catalogue import _W
from fieldlab.plans.paths import scratch
from fieldlab.sources.standins import PROBABILITIES_SQL, probabilities, records, table

QUERIES, SQL = {}, {}
_P = f"WITH {PROBABILITIES_SQL}"
_NAMES = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
_CELLS = "cells AS (SELECT a.k AS truth, b.k AS predicted, (SELECT count(*) FROM top t WHERE t.truth = a.k AND t.predicted = b.k) AS n FROM (SELECT unnest(range(5)) AS k) a CROSS JOIN (SELECT unnest(range(5)) AS k) b)"
_REPORT = """rep AS (SELECT k AS class, pr AS precision, re AS recall, support, n, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM (
  SELECT truth AS k, n, support, CASE WHEN called = 0 THEN 0 ELSE n::DOUBLE / called END AS pr, CASE WHEN support = 0 THEN 0 ELSE n::DOUBLE / support END AS re
  FROM (SELECT *, sum(n) OVER (PARTITION BY truth) AS support, sum(n) OVER (PARTITION BY predicted) AS called FROM cells) WHERE truth = predicted))"""
_VERDICT = "CASE WHEN top1 - top2 >= 0.15::DOUBLE AND top1 >= 0.5::DOUBLE THEN 'conclusive' WHEN top1 - top2 < 0.15::DOUBLE AND top1 + top2 >= 0.65::DOUBLE THEN 'ambiguous' ELSE 'insufficient' END"
_BINS = "bins AS (SELECT version, CAST(least(9, floor(top1 * 10)) AS INT) AS bin, count(*) AS n, avg(top1) AS confidence, avg((truth = predicted)::INT::DOUBLE) AS accuracy FROM top GROUP BY 1, 2)"
_DEVICE = "'dev-' || (item % 4)"


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def scored(spark, d):
    return E.with_prediction(probabilities(spark, d), CLASSES)


def rounded(df, digits=9):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def log(spark, d):
    """A score log: verdict, quality flags, failure causes and device class of each item."""
    k = F.col("item")
    s = scored(spark, d).withColumn("verdict", E.verdict(F.col("probabilities")))
    cause = F.when(k % 37 == 5, "timeout").when(k % 41 == 6, "decode").when(k % 83 == 7, "gpuLost")
    flags = F.array_compact(F.array(F.when(k % 5 == 0, "contrast"), F.when(k % 7 == 0, "specular")))
    return s.withColumns({"flags": flags, "status": E.outcome_status(F.get("probabilities", 0), cause, k % 97 == 8), "device": F.concat(F.lit("dev-"), k % 4), "blocked": k % 6 == 0})


_STATUS = "CASE WHEN item % 37 = 5 THEN 'failed:timeout' WHEN item % 41 = 6 THEN 'failed:decode' WHEN item % 83 = 7 THEN 'failed:interpreter' WHEN item % 97 = 8 THEN 'rejectedOod' ELSE 'ok' END"


@query("label_from_index", _W + "SELECT id, CASE WHEN id % 7 BETWEEN 0 AND 4 AND id % 3 > 0 THEN " + _NAMES + "[CAST(id % 7 AS INT) + 1] END AS label FROM records")
def _(spark, d):
    k = F.col("id")
    n = F.when(k % 3 > 0, 5).otherwise(4)
    return records(spark, d).select("id", E.label_from_index((k % 7).cast("int"), n, CLASSES).alias("label"))


@query("argmax_label", f"{_P} SELECT item, predicted, {_NAMES}[predicted + 1] AS label, round(top1, 9) AS confidence FROM top")
def _(spark, d):
    return rounded(scored(spark, d).select("item", "predicted", "label", "confidence"))


@query("confusion_matrix", f"{_P}, {_CELLS} SELECT CAST(truth AS INT) AS truth, CAST(predicted AS INT) AS predicted, n FROM cells")
def _(spark, d):
    return E.confusion(scored(spark, d), 5)


@query("classification_report", f"{_P}, {_CELLS}, {_REPORT} SELECT CAST(class AS INT) AS class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM rep")
def _(spark, d):
    return rounded(E.report(E.confusion(scored(spark, d), 5)).select("class", "precision", "recall", "f1", "support"))


@query("accuracy_f1", f"{_P}, {_CELLS}, {_REPORT} SELECT round(sum(n)::DOUBLE / sum(support), 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, CAST(sum(support) AS BIGINT) AS test_size FROM rep")
def _(spark, d):
    return rounded(E.summary(E.report(E.confusion(scored(spark, d), 5))))


@query("probability_ranking", f"{_P} SELECT item, CAST(place AS INT) AS place, CAST(k AS INT) AS class, round(p, 9) AS p FROM ranked")
def _(spark, d):
    r = probabilities(spark, d).select("item", F.posexplode(E.ranking(F.col("probabilities"))).alias("place", "r"))
    return rounded(r.select("item", (F.col("place") + 1).alias("place"), "r.class", "r.p"))


@query("classification_verdict", f"{_P} SELECT item, CASE WHEN item % 53 = 0 THEN 'notAnalysed' ELSE {_VERDICT} END AS verdict FROM top")
def _(spark, d):
    p = F.when(F.col("item") % 53 != 0, F.col("probabilities"))
    return probabilities(spark, d).select("item", E.verdict(p).alias("verdict"))


@query("calibration_ece", f"{_P}, {_BINS} SELECT bin, CAST(sum(n) AS BIGINT) AS n, round(sum(n * confidence) / sum(n), 9) AS confidence, round(sum(n * accuracy) / sum(n), 9) AS accuracy, (SELECT round(sum(m * abs(a - c)) / sum(m), 9) FROM (SELECT sum(n) AS m, sum(n * accuracy) / sum(n) AS a, sum(n * confidence) / sum(n) AS c FROM bins GROUP BY bin)) AS ece FROM bins GROUP BY bin")
def _(spark, d):
    table_ = E.reliability(scored(spark, d))
    return rounded(table_.join(E.calibration_error(table_), F.lit(True)))


_T = [0.2, 0.4, 0.5, 0.6, 0.8, 0.95]


@query("coverage_curve", f"{_P}, t AS (SELECT unnest({_T})::DOUBLE AS threshold) SELECT threshold, round(avg((top1 >= threshold)::INT::DOUBLE), 9) AS coverage, round(1 - avg((top1 >= threshold)::INT::DOUBLE), 9) AS rejection, round(avg((truth = predicted)::INT::DOUBLE) FILTER (WHERE top1 >= threshold), 9) AS accuracy FROM top CROSS JOIN t GROUP BY 1")
def _(spark, d):
    return rounded(E.coverage(scored(spark, d), _T))


@query("cost_weighted_confusion", f"{_P}, {_CELLS} SELECT CAST(sum(n * abs(truth - predicted)) AS DOUBLE) AS total_cost, round(sum(n * abs(truth - predicted))::DOUBLE / sum(n), 9) AS mean_cost FROM cells")
def _(spark, d):
    costs = spark.createDataFrame([(a, b, float(abs(a - b))) for a in range(5) for b in range(5)], "truth int, predicted int, cost double")
    return rounded(E.weighted_cost(E.confusion(scored(spark, d), 5), costs))


@query("confidence_percentiles", f"{_P} SELECT version, round(quantile_cont(top1, 0.05), 9) AS p5, round(quantile_cont(top1, 0.5), 9) AS p50, round(quantile_cont(top1, 0.95), 9) AS p95 FROM top GROUP BY 1")
def _(spark, d):
    return rounded(E.percentiles(scored(spark, d), "confidence", [0.05, 0.5, 0.95], ["version"]))


_CLASSIFIED = "SELECT version, 'class' AS kind, " + _NAMES + "[predicted + 1] AS value FROM top"


@query("monitoring_counters", f"""{_P}, facts AS ({_CLASSIFIED} UNION ALL SELECT version, 'verdict', {_VERDICT} FROM top UNION ALL SELECT version, 'cause', split_part({_STATUS}, ':', 2) FROM top WHERE {_STATUS} LIKE 'failed:%'
  UNION ALL SELECT version, 'flag', 'contrast' FROM top WHERE item % 5 = 0 UNION ALL SELECT version, 'flag', 'specular' FROM top WHERE item % 7 = 0) SELECT version, kind, value, count(*) AS n FROM facts GROUP BY 1, 2, 3""")
def _(spark, d):
    return M.counters(log(spark, d))


@query("monitoring_counters_stream", SQL["monitoring_counters"])
def _(spark, d):
    """The same counters kept by a streaming aggregate over the log as it grows."""
    root = scratch(spark, "score-log")
    rows = log(spark, d).select("version", "item", "label", "verdict", "flags", "status")
    rows.repartitionByRange(3, "item").write.parquet(f"{root}/log")
    grows = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    name = f"counters_{root[-8:]}"
    M.follow_counters(grows, name, f"{root}/checkpoint").awaitTermination()
    return spark.table(name)


@query("drift_compare", f"""{_P}, dealt AS (SELECT *, CASE WHEN version = 1 AND item % 20 = 1 THEN 'dev-new' ELSE {_DEVICE.replace('% 4', '// 2 % 4')} END AS dev FROM top),
  r AS (SELECT version, dev AS device, avg(({_VERDICT} = 'ambiguous')::INT::DOUBLE) AS a, avg(({_VERDICT} = 'insufficient')::INT::DOUBLE) AS i, avg((item % 6 = 0)::INT::DOUBLE) AS b FROM dealt GROUP BY 1, 2)
  SELECT coalesce(x.device, y.device) AS device, round(y.a - x.a, 9) AS ambiguous_delta, round(y.i - x.i, 9) AS insufficient_delta, round(y.b - x.b, 9) AS blocked_delta, CASE WHEN y.device IS NULL THEN 0 WHEN x.device IS NULL THEN 1 END AS only_in
  FROM (SELECT * FROM r WHERE version = 0) x FULL JOIN (SELECT * FROM r WHERE version = 1) y USING (device)""")
def _(spark, d):
    new = (F.col("version") == 1) & (F.col("item") % 20 == 1)
    of = log(spark, d).withColumn("device", F.when(new, "dev-new").otherwise(F.concat(F.lit("dev-"), F.floor(F.col("item") / 2) % 4)))
    return rounded(M.drift(of, 0, 1))


@query("model_parity", f"""{_P}, b AS (SELECT a.item, a.truth, n.predicted, n.top1 FROM top a JOIN top n ON n.item = CASE WHEN a.item % 2 = 0 THEN a.item + 1 ELSE a.item - 1 END WHERE a.item % 30 <> 4),
  ea AS (SELECT sum(n * abs(accuracy - confidence)) / sum(n) AS e FROM (SELECT count(*) AS n, avg(top1) AS confidence, avg((truth = predicted)::INT::DOUBLE) AS accuracy FROM top WHERE item IN (SELECT item FROM b) GROUP BY least(9, floor(top1 * 10)))),
  eb AS (SELECT sum(n * abs(accuracy - confidence)) / sum(n) AS e FROM (SELECT count(*) AS n, avg(top1) AS confidence, avg((truth = predicted)::INT::DOUBLE) AS accuracy FROM b GROUP BY least(9, floor(top1 * 10))))
  SELECT count(*) AS items, (SELECT count(*) FROM top WHERE item NOT IN (SELECT item FROM b)) AS only_a, 0 AS only_b, round(avg((a.predicted = b.predicted)::INT::DOUBLE), 9) AS agreement, round(avg((b.truth = b.predicted)::INT::DOUBLE) - avg((a.truth = a.predicted)::INT::DOUBLE), 9) AS accuracy_delta, round((SELECT e FROM eb) - (SELECT e FROM ea), 9) AS ece_delta FROM top a JOIN b USING (item)""")
def _(spark, d):
    a = scored(spark, d).select("item", "truth", "predicted", "confidence")
    partner = F.when(F.col("item") % 2 == 0, F.col("item") + 1).otherwise(F.col("item") - 1)
    b = a.select(partner.alias("item"), "predicted", "confidence").join(a.select("item", "truth"), "item")
    return rounded(E.parity(a, b.where("item % 30 <> 4")))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))


@query("nearest_real_distance", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id AS item, b.vec_id AS nearest, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])))) AS distance
    FROM v a CROSS JOIN v b WHERE a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0)
  SELECT item, round(min(distance), 6) AS distance, min(distance) < 0.3::DOUBLE AS near_duplicate FROM d GROUP BY item""")
def _(spark, d):
    e, root = _vectors(spark, d), scratch(spark, "neighbours")
    index = N.write_index(e.where("item % 10 <> 0"), f"{root}/index")
    n = N.nearest(e.where("item % 10 = 0"), index, f"{root}/work", exact=True)
    return n.select(F.col("query").alias("item"), F.round("distance", 6).alias("distance"), (F.col("distance") < 0.3).alias("near_duplicate"))


@query("nearest_index_recall", "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def _(spark, d):
    """The index against an exact search: every row divisible by 50 against all others, with as many probes as 95 % of a sample need."""
    e, root = _vectors(spark, d), scratch(spark, "neighbours")
    lists = max(2, round(e.count() ** 0.5))  # the rule for large tables, at any size
    index, asked = N.write_index(e, f"{root}/index", N.fit_centroids(e, lists)), e.where("item % 50 = 0")
    found = N.nearest(asked, index, f"{root}/few", probes=N.probes_for(index, asked, f"{root}/probes"))
    r = N.recall(found, N.nearest(asked, index, f"{root}/exact", exact=True))
    return r.select("queries", (F.col("recall") >= 0.9).alias("reached"))


@query("latency_percentiles", "SELECT event_type AS stage, round(quantile_cont(value * 3, 0.5), 6) AS p50, round(quantile_cont(value * 3, 0.95), 6) AS p95, round(quantile_cont(value * 3, 0.99), 6) AS p99 FROM events GROUP BY 1")
def _(spark, d):
    """Exact percentiles of how long each stage took (milliseconds), beside those of confidence."""
    took = table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("value") * 3).alias("took_ms"))
    return rounded(E.percentiles(took, "took_ms", [0.5, 0.95, 0.99], ["stage"]), 6)


@query("temperature_scaling", f"""{_P}, t AS (SELECT unnest([0.5, 0.75, 1.0, 1.5, 2.0])::DOUBLE AS t)
  SELECT t, round(sum(-ln(pow(p[truth + 1], 1 / t) / (pow(p[1], 1 / t) + pow(p[2], 1 / t) + pow(p[3], 1 / t) + pow(p[4], 1 / t) + pow(p[5], 1 / t)))), 5) AS loss FROM probs CROSS JOIN t GROUP BY 1""")
def _(spark, d):
    return rounded(E.temperature_loss(probabilities(spark, d), [0.5, 0.75, 1.0, 1.5, 2.0]), 5)


@query("fit_temperature")
def _(spark, d):
    p = probabilities(spark, d)
    best = E.fit_temperature(p)
    return p.agg(F.count("*").alias("items"), F.lit(best).alias("temperature"))


@query("per_class_thresholds", f"{_P} SELECT predicted, count(*) AS n, round(quantile_cont(top1, 0.2), 9) AS top1_threshold, round(quantile_cont(top1 - top2, 0.2), 9) AS margin_threshold, round((SELECT quantile_cont(top1, 0.2) FROM top), 9) AS global_threshold FROM top GROUP BY 1")
def _(spark, d):
    r = E.ranking(F.col("probabilities"))
    s = scored(spark, d).withColumn("margin", F.get(r, 0)["p"] - F.get(r, 1)["p"])
    return rounded(E.thresholds_by_class(s))


@query("thresholds_at_equal_coverage", f"""{_P}, own AS (SELECT predicted, quantile_cont(top1, 0.2) AS a, quantile_cont(top1 - top2, 0.2) AS b FROM top GROUP BY 1),
  r AS (SELECT truth = predicted AS hit, unnest(['top1', 'margin', 'global']) AS rule, unnest([top1 >= a, top1 - top2 >= b, top1 >= (SELECT quantile_cont(top1, 0.2) FROM top)]) AS taken FROM top JOIN own USING (predicted))
  SELECT rule, round(avg(taken::INT::DOUBLE), 9) AS coverage, round(avg(hit::INT::DOUBLE) FILTER (WHERE taken), 9) AS accuracy FROM r GROUP BY rule""")
def _(spark, d):
    r = E.ranking(F.col("probabilities"))
    s = scored(spark, d).withColumn("margin", F.get(r, 0)["p"] - F.get(r, 1)["p"])
    return rounded(E.compare_thresholds(s, E.thresholds_by_class(s)))


@query("outcome_status", f"{_P} SELECT item, {_STATUS} AS status FROM top")
def _(spark, d):
    return log(spark, d).select("item", "status")


def _model(spark, d):
    from fieldlab.operators.dataset import class_weights

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "embedding", (F.col("label") % 5).cast("double").alias("label"))
    train = e.where("item % 4 <> 3")
    w = class_weights(train.select(F.col("label").cast("int").cast("string").alias("texture_class")), [str(k) for k in range(5)])
    w = w.select(F.col("texture_class").cast("double").alias("label"), "weight")
    return E.train_classifier(train, "embedding", "label", w, iterations=20), e


@query("train_classifier")
def _(spark, d):
    model, e = _model(spark, d)
    s = E.batch_score(model, e.where("item % 4 = 3"), "embedding").select(F.col("label").cast("int").alias("truth"), "probabilities")
    return rounded(E.summary(E.report(E.confusion(E.with_prediction(s, CLASSES), 5))), 6)


@query("batch_score")
def _(spark, d):
    model, e = _model(spark, d)
    return E.with_prediction(E.batch_score(model, e, "embedding"), CLASSES).select("item", "predicted", "label", F.round("confidence", 6).alias("confidence"))


@query("control_arms_trained")
def _(spark, d):
    """Held-out accuracy of models trained on real and on shuffled labels, five seeds each, all in one fit."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("int").alias("truth"))
    runs = K.train_arms(rows, "vector", "item", "truth", 10, [1, 2, 3, 4, 5], scratch(spark, "arms"), iterations=25, tolerance=1e-3)
    return rounded(D.compare_arms(runs), 6)
