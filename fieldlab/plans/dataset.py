"""Queries over the dataset inventory, splits and manifests."""

from pyspark.sql import functions as F

from fieldlab.constants import CLASSES as LABELS
from fieldlab.operators import dataset as D
from fieldlab.operators import evaluation as E
from fieldlab.operators import quality as Q
from fieldlab.plans.paths import scratch
from fieldlab.plans.quality import _SHOTS, AUDIT, BLUR, LEAST, shots
from fieldlab.sources import manifests as M
from fieldlab.sources.standins import MANIFEST_SQL, PROBABILITIES_SQL, manifest, photos, probabilities, table

QUERIES, SQL = {}, {}
CLASSES = ["de", "en", "es", "fr"]
_W = f"WITH {MANIFEST_SQL} "
_GROUP = "texture_class || '::' || sample_id"
_SPLIT = f"""{_W}, groups AS (SELECT DISTINCT texture_class, {_GROUP} AS sample_group FROM manifest),
placed AS (SELECT *, row_number() OVER (PARTITION BY texture_class ORDER BY sha256('42|' || sample_group), sample_group) AS place, count(*) OVER (PARTITION BY texture_class) AS n FROM groups),
named AS (SELECT sample_group, CASE WHEN place <= greatest(1, round(n * 0.15::DOUBLE)) THEN 'test' WHEN place <= greatest(1, round(n * 0.15::DOUBLE)) * 2 THEN 'val' ELSE 'train' END AS split FROM placed),
split AS (SELECT m.*, {_GROUP} AS sample_group, split FROM manifest m JOIN named USING (sample_group))""".replace("JOIN named USING (sample_group)", f"JOIN named ON named.sample_group = {_GROUP}")


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def split(spark, d):
    return D.split_groups(manifest(spark, d))


@query("scan_image_folders", _W + "SELECT texture_class, count(*) AS images FROM manifest WHERE texture_class IN ('de', 'en', 'es') GROUP BY 1 UNION ALL SELECT 'it', 0")
def _(spark, d):
    images, missing = D.scan_folders(manifest(spark, d), ["de", "en", "es", "it"])
    return images.groupBy("texture_class").agg(F.count("*").alias("images")).unionByName(missing.select("texture_class", F.lit(0).cast("long").alias("images")))


@query("sample_group_key", _W + f"SELECT photo, {_GROUP} AS sample_group FROM manifest")
def _(spark, d):
    return D.with_groups(manifest(spark, d)).select("photo", "sample_group")


@query("group_counts_per_class", _W + f"SELECT texture_class, count(DISTINCT {_GROUP}) AS samples, count(DISTINCT {_GROUP}) >= 3 AS enough FROM manifest GROUP BY 1")
def _(spark, d):
    return D.group_counts(manifest(spark, d))


@query("group_stratified_split", _SPLIT + " SELECT photo, sample_group, split FROM split")
def _(spark, d):
    return split(spark, d).select("photo", "sample_group", "split")


@query("split_counts", _SPLIT + " SELECT split, count(*) AS images FROM split GROUP BY 1")
def _(spark, d):
    return D.split_counts(split(spark, d))


@query("split_leakage", _SPLIT + """, moved AS (SELECT sample_group, CASE WHEN photo % 10 = 0 THEN 'val' ELSE split END AS split FROM split), w AS (SELECT DISTINCT * FROM moved)
  SELECT a.sample_group, a.split AS split_a, b.split AS split_b FROM w a JOIN w b USING (sample_group) WHERE list_position(['train', 'val', 'test'], a.split) < list_position(['train', 'val', 'test'], b.split)""")
def _(spark, d):
    moved = split(spark, d).withColumn("split", F.when(F.col("photo") % 10 == 0, "val").otherwise(F.col("split")))
    return D.leakage(moved)


@query("class_weights", _SPLIT + """, n AS (SELECT texture_class, count(*) AS n FROM split WHERE split = 'train' GROUP BY 1), k AS (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS texture_class)
  SELECT k.texture_class, round(CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE (SELECT sum(n) FROM n)::DOUBLE / (5 * n) END, 9) AS weight FROM k LEFT JOIN n USING (texture_class)""")
def _(spark, d):
    w = D.class_weights(split(spark, d).where("split = 'train'"), [*CLASSES, "it"])
    return w.select("texture_class", F.round("weight", 9).alias("weight"))


@query("write_split_manifest", _SPLIT + " SELECT photo, sample_group, split FROM split")
def _(spark, d):
    path = scratch(spark, "split")
    M.write_split(split(spark, d).select("photo", "sample_group", "split"), path, 42, 0.15, 0.15, CLASSES)
    return M.load_split(spark, path)[0].select("photo", "sample_group", "split")


@query("load_split_manifest", _SPLIT + " SELECT split, count(*) AS images, '42' AS seed, 'de,en,es,fr' AS classes FROM split GROUP BY 1")
def _(spark, d):
    path = scratch(spark, "split")
    M.write_split(split(spark, d).select("photo", "sample_group", "split"), path, 42, 0.15, 0.15, CLASSES)
    rows, settings = M.load_split(spark, path)
    one = settings.groupBy().pivot("name", ["seed", "classes"]).agg(F.first("value"))
    return D.split_counts(rows).crossJoin(F.broadcast(one))  # one row


@query("split_contract_check", "SELECT 'classes' AS name, string_agg(DISTINCT lang, ',' ORDER BY lang) AS stored, 'de,en,es,fr,it' AS active FROM documents UNION ALL SELECT 'seed', '42', '7'")
def _(spark, d):
    classes = manifest(spark, d).agg(F.array_join(F.array_sort(F.collect_set("texture_class")), ",").alias("value")).select(F.lit("classes").alias("name"), "value")
    stored = classes.unionByName(spark.createDataFrame([("seed", "42"), ("test", "0.15")], "name string, value string"))
    active = spark.createDataFrame([("classes", "de,en,es,fr,it"), ("seed", "7"), ("val", "0.2"), ("test", "0.15")], "name string, value string")
    return D.contract_violations(stored, active)


@query("write_run_artifacts", f"""WITH {PROBABILITIES_SQL}
  SELECT version::VARCHAR AS version, round(avg((truth = predicted)::INT::DOUBLE), 9) AS accuracy, count(*) AS test_size, count(*) FILTER (WHERE truth = 0 AND predicted = 1) AS zero_as_one, 'again' AS note, 2 AS epochs FROM top GROUP BY version""")
def _(spark, d):
    path = scratch(spark, "runs")
    rows = E.with_prediction(probabilities(spark, d), LABELS)
    for note in ("once", "again"):  # the second write replaces the first
        for v in (0, 1):
            M.write_run(M.run_artifacts(v, rows.where(F.col("version") == v), LABELS, {"note": note}, None, [(1, 0, "loss", 1.0), (1, 1, "loss", 0.5)]), path)
    steps = M.concat_history(M.run_history(spark, path)).groupBy("version").agg(F.max("step").alias("epochs"))
    runs = spark.read.parquet(path).withColumn("version", F.col("version").cast("string"))
    told = runs.select("version", F.round("metrics.accuracy", 9).alias("accuracy"), "metrics.test_size", F.col("metrics.confusion")[0][1].alias("zero_as_one"), F.col("config")["note"].alias("note"))
    return told.join(steps, "version")


@query("concat_history", """WITH h AS (SELECT user_id % 5 AS version, CASE WHEN event_id % 3 > 0 THEN 1 ELSE 2 END AS phase, event_id AS epoch,
    event_type || CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN '_late' ELSE '' END AS metric, value FROM events)
  SELECT version, metric, phase, epoch, CAST(row_number() OVER (PARTITION BY version, metric ORDER BY phase, epoch) AS INT) AS step FROM h
  WHERE (version, metric) IN (SELECT (version, metric) FROM h WHERE phase = 1)""")
def _(spark, d):
    k = F.col("event_id")
    late = F.when((k % 3 == 0) & (k % 2 == 0), "_late").otherwise("")
    h = table(spark, d, "events").select((F.col("user_id") % 5).alias("version"), F.when(k % 3 > 0, 1).otherwise(2).alias("phase"), k.alias("epoch"), F.concat("event_type", late).alias("metric"), "value")
    return M.concat_history(h).select("version", "metric", "phase", "epoch", "step")


@query("manifest_validate", _W + """SELECT 'missing_column' AS problem, unnest(['image', 'captured_at']) AS subject UNION ALL SELECT DISTINCT 'unknown_class', texture_class FROM manifest WHERE texture_class NOT IN ('de', 'en', 'es')
  UNION ALL SELECT DISTINCT 'unknown_setting', setting FROM manifest WHERE setting NOT IN ('bench', 'in_situ')
  UNION ALL SELECT 'sample_in_two_classes', sample_id FROM manifest GROUP BY sample_id HAVING count(DISTINCT texture_class) > 1""")
def _(spark, d):
    return D.manifest_violations(manifest(spark, d), ["de", "en", "es"])


@query("manifest_vs_files", _W + "SELECT 'row_without_file' AS problem, path FROM manifest WHERE photo % 50 = 7 UNION ALL SELECT 'file_without_row', path FROM manifest WHERE photo % 60 = 11 AND photo % 50 <> 7")
def _(spark, d):
    m = manifest(spark, d)
    return D.manifest_vs_files(m.where("NOT (photo % 60 = 11 AND photo % 50 <> 7)"), m.where("photo % 50 <> 7"))


_ADMIT = f"""{_SHOTS}, flagged AS (SELECT m.image_id, coalesce(string_agg(criterion, ',' ORDER BY no), '') AS flags, string_agg(criterion, ',' ORDER BY no) FILTER (WHERE blocking) AS reason
  FROM metrics m LEFT JOIN failing f ON f.image_id = m.image_id GROUP BY 1)"""


@query("admit_images", f"{_ADMIT} SELECT doc_id AS photo, image_id IS NOT NULL AND reason IS NULL AS admitted, flags AS quality_flags, CASE WHEN image_id IS NULL THEN 'no photo' ELSE reason END AS reason FROM documents LEFT JOIN flagged ON image_id = doc_id")
def _(spark, d):
    judged = Q.audit(Q.as_images(photos(spark, d)), "image_id", AUDIT, BLUR).withColumnRenamed("image_id", "photo")
    return D.admit(manifest(spark, d).select("photo"), judged, "photo").select("photo", "admitted", "quality_flags", "reason")


@query("recompute_admission", f"""{_SHOTS} SELECT image_id, CASE WHEN blur < 15000 OR mean_luma < 110 OR mean_luma > 140 OR clipped > 0.05::DOUBLE OR side < {LEAST} THEN 'blocking' WHEN contrast < 46 OR cast_ > 0.1::DOUBLE OR specular > 0.02::DOUBLE THEN 'advisory' ELSE 'ok' END AS verdict FROM metrics""")
def _(spark, d):
    from fieldlab.constants import QualityCriteria

    new = QualityCriteria(min_blur=15000.0, min_luma=110.0, max_luma=140.0, max_clipped=0.05, min_contrast=46.0, max_cast=0.1, max_specular=0.02, min_side=LEAST)
    path = scratch(spark, "metrics")
    shots(spark, d).write.parquet(path)  # recorded once
    return spark.read.parquet(path).select("image_id", Q.verdict(Q.failures(new), F.col("error")).alias("verdict"))


@query("split_composition", _SPLIT + """ SELECT split, 'class' AS "by", texture_class AS value, count(*) AS images FROM split GROUP BY 1, 3 UNION ALL SELECT split, 'site', site, count(*) FROM split GROUP BY 1, 3
  UNION ALL SELECT split, 'device', device, count(*) FROM split GROUP BY 1, 3""")
def _(spark, d):
    return D.composition(split(spark, d))


@query("class_inventory", _W + "SELECT texture_class, count(*) AS images, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share, round(count(*)::DOUBLE / min(count(*)) OVER (), 9) AS ratio FROM manifest GROUP BY 1")
def _(spark, d):
    return D.inventory(manifest(spark, d)).select("texture_class", "images", F.round("share", 9).alias("share"), F.round("ratio", 9).alias("ratio"))


@query("class_floor_eligibility", _W + f", n AS (SELECT texture_class, count(DISTINCT {_GROUP}) AS samples FROM manifest GROUP BY 1) SELECT texture_class, samples, samples >= 30 AS clears_floor, samples >= 67 AS meets_target, (SELECT bool_and(samples >= 30) FROM n) AS all_clear FROM n")
def _(spark, d):
    return D.floor_eligibility(manifest(spark, d))


@query("label_shuffle_control", _W + """, a AS (SELECT photo, row_number() OVER (ORDER BY sha256('5a|' || photo), photo) AS place FROM manifest), b AS (SELECT texture_class AS control, row_number() OVER (ORDER BY sha256('5b|' || photo), photo) AS place FROM manifest)
  SELECT photo, control FROM a JOIN b USING (place)""")
def _(spark, d):
    return D.shuffled_labels(manifest(spark, d), "photo", "texture_class", 5)


@query("control_arms", _W + """, seeds AS (SELECT unnest([1, 2, 3]) AS seed),
  a AS (SELECT seed, sample_id, texture_class, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || 'a|' || photo), photo) AS place FROM manifest CROSS JOIN seeds),
  b AS (SELECT seed, texture_class AS control, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || 'b|' || photo), photo) AS place FROM manifest CROSS JOIN seeds),
  rows AS (SELECT a.seed, sample_id, texture_class, control FROM a JOIN b USING (seed, place)),
  runs AS (SELECT 'real' AS arm, seed, avg((n = 1)::INT::DOUBLE) AS value FROM (SELECT seed, sample_id, count(DISTINCT texture_class) AS n FROM rows GROUP BY 1, 2) GROUP BY seed
    UNION ALL SELECT 'shuffled', seed, avg((n = 1)::INT::DOUBLE) FROM (SELECT seed, sample_id, count(DISTINCT control) AS n FROM rows GROUP BY 1, 2) GROUP BY seed),
  arms AS (SELECT arm, avg(value) AS mean, stddev_samp(value) AS spread, count(*) AS seeds FROM runs GROUP BY arm)
  SELECT arm, round(mean, 9) AS mean, round(spread, 9) AS spread, seeds, round(mean - (SELECT mean FROM arms WHERE arm = 'real'), 9) AS delta FROM arms""")
def _(spark, d):
    # share of samples whose photos have one label, with real labels and with shuffled ones
    m, runs = manifest(spark, d).select("photo", "sample_id", "texture_class"), []
    for seed in (1, 2, 3):
        both = m.join(D.shuffled_labels(m, "photo", "texture_class", seed), "photo")
        of = both.groupBy("sample_id").agg(F.countDistinct("texture_class").alias("real"), F.countDistinct("control").alias("shuffled"))
        whole = of.agg(*(F.avg((F.col(c) == 1).cast("double")).alias(c) for c in ("real", "shuffled")))
        runs.append(whole.select(F.lit(seed).alias("seed"), F.expr("stack(2, 'real', real, 'shuffled', shuffled) AS (arm, value)")))
    c = D.compare_arms(runs[0].unionByName(runs[1]).unionByName(runs[2]))
    return c.select("arm", F.round("mean", 9).alias("mean"), F.round("spread", 9).alias("spread"), "seeds", F.round("delta", 9).alias("delta"))


@query("synthetic_lineage_split", _SPLIT + """ SELECT 's-' || photo AS item, CASE WHEN photo % 16 <> 1 THEN sample_group END AS sample_group, CASE WHEN photo % 16 <> 1 THEN split END AS split,
  CASE WHEN photo % 16 = 1 THEN 'unknown parent' WHEN split = 'test' THEN 'parent in test' END AS reason FROM split WHERE photo % 4 = 1""")
def _(spark, d):
    fake = manifest(spark, d).where("photo % 4 = 1").select(F.concat(F.lit("s-"), "photo").alias("item"), F.when(F.col("photo") % 16 == 1, -F.col("photo")).otherwise(F.col("photo")).alias("parent"))
    of, bad = D.inherit_split(fake, split(spark, d))
    return of.join(bad.select("item", "reason"), "item", "left").select("item", "sample_group", "split", "reason")


@query("manifest_format_diagnosis", "SELECT DISTINCT unnest(['semicolon', 'latin']) AS folder, unnest(['semicolon_delimiter', 'not_utf8']) AS problem FROM documents")
def _(spark, d):
    root = scratch(spark, "manifests")
    m = manifest(spark, d).select("sample_id", "texture_class", F.col("path").alias("image"), "setting", F.concat(F.lit("São "), "site").alias("site"), "device")
    m.write.option("header", True).csv(f"{root}/good")
    m.write.option("header", True).option("sep", ";").csv(f"{root}/semicolon")
    m.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{root}/latin")
    found = M.manifest_format(spark, f"{root}/*/*.csv")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "problem").distinct()


@query("manifest_hash", _SPLIT + " SELECT split, count(*) AS images, true AS recorded FROM split GROUP BY 1")
def _(spark, d):
    root = scratch(spark, "manifests")
    s = split(spark, d)
    s.select("sample_id", "texture_class", F.col("path").alias("image"), "setting", "site", "device").write.option("header", True).csv(f"{root}/manifest")
    M.write_split(s.select("photo", "sample_group", "split"), f"{root}/split", 42, 0.15, 0.15, CLASSES, manifest=f"{root}/manifest/*.csv")
    rows, settings = M.load_split(spark, f"{root}/split", manifest=f"{root}/manifest/*.csv")  # fails if the files changed
    recorded = settings.agg(F.max((F.col("name") == "manifest_sha256") & (F.length("value") == 64)).alias("recorded"))
    return D.split_counts(rows).crossJoin(F.broadcast(recorded))  # one row
