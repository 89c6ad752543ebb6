"""Files: image listings, dataset manifests, split manifests and run artifacts."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlab.operators import evaluation as E
from fieldlab.operators.dataset import REQUIRED, SPLITS, scan_folders

MANIFEST = "sample_id string, texture_class string, image string, setting string, site string, device string, captured_at string, sand_pct double, silt_pct double, clay_pct double, lab_report string, quality_flags string"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path and length of every file under ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def scan_dataset(spark: SparkSession, root: str, classes: list[str]) -> DataFrame:
    """The images of a dataset folder; raises FileNotFoundError without the folder and
    ValueError with the classes that have no image."""
    try:
        images, missing = scan_folders(list_files(spark, root), classes)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        raise FileNotFoundError(f"no dataset folder {root}") from error
    lacking = sorted(r[0] for r in missing.collect())  # class names only
    if lacking:
        raise ValueError(f"no images of {', '.join(lacking)} under {root}")
    return images


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with the known columns that its header has."""
    header = spark.read.option("header", True).csv(path).columns
    kinds = dict(x.split(" ") for x in MANIFEST.split(", "))
    return spark.read.option("header", True).schema(", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in header)).csv(path)


def manifest_format(spark: SparkSession, path: str) -> DataFrame:
    """path and problem of files that are not UTF-8 or not comma-separated."""
    f = spark.read.format("binaryFile").load(path).select("path", "content")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    header = F.split_part(F.col("content").cast("string"), F.lit("\n"), F.lit(1))
    return f.select("path", F.when(~valid, "not_utf8").when(F.contains(header, F.lit(";")) & ~F.contains(header, F.lit(",")), "semicolon_delimiter").when(~F.contains(header, F.lit(REQUIRED[0])), "no_header").alias("problem")).where("problem IS NOT NULL")


def manifest_hash(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def manifest_digest(spark: SparkSession, path: str) -> str:
    """One digest of a manifest's files, in order of their own digests (a row a file comes to the driver)."""
    return hashlib.sha256("".join(sorted(r["sha256"] for r in manifest_hash(spark, path).select("sha256").collect())).encode()).hexdigest()


def write_split(split: DataFrame, path: str, seed: int, val: float, test: float, classes: list[str], manifest: str | None = None) -> None:
    """Rows by split, and one row a setting beside them: seed, fractions, classes and their numbers (``class_to_idx.<class>``),
    photos of each split (``count.<split>``); with ``manifest`` also the digest of those files.

    Each write goes to a folder of its own, which the pointer ``current`` names
    at the end: a reader sees the rows and settings of one write.
    """
    spark = split.sparkSession
    name = uuid.uuid4().hex
    split.write.partitionBy("split").parquet(f"{path}/{name}/rows")
    counts = {r["split"]: r["n"] for r in spark.read.parquet(f"{path}/{name}/rows").groupBy("split").agg(F.count("*").alias("n")).collect()}  # a row a split
    settings = [("seed", str(seed)), ("val", str(val)), ("test", str(test)), ("classes", ",".join(classes))]
    settings += [(f"class_to_idx.{c}", str(i)) for i, c in enumerate(classes)] + [(f"count.{k}", str(counts.get(k, 0))) for k in SPLITS]
    if manifest:
        settings.append(("manifest_sha256", manifest_digest(spark, manifest)))
    spark.createDataFrame(settings, "name string, value string").coalesce(1).write.parquet(f"{path}/{name}/settings")
    last = _current(spark, path)
    spark.createDataFrame([(last[0] + 1 if last else 1, name)], "number long, name string").coalesce(1).write.mode("append").parquet(f"{path}/current")


def _current(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the last write; None before the first."""
    try:
        r = spark.read.schema("number long, name string").parquet(f"{path}/current").agg(F.max(F.struct("number", "name")).alias("m")).first()["m"]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return r and (r["number"], r["name"])


def load_split(spark: SparkSession, path: str, manifest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, settings) of the last write; raises FileNotFoundError if there is none, and ValueError
    where ``manifest`` is not the one that the split was made of."""
    last = _current(spark, path)
    if last is None:
        raise FileNotFoundError(f"no split under {path}")
    rows, settings = spark.read.parquet(f"{path}/{last[1]}/rows"), spark.read.parquet(f"{path}/{last[1]}/settings")
    if manifest:
        stored = settings.where("name = 'manifest_sha256'").first()
        found = manifest_digest(spark, manifest)
        if stored is None or stored["value"] != found:
            raise ValueError(f"the split was made of manifest {stored and stored['value']}, not of {found}")
    return rows, settings


def run_artifacts(version: str, scored: DataFrame, classes: list[str], config: dict[str, str], runtime: dict[str, str] | None, history: list[tuple[int, int, str, float]] = ()) -> DataFrame:
    """One row with all that a run leaves: version, config, runtime, metrics and history.

    ``scored`` has truth and predicted of the test rows; the metrics are
    accuracy, both F1, precision, recall, F1 and support of each class, the
    confusion (rows by truth; a further column of rows without a prediction)
    and the test size.  ``runtime`` is what the training recorded about itself,
    null if it recorded nothing.  ``history``: phase, epoch, metric, value.
    """
    k, spark = len(classes), scored.sparkSession
    cells = E.confusion(scored, k)
    report = E.report(cells)
    names = F.array(*map(F.lit, classes))
    row = F.struct(F.get(names, F.col("class")).alias("class"), "precision", "recall", "f1", "support")
    per_class = report.agg(F.transform(F.array_sort(F.collect_list(F.struct("class", row.alias("r")))), lambda x: x["r"]).alias("per_class"))  # a row a class
    lines = cells.groupBy("truth").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("predicted") < 0, k).otherwise(F.col("predicted")).alias("at"), "n"))), lambda x: x["n"]).alias("line"))
    matrix = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("truth", "line"))), lambda x: x["line"]).alias("confusion"))
    numbers = E.summary(report).withColumnsRenamed({"macro_f1": "f1_macro", "weighted_f1": "f1_weighted"})
    one = numbers.join(per_class, F.lit(True)).join(matrix, F.lit(True))  # one row each
    told = spark.createDataFrame([(str(version), config, runtime, [tuple(h) for h in history])], "version string, config map<string,string>, runtime map<string,string>, history array<struct<phase: int, epoch: bigint, metric: string, value: double>>")
    return told.join(one, F.lit(True)).select("version", "config", "runtime", F.struct("accuracy", "f1_macro", "f1_weighted", "per_class", "confusion", "test_size").alias("metrics"), "history")


def fit_history(model, phase: int = 1) -> list[tuple[int, int, str, float]]:
    """The objective of each iteration of a fitted pipeline's classifier."""
    return [(phase, i, "objective", float(v)) for i, v in enumerate(model.stages[-1].summary.objectiveHistory)]


def write_run(runs: DataFrame, path: str) -> None:
    """Writes rows of one or more versions, a folder a version; a version that is there already is replaced."""
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def run_history(spark: SparkSession, path: str) -> DataFrame:
    """version, phase, epoch, metric, value of all runs: what concat_history takes."""
    runs = spark.read.parquet(path).select(F.col("version").cast("string").alias("version"), F.explode("history").alias("h"))
    return runs.select("version", "h.phase", "h.epoch", "h.metric", "h.value")


def concat_history(history: DataFrame, chunk: int = 4096) -> DataFrame:
    """Metric series (version, phase, epoch, metric, value) with both phases end to end.

    Only metrics that phase 1 has go on; ``step`` counts epochs over both.  The
    place in a series is what lies in the chunks of epochs before plus the place
    in its own chunk, so no task sorts a whole series.
    """
    series = ["version", "metric"]
    known = history.where("phase = 1").select(*series).distinct()
    rows = history.join(known, series).withColumn("chunk", F.floor(F.col("epoch") / chunk))
    earlier = Window.partitionBy(*series).orderBy("phase", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*series, "phase", "chunk").agg(F.count("*").alias("m"))
    sizes = sizes.select(*series, "phase", "chunk", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*series, "phase", "chunk").orderBy("epoch"))
    placed = rows.withColumn("inside", inside).join(sizes, [*series, "phase", "chunk"])
    return placed.withColumn("step", (F.col("before") + F.col("inside")).cast("int")).select(*history.columns, "step")
