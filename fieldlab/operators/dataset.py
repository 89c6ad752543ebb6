"""Dataset inventory, leak-free splits and manifest checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlab.constants import IMAGE_EXTENSIONS

SPLITS = ("train", "val", "test")
SETTINGS = ("bench", "in_situ")
REQUIRED = ("sample_id", "texture_class", "image", "setting", "site", "device", "captured_at")


def folder_name(texture_class: Column) -> Column:
    return F.translate(texture_class, " ", "_")


def scan_folders(files: DataFrame, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(images, missing classes) of a listing with ``path``: one folder a class, image files only.

    ``images``: texture_class, path.  A class without a file counts as missing.
    """
    spark = files.sparkSession
    known = spark.createDataFrame([(c, c.replace(" ", "_")) for c in classes], "texture_class string, folder string")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = files.where(extension.isin(*IMAGE_EXTENSIONS)).select("path", folder.alias("folder"))
    images = found.join(F.broadcast(known), "folder").select("texture_class", "path")  # one row a class
    missing = known.select("texture_class").join(images.select("texture_class").distinct(), "texture_class", "left_anti")
    return images, missing


def sample_id(path: Column) -> Column:
    """The file's stem without a trailing photo number in parentheses."""
    # Fixed value: the shape of a numbered photo's stem.
    stem = F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    numbered = F.regexp_extract(stem, r"^(.+?)\s*\(\d+\)$", 1)
    return F.when(numbered != "", F.trim(numbered)).otherwise(stem)


def group_key(texture_class: Column, path: Column) -> Column:
    return F.concat(texture_class, F.lit("::"), sample_id(path))


def with_groups(images: DataFrame) -> DataFrame:
    return images.withColumn("sample_group", group_key(F.col("texture_class"), F.col("path")))


def group_counts(images: DataFrame, least: int = 3) -> DataFrame:
    """Distinct samples of each class, and whether they are enough to split."""
    return with_groups(images).groupBy("texture_class").agg(F.countDistinct("sample_group").alias("samples")).withColumn("enough", F.col("samples") >= least)


def split_groups(images: DataFrame, seed: int = 42, val: float = 0.15, test: float = 0.15, least: int = 3) -> DataFrame:
    """``images`` with sample_group and split: all photos of a group in one split.

    A class with under ``least`` groups stops the job that reads the split, with
    its name and number.

    Groups of a class stand in the order of a seeded hash; the first
    max(1, round(test * n)) go to test, the next to val.  A photo without a class
    or a sample stops the job as well.  The place in a class
    comes from counts of hash ranges, so no task sorts a whole class.
    """
    images = with_groups(images)
    unnamed = F.raise_error(F.lit("a photo has no class or no sample, so it belongs to no split"))
    images = images.withColumn("sample_group", F.when(F.col("texture_class").isNull() | F.col("sample_group").isNull(), unnamed).otherwise(F.col("sample_group")))
    groups = images.select("texture_class", "sample_group").distinct()
    groups = groups.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}|"), "sample_group"), 256)).withColumn("part", F.substring("h", 1, 2))
    sizes = groups.groupBy("texture_class", "part").agg(F.count("*").alias("m"))
    whole = Window.partitionBy("texture_class")
    before = F.sum("m").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("texture_class", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("m").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy("texture_class", "part").orderBy("h", "sample_group"))
    placed = groups.withColumn("place", inside).join(sizes, ["texture_class", "part"]).withColumn("place", F.col("place") + F.col("before"))
    quota = lambda share: F.greatest(F.lit(1), F.round(F.col("n") * share))
    split = F.when(F.col("place") <= quota(test), "test").when(F.col("place") <= quota(test) + quota(val), "val").otherwise("train")
    few = F.concat(F.lit("class "), "texture_class", F.lit(" has "), F.col("n").cast("string"), F.lit(f" sample group(s), a split needs at least {least}"))
    split = F.when(F.col("n") < least, F.raise_error(few)).otherwise(split)
    return images.join(placed.select("sample_group", split.alias("split")), "sample_group")


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("images"))


def leakage(split: DataFrame) -> DataFrame:
    """Groups that stand in two splits, by pair of splits."""
    where = split.select("sample_group", "split").distinct()
    a, b = (where.select("sample_group", F.col("split").alias(f"split_{k}")) for k in "ab")
    order = lambda c: F.array_position(F.array(*map(F.lit, SPLITS)), F.col(c))
    return a.join(b, "sample_group").where(order("split_a") < order("split_b"))


def class_weights(train: DataFrame, classes: list[str]) -> DataFrame:
    """n / (k * n_i) for each of the k classes; 1 for a class without rows."""
    known = train.sparkSession.createDataFrame([(c,) for c in classes], "texture_class string")
    n = train.groupBy("texture_class").agg(F.count("*").alias("n"))
    of = known.join(n, "texture_class", "left").withColumn("total", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy()))
    return of.select("texture_class", F.when(F.col("n").isNull(), 1.0).otherwise(F.col("total") / (len(classes) * F.col("n"))).alias("weight"))


def contract_violations(stored: DataFrame, active: DataFrame) -> DataFrame:
    """Settings (name, value) that differ from the active ones; those not stored are skipped if they are fractions."""
    both = active.select("name", F.col("value").alias("active")).join(stored.select("name", F.col("value").alias("stored"), F.lit(True).alias("has")), "name", "left")
    skipped = F.col("has").isNull() & F.col("name").isin("val", "test")
    return both.where(~skipped & ~F.col("stored").eqNullSafe(F.col("active"))).select("name", "stored", "active")


def manifest_violations(manifest: DataFrame, classes: list[str]) -> DataFrame:
    """(problem, subject): every violation of a manifest in one report."""
    missing = [c for c in REQUIRED if c not in manifest.columns]
    report = manifest.sparkSession.createDataFrame([("missing_column", c) for c in missing], "problem string, subject string")
    if {"sample_id", "texture_class"} <= set(manifest.columns):
        odd = manifest.where(F.col("texture_class").isNull() | ~F.col("texture_class").isin(*classes)).select(F.lit("unknown_class").alias("problem"), F.coalesce("texture_class", F.lit("")).alias("subject")).distinct()
        twice = manifest.groupBy("sample_id").agg(F.countDistinct("texture_class").alias("n")).where("n > 1").select(F.lit("sample_in_two_classes").alias("problem"), F.col("sample_id").alias("subject"))
        report = report.unionByName(odd).unionByName(twice)
    if "setting" in manifest.columns:
        bad = manifest.where(F.col("setting").isNull() | ~F.col("setting").isin(*SETTINGS)).select(F.lit("unknown_setting").alias("problem"), F.coalesce("setting", F.lit("")).alias("subject")).distinct()
        report = report.unionByName(bad)
    return report


def manifest_vs_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Rows without a file and files without a row, each named; both have ``path``."""
    a, b = manifest.select("path").distinct(), files.select("path").distinct()
    return a.join(b, "path", "left_anti").select(F.lit("row_without_file").alias("problem"), "path").unionByName(b.join(a, "path", "left_anti").select(F.lit("file_without_row").alias("problem"), "path"))


def admit(manifest: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Every manifest row with its photo's metrics, flags and whether it is admitted, with the reason if not
    (``no photo`` where none was judged)."""
    flags = F.transform("failures", lambda f: f["criterion"])
    blocking = F.array_join(F.transform(F.filter("failures", lambda f: f["blocking"]), lambda f: f["criterion"]), ",")
    out = manifest.join(judged, key, "left")
    refused = F.col("verdict").isNull() | F.col("verdict").isin("blocking", "unvalidated")
    reason = F.when(F.col("verdict").isNull(), "no photo").when(F.col("verdict") == "blocking", blocking).when(F.col("verdict") == "unvalidated", F.col("error") if "error" in judged.columns else F.lit("unvalidated"))
    return out.withColumns({"admitted": ~refused, "quality_flags": F.array_join(flags, ","), "reason": reason})


def composition(split: DataFrame) -> DataFrame:
    """Counts of each split by class, by site and by device, in one pass."""
    grouped = split.groupingSets([["split", "texture_class"], ["split", "site"], ["split", "device"]], "split", "texture_class", "site", "device").agg(F.count("*").alias("images"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "class").when(F.col("g") == 5, "site").otherwise("device")
    return grouped.select("split", kind.alias("by"), F.coalesce("texture_class", "site", "device").alias("value"), "images")


def inventory(images: DataFrame) -> DataFrame:
    """Count, share of all and ratio to the smallest class."""
    n = images.groupBy("texture_class").agg(F.count("*").alias("images"))
    every = Window.partitionBy()  # one row a class
    return n.withColumn("share", F.col("images") / F.sum("images").over(every)).withColumn("ratio", F.col("images") / F.min("images").over(every))


def floor_eligibility(images: DataFrame, floor: int = 30, target: int = 67) -> DataFrame:
    """Samples of each class against the floor and the target, and whether all classes clear the floor."""
    n = with_groups(images).groupBy("texture_class").agg(F.countDistinct("sample_group").alias("samples"))
    clears = F.col("samples") >= floor
    return n.withColumns({"clears_floor": clears, "meets_target": F.col("samples") >= target, "all_clear": F.min(clears).over(Window.partitionBy())})


def shuffled_labels(images: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """``key`` and ``control``: the labels permuted by two seeded orders of the rows.

    The place in either order comes from counts of hash ranges, as in split_groups.
    """

    def order(seed_text):
        rows = images.select(key, label, F.sha2(F.concat(F.lit(seed_text), F.col(key).cast("string")), 256).alias("h")).withColumn("part", F.substring("h", 1, 3))
        sizes = rows.groupBy("part").agg(F.count("*").alias("m"))
        before = F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # at most 4096 rows
        inside = F.row_number().over(Window.partitionBy("part").orderBy("h", key))
        return rows.withColumn("place", inside).join(sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")), "part").withColumn("place", F.col("place") + F.col("before"))

    return order(f"{seed}a|").select(key, "place").join(order(f"{seed}b|").select("place", F.col(label).alias("control")), "place").select(key, "control")


def compare_arms(runs: DataFrame) -> DataFrame:
    """Mean, spread and number of seeds of each arm (arm, seed, value), and how far its mean lies from the ``real`` arm's."""
    of = runs.groupBy("arm").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"), F.count("value").alias("seeds"))
    real = F.max(F.when(F.col("arm") == "real", F.col("mean"))).over(Window.partitionBy())  # one row an arm
    return of.withColumn("delta", F.col("mean") - real)


def inherit_split(synthetic: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(synthetic rows with their parent's group and split, those that must not be used).

    The second table has those that landed in test and those whose parent is
    unknown, each with its ``reason``; the first has every row, with nulls for
    an unknown parent.
    """
    known = split.select(F.col("photo").alias("parent"), "sample_group", "split")
    of = synthetic.join(known, "parent", "left")
    reason = F.when(F.col("split").isNull(), "unknown parent").when(F.col("split") == "test", "parent in test")
    return of, of.withColumn("reason", reason).where("reason IS NOT NULL")
