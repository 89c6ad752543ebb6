"""Model monitoring: aggregates only, without ids, paths or places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counters(log: DataFrame) -> DataFrame:
    """Counts (version, kind, value, n) by class, verdict, quality flag and failure cause.

    ``log``: version, label, verdict, flags (array), status.
    """
    cause = F.when(F.col("status").startswith("failed:"), F.substring_index("status", ":", -1))
    facts = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, v in (("class", F.col("label")), ("verdict", F.col("verdict")), ("cause", cause)))))
    flags = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("value")))
    return log.select("version", F.explode(F.concat(facts, flags)).alias("f")).groupBy("version", "f.kind", "f.value").agg(F.count("*").alias("n"))


def rates(log: DataFrame) -> DataFrame:
    """Ambiguous, insufficient and blocked shares of each version and device class."""
    share = lambda c: F.avg(c.cast("double"))
    return log.groupBy("version", "device").agg(F.count("*").alias("n"), share(F.col("verdict") == "ambiguous").alias("ambiguous"), share(F.col("verdict") == "insufficient").alias("insufficient"), share(F.col("blocked")).alias("blocked"))


def drift(log: DataFrame, old: int, new: int) -> DataFrame:
    """Change of the rates from one version to another, for each device class.

    A device class that only one version has keeps a row: its changes are null
    and ``only_in`` names the version.
    """
    r = rates(log)
    names = ("ambiguous", "insufficient", "blocked")
    a = r.where(F.col("version") == old).select("device", F.lit(True).alias("has_a"), *(F.col(c).alias(f"{c}_a") for c in names))
    b = r.where(F.col("version") == new).select("device", F.lit(True).alias("has_b"), *names)
    both = a.join(b, "device", "full")
    only = F.when(F.col("has_b").isNull(), F.lit(old)).when(F.col("has_a").isNull(), F.lit(new))
    return both.select("device", *((F.col(c) - F.col(f"{c}_a")).alias(f"{c}_delta") for c in names), only.alias("only_in"))


def follow_counters(log: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the counters of a score log that grows as table ``name`` of the session: a streaming aggregate in complete mode.

    The table has a row a counter (versions by classes, verdicts, flags and
    causes), whatever the length of the log.
    """
    writer = counters(log).writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return writer.outputMode("complete").trigger(availableNow=True).start()
