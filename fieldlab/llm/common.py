"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word of the contracts: a run of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch: texts of 100 KB then come to 100 MB, not 1 GB.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers Spark's default number of rows in an Arrow batch for the session; a number that the user chose stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder among those that driver and executors share.

    It lies in what ``spark.checkpoint.dir`` names.  Where that is unset, as in
    tests on one machine, a local master gets a temporary folder; a cluster has
    to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="fieldlab-"))
    return f"{base.rstrip('/')}/fieldlab-{app}"


_LOCAL: dict[str, str] = {}
#: Tables made inside the innermost ``only_the_last`` of this thread.
_MADE: ContextVar[list[str] | None] = ContextVar("tables made", default=None)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; results that still read them are void after that."""
    _delete(spark, shared_dir(spark))


@contextmanager
def only_the_last(spark: SparkSession):
    """Of the tables that this thread makes inside, only the last one stays, and none after an error.

    For steps that end in a written table; what an outer step keeps is its own last one.
    """
    made: list[str] = []
    outer = _MADE.get()
    token = _MADE.set(made)
    kept = 0
    try:
        yield
        kept = len(made[-1:])
    finally:
        _MADE.reset(token)
        for path in made[: len(made) - kept]:
            _delete(spark, path)
        if outer is not None:
            outer += made[len(made) - kept :]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage at a table that survives the loss of executors.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def for_a_while(df: DataFrame, label: str):
    """``df`` as a written table that goes when the block ends; what reads it has to be written inside."""
    spark = df.sparkSession
    path = new_path(spark, label)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _delete(spark, path)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and other signs included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores behind it until no taken name equals it (case aside)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


class ArrowPass:
    """An Arrow pass over ``df`` that hands the ``keep`` columns on and adds columns.

    Inside, kept columns go by plain names (``kept``), as signs in names are
    not safe there, and those of ``read`` by their own.  The result has the
    ``keep`` columns, then ``added`` (a list of DDL fields), renamed by
    ``free_names`` where a kept column has the name already.
    """

    def __init__(self, df: DataFrame, keep: list[str], added: str, read: tuple[str, ...] = ("text",)):
        new = T.StructType.fromDDL(added)
        self.kept = [k if k in read else f"k{i}" for i, k in enumerate(keep)]
        self.rows = df.select(*(quoted(k).alias(n) for k, n in zip(keep, self.kept)), *(quoted(k) for k in read if k not in keep))
        self.names = [*self.kept, *(f"new{i}" for i in range(len(new)))]
        self.final = [*keep, *free_names(keep, *new.names)]
        self.schema = T.StructType([*self.rows.select(*self.kept).schema.fields, *(T.StructField(f"new{i}", f.dataType) for i, f in enumerate(new))])

    def run(self, f) -> DataFrame:
        return self.rows.mapInArrow(f, self.schema).toDF(*self.final)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_running_sum(df: DataFrame, group: str, chunk: str, order: list, value: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, without a task per group.

    ``chunk`` cuts each group into pieces that follow ``order``; a task sorts
    one chunk, and only one row a chunk goes through the window over the group.
    ``df`` is read twice, so it should be a written table.  ``group`` and
    ``chunk`` must not be null.
    """
    base, val = f"{out}__base", f"{out}__value"
    df = df.withColumn(val, value)
    earlier = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = df.groupBy(group, chunk).agg(F.sum(val).alias(base)).withColumn(base, F.coalesce(F.sum(base).over(earlier), F.lit(0)))
    inside = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn(out, F.coalesce(F.sum(val).over(inside), F.lit(0)))
        .join(bases, [group, chunk])
        .withColumn(out, F.col(out) + F.col(base))
        .drop(base, val)
    )


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending bounds that cut ``key`` into even ranges."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, at, 20 * parts)).first()[0]
    return sorted(set(found or []))


def number_list(values: Iterable[int | None]) -> Column:
    """A constant array of longs: one literal for the optimizer, however long it is."""
    text = ",".join("" if v is None else str(v) for v in values)
    return F.split(F.lit(text), ",").try_cast("array<bigint>")


def range_number(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` lie below ``key``: its range, 0 for null.

    A binary search in one constant array: the expression is as large for
    20,000 ranges as for two, and a row costs the logarithm of their number.
    """
    if not bounds:
        return F.lit(0)
    at = number_list(bounds)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(at, n + step - 1) < key, n + step).otherwise(n))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a few numbers that may be broadcast: some 50 MB as a hash table.
BROADCAST_ROWS = 500_000


def small_broadcast(df: DataFrame, label: str) -> DataFrame:
    """``df`` (rows of a few numbers) as a written table, with a broadcast hint if it is small."""
    df = materialize(df, label)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
