"""Operator 4: line dedup by site-relative frequency.

A line is boilerplate on a host if it surely stands on more than ``ratio`` of
the host's pages: if n of its N pages hold it, n has to exceed ``ratio`` * N by
``sure`` standard deviations of a count, sqrt(n).  So chance repeats stay on a
host of any size without a fixed number of pages (twice is never enough), and
on large hosts the ratio alone decides.  Lines are compared
without white space at their ends and known by a 64-bit hash; each page counts
a line once.  Pages of equal text on a host are one page (unless ``distinct`` is
off), so copies of a page do not turn its own lines into boilerplate.  Only (host, hash)
pairs are shuffled, summed up before they move (with a hash of the text beside
them if ``distinct``);
the few boilerplate hashes of each host come back to the pages, as a broadcast
where their number is under ``BROADCAST_LINES``, else by a join in which each
host is dealt over ``SALTS`` keys.

A page's boilerplate is looked up once for the page (a hash set), not once a line.

Defined results: blank lines are never dropped; a null text stays null, an
empty one empty; the null host is a host of its own; repeated rows are pages
of their own; a page of nothing but boilerplate is left with an empty text; a
url without a host belongs to the null host; columns of the pages that are
called as an output stay, and the output gets an underscore.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import free_names, materialize, quoted, read

#: A line on over this share of a host's distinct pages is boilerplate, with so many standard deviations to spare (95 % sure).
RATIO, SURE = 0.01, 1.645
#: Most hashes that are broadcast: 8 MB.
BROADCAST_LINES = 1_000_000
SALTS = 64
_ENDS = " \t\r\x0b\x0c"
_NO_HOST = "\x00"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_ENDS)))


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without port; null if it has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _at(host: str | Column) -> Column:
    return F.coalesce((quoted(host) if isinstance(host, str) else host).cast("string"), F.lit(_NO_HOST))


def boilerplate(docs: DataFrame, host: str | Column = "source", ratio: float = RATIO, sure: float = SURE, distinct: bool = True) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines.

    A host has at most (distinct lines of its average page) / ratio of them.
    """
    at = _at(host).alias("host")
    page = F.xxhash64("text").alias("page")
    pages = (docs.select(at, page).distinct() if distinct else docs).groupBy("host" if distinct else at).agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(_ENDS)) != ""), _key))
    seen = docs.select(at, page, F.explode(keys).alias("line"))
    seen = (seen.distinct() if distinct else seen).groupBy("host", "line").agg(F.count("*").alias("n"))
    least = max(1, math.ceil(sure * sure))  # n - sure * sqrt(n) > 0 needs more than that
    over = F.col("n") - F.col("pages") * ratio
    common = seen.where(F.col("n") >= least).join(pages, "host").where((over > 0) & (over * over > F.col("n") * (sure * sure)))
    return common.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str | Column = "source", ratio: float = RATIO, sure: float = SURE, distinct: bool = True) -> DataFrame:
    """``docs`` with the cleaned ``text``, ``n_lines`` and ``n_dropped``; other columns stay."""
    found = materialize(boilerplate(docs, host, ratio, sure, distinct), "boilerplate")
    total = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    at, deal, b_host, b_lines, b_salt, kept = free_names(docs.columns, "__at", "__deal", "__host", "__lines", "__salt", "__kept")
    found = found.withColumnsRenamed({"host": b_host, "lines": b_lines})
    left = docs.withColumn(at, _at(host))
    if total <= BROADCAST_LINES:
        joined = left.join(F.broadcast(found), F.col(at) == F.col(b_host), "left")
    else:
        left = left.withColumn(deal, F.pmod(F.xxhash64("text"), F.lit(SALTS)))
        found = found.withColumn(b_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.join(found, (F.col(at) == F.col(b_host)) & (F.col(deal) == F.col(b_salt)), "left")
    lines = _lines(F.col("text"))
    bad = F.array_intersect(F.transform(lines, _key), F.coalesce(b_lines, F.array().cast("array<bigint>")))
    # the one-element array binds a page's hits to a name, so they are found once a page
    left_over = F.transform(F.array(bad), lambda hits: F.filter(lines, lambda x: (F.btrim(x, F.lit(_ENDS)) == "") | ~F.array_contains(hits, _key(x))))
    n_lines, n_dropped = free_names(docs.columns, "n_lines", "n_dropped")
    out = joined.withColumn(kept, F.when(F.col("text").isNotNull(), F.get(left_over, F.lit(0))))
    out = out.withColumn(n_lines, F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    out = out.withColumn(n_dropped, F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col(n_lines) - F.size(kept)).cast("long"))
    out = out.withColumn(n_lines, F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col(n_lines)).cast("long"))
    return out.withColumn("text", F.array_join(kept, "\n")).select(*map(quoted, docs.columns), n_lines, n_dropped)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_lines", "n_dropped")


ORACLE = {
    "op4_line_dedup": f"""
WITH pages AS (SELECT source, count(DISTINCT text) + max((text IS NULL)::INT) AS pages FROM documents GROUP BY source),
seen AS (
  SELECT source, line, count(DISTINCT text) AS n
  FROM (SELECT source, text, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM documents)
  WHERE line <> '' GROUP BY source, line),
bad AS (
  SELECT s.source, list(line) AS lines FROM seen s JOIN pages p ON s.source IS NOT DISTINCT FROM p.source
  WHERE n - p.pages * {RATIO}::DOUBLE > 0 AND (n - p.pages * {RATIO}::DOUBLE) * (n - p.pages * {RATIO}::DOUBLE) > n * {SURE * SURE}::DOUBLE GROUP BY s.source),
split AS (
  SELECT doc_id, string_split(text, chr(10)) AS all_lines,
         list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) = ''
           OR NOT list_contains(coalesce(b.lines, []), trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) AS kept
  FROM documents k LEFT JOIN bad b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, coalesce(array_to_string(kept, chr(10)), CASE WHEN all_lines IS NULL THEN NULL ELSE '' END) AS text,
       CAST(coalesce(len(all_lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(all_lines) - len(kept), 0) AS BIGINT) AS n_dropped
FROM split
"""
}
QUERIES = {"op4_line_dedup": op4_line_dedup}
