"""Operator 7: mixing sources to target weights by a low-discrepancy schedule.

Native: DataFrame functions only.

Each source's documents are shuffled into a line of words that is read at most
``max_epochs`` times and cut into blocks of equally many words.  Slot ``i`` of
the mix looks up the golden-ratio point ``frac((i + 1) * phi)`` in the
cumulative targets; the slots of a source are ranked, and its slot of rank
``r`` takes its block ``r``.  Golden-ratio points leave a source a few slots
off its target at most: its last slot takes what the target still wants, and
slots beyond the target take nothing.  A source so small that no point hits it
gets one slot, at the place in the schedule that its targets' middle has in the
cumulative ones.  So every source is taken to its target, rounded to whole
words, and slots decide from which block on, in which order and in how many
pieces.  Points are exact integers modulo 2^64.

Defined results: null texts have size 0; the null source is a source of its
own, the last in order; documents without words and sources without words are
taken 0 times; repeated rows are mixed as separate documents; an empty table
gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlab.llm.common import free_names, materialize, n_words, quoted, read, shuffle_parts, small_broadcast, split_running_sum

#: Fixed value: 2^64 over the golden ratio.
GOLDEN = 0x9E3779B97F4A7C15
#: Cells of the unit interval for the lookup of points by an equi-join.
CELLS = 4096
#: Slots that share a chunk when they are ranked.
SLOT_CHUNK = 65536
#: Blocks of the average source, unless they would hold more than ``block_words`` words.
SLOTS = 2000


def _whole(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(20,0)")


def cyclic_weights(rank: Column) -> Column:
    """3, 1, 2, repeating along the order of the sources."""
    return F.element_at(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)), (rank % 3 + 1).cast("int"))


def source_targets(sized: DataFrame, weight=cyclic_weights, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row a source: number, words, target.

    Water filling in closed form: in ascending order of cap over weight the
    capped sources are a prefix; the rest share what remains by weight.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", weight(F.col("source_no"))).withColumn("cap", F.col("source_size") * max_epochs)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest_words = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))
    s = s.withColumn("level", rest_words / rest_weight).withColumn("full", F.col("level") >= F.col("cap") / F.col("weight"))
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("cap") / F.col("weight"))).over(everything)
    return s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level)).select(
        "source", "source_no", "source_size", "target"
    )


def mix(docs: DataFrame, weight=cyclic_weights, share: float = 1.5, max_epochs: int = 2, block_words: int = 4096, seed: str = "mix") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (documents with their line position, sources, pieces).

    A piece is what a slot takes of one document: slot, source_no, block, row
    key (source_no, chunk, row_no), doc_id, epoch, first word, words.  A block
    holds the ``SLOTS``-th part of the average source's target, at least one
    word and at most ``block_words``; a source's last one ends with its target.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffle"))
    sized = materialize(sized, "mix-sizes")
    sources = materialize(source_targets(sized, weight, share, max_epochs), "mix-sources")
    line = sized.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # the shuffled line of a source, in chunks by the first digits of the shuffle key
    line = line.withColumn("chunk", F.substring("shuffle", 1, 3))
    order = ["shuffle", "doc_id", "size"]
    line = line.withColumn("row_no", F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy(*order)))
    line = materialize(split_running_sum(line, "source_no", "chunk", ["row_no"], F.col("size"), "at"), "mix-line")

    # whole words, so that sums do not depend on their order
    quotas = sources.withColumn("quota", F.round("target").cast("long"))
    total, n_sources = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    block = max(1, min(block_words, total // (SLOTS * max(1, n_sources))))

    # cumulative targets as intervals of [0, 1), listed under each cell that they touch
    upto = Window.orderBy("source_no")
    spans = quotas.where("quota > 0").withColumn("hi", F.sum("quota").over(upto) / F.lit(float(total or 1)))
    spans = spans.withColumn("lo", F.lag("hi", 1, 0.0).over(upto)).withColumn("hi", F.when(F.lead("hi").over(upto).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    spans = spans.select("source_no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS).cast("int")))).alias("cell"))
    n_slots = -(-total // block)
    points = docs.sparkSession.range(n_slots).withColumnRenamed("id", "slot")
    turn = ((F.col("slot") + 1).cast("decimal(18,0)") * _whole(GOLDEN)) % _whole(1 << 64)
    # the upper 53 bits, which a double holds exactly
    points = points.withColumn("point", F.shiftrightunsigned((turn - _whole(1 << 63)).cast("long").bitwiseXOR(F.lit(-(1 << 63))), 11) / F.lit(float(1 << 53)))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    slots = points.join(spans, "cell").where("point >= lo AND point < hi").select("slot", "source_no")
    slots = materialize(slots, "mix-hits")
    missed = spans.groupBy("source_no").agg(F.min("lo").alias("lo"), F.min(F.least("hi", F.lit(1.0))).alias("hi")).join(slots, "source_no", "left_anti")
    slots = slots.union(missed.select(F.floor((F.col("lo") + F.col("hi")) / 2 * n_slots), "source_no"))
    slots = materialize(slots.withColumn("slot_chunk", F.floor(F.col("slot") / SLOT_CHUNK)), "mix-slots")
    slots = split_running_sum(slots, "source_no", "slot_chunk", ["slot"], F.lit(1), "block").drop("slot_chunk")
    ends = slots.groupBy("source_no").agg((F.count("*") - 1).alias("last")).join(quotas.select("source_no", "quota"), "source_no")

    # the words [from, upto) of a document's reading in each epoch, as far as the target reaches, cut at block borders
    row = ["source_no", "chunk", "row_no"]
    reads = line.where("size > 0").join(ends, "source_no")
    reads = reads.select(*row, "doc_id", "size", "quota", "last", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"), (F.col("source_size") * F.col("epoch") + F.col("at")).alias("from"))
    reads = reads.withColumn("upto", F.least(F.col("from") + F.col("size"), "quota")).where("`from` < upto")
    of = lambda word: F.least(F.floor(word / block), F.col("last"))
    cut = reads.withColumn("block", F.explode(F.sequence(of(F.col("from")), of(F.col("upto") - 1))))
    first = F.greatest(F.col("from"), F.col("block") * block)
    end = F.when(F.col("block") == F.col("last"), F.col("upto")).otherwise(F.least("upto", (F.col("block") + 1) * block))
    pieces = cut.select(*row, "doc_id", "epoch", "block", (first - F.col("from")).alias("first_word"), (end - first).alias("words"))
    return line, sources, pieces.join(slots, ["source_no", "block"])


def taken_words(line: DataFrame, pieces: DataFrame) -> DataFrame:
    """The documents of ``line`` with the words that the mix takes of them, and
    the first and the number of the slots that do (null and 0 if none does)."""
    row = ["source_no", "chunk", "row_no"]
    got = pieces.groupBy(*row).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"))
    return line.join(got, row, "left").withColumns({"taken": F.coalesce("taken", F.lit(0)), "n_slots": F.coalesce("n_slots", F.lit(0))})


def whole_documents(docs: DataFrame, line: DataFrame, pieces: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them, to the nearest whole reading: rows of 0 to
    ``max_epochs`` copies, each at the slot in which its reading begins; the
    partitions are ranges of slots.  Rows of one doc_id are taken alike."""
    row = ["source_no", "chunk", "row_no"]
    reads = pieces.groupBy(*row, "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"), F.min("block").alias("block"))
    reads = reads.join(line.select(*row, "doc_id", "size", "at"), row).where(F.col("words") * 2 >= F.col("size"))
    own, place = free_names(docs.columns, "id", "place")
    taken = reads.groupBy(F.col("doc_id").alias(own), "epoch").agg(F.min(F.struct("slot", "block", "source_no", "epoch", "at")).alias(place))
    taken = small_broadcast(taken.select(own, place), "mix-copies")
    order = [place, F.xxhash64("text")]
    out = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(own)))
    return out.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order).select(*map(quoted, docs.columns))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, _, pieces = mix(read(spark, sf_dir, "documents"))
    return taken_words(line, pieces).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), F.col("taken").cast("long"), "first_slot", "n_slots")


ORACLE = {
    "op7_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM sized GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][CAST(no % 3 AS INT) + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / weight AS ratio,
        (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
      FROM w WINDOW p AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size,
        CASE WHEN level >= ratio THEN cap ELSE weight * (min_by(level, ratio) FILTER (WHERE level < ratio) OVER ()) END AS target FROM f),
q AS (SELECT *, CAST(round(target) AS BIGINT) AS quota FROM t),
plan AS (SELECT CAST(coalesce(sum(quota), 0) AS BIGINT) AS total, greatest(1, least(4096, coalesce(sum(quota), 0) // (2000 * greatest(1, count(*))))) AS block FROM q),
span AS (SELECT source, CAST(sum(quota) OVER (ORDER BY source NULLS LAST) AS BIGINT) / (SELECT total FROM plan)::DOUBLE AS hi FROM q WHERE quota > 0),
spans AS (SELECT source, coalesce(lag(hi) OVER (ORDER BY hi), 0) AS lo, CASE WHEN lead(hi) OVER (ORDER BY hi) IS NULL THEN 2 ELSE hi END AS hi FROM span),
point AS (
  SELECT slot, CAST((slot + 1)::HUGEINT * 11400714819323198485 % 18446744073709551616 // 2048 AS BIGINT) / 9007199254740992::DOUBLE AS point
  FROM (SELECT unnest(range(CAST(ceil(total / block) AS BIGINT))) AS slot FROM plan)),
hits AS (SELECT slot, source FROM point JOIN spans ON point >= lo AND point < hi),
every AS (
  SELECT * FROM hits UNION ALL
  SELECT CAST(floor((lo + least(hi, 1)) / 2 * (SELECT count(*) FROM point)) AS BIGINT), source FROM spans s
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.source IS NOT DISTINCT FROM s.source)),
slots AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS block FROM every),
ends AS (SELECT source, count(*) - 1 AS last FROM slots GROUP BY source),
line AS (
  SELECT z.doc_id, z.source, z.size, q.source_size, q.target, q.quota, e.last,
         coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY shuffle, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM sized z JOIN q ON z.source IS NOT DISTINCT FROM q.source LEFT JOIN ends e ON z.source IS NOT DISTINCT FROM e.source),
part AS (SELECT *, least(greatest(quota - pos, 0), size) AS once, least(greatest(quota - source_size - pos, 0), size) AS again, (SELECT block FROM plan) AS block FROM line)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(once + again AS BIGINT) AS taken, first.slot AS first_slot,
       CAST(CASE WHEN once = 0 THEN 0 ELSE least((pos + once - 1) // p.block, last) - least(pos // p.block, last) + 1 END
          + CASE WHEN again = 0 THEN 0 ELSE least((source_size + pos + again - 1) // p.block, last) - least((source_size + pos) // p.block, last) + 1 END AS BIGINT) AS n_slots
FROM part p LEFT JOIN slots first ON once > 0 AND first.source IS NOT DISTINCT FROM p.source AND first.block = least(pos // p.block, last)
"""
}
QUERIES = {"op7_mixing": op7_mixing}
