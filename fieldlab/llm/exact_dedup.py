"""Operator 13: exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes of their texts until a group has one
document or its texts have ended; texts are equal if they end in one group, so
no digest decides.  The upper part of the radix tree is split by Spark, in
rounds of ``WIDTH`` times as many bytes: a round counts documents by their
leading bytes (summed up before they move), and only nodes that weigh more than
a task should hold are split further by the next one.  A heavy node whose texts
have ended is a group already, whatever its size; none of its documents moves.
All other documents are dealt once, by the leading bytes of their first light
node, and a task splits its nodes byte by byte, passing over bytes that a whole
group shares.  So a hot text, or a passage with which many texts begin, costs
rounds and no large task, and a task holds one light node at a time.

Rounds read ``text`` (and the id) again; heavy nodes, at most (all bytes) /
(bytes of a light node) a round, are written and come back to the documents as
a broadcast where they are small, else by a join in which each node is dealt
over ``SALTS`` keys.

Defined results: a null text counts as empty, and all empty texts are equal; a
null doc_id is smaller than any other, and keep_id is null where a group has no
other; of rows of one doc_id and one text one stays; an empty table gives an
empty result; columns of the documents that are called as an output stay, and
the output gets an underscore.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldlab.llm.common import free_names, materialize, quoted, read, shuffle_parts

#: Bytes of the first round, and how many times as many each further round looks at.
FIRST, WIDTH = 8, 8
#: What a document weighs besides the bytes of its text.
ROW_BYTES = 64
#: A light node's bytes: a quarter of an even share of a task, but within these bounds.
LIGHT_BYTES = (256 << 10, 32 << 20)
#: Most bytes of heavy nodes that are broadcast.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def split_equal(texts: list[bytes]) -> list[list[int]]:
    """Places of equal texts, a list for each different text, by MSD radix splits.

    Bytes that all texts of a group share are passed over: they are those that
    its smallest and largest text share.
    """
    done, open_groups = [], [(list(range(len(texts))), 0)]
    while open_groups:
        group, at = open_groups.pop()
        if len(group) == 1:
            done.append(group)
            continue
        low, high = min(texts[i] for i in group), max(texts[i] for i in group)
        if low == high:  # all have ended alike
            done.append(group)
            continue
        step, end = 1, min(len(low), len(high))
        while at < end and low[at : at + step] == high[at : at + step]:  # by leaps, then by the byte
            at, step = min(end, at + step), step * 2
        while step > 1:
            step //= 2
            if low[at : at + step] == high[at : at + step]:
                at = min(end, at + step)
        buckets: dict[bytes, list[int]] = {}
        for i in group:
            buckets.setdefault(texts[i][at : at + 1], []).append(i)  # no byte: the text has ended
        open_groups += [(b, at + 1) for b in buckets.values()]
    return done


def _leading(body: str, depth: int) -> Column:
    return F.substring(F.col(body), 1, depth)


def beside(rows: DataFrame, key: Column, nodes: DataFrame, size: int, how: str) -> DataFrame:
    """``rows`` beside the ``nodes`` (``size`` bytes; the first column is the node) that their ``key`` names."""
    node = nodes.columns[0]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(nodes), key == F.col(node), how)
    deal, salt = free_names([*rows.columns, *nodes.columns], "deal", "salt")
    rows = rows.withColumn(deal, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    nodes = nodes.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(nodes, (key == F.col(node)) & (F.col(deal) == F.col(salt)), how).drop(deal, salt)


class HeavyNodes:
    """The nodes of one depth that weigh too much for a task, as a written table with what its documents have in common."""

    def __init__(self, rows: DataFrame, body: str, doc_id: Column, depth: int, light: int):
        self.depth, self.body = depth, body
        found = rows.groupBy(_leading(body, depth).alias("node")).agg(
            F.count("*").alias("n"), F.sum(F.octet_length(body) + F.lit(ROW_BYTES)).alias("weight"), F.max(doc_id).alias("top")
        )
        found = found.where((F.col("weight") > light) & (F.col("n") > 1)).withColumn("ended", F.octet_length("node") < depth)
        self.table = materialize(found, "radix-nodes")
        count, size, self.growing = self.table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("node") + F.lit(ROW_BYTES)), F.lit(0)), F.count_if(~F.col("ended"))).first()
        self.size, self.any = size, count > 0

    def below(self, rows: DataFrame) -> DataFrame:
        """Documents whose text goes on under one of the nodes."""
        return beside(rows, _leading(self.body, self.depth), self.table.where(~F.col("ended")).select("node"), self.size, "left_semi")


def _light_bytes(rows: DataFrame, body: str) -> int:
    total = rows.agg(F.coalesce(F.sum(F.octet_length(body) + F.lit(ROW_BYTES)), F.lit(0))).first()[0]
    low, high = LIGHT_BYTES
    return max(low, min(high, total // (4 * shuffle_parts(rows.sparkSession))))


def exact_groups(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of all rows of ``docs`` (doc_id, text), with keep_id, group_size, kept and text_sha256."""
    body, doc_id, leaf, *k = free_names(["text"], "body", "id", "leaf", *(f"k{i}" for i in range(len(keep))))
    rows = docs.select(*(quoted(c).alias(n) for c, n in zip(keep, k)), F.col("doc_id").alias(doc_id), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias(body))
    plain = rows.select(doc_id, body)
    light = _light_bytes(plain, body)
    levels, under, depth = [], plain, FIRST
    while True:
        level = HeavyNodes(under, body, F.col(doc_id), depth, light)
        if not level.any:
            break
        levels.append(level)
        depth *= WIDTH
        if not level.growing:
            break
        under = level.below(plain)

    # each document goes down the heavy nodes until its text ends in one or it comes to a light one
    at, path, cut, done = rows, F.lit(True), F.lit(depth), F.lit(False)
    for i, level in reversed(list(enumerate(levels))):
        cut = F.when(F.col(f"ended{i}").isNull(), F.lit(level.depth)).otherwise(cut)
    for i, level in enumerate(levels):
        nodes = level.table.select(F.col("node").alias(f"node{i}"), F.col("ended").alias(f"ended{i}"))
        at = beside(at, F.when(path, _leading(body, level.depth)), nodes, level.size, "left")
        path = F.coalesce(~F.col(f"ended{i}"), F.lit(False))
        done = done | F.coalesce(F.col(f"ended{i}"), F.lit(False))
    out = _split_in_tasks(at.where(~done).select(*k, doc_id, body, F.substr(F.col(body), F.lit(1), cut).alias(leaf)), k, doc_id, body, leaf)
    if levels:
        ended = reduce(DataFrame.union, (x.table.where("ended") for x in levels))  # nodes that are whole texts
        ended = ended.select("node", F.col("n").alias("group_size"), F.col("top").alias("keep_id"), F.sha2("node", 256).alias("text_sha256"))
        out = out.union(_settled(beside(rows, F.col(body), ended, sum(x.size for x in levels), "inner"), k, doc_id))
    return out.toDF(*keep, *free_names(keep, "keep_id", "group_size", "kept", "text_sha256"))


def _settled(rows: DataFrame, k: list[str], doc_id: str) -> DataFrame:
    """Documents of heavy groups: one row that has the largest doc_id stays.

    Only rows with that doc_id are compared; equal ones among them are counted
    before they move.
    """
    said = ["keep_id", "group_size"]
    top = F.col(doc_id).eqNullSafe(F.col("keep_id"))
    rest = rows.where(~top).select(*k, *said, F.lit(False).alias("kept"), "text_sha256")
    alike = rows.where(top).groupBy("node", *k, *said, "text_sha256").agg(F.count("*").alias("times"))
    alike = alike.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(*(k or ["node"]))))
    each = alike.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rest.union(each.select(*k, *said, ((F.col("place") == 1) & (F.col("time") == 1)).alias("kept"), "text_sha256"))


def _split_in_tasks(rows: DataFrame, k: list[str], doc_id: str, body: str, leaf: str) -> DataFrame:
    """Documents of light nodes: dealt by node, each node split byte by byte in its task."""
    parts = shuffle_parts(rows.sparkSession)
    dealt = rows.repartition(parts, leaf).sortWithinPartitions(leaf)
    id_type = rows.schema[doc_id].dataType
    names = [*k, "keep_id", "group_size", "kept", "text_sha256"]
    schema = T.StructType([*rows.select(*k).schema.fields, T.StructField("keep_id", id_type), T.StructField("group_size", T.LongType()), T.StructField("kept", T.BooleanType()), T.StructField("text_sha256", T.StringType())])

    def report(held: pa.Table) -> pa.RecordBatch:
        nodes, texts, ids = (held.column(c).to_pylist() for c in (leaf, body, doc_id))
        n = len(nodes)
        top, size, stays, sha = [None] * n, [1] * n, [False] * n, [""] * n
        lo = 0
        while lo < n:
            hi = lo + 1
            while hi < n and nodes[hi] == nodes[lo]:
                hi += 1
            for group in split_equal(texts[lo:hi]):
                digest = hashlib.sha256(texts[lo + group[0]]).hexdigest()
                best = max(group, key=lambda i: (ids[lo + i] is not None, ids[lo + i] if ids[lo + i] is not None else 0))
                for i in group:
                    top[lo + i], size[lo + i], sha[lo + i] = ids[lo + best], len(group), digest
                stays[lo + best] = True
            lo = hi
        new = [pa.array(top, held.schema.field(doc_id).type), pa.array(size, pa.int64()), pa.array(stays), pa.array(sha, pa.string())]
        kept = held.select(k).combine_chunks().to_batches()
        return pa.RecordBatch.from_arrays([*(kept[0].column(c) for c in k), *new], names=names)

    def split(batches):
        held: list[pa.RecordBatch] = []  # all rows of the node that comes last
        for batch in batches:
            nodes = batch.column(leaf)
            n = batch.num_rows
            if not n:
                continue
            last = n - 1
            while last > 0 and nodes[last - 1] == nodes[n - 1]:
                last -= 1
            if last == 0 and held and held[-1].column(leaf)[0] == nodes[0]:
                held.append(batch)
                continue
            if last:
                held.append(batch.slice(0, last))
            if held:
                yield report(pa.Table.from_batches(held))
            held = [batch.slice(last)]
        if held:
            yield report(pa.Table.from_batches(held))

    return dealt.mapInArrow(split, schema)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without copies: of equal texts the row with the largest doc_id stays."""
    names = free_names(docs.columns, "keep_id", "group_size", "kept", "text_sha256")
    return exact_groups(docs, docs.columns).where(quoted(names[2])).select(*map(quoted, docs.columns))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"), ["doc_id"])


ORACLE = {
    "op13_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
}
QUERIES = {"op13_exact_dedup": op13_exact_dedup}
