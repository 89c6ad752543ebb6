"""Operator 12: source divergence audit by single-pass in-memory indexing (SPIMI).

A task reads its documents once and collects postings (term, document) until
``BLOCK_POSTINGS`` are held; the block is then counted by (lang, term, source)
and leaves as a run, sorted by these, dealt over hash shards of the term and cut
into pieces of about ``PIECE`` entries, never within a term.  Pieces are Arrow
record batches in bytes, so Spark moves blobs.  Each shard's runs are merged
with a heap of open pieces, by the last term of each: what all of them hold up
to the smallest one is summed up at a stroke.  ``FAN`` runs are merged at once,
in rounds, and a merge holds one piece a run whatever the size of the shard.
The last round knows each term of a language with all its sources and keeps
those that enough documents of the language hold: the frequencies.

Probabilities are smoothed integers (billionths).  The distance of two sources
is first that of two sources without words, equal for all terms, and is then
corrected by a stream over the frequencies in term order: only sources that
hold a term are touched, no pair of sources becomes a row for a term, and a
task holds one square of ``SOURCE_BLOCK`` sources at a time.

Defined results: null text, lang and source count as empty; a (lang, source)
without terms is a group of its own; a language without kept terms has pairs
of distance 0 and no terms; repeated rows are documents of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlab.llm.common import materialize, read, shuffle_parts, small_broadcast

#: Postings of a block in memory, entries of a piece of a run, and runs that are merged at once.
BLOCK_POSTINGS, PIECE, FAN = 2_000_000, 4096, 128
#: Sources on a side of a square of pairs.
SOURCE_BLOCK = 512
#: Entries of a language for each task that corrects a square of its pairs.
TASK_ENTRIES = 100_000
#: A term stays in a language from so many documents on; ranks of terms that are told.
LEAST_DOCS, TOP_TERMS = 30, 50
SCALE, SMOOTH = 1_000_000_000, 5
#: Letters and all beyond ASCII are parts of terms, A-Z in lower case; other bytes end one.
_TERM_BYTES = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_ENTRIES = pa.schema([("key", pa.binary()), ("source", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_RUN = pa.schema([("shard", pa.int32()), ("run", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("piece", pa.binary())])
_RUN_DDL = "shard int, run string, first binary, last binary, piece binary"


def terms(text: str) -> list[bytes]:
    return _bytes(text).translate(_TERM_BYTES).split()


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _prefix(lang: str) -> bytes:
    """Before a term's bytes, it orders as (lang, term): two zero bytes end the language, and none of its own look like them."""
    return _bytes(lang).replace(b"\0", b"\0\1") + b"\0\0"


def _lang_and_term(key: bytes) -> tuple[str, str]:
    lang, _, term = key.rpartition(b"\0\0")  # terms hold no zero byte
    return lang.replace(b"\0\1", b"\0").decode("utf-8", "surrogatepass"), term.decode("utf-8", "surrogatepass")


def _pieces(shard: int, run: str, entries: pa.RecordBatch):
    """A sorted run (or a stretch of one) of one shard in pieces that end with a term."""
    keys, n, lo, rows = entries.column(0), entries.num_rows, 0, []
    if n:
        same = pc.equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        ends = np.append(np.flatnonzero(~same), n - 1) + 1
        while lo < n:
            hi = int(ends[min(np.searchsorted(ends, lo + PIECE), len(ends) - 1)])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _ENTRIES, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_batch(entries.slice(lo, hi - lo))
            rows.append((shard, run, keys[lo].as_py(), keys[hi - 1].as_py(), sink.getvalue().to_pybytes()))
            lo = hi
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUN)], schema=_RUN)


class _Block:
    """Postings of the documents since the last run."""

    def __init__(self):
        self.known = defaultdict(count().__next__)
        self.postings: list[np.ndarray] = []
        self.langs, self.sources, self.size = [], [], 0

    def add(self, lang: str, source: str, words: list[bytes]) -> None:
        self.postings.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        self.langs.append(lang)
        self.sources.append(source)
        self.size += len(words)

    def run(self, shards: int, name: str):
        """The block's entries, sorted, as pieces of each shard."""
        names = np.array(list(self.known), object)
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        names = names[order]
        docs = np.repeat(np.arange(len(self.postings)), [len(p) for p in self.postings])
        held, times = np.unique(rank[np.concatenate(self.postings)] * len(self.postings) + docs, return_counts=True)  # (term, document)
        term, doc = np.divmod(held, len(self.postings))
        langs, lang_of = np.unique(np.array(self.langs, object), return_inverse=True)
        sources, source_of = np.unique(np.array(self.sources, object), return_inverse=True)
        key = (lang_of[doc] * len(names) + term) * len(sources) + source_of[doc]
        key, place = np.unique(key, return_inverse=True)
        n, in_docs = np.bincount(place, times).astype(np.int64), np.bincount(place)
        pair, source = np.divmod(key, len(sources))
        pairs, pair_of = np.unique(pair, return_inverse=True)
        prefixes = [_prefix(x) for x in langs]
        pair_lang, pair_term = np.divmod(pairs, len(names))
        keys = pa.array([prefixes[a] + b for a, b in zip(pair_lang.tolist(), names[pair_term])], pa.binary())
        shard_of = np.array([crc32(x) % shards for x in names], np.int64)[pair_term][pair_of]
        by = np.argsort(shard_of, kind="stable")
        cuts = np.searchsorted(shard_of[by], np.arange(shards + 1))
        entries = pa.record_batch([keys.take(pa.array(pair_of[by])), pa.array([_bytes(s) for s in sources], pa.binary()).take(pa.array(source[by])), pa.array(n[by]), pa.array(in_docs[by])], schema=_ENTRIES)
        for shard in range(shards):
            yield from _pieces(shard, name, entries.slice(cuts[shard], cuts[shard + 1] - cuts[shard]))


def index_runs(docs: DataFrame, shards: int) -> DataFrame:
    """The runs of all blocks of ``docs`` (lang, source, text, none null)."""

    def index(batches):
        block, number, task = _Block(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
                words = terms(text.as_py())
                if words:
                    block.add(lang.as_py(), source.as_py(), words)
                if block.size >= BLOCK_POSTINGS:
                    yield from block.run(shards, f"{task}-{number}")
                    block, number = _Block(), number + 1
        if block.size:
            yield from block.run(shards, f"{task}-{number}")

    return docs.select("lang", "source", "text").mapInArrow(index, _RUN_DDL)


class _Keys:
    """A column that can be searched without a copy."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __len__(self):
        return len(self.column)

    def __getitem__(self, i):
        return self.column[i].as_py()


def _merged(pieces):
    """All entries in order as tables of whole terms, equal keys summed up.

    ``pieces``: (first key, last key, piece) in the order of first keys.  Of
    each run the one piece is open that the merge has come to.
    """
    heap: list[tuple[bytes, int, pa.RecordBatch]] = []
    opened, waiting = 0, next(pieces, None)
    while heap or waiting:
        while waiting and (not heap or waiting[0] <= heap[0][0]):
            heapq.heappush(heap, (waiting[1], opened, pa.ipc.open_stream(waiting[2]).read_next_batch()))
            opened, waiting = opened + 1, next(pieces, None)
        bound, parts, rest = heap[0][0], [], []
        for last, number, batch in heap:
            cut = batch.num_rows if last == bound else bisect_right(_Keys(batch.column(0)), bound)
            if cut:
                parts.append(batch.slice(0, cut))
            if cut < batch.num_rows:
                rest.append((last, number, batch.slice(cut)))
        heap = rest
        heapq.heapify(heap)
        table = pa.Table.from_batches(parts)
        if len(parts) > 1:
            table = table.group_by(["key", "source"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(_ENTRIES.names).cast(_ENTRIES)
            table = table.sort_by([("key", "ascending"), ("source", "ascending")])
        yield table


def _by_group(batches, columns: tuple[str, ...]):
    """(values of ``columns``, iterator of (first, last, piece)) of each stretch of equal values."""
    rows = ((row[:-3], row[-3:]) for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in (*columns, "first", "last", "piece"))))
    head = next(rows, None)

    def own(group):
        nonlocal head
        while head and head[0] == group:
            yield head[1]
            head = next(rows, None)

    while head:
        yield head[0], own(head[0])


def _dealt(runs: DataFrame, *by: str) -> DataFrame:
    return runs.repartition(shuffle_parts(runs.sparkSession), *by).sortWithinPartitions(*by, "first")


def _one_batch(tables: list[pa.Table]) -> pa.RecordBatch:
    batches = pa.concat_tables(tables).combine_chunks().to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], _ENTRIES)


def merge_round(runs: DataFrame, groups: int) -> DataFrame:
    """Runs of a shard merged into at most ``groups`` runs."""
    runs = runs.withColumn("to", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int"))

    def merge(batches):
        for (shard, to), pieces in _by_group(batches, ("shard", "to")):
            held = []
            for table in _merged(pieces):
                held.append(table)
                if sum(t.num_rows for t in held) >= 4 * PIECE:
                    yield from _pieces(shard, str(to), _one_batch(held))
                    held = []
            if held:
                yield from _pieces(shard, str(to), _one_batch(held))

    return _dealt(runs, "shard", "to").mapInArrow(merge, _RUN_DDL)


def frequencies(runs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, source, n of all terms that ``least_docs`` documents of their language hold; each shard's runs are merged for the last time.

    ``lang_n`` counts the term in its language; ``heads`` is 1 in one row of each term.
    """
    names = ["lang", "term", "source", "n", "lang_n", "heads"]

    def merge(batches):
        for _, pieces in _by_group(batches, ("shard",)):
            for table in _merged(pieces):
                of_term = table.group_by("key", use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
                of_term = of_term.filter(pc.greater_equal(of_term.column("docs_sum"), least_docs)).combine_chunks()
                if not of_term.num_rows:
                    continue
                terms_kept = of_term.column("key").combine_chunks()
                at = pc.index_in(table.column("key"), value_set=terms_kept).combine_chunks()
                kept, at = table.filter(at.is_valid()), at.drop_null()
                lang, term = (pa.array(x, pa.string()).take(at) for x in zip(*map(_lang_and_term, terms_kept.to_pylist())))
                place = at.to_numpy()
                heads = np.append(True, place[1:] != place[:-1]).astype(np.int64)  # a term's rows stand together
                columns = [lang, term, kept.column("source").combine_chunks().cast(pa.string()), kept.column("n").combine_chunks(), of_term.column("n_sum").combine_chunks().take(at), pa.array(heads)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return _dealt(runs, "shard").mapInArrow(merge, "lang string, term string, source string, n bigint, lang_n bigint, heads bigint")


def term_frequencies(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Index, merge rounds and last merge as one; ``docs`` has lang, source and text without nulls."""
    runs = materialize(index_runs(docs, shuffle_parts(docs.sparkSession)), "spimi-runs")
    n_runs = runs.select("run").distinct().count()
    while n_runs > FAN:
        n_runs = -(-n_runs // FAN)
        runs = materialize(merge_round(runs, n_runs), "spimi-runs")
    return materialize(frequencies(runs, least_docs), "spimi-frequencies")


def smoothed(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)) in exact integers; null for a language without kept terms."""
    under = total + kept * SMOOTH
    wide = lambda c: c.cast("decimal(20,0)")
    exact = F.call_function("div", wide(n + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), wide(under))
    fits = (n < (1 << 63) // SCALE - SMOOTH) & (n >= 0)  # else the product needs more than 64 bits
    return F.when(kept > 0, 1 + F.when(fits, F.call_function("div", (n + SMOOTH) * F.lit(SCALE).cast("long"), under)).otherwise(exact))


def pair_corrections(scored: DataFrame, groups: DataFrame, block: int | None = None) -> DataFrame:
    """lang, a, b (numbers of sources, a < b), more: the summed difference from two sources without words.

    ``scored``: lang, term, source_no, p.  ``groups``: lang, source_no, p0.
    Both have blocks (of sources) and parts (over which terms are dealt) of the
    language.  A square of two blocks gets the entries of both; the p0 of its
    sources come first.
    """
    block = block or SOURCE_BLOCK
    mine = F.floor(F.col("source_no") / block).cast("int")
    squares = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, mine).alias("i"), F.greatest(x, mine).alias("j")))).alias("sq")
    heads = groups.select("lang", "parts", "source_no", F.col("p0").alias("p"), squares)
    heads = heads.select("lang", "sq.i", "sq.j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.lit("").alias("term"), "source_no", "p")
    body = scored.select("lang", squares, F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"), "term", "source_no", "p")
    body = body.select("lang", "sq.i", "sq.j", "part", F.lit(1).alias("side"), "term", "source_no", "p")
    task = ["lang", "i", "j", "part"]
    rows = heads.union(body).repartition(shuffle_parts(scored.sparkSession), *task).sortWithinPartitions(*task, "side", "term", "source_no")

    def correct(batches):
        square = None
        for batch in batches:
            n = batch.num_rows
            keys = list(zip(*(batch.column(c).to_pylist() for c in task)))
            numbers, p, side = (batch.column(c).to_numpy() for c in ("source_no", "p", "side"))
            term = batch.column("term").dictionary_encode()
            codes = term.indices.to_numpy()
            lo = 0
            while lo < n:
                if square is None or square.key != keys[lo]:
                    if square:
                        yield square.result()
                    square = _Square(keys[lo], block)
                hi = n if keys[n - 1] == keys[lo] else next(i for i in range(lo, n) if keys[i] != keys[lo])
                body = lo + int(np.searchsorted(side[lo:hi], 1))
                square.heads += list(zip(numbers[lo:body].tolist(), p[lo:body].tolist()))
                cuts = [body, *(np.flatnonzero(codes[body + 1 : hi] != codes[body : hi - 1]) + body + 1).tolist(), hi] if body < hi else []
                for x, y in zip(cuts, cuts[1:]):
                    square.add(term.dictionary[int(codes[x])].as_py(), numbers[x:y], p[x:y])
                lo = hi
        if square:
            yield square.result()

    found = rows.mapInArrow(correct, "lang string, a bigint, b bigint, more bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


class _Square:
    """Corrections of the pairs of two blocks of sources, term by term."""

    def __init__(self, key: tuple, block: int):
        self.key, self.offsets, self.block = key, (key[1] * block, key[2] * block), block
        self.heads: list[tuple[int, int]] = []
        self.base, self.sums, self.term, self.held = None, None, None, []

    def add(self, term: str, numbers: np.ndarray, p: np.ndarray) -> None:
        """Sources of one term; those of a term may come in several stretches."""
        if term != self.term:
            self._correct()
            self.term = term
        self.held.append((numbers, p))

    def _correct(self) -> None:
        """What the held term changes for the pairs of which one source or both hold it."""
        if self.base is None:
            self.base = [np.array([p for no, p in self.heads if no // self.block == b], np.int64) for b in self.key[1:3]]
            self.sums = np.zeros((len(self.base[0]), len(self.base[1])), np.int64)
        if not self.held:
            return
        at, p = (np.concatenate(x) for x in zip(*self.held))
        sides = []
        for b, offset, base in zip(self.key[1:3], self.offsets, self.base):
            here = at // self.block == b
            now = base.copy()
            now[at[here] - offset] = p[here]
            sides.append((at[here] - offset, now))
        (ri, r), (ci, c) = sides
        r0, c0 = self.base
        self.sums[ri] += np.abs(r[ri, None] - c) - np.abs(r0[ri, None] - c0)
        more = np.abs(r[:, None] - c[ci]) - np.abs(r0[:, None] - c0[ci])
        more[ri] = 0  # counted with their row
        self.sums[:, ci] += more
        self.held = []

    def result(self) -> pa.RecordBatch:
        self._correct()
        a, b = np.nonzero(self.sums)
        below = a + self.offsets[0] < b + self.offsets[1]
        a, b = a[below], b[below]
        columns = [pa.array(x, pa.int64()) for x in (a + self.offsets[0], b + self.offsets[1], self.sums[a, b])]
        return pa.RecordBatch.from_arrays([pa.array([self.key[0]] * len(a), pa.string()), *columns], names=["lang", "a", "b", "more"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the language's other sources (``pair``) and the terms that a source
    holds more often than its language (``term``)."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = term_frequencies(docs, least_docs)
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("heads").alias("heads"), F.count("*").alias("entries"))
    numbered = docs.select("lang", "source").distinct()
    groups = numbered.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "heads", "entries"])
    lang = Window.partitionBy("lang")
    groups = groups.withColumns({
        "source_no": (F.row_number().over(lang.orderBy("source")) - 1).cast("long"),
        "lang_total": F.sum("total").over(lang), "kept": F.sum("heads").over(lang),
        "blocks": F.ceil(F.count("*").over(lang) / SOURCE_BLOCK).cast("int"),
        "parts": F.greatest(F.lit(1), F.ceil(F.sum("entries").over(lang) / TASK_ENTRIES)).cast("int"),
    })
    zero = F.lit(0).cast("long")
    groups = groups.withColumn("p0", F.coalesce(smoothed(zero, F.col("total"), F.col("kept")), zero)).drop("heads", "entries")
    groups = small_broadcast(groups, "audit-groups")
    scored = found.join(groups, ["lang", "source"]).withColumn("p", smoothed(F.col("n"), F.col("total"), F.col("kept")))

    more = pair_corrections(scored, groups)
    both = more.select("lang", F.col("a").alias("source_no"), F.col("b").alias("other_no"), "more").union(more.select("lang", "b", "a", "more"))
    other = groups.select("lang", F.col("source_no").alias("other_no"), F.col("source").alias("item"), F.col("p0").alias("other_p0"))
    pairs = groups.join(other, "lang").where("source_no <> other_no").join(both, ["lang", "source_no", "other_no"], "left")  # the result's own rows
    pairs = pairs.withColumn("value", F.col("kept") * F.abs(F.col("p0") - F.col("other_p0")) + F.coalesce("more", F.lit(0)))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(_falling("value", "item")).alias("rank"))

    words = scored.withColumn("value", F.col("p") - smoothed(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).where("value > 0")
    words = words.withColumn("rank", F.row_number().over(_falling("value", "term"))).where(F.col("rank") <= top_terms)
    return pairs.union(words.select("lang", "source", F.lit("term"), "term", "value", "rank"))


def _falling(value: str, item: str):
    return Window.partitionBy("lang", "source").orderBy(F.desc(value), item)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


ORACLE = {
    "op12_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
counted AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k ON g.lang = k.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
scored AS (
  SELECT lang, source, term, n,
    1 + {SCALE}::HUGEINT * (n + {SMOOTH}) // (sum(n) OVER s + {SMOOTH} * count(*) OVER s)::HUGEINT AS p,
    1 + {SCALE}::HUGEINT * (lang_n + {SMOOTH}) // (sum(lang_n) OVER s + {SMOOTH} * count(*) OVER s)::HUGEINT AS q
  FROM cells WINDOW s AS (PARTITION BY lang, source)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM scored a JOIN scored b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM scored WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
}
QUERIES = {"op12_divergence": op12_divergence}
