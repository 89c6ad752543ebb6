"""Operator 11: runs of words that repeat with a period, by descending-LCP Kruskal.

Two suffixes of a text that share their first l words (their LCP) and begin d
<= l words apart make a stretch of l + d words with period d.  Suffixes are
sorted, and the LCPs of neighbours are the edges of a graph that Kruskal's
algorithm takes from the largest down: union-find joins suffix classes, each
with the ordered set of its positions, the smaller into the larger, and a pair
of positions that becomes adjacent at a distance within the current LCP seeds a
run.  Adjacent means that no smaller period was there before, so a seed's
distance is its stretch's smallest period; a seed that the word to its left
does not extend starts a maximal run, and each run has exactly one.

Only suffixes whose first words stand twice in their text can take part: a run
of at least ``least_power`` periods and ``least_length`` words needs an LCP of
some words (5 for 4 periods and 6 words), so repeated n-grams of that length
are found first, by sorting arrays for many texts at once.  What goes on to the
suffix order is the repeated part of the texts, to the last word.

A scan with one Arrow pass: no shuffle, and a document is the unit of work; a
task holds the arrays of ``BATCH_WORDS`` words, or of one longer document.

Defined results: a null text has no words and no runs, an empty one as well;
texts of any length are read whole; equal rows give equal results; columns of
the documents that are called as an output stay, and the output gets an
underscore.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import WORD, ArrowPass, free_names, quoted, read

#: Words whose arrays are worked on at once.
BATCH_WORDS = 200_000
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def shared_words(least_power: int, least_length: int) -> int:
    """The least LCP that a run can have between its start and one period on."""
    return min(max(least_length - q, (least_power - 1) * q) for q in range(1, max(2, least_length) + 1))


def repeated_grams(ids: np.ndarray, width: int) -> np.ndarray:
    """Ascending positions whose ``width`` words occur twice or more."""
    base = len(ids) + 1
    at = np.arange(len(ids))
    rank = np.full(len(ids) + width, -1, np.int64)  # of repeated grams, by position
    rank[: len(ids)] = ids
    keep = np.bincount(ids)[ids] > 1
    at, long = at[keep], 1
    rank[: len(ids)][~keep] = -1
    while long < width and len(at):
        step = min(long, width - long)
        at = at[rank[at + step] >= 0]
        _, inverse, times = np.unique(rank[at] * base + rank[at + step], return_inverse=True, return_counts=True)
        keep = times[inverse] > 1
        rank[:] = -1
        at = at[keep]
        rank[at] = inverse[keep]
        long += step
    return at


def suffix_order(ids: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``at`` in lexicographic order of the suffixes there, and for each in this order whether it shares ``width`` words with the one before.

    ``at`` is ascending and holds all repeated grams of ``width`` words and the
    ``width`` positions behind each, which is what doubling looks up.
    """
    padded = np.concatenate([ids, np.full(width, -1, ids.dtype)])
    grams = padded[at[:, None] + np.arange(width)]
    order = np.lexsort(grams.T[::-1])
    n = len(at)
    fresh = np.ones(n, bool)
    fresh[1:] = (grams[order[1:]] != grams[order[:-1]]).any(axis=1)
    near = ~fresh
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0))
    slot = np.full(len(ids) + 1, -1, np.int64)
    slot[at] = place
    alone = lambda first: first & np.append(first[1:], True)
    left, h = order[~alone(fresh)], width
    while len(left):
        k1, k2 = rank[left], rank[slot[at[left] + h]]
        by = np.lexsort((k2, k1))
        left, k1, k2 = left[by], k1[by], k2[by]
        i = np.arange(len(left))
        old = np.append(True, k1[1:] != k1[:-1])
        first = old | np.append(True, k2[1:] != k2[:-1])
        begin = np.maximum.accumulate(np.where(old, i, 0))
        order[k1 + i - begin] = left
        rank[left] = k1 + np.maximum.accumulate(np.where(first, i, 0)) - begin
        left, h = left[~alone(first)], h * 2
    return order, near


def neighbour_lcps(ids: list[int], at: np.ndarray, order: np.ndarray, near: np.ndarray, width: int) -> list[int]:
    """LCP of each suffix in ``order`` with the one before it, 0 where it is under ``width`` (Kasai's walk along the text)."""
    before = np.full(len(at), -1, np.int64)
    before[order[1:][near[1:]]] = at[order[:-1][near[1:]]]
    lcp, long, last = [0] * len(at), 0, -2
    for i, (p, q) in enumerate(zip(at.tolist(), before.tolist())):
        if q < 0:
            long = 0
        else:
            long = max(width, long - 1) if p == last + 1 else width
            while ids[p + long] == ids[q + long]:  # a separator ends it
                long += 1
            lcp[i] = long
        last = p
    return [lcp[i] for i in order.tolist()]


def seeds(at: list[int], lcp: list[int], least_power: int, least_length: int):
    """(position, distance, LCP) of all pairs that become adjacent within reach; ``at`` in suffix order."""
    parent = list(range(len(at)))
    members: list[list[int]] = [[p] for p in at]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k in np.argsort(-np.array(lcp), kind="stable").tolist():
        reach = lcp[k]
        if not reach:
            return
        a, b = root(k - 1), root(k)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members[b]
        below = -1
        for t, p in enumerate(small):
            s = bisect_left(large, p)
            above = small[t + 1] if t + 1 < len(small) else None
            pairs = []
            if s and large[s - 1] > below:
                pairs.append((large[s - 1], p))
            if s < len(large) and (above is None or large[s] < above):
                pairs.append((p, large[s]))
            for i, j in pairs:
                d = j - i
                if reach >= (least_power - 1) * d and reach + d >= least_length:
                    yield i, d, reach
            below = p
        if len(small) * 8 < len(large):
            for p in small:
                insort(large, p)
        else:
            large += small
            large.sort()  # two ascending runs: linear
        parent[b], members[b] = a, []


def find_runs(texts: list[list], least_power: int = 4, least_length: int = 6) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start and period."""
    numbers = count()
    pieces, starts, n = [np.array([next(numbers)])], [], 1
    for words in texts:
        known = defaultdict(numbers.__next__)  # words of different texts are different
        starts.append(n)
        pieces += [np.fromiter(map(known.__getitem__, words), np.int64, len(words)), np.array([next(numbers)])]
        n += len(words) + 1
    ids = np.concatenate(pieces)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    width = shared_words(least_power, least_length)
    grams = repeated_grams(ids, width)
    if not len(grams):
        return found
    there = np.zeros(len(ids) + width, bool)
    for k in range(width + 1):
        there[grams + k] = True
    at = np.flatnonzero(there[: len(ids)])
    order, near = suffix_order(ids, at, width)
    plain = ids.tolist()
    lcp = neighbour_lcps(plain, at, order, near, width)
    runs = sorted({(i, reach + d, d) for i, d, reach in seeds(at[order].tolist(), lcp, least_power, least_length) if plain[i - 1] != plain[i - 1 + d]}, key=lambda r: (r[0], r[2]))
    of = np.searchsorted(starts, [r[0] for r in runs], side="right") - 1
    for k, (start, length, period) in zip(of.tolist(), runs):
        found[k].append((start - starts[k], length, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that stand in a run behind its first period."""
    if not runs:
        return b" ".join(words)
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return b" ".join(w for w, g in zip(words, gone) if not g)


def periodic_runs(docs: DataFrame, keep: list[str], least_power: int = 4, least_length: int = 6) -> DataFrame:
    """The ``keep`` columns with ``runs`` (start, length, period; by start and period), and ``collapsed``: the kept words, a blank between them."""
    if least_power < 2 or least_length < 2:
        raise ValueError("a run has at least two periods and two words")
    p = ArrowPass(docs, keep, f"runs array<{RUN}>, collapsed string")
    kept, names = p.kept, p.names
    runs_type = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            column, lo = batch.column("text"), 0
            runs, short, words, held = [], [], [], 0
            for text in column:
                value = text.as_py()
                words.append(value.encode("utf-8", "surrogatepass").split() if value else [])  # white space of bytes is that of the pattern
                held += len(words[-1])
                lo += 1
                if held >= BATCH_WORDS or lo == len(column):
                    for one, its in zip(words, find_runs(words, least_power, least_length)):
                        runs.append([{"start": s, "length": length, "period": q} for s, length, q in its])
                        short.append(collapsed(one, its).decode("utf-8", "surrogatepass"))
                    words, held = [], 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(runs, runs_type), pa.array(short, pa.string())], names=names)

    return p.run(run)


def greatest_run(runs: Column) -> Column:
    """Of runs by start and period the one of greatest length over period, the first of equals; null if there is none."""
    longer = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(longer(best, r), r).otherwise(best))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the repeats that the query's contract writes into a tenth of the texts."""
    h, words, n, a, p = free_names(docs.columns, "h", "words", "n", "a", "p")
    of = lambda name: F.col(name)
    rows = docs.withColumn(h, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    rows = rows.withColumn(words, F.when(of(h) % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    g = F.floor(of(h) / 10)
    rows = rows.withColumn(n, F.size(words).cast("long")).withColumn(a, g % F.nullif(of(n), F.lit(0)))
    rows = rows.withColumn(p, 1 + F.floor((of(n) - of(a)) / (3 + g % 8)))
    piece = lambda array, start, length: F.slice(array, start.cast("int"), length.cast("int"))
    times = F.ceil((of(n) - of(a)) / of(p)).cast("int")
    again = F.concat(piece(of(words), F.lit(1), of(a)), F.flatten(F.array_repeat(piece(of(words), of(a) + 1, of(p)), times)))
    planted = F.array_join(piece(again, F.lit(1), of(n)), " ")
    return rows.withColumn("text", F.when(of(n) > 0, planted).otherwise(F.col("text"))).select(*map(quoted, docs.columns))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs, ["doc_id"])
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("best", greatest_run(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic": op11_periodic}
