"""Operator 9: quality rules as a learned decision list.

Sequential covering: rules that predict low quality are grown one after the
other as conjunctions of thresholds on per-document statistics (FOIL gain on a
grow set), pruned on a prune set, and kept while they hold on the prune set; the
rows that a rule covers leave before the next one is grown.  The ordered list becomes one
Spark ``CASE WHEN`` expression.

The list is fitted on at most ``SAMPLE`` labelled rows of each label (chosen by
a hash of doc_id), of which the driver sees only the numeric statistics.
Statistics and verdicts cover every document.

Defined results: a null or empty text has no words and fails the base rules;
lines are split at ``\\n`` only; without labels of both kinds the list is empty
and keeps whatever passes the base rules; repeated rows are judged one by one;
kept columns that have a name of this operator's get an underscore.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import ArrowPass, free_names, materialize, quoted, read

#: Labelled rows of each label that a list is fitted on, at most.
SAMPLE = 10_000
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long, n_distinct long"
#: Ratios that rules test.
FEATURES = {
    "symbol_ratio": "n_symbols / word_chars",
    "dup_line_ratio": "n_dup_lines / n_words",
    "repeat_ratio": "n_repeat_words / n_words",
    "upper_ratio": "n_upper / n_letters",
    "letter_ratio": "n_letters / word_chars",
    "distinct_ratio": "n_distinct / n_words",
    "mean_word": "word_chars / n_words",
    "n_words": "n_words",
}
VERDICTS = ("rule", "base_failed", "kept")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of STATS for one text."""
    text = text or ""
    words = _WORD.findall(text)
    lines = Counter(x for x in text.split("\n") if _WORD.search(x))
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        times, end = Counter(grams), -1  # end: last word that counts already
        for i, g in enumerate(grams):
            if times[g] > 1:
                repeated += i + 2 - max(end, i - 1)
                end = i + 2
    joined = "".join(words)
    lower, upper = joined.lower(), joined.upper()
    cased = len(joined) == len(lower) == len(upper)
    n_upper = sum(map(str.isupper, joined)) if not cased or joined != lower else 0
    return (
        len(words),
        len(joined),
        len(_SYMBOL.findall(text)),
        sum(lines.values()) - len(lines),
        repeated,
        n_upper,
        sum(map(len, re.findall(r"[^\W\d_]+", joined))),
        len(set(words)),
    )


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and the counts of its texts, in one pass without a shuffle.

    Kept columns that have a name of this operator's get an underscore.
    """
    free = free_names([*(x.split()[0] for x in STATS.split(", ")), *FEATURES, *VERDICTS], *keep)
    docs = docs.select(*(quoted(k).alias(n) for k, n in zip(keep, free)), *["text"] * ("text" not in keep))
    arrow = ArrowPass(docs, free, STATS)
    kept, names = arrow.kept, arrow.names
    n_stats = len(names) - len(keep)

    def run(batches):
        for b in batches:
            stats = zip(*(text_stats(x.as_py()) for x in b.column("text"))) if b.num_rows else [()] * n_stats
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *(pa.array(x, pa.int64()) for x in stats)], names=names)

    return arrow.run(run)


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({k: F.coalesce(F.try_divide(*(F.col(x).cast("double") for x in v.split(" / "))), F.lit(0.0)) if "/" in v else F.col(v).cast("double") for k, v in FEATURES.items()})


# --- fitting (on the bounded sample) ---------------------------------------


def _covers(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    return reduce(np.logical_and, (x[:, f] <= v if op == "<=" else x[:, f] > v for f, op, v in rule), np.ones(len(x), bool))


def _grow(x: np.ndarray, bad: np.ndarray) -> list[tuple[int, str, float]]:
    """Adds the threshold test of best FOIL gain until only bad rows are covered or none gains."""
    rule, on = [], np.ones(len(x), bool)
    while True:
        p0, n0 = bad[on].sum(), (~bad[on]).sum()
        if n0 == 0 or p0 == 0:
            break
        before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f in range(x.shape[1]):
            order = np.argsort(x[on, f], kind="stable")
            v, y = x[on, f][order], bad[on][order]
            edge = np.flatnonzero(v[1:] > v[:-1])
            p, n = np.cumsum(y)[edge], np.cumsum(~y)[edge]
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                gain = pp * (np.log2(np.maximum(pp, 1e-12) / np.maximum(pp + nn, 1)) - before)
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = gain[i], (f, op, float((v[edge[i]] + v[edge[i] + 1]) / 2))
        if best[1] is None:
            break
        rule.append(best[1])
        on = _covers(x, rule)
    return rule


def _worth(x: np.ndarray, bad: np.ndarray, rule: list) -> float:
    on = _covers(x, rule)
    p, n = bad[on].sum(), (~bad[on]).sum()
    return (p - n) / (p + n) if p + n else -1.0


def fit_decision_list(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.9, least: int = 5) -> list[list[tuple[str, str, float]]]:
    """Ordered rules; a row that any rule covers is of low quality.

    A third of the rows prunes: the last tests of a rule go as long as the rule
    does no worse on those rows, and the list ends with the first rule that does
    not hold there (``precision`` of what it covers is bad) or covers under
    ``least`` bad rows in all.
    """
    pruning = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while bad[left & ~pruning].sum() >= least:
        rule = _grow(x[left & ~pruning], bad[left & ~pruning])
        held = left & pruning
        while len(rule) > 1 and _worth(x[held], bad[held], rule[:-1]) >= _worth(x[held], bad[held], rule):
            rule = rule[:-1]
        on = left & _covers(x, rule)
        proof = bad[on & pruning]
        if not rule or bad[on].sum() < least or not len(proof) or proof.mean() < precision:
            break
        tightest: dict[tuple[int, str], float] = {}
        for f, op, v in rule:
            tightest[f, op] = (min if op == "<=" else max)(v, tightest.get((f, op), v))
        rules.append([(names[f], op, v) for (f, op), v in tightest.items()])
        left &= ~on
    return rules


def labelled_sample(featured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled rows of each label, by a hash of doc_id; of rows of one doc_id the one of smallest features."""
    want = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [want.where(f"quality = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    of = featured.select("doc_id", *FEATURES).join(chosen[0].union(chosen[1]), "doc_id").groupBy("doc_id", "quality")
    return of.agg(F.min(F.struct(*FEATURES)).alias("f")).select("doc_id", "quality", "f.*")


def learn_rules(featured: DataFrame, labels: DataFrame, sample: int = SAMPLE, **fit) -> list[list[tuple[str, str, float]]]:
    rows = labelled_sample(featured, labels, sample).toPandas().sort_values(["doc_id", *FEATURES], kind="stable")
    bad = (rows["quality"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return []
    order = np.random.default_rng(7).permutation(len(rows))
    return fit_decision_list(rows[list(FEATURES)].to_numpy(float)[order], bad[order], list(FEATURES), **fit)


def rule_number(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The list as one CASE expression: number of the first rule that fires, null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        tests = (F.col(f) <= v if op == "<=" else F.col(f) > v for f, op, v in rule)
        out = F.when(reduce(Column.__and__, tests), F.lit(i)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(with_stats(read(spark, sf_dir, "documents"), ["doc_id"]), "quality-stats")
    featured = with_features(stats)
    rules = learn_rules(featured, read(spark, sf_dir, "labels"))
    judged = featured.withColumn("rule", rule_number(rules)).withColumn("base_failed", base_failed())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


QUERIES = {"op9_quality_rules": op9_quality_rules}
