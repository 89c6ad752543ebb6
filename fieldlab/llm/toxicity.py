"""Operator 6: toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts and lexicon are folded alike: lower case, invisible characters out,
homoglyphs of other scripts and digit substitutions to one Latin skeleton.  The
lexicon holds words, and stems (``abcde*``) of inflected ones, of significant
log-odds among labelled texts; a word counts once, by its heaviest entry.  An exception
phrase (a lexicon word with one neighbour) takes back the match of its heavier
word (of equals the first) where labelled clean texts use that phrase; a match
is taken back once, however many phrases hold it.  One automaton finds words and phrases; the sum of
weights, alone and per word of the text, goes through a logistic link.

Fitted on at most ``SAMPLE`` labelled rows of each label: the lexicon on about
two thirds of them, the link on the rest.  The lexicon comes to the driver: it
holds only words of at least ``least_docs`` documents of that sample.  Every
whole text is scored.

Defined results: null, empty and wordless texts have no match and get the
score of a text without matches; without labels of both kinds the lexicon is
empty and every score is 0; repeated rows are scored one by one; a kept column
called ``score`` keeps its name, and the score gets an underscore.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import ArrowPass, materialize, read
from fieldlab.llm.language_id import fold as id_fold

#: Labelled rows of each label that the model is fitted on, at most.
SAMPLE = 10_000
#: Letters of a stem.
STEM = 5
#: Documents are rejected from this score on.
THRESHOLD = 0.7

# Characters that pass for Latin letters, and the letter they fold to.
_CYRILLIC = dict(zip("абвеёзікмнорстухуѕјԁԛԝһ", "abeee3ikmhopctyxysjdqwh"))
_GREEK = dict(zip("αβεικνορτυχ", "abeiknoptux"))
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"), None)
_FOLD = str.maketrans({**_CYRILLIC, **_GREEK, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}, **_SIGNS, "з": "e"}) | _INVISIBLE
_TOKEN = re.compile(r"\w+")
#: Punctuation that stands for a letter only inside a word.
_EDGE = re.compile(r"(?<=\w)[!|]+(?!\w)|(?<!\w)[!|$@]+(?!\w)")


def folded_words(text: str | None) -> list[str]:
    text = (text or "").lower()
    if "!" in text or "|" in text or "$" in text or "@" in text:
        text = _EDGE.sub(" ", text)
    return _TOKEN.findall(text.translate(_FOLD))


def lexicon_keys(text: str | None) -> set[str]:
    """The words of a text and the stems of those that are long enough."""
    words = set(folded_words(text))
    return words | {f"{w[:STEM]}*" for w in words if len(w) >= STEM}


class Lexicon:
    """Weights of folded words, stems and exception phrases (two words), with a link."""

    def __init__(self, words: dict[str, float], phrases: set[str] = frozenset(), link: tuple[float, ...] = (0.0, 0.0, 0.0)):
        self.words, self.phrases, self.link, self._found = words, phrases, link, None

    def __getstate__(self):
        return self.words, self.phrases, self.link

    def __setstate__(self, state):
        self.__init__(*state)

    def _automaton(self) -> ahocorasick.Automaton:
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for w, x in self.words.items():
                if not w.endswith("*"):
                    x = max(0.0, x - self.words.get(f"{w[:STEM]}*", 0.0)) if len(w) >= STEM else x
                self._found.add_word(f" {w[:-1]}" if w.endswith("*") else f" {w} ", (x, 0))
            for p in self.phrases:
                a, b = p.split(" ")
                x, y = self.weight(a), self.weight(b)
                self._found.add_word(f" {p} ", (max(x, y), len(b if y > x else p)))
            if len(self._found):
                self._found.make_automaton()
        return self._found

    def weight(self, word: str) -> float:
        """Of the heaviest entry that matches a word."""
        return max(self.words.get(word, 0.0), self.words.get(f"{word[:STEM]}*", 0.0) if len(word) >= STEM else 0.0)

    def measure(self, text: str | None) -> tuple[float, float]:
        """Sum of the weights matched, and that sum per 100 words."""
        words, found = folded_words(text), self._automaton()
        if not words or not len(found):
            return 0.0, 0.0
        total, back = 0.0, {}
        for end, (x, behind) in found.iter(f" {' '.join(words)} "):
            if behind:  # where the heavier word of a phrase begins
                back[end - behind] = x
            else:
                total += x
        total = max(0.0, total - sum(back.values()))
        return total, 100 * total / len(words)

    def score(self, text: str | None) -> float:
        if not self.words:
            return 0.0
        return float(_sigmoid(_inputs([self.measure(text)]) @ np.array(self.link))[0])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _inputs(measures: list[tuple[float, float]]) -> np.ndarray:
    m = np.log1p(np.array(measures, float).reshape(-1, 2))
    return np.column_stack([np.ones(len(m)), m])


def fit_link(measures: list[tuple[float, float]], y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Logistic regression by Newton steps; slopes do not go below 0."""
    x, b = _inputs(measures), np.zeros(3)
    for _ in range(50):
        p = _sigmoid(x @ b)
        pull = np.array([1e-6, ridge, ridge])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * b)
        b = b + np.clip(step, -4, 4)
        b[1:] = np.maximum(b[1:], 0)
    return tuple(map(float, b))


def _per_batch(count, schema: str):
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(b.column("text"), b.column("toxic").to_pylist()):
                (toxic if label == 1 else clean).update(count(text.as_py()))
            keys = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=names)

    return run


def _odds(a, b, na, nb):
    """Smoothed log odds, and the log-likelihood ratio of a 2 x 2 table."""
    odds = F.log((a + 0.5) / F.lit(na + 1.0)) - F.log((b + 0.5) / F.lit(nb + 1.0))
    rate = F.lit(na / (na + nb))
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return odds, 2 * (part(a, (a + b) * rate) + part(b, (a + b) * (1 - rate)))


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_docs: int = 3, least_ratio: float = 15.0) -> Lexicon:
    """Fits on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic)."""
    want = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [want.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # at most 2 * sample short rows
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # one of repeated ids
    rows = rows.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = materialize(rows.withColumn("fit", F.substring("key", 1, 1).isin(*"0123456789")).drop("key"), "toxicity-sample")
    fit = rows.where("fit")
    n = {r["toxic"]: r["n"] for r in fit.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon({})
    schema = "key string, a long, b long"
    found = fit.select("text", "toxic").mapInArrow(_per_batch(lexicon_keys, schema), schema).groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds, ratio = _odds(F.col("a"), F.col("b"), n[1], n[0])
    words = found.withColumn("odds", odds).withColumn("ratio", ratio).where((F.col("a") >= least_docs) & (F.col("odds") > np.log(10)) & (F.col("ratio") >= least_ratio))
    words = {r["key"]: r["odds"] for r in words.collect()}
    if not words:
        return Lexicon({})

    plain = Lexicon(words)

    def phrases(text):
        w = folded_words(text)
        hit = {x for x in set(w) if plain.weight(x)}
        return {f"{p} {q}" for p, q in zip(w, w[1:]) if p in hit or q in hit}

    pairs = fit.select("text", "toxic").mapInArrow(_per_batch(phrases, schema), schema).groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # a phrase of clean texts: seen there, and not more often among toxic texts than texts at large
    pairs = pairs.where((F.col("b") >= least_docs) & (F.col("a") * n[0] <= F.col("b") * n[1]))
    exempt = {r["key"] for r in pairs.collect()}
    raw = Lexicon(words, exempt)

    def measured(batches):
        for b in batches:
            m = [raw.measure(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array([x[0] for x in m], pa.float64()), pa.array([x[1] for x in m], pa.float64())], names=["toxic", "total", "rate"])

    held = rows.where("NOT fit").select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(measured, "toxic int, total double, rate double").toPandas().sort_values(["toxic", "total", "rate"])
    if held["toxic"].nunique() < 2:
        return Lexicon(words, exempt, (-3.0, 3.0, 0.0))
    return Lexicon(words, exempt, fit_link(list(zip(held["total"], held["rate"])), held["toxic"].to_numpy(float)))


def score_texts(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``keep`` columns and the score; reads no other column but text."""
    arrow = ArrowPass(docs, keep, "score double")
    kept, names = arrow.kept, arrow.names

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array([lexicon.score(x.as_py()) for x in b.column("text")], pa.float64())], names=names)

    return arrow.run(run)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    lexicon = learn_lexicon(docs.select("doc_id", "text"), labels.where(id_fold("doc_id", 3) != 1))
    docs = docs.withColumn("held_out", F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False)))
    return score_texts(docs, lexicon, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op6_toxicity": op6_toxicity}
