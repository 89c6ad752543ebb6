"""Operator 2: language identification by rank-order n-gram profiles.

A language's profile lists the most frequent character n-grams (n = 1 to 3,
words padded with ``_``) of labelled documents in order of rank.  A document's
own n-grams are ranked the same way and each profile is charged the
out-of-place distance: how far every n-gram of the document stands from its
place in the profile, or the full length of a profile where it is missing.

Profiles are fitted on about ``SAMPLE`` labelled documents of each language (by
a hash of doc_id, all where there are fewer); every whole text is predicted.
The driver holds one profile of ``TOP`` n-grams a language.

Defined results: a null text or one without a letter is ``und`` with score 0,
as is everything when nothing is labelled; equal distances go to the smaller
language name; equal counts rank by n-gram code; a kept
column that has an output's name keeps it, and the output gets an underscore.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlab.llm.common import ArrowPass, read

TOP = 300
SAMPLE = 2000
_PAD = ord("_")
_SHIFT = 21  # bits of a code point


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text, in ascending order of code."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[cp]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one pad after each word
    line = np.concatenate(([_PAD], np.where(letter, cp, _PAD)[keep], [_PAD] * bool(letter[-1])))
    line = line.astype(np.int64)
    two = (line[:-1] << _SHIFT) | line[1:]
    three = (two[:-1] << _SHIFT) | line[2:]
    return np.unique(np.concatenate((cp[letter], two, three)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent codes in order of rank; codes come in ascending."""
    if len(codes) > 4 * top:  # all that tie with the last place stay in
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """Rank-order profiles of several languages, compared in one step."""

    def __init__(self, by_lang: dict[str, list[int]], top: int = TOP):
        self.langs, self.top = sorted(by_lang), top
        self.codes = np.array(sorted({c for v in by_lang.values() for c in v}), np.int64)
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.codes, by_lang[lang])] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(*ngram_counts(text), self.top)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        place = self.rank[:, at]
        away = np.where(place < 0, self.top, np.abs(place - np.arange(len(own)))).sum(axis=1)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.top * len(own)))


def fold(doc_id: str, parts: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def learn_profiles(docs: DataFrame, sample: int = SAMPLE, top: int = TOP) -> Profiles:
    """Profiles from ``docs`` (doc_id, text, lang); rows with a null lang are passed over."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("lang").count().collect()
    unit = (F.xxhash64("doc_id") % 1_000_003 + 1_000_003) % 1_000_003
    share = reduce(lambda c, r: c.when(F.col("lang") == r["lang"], sample / r["count"] * 1_000_003), sizes, F.when(F.lit(False), F.lit(0.0)))

    def count(batches):
        for b in batches:
            found: dict[str, list] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                found.setdefault(lang, []).append(ngram_counts(text.as_py()))
            for lang, parts in found.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    grams = known.where(unit < share).select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = grams.withColumn("place", place).where(F.col("place") <= top).select("lang", "code", "place").collect()
    by_lang: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        by_lang.setdefault(r["lang"], []).append(r["code"])
    return Profiles(by_lang, top)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """``keep`` columns with lang_pred and score; reads no other column but text."""
    arrow = ArrowPass(docs, keep, "lang_pred string, score double")
    kept, names = arrow.kept, arrow.names

    def run(batches):
        for b in batches:
            found = [profiles.predict(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=names)

    return arrow.run(run)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    profiles = learn_profiles(docs.where(~F.col("held_out")))
    return identify(docs, profiles, ["doc_id", "held_out"])


QUERIES = {"op2_language_id": op2_language_id}
