"""A corpus pipeline over ``documents``: five stages, each by one operator.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; its result is written as Parquet and read again.  All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from fieldlab.llm.common import bounded_batches, free_names, materialize, only_the_last, quoted, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents scored at the threshold or over it go."""
    bounded_batches(spark)
    labels = read(spark, sf_dir, "labels").where(toxicity.id_fold("doc_id", 3) != 1)
    lexicon = toxicity.learn_lexicon(docs.select("doc_id", "text"), labels)
    score = free_names(docs.columns, "score")[0]
    return toxicity.score_texts(docs, lexicon, docs.columns).where(F.col(score) < toxicity.THRESHOLD).select(*map(quoted, docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: boilerplate lines go, documents stay; n_chars follows the text."""
    bounded_batches(spark)
    cleaned = line_dedup.drop_boilerplate(docs)
    n_dropped = free_names(docs.columns, "n_lines", "n_dropped")[1]
    return cleaned.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 (five words, similarity 0.8): the smallest doc_id of each group stays."""
    bounded_batches(spark)
    return ngram_join.keep_one(docs, ngram_join.similarity_components(docs, width=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each document as often as the mix takes it, to the nearest whole reading."""
    bounded_batches(spark)
    line, _, pieces = mixing.mix(docs)
    return mixing.whole_documents(docs, line, pieces)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token ids of each document, with digests of ids and decoded text."""
    bounded_batches(spark)
    return bpe.round_trip(docs, ["doc_id", "source"], with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: SQL can express neither the learned lexicon nor connected components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with only_the_last(spark):
        for k, (_, stage) in enumerate(STAGES, 1):
            with only_the_last(spark):  # the stage before stays until this one is written
                docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
