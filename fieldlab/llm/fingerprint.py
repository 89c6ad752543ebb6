"""Operator 8: document fingerprints as quartile bucket digests.

Every run of three bytes is hashed to one of 128 buckets; each bucket's count
is coded by the quartile of the counts that it falls in (two bits), behind one
byte for the logarithm of the length.  Two digests differ by the quartile steps
between their buckets (a jump over three quartiles counts double) plus the step
of the length codes, at most ``LENGTH_CAP``; the sum is bounded by ``FAR``,
what unrelated digests come to, and scaled to a likeness of 0 to 1.

The query also needs each document's successor in descending order of doc_id:
rows go to ranges of doc_id, a task a range, each range is sorted, and the
first row of the range below is sent along as its last row's successor.

Defined results: null texts count as empty; texts under three bytes have an
all-zero digest behind their length; equal texts have equal digests; rows of
one doc_id follow each other in ascending order of text; a table of one row is
its own successor; null doc_ids come last.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import ArrowPass, number_list, range_bounds, range_number, read, shuffle_parts

BUCKETS = 128
LENGTH_CAP = 12
#: Mean difference of independent digests: 1.625 a bucket.
FAR = 208
_STEPS = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])


def length_code(n: int) -> int:
    return 0 if n == 0 else min(255, 1 + int(math.log(n) / math.log(1.1)))


def digest(data: bytes) -> np.ndarray:
    """Length code and the quartile (0 to 3) of each bucket."""
    out = np.zeros(1 + BUCKETS, np.uint8)
    out[0] = length_code(len(data))
    if len(data) >= 3:
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        counts = np.bincount((code * np.uint32(2654435761)) >> np.uint32(25), minlength=BUCKETS)
        q = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
        out[1:] = (counts[:, None] > q).sum(axis=1)
    return out


def as_text(d: np.ndarray) -> str:
    q = d[1:].reshape(-1, 4)
    return bytes([d[0]]).hex() + ((q[:, 0] << 6) | (q[:, 1] << 4) | (q[:, 2] << 2) | q[:, 3]).astype(np.uint8).tobytes().hex()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(s), np.uint8)
    return np.concatenate((raw[:1], np.stack([(raw[1:] >> k) & 3 for k in (6, 4, 2, 0)], axis=1).ravel()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    away = int(_STEPS[a[1:], b[1:]].sum()) + min(LENGTH_CAP, abs(int(a[0]) - int(b[0])))
    return 1 - min(FAR, away) / FAR


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``fingerprint`` of each whole text; no shuffle."""
    arrow = ArrowPass(docs, keep, "fingerprint string")
    kept, names = arrow.kept, arrow.names

    def run(batches):
        for b in batches:
            found = [as_text(digest((x.as_py() or "").encode())) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(found, pa.string())], names=names)

    return arrow.run(run)


def with_successor(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges: part, extra, doc_id, text, sorted within each
    part by descending doc_id; a row marked extra only serves as successor of
    the part's last row."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(docs, "doc_id", parts)
    docs = docs.withColumn("part", range_number(F.col("doc_id"), bounds))
    # one row a range: its largest doc_id, and the range above whose last row it follows
    top = sorted(tuple(r) for r in docs.groupBy("part").agg(F.max("doc_id")).collect())
    most, above = [None] * parts, [None] * parts
    for i, (part, largest) in enumerate(top):
        most[part], above[part] = largest, top[(i + 1) % len(top)][0]
    leads = F.col("doc_id").eqNullSafe(F.get(number_list(most), F.col("part")))
    own, lead = F.struct("part", F.lit(0).alias("extra")), F.struct(F.get(number_list(above), F.col("part")).cast("int").alias("part"), F.lit(1).alias("extra"))
    both = F.when(leads, F.array(own, lead)).otherwise(F.array(own))
    rows = docs.select("doc_id", "text", F.explode(both).alias("to")).select("to.*", "doc_id", "text")
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "text")


def _edited(text: str, nxt: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + nxt[:half]


def _compare(batches):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None  # part, doc_id, text, digest of the row that waits for its successor
    for b in batches:
        out = []
        for part, extra, doc_id, text in zip(*(b.column(c) for c in ("part", "extra", "doc_id", "text"))):
            part, text, extra = part.as_py(), text.as_py(), extra.as_py()
            if extra and (held is None or held[0] != part):
                continue  # a further row of the successor's doc_id
            own = digest(text.encode())
            if held is not None and held[0] == part:
                edited = _edited(held[2], text).encode()
                changed = digest(edited)
                out.append((held[1], len(held[2]), hashlib.sha256(edited).hexdigest(), as_text(held[3]), as_text(changed), likeness(held[3], changed), likeness(held[3], own)))
            held = None if extra else (part, doc_id.as_py(), text, own)
        cols = zip(*out) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_successor(read(spark, sf_dir, "documents")).mapInArrow(
        _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


QUERIES = {"op8_fingerprint": op8_fingerprint}
