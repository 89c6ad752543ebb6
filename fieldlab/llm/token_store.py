"""Operator 10: token ids in binary shards with keyed access.

A store is a Parquet table of shards in ascending order of doc_id.  A shard
holds the raw ids of its documents end to end (little-endian, two bytes an id
where the vocabulary allows, else four), the keys in order, and a minimal
perfect hash of the keys: a pilot for each small group of keys sends its
members to slots of their own, and a slot holds offset, count and a 32-bit
fingerprint that turns strange keys away.  So one key costs two hashes and one
slice, however many documents a shard has.

Texts move once, to ranges of doc_id, a task a range; ids are written by the
task that made them.  The driver sees one row for each range, to place the
ranges one after the other.

Ids come from the tokenizers library.  For a plain byte-level BPE the encoding
of a text is that of its words, end to end, so each worker asks the library for
a word once; every ``VERIFY``-th text (by its checksum) also goes to the
library whole, and a difference stops the job.  With ``whole``, or for any
other kind of vocabulary, every text goes to the library whole.

Defined results: null texts count as empty and hold the end id alone; rows of
one doc_id stand in order of text and are told apart by their ordinal; null
doc_ids stand first; an empty table gives an empty store; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.bpe import check_byte_level, vocabulary_path
from fieldlab.llm.common import BROADCAST_ROWS, materialize, new_path, number_list, range_bounds, range_number, read, shuffle_parts
from fieldlab.llm.pretoken import library_splitter, split_words

#: A shard is closed once it holds this many ids.
SHARD_IDS = 1 << 20
#: Words whose ids a task keeps.
CACHE = 500_000
#: One text in so many is encoded both by words and whole.
VERIFY = 64
#: Words that the library is given in one line.
RUN = 256
#: The key that stands for a null doc_id.
NO_KEY = -(1 << 63)
SCHEMA = "part int, shard int, first_key long, last_key long, first_nth long, n_docs long, n_ids long, start long, width int, payload binary, keys binary, pilots binary, prints binary, offsets binary, counts binary"


# --- minimal perfect hash ---------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    return _mix(_mix(keys.astype(np.int64).view(np.uint64)) + ordinals.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prints_of(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _slot(hashes: np.ndarray, pilot, n: int) -> np.ndarray:
    return _mix(hashes + np.asarray(pilot, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)


def build_pilots(hashes: np.ndarray) -> np.ndarray:
    """A pilot for each group of keys, the largest group placed first."""
    n = len(hashes)
    groups = max(1, n // 3)
    group = ((hashes >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    ends = np.cumsum(sizes)
    pilots, taken = np.zeros(groups, np.uint32), np.zeros(n, bool)
    for g in np.argsort(-sizes, kind="stable"):
        size = sizes[g]
        if not size:
            break
        own, first, step = hashes[order[ends[g] - size : ends[g]]], 0, 16
        while True:
            at = np.sort(_slot(own[None, :], np.arange(first, first + step)[:, None], n), axis=1)
            free = ~taken[at].any(axis=1)
            if size > 1:
                free &= (at[:, 1:] != at[:, :-1]).all(axis=1)
            if free.any():
                i = int(free.argmax())
                pilots[g] = first + i
                taken[at[i]] = True
                break
            first, step = first + step, min(4096, step * 2)
    return pilots


def slots(hashes: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    group = ((hashes >> np.uint64(33)) % np.uint64(len(pilots))).astype(np.int64)
    return _slot(hashes, pilots[group], n).astype(np.int64)


class Shard:
    """Keyed access to one shard row (a mapping of the columns of SCHEMA)."""

    def __init__(self, row):
        self.n, self.first_key, self.first_nth = row["n_docs"], row["first_key"], row["first_nth"]
        self.ids = np.frombuffer(row["payload"], f"<u{row['width']}")
        self.keys = np.frombuffer(row["keys"], "<i8").reshape(2, -1)
        self.pilots, self.prints = np.frombuffer(row["pilots"], "<u4"), np.frombuffer(row["prints"], "<u4")
        self.offsets, self.counts = np.frombuffer(row["offsets"], "<u8"), np.frombuffer(row["counts"], "<u8")

    def find(self, keys: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that are not here."""
        h = key_hash(keys, ordinals)
        at = slots(h, self.pilots, self.n)
        return np.where(self.prints[at] == prints_of(h), at, -1)

    def find_all(self, keys: np.ndarray) -> list[tuple[int, int]]:
        """(key, slot) of every document of the given keys, in order of ordinals.

        A key's ordinals start at 0, but for the first key of the shard, which
        may have begun in the shard before.  Prints only spare comparisons: a
        slot counts if its document has the key and the ordinal.
        """
        document = np.empty(self.n, np.int64)
        document[slots(key_hash(self.keys[0], self.keys[1]), self.pilots, self.n)] = np.arange(self.n)
        k, nth, found = keys, np.where(keys == self.first_key, self.first_nth, 0), []
        while len(k):
            at = self.find(k, nth)
            own = self.keys[:, document[at]]
            here = (at >= 0) & (own[0] == k) & (own[1] == nth)
            k, nth, at = k[here], nth[here], at[here]
            found += zip(k.tolist(), at.tolist())
            nth = nth + 1
        return found

    def get(self, slot: int) -> np.ndarray:
        a = int(self.offsets[slot])
        return self.ids[a : a + int(self.counts[slot])]


def _shard_row(start: int, width: int, blobs: list[bytes], keys: list[int], ordinals: list[int]) -> dict:
    k, o = np.array(keys, np.int64), np.array(ordinals, np.int64)
    h = key_hash(k, o)
    pilots = build_pilots(h)
    at = slots(h, pilots, len(k))
    counts = np.array([len(b) // width for b in blobs], np.uint64)
    offsets = np.cumsum(counts) - counts
    placed = [np.empty(len(k), t) for t in ("<u4", "<u8", "<u8")]
    for p, v in zip(placed, (prints_of(h), offsets, counts)):
        p[at] = v
    return {
        "first_key": keys[0], "last_key": keys[-1], "first_nth": ordinals[0], "n_docs": len(k), "n_ids": int(counts.sum()), "start": start, "width": width,
        "payload": b"".join(blobs), "keys": np.stack([k, o]).astype("<i8").tobytes(), "pilots": pilots.astype("<u4").tobytes(),
        "prints": placed[0].tobytes(), "offsets": placed[1].tobytes(), "counts": placed[2].tobytes(),
    }


# --- encoding with the library ----------------------------------------------


class _Codes(dict):
    """Numbers words as they come up; the new ones wait in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        code = self[word] = len(self)
        return code


class LibraryEncoder:
    """Ids of texts from the tokenizers library, asked once for each word or for whole texts.

    A word has a number; the ids of all numbered words lie in one array, from
    which those of a batch of texts are gathered.
    """

    def __init__(self, definition: str, whole: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = library_splitter(self.tokenizer)
        try:
            check_byte_level(json.loads(definition))
            self.whole = whole
        except ValueError:
            self.whole = True
        self._forget()

    def _forget(self) -> None:
        self.codes, self.ids, self.ends = _Codes(), np.empty(0, self.kind), np.zeros(1, np.int64)

    def _ask(self, words: list[str]) -> list[np.ndarray]:
        """The library's ids of each word.

        Words of a space and no other white space go in lines of RUN words: the
        library splits them there again, and the ids that start with a space say
        where a word begins.
        """
        out: list = [None] * len(words)
        led = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and not w[1].isspace()]
        runs = [led[i : i + RUN] for i in range(0, len(led), RUN)]
        lines = ["".join(map(words.__getitem__, run)) for run in runs]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            first = np.flatnonzero(self.spaced[ids])
            if len(first) == len(run):
                for i, a, b in zip(run, first.tolist(), [*first[1:].tolist(), len(ids)]):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, self.kind)
        return out

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return self.encode_whole(texts)
        out = self._encode_words(texts)
        sure = [i for i, t in enumerate(texts) if zlib.crc32(t.encode()) % VERIFY == 0]
        for i, ids in zip(sure, self.encode_whole([texts[i] for i in sure])):
            if ids != out[i]:
                raise ValueError(f"ids of the words of a text differ from those of the text: {texts[i][:200]!r}")
        return out

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        if len(self.codes) > CACHE:
            self._forget()
        whole = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        number = self.codes.__getitem__
        codes = []
        for i, t in enumerate(texts):
            words = [] if i in whole else split_words(t, self.split)
            codes.append(np.fromiter(map(number, words), np.int64, len(words)))
        if self.codes.fresh:
            new = self._ask(self.codes.fresh)
            self.ids = np.concatenate([self.ids, *new])
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum([len(x) for x in new])))
            self.codes.fresh = []
        every = np.concatenate(codes) if codes else np.empty(0, np.int64)
        size = self.ends[every + 1] - self.ends[every]
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        flat = self.ids[np.repeat(self.ends[every] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        cut = (upto[np.cumsum([0, *map(len, codes)])] * self.width).tolist()
        out = [flat[a:b] for a, b in zip(cut, cut[1:])]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.kind).tobytes()
        return out


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(definition: str, whole: bool = False) -> LibraryEncoder:
    """One encoder for each vocabulary and Python worker."""
    key = hashlib.sha256(definition.encode()).hexdigest() + str(whole)
    if key not in _ENCODERS:
        _ENCODERS[key] = LibraryEncoder(definition, whole)
    return _ENCODERS[key]


def write_store(docs: DataFrame, path: str, end_id: int = 0, shard_ids: int = SHARD_IDS, vocabulary: str | None = None, whole: bool = False) -> None:
    """Encodes ``docs`` (doc_id, text) and writes a store to ``path``."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    definition = spark.sparkContext.broadcast(Path(vocabulary or vocabulary_path()).read_text(encoding="utf-8"))
    part = range_number(F.col("doc_id"), range_bounds(docs, "doc_id", parts))
    rows = docs.select(part.cast("int").alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionById(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        encoder = library_encoder(definition.value, whole)
        end = np.array([end_id], encoder.kind).tobytes()
        now, shard, start, size, last, nth = None, 0, 0, 0, None, 0
        blobs, keys, ordinals = [], [], []

        def close():
            row = {"part": now, "shard": shard, **_shard_row(start, encoder.width, blobs, keys, ordinals)}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                cut = b.slice(lo, 256)
                for part, key, ids in zip(cut.column("part").to_pylist(), cut.column("doc_id").to_pylist(), encoder.encode(cut.column("text").to_pylist())):
                    key = NO_KEY if key is None else key
                    if blobs and (part != now or size >= shard_ids):
                        yield close()
                        shard, start, size = shard + 1, start + size, 0
                        blobs, keys, ordinals = [], [], []
                    if part != now:
                        now, shard, start, last = part, 0, 0, None
                    nth = nth + 1 if key == last else 0
                    last = key
                    blobs.append(ids + end)
                    keys.append(key)
                    ordinals.append(nth)
                    size += len(blobs[-1]) // encoder.width
        if blobs:
            yield close()

    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(n, types[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])
    rows.mapInArrow(run, SCHEMA).write.parquet(path)


def range_starts(store: DataFrame) -> dict[int, int]:
    """Ids before each range: one row a range comes to the driver."""
    total, out = 0, {}
    for r in sorted(store.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        out[r["part"]] = total
        total += r["n"]
    return out


def read_documents(store: DataFrame) -> DataFrame:
    """Every document of a store, each found by its key: doc_id, start, n_tokens, ids_crc32."""
    base = range_starts(store)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row)
                at = s.find(s.keys[0], s.keys[1])
                if (at < 0).any():
                    raise ValueError("the index does not hold a key of its shard")
                first = base[row["part"]] + row["start"]
                crc = [zlib.crc32(s.get(i).astype("<u4").tobytes()) for i in at]
                ids = [None if k == NO_KEY else k for k in s.keys[0].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first + s.offsets[at].astype(np.int64)), pa.array(s.counts[at].astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _count_below(ascending: str, key: str, or_equal: bool) -> Column:
    """How many numbers of an ascending array column lie below the key (or equal it), by a binary search."""
    array, wanted = F.col(ascending), F.col(key)
    steps = F.transform(F.sequence(F.lit(30), F.lit(0)), lambda i: F.pow(F.lit(2), i).cast("int"))

    def move(n, step):
        at = F.get(array, n + step - 1)  # null beyond the end
        return F.when(at <= wanted if or_equal else at < wanted, n + step).otherwise(n)

    return F.aggregate(steps, F.lit(0), move)


def lookup(store: DataFrame, keys: DataFrame | list[int]) -> DataFrame:
    """(doc_id, ids) of the asked keys (a list, or the column doc_id of a table); strange keys give no row.

    Keys go to their range by a binary search over the last keys of the ranges
    (one row a range comes to the driver), to their shard by another one within
    that range, and are then found by hash.  Shards outside the
    span of all keys are pruned by their footer statistics.
    """
    spark = store.sparkSession
    asked = keys if isinstance(keys, DataFrame) else spark.createDataFrame([(int(k),) for k in keys], "doc_id long")
    asked = materialize(asked.select(F.col("doc_id").cast("long").alias("key")).where("key IS NOT NULL").distinct(), "store-keys")
    least, most, n = asked.agg(F.min("key"), F.max("key"), F.count("*")).first()
    ranges = sorted((r["last"], r["part"]) for r in store.groupBy("part").agg(F.max("last_key").alias("last")).collect())
    place = F.get(number_list(part for _, part in ranges), range_number(F.col("key"), [last for last, _ in ranges]))
    asked = asked.withColumn("part", place.cast("int"))
    # a row a range: its shards in order, in which a key is searched (it may stand in several, one behind another)
    shards = store.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("shard", "first_key", "last_key"))).alias("s"))
    first, last = _count_below("s.last_key", "key", False), _count_below("s.first_key", "key", True) - 1
    at = asked.join(shards, "part").select("part", "key", F.col("s.shard").alias("numbers"), F.when(first <= last, F.sequence(first, last)).alias("places"))
    to = at.select("part", "key", "numbers", F.explode("places").alias("place")).select("part", F.get("numbers", F.col("place")).alias("shard"), "key")
    to = to.groupBy("part", "shard").agg(F.collect_list("key").alias("asked"))
    to = materialize(to, "store-asked")  # at most the documents of a shard in a row
    near = store.where((F.col("last_key") >= F.lit(least)) & (F.col("first_key") <= F.lit(most)))
    near = near.join(F.broadcast(to) if n <= BROADCAST_ROWS else to, ["part", "shard"])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row)
                found = s.find_all(np.array(row["asked"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s.get(i).tolist() for _, i in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return near.mapInArrow(run, "doc_id long, ids array<long>")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    write_store(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_documents(spark.read.schema(SCHEMA).parquet(path))


QUERIES = {"op10_token_store": op10_token_store}
