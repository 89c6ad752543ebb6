"""Operator 1: BPE encoding and decoding by a prefix-sharing trie.

The merges of a byte-level BPE have one property that makes words cheap: the
encoding of a prefix is the encoding of a shorter prefix plus its last token.
So the state of a prefix is its last token alone, and words that share a prefix
share that prefix's states.  Each task puts the distinct new words of a batch
into a trie, walks it depth-first and finds for every node the one vocabulary
token that ends there and is stable next to the token before it; a word's ids
are read off by following last tokens back to the root.

Map-only: texts never move.  A task keeps at most ``CACHE`` encoded words (two
generations), so its memory does not grow with the corpus.

Defined results: null texts encode as empty ones (no ids, empty decoded text);
the strings of added tokens become their ids, as the library does; repeated
rows are encoded one by one; surrogates cannot occur in Arrow strings; a kept
column that has an output's name keeps it, and the output gets an underscore.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldlab.llm.common import ArrowPass, read
from fieldlab.llm.pretoken import library_splitter, split_words

#: Encoded words that a task keeps in each of two generations.
CACHE = 150_000
#: Pairs of tokens whose stability a task remembers.
PAIRS = 500_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def check_byte_level(spec: dict) -> None:
    """Raises for a vocabulary file that asks for more than the published byte-level split and plain merges."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = {
        "model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "normalizer": bool(spec.get("normalizer")),
        "pre_tokenizer": split.get("type") != "ByteLevel" or split.get("add_prefix_space", False) or not split.get("use_regex", True),
        "decoder": (spec.get("decoder") or {}).get("type") != "ByteLevel",
        "added_tokens": any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")),
    }
    if any(odd.values()):
        raise ValueError(f"not a plain byte-level BPE: {', '.join(k for k, v in odd.items() if v)}")


class TrieBpe:
    """Encoder and decoder for a vocabulary file (its JSON text)."""

    def __init__(self, definition: str, cache: int = CACHE):
        spec, byte_of = json.loads(definition), _byte_of()
        check_byte_level(spec)
        raw = lambda s: bytes(byte_of[c] for c in s)
        vocab, added = spec["model"]["vocab"], spec["added_tokens"]
        self.added = {x["content"]: x["id"] for x in added}
        self._added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.id_of = {raw(s): i for s, i in vocab.items() if s not in self.added}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes_of = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.text_of = [str(i) for i in range(size)]
        # order[t]: when t is merged, 0 for a byte; halves[t]: what it is merged from
        self.order, self.halves, self.merged = [0] * size, [None] * size, {}
        for n, m in enumerate(spec["model"]["merges"], 1):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = vocab[a], vocab[b]
            whole = vocab[a + b]
            self.merged[pair] = n
            if self.halves[whole] is None:
                self.order[whole], self.halves[whole] = n, pair
        self.length = list(map(len, self.bytes_of))
        self.longest = max(map(len, self.id_of))
        self.stable: dict[tuple[int, int], bool] = {}
        self.cache, self.new, self.old = cache, {}, {}
        self._definition, self._library = definition, None

    def _split(self, text: str) -> list[str]:
        def by_library(t):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = library_splitter(Tokenizer.from_str(self._definition))
            return self._library(t)

        return split_words(text, by_library)

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merges leave these two tokens apart when their bytes meet.

        Undoes the later of both tokens' merges again and again: at no moment
        may a merge across the border be due before the next one undone.
        """
        key = left, right
        order, halves, due = self.order, self.halves, self.merged
        before, right_next = 1 << 60, False  # the merge undone last, and whether it was the right token's
        good = True
        while True:
            across = due.get((left, right))
            # of equal merges the leftmost comes first
            if across is not None and (across < before or (right_next and across == before)):
                good = False
                break
            a, b = order[left], order[right]
            if a > b:
                before, right_next, left = a, False, halves[left][1]
            elif b:
                before, right_next, right = b, True, halves[right][0]
            else:
                break
        if len(self.stable) > PAIRS:
            self.stable.clear()
        self.stable[key] = good
        return good

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Encodings of distinct words, each shared prefix computed once.

        The trie is laid out as the sorted words: a word's leaf follows the
        one before it in depth-first order and shares with it the nodes of
        their common prefix, whose states stay on the stack ``last``.
        """
        out: list[tuple[int, ...]] = [()] * len(words)
        last: list[int] = []  # last[d - 1]: last token of the prefix of length d
        token_of, stable, adjacent, longest, length = self.id_of.get, self.stable.get, self.adjacent, self.longest, self.length
        before = b""
        for n in sorted(range(len(words)), key=words.__getitem__):
            w = words[n]
            size = len(w)
            d = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                d += 1
            del last[d:]
            before = w
            while d < size:
                d += 1
                for at in range(d - longest if d > longest else 0, d):
                    token = token_of(w[at:d])
                    if token is not None:
                        if at == 0:
                            break
                        left = last[at - 1]
                        good = stable((left, token))
                        if good is None:
                            good = adjacent(left, token)
                        if good:
                            break
                else:
                    raise ValueError(f"byte {w[d - 1]} is not in the vocabulary")
                last.append(token)
            ids = []
            while d:
                token = last[d - 1]
                ids.append(token)
                d -= length[token]
            out[n] = tuple(reversed(ids))
        return out

    def _learn(self, words: set[str]) -> None:
        missing = []
        for w in words:
            known = self.old.get(w)
            if known is None:
                missing.append(w)
            else:
                self.new[w] = known
        for i in range(0, len(missing), self.cache):
            part = missing[i : i + self.cache]
            self.new.update(zip(part, self.encode_words([w.encode() for w in part])))

    def _pieces(self, text: str) -> list:
        """Lists of words, and ids of added tokens between them."""
        if not self._added or not self._added.search(text):
            return [self._split(text)]
        out, at = [], 0
        for m in self._added.finditer(text):
            out += [self._split(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return [*out, self._split(text[at:])]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; the new words of all of them go into one trie."""
        split = [self._pieces(t or "") for t in texts]
        if len(self.new) > self.cache:
            self.old, self.new = self.new, {}
        self._learn({w for pieces in split for p in pieces if isinstance(p, list) for w in p}.difference(self.new))
        out = []
        for pieces in split:
            ids: list[int] = []
            for p in pieces:
                if isinstance(p, list):
                    ids.extend(chain.from_iterable(map(self.new.__getitem__, p)))
                else:
                    ids.append(p)
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict[str, TrieBpe] = {}


def coder(definition: str) -> TrieBpe:
    """One encoder for each vocabulary and Python worker."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = TrieBpe(definition)
    return _CODERS[key]


def load_definition(spark: SparkSession, path: str | None = None):
    """The vocabulary file as a broadcast string: 1.5 MB, whatever the corpus."""
    return spark.sparkContext.broadcast(Path(path or vocabulary_path()).read_text(encoding="utf-8"))


def encode(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` columns and ``ids``, the token ids of each whole text."""
    definition = load_definition(docs.sparkSession, path)
    arrow = ArrowPass(docs, keep, "ids array<int>")
    kept, names = arrow.kept, arrow.names

    def run(batches):
        bpe = coder(definition.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = pa.array(bpe.encode_batch(part.column("text").to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), ids], names=names)

    return arrow.run(run)


def decode(encoded: DataFrame, keep: list[str], path: str | None = None, ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``text`` from the column ``ids``; null ids decode to an empty text."""
    definition = load_definition(encoded.sparkSession, path)
    arrow = ArrowPass(encoded, keep, "text string", (ids,))
    kept, names = arrow.kept, arrow.names

    def run(batches):
        bpe = coder(definition.value)
        for b in batches:
            texts = pa.array([bpe.decode(x.as_py() or []) for x in b.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), texts], names=names)

    return arrow.run(run)


def round_trip(docs: DataFrame, keep: list[str], path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``keep`` columns and digests of the ids and of the text decoded from them,
    in one pass over the texts; also the ids themselves if asked for."""
    definition = load_definition(docs.sparkSession, path)
    arrow = ArrowPass(docs, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    kept, names = arrow.kept, arrow.names

    def run(batches):
        bpe = coder(definition.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = bpe.encode_batch(part.column("text").to_pylist())
                lines = [hashlib.sha256(",".join(map(bpe.text_of.__getitem__, x)).encode()).hexdigest() for x in ids]
                texts = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]
                cols = [pa.array(list(map(len, ids)), pa.int64()), pa.array(lines, pa.string()), pa.array(texts, pa.string())]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *cols], names=names)

    return arrow.run(run)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op1_bpe": op1_bpe}
