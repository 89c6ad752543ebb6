"""Operator 5: chat formatting over a prefix tree.

Each turn of a conversation is known by a digest of all turns up to it, so
conversations that share initial turns share the nodes of a prefix tree.
Distinct conversations, sorted by their chain of digests, stand in depth-first
order of that tree: each emits the turns that the one before it does not have,
every shared turn once.  The output is a table of segments (one a node) in
ranges of that order, in two units.  In code points: the segment's place in the
output, the position of its first character in a conversation, its loss spans
and the intervals of its ancestors.  In tokens of a byte-level BPE: the ids, the
place of the first one, the position id that it starts with, the token spans
under the loss, and the intervals of earlier tokens that its tokens attend to
besides their own segment.  ``token_rows`` spells the position ids out.  An
index leads from conversations to nodes.

The opening, the text and the close of a turn are tokenized one by one, so loss
spans fall on token borders.  The driver sees one path and one stack of places
for each range, never the conversations.

Template: ``<s>`` opens a conversation; ``[SYS] x [/SYS]``, ``[INST] x [/INST]``
and `` x </s>`` hold a system, user and assistant turn, ``[ROLE] r [IS] x
[/ROLE]`` one of any other role.  Backslashes in texts are doubled and a
backslash is put into every control string, so none is left to mistake.

Defined results: turns stand in order of (turn, role, text), nulls first; a
null text or role counts as empty; a null conv_id is a conversation of its own;
repeated turns are turns of their own; equal conversations share all nodes and
get a row each; an empty table gives empty outputs; other columns are not read.
A single conversation has to fit in a task.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm import bpe
from fieldlab.llm.common import materialize, read, shuffle_parts

# The control strings of the template.
CONTROLS = ["<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[IS]"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_OPEN = {"user": "[INST] ", "system": "[SYS] ", "assistant": " "}
_CLOSE = {"user": " [/INST]", "system": " [/SYS]", "assistant": " </s>"}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str, first: bool) -> tuple[str, str, str]:
    """Opening, escaped text and close of a turn."""
    head = ("<s>" if first else "") + (_OPEN[role] if role in _OPEN else f"[ROLE] {escape(role)} [IS] ")
    return head, escape(text), _CLOSE.get(role, " [/ROLE]")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    if formatted.startswith("<s>"):
        at = 3
    while at < len(formatted):
        role = next((r for r in ("user", "system") if formatted.startswith(_OPEN[r], at)), None)
        if role is None and formatted.startswith("[ROLE] ", at):
            mid = formatted.index(" [IS] ", at)
            name, at, close = unescape(formatted[at + 7 : mid]), mid + 6, " [/ROLE]"
        else:
            role = role or "assistant"
            name, at, close = role, at + len(_OPEN[role]), _CLOSE[role]
        end = formatted.index(close, at)
        turns.append((name, unescape(formatted[at:end])))
        at = end + len(close)
    return turns


# --- the tree ---------------------------------------------------------------

_KEY = 16  # bytes of a node's digest

_TURNS = "array<struct<role:string,text:string>>"


def node_key(parent: bytes, role: str, text: str) -> bytes:
    """The digest of a turn behind its parent's; lengths keep the parts apart whatever they hold."""
    r, t = role.encode(), text.encode()
    return hashlib.blake2b(b"%d %d " % (len(r), len(t)) + parent + r + t, digest_size=_KEY).digest()


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path (the digests of its nodes, end to end) and turns."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def run(batches):
        for b in batches:
            paths = []
            for turns in b.column("turns").to_pylist():
                path = [b""]
                for t in turns:
                    path.append(node_key(path[-1], t["role"], t["text"]))
                paths.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(paths, pa.binary()), b.column("turns")], names=["conv_id", "path", "turns"])

    return whole.mapInArrow(run, f"conv_id long, path binary, turns {_TURNS}")


def _shared(a: bytes, b: bytes) -> int:
    """Nodes that two paths share."""
    n = 0
    while n + _KEY <= min(len(a), len(b)) and a[n : n + _KEY] == b[n : n + _KEY]:
        n += _KEY
    return n // _KEY


def _walk(batches, before: dict[int, bytes], coder: bpe.TrieBpe):
    """Over rows sorted by part and path: (part, path, nodes shared with the row before, new segments).

    A segment: text, loss spans, ids, loss spans over the ids.
    """
    now, last = None, b""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            cut = batch.slice(at, 256)
            for part, path, turns in zip(*(cut.column(c).to_pylist() for c in ("part", "path", "turns"))):
                if part != now:
                    now, last = part, before.get(part, b"")
                shared = _shared(last, path)
                fresh = [format_turn(t["role"], t["text"], k == 0) for k, t in enumerate(turns[shared:], shared)]
                ids = iter(coder.encode_batch([x for parts in fresh for x in parts]))
                new = []
                for (head, body, close), t in zip(fresh, turns[shared:]):
                    a, b, c = next(ids), next(ids), next(ids)
                    lost = t["role"] == "assistant"
                    new.append((head + body + close, [(len(head), len(body))] * lost, a + b + c, [(len(a), len(b))] * lost))
                last = path
                yield part, path, shared, new


_SUMMARY = "part int, shared int, size long, starts array<long>, lengths array<long>, n_ids long, id_starts array<long>, id_lengths array<long>"


def _summaries(before: dict[int, bytes], definition):
    """A row for each part: nodes that its first path shares with the part before, and in either unit
    what it emits and the nodes of its last path (start -1: in an earlier part)."""

    def run(batches):
        done: list[list] = []
        for part, _, shared, new in _walk(batches, before, bpe.coder(definition.value)):
            if not done or part != done[-1][0]:
                done.append([part, shared, *(x for _ in range(2) for x in (0, [-1] * shared, [0] * shared))])
            r = done[-1]
            for at, field in ((2, 0), (5, 2)):
                del r[at + 1][shared:], r[at + 2][shared:]
                for segment in new:
                    r[at + 1].append(r[at])
                    r[at + 2].append(len(segment[field]))
                    r[at] += len(segment[field])
        if done:
            longs = pa.list_(pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int64(), longs, longs, pa.int64(), longs, longs)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=[x.split()[0] for x in _SUMMARY.split(", ")])

    return run


_SPANS = "array<struct<start:long,length:long>>"
_SEGMENT = (
    f"part int, start long, length long, depth int, position long, text string, loss {_SPANS}, ancestors {_SPANS}, path binary, nodes array<long>, "
    f"ids array<int>, id_start long, position_id long, id_loss {_SPANS}, id_ancestors {_SPANS}"
)


def _joined(stack: list[tuple[int, int]]) -> list[dict]:
    """Intervals (start, length) with neighbours in one."""
    out: list[dict] = []
    for a, n in stack:
        if out and out[-1]["start"] + out[-1]["length"] == a:
            out[-1]["length"] += n
        elif n:
            out.append({"start": a, "length": n})
    return out


def _emit(before: dict[int, bytes], places: dict[int, tuple], definition):
    """Segments; the last of each conversation also has its path and the starts of all its nodes."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    long = pa.int64()
    kinds = [pa.int32(), long, long, pa.int32(), long, pa.string(), span, span, pa.binary(), pa.list_(long), pa.list_(pa.int32()), long, long, span, span]
    names = [x.split(" ")[0] for x in _SEGMENT.split(", ")]
    spans = lambda pairs: [{"start": a, "length": n} for a, n in pairs]

    def run(batches):
        now, out = None, []
        at, id_at, stack, id_stack = 0, 0, [], []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        for part, path, shared, new in _walk(batches, before, bpe.coder(definition.value)):
            if part != now:
                now = part
                at, id_at, stack, id_stack = places[part][0], places[part][1], list(places[part][2]), list(places[part][3])
            del stack[shared:], id_stack[shared:]
            for k, (text, loss, ids, id_loss) in enumerate(new):
                above, id_above = _joined(stack), _joined(id_stack)
                stack.append((at, len(text)))
                id_stack.append((id_at, len(ids)))
                leaf = k == len(new) - 1
                out.append((
                    part, at, len(text), shared + k, sum(x["length"] for x in above), text, spans(loss), above, path if leaf else None, [a for a, _ in stack] if leaf else None,
                    ids, id_at, sum(x["length"] for x in id_above), spans(id_loss), id_above,
                ))
                at, id_at = at + len(text), id_at + len(ids)
            if len(out) >= 512:
                yield flush()
        if out:
            yield flush()

    return run


def format_conversations(conversations: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, members).

    ``segments``: the tree depth-first, ``start`` counting over the whole
    output; the segment that ends a distinct conversation has its ``path`` and
    ``nodes``, the starts of its segments in order.  ``members``: conv_id and
    leaf, the digest that ends the path of its conversation.
    """
    spark = conversations.sparkSession
    parts = shuffle_parts(spark)
    definition = bpe.load_definition(spark, vocabulary)
    paths = materialize(conversation_paths(conversations), "chat-paths")
    distinct = paths.groupBy("path").agg(F.first("turns").alias("turns"))
    placed = materialize(distinct.repartitionByRange(parts, "path").withColumn("part", F.spark_partition_id()), "chat-order")
    ends = sorted((r["part"], bytes(r["last"])) for r in placed.groupBy("part").agg(F.max("path").alias("last")).collect())
    before = {b: last for (_, last), (b, _) in zip(ends, ends[1:])}
    ordered = placed.select("part", "path", "turns").repartitionById(parts, "part").sortWithinPartitions("part", "path")
    places, at, id_at, stack, id_stack = {}, 0, 0, [], []
    for r in sorted(ordered.mapInArrow(_summaries(before, definition), _SUMMARY).collect(), key=lambda r: r["part"]):
        places[r["part"]] = at, id_at, stack[: r["shared"]], id_stack[: r["shared"]]
        stack = [stack[i] if a < 0 else (at + a, n) for i, (a, n) in enumerate(zip(r["starts"], r["lengths"]))]
        id_stack = [id_stack[i] if a < 0 else (id_at + a, n) for i, (a, n) in enumerate(zip(r["id_starts"], r["id_lengths"]))]
        at, id_at = at + r["size"], id_at + r["n_ids"]
    segments = materialize(ordered.mapInArrow(_emit(before, places, definition), _SEGMENT), "chat-segments")
    return segments, paths.select("conv_id", F.substring("path", -_KEY, _KEY).alias("leaf"))


def token_rows(segments: DataFrame) -> DataFrame:
    """A row a segment that has tokens: id_start, ids, position_ids (one a token), id_loss, id_ancestors."""
    last = F.col("position_id") + F.size("ids") - 1
    some = segments.where(F.size("ids") > 0)
    return some.select("id_start", "ids", F.sequence("position_id", last).alias("position_ids"), "id_loss", "id_ancestors")


def read_back(segments: DataFrame, members: DataFrame) -> DataFrame:
    """Every conversation from the output alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""
    asked = segments.where("path IS NOT NULL").select(F.substring("path", -_KEY, _KEY).alias("leaf"), F.posexplode("nodes").alias("k", "start"))
    found = asked.join(segments.select("start", "text", "loss"), "start")
    whole = found.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("k", "text", "loss"))).alias("parts"))
    names = ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        for b in batches:
            out = []
            for leaf, segs in zip(b.column("leaf").to_pylist(), b.column("parts")):
                segs = segs.as_py()
                formatted = "".join(x["text"] for x in segs)
                turns = parse(formatted)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(unescape(x["text"][m["start"] : m["start"] + m["length"]]) for x in segs for m in x["loss"])
                out.append((leaf, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            cols = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    digests = whole.mapInArrow(run, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return members.join(digests, "leaf").drop("leaf")


def op5_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], told.schema)
    return read_back(*format_conversations(told.unionByName(own)))


QUERIES = {"op5_chat_tree": op5_chat_tree}
