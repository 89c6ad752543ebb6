"""Operator 3: n-gram Jaccard join by token-combination prefixes.

Texts become sets of hashed word shingles (the tokens of the join).  Sets are
ordered by hash; of a set of n tokens at most t = n - ceil(s * n) are missing
from a partner of similarity s, so t + 1 of its first tokens would do as index
keys.  Tokens seen in over ``FREQUENT`` such prefixes are of the frequent class:
they are indexed by pairs within a narrow range of hashes, not alone.  c tokens
of one range yield a shared pair unless c - 1 of them are missing, so the
prefix is extended until single rare tokens plus (c - 1) for each range reach
t + 1.  Range widths follow the size of the set in powers of two; sets near the
next power are indexed for both.

Sets that are equal become one representative at once.  Keys with the same
representatives are one bucket.  Buckets are resolved without listing their
pairs: representatives are first checked against the smallest one of a bucket;
then those outside the largest component of their bucket are compared with all
of its other members, each two components by their closest pair; then, in the
buckets where such pairs were found, whatever pairs of different components are
left.  A parity bitmap (four bits and more for each token that linked sets may
differ in, at most two for each of its own) bounds the symmetric difference
from below and only drops pairs that cannot link; every
link is verified on whole sets.

Rows shuffled: prefixes, keys, bitmaps, and the sets of candidates only.  What
a bucket is (its size, first member, signature) comes from aggregates that are
summed up before they move, so a key that a third of all rows share is a row a
task there; members meet their bucket in plain joins, which AQE splits.  The
driver sees counts.  Zones, the largest table, are there only until the keys are.

Defined results: words are lower-cased (A-Z) runs of anything but ASCII white
space; shorter texts are one shingle of all their words; null and wordless
texts have no shingles and stay alone; repeated rows get one component; texts
that share a doc_id are linked each by itself; a row with a null doc_id gets a
null component, but is linked (and dropped by ``keep_one``) like any other.
"""

from __future__ import annotations

import hashlib
import math
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import for_a_while, free_names, materialize, read, shuffle_parts, small_broadcast

#: Prefixes that hold a token before it counts as frequent.
FREQUENT = 40
#: Tokens of a set that a range of hashes holds, at least.
RANGE_TOKENS = 5
#: Representatives that ask in a tile of a bucket, those that answer, and those compared in a step.
TILE, SEGMENT, STEP = 512, 2048, 512
#: Documents whose ids are broadcast to the scan that verifies them: 16 MB.
BROADCAST_IDS = 1_000_000
#: Members that meet one set of their hub in a task, and hubs that a row of a member lists, about.
HUB_DEAL = 2000
#: Bytes of sets in an Arrow batch.
SET_BYTES = 16 << 20

# --- shingles ---------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode().translate(_FOLD), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], data != 32, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(data))
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * up[: len(data)], dtype=np.uint64)))
    return _mix((run[end] - run[start]) * down[start] + _mix((end - start).astype(np.uint64)))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``width`` words."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(_BASE) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


# --- prefixes and keys ------------------------------------------------------


def missing(n: int, percent: int) -> int:
    """Tokens of a set of n that a linked partner may lack."""
    return n - -(-n * percent // 100)


def bands(n: int, percent: int) -> list[int]:
    """Powers of two that the set is indexed for: its own, and the next if a partner may reach it."""
    b = n.bit_length() - 1
    return [b, b + 1] if n * 100 >= percent << (b + 1) else [b]


def hash_range(tokens: np.ndarray, band: int) -> np.ndarray:
    return (tokens >> np.uint64(32)) * np.uint64(1 << band) // np.uint64(RANGE_TOKENS << 32)


def _ordinal(groups: np.ndarray) -> np.ndarray:
    """How many of the same value stand before each; equal values are neighbours."""
    new = np.concatenate(([True], groups[1:] != groups[:-1]))
    at = np.arange(len(groups))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def zone(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The longest prefix that keys may need: as if all tokens were frequent."""
    need, end = missing(len(tokens), percent) + 1, 0
    for b in bands(len(tokens), percent):
        got = np.cumsum(_ordinal(hash_range(tokens, b)) >= 1)
        end = max(end, int(np.searchsorted(got, need)) + 1)
    return tokens[:end]


def index_keys(n: int, percent: int, at: np.ndarray, tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Keys of a set from the shared tokens of its zone (their places, in order)."""
    need, keys = missing(n, percent) + 1, []
    for b in bands(n, percent):
        of = hash_range(tokens[frequent], b)
        first = at[frequent][_ordinal(of) == 0] if len(of) else at[:0]  # lose a token each
        end, lost = need, 0
        while True:  # prefix length p holds p - (ranges begun before p) countable tokens
            lost_now = int(np.searchsorted(first, end))
            if lost_now == lost:
                break
            end, lost = end + lost_now - lost, lost_now
        inside = at < end
        keys.append(tokens[inside & ~frequent])
        x = tokens[inside & frequent]
        if len(x) > 1:
            g = hash_range(x, b)
            for step in range(1, len(x)):
                same = g[step:] == g[:-step]
                if not same.any():
                    break
                keys.append(_mix(_mix(x[:-step][same] + np.uint64(b)) + x[step:][same]))
    return np.unique(np.concatenate(keys))


# --- bitmaps ----------------------------------------------------------------


def parity_bitmap(tokens: np.ndarray, percent: int) -> bytes:
    """A power of two of bits: of unlike sets half differ, over twice of what links allow (from 78 % on)."""
    n = len(tokens)
    bits = max(256, 1 << (min(n, -(-8 * n * (100 - percent) // (100 + percent))) - 1).bit_length())
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold_to(words: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) halved until ``size`` words are left."""
    while words.shape[1] > size:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def may_link(away, n_sum, percent: int):
    """Whether sets of n_sum tokens together may differ in ``away`` of them."""
    return (100 - percent) * n_sum >= (100 + percent) * away


def _close(n_a, map_a, n_b, map_b, percent: int) -> np.ndarray:
    """Pairs (i, j) that sizes and bitmaps allow, with the bound on their difference."""
    out = []
    words_a, words_b = ([np.frombuffer(m, np.uint64) for m in x] for x in (map_a, map_b))
    size_a, size_b = (np.array([len(w) for w in x]) for x in (words_a, words_b))
    for s in set(size_a.tolist()):
        i = np.flatnonzero(size_a == s)
        left = np.stack([words_a[k] for k in i])
        for r in (s // 2, s, s * 2):
            j = np.flatnonzero(size_b == r)
            if not len(j):
                continue
            right, t = np.stack([words_b[k] for k in j]), min(s, r)
            right, own = fold_to(right, t), fold_to(left, t)
            for k, row in zip(i, own):
                n_sum = n_a[k] + n_b[j]
                fits = may_link(np.abs(n_b[j] - n_a[k]), n_sum, percent)
                if fits.any():
                    away = np.bitwise_count(right[fits] ^ row).sum(axis=1)
                    good = may_link(away, n_sum[fits], percent)
                    for jj, d in zip(j[fits][good], away[good]):
                        out.append((k, jj, d))
    return np.array(out, np.int64).reshape(-1, 3)


# --- the join ---------------------------------------------------------------


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, digest, zone, bitmap; the last two null where no other set can link."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                cut = b.slice(lo, 256)
                n, digest, zones, maps = [], [], [], []
                for t in cut.column("text"):
                    s = shingle_set(t.as_py(), width)
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    alone = len(s) * (100 - percent) < percent
                    zones.append(None if alone else zone(s, percent).tobytes())
                    maps.append(None if alone else parity_bitmap(s, percent))
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("text_key"), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, zones, maps))], names=["doc_id", "text_key", "n", "digest", "zone", "bitmap"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, n long, digest binary, zone binary, bitmap binary")


def _explode_zone(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            cut = b.slice(lo, 1024)
            z = [np.frombuffer(x.as_py(), np.int64) for x in cut.column("zone")]
            if z:
                size = np.array([len(x) for x in z])
                rep, n = (np.repeat(cut.column(c).to_numpy(), size) for c in ("rep", "n"))
                at = np.concatenate([np.arange(k) for k in size])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)), pa.array(rep), pa.array(n), pa.array(at.astype(np.int32))], names=["token", "rep", "n", "at"])


def _keys(percent: int):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                cut = b.slice(lo, 1024)
                reps, sizes, keys = [], [], []
                for rep, n, shared in zip(cut.column("rep").to_pylist(), cut.column("n").to_pylist(), cut.column("shared")):
                    v = shared.values
                    at = v.field("at").to_numpy()
                    order = np.argsort(at)
                    k = index_keys(n, percent, at[order].astype(np.int64), v.field("token").to_numpy()[order].view(np.uint64), v.field("often").to_numpy(zero_copy_only=False)[order])
                    reps.append(np.full(len(k), rep, np.int64))
                    sizes.append(np.full(len(k), n, np.int64))
                    keys.append(k.view(np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, reps, sizes)], names=["key", "rep", "n"])

    return run


def sets_keys(zones: DataFrame, percent: int) -> DataFrame:
    """(key, rep, n): the index keys of representatives (rep, n, zone)."""
    tokens = zones.mapInArrow(_explode_zone, "token long, rep long, n long, at int")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    known = tokens.join(shared, "token").groupBy("rep", "n").agg(F.collect_list(F.struct("at", "token", (F.col("df") > FREQUENT).alias("often"))).alias("shared"))
    return known.mapInArrow(_keys(percent), "key long, rep long, n long")


def buckets(keys: DataFrame, percent: int) -> DataFrame:
    """(key, rep, m): index keys that m >= 2 representatives share, one key for each set of them.

    Sizes of linked sets differ by a factor under 100 / percent, so each key is
    split by the logarithm of the size, neighbouring classes together.  ``keys``
    is a written table.
    """
    # a little over the largest factor, so that rounding cannot put two classes between linked sizes
    size = F.floor(F.ln("n") / math.log(100 / percent * 1.000001))
    split = keys.select(F.explode(F.array(F.xxhash64("key", size), F.xxhash64("key", size + 1))).alias("key"), "rep")
    several = split.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    with for_a_while(split.join(several, "key"), "join-shared") as shared_keys:
        members = shared_keys.groupBy("key", "m").agg(F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x"))
        chosen = members.groupBy("m", "s", "x").agg(F.min("key").alias("key")).select("key")
        return materialize(shared_keys.join(chosen, "key"), "join-buckets")


def _hub_pairs(percent: int):
    """Keeps the pairs that their bitmaps allow, with the bound on the difference."""

    def run(batches):
        for b in batches:
            c = {k: b.column(k).to_pylist() for k in ("rep", "hub", "n", "bitmap", "hub_n", "hub_map")}
            out = []
            for rep, hub, n, m, hn, hm in zip(*c.values()):
                if may_link(abs(n - hn), n + hn, percent):
                    w = [np.frombuffer(x, np.uint64)[None, :] for x in (m, hm)]
                    size = min(x.shape[1] for x in w)
                    away = int(np.bitwise_count(fold_to(w[0], size) ^ fold_to(w[1], size)).sum())
                    if may_link(away, n + hn, percent):
                        out.append((rep, hub, away))
            cols = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["rep", "hub", "away"])

    return run


#: What a row does in a tile: it asks, or asks and answers its peers, or answers.
ASKS, PEER, ANSWERS = 0, 1, 2


def _tile_pairs(percent: int, nearest_only: bool):
    """Pairs of different components in tiles that come sorted by (key, tile, segment, role).

    A tile's asking rows are held (about TILE of them), the answering ones pass
    by in steps.  Peers of a tile are compared once, by the smaller rep.
    """

    def pairs(asking, answering):
        (role_a, rep_a, comp_a, n_a), (role_b, rep_b, comp_b, n_b) = (np.array([r[:4] for r in x], np.int64).T for x in (asking, answering))
        got = _close(n_a, [r[4] for r in asking], n_b, [r[4] for r in answering], percent)
        i, j, away = got.T
        keep = (comp_a[i] != comp_b[j]) & ((role_b[j] == ANSWERS) | (rep_a[i] < rep_b[j]))
        i, j, away = i[keep], j[keep], away[keep]
        if nearest_only and len(i):
            lo, hi = np.minimum(comp_a[i], comp_b[j]), np.maximum(comp_a[i], comp_b[j])
            order = np.lexsort((rep_b[j], rep_a[i], away, hi, lo))
            first = np.concatenate(([True], (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)))
            i, j = i[order][first], j[order][first]
        return np.minimum(rep_a[i], rep_b[j]), np.maximum(rep_a[i], rep_b[j])

    def run(batches):
        tile, asking, answering = None, [], []
        found: list[list[np.ndarray]] = [[], [], []]

        def settle():
            if asking and answering:
                hub, rep = pairs(asking, answering)
                for out, x in zip(found, (np.full(len(hub), tile[0], np.int64), hub, rep)):
                    out.append(x)
            answering.clear()

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("key", "tile", "segment", "role", "rep", "comp", "n", "bitmap"))):
                if r[:3] != tile:
                    settle()
                    tile, asking = r[:3], []
                if r[3] != ANSWERS:
                    asking.append(r[3:])
                if r[3] != ASKS:
                    answering.append(r[3:])
                    # peers are settled once all that ask are here
                    if len(answering) >= STEP and r[3] == ANSWERS:
                        settle()
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["key", "hub", "rep"])
                found = [[], [], []]
        settle()
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["key", "hub", "rep"])

    return run


def cross_pairs(bucket: DataFrame, facts: DataFrame, comps: DataFrame, percent: int, nearest_only: bool) -> DataFrame:
    """(key, hub, rep): pairs of different components that share a bucket and may link.

    Only representatives outside a bucket's largest component ask.  They are
    dealt over tiles, and those that answer over segments; a pair meets in one
    tile and one segment.
    """
    now = bucket.join(comps, "rep")
    of = now.groupBy("key", "comp").agg(F.count("*").alias("c"))
    shape = of.groupBy("key").agg(F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("main"))
    shape = shape.where(F.col("all") > F.col("most")).select("key", "main", F.ceil((F.col("all") - F.col("most")) / TILE).cast("int").alias("tiles"), F.ceil(F.col("all") / SEGMENT).cast("int").alias("segments"))
    tile, segment = (F.pmod(F.xxhash64("rep", F.lit(k)), c).cast("int") for k, c in enumerate(("tiles", "segments")))
    spot = lambda t, g, role: F.struct(t.alias("tile"), g.alias("segment"), F.lit(role).alias("role"))
    outside = F.col("comp") != F.col("main")
    upto = F.sequence(F.lit(0), F.col("tiles") - 1)
    asks = F.transform(F.sequence(F.lit(0), F.col("segments") - 1), lambda g: F.when(g == segment, spot(tile, g, PEER)).otherwise(spot(tile, g, ASKS)))
    answers = F.transform(F.filter(upto, lambda t: ~outside | (t < tile)), lambda t: spot(t, segment, ANSWERS))
    spots = F.when(outside, F.concat(asks, answers)).otherwise(answers)
    rows = now.join(shape, "key").join(facts, "rep").withColumn("spot", F.explode(spots)).select("key", "spot.*", "rep", "comp", "n", "bitmap")
    rows = rows.repartition("key", "tile", "segment").sortWithinPartitions("key", "tile", "segment", "role")
    return rows.mapInArrow(_tile_pairs(percent, nearest_only), "key long, hub long, rep long")


def verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (hub, rep) whose whole sets link.  Each candidate's text is read once more.

    A hub's members are dealt over as many copies of its set as they need, and
    what a document is asked for over as many rows.
    """
    spark = docs.sparkSession
    load = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_DEAL).cast("int").alias("deals"))
    dealt = pairs.join(load, "hub").select("hub", F.pmod(F.xxhash64("rep"), "deals").cast("int").alias("deal"), F.col("rep").alias("doc_id"), F.lit(1).alias("member"))
    hubs = load.select("hub", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("hub").alias("doc_id"), F.lit(0).alias("member"))
    every = materialize(dealt.unionByName(hubs), "join-dealt")
    lists = every.groupBy("doc_id").agg(F.ceil(F.count("*") / HUB_DEAL).cast("int").alias("lists"))
    listed = every.join(lists, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("hub", "deal"), "lists").alias("list"))
    asked = materialize(listed.agg(F.collect_list(F.struct("hub", "deal", "member")).alias("to")).drop("list"), "join-asked")
    size = asked.agg(F.coalesce(F.sum(F.size("to")), F.lit(0))).first()[0]
    if size <= BROADCAST_IDS:
        asked = F.broadcast(asked)
    texts = docs.select("doc_id", "text").join(asked, "doc_id")
    names, kinds = ["hub", "deal", "member", "doc_id", "tokens"], (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def sets(batches):
        out, held = [], 0
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for b in batches:
            for doc_id, text, to in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("to")):
                s = shingle_set(text.as_py(), width).tobytes()
                for x in to.as_py():
                    out.append((x["hub"], x["deal"], x["member"], doc_id, s))
                    held += len(s)
                    if held >= SET_BYTES:
                        yield batch(out)
                        out, held = [], 0
        if out:
            yield batch(out)

    def compare(batches):
        hub, own = None, None
        for b in batches:
            linked = []
            for h, member, doc_id, tokens in zip(b.column("hub").to_pylist(), b.column("member").to_pylist(), b.column("doc_id").to_pylist(), b.column("tokens")):
                s = np.frombuffer(tokens.as_py(), np.uint64)
                if not member:
                    hub, own = h, s
                elif hub == h:
                    both = len(own) + len(s) - len(np.union1d(own, s))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        linked.append((h, doc_id))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.int64()) for k in (0, 1)], names=["hub", "rep"])

    kind = "hub long, deal int, member int, doc_id long, tokens binary"
    return texts.mapInArrow(sets, kind).repartition(shuffle_parts(spark), "hub", "deal").sortWithinPartitions("hub", "deal", "member").mapInArrow(compare, "hub long, rep long")


def merge_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, comp) after ``links`` (hub, rep): comp is the smallest member.

    Links become links of components; each component hooks onto its smallest
    neighbour, hooks are followed to their ends, until no link is left open.
    """
    a, b = comps.select(F.col("rep").alias("hub"), F.col("comp").alias("a")), comps.withColumnRenamed("comp", "b")
    open_links = materialize(links.join(a, "hub").join(b, "rep").where("a <> b").select("a", "b").distinct(), "join-links")
    while open_links.limit(1).count():
        both = open_links.unionByName(open_links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("p")).withColumn("p", F.least("a", "p"))
        hooks = materialize(hooks, "join-hooks")
        while True:
            further = hooks.select(F.col("a").alias("p"), F.col("p").alias("q"))
            step = materialize(hooks.join(further, "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "join-hooks")
            moved = step.where("moved").limit(1).count()
            hooks = step.select("a", "p")
            if not moved:
                break
        new = hooks.where("a <> p").withColumnsRenamed({"a": "comp"})
        comps = materialize(comps.join(new, "comp", "left").select("rep", F.coalesce("p", "comp").alias("comp")), "join-components")
        to = hooks.select(F.col("a").alias("old"), "p")
        open_links = open_links.join(to, F.col("a") == F.col("old")).select(F.col("p").alias("a"), "b").join(to, F.col("b") == F.col("old")).select("a", F.col("p").alias("b")).where("a <> b").distinct()
        open_links = materialize(open_links, "join-links")
    return comps


def _candidates(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, bool]:
    """(sets, classes, facts of representatives, buckets, docs by representative, whether ids are null or repeated)."""
    if not 50 <= percent <= 100:
        raise ValueError(f"similarity of {percent} %: index keys are complete from 50 % to 100 %")
    with ExitStack() as until_keys:
        with for_a_while(_sets(docs, width, percent), "join-whole") as whole:
            sets = materialize(whole.select("doc_id", "text_key", "n", "digest"), "join-sets")
            odd = sets.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count() > 0
            first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
            rep = F.xxhash64("digest").alias("rep") if odd else F.col("class_id").alias("rep")
            classes = sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class_id"), *([first] if odd else [])).select("*", rep)
            one = lambda c: whole.where("zone IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first(c).alias(c)).select(rep, "n", c)
            facts = materialize(one("bitmap"), "join-facts")
            zones = until_keys.enter_context(for_a_while(one("zone"), "join-zones"))
        with for_a_while(sets_keys(zones, percent), "join-keys") as keys:
            until_keys.close()
            bucket = buckets(keys, percent)
    if odd:
        named = classes.select("rep", F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key"))
        docs = docs.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))).select(F.col("rep").alias("doc_id"), "text")
        docs = materialize(docs.dropDuplicates(["doc_id"]), "join-named")
    return sets, classes, facts, bucket, docs, odd


def similarity_links(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(links, members): every link between classes of equal sets, and the class of each row.

    ``links`` (a, b): keys of two classes, each pair once.  ``members``: doc_id,
    text_key, class (null for texts without words).  The work grows with the
    links, as its result does; similarity_components doesn't list them.
    """
    sets, classes, facts, bucket, named, _ = _candidates(docs, width, percent)
    alone = bucket.select("rep").distinct().withColumn("comp", F.col("rep"))
    pairs = materialize(cross_pairs(bucket, facts, alone, percent, False).select("hub", "rep").distinct(), "join-pairs")
    links = verify(named, pairs, width, percent).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    of = materialize(classes.select("digest", F.col("rep").alias("class")), "join-of")
    members = sets.select("doc_id", "text_key", "digest").join(of, "digest", "left").drop("digest")
    return links, members


def similarity_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, class_id
    (smallest doc_id with an equal set), component_id (smallest doc_id reachable by links),
    text_key (hash of the text) and stays (whether it is the first of its component by
    doc_id, nulls last, and text_key).

    Representatives go by their doc_id; where ids are null or repeated, by a hash of
    their set, so that each text has its own.
    """
    sets, classes, facts, bucket, docs, odd = _candidates(docs, width, percent)
    comps = materialize(bucket.select("rep").distinct().withColumn("comp", F.col("rep")), "join-components")

    hubs = bucket.groupBy("key").agg(F.min("rep").alias("hub"))
    near = bucket.join(hubs, "key").where("rep <> hub").select("rep", "hub").distinct()
    near = near.join(facts, "rep").join(facts.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("bitmap").alias("hub_map")), "hub")
    near = near.mapInArrow(_hub_pairs(percent), "rep long, hub long, away long").groupBy("rep").agg(F.min_by("hub", F.struct("away", "hub")).alias("hub"))
    comps = merge_components(comps, verify(docs, materialize(near.select("hub", "rep"), "join-pairs"), width, percent))
    for nearest_only in (True, False):
        pairs = materialize(cross_pairs(bucket, facts, comps, percent, nearest_only), "join-pairs")
        if not pairs.limit(1).count():
            break
        comps = merge_components(comps, verify(docs, pairs.select("hub", "rep").distinct(), width, percent))
        # a bucket without such a pair has no further link between two components
        bucket = bucket.join(pairs.select("key").distinct(), "key", "left_semi")
    of = classes.join(comps, "rep", "left").withColumn("component_id", F.coalesce("comp", "rep"))
    stays = F.col("doc_id") == F.coalesce("component_id", "doc_id")
    if odd:
        of = materialize(of, "join-classes")
        ids = of.groupBy("component_id").agg(F.min("class_id").alias("smallest"), F.min("first").alias("kept"))
        of = of.join(ids, "component_id").drop("component_id").withColumnRenamed("smallest", "component_id")
        stays = F.col("kept").isNull() | (F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_key") == F.col("kept.text_key")))
    # a written table: a large class of copies is then a skewed join, whose rows Spark deals over tasks
    of = materialize(of.select("digest", "class_id", "component_id", *(["kept"] if odd else [])), "join-of")
    return sets.select("doc_id", "text_key", "n", "digest").join(of, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), *(F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c) for c in ("class_id", "component_id")), "text_key", stays.alias("stays")
    )


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the members of a component but its first (``stays``).

    ``found`` comes from similarity_components over the same rows.  Rows go by
    doc_id and text; of rows with both equal (nulls too) one stays.
    """
    found = materialize(found.select("doc_id", "text_key", "stays"), "join-found")
    own, key = free_names(docs.columns, "id", "key")
    gone = small_broadcast(found.where("NOT stays").select(F.col("doc_id").alias(own), F.col("text_key").alias(key)).distinct(), "join-gone")
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(key)), "left_anti")
    if found.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return similarity_components(docs, width=3, percent=90).select("doc_id", "n_shingles", "component_id", "class_id")


QUERIES = {"op3_ngram_join": op3_ngram_join}
