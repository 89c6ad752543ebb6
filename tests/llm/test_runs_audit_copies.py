"""Operators 11 to 13 against brute force and SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldlab.llm import divergence, exact_dedup, periodic
from fieldlab.llm.common import read
from fieldlab.llm.registry import QUERIES

from test_llm import NASTY, empty, nasty  # noqa: F401

# --- 11: periodic runs --------------------------------------------------------


def brute_runs(words, power=4, least=6):
    """All maximal stretches with smallest period q and length >= max(least, power * q), by the definition."""
    n, out = len(words), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(words[x] == words[x + e] for x in range(i, i + length - e)) for e in range(1, q))
            if length >= max(least, power * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_by_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(150):
        text = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):  # repeats, some of repeats
            base = text[-rng.randint(1, 8) :] or ["x"]
            text += base * rng.randint(1, 6) + base[: rng.randint(0, len(base))]
            text += [rng.choice("abcd") for _ in range(rng.randint(0, 3))]
        texts.append(text[:160])
    assert periodic.find_runs(texts) == [brute_runs(t) for t in texts]
    assert periodic.find_runs(texts, 2, 2) == [brute_runs(t, 2, 2) for t in texts]
    assert periodic.find_runs(texts, 3, 9) == [brute_runs(t, 3, 9) for t in texts]


def test_runs_of_long_texts():
    ab = ["a", "b"] * 40_000
    assert periodic.find_runs([ab, ["a"] * 50_000, [], ["x"]]) == [[(0, 80_000, 2)], [(0, 50_000, 1)], [], []]
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 30_000:
        fib = fib[1], fib[1] + fib[0]
    assert periodic.find_runs([fib[1]]) == [[]]  # no power of four or more in a Fibonacci word
    assert len(periodic.find_runs([fib[1][:600]], 2, 2)[0]) == len(brute_runs(fib[1][:600], 2, 2))


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def test_runs_of_the_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in read(spark, sf_dir, "documents").collect()}
    rows, some = QUERIES["op11_periodic"](spark, sf_dir).collect(), 0
    assert len(rows) == len(texts)
    for r in rows:
        words = planted(r["doc_id"], texts[r["doc_id"]])
        if len(words) > 600:
            continue  # brute force is of the third power
        runs = brute_runs(words)
        some += bool(runs)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        said = (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"])
        assert said == (len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    assert some > 5


def test_planted_repeats(spark):
    rng = random.Random(2)
    rows = [(i, "  ".join(rng.choice("uvw") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), "keep", i) for i in range(400)] + [(None, "x y", "k", 1), (3, None, "k", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, words long")
    for r in periodic.with_planted_repeats(docs).collect():
        before = rows[r["words"]][1] if r["h"] == "keep" else None
        if before is not None:
            assert r["text"].encode().split() == planted(r["doc_id"], before)
    assert docs.columns == periodic.with_planted_repeats(docs).columns


def test_runs_of_odd_rows(nasty, empty):  # noqa: F811
    docs = nasty.withColumnsRenamed({"label": "runs", "lines": "collapsed"})
    out = periodic.periodic_runs(docs, docs.columns)
    assert out.columns == [*docs.columns, "runs_", "collapsed_"]
    got = Counter((r["doc_id"], r["collapsed_"], len(r["runs_"])) for r in out.collect())
    assert got == Counter((i, "wörd" if i == 6 else " ".join((t or "").split(" ")).strip().replace("\n\t", "").strip(), int(i == 6)) for i, t, *_ in NASTY)
    assert periodic.periodic_runs(empty, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(empty, [], least_power=1)


# --- 12: source divergence ----------------------------------------------------


def brute_audit(rows, least, top):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang or "", source or "", "".join(c if ord(c) > 127 or c.isalpha() else " " for c in (text or "").translate(low)).split(" ")) for lang, source, text in rows]
    docs = [(lang, source, [w for w in words if w]) for lang, source, words in docs]
    out = []
    for lang in {d[0] for d in docs}:
        held, n = Counter(), defaultdict(Counter)
        for own, source, words in docs:
            if own == lang:
                held.update(set(words))
                n[source].update(words)
        kept = sorted(t for t in held if held[t] >= least)
        n = {s: Counter({t: c[t] for t in kept}) for s, c in n.items()}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in n.items()}, p(sum(n.values(), Counter()))
        for s in n:
            pairs = [(sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in n if o != s]
            terms = [(ps[s][t] - q[t], t) for t in kept if n[s][t] and ps[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                for k, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit], 1):
                    out.append((lang, s, part, item, v, k))
    return sorted(out)


def audit_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "İota", "e'f", "x1y", "漢字", "zeta\x00eta", "eta", "rare", "Ärger"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None, "s5", "s6", "s7"]), " ".join(rng.choices(words, [9, 8, 7, 6, 5, 4, 3, 2, 2, 2, 0.2, 3], k=rng.randint(0, 12)))) for _ in range(n)]
    return rows + [("en", "silent", None), ("en", "silent", ""), ("la", "one", "solus"), ("la", "two", None), ("", "s1", "Alpha" * 5000)]


@pytest.mark.parametrize("seed, small", [(1, False), (2, True)])
def test_audit_by_brute_force(spark, monkeypatch, seed, small):
    if small:  # many runs, merge rounds, small pieces and squares
        for name, value in (("BLOCK_POSTINGS", 60), ("PIECE", 3), ("FAN", 2), ("SOURCE_BLOCK", 2), ("TASK_ENTRIES", 10)):
            monkeypatch.setattr(divergence, name, value)
    rows = audit_rows(seed)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(5)
    assert sorted(map(tuple, divergence.audit(docs, 10, 4).collect())) == brute_audit(rows, 10, 4)


def test_merge_keeps_all_entries(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 2)
    rng = random.Random(4)
    entries = [(b"en\0\0%d" % rng.randint(0, 30), rng.choice([b"a", b"b"]), rng.randint(1, 9), 1) for _ in range(500)]
    want = Counter()
    for key, source, n, _ in entries:
        want[key, source] += n
    rows = []
    for k in range(7):
        block = Counter()
        for key, source, n, _ in entries[k::7]:
            block[key, source] += n
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*((*x, n, 1) for x, n in sorted(block.items()))), divergence._ENTRIES)], schema=divergence._ENTRIES)
        for b in divergence._pieces(0, str(k), batch):
            rows += list(zip(*(b.column(c).to_pylist() for c in ("first", "last", "piece"))))
    assert len(rows) > 50
    merged = [x for t in divergence._merged(iter(sorted(rows))) for x in zip(*(t.column(c).to_pylist() for c in ("key", "source", "n")))]
    assert [x[:2] for x in merged] == sorted(want) and all(want[x[:2]] == x[2] for x in merged)


def test_smoothed_is_exact(spark):
    big = [(10**12 + 7, 10**15 + 3, 10**7), (0, 0, 1), (3, 10, 7), (0, 5, 0)]
    df = spark.createDataFrame(big, "n long, total long, kept long")
    got = [r[0] for r in df.select(divergence.smoothed(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * k) if k else None for n, t, k in big]


def test_audit_of_odd_rows(spark, nasty, empty):  # noqa: F811
    assert divergence.audit(empty).count() == 0
    got = sorted(map(tuple, divergence.audit(nasty, 1, 50).collect()))
    assert got == brute_audit([(r[2], r[3], r[1]) for r in NASTY], 1, 50)


# --- 13: exact dedup ----------------------------------------------------------


def test_splits_by_bytes():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(300)] + [b"x" * 5000 + bytes([i % 3]) for i in range(9)] + [b""]
    groups = exact_dedup.split_equal(texts)
    assert sorted(i for g in groups for i in g) == list(range(len(texts)))
    assert len({texts[i] for g in groups for i in g[:1]}) == len(groups) and all(len({texts[i] for i in g}) == 1 for g in groups)


def copies(seed, n=600):
    rng = random.Random(seed)
    long = "shared beginning of many texts " * 40
    pool = ["", None, "a", "ab", "12345678", "123456789", "1234567", "é" * 70, long, long + "x", long + "y", long[:512], long[:64], "hot text " * 3]
    rows = [(rng.randint(0, n // 2) if rng.random() > 0.05 else None, rng.choices(pool, [1] * 13 + [9])[0] if rng.random() < 0.6 else f"{rng.random()}") for _ in range(n)]
    return rows + [rows[0], rows[0], (None, "only null"), (None, "only null")]


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        for k, i in enumerate(sorted(ids, key=lambda i: (i == top, i is None, i or 0), reverse=True)):
            out[i, top, len(ids), k == 0, sha] += 1
    return out


@pytest.mark.parametrize("light, broadcast", [((10**6, 10**7), 10**6), ((300, 300), 10**6), ((300, 300), 0), ((1, 1), 10**6)])
def test_copies_by_brute_force(spark, monkeypatch, light, broadcast):
    monkeypatch.setattr(exact_dedup, "LIGHT_BYTES", light)
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(exact_dedup, "SALTS", 3)
    rows = copies(len(str(light)) + broadcast)
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, keep_id string, node string").repartition(3)
    out = exact_dedup.exact_groups(docs, ["doc_id"])
    assert Counter(map(tuple, out.collect())) == brute_copies(rows)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    want = Counter((k[0], k[4]) for k, n in brute_copies(rows).items() if k[3] for _ in range(n))
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect()) == want


def test_copies_of_odd_rows(nasty, empty):  # noqa: F811
    assert Counter(map(tuple, exact_dedup.exact_groups(nasty, ["doc_id"]).collect())) == brute_copies([(r[0], r[1]) for r in NASTY])
    assert exact_dedup.drop_copies(empty).count() == 0 and exact_dedup.exact_groups(empty, empty.columns).count() == 0


@pytest.mark.parametrize("name, sql", [("op12_divergence", divergence.ORACLE), ("op13_exact_dedup", exact_dedup.ORACLE)])
def test_oracle_on_odd_documents(spark, tmp_path, name, sql):
    """Queries and their SQL agree beyond the given tables."""
    rows = [(i, t, lang, source) for i, ((lang, source, t), (_, c)) in enumerate(zip(audit_rows(5), copies(5))) for t in ((t or "").replace("\x00", ""), c)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = c.execute(sql[name])
    names = [x[0] for x in found.description]
    assert Counter(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*names).collect())) == Counter(found.fetchall())


# --- 10: keys of a store ------------------------------------------------------


def test_equal_prints_do_not_return_another_document(monkeypatch):
    import numpy as np

    from fieldlab.llm import token_store

    monkeypatch.setattr(token_store, "prints_of", lambda h: np.zeros(len(h), np.uint32))  # all collide
    row = token_store._shard_row(0, 4, [bytes([k, 0, 0, 0]) for k in range(6)], [2, 4, 4, 6, 8, 9], [0, 0, 1, 0, 0, 0])
    shard = token_store.Shard(row)
    found = shard.find_all(np.array([1, 2, 3, 4, 7, 9, 50]))
    assert sorted((k, int(shard.get(at)[0])) for k, at in found) == [(2, 0), (4, 1), (4, 2), (9, 5)]
