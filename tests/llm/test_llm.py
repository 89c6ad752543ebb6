"""Operators of the llm subpackage against brute force, exact round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.llm import bpe, chat_tree, common, fingerprint, language_id, line_dedup, mixing, ngram_join, quality_rules, token_store, toxicity
from fieldlab.llm.common import read
from fieldlab.llm.registry import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, label string, lines string, at long, host string"
NASTY = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, "   \n\t ", "en", "a", 6), (3, "one", "en", None, 3), (4, "one two", "en", "a", 7),
    (5, "x" * 50_000, "en", "a", 50_000), (6, "wörd " * 20_000, "de", "b", 100_000), (7, "same text here again", "en", "b", 20), (8, "same text here again", "en", "b", 20),
    (9, "<|endoftext|> a <s> [INST] \\ 😀‍", "en", "c", 30), (10, "日本語のテキスト ՘", "ja", "c", 12), (10, "日本語のテキスト ՘", "ja", "c", 12), (None, "no id at all", "en", "c", 12),
]


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 7, "clash") for r in NASTY], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in read(spark, sf_dir, "documents").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    df = QUERIES[name](spark, sf_dir)
    found = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == sorted(map(repr, found.fetchall()))


# --- 1: BPE ------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_equals_the_library(spark, sf_dir, documents, library):
    for r in QUERIES["op1_bpe"](spark, sf_dir).collect():
        ids = library.encode(documents[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_random_strings(library):
    coder = bpe.TrieBpe(open(bpe.vocabulary_path(), encoding="utf-8").read(), cache=50)
    rng = random.Random(5)
    pool = "abcdeé \n\t'sr=-0123漢😀<|endoftext|> ՘"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["a" * 3000, " " * 500, "=-" * 400, "x<|endoftext|><|endoftext|> y"]
    for lo in range(0, len(texts), 100):
        part = texts[lo : lo + 100]
        for t, ids in zip(part, coder.encode_batch(part)):
            assert ids == library.encode(t, add_special_tokens=False).ids
            assert coder.decode(ids) == t


def test_bpe_round_trip_of_odd_rows(nasty, empty):
    ids = bpe.encode(nasty, ["doc_id", "lines"])
    back = Counter((r["doc_id"], r["text"]) for r in bpe.decode(ids, ["doc_id"]).collect())
    assert back == Counter((r[0], r[1] or "") for r in NASTY)
    assert bpe.encode(empty, ["doc_id"]).count() == 0


# --- 2: language -------------------------------------------------------------


def test_language_on_held_out_rows(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in read(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op2_language_id"](spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def brute_ranks(text):
    """n-grams of a text by falling count, then by their code points."""
    counts = Counter()
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = "_" + "".join(f"{w}_" for w in words)
    counts.update("".join(words))
    for n in (2, 3):
        counts.update(line[i : i + n] for i in range(len(line) - n + 1))
    return counts


def _ranked(counts, top):
    code = lambda g: sum(ord(c) << (21 * k) for k, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]


def test_language_of_the_query_by_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: (r["text"] or "", r["lang"]) for r in read(spark, sf_dir, "documents").collect()}
    sums = defaultdict(Counter)
    for i, (text, lang) in docs.items():
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang].update(brute_ranks(text))
    top = language_id.TOP
    places = {lang: {g: k for k, g in enumerate(_ranked(c, top))} for lang, c in sums.items()}
    for r in QUERIES["op2_language_id"](spark, sf_dir).collect():
        own = _ranked(brute_ranks(docs[r["doc_id"]][0]), top)
        away = {lang: sum(abs(p[g] - k) if g in p else top for k, g in enumerate(own)) for lang, p in places.items()}
        best = min(sorted(away), key=away.get) if own else "und"
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 - away[best] / (top * len(own)) if own else 0.0)


def test_language_of_odd_rows(nasty, empty):
    p = language_id.learn_profiles(nasty)
    got = {r["doc_id"]: r for r in language_id.identify(nasty, p, ["doc_id"]).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[10]["lang_pred"] == "ja" and got[6]["lang_pred"] == "de"
    none = language_id.learn_profiles(empty)
    assert none.langs == [] and language_id.identify(nasty, none, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_ngram_ranks_by_brute_force():
    text = "the cat, the hat! Été x" * 3
    codes, n = language_id.ngram_counts(text)
    read_code = lambda c: "".join(chr((c >> k) & 0x1FFFFF) for k in (42, 21, 0)).lstrip("\0")
    assert {read_code(c): k for c, k in zip(codes.tolist(), n.tolist())} == dict(brute_ranks(text))
    assert [read_code(c) for c in language_id.ranked(codes, n, 12).tolist()] == _ranked(brute_ranks(text), 12)


# --- 3: near duplicates ------------------------------------------------------


def brute_components(texts, width, percent):
    sets, parent = {}, {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def copies(seed, groups=6, size=25, words=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, words))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t))
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize(("width", "percent", "seed", "frequent", "tile"), [(3, 90, 1, 40, 512), (3, 90, 2, 3, 8), (5, 80, 3, 4, 16)])
def test_components_by_brute_force(spark, monkeypatch, width, percent, seed, frequent, tile):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    for name, value in (("TILE", tile), ("SEGMENT", 3 * tile), ("STEP", tile), ("HUB_DEAL", 5), ("SET_BYTES", 4096)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", -1 if seed == 2 else 300_000)
    texts = copies(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(docs, width, percent).collect()}
    assert got == brute_components(texts, width, percent)


def test_links_by_brute_force(spark, monkeypatch):
    for name, value in (("FREQUENT", 3), ("TILE", 8), ("SEGMENT", 16), ("STEP", 8)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = copies(9, groups=4)
    docs = spark.createDataFrame([*texts.items(), (1000, None), (1001, "")], "doc_id long, text string")
    links, members = ngram_join.similarity_links(docs, 3, 80)
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(3)))) for i, t in texts.items()}
    of = {r["doc_id"]: r["class"] for r in members.collect()}
    assert of[1000] is None and of[1001] is None
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = {(of[i], of[j]) for i in texts for j in texts if of[i] < of[j] and near(sets[i], sets[j])}
    got = [(r["a"], r["b"]) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert all((of[i] == of[j]) == (sets[i] == sets[j]) for i in texts for j in texts)


def test_similarity_below_half_is_refused(nasty):
    with pytest.raises(ValueError):
        ngram_join.similarity_components(nasty, 3, 40)


def test_one_doc_id_with_two_texts_keeps_links(spark):
    words = [f"w{i}" for i in range(101)]
    rows = [(1, " ".join(words)), (1, "some other text " * 5), (2, " ".join(words[:-1])), (0, "nothing in common with the rest of them")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.similarity_components(docs, 3, 90).collect()}
    assert got[2, 98] == got[1, 99] == 1 and got[0, 6] == 0


def test_components_of_the_documents(spark, sf_dir, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op3_ngram_join"](spark, sf_dir).collect()}
    assert got == brute_components(documents, 3, 90)


def test_components_of_odd_rows(nasty, empty):
    found = ngram_join.similarity_components(nasty, 3, 90)
    rows = found.collect()
    assert len(rows) == len(NASTY)
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert got[8] == 7 and got[2] == 2 and got[None] is None and got[10] == 10
    kept = ngram_join.keep_one(nasty, found)
    assert kept.columns == nasty.columns and kept.count() == len(NASTY) - 2
    assert ngram_join.similarity_components(empty).count() == 0


def test_texts_of_one_doc_id_stay_and_go_by_themselves(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    near = {k: t + " more" for k, t in text.items()}
    rows = [(2, text["a"]), (5, text["a"]), (5, text["b"]), (7, near["b"]), (5, text["c"]), (None, text["d"]), (None, text["d"]), (None, near["d"]), (None, text["a"]), (None, text["e"]), (9, near["e"]), (11, text["f"]), (11, near["f"]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.keep_one(docs, ngram_join.similarity_components(docs)).collect()]
    sure = {(2, text["a"]), (5, text["b"]), (5, text["c"]), (9, near["e"]), (None, None)}
    assert sure <= set(got) and len(got) == len(sure) + 2
    assert len({(None, text["d"]), (None, near["d"])} & set(got)) == 1 and len({(11, text["f"]), (11, near["f"])} & set(got)) == 1


# --- 4: lines ----------------------------------------------------------------


def test_lines_of_odd_rows(spark, nasty, empty):
    out = line_dedup.drop_boilerplate(nasty)
    assert out.columns == [*nasty.columns, "n_lines", "n_dropped"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"] is None and got[0]["n_lines"] == 0 and got[1]["text"] == "" and got[1]["n_lines"] == 1
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_lines_with_columns_of_the_same_names(spark):
    rows = [(i, f"http://H{i % 2}.example.org:80/{i}", f"menu\nbody {i}", 5, "kept", "x") for i in range(20)] + [(99, "no url", "menu", 5, "kept", "x")]
    docs = spark.createDataFrame(rows, "page_id long, url string, text string, n_lines long, `page.url` string, __host string")
    out = line_dedup.drop_boilerplate(docs, host=line_dedup.host_of(F.col("url")))
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped"]
    got = {r["page_id"]: r for r in common.materialize(out, "test").collect()}
    assert all(got[i]["text"] == f"body {i}" and got[i]["n_dropped"] == 1 and got[i]["n_lines"] == 5 and got[i]["page.url"] == "kept" for i in range(20))
    assert got[99]["text"] == "menu"
    hosts = line_dedup.boilerplate(docs, host=line_dedup.host_of(F.col("url"))).collect()
    assert {r["host"] for r in hosts} == {"h0.example.org", "h1.example.org"}


def test_lines_of_raw_pages(spark, sf_dir):
    from urllib.parse import urlsplit

    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("html", ">", ">\n").alias("text"))
    rows = {r["page_id"]: (urlsplit(r["url"]).hostname, r["text"]) for r in pages.collect()}
    strip = lambda x: x.strip(" \t\r\x0b\x0c")
    per, held = Counter(h for h, _ in rows.values()), Counter((h, x) for h, t in rows.values() for x in {strip(y) for y in t.split("\n")})
    bad = lambda h, x: x and held[h, x] - 0.3 * per[h] > 0.5 * held[h, x] ** 0.5
    out = line_dedup.drop_boilerplate(pages, host=line_dedup.host_of(F.col("url")), ratio=0.3, sure=0.5, distinct=False)
    for r in out.collect():
        h, t = rows[r["page_id"]]
        assert r["text"] == "\n".join(x for x in t.split("\n") if not bad(h, strip(x)))


def test_both_ways_to_the_pages(spark, sf_dir, monkeypatch):
    pages = [(i, f"h{i % 2}", f"menu \nbody {i}\n\n menu\t\nfoot {i % 9}") for i in range(60)]
    docs = spark.createDataFrame(pages, "doc_id long, source string, text string")
    a = sorted(map(repr, line_dedup.drop_boilerplate(docs, ratio=0.2).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert a == sorted(map(repr, line_dedup.drop_boilerplate(docs, ratio=0.2).collect()))
    assert all("menu" not in x and "body" in x and "n_dropped=2" in x for x in a)


def test_pipeline_drops_lines_of_a_few_pages_in_a_hundred(spark, sf_dir):
    import corpus_pipeline as cp

    body = {i: f"body {i}" + ("\nmenu" if i % 25 == 0 else "") + ("\nchance" if i < 4 else "") for i in range(200)}
    body |= {i: "one page\nmany copies" for i in range(200, 220)}
    docs = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in body.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in cp.drop_repeated_lines(spark, docs, sf_dir).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: t.replace("\nmenu", "") for i, t in body.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


# --- 5: chats ----------------------------------------------------------------


def chat_digests(turns):
    """n_turns, turns_sha256, loss_chars, loss_sha256 of (role, text) turns."""
    loss = "".join(x for r, x in turns if r == "assistant")
    said = "".join(f"{a}\n{b}\n" for a, b in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def _digests(r):
    return r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]


@pytest.mark.parametrize("parts", ["4", "61"])
def test_chats_read_back(spark, parts):
    said = ["hi", "</s>[INST] ok [/INST]", "a\\b <s>", "", None, "[ROLE] x [IS] ", " [/INST]", "😀\n"]
    rng, rows = random.Random(3), []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, ["user", "assistant", "system", "tool [IS]", None][0 if t == 0 else rng.randrange(5)], "hello" if t == 0 and c % 3 else rng.choice(said)))
    rows += [(100, t, r, x) for c, t, r, x in rows if c == 1]
    rows += [(200, 0, "user\0x", "y"), (201, 0, "user", "x\0y"), (202, 0, "user", "5 4 "), (203, 0, "user5 4 ", "")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        segments, members = chat_tree.format_conversations(chats)
        got = {r["conv_id"]: r for r in chat_tree.read_back(segments, members).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    per = defaultdict(list)
    for c, t, r, x in rows:
        per[c].append((r or "", x or ""))
    assert {c: _digests(r) for c, r in got.items()} == {c: chat_digests(turns) for c, turns in per.items()}
    nodes = {tuple(turns[: k + 1]) for turns in per.values() for k in range(len(turns))}
    seg = segments.orderBy("start").collect()
    assert len(seg) == len(nodes)
    at = id_at = 0
    ids = [i for s in seg for i in s["ids"]]
    for s in seg:
        assert (s["start"], s["id_start"]) == (at, id_at)
        assert sum(a["length"] for a in s["ancestors"]) == s["position"] and sum(a["length"] for a in s["id_ancestors"]) == s["position_id"]
        assert all(a["start"] + a["length"] <= s["start"] for a in s["ancestors"]) and all(a["start"] + a["length"] <= s["id_start"] for a in s["id_ancestors"])
        at, id_at = at + s["length"], id_at + len(s["ids"])
    coder = bpe.TrieBpe(open(bpe.vocabulary_path(), encoding="utf-8").read())
    by_start = {s["start"]: s for s in seg}
    for s in seg:  # attended tokens and own ones spell the conversation up to here; loss tokens spell the loss
        seen = [i for a in s["id_ancestors"] for i in ids[a["start"] : a["start"] + a["length"]]] + s["ids"]
        text = "".join(x["text"] for x in seg for a in s["ancestors"] if a["start"] <= x["start"] < a["start"] + a["length"]) + s["text"]
        assert coder.decode(seen) == text
        for m, k in zip(s["loss"], s["id_loss"]):
            assert coder.decode(s["ids"][k["start"] : k["start"] + k["length"]]) == s["text"][m["start"] : m["start"] + m["length"]]
        assert s["nodes"] is None or [by_start[n]["depth"] for n in s["nodes"]] == list(range(len(s["nodes"])))
    for r in chat_tree.token_rows(segments).collect():
        assert r["position_ids"] == list(range(r["position_ids"][0], r["position_ids"][0] + len(r["ids"])))


def test_chats_of_the_query(spark, sf_dir):
    per = defaultdict(list)
    for r in read(spark, sf_dir, "conversations").collect():
        per[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    per[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in QUERIES["op5_chat_tree"](spark, sf_dir).collect()}
    assert {c: _digests(r) for c, r in got.items()} == {c: chat_digests([x[1:] for x in sorted(turns)]) for c, turns in per.items()}
    assert got[-1]["formatted_chars"] > len("</s>[INST] ok [/INST]") * 2


def test_odd_conversations(spark):
    rows = [(None, 1, "user", "a"), (None, 0, "user", "b"), (7, 0, "user", "x"), (7, 0, "user", "x"), (8, None, "user", "late?"), (8, 0, "assistant", "y"), (9, 0, "user", "long " * 30_000)]
    chats = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, path string")
    got = {r["conv_id"]: r for r in chat_tree.read_back(*chat_tree.format_conversations(chats)).collect()}
    assert _digests(got[None]) == chat_digests([("user", "b"), ("user", "a")]) and got[7]["n_turns"] == 2 and got[9]["n_turns"] == 1
    assert _digests(got[8]) == chat_digests([("user", "late?"), ("assistant", "y")])


def test_no_chats(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_tree.read_back(*chat_tree.format_conversations(none)).count() == 0


# --- 6: toxicity -------------------------------------------------------------


def test_folding_and_exceptions():
    lex = toxicity.Lexicon({"idiot": 5.0, "moron": 4.0}, {"viiiage idiot"}, (-2.0, 2.0, 0.0))
    assert toxicity.folded_words("1d10t іdiоt IDI0T! mor​on") == ["idiot", "idiot", "idiot", "moron"]
    assert lex.measure("you 1d10t")[0] == 5 and lex.measure("the village idiot")[0] == 0 and lex.measure("idiots")[0] == 0
    assert lex.score(None) == lex.score("") == lex.score("fine") < 0.7 < lex.score("you idiot")


def test_toxicity_learns_planted_words(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("bcdfgaeiou") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [rng.choice(vocabulary) for _ in range(60)]
        if toxic:
            words[5], words[40] = rng.choice(["vilewort", "nastling"]), "vilewort"
        elif i % 5 == 0:
            words[3:5] = ["holy", "nastling"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lex = toxicity.learn_lexicon(docs, labels.where("doc_id % 3 <> 1"))
    assert "viiewort" in lex.words
    got = toxicity.score_texts(docs, lex, ["doc_id"]).join(labels, "doc_id").where("doc_id % 3 = 1").collect()
    assert all((r["score"] >= 0.7) == bool(r["toxic"]) for r in got)


def brute_measure(lex, text):
    """Sum of weights over the words whose match no exception phrase takes back; and that per 100 words."""
    words = toxicity.folded_words(text)
    weigh = lambda w: max([0.0, *(x for k, x in lex.words.items() if k == w or (k.endswith("*") and w.startswith(k[:-1])))])
    weights = {w: weigh(w) for w in set(words)}
    back = {i + (weights[b] > weights[a]) for i, (a, b) in enumerate(zip(words, words[1:])) if f"{a} {b}" in lex.phrases}
    total = sum(weights[w] for i, w in enumerate(words) if i not in back)
    return total, 100 * total / len(words) if words else 0.0


def test_a_match_is_taken_back_once():
    lex = toxicity.Lexicon({"damn": 3.0, "idiot": 3.0}, {"nice damn", "damn joke", "idiot damn"})
    for text, want in (("nice damn joke you idiot", 3), ("you idiot", 3), ("nice damn joke", 0), ("idiot damn", 3), ("nice damn damn joke", 0), ("damn", 3), ("idiot idiot damn joke", 3)):
        assert lex.measure(text)[0] == want == brute_measure(lex, text)[0]


def test_toxicity_of_the_query_by_brute_force(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    lex = toxicity.learn_lexicon(docs, labels.where(toxicity.id_fold("doc_id", 3) != 1), least_docs=1, least_ratio=6.0)
    assert any(k.endswith("*") for k in lex.words) and any(not k.endswith("*") for k in lex.words)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score_texts(docs, lex, ["doc_id"]).collect():
        a, b = brute_measure(lex, texts[r["doc_id"]])
        z = lex.link[0] + lex.link[1] * np.log1p(a) + lex.link[2] * np.log1p(b)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    rows = QUERIES["op6_toxicity"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in read(spark, sf, "labels").collect()}
    rows = [r for r in QUERIES["op6_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    caught = [r["predicted"] for r in rows if toxic[r["doc_id"]]]
    assert sum(caught) >= 0.75 * len(caught) and not any(r["predicted"] for r in rows if not toxic[r["doc_id"]])


def test_scores_beside_columns_of_the_same_name(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(1, "fine", 0.1, "u", "d"), (2, "you idiot", 0.2, "u", "d")], "doc_id long, text string, score double, `page url` string, `a.b` string")
    lex = toxicity.Lexicon({"idiot": 5.0}, frozenset(), (-2.0, 2.0, 0.0))
    out = common.materialize(toxicity.score_texts(docs, lex, docs.columns), "test")
    assert out.columns == [*docs.columns, "score_"] and {r["doc_id"]: r["score"] for r in out.collect()} == {1: 0.1, 2: 0.2}
    full = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(9), "n_lines": F.lit(1), "n_dropped": F.lit(77), "ids": F.lit("i"), "__kept": F.lit(1), "__id": F.lit(1), "__place": F.lit(1), "__gone": F.lit(1), "__key": F.lit(1), "id": F.lit(1), "place": F.lit(2), "key": F.lit(3)})
    now = full
    for _, stage in cp.STAGES[:4]:
        now = common.materialize(stage(spark, now, "/root/testdata/sf0.001"), "test")
        assert now.columns == full.columns
    assert {r["n_dropped"] for r in now.collect()} <= {77}
    for f in (lambda k: bpe.round_trip(full, k, with_ids=True), lambda k: bpe.encode(full, k), lambda k: fingerprint.fingerprints(full, k), lambda k: quality_rules.with_stats(full, k), lambda k: language_id.identify(full, language_id.Profiles({}), k)):
        out = common.materialize(f(full.columns), "test")
        assert out.count() == 2 and len(set(out.columns)) == len(out.columns)


def test_toxicity_of_odd_rows(spark, nasty, empty):
    lex = toxicity.learn_lexicon(nasty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert lex.words == {} and {r["score"] for r in toxicity.score_texts(nasty, lex, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score_texts(empty, lex, ["doc_id"]).count() == 0


# --- 7: mixing ---------------------------------------------------------------


def brute_mix(rows, slots_a_source, block_words):
    """(taken, first slot, slots) of each document, slot by slot; rows are (doc_id, words, source)."""
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, t in rows if t == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        free = [s for s in names if s not in full]
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / (sum(weight[s] for s in free) or 1)
        over = {s for s in free if weight[s] * level >= 2 * size[s]}
        if not over:
            break
        full |= over
    quota = {s: round(2 * size[s] if s in full else weight[s] * level) for s in names}
    total = sum(quota.values())
    block = max(1, min(block_words, total // (slots_a_source * len(names))))
    line = {s: [] for s in names}
    for s in names:  # the words of a source in shuffled order, read twice
        for i, n, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"mix{r[0]}".encode()).hexdigest()):
            line[s] += [i] * n
        line[s] *= 2
    taken, slots = Counter(), defaultdict(list)
    n_slots, its = -(-total // block), defaultdict(list)
    for slot in range(n_slots):
        point, upto = (slot + 1) * mixing.GOLDEN % 2**64 / 2**64, 0
        for s in names:
            upto += quota[s]
            if quota[s] and (point < upto / total or s == names[-1]):
                its[s].append(slot)
                break
    for s in names:
        if quota[s] and not its[s]:
            before = sum(quota[x] for x in names[: names.index(s)])
            its[s] = [int((before / total + (before + quota[s]) / total) / 2 * n_slots)]
        for r, slot in enumerate(its[s]):  # the last slot ends with the target
            got = line[s][: quota[s]][r * block : None if r == len(its[s]) - 1 else (r + 1) * block]
            taken.update(got)
            for i in set(got):
                slots[i].append(slot)
    return {i: (taken[i], slots[i]) for i, _, _ in rows}, quota, block


def test_mix_by_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 40), ([*["hot"] * 6, "b", "c", None])[i % 9]) for i in range(900)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "SLOTS", 300)
    line, sources, pieces = mixing.mix(docs)
    got = {r["doc_id"]: r for r in mixing.taken_words(line, pieces).collect()}
    want, quota, block = brute_mix(rows, 300, 4096)
    by = Counter()
    for i, n, s in rows:
        taken, slots = want[i]
        assert (got[i]["taken"], got[i]["first_slot"]) == (taken, min(slots, default=None)) and taken <= 2 * n
        assert got[i]["n_slots"] >= len(slots)  # a block may hold the end of one reading and the start of the next
        by[s] += taken
    assert block > 1 and by == Counter(quota)
    assert {r["source"]: round(r["target"]) for r in sources.collect()} == quota
    again = mixing.taken_words(*[x for k, x in enumerate(mixing.mix(docs)) if k != 1]).collect()
    assert sorted(map(repr, got.values())) == sorted(map(repr, again))
    monkeypatch.setattr(mixing, "GOLDEN", 1 << 62)  # without its schedule the mix is another one
    line, _, pieces = mixing.mix(docs)
    assert {r["doc_id"]: r["first_slot"] for r in mixing.taken_words(line, pieces).collect()} != {i: r["first_slot"] for i, r in got.items()}


def test_small_sources_meet_their_targets(spark):
    """Sources of 1, 40 and 400 words beside one of a million."""
    rows = [(i, 5000, "huge") for i in range(200)] + [(200, 1, "a"), *((201 + i, 4, "b") for i in range(10)), *((211 + i, 20, "tiny") for i in range(20)), (231, 0, "none")]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string")
    line, sources, pieces = mixing.mix(docs)
    got = {r["doc_id"]: r for r in mixing.taken_words(line, pieces).collect()}
    by = Counter()
    for i, n, s in rows:
        by[s] += got[i]["taken"]
        assert got[i]["taken"] <= 2 * n
    target = {r["source"]: r["target"] for r in sources.collect()}
    assert {s: round(t) for s, t in target.items()} == by and (by["a"], by["b"], by["tiny"], by["none"]) == (2, 80, 800, 0)
    want, _, _ = brute_mix(rows, mixing.SLOTS, 4096)
    assert {i: (r["taken"], r["first_slot"]) for i, r in got.items()} == {i: (t, min(slots, default=None)) for i, (t, slots) in want.items()}
    whole = Counter(r["source"] for r in mixing.whole_documents(docs, line, pieces).collect())
    assert (whole["a"], whole["b"], whole["tiny"]) == (2, 20, 40)


def test_mix_of_odd_rows(nasty, empty, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    for df in (nasty, empty):
        line, _, pieces = mixing.mix(df)
        assert mixing.taken_words(line, pieces).count() == df.count()
        assert mixing.whole_documents(df, line, pieces).columns == df.columns


def test_whole_documents_come_in_slot_order(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 40), "abc"[i // 300]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    line, _, pieces = mixing.mix(docs)
    first, words = {}, Counter()
    for r in pieces.collect():
        k = r["doc_id"], r["epoch"]
        words[k] += r["words"]
        at = (r["slot"] is None, r["slot"] or 0, r["block"])
        first[k] = min(first.get(k, at), at)
    size = {i: t.count("w") for i, t, _ in rows}
    want = sorted((at, i) for (i, e), at in first.items() if 2 * words[i, e] >= size[i])
    got = [r["doc_id"] for r in mixing.whole_documents(docs, line, pieces).collect()]
    assert Counter(got) == Counter(i for _, i in want)
    place = {i: [at for at, k in want if k == i] for i in set(got)}
    seen = [place[i].pop(0) for i in got]
    assert seen == sorted(seen)
    whole, part = (Counter(rows[i][2] for i in x) for x in (got, got[: len(got) // 4]))
    assert all(abs(part[s] / len(got) * 4 - whole[s] / len(got)) < 0.1 for s in "abc")


# --- 8: fingerprints ---------------------------------------------------------


def test_fingerprints(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in QUERIES["op8_fingerprint"](spark, sf_dir).collect()}
    order = sorted(documents, reverse=True)
    assert len(got) == len(order)
    for i, nxt in zip(order, [*order[1:], order[0]]):
        a, b, r = documents[i] or "", documents[nxt] or "", got[i]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        fa, fe = (fingerprint.digest(x.encode()) for x in (a, edited))
        assert r["fingerprint"] == fingerprint.as_text(fa) and r["edited_fingerprint"] == fingerprint.as_text(fe)
        assert r["near_edited"] == fingerprint.likeness(fa, fe) and r["near_next"] == fingerprint.likeness(fa, fingerprint.digest(b.encode()))
        assert (fingerprint.from_text(r["fingerprint"]) == fa).all()
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()])


def test_ranges_of_any_number(spark):
    import bisect

    rng = random.Random(2)
    bounds = sorted({rng.randint(-(10**12), 10**12) for _ in range(5000)})
    keys = [*rng.sample(bounds, 300), *(b + 1 for b in bounds[:300]), bounds[0] - 1, bounds[-1] + 1, None]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", common.range_number(F.col("k"), bounds).alias("n"))
    assert all(r["n"] == (0 if r["k"] is None else bisect.bisect_left(bounds, r["k"])) for r in df.collect())


def test_fingerprints_at_many_partitions(spark, sf_dir):
    few = sorted(map(repr, QUERIES["op8_fingerprint"](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "700")
    try:
        assert few == sorted(map(repr, QUERIES["op8_fingerprint"](spark, sf_dir).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_likeness_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.concatenate((rng.integers(0, 90, 1), rng.integers(0, 4, 128))).astype(np.uint8) for _ in range(2))
        away = min(12, abs(int(a[0]) - int(b[0])))
        for x, y in zip(a[1:].tolist(), b[1:].tolist()):
            away += 6 if abs(x - y) == 3 else abs(x - y)
        assert fingerprint.likeness(a, b) == 1 - min(208, away) / 208


def test_digest_by_brute_force():
    data = "grüße aus dem Feld, grüße!".encode()
    counts = [0] * 128
    for a, b, c in zip(data, data[1:], data[2:]):
        counts[((((a << 16) | (b << 8) | c) * 2654435761) % (1 << 32)) >> 25] += 1
    q = sorted(counts)
    q = q[31], q[63], q[95]
    assert fingerprint.digest(data)[1:].tolist() == [sum(c > x for x in q) for c in counts]


def test_fingerprints_of_odd_rows(nasty, empty):
    rows = fingerprint.with_successor(nasty).mapInArrow(fingerprint._compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in NASTY)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (7, 8)}) == 1
    assert fingerprint.with_successor(empty).count() == 0 and fingerprint.fingerprints(empty, ["doc_id"]).count() == 0


# --- 9: quality --------------------------------------------------------------


def brute_stats(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_stats_by_brute_force(spark, sf_dir, documents):
    for r in QUERIES["op9_quality_rules"](spark, sf_dir).collect():
        n, chars, symbols, dup, rep = want = brute_stats(documents[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and (not r["kept"] or not r["base_failed"])
    for t in ("a b c a b c a b c", "x x x x", "a b c d a b c", "\n\na\na\n \n", "a b", ""):
        assert quality_rules.text_stats(t)[:5] == brute_stats(t)


def test_rules_find_thresholds(spark):
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = quality_rules.fit_decision_list(x, bad, ["a", "b", "c"])
    df = spark.createDataFrame([(*map(float, v), bool(y)) for v, y in zip(x, bad)], "a double, b double, c double, bad boolean")
    got = df.select(quality_rules.rule_number(rules).isNotNull().alias("hit"), "bad").collect()
    assert np.mean([r["hit"] == r["bad"] for r in got]) > 0.97
    assert quality_rules.fit_decision_list(x, np.zeros(3000, bool), ["a", "b", "c"]) == []


def test_verdicts_of_the_query(spark, sf_dir, documents):
    labels = {r["doc_id"]: r["quality"] for r in read(spark, sf_dir, "labels").collect() if r["doc_id"] in documents}
    stats = {i: quality_rules.text_stats(t) for i, t in documents.items()}
    names = [x.split()[0] for x in quality_rules.STATS.split(", ")]

    def feature(i, f):
        v = dict(zip(names, stats[i]))
        a, _, b = quality_rules.FEATURES[f].partition(" / ")
        return float(v[a]) if not b else v[a] / v[b] if v[b] else 0.0

    ids = sorted(labels)
    x, bad = np.array([[feature(i, f) for f in quality_rules.FEATURES] for i in ids]), np.array([labels[i] == 0 for i in ids])
    order = np.random.default_rng(7).permutation(len(ids))
    rules = quality_rules.fit_decision_list(x[order], bad[order], list(quality_rules.FEATURES))
    assert rules
    for r in QUERIES["op9_quality_rules"](spark, sf_dir).collect():
        hit = [all((feature(r["doc_id"], f) <= v) == (op == "<=") for f, op, v in rule) for rule in rules]
        assert r["rule"] == (hit.index(True) + 1 if any(hit) else None)
        assert r["kept"] == (not r["base_failed"] and not any(hit))


def test_rules_hold_on_the_prune_rows():
    rng = np.random.default_rng(2)
    x, bad = rng.random((900, 2)), rng.random(900) < 0.3  # nothing to learn
    assert quality_rules.fit_decision_list(x, bad, ["a", "b"]) == []
    bad = x[:, 0] > 0.7
    wrong = bad.copy()
    wrong[2::3] = ~bad[2::3]  # the prune rows deny what the others say
    assert quality_rules.fit_decision_list(x, bad, ["a", "b"]) and quality_rules.fit_decision_list(x, wrong, ["a", "b"]) == []


def test_quality_of_odd_rows(spark, nasty, empty):
    f = quality_rules.with_features(quality_rules.with_stats(nasty, ["doc_id"]))
    assert f.count() == len(NASTY)
    assert quality_rules.learn_rules(f, spark.createDataFrame([], "doc_id long, quality int")) == []
    assert quality_rules.with_features(quality_rules.with_stats(empty, ["doc_id"])).count() == 0


# --- 10: token store ---------------------------------------------------------


def test_store_equals_the_library(spark, sf_dir, documents, library):
    got = {r["doc_id"]: r for r in QUERIES["op10_token_store"](spark, sf_dir).collect()}
    at = 0
    for i in sorted(documents):
        ids = library.encode(documents[i] or "", add_special_tokens=False).ids + [0]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_store_of_odd_rows(spark, nasty, empty, library, tmp_path):
    token_store.write_store(nasty, str(tmp_path / "a"), shard_ids=20)
    store = spark.read.schema(token_store.SCHEMA).parquet(str(tmp_path / "a"))
    assert Counter(r["doc_id"] for r in token_store.read_documents(store).collect()) == Counter(r[0] for r in NASTY)
    found = token_store.lookup(store, [9, 10, 77]).collect()
    want = library.encode(NASTY[10][1], add_special_tokens=False).ids + [0]
    assert [r["ids"] for r in found if r["doc_id"] == 10] == [want, want]
    assert Counter(r["doc_id"] for r in found) == {9: 1, 10: 2}
    token_store.write_store(empty, str(tmp_path / "b"))
    assert token_store.read_documents(spark.read.schema(token_store.SCHEMA).parquet(str(tmp_path / "b"))).count() == 0


def test_store_of_whole_texts_is_the_same(library):
    definition = open(bpe.vocabulary_path(), encoding="utf-8").read()
    texts = ["", "plain words here", "<|endoftext|> x", "tabs\t\tand  blanks ", "ՠ日本語 ok", "don't we'll I'm"] * 3
    words, whole = token_store.LibraryEncoder(definition), token_store.LibraryEncoder(definition, whole=True)
    assert words.encode(texts) == whole.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def test_a_difference_stops_the_store(monkeypatch):
    encoder = token_store.LibraryEncoder(open(bpe.vocabulary_path(), encoding="utf-8").read())
    monkeypatch.setattr(token_store, "VERIFY", 1)
    monkeypatch.setattr(encoder, "_encode_words", lambda texts: [b"" for _ in texts])
    with pytest.raises(ValueError):
        encoder.encode(["some text"])


def test_other_tokenizers_are_refused(library):
    import json

    spec = json.loads(open(bpe.vocabulary_path(), encoding="utf-8").read())
    bpe.check_byte_level(spec)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"pre_tokenizer": None}):
        with pytest.raises(ValueError):
            bpe.TrieBpe(json.dumps({**spec, **change}))
    lower = token_store.LibraryEncoder(json.dumps({**spec, "normalizer": {"type": "Lowercase"}}))
    assert lower.whole and lower.encode(["ABC"]) == [np.array(library.encode("abc").ids, "<u2").tobytes()]


def test_lookup_of_many_keys(spark, library, tmp_path):
    rows = [(i * 3, f"text number {i}") for i in range(6000)] + [(900, f"again {k} " * 5) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_store.write_store(docs, str(tmp_path / "s"), shard_ids=500)
    store = spark.read.schema(token_store.SCHEMA).parquet(str(tmp_path / "s"))
    assert store.where("first_nth > 0").count() > 0  # a key that goes on in further shards
    want = defaultdict(list)
    for k, t in rows:
        want[k].append(library.encode(t, add_special_tokens=False).ids + [0])
    got = defaultdict(list)
    for r in token_store.lookup(store, list(range(10_000))).collect():
        got[r["doc_id"]].append(r["ids"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if k < 10_000}
    few = token_store.lookup(store, spark.createDataFrame([(3,), (4,), (None,), (3,)], "doc_id long")).collect()
    assert [(r["doc_id"], r["ids"]) for r in few] == [(3, want[3][0])]
    assert token_store.lookup(store, []).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997])
def test_perfect_hash(n):
    keys = np.arange(n) * 31 - 5
    h = token_store.key_hash(keys, np.zeros(n, np.int64))
    assert sorted(token_store.slots(h, token_store.build_pilots(h), n).tolist()) == list(range(n))


# --- pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir, library):
    import corpus_pipeline as cp

    docs = read(spark, sf_dir, "documents")
    kept = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = cp.materialize(stage(spark, docs, sf_dir), "test")
        if k < 4:
            assert out.columns == docs.columns
        if k == 2:
            want = brute_components({r["doc_id"]: r["text"] for r in docs.collect()}, 5, 80)
            assert {r["doc_id"] for r in out.collect()} == {i for i, (_, c) in want.items() if c == i}
        kept.append(out.count())
        before, docs = docs, out
    assert kept[0] == kept[1] >= kept[2] and kept[3] == kept[4]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in docs.collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_pipeline_leaves_one_table(spark, sf_dir):
    import os

    import corpus_pipeline as cp

    base = common.shared_dir(spark)
    before = set(os.listdir(base))
    rows = cp.run(spark, sf_dir)
    left = set(os.listdir(base)) - before
    assert len(left) == 1 and rows.count() > 0 and rows.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_pipeline_of_odd_rows(spark, nasty, sf_dir):
    import corpus_pipeline as cp

    docs = nasty.select("doc_id", "text", "lang", "source", "n_chars", F.col("label").alias("extra"))
    for _, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, sf_dir), "test")
    assert docs.count() > 0
