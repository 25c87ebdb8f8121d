"""Language model, prefix trie and lexical search against brute force on small tables, with their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.llm import language_model as lm
from callscope.llm import lexical_search, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string, score string, rank string, t string"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    common = ["the", "of", "La", "über", "x1"]
    rare = ["".join(r.choice("abcdefé") for _ in range(r.randint(2, 6))) for _ in range(300)]
    made = [" ".join(r.choice(common if r.random() < 0.5 else rare) for _ in range(r.randint(1, 60))) for _ in range(150)]
    return [*made, None, "", " .,;\n", made[3], made[3], "the " * 4000, "The\x85of LA-über", "É é\x00x1", " ".join(rare)]


# --- ranked lexical search


def brute_search(docs, items, k=10):
    found = [(i, collections.Counter(TERM.findall(ascii_lower(t or "")))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in TERM.findall(ascii_lower(text or "")) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def searched(docs, items, **more):
    return sorted(map(tuple, lexical_search.search(docs, items, **more).collect()), key=repr)


def test_search_equals_brute_force(spark, texts, monkeypatch):
    docs = [*enumerate(texts), (None, texts[0]), (None, texts[1])]
    items = [(i, t) for i, t in enumerate([texts[0], texts[40], texts[77] + " the the the", "the of", "nowhere", None, "", "X1 la über"])]
    frame = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in docs], DOCS).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items)
    assert searched(frame, asked) == want
    # more shards, blocks of items
    monkeypatch.setattr(lexical_search, "SHARD", 300)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 3)
    assert searched(frame.coalesce(1), asked) == want
    assert searched(frame, asked, k=1000) == brute_search(docs, items, 1000)


def test_search_keeps_ties_and_repeated_items(spark):
    docs = [(i, "same words here" if i % 3 else "other") for i in range(60)]
    items = [("a", "words"), ("a", "words"), ("b", "other words")]
    got = searched(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert got == brute_search(docs, items)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert searched(none, items) == []
    assert searched(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)) == []


def test_reading_stops_before_the_ends_of_lists():
    r = np.random.default_rng(1)
    n = 20_000
    doc = np.repeat(np.arange(n), 2)
    code = np.tile(np.array([0, 1]), n)
    impact = r.integers(1, 1000, 2 * n)
    impact[:40] = 5000 + np.arange(40)  # the first 20 documents stand out in both lists
    shard = lexical_search.Shard(np.arange(n), np.zeros(n, dtype=bool), doc, code, impact)
    top, slot = lexical_search.Top(10), np.full(2, -1, dtype=np.int64)
    scored = shard.best(0, np.array([0, 1]), np.array([1, 1]), slot, top)
    assert sorted(top.ids.tolist()) == list(range(10, 20))
    assert scored < 200
    assert (slot == -1).all()


# --- prefix trie


def brute_trie(rows):
    told = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    told = {c: [x[3:] for x in sorted(v)] for c, v in told.items()}
    made = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = told.get(c - int(math.fmod(c, 20)), [])
        made[c] = tuple(base[:h]) + tuple(own[h:])
    nodes = collections.defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        gain = (len(members) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += gain
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def grown(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted(map(tuple, prefix_trie.trie(frame.repartition(3)).collect()), key=repr)


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(3)
    rows = []
    for c in [*range(130), 400, 401, 419, -3, -25]:
        start = r.randint(0, 2)
        for t in range(r.randint(1, 9)):
            rows.append((c, t, ["user", "assistant"][t % 2], f"{'hello there' if t < 2 + start else r.choice('abc')} {t % 3}"))
    for c in range(200, 260):  # copies
        rows += [(c, t, "user", f"copy of {t}") for t in range(6)]
    rows += [(300, t, "user", f"long {t}") for t in range(150)]
    rows += [(301, t, "user", f"long {t}") for t in range(120)]
    rows += [(500, None, None, None), (500, None, "user", ""), (500, 1, None, "x"), (500, 1, "user", "x"), (500, 1, "user", "x"), (None, 1, "user", "nobody")]
    rows += [(501, -1, "user", " \t")]
    return rows


def test_trie_equals_brute_force(spark, conversations):
    assert grown(spark, conversations) == brute_trie(conversations)


def test_trie_is_the_same_in_small_pieces(spark, conversations, monkeypatch):
    for name, value in {"RANGE": 700, "SHARD": 40, "DEPTHS": 16, "LISTED": 7, "PARENTHESES": 4}.items():
        monkeypatch.setattr(prefix_trie, name, value)
    assert grown(spark, conversations) == brute_trie(conversations)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert grown(spark, []) == []
    alone = [(c, 0, "user", "a") for c in range(21, 40)]  # their base is absent; some lose their only turn
    assert grown(spark, alone) == brute_trie(alone)


def test_find_close_matches_a_stack(monkeypatch):
    monkeypatch.setattr(prefix_trie, "PARENTHESES", 8)
    r = random.Random(2)
    for n in (1, 2, 7, 50, 400):
        bits, depth, left = [], 0, n
        while left or depth:
            up = left and (not depth or r.random() < 0.55)
            bits.append(bool(up))
            depth, left = depth + (1 if up else -1), left - bool(up)
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        bits = np.array(bits)
        at = np.flatnonzero(bits)
        assert prefix_trie.find_close(bits, at).tolist() == [want[i] for i in at.tolist()]


# --- language model


def lm_rows(spark, texts):
    rows = [(i, t, "a", "b", "c", "d") for i, t in enumerate(texts)] + [(None, texts[0], "a", "b", "c", "d"), (7, texts[7], "a", "b", "c", "d")]
    return rows, spark.createDataFrame(rows, DOCS).repartition(4)


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def training():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1


def tokens(text):
    return [*WORD.findall(ascii_lower(text or "")), None]


def test_counts_and_base_scores(spark, texts, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 40)  # most words take the join
    monkeypatch.setattr(lm, "COUNTED", 50)
    rows, frame = lm_rows(spark, [*texts, "w" * 100 + " and " + "v" * 50])
    count = collections.Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    total, distinct = sum(count.values()), len(count)
    got = lm.score_documents(frame, training()).collect()
    assert len(got) == len(rows)
    want = sorted((repr(r[0]), held(r[0]), len(tokens(r[1])), sum(count[t] > 0 for t in tokens(r[1])), total, round(sum(math.log10((count[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens(r[1])), 5)) for r in rows)
    seen = sorted((repr(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 5)) for g in got)
    assert seen == want


def test_rows_of_a_null_condition_are_held_out(spark):
    frame = spark.createDataFrame([(None, "a b"), (3, "a c")], "doc_id long, text string")
    got = {g.doc_id: g for g in lm.score_documents(frame, F.col("doc_id") == 3).collect()}
    assert (got[None].held_out, got[None].n_known, got[3].held_out, got[3].train_tokens) == (True, 2, False, 3)


def test_probabilities_add_up_to_one(spark, texts, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 64)
    _, frame = lm_rows(spark, texts)
    counts = lm.count(frame)
    model = lm.train(frame, counts)
    table = {bytes(r.w): r.n for r in counts.table.collect()}
    chosen = set(counts.frequent)
    symbols = np.arange(lm.SYMBOLS)
    logp = np.array([lm.symbol_log10(model, np.array([5, 9, s]), np.array([2]))[2] for s in symbols])
    by_symbol = 10**logp
    assert by_symbol.sum() == pytest.approx(1, abs=1e-5)
    shares = collections.Counter()
    for w, n in table.items():
        if w not in chosen:
            shares[lm.suffix(w)] += (n + 0.5) / counts.masses[lm.suffix(w)]
    for s in range(lm.SUFFIXES):
        assert shares[s] + 0.5 / counts.masses[s] == pytest.approx(1)


@pytest.mark.parametrize("scale", [1, 400])
def test_products_of_exponentials_are_the_softmax(scale):
    """Both ways of normalising, of small and of large logits."""
    r = np.random.default_rng(3)
    model = lm.start_model(np.full(lm.SYMBOLS, 1 / lm.SYMBOLS))
    model.target *= scale
    symbols, ends = r.integers(0, lm.SYMBOLS, 600), np.array([99, 100, 599])
    ctx = lm.contexts(symbols, ends)
    logits = sum(t[c] for t, c in zip(model.tables(), ctx, strict=True)).astype(np.float64) @ model.target.T + model.bias
    want = logits[np.arange(600), symbols] - logits.max(axis=1) - np.log(np.exp(logits - logits.max(axis=1)[:, None]).sum(axis=1))
    assert np.allclose(lm.symbol_log10(model, symbols, ends) * np.log(10), want, rtol=1e-4, atol=1e-4)


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    noise = np.full(lm.SYMBOLS, 1 / lm.SYMBOLS)
    model = lm.start_model(noise)
    model = lm.Model.unpack(model.pack().astype(np.float64))
    ctx, goal, drawn = r.integers(0, 6, (lm.CONTEXT, 9)), r.integers(0, 6, 9), r.integers(0, 6, 5)
    log_noise = np.log(5 * noise)
    _, grad = lm.nce_loss_and_gradients(model, ctx, goal, drawn, log_noise)
    for name in ("source", "weight", "target", "bias"):
        value = getattr(model, name)
        for at in [(0,) * value.ndim, (3,) * value.ndim, (1, *(5,) * (value.ndim - 1))]:
            old, eps = value[at], 1e-5
            value[at] = old + eps
            up = lm.nce_loss_and_gradients(model, ctx, goal, drawn, log_noise)[0]
            value[at] = old - eps
            down = lm.nce_loss_and_gradients(model, ctx, goal, drawn, log_noise)[0]
            value[at] = old
            assert getattr(grad, name)[at] == pytest.approx((up - down) / (2 * eps), abs=1e-4)


def test_training_finds_symbols_without_looking_up_each_word(texts):
    long = [b"aaaaaaaa" + bytes([c]) + b"bbbbbbbb" for c in b"yz"]
    given = [None if t is None else t.encode() for t in texts] + [b"", b"\t a  B\n", b" AAAAAAAAybbbbbbbb " + long[1], None]
    counted = collections.Counter(w for t in given for w in lm.words(t))
    for frequent in ([w for w, _ in counted.most_common(200)] + long[:1], []):
        _, codes, ends = lm._encoded(given, lm.Symbols(frequent))
        symbols, places = lm.FrequentSymbols(frequent).of(given)
        assert symbols.tolist() == lm._to_symbols(codes, lm._symbol_table(frequent, frequent)).tolist()
        assert places.tolist() == ends.tolist()


def test_the_model_learns_what_follows_what(spark):
    """Two languages with the same word counts: only the words before tell which word comes."""
    r = random.Random(4)
    vocabularies = [[f"{x}{i}" for i in range(20)] for x in ("aa", "bb")]
    rows = [(i, " ".join(r.choice(vocabularies[i % 2]) for _ in range(80))) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = lm.score_documents(frame, training()).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.2  # of log10(2) = 0.30 at best


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(none, F.lit(True)).collect() == []
    only = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lm.score_documents(only, F.lit(False)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.base_score == pytest.approx(0) and math.isfinite(row.score)


def test_merging_models_by_streams(spark):
    r = np.random.default_rng(3)
    flats = r.normal(size=(70, 12))
    frame = spark.createDataFrame([(bytearray(f.tobytes()), float(i + 1)) for i, f in enumerate(flats)], "m binary, n double").repartition(9)
    want = (flats * np.arange(1, 71)[:, None]).sum(axis=0) / np.arange(1, 71).sum()
    assert np.allclose(lm._merged(frame), want)
