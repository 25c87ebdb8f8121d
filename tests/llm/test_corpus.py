"""Corpus operators against brute force on small tables, with their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import textwrap
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark import TaskContext

from callscope.llm import bpe, fingerprint, license_texts, licenses, mixing, near_dup, neighbours, secret_scan, shingles, substring_dedup, toxicity
from callscope.llm.common import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size long, _text string"


def words(n, r, vocabulary):
    return [r.choice(vocabulary) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, short and long texts, odd blanks, nulls."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghijé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    passage = words(60, r, vocabulary)
    out = [None, "", "   ", "one two", "one two", "One  two", "é b c d", "x " * 500, "a b " * 300]
    for i in range(60):
        w = words(r.randint(5, 160), r, vocabulary)
        if i % 4 == 0:
            w[3:3] = passage
        out.append(" ".join(w))
        if i % 3 == 0:
            for _ in range(i % 5):
                v = list(w)
                for _ in range(r.randint(0, 4)):
                    v[r.randrange(len(v))] = r.choice(vocabulary)
                out.append(("\t" if i % 2 else " ").join(v).upper() if i % 7 == 0 else "\n".join(v))
    out.append(" ".join(words(30000, r, vocabulary)))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t or ""), "k", 5, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates_equal_brute_force(spark, docs, texts, empty):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.groups(docs).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)}
    assert {r.doc_id for r in near_dup.keep_one(docs).collect()} == {i for i in range(len(sets)) if root(i) == i}
    assert near_dup.groups(empty).count() == 0


def test_near_duplicates_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (9, "q w e r t y"), (9, "q w e r t y")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dup.groups(df).collect()) == [("4", 4, True), ("9", 9, True), ("9", 9, True), ("None", 4, False), ("None", 4, False)]


def test_components_of_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (41, 40), (7, 7)], "a long, b long")
    assert {r.node: r.comp for r in near_dup.components(e).collect()} == {**dict.fromkeys(range(31), 0), 40: 40, 41: 40, 50: 40}


def _cost(spark, run):
    """What run() returns, the tasks of its stages and the bytes that they shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    first = 1 + max([-1, *spark.sparkContext.parallelize([0]).map(lambda x: TaskContext.get().stageId()).collect()])
    out = run()
    last = spark.sparkContext.parallelize([0]).map(lambda x: TaskContext.get().stageId()).collect()[0]
    time.sleep(1)  # for the listener that keeps the figures
    stages = [store.lastStageAttempt(i) for i in range(first, last)]
    return out, sum(s.numCompleteTasks() for s in stages), sum(s.shuffleWriteBytes() for s in stages)


def test_near_duplicates_of_many_partitions(spark):
    """each turn of the components, and each step around it, cost a task and its files for every partition,
    and band keys were shuffled several times: the stage took more disk than its limit on check_h."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(60)]
    texts = [" ".join([*base[: i % 50], f"x{i % 7}", *base[i % 50 + 1 :]]) for i in range(300)] + [" ".join(rng.choices(words, k=30)) for _ in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40).localCheckpoint()
    chains = spark.createDataFrame([(i, i + 1) for i in range(0, 400) if i % 20], "a long, b long")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found, tasks, _ = _cost(spark, lambda: near_dup.components(chains).collect())
        assert {r.node: r.comp for r in found} == {i: (i - 1) // 20 * 20 + 1 for i in range(1, 401)}
        kept, all_tasks, moved = _cost(spark, lambda: near_dup.keep_one(docs).collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    # before: 3091 and 4088 tasks, 5.7 MB; now 1636 and 2888 tasks, 4.4 MB
    assert tasks <= 2300 and all_tasks <= 3500 and moved <= 5_000_000
    assert len(kept) < 1000 and set(range(300, 1000)) <= {r.doc_id for r in kept}


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 300).astype(np.uint64))
    b = np.unique(np.concatenate([a[:240], r.integers(0, 2**63, 60).astype(np.uint64)]))
    s = shingles.sketch([a, b, a[:1], a[:2]], 512)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.1


def test_windows_tell_orders_apart():
    known = WordHashes()
    r = random.Random(4)
    seen = {}
    for _ in range(5000):
        w = tuple(r.choice([b"a", b"b", b"c"]) for _ in range(9))
        h = int(shingles.windows(shingles.hash_words(list(w), known), 9)[0])
        assert seen.setdefault(h, w) == w


def test_substring_dedup_equals_brute_force(docs, texts, empty):
    cut = [WORD.findall(t or "") for t in texts]
    for width in (35, 4):
        count = collections.Counter(tuple(w[k : k + width]) for w in cut for k in range(len(w) - width + 1))
        want = {}
        for i, w in enumerate(cut):
            gone = [False] * len(w)
            for k in range(len(w) - width + 1):
                if count[tuple(w[k : k + width])] > 1:
                    gone[k : k + width] = [True] * width
            want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, width=width).collect()}
        assert got == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_a_joined_sketch_gives_the_same(docs, empty):
    """A sketch that is too large to broadcast is joined block by block; the result is the same, and the
    windows that pass both ways of the prefilter are the same."""
    for width in (35, 4):
        whole = sorted(map(tuple, substring_dedup.remove_repeats(docs, width=width).collect()))
        assert sorted(map(tuple, substring_dedup.remove_repeats(docs, width=width, max_log2=8).collect())) == whole
    assert substring_dedup.remove_repeats(empty, max_log2=8).count() == 0
    from pyspark.sql import functions as F

    keyed = docs.select("text", (F.col("doc_id") % 7).cast("int").alias("bucket"))
    spark = docs.sparkSession
    log2 = 14
    near = substring_dedup._suspects(keyed, 4, log2, spark.sparkContext.broadcast(substring_dedup._collected(keyed, 4, log2)), 5)
    far = substring_dedup._suspects_by_join(keyed, 4, log2, 6, 5)

    def passed(df):
        out = set()
        for r in df.collect():
            h, bucket = np.frombuffer(r.h, "<u8").reshape(-1, 2), np.frombuffer(r.bucket, "<i4")
            out |= {(r.shard, *map(int, x), int(y)) for x, y in zip(h, bucket, strict=True)}
        return out

    assert passed(near) == passed(far) and 0 < len(passed(far))


def test_packing_round_trip():
    r = np.random.default_rng(2)
    for places in ([], [0], [255], [254, 255, 510, 511, 4000], np.unique(r.integers(0, 500000, 3000)).tolist()):
        assert substring_dedup.unpack(substring_dedup.pack(np.asarray(places, dtype=np.int64))).tolist() == places


def test_bpe_equals_the_reference_library(spark, docs, texts, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    model = bpe.ByteBpe(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode_ordinary(t or "")
        assert bytes(got[i].decoded).decode() == (t or "") and got[i].n_tokens == len(got[i].ids) // 4
    r = random.Random(1)
    alphabet = [chr(c) for c in [*range(128), 0x85, 0xA0, 0xE9, 0x4E2D, 0x1F600, 0x301, 0x660, 0x2028]]
    odd = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(800)] + [" " * 300, "a" * 5000, "ab" * 2000, "\n" * 70]
    for t, ids in zip(odd, model.encode_texts(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert model.decode(ids) == t.encode()
    assert bpe.encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_mixing_meets_its_targets(spark, docs, texts, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts)
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    by = collections.defaultdict(list)
    for r in got:
        assert r.size == size[r.doc_id] and r.taken == r.copies * r.size and r.taken <= 3 * r.size
        by[(r.source_size, r.target)].append(r)
    assert sum(t for _, t in by) == pytest.approx(sum(size.values()))
    for (source_size, target), rows in by.items():
        assert source_size == sum(r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows) / 2 + 1e-6
        assert max(r.copies for r in rows) - min(r.copies for r in rows) <= 1
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix(empty).count() == 0
    kept = mixing.mix(docs, keep=["text", "kept"])
    assert {"text", "kept"} <= set(kept.columns)


def test_mixing_prefers_quality(spark):
    rows = [(i, ("word " if i % 2 else "1234 ") * 20, "s") for i in range(400)] + [(1000 + i, "word " * 20, "t") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = [r for r in mixing.mix(df, cycle=(1, 4)).collect() if r.doc_id < 1000]
    assert sum(r.copies for r in taken if r.doc_id % 2) > 1.5 * sum(r.copies for r in taken if r.doc_id % 2 == 0)


def test_mixing_tells_small_weights_apart(spark):
    """Documents of digits have tiny weights; their keys stay distinct and spread over the cells."""
    from pyspark.sql import functions as F

    rows = [(i, "7" * (1000 + i % 50) + (" word" * (i % 3)), "s") for i in range(3000)] + [(9000 + i, "word " * 400, "t") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.measured(df, "doc_id", "text", "source", "mix-1").cache()
    assert m.where("source = 's'").select("_r").distinct().count() == 3000
    for cells, width in ((["_c1"], mixing.CELLS_1), (["_c1", "_c2"], mixing.CELLS_1 * mixing.CELLS_2)):
        most = m.groupBy("source", *cells).count().agg(F.max("count")).first()[0]
        mean = 3000 / (math.e * width)
        assert most <= mean + 5 * math.sqrt(mean) + 3
    taken = collections.Counter()
    for r in mixing.mix(df, cycle=(1, 500)).collect():
        if r.doc_id < 3000:
            taken[r.doc_id % 3] += r.copies
    # a third of the documents has next to no letters, the others 5 and 9 times as many: no prefix of ids
    assert 0 < taken[0] < taken[1] < taken[2]
    chosen = [r.doc_id for r in mixing.mix(df, cycle=(1, 500)).where("doc_id < 3000 and copies > 0").select("doc_id").collect()]
    assert max(chosen) > 2900 and 1200 < np.mean(chosen) < 1800


@pytest.mark.parametrize("call", [lambda d, k: mixing.mix(d, keep=k), lambda d, k: bpe.encode_decode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=k), lambda d, k: secret_scan.scan(d, [0.0] * secret_scan.CODES**2, keep=k), lambda d, k: toxicity.score(d, toxicity.Model({}, np.array([1.0, 2.0, 3.0])), keep=k)])
def test_kept_columns_may_not_clash(docs, call):
    made = set(call(docs, ["text", "lang", "text"]).columns) - {"doc_id", "text", "lang"}
    for name in sorted(made & {"size", "ids", "assign", "p_toxic"}):
        with pytest.raises(ValueError, match=name):
            call(docs.withColumnRenamed("kept", name) if name != "size" else docs, [name])


def test_neighbours_recall_and_ties(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 24)) * r.uniform(0.2, 2, (900, 1))
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in np.float32(v)], "q") for i, v in enumerate(x)]
    rows += [(2000, None, "q"), (2020, [0.0] * 24, "q"), (2040, [float("nan")] * 24, "q"), (2060, [1.0], "q"), (None, rows[0][1], "q"), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    from pyspark.sql import functions as F

    got = collections.defaultdict(list)
    for q in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.rank, q.vec_id, q.score))
    m = np.float32(x).astype(np.float64)
    hits = total = 0
    assert sorted(got) == list(range(0, 900, 20))
    for q, found in got.items():
        score = (m * m[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(f[2] == pytest.approx(score[f[1]], abs=1e-12) for f in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len(set(order) & {f[1] for f in found})
        total += 20
    assert hits / total >= 0.9
    same = [f[1] for f in got[120]][:19]
    assert same == [i for i in range(100, 140) if i != 120][:19] or got[120][0][2] > score_of(m, 120)
    other = spark.createDataFrame([(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3020, [1.0, 0.0])], "vec_id long, embedding array<float>")
    apart = neighbours.search(df.select("vec_id", "embedding").unionByName(other), F.col("vec_id") >= 3000)
    assert sorted((q.query_id, q.vec_id, q.score) for q in apart.where("rank = 1").collect()) == [(3000, 3001, 4.0), (3001, 3000, 4.0), (3020, 3001, 2.0)]
    few = neighbours.search(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_buckets_of_joined_hashes(spark):
    """The cheapest buckets against all of them; more vectors join more hashes; several hashes find what
    lies near in clusters, from blocks with hot buckets too."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    near = [neighbours.sided(r.normal(size=(6, 4))) for _ in range(3)]
    for i, got in enumerate(neighbours.nearest_codes(near, 20)):
        cost = {(a * 8 + b) * 8 + c: sum((n[i].max() - n[i][j]) ** 2 for n, j in zip(near, (a, b, c), strict=True)) for a in range(8) for b in range(8) for c in range(8)}
        assert sorted(cost[c] for c in got) == pytest.approx(sorted(cost.values())[:20])
    assert [neighbours.hashes(n, 64) for n in (1, 16_384, 16_385, 2_000_000, 3_000_000, 10**8, 10**9)] == [1, 1, 2, 2, 3, 3, 4]
    centres = r.normal(size=(40, 16))
    x = np.float32(np.concatenate([centres[i % 40] + 0.05 * r.normal(size=16) for i in range(3000)]).reshape(-1, 16))
    df = spark.createDataFrame([(i, [float(v) for v in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    hits = total = 0
    m = x.astype(np.float64)
    found = collections.defaultdict(set)
    for q in neighbours.search(df, F.col("vec_id") % 100 == 0, joined=2).collect():
        found[q.query_id].add(q.vec_id)
    for q, ids in found.items():
        score = m @ m[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & ids)
        total += 20
    assert len(found) == 30 and hits / total >= 0.9


def score_of(m, i):
    return float((m[i] * m[i]).sum())


def test_fingerprints(spark, docs, texts, empty):
    got = {r.doc_id: r for r in fingerprint.report(docs).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for at, i in enumerate(order):
        t, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    prints = collections.defaultdict(set)
    for i, t in enumerate(texts):
        prints[t or ""].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert len({got[i].fingerprint for i in range(20, len(texts))}) > 0.8 * len(set(texts[20:]))
    # against a plain version of the lexicons, hashes and likeness
    total = len(texts)
    df = collections.Counter(w for t in texts for w in {x.translate(shingles.LOWER) for x in (t or "").encode().split()})
    low, high = max(2, math.ceil(fingerprint.MIN_SHARE * total)), max(2, int(fingerprint.MAX_SHARE * total))
    band = {xxhash.xxh64_intdigest(w) for w, n in df.items() if low <= n <= high}

    def plain(t):
        words = {xxhash.xxh64_intdigest(w.translate(shingles.LOWER)) for w in (t or "").encode().split()}
        words = sorted(words & band or words)
        out = []
        for k in range(fingerprint.SUBSETS):
            drawn = shingles.mix64(np.asarray(words, dtype=np.uint64) + np.uint64((k + 1) * 0x9FB21C651E98DF25 & (2**64 - 1)))
            rate = int(fingerprint.RATES[k % len(fingerprint.RATES)] * 2**64)
            kept = [w for w, d in zip(words, drawn.tolist(), strict=True) if k == 0 or d < rate]
            out.append(f"{xxhash.xxh32_intdigest(np.asarray(kept, '<u8').tobytes(), seed=1):08x}" if kept else "0" * 8)
        return out

    for at, i in enumerate(order[::7]):
        t, following = texts[i] or "", texts[order[(at * 7 + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, changed, after = plain(t), plain(edited), plain(following)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == ("".join(own), "".join(changed))
        for near, other in ((got[i].near_edited, changed), (got[i].near_next, after)):
            some = [(x, y) for x, y in zip(own, other, strict=True) if (x, y) != ("0" * 8, "0" * 8)]
            assert near == pytest.approx(sum(x == y for x, y in some) / len(some) if some else 1.0)
    twins = spark.createDataFrame([(1, "a b"), (1, "c d"), (None, "e"), (None, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_chars) for r in fingerprint.report(twins).collect()) == [(0, 0), (0, 1), (1, 3), (1, 3), (2, 0)]
    one = fingerprint.report(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert fingerprint.report(empty).count() == 0


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    bad = ["vile", "nasty", "awful"]
    rows, labels = [(0, None), (1, "")], []
    for i in range(2, 900):
        w = words(r.randint(10, 60), r, vocabulary)
        toxic = i % 6 == 0
        for _ in range(r.randint(1, 8) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", ",", "!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels[:600], "doc_id long, toxic int"))
    assert list(model.thresholds) == sorted(model.thresholds)
    out = {x.doc_id: x for x in toxicity.score(docs, model, keep=["text"]).collect()}
    held = labels[600:]
    assert sum(out[i].toxic == bool(y) for i, y in held) >= 0.98 * len(held)
    assert not out[0].toxic and not out[1].toxic
    severe = [out[i].severity for i, y in held if y]
    count = [sum(w.strip(",!") in bad for w in dict(rows)[i].split()) for i, y in held if y]
    assert np.corrcoef(severe, count)[0, 1] > 0.6
    # against a plain scorer; repeated rows and null ids score alike, a very long text too
    odd = spark.createDataFrame([(7, "vile, VILE! nasty"), (7, "vile, VILE! nasty"), (None, "vile, VILE! nasty"), (8, "awful " * 50000)], "doc_id long, text string")
    for x in toxicity.score(odd, model, keep=["text"]).collect():
        count = collections.Counter(f for w in x.text.lower().split() for f in toxicity.features(w))
        z = sum(model.weights.get(f, 0.0) * math.log2(1 + n) for f, n in count.items())
        over = [1 / (1 + math.exp(-max(-40, min(40, z - c)))) for c in model.thresholds]
        assert (x.p_toxic, x.severity, x.grade, x.toxic) == (pytest.approx(over[0]), pytest.approx(sum(over)), sum(o > 0.5 for o in over), over[0] >= toxicity.REJECT)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(x.toxic for x in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_licenses_and_inheritance(spark):
    filler = "the quick brown fox jumps over lazy dogs while rain keeps falling on tin roofs"
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\n" + filler),
        (2, "a/b/x", filler),
        (3, "a/b/c/y", filler + "\nLicensed under the Apache License, Version 2.0."),
        (4, "d/z", filler + " license"),
        (5, "a/b/LICENSE", licenses.TEMPLATES["GPL-3.0"][1]),
        (6, None, None),
        (7, "top", ""),
    ] + [(100 + i, f"e/{i}", f"{filler} number{i} word{i % 7}") for i in range(200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, license string")
    got = {r.doc_id: (r.license, r.basis, r.from_dir) for r in licenses.scan(df).collect()}
    assert got[1] == ("MIT", "statement", None)
    assert got[2] == ("GPL-3.0", "directory", "a/b")
    assert got[3] == ("Apache-2.0", "statement", None)
    assert got[4] == got[6] == got[7] == got[150] == (None, None, None)
    assert got[5] == ("GPL-3.0", "statement", None)
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_that_many_documents_have(spark):
    filler = "the quick brown fox jumps over lazy dogs while rain keeps falling on tin roofs"
    header = "Licensed under the Apache License, Version 2.0."
    for n in (3, 30, 600):
        rows = [(i, f"d{i}/x", f"{filler} number{i}\n{header if i % 3 == 0 else 'nothing'}\n{filler}") for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, path string, text string")
        got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
        assert got == {i: None if i % 3 else "Apache-2.0" for i in range(n)}


def test_license_gate_is_exact():
    r = random.Random(8)
    vocabulary = sorted({t for g in licenses.TEMPLATES.values() for x in g for t in licenses.tokens(x.encode())})
    for _ in range(5):
        matcher = licenses.Matcher(licenses.TEMPLATES, {t: r.uniform(1, 12) for t in vocabulary}, 12.0)
        for _, template in matcher.templates:
            for _ in range(20):
                words = r.sample(sorted(template), r.randint(1, len(template))) + r.sample(vocabulary, r.randint(0, 5))
                vector = matcher.unit(words)
                for i, (_, other) in enumerate(matcher.templates):
                    if sum(x * vector.get(t, 0) for t, x in other.items()) >= licenses.CUT:
                        assert i in matcher.near(words)


@pytest.mark.parametrize("spread", ["one", "few", "all"])
def test_neighbours_recall_of_uneven_lengths(spark, spread):
    """Inner products in 64 dimensions: one vector, a few, or all of another length."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    n, step = 20000, 200
    x = r.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if spread == "one":
        x[7] *= 3
    elif spread == "few":
        x[:60] *= r.uniform(1.5, 5, (60, 1))
    else:
        x *= r.uniform(0.2, 2, (n, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for q in neighbours.search(df, F.col("vec_id") % step == 0).collect():
        got[q.query_id].add(q.vec_id)
    hits = 0
    for q in range(0, n, step):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    print("recall", spread, hits / (20 * (n // step)))
    assert hits >= 0.9 * 20 * (n // step)


def test_keep_one_of_null_and_repeated_ids(spark):
    """One row of each group stays, whatever ids its rows have."""
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [
        (1, near), (None, near + " end"), (None, "unique clean text without any copy at all"),
        (5, near), (5, "another text of five words and more"), (6, "another text of five words and more"),
        (7, "said twice by the very same row"), (7, "said twice by the very same row"),
        (None, "only null ids hold this text here"), (None, "only null ids hold this text here"),
        (8, None), (8, ""), (8, ""), (None, None),
    ]
    got = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [rows[i] for i in (0, 2, 4, 6, 8, 10, 11, 12, 13)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_wrapped_notices_and_license_files(spark):
    code = "\n".join(f"value{i} = compute(value{i - 1}, other{i}) + {i}" for i in range(60))
    wrap = lambda text, mark: "\n".join(mark + x for x in textwrap.wrap(text, 60))
    mit = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + "\n".join(textwrap.wrap(license_texts.WHOLE["MIT"][1].split("\n", 1)[1], 76))
    rows = [
        (1, "a/x.py", "# Copyright 2020 Some Body\n#\n" + wrap(licenses.TEMPLATES["BSD-3-Clause"][1], "# ") + "\n\n" + code),
        (2, "b/LICENSE", mit),
        (3, "b/c/y.py", code),
        (4, "d/COPYING", license_texts.WHOLE["GPL-3.0"][0]),
        (5, "d/z.py", code),
        (6, "e/w.c", "/*\n" + wrap(licenses.TEMPLATES["GPL-3.0"][1], " * ") + "\n */\n" + code),
    ] + [(100 + i, f"f{i}/x", f"{code} number{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.basis, r.from_dir, r.n_statements) for r in licenses.scan(df).collect()}
    assert got[1] == ("BSD-3-Clause", "statement", None, 1)
    assert got[2][:2] == ("MIT", "statement") and got[3][:3] == ("MIT", "directory", "b")
    assert got[4][:2] == ("GPL-3.0", "statement") and got[5][:3] == ("GPL-3.0", "directory", "d")
    assert got[6] == ("GPL-3.0", "statement", None, 1)
    assert got[150] == (None, None, None, 0)
