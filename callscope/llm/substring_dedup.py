"""Substring dedup: a count-min prefilter, then exact grouping of what it lets through.

Pass 1 hashes every window of `width` words. Each task adds its windows to a count-min sketch whose
counters saturate at two, all the next pass asks, and ships it as packed blocks, which are merged by
groupings. A merged counter never underestimates, so no repeated window is lost. The sketch follows the
input at any size. Up to 2^MAX_LOG2 counters a row it's broadcast (32 MB a row) and merged in two levels.
Beyond that nothing is collected: each bucket of documents sends the counters that its windows touch to the
counters' blocks, a block answers every bucket with those of them that were touched twice, and the answers
meet the bucket's texts, which are shuffled once more for it.

Pass 2 groups, on 128 bits, only windows that are estimated repeated. They are dealt by hash into shards; a
task sends a window once for each bucket of documents. A shard answers each bucket with the bucket's
repeated windows.

Pass 3 brings a bucket's texts and its repeated windows together, by 64 bits of the hash (among the 700,000
windows of a bucket a false match has a chance of about 3e-8), and removes the covered words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import WordHashes, as_bytes, hash_words, mix64, text_slices
from .shingles import EMPTY, ODD, windows

WIDTH = 35
DEPTH = 2
MIN_LOG2, MAX_LOG2 = 20, 28
BLOCK_LOG2 = 19
#: Partition sketches merged at once.
MERGE = 256
#: Windows that a task gathers before it ships.
FLUSH = 3_000_000
#: Bytes of text per bucket (more where there would be over MOST_BUCKETS), and per shard.
BUCKET_BYTES, SHARD_BYTES, MOST_BUCKETS, LARGEST_BUCKET = 4_000_000, 6_000_000, 50_000, 64_000_000
#: Touched counters in a block, where blocks answer buckets.
BLOCK_COUNTERS = 4_000_000


def second_hash(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n <= 0:
        return EMPTY
    total = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        total += words[i : i + n] * ODD[63 - i]
    return mix64(total ^ np.uint64(0x5851F42D4C957F2D))


def counters(h: np.ndarray, row: int, log2: int) -> np.ndarray:
    """The counter of each window in one row of the sketch."""
    return (mix64(h + np.uint64((row + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))) >> np.uint64(64 - log2)).astype(np.int64)


def pack(places: np.ndarray) -> bytes:
    """Sorted distinct places as gaps, a byte each; a gap of 255 or more takes a 255 for every 255."""
    gaps = np.diff(places, prepend=0)
    ends = np.cumsum(gaps // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, dtype=np.uint8)
    out[ends - 1] = gaps % 255
    return out.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    gaps = np.frombuffer(packed, dtype=np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def _blocks(counter: np.ndarray, block_log2: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Per touched block: the counters seen at least once, and at least twice."""
    counter = np.sort(counter)
    first = np.ones(len(counter), dtype=bool)
    first[1:] = counter[1:] != counter[:-1]
    once, twice = counter[first], np.unique(counter[~first])
    touched = np.unique(once >> block_log2)
    edges = [touched << block_log2, (touched + 1) << block_log2]
    spans = [np.searchsorted(x, e).tolist() for x in (once, twice) for e in edges]
    for block, lo, hi, lo2, hi2 in zip(touched.tolist(), *spans, strict=True):
        yield block, pack(once[lo:hi] - (block << block_log2)), pack(twice[lo2:hi2] - (block << block_log2))


def sketch(texts: DataFrame, width: int, log2: int) -> DataFrame:
    """(row, block, once, twice): the merged sketch of all windows."""
    block_log2 = min(BLOCK_LOG2, log2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gathered, n = WordHashes(), [], 0
        task = TaskContext.get().partitionId()

        def ship() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(gathered)
            gathered.clear()
            for row in range(DEPTH):
                found = list(_blocks(counters(h, row, log2), block_log2))
                for i in range(0, len(found), 64):
                    block, once, twice = zip(*found[i : i + 64], strict=True)
                    n = len(block)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int32()), pa.array(block, pa.int32()), pa.array([task // MERGE] * n, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["row", "block", "part", "once", "twice"])

        for batch in batches:
            for part in text_slices(batch, 0):
                for text in as_bytes(part.column(0)):
                    h = windows(hash_words((text or b"").split(), known), width)
                    if len(h):
                        gathered.append(h)
                        n += len(h)
                if n >= FLUSH:
                    yield from ship()
                    n = 0
        if gathered:
            yield from ship()

    def merge(group: pa.Table) -> pa.Table:
        once, twice = np.zeros((2, 1 << block_log2), dtype=bool)
        for a, b in zip(group["once"], group["twice"], strict=True):
            seen = unpack(a.as_py())
            twice[seen] |= once[seen]
            once[seen] = True
            twice[unpack(b.as_py())] = True
        head = group.slice(0, 1)
        return pa.table([head["row"], head["block"], head["part"], *[pa.array([pack(np.flatnonzero(x))], pa.binary()) for x in (once, twice)]], names=["row", "block", "part", "once", "twice"])

    schema = "row int, block int, part int, once binary, twice binary"
    parts = texts.select("text").mapInArrow(run, schema)
    if texts.rdd.getNumPartitions() > MERGE:
        # the parts of a group are bounded by MERGE, then by the number of groups
        parts = parts.groupBy("row", "block", "part").applyInArrow(merge, schema)
    return parts.groupBy("row", "block").applyInArrow(merge, schema)


def _packed(h1: np.ndarray, h2: np.ndarray, bucket: np.ndarray, shards: int) -> pa.RecordBatch:
    """Windows per shard: (shard, h, bucket, many), each window once a bucket."""
    shard = ((h1 >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((h2, h1, bucket, shard))
    h1, h2, bucket, shard = h1[order], h2[order], bucket[order], shard[order]
    same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & (bucket[1:] == bucket[:-1])
    first = np.flatnonzero(np.append(True, ~same))
    many = (np.diff(np.append(first, len(h1))) > 1).astype(np.uint8)
    h = np.stack([h1[first], h2[first]], axis=1)
    bucket, shard = bucket[first].astype("<i4"), shard[first]
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist()
    spans = list(zip(cut, [*cut[1:], len(shard)], strict=True))
    return pa.RecordBatch.from_arrays([pa.array(shard[cut], pa.int32()), *[pa.array([x[b:e].tobytes() for b, e in spans], pa.binary()) for x in (h, bucket, many)]], ["shard", "h", "bucket", "many"])


def _suspects(texts: DataFrame, width: int, log2: int, bits, shards: int) -> DataFrame:
    """(shard, h, bucket, many): packed windows estimated repeated, once per task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = bits.value
        known, gathered, n = WordHashes(), [], 0

        def ship() -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*gathered, strict=True)]
            gathered.clear()
            return _packed(*parts, shards)

        for batch in batches:
            for part in text_slices(batch, 0):
                for text, bucket in zip(as_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                    words = hash_words((text or b"").split(), known)
                    h1 = windows(words, width)
                    if not len(h1):
                        continue
                    hit = np.ones(len(h1), dtype=bool)
                    for row in range(DEPTH):
                        c = counters(h1, row, log2)
                        hit &= (planes[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
                    if hit.any():
                        gathered.append((h1[hit], second_hash(words, width)[hit], np.full(int(hit.sum()), bucket)))
                        n += len(gathered[-1][0])
                if n >= FLUSH:
                    yield ship()
                    n = 0
        if gathered:
            yield ship()

    return texts.mapInArrow(run, SUSPECTS)


SUSPECTS = "shard int, h binary, bucket binary, many binary"


def _suspects_by_join(texts: DataFrame, width: int, log2: int, blocks: int, shards: int) -> DataFrame:
    """The same where the sketch is too large for a task: its blocks answer the buckets of documents."""
    size = -(-(1 << log2) // blocks)

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, block, bucket, once, twice): the counters that a task's windows of a bucket touch."""
        known, gathered, n = WordHashes(), {}, 0

        def ship() -> Iterator[pa.RecordBatch]:
            for bucket, parts in gathered.items():
                h = np.concatenate(parts)
                for row in range(DEPTH):
                    c, k = np.unique(counters(h, row, log2), return_counts=True)
                    block = c // size
                    cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist()
                    spans = list(zip(cut, [*cut[1:], len(c)], strict=True))
                    m = len(spans)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * m, pa.int32()), pa.array(block[cut], pa.int64()), pa.array([bucket] * m, pa.int32()), pa.array([(c[b:e] - block[b] * size).astype("<u4").tobytes() for b, e in spans], pa.binary()), pa.array([(k[b:e] > 1).astype(np.uint8).tobytes() for b, e in spans], pa.binary())], ["row", "block", "bucket", "once", "twice"])
            gathered.clear()

        for batch in batches:
            for part in text_slices(batch, 0):
                for text, bucket in zip(as_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                    h = windows(hash_words((text or b"").split(), known), width)
                    if len(h):
                        gathered.setdefault(bucket, []).append(h)
                        n += len(h)
                if n >= FLUSH:
                    yield from ship()
                    n = 0
        if gathered:
            yield from ship()

    def merge(group: pa.Table) -> pa.Table:
        """One block's answers: for each bucket those of its counters that were touched twice anywhere."""
        once = [np.frombuffer(x, dtype="<u4") for x in group["once"].to_pylist()]
        place, many = np.concatenate(once), np.frombuffer(b"".join(group["twice"].to_pylist()), dtype=np.uint8)
        bucket = np.repeat(np.asarray(group["bucket"]), [len(x) for x in once])
        order = np.lexsort((bucket, place))
        place, many, bucket = place[order], many[order], bucket[order]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        sizes = np.diff(np.append(first, len(place)))
        twice = np.repeat((sizes > 1) | (np.maximum.reduceat(many, first) > 0), sizes)
        place, bucket = place[twice], bucket[twice]
        order = np.lexsort((place, bucket))
        place, bucket = place[order], bucket[order]
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() if len(bucket) else []
        row, base = group["row"][0].as_py(), group["block"][0].as_py() * size
        full = place.astype("<i8") + base
        packed = [np.unique(full[b:e]).tobytes() for b, e in zip(cut, [*cut[1:], len(bucket)], strict=True)]
        return pa.table([pa.array(bucket[cut], pa.int32()), pa.array([row] * len(cut), pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "row", "touched"])

    def pick(texts: pa.Table, found: pa.Table) -> pa.Table:
        """One bucket's windows whose counters were touched twice in every row."""
        rows = np.asarray(found["row"])
        packed = found["touched"].to_pylist()
        touched = [np.sort(np.frombuffer(b"".join(p for p, r in zip(packed, rows, strict=True) if r == row), dtype="<i8")) for row in range(DEPTH)]
        known, gathered = WordHashes(), []
        if all(len(t) for t in touched):
            for text in as_bytes(texts["text"].combine_chunks()):
                words = hash_words((text or b"").split(), known)
                h1 = windows(words, width)
                if not len(h1):
                    continue
                hit = np.ones(len(h1), dtype=bool)
                for row, t in enumerate(touched):
                    c = counters(h1, row, log2)
                    hit &= t[np.minimum(np.searchsorted(t, c), len(t) - 1)] == c
                if hit.any():
                    gathered.append((h1[hit], second_hash(words, width)[hit]))
        if not gathered:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())], names=["shard", "h", "bucket", "many"])
        h1, h2 = (np.concatenate(x) for x in zip(*gathered, strict=True))
        return pa.Table.from_batches([_packed(h1, h2, np.full(len(h1), texts["bucket"][0].as_py()), shards)])

    touched = texts.mapInArrow(touch, "row int, block bigint, bucket int, once binary, twice binary")
    answers = touched.groupBy("row", "block").applyInArrow(merge, "bucket int, row int, touched binary")
    return texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(pick, SUSPECTS)


def _answers(group: pa.Table) -> pa.Table:
    """One shard: the windows that start at least twice anywhere, for each bucket that has them."""
    h = np.frombuffer(b"".join(group["h"].to_pylist()), dtype="<u8").reshape(-1, 2)
    bucket = np.frombuffer(b"".join(group["bucket"].to_pylist()), dtype="<i4")
    many = np.frombuffer(b"".join(group["many"].to_pylist()), dtype=np.uint8)
    order = np.lexsort((h[:, 1], h[:, 0]))
    h, bucket, many = h[order], bucket[order], many[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]).any(axis=1)))
    sizes = np.diff(np.append(first, len(h)))
    repeated = np.repeat((sizes > 1) | (np.maximum.reduceat(many, first) > 0), sizes)
    key, bucket = h[repeated, 0], bucket[repeated]
    order = np.lexsort((key, bucket))
    key, bucket = key[order], bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() if len(bucket) else []
    packed = [key[b:e].tobytes() for b, e in zip(cut, [*cut[1:], len(bucket)], strict=True)]
    return pa.table([pa.array(bucket[cut], pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "keys"])


def _collected(texts: DataFrame, width: int, log2: int) -> np.ndarray:
    """The merged sketch, a bit a counter: at most 2^MAX_LOG2 bits a row."""
    planes = np.zeros((DEPTH, (1 << log2) // 8), dtype=np.uint8)
    block_size = 1 << min(BLOCK_LOG2, log2)
    step = block_size // 8
    for row, block, twice in sketch(texts, width, log2).select("row", "block", "twice").collect():
        bits = np.zeros(block_size, dtype=np.uint8)
        bits[unpack(twice)] = 1
        planes[row, block * step : (block + 1) * step] = np.packbits(bits)
    return planes


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, max_log2: int = MAX_LOG2) -> DataFrame:
    """Remove every word that lies in a window of `width` words which also starts elsewhere.

    Windows are judged on the input, repeats in the same text included. Words are cut at ASCII
    blanks and left unchanged. Returns id_col, n_words, n_removed (long) and kept (the words that
    stay, joined by one space). A null text has no words; texts shorter than the window lose
    nothing; a very long text is one row of one bucket. Rows stay one to one (repeated rows are copies of
    each other, so their windows repeat); null ids are safe; an empty table gives no rows; columns of docs
    that are not named are ignored. A sketch beyond max_log2 is joined and not broadcast.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2 = max(MIN_LOG2, int(total // 4).bit_length())
    each = min(LARGEST_BUCKET, max(BUCKET_BYTES, total // MOST_BUCKETS))
    buckets, shards = int(max(16, total // each)), int(max(16, total // SHARD_BYTES))
    keyed = picked.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int"))
    pairs = keyed.select("text", "bucket")
    if log2 > max_log2:
        suspects = _suspects_by_join(pairs, width, log2, int(max(4, total // BLOCK_COUNTERS)), shards)
    else:
        suspects = _suspects(pairs, width, log2, spark.sparkContext.broadcast(_collected(picked, width, log2)), shards)
    answers = suspects.groupBy("shard").applyInArrow(_answers, "bucket int, keys binary")

    def prune(texts: pa.Table, found: pa.Table) -> pa.Table:
        repeated = np.unique(np.frombuffer(b"".join(found["keys"].to_pylist()), dtype="<u8"))
        known = WordHashes()
        counts, removed, kept = [], [], []
        for text in as_bytes(texts["text"].combine_chunks()):
            words = (text or b"").split()
            gone = 0
            if len(words) >= width and len(repeated):
                h = windows(hash_words(words, known), width)
                at = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
                starts = np.flatnonzero(repeated[at] == h)
                if len(starts):
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    edge[starts] += 1
                    edge[starts + width] -= 1
                    stays = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
            counts.append(len(words) + gone)
            removed.append(gone)
            kept.append(b" ".join(words))
        return pa.table([texts["id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    done = keyed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(prune, f"id {kind}, n_words bigint, n_removed bigint, kept string")
    return done.withColumnRenamed("id", id_col)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 34, 0) + 1)) AS i FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM s),
r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM h JOIN r USING (h)),
g AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
