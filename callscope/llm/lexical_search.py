"""Ranked lexical search: the Best Position Algorithm over impact lists of document shards.

1. One pass over all documents counts them, their terms, and how many of them hold each term of the
   items; only a row a term and task is shuffled.
2. A second pass deals documents into shards of at most SHARD postings, as a task streams them. A shard
   holds, for each term, the list of its documents by falling impact, and the other way round the
   places of each document in all lists, for direct access.
3. For every item the lists are read from the top, side by side and in growing steps. Each document met is
   scored in full by direct access, which marks its places as seen in all lists. The best position of a
   list is the end of its seen head; no document unseen can add more than the impact just beyond it.
   The sum of these bounds is the threshold; reading stops when it is strictly below the k-th score, so
   that ties are kept, or when it is 0.
4. A task hands the k-th score on from shard to shard and returns k rows an item at most; the best of all
   tasks are ranked in two rounds.

Items are taken in blocks of bounded bytes, all documents against each block; texts are never shuffled.

Odd rows. A null or empty text has no term: such an item finds nothing, such a document is never found.
Very long texts are read whole; one alone may be a shard. Documents that repeat an id or a text are ranked
each for itself; null ids are ranked after all others of their score. Items that repeat an id answer
each for themselves. Without documents or items the result is empty. Input columns besides the named ones
are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, text_slices

K = 10
#: Postings of a shard, and documents.
SHARD, SHARD_DOCS = 1 << 21, 1 << 17
#: Items of one block: rows and bytes of text.
BLOCK_ITEMS, BLOCK_BYTES = 1 << 14, 16 << 20
#: Places of each list that the first step reads; every further step reads twice as many.
FIRST_STEP = 8
SALT = 32

#: Bytes of a term stay (A-Z lower-cased), all others part terms.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_col, rank (from 1), id_col, score: the k highest-scoring documents of each item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = items.schema[item_col].dataType.simpleString()
    out = None
    for block in _blocks(items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("t"))):
        found = _search_block(spark, docs, block, k, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item {kind}, rank int, id bigint, score bigint")
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    block, held = [], 0
    for item, text in items.toLocalIterator():
        block.append((item, terms((text or "").encode())))
        held += len(text or "")
        if len(block) >= BLOCK_ITEMS or held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _search_block(spark, docs: DataFrame, block: list[tuple], k: int, kind: str) -> DataFrame:
    known = {t: i for i, t in enumerate(sorted({t for _, ts in block for t in ts}))}
    names = spark.sparkContext.broadcast(list(known))
    counts = docs.select("t").mapInArrow(_counter(names), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held = dict(zip(counts["term"].to_pylist(), counts["n"].to_pylist(), strict=True))
    n_docs, n_terms = held.get(-1, 0), held.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(known))], dtype=np.int64)
    asked = []
    for _, ts in block:
        codes, repeats = np.unique(np.array([known[t] for t in ts], dtype=np.int64), return_counts=True)
        asked.append((codes, repeats))
    index = spark.sparkContext.broadcast((weights, asked, n_docs, n_terms))
    best = docs.mapInArrow(_searcher(names, index, k), "i int, id long, score long")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    salted = best.withColumn("_salt", F.pmod(F.xxhash64("id", "score"), F.lit(SALT)))
    head = salted.withColumn("_r", F.row_number().over(Window.partitionBy("i", "_salt").orderBy(*order))).where(F.col("_r") <= k)
    ranked = head.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(*order))).where(F.col("rank") <= k)
    named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"i int, item {kind}")
    # at most BLOCK_ITEMS rows
    return ranked.join(F.broadcast(named), "i").select("item", F.col("rank").cast("int").alias("rank"), "id", "score")


def _counter(names):
    """Of a task's documents: how many hold each term; at -1 how many have a term, at -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(names.value)}
        held = np.zeros(len(known) + 2, dtype=np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                if ts := terms(text):
                    held[-1] += 1
                    held[-2] += len(ts)
                    codes = {known[t] for t in ts if t in known}
                    held[np.fromiter(codes, dtype=np.int64, count=len(codes))] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at >= len(known), at - len(held), at), pa.int32()), pa.array(held[at])], names=["term", "n"])

    return run


class Shard:
    """Impact lists of some documents, and each document's places in them."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, doc: np.ndarray, code: np.ndarray, impact: np.ndarray):
        """doc, code, impact: a posting each, by document; impacts are above 0."""
        self.ids, self.nulls = ids, nulls
        order = np.lexsort((-impact, code))
        #: by list
        self.list_doc, self.list_impact = doc[order], impact[order]
        listed = code[order]
        first = np.flatnonzero(np.r_[True, listed[1:] != listed[:-1]]) if len(listed) else np.zeros(0, dtype=np.int64)
        self.codes, self.starts = listed[first], np.r_[first, len(listed)]
        #: by document
        self.code, self.impact = code, impact
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.heads = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.met = np.full(len(ids), -1, dtype=np.int64)

    def best(self, item: int, codes: np.ndarray, repeats: np.ndarray, slot: np.ndarray, top: Top) -> int:
        """Take this shard's best documents of an item into top; the number of documents scored.

        slot: of every term; all -1 before and after.
        """
        at = np.searchsorted(self.codes, codes)
        here = np.flatnonzero(at < len(self.codes))
        here = here[self.codes[at[here]] == codes[here]]
        if not len(here):
            return 0
        at, repeats = at[here], repeats[here]
        start, length = self.starts[at], self.starts[at + 1] - self.starts[at]
        slot[codes[here]] = np.arange(len(here))
        # a list's places side by side, and one more that is never seen
        base = np.r_[0, np.cumsum(length + 1)[:-1]]
        unseen = np.ones(int((length + 1).sum()), dtype=bool)
        best = np.zeros(len(here), dtype=np.int64)
        depth, step, scored = 0, FIRST_STEP, 0
        while True:
            read = [self.list_doc[s + depth : s + min(depth + step, n)] for s, n in zip(start.tolist(), length.tolist(), strict=True) if n > depth]
            docs = np.unique(np.concatenate(read)) if read else np.zeros(0, dtype=np.int64)
            docs = docs[self.met[docs] != item]
            if len(docs):
                self.met[docs] = item
                scored += len(docs)
                # direct access: all places of these documents in the item's lists
                sizes = self.heads[docs + 1] - self.heads[docs]
                ends = np.cumsum(sizes)
                entry = np.arange(int(ends[-1])) + np.repeat(self.heads[docs] - (ends - sizes), sizes)
                which = slot[self.code[entry]]
                ours = which >= 0
                entry, which = entry[ours], which[ours]
                unseen[base[which] + self.place[entry] - start[which]] = False
                owner = np.repeat(np.arange(len(docs)), sizes)[ours]
                # a document met has at least one entry, and entries are by document
                sums = np.add.reduceat(self.impact[entry] * repeats[which], np.searchsorted(owner, np.arange(len(docs))))
                top.take(sums, self.ids[docs], self.nulls[docs])
            depth, step = depth + step, 2 * step
            for i in range(len(here)):
                lo = base[i] + best[i]
                best[i] += int(unseen[lo : base[i] + length[i] + 1].argmax())
            open_ = best < length
            threshold = int((self.list_impact[start[open_] + best[open_]] * repeats[open_]).sum())
            if threshold == 0 or threshold < top.kth():
                break
        slot[codes[here]] = -1
        return scored


class Top:
    """The k best of an item so far: highest score first, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids, self.nulls = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def kth(self) -> int:
        return int(self.score[-1]) if len(self.score) >= self.k else 0

    def take(self, score: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        fit = score >= max(self.kth(), 1)
        if fit.any():
            score, ids, nulls = (np.concatenate([a, b[fit]]) for a, b in ((self.score, score), (self.ids, ids), (self.nulls, nulls)))
            order = np.lexsort((ids, nulls, -score))[: self.k]
            self.score, self.ids, self.nulls = score[order], ids[order], nulls[order]


def _searcher(names, index, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(names.value)}
        weights, asked, n_docs, n_terms = index.value
        slot = np.full(len(known), -1, dtype=np.int64)
        tops = [Top(k) for _ in asked]
        held: list[tuple] = []
        postings = rows = 0

        def close() -> None:
            ids, nulls, doc, code, impact = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = Shard(ids, nulls, doc, code, impact)
            for i, (codes, repeats) in enumerate(asked):
                shard.best(i, codes, repeats, slot, tops[i])

        for batch in batches:
            for piece in text_slices(batch, 1):
                part = _postings(piece, known, weights, n_docs, n_terms, rows)
                if rows and (postings + len(part[2]) > SHARD or rows + len(part[0]) > SHARD_DOCS):
                    close()
                    part = (*part[:2], part[2] - rows, *part[3:])
                    held, postings, rows = [], 0, 0
                held.append(part)
                postings, rows = postings + len(part[2]), rows + len(part[0])
        if rows:
            close()
        which = np.repeat(np.arange(len(tops), dtype=np.int32), [len(t.score) for t in tops])
        if len(which):
            nulls = np.concatenate([t.nulls for t in tops])
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.concatenate([t.ids for t in tops]), mask=nulls), pa.array(np.concatenate([t.score for t in tops]))], names=["i", "id", "score"])

    return run


def _postings(piece: pa.RecordBatch, known: dict[bytes, int], weights: np.ndarray, n_docs: int, n_terms: int, first: int) -> tuple:
    """ids, nulls, then a row a posting with impact above 0: document (from first on), term, impact."""
    lengths, sizes, codes = [], [], []
    for text in as_bytes(piece.column(1)):
        ts = terms(text)
        ours = [known[t] for t in ts if t in known]
        lengths.append(len(ts))
        sizes.append(len(ours))
        codes += ours
    ids = piece.column(0)
    nulls = np.asarray(ids.is_null())
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    key, tf = np.unique(doc * max(len(known), 1) + np.array(codes, dtype=np.int64), return_counts=True)
    doc, code = key // max(len(known), 1), key % max(len(known), 1)
    m = 25 + (75 * np.array(lengths, dtype=np.int64) * n_docs) // max(n_terms, 1)
    impact = weights[code] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])) if len(code) else np.zeros(0, dtype=np.int64)
    up = impact > 0
    return np.asarray(ids.fill_null(0)), nulls, doc[up] + first, code[up], impact[up]


ORACLE = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
post AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
lens AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
tot AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lens),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * nn) // ll) AS m FROM lens, tot),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM post, tot GROUP BY t, nn),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN post USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
