"""Document fingerprints: I-Match with several randomised lexicons.

Document frequencies of all terms are counted over all documents. The lexicon holds the terms inside
an inverse-document-frequency band; since a term needs a least share of the documents, the lexicon
has at most (mean distinct terms per document) / MIN_SHARE entries at any corpus size. Each of
SUBSETS lexicons is a random part of it. A text's distinct terms that lie in a lexicon, sorted, are
hashed; the fingerprint is the row of these hashes, and two fingerprints are as alike as the share
of lexicons on which they agree. A text without any term in the band is fingerprinted over all its
terms, so equal texts always agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, hash_words, mix64, text_slices
from .shingles import LOWER

MIN_SHARE, MAX_SHARE = 0.0005, 0.1
SUBSETS = 63
#: Chance that a lexicon holds a term, in turn; the very first lexicon is whole. Where half of a text's n
#: terms stay, a lexicon of rate 1 / n agrees with the best chance, so there are some for every length.
RATES = (1 / 4, 1 / 8, 1 / 16, 1 / 32, 1 / 64, 1 / 128, 1 / 256, 1 / 512, 1 / 1024)
FLUSH = 2_000_000
#: Bytes of text in one range of ids, sampled ids per range, and most ranges. Beyond them ranges grow; they
#: are sorted by Spark and streamed with one text held, so a task's memory doesn't.
RANGE_BYTES, PER_RANGE, MAX_RANGES = 8_000_000, 20, 200_000
EMPTY_HASH = "00000000"


def terms(text: bytes, known: WordHashes) -> np.ndarray:
    """Sorted distinct term hashes: words between ASCII blanks, ASCII letters lower-cased."""
    return np.unique(hash_words(text.translate(LOWER).split(), known))


def lexicon(docs: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> np.ndarray:
    """Sorted hashes of the terms inside the band; counted over all documents."""
    total = docs.count()
    low, high = max(2, int(np.ceil(min_share * total))), max(2, int(max_share * total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gathered, n = WordHashes(), [], 0

        def ship() -> pa.RecordBatch:
            term, count = np.unique(np.concatenate(gathered), return_counts=True)
            gathered.clear()
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(count.astype(np.int64))], ["term", "n"])

        for batch in batches:
            for part in text_slices(batch, 0):
                for text in as_bytes(part.column(0)):
                    gathered.append(terms(text or b"", known))
                    n += len(gathered[-1])
                if n >= FLUSH:
                    yield ship()
                    n = 0
        if gathered:
            yield ship()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))
    inside = counted.where(F.col("df").between(low, high)).select("term")
    rows = [np.asarray([r[0] for r in inside.collect()], dtype=np.int64)]  # bounded, see above
    return np.sort(np.concatenate(rows).view(np.uint64))


class Fingerprints:
    def __init__(self, words: np.ndarray):
        self.words = words
        self.known = WordHashes()
        self.member = self.subsets(words)

    @staticmethod
    def subsets(words: np.ndarray) -> np.ndarray:
        out = np.zeros((SUBSETS, len(words)), dtype=bool)
        for k in range(SUBSETS):
            drawn = mix64(words + np.uint64((k + 1) * 0x9FB21C651E98DF25 & (2**64 - 1)))
            out[k] = (drawn < np.uint64(int(RATES[k % len(RATES)] * 2**64))) | (k == 0)
        return out

    def of(self, text: bytes) -> list[str]:
        found = terms(text, self.known)
        at = np.minimum(np.searchsorted(self.words, found), max(0, len(self.words) - 1))
        hit = self.words[at] == found if len(self.words) else np.zeros(len(found), dtype=bool)
        if hit.any():
            found, member = found[hit], self.member[:, at[hit]]
        else:
            member = self.subsets(found)
        return [f"{xxhash.xxh32_intdigest(found[m].tobytes(), seed=1):08x}" if m.any() else EMPTY_HASH for m in member]


def likeness(a: list[str], b: list[str]) -> float:
    """Share of the lexicons, without those in which neither has a term, on which both agree."""
    counted = [(x, y) for x, y in zip(a, b, strict=True) if x != EMPTY_HASH or y != EMPTY_HASH]
    return sum(x == y for x, y in counted) / len(counted) if counted else 1.0


def with_next(docs: DataFrame, id_col: str, text_col: str, prepared, apply):
    """Run apply(prepared(), id, text, text of the next document) over ids in descending order; after
    the last comes the first.

    Texts are dealt once, by ranges of ids taken from a sample; each range is sorted and read as a
    stream with one text held back. The top text of every range goes along to the range above it.
    Null ids come last; equal ids are ordered by text.
    """
    spark = docs.sparkSession
    least = -(2**63)
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("ord", F.coalesce("id", F.lit(least)))
    size = picked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    ranges = int(min(MAX_RANGES, max(16, (size["b"] or 0) // RANGE_BYTES)))
    ids = picked.select("ord")
    share = min(1.0, PER_RANGE * ranges / max(1, size["n"]))
    drawn = ids.where(F.pmod(F.xxhash64("ord"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else ids
    sample = np.sort(drawn.toArrow()["ord"].to_numpy())  # at most about PER_RANGE * MAX_RANGES ids
    cuts = np.unique(sample[np.linspace(0, len(sample) - 1, ranges + 1).astype(int)[1:-1]]) if len(sample) else sample
    shared = spark.sparkContext.broadcast(cuts)

    def place(batches: Iterator[pa.RecordBatch], tops: np.ndarray, above: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.searchsorted(shared.value, np.asarray(batch.column(2)), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(np.zeros(len(own)), pa.int32())], ["id", "text", "ord", "range", "tail"])
            hit = np.isin(np.asarray(batch.column(2)), tops)
            if hit.any():
                extra = batch.filter(pa.array(hit))
                up = above[np.searchsorted(tops, np.asarray(extra.column(2)))]
                yield pa.RecordBatch.from_arrays([*extra.columns, pa.array(up, pa.int32()), pa.array(np.ones(len(up)), pa.int32())], ["id", "text", "ord", "range", "tail"])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ord_ = np.asarray(batch.column(0))
            own = np.searchsorted(shared.value, ord_, side="right")
            for r in np.unique(own):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([ord_[own == r].max()], pa.int64())], ["range", "top"])

    found = sorted((r["range"], r["top"]) for r in ids.mapInArrow(ranged, "range int, top bigint").groupBy("range").agg(F.max("top").alias("top")).collect())
    order = [r for r, _ in found]
    tops = np.asarray([t for _, t in found], dtype=np.int64)
    above = np.asarray([order[(i + 1) % len(order)] for i in range(len(order))], dtype=np.int64)
    dealt = picked.mapInArrow(lambda b: place(b, tops, above), "id bigint, text string, ord bigint, range int, tail int")
    dealt = dealt.repartition(ranges, "range").sortWithinPartitions("range", "tail", F.desc("ord"), "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = prepared(), None
        for batch in batches:
            for part in text_slices(batch, 1):
                out = []
                for doc_id, text, where, tail in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    if held is not None:
                        out.append(apply(state, held[0], held[1], text))
                    # a tail closes its range; rows that repeat its id follow unused
                    held = (doc_id, text) if not tail else None
                if out:
                    yield out

    return dealt, stream


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text: the last floor(n/2) code points
    replaced by the first as many (or all) of the next document by descending id.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts count as empty; the empty fingerprint is all zeros and alike to itself. Null ids come
    last, and rows that repeat an id are ordered by text, so each of them has a next one; a very long text
    is held with its next one only. A single document is its own next one; an empty table gives no rows;
    other columns are ignored.
    """
    words = lexicon(docs, text_col) if words is None else words
    shared = docs.sparkSession.sparkContext.broadcast(words)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    recent: dict = {}

    def prepared():
        recent.clear()
        return Fingerprints(shared.value)

    def apply(state: Fingerprints, doc_id, text: bytes, following: bytes) -> tuple:
        own = recent.pop("next") if recent.get("text") is text else state.of(text)
        chars = text.decode("utf-8", "replace")
        half = len(chars) // 2
        edited = (chars[: len(chars) - half] + following.decode("utf-8", "replace")[:half]).encode("utf-8")
        changed, after = state.of(edited), state.of(following)
        recent.update(text=following, next=after)
        return doc_id, len(chars), hashlib.sha256(edited).hexdigest(), "".join(own), "".join(changed), likeness(own, changed), likeness(own, after)

    dealt, stream = with_next(docs, id_col, text_col, prepared, apply)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stream(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    out = dealt.mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
