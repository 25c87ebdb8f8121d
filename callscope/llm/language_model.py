"""Language-model scores: a log-bilinear neural model trained in numpy by noise-contrastive estimation.

1. Words of all training documents are counted: exact sums in each task, then one row a word and task
   is shuffled. The FREQUENT commonest words and the end are symbols of the model; every other word,
   known or not, belongs to one of SUFFIXES symbols by its last bytes.
2. The model gives P(symbol | CONTEXT symbols before): the contexts' vectors, weighted by position, add up to
   a vector that meets the symbol's vector and bias. It learns from all training documents, each once,
   in rounds that double: every task trains on its part of a round from the same start, by noise samples
   that a batch shares, and the tasks' models are averaged, weighted by tokens, in a tree of streams.
3. Scoring normalises over all symbols by batched matrix products. Within a suffix symbol a word has
   its share (c + 0.5) of the symbol's counts plus 0.5 for what was never seen, so the probabilities of all
   known words and one unseen word a suffix add up to 1.
4. Counts of the KNOWN commonest words go to every task; rarer words are joined to the counts, a row a
   word and document, and summed by document. Texts are never shuffled.

Odd rows. A null or empty text is one end token. Very long texts are read whole, a slice of tokens at
a time; a word of over LONG bytes goes by a 128-bit digest. Training rows are those of the caller's
condition (null is no); rows equal in id and text have equal results, each its row. Null ids keep their row.
Without training tokens the counts are 0 and the model is uniform. Columns beyond id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, checkpointed, text_slices

FREQUENT, SUFFIXES = 255, 128
#: Symbols: the end, the frequent words, the suffixes; and a start that only stands in contexts.
SYMBOLS = 1 + FREQUENT + SUFFIXES
CONTEXT, SIZE = 4, 24
#: Words whose counts every task holds, at most; buckets of the histogram that finds them.
KNOWN, BUCKETS = 1 << 17, 8
LONG = 40
#: Words of a task counted before they are handed on.
COUNTED = 300_000
#: Slices of the training documents; a round takes as many slices as all before it.
SLICES, ROUNDS = 16, ((0, 1), (1, 2), (2, 4), (4, 8), (8, 16))
BATCH, NOISE, RATE = 2048, 48, 0.15
#: Models averaged by one task, and tokens scored at once.
FAN, SCORED = 32, 256
#: Words outside the known ones whose symbol a task remembers.
REMEMBERED = 200_000
#: Logits below which their exponentials can be added up as they are.
SAFE = 60.0


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def word_key(word: bytes) -> bytes:
    """The word; where it is long, its digest and its last two bytes (no text holds a byte of 255)."""
    return word if len(word) <= LONG else b"\xff" + xxhash.xxh3_128_digest(word) + word[-2:]


def suffix(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUFFIXES


@dataclass
class Counts:
    """What the training documents hold; table has a row a word (key, n), the end not among them."""

    table: DataFrame
    tokens: int
    distinct: int
    ends: int
    frequent: list[bytes]
    known: list[bytes]
    known_counts: np.ndarray
    #: Of every suffix symbol: the counts of its words, each plus 0.5, and 0.5 more.
    masses: np.ndarray


@dataclass
class Model:
    """Vectors of symbols in contexts (the start is the last), weights by position, vectors of symbols as
    targets, biases; and the squares that steer the step sizes."""

    source: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        return [(SYMBOLS + 1, SIZE), (CONTEXT, SIZE), (SYMBOLS, SIZE), (SYMBOLS,)]

    @classmethod
    def unpack(cls, flat: np.ndarray) -> Model:
        cuts = np.cumsum([int(np.prod(s)) for s in cls.shapes()])[:-1]
        return cls(*(p.reshape(s).copy() for p, s in zip(np.split(flat, cuts), cls.shapes(), strict=True)))

    def pack(self) -> np.ndarray:
        return np.concatenate([self.source.ravel(), self.weight.ravel(), self.target.ravel(), self.bias.ravel()])

    def tables(self) -> list[np.ndarray]:
        """For each position before, the vectors of the symbols weighted by that position."""
        return [self.source * w for w in self.weight]


def count(docs: DataFrame, text_col: str = "text") -> Counts:
    """Counts of the words of these documents."""
    counted = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(_count, "w binary, n long")
    table = checkpointed(counted.groupBy("w").agg(F.sum("n").alias("n")))
    ends = (table.where(F.col("w") == F.lit(bytearray(b"")))).agg(F.sum("n")).first()[0] or 0
    table = table.where(F.col("w") != F.lit(bytearray(b"")))
    bucket = F.floor(F.log2("n") * BUCKETS)
    cls = F.pmod(F.crc32(F.expr("substring(w, -2)")), F.lit(SUFFIXES)).cast("int")
    steps = table.groupBy(bucket.alias("b")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.col("b").desc()).collect()
    tokens, distinct = ends + sum(r["n"] for r in steps), (ends > 0) + sum(r["words"] for r in steps)
    held, least = 0, None
    for r in steps:
        held += r["words"]
        if held > KNOWN:
            break
        least = r["b"]
    # at most KNOWN words
    top = table.where(bucket >= least).toArrow() if least is not None else pa.table({"w": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    pairs = sorted(zip(top["w"].to_pylist(), top["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    frequent = [w for w, _ in pairs if not w.startswith(b"\xff")][:FREQUENT]
    masses = np.full(SUFFIXES, 0.5)
    for r in table.groupBy(cls.alias("c")).agg(F.sum(F.col("n") + 0.5).alias("m")).collect():
        masses[r["c"]] += r["m"]
    chosen = set(frequent)
    for w, n in pairs:
        if w in chosen:
            masses[suffix(w)] -= n + 0.5
    return Counts(table, tokens, distinct, ends, frequent, [w for w, _ in pairs], np.array([n for _, n in pairs], dtype=np.int64), masses)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a word, again each time that COUNTED are held; the empty word counts documents."""

    def rows(held: Counter) -> Iterator[pa.RecordBatch]:
        keys, counts = list(map(word_key, held)), list(held.values())
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000], pa.binary()), pa.array(counts[i : i + 50_000], pa.int64())], names=["w", "n"])

    held: Counter = Counter()
    for batch in batches:
        for piece in text_slices(batch, 0):
            held[b""] += piece.num_rows
            for text in as_bytes(piece.column(0)):
                held.update(words(text))
            if len(held) >= COUNTED:
                yield from rows(held)
                held.clear()
    yield from rows(held)


class Symbols(dict):
    """Word (bytes) -> its place among the known words, or -1 - suffix of what isn't among them."""

    def __init__(self, known: list[bytes]):
        super().__init__(zip(known, range(len(known)), strict=True))
        self.room = REMEMBERED

    def __missing__(self, word: bytes) -> int:
        code = -1 - zlib.crc32(word[-2:]) % SUFFIXES
        if len(word) <= LONG and self.room > 0:
            self.room -= 1
            self[word] = code
        return code


def _symbol_table(known: list[bytes], frequent: list[bytes]) -> np.ndarray:
    """The symbol of each known word."""
    place = {w: 1 + i for i, w in enumerate(frequent)}
    return np.array([place.get(w, 1 + FREQUENT + suffix(w)) for w in known], dtype=np.int64)


def contexts(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CONTEXT columns: the symbols before each, nearest first, the start where a text begins.

    ends: places where texts end (each text's last symbol).
    """
    starts = np.r_[0, ends[:-1] + 1]
    since = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.r_[starts, len(symbols)]))
    out = np.empty((CONTEXT, len(symbols)), dtype=np.int64)
    for i in range(CONTEXT):
        before = np.r_[np.full(min(i + 1, len(symbols)), SYMBOLS), symbols[: max(0, len(symbols) - i - 1)]]
        out[i] = np.where(since > i, before, SYMBOLS)
    return out


# --- training


def start_model(noise: np.ndarray) -> Model:
    r = np.random.default_rng(7)
    draw = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
    return Model(draw(SYMBOLS + 1, SIZE), np.full((CONTEXT, SIZE), 1 / CONTEXT, dtype=np.float32), draw(SYMBOLS, SIZE), np.log(noise).astype(np.float32))


def noise_of(counts: Counts) -> np.ndarray:
    """The symbols' shares of the training tokens, none of them 0."""
    place = {w: 1 + i for i, w in enumerate(counts.frequent)}
    out = np.full(SYMBOLS, 0.5)
    out[0] += counts.ends
    for w, n in zip(counts.known, counts.known_counts.tolist(), strict=True):
        if w in place:
            out[place[w]] += n
    out[1 + FREQUENT :] += counts.masses - 0.5
    return out / out.sum()


def nce_loss_and_gradients(model: Model, ctx: np.ndarray, goal: np.ndarray, drawn: np.ndarray, log_noise: np.ndarray) -> tuple[float, Model]:
    """Loss of a batch and its gradients, both summed over the batch.

    ctx: CONTEXT rows; goal: the true symbols; drawn: noise symbols shared by the batch; log_noise: log of
    noise samples times noise share, of every symbol.
    """
    true, false, grad = _nce(model, ctx, goal, drawn, log_noise)
    soft = lambda x: np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))
    return float(soft(-true).sum(dtype=np.float64) + soft(false).sum(dtype=np.float64)), grad


def _nce(model: Model, ctx: np.ndarray, goal: np.ndarray, drawn: np.ndarray, log_noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, Model]:
    """Scores of the true and of the noise symbols against the noise, and the gradients."""
    sources = np.take(model.source, ctx, axis=0, mode="clip")
    hidden = np.einsum("cbd,cd->bd", sources, model.weight)
    goal_vec, noise_vec = np.take(model.target, goal, axis=0, mode="clip"), model.target[drawn]
    true = np.einsum("bd,bd->b", hidden, goal_vec) + (model.bias - log_noise)[goal]
    false = hidden @ noise_vec.T
    false += model.bias[drawn] - log_noise[drawn]
    g_true, g_false = -_logistic(-true), _logistic(false)
    d_hidden = g_true[:, None] * goal_vec + g_false @ noise_vec
    grad = Model(np.zeros_like(model.source), np.einsum("cbd,bd->cd", sources, d_hidden), np.zeros_like(model.target), np.zeros_like(model.bias))
    _add(grad.source, ctx.ravel(), (d_hidden[None] * model.weight[:, None]).reshape(-1, SIZE))
    _add(grad.target, goal, g_true[:, None] * hidden)
    _add(grad.target, drawn, g_false.T @ hidden)
    grad.bias += (np.bincount(goal, g_true, SYMBOLS) + np.bincount(drawn, g_false.sum(axis=0), SYMBOLS)).astype(model.bias.dtype)
    return true, false, grad


def _logistic(x: np.ndarray) -> np.ndarray:
    out = np.exp(-np.clip(x, -80, 80))
    out += 1
    return np.reciprocal(out, out=out)


def _add(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add values to rows that may repeat."""
    order = np.argsort(rows.astype(np.int16), kind="stable")
    listed = rows[order]
    first = np.flatnonzero(np.r_[True, listed[1:] != listed[:-1]])
    into[listed[first]] += np.add.reduceat(np.take(values, order, axis=0, mode="clip"), first, axis=0)


class Trainer:
    """Steps of falling size (by the squares of past gradients) over batches of one stream."""

    def __init__(self, flat: np.ndarray, squares: np.ndarray, noise: np.ndarray, seed: int):
        self.model, self.squares = Model.unpack(flat), Model.unpack(squares)
        self.noise, self.log_noise = np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)
        self.random, self.tokens = np.random.default_rng(seed), 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def feed(self, symbols: np.ndarray, ends: np.ndarray) -> None:
        """Whole texts; batches mix all that waits."""
        self.held.append((contexts(symbols, ends), symbols))
        self.waiting += len(symbols)
        if self.waiting >= 32 * BATCH:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        ctx, goal = np.concatenate([c for c, _ in self.held], axis=1), np.concatenate([s for _, s in self.held])
        self.held, self.waiting = [], 0
        order = self.random.permutation(len(goal))
        for i in range(0, len(order), BATCH):
            self.step(np.take(ctx, order[i : i + BATCH], axis=1, mode="clip"), goal[order[i : i + BATCH]])

    def step(self, ctx: np.ndarray, goal: np.ndarray) -> None:
        drawn = np.minimum(np.searchsorted(self.noise, self.random.random(NOISE)), SYMBOLS - 1)
        _, _, grad = _nce(self.model, ctx, goal, drawn, self.log_noise)
        self.tokens += len(goal)
        for name in ("source", "weight", "target", "bias"):
            g, s, v = getattr(grad, name) / len(goal), getattr(self.squares, name), getattr(self.model, name)
            s += g * g
            v -= RATE * g / (np.sqrt(s) + 1e-4)


def train(docs: DataFrame, counts: Counts, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of these documents, each of which it reads once."""
    spark = docs.sparkSession
    noise = noise_of(counts)
    first = start_model(noise)
    if not counts.tokens:
        first.target[:] = 0
        first.bias[:] = -np.log(SYMBOLS)
        return first
    flat, squares = first.pack(), np.zeros(len(first.pack()), dtype=np.float32)
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")), F.lit(SLICES))
    for round_, (low, high) in enumerate(ROUNDS):
        state = spark.sparkContext.broadcast((flat, squares, noise, counts.frequent))
        taken = docs.where((part >= low) & (part < high)).select(F.col(text_col).cast("string").alias("t"))
        models = taken.mapInArrow(_trainer(state, round_), "m binary, n double")
        total = _merged(models)
        if total is not None:
            flat, squares = np.split(total.astype(np.float32), 2)
    return Model.unpack(flat)


def _merged(models: DataFrame) -> np.ndarray | None:
    """The models' mean, weighted by n: FAN of them in one stream, until FAN are left."""
    models = checkpointed(models)
    rows = models.count()
    while rows > FAN:
        models = checkpointed(models.repartition(-(-rows // FAN)).mapInArrow(_mean, "m binary, n double"))
        rows = models.count()
    done = list(_mean(iter(models.toArrow().to_batches())))
    return np.frombuffer(done[0].column(0)[0].as_py(), dtype=np.float64) if done else None


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, weight = None, 0.0
    for batch in batches:
        for m, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            one = np.frombuffer(m.as_py(), dtype=np.float64) * n
            total, weight = one if total is None else total + one, weight + n
    if weight:
        yield _model_row(total / weight, weight)


def _model_row(flat: np.ndarray, n: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([flat.astype(np.float64).tobytes()], pa.binary()), pa.array([n], pa.float64())], names=["m", "n"])


def _trainer(state, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        flat, squares, noise, frequent = state.value
        symbols = FrequentSymbols(frequent)
        trainer = Trainer(flat, squares, noise, 1000 * TaskContext.get().partitionId() + round_)
        for batch in batches:
            for piece in text_slices(batch, 0, max_bytes=1 << 20):
                trainer.feed(*symbols.of(as_bytes(piece.column(0))))
        trainer.flush()
        if trainer.tokens:
            yield _model_row(np.concatenate([trainer.model.pack(), trainer.squares.pack()]), float(trainer.tokens))

    return run


END = np.iinfo(np.int64).min


def _encoded(texts: list[bytes | None], known: Symbols) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words (an empty one for every end), their codes (END for ends), and the places of the ends."""
    listed, ends = [], []
    for text in texts:
        listed += words(text)
        ends.append(len(listed))
        listed.append(b"")
    codes = np.fromiter(map(known.__getitem__, listed), dtype=np.int64, count=len(listed))
    ends = np.array(ends, dtype=np.int64)
    codes[ends] = END
    return listed, codes, ends


def _to_symbols(codes: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    out = np.where(codes < 0, FREQUENT - codes, 0)
    near = codes >= 0
    out[near] = symbol[codes[near]]
    out[codes == END] = 0
    return out


#: What parts words, as bytes; and odd factors that mix a word's bytes and length into a key.
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\v\f", dtype=np.uint8))
MIXED = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


class FrequentSymbols:
    """Symbols of texts as _encoded and _to_symbols give them where only the frequent words are known, found
    for all words of some texts together: training needs no word itself."""

    def __init__(self, frequent: list[bytes]):
        two = [bytes([a, b]) for a in range(256) for b in range(256)] + [bytes([a]) for a in range(256)]
        self.by_end = np.array([1 + FREQUENT + suffix(w) for w in two], dtype=np.int64)
        self.frequent = frequent
        keys = np.concatenate([self._words(w)[2] for w in frequent]) if frequent else np.zeros(0, dtype=np.uint64)
        self.place = np.argsort(keys, kind="stable")
        self.keys = keys[self.place]

    @staticmethod
    def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where words start and stop (in the text after 8 blanks), their keys, and that text."""
        flat = np.frombuffer(b"".join((b" " * 8, text, b" " * 8)), dtype=np.uint8)
        space = SPACE[flat]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, stops = edges[::2], edges[1::2]
        eight = np.ndarray(len(flat) - 7, dtype="<u8", buffer=flat, strides=(1,))
        unused = (64 - 8 * np.minimum(stops - starts, 8)).astype(np.uint64)
        first, last = (eight[starts] << unused) >> unused, eight[stops - 8] >> unused
        return starts, stops, first * MIXED[0] + last * MIXED[1] + (stops - starts).astype(np.uint64) * MIXED[2], flat

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of these texts, and the places of their ends."""
        texts = [t or b"" for t in texts]
        starts, stops, keys, flat = self._words(b" ".join(texts).lower())
        size = stops - starts
        end = flat[stops - 1].astype(np.int64)
        found = self.by_end[np.where(size > 1, 256 * flat[stops - 2].astype(np.int64), 65536) + end]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            # a key holds 16 bytes of a word
            for i in np.flatnonzero(hit & (size > 16)).tolist():
                hit[i] = flat[starts[i] : stops[i]].tobytes() == self.frequent[self.place[at[i]]]
            found[hit] = 1 + self.place[at[hit]]
        upto = 8 + np.cumsum([len(t) + 1 for t in texts])
        ends = np.searchsorted(starts, upto) + np.arange(len(texts))
        out = np.zeros(len(found) + len(texts), dtype=np.int64)
        word = np.ones(len(out), dtype=bool)
        word[ends] = False
        out[word] = found
        return out, ends


# --- scoring


def symbol_log10(model: Model, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log10 P(symbol | symbols before) of every symbol, normalised over all of them.

    A logit is a sum over the positions before, so its exponential is a product: one matrix product a position
    gives every symbol's part of all logits, and tokens multiply rows of their exponentials. Where logits are
    too large for that, they are formed and normalised for each token.
    """
    parts = [table @ model.target.T for table in model.tables()]
    out, ctx = np.empty(len(symbols)), contexts(symbols, ends)
    true = model.bias[symbols].astype(np.float64)
    for part, before in zip(parts, ctx, strict=True):
        true += np.take(part.ravel(), before * SYMBOLS + symbols, mode="clip")
    if sum(float(np.abs(p).max()) for p in parts) + float(np.abs(model.bias).max()) < SAFE:
        raised = [np.exp(p) for p in parts]
        raised[0] *= np.exp(model.bias)
        # two blocks of rows, which stay in the processor's cache
        product, factor = np.empty((2, SCORED, SYMBOLS), dtype=raised[0].dtype)
        for i in range(0, len(symbols), SCORED):
            n = min(SCORED, len(symbols) - i)
            np.take(raised[0], ctx[0, i : i + n], axis=0, mode="clip", out=product[:n])
            for j in range(1, CONTEXT):
                np.take(raised[j], ctx[j, i : i + n], axis=0, mode="clip", out=factor[:n])
                if j < CONTEXT - 1:
                    product[:n] *= factor[:n]
            out[i : i + n] = np.vecdot(product[:n], factor[:n])
        np.log(out, out=out)
    else:
        for i in range(0, len(symbols), SCORED):
            logits = model.bias + sum(p[c[i : i + SCORED]] for p, c in zip(parts, ctx, strict=True))
            high = logits.max(axis=1)
            out[i : i + SCORED] = high + np.log(np.exp(logits - high[:, None]).sum(axis=1))
    return (true - out) / np.log(10)


def score(docs: DataFrame, counts: Counts, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row a document.

    base_score takes every token by its count alone, whatever stands before.
    """
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((model, counts.known, counts.known_counts, counts.frequent, counts.masses, counts.ends, counts.tokens, counts.distinct))
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("h"), F.col(text_col).cast("string").alias("t"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"))
    kind = docs.schema[id_col].dataType.simpleString()
    parts = rows.mapInArrow(_scorer(given), f"w binary, k1 long, k2 long, n long, head struct<id:{kind},h:boolean,tokens:long,known:long,base:double,score:double>")
    # heads have a key that no word has, so they meet nothing and lie in no one place
    met = parts.join(counts.table.select("w", F.col("n").alias("c")), "w", "left")
    rare = F.when(F.col("head").isNull(), F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5))
    summed = met.groupBy("k1", "k2").agg(
        F.max("head").alias("head"),
        F.count("head").alias("rows"),
        F.coalesce(F.sum(rare), F.lit(0.0)).alias("rare"),
        F.coalesce(F.sum(F.when(F.col("head").isNull() & F.col("c").isNotNull(), F.col("n"))), F.lit(0)).alias("rare_known"),
    )
    # rows equal in id and text have summed their words together
    again = F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_again")
    return summed.select(
        F.col("head.id").alias(id_col),
        F.col("head.h").alias("held_out"),
        F.col("head.tokens").alias("n_tokens"),
        (F.col("head.known") + (F.col("rare_known") / F.col("rows")).cast("bigint")).alias("n_known"),
        F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
        (F.col("head.base") + F.col("rare") / F.col("rows")).alias("base_score"),
        (F.col("head.score") + F.col("rare") / F.col("rows")).alias("score"),
        again,
    ).drop("_again")


def _scorer(given):
    """A head for every document with what is known here, and a row for every rarer word in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known_words, known_counts, frequent, masses, ends_count, tokens, distinct = given.value
        known, symbol = Symbols(known_words), _symbol_table(known_words, frequent)
        whole = np.log10(tokens + 0.5 * (distinct + 1))
        count_log = np.log10(known_counts + 0.5)
        # of a word that is no symbol of its own: its count in its symbol
        share = np.where(symbol > FREQUENT, count_log - np.log10(masses)[np.maximum(symbol - 1 - FREQUENT, 0)], 0.0)
        # rarer words: their count comes with the join
        mass_log = np.log10(masses)
        for batch in batches:
            for piece in text_slices(batch, 2, max_bytes=1 << 20):
                texts, keys = as_bytes(piece.column(2)), as_bytes(piece.column(3))
                listed, codes, ends = _encoded(texts, known)
                symbols = _to_symbols(codes, symbol)
                near, end = codes >= 0, codes == END
                rare = ~near & ~end
                model_part = symbol_log10(model, symbols, ends)
                model_part[near] += share[codes[near]]
                model_part[rare] -= mass_log[symbols[rare] - 1 - FREQUENT]
                base_part = np.full(len(codes), -whole)
                base_part[near] += count_log[codes[near]]
                base_part[end] += np.log10(ends_count + 0.5)
                starts = np.r_[0, ends[:-1] + 1]
                digests = [xxhash.xxh3_128(k + b"\x00" + (t or b"")).intdigest() for k, t in zip(keys, texts, strict=True)]
                k1 = np.array([d >> 64 for d in digests], dtype=np.uint64).view(np.int64)
                k2 = np.array([d & (1 << 64) - 1 for d in digests], dtype=np.uint64).view(np.int64)
                # distinct rare words of the piece by number, then a row a document and word
                at = np.flatnonzero(rare)
                number: dict[bytes, int] = {}
                which = np.fromiter((number.setdefault(listed[i], len(number)) for i in at.tolist()), dtype=np.int64, count=len(at))
                pairs, times = np.unique(np.searchsorted(ends, at) * max(len(number), 1) + which, return_counts=True)
                who, which = np.divmod(pairs, max(len(number), 1))
                rare_words = pa.array(list(map(word_key, number)), pa.binary()).take(pa.array(which))
                known_here = near | end & (ends_count > 0)
                heads = pa.StructArray.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(ends - starts + 1), pa.array(np.add.reduceat(known_here.astype(np.int64), starts)), pa.array(np.add.reduceat(base_part, starts)), pa.array(np.add.reduceat(model_part, starts))],
                    names=["id", "h", "tokens", "known", "base", "score"],
                )
                own = pa.array([b"\xff\xff" + d.to_bytes(16) for d in digests], pa.binary())
                yield pa.RecordBatch.from_arrays([own, pa.array(k1), pa.array(k2), pa.array(np.ones(len(k1), dtype=np.int64)), heads], names=["w", "k1", "k2", "n", "head"])
                if len(who):
                    yield pa.RecordBatch.from_arrays([rare_words, pa.array(k1[who]), pa.array(k2[who]), pa.array(times.astype(np.int64)), pa.nulls(len(who), heads.type)], names=["w", "k1", "k2", "n", "head"])

    return run


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count and train on the rows where training holds (null is no), and score all rows."""
    wanted = F.coalesce(training, F.lit(False))
    taught = docs.where(wanted)
    counts = count(taught, text_col)
    return score(docs, counts, train(taught, counts, id_col, text_col), ~wanted, id_col, text_col)
