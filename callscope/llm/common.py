"""Helpers shared by the training-data operators: checkpoints, spans by native regular
expressions, and bounded word hashing inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,m:string>"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; where none is set
    (tests), a folder in the warehouse, which all executors share, is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def counted(df: DataFrame, *sums: Column) -> tuple[DataFrame, list]:
    """A checkpoint and the values of sums over its rows, taken as it is written instead of by a second job."""
    seen = Observation()
    done = checkpointed(df.observe(seen, *[x.alias(f"s{i}") for i, x in enumerate(sums)]))
    return done, [seen.get[f"s{i}"] for i in range(len(sums))]


def kept_columns(keep: list[str] | None, id_col: str, made: tuple[str, ...]) -> list[str]:
    """The columns to carry besides the id, each once; one with the name of a made column is refused."""
    keep = [c for c in dict.fromkeys(keep or []) if c != id_col]
    clash = sorted({id_col, *keep} & set(made))
    if clash:
        raise ValueError(f"these columns have names of the result's own: {', '.join(clash)}; rename them first")
    return keep


#: Spans gathered before they are put aside, so that a text with n of them copies n * CHUNK / 2 and not n^2 / 2.
CHUNK = 128
#: Stand for a character inside a span, and inside a match that fails its check; noncharacters, which
#: no text holds.
FILL, REJECTED = "\uffff", "\ufffe"


def with_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add, for each name, the leftmost non-overlapping matches of a pattern as an array of
    (s, e, m): start, end (exclusive) in code points, and the matched text.

    ``split`` gives what lies between the matches, so a running sum of lengths gives places.
    """
    hits = df.withColumns({f"_h_{k}": F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for k, p in patterns.items()})
    none = F.array().cast(f"array<{SPAN}>")

    def placed(k: str, p: str) -> Column:
        found = F.col(f"_h_{k}")
        between = F.slice(F.split(F.col(text), p, -1), F.lit(1), F.size(found))
        zipped = F.zip_with(between, found, lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m).alias("len"), m.alias("m")))
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"), F.array().cast(f"array<array<{SPAN}>>").alias("full"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(start.alias("s"), (start + x["len"]).alias("e"), x["m"].alias("m"))
            fills = F.size(acc["out"]) >= CHUNK
            out = F.when(fills, F.array(span)).otherwise(F.concat(acc["out"], F.array(span)))
            return F.struct((start + x["len"]).alias("at"), out.alias("out"), F.when(fills, F.concat(acc["full"], F.array(acc["out"]))).otherwise(acc["full"]).alias("full"))

        return F.when(F.size(found) > 0, F.aggregate(zipped, zero, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["out"]))))).otherwise(none)

    return hits.withColumns({k: placed(k, p) for k, p in patterns.items()}).drop(*[f"_h_{k}" for k in patterns])


def blanked(text: Column, pattern: str, valid=None, mark_rejected: bool = False) -> Column:
    """The text with every character of a pattern's (valid) matches replaced by FILL, in one pass;
    matches that fail the check stay, or become REJECTED."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    fill = lambda m, c: F.repeat(F.lit(c), F.char_length(m))
    other = lambda m: fill(m, REJECTED) if mark_rejected else m
    hide = lambda m: fill(m, FILL) if valid is None else F.when(valid(m), fill(m, FILL)).otherwise(other(m))
    pieces = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.concat(b, hide(m)))
    return F.concat(F.array_join(pieces, ""), F.element_at(between, -1))


def overlaid(texts: list[Column]) -> Column:
    """Of versions of one text, FILL wherever one of them has it, else REJECTED wherever one has that."""
    out = texts[0]
    for t in texts[1:]:
        either = F.zip_with(F.split(out, ""), F.split(t, ""), lambda a, b: F.when((a == FILL) | ((a == REJECTED) & (b != FILL)), a).otherwise(b))
        out = F.when(out.isNull(), t).when(t.isNull(), out).otherwise(F.array_join(either, ""))
    return out


def joined_spans(spans: Column) -> Column:
    """'kind:start:end' of an already ordered array of structs with kind, s, e; comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash. At most LIMIT words of at most LONGEST bytes are remembered, so
    a task's memory stays flat whatever the texts hold."""

    LIMIT, LONGEST = 100_000, 64

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value


def hash_words(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: int, max_bytes: int = 4 << 20, max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that no piece holds more than max_rows rows or much more text than
    max_bytes (a single longer text is a piece of its own)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and (total + n > max_bytes or i - begin >= max_rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
    # a worker waits for its next task with what its pool has kept
    pa.default_memory_pool().release_unused()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding them."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return column.to_pylist()
