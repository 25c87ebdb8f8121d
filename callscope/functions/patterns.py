"""Many words in many texts at once: an automaton over all words (Aho-Corasick) reads each text once,
so texts and words never pair up in a join."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Words of one automaton at most, and their characters; more are taken in several passes.
MOST_WORDS, MOST_CHARS = 200_000, 8 << 20


def _blocks(words: DataFrame) -> Iterator[list[str]]:
    """Distinct words, in blocks that a task can hold."""
    block, chars = [], 0
    for (word,) in words.distinct().toLocalIterator():
        if word:
            block.append(word)
            chars += len(word)
        if len(block) >= MOST_WORDS or chars >= MOST_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


def _with(df: DataFrame, name: str) -> StructType:
    return StructType([*df.schema.fields, StructField(name, StringType())])


def words_in(texts: DataFrame, text_col: str, words: DataFrame, name: str) -> DataFrame:
    """A row a text and word that it holds, the word as a new column. words: one column of text; null and
    empty ones are held by none."""
    out = None
    for block in _blocks(words):
        sent = texts.sparkSession.sparkContext.broadcast(block)
        found = _search(texts, text_col, sent, name)
        out = found if out is None else out.unionByName(found)
    return texts.withColumn(name, F.lit(None).cast("string")).limit(0) if out is None else out


def _search(texts: DataFrame, text_col: str, sent, name: str) -> DataFrame:
    at = texts.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value)
        for batch in batches:
            rows, held = [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                if text:
                    found = sorted({w for _, w in automaton.iter(text)})
                    rows += [i] * len(found)
                    held += found
            if rows:
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(held, pa.string())], names=[*batch.schema.names, name])

    return texts.mapInArrow(run, _with(texts, name))


def own_words_in(texts: DataFrame, text_col: str, words_col: str, name: str) -> DataFrame:
    """A row a text and word that it holds, of the words that its own row names (an array of distinct
    texts). Rows that follow each other with the same words share an automaton."""
    at, words_at = texts.columns.index(text_col), texts.columns.index(words_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, automaton = None, None
        for batch in batches:
            rows, held = [], []
            for i, (text, words) in enumerate(zip(batch.column(at).to_pylist(), batch.column(words_at).to_pylist(), strict=True)):
                words = [w for w in words or [] if w]
                if not text or not words:
                    continue
                if words != last:
                    last, automaton = words, _automaton(words)
                found = sorted({w for _, w in automaton.iter(text)})
                rows += [i] * len(found)
                held += found
            if rows:
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(held, pa.string())], names=[*batch.schema.names, name])

    return texts.mapInArrow(run, _with(texts, name))
