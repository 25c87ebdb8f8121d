"""Corpus preparation: toxicity, near duplicates, secrets, mixing, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and reread as the next one's docs. All but the last return the columns
of documents, and no others: columns beyond these five don't go through. An empty table goes through
all stages as an empty table. What a stage does with nulls, empty and very long texts, ties and repeated
rows is said at each; an input column that has the name of a result column can't clash, as only the
five are read. The stages' folders stay under the checkpoint folder for its owner to clear.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import bpe, mixing, near_dup, secret_scan, toxicity
from callscope.llm.queries import PATTERN, RANKS, table
from callscope.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of op2, fitted on labels, doesn't reject.

    Null and empty texts are clean; very long ones are read whole; rows that repeat an id or a text, and
    null ids, are judged alike and each for itself.
    """
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=[c for c in COLUMNS if c != "doc_id"])
    return scored.where(~F.col("toxic")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id.

    Null and word-less texts are in no group and stay; of rows equal in id and text one stays; null ids
    come after all others, ties by the text's digest.
    """
    ship(spark)
    return near_dup.keep_one(docs.select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets in its text masked and n_chars counted anew.

    A null text stays null, with a null n_chars; texts without secrets stay as they are, whatever their
    length; rows stay one to one.
    """
    masked = secret_scan.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those it doesn't take go.

    Documents without words, null texts among them, take part in complete epochs only; a null source is a
    source of its own; ties of the key go by id; rows equal in id and text are taken together.
    """
    mixed = mixing.mix(docs, keep=[c for c in COLUMNS if c != "doc_id"])
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    return mixed.where("copies > 0").select(*COLUMNS, copies).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them.

    A null text has no tokens; very long texts are encoded whole; rows stay one to one.
    """
    ship(spark)
    # the digest stands for the text, so that each text travels once
    digest = docs.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    done = bpe.encode_decode(digest, RANKS, PATTERN, keep=["lang", "source", "_digest"])
    same = F.sha2("decoded", 256) == F.col("_digest")
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Regression, sketches and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    folder = f"{root.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
