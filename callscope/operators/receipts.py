"""A content-addressed store of judge calls: bundles of request, response and what was parsed of it, each
under the digest of its parts, written once and verified when they are replayed.

The store is a table in BUCKETS buckets by request hash: looking requests up and adding bundles moves only
the new rows to their buckets, never what is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

BUCKETS = 64
#: Words in a key that bear secrets: fixed values.
SECRET_KEYS = ("authorization", "api_key", "apikey", "access_token")
#: A key in a JSON text: a string, escapes and all, before a colon.
KEY = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"\s*+:'
PARTS = ("request", "raw_response", "parsed", "metadata")
HASHES = ("request_hash", "raw_response_hash", "parsed_hash", "metadata_hash")
STORED = ["namespace", *PARTS, *HASHES, "receipt_id"]


def digest(text: Column) -> Column:
    """'sha256:' and the digest of a canonical JSON text; a missing one is null in JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(text, F.lit("null")), 256))


def receipts(bundles: DataFrame) -> DataFrame:
    """bundles (namespace, request, raw_response, parsed, metadata: canonical JSON texts) with the hash of
    each part and the receipt's id, the digest of the hashes as canonical JSON."""
    hashed = bundles.withColumns({h: digest(F.col(p)) for h, p in zip(HASHES, PARTS, strict=True)})
    identity = F.to_json(F.struct(*sorted(HASHES)))
    return hashed.withColumn("receipt_id", digest(identity)).select(*STORED)


def secret_bearing(text: Column) -> Column:
    """Whether a key anywhere in a JSON text holds a word that bears secrets."""
    words = "|".join(SECRET_KEYS)
    keys = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(KEY), F.lit(1))
    return F.exists(keys, lambda k: F.lower(k).rlike(words))


def exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def write(bundles: DataFrame, table: str) -> DataFrame:
    """Add what isn't stored yet, and return a row a bundle: receipt_id, request_hash and outcome.

    'rejected': a key bears secrets, or the namespace is no single name; nothing is written. 'stored': it
    was there, and what is there is the same. 'altered': it was there, but the stored parts have another
    digest. 'second_response': written, but the request has another response too. 'written' otherwise.
    What is stored is never overwritten; equal bundles are one.
    """
    spark = bundles.sparkSession
    # equal bundles are found by their texts, so only these are shuffled; a missing text has the digest of null
    said = [F.coalesce(p, F.lit("null")).alias(f"_{p}") for p in PARTS]
    rows = receipts(bundles.select("namespace", *PARTS, *said).dropDuplicates(["namespace", *[f"_{p}" for p in PARTS]]))
    named = F.col("namespace").rlike(r"^[^/]+$") & ~F.col("namespace").isin(".", "..")
    secret = F.lit(False)
    for part in PARTS:
        secret = secret | secret_bearing(F.col(part))
    rows = rows.withColumn("_bad", secret | ~F.coalesce(named, F.lit(False)))
    good = rows.where(~F.col("_bad")).drop("_bad")
    keys = ["namespace", "request_hash", "receipt_id"]
    if exists(spark, table):
        stored = spark.table(table).select(*STORED)
        there = good.select(*keys).join(stored, keys)
        old = there.select(*keys, F.when(_intact(), "stored").otherwise("altered").alias("outcome"))
        new = good.join(stored.select(*keys), keys, "left_anti")
        responses = stored.select("namespace", "request_hash", "raw_response_hash").unionByName(new.select("namespace", "request_hash", "raw_response_hash"))
    else:
        old, new, responses = None, good, good.select("namespace", "request_hash", "raw_response_hash")
    # least and most differ where there are several: one shuffle after partial aggregation, no set of responses
    count = responses.groupBy("namespace", "request_hash").agg((F.min("raw_response_hash") != F.max("raw_response_hash")).alias("more"))
    told = new.join(count, ["namespace", "request_hash"]).select(*keys, F.when(F.col("more"), "second_response").otherwise("written").alias("outcome"))
    out = told if old is None else told.unionByName(old)
    out = out.unionByName(rows.where("_bad").select(*keys, F.lit("rejected").alias("outcome"))).drop("namespace")
    # the report is made before the rows are, so it says what was there
    out = checkpointed(out)
    new.repartition(BUCKETS, "request_hash").sortWithinPartitions("request_hash").write.bucketBy(BUCKETS, "request_hash").sortBy("request_hash").mode("append").format("parquet").saveAsTable(table)
    return out


def lookup(requests: DataFrame, table: str, namespace: str) -> DataFrame:
    """requests (request: canonical JSON, and other columns) with request_hash, parsed and outcome: 'hit',
    'open' (nothing stored), or 'ambiguous' (stored with several responses)."""
    asked = requests.withColumn("request_hash", digest(F.col("request")))
    spark = requests.sparkSession
    if not exists(spark, table):
        return asked.withColumns({"parsed": F.lit(None).cast("string"), "outcome": F.lit("open")})
    stored = spark.table(table).where(F.col("namespace") == namespace)
    known = stored.groupBy("request_hash").agg((F.min("raw_response_hash") != F.max("raw_response_hash")).alias("_more"), F.max("parsed").alias("parsed"))
    found = asked.join(known, "request_hash", "left")
    outcome = F.when(F.col("_more").isNull(), "open").when(F.col("_more"), "ambiguous").otherwise("hit")
    return found.withColumn("outcome", outcome).withColumn("parsed", F.when(F.col("outcome") == "hit", F.col("parsed"))).drop("_more")


def replay(wanted: DataFrame, table: str) -> DataFrame:
    """wanted (receipt_id) with the stored parts and outcome: 'intact', 'altered' (the parts don't have the
    digests that they are stored under), or 'missing'."""
    stored = wanted.sparkSession.table(table).select(*PARTS, *HASHES, "receipt_id")
    found = wanted.join(stored, "receipt_id", "left")
    outcome = F.when(F.col("request_hash").isNull(), "missing").when(_intact(), "intact").otherwise("altered")
    return found.select(*wanted.columns, *PARTS, outcome.alias("outcome"))


def _intact() -> Column:
    """Whether the parts have their hashes, and the hashes the receipt's id."""
    out = digest(F.to_json(F.struct(*sorted(HASHES)))) == F.col("receipt_id")
    for h, p in zip(HASHES, PARTS, strict=True):
        out = out & (digest(F.col(p)) == F.col(h))
    return F.coalesce(out, F.lit(False))
