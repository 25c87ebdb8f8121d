"""Helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast; beyond it Spark picks the join.
MOST_BROADCAST = 100_000


def dim(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A table of rules or contracts, broadcast if it's as small as such tables should be."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with its partner. It's joined by sorting: Spark sees the size of compressed
    shuffle files only, and would send what looks small, however many rows it has, through the driver."""
    return df.hint("merge")


#: Rows of a part of a table that is dealt by rows.
ROWS_A_PART = 500_000


def parts(*frames: DataFrame) -> int:
    """Parts for these frames together, by their rows. Parts by bytes, as Spark makes them, grow with how well
    rows compress: a shuffle of few different values has millions of rows in some MB."""
    n = sum(df.count() for df in frames)
    cores = frames[0].sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // ROWS_A_PART), min(cores, n // 10_000))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A growing table dealt by key in as many parts as its rows need; aggregations and windows by this key,
    alone or with others, need no further shuffle."""
    return df.repartition(parts(df), key)


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """An inner or left join of two growing tables by sorting, in as many parts as their rows need.

    Several columns become one key: were one of them the same for all rows, Spark would leave it out of the
    join and deal both sides anew, in parts by bytes.
    """
    n = max(parts(left, right), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in on])
    key = F.when(whole, F.struct(*on)).alias("_on")
    first, second = ([c for c in df.columns if c not in on] for df in (left, right))
    sides = left.select(key, *on, *first).repartition(n, "_on"), right.select(key, *second).repartition(n, "_on")
    return sides[0].join(merged(sides[1]), "_on", how).select(*on, *first, *second)


def each(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row of df with every row of a small table of contracts, which becomes a constant: no join."""
    found = rows.limit(MOST_BROADCAST + 1).collect()
    if len(found) > MOST_BROADCAST:
        raise ValueError(f"a table of more than {MOST_BROADCAST} contracts can't go with every row")
    kind = F.lit(None).cast(f"array<{rows.schema.simpleString()}>")
    if not found:
        return df.select("*", F.explode(kind).alias("_x")).select(*df.columns, "_x.*")
    constant = df.sparkSession.createDataFrame(found, rows.schema).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("j")).first()["j"]
    return df.select("*", F.explode(F.from_json(F.lit(constant), f"array<{rows.schema.simpleString()}>")).alias("_x")).select(*df.columns, "_x.*")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: in the folder that spark.checkpoint.dir names, or else one in the warehouse."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def broken(df: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, rule, detail) for every rule, name: (what breaks it, detail), that a row breaks; one pass."""
    each = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, (bad, detail) in rules.items()]
    found = F.filter(F.array(*each), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(found).alias("_v")).select(key, "_v.*")


def repeated(df: DataFrame, keys: list[str], rule: str, key: str) -> DataFrame:
    """(key, rule, detail) for every combination of keys that occurs more than once; key is one of them."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return n.select(key, F.lit(rule).alias("rule"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys if k != key]).alias("detail"))


def lost(df: DataFrame, refs: DataFrame, on: list[str], rule: str, key: str) -> DataFrame:
    """(key, rule, detail) for rows whose reference isn't in refs."""
    return df.join(refs.select(*on).distinct(), on, "left_anti").select(key, F.lit(rule).alias("rule"), F.concat_ws(":", *[F.col(k).cast("string") for k in on if k != key]).alias("detail"))


def blank(c: Column) -> Column:
    """Null or empty."""
    return c.isNull() | (c == "")
