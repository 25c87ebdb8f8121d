"""Where a value came from: leaves of nested values and tiered as-of joins."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import contains_value, holds_typed

LEAVES = T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("path", "kind", "value")]]))


def _walk(value, path: str) -> Iterator[tuple[str, str, str | None]]:
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from _walk(inner, f"{path}.{key}")
    elif isinstance(value, list):
        for i, inner in enumerate(value):
            yield from _walk(inner, f"{path}[{i}]")
    elif value is None:
        yield path, "null", None
    elif isinstance(value, bool):
        yield path, "boolean", str(value).lower()
    elif isinstance(value, (int, float)):
        whole = isinstance(value, int) or value.is_integer()
        yield path, "number", str(int(value)) if whole else repr(value)
    else:
        yield path, "string", value


@pandas_udf(LEAVES)
def json_leaves(texts: pd.Series) -> pd.Series:
    """All scalar leaves of a JSON text in document order, each with its path and kind. Numbers are
    written so that 1 and 1.0 agree; a malformed text has no leaves."""

    def one(text: str | None) -> list[dict]:
        try:
            found = list(_walk(json.loads(text), "$")) if text is not None else []
        except ValueError:
            found = []
        return [{"ord": i, "path": p, "kind": k, "value": v} for i, (p, k, v) in enumerate(found)]

    return texts.map(one)


def leaves(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """One row per leaf: the columns kept, ord, path, kind, value."""
    return df.select(*keep, F.explode(json_leaves(F.col(text_col))).alias("_l")).select(*keep, "_l.*")


def keys_matching(df: DataFrame, text_col: str, keep: list[str], pattern: str) -> DataFrame:
    """Leaves that lie under a key which matches a pattern."""
    return leaves(df, text_col, keep).where(F.col("path").rlike(pattern))


def _nearest(args: DataFrame, source: DataFrame, kind: str, tier: int, on: Column | None) -> DataFrame:
    s = source.select("run_id", F.col("seq").alias("_seq"), F.col("path").alias("_path"), F.col("value").alias("_value"))
    if on is None:
        hit = args.join(s, (args["run_id"] == s["run_id"]) & (args["value"] == s["_value"]) & (s["_seq"] < args["call_seq"])).drop(s["run_id"])
    else:
        hit = args.join(s, (args["run_id"] == s["run_id"]) & (s["_seq"] < args["call_seq"]) & on).drop(s["run_id"])
    # the newest source of the tier; among equals the first path
    best = hit.groupBy("run_id", "call_seq", "field").agg(F.max_by(F.struct("_seq", "_path"), F.struct("_seq")).alias("_s"))
    return best.select("run_id", "call_seq", "field", F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), F.col("_s._seq").alias("source_seq"), F.col("_s._path").alias("path"))


def tiered(args: DataFrame, exact: list[tuple[str, DataFrame]], contains: list[tuple[str, DataFrame]] | None = None, held: Column | None = None) -> DataFrame:
    """The source of every argument value: the first tier that has one, the newest before the call.

    args: run_id, call_seq, field, value (text; null ones are not applicable); every source: run_id,
    seq, path, value. Exact tiers are equi-joins on run and value; containing tiers join on the run
    with the containment as residual (held, over value and _value; by default as a whole token), and only
    for arguments that the exact tiers left open.
    """
    open_args = args.where(F.col("value").isNotNull())
    found = [_nearest(open_args, s, kind, i, None) for i, (kind, s) in enumerate(exact)]
    done = reduce(DataFrame.unionByName, found)
    keys = ["run_id", "call_seq", "field"]
    if contains:
        rest = open_args.join(done.select(*keys).distinct(), keys, "left_anti")
        held = contains_value(F.col("_value"), F.col("value")) if held is None else held
        done = reduce(DataFrame.unionByName, [_nearest(rest, s, kind, len(exact) + i, held) for i, (kind, s) in enumerate(contains)], done)
    best = done.groupBy(*keys).agg(F.min_by(F.struct("kind", "source_seq", "path"), "tier").alias("_b"))
    out = args.join(best, keys, "left")
    kind = F.when(F.col("value").isNull(), "not_applicable").otherwise(F.coalesce("_b.kind", F.lit("unknown")))
    return out.select(*args.columns, kind.alias("source_kind"), F.col("_b.source_seq").alias("source_seq"), F.col("_b.path").alias("source_path"))


#: Tiers of the recorded mode, the best first: fixed values.
RECORDED = ("tool_result", "customer_utterance", "sop_step", "domain_policy")


def recorded(args: DataFrame, results: DataFrame, messages: DataFrame, steps: DataFrame, policy: DataFrame) -> DataFrame:
    """Provenance as it's recorded at the time of the call: results that failed count too, no spoken forms
    and no tool contracts; texts hold a value under its column's name and type.

    args: run_id, call_seq, field, value, type; results, messages (the customer's) and steps (of opened
    procedures): run_id, seq, path, value; policy: run_id, path, value (before everything else).
    """
    held = holds_typed(F.col("_value"), F.col("value"), F.col("field"), F.coalesce("type", F.lit("")))
    told = policy.select("run_id", F.lit(-1).cast("bigint").alias("seq"), "path", "value")
    return tiered(args, [(RECORDED[0], results)], [(RECORDED[1], messages), (RECORDED[2], steps), (RECORDED[3], told)], held)


def declared_spoken(args: DataFrame, inputs: DataFrame) -> DataFrame:
    """Spoken forms that a scenario declares for an argument's value, among its identity and its other
    inputs: run_id, call_seq, field, spoken. inputs: run_id, grp, value, spoken."""
    named = inputs.where(F.col("grp").isin("identity", "declared") & F.col("spoken").isNotNull())
    return args.join(named.select("run_id", "value", "spoken"), ["run_id", "value"]).select("run_id", "call_seq", "field", "spoken").distinct()
