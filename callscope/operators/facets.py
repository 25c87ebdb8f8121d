"""Facets of tool execution: arguments against expectations, and what the facets add up to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACETS = ("required_success", "argument_value", "argument_provenance", "dependency_order", "error_recovery")


def same_value(a: Column, b: Column, kind: Column) -> Column:
    """Equality under a declared type; without one, numbers equal as numbers and text as text."""
    x, y = a.try_cast("double"), b.try_cast("double")
    number = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.eqNullSafe(b))
    return F.when(kind.isin("integer", "number"), x.eqNullSafe(y)).when(kind == "string", F.trim(a).eqNullSafe(F.trim(b))).otherwise(number)


def argument_match(expected: DataFrame, args: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per expected call, whether a successful attempt of its tool has all expected arguments, and the
    first such attempt. expected: run_id, idx, tool, name, value, type (one row per argument; a call
    without arguments has a null name); args: run_id, call_seq, name, value; attempts: run_id, tool,
    call_seq, outcome. Both sides meet on (run, tool) and then on the argument's name.
    """
    good = attempts.where(F.col("outcome") == "ok").select("run_id", "tool", "call_seq")
    pairs = expected.join(good, ["run_id", "tool"])
    given = args.select("run_id", "call_seq", "name", F.col("value").alias("_given"), F.lit(True).alias("_has"))
    each = pairs.join(given, ["run_id", "call_seq", "name"], "left")
    right = F.col("name").isNull() | (F.coalesce("_has", F.lit(False)) & F.coalesce(same_value(F.col("_given"), F.col("value"), F.col("type")), F.lit(False)))
    full = each.groupBy("run_id", "idx", "call_seq").agg(F.bool_and(right).alias("ok")).where("ok")
    found = full.groupBy("run_id", "idx").agg(F.min("call_seq").alias("call_seq"))
    calls = expected.select("run_id", "idx", "tool").distinct()
    return calls.join(found, ["run_id", "idx"], "left").withColumn("matched", F.col("call_seq").isNotNull())


def align(expected: DataFrame, in_order: DataFrame, nth: DataFrame, exact: DataFrame) -> DataFrame:
    """The attempt that stands for each expected call: the ordered match, else the n-th success, else
    an exact one. All: run_id, idx, call_seq."""
    out = expected.select("run_id", "idx")
    for i, df in enumerate((in_order, nth, exact)):
        out = out.join(df.select("run_id", "idx", F.col("call_seq").alias(f"_{i}")), ["run_id", "idx"], "left")
    return out.select("run_id", "idx", F.coalesce("_0", "_1", "_2").alias("call_seq"))


def combine(facets: list[tuple[str, DataFrame]], runs: DataFrame) -> DataFrame:
    """One row per run and facet: pass if all of its findings hold, fail otherwise, N/A without any.
    Every finding frame: run_id, passed."""
    found = reduce(DataFrame.unionByName, [df.select("run_id", F.lit(name).alias("facet"), "passed") for name, df in facets])
    every = runs.select("run_id", F.explode(F.array(*[F.lit(n) for n, _ in facets])).alias("facet"))
    agg = found.groupBy("run_id", "facet").agg(F.bool_and("passed").alias("ok"))
    status = F.when(F.col("ok").isNull(), "N/A").when(F.col("ok"), "pass").otherwise("fail")
    return every.join(agg, ["run_id", "facet"], "left").select("run_id", "facet", status.alias("status"))


def pass_rate(facets: DataFrame) -> DataFrame:
    """Share of applicable facets that pass; N/A without one."""
    value = F.when(F.col("status") != "N/A", (F.col("status") == "pass").cast("double"))
    out = facets.groupBy("run_id").agg(F.avg(value).alias("score"))
    return out.withColumn("status", F.when(F.col("score").isNull(), "N/A").otherwise("measured"))


def flat_violations(results: DataFrame) -> DataFrame:
    """Violations of all metric rows, one each. results: run_id, metric_id, violations (array)."""
    return results.select("run_id", "metric_id", F.posexplode("violations").alias("pos", "violation"))
