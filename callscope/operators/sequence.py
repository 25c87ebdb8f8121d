"""Matching of expected call sequences, recovery from errors, and rejected-call streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nth_match(expected: DataFrame, attempts: DataFrame) -> DataFrame:
    """k-th expected (tool, outcome) to the k-th attempt of the same tool and outcome.

    expected: run_id, idx, tool, outcome; attempts: run_id, tool, outcome, call_seq. Unmatched
    expectations stay with a null call_seq.
    """
    keys = ["run_id", "tool", "outcome"]
    e = expected.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("idx")))
    a = attempts.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("call_seq"))).select(*keys, "k", "call_seq")
    return e.join(a, [*keys, "k"], "left")


def ordered_match(expected: DataFrame, attempts: DataFrame) -> DataFrame:
    """Greedy subsequence: each expected call takes the first later attempt of its tool and outcome.

    A fold over the run's sorted attempts; one row per run with the matched seqs in order (as many as
    could be matched) and whether all were.
    """
    want = expected.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "tool", "outcome"))), lambda x: F.struct(x["tool"].alias("tool"), x["outcome"].alias("outcome"))).alias("want"))
    have = attempts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("call_seq", "tool", "outcome"))).alias("have"))
    both = want.join(have, "run_id", "left")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<bigint>").alias("seqs"))

    def step(acc, a):
        following = F.get("want", acc["at"])
        fits = F.coalesce((following["tool"] == a["tool"]) & (following["outcome"] == a["outcome"]), F.lit(False))
        return F.when(fits, F.struct((acc["at"] + 1).alias("at"), F.concat(acc["seqs"], F.array(a["call_seq"].cast("bigint"))).alias("seqs"))).otherwise(acc)

    seqs = F.coalesce(F.aggregate("have", zero, step, lambda acc: acc["seqs"]), F.array().cast("array<bigint>"))
    return both.select("run_id", seqs.alias("seqs"), F.size("want").alias("n_expected")).withColumn("matched", F.size("seqs") == F.col("n_expected"))


def natural_recovery(attempts: DataFrame, expected_tools: DataFrame) -> DataFrame:
    """For every failed attempt: the next attempt of the same tool if the tool is expected, else the
    next attempt of any expected tool; recovered if that one succeeded.

    attempts: run_id, tool, call_seq, outcome; expected_tools: run_id, tool.
    """
    wanted = expected_tools.select("run_id", "tool", F.lit(True).alias("expected")).distinct()
    a = attempts.join(wanted, ["run_id", "tool"], "left").withColumn("expected", F.coalesce("expected", F.lit(False)))
    item = F.struct("call_seq", "outcome")
    later = Window.partitionBy("run_id").orderBy("call_seq").rowsBetween(1, Window.unboundedFollowing)
    same = Window.partitionBy("run_id", "tool").orderBy("call_seq")
    a = a.withColumn("_any", F.first(F.when(F.col("expected"), item), ignorenulls=True).over(later))
    a = a.withColumn("_same", F.lead(item).over(same))
    chosen = F.when(F.col("expected"), F.col("_same")).otherwise(F.col("_any"))
    a = a.where(F.col("outcome") == "error").withColumn("_next", chosen)
    return a.select("run_id", "tool", "call_seq", F.col("_next.call_seq").alias("retry_seq"), F.coalesce(F.col("_next.outcome") == "ok", F.lit(False)).alias("recovered"))


def declared_recovery(attempts: DataFrame, injections: DataFrame) -> DataFrame:
    """An injected error: first errored attempt of the tool, then the first later success of the
    recovery tool, then the first later attempt of the tool, which must succeed.

    injections: run_id, tool, recovery_tool. One row per injection.
    """
    a = attempts.select("run_id", F.col("tool").alias("_tool"), "call_seq", "outcome")

    def after(df: DataFrame, tool, seq, name: str, extra) -> DataFrame:
        first = df.join(a, "run_id", "left").groupBy(*df.columns).agg(F.min(F.when((F.col("_tool") == tool) & (F.col("call_seq") > seq) & extra, F.struct("call_seq", "outcome"))).alias("_x"))
        return first.select(*df.columns, F.col("_x.call_seq").alias(name), F.col("_x.outcome").alias(f"{name}_outcome"))

    df = injections.select("run_id", "tool", "recovery_tool").distinct()
    df = after(df, F.col("tool"), F.lit(-1), "error_seq", F.col("outcome") == "error").drop("error_seq_outcome")
    df = after(df, F.col("recovery_tool"), F.col("error_seq"), "recovery_seq", F.col("outcome") == "ok").drop("recovery_seq_outcome")
    df = after(df, F.col("tool"), F.col("recovery_seq"), "retry_seq", F.lit(True))
    status = F.when(F.col("error_seq").isNull(), "N/A").when(F.coalesce(F.col("retry_seq_outcome") == "ok", F.lit(False)), "pass").otherwise("fail")
    return df.withColumn("status", status).drop("retry_seq_outcome")


def rejected_streaks(calls: DataFrame, most: int = 2) -> DataFrame:
    """Consecutive rejected calls per tool, reset by an accepted one; beyond `most` a hard reject.

    calls: run_id, tool, seq, accepted. Adds streak (0 for accepted calls) and hard_reject.
    """
    w = Window.partitionBy("run_id", "tool").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = calls.withColumn("_island", F.sum(F.col("accepted").cast("int")).over(w))
    inside = Window.partitionBy("run_id", "tool", "_island").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("streak", F.when(F.col("accepted"), 0).otherwise(F.sum((~F.col("accepted")).cast("int")).over(inside)))
    return c.withColumn("hard_reject", F.col("streak") > most).drop("_island")


def dependency_edges(matched: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges between consecutive matched calls: the later call's argument value comes from the earlier
    one's result and from no source before that.

    matched: run_id, idx, call_seq, result_seq, value (the scalar argument), result_value; sources:
    run_id, seq, value (everything else seen so far). passed = the earlier call came first.
    """
    left = matched.select("run_id", (F.col("idx") + 1).alias("idx"), F.col("call_seq").alias("before_seq"), F.col("result_seq").alias("before_result"), F.col("result_value").alias("given"))
    pairs = matched.join(left, ["run_id", "idx"]).where(F.col("value").eqNullSafe(F.col("given")) & F.col("value").isNotNull())
    known = sources.select("run_id", F.col("seq").alias("_seq"), F.col("value").alias("_value"))
    earlier = (pairs["run_id"] == known["run_id"]) & (pairs["value"] == known["_value"]) & (known["_seq"] < pairs["before_result"])
    return pairs.join(known, earlier, "left_anti").select("run_id", "idx", "value", "before_seq", "call_seq", (F.col("before_seq") < F.col("call_seq")).alias("passed"))
