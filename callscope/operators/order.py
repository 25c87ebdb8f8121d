"""Order constraints, obligations and alignment of ideal events with runtime events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import own_words_in
from .common import dim, each


def prerequisites(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Every risky action after its trigger needs each prerequisite call at or before it.

    calls: run_id, seq, tool, trigger (text or null); edges: edge_id, trigger, action_tool,
    required_tools. The earliest action after the first trigger binds, so the test is a comparison of
    minima; prerequisites before the trigger count, and the action may be its own.
    """
    kept = edges.select("edge_id", "trigger", "action_tool", F.array_distinct("required_tools").alias("_need"))
    few = dim(kept)
    first = calls.where(F.col("trigger").isNotNull()).groupBy("run_id", "trigger").agg(F.min("seq").alias("trigger_seq"))
    fired = first.join(few.select("edge_id", "trigger", F.col("action_tool").alias("tool")), "trigger").select("run_id", "edge_id", "trigger_seq", "tool")
    after = calls.where(F.col("tool").isNotNull()).select("run_id", "tool", "seq").join(fired, ["run_id", "tool"]).where(F.col("seq") > F.col("trigger_seq"))
    action = after.groupBy("run_id", "edge_id").agg(F.min("seq").alias("action_seq"))
    every = each(calls.select("run_id").distinct(), kept.select("edge_id", "_need"))
    acted = every.join(fired.select("run_id", "edge_id", "trigger_seq"), ["run_id", "edge_id"], "left").join(action, ["run_id", "edge_id"], "left")
    have = calls.where(F.col("tool").isNotNull()).groupBy("run_id", "tool").agg(F.min("seq").alias("pre_seq"))
    need = acted.where(F.col("action_seq").isNotNull()).select("run_id", "edge_id", "action_seq", F.explode("_need").alias("tool"))
    unmet = need.join(have, ["run_id", "tool"], "left").where(~F.coalesce(F.col("pre_seq") <= F.col("action_seq"), F.lit(False))).select("run_id", "edge_id", F.lit(False).alias("_met")).distinct()
    met = acted.drop("_need").join(unmet, ["run_id", "edge_id"], "left").withColumn("_met", F.col("_met").isNull())
    status = F.when(F.col("trigger_seq").isNull() | F.col("action_seq").isNull(), "N/A").when(F.col("_met"), "pass").otherwise("fail")
    return met.withColumn("status", status).drop("_met")


def obligations(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """Required events exist and meet the deadline; consent comes before the protected action.

    events: run_id, seq, refs (array of its references and aliases); contracts: run_id,
    obligation_id, required_refs, deadline_ref, consent_ref, action_ref. A declared deadline that
    resolves to nothing fails, and so does a protected action that doesn't.
    """
    where = events.select("run_id", "seq", F.explode("refs").alias("ref"))
    place = where.groupBy("run_id", "ref").agg(F.min("seq").alias("seq"))

    def at(df: DataFrame, ref: str, name: str) -> DataFrame:
        return df.join(place.select("run_id", F.col("ref").alias(ref), F.col("seq").alias(name)), ["run_id", ref], "left")

    c = contracts
    for ref in ("deadline", "consent", "action"):
        c = at(c, f"{ref}_ref", f"{ref}_seq")
    need = c.select("run_id", "obligation_id", "deadline_seq", F.explode_outer("required_refs").alias("ref")).join(place, ["run_id", "ref"], "left")
    need = need.groupBy("run_id", "obligation_id").agg(
        F.bool_and(F.col("ref").isNull() | F.col("seq").isNotNull()).alias("required_present"),
        F.bool_and(F.col("ref").isNull() | F.coalesce(F.col("seq") < F.col("deadline_seq"), F.lit(False))).alias("_in_time"),
    )
    c = c.join(need, ["run_id", "obligation_id"])
    c = c.withColumn("deadline_met", F.when(F.col("deadline_ref").isNull(), F.lit(True)).otherwise(F.col("_in_time") & F.col("deadline_seq").isNotNull()))
    c = c.withColumn("consent_met", F.when(F.col("action_ref").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("consent_seq") < F.col("action_seq"), F.lit(False))))
    status = F.when(F.col("required_present") & F.col("deadline_met") & F.col("consent_met"), "pass").otherwise("fail")
    return c.select("run_id", "obligation_id", "required_present", "deadline_met", "consent_met", status.alias("status"))


def anchors(ideal: DataFrame, runtime: DataFrame) -> DataFrame:
    """Anchor ideal tool calls to runtime calls, the last to the last and so backwards; a tool that
    the runtime called less often than the ideal is left out.

    ideal: run_id, idx, tool; runtime: run_id, seq, tool.
    """
    keys = ["run_id", "tool"]
    back = lambda df, col: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(col)))).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    i, r = back(ideal, "idx"), back(runtime, "seq").withColumnRenamed("n", "m")
    return i.join(r, [*keys, "k"]).where(F.col("m") >= F.col("n")).select("run_id", "tool", "idx", "seq")


def align_messages(ideal: DataFrame, runtime: DataFrame, anchored: DataFrame) -> DataFrame:
    """k-th ideal message to the k-th runtime message of the same actor between the same anchors.

    ideal: run_id, idx, actor; runtime: run_id, seq, actor; anchored: run_id, idx, seq. The interval
    of a message is the number of anchors before it, so the range join is an equi-join on that count.
    Anchors that run backwards (a later idx at an earlier seq) are ignored.
    """
    upto = Window.partitionBy("run_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    a = anchored.withColumn("_last", F.max("seq").over(upto)).where(F.col("_last").isNull() | (F.col("seq") > F.col("_last"))).select("run_id", "idx", "seq")

    def numbered(df: DataFrame, col: str) -> DataFrame:
        marks = a.select("run_id", F.col(col), F.lit(None).cast("string").alias("actor"), F.lit(1).alias("mark"))
        both = df.select("run_id", col, "actor", F.lit(0).alias("mark")).unionByName(marks)
        w = Window.partitionBy("run_id").orderBy(col, "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        gap = both.withColumn("gap", F.sum("mark").over(w)).where("mark = 0").drop("mark")
        return gap.withColumn("k", F.row_number().over(Window.partitionBy("run_id", "actor", "gap").orderBy(col)))

    return numbered(ideal, "idx").join(numbered(runtime, "seq"), ["run_id", "actor", "gap", "k"]).select("run_id", "actor", "idx", "seq")


def first_success_else_first(calls: DataFrame) -> DataFrame:
    """Per (run_id, tool): the first successful call, or the first one if none succeeded."""
    return calls.groupBy("run_id", "tool").agg(F.min_by("seq", F.struct((~F.coalesce("ok", F.lit(False))).cast("int").alias("bad"), F.col("seq"))).alias("seq"))


def last_before(events: DataFrame, marks: DataFrame) -> DataFrame:
    """The last event of each run before the run's mark (run_id, mark_seq)."""
    return events.join(marks, "run_id").where(F.col("seq") < F.col("mark_seq")).groupBy("run_id").agg(F.max("seq").alias("seq"))


def unique_contains(messages: DataFrame, values: DataFrame) -> DataFrame:
    """The only message of a run that contains a declared value; none where several do.

    messages: run_id, seq, content; values: run_id, alias, value.
    """
    # a run declares few values; its messages read them all at once
    own = values.groupBy("run_id").agg(F.array_sort(F.collect_set("value")).alias("_words"))
    held = own_words_in(messages.select("run_id", "seq", "content").join(own, "run_id"), "content", "_words", "value")
    hit = held.select("run_id", "seq", "value").join(values, ["run_id", "value"])
    return hit.groupBy("run_id", "alias").agg(F.count("*").alias("n"), F.min("seq").alias("seq")).where("n = 1").drop("n")
