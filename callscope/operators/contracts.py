"""Scenario packages as tables: gold traces, dialogue, derived contracts and dimension rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, dim, matched


def successful_changes(results: DataFrame) -> DataFrame:
    """Changes of successful calls as a change log.

    results: run_id, seq, ok, changes (array<struct<operation,tbl,identity,after>>).
    """
    return results.where(F.coalesce("ok", F.lit(True))).select("run_id", "seq", F.explode("changes").alias("c")).select("run_id", "seq", "c.*")


def expected_trace(gold_calls: DataFrame, executed: DataFrame) -> DataFrame:
    """Gold calls in order with the outcome each should have: an error where the executed gold trace
    had one at that place. gold_calls: scenario_id, calls (array<struct<tool,arguments>>); executed:
    scenario_id, idx, error."""
    g = gold_calls.select("scenario_id", F.posexplode("calls").alias("idx", "c")).select("scenario_id", "idx", "c.*")
    e = executed.select("scenario_id", "idx", "error")
    return matched(g, e, ["scenario_id", "idx"], "left").withColumn("outcome", F.when(F.col("error").isNotNull(), "error").otherwise("ok")).drop("error")


def ideal_conversation(gold_turns: DataFrame) -> DataFrame:
    """Utterances and tool calls of the gold dialogue, numbered anew without tool results; turn is the
    place in the dialogue, idx the place in the ideal conversation.

    gold_turns: scenario_id, turns (array<struct<kind,actor,text,tool>>).
    """
    t = gold_turns.select("scenario_id", F.posexplode("turns").alias("turn", "t")).select("scenario_id", "turn", "t.*")
    kept = t.where(F.col("kind").isin("utterance", "tool_call"))
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy("scenario_id").orderBy("turn")) - 1)


def disclosure_deadline(ideal: DataFrame, disclosures: DataFrame) -> DataFrame:
    """The deadline of each required disclosure: the first tool call after the turn that makes it.

    ideal: as above; disclosures: scenario_id, disclosure_id, turn.
    """
    calls = ideal.where(F.col("kind") == "tool_call").select("scenario_id", F.col("turn").alias("_turn"), F.col("idx").alias("_idx"), F.col("tool").alias("_tool"))
    later = disclosures.join(calls, "scenario_id", "left").where(F.col("_turn").isNull() | (F.col("_turn") > F.col("turn")))
    first = later.groupBy("scenario_id", "disclosure_id").agg(F.min_by(F.struct("_idx", "_tool"), "_turn").alias("d"))
    return disclosures.join(first, ["scenario_id", "disclosure_id"], "left").select("scenario_id", "disclosure_id", F.col("d._idx").alias("deadline_idx"), F.col("d._tool").alias("deadline_tool"))


def single_trigger(triggers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenarios with exactly one active trigger, and the others with their count."""
    active = dealt(triggers.where("active"), "scenario_id")
    n = active.groupBy("scenario_id").agg(F.count("*").alias("n"))
    # a null scenario is none
    one = active.withColumn("_n", F.count("*").over(Window.partitionBy("scenario_id"))).where("_n = 1 AND scenario_id IS NOT NULL").drop("_n")
    return one, n.where("n != 1")


def argument_contracts(filters: DataFrame, sets: DataFrame, columns: DataFrame, tool_args: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The column and type that each tool argument feeds, through filters and mutations, and arguments
    that feed columns of different types. filters and sets: tool, name, tbl, column; columns: tbl,
    column, type; tool_args: tool, name, type. An argument that feeds none keeps its own name and type."""
    fed = filters.select("tool", "name", "tbl", "column").unionByName(sets.select("tool", "name", "tbl", "column")).distinct().join(columns, ["tbl", "column"])
    kinds = fed.groupBy("tool", "name").agg(F.count_distinct("type").alias("n"), F.min("column").alias("column"), F.min("type").alias("_type"))
    clash = kinds.where("n > 1").select("tool", "name")
    out = tool_args.join(kinds.where("n = 1"), ["tool", "name"], "left").select("tool", "name", F.coalesce("column", "name").alias("column"), F.coalesce("_type", "type").alias("type"))
    return out.join(clash, ["tool", "name"], "left_anti"), clash


def measurement_contract(scenarios: DataFrame, metrics: DataFrame, mode: str) -> DataFrame:
    """Every metric of every scenario with an id that follows from both."""
    every = scenarios.select("scenario_id").join(dim(metrics.select("metric_id")))
    name = F.concat_ws("|", F.lit(mode), "scenario_id", "metric_id")
    return every.select("scenario_id", "metric_id", F.concat(F.lit("mi-"), F.substring(F.sha2(name, 256), 1, 16)).alias("instance_id"))


def persons(inputs: DataFrame) -> DataFrame:
    """Surface forms of the people a scenario names. inputs: scenario_id, people
    (array<struct<person_id,relation,names array<string>>>)."""
    p = inputs.select("scenario_id", F.explode("people").alias("p")).select("scenario_id", "p.person_id", "p.relation", F.explode("p.names").alias("surface"))
    return p.where(F.trim("surface") != "").distinct()


def referenced(refs: DataFrame) -> DataFrame:
    """Indices of ideal events that contracts refer to as conversation[NNNN]. refs: scenario_id, refs."""
    r = refs.select("scenario_id", F.explode("refs").alias("ref"))
    return r.select("scenario_id", "ref", F.regexp_extract("ref", r"^conversation\[(\d+)\]$", 1).try_cast("int").alias("idx")).where("idx IS NOT NULL").distinct()


def owners(attached: DataFrame) -> DataFrame:
    """One event per alias: the one attached with the best priority, then the earliest.
    attached: run_id, alias, seq, priority."""
    return attached.groupBy("run_id", "alias").agg(F.min_by("seq", F.struct("priority", "seq")).alias("seq"))


def first_wins(questions: DataFrame, most: int, by: str = "kind") -> DataFrame:
    """At most `most` questions per run and kind, by priority and id. questions: run_id, kind,
    priority, question_id."""
    w = Window.partitionBy("run_id", by).orderBy("priority", "question_id")
    return questions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def utterances(events: DataFrame) -> DataFrame:
    """Operator messages of the call with their text and the transcripts that aren't blank.
    events: run_id, seq, event_type, actor, content, transcripts (array)."""
    e = events.where((F.col("event_type") == "message") & (F.col("actor") == "operator"))
    return e.select("run_id", "seq", "content", F.filter("transcripts", lambda t: F.trim(t) != "").alias("transcripts"))


def evidence(turns: DataFrame) -> DataFrame:
    """Evidence rows labelled conversation[NNNN] by place, with their kind. turns: run_id, seq, actor."""
    pos = F.row_number().over(Window.partitionBy("run_id").orderBy("seq")) - 1
    kind = F.when(F.col("actor") == "tool", "tool").when(F.col("actor") == "operator", "operator_utterance").otherwise("conversation")
    return turns.withColumn("_pos", pos).select("*", F.format_string("conversation[%04d]", F.col("_pos")).alias("ref"), kind.alias("kind")).drop("_pos")


def joinable_plan(plan: DataFrame, segments: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audio plan entries whose segments and events exist, and the metrics that lost all of theirs.
    plan: run_id, metric_id, segment_id, event_id."""
    kept = plan.join(segments.select("run_id", "segment_id").distinct(), ["run_id", "segment_id"], "left_semi").join(events.select("run_id", "event_id").distinct(), ["run_id", "event_id"], "left_semi")
    gaps = plan.select("run_id", "metric_id").distinct().join(kept.select("run_id", "metric_id").distinct(), ["run_id", "metric_id"], "left_anti")
    return kept, gaps.withColumn("reason", F.lit("no joinable evidence"))


def clock_receipt(events: DataFrame) -> DataFrame:
    """Per run: one clock and its span, or the reason why times can't be compared.
    events: run_id, clock_id, monotonic_ns."""
    c = events.groupBy("run_id").agg(F.count_distinct("clock_id").alias("clocks"), F.max(F.col("clock_id").isNull()).alias("unnamed"), F.min("monotonic_ns").alias("first_ns"), F.max("monotonic_ns").alias("last_ns"))
    reason = F.when(F.col("unnamed"), "clock missing").when(F.col("clocks") != 1, "several clocks")
    return c.select("run_id", "first_ns", "last_ns", reason.alias("reason"))
