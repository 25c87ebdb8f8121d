"""Closed judgements in batch: questions, requests, cache, validation and scores.

The model call is a function of the user; everything around it is data work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dim


def questions(runs: DataFrame, templates: DataFrame) -> DataFrame:
    """Every template that applies to a run, with its text filled in.

    runs: run_id, variant_id, topic; templates: template_id, metric_id, text (with %s for the topic),
    hard_only. Templates are few and broadcast.
    """
    q = runs.join(dim(templates), ~F.col("hard_only") | (F.col("variant_id") == "hard"))
    name = F.concat_ws(":", F.col("run_id").cast("string"), "template_id")
    return q.select("run_id", name.alias("question_id"), "metric_id", F.replace("text", F.lit("%s"), "topic").alias("question"))


#: Evidence rows that are packed together at most.
PART_ROWS = 512


def requests(tasks: DataFrame, evidence: DataFrame, max_bytes: int = 2_000_000) -> DataFrame:
    """Requests of every run: its questions and evidence as sorted JSON, the hash of it, and whether it
    fits. Nothing is cut: evidence beyond max_bytes goes into further parts, each with all questions.
    A text of more than half the room is a part of its own; one that is longer than the room doesn't fit.

    tasks: run_id, question_id, question; evidence: run_id, seq, ref, text. Evidence is dealt by blocks
    of PART_ROWS places, so no task holds a long run as a whole.
    """
    q = tasks.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("question_id", "question"))).alias("questions"))
    asked = F.octet_length(F.to_json("questions"))
    e = evidence.withColumn("_block", F.floor(F.col("seq") / PART_ROWS)).withColumn("_size", F.octet_length(F.to_json(F.struct("ref", "text"))) + 1)
    e = e.join(q.select("run_id", (F.lit(max_bytes) - asked - 64).alias("_room")), "run_id")
    half = F.greatest(F.floor(F.col("_room") / 2), F.lit(1))
    order = Window.partitionBy("run_id", "_block").orderBy("seq", "ref", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # texts of half the room at most are dealt by their running sum, so a part holds at most the room
    e = e.withColumn("_small", F.when(F.col("_size") <= half, F.col("_size")).otherwise(0)).withColumn("_own", F.when(F.col("_size") > half, F.row_number().over(order)).otherwise(0))
    e = e.withColumn("_part", F.floor((F.sum("_small").over(upto) - F.col("_small")) / half))
    packed = e.groupBy("run_id", "_block", "_part", "_own").agg(F.array_sort(F.collect_list(F.struct("ref", "text"))).alias("evidence"))
    both = q.join(packed, "run_id", "left")
    body = F.to_json(F.struct("evidence", "questions"))
    part = F.concat_ws(".", F.coalesce("_block", F.lit(0)).cast("string"), F.coalesce("_part", F.lit(0)).cast("string"), F.when(F.col("_own") > 0, F.col("_own").cast("string")))
    return both.select("run_id", part.alias("part"), body.alias("request"), F.sha2(body, 256).alias("request_hash"), (F.octet_length(body) <= max_bytes).alias("fits"), F.coalesce(F.size("evidence") > 0, F.lit(False)).alias("has_evidence"))


def against_cache(requests_: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answered requests, open ones (once per hash), and hashes with more than one response.

    cache: request_hash, raw_hash, parsed.
    """
    clash = cache.groupBy("request_hash").agg(F.count_distinct("raw_hash").alias("n")).where("n > 1")
    hits = requests_.join(cache.dropDuplicates(["request_hash"]), "request_hash")
    misses = requests_.join(cache, "request_hash", "left_anti").dropDuplicates(["request_hash"])
    return hits, misses, clash


def ask(open_requests: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """Call the user's function on each open request; returns request_hash, raw, raw_hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"request_hash": pdf["request_hash"], "raw": [answer(r) for r in pdf["request"]]})

    out = open_requests.select("request_hash", "request").mapInPandas(run, "request_hash string, raw string")
    return out.withColumn("raw_hash", F.sha2("raw", 256))


REPLY = "struct<judgements:array<struct<question_id:string,answer:string,evidence:array<struct<ref:string,description:string>>>>>"


def judgements(replies: DataFrame, requests_: DataFrame) -> DataFrame:
    """Replies parsed to one row per question and part: run_id, part, question_id, answer, refs."""
    parsed = replies.join(requests_.select("run_id", "part", "request_hash"), "request_hash").select("run_id", "part", F.explode(F.from_json("raw", REPLY)["judgements"]).alias("j"))
    return parsed.select("run_id", "part", "j.question_id", "j.answer", F.transform("j.evidence", lambda e: e["ref"]).alias("refs"))


def over_parts(given: DataFrame, requests_: DataFrame, tasks: DataFrame) -> DataFrame:
    """One answer per task: yes if a part of the run's evidence says yes; without any evidence no; a run
    with a part that didn't fit has status too_long and keeps the answer of the others."""
    per = given.groupBy("run_id", "question_id").agg(F.when(F.max((F.col("answer") == "yes").cast("int")) == 1, "yes").otherwise("no").alias("answer"), F.array_distinct(F.flatten(F.collect_list("refs"))).alias("refs"))
    fits = requests_.groupBy("run_id").agg(F.bool_and("fits").alias("_fits"), F.max("has_evidence").alias("_seen"))
    out = tasks.join(per, ["run_id", "question_id"], "left").join(fits, "run_id", "left")
    status = F.when(~F.col("_fits"), "too_long").when(~F.col("_seen"), "no_evidence").when(F.col("answer").isNull(), "unanswered").otherwise("answered")
    answer = F.when(~F.coalesce("_seen", F.lit(True)), "no").otherwise(F.col("answer"))
    return out.select("run_id", "question_id", answer.alias("answer"), F.col("refs"), status.alias("status"))


def validate(given: DataFrame, tasks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per task: valid if answered exactly once with yes or no, and every reference exists and comes
    before the task's bound. tasks: run_id, question_id, bound_seq; evidence: run_id, ref, seq."""
    once = given.groupBy("run_id", "question_id").agg(F.count("*").alias("n"), F.first("answer").alias("answer"), F.flatten(F.collect_list("refs")).alias("refs"))
    t = tasks.join(once, ["run_id", "question_id"], "left")
    refs = t.select("run_id", "question_id", "bound_seq", F.explode("refs").alias("ref")).join(evidence, ["run_id", "ref"], "left")
    bad = refs.groupBy("run_id", "question_id").agg(F.max((F.col("seq").isNull() | (F.col("seq") > F.coalesce("bound_seq", F.col("seq")))).cast("int")).alias("bad"))
    t = t.join(bad, ["run_id", "question_id"], "left")
    ok = (F.coalesce("n", F.lit(0)) == 1) & F.coalesce(F.col("answer").isin("yes", "no"), F.lit(False)) & (F.coalesce("bad", F.lit(0)) == 0)
    return t.withColumn("valid", ok).drop("n", "bad", "refs")


def score(valid: DataFrame) -> DataFrame:
    """Rate of valid and expected answers per run and metric; pass at exactly one."""
    right = F.coalesce(F.col("valid") & (F.col("answer") == F.col("expected")), F.lit(False))
    out = valid.groupBy("run_id", "metric_id").agg(F.avg(right.cast("double")).alias("rate"), F.count("*").alias("n"))
    return out.withColumn("status", F.when(F.col("rate") == 1.0, "pass").otherwise("fail"))


def consent_pairs(declarations: DataFrame, utterances: DataFrame) -> DataFrame:
    """Agreement declarations with the customer's utterances before their deadline, per run.

    declarations: run_id, declaration_id, deadline_seq; utterances: run_id, seq, text.
    """
    return declarations.join(utterances, "run_id").where(F.col("seq") < F.col("deadline_seq")).select("run_id", "declaration_id", "seq", "text")


def any_yes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("run_id", "declaration_id").agg(F.max(F.coalesce(F.col("answer") == "yes", F.lit(False))).alias("consented"))


def fired_mean(valid: DataFrame) -> DataFrame:
    """M16: share of right answers among the criteria that were asked, always a measured value.
    valid: run_id, criterion, valid, answer, expected."""
    right = F.coalesce(F.col("valid") & (F.col("answer") == F.col("expected")), F.lit(False))
    return valid.groupBy("run_id").agg(F.avg(right.cast("double")).alias("score"), F.count("*").alias("fired")).withColumn("status", F.lit("measured"))
