"""Call and result pairing, success predicates and event filters.

Every function takes an events frame with run_id, seq (strictly increasing per run), event_type and
tool, and keeps its other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALL, RESULT = "tool_call", "tool_result"
DOCUMENT_TOOLS = ("search_docs", "open_doc")


def pair_calls(events: DataFrame, call_cols: list[str], result_cols: list[str]) -> DataFrame:
    """First-in first-out pairing within (run_id, tool).

    A result with no outstanding call is an orphan and drops; an unanswered call stays with a null
    result. The running count of outstanding calls, floored at zero, tells orphans apart, so the
    pairing is windows and one join on (run_id, tool, n); all share the same partitioning.
    """
    w = Window.partitionBy("run_id", "tool").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.when(F.col("event_type") == CALL, 1).otherwise(-1)
    e = events.where(F.col("event_type").isin(CALL, RESULT) & F.col("tool").isNotNull())
    e = e.withColumn("_s", F.sum(x).over(upto))
    e = e.withColumn("_m", F.least(F.lit(0), F.min("_s").over(upto)))
    e = e.withColumn("_orphan", (F.col("event_type") == RESULT) & (F.col("_m") < F.lag("_m", 1, 0).over(w)))
    e = e.where(~F.col("_orphan"))
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("run_id", "tool", "event_type").orderBy("seq")))
    calls = e.where(F.col("event_type") == CALL).select("run_id", "tool", "n", F.col("seq").alias("call_seq"), *[F.col(c).alias(f"call_{c}") for c in call_cols])
    results = e.where(F.col("event_type") == RESULT).select("run_id", "tool", "n", F.col("seq").alias("result_seq"), *[F.col(c).alias(f"result_{c}") for c in result_cols])
    return calls.join(results, ["run_id", "tool", "n"], "left")


def outcome(ok: Column, result_seq: Column) -> Column:
    """'ok', 'error' or 'missing_result'."""
    return F.when(result_seq.isNull(), "missing_result").when(F.coalesce(ok, F.lit(False)), "ok").otherwise("error")


def domain_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.where(~F.col("tool").isin(*DOCUMENT_TOOLS))


def call_epoch(events: DataFrame) -> DataFrame:
    """Events of the call itself; a missing epoch means the call."""
    return events.where(F.coalesce("epoch", F.lit("call")) == "call")


def before_ticket(events: DataFrame) -> DataFrame:
    """The other notion of the call's events: everything but the ticket event."""
    return events.where(F.col("event_type") != "post_session_ticket")


def _plain(error: Column) -> Column:
    return error.isNull() | error.isin("", "false")


def success_columns(error: Column, error_type: Column, ok: Column, flags: list[Column], hard_fails: Column) -> dict[str, Column]:
    """Four of the five notions of success that the metrics use (next_result_ok is the fifth); they
    differ on purpose.

    by_metric: no error or error type, and none of the flags is false. by_outcome: ok isn't false, no
    error, no hard fails. by_ticket: the same without hard fails. strictly: ok is true.
    """
    flags_hold = F.lit(True)
    for flag in flags:
        flags_hold = flags_hold & F.coalesce(flag, F.lit(True))
    not_false = F.coalesce(ok, F.lit(True))
    return {
        "by_metric": _plain(error) & _plain(error_type) & flags_hold,
        "by_outcome": not_false & error.isNull() & (F.coalesce(F.size(hard_fails), F.lit(0)) <= 0),
        "by_ticket": not_false & error.isNull(),
        "strictly": F.coalesce(ok, F.lit(False)),
    }


def next_result_ok(events: DataFrame) -> DataFrame:
    """Calls (run_id, seq, tool) with ok: whether the next result of the tool, whichever call it
    answers, says that ok is true."""
    w = Window.partitionBy("run_id", "tool").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    said = F.first(F.when(F.col("event_type") == RESULT, F.struct("ok")), ignorenulls=True).over(w)
    e = events.where(F.col("event_type").isin(CALL, RESULT) & F.col("tool").isNotNull()).withColumn("_next", said)
    return e.where(F.col("event_type") == CALL).select("run_id", "seq", "tool", F.coalesce("_next.ok", F.lit(False)).alias("ok"))
