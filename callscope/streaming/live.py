"""Streaming forms of the batch operators: scoring landed records, pairing, order checks, latency."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..functions import sketch


def score_landed(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str):
    """Score each micro-batch with a batch function and write it under its number, so that a batch
    that runs again replaces its own rows. Returns the started query."""

    def one(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PAIR = "run_id bigint, tool string, call_seq bigint, result_seq bigint, outcome string"


#: The open calls of a shard, as columns by seq within run and tool.
OPEN = "runs array<bigint>, tools array<string>, seqs array<bigint>, ats array<bigint>"
#: Shards of the state: a call of Python and one state each, whatever the number of runs and tools. A call holds
#: its shard's rows of a micro-batch and its open calls; checkpoints hold to the number they began with.
SHARDS = 512


def _pairing(patience_ms: int):
    """Queues of open calls per (run_id, tool) of a shard, and a time-out for the oldest call of them all."""

    def pair(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, out = {}, []
        for run, tool, seq, at in zip(*state.get) if state.exists else ():
            waiting.setdefault((run, tool), deque()).append((seq, at))

        def over(k, now: int) -> deque:
            calls = waiting.get(k, ())
            while calls and calls[0][1] + patience_ms <= now:
                out.append((*k, calls.popleft()[0], None, "missing_result"))
            return calls

        # a timed-out shard has no rows
        batch = pd.concat(list(rows)).astype({"seq": "int64", "at": "int64"}).sort_values("seq") if not state.hasTimedOut else None
        if batch is not None:
            # runs of null have shards of their own
            runs = [None] * len(batch) if key[0] else batch["run_id"].tolist()
            for run, tool, seq, kind, at in zip(runs, *(batch[c].tolist() for c in ("tool", "seq", "event_type", "at")), strict=True):
                if kind == "tool_call":
                    waiting.setdefault((run, tool), deque()).append((seq, at))
                # a call whose time is over isn't answered any more, whenever its time-out comes
                elif calls := over((run, tool), at):
                    out.append((run, tool, calls.popleft()[0], seq, "answered"))
        # all that the watermark has passed: a time-out set there would come with the next micro-batch only
        for k in waiting:
            over(k, state.getCurrentWatermarkMs())
        left = [(*k, *call) for k, calls in waiting.items() for call in calls]
        if left:
            state.update(tuple(map(list, zip(*left, strict=True))))
            # it comes when the watermark is beyond it
            state.setTimeoutTimestamp(max(1, min(calls[0][1] for calls in waiting.values() if calls) + patience_ms - 1))
        elif state.exists:
            state.remove()
        made = pd.DataFrame(out, columns=["run_id", "tool", "call_seq", "result_seq", "outcome"])
        yield made.astype({"run_id": "Int64", "call_seq": "Int64", "result_seq": "Int64"})

    return pair


def pair_calls(events: DataFrame, patience: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """First-in first-out pairing of calls and results as they arrive.

    events: run_id, tool, seq, event_type, ts (timestamp). State is the queues of open calls per (run_id,
    tool), in SHARDS shards by hash: a micro-batch calls Python once a shard, not once a queue. Rows of a
    micro-batch are taken by seq. A call is over when patience has passed since it, by the event time of a
    result or by the watermark, whichever comes first: its shard's time-out emits missing_result and its
    state goes. Results without a call drop; rows behind the watermark drop and are counted (late_rows).
    """
    kept = events.where(F.col("event_type").isin("tool_call", "tool_result") & F.col("tool").isNotNull())
    shard = F.pmod(F.xxhash64("run_id", "tool"), F.lit(SHARDS)).alias("_shard")
    kept = kept.select(F.col("run_id").isNull().alias("_none"), shard, "run_id", "tool", "seq", "event_type", F.unix_millis("ts").alias("at"), "ts").withWatermark("ts", late)
    ms = kept.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + interval {patience}) AS ms").first()["ms"]
    return kept.groupBy("_none", "_shard").applyInPandasWithState(_pairing(ms), PAIR, OPEN, "append", "EventTimeTimeout")


CHECKED = "run_id bigint, pos bigint, seq bigint, quarantined boolean"


class Order(StatefulProcessor):
    """Largest seq of a run, forgotten when the run has been silent for a while."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("pos")
        last = self.last.get()[0] if self.last.exists() else -(2**62)
        before = batch["seq"].cummax().shift(fill_value=last).clip(lower=last)
        self.last.update((max(last, int(batch["seq"].max())),))
        yield batch.assign(run_id=key[0], quarantined=batch["seq"] <= before)[["run_id", "pos", "seq", "quarantined"]]

    def close(self) -> None:
        pass


def checked_order(events: DataFrame, keep: str = "1 day") -> DataFrame:
    """events (run_id, pos, seq) with quarantined: whether seq doesn't exceed the largest before it in its
    run. A run's state goes when nothing has come for it for the time to keep (by the clock). Needs
    state_store(spark, idle_batches=False)."""
    ms = events.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + interval {keep}) AS ms").first()["ms"]
    return events.groupBy("run_id").transformWithStateInPandas(Order(ms), CHECKED, "append", "processingTime")


def split_order(checked: DataFrame, path: str, checkpoint: str):
    """Write what passed the order check and the quarantine beside each other, as partitions of one table by
    quarantined. Returns the started query."""
    return checked.writeStream.format("parquet").partitionBy("quarantined").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


@contextmanager
def state_store(spark: SparkSession, idle_batches: bool = True) -> Iterator[None]:
    """Run with the state store that timers and times to live need; the settings are put back after.

    idle_batches: whether a micro-batch without rows runs when time has gone on. A state with a time to live
    by the clock would always ask for one more, so a stream that runs to the end of its input needs False.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower(),
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators dropped as behind the watermark, over the progress it keeps."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def state_rows(query: StreamingQuery) -> int:
    """Rows of state after the last micro-batch."""
    return sum(op.numRowsTotal for op in query.lastProgress.stateOperators) if query.lastProgress else 0


def response_latency(received: DataFrame, played: DataFrame, late: str = "1 minute", within: str = "30 seconds") -> DataFrame:
    """Customer receipts joined with the playback of their response by a stream-stream interval join.

    received: run_id, turn, received_at; played: run_id, turn, played_at (timestamps).
    """
    r = received.withWatermark("received_at", late)
    p = played.withColumnsRenamed({"run_id": "_run", "turn": "_turn"}).withWatermark("played_at", late)
    near = (F.col("run_id") == F.col("_run")) & (F.col("turn") == F.col("_turn")) & (F.col("played_at") >= F.col("received_at")) & (F.col("played_at") <= F.col("received_at") + F.expr(f"interval {within}"))
    joined = r.join(p, near)
    return joined.select("run_id", "turn", "received_at", "played_at", ((F.unix_micros("played_at") - F.unix_micros("received_at")) / 1000.0).alias("latency_ms"))


def latency_windows(latencies: DataFrame, width: str = "5 minutes", late: str = "1 minute", alpha: float = sketch.ALPHA) -> DataFrame:
    """start, n and sketch of latency_ms per window of received_at: rows of a window come out once the
    watermark has passed it, later ones drop. The sketch holds its quantiles with a relative error of at
    most alpha and merges with those of other windows (functions.sketch)."""
    cells = latencies.withWatermark("received_at", late).groupBy(F.window("received_at", width).alias("w"), sketch.bucket(F.col("latency_ms"), alpha).alias("b")).agg(F.count("*").alias("n"))
    # a bounded number of cells a window
    whole = cells.groupBy(F.window(F.window_time("w"), width).alias("w")).agg(F.collect_list(F.struct("b", "n")).alias("cells"))
    return whole.select(F.col("w.start").alias("start"), sketch.total(F.col("cells")).alias("n"), F.array_sort("cells").alias("sketch"))
