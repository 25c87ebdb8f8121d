"""Streaming forms give what the batch operators give on the same events."""

import math
import random
import time

from pyspark.sql import functions as F

from callscope.functions import sketch
from callscope.operators import attempts
from callscope.streaming import live


def streamed(spark, df, schema, folder, parts):
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def replayed(spark, slices, make, tmp_path, idle_batches=True):
    """Run the stream after each slice of rows has landed, from its checkpoint on; the queries and all rows."""
    folder, queries = str(tmp_path / "in"), []
    with live.state_store(spark, idle_batches):
        for part in slices:
            part.coalesce(1).write.mode("append").parquet(folder)
            made = make(spark.readStream.schema(part.schema).parquet(folder))
            q = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
            queries.append(q)
    return queries, spark.read.schema(made.schema).parquet(str(tmp_path / "out"))


EVENTS = "run_id bigint, seq bigint, event_type string, tool string, ts timestamp"


def events_of(spark, rows):
    return spark.createDataFrame(rows, "run_id bigint, seq bigint, event_type string, tool string, at bigint").withColumn("ts", F.timestamp_seconds("at")).drop("at")


def brute_pairs(rows, patience):
    out, waiting = [], {}
    for run, seq, kind, tool, at in sorted(rows, key=lambda r: r[1]):
        open_ = waiting.setdefault((run, tool), [])
        if kind == "tool_call":
            open_.append((seq, at))
        else:
            while open_ and open_[0][1] + patience <= at:
                out.append((run, tool, open_.pop(0)[0], None, "missing_result"))
            if open_:
                out.append((run, tool, open_.pop(0)[0], seq, "answered"))
    return sorted([*out, *((run, tool, seq, None, "missing_result") for (run, tool), left in waiting.items() for seq, _ in left)], key=repr)


def test_pairing_with_timers(spark, tmp_path):
    r = random.Random(1)
    rows = [(run, i, "tool_call" if r.random() < 0.6 else "tool_result", r.choice("ab"), 1000 + 10 * i) for i in range(90) for run in range(4) if r.random() < 0.7]
    slices = [[x for x in rows if x[1] // 30 == k] for k in range(3)]
    # a heartbeat moves the watermark, the next one lets what it passed come out
    beats = [[(-1, i, "tool_call", "a", 10**9 + i)] for i in range(2)]
    queries, got = replayed(spark, [events_of(spark, s) for s in [*slices, *beats]], lambda s: live.pair_calls(s, patience="100 seconds", late="1 minute"), tmp_path)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_pairs(rows, 100)
    # only the heartbeats' calls are open in the end
    assert live.state_rows(queries[-1]) < live.state_rows(queries[0])
    late = events_of(spark, [(1, 500, "tool_call", "a", 1000), (1, 501, "tool_call", "a", 1010)])
    (q,), _ = replayed(spark, [late], lambda s: live.pair_calls(s, patience="100 seconds", late="1 minute"), tmp_path)
    assert live.late_rows(q) == 2


def test_pairing_keeps_state_by_shard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "SHARDS", 3, raising=False)
    r = random.Random(2)
    rows = [(run, i, "tool_call" if r.random() < 0.6 else "tool_result", r.choice("abc"), 1000 + 10 * i) for i in range(40) for run in [None, *range(2**60, 2**60 + 12)] if r.random() < 0.5]
    beats = [[(-1, i, "tool_call", "a", 10**9 + i)] for i in range(2)]
    slices = [[x for x in rows if x[1] < 20], [x for x in rows if x[1] >= 20], *beats]
    queries, got = replayed(spark, [events_of(spark, s) for s in slices], lambda s: live.pair_calls(s, patience="100 seconds"), tmp_path)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_pairs(rows, 100)
    # 39 queues, some of them without a run
    assert live.state_rows(queries[0]) <= 2 * 3


def test_pairing_equals_batch(spark, tmp_path):
    rows = [(r, i, "tool_call" if (i * 7 + r) % 3 else "tool_result", "ab"[(i + r) % 2], 1000 + i) for r in range(4) for i in range(40)]
    slices = [[x for x in rows if x[1] < 20], [x for x in rows if x[1] >= 20], *([(-1, i, "tool_call", "a", 10**9 + i)] for i in range(2))]
    _, got = replayed(spark, [events_of(spark, s) for s in slices], lambda s: live.pair_calls(s, patience="1 day"), tmp_path)
    want = attempts.pair_calls(events_of(spark, rows), [], []).select("run_id", "tool", "call_seq", "result_seq")
    assert sorted(map(tuple, got.drop("outcome").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_order_state_is_forgotten(spark, tmp_path):
    """Many runs one after the other: the state holds those that were heard of lately, not all."""
    slices = [spark.createDataFrame([(100 * k + r, i, i if i != 3 else 1) for r in range(20) for i in range(5)], "run_id bigint, pos bigint, seq bigint") for k in range(4)]
    sizes, folder = [], str(tmp_path / "in")
    with live.state_store(spark, idle_batches=False):
        for part in slices:
            part.coalesce(1).write.mode("append").parquet(folder)
            made = live.checked_order(spark.readStream.schema(part.schema).parquet(folder), keep="1 second")
            q = live.split_order(made, str(tmp_path / "out"), str(tmp_path / "state"))
            q.awaitTermination(120)
            sizes.append(live.state_rows(q))
            time.sleep(1.5)
    assert max(sizes) <= 40 and sizes[-1] <= 40
    out = spark.read.schema(live.CHECKED).parquet(str(tmp_path / "out"))
    assert out.where("quarantined").count() == 80 and out.where("NOT quarantined").count() == 320


def test_order_goes_on_from_state(spark, tmp_path):
    slices = [spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "run_id bigint, pos bigint, seq bigint"), spark.createDataFrame([(1, 3, 6), (1, 4, 7), (2, 1, 1)], "run_id bigint, pos bigint, seq bigint")]
    _, got = replayed(spark, slices, live.checked_order, tmp_path, idle_batches=False)
    assert sorted(r.pos for r in got.where("quarantined").collect()) == [3]


def test_latency_windows_drop_late_rows_and_bound_the_error(spark, tmp_path):
    r = random.Random(2)
    rows = [[(60 * i, r.lognormvariate(5, 1.5)) for i in range(k * 200, k * 200 + 200)] for k in range(3)]
    late = [(30, 1e9)]  # hours behind when it comes
    slices = [rows[0], rows[1] + late, rows[2], [(10**7, 1.0)], [(10**7 + 1, 1.0)]]
    frames = [spark.createDataFrame(s, "at bigint, latency_ms double").select(F.timestamp_seconds("at").alias("received_at"), "latency_ms") for s in slices]
    queries, got = replayed(spark, frames, lambda s: live.latency_windows(s, "50 minutes", "1 minute"), tmp_path)
    assert sum(map(live.late_rows, queries)) == 1
    seen = {x.start.timestamp(): x for x in got.select(F.col("start"), "n", *[sketch.quantile(F.col("sketch"), q).alias(f"q{i}") for i, q in enumerate((0, 0.5, 0.95, 1))]).collect()}
    every = [x for s in rows for x in s]
    assert len(seen) == 12
    for start, x in seen.items():
        values = sorted(v for at, v in every if start <= at < start + 3000)
        assert x.n == len(values) == 50
        for i, q in enumerate((0, 0.5, 0.95, 1)):
            want = values[max(math.ceil(q * 50), 1) - 1]
            assert abs(x[f"q{i}"] - want) <= sketch.ALPHA * want * 1.0001


def test_sketches_merge(spark):
    r = random.Random(4)
    rows = [(i % 5, r.gauss(0, 100)) for i in range(2000)] + [(0, 0.0), (1, None), (2, float("nan"))]
    df = spark.createDataFrame(rows, "part int, v double")
    merged = sketch.merge(sketch.build(df, ["part"], F.col("v")), [])
    row = merged.select(sketch.total(F.col("sketch")).alias("n"), *[sketch.quantile(F.col("sketch"), q).alias(f"q{i}") for i, q in enumerate((0.01, 0.5, 0.9))]).first()
    values = sorted(v for _, v in rows if v is not None and not math.isnan(v))
    assert row.n == len(values)
    for i, q in enumerate((0.01, 0.5, 0.9)):
        want = values[math.ceil(q * len(values)) - 1]
        assert abs(row[f"q{i}"] - want) <= sketch.ALPHA * abs(want) * 1.0001


def test_landed_records_are_scored_once(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "run_id long, part int")
    stream = streamed(spark, df, "run_id long", str(tmp_path / "in"), 2)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        live.score_landed(stream, lambda b: b.withColumn("score", F.lit(1.0)), out, mark).awaitTermination(120)
    assert spark.read.parquet(out).count() == 10


def test_latency_join(spark, tmp_path):
    a = spark.sql("SELECT cast(id as bigint) run_id, 0 AS turn, timestamp_seconds(1000 + id * 60) AS received_at, 0 AS part FROM range(5)")
    b = spark.sql("SELECT cast(id as bigint) run_id, 0 AS turn, timestamp_millis((1000 + id * 60) * 1000 + 500 * (id + 1) + CASE WHEN id = 4 THEN 60000 ELSE 0 END) AS played_at, 0 AS part FROM range(5)")
    left = streamed(spark, a, "run_id bigint, turn int, received_at timestamp", str(tmp_path / "a"), 1)
    right = streamed(spark, b, "run_id bigint, turn int, played_at timestamp", str(tmp_path / "b"), 1)
    got = run(spark, live.response_latency(left, right), "latency")
    assert sorted(r.latency_ms for r in got.collect()) == [500.0, 1000.0, 1500.0, 2000.0]
