"""Parts of growing tables go by rows: no task gets more of them as the input grows."""

import pytest
from pyspark.sql import functions as F

from callscope.operators import audio, common, contracts, state, tickets
from callscope.plans import registry

ROWS = 40


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(common, "ROWS_A_PART", ROWS)


def largest(df):
    """Rows of the largest part of a result."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def runs(spark, n=1000):
    return spark.range(n).select(F.col("id").alias("run_id"))


def test_completion_parts(spark, small_parts):
    o = runs(spark)
    base = o.select("run_id", F.lit("update").alias("operation"), F.lit("t").alias("tbl"), F.create_map(F.lit("a"), F.col("run_id").cast("string")).alias("after"))
    wanted = base.withColumn("mutation_id", F.lit("m"))
    out = state.completion(base, wanted, wanted.where("run_id % 10 = 0"), o)
    assert largest(out) <= 2 * ROWS
    assert {(r.outcome, r["count"]) for r in out.groupBy("outcome").count().collect()} == {("complete", 900), ("forbidden_change", 100)}


def test_completion_of_runs_that_repeat_or_have_nothing(spark):
    mutation = "run_id bigint, operation string, tbl string, after map<string,string>"
    changes = spark.createDataFrame([(1, "update", "t", {"a": "1", "b": None}), (1, "update", "t", {"a": "2"})], mutation)
    required = spark.createDataFrame([(1, "update", "t", {"b": None}, "m"), (1, "update", "u", {"a": "1"}, "n"), (None, "update", "t", {"a": "1"}, "m")], mutation + ", mutation_id string")
    forbidden = spark.createDataFrame([(2, "update", "t", {"a": "2"}, "m"), (9, "update", "t", {"a": "2"}, "m")], mutation + ", mutation_id string")
    out = state.completion(changes, required, forbidden, spark.createDataFrame([(1,), (2,), (2,), (None,)], "run_id bigint"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 1, 0, "incomplete"), (2, 0, 0, "complete"), (2, 0, 0, "complete"), (None, 0, 0, "complete")], key=str)


def test_expected_trace_parts(spark, small_parts):
    s = runs(spark).withColumnRenamed("run_id", "scenario_id")
    gold = s.select("scenario_id", F.array(F.struct(F.lit("t").alias("tool"), F.lit("{}").alias("arguments"))).alias("calls"))
    out = contracts.expected_trace(gold, s.select("scenario_id", F.lit(0).alias("idx"), F.when(F.col("scenario_id") < 10, "boom").alias("error")))
    assert largest(out) <= 2 * ROWS
    assert out.where("outcome = 'error'").count() == 10
    assert largest(contracts.single_trigger(s.withColumn("active", F.lit(True)))[0]) <= 2 * ROWS


def test_confirmed_evidence_parts(spark, small_parts):
    claimed = runs(spark).select("run_id", F.lit(0).alias("pos"), F.lit("event").alias("kind"), F.lit("e").alias("ref"))
    out = tickets.confirmed_evidence(claimed, claimed.drop("pos"), claimed.drop("pos"))
    assert largest(out) <= 2 * ROWS and out.count() == 1000


def test_confirmed_evidence_of_references_that_repeat_or_are_null(spark):
    ref = "run_id bigint, kind string, ref string"
    claimed = spark.createDataFrame([(1, 0, "e", "a"), (1, 4, "e", "a"), (1, 7, "e", "lost"), (1, 2, None, "a"), (None, 5, "e", "a")], "run_id bigint, pos int, kind string, ref string")
    valid = spark.createDataFrame([(1, "e", "a"), (1, "e", "a"), (1, None, "a"), (None, "e", "a")], ref)
    mandatory = spark.createDataFrame([(1, "e", "a"), (1, "e", "b"), (1, "e", "b"), (1, None, "a"), (None, "e", "a"), (2, "e", "x")], ref)
    found = sorted(map(tuple, tickets.confirmed_evidence(claimed, valid, mandatory).collect()), key=str)
    assert found == sorted([(1, "e", "a", 0), (1, "e", "a", 4), (1, None, "a", 8), (1, "e", "b", 9), (None, "e", "a", 0), (2, "e", "x", 0)], key=str)


def test_consent_pair_parts(spark, small_parts):
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert registry.queries()["consent_pair_rules"](spark, sf).rdd.getNumPartitions() >= lines // ROWS


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition")


def test_turn_probes_of_events_that_repeat_or_are_null(spark, small_parts):
    probe = "run_id bigint, probe_id string, applicable boolean, expected_control string, observed_control_event_id string, latency_kind string, start_event_id string, end_event_id string"
    p = spark.createDataFrame([(1, "a", True, "go", "x", "stop", "x", "y"), (1, "b", True, "go", None, "stop", "x", "y"), (1, "c", True, "go", "x", "stop", "x", "z"), (1, "c", True, "go", "x", "stop", "x", "z"), (2, "a", True, "go", "x", "stop", "x", "y"), (2, None, False, None, None, None, None, None), (2, None, False, None, None, None, None, None)], probe)
    e = spark.createDataFrame([(1, "x", 0, "go"), (1, "y", 5_000_000, "go"), (1, "y", 90_000_000, "go"), (1, None, 7, "go"), (2, "x", 0, "go"), (2, "y", 1_000_000, "go")], "run_id bigint, event_id string, ns bigint, control string")
    c = spark.createDataFrame([(1, 0), (3, 0)], "run_id bigint, uncertainty_ns bigint")
    out = audio.turn_probes(p, e, c, {"stop_latency_max_ms": 20.0, "clock_uncertainty_max_ms": 4.0})
    none = (2, None, "N/A", "probe_opportunity_not_present")
    want = [(1, "a", "passed", "latency_interval_within_maximum"), (1, "a", "failed", "latency_interval_exceeds_maximum"), *[(1, "b", "contract_invalid", "observed control event missing")] * 2, *[(1, "c", "contract_invalid", "duplicate probe_id")] * 2, (2, "a", "contract_invalid", "clock missing"), none, none]
    assert sorted(map(tuple, out.select("run_id", "probe_id", "status", "reason").collect()), key=str) == sorted(want, key=str)
    assert exchanges(out) == 1


def test_state_by_run_is_shuffled_once(spark, small_parts):
    sf = "/root/testdata/sf0.001"
    # orders join their lines, then initial state and changes are dealt; no cell is shuffled
    assert exchanges(registry.queries()["state_hash"](spark, sf)) <= 4


def test_same_state_of_cells_that_are_null_or_on_one_side(spark):
    cells = lambda rows: spark.createDataFrame(rows, "run_id bigint, tbl string, identity string, column string, value string")
    before = cells([(1, "t", "a", "x", "1"), (1, "t", "a", "y", None), (1, "t", None, "x", "1"), (2, "t", "a", "x", None), (None, "t", "a", "x", "1")])
    after = cells([(1, "t", "a", "x", "2"), (1, "t", "a", "y", None), (1, "t", None, "x", "1"), (3, "t", "a", "x", None)])
    runs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "run_id bigint")
    assert sorted(map(tuple, state.same_state(before, after, runs).collect())) == [(1, 3, False), (2, 1, False), (3, 1, False), (4, 0, True)]
