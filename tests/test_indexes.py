"""Automata, pruned ranking, receipts and turn probes against plain versions."""

import difflib
import hashlib
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from callscope.functions.patterns import words_in
from callscope.operators import audio, order, receipts, retrieval, text_rules
from callscope.sources import records


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_in_texts(spark, monkeypatch):
    r = random.Random(1)
    words = ["".join(r.choice("ab様") for _ in range(r.randint(1, 4))) for _ in range(40)] + ["", None]
    texts = [(i, "".join(r.choice("ab様c") for _ in range(30))) for i in range(50)] + [(99, None), (98, "")]
    frame, given = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(w,) for w in words], "w string")
    want = sorted((i, w) for i, t in texts for w in set(words) if t and w and w in t)
    for most in (200_000, 7):
        monkeypatch.setattr("callscope.functions.patterns.MOST_WORDS", most)
        got = words_in(frame, "t", given, "word")
        assert sorted(map(tuple, got.select("id", "word").collect())) == want
        assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_rules_and_names_meet_no_nested_loop(spark):
    turns = spark.createDataFrame([(1, "ご覧になられる田中様"), (2, "拝見させていただく"), (3, "a.b")], "id long, t string")
    rules = spark.createDataFrame([("r1", "になられる"), ("r2", "させて(いただ|頂)く"), ("r3", r"a\.b"), ("r4", "になられる"), ("r5", None)], "rule_id string, pattern string")
    got = text_rules.closed_misuse(turns, rules, "t", ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "r1"), (1, "r4"), (2, "r2"), (3, "r3")]
    people = spark.createDataFrame([("田中", "self")], "surface string, relation string")
    named = text_rules.in_group_suffix(turns, people, "t", ["id"])
    messages = spark.createDataFrame([(1, 1, "say x1y"), (1, 2, "x1y again"), (1, 3, "z"), (2, 1, "z")], "run_id long, seq long, content string")
    values = spark.createDataFrame([(1, "a", "x1y"), (1, "b", "z"), (2, "c", "z"), (2, "d", "z"), (2, "e", None)], "run_id long, alias string, value string")
    one = order.unique_contains(messages, values)
    assert sorted(map(tuple, one.select("run_id", "alias", "seq").collect())) == [(1, "b", 3), (2, "c", 1), (2, "d", 1)]
    edges = spark.createDataFrame([("e", "t", "act", ["pre"])], "edge_id string, trigger string, action_tool string, required_tools array<string>")
    calls = spark.createDataFrame([(1, 1, "pre", None), (1, 2, None, "t"), (1, 3, "act", None), (2, 1, "act", None)], "run_id long, seq long, tool string, trigger string")
    checked = order.prerequisites(calls, edges)
    assert sorted(map(tuple, checked.select("run_id", "status").collect())) == [(1, "pass"), (2, "N/A")]
    for df in (got, named, one, checked):
        assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)


def brute_rank(queries, texts, k, ratio):
    plain = lambda s: "".join(c.lower() for c in s if c.isalnum())
    out = []
    for qid, q in queries:
        q = plain(q)
        grams = {q[i : i + 2] for i in range(len(q) - 1)}
        rows = []
        for tid, t in texts:
            t = plain(t)
            n = sum(g in t for g in grams)
            if n:
                rows.append((-(n + (difflib.SequenceMatcher(None, q, t).ratio() if ratio else 0)), tid, n))
        out += [(qid, tid, n, i + 1) for i, (_, tid, n) in enumerate(sorted(rows)[:k])]
    return sorted(out)


@pytest.mark.parametrize("ratio", [False, True])
def test_pruned_ranking_equals_brute_force(spark, ratio):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    texts = [(i, f"http {word()} {word()} end") for i in range(300)]  # all hold the bigrams of http and end
    queries = [(i, f"http {word()}") for i in range(20)] + [(90, texts[7][1]), (91, "ht"), (92, "zzz"), (93, ""), (94, "a")]
    q, t = spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(texts, "text_id long, text string")
    got = retrieval.bigram_rank(q, t, 4, ratio)
    assert sorted(map(tuple, got.select("query_id", "text_id", "overlap", "rank").collect())) == brute_rank(queries, texts, 4, ratio)


def test_peers_by_counts(spark):
    rows = [(1, "d", ["a", "b"]), (2, "d", ["b", "c"]), (3, "d", []), (4, "e", ["a"]), (5, "e", ["a", "a"])]
    s = spark.createDataFrame(rows, "scenario_id long, domain_id string, disclosures array<string>")
    want = sorted({(i, x) for i, d, _ in rows for j, e, xs in rows for x in xs if d == e and i != j})
    assert sorted(map(tuple, records.peer_disclosures(s).collect())) == want


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_receipts_are_written_once_and_replayed(spark):
    table = f"receipts_{uuid.uuid4().hex}"
    bundle = lambda n, answer, parsed="{}", ns="judge", more=None: (ns, canonical({"q": n} | (more or {})), canonical({"a": answer}), parsed, canonical({"v": 1}))
    kinds = "namespace string, request string, raw_response string, parsed string, metadata string"
    outcomes = lambda rows: sorted(r.outcome for r in receipts.write(spark.createDataFrame(rows, kinds), table).collect())
    first = [bundle(1, "x"), bundle(1, "x"), bundle(2, "y", None), bundle(3, "z", more={"h": {"X-API_key": "s"}}), bundle(4, "z", ns="../up")]
    assert outcomes(first) == ["rejected", "rejected", "written", "written"]
    assert outcomes(first) == ["rejected", "rejected", "stored", "stored"]
    asked = spark.createDataFrame([(canonical({"q": n}),) for n in (1, 2, 9)], "request string")
    found = {r.request: (r.outcome, r.parsed) for r in receipts.lookup(asked, table, "judge").collect()}
    assert found == {canonical({"q": 1}): ("hit", "{}"), canonical({"q": 2}): ("hit", None), canonical({"q": 9}): ("open", None)}
    assert outcomes([bundle(1, "changed")]) == ["second_response"]
    assert {r.outcome for r in receipts.lookup(asked.limit(1), table, "judge").collect()} == {"ambiguous"}
    identity = {h: "sha256:" + hashlib.sha256(p.encode()).hexdigest() for h, p in zip(receipts.HASHES, (canonical({"q": 2}), canonical({"a": "y"}), "null", canonical({"v": 1})), strict=True)}
    mine = "sha256:" + hashlib.sha256(canonical(identity).encode()).hexdigest()
    wanted = spark.createDataFrame([(mine,), ("sha256:0",)], "receipt_id string")
    assert {r.receipt_id: r.outcome for r in receipts.replay(wanted, table).collect()} == {mine: "intact", "sha256:0": "missing"}
    spoilt = spark.table(table).withColumn("raw_response", F.when(F.col("receipt_id") == mine, canonical({"a": "forged"})).otherwise(F.col("raw_response")))
    spoilt.write.bucketBy(receipts.BUCKETS, "request_hash").saveAsTable(f"{table}_spoilt")
    assert receipts.replay(wanted.limit(1), f"{table}_spoilt").first().outcome == "altered"
    lookups = plan_of(receipts.lookup(asked.repartition(3), table, "judge").select("outcome"))
    assert "Bucketed: true" in lookups


def test_turn_probes(spark):
    policy = {"stop_latency_max_ms": 100.0, "response_latency_max_ms": 100.0, "resume_latency_max_ms": -1.0, "pause_hold_min_ms": 100.0, "clock_uncertainty_max_ms": 20.0}
    events = [("c", 0, "hold"), ("n", 0, None), ("s", 0, "x"), ("e50", 50_000_000, "x"), ("e95", 95_000_000, "x"), ("e200", 200_000_000, "x"), ("e5", 5_000_000, "x")]
    ev = spark.createDataFrame([(run, e, ns, c) for run in (1, 2) for e, ns, c in events], "run_id long, event_id string, ns long, control string")
    clocks = spark.createDataFrame([(1, 10_000_000), (2, 30_000_000)], "run_id long, uncertainty_ns long")
    p = [
        (1, "p1", True, "hold", "c", "stop", "s", "e50", "passed", "latency_interval_within_maximum"),
        (1, "p2", True, "hold", "c", "response", "s", "e95", "N/M", "clock_uncertainty_crosses_latency_threshold"),
        (1, "p3", True, "hold", "c", "stop", "s", "e200", "failed", "latency_interval_exceeds_maximum"),
        (1, "p4", True, "hold", "c", "pause_hold", "s", "e200", "passed", "hold_interval_meets_minimum"),
        (1, "p5", True, "hold", "c", "pause_hold", "s", "e5", "failed", "hold_interval_below_minimum"),
        (1, "p6", False, None, None, None, None, None, "N/A", "probe_opportunity_not_present"),
        (1, "p7", True, "stop", "c", "stop", "s", "e50", "failed", "turn_control_classification_mismatch"),
        (1, "p8", True, "hold", "c", None, None, None, "passed", "turn_control_classification_matches"),
        (2, "p9", True, "hold", "c", "stop", "s", "e50", "N/M", "clock_uncertainty_exceeds_policy"),
        (1, "q1", True, "hold", "gone", "stop", "s", "e50", "contract_invalid", "observed control event missing"),
        (1, "q2", True, "hold", "n", "stop", "s", "e50", "contract_invalid", "observed control empty"),
        (1, "q3", True, "hold", "c", "odd", "s", "e50", "contract_invalid", "latency kind unknown"),
        (1, "q4", True, "hold", "c", "resume", "s", "e50", "contract_invalid", "threshold missing or negative"),
        (1, "q5", True, "hold", "c", "stop", "e50", "s", "contract_invalid", "latency negative"),
        (1, "q6", True, "hold", "c", "stop", "s", "gone", "contract_invalid", "start or end event missing"),
        (1, "q7", True, "hold", "c", "stop", "s", "e50", "contract_invalid", "duplicate probe_id"),
        (1, "q7", True, "hold", "c", "stop", "s", "e50", "contract_invalid", "duplicate probe_id"),
    ]
    probes = spark.createDataFrame([x[:8] for x in p], "run_id long, probe_id string, applicable boolean, expected_control string, observed_control_event_id string, latency_kind string, start_event_id string, end_event_id string")
    got = audio.turn_probes(probes, ev, clocks, policy)
    assert sorted((r.run_id, r.probe_id, r.status, r.reason) for r in got.collect()) == sorted((x[0], x[1], *x[8:]) for x in p)
    unset = audio.turn_probes(probes.where("probe_id IN ('p1', 'p6')"), ev, clocks, None)
    assert sorted((r.probe_id, r.status, r.reason) for r in unset.collect()) == [("p1", "N/M", "M21_threshold_profile_unselected"), ("p6", "N/A", "probe_opportunity_not_present")]
    cut = spark.createDataFrame([(5.0, 0.0, 10.0, True), (5.0, 0.0, 10.0, False)], "v double, b double, u double, least boolean")
    assert [r.s for r in cut.select(audio.against(F.col("v"), F.col("b"), F.col("u"), F.col("least")).alias("s")).collect()] == ["passed", "N/M"]
