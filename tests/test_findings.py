"""Findings of larger tables and odd inputs, each with a case that failed before."""

import json
import re
import time
import uuid

from pyspark.sql import functions as F

from callscope.functions import text as ft
from callscope.operators import judge, receipts, retrieval, text_rules, values


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_sentences_of_a_text_without_a_boundary(spark):
    long = "word " * 60_000
    texts = spark.createDataFrame([(1, long), (2, "一。二　三！"), (3, "。。四"), (4, "五"), (5, "")], "id long, t string")
    began = time.time()
    got = texts.select("id", text_rules.sentences(F.col("t")).alias("s"))
    assert rows(got) == [(1, []), (2, ["一", "二三"]), (3, []), (4, []), (5, [])]
    marks = spark.createDataFrame([(1, "a" + " " * 60_000 + "b"), (2, "a   \n b"), (3, "a \t\r\nb"), (4, "a  \n")], "id long, t string")
    assert rows(text_rules.style_spans(marks, "t", ["id"]).where("rule = 'hard_break'")) == [(2, "hard_break", 1, 5), (3, "hard_break", 1, 5)]
    assert time.time() - began < 20


def test_texts_that_fit_one_by_one_fit_their_parts(spark):
    sizes = [1500, 3000, 1500, 1500, 3300, 100, 5000]
    evidence = spark.createDataFrame([(1, i, f"r{i}", "x" * n) for i, n in enumerate(sizes)], "run_id long, seq long, ref string, text string")
    tasks = spark.createDataFrame([(1, "q", "asked?")], "run_id long, question_id string, question string")
    reqs = judge.requests(tasks, evidence, 4000).collect()
    refs = lambda fits: sorted(e["ref"] for r in reqs if r["fits"] == fits for e in json.loads(r["request"])["evidence"])
    assert refs(False) == ["r6"] and refs(True) == [f"r{i}" for i in range(6)]
    assert len({r["part"] for r in reqs}) == len(reqs)


def test_value_metrics_send_nothing_through_the_driver(spark):
    runs = spark.createDataFrame([(1, False)], "run_id long, malformed boolean")
    important = spark.createDataFrame([(1, "phone_number", None, "0901", "phone")], "run_id long, slot_id string, name string, value string, value_type string")
    slots = values.slots(important, spark.createDataFrame([(1, "tel", "0901")], "run_id long, name string, value string"))
    turns = spark.createDataFrame([(1, 0, "user", "0901", []), (1, 1, "operator", "0901", ["0901", "0901"])], "run_id long, seq long, actor string, text string, transcripts array<string>")
    args = spark.createDataFrame([(1, 2, "t", "tel", "0901", True, "tool_result")], "run_id long, call_seq long, tool string, name string, value string, ledger boolean, source_kind string")
    contracts = spark.createDataFrame([(1, "1円", "t")], "run_id long, disclosure string, deadline_tool string")
    got = values.value_metrics(runs, slots, turns, args, contracts)
    assert "Broadcast" not in plan_of(got)
    assert rows(got.select("metric_id", "status")) == [("M20", "passed"), ("M22", "failed"), ("M25", "passed"), ("M26", "passed")]


def test_values_that_differ_by_row_are_not_compiled(spark):
    ft._pattern.cache_clear()
    for k in range(200, 3000):
        assert ft.holds_typed_value(f"計 {k},000 円", f"{k}000", "", "integer") and not ft.holds_typed_value(f"計{k}.5円", str(k), "", "number")
        assert ft.holds_typed_value(f"スタンダード{k}に", f"スタンダード{k}", "plan_name", "") and not ft.holds_typed_value(f"03-{k}", f"03-1{k}", "phone", "")
    assert ft._pattern.cache_info().currsize == 0
    cases = [("0,5,", "5", True), ("1,234", "234", True), ("1,234", "1", True), ("1.0", "1", True), ("1.50", "1.5", True), ("1,.5", "1.5", True), ("0.05", "0.05", True), ("x0", "0", True), ("00", "0", False), ("120-", "120", False), ("3:120", "120", False), ("٣500", "500", False)]
    assert [ft.holds_typed_value(t, v, "", "number") for t, v, _ in cases] == [c for _, _, c in cases]


def test_ranking_shuffles_each_tasks_best_only(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 2)
    monkeypatch.setattr(retrieval, "TEXTS_AT_ONCE", 7)
    pages = [(f"p{i:03d}", f"host{i % 5}", f"www.host{i % 5}.org/{i * 37 % 101}") for i in range(60)]
    asked = [(1, "host1 org 37"), (2, "host zz 74"), (3, None), (4, "org/99 host4"), (5, "qq")]
    docs = spark.createDataFrame(pages, "doc_id string, category_id string, title string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, query string")
    kinds = docs.select("category_id", F.col("category_id").alias("title")).distinct()
    pairs = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    plain = lambda s: "".join(c for c in s or "" if c.isalnum())

    def best(q, texts, k):
        found = sorted((-len(pairs(plain(q)) & pairs(plain(t))), i) for i, t in texts)
        return [(i, -n, r + 1) for r, (n, i) in enumerate(found[:k]) if n]

    ranked = retrieval.bigram_rank(queries, docs.select(F.col("doc_id").alias("text_id"), F.col("title").alias("text")), 4, ratio=False)
    assert rows(ranked) == sorted((q, *x) for q, t in asked for x in best(t, [(i, u) for i, _, u in pages], 4))
    staged = retrieval.two_stage(queries, kinds, docs, 2)
    inside = lambda t: {c for c, _, _ in best(t, sorted({(c, c) for _, c, _ in pages}), 2)}
    assert rows(staged.select("query_id", "doc_id", "overlap", "rank")) == sorted((q, *x) for q, t in asked for x in best(t, [(i, u) for i, c, u in pages if c in inside(t)], 2))
    for df in (ranked, staged):
        assert "Join" not in plan_of(df)


def test_receipts_find_equal_bundles_by_their_texts(spark, monkeypatch):
    plans = []
    keep = receipts.checkpointed
    monkeypatch.setattr(receipts, "checkpointed", lambda df: plans.append(plan_of(df)) or keep(df))
    bundles = [("n", "q1", "a", "{}", None), ("n", "q1", "a", "{}", "null"), ("n", "q1", "b", "{}", None), ("n", "q2", "a", None, None), ("n", "q2", "a", "null", "null")]
    frame = spark.createDataFrame(bundles, "namespace string, request string, raw_response string, parsed string, metadata string")
    said = receipts.write(frame, f"receipts_{uuid.uuid4().hex}")
    assert sorted(r.outcome for r in said.collect()) == ["second_response", "second_response", "written"]
    assert not re.search(r"hashpartitioning\(namespace#\d+, receipt_id", plans[0])
