"""Run operators on hand-made traces, against brute force where a loop says it plainly."""

import hashlib
import json
import re
import random
import struct
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.functions import text as ft
from callscope.operators import attempts, audio, contracts, facets, judge, order, provenance, quality, report, retrieval, search, sequence, state, text_rules, tickets, values
from callscope.sources import records


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pairing_equals_a_queue(spark):
    r = random.Random(3)
    events = [(run, i, r.choice(["tool_call", "tool_result", "message"]), r.choice("ab"), i * 10) for run in range(8) for i in range(60)]
    df = spark.createDataFrame(events, "run_id long, seq long, event_type string, tool string, v long").repartition(5)
    want, waiting = [], defaultdict(deque)
    for run, seq, kind, tool, _ in events:
        if kind == "tool_call":
            row = [run, tool, seq, None]
            want.append(row)
            waiting[run, tool].append(row)
        elif kind == "tool_result" and waiting[run, tool]:
            waiting[run, tool].popleft()[3] = seq
    got = attempts.pair_calls(df, ["v"], ["v"]).select("run_id", "tool", "call_seq", "result_seq")
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(key(tuple(x)) for x in want)


def test_success_notions_differ(spark):
    df = spark.createDataFrame([(None, None, None, None, []), ("", None, True, None, ["x"]), ("e", None, True, True, []), (None, None, False, None, []), (None, "t", True, False, [])], "error string, error_type string, ok boolean, verified boolean, fails array<string>")
    c = attempts.success_columns(F.col("error"), F.col("error_type"), F.col("ok"), [F.col("ok"), F.col("verified")], F.col("fails"))
    got = [tuple(r) for r in df.select(*[v.alias(k) for k, v in c.items()]).collect()]
    assert got == [(True, True, True, False), (True, False, False, True), (False, False, False, True), (False, False, False, False), (False, True, True, True)]


def test_ordered_match_is_greedy(spark):
    e = spark.createDataFrame([(1, 0, "a", "ok"), (1, 1, "b", "ok"), (2, 0, "a", "ok")], "run_id long, idx int, tool string, outcome string")
    a = spark.createDataFrame([(1, 5, "b", "ok"), (1, 6, "a", "ok"), (1, 7, "b", "ok"), (1, 8, "b", "ok")], "run_id long, call_seq long, tool string, outcome string")
    got = {r.run_id: (r.seqs, r.matched) for r in sequence.ordered_match(e, a).collect()}
    assert got == {1: ([6, 7], True), 2: ([], False)}


def test_streaks_reset(spark):
    c = spark.createDataFrame([(1, "t", i, ok) for i, ok in enumerate([False, False, False, True, False])], "run_id long, tool string, seq long, accepted boolean")
    assert [(r.streak, r.hard_reject) for r in sequence.rejected_streaks(c).orderBy("seq").collect()] == [(1, False), (2, False), (3, True), (0, False), (1, False)]


def test_prerequisite_may_precede_the_trigger(spark):
    calls = spark.createDataFrame([(1, 1, "verify", None), (1, 2, None, "p"), (1, 3, "update", None), (2, 1, None, "p"), (2, 2, "update", None), (2, 3, "verify", None), (3, 1, "update", None)], "run_id long, seq long, tool string, trigger string")
    edges = spark.createDataFrame([("e", "p", "update", ["verify"])], "edge_id string, trigger string, action_tool string, required_tools array<string>")
    assert [(r.run_id, r.status) for r in order.prerequisites(calls, edges).orderBy("run_id").collect()] == [(1, "pass"), (2, "fail"), (3, "N/A")]


def test_unresolved_deadline_fails(spark):
    events = spark.createDataFrame([(1, 1, ["r"]), (1, 2, ["d", "alias"])], "run_id long, seq long, refs array<string>")
    contracts = spark.createDataFrame([(1, "ok", ["r"], "alias", None, None), (1, "late", ["d"], "r", None, None), (1, "lost", ["r"], "zz", None, None), (1, "consent", ["r"], None, "r", "d"), (1, "noact", [], None, "r", "zz")], "run_id long, obligation_id string, required_refs array<string>, deadline_ref string, consent_ref string, action_ref string")
    got = {r.obligation_id: r.status for r in order.obligations(events, contracts).collect()}
    assert got == {"ok": "pass", "late": "fail", "lost": "fail", "consent": "pass", "noact": "fail"}


def test_alignment_between_anchors(spark):
    anchored = spark.createDataFrame([(1, 2, 10)], "run_id long, idx long, seq long")
    ideal = spark.createDataFrame([(1, 0, "user"), (1, 1, "user"), (1, 3, "user")], "run_id long, idx long, actor string")
    runtime = spark.createDataFrame([(1, 4, "user"), (1, 12, "user"), (1, 13, "user")], "run_id long, seq long, actor string")
    assert rows(order.align_messages(ideal, runtime, anchored)) == [(1, "user", 0, 4), (1, "user", 3, 12)]


def test_anchors_run_backwards(spark):
    ideal = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b")], "run_id long, idx long, tool string")
    runtime = spark.createDataFrame([(1, 5, "a"), (1, 6, "a"), (1, 7, "a")], "run_id long, seq long, tool string")
    assert rows(order.anchors(ideal, runtime)) == [(1, "a", 0, 6), (1, "a", 1, 7)]


def test_provenance_tiers(spark):
    args = spark.createDataFrame([(1, 9, "x", "42"), (1, 9, "y", "blue"), (1, 9, "z", "none"), (1, 9, "n", None)], "run_id long, call_seq long, field string, value string")
    results = spark.createDataFrame([(1, 3, "$.a", "42"), (1, 5, "$.b", "42"), (1, 11, "$.c", "42")], "run_id long, seq long, path string, value string")
    says = spark.createDataFrame([(1, 2, "text", "I like blue, or bluebird")], "run_id long, seq long, path string, value string")
    got = {r.field: (r.source_kind, r.source_seq) for r in provenance.tiered(args, [("result", results)], [("user", says)]).collect()}
    assert got == {"x": ("result", 5), "y": ("user", 2), "z": ("unknown", None), "n": ("not_applicable", None)}


def test_json_leaves_and_forbidden_keys(spark):
    df = spark.createDataFrame([(1, '{"a": [1.0, {"user_token": true}], "b": null}'), (2, "broken"), (3, None)], "run_id long, p string")
    keys = spark.createDataFrame([(1, '{"usage": {"prompt_tokens": 3}, "x": "api_key"}'), (2, '{"h": [{"My_API_Key": {}}]}'), (3, '{"say": "\\"authorization\\": no", "single_overall_score": 1}'), (4, None)], "run_id long, p string")
    assert rows(provenance.leaves(df, "p", ["run_id"]).select("ord", "path", "kind", "value"))[0:2] == [(0, "$.a[0]", "number", "1"), (1, "$.a[1].user_token", "boolean", "true")]
    assert rows(quality.forbidden_keys(keys, "p", quality.SECRET_KEYS, "secret")) == [(2, "secret", "My_API_Key")]
    assert rows(quality.forbidden_keys(keys, "p", quality.OVERALL_KEYS, "score")) == [(3, "score", "single_overall_score")]
    assert quality.forbidden_keys(df, "p", quality.SECRET_KEYS, "secret").count() == 0


def test_state_folds_differs_and_hashes(spark):
    initial = spark.createDataFrame([(1, "t", "r1", {"a": "1", "b": "2"})], "run_id long, tbl string, identity string, values map<string,string>")
    log = spark.createDataFrame([(1, 5, "update", "t", "r1", {"a": "9"}), (1, 3, "update", "t", "r1", {"a": "7"}), (1, 6, "create", "t", "r2", {"a": "1"})], "run_id long, seq long, operation string, tbl string, identity string, after map<string,string>")
    cells = state.fold_changes(initial, log)
    assert rows(cells.select("identity", "column", "value")) == [("r1", "a", "9"), ("r1", "b", "2"), ("r2", "a", "1")]
    before = initial.select("run_id", "tbl", "identity", F.explode("values").alias("column", "value"))
    assert rows(state.state_diff(before, cells).select("identity", "change")) == [("r1", "changed"), ("r2", "created")]
    again = state.state_hash(cells.repartition(3)).first().state_sha256
    want = {"t": [{"row_identity": "r1", "values": {"a": "9", "b": "2"}}, {"row_identity": "r2", "values": {"a": "1"}}]}
    assert again == hashlib.sha256(json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    odd = spark.createDataFrame([(1, "b", ("s", 10), "名\\", 'a "q", {x}=1;\n', "string"), (1, "b", ("s", 10), "n", "3", "number"), (1, "b", ("s", 2), "z", None, "null"), (1, "a", ("s", 1), "t", "true", "boolean")], "run_id long, tbl string, identity struct<kind:string,no:int>, column string, value string, kind string")
    plain = {"a": [{"row_identity": {"kind": "s", "no": "1"}, "values": {"t": True}}], "b": [{"row_identity": {"kind": "s", "no": "10"}, "values": {"名\\": 'a "q", {x}=1;\n', "n": 3}}, {"row_identity": {"kind": "s", "no": "2"}, "values": {"z": None}}]}
    assert state.canonical(odd).first().canonical == json.dumps(plain, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert again == state.state_hash(cells).first().state_sha256
    assert state.digest_mismatches(cells, spark.createDataFrame([(1, "sha256:" + again)], "run_id long, declared string")).count() == 0
    fresh, taken = state.create_rows(initial, spark.createDataFrame([(1, 1, "t", "r1", {"a": "0"}), (1, 2, "t", None, {"a": "0"})], "run_id long, seq long, tbl string, identity string, after map<string,string>"))
    assert [r.identity for r in fresh.collect()] == ["unplanned:1"] and taken.count() == 1


def test_reciprocal_rank_counts_successes(spark):
    opens = spark.createDataFrame([(1, 1, 7, False), (1, 2, 3, True), (1, 3, 7, True)], "run_id long, seq long, doc int, ok boolean")
    gold = spark.createDataFrame([(1, 7), (2, 7)], "run_id long, doc int")
    runs = spark.createDataFrame([(1,), (2,)], "run_id long")
    got = {r.run_id: (r.k, r.score, r.one_shot, r.final_gold) for r in retrieval.reciprocal_rank(opens, gold, runs).collect()}
    assert got == {1: (2, 0.5, True, True), 2: (None, 0.0, False, False)}


def test_bigram_rank_equals_brute_force(spark):
    import difflib

    r = random.Random(2)
    qs = [(i, "".join(r.choice("abcd ") for _ in range(8))) for i in range(6)]
    ts = [(i, "".join(r.choice("abcd ") for _ in range(14))) for i in range(40)]
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    want = []
    for qi, q in qs:
        p = plain(q)
        grams = {p[i : i + 2] for i in range(len(p) - 1)}
        scored = sorted((-(n + difflib.SequenceMatcher(None, p, plain(t)).ratio()), ti) for ti, t in ts if (n := sum(g in plain(t) for g in grams)))
        want += [(qi, ti, k + 1) for k, (_, ti) in enumerate(scored[:3])]
    got = retrieval.bigram_rank(spark.createDataFrame(qs, "query_id long, query string"), spark.createDataFrame(ts, "text_id long, text string"), 3)
    assert rows(got.select("query_id", "text_id", "rank")) == sorted(want)


def test_tickets(spark):
    a = spark.createDataFrame([(1, 2, "u", "ok", "T1", "D1"), (1, 1, "v", "ok", None, "D1")], "run_id long, call_seq long, tool string, outcome string, target string, evidence string")
    f = tickets.facts(a).withColumn("handling_type", F.lit("refusal"))
    assert f.first().actions == ["v:ok", "u:ok"] and f.first().evidence == ["D1"]
    assert tickets.compare(f, f).first().score == 1.0
    assert tickets.compare(f.limit(0), f).first().status == "N/M"
    lists = [["guidance_inquiry_answer", "refusal"], ["refusal", "callback_commitment", "escalation"], ["guidance_inquiry_answer"], ["change_procedure", "guidance_inquiry_answer"], [None, "refusal"], []]
    kinds = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, k array<string>").select("i", tickets.handling_type(F.col("k")).alias("t"), tickets.outcome_handling(F.col("k")).alias("o"))
    got = {r.i: (r.t, r.o) for r in kinds.collect()}
    assert got == {0: ("refusal", "refusal"), 1: ("escalation", "escalation"), 2: ("guidance_inquiry_answer",) * 2, 3: ("change_procedure",) * 2, 4: ("refusal", "refusal"), 5: (None, None)}
    kind, reason = tickets.observed_handling(F.col("w"))
    seen = spark.createDataFrame([(1, ["change", "x"]), (2, ["change", "refusal"]), (3, [])], "i int, w array<string>").select("i", kind.alias("k"), reason.alias("r"))
    assert rows(seen.select("i", F.coalesce("k", F.lit("-")), F.coalesce("r", F.lit("-")))) == [(1, "change_procedure", "-"), (2, "-", "handling_type_ambiguous"), (3, "-", "handling_type_not_observed")]
    o = spark.createDataFrame([(1, None, True, [], ["refusal"], False), (2, None, True, [], [], True), (3, None, False, ["refusal"], [], True), (4, "escalation", False, [], [], False), (5, None, True, [], [], False)], "run_id long, stored string, completed boolean, from_events array<string>, from_state array<string>, changed boolean")
    assert rows(tickets.run_outcome(o)) == [(1, "refusal", True, "observed_run_evidence"), (2, "change_procedure", True, "observed_run_evidence"), (3, "incomplete", False, "run_not_completed"), (4, "escalation", True, "stored"), (5, "incomplete", False, "completion_record_missing")]
    claimed = spark.createDataFrame([(1, 0, "doc", "a"), (1, 1, "doc", "b")], "run_id long, pos long, kind string, ref string")
    keep = spark.createDataFrame([(1, "doc", "b"), (1, "doc", "c")], "run_id long, kind string, ref string")
    assert [r.ref for r in tickets.confirmed_evidence(claimed, keep, keep).orderBy("pos").collect()] == ["b", "c"]


def test_quality_rules(spark):
    e = spark.createDataFrame([(1, 1, 1, None, "m"), (1, 2, 1, "post_call", "m"), (1, 3, 5, None, "m"), (1, 4, None, "x", "m")], "run_id long, pos long, seq long, epoch string, event_type string")
    assert rows(quality.event_log(e)) == [(1, "call_after_ticket", "5"), (1, "seq_missing", "4"), (1, "seq_not_increasing", "1"), (1, "unknown_epoch", "x")]
    d = spark.createDataFrame([(1, "2024-02-30", 5), (2, "2024-02-29", None)], "run_id long, day string, n int")
    kinds = d.select(quality.matches_type(F.col("day"), F.lit("date")).alias("ok"))
    assert [r.ok for r in kinds.collect()] == [False, True]
    rules = [{"field": "n", "required": True, "max": 4}, {"field": "day", "matches": r"^\d{4}"}]
    assert rows(quality.expectations(d, rules)) == [(1, "max", "n"), (2, "required", "n")]
    assert quality.bad_variants(spark.createDataFrame([(1, "hard"), (2, "soft")], "run_id long, variant_id string")).count() == 1


def test_scores_and_tables(spark):
    r = spark.createDataFrame([("pass", None), ("fail", 0.5), ("measured", 0.25), ("N/M", None), ("N/A", None), ("contract_invalid", None)], "status string, rate double")
    score = lambda m: [x.s for x in r.select(report.entity_score(F.col("status"), F.col("rate"), F.lit(m)).alias("s")).collect()]
    assert score("M14") == [1.0, 0.5, 0.25, 0.0, None, 0.0] and score("M01") == [1.0, 0.0, 0.25, 0.0, None, 0.0]
    with pytest.raises(Exception, match="unknown status"):
        spark.createDataFrame([("odd", None)], "status string, rate double").select(report.entity_score(F.col("status"), F.col("rate"), F.lit("M01"))).collect()
    f = spark.createDataFrame([(1, "a", None), (2, "a", "pass"), (3, "a", "not_applicable"), (1, "error_recovery", None)], "run_id long, facet string, status string")
    assert rows(report.facet_table(f).select("facet", "n")) == [("a", 2), ("error_recovery", 0)]
    core = spark.createDataFrame([(1, "M05", "pass", ""), (2, "M05", "fail", "")], "run_id long, metric_id string, status string, reason string")
    other = core.withColumn("status", F.lit("N/M"))
    assert rows(report.override(core, other, "pass").select("run_id", "status")) == [(1, "N/M"), (2, "fail")]


def test_bootstrap_brackets_the_mean(spark):
    d = spark.createDataFrame([("g", i, float(i % 5)) for i in range(40)], "grp string, key long, diff double")
    lo, hi = report.bootstrap(d, 2000).select("lo", "hi").first()
    assert lo < 2.0 < hi and hi - lo < 1.2


def test_text_functions(spark):
    assert [ft.kanji_number(x) for x in ("十", "二十三", "百五", "一万二千", "二〇二四", "x", "")] == [10, 23, 105, 12000, 2024, None, None]
    df = spark.createDataFrame([("２０２４年２月３日",), ("2024/13/01",), ("2024-2-3",)], "t string")
    assert [r[0] for r in df.select(ft.normal_date(F.col("t"))).collect()] == ["2024-02-03", None, "2024-02-03"]
    got = spark.createDataFrame([("ＡＢ１", "二十時、三 分", "ひらがな")], "a string, b string, c string").select(ft.nfkc("a"), ft.compact("b"), ft.to_katakana(F.col("c"))).first()
    assert tuple(got) == ("AB1", "20時3分", "ヒラガナ")
    held = spark.createDataFrame([("say a.b now", "a.b"), ("xa.b", "a.b")], "t string, v string").select(ft.contains_value(F.col("t"), F.col("v")))
    assert [r[0] for r in held.collect()] == [True, False]


def test_text_rules(spark):
    t = spark.createDataFrame([(1, "a", "「はい」。(だめ]"), (1, "b", "お客様、承りました。だ。（例：はい）例: だ"), (1, "c", "see https://x.y and snake_case")], "run_id long, turn_ref string, text string")
    j = {r.turn_ref: r for r in text_rules.japanese_rules(t, "text", ["turn_ref"]).collect()}
    assert not j["a"].balanced and j["b"].balanced and j["b"].impolite_sentences == 2 and not j["c"].has_japanese
    more = spark.createDataFrame([("ですますね［x］よね", 1), ("そうですよね」", 0), ("行きますかね。", 0), ("ご予約されている方です", 0)], "text string, i int")
    got = text_rules.japanese_rules(more, "text", ["text"]).orderBy("text").collect()
    assert {r.text: (r.balanced, r.malformed, r.double_honorifics, r.impolite_sentences) for r in got} == {"ですますね［x］よね": (True, 1, 0, 1), "そうですよね」": (False, 0, 0, 0), "行きますかね。": (True, 0, 0, 0), "ご予約されている方です": (True, 0, 1, 0)}
    assert {r.rule for r in text_rules.style_violations(t, "text", ["turn_ref"]).collect()} == {"url", "identifier", "digit_punctuation"} - {"digit_punctuation"}
    k = spark.createDataFrame([(1, "a", 0, 1, "に", "ADP", 0, 1), (1, "a", 0, 2, "に", "ADP", 1, 2), (1, "a", 0, 3, "に", "ADP", 5, 6), (1, "b", 0, 1, "まで", "ADP", 0, 2), (1, "b", 0, 2, "まで", "ADP", 2, 4)], "run_id long, turn_ref string, sentence_id int, token_id int, lemma string, pos string, start_char int, end_char int")
    assert [r.token_id for r in text_rules.doubled_particles(k).collect()] == [2]
    twice = spark.createDataFrame([(1, "これは とても長い文章です、そして繰り返します。これはとても長い文章です、そして繰り返します。終わり")], "id long, text string")
    assert [r.repeats for r in text_rules.repeated_sentences(twice, "text", ["id"]).collect()] == [1]
    v = text_rules.style_violations(t, "text", ["run_id", "turn_ref"])
    assert text_rules.roll_up(t, v).first().status == "fail"
    people = spark.createDataFrame([("田中", "self"), ("鈴木", "customer"), ("佐藤", "self"), ("佐藤", "customer")], "surface string, relation string")
    said = spark.createDataFrame([(1, "田中様、お客様の田中様"), (2, "弊社の担当の鈴木様と鈴木様"), (3, "佐藤様"), (4, "田中さん")], "id long, text string")
    assert rows(text_rules.in_group_suffix(said, people, "text", ["id"])) == [(1, "田中", 2, 1, 0), (2, "鈴木", 2, 1, 0), (3, "佐藤", 1, 0, 1)]


def test_style_marks_equal_a_plain_search(spark):
    """Earlier rules win, and an overlapped match doesn't suppress others."""
    r = random.Random(5)
    pieces = ["- a", "1. b", "(2) c", "|x|", "**b**", "# h", "`" * 3, "www.a.b/c_d", "\n\n", "  \n", "\n", "\r\n", "12:30", "1,000", "some_name", "_ab", "long_" * 3, "文" * 210, "。", " ", "・x", "！", "｜"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 14))) for _ in range(150)]
    want = []
    for i, t in enumerate(texts):
        kept = []
        for rule, pattern in text_rules.STYLE_RULES:
            for m in re.finditer(pattern, t):
                if not any(m.start() < e and m.end() > s for _, s, e in kept):
                    kept.append((rule, m.start(), m.end()))
        want += [(i, *x) for x in kept]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert rows(text_rules.style_spans(df, "t", ["i"])) == sorted(want)
    assert len({w[1] for w in want}) == len(text_rules.STYLE_RULES)
    one = spark.createDataFrame([(1, "- see www.x.y 12:30"), (2, "a  \nb"), (3, None)], "i int, t string")
    assert rows(text_rules.style_violations(one, "t", ["i"])) == [(1, "bullet", 1), (2, "hard_break", 1)]


def test_values(spark):
    turns = spark.createDataFrame([(1, 0, "user", "my id is 55"), (1, 1, "operator", "55, right"), (1, 2, "user", "yes 55"), (1, 3, "operator", "ok")], "run_id long, seq long, actor string, text string")
    slots = spark.createDataFrame([(1, "id", "55")], "run_id long, slot_id string, value string")
    o = values.read_backs(turns, slots)
    assert rows(o.select("said_seq", "n_turns", "read_back")) == [(0, 1, True), (2, 1, False)]
    assert values.read_back_rates(o, 3).first().observation == pytest.approx(2 / 3)
    args = spark.createDataFrame([(1, "id", "56"), (1, "id", "55")], "run_id long, name string, value string")
    said = spark.createDataFrame([(1, "maybe 56")], "run_id long, text string")
    assert values.retained(slots, args, said).first().status == "pass"
    assert values.retained(slots, args, said.limit(0)).first().status == "fail"
    profiles = spark.createDataFrame([(1, 1, ["a 1 2 fee", "a 12 fee"])], "run_id long, seq long, transcripts array<string>")
    assert values.agreed_tokens(profiles).first().tokens == ["12"]
    kw = spark.createDataFrame([(1, "d", "fee"), (1, "x", "none")], "run_id long, disclosure_id string, keyword string")
    assert rows(values.disclosed(kw, profiles)) == [(1, "d", True), (1, "x", False)]


def wav(samples, rate=8000):
    data = b"".join(struct.pack("<h", int(max(-32768, min(32767, s * 32768)))) for s in samples)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


PROFILE = {
    "sample_rate_hz": [8000], "channels": [1], "sample_width_bits": [16], "rms_dbfs_min": -50.0, "rms_dbfs_max": -3.0, "peak_dbfs_max": 0.0, "clip_ratio_max": 0.01,
    "flat_top_max_ms": 20.0, "dropout_max_ms": 1500.0, "snr_min_db": 0.0, "rolloff_min_hz": 300.0, "rolloff_max_hz": 3600.0, "dc_max_dbfs": -30.0, "active_level_dbov_min": -50.0,
    "active_level_dbov_max": -3.0, "required_facets": ["decode_format", "rms_peak", "clipping", "flat_top", "bandwidth", "dc"], "inapplicable_facets": {"snr": "none", "active_level": "none"},
}


def test_audio(spark):
    t = np.arange(8000) / 8000
    files = [("good", wav(0.5 * np.sin(2 * np.pi * 440 * t))), ("clipped", wav(np.sign(np.sin(2 * np.pi * 440 * t)) * 1.2)), ("bad", b"nothing"), ("silent", wav(np.zeros(100)))]
    binary = spark.createDataFrame([(n, bytearray(b)) for n, b in files], "path string, content binary")
    f = audio.wav_features(binary)
    s = audio.signal_status(f, PROFILE)
    assert {r.path: r.status for r in s.collect()} == {"good": "passed", "clipped": "failed", "bad": "contract_invalid", "silent": "failed"}
    assert "snr" not in s.where("path = 'silent'").first().violations
    good = f.where("path = 'good'").first()
    assert good.frames == 8000 and good.rms_dbfs == pytest.approx(-9.03, abs=0.05) and good.rolloff_hz == pytest.approx(440, abs=3) and good.flat_top_ms == 0
    clipped, silent = (f.where(f"path = '{n}'").first() for n in ("clipped", "silent"))
    # 16 bit samples clip at 32767 / 32768; a half wave of 440 Hz at 8 kHz has up to 10 equal ones
    assert clipped.clip_ratio > 0.9 and 9 <= clipped.flat_top_ms * 8 <= 10
    assert silent.rms_dbfs == silent.dc_dbfs == -300.0 and silent.rolloff_hz == 0 and silent.dropout_ms is None
    spans = spark.createDataFrame([("good", [(0, 4000)], [(0, 400)])], "path string, speech_ranges array<struct<start:long,end:long>>, noise_ranges array<struct<start:long,end:long>>")
    heard = audio.wav_features(binary.join(spans, "path")).first()
    assert abs(heard.snr_db) < 0.2 and heard.dropout_ms < 1
    facts = spark.createDataFrame([("good", None, 8000, 1, 16, 8000), ("clipped", "00", 8000, 2, 16, None), ("none", None, None, None, None, None), ("bad", None, None, None, None, None)], "path string, sha256 string, rate int, channels int, bits int, frames long")
    assert [(r.path, r.rule) for r in audio.undeclared_facts(f, facts).orderBy("path", "rule").collect()] == [("bad", "malformed"), ("clipped", "channels_differs"), ("clipped", "sha256_differs"), ("none", "file_missing")]
    e = spark.createDataFrame([(1, 10, "customer_received", "c"), (1, 20, "response_started", "s"), (1, 25, "playback", "x"), (1, 4000000020, "playback", "s")], "run_id long, ns long, kind string, segment string")
    p = audio.latency_status(audio.latency_probes(e)).first()
    assert (p.received_ns, p.played_ns, p.status) == (10, 4000000020, "failed")
    seg = spark.createDataFrame([(1, "s", ["a", "b"]), (1, "t", ["a"])], "run_id long, segment_id string, chunk_ids array<string>")
    chunks = spark.createDataFrame([(1, "a")], "run_id long, chunk_id string")
    assert rows(audio.continuous(seg, chunks, chunks.limit(0))) == [(1, "s", False), (1, "t", True)]


def test_value_metrics(spark):
    """Slots, attempts in transcripts, excused and copied values, disclosures and ledgers."""
    important = spark.createDataFrame([(1, "phone_number", None, "090-1234-5678", "phone"), (1, None, "kana", "イシカワ", "name"), (1, "note", None, "了解", "text"), (2, "size", None, "55", None)], "run_id long, slot_id string, name string, value string, value_type string")
    gold = spark.createDataFrame([(1, "tel", "09012345678"), (2, "size", "54")], "run_id long, name string, value string")
    slots = values.slots(important, gold).cache()
    assert rows(slots.where("run_id = 1").select("slot_id", "normalized", "kind", "argument_names")) == [("kana", "イシカワ", "kana", []), ("note", "了解", "text", []), ("phone_number", "09012345678", "digits", ["tel"])]
    turns = spark.createDataFrame(
        [(1, 0, "user", "〇九〇 1234-5678、イシカワです。了解", []), (1, 1, "operator", "復唱", ["090 1234 5679 イシカワ", "０９０-1234-5679 イシカワ"]), (1, 2, "user", "違います", []), (1, 3, "operator", "09012345678ですね。手数料500円、返金", ["09012345670 500円返金", "09012345670 500円の返金"]), (2, 0, "customer", "55です", []), (2, 1, "operator", "はい", ["55", "66"])],
        "run_id long, seq long, actor string, text string, transcripts array<string>",
    )
    e = values.transcript_evidence(slots, turns)
    assert rows(e.select("run_id", "slot_id", "seq", "token", "correct")) == [(1, "kana", 1, "イシカワ", True), (1, "phone_number", 1, "09012345679", False)]
    args = spark.createDataFrame([(1, 5, "tool", "tel", "09012345678", True, "customer_utterance"), (1, 5, "tool", "kana", "イシカワ", True, "unknown"), (2, 5, "tool", "size", "66", True, "tool_result"), (2, 6, "tool", "size", "55", True, None)], "run_id long, call_seq long, tool string, name string, value string, ledger boolean, source_kind string")
    contracts = spark.createDataFrame([(1, "手数料500円、返金します", "tool"), (2, "ありがとう", None), (3, "取消", "never")], "run_id long, disclosure string, deadline_tool string")
    runs = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True)], "run_id long, malformed boolean")
    got = {(r.run_id, r.metric_id): (r.status, r.units, r.passed_units) for r in values.value_metrics(runs, slots, turns, args, contracts).collect()}
    assert got[1, "M20"] == ("failed", 2, 1) and got[1, "M25"] == ("failed", 2, 1) and got[1, "M26"] == ("failed", 2, 1) and got[1, "M22"] == ("passed", 1, 1)
    assert got[2, "M20"] == ("passed", 1, 1) and got[2, "M22"] == ("N/M", 0, 0) and got[2, "M26"] == ("N/M", 0, 0) and got[2, "M25"] == ("N/A", 0, 0)
    assert {got[3, m][0] for m in ("M20", "M22", "M25", "M26")} == {"N/A"} and {got[4, m][0] for m in ("M20", "M22", "M25", "M26")} == {"N/M"}


def test_judge_batch(spark):
    tasks = spark.createDataFrame([(1, "q", "M", "yes", 5), (1, "r", "M", "yes", 1), (1, "s", "M", "no", None)], "run_id long, question_id string, metric_id string, expected string, bound_seq long")
    given = spark.createDataFrame([(1, "q", "yes", ["e"]), (1, "r", "yes", ["e"]), (1, "s", "maybe", [])], "run_id long, question_id string, answer string, refs array<string>")
    evidence = spark.createDataFrame([(1, "e", 3)], "run_id long, ref string, seq long")
    v = judge.validate(given, tasks, evidence)
    assert rows(v.select("question_id", "valid")) == [("q", True), ("r", False), ("s", False)]
    assert judge.score(v).first().rate == pytest.approx(1 / 3)
    cache = spark.createDataFrame([("h", "a", "x"), ("h", "b", "x")], "request_hash string, raw_hash string, parsed string")
    asked = spark.createDataFrame([(i, q, "x") for i in (1, 2, 3) for q in ("a", "b")], "run_id long, question_id string, question string")
    seen = spark.createDataFrame([(1, i, f"c{i:04d}", "t" * 300) for i in range(1200)] + [(2, 0, "c0000", "t" * 9000)], "run_id long, seq long, ref string, text string")
    parts = judge.requests(asked, seen, 4000)
    assert parts.where("run_id = 1 and fits").count() == parts.where("run_id = 1").count() > 100
    packed = parts.where("run_id = 1").select(F.explode(F.from_json("request", "evidence array<struct<ref:string>>")["evidence"]["ref"]).alias("ref"))
    assert rows(packed) == [(f"c{i:04d}",) for i in range(1200)]
    replies = judge.ask(parts.where("fits and has_evidence"), lambda r: json.dumps({"judgements": [{"question_id": "a", "answer": "yes" if "c0777" in r else "no", "evidence": []}, {"question_id": "b", "answer": "no", "evidence": []}]}))
    merged = judge.over_parts(judge.judgements(replies, parts), parts, asked)
    assert rows(merged.select("run_id", "question_id", F.coalesce("answer", F.lit("-")), "status")) == [(1, "a", "yes", "answered"), (1, "b", "no", "answered"), (2, "a", "-", "too_long"), (2, "b", "-", "too_long"), (3, "a", "no", "no_evidence"), (3, "b", "no", "no_evidence")]
    hits, misses, clash = judge.against_cache(spark.createDataFrame([(1, "h"), (2, "g"), (3, "g")], "run_id long, request_hash string"), cache)
    assert hits.count() == 1 and misses.count() == 1 and clash.first().n == 2


def test_sources(spark, tmp_path):
    for variant in ("baseline", "hard"):
        folder = tmp_path / variant / "s1" / "run_001"
        folder.mkdir(parents=True)
        (folder / "record.json").write_text('{"run_id": "r-%s", "scenario_id": "s1", "variant_id": "%s", "status": "ok", "wall_time_sec": 2.5, "event_log": [{"seq": 1, "event_type": "message", "content": "hi"}]}' % (variant, variant))
    files = records.whole_files(spark, [str(tmp_path)], "record.json")
    assert rows(files.select("variant_id", "scenario_id", "run_number")) == [("baseline", "s1", 1), ("hard", "s1", 1)]
    runs, events = records.runs_and_events(files)
    assert runs.count() == 2 and events.first().content == "hi"
    tasks = spark.createDataFrame([("a", '{"x": 1, "metadata": 1}'), ("b", '{"x": 1}'), ("c", "{}")], "scenario_id string, body string")
    sols = spark.createDataFrame([("a", '{"y": 1, "metadata": 1}'), ("b", '{"x": 2}')], "scenario_id string, body string")
    good, bad = records.assemble(tasks, sols)
    assert [r.scenario_id for r in good.collect()] == ["a"] and rows(bad) == [("b", "repeated_keys: x"), ("c", "missing_solution")]
    out = str(tmp_path / "results")
    m = spark.createDataFrame([(1, "M01", 1.0), (1, "M02", 0.5)], "run_id long, metric_id string, score double")
    records.write_results(m, out)
    records.write_results(m.where("metric_id = 'M01'").withColumn("score", F.lit(0.0)), out)
    assert rows(spark.read.parquet(out).select("metric_id", "score")) == [("M01", 0.0), ("M02", 0.5)]
    assert records.markdown(m.select("metric_id", "score")).first().line == "| M01 | 1.000 |"


def test_filtered_search(spark):
    cells = spark.createDataFrame([(1, "t", i, c, v) for i, row in (("r1", ("10", "x")), ("r2", ("9", "x")), ("r3", ("100", "y"))) for c, v in zip(("n", "s"), row, strict=True)], "run_id long, tbl string, identity string, column string, value string")
    filters = spark.createDataFrame([("find", "a", "n", "gte", "least", None, "integer"), ("find", "b", "s", "eq", None, "x", "string")], "tool string, rule string, column string, op string, arg string, constant string, type string")
    calls = spark.createDataFrame([(1, 5, "find", "t"), (1, 6, "find", "t"), (1, 7, "find", "t")], "run_id long, call_seq long, tool string, tbl string")
    args = spark.createDataFrame([(1, 5, "least", "10"), (1, 6, "least", "many")], "run_id long, call_seq long, name string, value string")
    limits = spark.createDataFrame([("find", 1)], "tool string, most int")
    got = search.filtered_search(calls, args, filters, cells, limits)
    assert rows(got.select("call_seq", "identity")) == [(5, "r1"), (7, "r1")]


def test_argument_facets(spark):
    e = spark.createDataFrame([(1, 0, "t", "a", "1", None), (1, 0, "t", "b", " x", "string"), (1, 1, "t", None, None, None), (1, 2, "u", "a", "1", None)], "run_id long, idx int, tool string, name string, value string, type string")
    args = spark.createDataFrame([(1, 5, "a", "1.0"), (1, 5, "b", "x"), (1, 4, "a", "2"), (1, 4, "b", "x")], "run_id long, call_seq long, name string, value string")
    tried = spark.createDataFrame([(1, "t", 4, "ok"), (1, "t", 5, "ok"), (1, "u", 9, "error")], "run_id long, tool string, call_seq long, outcome string")
    m = facets.argument_match(e, args, tried)
    assert rows(m.select("idx", "matched")) == [(0, True), (1, True), (2, False)] and m.where("idx = 0").first().call_seq == 5
    runs = spark.createDataFrame([(1,), (2,)], "run_id long")
    f = facets.combine([("argument_value", m.select("run_id", F.col("matched").alias("passed"))), ("error_recovery", m.limit(0).select("run_id", F.col("matched").alias("passed")))], runs)
    assert rows(facets.pass_rate(f).select("run_id", "status")) == [(1, "measured"), (2, "N/A")]


def test_contract_tables(spark):
    turns = spark.sql("SELECT 's' AS scenario_id, array(named_struct('kind','utterance','actor','user','text','hi','tool',cast(null as string)), named_struct('kind','tool_call','actor','operator','text',null,'tool','a'), named_struct('kind','tool_result','actor','tool','text',null,'tool','a'), named_struct('kind','utterance','actor','operator','text','fee','tool',null), named_struct('kind','tool_call','actor','operator','text',null,'tool','b')) AS turns")
    ideal = contracts.ideal_conversation(turns)
    assert rows(ideal.select("turn", "idx")) == [(0, 0), (1, 1), (3, 2), (4, 3)]
    d = contracts.disclosure_deadline(ideal, spark.createDataFrame([("s", "d", 3), ("s", "e", 4)], "scenario_id string, disclosure_id string, turn int"))
    assert {r.disclosure_id: (r.deadline_idx, r.deadline_tool) for r in d.collect()} == {"d": (3, "b"), "e": (None, None)}
    gold = spark.sql("SELECT 's' AS scenario_id, array(named_struct('tool','a','arguments','{}'), named_struct('tool','b','arguments','{}')) AS calls")
    trace = contracts.expected_trace(gold, spark.createDataFrame([("s", 1, "boom")], "scenario_id string, idx int, error string"))
    assert rows(trace.select("idx", "tool", "outcome")) == [(0, "a", "ok"), (1, "b", "error")]
    f = spark.createDataFrame([("t", "x", "o", "c1"), ("t", "y", "o", "c1"), ("t", "y", "o", "c2")], "tool string, name string, tbl string, column string")
    cols = spark.createDataFrame([("o", "c1", "date"), ("o", "c2", "string")], "tbl string, column string, type string")
    own = spark.createDataFrame([("t", "x", "string"), ("t", "y", "string"), ("t", "z", "integer")], "tool string, name string, type string")
    good, clash = contracts.argument_contracts(f, f.limit(0), cols, own)
    assert rows(good) == [("t", "x", "c1", "date"), ("t", "z", "z", "integer")] and rows(clash) == [("t", "y")]
    ids = contracts.measurement_contract(spark.createDataFrame([("s",), ("r",)], "scenario_id string"), spark.createDataFrame([("M01",), ("M04",)], "metric_id string"), "text")
    assert ids.select("instance_id").distinct().count() == 4
    own = contracts.owners(spark.createDataFrame([(1, "x", 5, 2), (1, "x", 9, 1), (1, "x", 8, 1)], "run_id long, alias string, seq long, priority int"))
    assert own.first().seq == 8
    q = spark.createDataFrame([(1, "yes", i, f"q{i}") for i in range(5)] + [(1, "decoy", 0, "d")], "run_id long, kind string, priority int, question_id string")
    assert contracts.first_wins(q, 3).count() == 4
    clocks = contracts.clock_receipt(spark.createDataFrame([(1, "a", 5), (1, "a", 9), (2, "a", 1), (2, "b", 2), (3, None, 1)], "run_id long, clock_id string, monotonic_ns long"))
    assert rows(clocks.select("run_id", F.coalesce("reason", F.lit("")))) == [(1, ""), (2, "several clocks"), (3, "clock missing")]


def test_typed_containment(spark):
    checks = [
        ("会議は2024年2月3日です", "2024-02-03", "", "date", True), ("２月３日に", "2024-02-03", "", "date", True), ("2月13日に", "2024-02-03", "", "date", False), ("二月三日", "2024/2/3", "birthdate", "", True), ("2024-02-30", "2024-02-30", "", "date", True),
        ("14:05から", "14:05", "", "time", True), ("１４時５分", "14:05", "", "time", True), ("14時", "14:00", "", "time", True), ("じゅうよじ", "14:00", "", "time", False), ("午後二時五分", "14:05", "", "time", True), ("夜の8時", "20:00", "", "time", True), ("24時", "14:00", "", "time", False),
        ("2月3日の14時です", "2024-02-03 14:00", "", "text", True), ("2月3日の15時です", "2024-02-03 14:00", "", "text", False),
        ("合計1,200円", "1200", "", "integer", True), ("12000円", "1200", "", "integer", False), ("1.5", "1", "", "number", True), ("十二名", "12", "", "integer", True), ("二十二名", "2", "", "integer", False), ("さんじゅう", "30", "", "integer", True), ("00", "0", "", "integer", False),
        ("tel 03-1234-5678", "0312345678", "phone", "phone", True), ("ゼロキュウゼロの1234の5678", "090-1234-5678", "phone_number", "", True),
        ("plan_a now", "plan", "", "text", True), ("いしかわ あやの", "イシカワアヤノ", "kana", "", True), ("Mail: A@B.co", "a@b.CO", "email", "", True), ("株式会社「ジェイ」商事", "株式会社ジェー商事", "", "", True),
        ("スタンダードにします", "スタンダード20", "plan_name", "", True), ("スタンダード30で", "スタンダード20", "plan_name", "", False), ("スタン", "スタンダード20", "plan_name", "", False), ("スタンダードにします", "スタンダード20", "name", "", False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(checks)], "i int, t string, v string, c string, k string, want boolean")
    wrong = df.where(ft.holds_typed("t", "v", "c", "k") != F.col("want"))
    assert [(r.t, r.v) for r in wrong.collect()] == []
    k = spark.createDataFrame([("キャンセルは三日前まで、手数料1,500円。18:30",)], "t string").select(ft.core_keywords(F.col("t")).alias("k")).first().k
    assert k == ["3日", "1500円", "1830", "キャンセル"]
    assert ft.NUMBER_FORMS[20] == ["にじゅう", "ニジュウ", "20", "二十"] and {"〇", "零"} < set(ft.NUMBER_FORMS[0]) and len(ft.NUMBER_FORMS) == 60
    t = spark.createDataFrame([("A-b、ｃ。/_x",)], "t string").select(ft.interaction_text(F.col("t")).alias("x"))
    assert t.first().x == "abｃx"


def test_recorded_provenance(spark):
    args = spark.createDataFrame([(1, 9, "amount", "1200", "integer"), (1, 9, "name", "plan b", ""), (1, 9, "day", "2024-02-03", "date"), (1, 9, "code", "zz", ""), (1, 9, "none", None, "")], "run_id long, call_seq long, field string, value string, type string")
    source = "run_id long, seq long, path string, value string"
    got = provenance.recorded(args, spark.createDataFrame([(1, 2, "$.error.code", "zz"), (1, 10, "$.x", "plan b")], source), spark.createDataFrame([(1, 3, "content", "1,200円です"), (1, 1, "content", "12000")], source), spark.createDataFrame([(1, 4, "steps[0]", "2月3日")], source), spark.createDataFrame([(1, "domain.rule", "the plan b rule")], "run_id long, path string, value string"))
    assert rows(got.select("field", "source_kind", F.coalesce("source_seq", F.lit(-9)))) == [("amount", "customer_utterance", 3), ("code", "tool_result", 2), ("day", "sop_step", 4), ("name", "domain_policy", -1), ("none", "not_applicable", -9)]


def test_five_successes(spark):
    e = spark.createDataFrame([(1, 1, "tool_call", "a", None), (1, 2, "tool_call", "a", None), (1, 3, "tool_result", "a", None), (1, 4, "tool_result", "a", True), (1, 5, "tool_call", "a", None)], "run_id long, seq long, event_type string, tool string, ok boolean")
    assert rows(attempts.next_result_ok(e).select("seq", "ok")) == [(1, False), (2, False), (5, False)]
    assert rows(attempts.next_result_ok(e.where("seq <> 3")).select("seq", "ok")) == [(1, True), (2, True), (5, False)]


def test_run_outcomes_and_failures(spark):
    r = spark.createDataFrame([(1, ["ok", None]), (2, ["run_failed: max_turns hit"]), (3, ["run_failed: ConnectionClosedError", "max_turns"]), (4, []), (5, None)], "i int, reasons array<string>")
    assert rows(r.select("i", report.run_outcome(F.col("reasons")))) == [(1, "終話到達"), (2, "上限打ち切り"), (3, "測定エラー"), (4, "終話到達"), (5, "終話到達")]
    assert r.select(report.run_outcome(F.col("reasons"), F.lit(True)).alias("o")).distinct().collect()[0].o == "上限打ち切り"
    f = spark.createDataFrame([(1, "TimeoutError", "asr timed out"), (2, "X", "request timed out"), (3, "X", "bad json"), (4, "WebSocket", "TTS"), (5, "ValueError", "boom"), (6, None, "tts")], "i int, t string, m string")
    assert rows(f.select("i", report.failure_class(F.col("t"), F.col("m")))) == [(1, "asr_failure"), (2, "timeout_failure"), (3, "judge_or_controller_json_failure"), (4, "transport_failure"), (5, "runtime_failure"), (6, "tts_failure")]
    d = spark.createDataFrame([("htl-001",), ("zzz-9",), ("plain",)], "s string").select(report.domain_of(F.col("s")).alias("d"))
    assert [x.d for x in d.collect()] == ["hotel", "zzz", "plain"]
