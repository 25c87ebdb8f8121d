"""Queries over projected traces: pairing, matching, order, retrieval, provenance and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attempts as at
from ..operators import order, provenance, quality, report, retrieval, sequence, tickets
from .traces import EXPECTED, TRACE_SQL, traces

RUN = ["run_id", "scenario_id", "variant_id", "domain"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else TRACE_SQL + sql
        return f

    return register


def paired(t: DataFrame) -> DataFrame:
    a = at.pair_calls(t, ["arg", "doc_id", "ts", "scenario_id", "variant_id", "domain"], ["ok", "arg", "ts"])
    return a.withColumn("outcome", at.outcome(F.col("result_ok"), F.col("result_seq")))


def runs_of(t: DataFrame) -> DataFrame:
    return t.select(*RUN).distinct()


def expected_of(runs: DataFrame) -> DataFrame:
    steps = F.posexplode(F.array(*[F.lit(x) for x in EXPECTED])).alias("idx", "tool")
    return runs.select("run_id", "scenario_id", steps).withColumn("outcome", F.lit("ok"))


@query("SELECT run_id, tool, CAST(n AS BIGINT) AS n, call_seq, result_seq, outcome FROM att")
def pair_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(traces(spark, sf_dir)).select("run_id", "tool", F.col("n").cast("bigint").alias("n"), "call_seq", "result_seq", "outcome")


GOLD = ", gold AS (SELECT run_id, CAST(unnest([(scenario_id * 3) % 10, (scenario_id * 3 + 5) % 10]) AS INT) AS doc FROM runs), opens AS (SELECT run_id, call_seq AS seq, doc_id % 10 AS doc, outcome = 'ok' AS ok FROM att WHERE tool = 'open_doc')"


def gold_and_opens(t: DataFrame, a: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = F.col("scenario_id") * 3
    gold = runs_of(t).select("run_id", F.explode(F.array((s % 10).cast("int"), ((s + 5) % 10).cast("int"))).alias("doc"))
    opens = a.where(F.col("tool") == "open_doc").select("run_id", F.col("call_seq").alias("seq"), (F.col("call_doc_id") % 10).alias("doc"), (F.col("outcome") == "ok").alias("ok"))
    return gold, opens


@query(GOLD + """,
g AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn FROM opens WHERE ok),
f AS (SELECT run_id, doc, min(rn) AS rn FROM g GROUP BY ALL),
k AS (SELECT gold.run_id, CASE WHEN count(f.rn) = count(*) THEN max(f.rn) END AS k FROM (SELECT DISTINCT * FROM gold) gold LEFT JOIN f USING (run_id, doc) GROUP BY 1)
SELECT run_id, CAST(k AS BIGINT) AS k, coalesce(1.0::DOUBLE / k, 0.0) AS score,
  coalesce((SELECT arg_min(doc, seq) FROM opens o WHERE o.run_id = k.run_id) IN (SELECT doc FROM gold WHERE gold.run_id = k.run_id), false) AS one_shot,
  coalesce((SELECT arg_max(doc, seq) FROM opens o WHERE o.run_id = k.run_id AND ok) IN (SELECT doc FROM gold WHERE gold.run_id = k.run_id), false) AS final_gold
FROM k""")
def reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    gold, opens = gold_and_opens(t, paired(t))
    return retrieval.reciprocal_rank(opens, gold, runs_of(t).select("run_id"))


@query(""", opens AS (SELECT run_id, call_seq AS seq, doc_id AS doc FROM att WHERE tool = 'open_doc' AND outcome = 'ok'),
f AS (SELECT run_id, doc, min(seq) AS opened_seq FROM opens GROUP BY ALL),
l AS (SELECT run_id, tool, max(call_seq) AS last_ok FROM att WHERE outcome = 'ok' GROUP BY ALL)
SELECT f.run_id, f.doc, opened_seq, coalesce(last_ok > opened_seq, false) AS applied
FROM f LEFT JOIN l ON f.run_id = l.run_id AND l.tool = CASE f.doc % 4 WHEN 0 THEN 'verify' WHEN 1 THEN 'lookup' WHEN 2 THEN 'update' ELSE 'record' END""")
def procedure_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = paired(traces(spark, sf_dir))
    opens = a.where(F.col("tool") == "open_doc").select("run_id", F.col("call_seq").alias("seq"), F.col("call_doc_id").alias("doc"), (F.col("outcome") == "ok").alias("ok"))
    last = opens.select("doc").distinct().withColumn("tool", F.element_at(F.array(*[F.lit(x) for x in EXPECTED]), (F.col("doc") % 4 + 1).cast("int")))
    return retrieval.procedure_applied(opens, last, a)


@query(""", c AS (SELECT run_id, seq, CASE WHEN event_type = 'tool_call' THEN tool END AS tool, "trigger" AS tr FROM t),
f AS (SELECT run_id, min(CASE WHEN tr = 'pressure' THEN seq END) AS trigger_seq, min(CASE WHEN tool = 'verify' THEN seq END) AS pre FROM c GROUP BY 1),
a AS (SELECT f.run_id, trigger_seq, pre, min(CASE WHEN tool = 'update' AND seq > trigger_seq THEN seq END) AS action_seq FROM f JOIN c USING (run_id) GROUP BY ALL)
SELECT run_id, 'e1' AS edge_id, trigger_seq, action_seq,
  CASE WHEN trigger_seq IS NULL OR action_seq IS NULL THEN 'N/A' WHEN pre <= action_seq THEN 'pass' ELSE 'fail' END AS status FROM a""")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    calls = t.select("run_id", "seq", F.when(F.col("event_type") == at.CALL, F.col("tool")).alias("tool"), "trigger")
    edges = spark.createDataFrame([("e1", "pressure", "update", ["verify"])], "edge_id string, trigger string, action_tool string, required_tools array<string>")
    return order.prerequisites(calls, edges)


@query(""", ref AS (SELECT run_id, seq, tool || ':' || event_type AS ref FROM t WHERE tool IS NOT NULL UNION ALL SELECT run_id, seq, actor || ':message' FROM t WHERE event_type = 'message'),
p AS (SELECT run_id, ref, min(seq) AS seq FROM ref GROUP BY ALL),
x AS (SELECT r.run_id, (SELECT seq FROM p WHERE p.run_id = r.run_id AND ref = 'record:tool_call') AS d, (SELECT seq FROM p WHERE p.run_id = r.run_id AND ref = 'user:message') AS c,
  (SELECT seq FROM p WHERE p.run_id = r.run_id AND ref = 'update:tool_call') AS a, (SELECT seq FROM p WHERE p.run_id = r.run_id AND ref = 'verify:tool_call') AS v,
  (SELECT seq FROM p WHERE p.run_id = r.run_id AND ref = 'operator:message') AS o FROM runs r),
y AS (SELECT run_id, v IS NOT NULL AND o IS NOT NULL AS required_present, coalesce(v < d, false) AND coalesce(o < d, false) AS deadline_met, coalesce(c < a, false) AS consent_met FROM x)
SELECT run_id, 'o1' AS obligation_id, required_present, deadline_met, consent_met, CASE WHEN required_present AND deadline_met AND consent_met THEN 'pass' ELSE 'fail' END AS status FROM y""")
def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    events = t.select("run_id", "seq", F.array(F.when(F.col("event_type") == "message", F.concat("actor", F.lit(":message"))).otherwise(F.concat_ws(":", "tool", "event_type"))).alias("refs"))
    contracts = runs_of(t).select("run_id", F.lit("o1").alias("obligation_id"), F.array(F.lit("verify:tool_call"), F.lit("operator:message")).alias("required_refs"), F.lit("record:tool_call").alias("deadline_ref"), F.lit("user:message").alias("consent_ref"), F.lit("update:tool_call").alias("action_ref"))
    return order.obligations(events, contracts)


WANT = ", want AS (SELECT run_id, scenario_id, unnest([0, 1, 2, 3]) AS idx, unnest(['verify', 'lookup', 'update', 'record']) AS tool FROM runs)"


@query(WANT + """, wk AS (SELECT *, row_number() OVER (PARTITION BY run_id, tool ORDER BY idx) AS k FROM want),
a AS (SELECT *, row_number() OVER (PARTITION BY run_id, tool ORDER BY call_seq) AS k FROM att WHERE outcome = 'ok')
SELECT wk.run_id, CAST(wk.idx AS BIGINT) AS idx, wk.tool, a.call_seq FROM wk LEFT JOIN a USING (run_id, tool, k)""")
def nth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    return sequence.nth_match(expected_of(runs_of(t)), paired(t)).select("run_id", F.col("idx").cast("bigint").alias("idx"), "tool", "call_seq")


@query(""",
s0 AS (SELECT r.run_id, min(a.call_seq) AS s FROM runs r LEFT JOIN att a ON a.run_id = r.run_id AND a.tool = 'verify' AND a.outcome = 'ok' GROUP BY 1),
s1 AS (SELECT s0.run_id, s0.s AS a0, min(a.call_seq) AS s FROM s0 LEFT JOIN att a ON a.run_id = s0.run_id AND a.tool = 'lookup' AND a.outcome = 'ok' AND a.call_seq > s0.s GROUP BY ALL),
s2 AS (SELECT s1.run_id, a0, s1.s AS a1, min(a.call_seq) AS s FROM s1 LEFT JOIN att a ON a.run_id = s1.run_id AND a.tool = 'update' AND a.outcome = 'ok' AND a.call_seq > s1.s GROUP BY ALL),
s3 AS (SELECT s2.run_id, a0, a1, s2.s AS a2, min(a.call_seq) AS s FROM s2 LEFT JOIN att a ON a.run_id = s2.run_id AND a.tool = 'record' AND a.outcome = 'ok' AND a.call_seq > s2.s GROUP BY ALL)
SELECT run_id, concat_ws(',', a0, a1, a2, s) AS seqs, s IS NOT NULL AS matched FROM s3""")
def ordered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    m = sequence.ordered_match(expected_of(runs_of(t)), paired(t).where(F.col("outcome") == "ok"))
    return m.select("run_id", F.concat_ws(",", F.col("seqs").cast("array<string>")).alias("seqs"), "matched")


@query(""", x AS (SELECT *, tool IN ('verify', 'lookup', 'update', 'record') AS want FROM att),
n AS (SELECT a.run_id, a.tool, a.call_seq, min(b.call_seq) AS retry_seq FROM x a LEFT JOIN x b ON a.run_id = b.run_id AND b.call_seq > a.call_seq AND CASE WHEN a.want THEN b.tool = a.tool ELSE b.want END WHERE a.outcome = 'error' GROUP BY ALL)
SELECT n.run_id, n.tool, n.call_seq, retry_seq, coalesce(b.outcome = 'ok', false) AS recovered FROM n LEFT JOIN x b ON b.run_id = n.run_id AND b.call_seq = n.retry_seq""")
def error_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    return sequence.natural_recovery(paired(t), expected_of(runs_of(t)))


@query(""", a AS (SELECT r.run_id, min(x.call_seq) AS error_seq FROM runs r LEFT JOIN att x ON x.run_id = r.run_id AND x.tool = 'update' AND x.outcome = 'error' GROUP BY 1),
b AS (SELECT a.run_id, error_seq, min(x.call_seq) AS recovery_seq FROM a LEFT JOIN att x ON x.run_id = a.run_id AND x.tool = 'lookup' AND x.outcome = 'ok' AND x.call_seq > error_seq GROUP BY ALL),
c AS (SELECT b.run_id, error_seq, recovery_seq, min(x.call_seq) AS retry_seq FROM b LEFT JOIN att x ON x.run_id = b.run_id AND x.tool = 'update' AND x.call_seq > recovery_seq GROUP BY ALL)
SELECT c.run_id, error_seq, recovery_seq, retry_seq, CASE WHEN error_seq IS NULL THEN 'N/A' WHEN coalesce(x.outcome = 'ok', false) THEN 'pass' ELSE 'fail' END AS status
FROM c LEFT JOIN att x ON x.run_id = c.run_id AND x.call_seq = c.retry_seq""")
def injected_error_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    injections = runs_of(t).select("run_id", F.lit("update").alias("tool"), F.lit("lookup").alias("recovery_tool"))
    return sequence.declared_recovery(paired(t), injections).select("run_id", "error_seq", "recovery_seq", "retry_seq", "status")


@query(""", c AS (SELECT run_id, tool, seq, arg % 3 <> 0 AS accepted FROM t WHERE event_type = 'tool_call'),
i AS (SELECT *, sum(CAST(accepted AS INT)) OVER (PARTITION BY run_id, tool ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM c),
s AS (SELECT *, CASE WHEN accepted THEN 0 ELSE sum(CAST(NOT accepted AS INT)) OVER (PARTITION BY run_id, tool, island ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS streak FROM i)
SELECT run_id, tool, seq, CAST(streak AS BIGINT) AS streak, streak > 2 AS hard_reject FROM s""")
def repair_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = traces(spark, sf_dir).where(F.col("event_type") == at.CALL).select("run_id", "tool", "seq", (F.col("arg") % 3 != 0).alias("accepted"))
    return sequence.rejected_streaks(calls).select("run_id", "tool", "seq", F.col("streak").cast("bigint").alias("streak"), "hard_reject")


@query(""", l AS (SELECT run_id, seq, arg FROM t WHERE event_type = 'tool_result' AND ok), u AS (SELECT run_id, seq, arg FROM t WHERE event_type = 'message' AND actor = 'user'),
c AS (SELECT run_id, seq, arg FROM t WHERE event_type = 'tool_call'),
r AS (SELECT c.run_id, c.seq, max(l.seq) AS s FROM c JOIN l ON l.run_id = c.run_id AND l.arg = c.arg AND l.seq < c.seq GROUP BY ALL),
v AS (SELECT c.run_id, c.seq, max(u.seq) AS s FROM c JOIN u ON u.run_id = c.run_id AND u.arg = c.arg AND u.seq < c.seq GROUP BY ALL)
SELECT c.run_id, c.seq AS call_seq, CASE WHEN r.s IS NOT NULL THEN 'tool_result' WHEN v.s IS NOT NULL THEN 'user' ELSE 'unknown' END AS source_kind, coalesce(r.s, v.s) AS source_seq
FROM c LEFT JOIN r USING (run_id, seq) LEFT JOIN v USING (run_id, seq)""")
def provenance_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir).withColumn("value", F.col("arg").cast("string"))
    args = t.where(F.col("event_type") == at.CALL).select("run_id", F.col("seq").alias("call_seq"), F.lit("arg").alias("field"), "value")
    leaves = t.where((F.col("event_type") == at.RESULT) & F.col("ok")).select("run_id", "seq", F.lit("$.arg").alias("path"), "value")
    says = t.where((F.col("event_type") == "message") & (F.col("actor") == "user")).select("run_id", "seq", F.lit("text").alias("path"), "value")
    return provenance.tiered(args, [("tool_result", leaves), ("user", says)]).select("run_id", "call_seq", "source_kind", "source_seq")


@query(WANT + """, m AS (SELECT w.run_id, w.idx, a.call_seq, a.result_seq, a.arg, a.result_arg FROM want w JOIN att a ON a.run_id = w.run_id AND a.tool = w.tool AND a.outcome = 'ok' AND a.n = (SELECT min(n) FROM att b WHERE b.run_id = w.run_id AND b.tool = w.tool AND b.outcome = 'ok')),
p AS (SELECT y.run_id, y.idx, y.arg, x.call_seq AS before_seq, y.call_seq, x.result_seq FROM m x JOIN m y ON x.run_id = y.run_id AND y.idx = x.idx + 1 AND x.result_arg % 5 = y.arg % 5)
SELECT p.run_id, CAST(p.idx AS BIGINT) AS idx, before_seq, call_seq, before_seq < call_seq AS passed FROM p
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.run_id = p.run_id AND t.event_type = 'message' AND t.actor = 'user' AND t.k < 20 AND t.arg % 5 = p.arg % 5 AND t.seq < p.result_seq)""")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    m = sequence.nth_match(expected_of(runs_of(t)), paired(t)).where(F.col("call_seq").isNotNull())
    a = paired(t).select("run_id", "call_seq", "result_seq", F.col("call_arg"), "result_arg")
    m = m.join(a, ["run_id", "call_seq"]).select("run_id", "idx", "call_seq", "result_seq", (F.col("call_arg") % 5).alias("value"), (F.col("result_arg") % 5).alias("result_value"))
    says = t.where((F.col("event_type") == "message") & (F.col("actor") == "user") & (F.col("k") < 20)).select("run_id", "seq", (F.col("arg") % 5).alias("value"))
    edges = sequence.dependency_edges(m, says)
    return edges.select("run_id", F.col("idx").cast("bigint").alias("idx"), "before_seq", "call_seq", "passed")


# --- reports -----------------------------------------------------------------------------------------

RESULTS = WANT + """, rs AS (SELECT w.run_id, w.scenario_id, r.variant_id, r.domain, w.tool AS metric_id, count(a.n) AS tried, count(a.n) FILTER (WHERE a.outcome = 'ok') AS good, count(a.n) FILTER (WHERE a.outcome = 'missing_result') AS lost
  FROM want w JOIN runs r USING (run_id) LEFT JOIN att a ON a.run_id = w.run_id AND a.tool = w.tool GROUP BY ALL),
res AS (SELECT run_id, scenario_id, variant_id, domain, metric_id, CASE WHEN tried = 0 THEN 'N/A' WHEN lost = tried THEN 'N/M' WHEN metric_id = 'record' THEN 'measured' WHEN good > 0 THEN 'pass' ELSE 'fail' END AS status,
  CASE WHEN tried = 0 THEN NULL WHEN lost = tried THEN 0.0 WHEN metric_id IN ('record', 'update') THEN good::DOUBLE / tried WHEN good > 0 THEN 1.0 ELSE 0.0 END AS score FROM rs)
"""


def results_of(t: DataFrame) -> DataFrame:
    """Metric rows: a tool's calls succeeded (verify, lookup), or the rate of them (record measured, update
    graded). All rows have a rate, which only these two may take."""
    a = paired(t).groupBy("run_id", "tool").agg(F.count("*").alias("tried"), F.count_if(F.col("outcome") == "ok").alias("good"), F.count_if(F.col("outcome") == "missing_result").alias("lost"))
    r = runs_of(t).select(*RUN, F.explode(F.array(*[F.lit(x) for x in EXPECTED])).alias("tool")).join(a, ["run_id", "tool"], "left")
    rated = F.col("tool") == "record"
    status = F.when(F.col("tried").isNull(), "N/A").when(F.col("lost") == F.col("tried"), "N/M").when(rated, "measured").when(F.col("good") > 0, "pass").otherwise("fail")
    r = r.withColumn("status", status).withColumn("rate", F.col("good") / F.col("tried"))
    return r.select(*RUN, F.col("tool").alias("metric_id"), "status", report.entity_score(F.col("status"), F.col("rate"), F.col("tool"), ("update",)).alias("score"))


@query(RESULTS + """, p AS (SELECT metric_id, scenario_id, max(score) FILTER (WHERE variant_id = 'baseline') AS b, max(score) FILTER (WHERE variant_id = 'hard') AS h FROM res GROUP BY ALL),
d AS (SELECT metric_id, avg(h - b) AS mean_diff, count(h - b) AS n_pairs FROM p GROUP BY 1),
m AS (SELECT metric_id, avg(score) FILTER (WHERE variant_id = 'baseline') AS baseline, avg(score) FILTER (WHERE variant_id = 'hard') AS hard, count(score) FILTER (WHERE variant_id = 'hard') AS nh,
  count(*) FILTER (WHERE status = 'N/A') AS n_na, count(*) FILTER (WHERE status = 'N/M') AS n_nm, any_value(mean_diff) AS mean_diff, any_value(n_pairs) AS n_pairs FROM res JOIN d USING (metric_id) GROUP BY 1)
SELECT metric_id, CASE WHEN metric_id <> 'lookup' THEN baseline END AS baseline, hard, n_na, n_nm, CASE WHEN metric_id <> 'lookup' THEN mean_diff END AS mean_diff, CASE WHEN metric_id = 'lookup' THEN nh ELSE n_pairs END AS n_pairs FROM m""")
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.metric_table(results_of(traces(spark, sf_dir)), ("lookup",))


#: The rule of each category, and its metrics.
CATEGORIES = [("procedure", "verify", "perfect"), ("procedure", "lookup", "perfect"), ("task", "update", "mean"), ("task", "record", "mean"), ("strain", "lookup", "hard"), ("strain", "record", "hard")]


@query(RESULTS + f""", mem AS (SELECT unnest({[c for c, _, _ in CATEGORIES]!r}) AS category, unnest({[m for _, m, _ in CATEGORIES]!r}) AS metric_id, unnest({[r for _, _, r in CATEGORIES]!r}) AS rule),
c AS (SELECT category, rule, scenario_id, variant_id, avg(score) AS score FROM res JOIN mem USING (metric_id) GROUP BY ALL),
p AS (SELECT category, rule, scenario_id, max(score) FILTER (WHERE variant_id = 'baseline') AS b, max(score) FILTER (WHERE variant_id = 'hard') AS h FROM c GROUP BY ALL),
s AS (SELECT category, rule, avg(b) AS b, avg(h) AS h, avg(h - b) AS d, count(h - b) AS n, count(h) AS nh, avg(CAST(b >= 0.999 AND h >= 0.999 AS INT)) FILTER (WHERE b IS NOT NULL AND h IS NOT NULL) AS full_ FROM p GROUP BY ALL)
SELECT category, CASE rule WHEN 'hard' THEN h WHEN 'mean' THEN round_even((round_even(b, 3) + round_even(h, 3)) / 2, 3) ELSE full_ END AS published, CASE WHEN rule <> 'hard' THEN b END AS baseline, h AS hard,
  CASE WHEN rule <> 'hard' THEN d END AS mean_diff, CASE WHEN rule = 'hard' THEN nh ELSE n END AS n FROM s""")
def category_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = spark.createDataFrame(CATEGORIES, "category string, metric_id string, rule string")
    return report.category_table(results_of(traces(spark, sf_dir)), members)


@query(RESULTS + """SELECT metric_id AS facet, avg(CASE WHEN st IN ('N/A', 'not_applicable') THEN NULL WHEN st = 'pass' THEN 1.0 ELSE 0.0 END) AS rate, count(*) FILTER (WHERE st NOT IN ('N/A', 'not_applicable')) AS n
FROM (SELECT *, CASE WHEN status = 'N/A' AND run_id % 2 = 0 THEN 'not_applicable' ELSE status END AS st FROM res) GROUP BY 1""")
def facet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = results_of(traces(spark, sf_dir)).withColumnRenamed("metric_id", "facet")
    return report.facet_table(f.withColumn("status", F.when((F.col("status") == "N/A") & (F.col("run_id") % 2 == 0), "not_applicable").otherwise(F.col("status"))))


@query(RESULTS + """, r AS (SELECT scenario_id, metric_id, avg(score) AS rate FROM res WHERE metric_id <> 'record' GROUP BY ALL) SELECT scenario_id, CASE WHEN count(rate) = 3 THEN avg(rate) END AS rate FROM r GROUP BY 1""")
def category_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a category's metrics per scenario, null where one of them has no rate."""
    rates = results_of(traces(spark, sf_dir)).groupBy("scenario_id", "metric_id").agg(F.avg("score").alias("rate"))
    return report.audio_category(rates, ["scenario_id"], ("verify", "lookup", "update"))


@query(RESULTS + """SELECT domain, avg(score) FILTER (WHERE metric_id = 'verify') AS verify, avg(score) FILTER (WHERE metric_id = 'lookup') AS lookup, avg(score) FILTER (WHERE metric_id = 'update') AS "update", avg(score) FILTER (WHERE metric_id = 'record') AS record FROM res WHERE variant_id = 'hard' GROUP BY 1""")
def domain_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.domain_pivot(results_of(traces(spark, sf_dir)), EXPECTED)


SIDE = """, rr AS (SELECT run_id, variant_id, count(*) FILTER (WHERE event_type = 'tool_result' AND NOT ok) AS bad, max(seq) AS last, count(*) FILTER (WHERE event_type = 'message' AND actor = 'user') AS turns, count(*) FILTER (WHERE event_type = 'tool_call') AS calls FROM t GROUP BY ALL),
ro AS (SELECT *, CASE WHEN last > 110 THEN '上限打ち切り' WHEN bad <= 12 THEN '終話到達' WHEN run_id % 3 = 0 THEN '上限打ち切り' ELSE '測定エラー' END AS outcome FROM rr)
"""


def run_rows(t: DataFrame) -> DataFrame:
    """Runs with the reasons of their metric rows: those with many failed results failed, some at a limit."""
    r = t.groupBy("run_id", "variant_id").agg(
        F.count_if((F.col("event_type") == at.RESULT) & ~F.col("ok")).alias("bad"),
        F.max("seq").alias("last"),
        F.count_if((F.col("event_type") == "message") & (F.col("actor") == "user")).alias("turns"),
        F.count_if(F.col("event_type") == at.CALL).alias("calls"),
    )
    cause = F.when(F.col("run_id") % 3 == 0, "run_failed: max_tool_rounds reached").otherwise("run_failed: max errors")
    r = r.withColumn("reasons", F.array(F.lit("scored"), F.lit("max_turns"), F.when(F.col("bad") > 12, cause)))
    return r.withColumn("outcome", report.run_outcome(F.col("reasons"), F.col("last") > 110)).withColumn("finished", F.col("outcome") == report.OUTCOMES[0])


@query(SIDE + "SELECT variant_id, outcome, count(*) AS n FROM ro GROUP BY ALL")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_rows(traces(spark, sf_dir)).groupBy("variant_id", "outcome").agg(F.count("*").alias("n"))


@query(SIDE + "SELECT variant_id, count(*) FILTER (WHERE outcome = '終話到達') AS finished, count(*) AS total, avg(turns) FILTER (WHERE outcome = '終話到達') AS mean_turns, avg(calls) FILTER (WHERE outcome = '終話到達') AS mean_calls FROM ro GROUP BY 1")
def side_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.side_table(run_rows(traces(spark, sf_dir)))


@query(RESULTS + """, p AS (SELECT metric_id AS grp, scenario_id AS key, max(score) FILTER (WHERE variant_id = 'hard') - max(score) FILTER (WHERE variant_id = 'baseline') AS diff FROM res GROUP BY ALL),
d AS (SELECT grp, diff, CAST('0x' || substr(md5('7:' || key), 1, 8) AS BIGINT) % 2147483646 + 1 AS h FROM p WHERE diff IS NOT NULL),
c AS (SELECT k, CAST(floor(q * 2147483647) AS BIGINT) AS cut FROM (SELECT k, sum(exp(-1) / gamma(j + 1)) AS q FROM range(9) a(k), range(9) b(j) WHERE j <= k GROUP BY 1)),
u AS (SELECT grp, diff, r, ((r + 1) * 1103515245 % 2147483647 * h) % 2147483647 AS x FROM d, range(10000) q(r)),
w AS (SELECT grp, r, diff, CASE WHEN x < 790015083 THEN 0 WHEN x < 1580030168 THEN 1 ELSE (SELECT count(*) FROM c WHERE cut <= x) END AS n FROM u),
m AS (SELECT grp, r, sum(diff * n) / sum(n) AS m FROM w WHERE n > 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(m, 9), r) - 1 AS k, count(*) OVER (PARTITION BY grp) AS n FROM m)
SELECT grp, round(max(m) FILTER (WHERE k = floor(n * 0.025)), 6) AS lo, round(max(m) FILTER (WHERE k = floor(n * 0.975) - 1), 6) AS hi FROM k GROUP BY 1""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda v: F.max(F.when(F.col("variant_id") == v, F.col("score")))
    p = results_of(traces(spark, sf_dir)).groupBy(F.col("metric_id").alias("grp"), F.col("scenario_id").alias("key")).agg((side("hard") - side("baseline")).alias("diff")).where("diff IS NOT NULL")
    return report.bootstrap(p).select("grp", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


FAILED = [("ConnectionClosedError", "no close frame"), ("RuntimeError", "transcript is missing"), ("RuntimeError", "cannot synthesize"), ("ValueError", "answer could not be repaired"), ("TimeoutError", ""), ("RuntimeError", "timed out in schema"), ("ValueError", "boom"), ("ASRError", "WebSocket")]


@query(""", m AS (SELECT run_id, variant_id, k % 8 AS j FROM t WHERE ok = false)
SELECT CASE WHEN j IN (0, 7) THEN 'transport_failure' WHEN j = 1 THEN 'asr_failure' WHEN j = 2 THEN 'tts_failure' WHEN j IN (3, 5) THEN 'judge_or_controller_json_failure' WHEN j = 4 THEN 'timeout_failure' ELSE 'runtime_failure' END AS failure, variant_id, count(*) AS n FROM m GROUP BY ALL""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of eight kinds; the oracle names their classes as the published rule does."""
    t = traces(spark, sf_dir).where(~F.col("ok"))
    told = F.element_at(F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).alias("message")) for a, b in FAILED]), F.col("k") % 8 + 1)
    t = t.withColumn("told", told)
    return t.groupBy(report.failure_class(F.col("told.type"), F.col("told.message")).alias("failure"), "variant_id").agg(F.count("*").alias("n"))


@query(SIDE + """, f AS (SELECT run_id, variant_id, 'errors' AS error_message FROM ro WHERE outcome = '測定エラー'), m AS (SELECT unnest(['M01', 'M04', 'M09']) AS metric_id, unnest([false, true, false]) AS hard_only)
SELECT run_id, metric_id, CASE WHEN hard_only AND variant_id <> 'hard' THEN 'N/A' ELSE 'N/M' END AS status, 'run_failed: ' || error_message AS reason FROM f, m""")
def failed_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = run_rows(traces(spark, sf_dir)).where(F.col("outcome") == report.OUTCOMES[2]).withColumn("error_message", F.lit("errors"))
    metrics = spark.createDataFrame([("M01", False), ("M04", True), ("M09", False)], "metric_id string, hard_only boolean")
    return report.failed_run_rows(runs, metrics)


@query(RESULTS + """SELECT run_id, count(*) FILTER (WHERE status NOT IN ('N/M', 'N/A')) AS measured, count(*) FILTER (WHERE status = 'N/M') AS not_measurable, count(*) FILTER (WHERE status = 'N/A') AS not_applicable, CAST(4 - count(DISTINCT metric_id) AS BIGINT) AS missing FROM res GROUP BY 1""")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = spark.createDataFrame([(x,) for x in EXPECTED], "metric_id string")
    return report.availability(results_of(traces(spark, sf_dir)), metrics)


# --- tickets and quality -----------------------------------------------------------------------------


@query(""", f AS (SELECT run_id, list(tool || ':' || outcome ORDER BY call_seq) AS actions, list(DISTINCT CASE WHEN outcome = 'ok' THEN 'T' || arg % 7 END) AS targets0, list(DISTINCT 'D' || doc_id) FILTER (WHERE tool = 'open_doc') AS ev FROM att GROUP BY 1),
g AS (SELECT run_id, actions, list_sort([x FOR x IN targets0 IF x IS NOT NULL]) AS targets, list_sort(coalesce(ev, [])) AS evidence FROM f)
SELECT run_id, array_to_string(actions, ',') AS actions, array_to_string(targets, ',') AS targets, array_to_string(evidence, ',') AS evidence FROM g""")
def ticket_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = paired(traces(spark, sf_dir))
    a = a.withColumn("target", F.when(F.col("outcome") == "ok", F.concat(F.lit("T"), (F.col("call_arg") % 7).cast("string")))).withColumn("evidence", F.when(F.col("tool") == "open_doc", F.concat(F.lit("D"), F.col("call_doc_id").cast("string"))))
    f = tickets.facts(a)
    text = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return f.select("run_id", F.array_join("actions", ",").alias("actions"), text("targets"), text("evidence"))


@query(""", b AS (SELECT run_id, list(tool || ':' || outcome ORDER BY call_seq) AS actions FROM att GROUP BY 1),
c AS (SELECT run_id, list(tool || ':' || CASE WHEN arg % 11 = 0 THEN 'error' ELSE outcome END ORDER BY call_seq) AS actions FROM att WHERE run_id % 5 <> 0 GROUP BY 1)
SELECT b.run_id, c.run_id IS NOT NULL AS handling_ok, c.run_id IS NOT NULL AS targets_ok, coalesce(c.actions = b.actions, false) AS actions_ok, c.run_id IS NOT NULL AS evidence_ok,
  CASE WHEN c.run_id IS NOT NULL THEN (3.0 + CAST(c.actions = b.actions AS INT)) / 4 END::DOUBLE AS score, CASE WHEN c.run_id IS NOT NULL THEN 'measured' ELSE 'N/M' END AS status FROM b LEFT JOIN c USING (run_id)""")
def ticket_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = paired(traces(spark, sf_dir)).withColumn("target", F.lit("x")).withColumn("evidence", F.lit("y"))
    wrong = a.where(F.col("run_id") % 5 != 0).withColumn("outcome", F.when(F.col("call_arg") % 11 == 0, "error").otherwise(F.col("outcome")))
    typed = lambda f: f.withColumn("handling_type", F.lit("resolved"))
    return tickets.compare(typed(tickets.facts(wrong)), typed(tickets.facts(a)))


@query(""", v AS (SELECT run_id, seq AS pos, CASE WHEN k = 7 THEN seq - 2 ELSE seq END AS seq, CASE WHEN k = 11 THEN 'later' WHEN k = 13 THEN 'post_call' END AS epoch FROM t),
w AS (SELECT *, lag(seq) OVER (PARTITION BY run_id ORDER BY pos) AS last, max(CAST(epoch = 'post_call' AS INT)) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS post FROM v)
SELECT run_id, 'seq_not_increasing' AS rule, CAST(seq AS VARCHAR) AS detail FROM w WHERE seq <= last UNION ALL SELECT run_id, 'unknown_epoch', epoch FROM w WHERE epoch = 'later'
UNION ALL SELECT run_id, 'call_after_ticket', CAST(seq AS VARCHAR) FROM w WHERE post = 1 AND coalesce(epoch, 'call') = 'call'""")
def dq_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    e = t.select("run_id", F.col("seq").alias("pos"), F.when(F.col("k") == 7, F.col("seq") - 2).otherwise(F.col("seq")).alias("seq"), F.when(F.col("k") == 11, "later").when(F.col("k") == 13, "post_call").alias("epoch"), "event_type")
    return quality.event_log(e)


@query(""", c AS (SELECT run_id, seq, tool, arg FROM t WHERE event_type = 'tool_call' AND tool IN ('lookup', 'update')),
a AS (SELECT run_id, seq, tool, CASE WHEN arg % 9 = 0 THEN 'note' ELSE 'amount' END AS name, CASE WHEN arg % 7 = 0 THEN '' WHEN arg % 5 = 0 THEN 'many' ELSE CAST(arg AS VARCHAR) END AS value FROM c),
w AS (SELECT *, CAST(seq AS VARCHAR) || ':' || name AS detail FROM a)
SELECT run_id, 'unknown_argument' AS rule, detail FROM w WHERE name = 'note' UNION ALL SELECT run_id, 'blank_argument', detail FROM w WHERE name = 'amount' AND value = ''
UNION ALL SELECT run_id, 'wrong_type', detail FROM w WHERE name = 'amount' AND NOT regexp_matches(value, '^[+-]?[0-9]+$') UNION ALL SELECT run_id, 'missing_argument', CAST(seq AS VARCHAR) || ':amount' FROM a WHERE name = 'note'""")
def dq_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = traces(spark, sf_dir).where((F.col("event_type") == at.CALL) & F.col("tool").isin("lookup", "update")).select("run_id", "seq", "tool", "arg")
    args = calls.select("run_id", "seq", "tool", F.when(F.col("arg") % 9 == 0, "note").otherwise("amount").alias("name"), F.when(F.col("arg") % 7 == 0, "").when(F.col("arg") % 5 == 0, "many").otherwise(F.col("arg").cast("string")).alias("value"))
    spec = spark.createDataFrame([(x, "amount", "integer", True, None) for x in ("lookup", "update")], "tool string, name string, type string, required boolean, enum array<string>")
    return quality.argument_violations(args, calls.drop("arg"), spec)


@query("""WITH p AS (SELECT event_id, CAST(props->>'$.k' AS INT) % 10 AS d FROM events)
SELECT event_id, 'secret_key' AS rule, CASE d WHEN 3 THEN 'Auth_API_KEY' ELSE 'x-authorization' END AS detail FROM p WHERE d IN (3, 4)""")
def secret_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with a secret's key, deep or with an empty value, and harmless ones: token counts, and the
    word inside a string."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props", (F.get_json_object("props", "$.k").cast("int") % 10).alias("d"))
    around = lambda head, tail: F.concat(F.lit(head), F.col("props"), F.lit(tail))
    payload = F.when(F.col("d") == 3, around('{"auth": [{"Auth_API_KEY": {}}], "props": ', "}")).when(F.col("d") == 4, around('{"props": ', ', "items": [{"x-authorization": 1, "access_token": 2}]}'))
    payload = payload.when(F.col("d") == 5, around('{"usage": {"prompt_tokens": 7}, "password": 1, "props": ', "}")).when(F.col("d") == 6, around('{"say": "the \\\\"api_key\\\\": is", "props": ', "}"))
    return quality.forbidden_keys(e.withColumn("payload", payload.otherwise(F.col("props"))), "payload", quality.SECRET_KEYS, "secret_key", "event_id")
