"""Queries over projected traces for alignment, searches, argument facets and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, facets, order, retrieval, search, sequence
from .trace_queries import WANT, expected_of, paired, runs_of
from .traces import TRACE_SQL, table, traces

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


@query(TRACE_SQL + WANT + """, i AS (SELECT *, row_number() OVER (PARTITION BY run_id, tool ORDER BY idx DESC) AS k, count(*) OVER (PARTITION BY run_id, tool) AS n FROM want),
c AS (SELECT run_id, tool, seq, row_number() OVER (PARTITION BY run_id, tool ORDER BY seq DESC) AS k, count(*) OVER (PARTITION BY run_id, tool) AS m FROM t WHERE event_type = 'tool_call')
SELECT i.run_id, i.tool, CAST(i.idx AS BIGINT) AS idx, c.seq FROM i JOIN c USING (run_id, tool, k) WHERE m >= n""")
def tool_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    calls = t.where("event_type = 'tool_call'").select("run_id", "seq", "tool")
    return order.anchors(expected_of(runs_of(t)), calls).select("run_id", "tool", F.col("idx").cast("bigint").alias("idx"), "seq")


@query(TRACE_SQL + """, g AS (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS k FROM t WHERE event_type = 'tool_call' AND tool = 'record'),
a AS (SELECT run_id, 10 AS idx, seq FROM g WHERE k = 1), u AS (SELECT run_id, seq, actor FROM t WHERE event_type = 'message'),
v AS (SELECT u.run_id, u.actor, u.seq, CASE WHEN a.seq IS NOT NULL AND u.seq > a.seq THEN 1 ELSE 0 END AS gap FROM u LEFT JOIN a USING (run_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, actor, gap ORDER BY seq) AS k FROM v),
i AS (SELECT r.run_id, x.idx, x.actor, CASE WHEN a.seq IS NOT NULL AND x.idx > 10 THEN 1 ELSE 0 END AS gap FROM runs r, (SELECT unnest([1, 2, 11, 12]) AS idx, unnest(['user', 'operator', 'user', 'user']) AS actor) x LEFT JOIN a ON a.run_id = r.run_id),
j AS (SELECT *, row_number() OVER (PARTITION BY run_id, actor, gap ORDER BY idx) AS k FROM i)
SELECT j.run_id, j.actor, CAST(j.idx AS BIGINT) AS idx, n.seq FROM j JOIN n USING (run_id, actor, gap, k)""")
def message_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    first = t.where("event_type = 'tool_call' AND tool = 'record'").groupBy("run_id").agg(F.min("seq").alias("seq"))
    anchored = first.select("run_id", F.lit(10).cast("bigint").alias("idx"), "seq")
    steps = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("idx"), F.lit(a).alias("actor")) for i, a in ((1, "user"), (2, "operator"), (11, "user"), (12, "user"))])).alias("s")
    ideal = runs_of(t).select("run_id", steps).select("run_id", "s.*")
    runtime = t.where("event_type = 'message'").select("run_id", "seq", "actor")
    return order.align_messages(ideal, runtime, anchored)


@query(TRACE_SQL + "SELECT run_id, tool, arg_min(call_seq, struct_pack(bad := CAST(outcome <> 'ok' AS INT), s := call_seq)) AS seq FROM att GROUP BY ALL")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = paired(traces(spark, sf_dir))
    return order.first_success_else_first(a.select("run_id", "tool", F.col("call_seq").alias("seq"), (F.col("outcome") == "ok").alias("ok")))


@query(TRACE_SQL + """, m AS (SELECT run_id, seq, 'x' || arg || 'y' AS content FROM t WHERE event_type = 'message' AND actor = 'user'), v AS (SELECT run_id, 'x' || (scenario_id * 7) % 50 || 'y' AS value FROM runs)
SELECT run_id, 'a' AS alias, min(seq) AS seq FROM m JOIN v USING (run_id) WHERE contains(content, value) GROUP BY run_id HAVING count(*) = 1""")
def declared_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    text = lambda c: F.concat(F.lit("x"), c.cast("string"), F.lit("y"))
    said = t.where("event_type = 'message' AND actor = 'user'").select("run_id", "seq", text(F.col("arg")).alias("content"))
    want = runs_of(t).select("run_id", F.lit("a").alias("alias"), text(F.col("scenario_id") * 7 % 50).alias("value"))
    return order.unique_contains(said, want)


@query("""WITH c AS (SELECT n_nationkey AS run_id, n_nationkey % 5 AS seg, (n_nationkey * 300) % 5000 AS least FROM nation),
r AS (SELECT c.run_id, s_suppkey, row_number() OVER (PARTITION BY c.run_id ORDER BY lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS rank FROM c JOIN supplier ON s_nationkey = c.run_id WHERE CAST(round(s_acctbal) AS BIGINT) >= least)
SELECT run_id, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS identity, rank FROM r WHERE rank <= 3""")
def declared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's run searches its suppliers with at least a balance; the first three by identity."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run_id"))
    s = table(spark, sf_dir, "supplier")
    balance = F.round("s_acctbal").cast("bigint").cast("string")
    cells = s.select(F.col("s_nationkey").alias("run_id"), F.lit("suppliers").alias("tbl"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("identity"), F.lit("balance").alias("column"), balance.alias("value"))
    calls = n.select("run_id", F.lit(1).alias("call_seq"), F.lit("find").alias("tool"), F.lit("suppliers").alias("tbl"))
    args = n.select("run_id", F.lit(1).alias("call_seq"), F.lit("least").alias("name"), (F.col("run_id") * 300 % 5000).cast("string").alias("value"))
    rules = spark.createDataFrame([("find", "r1", "balance", "gte", "least", None, "integer")], "tool string, rule string, column string, op string, arg string, constant string, type string")
    limits = spark.createDataFrame([("find", 3)], "tool string, most int")
    return search.filtered_search(calls, args, rules, cells, limits).select("run_id", "identity", F.col("rank").cast("bigint").alias("rank"))


@query(TRACE_SQL + WANT + """, w AS (SELECT run_id, idx, tool, (scenario_id * 7 + idx) % 5 AS v FROM want)
SELECT w.run_id, CAST(w.idx AS BIGINT) AS idx, min(a.call_seq) AS call_seq, min(a.call_seq) IS NOT NULL AS matched FROM w LEFT JOIN att a ON a.run_id = w.run_id AND a.tool = w.tool AND a.outcome = 'ok' AND a.arg % 5 = v GROUP BY ALL""")
def argument_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    a = paired(t)
    e = expected_of(runs_of(t)).select("run_id", "idx", "tool", F.lit("arg").alias("name"), ((F.col("scenario_id") * 7 + F.col("idx")) % 5).cast("string").alias("value"), F.lit("integer").alias("type"))
    args = a.select("run_id", "call_seq", F.lit("arg").alias("name"), (F.col("call_arg") % 5).cast("string").alias("value"))
    return facets.argument_match(e, args, a).select("run_id", F.col("idx").cast("bigint").alias("idx"), "call_seq", "matched")


@query(TRACE_SQL + WANT + """, n AS (SELECT w.run_id, w.tool, count(a.n) > 0 AS ok FROM want w LEFT JOIN att a ON a.run_id = w.run_id AND a.tool = w.tool AND a.outcome = 'ok' GROUP BY ALL),
f AS (SELECT run_id, bool_and(ok) AS s FROM n GROUP BY 1), r AS (SELECT run_id, bool_and(outcome <> 'error') AS s FROM att GROUP BY 1),
x AS (SELECT runs.run_id, CASE WHEN f.s THEN 1.0 ELSE 0.0 END AS a, CASE WHEN r.s IS NULL THEN NULL WHEN r.s THEN 1.0 ELSE 0.0 END AS b FROM runs LEFT JOIN f USING (run_id) LEFT JOIN r USING (run_id))
SELECT run_id, (a + coalesce(b, 0.0)) / (1 + CAST(b IS NOT NULL AS INT))::DOUBLE AS score, 'measured' AS status FROM x""")
def execution_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    a = paired(t)
    required = sequence.nth_match(expected_of(runs_of(t)), a).select("run_id", F.col("call_seq").isNotNull().alias("passed"))
    clean = a.select("run_id", (F.col("outcome") != "error").alias("passed"))
    return facets.pass_rate(facets.combine([("required_success", required), ("no_errors", clean)], runs_of(t)))


@query("""WITH b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role FROM conversations)
SELECT conv_id, turn, 'conversation[' || lpad(CAST(pos AS VARCHAR), 4, '0') || ']' AS ref, CASE WHEN role = 'assistant' THEN 'operator_utterance' WHEN role = 'tool' THEN 'tool' ELSE 'conversation' END AS kind FROM b""")
def evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "operator").otherwise(F.col("role")).alias("actor"))
    return contracts.evidence(c).select(F.col("run_id").alias("conv_id"), F.col("seq").alias("turn"), "ref", "kind")


@query("""SELECT s_suppkey AS scenario_id, m AS metric_id, 'mi-' || substr(sha256('text|' || s_suppkey || '|' || m), 1, 16) AS instance_id FROM supplier, (SELECT unnest(['M01', 'M04', 'M09']) AS m)""")
def measurement_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scenario_id"))
    metrics = spark.createDataFrame([("M01",), ("M04",), ("M09",)], "metric_id string")
    return contracts.measurement_contract(s, metrics, "text")


PLAIN = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
GRAMS = "list_distinct([substr({0}, i, 2) FOR i IN range(1, length({0}))])"


@query(f"""WITH b AS (SELECT item_id AS q, {PLAIN.format('text')} AS x FROM benchmark), g AS (SELECT q, {GRAMS.format('x')} AS grams FROM b),
p AS (SELECT page_id, split_part(url, '/', 3) AS host, {PLAIN.format('url')} AS x FROM pages), h AS (SELECT DISTINCT host, {PLAIN.format('host')} AS hx FROM p),
c AS (SELECT q, host, len(list_intersect(grams, {GRAMS.format('hx')})) AS o FROM g, h),
s AS (SELECT q, host, row_number() OVER (PARTITION BY q ORDER BY o DESC, host) AS rn FROM c WHERE o > 0),
d AS (SELECT s.q, p.host, p.page_id, len([y FOR y IN g.grams IF contains(p.x, y)]) AS o FROM s JOIN p USING (host) JOIN g ON g.q = s.q WHERE rn <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o DESC, page_id) AS rn FROM d WHERE o > 0)
SELECT q AS query_id, host AS category_id, page_id AS doc_id, o AS overlap, rn AS rank FROM r WHERE rn <= 3""")
def two_stage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts first, then the pages of the hosts that surfaced."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.split("url", "/")[2].alias("host"))
    queries_ = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    categories = pages.select(F.col("host").alias("category_id"), F.col("host").alias("title")).distinct()
    docs = pages.select(F.col("page_id").alias("doc_id"), F.col("host").alias("category_id"), F.col("url").alias("title"))
    return retrieval.two_stage(queries_, categories, docs, 3).select("query_id", "category_id", "doc_id", "overlap", F.col("rank").cast("bigint").alias("rank"))
