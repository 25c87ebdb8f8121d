"""Queries over the other tables: state logs, text rules, ranking, judgements, values and signals."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audio, judge, provenance, retrieval, state, values
from ..operators.common import parts
from .traces import TRACE_SQL, table, traces

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- orders and their lines as business state and its change log -------------------------------------

STATE = """WITH init AS (SELECT o_custkey AS run_id, 'orders' AS tbl, CAST(o_orderkey AS VARCHAR) AS identity, unnest(['status', 'price']) AS "column", unnest(['open', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)]) AS value FROM orders),
chg AS (SELECT o_custkey AS run_id, CAST(l_orderkey AS VARCHAR) AS identity, row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_partkey) AS seq, l_returnflag AS flag, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cells AS (SELECT run_id, tbl, identity, "column", -1 AS seq, value FROM init UNION ALL SELECT run_id, 'orders', identity, 'status', seq, flag FROM chg UNION ALL SELECT run_id, 'orders', identity, 'last_amount', seq, amount FROM chg),
fin AS (SELECT run_id, tbl, identity, "column", arg_max(value, seq) AS value FROM cells GROUP BY ALL)
"""


def order_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, li = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey"), F.col("o_totalprice")), table(spark, sf_dir, "lineitem")
    # both are dealt by run alike, and early: what follows goes by run, and long rows of maps are never shuffled
    n = parts(o, li)
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint").cast("string")
    initial = o.repartition(n, "run_id").select("run_id", F.lit("orders").alias("tbl"), F.col("o_orderkey").cast("string").alias("identity"), F.create_map(F.lit("status"), F.lit("open"), F.lit("price"), cents("o_totalprice")).alias("values"))
    lines = li.join(o.select("run_id", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select("run_id", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_returnflag").repartition(n, "run_id")
    seq = F.row_number().over(Window.partitionBy("run_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")).cast("bigint")
    changes = lines.select("run_id", seq.alias("seq"), F.lit("update").alias("operation"), F.lit("orders").alias("tbl"), F.col("l_orderkey").cast("string").alias("identity"), F.create_map(F.lit("status"), F.col("l_returnflag"), F.lit("last_amount"), cents("l_extendedprice")).alias("after"))
    return initial, changes


def initial_cells(initial: DataFrame) -> DataFrame:
    return initial.select(*state.KEY, F.explode("values").alias("column", "value"))


@query(STATE + 'SELECT run_id, tbl, identity, "column", value FROM fin')
def fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fold_changes(*order_log(spark, sf_dir))


@query(STATE + """SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.identity, b.identity) AS identity, coalesce(a."column", b."column") AS "column", b.value AS before, a.value AS after, CASE WHEN b.run_id IS NULL THEN 'created' WHEN a.run_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM fin a FULL JOIN init b ON a.run_id = b.run_id AND a.identity = b.identity AND a."column" = b."column" WHERE a.value IS DISTINCT FROM b.value""")
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    initial, changes = order_log(spark, sf_dir)
    return state.state_diff(initial_cells(initial), state.fold_changes(initial, changes)).drop("tbl")


@query(STATE + """, r AS (SELECT run_id, identity, string_agg('"' || "column" || '":"' || value || '"', ',' ORDER BY "column") AS line FROM fin GROUP BY ALL)
SELECT run_id, sha256('{"orders":[' || string_agg('{"row_identity":"' || identity || '","values":{' || line || '}}', ',' ORDER BY identity) || ']}') AS state_sha256 FROM r GROUP BY 1""")
def state_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.state_hash(state.fold_changes(*order_log(spark, sf_dir)))


@query(STATE + """, runs AS (SELECT DISTINCT o_custkey AS run_id FROM orders), n AS (SELECT run_id, count(*) FILTER (WHERE flag = 'R') AS r, count(*) FILTER (WHERE flag = 'A') AS a, count(*) FILTER (WHERE flag = 'N') AS n FROM chg GROUP BY 1)
SELECT run_id, CAST(coalesce(CAST(n.r = 0 AS INT), 1) + coalesce(CAST(n.a = 0 AS INT), 1) AS BIGINT) AS missing, CAST(coalesce(CAST(n.n > 0 AND run_id % 7 = 0 AS INT), 0) AS BIGINT) AS forbidden,
CASE WHEN coalesce(n.n > 0 AND run_id % 7 = 0, false) THEN 'forbidden_change' WHEN coalesce(n.r = 0, true) OR coalesce(n.a = 0, true) THEN 'incomplete' ELSE 'complete' END AS outcome FROM runs LEFT JOIN n USING (run_id)""")
def completion_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, changes = order_log(spark, sf_dir)
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id")).distinct()
    want = lambda name, flag, who: who.select("run_id", F.lit(name).alias("mutation_id"), F.lit("update").alias("operation"), F.lit("orders").alias("tbl"), F.create_map(F.lit("status"), F.lit(flag)).alias("after"))
    required = want("returned", "R", runs).unionByName(want("accepted", "A", runs))
    return state.completion(changes, required, want("open", "N", runs.where(F.col("run_id") % 7 == 0)), runs)


# --- texts -------------------------------------------------------------------------------------------

@query("""WITH b AS (SELECT conv_id, turn, role AS actor, coalesce(text, '') AS text FROM conversations),
s AS (SELECT conv_id, left(regexp_extract(text, '[A-Za-z]{5,}', 0), 5) AS value FROM b WHERE turn = 0 AND regexp_extract(text, '[A-Za-z]{5,}', 0) <> ''),
u AS (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM b WHERE actor = 'user'),
o AS (SELECT u.conv_id, u.turn AS said_seq, nx, value FROM u JOIN s USING (conv_id) WHERE contains(u.text, value))
SELECT o.conv_id, said_seq, count(b.turn) AS n_turns, coalesce(bool_or(contains(b.text, value)), false) AS read_back FROM o LEFT JOIN b ON b.conv_id = o.conv_id AND b.actor = 'assistant' AND b.turn > said_seq AND (nx IS NULL OR b.turn < nx) GROUP BY ALL""")
def readback_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "operator").otherwise(F.col("role")).alias("actor"), F.coalesce("text", F.lit("")).alias("text"))
    word = F.left(F.regexp_extract("text", "[A-Za-z]{5,}", 0), F.lit(5))
    slots = c.where("seq = 0").select("run_id", F.lit("s").alias("slot_id"), word.alias("value")).where("value != ''")
    return values.read_backs(c, slots).select(F.col("run_id").alias("conv_id"), "said_seq", "n_turns", "read_back")


@query("""WITH g AS (SELECT item_id, list_distinct([substr(x, i, 2) FOR i IN range(1, length(x))]) AS grams FROM (SELECT item_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS x FROM benchmark)),
d AS (SELECT page_id, list_distinct([substr(x, i, 2) FOR i IN range(1, length(x))]) AS grams FROM (SELECT page_id, lower(regexp_replace(url, '[^\\p{L}\\p{N}]+', '', 'g')) AS x FROM pages)),
o AS (SELECT item_id, page_id, len(list_intersect(g.grams, d.grams)) AS overlap FROM g, d), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, page_id) AS rank FROM o WHERE overlap > 0)
SELECT item_id AS query_id, page_id AS text_id, overlap, rank FROM r WHERE rank <= 4""")
def bigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    t = table(spark, sf_dir, "pages").select(F.col("page_id").alias("text_id"), F.col("url").alias("text"))
    return retrieval.bigram_rank(q, t, 4, ratio=False)


@query()
def ratio_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the similarity ratio, which SQL lacks."""
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("query"))
    t = table(spark, sf_dir, "pages").select(F.col("page_id").alias("text_id"), F.col("url").alias("text"))
    return retrieval.bigram_rank(q, t, 4)


# --- judgements --------------------------------------------------------------------------------------


@query("""WITH j AS (SELECT conv_id AS run_id, count(*) FILTER (WHERE role = 'user') % 2 = 0 AS even, max(turn) AS last FROM conversations GROUP BY 1)
SELECT run_id, 'M15' AS metric_id, (CAST(NOT even AS INT) + CAST(last % 3 <> 0 AS INT)) / 2.0::DOUBLE AS rate, CAST(2 AS BIGINT) AS n, CASE WHEN NOT even AND last % 3 <> 0 THEN 'pass' ELSE 'fail' END AS status FROM j""")
def judge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions a conversation, answered by a stub: polite (odd number of customer turns) and
    complete (evidence within its bound)."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").cast("bigint").alias("seq"), "role")
    runs = c.groupBy("run_id").agg((F.count_if(F.col("role") == "user") % 2 == 0).alias("even"), F.max("seq").alias("last"))
    tasks = runs.select("run_id", F.explode(F.array(F.lit("q1"), F.lit("q2"))).alias("question_id"), F.lit("M15").alias("metric_id"), F.lit("yes").alias("expected"), F.col("last").alias("bound_seq"))
    given = runs.select("run_id", F.explode(F.array(F.struct(F.lit("q1").alias("question_id"), F.when(F.col("even"), "no").otherwise("yes").alias("answer"), F.col("last").alias("at")), F.struct(F.lit("q2").alias("question_id"), F.lit("yes").alias("answer"), F.when(F.col("last") % 3 == 0, F.col("last") + 5).otherwise(F.col("last")).alias("at")))).alias("g")).select("run_id", "g.*")
    given = given.select("run_id", "question_id", "answer", F.array(F.format_string("conversation[%04d]", F.col("at"))).alias("refs"))
    evidence = c.select("run_id", F.format_string("conversation[%04d]", F.col("seq")).alias("ref"), "seq").distinct()
    return judge.score(judge.validate(given, tasks, evidence))


@query("""WITH r AS (SELECT conv_id, sha256(string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY 1),
c AS (SELECT h, conv_id % 2 AS raw FROM r WHERE conv_id % 3 = 0)
SELECT request_hash, kind, n FROM (SELECT h AS request_hash, 'hit' AS kind, count(*) AS n FROM r WHERE h IN (SELECT h FROM c) GROUP BY 1
UNION ALL SELECT DISTINCT h, 'open', CAST(1 AS BIGINT) FROM r WHERE h NOT IN (SELECT h FROM c) UNION ALL SELECT h, 'clash', count(DISTINCT raw) FROM c GROUP BY 1 HAVING count(DISTINCT raw) > 1)""")
def judge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against a cache of a third of the runs: answered ones, open ones (each once), and requests
    with two responses."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat_ws(":", "role", F.coalesce("text", F.lit("")))
    r = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("request"))
    r = r.select("conv_id", F.sha2("request", 256).alias("request_hash"))
    cache = r.where("conv_id % 3 = 0").select("request_hash", F.sha2((F.col("conv_id") % 2).cast("string"), 256).alias("raw_hash"), F.lit("{}").alias("parsed"))
    hits, open_, clash = judge.against_cache(r, cache)
    counted = hits.groupBy("request_hash").agg(F.count("*").alias("n")).withColumn("kind", F.lit("hit"))
    return counted.unionByName(open_.select("request_hash", F.lit(1).cast("bigint").alias("n"), F.lit("open").alias("kind"))).unionByName(clash.withColumn("kind", F.lit("clash")))


def _stub(request: str) -> str:
    asked = json.loads(request)
    refs = [e["ref"] for e in asked["evidence"] if "the" in e["text"]]
    return json.dumps({"judgements": [{"question_id": q["question_id"], "answer": "yes" if refs and "politely" in q["question"] else "no", "evidence": [{"ref": r, "description": "said"} for r in refs]} for q in asked["questions"]]})


@query("""WITH r AS (SELECT conv_id AS run_id, string_agg(DISTINCT 'conversation[' || lpad(CAST(turn AS VARCHAR), 4, '0') || ']', ',' ORDER BY 'conversation[' || lpad(CAST(turn AS VARCHAR), 4, '0') || ']') FILTER (WHERE contains(text, 'the')) AS refs FROM conversations GROUP BY 1)
SELECT run_id, run_id || ':' || t AS question_id, CASE WHEN t = 'polite' AND refs IS NOT NULL THEN 'yes' ELSE 'no' END AS answer, 'answered' AS status, coalesce(refs, '') AS refs FROM r, (SELECT unnest(['polite', 'pressure']) AS t) WHERE t = 'polite' OR run_id % 2 = 1""")
def judge_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from templates, requests with their evidence in parts, a stub's replies (it cites the turns
    that hold a word), judgements merged over the parts."""
    c = table(spark, sf_dir, "conversations")
    runs = c.select(F.col("conv_id").alias("run_id"), F.when(F.col("conv_id") % 2 == 1, "hard").otherwise("baseline").alias("variant_id"), F.lit("the order").alias("topic")).distinct()
    templates = spark.createDataFrame([("polite", "M15", "Was %s handled politely?", False), ("pressure", "M16", "Did pressure on %s change it?", True)], "template_id string, metric_id string, text string, hard_only boolean")
    evidence = c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.format_string("conversation[%04d]", F.col("turn")).alias("ref"), F.coalesce("text", F.lit("")).alias("text"))
    tasks = judge.questions(runs, templates)
    reqs = judge.requests(tasks, evidence, 4000)
    replies = judge.ask(reqs.where("fits and has_evidence"), _stub)
    return judge.over_parts(judge.judgements(replies, reqs), reqs, tasks).select("run_id", "question_id", "answer", "status", F.array_join(F.array_sort("refs"), ",").alias("refs"))


# --- values and signals ------------------------------------------------------------------------------


@query(TRACE_SQL + """, x AS (SELECT run_id, epoch_us(ts) * 1000 AS ns, CASE WHEN event_type = 'message' AND actor = 'user' THEN 'customer_received' WHEN event_type = 'tool_call' THEN 'response_started' WHEN event_type = 'tool_result' THEN 'playback' END AS kind, tool AS segment FROM t),
s AS (SELECT * FROM x WHERE kind = 'response_started')
SELECT s.run_id, s.segment, s.ns AS started_ns, s.ns - (SELECT max(ns) FROM x WHERE x.run_id = s.run_id AND kind = 'customer_received' AND x.ns < s.ns) AS waited_ns, (SELECT min(ns) FROM x WHERE x.run_id = s.run_id AND x.segment = s.segment AND kind = 'playback' AND x.ns > s.ns) - s.ns AS until_play_ns FROM s""")
def latency_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    kind = F.when((F.col("event_type") == "message") & (F.col("actor") == "user"), "customer_received").when(F.col("event_type") == "tool_call", "response_started").when(F.col("event_type") == "tool_result", "playback")
    e = t.select("run_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"), kind.alias("kind"), F.col("tool").alias("segment"))
    p = audio.latency_probes(e)
    return p.select("run_id", "segment", "started_ns", (F.col("started_ns") - F.col("received_ns")).alias("waited_ns"), (F.col("played_ns") - F.col("started_ns")).alias("until_play_ns"))


@query(TRACE_SQL + """, x AS (SELECT run_id, epoch_us(ts) * 1000 AS ns, CASE WHEN event_type = 'message' AND actor = 'user' THEN 'customer_received' WHEN event_type = 'tool_call' THEN 'response_started' WHEN event_type = 'tool_result' THEN 'playback' END AS kind, tool AS segment FROM t),
s AS (SELECT run_id, ns AS t0, ((SELECT min(ns) FROM x WHERE x.run_id = r.run_id AND x.segment = r.segment AND kind = 'playback' AND x.ns > r.ns) - (SELECT max(ns) FROM x WHERE x.run_id = r.run_id AND kind = 'customer_received' AND x.ns < r.ns)) / 1e6 AS ms FROM x r WHERE kind = 'response_started')
SELECT run_id, t0 AS started_ns, CASE WHEN ms IS NULL THEN 'N/M' WHEN ms + 36000000 <= 720000000 THEN 'passed' WHEN ms - 36000000 > 720000000 THEN 'failed' ELSE 'N/M' END AS status FROM s""")
def latency_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies against 200 hours (the events are days apart), ten hours uncertain."""
    t = traces(spark, sf_dir)
    kind = F.when((F.col("event_type") == "message") & (F.col("actor") == "user"), "customer_received").when(F.col("event_type") == "tool_call", "response_started").when(F.col("event_type") == "tool_result", "playback")
    e = t.select("run_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"), kind.alias("kind"), F.col("tool").alias("segment"))
    return audio.latency_status(audio.latency_probes(e), 720000000.0, 36000000.0).select("run_id", "started_ns", "status")


@query(TRACE_SQL + """, s AS (SELECT run_id, min(arg) AS value FROM t WHERE event_type = 'message' AND actor = 'user' GROUP BY 1),
h AS (SELECT c.run_id, c.k % 9 <> 0 AS known, c.k % 23 = 0 AS gap FROM t c JOIN s ON s.run_id = c.run_id AND s.value = c.arg WHERE c.event_type = 'tool_call')
SELECT run_id, CASE WHEN NOT bool_or(gap) THEN avg(CAST(known AS INT)) END AS rate, CASE WHEN bool_or(gap) THEN 'N/M' WHEN avg(CAST(known AS INT)) = 1.0 THEN 'pass' ELSE 'fail' END AS status FROM h GROUP BY 1""")
def grounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    slots = t.where((F.col("event_type") == "message") & (F.col("actor") == "user")).groupBy("run_id").agg(F.min("arg").cast("string").alias("value"))
    args = t.where(F.col("event_type") == "tool_call").select("run_id", F.lit("arg").alias("field"), F.col("arg").cast("string").alias("value"), F.when(F.col("k") % 23 == 0, None).when(F.col("k") % 9 != 0, "user").otherwise("unknown").alias("source_kind"))
    return values.grounded(args, slots)


@query("""WITH p AS (SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events) SELECT event_id, CAST(0 AS INT) AS ord, '$.k' AS path, 'number' AS kind, CAST(k AS VARCHAR) AS value FROM p""")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.leaves(table(spark, sf_dir, "events"), "props", ["event_id"])
