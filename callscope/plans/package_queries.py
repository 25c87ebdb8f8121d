"""Queries over gold dialogues and traces: projections, contracts derived from them, evidence, questions,
records in JSON, and the streaming forms run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sketch
from ..operators import attempts, contracts, facets, judge, order, provenance, report, sequence, state
from ..operators.common import matched
from ..sources import records
from ..streaming import live
from .rule_queries import at, words
from .trace_queries import WANT, expected_of, paired, results_of, runs_of
from .traces import TRACE_SQL, table, traces
from .value_queries import orders_by, text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- events ---------------------------------------------------------------------------------------------


@query(TRACE_SQL + """, ev AS (SELECT *, CASE WHEN k = 13 THEN 'post_call' WHEN k % 2 = 0 THEN 'call' END AS epoch, CASE WHEN k = 17 THEN 'post_session_ticket' ELSE event_type END AS kind FROM t)
SELECT run_id, count(*) FILTER (WHERE coalesce(epoch, 'call') = 'call') AS in_call, count(*) FILTER (WHERE kind <> 'post_session_ticket') AS before_ticket, count(*) FILTER (WHERE tool IS NOT NULL AND tool NOT IN ('search_docs', 'open_doc')) AS domain FROM ev GROUP BY 1""")
def event_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both notions of the call's events, and attempts of domain tools."""
    t = traces(spark, sf_dir)
    e = t.withColumn("epoch", F.when(F.col("k") == 13, "post_call").when(F.col("k") % 2 == 0, "call")).withColumn("event_type", F.when(F.col("k") == 17, "post_session_ticket").otherwise(F.col("event_type")))
    n = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    parts = [n(attempts.call_epoch(e), "in_call"), n(attempts.before_ticket(e), "before_ticket"), n(attempts.domain_attempts(e.where("tool is not null")), "domain")]
    out = t.select("run_id").distinct()
    for p in parts:
        out = out.join(p, "run_id", "left")
    return out.select("run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_call", "before_ticket", "domain")])


@query(TRACE_SQL + """, x AS (SELECT run_id, tool, seq, k % 5 AS j FROM t WHERE event_type = 'tool_result'), c AS (SELECT run_id, tool, seq, (SELECT arg_min(ok, seq) FROM t r WHERE r.run_id = t.run_id AND r.tool = t.tool AND r.event_type = 'tool_result' AND r.seq > t.seq) AS nx FROM t WHERE event_type = 'tool_call')
SELECT run_id, seq, j NOT IN (1, 2) AS by_metric, j NOT IN (1, 3, 4) AS by_outcome, j NOT IN (1, 4) AS by_ticket, NULL AS strictly FROM x UNION ALL SELECT run_id, seq, NULL, NULL, NULL, coalesce(nx, false) FROM c""")
def success_notions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by four notions of success (an error, a false flag, a hard fail, a false ok), and calls by
    the next result of their tool."""
    t = traces(spark, sf_dir)
    j = F.col("k") % 5
    none = F.lit(None)
    made = attempts.success_columns(F.when(j == 1, "boom"), none.cast("string"), F.when(j == 4, False), [F.when(j == 2, False).cast("boolean")], F.when(j == 3, words("hard")))
    r = t.where("event_type = 'tool_result'").select("run_id", "seq", *[made[c].alias(c) for c in ("by_metric", "by_outcome", "by_ticket")], none.cast("boolean").alias("strictly"))
    calls = attempts.next_result_ok(t).select("run_id", "seq", *[none.cast("boolean").alias(c) for c in ("by_metric", "by_outcome", "by_ticket")], F.col("ok").alias("strictly"))
    return r.unionByName(calls)


@query(TRACE_SQL + """, m AS (SELECT run_id, min(seq) AS mark FROM t WHERE event_type = 'tool_call' AND tool = 'update' GROUP BY 1) SELECT t.run_id, max(seq) AS seq FROM t JOIN m ON m.run_id = t.run_id WHERE event_type = 'message' AND actor = 'user' AND seq < mark GROUP BY 1""")
def last_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's last message before the first update."""
    t = traces(spark, sf_dir)
    marks = t.where("event_type = 'tool_call' and tool = 'update'").groupBy("run_id").agg(F.min("seq").alias("mark_seq"))
    return order.last_before(t.where("event_type = 'message' and actor = 'user'").select("run_id", "seq"), marks)


@query(TRACE_SQL + """, m AS (SELECT run_id, min(seq) AS mark FROM t WHERE event_type = 'tool_call' AND tool = 'record' GROUP BY 1) SELECT t.run_id, 'd1' AS declaration_id, bool_or(arg % 4 = 0) AS consented, count(*) AS pairs FROM t JOIN m ON m.run_id = t.run_id WHERE event_type = 'message' AND actor = 'user' AND seq < mark GROUP BY 1""")
def consent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreements with what the customer said before the deadline, and whether any of it agrees."""
    t = traces(spark, sf_dir)
    d = t.where("event_type = 'tool_call' and tool = 'record'").groupBy("run_id").agg(F.min("seq").alias("deadline_seq")).withColumn("declaration_id", F.lit("d1"))
    said = t.where("event_type = 'message' and actor = 'user'").select("run_id", "seq", F.col("arg").cast("string").alias("text"))
    pairs = judge.consent_pairs(d, said)
    n = pairs.groupBy("run_id", "declaration_id").agg(F.count("*").alias("pairs"))
    return judge.any_yes(pairs.withColumn("answer", at(F.col("text").cast("bigint"), 4, "yes", "no"))).join(n, ["run_id", "declaration_id"])


@query(TRACE_SQL + WANT + """, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, tool ORDER BY call_seq) AS j FROM att WHERE outcome = 'ok'), n AS (SELECT w.run_id, w.idx, k.call_seq FROM want w LEFT JOIN k ON k.run_id = w.run_id AND k.tool = w.tool AND k.j = 1),
l AS (SELECT w.run_id, w.idx, min(a.call_seq) AS call_seq FROM want w LEFT JOIN att a ON a.run_id = w.run_id AND a.tool = w.tool GROUP BY ALL)
SELECT w.run_id, CAST(w.idx AS INT) AS idx, CASE WHEN w.run_id % 3 = 0 THEN CAST(w.idx AS BIGINT) ELSE coalesce(n.call_seq, l.call_seq) END AS call_seq FROM want w LEFT JOIN n USING (run_id, idx) LEFT JOIN l USING (run_id, idx)""")
def aligned_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt that stands for each expected call: ordered match, else n-th success, else any."""
    t = traces(spark, sf_dir)
    e = expected_of(runs_of(t))
    a = paired(t)
    nth = sequence.nth_match(e, a).where("call_seq is not null").select("run_id", "idx", "call_seq")
    any_ = e.select("run_id", "idx", "tool").join(a.groupBy("run_id", "tool").agg(F.min("call_seq").alias("call_seq")), ["run_id", "tool"]).select("run_id", "idx", "call_seq")
    return facets.align(e, e.where(F.col("run_id") % 3 == 0).select("run_id", "idx", F.col("idx").cast("bigint").alias("call_seq")), nth, any_)


# --- gold dialogues -------------------------------------------------------------------------------------

GOLD = """WITH l AS (SELECT l_orderkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS turn, l_suppkey % 3 AS j FROM lineitem),
i AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY turn) - 1 AS idx FROM l WHERE j <> 2)"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues of utterances, tool calls and results made from order lines."""
    j = F.col("l_suppkey") % 3
    li = table(spark, sf_dir, "lineitem")
    one = F.struct("l_linenumber", "l_partkey", "l_extendedprice", F.when(j == 0, "utterance").when(j == 1, "tool_call").otherwise("tool_result").alias("kind"), F.when(j == 0, "user").alias("actor"), F.when(j == 0, "hi").alias("text"), F.when(j == 1, text("t", F.col("l_suppkey"))).alias("tool"))
    turns = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["kind"].alias("kind"), x["actor"].alias("actor"), x["text"].alias("text"), x["tool"].alias("tool")))
    return li.groupBy(F.col("l_orderkey").alias("scenario_id")).agg(turns.alias("turns"))


@query(GOLD + """, k AS (SELECT s, turn AS ct, idx AS ci FROM i WHERE j = 1), n AS (SELECT s, count(*) AS ideal FROM i GROUP BY 1)
SELECT n.s AS scenario_id, 'd' AS disclosure_id, CAST(arg_min(ci, ct) FILTER (WHERE ct > n.s % 4) AS INT) AS deadline_idx, any_value(ideal) AS ideal FROM n LEFT JOIN k ON k.s = n.s GROUP BY n.s""")
def disclosure_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ideal conversation without results, and the first tool call after a disclosure's turn."""
    ideal = contracts.ideal_conversation(gold(spark, sf_dir))
    n = ideal.groupBy("scenario_id").agg(F.count("*").alias("ideal"))
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scenario_id")).distinct().select("scenario_id", F.lit("d").alias("disclosure_id"), (F.col("scenario_id") % 4).alias("turn"))
    found = contracts.disclosure_deadline(ideal, d)
    return found.join(n, "scenario_id").select("scenario_id", "disclosure_id", F.col("deadline_idx").cast("int").alias("deadline_idx"), "ideal")


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS scenario_id, CAST(i AS INT) AS idx, 't' || i AS tool, CASE WHEN k % 3 = 0 AND i = 1 THEN 'error' ELSE 'ok' END AS outcome, k % 4 IN (1, 2) AS one_trigger FROM o, (SELECT unnest([0, 1, 2]) AS i)""")
def expected_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold calls with the outcome each should have, and whether the scenario has exactly one trigger."""
    o, k = orders_by(spark, sf_dir)
    s = o.select(k.alias("scenario_id"))
    calls = F.array(*[F.struct(F.lit(f"t{i}").alias("tool"), F.lit("{}").alias("arguments")) for i in range(3)])
    e = contracts.expected_trace(s.select("scenario_id", calls.alias("calls")), s.select("scenario_id", F.lit(1).alias("idx"), at(F.col("scenario_id"), 3, "boom", F.lit(None).cast("string")).alias("error")))
    j = F.col("scenario_id") % 4
    triggers = s.select("scenario_id", F.explode(F.array(F.struct((j >= 1).alias("active")), F.struct((j == 3).alias("active")))).alias("t")).select("scenario_id", "t.active")
    one, _ = contracts.single_trigger(triggers.where(j != 2).unionByName(s.where(j == 2).withColumn("active", F.lit(True))))
    return matched(e, one.select("scenario_id", F.lit(True).alias("_one")), ["scenario_id"], "left").select("scenario_id", "idx", "tool", "outcome", F.coalesce("_one", F.lit(False)).alias("one_trigger"))


@query("""WITH p AS (SELECT p_partkey AS k, 't' || p_partkey AS tool FROM part)
SELECT tool, 'x' AS name, CASE WHEN k % 3 = 0 THEN 'x' ELSE 'price' END AS "column", CASE WHEN k % 3 = 0 THEN 'string' ELSE 'number' END AS type FROM p WHERE k % 5 <> 0 OR k % 3 = 0 UNION ALL SELECT tool, 'x', '', 'clash' FROM p WHERE k % 5 = 0 AND k % 3 <> 0""")
def argument_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an argument feeds through filters and mutations, and those that feed columns of two types."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text("t", F.col("p_partkey")).alias("tool"))
    fed = lambda df, c: df.select("tool", F.lit("x").alias("name"), F.lit("parts").alias("tbl"), F.lit(c).alias("column"))
    columns = spark.createDataFrame([("parts", "price", "number"), ("parts", "label", "string")], "tbl string, column string, type string")
    good, clash = contracts.argument_contracts(fed(p.where("k % 3 <> 0"), "price"), fed(p.where("k % 5 = 0 and k % 3 <> 0"), "label"), columns, p.select("tool", F.lit("x").alias("name"), F.lit("string").alias("type")))
    return good.unionByName(clash.select("tool", "name", F.lit("").alias("column"), F.lit("clash").alias("type")))


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS n FROM customer) SELECT k AS scenario_id, 'p1' AS person_id, 'customer' AS relation, n AS surface FROM c UNION ALL SELECT k, 'p1', 'customer', n || '様' FROM c WHERE k % 3 <> 0 UNION ALL SELECT k, 'p2', 'self', '私' FROM c""")
def person_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    person = lambda i, r, names: F.struct(F.lit(i).alias("person_id"), F.lit(r).alias("relation"), names.alias("names"))
    names = F.array(F.col("c_name"), at(k, 3, " ", text(F.col("c_name"), "様")), F.col("c_name"))
    return contracts.persons(c.select(k.alias("scenario_id"), F.array(person("p1", "customer", names), person("p2", "self", words("私"))).alias("people")))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS run_id, CASE WHEN k % 3 = 0 THEN 8 ELSE 5 END AS seq, CAST(k % 100 AS INT) AS idx FROM o WHERE k % 2 = 0""")
def alias_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideal events that contracts refer to, each with the one event that owns the alias."""
    o, k = orders_by(spark, sf_dir)
    ref = text("conversation[", F.lpad((k % 100).cast("string"), 4, "0"), "]")
    r = contracts.referenced(o.select(k.alias("scenario_id"), F.array(at(k, 2, ref, "ticket[1]"), F.lit("conversation[x]"), at(k, 2, ref, "ticket[1]")).alias("refs")))
    cand = lambda seq, p: F.struct(F.lit(seq).alias("seq"), p.alias("priority"))
    a = o.select("run_id", F.explode(F.array(cand(5, F.lit(2)), cand(9, F.lit(2)), cand(8, at(k, 3, 1, 3)))).alias("c")).select("run_id", F.lit("a").alias("alias"), "c.*")
    return contracts.owners(a).join(r.select(F.col("scenario_id").alias("run_id"), "idx"), "run_id").select("run_id", "seq", "idx")


# --- evidence, questions and judgements -----------------------------------------------------------------


@query("""SELECT conv_id AS run_id, turn AS seq, coalesce(text, '') AS content, CASE WHEN turn % 3 = 0 THEN 1 ELSE 2 END AS transcripts FROM conversations WHERE role = 'assistant'""")
def operator_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    e = c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.lit("message").alias("event_type"), F.when(F.col("role") == "assistant", "operator").otherwise(F.col("role")).alias("actor"), F.coalesce("text", F.lit("")).alias("content"), F.array(F.lit("a"), at(F.col("turn"), 3, " ", "b")).alias("transcripts"))
    return contracts.utterances(e).select("run_id", "seq", "content", F.size("transcripts").alias("transcripts"))


@query("""WITH l AS (SELECT l_orderkey AS run_id, CASE WHEN l_suppkey % 2 = 0 THEN 'yes' ELSE 'decoy' END AS kind, l_suppkey AS p, l_partkey || '-' || l_linenumber || '-' || l_extendedprice AS q FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY p, q) AS n FROM l) SELECT run_id, kind, p AS priority FROM r WHERE n <= 2""")
def first_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two questions of each kind a run, by priority."""
    li = table(spark, sf_dir, "lineitem")
    q = li.select(F.col("l_orderkey").alias("run_id"), at(F.col("l_suppkey"), 2, "yes", "decoy").alias("kind"), F.col("l_suppkey").alias("priority"), text(F.col("l_partkey"), "-", F.col("l_linenumber"), "-", F.col("l_extendedprice")).alias("question_id"))
    return contracts.first_wins(q, 2).select("run_id", "kind", "priority")


@query(TRACE_SQL + WANT + """, n AS (SELECT w.run_id, w.idx, w.tool, count(a.n) FILTER (WHERE a.outcome = 'ok') > 0 AS ok FROM want w LEFT JOIN att a ON a.run_id = w.run_id AND a.tool = w.tool GROUP BY ALL)
SELECT run_id, 'M11' AS metric_id, tool AS violation FROM n WHERE NOT ok""")
def tool_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected tools that never succeed, as violations of their run."""
    t = traces(spark, sf_dir)
    e = expected_of(runs_of(t))
    ok = paired(t).where("outcome = 'ok'").select("run_id", "tool", F.lit(True).alias("_ok")).distinct()
    missing = e.join(ok, ["run_id", "tool"], "left").groupBy("run_id").agg(F.collect_list(F.when(F.col("_ok").isNull(), F.col("tool"))).alias("violations"))
    return facets.flat_violations(missing.withColumn("metric_id", F.lit("M11"))).select("run_id", "metric_id", "violation")


@query("""WITH c AS (SELECT conv_id AS run_id, turn AS seq, role, coalesce(text, '') AS x FROM conversations)
SELECT 'r' || run_id AS run_id, CASE WHEN run_id % 5 = 0 THEN 'failed_runtime' ELSE 'success' END AS status, seq, role AS actor, x AS content, '{"n":' || seq || '}' AS arguments FROM c""")
def parsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON text, parsed to runs and events; nested arguments stay JSON."""
    c = table(spark, sf_dir, "conversations")
    event = F.struct(F.col("turn").alias("seq"), F.col("role").alias("actor"), F.lit("message").alias("event_type"), F.coalesce("text", F.lit("")).alias("content"), F.struct(F.col("turn").alias("n")).alias("arguments"))
    r = c.groupBy("conv_id").agg(F.collect_list(event).alias("event_log"))
    body = F.to_json(F.struct(text("r", F.col("conv_id")).alias("run_id"), at(F.col("conv_id"), 5, "failed_runtime", "success").alias("status"), "event_log"))
    runs, events = records.runs_and_events(r.select(body.alias("text")))
    return events.join(runs.select("run_id", "status"), "run_id").select("run_id", "status", "seq", "actor", "content", "arguments")


@query("""SELECT '| ' || n_nationkey || ' | ' || n_name || ' | ' || replace(format('{:,.3f}', n_nationkey * 1000.5), ' ', '') || ' |' AS line FROM nation JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON s_nationkey = n_nationkey""")
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return records.markdown(n.select("n_nationkey", "n_name", (F.col("n_nationkey") * 1000.5).cast("double").alias("x")))


@query(TRACE_SQL + """SELECT run_id, CAST(3 AS BIGINT) AS leaves, 'r' || run_id AS ref, CAST(run_id AS VARCHAR) AS id, 'a' AS first_key, true AS includes FROM runs""")
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of nested payloads, those under a key, and sub-maps with nulls."""
    r = runs_of(traces(spark, sf_dir)).select("run_id")
    payload = r.select("run_id", text('{"a": [{"source_ref": "r', F.col("run_id"), '"}, {"b": {"sop_id": ', F.col("run_id"), '}}], "c": null, "d": []}').alias("p"))
    n = provenance.leaves(payload, "p", ["run_id"]).groupBy("run_id").agg(F.count("*").alias("leaves"))
    under = lambda key, name: provenance.keys_matching(payload, "p", ["run_id"], rf"\.{key}$").select("run_id", F.col("value").alias(name))
    first = provenance.leaves(payload, "p", ["run_id"]).groupBy("run_id").agg(F.substring(F.min_by("path", "ord"), 3, 1).alias("first_key"))
    held = r.select("run_id", state.includes(F.create_map(F.lit("x"), F.col("run_id").cast("string"), F.lit("y"), F.lit(None).cast("string")), F.create_map(F.lit("y"), F.lit(None).cast("string"), F.lit("x"), F.col("run_id").cast("string"))).alias("includes"))
    return n.join(under("source_ref", "ref"), "run_id").join(under("sop_id", "id"), "run_id").join(first, "run_id").join(held, "run_id").select("run_id", "leaves", "ref", "id", "first_key", "includes")


@query("""SELECT o_orderkey AS run_id, 'M01' AS metric_id, 'pass' AS status FROM orders UNION ALL SELECT o_orderkey, 'M09', 'measured' FROM orders WHERE o_orderkey % 2 = 0""")
def written_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows written by metric; a second write replaces only its own metric's rows."""
    o, k = orders_by(spark, sf_dir)
    row = lambda df, m, status: df.select("run_id", F.lit(m).alias("metric_id"), F.lit(status).alias("status"))
    folder = f"{_folder(spark)}/results"
    records.write_results(row(o, "M01", "pass").unionByName(row(o, "M09", "fail")), folder)
    records.write_results(row(o.where(k % 2 == 0), "M09", "measured"), folder)
    return spark.read.parquet(folder).select("run_id", "metric_id", "status")


@query("""SELECT o_orderkey AS run_id, n FROM orders, (SELECT unnest([1, 2]) AS n) WHERE n = 1 OR o_orderkey % 3 = 0""")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended as JSON lines, twice."""
    o, k = orders_by(spark, sf_dir)
    folder = f"{_folder(spark)}/rows"
    records.append_jsonl(o.withColumn("n", F.lit(1)), folder)
    records.append_jsonl(o.where(k % 3 == 0).withColumn("n", F.lit(2)), folder)
    return spark.read.schema("run_id bigint, n int").json(folder)


@query(TRACE_SQL + """SELECT run_id, variant_id, CASE WHEN run_id % 4 <> 3 THEN 'pass' END AS status, run_id % 4 = 3 AS unscored FROM runs""")
def facets_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the status of a facet; those without a score keep an empty one."""
    r = runs_of(traces(spark, sf_dir)).select("run_id", "variant_id")
    out = records.with_facets(r, r.where("run_id % 4 <> 3").select("run_id", F.lit("pass").alias("status")))
    return out.select("run_id", "variant_id", "status", F.col("status").isNull().alias("unscored"))


@query(None)
def metric_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric table with its bootstrap intervals (each has its own oracle)."""
    r = results_of(traces(spark, sf_dir))
    side = lambda v: F.max(F.when(F.col("variant_id") == v, F.col("score")))
    d = r.groupBy(F.col("metric_id").alias("grp"), F.col("scenario_id").alias("key")).agg((side("hard") - side("baseline")).alias("diff")).where("diff IS NOT NULL")
    return report.with_interval(report.metric_table(r), report.bootstrap(d))


# --- streaming forms, run to their end ------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/_streams/{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")


def _finish(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Run a stream over what is there and read what it wrote."""
    folder = _folder(spark)
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


#: Seconds of a slice of the events that arrive together.
SLICE = 1_296_000


def _replay(spark: SparkSession, sf_dir: str, make, start, arrival=None, idle_batches: bool = True) -> str:
    """Let the events arrive slice by slice and run the stream after each, from its checkpoint on; at the
    end heartbeats far ahead move the watermark over all of them.

    make: from the stream to what is written; start(made, folder): the started query.
    """
    folder = _folder(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("_slice", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / SLICE) if arrival is None else arrival)
    # the second one lets out what the watermark of the first has passed
    beat = spark.sql("SELECT -1L AS event_id, make_timestamp_ntz(2100, 1, id + 1, 0, 0, 0) AS ts, -1L AS user_id, 'heartbeat' AS event_type, 0D AS value, '{}' AS props, 1000000000L + id AS _slice FROM range(2)")
    e = e.unionByName(beat)
    with live.state_store(spark, idle_batches):
        for r in e.select("_slice").distinct().orderBy("_slice").collect():
            e.where(F.col("_slice") == r["_slice"]).drop("_slice").write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(e.drop("_slice").schema).parquet(f"{folder}/in")
            start(make(stream), folder).awaitTermination()
    return folder


def _append(df: DataFrame, folder: str):
    return df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()


def _live(stream: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type").isin("click", "heartbeat"), "tool_call").when(F.col("event_type").isin("purchase", "error"), "tool_result").otherwise("message")
    return stream.select(F.col("user_id").alias("run_id"), text("t", k % 6).alias("tool"), F.col("event_id").alias("seq"), kind.alias("event_type"), "ts", k.alias("k"))


LIVE = "WITH t AS (SELECT user_id AS run_id, 't' || CAST(props->>'$.k' AS INT) % 6 AS tool, event_id AS seq, CASE WHEN event_type = 'click' THEN 'tool_call' WHEN event_type IN ('purchase', 'error') THEN 'tool_result' ELSE 'message' END AS event_type, ts, CAST(props->>'$.k' AS INT) AS k FROM events)"


@query(LIVE + """, p AS (SELECT *, sum(CASE WHEN event_type = 'tool_call' THEN 1 ELSE -1 END) OVER w AS s FROM t WHERE event_type <> 'message' WINDOW w AS (PARTITION BY run_id, tool ORDER BY seq)),
m AS (SELECT *, least(0, min(s) OVER (PARTITION BY run_id, tool ORDER BY seq)) AS m FROM p), o AS (SELECT *, m < lag(m, 1, 0) OVER (PARTITION BY run_id, tool ORDER BY seq) AS fell FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, tool, event_type ORDER BY seq) AS n FROM o WHERE NOT (event_type = 'tool_result' AND fell))
SELECT c.run_id, c.tool, c.seq AS call_seq, r.seq AS result_seq, CASE WHEN r.seq IS NULL THEN 'missing_result' ELSE 'answered' END AS outcome
FROM n c LEFT JOIN n r ON c.run_id = r.run_id AND c.tool = r.tool AND c.n = r.n AND r.event_type = 'tool_result' WHERE c.event_type = 'tool_call'""")
def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call and result pairing as events arrive; timers tell of calls that stay without a result."""
    make = lambda s: live.pair_calls(_live(s).withColumns({"ts": F.col("ts").cast("timestamp"), "tool": F.coalesce("tool", F.lit("none"))}), patience="40 days")
    folder = _replay(spark, sf_dir, make, _append)
    return spark.read.schema(live.PAIR).parquet(f"{folder}/out")


@query(LIVE + """, v AS (SELECT run_id, seq AS pos, CASE WHEN k = 7 THEN seq - 500 ELSE seq END AS seq FROM t), w AS (SELECT *, max(seq) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM v) SELECT run_id, pos, seq FROM w WHERE seq <= last""")
def stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order violations as a stream, from its quarantine."""
    return _checked(spark, sf_dir).where("quarantined").select("run_id", "pos", "seq")


@query(LIVE + """, v AS (SELECT run_id, seq AS pos, CASE WHEN k = 7 THEN seq - 500 ELSE seq END AS seq FROM t), w AS (SELECT *, max(seq) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM v) SELECT run_id, pos, seq FROM w WHERE seq > coalesce(last, -10000)""")
def stream_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passes the order check as a stream."""
    return _checked(spark, sf_dir).where("NOT quarantined").select("run_id", "pos", "seq")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda s: _live(s).select("run_id", F.col("seq").alias("pos"), F.when(F.col("k") == 7, F.col("seq") - 500).otherwise(F.col("seq")).alias("seq"))
    folder = _replay(spark, sf_dir, lambda s: live.checked_order(e(s)), lambda df, f: live.split_order(df, f"{f}/out", f"{f}/state"), idle_batches=False)
    return spark.read.schema(live.CHECKED).parquet(f"{folder}/out").where("run_id >= 0")


#: Cells of the quantile sketch, as the oracle computes them.
_CELLS = """c AS (SELECT start, CASE WHEN x < 1e-6 THEN 0 ELSE greatest(ceil(ln(x / 1e-6) / ln(1.01 / 0.99)), 1)::INT END AS b, count(*) AS n FROM kept GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY start ORDER BY b) AS upto, sum(n) OVER (PARTITION BY start) AS total FROM c),
q AS (SELECT start, any_value(total)::BIGINT AS n, min(b) FILTER (upto >= ceil(total * 0.5)) AS b50, min(b) FILTER (upto >= ceil(total * 0.95)) AS b95 FROM r GROUP BY start)
SELECT start, n, CASE WHEN b50 = 0 THEN 0 ELSE pow(1.01 / 0.99, b50) * 1e-6 * 2 / (1 + 1.01 / 0.99) END::DOUBLE AS p50_ms, CASE WHEN b95 = 0 THEN 0 ELSE pow(1.01 / 0.99, b95) * 1e-6 * 2 / (1 + 1.01 / 0.99) END::DOUBLE AS p95_ms FROM q"""


@query("""WITH a AS (SELECT ts, value * 10 AS x, floor(epoch(ts) / 1296000)::BIGINT + CASE WHEN CAST(props->>'$.k' AS INT) = 7 THEN 1 ELSE 0 END AS arrival FROM events),
m AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 3 DAY AS mark FROM a GROUP BY arrival),
kept AS (SELECT (floor(epoch(ts) / 21600) * 21600)::BIGINT AS start, x FROM a JOIN m USING (arrival) WHERE mark IS NULL OR to_timestamp((floor(epoch(ts) / 21600) + 1) * 21600) > mark AT TIME ZONE 'UTC'),
""" + _CELLS)
def stream_latency_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of latency per six hours, rows arriving in slices, some a slice too late: those behind the
    watermark drop."""
    late = F.coalesce(F.get_json_object("props", "$.k").cast("int") == 7, F.lit(False)).cast("bigint")
    arrival = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / SLICE) + late
    make = lambda s: live.latency_windows(s.select(F.col("ts").cast("timestamp").alias("received_at"), (F.col("value") * 10).alias("latency_ms")), "6 hours", "3 days")
    folder = _replay(spark, sf_dir, make, _append, arrival)
    out = spark.read.schema("start timestamp, n bigint, sketch array<struct<b:int,n:bigint>>").parquet(f"{folder}/out")
    return out.select(F.unix_seconds("start").alias("start"), "n", sketch.quantile(F.col("sketch"), 0.5).alias("p50_ms"), sketch.quantile(F.col("sketch"), 0.95).alias("p95_ms"))


@query("""WITH kept AS (SELECT user_id % 7 AS start, value - 50 AS v, abs(value - 50) AS x FROM events), c AS (SELECT start, (CASE WHEN x < 1e-6 THEN 0 ELSE greatest(ceil(ln(x / 1e-6) / ln(1.01 / 0.99)), 1) END * CASE WHEN v < 0 THEN -1 ELSE 1 END)::INT AS b, count(*) AS n FROM kept GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY start ORDER BY b) AS upto, sum(n) OVER (PARTITION BY start) AS total FROM c),
q AS (SELECT start, any_value(total)::BIGINT AS n, min(b) FILTER (upto >= ceil(total * 0.25)) AS b FROM r GROUP BY start)
SELECT start AS grp, n, CASE WHEN b = 0 THEN 0 ELSE sign(b) * pow(1.01 / 0.99, abs(b)) * 1e-6 * 2 / (1 + 1.01 / 0.99) END::DOUBLE AS p25 FROM q""")
def merged_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile sketches of days, merged by group of users."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 7).alias("grp"), F.to_date("ts").alias("day"), (F.col("value") - 50).alias("v"))
    days = sketch.build(e, ["grp", "day"], F.col("v"))
    return sketch.merge(days, ["grp"]).select("grp", sketch.total(F.col("sketch")).alias("n"), sketch.quantile(F.col("sketch"), 0.25).alias("p25"))


@query(LIVE + """, r AS (SELECT run_id, seq AS turn, ts FROM t WHERE event_type = 'message' AND k % 4 <> 0) SELECT run_id, turn, (k2 % 40) * 1000.0::DOUBLE AS latency_ms FROM (SELECT run_id, turn, turn % 40 AS k2 FROM r) WHERE k2 <= 30""")
def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts joined with playbacks of up to 30 seconds later, as a stream."""
    m = _live(_stream(spark, sf_dir)).where((F.col("event_type") == "message") & (F.col("k") % 4 != 0))
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("seq") % 40).cast("decimal(18,6)"))
    received = m.select("run_id", F.col("seq").alias("turn"), F.col("ts").cast("timestamp").alias("received_at"))
    played = _live(_stream(spark, sf_dir)).where((F.col("event_type") == "message") & (F.col("k") % 4 != 0)).select("run_id", F.col("seq").alias("turn"), (F.col("ts").cast("timestamp") + wait).alias("played_at"))
    # the whole table is one burst: nothing may be late
    return _finish(spark, live.response_latency(received, played, late="100000 hours")).select("run_id", "turn", "latency_ms")


@query("SELECT user_id AS run_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed events scored by a batch function, each micro-batch under its number."""
    folder = _folder(spark)
    score = lambda batch: batch.groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    live.score_landed(_stream(spark, sf_dir), score, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("run_id").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
