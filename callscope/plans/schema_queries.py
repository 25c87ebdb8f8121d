"""Queries over documents in JSON, stored judge calls, turn probes, resampling and compared forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audio, receipts, resampling, search, state
from ..operators.common import dealt
from ..operators.document_schema import violations
from .trace_queries import RESULTS, results_of
from .traces import TRACE_SQL, table, traces

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- documents in JSON ----------------------------------------------------------------------------------

#: An order as a document: what it must be.
ORDER_SCHEMA = {
    "type": "object",
    "fields": {
        "id": {"type": "string", "required": True, "non_empty": True},
        "kind": {"type": "enum", "values": ["tool", "question", "explain"], "required": True},
        "tool": {"type": "string", "required_if": {"path": "kind", "equals": "tool"}},
        "question": {"type": "string", "required_if": {"path": "kind", "values": ["question", "explain"]}},
        "duties": {"type": "object", "fields": {"tell": {"type": ["string", "null"]}}},
        "contract": {"type": "object", "required": True, "fields": {"told": {"type": "list", "of": {"type": "string"}, "required_if": {"scope": "container_parent", "path": "duties.tell", "present": True}}}},
        "lines": {
            "type": "list",
            "required": True,
            "max_items": 6,
            "of": {
                "type": "object",
                "field_sets": [["n", "qty", "argument"], ["n", "qty", "value"]],
                "fields": {"n": {"type": "integer", "min": 1}, "qty": {"type": "number", "max": 45}, "argument": {"type": "string"}, "value": {"type": "any"}},
            },
        },
    },
}


@query("""WITH l AS (SELECT o_orderkey AS k, l_quantity AS qty, l_suppkey AS s, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
o AS (SELECT k, count(*) AS n FROM l GROUP BY k), ln AS (SELECT *, '$.lines[' || i || ']' AS p FROM l)
SELECT k AS run_id, '$' AS path, 'malformed' AS rule FROM o WHERE k % 97 = 0
UNION ALL SELECT * FROM (
  SELECT k, '$.id', 'non_empty' FROM o WHERE k % 13 = 0 UNION ALL SELECT k, '$.kind', 'enum' FROM o WHERE k % 5 = 3 UNION ALL SELECT k, '$.kind', 'required' FROM o WHERE k % 5 = 4
  UNION ALL SELECT k, '$.tool', 'required_if' FROM o WHERE k % 5 = 0 AND k % 3 = 0 UNION ALL SELECT k, '$.question', 'required_if' FROM o WHERE k % 5 IN (1, 2) AND k % 7 = 0
  UNION ALL SELECT k, '$.contract', 'required' FROM o WHERE k % 11 = 0 UNION ALL SELECT k, '$.contract.told', 'required_if' FROM o WHERE k % 11 <> 0 AND k % 4 = 0
  UNION ALL SELECT k, '$.lines', 'max_items' FROM o WHERE n > 6
  UNION ALL SELECT k, p || '.qty', 'max' FROM ln WHERE s % 9 <> 0 AND qty > 45 UNION ALL SELECT k, p || '.qty', 'type' FROM ln WHERE s % 9 = 0
  UNION ALL SELECT k, p, 'field_set' FROM ln WHERE s % 7 = 0
) WHERE k % 97 <> 0""")
def document_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as documents, every rule broken somewhere."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    s = F.col("l_suppkey")
    text = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    qty = F.when(s % 9 == 0, text(F.lit("many"))).otherwise(F.col("l_quantity").cast("double").cast("string"))
    argument = F.when((s % 2 == 0) | (s % 7 == 0), F.lit(',"argument":"a"')).otherwise("")
    value = F.when((s % 2 == 1) | (s % 7 == 0), F.lit(',"value":null')).otherwise("")
    line = F.concat(F.lit('{"n":'), F.col("l_linenumber").cast("string"), F.lit(',"qty":'), qty, argument, value, F.lit("}"))
    lines = li.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", line.alias("j")))).alias("x"))
    k = F.col("run_id")
    head = F.to_json(
        F.struct(
            F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("o"), k.cast("string"))).alias("id"),
            F.get(F.array(*map(F.lit, ["tool", "question", "explain", "other"]), F.lit(None)), (k % 5).cast("int")).alias("kind"),
            F.when(k % 3 != 0, "t").alias("tool"),
            F.when(k % 7 != 0, "q").alias("question"),
            F.struct(F.when(k % 2 == 0, "x").alias("tell")).alias("duties"),
            F.when(k % 11 != 0, F.struct(F.when(k % 4 != 0, F.array(F.lit("a"))).alias("told"))).alias("contract"),
        )
    )
    whole = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"lines":['), F.array_join(F.transform("x", lambda e: e["j"]), ","), F.when(k % 97 == 0, "").otherwise("]}"))
    docs = o.select(F.col("o_orderkey").alias("run_id")).join(lines, "run_id").select("run_id", whole.alias("doc"))
    return violations(docs, "run_id", "doc", ORDER_SCHEMA)


# --- stored judge calls ---------------------------------------------------------------------------------

BUNDLES = """WITH b AS (SELECT o_orderkey AS k, '{"q":' || o_custkey || '}' AS request, '{"a":' || o_orderkey % 3 || '}' AS raw FROM orders), f AS (SELECT DISTINCT request, raw FROM b WHERE k % 2 = 0), s AS (SELECT DISTINCT request, raw FROM b),
n AS (SELECT request, count(DISTINCT raw) AS r FROM s GROUP BY 1) """


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.lit("judge").alias("namespace"), F.concat(F.lit('{"q":'), F.col("o_custkey").cast("string"), F.lit("}")).alias("request"), F.concat(F.lit('{"a":'), (F.col("o_orderkey") % 3).cast("string"), F.lit("}")).alias("raw_response"), F.lit("{}").alias("parsed"), F.lit(None).cast("string").alias("metadata"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    """A fresh store after two writes, the second with all bundles, and what both said."""
    name, b = f"receipts_{uuid.uuid4().hex}", _bundles(spark, sf_dir)
    first = receipts.write(b.where("k % 2 = 0").drop("k"), name)
    return name, first, receipts.write(b.drop("k"), name)


@query(BUNDLES + """SELECT 2 AS turn, CASE WHEN f.raw IS NOT NULL THEN 'stored' WHEN n.r > 1 THEN 'second_response' ELSE 'written' END AS outcome, count(*) AS n FROM s LEFT JOIN f USING (request, raw) JOIN n USING (request) GROUP BY ALL
UNION ALL SELECT 1, CASE WHEN r > 1 THEN 'second_response' ELSE 'written' END, count(*) FROM f JOIN (SELECT request, count(DISTINCT raw) AS r FROM f GROUP BY 1) USING (request) GROUP BY ALL""")
def receipts_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles written twice: what is stored stays, and a request's further response is told."""
    _, first, second = _stored(spark, sf_dir)
    said = lambda df, i: df.groupBy("outcome").agg(F.count("*").alias("n")).select(F.lit(i).alias("turn"), "outcome", "n")
    return said(first, 1).unionByName(said(second, 2))


@query(BUNDLES + """, a AS (SELECT c_custkey AS k, '{"q":' || c_custkey || '}' AS request FROM customer)
SELECT CASE WHEN r IS NULL THEN 'open' WHEN r > 1 THEN 'ambiguous' ELSE 'hit' END AS outcome, count(*) AS n, count(*) FILTER (WHERE r = 1) AS parsed FROM a LEFT JOIN n USING (request) GROUP BY 1""")
def receipts_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's request looked up."""
    name, _, _ = _stored(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit('{"q":'), F.col("c_custkey").cast("string"), F.lit("}")).alias("request"))
    return receipts.lookup(asked, name, "judge").groupBy("outcome").agg(F.count("*").alias("n"), F.count("parsed").alias("parsed"))


@query("""WITH b AS (SELECT DISTINCT '{"q":' || o_custkey || '}' AS request, '{"a":' || o_orderkey % 3 || '}' AS raw, o_custkey FROM orders), h AS (SELECT *, 'sha256:' || sha256(request) AS rq, 'sha256:' || sha256(raw) AS rr, 'sha256:' || sha256('{}') AS p, 'sha256:' || sha256('null') AS m FROM b)
SELECT 'sha256:' || sha256('{"metadata_hash":"' || m || '","parsed_hash":"' || p || '","raw_response_hash":"' || rr || '","request_hash":"' || rq || '"}') AS receipt_id, CASE WHEN o_custkey % 10 = 0 THEN 'altered' ELSE 'intact' END AS outcome FROM h""")
def receipts_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored bundle replayed; the responses of some have been tampered with."""
    name = f"receipts_{uuid.uuid4().hex}"
    made = receipts.receipts(_bundles(spark, sf_dir).drop("k")).dropDuplicates(["receipt_id"])
    bad = F.get_json_object("request", "$.q").cast("long") % 10 == 0
    made.withColumn("raw_response", F.when(bad, '{"a":"forged"}').otherwise(F.col("raw_response"))).repartition(receipts.BUCKETS, "request_hash").write.bucketBy(receipts.BUCKETS, "request_hash").saveAsTable(name)
    return receipts.replay(made.select("receipt_id"), name).select("receipt_id", "outcome")


# --- turn probes ----------------------------------------------------------------------------------------

POLICY = {"stop_latency_max_ms": 20.0, "response_latency_max_ms": 25.0, "resume_latency_max_ms": 30.0, "pause_hold_min_ms": 20.0, "clock_uncertainty_max_ms": 4.0}


@query("""WITH l AS (SELECT l_orderkey AS run_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS probe_id, l_quantity::DOUBLE AS ms, l_suppkey AS s, l_orderkey % 6 AS u, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
k AS (SELECT *, CASE s % 5 WHEN 0 THEN 'stop' WHEN 1 THEN 'response' WHEN 2 THEN 'resume' WHEN 3 THEN 'pause_hold' END AS kind, CASE s % 5 WHEN 0 THEN 20 WHEN 1 THEN 25 WHEN 2 THEN 30 WHEN 3 THEN 20 END AS b, greatest(0, ms - u) AS lo, ms + u AS hi FROM l WHERE n = 1),
r AS (SELECT run_id, probe_id, CASE WHEN s % 11 = 0 THEN 'probe_opportunity_not_present' WHEN s % 7 = 0 THEN 'turn_control_classification_mismatch' WHEN kind IS NULL THEN 'turn_control_classification_matches' WHEN u > 4 THEN 'clock_uncertainty_exceeds_policy'
  WHEN kind = 'pause_hold' THEN CASE WHEN lo >= b THEN 'hold_interval_meets_minimum' WHEN hi < b THEN 'hold_interval_below_minimum' ELSE 'clock_uncertainty_crosses_latency_threshold' END
  WHEN hi <= b THEN 'latency_interval_within_maximum' WHEN lo > b THEN 'latency_interval_exceeds_maximum' ELSE 'clock_uncertainty_crosses_latency_threshold' END AS reason FROM k)
SELECT run_id, probe_id, reason, CASE WHEN reason LIKE 'probe%' THEN 'N/A' WHEN reason LIKE 'clock%' THEN 'N/M' WHEN reason LIKE '%mismatch' OR reason LIKE '%exceeds_maximum' OR reason LIKE '%below%' THEN 'failed' ELSE 'passed' END AS status FROM r""")
def turn_probe_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe a line, of every kind of latency, against a policy and an uncertain clock."""
    li = table(spark, sf_dir, "lineitem")
    name = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    li = dealt(li.select(F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "run_id")
    li = li.select("run_id", name.alias("probe_id"), F.col("l_quantity").cast("double").alias("ms"), F.col("l_suppkey").alias("s"))
    once = li.groupBy("run_id", "probe_id").agg(F.first("ms").alias("ms"), F.first("s").alias("s"), F.count("*").alias("n")).where("n = 1")
    s = F.col("s")
    kind = F.get(F.array(*map(F.lit, ["stop", "response", "resume", "pause_hold"]), F.lit(None)), (s % 5).cast("int"))
    probes = once.select("run_id", "probe_id", (s % 11 != 0).alias("applicable"), F.when(s % 7 == 0, "stop").otherwise("go").alias("expected_control"), F.concat("probe_id", F.lit(":a")).alias("observed_control_event_id"), kind.alias("latency_kind"), F.concat("probe_id", F.lit(":a")).alias("start_event_id"), F.concat("probe_id", F.lit(":b")).alias("end_event_id"))
    at = lambda end, ms: F.struct(F.concat("probe_id", F.lit(end)).alias("event_id"), (ms * 1_000_000).cast("bigint").alias("ns"), F.lit("go").alias("control"))
    events = once.select("run_id", F.inline(F.array(at(":a", F.lit(0)), at(":b", F.col("ms")))))
    clocks = li.select("run_id", (F.col("run_id") % 6 * 1_000_000).alias("uncertainty_ns")).distinct()
    return audio.turn_probes(probes, events, clocks, POLICY).select("run_id", "probe_id", "status", "reason")


# --- resampling -----------------------------------------------------------------------------------------


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda v: F.max(F.when(F.col("variant_id") == v, F.col("score")))
    return results_of(traces(spark, sf_dir)).groupBy(F.col("metric_id").alias("grp"), F.col("scenario_id").alias("key")).agg((side("hard") - side("baseline")).alias("diff"))


@query(TRACE_SQL + RESULTS + """, p AS (SELECT metric_id AS grp, scenario_id, max(score) FILTER (WHERE variant_id = 'hard') - max(score) FILTER (WHERE variant_id = 'baseline') AS diff FROM res GROUP BY ALL)
SELECT grp, count(*) * 10000 AS draws, count(*) AS fewest, count(*) AS most, 10000 AS replicates, true AS brackets FROM p WHERE diff IS NOT NULL GROUP BY 1""")
def bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws of 10,000 replicates a group: n in every one of them; and the interval holds the mean."""
    d = _differences(spark, sf_dir)
    sums = resampling.replicate_sums(d)
    counted = sums.groupBy("grp").agg(F.sum("draws").alias("draws"), F.min("draws").alias("fewest"), F.max("draws").alias("most"), F.count("*").cast("int").alias("replicates"))
    mean = d.groupBy("grp").agg(F.avg("diff").alias("mean"))
    held = resampling.bootstrap(d).join(mean, "grp").select("grp", F.col("mean").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9).alias("brackets"))
    return counted.join(held, "grp")


# --- compared forms -------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey AS k FROM customer) SELECT k AS run_id, 'c' || k AS identity FROM c WHERE k % 4 <> 3""")
def search_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by phone, address, reading and date that are written otherwise in the state; a quarter asks
    for another value."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    k = F.col("run_id")
    pick = lambda *cs: F.get(F.array(*cs), (k % 4).cast("int"))
    column = pick(*map(F.lit, ["phone", "work_email", "name_kana", "birthdate"]))
    digits = F.lpad(k.cast("string"), 8, "0")
    said = pick(F.concat(F.lit("０９０ー"), digits), F.concat(F.lit(" USER"), k.cast("string"), F.lit("@MAIL.jp ")), F.lit("たなか　はな"), F.lit("2024/2/3"))
    kept = pick(F.concat(F.lit("090-"), digits), F.concat(F.lit("user"), k.cast("string"), F.lit("@mail.jp")), F.lit("タナカハナ"), F.lit("2024-02-04"))
    calls = c.select("run_id", F.lit(1).alias("call_seq"), column.alias("tool"), F.lit("people").alias("tbl"))
    args = c.select("run_id", F.lit(1).alias("call_seq"), F.lit("value").alias("name"), said.alias("value"))
    cells = c.select("run_id", F.lit("people").alias("tbl"), F.concat(F.lit("c"), k.cast("string")).alias("identity"), column.alias("column"), kept.alias("value"))
    filters = spark.createDataFrame([(t, "r", t, "eq", "value", None, "string") for t in ("phone", "work_email", "name_kana", "birthdate")], "tool string, rule string, column string, op string, arg string, constant string, type string")
    limits = spark.createDataFrame([(t, 3) for t in ("phone", "work_email", "name_kana", "birthdate")], "tool string, most int")
    return search.filtered_search(calls, args, filters, cells, limits).select("run_id", "identity")


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS missing, 0::BIGINT AS forbidden, CASE WHEN o_orderkey % 3 = 0 THEN 'incomplete' ELSE 'complete' END AS outcome FROM orders""")
def completion_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required changes that were made in another notation, or, for a third, with another value."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    k = F.col("run_id")
    row = lambda phone, day: F.create_map(F.lit("phone"), phone, F.lit("visit_date"), day)
    base = o.select("run_id", F.lit("update").alias("operation"), F.lit("t").alias("tbl"))
    number = F.concat(F.lit("03-"), k.cast("string"))
    wrong = F.when(k % 3 == 0, "2024-01-02").otherwise("２０２４年１月１日")
    changes = base.withColumn("after", row(F.concat(F.lit("０３"), k.cast("string")), wrong))
    required = base.withColumns({"mutation_id": F.lit("m"), "after": row(number, F.lit("2024-01-01"))})
    forbidden = base.withColumns({"mutation_id": F.lit("f"), "after": row(number, F.lit("2020-01-01"))})
    return state.completion(changes, required, forbidden, o)
