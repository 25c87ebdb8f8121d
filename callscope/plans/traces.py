"""Traces projected from the events table, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOOLS = ["search_docs", "open_doc", "verify", "lookup", "update", "record"]
EXPECTED = ["verify", "lookup", "update", "record"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, scenario_id, variant_id, domain, seq, event_type, actor, tool, ok, trigger, doc_id, arg."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select(F.col("user_id").alias("run_id"), "event_id", "ts", F.col("event_type").alias("et"), "value", k.alias("k"))
    e = e.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")).cast("bigint"))
    scenario = F.floor(F.col("run_id") / 2).cast("bigint")
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.col("k") % 6 + 1).cast("int"))
    return e.select(
        "run_id",
        scenario.alias("scenario_id"),
        F.when(F.col("run_id") % 2 == 0, "baseline").otherwise("hard").alias("variant_id"),
        F.concat(F.lit("d"), (scenario % 4).cast("string")).alias("domain"),
        "seq",
        "event_id",
        "ts",
        F.when(F.col("et").isin("view", "signup"), "message").when(F.col("et") == "click", "tool_call").otherwise("tool_result").alias("event_type"),
        F.when((F.col("et") == "signup") | ((F.col("et") == "view") & (F.col("k") % 2 == 0)), "user").when(F.col("et").isin("view", "click"), "operator").otherwise("tool").alias("actor"),
        F.when(F.col("et").isin("click", "purchase", "error"), tool).alias("tool"),
        F.when(F.col("et") == "purchase", True).when(F.col("et") == "error", False).alias("ok"),
        F.when((F.col("et") == "signup") & (F.col("k") < 10), "pressure").alias("trigger"),
        (F.col("k") % 20).cast("int").alias("doc_id"),
        F.floor("value").cast("bigint").alias("arg"),
        F.col("k"),
    )


#: The same projection for the oracle; queries add their own common table expressions after it.
TRACE_SQL = """
WITH e AS (
  SELECT user_id, event_id, ts, event_type AS et, value, CAST(props->>'$.k' AS INT) AS k,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM events),
t AS (
  SELECT user_id AS run_id, CAST(floor(user_id / 2) AS BIGINT) AS scenario_id,
    CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'hard' END AS variant_id,
    'd' || CAST(CAST(floor(user_id / 2) AS BIGINT) % 4 AS VARCHAR) AS domain, seq, event_id, ts,
    CASE WHEN et IN ('view', 'signup') THEN 'message' WHEN et = 'click' THEN 'tool_call' ELSE 'tool_result' END AS event_type,
    CASE WHEN et = 'signup' THEN 'user' WHEN et = 'view' AND k % 2 = 0 THEN 'user' WHEN et IN ('view', 'click') THEN 'operator' ELSE 'tool' END AS actor,
    CASE WHEN et IN ('click', 'purchase', 'error') THEN
      CASE k % 6 WHEN 0 THEN 'search_docs' WHEN 1 THEN 'open_doc' WHEN 2 THEN 'verify' WHEN 3 THEN 'lookup' WHEN 4 THEN 'update' ELSE 'record' END END AS tool,
    CASE WHEN et = 'purchase' THEN true WHEN et = 'error' THEN false END AS ok,
    CASE WHEN et = 'signup' AND k < 10 THEN 'pressure' END AS "trigger",
    CAST(k % 20 AS INT) AS doc_id, CAST(floor(value) AS BIGINT) AS arg, k
  FROM e),
pe AS (
  SELECT *, sum(CASE WHEN event_type = 'tool_call' THEN 1 ELSE -1 END) OVER (PARTITION BY run_id, tool ORDER BY seq) AS s
  FROM t WHERE tool IS NOT NULL),
pm AS (SELECT *, least(0, min(s) OVER (PARTITION BY run_id, tool ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS m FROM pe),
po AS (SELECT *, m < lag(m, 1, 0) OVER (PARTITION BY run_id, tool ORDER BY seq) AS fell FROM pm),
pn AS (SELECT *, row_number() OVER (PARTITION BY run_id, tool, event_type ORDER BY seq) AS n FROM po WHERE NOT (event_type = 'tool_result' AND fell)),
att AS (
  SELECT c.run_id, c.scenario_id, c.variant_id, c.domain, c.tool, c.n, c.seq AS call_seq, r.seq AS result_seq, c.arg AS arg, c.doc_id AS doc_id, c.ts AS call_ts, r.ts AS result_ts, r.ok AS ok, r.arg AS result_arg,
    CASE WHEN r.seq IS NULL THEN 'missing_result' WHEN r.ok THEN 'ok' ELSE 'error' END AS outcome
  FROM pn c LEFT JOIN pn r ON c.run_id = r.run_id AND c.tool = r.tool AND c.n = r.n AND r.event_type = 'tool_result'
  WHERE c.event_type = 'tool_call'),
runs AS (SELECT DISTINCT run_id, scenario_id, variant_id, domain FROM t)
"""
