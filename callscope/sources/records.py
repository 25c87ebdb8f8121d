"""Run records: JSON scenario files, records and score files in, typed tables and reports out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report

PLACE = r"([^/]+)/([^/]+)/run_(\d+)/[^/]+$"


def whole_files(spark: SparkSession, roots: list[str], name: str) -> DataFrame:
    """One row per file of that name anywhere under the roots: path, text, and variant, scenario and
    run number as the path gives them."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(roots)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, PLACE, i)
    return files.select(path.alias("path"), F.col("value").alias("text"), part(1).alias("variant_id"), part(2).alias("scenario_id"), part(3).try_cast("int").alias("run_number"))


def assemble(tasks: DataFrame, solutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks joined with their solutions, and what is wrong: a missing solution, or a root key in both.

    Both: scenario_id, body (JSON text). 'metadata' may be in both and is dropped.
    """
    keys = lambda c: F.coalesce(F.array_except(F.json_object_keys(c), F.array(F.lit("metadata"))), F.array().cast("array<string>"))
    both = tasks.join(solutions.withColumnRenamed("body", "solution"), "scenario_id", "left")
    shared = F.array_intersect(keys(F.col("body")), keys(F.col("solution")))
    bad = both.select("scenario_id", F.when(F.col("solution").isNull(), "missing_solution").when(F.size(shared) > 0, F.concat(F.lit("repeated_keys: "), F.array_join(shared, ","))).alias("error")).where("error IS NOT NULL")
    return both.join(bad.select("scenario_id"), "scenario_id", "left_anti"), bad


def pick_scenarios(scenarios: DataFrame, wanted: DataFrame | None = None, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scenarios, optionally those of an id list, optionally the first N by id; and ids not found."""
    out, lost = scenarios, scenarios.select("scenario_id").limit(0)
    if wanted is not None:
        out = scenarios.join(wanted, "scenario_id", "left_semi")
        lost = wanted.join(scenarios, "scenario_id", "left_anti").select("scenario_id")
    return (out.orderBy("scenario_id").limit(first) if first is not None else out), lost


RECORD = "run_id string, scenario_id string, variant_id string, status string, wall_time_sec double, error_message string, event_log array<struct<seq:bigint,event_id:string,event_ref:string,epoch:string,actor:string,event_type:string,content:string,tool:string,arguments:string,result:string>>"


def runs_and_events(records: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Records (JSON text) as runs and events; nested arguments and results stay JSON text."""
    r = records.select(F.from_json(text_col, RECORD).alias("r")).select("r.*")
    events = r.select("run_id", "scenario_id", "variant_id", F.explode("event_log").alias("e")).select("run_id", "scenario_id", "variant_id", "e.*")
    return r.drop("event_log"), events


def repeated_scenarios(scenarios: DataFrame) -> DataFrame:
    """Scenario ids that occur more than once, which is an error."""
    return scenarios.groupBy("scenario_id").agg(F.count("*").alias("n")).where("n > 1")


def scored_or_recorded(scored: DataFrame, recorded: DataFrame) -> DataFrame:
    """Every place (variant_id, scenario_id) that has a score or a record."""
    keys = ["variant_id", "scenario_id"]
    return scored.select(*keys).union(recorded.select(*keys)).distinct()


def left_out(scenarios: DataFrame, runs: DataFrame) -> DataFrame:
    """Scenarios without a record, skipped when stored records are scored again."""
    return scenarios.join(runs, "scenario_id", "left_anti").select("scenario_id")


def with_facets(runs: DataFrame, facets: DataFrame) -> DataFrame:
    """Runs with their facet statuses; a run without a score keeps empty ones."""
    return runs.join(facets, "run_id", "left")


def score_stored(scenarios: DataFrame, runs: DataFrame, metrics: DataFrame, scores: list[DataFrame], mode: str = "text") -> tuple[DataFrame, DataFrame]:
    """Score stored runs again with every metric: one row per run and declared metric, and the scenarios
    that have no record.

    runs: run_id, scenario_id, variant_id, status, error_message; metrics: metric_id, hard_only; each of
    scores: run_id, metric_id, status, reason (from the metric's own operator). Failed runs get their
    rows from the failure alone; a metric that no operator scored is N/M; in audio mode the written
    style doesn't apply. A metric scored twice for a run is an error.
    """
    failed, done = runs.where("status = 'failed_runtime'"), runs.where("status <> 'failed_runtime'")
    every = reduce(DataFrame.unionByName, [s.select("run_id", "metric_id", "status", "reason") for s in scores])
    once = every.groupBy("run_id", "metric_id").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("a metric is scored twice for a run"))).otherwise(F.first("status")).cast("string").alias("status"), F.first("reason").alias("reason"))
    rows = report.resolve_rows(metrics, done, once).unionByName(report.failed_run_rows(failed, metrics))
    rows = rows.select("run_id", "metric_id", "status", "reason")
    return (report.audio_mode(rows) if mode != "text" else rows), left_out(scenarios, runs)


def repeated_places(files: DataFrame) -> DataFrame:
    return files.groupBy("variant_id", "scenario_id", "run_number").agg(F.count("*").alias("n")).where("n > 1")


def write_results(results: DataFrame, path: str) -> None:
    """Metric rows, partitioned by metric; only the partitions written are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric_id").parquet(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def markdown(table: DataFrame, digits: int = 3) -> DataFrame:
    """A report table as Markdown lines, numbers rounded; one row per line, in the table's order."""
    cell = lambda f: F.coalesce(F.format_number(f.name, digits) if f.dataType.simpleString() in ("double", "float") else F.col(f.name).cast("string"), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(f) for f in table.schema.fields]), F.lit(" |"))
    return table.select(line.alias("line"))


def peer_disclosures(scenarios: DataFrame) -> DataFrame:
    """Disclosures that other scenarios of the same domain require.

    scenarios: scenario_id, domain_id, disclosures (array). Counts per domain and disclosure tell which
    ones a scenario requires alone; it gets all of its domain's others, so scenarios never pair up.
    """
    d = scenarios.select("scenario_id", "domain_id", F.explode("disclosures").alias("disclosure")).where(F.col("disclosure").isNotNull()).distinct()
    held = d.groupBy("domain_id", "disclosure").agg(F.count("*").alias("n"), F.min("scenario_id").alias("scenario_id"))
    every = held.groupBy("domain_id").agg(F.collect_list("disclosure").alias("every"))
    alone = held.where("n = 1").groupBy("domain_id", "scenario_id").agg(F.collect_list("disclosure").alias("alone"))
    asked = scenarios.select("scenario_id", "domain_id").distinct().join(every, "domain_id").join(alone, ["domain_id", "scenario_id"], "left")
    others = F.array_except("every", F.coalesce("alone", F.array().cast("array<string>")))
    return asked.select("scenario_id", F.explode(others).alias("disclosure")).distinct()
