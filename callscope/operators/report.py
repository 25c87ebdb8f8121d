"""Scores, tables and intervals over metric results."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dim

STATUSES = ("pass", "fail", "measured", "N/M", "N/A", "contract_invalid")
PERFECT = 0.999
REPLICATES = 10_000


#: Metrics whose pass or fail is graded by the row's rate, metrics of the hard variant alone, metrics of the
#: audio category, and statuses that don't apply: fixed values.
GRADED = ("M14", "M15", "M19")
HARD_ONLY = ("M04", "M19")
AUDIO_CATEGORY = ("M20", "M22", "M23", "M25", "M26")
NOT_APPLICABLE = ("N/A", "not_applicable")


def entity_score(status: Column, rate: Column, metric: Column, graded: tuple[str, ...] = GRADED) -> Column:
    """Score of a metric row: pass 1, fail 0, for graded metrics the row's rate if it has one; measured
    its rate; not measurable and invalid contracts score 0 and stay in the denominator; not applicable is
    null."""
    unknown = F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(status, F.lit("null"))))
    verdict = (status == "pass").cast("double")
    return (
        F.when(status.isin("pass", "fail"), F.when(metric.isin(*graded), F.coalesce(rate, verdict)).otherwise(verdict))
        .when(status == "measured", F.coalesce(rate, F.lit(0.0)))
        .when(status.isin("N/M", "contract_invalid"), F.lit(0.0))
        .when(status == "N/A", F.lit(None).cast("double"))
        .otherwise(unknown.cast("double"))
    )


def _side(variant: str, of=F.max) -> Column:
    return of(F.when(F.col("variant_id") == variant, F.col("score")))


def metric_table(results: DataFrame, hard_only: tuple[str, ...] = HARD_ONLY) -> DataFrame:
    """Per metric: mean per variant, mean paired difference, pairs, N/A and N/M counts. A metric of the hard
    variant alone has no baseline and no difference; its n_pairs are its hard scores.

    results: scenario_id, variant_id, metric_id, status, score.
    """
    pairs = results.groupBy("metric_id", "scenario_id").agg(_side("baseline").alias("b"), _side("hard").alias("h"))
    paired = pairs.groupBy("metric_id").agg(F.avg(F.col("h") - F.col("b")).alias("mean_diff"), F.count(F.col("h") - F.col("b")).alias("n_pairs"))
    plain = results.groupBy("metric_id").agg(_side("baseline", F.avg).alias("baseline"), _side("hard", F.avg).alias("hard"), _side("hard", F.count).alias("_n"), F.count_if(F.col("status") == "N/A").alias("n_na"), F.count_if(F.col("status") == "N/M").alias("n_nm"))
    alone = F.col("metric_id").isin(*hard_only)
    out = plain.join(paired, "metric_id").withColumn("n_pairs", F.when(alone, F.col("_n")).otherwise(F.col("n_pairs"))).drop("_n")
    return out.withColumns({c: F.when(~alone, F.col(c)) for c in ("baseline", "mean_diff")})


def category_table(results: DataFrame, members: DataFrame) -> DataFrame:
    """Means per variant, mean paired difference, pairs and published value per category. A run's category
    score is the mean of its non-null scores; each side's mean is over all its runs, the difference over
    pairs.

    members: category, metric_id, rule. The published value is, by rule, 'perfect': the share of pairs
    whose score is perfect in both variants; 'mean': the mean of both sides' means, each as printed (three
    digits); 'hard': the hard mean, and such a category has no baseline, its n are its hard runs.
    """
    runs = results.join(dim(members), "metric_id").groupBy("category", "rule", "scenario_id", "variant_id").agg(F.avg("score").alias("score"))
    scenarios = runs.groupBy("category", "rule", "scenario_id").agg(_side("baseline").alias("b"), _side("hard").alias("h"))
    b, h = F.col("b"), F.col("h")
    both = (b >= PERFECT) & (h >= PERFECT)
    out = scenarios.groupBy("category", "rule").agg(F.avg("b").alias("baseline"), F.avg("h").alias("hard"), F.avg(h - b).alias("mean_diff"), F.count(h - b).alias("n"), F.count("h").alias("_n"), F.avg(F.when((h - b).isNotNull(), both.cast("double"))).alias("_perfect"))
    sides = F.filter(F.array(F.bround("baseline", 3), F.bround("hard", 3)), lambda x: x.isNotNull())
    mean = F.bround(F.try_divide(F.aggregate(sides, F.lit(0.0), lambda a, x: a + x), F.size(sides)), 3)
    hard = F.col("rule") == "hard"
    published = F.when(hard, F.col("hard")).when(F.col("rule") == "mean", mean).otherwise(F.col("_perfect"))
    out = out.withColumn("published", published).withColumn("n", F.when(hard, F.col("_n")).otherwise(F.col("n")))
    out = out.withColumns({c: F.when(~hard, F.col(c)) for c in ("baseline", "mean_diff")})
    return out.select("category", "published", "baseline", "hard", "mean_diff", "n")


def facet_table(facets: DataFrame, optional: str = "error_recovery") -> DataFrame:
    """Pass rate per facet; what doesn't apply stays outside, and a missing status counts 0 except for the
    optional facet, which it leaves out.

    facets: run_id, facet, status.
    """
    absent = F.col("status").isin(*NOT_APPLICABLE) | (F.col("status").isNull() & (F.col("facet") == optional))
    value = F.when(~F.coalesce(absent, F.lit(False)), F.coalesce(F.col("status") == "pass", F.lit(False)).cast("double"))
    return facets.groupBy("facet").agg(F.avg(value).alias("rate"), F.count(value).alias("n"))


def audio_category(rates: DataFrame, keys: list[str], members: tuple[str, ...] = AUDIO_CATEGORY) -> DataFrame:
    """keys, rate: the mean of the category's metrics, null if one of them has none. rates: keys, metric_id,
    rate (a row a metric)."""
    ours = rates.where(F.col("metric_id").isin(*members)).groupBy(*keys).agg(F.avg("rate").alias("_mean"), F.count("rate").alias("_n"))
    return ours.select(*keys, F.when(F.col("_n") == len(members), F.col("_mean")).alias("rate"))


#: Domains by the prefix of a scenario's id: fixed values.
DOMAINS = {"htl": "hotel", "tel": "telecom", "par": "parcel", "ecf": "ec_flea"}


def domain_of(scenario_id: Column) -> Column:
    """The domain that a scenario's id begins with; an unknown prefix stands for itself."""
    prefix = F.split(scenario_id, "-")[0]
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair]), prefix), prefix)


def domain_pivot(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean score per domain, one column per metric, over the hard variant."""
    return results.where(F.col("variant_id") == "hard").groupBy("domain").pivot("metric_id", metrics).agg(F.avg("score"))


def side_table(runs: DataFrame) -> DataFrame:
    """Finished and all runs, mean customer turns and tool calls over finished runs, per variant."""
    done = F.col("finished")
    return runs.groupBy("variant_id").agg(F.count_if(done).alias("finished"), F.count("*").alias("total"), F.avg(F.when(done, F.col("turns"))).alias("mean_turns"), F.avg(F.when(done, F.col("calls"))).alias("mean_calls"))


#: Outcomes of a run, the mark of a failed one in a metric's reason, and limits: fixed values.
OUTCOMES = ("終話到達", "上限打ち切り", "測定エラー")
RUN_FAILED = "run_failed:"
LIMITS = ("max_turns", "max_tool_rounds")


def run_outcome(reasons: Column, limit_reached: Column | None = None) -> Column:
    """Finished, cut off by a limit, or a measurement error, by the reasons of a run's metric rows; a
    record that says it reached the call's limit is cut off whatever they say."""
    failures = F.filter(reasons, lambda r: F.coalesce(F.startswith(r, F.lit(RUN_FAILED)), F.lit(False)))
    cut = F.exists(failures, lambda r: F.contains(r, F.lit(LIMITS[0])) | F.contains(r, F.lit(LIMITS[1])))
    told = F.lit(False) if limit_reached is None else F.coalesce(limit_reached, F.lit(False))
    return F.when(told, OUTCOMES[1]).when(F.coalesce(F.size(failures), F.lit(0)) <= 0, OUTCOMES[0]).when(cut, OUTCOMES[1]).otherwise(OUTCOMES[2])


def audio_table(units: DataFrame) -> DataFrame:
    """Units pooled over all runs: passed / (passed + failed + not measurable); others stay outside.

    units: metric_id, status, opportunity, target. observation = sum(min(opportunity, target)) / sum(target).
    """
    counted = F.col("status").isin("passed", "failed", "N/M")
    return units.groupBy("metric_id").agg(
        F.avg(F.when(counted, (F.col("status") == "passed").cast("double"))).alias("rate"),
        F.count_if(counted).alias("n"),
        F.try_divide(F.sum(F.least("opportunity", "target")), F.sum("target")).cast("double").alias("observation"),
    )


#: Probabilities that a Poisson count of mean 1 is under 1, 2, 3 and so on.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9))
PRIME = 2147483647


def bootstrap(diffs: DataFrame, replicates: int = REPLICATES, seed: int = 7) -> DataFrame:
    """95 % interval of the mean of paired differences, per group.

    diffs: grp, key, diff. In replicate r each difference counts as often as a Poisson count of mean 1,
    drawn by an integer congruence of r and the key that any engine computes alike. Every task adds up
    its own differences, so only one row a task, group and replicate is shuffled, and no group is ever
    numbered or collected. The bounds are the order statistics at int(.025 R) and int(.975 R) - 1, from
    zero, R being the replicates that draw anything.
    """
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string"))), 1, 8), 16, 10).cast("bigint")
    # each row stands for `replicates` draws, so even few rows are worth spreading
    parts = int(diffs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = diffs.select("grp", "diff", (digest % (PRIME - 1) + 1).alias("_h")).repartition(parts, "_h")
    # from zero, the hash being positive; a constant array would be built and read outside generated code
    d = d.select("grp", "diff", "_h", F.explode(F.sequence(F.least("_h", F.lit(0)), F.lit(replicates - 1))).alias("r"))
    x = (((F.col("r") + 1) * F.lit(1103515245)) % PRIME * F.col("_h")) % PRIME
    weight = reduce(lambda a, b: a + b, [(x >= F.lit(int(p * PRIME))).cast("int") for p in POISSON])
    d = d.select("grp", "r", "diff", weight.alias("_w"))
    means = d.groupBy("grp", "r").agg(F.try_divide(F.sum(F.col("diff") * F.col("_w")), F.sum("_w")).alias("m")).where("m IS NOT NULL")
    w = Window.partitionBy("grp")  # at most one row a replicate
    ranked = means.withColumn("k", F.row_number().over(w.orderBy(F.round("m", 9), "r")) - 1).withColumn("n", F.count("*").over(w))
    pick = lambda at: F.max(F.when(F.col("k") == at, F.col("m")))
    return ranked.groupBy("grp").agg(pick(F.floor(F.col("n") * 0.025)).alias("lo"), pick(F.floor(F.col("n") * 0.975) - 1).alias("hi"))


#: Classes of runtime failures and the words that tell them, the first match wins: fixed values.
FAILURES = (
    ("transport_failure", ("ConnectionClosedError", "BrokenPipeError", "WebSocket", "no close frame")),
    ("asr_failure", ("ASR", "asr", "transcribe", "transcript is missing")),
    ("tts_failure", ("TTS", "tts", "synthesize")),
    ("judge_or_controller_json_failure", ("JSON", "json", "schema", "could not be repaired")),
    ("timeout_failure", ("TimeoutError", "timed out", "timeout")),
)
OTHER_FAILURE = "runtime_failure"


def failure_class(error_type: Column, message: Column) -> Column:
    """The first class with a word that the failure's type or text holds."""
    text = F.concat_ws("\n", error_type, message)
    out = F.lit(OTHER_FAILURE)
    for name, words in reversed(FAILURES):
        held = F.lit(False)
        for word in words:
            held = held | F.contains(text, F.lit(word))
        out = F.when(held, name).otherwise(out)
    return out


def failed_run_rows(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per failed run and metric: N/A where the metric doesn't apply, else N/M with the cause.

    runs: run_id, variant_id, error_message; metrics: metric_id, hard_only.
    """
    every = runs.join(dim(metrics))
    absent = F.col("hard_only") & (F.col("variant_id") != "hard")
    return every.select("run_id", "metric_id", F.when(absent, "N/A").otherwise("N/M").alias("status"), F.concat(F.lit("run_failed: "), F.col("error_message")).alias("reason"))


def resolve_rows(metrics: DataFrame, runs: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per run and declared metric; what wasn't scored is N/M."""
    every = runs.select("run_id").join(dim(metrics.select("metric_id")))
    out = every.join(scored, ["run_id", "metric_id"], "left")
    return out.withColumn("reason", F.when(F.col("status").isNull(), "not scored").otherwise(F.col("reason"))).withColumn("status", F.coalesce("status", F.lit("N/M")))


def override(core: DataFrame, other: DataFrame, only_from: str | None = None) -> DataFrame:
    """Replace rows by (run_id, metric_id); with only_from, only rows that have that status."""
    o = other.select("run_id", "metric_id", F.col("status").alias("_status"), F.col("reason").alias("_reason"))
    out = core.join(o, ["run_id", "metric_id"], "left")
    take = F.col("_status").isNotNull() if only_from is None else F.col("_status").isNotNull() & (F.col("status") == only_from)
    return out.withColumns({"status": F.when(take, F.col("_status")).otherwise(F.col("status")), "reason": F.when(take, F.col("_reason")).otherwise(F.col("reason"))}).drop("_status", "_reason")


def availability(results: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per run: measured, not measurable and not applicable counts, and metrics without a row."""
    n = metrics.count()
    out = results.groupBy("run_id").agg(F.count_if(~F.col("status").isin("N/M", "N/A")).alias("measured"), F.count_if(F.col("status") == "N/M").alias("not_measurable"), F.count_if(F.col("status") == "N/A").alias("not_applicable"), F.count_distinct("metric_id").alias("_seen"))
    return out.withColumn("missing", F.lit(n) - F.col("_seen")).drop("_seen")


def run_summary(runs: DataFrame) -> DataFrame:
    """Counts, failures and wall time over all records."""
    return runs.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed_runtime").alias("failed"), F.sum("wall_time_sec").alias("wall_sec"), F.max("wall_time_sec").alias("longest_sec"))


def scenario_times(runs: DataFrame) -> DataFrame:
    """Per scenario: its runs, failures and wall time."""
    return runs.groupBy("scenario_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed_runtime").alias("failed"), F.sum("wall_time_sec").alias("wall_sec"))


def with_interval(table: DataFrame, interval: DataFrame) -> DataFrame:
    """The metric table with its interval (grp, lo, hi); metrics without pairs have none."""
    return table.join(interval.withColumnRenamed("grp", "metric_id"), "metric_id", "left")


def not_measured(results: DataFrame) -> DataFrame:
    """Rows that are not measurable, with their reason."""
    return results.where(F.col("status") == "N/M").select("run_id", "metric_id", "reason")


def audio_mode(results: DataFrame) -> DataFrame:
    """Written style doesn't apply to speech: M24 becomes N/A."""
    spoken = F.col("metric_id") == "M24"
    return results.withColumn("status", F.when(spoken, "N/A").otherwise(F.col("status"))).withColumn("reason", F.when(spoken, "audio_output_is_speech").otherwise(F.col("reason")))


def token_usage(calls: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Tokens by run over both naming schemes of providers; null until a first value."""
    return calls.groupBy(run_id).agg(F.sum(F.coalesce("prompt_tokens", "input_tokens")).alias("input_tokens"), F.sum(F.coalesce("completion_tokens", "output_tokens")).alias("output_tokens"))
