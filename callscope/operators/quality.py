"""Data-quality rules: every violation becomes a row (run_id, rule, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dim

VARIANTS = ("baseline", "hard")
#: Key fragments that name a secret, any letter case: fixed values.
SECRET_FRAGMENTS = ("authorization", "api_key", "apikey", "access_token")
SECRET_KEYS = rf"(?i){'|'.join(SECRET_FRAGMENTS)}"
OVERALL_KEYS = "^(?:overall_score|single_overall_score)$"
#: Every string of a JSON text, and whether a colon follows: only keys have one.
JSON_STRING = r'''"((?:[^"\\]|\\.)*+)"(\s*+:)?'''
DIGEST = "^sha256:[0-9a-f]{64}$"


def _rows(df: DataFrame, rule: str, broken: Column, detail: Column, key: str = "run_id") -> DataFrame:
    return df.where(F.coalesce(broken, F.lit(False))).select(F.col(key), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def event_log(events: DataFrame) -> DataFrame:
    """seq missing, repeated or not increasing in arrival order; unknown epochs; calls after the ticket.

    events: run_id, pos (arrival), seq, epoch (null: call), event_type.
    """
    w = Window.partitionBy("run_id").orderBy("pos")
    e = events.withColumn("_last", F.lag("seq").over(w)).withColumn("_post", F.max((F.col("epoch") == "post_call").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    epoch = F.coalesce("epoch", F.lit("call"))
    found = [
        _rows(e, "seq_missing", F.col("seq").isNull(), F.col("pos")),
        _rows(e, "seq_not_increasing", F.col("seq") <= F.col("_last"), F.col("seq")),
        _rows(e, "unknown_epoch", ~epoch.isin("call", "post_call"), epoch),
        _rows(e, "call_after_ticket", (F.col("_post") == 1) & (epoch == "call"), F.col("seq")),
    ]
    return reduce(DataFrame.unionByName, found)


def matches_type(value: Column, kind: Column) -> Column:
    """Whether a text is a value of a declared scalar type; booleans are never integers."""
    number = value.try_cast("double")
    return (
        F.when(kind == "integer", value.rlike(r"^[+-]?\d+$"))
        .when(kind == "number", number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))))
        .when(kind == "boolean", value.isin("true", "false"))
        .when(kind == "date", value.rlike(r"^\d{4}-\d{2}-\d{2}$") & value.try_cast("date").isNotNull())
        .when(kind == "time", value.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"))
        .otherwise(F.lit(True))
    )


def argument_violations(args: DataFrame, calls: DataFrame, tool_args: DataFrame) -> DataFrame:
    """Unknown, missing, blank, mistyped and out-of-enum arguments of calls.

    calls: run_id, seq, tool; args: run_id, seq, tool, name, value; tool_args: tool, name, type,
    required, enum (array or null).
    """
    spec = tool_args.select("tool", "name", "type", "required", "enum", F.lit(True).alias("_known"))
    given = args.join(dim(spec), ["tool", "name"], "left")
    need = calls.join(dim(spec.where("required")), "tool").select("run_id", "seq", "tool", "name")
    missing = need.join(args.select("run_id", "seq", "name"), ["run_id", "seq", "name"], "left_anti")
    where = F.concat_ws(":", F.col("seq").cast("string"), "name")
    known = F.coalesce("_known", F.lit(False))
    found = [
        _rows(given, "unknown_argument", ~known, where),
        _rows(given, "blank_argument", known & (F.trim("value") == ""), where),
        _rows(given, "wrong_type", known & ~matches_type(F.col("value"), F.col("type")), where),
        _rows(given, "not_in_enum", known & F.col("enum").isNotNull() & ~F.array_contains("enum", F.col("value")), where),
        _rows(missing, "missing_argument", F.lit(True), where),
    ]
    return reduce(DataFrame.unionByName, found)


def state_rows(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Undeclared columns, mistyped values and repeated cells. cells: run_id, tbl, identity, column,
    value; columns: tbl, column, type."""
    c = cells.join(dim(columns.withColumn("_known", F.lit(True))), ["tbl", "column"], "left")
    twice = cells.groupBy("run_id", "tbl", "identity", "column").agg(F.count("*").alias("n"))
    name = F.concat_ws(".", "tbl", "identity", "column")
    known = F.coalesce("_known", F.lit(False))
    found = [
        _rows(c, "undeclared_column", ~known, name),
        _rows(c, "wrong_type", known & F.col("value").isNotNull() & ~matches_type(F.col("value"), F.col("type")), name),
        _rows(twice, "repeated_cell", F.col("n") > 1, name),
        _rows(cells, "identity_missing", F.col("identity").isNull() | (F.col("identity") == ""), F.col("tbl")),
    ]
    return reduce(DataFrame.unionByName, found)


def forbidden_keys(payloads: DataFrame, text_col: str, pattern: str, rule: str, key: str = "run_id") -> DataFrame:
    """Payloads with a key that may not appear anywhere in them, such as SECRET_KEYS or OVERALL_KEYS;
    the detail is the first such key. The JSON text is only cut into its strings, never parsed."""
    names = F.regexp_extract_all(F.col(text_col), F.lit(JSON_STRING), F.lit(1))
    colons = F.regexp_extract_all(F.col(text_col), F.lit(JSON_STRING), F.lit(2))
    bad = F.get(F.filter(F.zip_with(names, colons, lambda n, c: F.when((c != "") & n.rlike(pattern), n)), lambda n: n.isNotNull()), F.lit(0))
    return payloads.select(key, F.lit(rule).alias("rule"), bad.alias("detail")).where("detail IS NOT NULL")


def bad_digests(refs: DataFrame, col: str = "digest") -> DataFrame:
    return _rows(refs, "bad_digest", ~F.coalesce(F.col(col).rlike(DIGEST), F.lit(False)), F.col(col))


def bad_variants(runs: DataFrame) -> DataFrame:
    return _rows(runs, "unknown_variant", ~F.coalesce(F.col("variant_id").isin(*VARIANTS), F.lit(False)), F.col("variant_id"))


def key_differences(df: DataFrame, actual: str, required: list[str]) -> DataFrame:
    """Missing and unknown field names of an array column of keys."""
    want = F.array(*[F.lit(k) for k in required])
    found = [
        df.select("run_id", F.lit("missing_key").alias("rule"), F.explode(F.array_except(want, F.col(actual))).alias("detail")),
        df.select("run_id", F.lit("unknown_key").alias("rule"), F.explode(F.array_except(F.col(actual), want)).alias("detail")),
    ]
    return reduce(DataFrame.unionByName, found)


def repeated(df: DataFrame, keys: list[str], rule: str, key: str = "run_id") -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return _rows(n, rule, F.col("_n") > 1, F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), key)


def dangling(df: DataFrame, refs: DataFrame, on: list[str], rule: str, key: str = "run_id") -> DataFrame:
    lost = df.join(refs.select(*on).distinct(), on, "left_anti")
    return _rows(lost, rule, F.lit(True), F.concat_ws(":", *[F.col(k).cast("string") for k in on]), key)


def expectations(df: DataFrame, rules: list[dict], key: str = "run_id") -> DataFrame:
    """Declarative rules as data: {field, required, required_if, enum, min, max, max_items, matches}."""
    found = []
    for r in rules:
        c = F.col(r["field"])
        name = F.lit(r["field"])
        if r.get("required"):
            found.append(_rows(df, "required", c.isNull(), name, key))
        if "required_if" in r:
            found.append(_rows(df, "required_if", F.expr(r["required_if"]) & c.isNull(), name, key))
        if "enum" in r:
            found.append(_rows(df, "enum", ~c.isin(*r["enum"]), name, key))
        if "min" in r:
            found.append(_rows(df, "min", c < r["min"], name, key))
        if "max" in r:
            found.append(_rows(df, "max", c > r["max"], name, key))
        if "max_items" in r:
            found.append(_rows(df, "max_items", F.size(c) > r["max_items"], name, key))
        if "matches" in r:
            found.append(_rows(df, "matches", ~c.rlike(r["matches"]), name, key))
    return reduce(DataFrame.unionByName, found)


def repair_counts(runs: DataFrame, repairs: DataFrame) -> DataFrame:
    """Schema and ticket repairs of every run. repairs: run_id, kind ('schema' or 'ticket')."""
    n = repairs.groupBy("run_id").agg(F.count_if(F.col("kind") == "schema").alias("schema_repairs"), F.count_if(F.col("kind") == "ticket").alias("ticket_repairs"))
    return runs.select("run_id").join(n, "run_id", "left").select("run_id", F.coalesce("schema_repairs", F.lit(0)).alias("schema_repairs"), F.coalesce("ticket_repairs", F.lit(0)).alias("ticket_repairs"))


def root_keys(states: DataFrame) -> DataFrame:
    """Root keys of a state against its reference: missing ones are an error, others are left out.
    states: run_id, reference (array), actual (array)."""
    return states.select("run_id", F.array_sort(F.array_except("reference", "actual")).alias("missing"), F.array_sort(F.array_except("actual", "reference")).alias("excluded"))
