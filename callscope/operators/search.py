"""Declared searches over business state, set-wise over all calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import column_kind, match_forms
from .common import dim
from .quality import matches_type


def holds(left: Column, right: Column, op: Column, kind: Column, column: Column) -> Column:
    """left op right under the declared type: equality in the forms in which values of such a column are
    compared, nulls equal; order on numbers as numbers and on everything else as text; a null never
    orders."""
    form = column_kind(column, kind)
    same = match_forms(left, form).eqNullSafe(match_forms(right, form))
    numeric = kind.isin("integer", "number")
    a, b = left.try_cast("double"), right.try_cast("double")
    low = F.when(numeric, a <= b).otherwise(left <= right)
    high = F.when(numeric, a >= b).otherwise(left >= right)
    return F.coalesce(F.when(op == "eq", same).when(op == "lte", low).when(op == "gte", high), F.lit(False))


def filtered_search(calls: DataFrame, args: DataFrame, filters: DataFrame, cells: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows that each search call returns, in identity order and cut at the tool's limit.

    calls: run_id, call_seq, tool, tbl; args: run_id, call_seq, name, value; filters: tool, rule,
    column, op, arg (null: constant), constant, type; cells: run_id, tbl, identity, column, value;
    limits: tool, most. All rules of a tool must hold; an argument of the wrong type empties the
    result; a rule whose optional argument is absent doesn't count. The cells meet the rules on
    (run, table, column), so no pair of call and row is made without a rule between them.
    """
    rule = calls.join(dim(filters), "tool").join(args.select("run_id", "call_seq", F.col("name").alias("arg"), F.col("value").alias("_given")), ["run_id", "call_seq", "arg"], "left")
    rule = rule.withColumn("want", F.coalesce("constant", "_given")).where(F.col("want").isNotNull())
    bad = rule.where(~matches_type(F.col("want"), F.col("type"))).select("run_id", "call_seq").distinct()
    rule = rule.join(bad, ["run_id", "call_seq"], "left_anti")
    need = rule.groupBy("run_id", "call_seq").agg(F.count("*").alias("need"))
    met = rule.join(cells, ["run_id", "tbl", "column"]).where(holds(F.col("value"), F.col("want"), F.col("op"), F.col("type"), F.col("column")))
    met = met.groupBy("run_id", "call_seq", "tool", "identity").agg(F.count("*").alias("n")).join(need, ["run_id", "call_seq"]).where("n = need")
    rank = F.row_number().over(Window.partitionBy("run_id", "call_seq").orderBy("identity"))
    return met.withColumn("rank", rank).join(dim(limits), "tool").where("rank <= most").select("run_id", "call_seq", "tool", "identity", "rank")


def public(rows: DataFrame) -> DataFrame:
    """State rows as a caller may see them, identities left out."""
    return rows.drop("identity", "row_identity", "role", "role_name", "customer", "sequence")
