"""Business state as rows: folding change logs, differences, hashes and completion checks.

State frames have run_id, tbl, identity (text) and values (map<string,string>); change logs have
run_id, seq, operation, tbl, identity, after (map) and, where useful, before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import match_entries
from .common import matched, parts

KEY = ["run_id", "tbl", "identity"]


def fold_changes(initial: DataFrame, changes: DataFrame) -> DataFrame:
    """Final state: per column the value with the highest seq, the initial state being seq -1.

    One shuffle on (run, table, identity, column) with partial aggregation; returns KEY, column, value.
    """
    first = initial.select(*KEY, F.lit(-1).cast("bigint").alias("seq"), F.explode("values").alias("column", "value"))
    later = changes.select(*KEY, "seq", F.explode("after").alias("column", "value"))
    return first.unionByName(later).groupBy(*KEY, "column").agg(F.max_by("value", "seq").alias("value"))


def as_rows(cells: DataFrame) -> DataFrame:
    """Cells (KEY, column, value) as state rows with a value map in column order."""
    entries = F.array_sort(F.collect_list(F.struct("column", "value")))
    return cells.groupBy(*KEY).agg(F.map_from_entries(entries).alias("values"))


def create_rows(existing: DataFrame, creates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Creates that may go ahead, and those whose planned identity exists already.

    creates: run_id, seq, tbl, identity (null for unplanned rows), after. Unplanned rows get the next
    free number of their table: unplanned:<existing unplanned rows + position>.
    """
    planned = creates.where(F.col("identity").isNotNull())
    taken = planned.join(existing.select(*KEY).distinct(), KEY, "left_semi")
    fresh = planned.join(existing.select(*KEY).distinct(), KEY, "left_anti")
    counts = existing.where(F.col("identity").startswith("unplanned:")).groupBy("run_id", "tbl").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("run_id", "tbl").orderBy("seq")
    loose = creates.where(F.col("identity").isNull()).withColumn("_k", F.row_number().over(w)).join(counts, ["run_id", "tbl"], "left")
    number = (F.coalesce("_n", F.lit(0)) + F.col("_k")).cast("string")
    loose = loose.withColumn("identity", F.concat(F.lit("unplanned:"), number)).drop("_n", "_k")
    return fresh.unionByName(loose.select(fresh.columns)), taken


def state_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows created, removed or changed between two cell frames; unchanged cells are left out."""
    b, a = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    b, a = b.withColumn("_b", F.lit(True)), a.withColumn("_a", F.lit(True))
    both = b.join(a, [*KEY, "column"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")) | F.col("_b").isNull() | F.col("_a").isNull())
    kind = F.when(F.col("_b").isNull(), "created").when(F.col("_a").isNull(), "removed").otherwise("changed")
    return both.select(*KEY, "column", "before", "after", kind.alias("change"))


def same_state(before: DataFrame, after: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: whether two states are equal, and how many cells differ. A cell is in a state once."""
    cell = [*KEY, "column"]
    side = lambda df, name: df.select(*cell, F.struct("value").alias(name))
    # a cell without a run, table, identity or column equals no other
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in cell])
    both = side(before, "_b").unionByName(side(after, "_a"), True).withColumn("_side", F.when(~whole, F.col("_a").isNull()))
    both = both.groupBy(*cell, "_side").agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    diff = both.where(~F.col("_b").eqNullSafe(F.col("_a"))).groupBy("run_id").agg(F.count("*").alias("n_diff"))
    return runs.join(diff, "run_id", "left").select("run_id", F.coalesce("n_diff", F.lit(0)).alias("n_diff"), F.coalesce(F.col("n_diff") == 0, F.lit(True)).alias("equal"))


def _json(c: Column) -> Column:
    """A text as a JSON literal; null as null."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def canonical(cells: DataFrame) -> DataFrame:
    """Canonical JSON of each run's state: tables and columns by name, rows by identity as text, no
    blanks, non-ASCII letters as they are.

    cells: KEY, column, value and, if values aren't all text, kind: 'number' and 'boolean' values are
    written bare. An identity that is a struct becomes an object with its fields by name.
    """
    value = _json(F.col("value"))
    if "kind" in cells.columns:
        value = F.when(F.col("kind").isin("number", "boolean") & F.col("value").isNotNull(), F.col("value")).otherwise(value)
    kind = cells.schema["identity"].dataType
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fieldNames())
        identity = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(_json(F.lit(f)), F.lit(":"), _json(F.col("identity")[f].cast("string"))) for f in fields]), F.lit("}"))
        order = F.array(*[F.col("identity")[f].cast("string") for f in kind.fieldNames()])
    else:
        identity, order = _json(F.col("identity")), F.array("identity")
    within = lambda by, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by.alias("by"), c.alias("c")))), lambda x: x["c"]), ",")
    rows = cells.groupBy(*KEY).agg(within(F.col("column"), F.concat(_json(F.col("column")), F.lit(":"), value)).alias("row"))
    line = F.concat(F.lit('{"row_identity":'), identity, F.lit(',"values":{'), F.col("row"), F.lit("}}"))
    tables = rows.groupBy("run_id", "tbl").agg(within(order, line).alias("rows"))
    whole = F.concat(_json(F.col("tbl")), F.lit(":["), F.col("rows"), F.lit("]"))
    return tables.groupBy("run_id").agg(F.concat(F.lit("{"), within(F.col("tbl"), whole), F.lit("}")).alias("canonical"))


def state_hash(cells: DataFrame) -> DataFrame:
    return canonical(cells).select("run_id", F.sha2("canonical", 256).alias("state_sha256"))


def digest_mismatches(cells: DataFrame, declared: DataFrame) -> DataFrame:
    """Runs whose declared digest ('sha256:<hex>') isn't that of their state."""
    actual = state_hash(cells).select("run_id", F.concat(F.lit("sha256:"), F.col("state_sha256")).alias("actual"))
    return declared.join(actual, "run_id", "left").where(~F.col("declared").eqNullSafe(F.col("actual")))


def includes(actual: Column, expected: Column, normal=lambda c: c) -> Column:
    """Whether a map holds every entry of another, nulls equal to nulls."""
    return F.forall(F.map_entries(expected), lambda e: normal(F.try_element_at(actual, e["key"])).eqNullSafe(normal(e["value"])))


def completion(changes: DataFrame, required: DataFrame, forbidden: DataFrame, runs: DataFrame) -> DataFrame:
    """Every required mutation observed and no forbidden one.

    changes: run_id, operation, tbl, after; required and forbidden: run_id, mutation_id, operation,
    tbl, after. Keys are equal, values are a sub-map in the forms in which values of such columns are
    compared, so the join is hashed on (run, table, operation).
    """
    formed = lambda df: df.withColumn("after", F.map_from_arrays(F.map_keys("after"), match_entries(F.map_values("after"), F.map_keys("after"))))
    by = ["run_id", "operation", "tbl"]
    side = lambda df, bad: formed(df).select(*by, "mutation_id", "after", F.lit(bad).alias("bad"))
    seen = formed(changes).select(*by, F.col("after").alias("_after"))
    hits = matched(side(required, False).unionByName(side(forbidden, True)), seen, by, "left")
    hits = hits.select("run_id", "bad", "mutation_id", F.coalesce(includes(F.col("_after"), F.col("after")), F.lit(False)).alias("seen"), F.lit(0).alias("here"))
    none = F.lit(None)
    own = runs.select("run_id", none.cast("boolean").alias("bad"), none.cast(hits.schema["mutation_id"].dataType).alias("mutation_id"), none.cast("boolean").alias("seen"), F.lit(1).alias("here"))
    # mutations and runs are dealt by run once, for both counts
    rows = hits.unionByName(own).repartition(parts(required, forbidden, runs), "run_id")
    each = rows.groupBy("run_id", "bad", "mutation_id").agg(F.max("seen").alias("seen"), F.sum("here").alias("here"))
    count = lambda c: F.coalesce(F.sum(F.when(F.col("run_id").isNotNull(), c.cast("int"))), F.lit(0)).cast("bigint")
    out = each.groupBy("run_id").agg(count(~F.col("bad") & ~F.col("seen")).alias("missing"), count(F.col("bad") & F.col("seen")).alias("forbidden"), F.sum("here").cast("int").alias("_here"))
    status = F.when(F.col("forbidden") > 0, "forbidden_change").when(F.col("missing") > 0, "incomplete").otherwise("complete")
    out = out.where("_here > 0").withColumn("outcome", status)
    return out.select("run_id", "missing", "forbidden", "outcome", F.explode(F.array_repeat(F.lit(0), F.col("_here"))).alias("_copy")).drop("_copy")


def state_changing(calls: DataFrame) -> DataFrame:
    """Flag calls whose changes differ from what was there. calls: changes array<struct<before,after>>
    of canonical texts."""
    return calls.withColumn("changed_state", F.exists("changes", lambda c: ~c["before"].eqNullSafe(c["after"])))


def number_events(events: DataFrame, order: list[str]) -> DataFrame:
    """seq within the run and an event id, assigned at ingest."""
    e = events.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)).cast("bigint"))
    return e.withColumn("event_ref", F.format_string("event:%s:%d", F.col("run_id").cast("string"), F.col("seq")))
