"""A quantile sketch by logarithmic cells, in built-in functions: counts of cells add up, so sketches of
tasks, windows and days merge by adding, whatever the order.

Cell b > 0 holds (g^(b-1), g^b] with g = (1 + alpha) / (1 - alpha), counted from LEAST; negative values
mirror it, and cell 0 is what is nearer to zero than LEAST. A quantile is answered by the middle of its
cell, which is off by a share alpha of the true value at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 0.01
#: Values nearer to zero are zero.
LEAST = 1e-6


def _growth(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket(value: Column, alpha: float = ALPHA) -> Column:
    """The cell of a value; null for a null or NaN."""
    size = F.abs(value.cast("double"))
    cell = F.greatest(F.ceil(F.log(size / LEAST) / math.log(_growth(alpha))), F.lit(1)).cast("int")
    return F.when(value.isNull() | F.isnan(value), None).when(size < LEAST, 0).otherwise(F.when(value < 0, -cell).otherwise(cell))


def value_of(cell: Column, alpha: float = ALPHA) -> Column:
    """The middle of a cell, by relative error."""
    g = _growth(alpha)
    return F.when(cell == 0, 0.0).otherwise(F.signum(cell.cast("double")) * F.pow(F.lit(g), F.abs(cell)) * LEAST * 2 / (1 + g))


def build(df: DataFrame, keys: list[str], value: Column, alpha: float = ALPHA) -> DataFrame:
    """keys, sketch: an array of (b, n) by cell; null values are left out."""
    cells = df.select(*keys, bucket(value, alpha).alias("b")).where("b IS NOT NULL").groupBy(*keys, "b").agg(F.count("*").alias("n"))
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("sketch"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches added up by keys."""
    cells = sketches.select(*keys, F.inline("sketch")).groupBy(*keys, "b").agg(F.sum("n").alias("n"))
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("sketch"))


def total(sketch: Column) -> Column:
    return F.aggregate(sketch, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])


def quantile(sketch: Column, q: float, alpha: float = ALPHA) -> Column:
    """The value of rank ceil(q n), at least the first; null of an empty sketch. Cells are in order."""
    rank = F.greatest(F.ceil(total(sketch) * F.lit(q)), F.lit(1))
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("int").alias("b"))
    step = lambda a, x: F.struct((a["before"] + x["n"]).alias("before"), F.when(a["b"].isNull() & (a["before"] + x["n"] >= rank), x["b"]).otherwise(a["b"]).alias("b"))
    return value_of(F.aggregate(sketch, start, step, lambda a: a["b"]), alpha)
