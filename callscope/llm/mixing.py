"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Each document draws u from its id; its exponential key -ln(u) / w orders a source so that every
prefix is a weighted sample without replacement, w being a quality weight (share of letters). A
source whose target is k times its size or more gives k complete epochs; the fraction left over is
the prefix of its order whose words come nearest to it.

No source is ever sorted as a whole. Rows carry r, the logarithm of the key: words are summed by cells
of r of width 1/CELLS_1, the cell that holds the budget's end by CELLS_2 cells again, and only that
inner cell is sorted. Whatever the weights, r is a mixture of shifted extreme-value laws, whose
density is at most 1/e, so an inner cell expects at most 1 / (e * CELLS_1 * CELLS_2) of the source's
documents, six in a million. What crosses between the passes is one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, kept_columns

WORD = r"[^\x20\x09-\x0D]+"
#: Characters that are not letters, for the quality weight: ASCII digits, punctuation and blanks.
NOT_LETTERS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t\n\x0b\x0c\r"
CELLS_1, CELLS_2 = 64, 1024
#: Added to r before cutting: u >= 2^-49 and w <= 1 keep r over -34.
SHIFT = 64
#: Columns that mix() makes.
MADE = ("size", "source_size", "target", "copies", "taken", "quality")
#: Largest per-source table that is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 50_000


def _skey(source: Column) -> Column:
    """A key that orders and joins like the source, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def quality_weight(text: Column) -> Column:
    """Share of characters that are not ASCII digits, punctuation or blanks, within (0, 1]."""
    letters = F.char_length(F.translate(text, NOT_LETTERS, ""))
    return (letters + F.lit(1)).cast("double") / (F.char_length(text) + F.lit(1)).cast("double")


def order_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """r = ln(-ln(u) / w), with u drawn from the id by a digest, so reruns agree. The logarithm keeps
    the order of the keys and tells apart those of very small weights."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))
    return F.log(-F.log(u)) - F.log(weight)


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """docs with _skey, _size (words), _w (quality weight), _r (order) and its cells _c1, _c2."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({"_skey": _skey(F.col(source_col)), "_size": F.regexp_count(text, F.lit(WORD)).cast("long"), "_w": quality_weight(text)})
    out = out.withColumn("_r", order_key(F.col(id_col), F.col("_w"), seed))
    fine = F.floor((F.col("_r") + F.lit(SHIFT)) * F.lit(CELLS_1 * CELLS_2)).cast("int")
    return out.withColumn("_c", fine).withColumns({"_c1": F.floor(F.col("_c") / CELLS_2).cast("int"), "_c2": (F.col("_c") % CELLS_2).cast("int")}).drop("_c")


def targets(sizes: DataFrame, cycle: tuple[int, ...], share: float, ceiling: int) -> DataFrame:
    """Per source: its weight by rank, and its target, the total shared by weight with each source
    held to ceiling times its size. The level that all uncapped sources share is found by repeated
    sums over the per-source table."""
    spark = sizes.sparkSession
    ranked = sizes.repartitionByRange(F.col("_skey")).sortWithinPartitions("_skey").withColumn("_pid", F.spark_partition_id())
    ranked = checkpointed(ranked.withColumn("_at", F.monotonically_increasing_id()))
    first = ranked.groupBy("_pid").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    base = first.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("_base") + F.col("_at") - F.col("_first")
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (rank % len(cycle) + 1).cast("int")).cast("double")
    table = checkpointed(ranked.join(F.broadcast(base.drop("_n")), "_pid").select("_skey", "_source_size", weight.alias("_weight")))
    cap = F.col("_source_size") * F.lit(float(ceiling))
    total, weights = table.agg(F.coalesce(F.sum("_source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0.0))).first()
    total = total * share
    level = total / weights if weights else 0.0
    while True:
        capped = cap < F.lit(level) * F.col("_weight")
        held, open_weight = table.agg(F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("_weight"))), F.lit(0.0))).first()
        raised = (total - held) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    return table.withColumn("_target", F.least(F.lit(level) * F.col("_weight"), cap))


def source_plan(rows: DataFrame, id_col: str, cycle: tuple[int, ...], share: float, ceiling: int) -> DataFrame:
    """One row per source: _source_size, _target, _epochs and the end of the fractional prefix:
    documents before cell (_b1, _b2), and in that cell those up to (_cut_r, _cut_id)."""
    sizes = rows.groupBy("_skey").agg(F.sum("_size").alias("_source_size"))
    plan = targets(sizes, cycle, share, ceiling)
    plan = plan.withColumn("_epochs", F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("_rest", F.col("_target") - F.col("_epochs") * F.col("_source_size"))
    plan = checkpointed(plan)
    small = plan.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda df: df)
    before = Window.partitionBy("_skey").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)

    def boundary(cells: DataFrame, budget: DataFrame, name: str) -> DataFrame:
        """The cell in which the running sum reaches the budget, and what comes before it."""
        run = cells.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
        run = run.join(hint(budget), "_skey").where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_words") > F.col("_rest")))
        return run.select("_skey", F.col("_cell").alias(name), (F.col("_rest") - F.col("_before")).alias("_rest"))

    budget = plan.where(F.col("_rest") > 0).select("_skey", "_rest")
    outer = checkpointed(boundary(rows.groupBy("_skey", F.col("_c1").alias("_cell")).agg(F.sum("_size").alias("_words")), budget, "_b1"))
    inside = rows.join(hint(outer.select("_skey", "_b1")), "_skey").where(F.col("_c1") == F.col("_b1"))
    inner = checkpointed(boundary(inside.groupBy("_skey", F.col("_c2").alias("_cell")).agg(F.sum("_size").alias("_words")), outer.select("_skey", "_rest"), "_b2"))
    place = outer.select("_skey", "_b1").join(hint(inner), "_skey", "left")
    cell = rows.join(hint(place.where(F.col("_b2").isNotNull())), "_skey").where((F.col("_c1") == F.col("_b1")) & (F.col("_c2") == F.col("_b2")))
    # rows that repeat an id and a text share their place and go together
    cell = cell.groupBy("_skey", "_rest", F.col("_r"), F.col(id_col).alias("_id")).agg(F.sum("_size").alias("_words"))
    line = Window.partitionBy("_skey").orderBy("_r", "_id").rowsBetween(Window.unboundedPreceding, -1)
    fits = cell.withColumn("_before", F.coalesce(F.sum("_words").over(line), F.lit(0))).where(F.col("_before") + F.col("_words") / 2 <= F.col("_rest"))
    cut = fits.groupBy("_skey").agg(F.max(F.struct("_r", "_id")).alias("_cut"))
    ends = place.join(hint(cut), "_skey", "left").select("_skey", "_b1", "_b2", F.col("_cut._r").alias("_cut_r"), F.col("_cut._id").alias("_cut_id"))
    return checkpointed(plan.drop("_rest", "_weight").join(hint(ends), "_skey", "left"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (1, 2, 3), share: float = 1.0, ceiling: int = 3, seed: str = "mix-1", keep: list[str] | None = None) -> DataFrame:
    """Decide how often each document enters the mix.

    Sources, ordered by code point with null last, weigh as cycle repeats, and share `share` of all
    words; a target stops at ceiling times its source's size and the excess is shared by weight
    again. Returns id_col, the columns in keep, size, source_size (long), target (double), copies
    (complete epochs, plus one if the fractional prefix takes the document), taken = copies * size,
    and quality (the weight that scales the exponential key).

    A null text has no words; documents without words take nothing; a very long text is one document
    like any other, so a source's taken words miss its target by half its longest text at most. A
    null source is a source of its own. Ties of the key go by id, nulls first; equal ids with equal
    texts are taken together. An empty table gives no rows. A kept column that has the name of a
    result column is refused; other columns are ignored.
    """
    keep = kept_columns(keep, id_col, MADE)
    narrow = docs.select(F.col(id_col), F.col(text_col), F.col(source_col))
    rows = measured(narrow, id_col, text_col, source_col, seed).select(id_col, "_skey", "_size", "_w", "_r", "_c1", "_c2")
    rows = checkpointed(rows)
    plan = source_plan(rows, id_col, cycle, share, ceiling)
    full = measured(docs.select(*dict.fromkeys([id_col, text_col, source_col, *keep])), id_col, text_col, source_col, seed) if keep else rows
    small = plan.count() <= BROADCAST_SOURCES
    out = full.join(F.broadcast(plan) if small else plan, "_skey")
    # without a cut no document of the cell fits; nulls sort first among ids
    same_r = F.col("_r") == F.col("_cut_r")
    up_to = (F.col("_r") < F.col("_cut_r")) | (same_r & (F.col(id_col).isNull() | (F.col(id_col) <= F.col("_cut_id"))))
    in_cell = F.coalesce(up_to, F.lit(False))
    earlier = (F.col("_c1") < F.col("_b1")) | ((F.col("_c1") == F.col("_b1")) & (F.col("_c2") < F.col("_b2")))
    chosen = F.coalesce(earlier, F.lit(False)) | ((F.col("_c1") == F.col("_b1")) & (F.col("_c2") == F.col("_b2")) & in_cell)
    copies = F.col("_epochs") + F.coalesce(chosen, F.lit(False)).cast("long")
    return out.select(id_col, *keep, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_size")).alias("taken"), F.col("_w").alias("quality"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(length(translate(coalesce(text, ''), '0123456789!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) + 1 AS DOUBLE)
           / CAST(length(coalesce(text, '')) + 1 AS DOUBLE) AS w,
         (CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
r AS (SELECT *, ln(-ln(u)) - ln(w) AS r FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS wt FROM d GROUP BY source),
o AS (SELECT *, 3.0 * source_size AS cap, (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) AS total,
        sum(wt) OVER () AS all_wt,
        coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / wt, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        coalesce(sum(wt) OVER (ORDER BY 3.0 * source_size / wt, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_wt,
        row_number() OVER (ORDER BY 3.0 * source_size / wt, source) AS k FROM s),
l AS (SELECT coalesce(arg_min((total - held) / (all_wt - held_wt), k), 0.0) AS level FROM o WHERE cap >= (total - held) / (all_wt - held_wt) * wt),
t AS (SELECT source, source_size, least(level * wt, cap) AS target,
        CASE WHEN source_size > 0 THEN floor(least(level * wt, cap) / source_size) ELSE 0 END AS epochs FROM o, l),
p AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size AS rest,
        coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.r, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((epochs + CASE WHEN rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM p
"""
