"""MinHash near-duplicate groups: fast similarity sketches, banding, exact verification.

1. Rows with equal shingle sets form a class (a 128-bit digest); only classes go on.
2. Every class has BANDS keys, each of ROWS sketch coordinates. Members of a bucket are paired with
   its smallest member, never with each other, and the pairs are confirmed on the full sets.
3. Confirmed pairs give components. Where a bucket still holds more than one component, members of
   different components are compared by a longer sketch, in blocks of bounded size, each pair in the
   first bucket it shares; the few that come near the threshold are confirmed on the full sets too.
4. The components of all confirmed links give the groups.

At the threshold of 0.75 a pair shares none of 48 bands of 5 with a chance of 2e-6, and a sketch of
2048 coordinates falls under the cut with a chance of about 1e-6. Links are confirmed on the full sets of
64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, checkpointed, counted, text_slices
from .shingles import band_keys, shingle_set, sketch

WIDTH = 5
ROWS, BANDS = 5, 48
NUM, DEN = 75, 100
#: Coordinates of the longer sketch, kept to two bits each: unequal ones agree once in four.
LONG_SKETCH = 2048
AGREE = 0.75 + 0.25 / 4
#: 4.75 standard deviations under the agreement of a pair at the threshold.
SKETCH_CUT = AGREE - 4.75 * (AGREE * (1 - AGREE) / LONG_SKETCH) ** 0.5
BLOCK = 1024
#: Sets sketched at once: a long sketch takes 16 KB a set until it's cut to two bits a coordinate.
SKETCHED = 256
#: Most document ids that are broadcast to pick texts; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Edges that one task reads, from EDGE_TASKS tasks on, so that few edges don't cost a task per shuffle partition.
EDGES, EDGE_TASKS = 50_000, 8


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    known = WordHashes()
    for batch in batches:
        for part in text_slices(batch, 1):
            yield part, [shingle_set(t, known, width) for t in as_bytes(part.column(1))]


def _fits(n: Column, m: Column) -> Column:
    """Sizes that leave the threshold possible."""
    return F.least(n, m) * DEN >= F.greatest(n, m) * NUM


def classes_of(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row: its id, class digest, set size and packed band keys (null for an empty set)."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, width):
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list[bytes | None] = [None] * len(sets)
            if full:
                for i, row in zip(full, band_keys(sketch([sets[i] for i in full], ROWS * BANDS), ROWS), strict=True):
                    keys[i] = row.astype("<u8").tobytes()
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], ["id", "cls", "n", "keys"])

    return picked.mapInArrow(run, f"id {kind}, cls binary, n bigint, keys binary")


def sets_of(docs: DataFrame, needed: DataFrame, n_needed: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """Full set, long sketch and band tags of the n_needed classes in needed (nid, cls, id), from the text of the row
    that each names. A tag is 32 bits of a band's key. The sets are shuffled once, by class."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = needed.select(F.col("id").alias("_id")).distinct()
    ids = F.broadcast(ids) if n_needed <= BROADCAST_IDS else ids
    picked = picked.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _sets(batches, width):
            found = [s for s in found if len(s)]
            for begin in range(0, len(found), SKETCHED):
                sets = found[begin : begin + SKETCHED]
                two = (sketch(sets, LONG_SKETCH) & np.uint64(3)).astype(np.uint8).reshape(len(sets), -1, 4)
                packed = two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6
                tags = band_keys(sketch(sets, ROWS * BANDS), ROWS).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([row.tobytes() for row in packed], pa.binary()), pa.array([row.tobytes() for row in tags], pa.binary())], ["cls", "shingles", "sign", "tags"])

    made = picked.mapInArrow(run, "cls binary, shingles array<bigint>, sign binary, tags binary")
    once = made.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("shingles", "sign", "tags")])
    return once.join(needed.select("nid", "cls"), "cls").select("nid", "shingles", "sign", "tags")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose full sets meet the threshold."""
    sets = sets.select("nid", "shingles")
    left = pairs.join(sets.withColumnsRenamed({"nid": "b", "shingles": "sb"}), "b")
    both = left.join(sets.withColumnsRenamed({"nid": "a", "shingles": "sa"}), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * DEN >= (F.size("sa") + F.size("sb") - shared) * NUM).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b), comp being its component's smallest node.

    Alternating large-star and small-star steps; each writes a checkpoint, counted as it is written, and the
    loop ends when a turn changes no edge.
    """
    pair = lambda x, y, names: F.struct(x.alias(names[0]), y.alias(names[1]))

    def turned(e: DataFrame) -> tuple[DataFrame, tuple]:
        done, (n, hashes) = counted(e.distinct(), F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        return done.coalesce(max(EDGE_TASKS, n // EDGES)), (n, hashes)

    e, last = turned(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"))
    while last[0]:
        a, b, m = F.col("a"), F.col("b"), F.col("m")
        both = e.select(F.explode(F.array(pair(a, b, "uv"), pair(b, a, "uv"))).alias("at")).select("at.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        up = F.when(b != m, F.array(pair(a, m, "ab"), pair(b, m, "ab"))).otherwise(F.array(pair(a, m, "ab")))
        e, now = turned(large.join(low, "a").select(F.explode(up).alias("at")).select("at.*"))
        if now == last:
            break
        last = now
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("comp", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def _across(members: DataFrame, signs: DataFrame) -> DataFrame:
    """Candidate pairs between components within mixed buckets.

    members: key, band, pivot, nid, comp, lead, n; signs: nid, sign, tags. The leading component is one
    side; it is never compared within itself. Both sides are cut into blocks of about BLOCK rows; a
    group holds one pair of blocks. Sketches join the narrow rows last and are shuffled once.
    """
    members = members.withColumn("other", (F.col("comp") != F.col("lead")).cast("int"))
    sizes = members.groupBy("key").agg(F.sum("other").alias("n_other"), F.sum(1 - F.col("other")).alias("n_lead"))
    sizes = sizes.select("key", F.ceil(F.col("n_other") / BLOCK).cast("int").alias("b_other"), F.ceil(F.col("n_lead") / BLOCK).cast("int").alias("b_lead"))
    m = members.join(sizes, "key")
    spread = lambda n: F.pmod(F.xxhash64("nid"), n).cast("int")
    own = F.when(F.col("other") == 1, spread(F.col("b_other"))).otherwise(spread(F.greatest("b_lead", F.lit(1))))
    m = m.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    none = F.array().cast("array<struct<kind:int,i:int,j:int,side:int>>")
    group = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    led = F.transform(upto(F.col("b_other")), lambda j: group(0, F.col("own"), j, 0))
    to_lead = F.when(F.col("b_lead") > 0, F.transform(upto(F.greatest("b_lead", F.lit(1))), lambda i: group(0, i, F.col("own"), 1))).otherwise(none)
    low = F.transform(F.filter(upto(F.col("b_other")), lambda j: j >= F.col("own")), lambda j: group(1, F.col("own"), j, 0))
    high = F.transform(F.filter(upto(F.col("b_other")), lambda j: j < F.col("own")), lambda j: group(1, j, F.col("own"), 1))
    places = F.when(F.col("other") == 0, led).otherwise(F.concat(to_lead, low, high))
    dealt = m.select("key", "band", "pivot", "nid", "comp", "n", F.explode(places).alias("at")).select("*", "at.*").drop("at").join(signs, "nid")

    names = ["key", "kind", "i", "j"]

    def compare(part: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        """The pairs of one group that come near the threshold."""
        nid, comp, n, tags, sign = (part[c] for c in ("nid", "comp", "n", "tags", "sign"))
        band, pivot = part["band"][0], part["pivot"][0]
        alone = part["kind"][0] == 1 and part["i"][0] == part["j"][0]
        left = np.arange(len(nid)) if alone else np.flatnonzero(part["side"] == 0)
        right = left if alone else np.flatnonzero(part["side"] == 1)
        if len(left) > len(right):
            left, right = right, left
        found = []
        for y in left.tolist():
            # pairs with the pivot are settled, and a pair counts in the first bucket it shares; by tags of
            # 32 bits another comes first with a chance of 1e-8
            if nid[y] == pivot:
                continue
            near = right[right > y] if alone else right
            near = near[(comp[near] != comp[y]) & (nid[near] != pivot)]
            near = near[np.minimum(n[near], n[y]) * DEN >= np.maximum(n[near], n[y]) * NUM]
            near = near[(tags[near] == tags[y]).argmax(axis=1) == band]
            near = near[(sign[near] == sign[y]).mean(axis=1) >= SKETCH_CUT]
            found += [(min(nid[x], nid[y]), max(nid[x], nid[y])) for x in near.tolist()]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups as they come in key order; the last of a batch waits for the next one."""
        held = None
        for batch in _with_end(batches):
            whole = batch if held is None else held if batch is None else pa.concat_batches([held, batch])
            if whole is None:
                break
            ids = [np.asarray(whole.column(c)) for c in names]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            ends = [*change.tolist(), *([whole.num_rows] if batch is None else [])]
            done = ends[-1] if ends else 0
            held = whole.slice(done)
            if not done:
                continue
            part = {c: np.asarray(whole.column(c)[:done]) for c in [*names, "band", "pivot", "nid", "comp", "n", "side"]}
            part["tags"] = np.frombuffer(b"".join(whole.column("tags")[:done].to_pylist()), dtype="<u4").reshape(done, -1)
            packed = np.frombuffer(b"".join(whole.column("sign")[:done].to_pylist()), dtype=np.uint8).reshape(done, -1)
            part["sign"] = np.stack([packed >> shift & 3 for shift in (0, 2, 4, 6)], axis=2).reshape(done, -1)
            found = []
            for b, e in zip([0, *ends[:-1]], ends, strict=True):
                if e - b > 1:
                    found += compare({c: x[b:e] for c, x in part.items()})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    # groups are bounded by 2 * BLOCK rows, so a sorted stream holds one at a time
    dealt = dealt.repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Near-duplicate groups of whole texts, by Jaccard similarity of 0.75 or more of word shingles.

    Returns id_col, n_shingles, component_id (the smallest id reachable over links, its own included)
    and kept (the row's id is that smallest one). Null and word-less texts have an empty set, link
    with nothing and are kept. A very long text is one set, sketched by itself. Rows with a null id take part; where a group has no other id its
    component_id is null, and such rows are kept only then. Rows that repeat an id share its fate.
    An empty table gives no rows; columns of docs that are not named are ignored.
    """
    rows = checkpointed(classes_of(docs, id_col, text_col, width))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = checkpointed(classes.withColumn("nid", F.monotonically_increasing_id()))

    packed = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.substring("keys", i * 8 + 1, F.lit(8)), i).alias("key")))
    member = classes.select("nid", "n", F.explode(packed).alias("b")).select("nid", "n", "b.band", "b.key")
    # a bucket has a class once, so a window needs one shuffle where a grouping and a join need two
    bucket = Window.partitionBy("key")
    shared = checkpointed(member.withColumns({"pivot": F.min("nid").over(bucket), "top": F.max("nid").over(bucket)}).where("pivot < top").drop("top"))

    sizes = classes.select(F.col("nid").alias("pivot"), F.col("n").alias("m"))
    stars = shared.where("nid != pivot").select("nid", "n", "pivot").distinct().join(sizes, "pivot").where(_fits(F.col("n"), F.col("m")))
    needed, (n_needed,) = counted(shared.select("nid").distinct().join(classes.select("nid", "cls", "id"), "nid"), F.count(F.lit(1)))
    sets = checkpointed(sets_of(docs, needed, n_needed, id_col, text_col, width))
    first = checkpointed(components(confirmed(stars.select(F.col("pivot").alias("a"), F.col("nid").alias("b")), sets)))

    placed = shared.join(first.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lead"), F.max("comp").alias("top")).where("lead < top").select("key", "lead")
    across = _across(placed.join(mixed, "key"), sets.select("nid", "sign", "tags"))
    more = confirmed(across, sets)
    label = first.withColumnRenamed("node", "a")
    ends = more.join(label, "a", "left").select(F.coalesce("comp", "a").alias("a"), "b")
    ends = ends.join(first.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("comp", "b").alias("b"))
    merged = components(ends)
    comp = first.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("whole")), "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp"))
    lone = merged.join(first.select("node"), "node", "left_anti").select("node", "comp")
    final = comp.unionByName(lone).withColumnRenamed("node", "nid")

    named = classes.select("nid", "cls", "id").join(final, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = named.join(least, "comp").select("cls", "component_id")
    alone = rows.where("cls is null").select("id", "n", F.col("id").alias("component_id"))
    out = rows.where("cls is not null").select("id", "n", "cls").join(named, "cls").select("id", "n", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with one row of each group: the one with the smallest id (nulls last), then digest of its text.

    A row is known by its id and its text's digest, so rows that repeat an id or lack one are told apart;
    of rows equal in both one stays. Rows without words all stay. An empty table gives no rows; all columns
    of docs stay, whatever their names (_key and _n aside).
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("digest"))
    keyed = docs.withColumn("_key", key)
    named = groups(keyed, "_key", text_col, width).where("n_shingles > 0").groupBy("_key", "kept").agg(F.count("*").alias("_n"))
    named, (n_gone, n_repeated) = counted(named.where("not kept or _n > 1"), F.count_if(~F.col("kept")), F.count_if(F.col("kept")))

    def some(condition: str, n: int) -> DataFrame:
        keys = named.where(condition).select("_key")
        return F.broadcast(keys) if n <= BROADCAST_IDS else keys

    gone, repeated = some("not kept", n_gone), some("kept", n_repeated)
    left = keyed.join(gone, "_key", "left_anti")
    if n_repeated:
        left = left.join(repeated, "_key", "left_anti").unionByName(left.join(repeated, "_key", "left_semi").dropDuplicates(["_key"]))
    return left.select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""
