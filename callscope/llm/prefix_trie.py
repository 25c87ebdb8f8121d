"""Conversation prefix trie, by balanced parentheses per shard.

1. Turns become digests. Their places, and along each rebuilt conversation the sums of words and of
   digests (a prefix is named by the sum of its turns' digests, each hashed with its place), are running
   sums over ranges of rows, so a conversation that holds a third of all rows spreads over many tasks.
2. Grouping by prefix gives the nodes: smallest member, members, ends, children. Only forks, ends and
   the root are vertices; chains of nodes with one child hang on the vertex below them.
3. Each distinct conversation is a path of vertices. Paths are sorted and dealt by range; a task takes
   a shard of them at a time and writes it as balanced parentheses. Blocks with their least and greatest
   excess let findclose delimit a vertex's subtree, a rank of leaf pairs counts its leaves, and cumulative
   arrays give its savings. A vertex's own saving stands with the path of its smallest member, so it
   counts once.
4. Vertices on the spines of several shards are merged by adding up.
5. Nodes between vertices take the values of the vertex below, found by conversation and block of depths.

Odd rows. A null role or text is empty; turns equal in number go by the digest of role and text, and
repeated turns stay. A row with a null conv_id is in no conversation. Very long texts only pass as digests.
Without rows the result is empty. Columns beyond the four are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: A conversation starts with up to SHARED - 1 turns of the first one of its FAMILY ids.
FAMILY, SHARED = 20, 4
#: Rows of a range of turns, at most so many where there is more than one; vertices on the paths of a shard.
RANGE, SHARD = 200_000, 500_000
#: Depths of a block, by which nodes find the vertex below.
DEPTHS = 1024
#: Ends of a node that are hashed as one list; more go in blocks of as many.
LISTED = 1024
#: Parentheses of a block of excesses.
PARENTHESES = 256

BLANKS = r"[\x20\x09-\x0D]+"
KEY = ["p", "h1", "h2"]


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a node."""
    rows, convs = rebuilt(conversations)
    rows = checkpointed(rows)
    nodes, ends = _nodes(rows, convs)
    nodes = checkpointed(nodes)
    vertices = nodes.where((F.col("children") != 1) | (F.col("ends") > 0) | (F.col("p") == 0))
    edges = _subtrees(_paths(rows, vertices, ends)).join(vertices.select(*KEY, "c"), KEY)
    blocks = edges.select("c", "top", F.col("p").alias("q"), "leaves", "saved", "above", F.explode(F.expr(f"sequence(top div {DEPTHS}, p div {DEPTHS})")).alias("blk"))
    placed = nodes.withColumn("blk", F.expr(f"p div {DEPTHS}")).join(blocks, ["c", "blk"]).where("p between top and q")
    full = placed.join(_end_hashes(ends), KEY, "left")
    return full.select(
        F.col("c").alias("conv_id"),
        F.col("p").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * (F.col("cum") - F.col("w") - F.col("above"))).alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the rebuilt conversations (c, p, w, cum, h1, h2 and the prefix before), and all conversations."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat_ws(":", F.char_length(role).cast("string"), F.concat(role, text)))
    words = F.size(F.filter(F.split(text, BLANKS), lambda x: x != "")).cast("bigint")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("c"), F.col("turn").cast("bigint").alias("turn"), digest.alias("d"), words.alias("w"), F.lit(1).cast("bigint").alias("one"))
    placed = running(turns, ["turn", "d"], {"pos": "one"}, turns.count()).select("c", "pos", "d", "w")
    lens = checkpointed(placed.groupBy("c").agg(F.max("pos").alias("len")))
    bases = lens.where(F.col("c") % FAMILY == 0).select(F.col("c").alias("b"), F.col("len").alias("b_len"))
    shared = (F.crc32(F.col("c").cast("string")) % SHARED).alias("h")
    convs = lens.select("c", "len", (F.col("c") - F.col("c") % FAMILY).alias("b"), shared).join(bases, "b", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("b_len", F.lit(0)))).withColumn("total", F.col("k") + F.greatest(F.col("len") - F.col("h"), F.lit(0)))
    convs = checkpointed(convs.select("c", "b", "h", "k", "total"))
    own = placed.join(convs, "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("p"), "d", "w")
    heads = placed.where((F.col("c") % FAMILY == 0) & (F.col("pos") < SHARED)).select(F.col("c").alias("b"), F.col("pos").alias("p"), "d", "w")
    lent = convs.join(heads, "b").where("p <= h").select("c", "p", "d", "w")
    both = own.unionByName(lent).select("c", "p", "w", F.xxhash64(F.lit(1), "p", "d").alias("t1"), F.xxhash64(F.lit(2), "p", "d").alias("t2"))
    rows = convs.agg(F.sum("total")).first()[0] or 0
    summed = running(both, ["p"], {"h1": "t1", "h2": "t2", "cum": "w"}, rows)
    return summed.select("c", "p", "w", "cum", "h1", "h2", "h1_before", "h2_before"), convs


def running(df: DataFrame, order: list[str], sums: dict[str, str], rows: int) -> DataFrame:
    """df with running sums along each c (64 bits, wrapping around), and <name>_before without the row itself.

    sums: new column -> column. Ranges of rows may cut a conversation; each adds what the ranges before it
    hold of the conversation that it begins with. Rows equal in c and order may come in any order.
    """
    spark = df.sparkSession
    parts = max(-(-rows // RANGE), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 1000)), 1)
    ranges = df.repartitionByRange(parts, "c", *order).sortWithinPartitions("c", *order)
    kept = checkpointed(ranges.withColumn("_part", F.spark_partition_id()))
    names, made = kept.columns, list(sums)

    def steps(batches: Iterator[pa.RecordBatch], given: dict) -> Iterator[tuple]:
        last, held = None, dict.fromkeys(made, 0)
        for i, batch in enumerate(b for b in batches if b.num_rows):
            c = batch.column(names.index("c")).to_numpy()
            if i == 0:
                last, held = given.get(batch.column(names.index("_part"))[0].as_py(), (last, held))
            fresh = np.r_[c[0] != last, c[1:] != c[:-1]]
            group, first = np.cumsum(fresh), np.flatnonzero(fresh)
            done = {}
            for m in made:
                term = batch.column(names.index(sums[m])).to_numpy()
                total = np.cumsum(term)
                off = np.r_[np.array([-held[m]]), total[first] - term[first]]
                done[m] = total - off[group]
                done[f"{m}_before"] = done[m] - term
            last, held = c[-1], {m: done[m][-1] for m in made}
            yield batch, done

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The conversations a range begins and ends with, and the latter's sums in it."""
        begin = end = None
        for batch, done in steps(batches, {}):
            begin, end = batch if begin is None else begin, (batch, done)
        if end is not None:
            batch, done = end
            at = [batch.column(names.index("_part"))[-1:], begin.column(names.index("c"))[:1], batch.column(names.index("c"))[-1:]]
            yield pa.RecordBatch.from_arrays([*at, *(pa.array(done[m][-1:]) for m in made)], names=["part", "first", "last", *made])

    # a row a range
    tails = kept.mapInArrow(tail, "part int, first long, last long, " + ", ".join(f"{m} long" for m in made)).toArrow().to_pylist()
    given, held = {}, None
    for r in sorted(tails, key=lambda r: r["part"]):
        sums_here = {m: np.int64(r[m]) for m in made}
        if held is not None and held[0] == r["first"]:
            given[r["part"]] = held
            if r["first"] == r["last"]:
                with np.errstate(over="ignore"):
                    sums_here = {m: sums_here[m] + held[1][m] for m in made}
        held = (r["last"], sums_here)
    sent = spark.sparkContext.broadcast(given)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, done in steps(batches, sent.value):
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, done.values())], names=[*names, *done])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept.schema] + [f"{m} long, {m}_before long" for m in made])
    return kept.mapInArrow(whole, schema).drop("_part")


def _nodes(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes: p, h1, h2, c (smallest member), n, w, cum, children, ends, parent (its smallest member);
    and where each conversation ends: c, p, h1, h2."""
    last = rows.groupBy("c").agg(F.max(F.struct(*KEY)).alias("x")).select("c", "x.*")
    none = convs.where("total = 0").select("c", *(F.lit(0).cast("bigint").alias(k) for k in KEY))
    ends = checkpointed(last.unionByName(none))
    inner = rows.groupBy(*KEY).agg(F.min("c").alias("c"), F.count("*").alias("n"), F.max("w").alias("w"), F.max("cum").alias("cum"), F.min("h1_before").alias("u1"), F.min("h2_before").alias("u2"))
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("c").alias("c"), F.count("*").alias("n")).where("n > 0").select(*(zero.alias(k) for k in KEY), "c", "n", zero.alias("w"), zero.alias("cum"), zero.alias("u1"), zero.alias("u2"))
    nodes = checkpointed(inner.unionByName(root))
    children = nodes.where("p > 0").groupBy((F.col("p") - 1).alias("p"), F.col("u1").alias("h1"), F.col("u2").alias("h2")).agg(F.count("*").alias("children"))
    ended = ends.groupBy(*KEY).agg(F.count("*").alias("ends"))
    parents = nodes.select((F.col("p") + 1).alias("p"), F.col("h1").alias("u1"), F.col("h2").alias("u2"), F.col("c").alias("parent"))
    full = nodes.join(children, KEY, "left").join(ended, KEY, "left").join(parents, ["p", "u1", "u2"], "left")
    return full.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("children", "ends")}).drop("u1", "u2"), ends


def _paths(rows: DataFrame, vertices: DataFrame, ends: DataFrame) -> DataFrame:
    """path: of each distinct conversation, the vertices from the root on, by depth."""
    reps = ends.groupBy(*KEY).agg(F.min("c").alias("rep")).select("rep")
    steps = rows.join(reps, F.col("c") == F.col("rep"), "left_semi").select(*KEY, F.col("c").alias("rep"))
    element = F.struct(*KEY, "n", "cum", (F.col("children") == 0).alias("leaf"), (F.col("c") == F.col("rep")).alias("mine"))
    inner = steps.join(vertices.where("p > 0"), KEY).select("rep", element.alias("x"))
    # the root is on all paths, so it is a constant and no key to join by; turnless conversations have only it
    root = vertices.where("p = 0").select("c", "n", (F.col("children") == 0).alias("leaf")).first()
    kind = inner.schema["x"].dataType.simpleString()
    c, n, leaf = root or (None, 0, True)
    top = F.struct(*(F.lit(0).cast("bigint").alias(k) for k in KEY), F.lit(n).alias("n"), F.lit(0).alias("cum"), F.lit(leaf).alias("leaf"), F.col("rep").eqNullSafe(F.lit(c)).alias("mine")).cast(kind)
    both = inner.unionByName(reps.select("rep", F.lit(None).cast(kind).alias("x")))
    return both.groupBy("rep").agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.concat(F.array(top), "x").alias("path"))


def _subtrees(paths: DataFrame) -> DataFrame:
    """Of each vertex: p, h1, h2, leaves and saved of its subtree (the edge to it included), the depth
    where its edge begins (top) and the words above that (above)."""
    key = F.transform("path", lambda x: F.struct(x["p"], x["h1"], x["h2"]))
    paths = checkpointed(paths.select("path", key.alias("k")))
    rows = paths.count()
    parts = max(-(-rows // RANGE), min(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // 1000)), 1)
    ranged = paths.repartitionByRange(parts, "k").sortWithinPartitions("k").select("path")
    partial = ranged.mapInArrow(_shards, "p long, h1 long, h2 long, leaves long, saved long, top long, above long")
    return partial.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("top").alias("top"), F.max("above").alias("above"))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted paths, a shard at a time: any cut between two paths will do."""
    held, size = [], 0
    for batch in batches:
        column, begin = batch.column(0), 0
        ends = column.offsets.to_numpy() - column.offsets[0].as_py()
        while begin < len(column):
            stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + SHARD - size, side="right")) - 1)
            held.append(column[begin : min(stop, len(column))])
            size += int(ends[min(stop, len(column))] - ends[begin])
            begin = stop
            if size >= SHARD:
                yield shard(pa.concat_arrays(held))
                held, size = [], 0
    if size:
        yield shard(pa.concat_arrays(held))


def shard(paths: pa.ListArray) -> pa.RecordBatch:
    """What the subtrees of these sorted paths' vertices hold, of these paths alone."""
    flat, sizes = paths.flatten(), np.diff(paths.offsets.to_numpy())
    p, h1, h2, n, cum, leaf, mine = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(7))
    heads = np.r_[0, np.cumsum(sizes)[:-1]]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(p)) - heads[owner]
    # vertices that the path before doesn't share
    before = np.where(owner > 0, heads[np.maximum(owner - 1, 0)] + place, 0)
    there = (owner > 0) & (place < sizes[np.maximum(owner - 1, 0)])
    before = np.where(there, before, 0)
    same = there & (p == p[before]) & (h1 == h1[before]) & (h2 == h2[before])
    common = np.minimum.reduceat(np.where(same, sizes[owner], place), heads)
    new = place >= common[owner]
    opens = np.flatnonzero(new)
    # closing what the path before leaves, opening what it adds
    left = np.r_[0, sizes[:-1] - common[1:], sizes[-1]]
    counts = np.ravel(np.column_stack([left, np.r_[sizes - common, 0]]))
    bits = np.repeat(np.tile(np.array([False, True]), len(left)), counts)
    at = np.flatnonzero(bits)
    close = find_close(bits, at)
    # the vertex of every place on a path: the last one opened at that place
    order = np.lexsort((owner, place))
    index = np.empty(len(p), dtype=np.int64)
    index[opens] = np.arange(len(opens))
    latest = np.maximum.accumulate(np.where(new[order], np.arange(len(order)), 0))
    vertex = np.empty(len(p), dtype=np.int64)
    vertex[order] = index[order[latest]]
    own = np.bincount(vertex, mine, len(opens)) > 0
    above = np.where(place > 0, cum[np.maximum(np.arange(len(p)) - 1, 0)], 0)[opens]
    top = np.where(place > 0, p[np.maximum(np.arange(len(p)) - 1, 0)] + 1, 0)[opens]
    pair = np.zeros(len(bits) + 1, dtype=np.int64)
    pair[at + 1] = (close == at + 1) & leaf[opens]
    gain = np.zeros(len(bits) + 1, dtype=np.int64)
    gain[at + 1] = np.where(own, (n[opens] - 1) * (cum[opens] - above), 0)
    leaves, saved = (np.cumsum(x) for x in (pair, gain))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (p[opens], h1[opens], h2[opens], leaves[close + 1] - leaves[at], saved[close + 1] - saved[at], top, above)], names=["p", "h1", "h2", "leaves", "saved", "top", "above"])


def find_close(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The closing parenthesis of each opening one: the next place whose excess is one less.

    The rest of the own block is looked through first; then a tree over the blocks' least and greatest
    excess leads to the first block that reaches the wanted excess, and that is looked through.
    """
    excess = np.cumsum(np.where(bits, 1, -1))
    n_blocks = -(-len(bits) // PARENTHESES)
    padded = np.r_[excess, np.full(n_blocks * PARENTHESES - len(bits), excess[-1])]
    blocks = padded.reshape(n_blocks, PARENTHESES)
    leaves = 1 << max(0, (n_blocks - 1).bit_length())
    least, most = np.full(2 * leaves, np.iinfo(np.int64).max), np.full(2 * leaves, np.iinfo(np.int64).min)
    least[leaves : leaves + n_blocks], most[leaves : leaves + n_blocks] = blocks.min(axis=1), blocks.max(axis=1)
    for i in range(leaves.bit_length() - 1, 0, -1):
        lo, hi = 1 << (i - 1), 1 << i
        least[lo:hi], most[lo:hi] = np.minimum(least[2 * lo : 2 * hi : 2], least[2 * lo + 1 : 2 * hi : 2]), np.maximum(most[2 * lo : 2 * hi : 2], most[2 * lo + 1 : 2 * hi : 2])
    wanted, out = excess[at] - 1, np.full(len(at), -1, dtype=np.int64)

    def look(who: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Look from start to the end of its block; those of who not found."""
        where = start.copy()
        while len(who):
            inside = where // PARENTHESES == start // PARENTHESES
            hit = inside & (padded[np.minimum(where, len(padded) - 1)] == wanted[who])
            out[who[hit]] = where[hit]
            missed.append(who[~inside])
            go = inside & ~hit
            who, where, start = who[go], where[go] + 1, start[go]
        return np.concatenate(missed) if missed else who

    missed: list[np.ndarray] = []
    # the opening one itself has a higher excess, so its own place is a harmless start
    rest = look(np.arange(len(at)), at)
    if len(rest):
        node, found = at[rest] // PARENTHESES + leaves, np.zeros(len(rest), dtype=bool)
        reaches = lambda v: (least[v] <= wanted[rest]) & (most[v] >= wanted[rest])
        while not found.all():
            right = ~found & (node % 2 == 0) & reaches(np.minimum(node + 1, 2 * leaves - 1))
            node = np.where(right, node + 1, np.where(found, node, node // 2))
            found |= right
        while (node < leaves).any():
            first = reaches(np.minimum(2 * node, 2 * leaves - 1))
            node = np.where(node < leaves, np.where(first, 2 * node, 2 * node + 1), node)
        missed.clear()
        look(rest, (node - leaves) * PARENTHESES)
    return out


def _end_hashes(ends: DataFrame) -> DataFrame:
    """p, h1, h2, sha: of the conversations that end at a node, by id."""
    counted = ends.groupBy(*KEY).agg(F.count("*").alias("m"))
    known = ends.join(counted, KEY)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    listed = known.where(F.col("m") <= LISTED).groupBy(*KEY).agg(F.sha2(text, 256).alias("sha"))
    many = known.where(F.col("m") > LISTED).select(*KEY, "c")
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = many.repartitionByRange(parts, *KEY, "c").sortWithinPartitions(*KEY, "c").mapInArrow(_packed, "p long, h1 long, h2 long, first long, ids binary")
    # a hash runs over its ids in order: one stream a node, of packed rows that pass by
    hashed = packed.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed, "p long, h1 long, h2 long, sha string")
    return listed.unionByName(hashed)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of one node, at most LISTED in a row, with the first of them."""
    for batch in (b for b in batches if b.num_rows):
        keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
        ids = batch.column(3).to_numpy()
        cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        bounds = np.concatenate([np.arange(a, b, LISTED) for a, b in zip(cut, np.r_[cut[1:], len(ids)], strict=True)])
        text = [",".join(map(str, ids[a:b].tolist())).encode() for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[bounds, i]) for i in range(3)), pa.array(ids[bounds]), pa.array(text, pa.binary())], names=["p", "h1", "h2", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    row = lambda: pa.RecordBatch.from_pylist([{"p": key[0], "h1": key[1], "h2": key[2], "sha": state.hexdigest()}], schema=pa.schema([("p", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sha", pa.string())]))
    for batch in batches:
        for *own, _, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if own == key:
                state.update(b"," + ids)
                continue
            if key is not None:
                yield row()
            key, state = own, hashlib.sha256(ids)
    if key is not None:
        yield row()


ORACLE = r"""
WITH placed AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, i + 1, 1))::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), range(0, 8)), lambda v, k: CASE v & 1 WHEN 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS v FROM (SELECT DISTINCT c FROM placed)),
convs AS (SELECT c, c - c % 20 AS b, xor(v, 4294967295) % 4 AS h FROM crc),
lent AS (SELECT v.c, 0 AS part, p.pos, p.role, p.text FROM convs v JOIN placed p ON p.c = v.b AND p.pos <= v.h
  UNION ALL SELECT v.c, 1, p.pos, p.role, p.text FROM convs v JOIN placed p ON p.c = v.c AND p.pos > v.h),
rows_ AS (SELECT c, row_number() OVER w AS p, text, list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
  FROM lent WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
every AS (SELECT c, p, text, path FROM rows_ UNION ALL SELECT c, 0, '', []::VARCHAR[] FROM convs),
last AS (SELECT c, max(p) AS total FROM every GROUP BY c),
nodes AS (SELECT p, path, min(c) AS c, count(*) AS n, any_value(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (p = total), '')) AS sha
  FROM every JOIN last USING (c) GROUP BY p, path),
kids AS (SELECT path[1:p - 1] AS path, count(*) AS k FROM nodes WHERE p > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids USING (path)),
under AS (SELECT path[1:d] AS path, (k = 0)::INT AS leaf, (n - 1) * w AS s FROM (SELECT *, unnest(range(0, p + 1)) AS d FROM known)),
total AS (SELECT path, sum(leaf)::BIGINT AS leaves, sum(s)::BIGINT AS saved FROM under GROUP BY path)
SELECT k.c AS conv_id, k.p AS depth, u.c AS parent_conv_id, k.n AS n_convs, k.k AS n_children, t.leaves AS n_leaves, t.saved AS saved_tokens, k.sha AS ends_sha256
FROM known k JOIN total t USING (path) LEFT JOIN nodes u ON k.p > 0 AND u.path = k.path[1:k.p - 1] AND u.p = k.p - 1
"""
