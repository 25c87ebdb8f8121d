"""Personal data: fixed rules, and bootstrapped contextual extraction of unseen identifiers.

Seeds are what the rules confirm, by kind. Lexical patterns are induced from the whole words around a
seed, "w2 w1 _" and "w1 _ w3" (lower case, digits written 0); their slot may hold any word of the corpus,
with digits or without. Patterns and the strings in their slots are a graph, and a few rounds pass
confidence along it, by kind: a pattern's is the weight of its strings over their number, smoothed, and
an unseen string takes the best confidence of its patterns. A string in the slot of a pattern that ends
above the threshold, with enough support, is a discovered identifier. Patterns around too few of a kind's seeds, or hardly
ever filled by seeds, never enter the graph; a string that a rule's check rejects (a number without a
right checksum) counts against its patterns and is never discovered.
All steps are native joins, groupings and column expressions; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILL, REJECTED, blanked, checkpointed, joined_spans, overlaid, with_spans

#: The fixed rules, written possessively so that long texts neither backtrack nor overflow the stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
RULES = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
KINDS = [*RULES]
NAMES = [*KINDS, "context"]

BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BLANKS = "\t\n\x0b\x0c\r"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
ROUNDS = 3
SMOOTHING = 1.0
MIN_CONFIDENCE = 0.6
MIN_SUPPORT = 3
#: Least part of its kind's seeds that a context surrounds, and least share of its slots that seeds fill.
MIN_PART, MIN_SHARE = 0.001, 0.05
#: Most texts with discovered words that are broadcast (their keys and words); beyond it the join shuffles.
BROADCAST_FOUND = 100_000


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(m)), ""), lambda d: d.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


#: What a match must meet besides its pattern.
VALID = {
    "ip": lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": lambda m: F.when(F.length(_digits(m)) <= 19, _luhn(m)).otherwise(F.lit(False)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _valid(kind: str, matches: Column) -> Column:
    return F.filter(matches, lambda x: VALID[kind](x["m"])) if kind in VALID else matches


def _base(docs: DataFrame, text: str) -> DataFrame:
    """The rules' spans, and _rest: the text with them, and what their checks reject, blanked."""
    out = with_spans(docs, text, RULES)
    hidden = [F.when(F.size(k) > 0, blanked(F.col(text), p, VALID.get(k), mark_rejected=True)) for k, p in RULES.items()]
    out = out.withColumn("_rest", F.coalesce(overlaid(hidden), F.col(text)))
    return out.withColumns({k: _valid(k, F.col(k)) for k in VALID})


def _plain(text: Column) -> Column:
    """Every blank a space, lower case, digits written 0."""
    return F.translate(F.lower(text), BLANKS + "123456789", " " * len(BLANKS) + "0" * 9)


def _around(text: Column, pattern: str) -> Column:
    """Per match of a pattern: m, and the words before (l2, l1) and after (r) it; empty where there is
    none, or where the match is not a whole word but for signs at its end."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    # the words of a piece that touch a match: the last two before it, and the first behind its signs
    before = F.transform(F.slice(between, F.lit(1), F.size(found)), lambda p: F.split(F.substring_index(_plain(p), " ", -3), " "))
    after = F.transform(F.slice(between, F.lit(2), F.size(found)), lambda p: F.split(F.substring_index(_plain(p), " ", 2), " "))

    def one(m: Column, b: Column, a: Column) -> Column:
        word = lambda arr, i: F.coalesce(F.get(arr, i), F.lit(""))
        whole = word(b, F.size(b) - 1) == ""
        part = lambda i: F.when(whole & (F.size(b) >= i), word(b, F.size(b) - i)).otherwise(F.lit(""))
        right = F.when(~word(a, F.lit(0)).rlike(r"[\p{L}\p{N}]"), word(a, F.lit(1))).otherwise(F.lit(""))
        return F.struct(m.alias("m"), part(3).alias("l2"), part(2).alias("l1"), right.alias("r"))

    return F.zip_with(F.arrays_zip(found.alias("m"), before.alias("b")), after, lambda x, a: one(x["m"], x["b"], a))


def _contexts(x: Column) -> Column:
    """The contexts around a slot; one that lacks a word is empty."""
    two = F.when((x["l2"] != "") & (x["l1"] != ""), F.concat(x["l2"], F.lit(" "), x["l1"], F.lit(" _"))).otherwise(F.lit(""))
    around = F.when((x["l1"] != "") & (x["r"] != ""), F.concat(x["l1"], F.lit(" _ "), x["r"])).otherwise(F.lit(""))
    return F.array(two, around)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Find personal data in every whole text.

    Returns id_col and arrays of (s, e, m): email, ip, card, phone by the rules, context for words
    that the bootstrapped patterns add, signs at their ends left out. A null text counts as empty; an
    empty table or one without seeds gives no context spans; a very long text takes time in
    proportion to its length. Rows are kept one to one: rows that repeat an id and a text are found
    alike, null ids included. Columns of docs that are not named are ignored.
    """
    key = F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), F.col("_id").cast("string")), F.lit("n")), F.lit("\n"), F.col("_text"))))
    picked = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = _base(picked, "_text")

    none = F.array().cast("array<struct<m:string,l2:string,l1:string,r:string>>")
    seen = lambda k, p: F.when(F.size(k) > 0, _valid(k, _around(F.col("_text"), p))).otherwise(none)
    named = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["m"].alias("m"), _contexts(x).alias("p"))
    seeds = F.concat(*[F.transform(seen(k, p), named(k)) for k, p in RULES.items()])
    rows = checkpointed(found.select("_id", key.alias("_key"), *KINDS, seeds.alias("_seeds")))

    uses = rows.select(F.explode("_seeds").alias("x")).select("x.kind", "x.m", F.explode("x.p").alias("pattern")).where("pattern != ''").distinct()
    # at most 2 / MIN_PART patterns a kind, however many seeds there are: 8,000
    known = uses.select("kind", "m").distinct().groupBy("kind").agg(F.count("*").alias("known"))
    frames = uses.groupBy("pattern", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= min_support).join(F.broadcast(known), "kind")
    frames = frames.where(F.col("n") >= F.col("known") * MIN_PART).select("pattern").distinct()
    contexts = _filled(picked, [r["pattern"] for r in frames.collect()])
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    plain = rows.select(F.col("_id").alias(id_col), *KINDS, empty.alias("context"))
    if not contexts:
        return plain
    hits = checkpointed(_slots(picked.withColumn("_key", key), contexts).distinct())
    trusted = patterns(uses.where(F.col("pattern").isin(contexts)), hits, rounds, min_confidence, min_support)
    good = checkpointed(hits.where(~F.contains("m", F.lit(REJECTED))).join(trusted.select("pattern").distinct(), "pattern", "left_semi").select("_key", "m").distinct().groupBy("_key").agg(F.collect_set("m").alias("_found")))
    if not good.limit(1).count():
        return plain
    # only the texts that hold a discovered word are read again
    placed = _places(picked.withColumn("_key", key).join(_small(good), "_key"))
    out = rows.select("_id", "_key", *KINDS).join(placed, "_key", "left")
    return out.select(F.col("_id").alias(id_col), *KINDS, F.coalesce("context", empty).alias("context"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_FOUND else df


def _triples(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Every slot of the texts with its two contexts: pattern and the string in it. Words are parted by
    one blank; a word of a rule's span is FILL."""
    rest = F.translate(F.col("_rest"), BLANKS, " " * len(BLANKS))
    words = F.split(_plain(rest), " ")
    n = F.size("_w")
    each = docs.select(*keep, words.alias("_w"), F.split(rest, " ").alias("_m"))
    # one more word at the end, so that the last one is a slot too
    shift = lambda c, k: F.slice(F.concat(F.col(c), F.array(F.lit(""))), F.lit(k + 1), n)
    zipped = F.arrays_zip(shift("_w", 0).alias("a"), shift("_w", 1).alias("b"), shift("_w", 2).alias("c"), shift("_m", 1).alias("mb"), shift("_m", 2).alias("mc"))
    t = each.select(*keep, F.inline(zipped)).where("a != ''")
    pair = F.array(
        F.when((F.col("b") != "") & (F.coalesce("c", F.lit("")) != ""), F.struct(F.concat("a", F.lit(" "), "b", F.lit(" _")).alias("pattern"), F.col("mc").alias("m"))),
        F.when((F.col("b") != "") & (F.coalesce("c", F.lit("")) != ""), F.struct(F.concat("a", F.lit(" _ "), "c").alias("pattern"), F.col("mb").alias("m"))),
    )
    return t.select(*keep, F.explode(pair).alias("x")).where("x IS NOT NULL").select(*keep, "x.pattern", "x.m")


def _filled(picked: DataFrame, contexts: list[str]) -> list[str]:
    """The contexts whose slots seeds fill often enough. One narrow pass, one count a pattern; contexts are
    few (see scan), so they are looked up in a set and not joined."""
    if not contexts:
        return []
    slots = _triples(_base(picked, "_text").select("_rest"), []).where(F.col("pattern").isin(contexts))
    seen = slots.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(F.contains("m", F.lit(FILL))).alias("seeds"))
    return [r["pattern"] for r in seen.where(F.col("seeds") >= F.col("n") * MIN_SHARE).select("pattern").collect()]


def _slots(keyed: DataFrame, contexts: list[str]) -> DataFrame:
    """(_key, m, pattern): unseen strings in the slots of contexts."""
    slots = _triples(_base(keyed, "_text").select("_key", "_rest"), ["_key"]).where(F.col("pattern").isin(contexts))
    m = F.regexp_replace("m", EDGES, "")
    # a rejected string is no letter or digit, but counts
    m = F.when(F.contains("m", F.lit(REJECTED)), F.col("m")).otherwise(m)
    return slots.where(~F.contains("m", F.lit(FILL))).select("_key", m.alias("m"), "pattern").where("m != ''")


def _places(texts: DataFrame) -> DataFrame:
    """(_key, context): where the words in _found stand in the rest of a text."""
    rest = _base(texts, "_text").select("_key", "_found", "_rest")
    word = with_spans(rest, "_rest", {"_word": r"[^\x20\x09-\x0D￿￾]++"})
    lead = lambda m: F.char_length(m) - F.char_length(F.regexp_replace(m, r"^[^\p{L}\p{N}]+", ""))
    bare = F.transform("_word", lambda x: F.struct((x["s"] + lead(x["m"])).alias("s"), F.regexp_replace(x["m"], EDGES, "").alias("m")))
    kept = F.transform(F.filter(bare, lambda x: F.array_contains("_found", x["m"])), lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.char_length(x["m"])).alias("e"), x["m"].alias("m")))
    return word.select("_key", kept.alias("context")).dropDuplicates(["_key"])


def patterns(uses: DataFrame, hits: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Patterns (pattern, kind, confidence) that end above the threshold.

    uses: seeds (kind, m, pattern); hits: unseen strings (m, pattern). Strings are counted once a pattern,
    and added up per task before they are shuffled; a rejected one never gains weight.
    """
    unseen = hits.select("pattern", "m").distinct().join(uses.select("m", "pattern").distinct(), ["m", "pattern"], "left_anti")
    other = unseen.groupBy("pattern").agg(F.count("*").alias("unseen"))
    seeds = uses.groupBy("pattern", "kind").agg(F.count("*").alias("own"))
    total = seeds.groupBy("pattern").agg(F.sum("own").alias("all"))
    graph = checkpointed(seeds.join(total, "pattern").join(other, "pattern", "left").na.fill(0, ["unseen"]))
    edges = checkpointed(unseen.where(~F.contains("m", F.lit(REJECTED))).join(graph.select("pattern", "kind"), "pattern"))
    g = graph.withColumns({"up": F.lit(0.0), "more": F.lit(0)})
    for turn in range(rounds):
        confidence = (F.col("own") + F.col("up")) / (F.col("all") + F.col("unseen") + F.lit(SMOOTHING))
        trusted = checkpointed(g.withColumn("confidence", confidence).where((F.col("confidence") >= min_confidence) & (F.col("own") + F.col("more") >= min_support)).select("pattern", "kind", "confidence"))
        if turn + 1 < rounds:
            best = edges.join(trusted, ["pattern", "kind"]).groupBy("m", "kind").agg(F.max("confidence").alias("best"))
            weight = edges.join(best, ["m", "kind"]).groupBy("pattern", "kind").agg(F.sum("best").alias("up"), F.count_if(F.col("best") >= 0.5).cast("int").alias("more"))
            g = graph.join(checkpointed(weight), ["pattern", "kind"], "left").na.fill(0.0, ["up"]).na.fill(0, ["more"])
    return trusted


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest of the rules' spans by kind and start, and all spans, of what scan() returns."""
    by_kind = lambda names: F.array_join(F.filter(F.array(*[joined_spans(_named(k)) for k in names]), lambda x: x != ""), ",")
    return found.select(
        id_col,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in NAMES],
        F.sha2(by_kind(KINDS), 256).alias("base_sha256"),
        by_kind(NAMES).alias("spans"),
    )


def _named(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
