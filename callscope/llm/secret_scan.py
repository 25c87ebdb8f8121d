"""Secret scans: fixed rules, and two character Markov models compared by log-likelihood ratio.

The labelled samples come from the corpus itself: strings that the rules confirm (values assigned
to a secret's name, access ids, long hex) are random strings; identifier-like words outside them
are ordinary. First-order transitions of both classes are counted by Spark over all documents. A
candidate token, outside the rules' spans and with a letter in it, is a secret when the mean log-likelihood ratio of its transitions, random against ordinary, and its sum
pass their thresholds. Everything runs in native column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILL, blanked, joined_spans, kept_columns, overlaid, with_spans

#: The fixed rules. Quantifiers are widened into the pattern only where that cannot change a match.
ASSIGN = r"""(?:(?i)(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "model"]

#: Candidates hold a letter: a number alone is an amount, an id or a card, which op8 looks at.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: Ordinary identifiers, as labelled samples: letters, with at most a few digits at the end, so that
#: keys which no rule names hardly ever enter the ordinary class.
IDENTIFIER = r"(?<![A-Za-z0-9+/_-])[A-Za-z_][A-Za-z_-]{7,}+[0-9]{0,4}+(?![A-Za-z0-9+/_=-])"

#: Transition table over the ASCII codes from '+' to 'z'.
FIRST, CODES = ord("+"), ord("z") - ord("+") + 1
RANDOM_ALPHABET = 36

#: Least mean and sum of the log-likelihood ratio, chosen on held-out strings (see the README).
MIN_MEAN, MIN_SUM = 1.0, 16.0


def _value(m: Column) -> Column:
    return F.regexp_extract(m, ASSIGN, 2)


def _long_enough(m: Column) -> Column:
    return F.char_length(_value(m)) >= 8


def _base(docs: DataFrame, text: str) -> DataFrame:
    """Spans of the rules, and _rest: the text with these spans blanked."""
    out = with_spans(docs, text, {"_assign": ASSIGN, "_access": ACCESS, "_hex": HEX})
    out = out.withColumn("_assign", F.filter("_assign", lambda x: _long_enough(x["m"])))
    hidden = lambda c, p, valid=None: F.when(F.size(c) > 0, blanked(F.col(text), p, valid))
    return out.withColumn("_rest", F.coalesce(overlaid([hidden("_assign", ASSIGN, _long_enough), hidden("_access", ACCESS), hidden("_hex", HEX)]), F.col(text)))


def _codes(token: Column) -> Column:
    """Codes of the characters, letters in lower case: how a name is written says little, and the
    ordinary class of one corpus hardly holds other corpora's capitals."""
    return F.transform(F.split(F.lower(token), ""), lambda c: F.ascii(c) - F.lit(FIRST))


def train(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Log-likelihood ratio of every transition (row: from, column: to), a table of fixed size, counted
    over all documents. Equal strings are added up before they are cut into transitions."""
    found = _base(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_text")
    samples = F.concat(
        F.transform("_assign", lambda x: F.struct(F.lit(1).alias("label"), _value(x["m"]).alias("m"))),
        *[F.transform(c, lambda x: F.struct(F.lit(1).alias("label"), x["m"].alias("m"))) for c in ("_access", "_hex")],
        F.transform(F.regexp_extract_all(F.col("_rest"), F.lit(IDENTIFIER), F.lit(0)), lambda m: F.struct(F.lit(0).alias("label"), m.alias("m"))),
    )
    each = found.select(F.explode(samples).alias("x")).groupBy("x.label", "x.m").agg(F.count("*").alias("n"))
    each = each.select("label", "n", _codes(F.col("m")).alias("c")).where(F.size("c") > 1)
    steps = each.select("label", "n", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * CODES + b)).alias("step"))
    counts = [[0] * (CODES * CODES) for _ in range(2)]
    for label, step, n in steps.groupBy("label", "step").agg(F.sum("n")).collect():  # at most 2 * CODES^2 rows
        if 0 <= step < CODES * CODES:
            counts[label][step] = n
    ratio = []
    alnum = [chr(FIRST + c).isalnum() for c in range(CODES)]
    for a in range(CODES):
        ordinary, random = ([x if ok else 0 for x, ok in zip(counts[k][a * CODES : (a + 1) * CODES], alnum, strict=True)] for k in (0, 1))
        n_ordinary, n_random = sum(ordinary), sum(random)
        for b in range(CODES):
            if not (alnum[a] and alnum[b]):
                # signs part the words of a name or a path; they tell nothing
                ratio.append(0.0)
                continue
            # half of the random model is uniform over its alphabet: unseen keys are random too
            p_random = 0.5 / RANDOM_ALPHABET + 0.5 * ((random[b] / n_random) if n_random else 1 / RANDOM_ALPHABET)
            p_ordinary = (ordinary[b] + 0.1) / (n_ordinary + 0.1 * CODES)
            ratio.append(round(math.log(p_random / p_ordinary), 4))
    return ratio


def _alnum(code: Column) -> Column:
    return code.between(ord("0") - FIRST, ord("9") - FIRST) | code.between(ord("a") - FIRST, ord("z") - FIRST)


def _score(token: Column, table: Column) -> Column:
    """(sum, n): the log-likelihood ratios along a token, and how many steps between letters or digits."""
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(acc: Column, code: Column) -> Column:
        counts = _alnum(acc["last"]) & _alnum(code)
        gain = F.when(counts, F.get(table, acc["last"] * CODES + code)).otherwise(F.lit(0.0))
        return F.struct(code.alias("last"), (acc["sum"] + gain).alias("sum"), (acc["n"] + counts.cast("int")).alias("n"))

    return F.aggregate(_codes(token), zero, step, lambda acc: F.struct(acc["sum"].alias("sum"), acc["n"].alias("n")))


def _scanned(docs: DataFrame, ratio: list[float], id_col: str, text_col: str, keep: list[str], min_mean: float, min_sum: float) -> DataFrame:
    """The id, kept columns, spans of every kind, and _rest (the text without the rules' spans)."""
    table = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<double>")
    picked = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = with_spans(_base(picked, "_text"), "_rest", {"_token": TOKEN})
    scored = F.transform("_token", lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), t["m"].alias("m"), _score(F.rtrim(t["m"], F.lit("=")), table).alias("llr")))
    out = out.withColumn("_scored", F.when(F.size("_token") > 0, scored).otherwise(F.array().cast("array<struct<s:int,e:int,m:string,llr:struct<sum:double,n:int>>>")))
    passing = F.filter("_scored", lambda t: (t["llr"]["sum"] >= min_sum) & (t["llr"]["sum"] >= min_mean * t["llr"]["n"]))
    return out.select(id_col, *keep, F.col("_assign").alias("assign"), F.col("_access").alias("access"), F.col("_hex").alias("hex"), passing.alias("model"), "_rest")


def scan(docs: DataFrame, ratio: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, min_mean: float = MIN_MEAN, min_sum: float = MIN_SUM) -> DataFrame:
    """Find secrets in every whole text, one narrow pass.

    Returns id_col, the columns in keep, and arrays of (s, e, m): assign, access, hex by the rules,
    model for tokens that the Markov models add outside of those. A null text counts as empty and
    an empty text has no spans; a very long text takes time in proportion to its length. Rows are kept
    one to one, repeated rows and null ids included; an empty table gives no rows. A kept column with
    the name of a result column is refused; columns of docs that are not named are ignored.
    """
    keep = kept_columns(keep, id_col, tuple(KINDS))
    ratio = train(docs, text_col) if ratio is None else ratio
    return _scanned(docs, ratio, id_col, text_col, keep, min_mean, min_sum).drop("_rest")


def ordered(kinds: list[str], names: list[str]) -> Column:
    """All spans of the given columns by start, then kind as listed."""
    def labelled(i: int) -> Column:
        return F.transform(F.col(kinds[i]), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"), F.lit(names[i]).alias("kind")))

    every = F.concat(*[labelled(i) for i in range(len(kinds))])
    return F.array_sort(every)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest of the rules' spans, and all spans, of what scan() returns."""
    base = KINDS[:3]
    return found.select(
        id_col,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined_spans(ordered(base, base)), 256).alias("base_sha256"),
        joined_spans(ordered(KINDS, KINDS)).alias("spans"),
    )


def redact(docs: DataFrame, ratio: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret in the text replaced by a mask; spans that overlap or touch become one.

    Of an assignment the whole match is masked. Null texts stay null, texts without secrets stay as
    they are; rows stay one to one, whatever their ids; columns keep their names and order.
    """
    keep = docs.columns
    ratio = train(docs, text_col) if ratio is None else ratio
    renamed = {c: f"_in_{c}" for c in keep}
    inner = docs.select(*[F.col(c).alias(renamed[c]) for c in keep])
    found = _scanned(inner, ratio, renamed[id_col], renamed[text_col], [c for c in renamed.values() if c != renamed[id_col]], MIN_MEAN, MIN_SUM)
    strings = F.transform("model", lambda x: x["m"])
    hidden = F.when(F.size("model") > 0, blanked(F.col("_rest"), TOKEN, lambda m: F.array_contains(strings, m))).otherwise(F.col("_rest"))
    some = F.size("assign") + F.size("access") + F.size("hex") + F.size("model") > 0
    masked = F.when(some, F.regexp_replace(hidden, FILL + "+", mask.replace("\\", "\\\\").replace("$", "\\$"))).otherwise(F.col(renamed[text_col]))
    return found.select(*[masked.alias(c) if c == text_col else F.col(renamed[c]).alias(c) for c in keep])
