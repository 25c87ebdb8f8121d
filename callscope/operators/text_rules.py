"""Rule-based text checks: spoken style, sentence rules, register, and rules over parsed tokens."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.patterns import words_in
from .common import dim, union

#: Written-style marks in spoken text, in the order in which an earlier one wins: fixed values.
STYLE_RULES: list[tuple[str, str]] = [
    ("code_block", r"(?m)^[ \t　]*```[^\r\n]*"),
    ("table", r"(?m)^[^\r\n]*[|｜][^\r\n]*$"),
    ("heading", r"(?m)^[ \t　]*[#＃]+[ \t　]*\S[^\r\n]*"),
    ("bold", r"\*\*[^\r\n*]+\*\*"),
    ("numbered", r"(?m)^[ \t　]*(?:[0-9０-９]+[.．][ \t　]+|[0-9０-９]+[)）][ \t　]*|[(（][0-9０-９]+[)）][ \t　]*)[ \t　]*\S[^\r\n]*"),
    ("bullet", r"(?m)^[ \t　]*(?:(?:[-*－＊﹣−][ \t　]+)|・[ \t　]*)\S[^\r\n]*"),
    ("url", r"(?i)(?:https?://|www\.)[^\s<>()]+"),
    ("paragraph", r"\r?\n[ \t　]*\r?\n"),
    ("hard_break", r"(?<![ \t])[ \t]{2,}\r?\n(?=[ \t　]*\S)"),
    ("digit_punctuation", r"(?:\d(?:[-:/,.]\d)+|\d[-:/,.]|[-:/,.]\d)"),
    ("identifier", r"(?<![a-z_])(?=[a-z_]{6,}(?![a-z_]))[a-z_]*_[a-z_]+(?![a-z_])"),
    ("long_sentence", r"[^。！？]{201,}"),
]
BOUNDARY = "[。！？]"
MIN_REPEAT = 20
SPANS = T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def _marks(text: str, rules: list[tuple[str, re.Pattern]]) -> list[dict]:
    """Accepted matches, kept sorted by place, so each test looks at two neighbours."""
    starts: list[int] = []
    kept: list[dict] = []
    for rule, pattern in rules:
        for m in pattern.finditer(text):
            at = bisect_left(starts, m.end())
            if at and kept[at - 1]["e"] > m.start():
                continue
            starts.insert(at, m.start())
            kept.insert(at, {"rule": rule, "s": m.start(), "e": m.end()})
    return kept


@pandas_udf(SPANS)
def style_marks(texts: pd.Series) -> pd.Series:
    """Places of written-style marks; one that overlaps an earlier rule's doesn't count. Which match
    wins depends on all earlier ones, so this is an Arrow function and no column expression."""
    rules = [(name, re.compile(pattern)) for name, pattern in STYLE_RULES]
    return texts.map(lambda t: _marks(t or "", rules))


def style_spans(turns: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep..., rule, s, e): every counted mark, start and end (exclusive) in characters."""
    return turns.select(*keep, F.explode(style_marks(F.col(text_col))).alias("m")).select(*keep, "m.*")


def style_violations(turns: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep..., rule, n): counted matches of each rule in a text."""
    return style_spans(turns, text_col, keep).groupBy(*keep, "rule").agg(F.count("*").alias("n"))


def sentences(text: Column) -> Column:
    """Sentences that a boundary ends, without their blanks."""
    # split, as a pattern for a sentence would try every place of a text without a boundary to its end
    parts = F.split(text, BOUNDARY, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)\s+", "")), lambda s: s != "")


def repeated_sentences(turns: DataFrame, text_col: str, keep: list[str], least: int = MIN_REPEAT) -> DataFrame:
    """Ended sentences of `least` characters or more that a turn holds more than once."""
    s = turns.select(*keep, F.explode(sentences(F.coalesce(F.col(text_col), F.lit("")))).alias("sentence")).where(F.char_length("sentence") >= least)
    return s.groupBy(*keep, "sentence").agg((F.count("*") - 1).alias("repeats")).where("repeats > 0")


def spoken_style(turns: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep..., rule): a row for every mark of written style and every time that a turn repeats a sentence."""
    again = repeated_sentences(turns, text_col, keep).select(*keep, F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("_i"))
    return style_spans(turns, text_col, keep).select(*keep, "rule").unionByName(again.select(*keep, F.lit("duplicate_sentence").alias("rule")))


#: Bracket pairs, opening and closing at the same place: fixed values.
OPEN, CLOSE = "「『（(［[【", "」』）)］]】"


def brackets_balanced(text: Column) -> Column:
    """Whether brackets nest properly; a fold over the brackets with a stack of text."""
    only = F.split(F.regexp_replace(text, r"[^「」『』（）()［］\[\]【】]", ""), "")

    def step(stack: Column, c: Column) -> Column:
        opens, closes = F.instr(F.lit(OPEN), c), F.instr(F.lit(CLOSE), c)
        top = F.right(stack, F.lit(1))
        fits = (stack != "") & (F.instr(F.lit(OPEN), top) == closes)
        return F.when((c == "") | (stack == "!"), stack).when(opens > 0, F.concat(stack, c)).when(fits, F.substring(stack, F.lit(1), F.char_length(stack) - 1)).otherwise(F.lit("!"))

    return F.aggregate(only, F.lit(""), step) == ""


#: Japanese text, malformed endings, polite endings, examples and doubled honorifics: fixed values.
JAPANESE = "[ぁ-んァ-ヶ一-龯々〆ヵヶ]"
MALFORMED = r"(?:ですます|ますです|ございますです|くださいです|させていただかせ)"
POLITE = r"(?:です|でした|ます|ました|ません|ませんでした|ください|くださいませ|でしょう)(?:よね|かね|か|ね|よ)?[」』）)\]］】]*$"
TRAILING_EXAMPLE = r"(?:（|\()(?:例[:：]).*(?:）|\))$"
EXAMPLE = ("例:", "例：")
DOUBLE_HONORIFIC = r"ご(?:予約|依頼|搭乗)され(?:ている|た|る)(?:方|ご本人)"


def facing_places(text: Column) -> Column:
    """Sentences, the last one ended or not, trimmed, empty ones left out: (s, e, t), from the first character
    of the sentence to its boundary."""
    kind = "array<struct<s:int,e:int,t:string>>"
    body = lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")
    lead = lambda p: F.char_length(p) - F.char_length(F.regexp_replace(p, r"(?U)^\s+", ""))

    def step(acc: Column, p: Column) -> Column:
        place = F.struct((acc["at"] + lead(p)).alias("s"), (acc["at"] + F.char_length(p)).alias("e"), body(p).alias("t"))
        out = F.when(body(p) != "", F.concat(acc["out"], F.array(place))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.char_length(p) + 1).alias("at"), out.alias("out"))

    return F.aggregate(F.split(text, BOUNDARY, -1), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def impolite_sentences(text: Column, marks: Column | None = None) -> Column:
    """Sentences in Japanese that don't end politely, examples and those that touch a mark of written style
    (an array with s and e) aside."""
    places = facing_places(text)
    if marks is not None:
        places = F.filter(places, lambda p: ~F.exists(marks, lambda m: (p["s"] < m["e"]) & (p["e"] > m["s"])))
    bare = F.transform(places, lambda p: F.regexp_replace(F.regexp_replace(p["t"], TRAILING_EXAMPLE, ""), r"(?U)\s+$", ""))
    example = lambda s: F.startswith(s, F.lit(EXAMPLE[0])) | F.startswith(s, F.lit(EXAMPLE[1]))
    return F.filter(bare, lambda s: (s != "") & ~example(s) & s.rlike(JAPANESE) & ~s.rlike(POLITE))


def japanese_rules(turns: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Per turn: Japanese present, brackets balanced, malformed endings, double honorifics, and
    impolite sentences (outside of marks of written style)."""
    turns = turns.withColumn("_marks", style_marks(F.col(text_col)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return turns.select(
        *keep,
        text.rlike(JAPANESE).alias("has_japanese"),
        brackets_balanced(text).alias("balanced"),
        F.regexp_count(text, F.lit(MALFORMED)).cast("bigint").alias("malformed"),
        F.regexp_count(text, F.lit(DOUBLE_HONORIFIC)).cast("bigint").alias("double_honorifics"),
        F.size(impolite_sentences(text, F.col("_marks"))).cast("bigint").alias("impolite_sentences"),
    )


#: Rules that one expression holds at most.
RULES_AT_ONCE = 500
SPECIAL = set(r"\^$.|?*+()[]{}")


def closed_misuse(turns: DataFrame, rules: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Rules given as rows (rule_id, pattern): a new rule needs no code.

    Rules that are plain words go through one automaton, the others are expressions over each text, compiled
    once a task; texts and rules never meet in a join.
    """
    rows = [(r["rule_id"], r["pattern"]) for r in rules.select("rule_id", "pattern").toLocalIterator() if r["pattern"]]
    plain = [(i, p) for i, p in rows if not SPECIAL & set(p)]
    found = []
    if plain:
        named = turns.sparkSession.createDataFrame(plain, rules.select("rule_id", "pattern").schema)
        hit = words_in(turns.select(*keep, F.col(text_col).alias("_text")), "_text", named.select("pattern"), "pattern").drop("_text")
        found.append(hit.join(dim(named), "pattern").select(*keep, "rule_id"))
    others = [(i, p) for i, p in rows if SPECIAL & set(p)]
    for at in range(0, len(others), RULES_AT_ONCE):
        each = [F.when(F.regexp_like(text_col, F.lit(p)), F.lit(i)) for i, p in others[at : at + RULES_AT_ONCE]]
        broken = F.filter(F.array(*each), lambda x: x.isNotNull())
        found.append(turns.select(*keep, F.explode(broken).alias("rule_id")))
    return union(found) if found else turns.select(*keep).limit(0).join(rules.select("rule_id").limit(0))


#: Case particles that may not stand twice in a row: fixed values.
CASE_PARTICLES = ("を", "が", "は", "に", "で", "と", "へ")


def doubled_particles(tokens: DataFrame) -> DataFrame:
    """Adjacent equal case particles without a gap. tokens: run_id, turn_ref, sentence_id, token_id,
    lemma, pos, start_char, end_char."""
    w = Window.partitionBy("run_id", "turn_ref", "sentence_id").orderBy("token_id")
    before = lambda c: F.lag(c).over(w)
    t = tokens.withColumns({"_lemma": before("lemma"), "_pos": before("pos"), "_end": before("end_char")})
    same = F.col("lemma").isin(*CASE_PARTICLES) & (F.col("lemma") == F.col("_lemma")) & (F.col("pos") == "ADP") & (F.col("_pos") == "ADP") & (F.col("_end") == F.col("start_char"))
    return t.where(same).select("run_id", "turn_ref", "sentence_id", "token_id", "lemma")


#: Whom a predicate's speech level may speak of, and of whom it speaks where no subject is named: fixed values.
ALLOWED = {"honorific": ("customer", "out_group"), "humble": ("self", "in_group")}
DEFAULT_RELATION = {"honorific": "customer", "humble": "self"}


def honorific_direction(tokens: DataFrame, levels: DataFrame, persons: DataFrame) -> DataFrame:
    """Predicates whose speech level disagrees with their subject.

    levels: lemma, level ('honorific' or 'humble'); persons: surface, relation ('self', 'in_group',
    'customer' or 'out_group'). The subject is the predicate's nsubj token, else the level's default.
    """
    predicates = tokens.join(dim(levels), "lemma")
    subjects = tokens.where(F.col("dep") == "nsubj").join(dim(persons), F.col("text") == F.col("surface"))
    subjects = subjects.select("run_id", "turn_ref", "sentence_id", F.col("head_token_id").alias("token_id"), "relation")
    p = predicates.join(subjects, ["run_id", "turn_ref", "sentence_id", "token_id"], "left")
    pick = lambda of: F.when(F.col("level") == "honorific", of("honorific")).otherwise(of("humble"))
    relation = F.coalesce("relation", pick(lambda k: F.lit(DEFAULT_RELATION[k])))
    fine = pick(lambda k: relation.isin(*ALLOWED[k]))
    return p.where(~fine).select("run_id", "turn_ref", "sentence_id", "token_id", "lemma", "level", relation.alias("relation"))


#: Suffixes of respect, relations that may not carry one, and what stands before a person of either
#: side: fixed values.
SUFFIXES = ("様",)
OWN_SIDE = ("self", "in_group")
CUSTOMER_BEFORE = ("御社", "貴社", "お客様の", "ご", "お")
OPERATOR_BEFORE = ("弊社", "当社", "弊社の", "当社の", "弊社の担当", "当社の担当", "弊社の担当の", "当社の担当の")


def in_group_suffix(turns: DataFrame, persons: DataFrame, text_col: str, keep: list[str], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(keep..., surface, occurrences, violations, unresolved): persons named with a suffix of respect.

    After a word of the customer's side an occurrence is fine, after one of the operator's it's a
    violation; else the person's relation decides, and where a surface has several it's unresolved.
    persons: surface, relation (a small table).
    """
    known = persons.groupBy("surface").agg(F.collect_set("relation").alias("_relations"), F.count("*").alias("_n"))
    hit = words_in(turns, text_col, known.select("surface"), "surface").join(dim(known), "surface")
    name = F.concat(F.lit(r"\Q"), F.col("surface"), F.lit(rf"\E(?:{'|'.join(suffixes)})"))
    count = lambda before: F.regexp_count(F.col(text_col), F.concat(F.lit(before), name))
    theirs, ours = "|".join(CUSTOMER_BEFORE), "|".join(OPERATOR_BEFORE)
    out = hit.withColumns({"occurrences": count(""), "_ours": count(f"(?<!{theirs})(?<={ours})"), "_plain": count(f"(?<!{theirs})(?<!{ours})")})
    own = F.array_contains(F.array(*[F.lit(x) for x in OWN_SIDE]), F.get("_relations", F.lit(0)))
    one = F.col("_n") == 1
    violations = F.col("_ours") + F.when(one & own, F.col("_plain")).otherwise(0)
    unresolved = F.when(~one, F.col("_plain")).otherwise(0)
    return out.where("occurrences > 0").select(*keep, "surface", F.col("occurrences").cast("bigint").alias("occurrences"), violations.cast("bigint").alias("violations"), unresolved.cast("bigint").alias("unresolved"))


def roll_up(turns: DataFrame, violations: DataFrame, key: str = "run_id", turn: str = "turn_ref") -> DataFrame:
    """Per run: fail on any violation, N/M without utterances; share of turns without one."""
    bad = violations.groupBy(key, turn).agg(F.count("*").alias("v"))
    t = turns.join(bad, [key, turn], "left")
    out = t.groupBy(key).agg(F.sum(F.coalesce("v", F.lit(0))).alias("violations"), F.avg(F.col("v").isNull().cast("double")).alias("pass_rate"), F.count("*").alias("turns"))
    return out.withColumn("status", F.when(F.col("turns") == 0, "N/M").when(F.col("violations") > 0, "fail").otherwise("pass"))
