"""Queries over values inside texts, transcripts, sources, tickets and audio, on texts made from the given
tables; what each row should give follows from residues of its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import audio, contracts, judge, provenance, quality, report, retrieval, state, text_rules, tickets, values
from ..operators.common import checkpointed
from ..sources import records
from .rule_queries import at, words
from .table_queries import STATE, initial_cells, order_log
from .traces import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def orders_by(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")), F.col("run_id")


# --- values in texts ------------------------------------------------------------------------------------

KANJI = "〇一二三四五六七八九"


@query("""WITH o AS (SELECT o_orderkey AS run_id, o_orderkey AS k, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 24 AS h, o_orderkey % 58 + 1 AS mi FROM orders)
SELECT run_id, k % 3 <> 2 AS day, k % 4 <> 2 AS clock, k % 5 <> 3 AS number, k % 2 = 0 AS phone, k % 3 <> 1 AS plan FROM o""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, times, numbers, phone numbers and plan names in Japanese text, and look-alikes that aren't them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("date").alias("d"))
    k = F.col("run_id")
    day = F.when(k % 3 == 0, text("納品は", F.month("d"), "月", F.dayofmonth("d"), "日です")).when(k % 3 == 1, text(F.year("d"), "/", F.month("d"), "/", F.dayofmonth("d"))).otherwise(text(F.month("d"), "月", F.dayofmonth("d") + 1, "日"))
    h, mi = k % 24, k % 58 + 1
    plain = text(h, "時", mi, "分に")
    clock = F.when(k % 4 == 1, F.when(h >= 13, text("午後", h - 12, "時", mi, "分")).otherwise(plain)).when(k % 4 == 2, text(h, "時", mi + 1, "分")).otherwise(plain)
    n = k + 1000
    number = F.when(k % 5 == 3, text("計", n, "0円")).when(k % 5 == 4, text("計", F.format_number(n.cast("double"), 0), "円")).otherwise(text("計 ", n, " 円"))
    tail = F.lpad((k % 10000).cast("string"), 4, "0")
    phone = text("ゼロサンの1234の", F.when(k % 2 == 0, tail).otherwise(F.lpad(((k + 1) % 10000).cast("string"), 4, "0")))
    plan = F.when(k % 3 == 0, text("スタンダードにします")).when(k % 3 == 1, text("スタンダード", k + 1)).otherwise(text("「スタンダード", k, "」で"))
    hhmm = text(F.lpad(h.cast("string"), 2, "0"), ":", F.lpad(mi.cast("string"), 2, "0"))
    held = lambda t, v, c, kind: ft.holds_typed(t, v.cast("string"), F.lit(c), F.lit(kind))
    return o.select("run_id", held(day, F.col("d"), "", "date").alias("day"), held(clock, hhmm, "", "time").alias("clock"), held(number, n, "", "integer").alias("number"), held(phone, text("03-1234-", tail), "phone", "").alias("phone"), held(plan, text("スタンダード", k), "plan_name", "").alias("plan"))


@query("""WITH o AS (SELECT o_orderkey AS run_id, o_orderkey AS k, o_orderdate AS d FROM orders)
SELECT run_id, '090' || lpad(CAST(k % 100000000 AS VARCHAR), 8, '0') AS phone, 'user' || k || '@mail.jp' AS email, 'アイカワ' AS kana, CASE WHEN k % 3 <> 2 THEN strftime(d, '%Y-%m-%d') END AS day, 'ID' || k || 'ー2' AS spoken, 'a' || k || 'b' AS interaction, 'doc-' || k AS ref,
'第' || (k % 90 + 10) || '号' || k AS compact, k % 90 + 10 AS kanji, k % 2 = 0 AS declared, substr(sha256(CAST(k AS VARCHAR)), 1, 12) AS short FROM o""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of full-width, spaced, hiragana and kanji writings."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("date").alias("d"))
    k = F.col("run_id")
    wide = lambda c: F.translate(c.cast("string"), ft.NARROW, ft.WIDE)
    n = k % 90 + 10
    tens = F.element_at(F.array(*[F.lit("" if i == 1 else KANJI[i]) for i in range(1, 10)]), F.floor(n / 10).cast("int"))
    ones = F.element_at(F.array(*[F.lit("" if i == 0 else KANJI[i]) for i in range(10)]), (n % 10 + 1).cast("int"))
    kanji = text(tens, "十", ones)
    day = F.when(k % 3 == 0, text(F.year("d"), "年", F.month("d"), "月", F.dayofmonth("d"), "日")).when(k % 3 == 1, wide(text(F.year("d"), "/", F.month("d"), "/", F.dayofmonth("d")))).otherwise(text(F.year("d"), "/13/", F.dayofmonth("d")))
    return o.select(
        "run_id",
        ft.typed_match(text("０９０－", F.lpad((k % 100000000).cast("string"), 8, "0")), "phone").alias("phone"),
        ft.typed_match(text(" USER", wide(k), "@Mail.JP "), "email").alias("email"),
        ft.typed_match(text("あい カワ"), "kana").alias("kana"),
        ft.normal_date(day).alias("day"),
        ft.spoken_value(text("id ", wide(k), "ー二。")).alias("spoken"),
        ft.interaction_text(text("A-", k, "、 B。")).alias("interaction"),
        ft.document_ref(text("SOP:DOC-", k)).alias("ref"),
        ft.compact(text("「第", kanji, "号」、", wide(k))).alias("compact"),
        ft.kanji_integer(kanji).alias("kanji"),
        ft.contains_spoken(text("はい、ジェイ", kanji, "です"), F.when(k % 2 == 0, text("ジェー ", n)).otherwise(text("ジェー ", n + 100))).alias("declared"),
        ft.short_hash(k.cast("string")).alias("short"),
    )


@query("""WITH o AS (SELECT o_orderkey AS run_id, o_orderkey AS k FROM orders)
SELECT run_id, CASE WHEN k % 3 = 0 THEN 'digits' WHEN k % 3 = 1 THEN 'kana' ELSE 'text' END AS kind, k % 3 <> 0 OR k % 2 = 0 AS shape, CASE WHEN k % 3 = 0 THEN '12,' || (k + 10) || '9' ELSE '' END AS tokens, (k + 10) || '円,18' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ',3日,返金' || CASE WHEN k % 2 = 0 THEN ',連絡' ELSE '' END AS keywords FROM o""")
def value_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, shapes and tokens of values, and the keywords of a disclosure."""
    o, k = orders_by(spark, sf_dir)
    value = F.when(k % 3 == 0, text("１２-", k + 10)).when(k % 3 == 1, text("イシカワ・アヤノ")).otherwise(text("plan ", k))
    other = F.when(k % 3 == 0, F.when(k % 2 == 0, text("98", k + 10)).otherwise(text("9", k + 10))).when(k % 3 == 1, text("タナカ")).otherwise(text("PLAN", k))
    kind = ft.value_kind(value)
    said = text("手数料", F.format_number((k + 10).cast("double"), 0), "円は18:", F.lpad((k % 60).cast("string"), 2, "0"), "までに三日前、返金", at(k, 2, "のご連絡", ""))
    tokens = ft.value_tokens(text("12 番 ", k + 10, " 9"), kind)
    return o.select("run_id", kind.alias("kind"), ft.same_shape(other, value, kind).alias("shape"), F.array_join(F.when(kind == "digits", tokens).otherwise(F.array().cast("array<string>")), ",").alias("tokens"), F.array_join(ft.core_keywords(said), ",").alias("keywords"))


# --- values over transcripts ----------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders), e AS (SELECT k, k % 4 IN (0, 1) AS e1, k % 4 = 0 AS c1, k % 5 <> 0 AS e2, k % 3 <> 0 AS c2, k % 4 <> 3 AS called FROM o),
m AS (SELECT k, 'M20' AS metric_id, 1 AS units, CAST((e1 OR e2) AND (NOT e1 OR c1) AND (NOT e2 OR c2) AS INT) AS good, false AS nm FROM e
UNION ALL SELECT k, 'M25', CAST(e2 AS INT), CAST(e2 AND c2 AS INT), false FROM e
UNION ALL SELECT k, 'M26', CAST(k % 4 = 0 AS INT), CAST(k % 8 = 0 AS INT), k % 7 = 0 AND called FROM e
UNION ALL SELECT k, 'M22', CAST(called AND k % 6 <> 0 AND k % 11 <> 0 AS INT), CAST(called AND k % 6 <> 0 AND k % 11 <> 0 AND k % 9 <> 0 AS INT), called AND k % 6 <> 0 AND k % 11 = 0 FROM e)
SELECT k AS run_id, metric_id, CASE WHEN nm OR k % 13 = 0 THEN 'N/M' WHEN units = 0 THEN 'N/A' WHEN good = units THEN 'passed' ELSE 'failed' END AS status, CAST(CASE WHEN nm OR k % 13 = 0 THEN 0 ELSE units END AS BIGINT) AS units, CAST(CASE WHEN nm OR k % 13 = 0 THEN 0 ELSE good END AS BIGINT) AS passed_units FROM m""")
def value_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phone number a run: said by the customer, passed to a tool, read back, and a disclosure."""
    o, k = orders_by(spark, sf_dir)
    rest = F.lpad((k % 100000000).cast("string"), 8, "0")
    phone = text("090", rest)
    wrong = text("090", F.left(rest, F.lit(7)), (F.right(rest, F.lit(1)).cast("int") + 1) % 10)
    heard = at(k, 3, wrong, phone)
    turn = lambda seq, actor, said, *heard: F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(actor).alias("actor"), said.alias("text"), F.array(*heard).cast("array<string>").alias("transcripts"))
    told = at(k, 9, "手数料五百円です", "手数料500円を返金します")
    four = F.array(turn(0, "user", text("電話は〇九〇-", rest)), turn(1, "operator", F.lit("はい"), text("お電話は", heard), at(k, 5, "なし", text(heard, "ですね"))), turn(2, "user", F.lit("はい")), turn(3, "operator", F.lit("では"), told, text("あの", told)))
    turns = o.select("run_id", F.explode(four).alias("t")).select("run_id", "t.*")
    important = o.select("run_id", F.lit("phone_number").alias("slot_id"), F.lit(None).cast("string").alias("name"), phone.alias("value"), F.lit("phone").alias("value_type"))
    slots = values.slots(important, o.select("run_id", F.lit("tel").alias("name"), phone.alias("value")))
    source = F.when(k % 8 == 4, "unknown").when(k % 4 == 0, "customer_utterance").when(k % 4 == 1, "unknown").otherwise("tool_result")
    args = o.where(k % 4 != 3).select("run_id", F.lit(5).cast("bigint").alias("call_seq"), F.lit("set_tel").alias("tool"), F.lit("tel").alias("name"), at(k, 4, phone, wrong).alias("value"), (k % 7 != 0).alias("ledger"), source.alias("source_kind"))
    contract = o.where(k % 6 != 0).select("run_id", at(k, 11, "ありがとうございます", "手数料500円を返金").alias("disclosure"), F.lit("set_tel").alias("deadline_tool"))
    return values.value_metrics(o.select("run_id", (k % 13 == 0).alias("malformed")), slots, turns, args, contract)


@query("""SELECT o_orderkey AS run_id, 'amount' AS field, CASE WHEN o_orderkey % 3 = 0 THEN 'tool_result' WHEN o_orderkey % 4 <> 0 THEN 'customer_utterance' WHEN o_orderkey % 5 = 0 THEN 'sop_step' WHEN o_orderkey % 7 = 0 THEN 'domain_policy' ELSE 'unknown' END AS source_kind,
CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 4 <> 0 THEN 3 WHEN o_orderkey % 5 = 0 THEN 4 WHEN o_orderkey % 7 = 0 THEN -1 END AS source_seq FROM orders""")
def recorded_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of an amount at the time of the call: failed results count, larger numbers that hold its
    digits don't."""
    o, k = orders_by(spark, sf_dir)
    n = k % 900 + 100
    args = o.select("run_id", F.lit(9).cast("bigint").alias("call_seq"), F.lit("amount").alias("field"), n.cast("string").alias("value"), F.lit("integer").alias("type"))
    source = lambda df, seq, path, v: df.select("run_id", F.lit(seq).cast("bigint").alias("seq"), F.lit(path).alias("path"), v.alias("value"))
    results = source(o.where(k % 3 == 0), 2, "$.error.amount", n.cast("string")).unionByName(source(o, 10, "$.amount", n.cast("string")))
    messages = source(o, 3, "content", text("合計は", n, at(k, 4, "0", ""), "円です"))
    steps = source(o.where(k % 5 == 0), 4, "steps[0]", text("手順 ", n, "円まで"))
    policy = source(o.where(k % 7 == 0), 0, "domain.rule", text("規定 ", n, " 円")).drop("seq")
    return provenance.recorded(args, results, messages, steps, policy).select("run_id", "field", "source_kind", F.col("source_seq").cast("int").alias("source_seq"))


@query("""SELECT o_orderkey AS run_id, 'v' AS field, 'form ' || g AS spoken FROM orders, (SELECT unnest(['identity', 'declared', 'other']) AS g) WHERE g <> 'other' AND NOT (g = 'identity' AND o_orderkey % 3 = 0) AND NOT (g = 'declared' AND o_orderkey % 5 = 0)""")
def declared_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = orders_by(spark, sf_dir)
    args = o.select("run_id", F.lit(1).alias("call_seq"), F.lit("v").alias("field"), k.cast("string").alias("value"))
    one = lambda g, v: F.struct(F.lit(g).alias("grp"), v.cast("string").alias("value"), F.lit(f"form {g}").alias("spoken"))
    inputs = o.select("run_id", F.explode(F.array(one("identity", at(k, 3, k + 1, k)), one("declared", at(k, 5, k + 1, k)), one("other", k))).alias("i")).select("run_id", "i.*")
    return provenance.declared_spoken(args, inputs).select("run_id", "field", "spoken")


# --- style and register over conversations --------------------------------------------------------------

CONV = "WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations), d AS (SELECT *, CASE conv_id % 6 WHEN 0 THEN '- ' || x WHEN 1 THEN '**' || left(x, 9) || '** 12:30' WHEN 2 THEN x || '  ' || chr(10) || 'end_of_it' WHEN 3 THEN '# ' || x || chr(10) || chr(10) || '(1)x' WHEN 4 THEN 'www.a.b/c_d-e ' || x ELSE '| ' || x || ' |' END AS t FROM c)"
PLACES = r"""
p(conv_id, turn, t, rule, o, hits, gaps) AS (SELECT conv_id, turn, t, rule, o, regexp_extract_all(t, pattern), regexp_split_to_array(t, pattern) FROM d, (SELECT unnest(['code_block', 'table', 'heading', 'bold', 'numbered', 'bullet', 'url', 'paragraph', 'hard_break', 'digit_punctuation', 'identifier', 'long_sentence']) AS rule, unnest(range(12)) AS o) JOIN pats USING (rule)),
q AS (SELECT conv_id, turn, t, rule, o, i, hits[i] AS h, list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0) AS s FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM p)),
k AS (SELECT conv_id, turn, rule, o, CAST(s AS INT) AS s, CAST(s + length(h) AS INT) AS e FROM q WHERE (rule <> 'hard_break' OR regexp_matches(substr(t, CAST(s + length(h) + 1 AS INT)), '^[ \t　]*[^\s]')) AND (rule <> 'identifier' OR (length(h) >= 6 AND regexp_matches(h, '_[a-z_]'))))"""


def _greedy(rules: int) -> str:
    """Rule by rule, matches that overlap none of the earlier ones."""
    steps = ["a0 AS (SELECT * FROM k WHERE o = 0)"]
    for i in range(1, rules):
        steps.append(f"a{i} AS (SELECT * FROM a{i - 1} UNION ALL SELECT * FROM k WHERE o = {i} AND NOT EXISTS (SELECT 1 FROM a{i - 1} b WHERE b.conv_id = k.conv_id AND b.turn = k.turn AND b.s < k.e AND b.e > k.s))")
    return ",\n".join(steps)


#: The oracle's own patterns: no look-around, so two rules are checked further above.
ORACLE_PATTERNS = {
    "code_block": r"(?m)^[ \t　]*```[^\r\n]*", "table": r"(?m)^[^\r\n]*[|｜][^\r\n]*$", "heading": r"(?m)^[ \t　]*[#＃]+[ \t　]*\S[^\r\n]*", "bold": r"\*\*[^\r\n*]+\*\*",
    "numbered": r"(?m)^[ \t　]*(?:[0-9０-９]+[.．][ \t　]+|[0-9０-９]+[)）][ \t　]*|[(（][0-9０-９]+[)）][ \t　]*)[ \t　]*\S[^\r\n]*", "bullet": r"(?m)^[ \t　]*(?:(?:[-*－＊﹣−][ \t　]+)|・[ \t　]*)\S[^\r\n]*",
    "url": r"(?i)(?:https?://|www\.)[^\s<>()]+", "paragraph": r"\r?\n[ \t　]*\r?\n", "hard_break": r"[ \t]{2,}\r?\n", "digit_punctuation": r"(?:\d(?:[-:/,.]\d)+|\d[-:/,.]|[-:/,.]\d)", "identifier": "[a-z_]+", "long_sentence": "[^。！？]{201,}",
}
STYLE = CONV + ", pats AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in ORACLE_PATTERNS) + "]) AS rule, unnest([" + ", ".join(f"'{v}'" for v in ORACLE_PATTERNS.values()) + "]) AS pattern)," + PLACES + ",\n" + _greedy(12)


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with written marks put into them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("x"))
    x, r = F.col("x"), F.col("conv_id") % 6
    marked = F.when(r == 0, text("- ", x)).when(r == 1, text("**", F.left(x, F.lit(9)), "** 12:30")).when(r == 2, text(x, "  \nend_of_it")).when(r == 3, text("# ", x, "\n\n(1)x")).when(r == 4, text("www.a.b/c_d-e ", x)).otherwise(text("| ", x, " |"))
    return c.select("conv_id", "turn", "role", marked.alias("t"))


@query(STYLE + " SELECT conv_id, turn, rule, s, e FROM a11")
def style_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of written style in turns, an earlier rule winning."""
    return text_rules.style_spans(styled(spark, sf_dir), "t", ["conv_id", "turn"])


@query(STYLE + """, sn AS (SELECT conv_id, turn, unnest(regexp_extract_all(x, '[^。！？]*[。！？]')) AS s FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'これはとても長い文章です、そして繰り返します。これは とても長い文章です、そして繰り返します。これはとても長い文章です、そして繰り返します。' ELSE '' END || replace(t, chr(10), '。') AS x FROM d)),
rp AS (SELECT conv_id, turn, count(*) - 1 AS n FROM (SELECT conv_id, turn, regexp_replace(replace(replace(replace(s, '。', ''), '！', ''), '？', ''), '[\\s\\v]+', '', 'g') AS sentence FROM sn) WHERE length(sentence) >= 20 GROUP BY conv_id, turn, sentence HAVING count(*) > 1),
v AS (SELECT conv_id, turn, sum(n) AS v FROM (SELECT conv_id, turn, n FROM rp) GROUP BY ALL), w AS (SELECT d.conv_id, d.turn, coalesce(v, 0) AS v FROM d LEFT JOIN v USING (conv_id, turn) WHERE role <> 'user')
SELECT conv_id AS run_id, CAST(sum(v) AS BIGINT) AS violations, avg(CAST(v = 0 AS INT)) AS pass_rate, count(*) AS turns, CASE WHEN sum(v) > 0 THEN 'fail' ELSE 'pass' END AS status FROM w GROUP BY 1""")
def repeat_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated sentences alone, rolled up by run: a third of the turns says a sentence three times."""
    t = styled(spark, sf_dir).where("role <> 'user'").withColumnsRenamed({"conv_id": "run_id", "turn": "turn_ref"})
    long = "これはとても長い文章です、そして繰り返します。"
    said = F.concat(F.when(F.col("turn_ref") % 3 == 1, long + long.replace("これは", "これは ") + long).otherwise(""), F.replace("t", F.lit("\n"), F.lit("。")))
    t = t.withColumn("t", said)
    again = text_rules.spoken_style(t, "t", ["run_id", "turn_ref"]).where("rule = 'duplicate_sentence'")
    return text_rules.roll_up(t, again).select("run_id", "violations", "pass_rate", "turns", "status")


@query(STYLE + """, v AS (SELECT conv_id, turn, count(*) AS v FROM a11 GROUP BY ALL),
sn AS (SELECT conv_id, turn, unnest(regexp_extract_all(t, '[^。！？]*[。！？]')) AS s FROM d),
rp AS (SELECT conv_id, turn, count(*) - 1 AS n FROM (SELECT conv_id, turn, regexp_replace(replace(replace(replace(s, '。', ''), '！', ''), '？', ''), '[\\s\\v]+', '', 'g') AS sentence FROM sn) WHERE length(sentence) >= 20 GROUP BY conv_id, turn, sentence HAVING count(*) > 1),
u AS (SELECT conv_id, turn, sum(v) AS v FROM (SELECT * FROM v UNION ALL SELECT * FROM rp) GROUP BY ALL), w AS (SELECT d.conv_id, d.turn, coalesce(v, 0) AS v FROM d LEFT JOIN u USING (conv_id, turn) WHERE role <> 'user')
SELECT conv_id AS run_id, CAST(sum(v) AS BIGINT) AS violations, avg(CAST(v = 0 AS INT)) AS pass_rate, count(*) AS turns, CASE WHEN sum(v) > 0 THEN 'fail' ELSE 'pass' END AS status FROM w GROUP BY 1""")
def style_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = styled(spark, sf_dir).where("role <> 'user'").withColumnsRenamed({"conv_id": "run_id", "turn": "turn_ref"})
    return text_rules.roll_up(t, text_rules.spoken_style(t, "t", ["run_id", "turn_ref"])).select("run_id", "violations", "pass_rate", "turns", "status")


@query("""SELECT o_orderkey AS run_id, true AS has_japanese, o_orderkey % 3 <> 0 AS balanced, CAST(o_orderkey % 5 = 0 AS BIGINT) AS malformed, CAST(o_orderkey % 7 = 0 AS BIGINT) AS double_honorifics,
CAST(CAST(o_orderkey % 2 = 0 AS INT) + CAST(o_orderkey % 7 = 0 AS INT) + CAST(o_orderkey % 11 = 1 AS INT) AS BIGINT) AS impolite_sentences FROM orders""")
def japanese_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Politeness, brackets and honorifics of made sentences; examples and what touches a written mark don't count."""
    o, k = orders_by(spark, sf_dir)
    said = text("注文", k, "を承りました。", at(k, 2, "明日届く。", "明日届きますよね！"), at(k, 3, "［確認」です。", "［確認］です）」"[:-2] + "。"), at(k, 5, "できるですますか。", ""), at(k, 7, "ご予約されている方？", ""), F.when(k % 11 == 0, "開始は12:30だ。").when(k % 11 == 1, "開始は昼だ。").otherwise(""), "例：届く。以上です（例：急ぐ）")
    return text_rules.japanese_rules(o.withColumn("t", said), "t", ["run_id"])


@query("""WITH c AS (SELECT conv_id, turn, replace(coalesce(text, ''), '.', '。') AS x FROM conversations), d AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN x || x WHEN conv_id % 3 = 1 THEN x || replace(x, ' ', '  ') || x ELSE x END AS t FROM c),
s AS (SELECT conv_id, turn, unnest(regexp_extract_all(t, '[^。！？]*[。！？]')) AS s FROM d), n AS (SELECT conv_id, turn, regexp_replace(replace(replace(replace(s, '。', ''), '！', ''), '？', ''), '[\\s\\v]+', '', 'g') AS sentence FROM s)
SELECT conv_id, turn, sentence, count(*) - 1 AS repeats FROM n WHERE length(sentence) >= 20 GROUP BY ALL HAVING count(*) > 1""")
def repeated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that say themselves once or twice more, with other blanks."""
    x = F.replace(F.coalesce("text", F.lit("")), F.lit("."), F.lit("。"))
    r = F.col("conv_id") % 3
    t = F.when(r == 0, text(x, x)).when(r == 1, text(x, F.replace(x, F.lit(" "), F.lit("  ")), x)).otherwise(x)
    return text_rules.repeated_sentences(table(spark, sf_dir, "conversations").withColumn("t", t), "t", ["conv_id", "turn"])


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS run_id, '田中' AS surface, CAST(2 AS BIGINT) AS occurrences, CAST(CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS violations, CAST(0 AS BIGINT) AS unresolved FROM o
UNION ALL SELECT k, '鈴木', 1, CAST(k % 4 = 0 AS BIGINT), 0 FROM o WHERE k % 2 = 0 UNION ALL SELECT k, '佐藤', 1, 0, 1 FROM o WHERE k % 2 = 1""")
def suffix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of either side named with a suffix of respect, by what stands before them."""
    o, k = orders_by(spark, sf_dir)
    people = spark.createDataFrame([("田中", "self"), ("鈴木", "customer"), ("佐藤", "self"), ("佐藤", "customer")], "surface string, relation string")
    said = text("田中様と", F.when(k % 3 == 0, "お客様の田中様").when(k % 3 == 1, "弊社の担当の田中様").otherwise("御社田中様"), "、", at(k, 4, "当社の鈴木様", at(k, 2, "鈴木様", "佐藤様")))
    return text_rules.in_group_suffix(o.withColumn("t", said), people, "t", ["run_id"])


@query("""WITH l AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i, l_suppkey AS s FROM lineitem),
t AS (SELECT *, ['を', 'が', 'まで', 'に'][s % 4 + 1] AS lemma, CASE WHEN s % 9 = 0 THEN 'NOUN' ELSE 'ADP' END AS pos, CASE WHEN s % 5 = 0 THEN 1 ELSE 0 END AS gap FROM l),
b AS (SELECT *, lag(lemma) OVER w AS pl, lag(pos) OVER w AS pp FROM t WINDOW w AS (PARTITION BY run_id ORDER BY i))
SELECT run_id, CAST(i AS INT) AS token_id, lemma FROM b WHERE lemma = pl AND lemma <> 'まで' AND pos = 'ADP' AND pp = 'ADP' AND gap = 0""")
def doubled_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens made from order lines: doubled case particles, and other words, parts and gaps."""
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    s = F.col("l_suppkey")
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), i.alias("token_id"), F.element_at(words("を", "が", "まで", "に"), (s % 4 + 1).cast("int")).alias("lemma"), at(s, 9, "NOUN", "ADP").alias("pos"), at(s, 5, 1, 0).alias("gap"))
    start = F.col("token_id") * 10 + F.col("gap")
    t = t.select("run_id", F.lit("t").alias("turn_ref"), F.lit(0).alias("sentence_id"), "token_id", "lemma", "pos", start.alias("start_char"), ((F.col("token_id") + 1) * 10).alias("end_char"))
    return text_rules.doubled_particles(t).select("run_id", "token_id", "lemma")


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'いらっしゃる' ELSE '伺う' END AS lemma, CASE WHEN o_orderkey % 3 = 0 THEN 'customer' WHEN o_orderkey % 3 = 1 THEN 'self' WHEN o_orderkey % 2 = 0 THEN 'customer' ELSE 'self' END AS relation FROM orders
WHERE (o_orderkey % 2 = 0 AND o_orderkey % 3 = 1) OR (o_orderkey % 2 = 1 AND o_orderkey % 3 = 0)""")
def honorific_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate a run, its subject a customer, the operator, or nobody."""
    o, k = orders_by(spark, sf_dir)
    token = lambda i, t, lemma, dep: F.struct(F.lit(i).alias("token_id"), t.alias("text"), lemma.alias("lemma"), F.lit(dep).alias("dep"), F.lit(2).alias("head_token_id"))
    subject = F.when(k % 3 == 0, "お客様").when(k % 3 == 1, "私").otherwise("荷物")
    t = o.select("run_id", F.explode(F.array(token(1, subject, subject, "nsubj"), token(2, F.lit("v"), at(k, 2, "いらっしゃる", "伺う"), "root"))).alias("t")).select("run_id", F.lit("a").alias("turn_ref"), F.lit(0).alias("sentence_id"), "t.*")
    levels = spark.createDataFrame([("いらっしゃる", "honorific"), ("伺う", "humble")], "lemma string, level string")
    people = spark.createDataFrame([("お客様", "customer"), ("私", "self")], "surface string, relation string")
    return text_rules.honorific_direction(t, levels, people).select("run_id", "lemma", "relation")


@query("""SELECT o_orderkey AS run_id, r AS rule_id FROM orders, (SELECT unnest(['r1', 'r2']) AS r) WHERE (r = 'r1' AND o_orderkey % 3 = 0) OR (r = 'r2' AND o_orderkey % 4 = 0)""")
def closed_misuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules given as rows."""
    o, k = orders_by(spark, sf_dir)
    rules = spark.createDataFrame([("r1", "いらっしゃられ"), ("r2", "お(?:読み|書き)になられ")], "rule_id string, pattern string")
    return text_rules.closed_misuse(o.withColumn("t", text(at(k, 3, "いらっしゃられます", "いらっしゃいます"), at(k, 4, "お読みになられ", "お読みになり"))), rules, "t", ["run_id"])


# --- tickets --------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS run_id, CASE WHEN k % 11 = 0 THEN 'escalation' WHEN k % 2 = 1 THEN 'incomplete' WHEN k % 5 = 0 THEN 'refusal' WHEN k % 3 = 0 THEN 'guidance_inquiry_answer' WHEN k % 7 = 0 THEN 'change_procedure' ELSE 'incomplete' END AS handling_type,
k % 11 = 0 OR (k % 2 = 0 AND (k % 5 = 0 OR k % 3 = 0 OR k % 7 = 0)) AS completed, CASE WHEN k % 11 = 0 THEN 'stored' WHEN k % 2 = 1 THEN 'run_not_completed' WHEN k % 5 = 0 OR k % 3 = 0 OR k % 7 = 0 THEN 'observed_run_evidence' ELSE 'completion_record_missing' END AS reason FROM o""")
def derived_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = orders_by(spark, sf_dir)
    none = F.array().cast("array<string>")
    done = tickets.completed_without_record(at(k, 4, "success", F.lit(None).cast("string")), F.lit(None).cast("boolean"), k % 4 == 2)
    return tickets.run_outcome(o.select("run_id", at(k, 11, "escalation", F.lit(None).cast("string")).alias("stored"), done.alias("completed"), at(k, 5, words("change_procedure", "refusal"), none).alias("from_events"), at(k, 3, words("guidance_inquiry_answer"), words("other")).alias("from_state"), (k % 7 == 0).alias("changed")))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS run_id, CASE k % 5 WHEN 0 THEN 'callback_commitment' WHEN 1 THEN 'guidance_inquiry_answer' WHEN 2 THEN 'refusal' WHEN 3 THEN 'change_procedure' END AS ticket, CASE k % 3 WHEN 0 THEN 'refusal' WHEN 1 THEN 'change_procedure' END AS observed, CASE k % 3 WHEN 2 THEN 'handling_type_ambiguous' END AS reason FROM o""")
def handling_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = orders_by(spark, sf_dir)
    roles = F.when(k % 5 == 0, words("refusal", "callback_commitment")).when(k % 5 == 1, words("guidance_inquiry_answer", "guidance_inquiry_answer")).when(k % 5 == 2, words("guidance_inquiry_answer", "refusal")).when(k % 5 == 3, words(None, "guidance_inquiry_answer")).otherwise(F.array().cast("array<string>"))
    kind, reason = tickets.observed_handling(F.when(k % 3 == 0, words("refusal", "x", "refusal")).when(k % 3 == 1, words("change")).otherwise(words("change", "callback")))
    return o.select("run_id", tickets.handling_type(roles).alias("ticket"), kind.alias("observed"), reason.alias("reason"))


@query("""SELECT o_orderkey AS run_id, o_orderkey % 3 <> 1 AND o_orderkey % 5 <> 0 AS matched FROM orders""")
def ticket_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of a ticket against those of the call: another id of the same result is fine."""
    o, k = orders_by(spark, sf_dir)
    action = lambda code, target, outcome: F.struct(F.lit(code).alias("action_code"), target.cast("string").alias("target_ref"), outcome.alias("outcome"), words("r").alias("receipt_refs"))
    fact = lambda code, target: F.struct(F.lit(code).alias("action_code"), F.lit(target).alias("target_ref"), F.lit("succeeded").alias("outcome"), words("r").alias("receipt_refs"), words("t2", "t3").alias("candidates"))
    target = F.when(k % 3 == 0, "t1").when(k % 3 == 1, "t9").otherwise("t3")
    seen = F.array(action("get_sop", F.lit("x"), F.lit("failed")), action("pay", target, at(k, 5, "failed", "succeeded")), action("close", F.lit(None), F.lit("succeeded")))
    return o.select("run_id", tickets.actions_match(seen, F.array(fact("pay", "t1"), fact("close", None))).alias("matched"))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders), c AS (SELECT k, 0 AS pos, 'event' AS kind, 'e' || k AS ref FROM o UNION ALL SELECT k, 1, 'sop', 's' || k % 7 FROM o WHERE k % 7 <> 3)
SELECT k AS run_id, CAST(pos AS INT) AS pos, kind, ref FROM c WHERE kind = 'sop' OR k % 4 <> 0 UNION ALL SELECT k, CASE WHEN k % 7 <> 3 THEN 2 ELSE 1 END, 'result', 'r' FROM o WHERE k % 5 = 0""")
def confirmed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = orders_by(spark, sf_dir)
    one = lambda pos, kind, ref: F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), ref.alias("ref"))
    claim = F.filter(F.array(one(0, "event", text("e", k)), F.when(k % 7 != 3, one(1, "sop", text("s", k % 7)))), lambda x: x.isNotNull())
    claimed = o.select("run_id", F.explode(claim).alias("c")).select("run_id", "c.*")
    valid = claimed.where("kind = 'sop' or run_id % 4 <> 0").select("run_id", "kind", "ref")
    mandatory = o.where(k % 5 == 0).select("run_id", F.lit("result").alias("kind"), F.lit("r").alias("ref")).unionByName(valid.where("kind = 'sop'"))
    return tickets.confirmed_evidence(claimed, valid, mandatory).select("run_id", F.col("pos").cast("int").alias("pos"), "kind", "ref")


# --- state ----------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_custkey AS run_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), e AS (SELECT run_id, count(*) AS n FROM o WHERE k % 5 = 0 GROUP BY 1),
p AS (SELECT run_id, CASE WHEN k % 3 = 0 THEN NULL ELSE 'id' || k END AS identity, i, k FROM o), u AS (SELECT run_id, i, row_number() OVER (PARTITION BY run_id ORDER BY i) AS j FROM p WHERE identity IS NULL)
SELECT run_id, CAST(i AS BIGINT) AS seq, identity, 'fresh' AS kind FROM p WHERE identity IS NOT NULL AND k % 7 <> 0 UNION ALL SELECT run_id, i, identity, 'taken' FROM p WHERE identity IS NOT NULL AND k % 7 = 0
UNION ALL SELECT u.run_id, u.i, 'unplanned:' || (coalesce(n, 0) + j), 'fresh' FROM u LEFT JOIN e USING (run_id)""")
def created_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creates with a planned identity, taken or free, and without one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("k"))
    k = F.col("k")
    seq = F.row_number().over(Window.partitionBy("run_id").orderBy("k")).cast("bigint")
    creates = o.select("run_id", seq.alias("seq"), F.lit("t").alias("tbl"), at(k, 3, F.lit(None).cast("string"), text("id", k)).alias("identity"), F.create_map(F.lit("a"), F.lit("1")).alias("after"))
    rows = o.where(k % 7 == 0).select("run_id", F.lit("t").alias("tbl"), text("id", k).alias("identity")).unionByName(o.where(k % 5 == 0).select("run_id", F.lit("t").alias("tbl"), text("unplanned:", k).alias("identity")))
    fresh, taken = state.create_rows(rows, creates)
    shown = lambda df, kind: df.select("run_id", "seq", "identity", F.lit(kind).alias("kind"))
    return shown(fresh, "fresh").unionByName(shown(taken, "taken"))


@query(STATE + """, r AS (SELECT DISTINCT run_id FROM init), d AS (SELECT f.run_id, count(*) AS n FROM fin f LEFT JOIN init i ON i.run_id = f.run_id AND i.identity = f.identity AND i."column" = f."column" WHERE f.value IS DISTINCT FROM i.value GROUP BY 1)
SELECT r.run_id, coalesce(n, 0) AS n_diff, n IS NULL AS equal, r.run_id % 3 = 0 AS digest_wrong FROM r LEFT JOIN d USING (run_id)""")
def replayed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayed against initial state, and declared digests, a third of them wrong."""
    initial, changes = order_log(spark, sf_dir)
    runs = initial.select("run_id").distinct()
    # the state is folded and written out once, then hashed and compared
    cells = checkpointed(state.fold_changes(initial, changes))
    declared = state.state_hash(cells).select("run_id", F.concat(F.lit("sha256:"), F.when(F.col("run_id") % 3 == 0, F.reverse("state_sha256")).otherwise(F.col("state_sha256"))).alias("declared"))
    wrong = state.digest_mismatches(cells, declared).select("run_id", F.lit(True).alias("_wrong"))
    same = state.same_state(initial_cells(initial), cells, runs)
    return same.join(wrong, "run_id", "left").select("run_id", "n_diff", "equal", F.coalesce("_wrong", F.lit(False)).alias("digest_wrong"))


@query("""WITH l AS (SELECT l_orderkey AS run_id, l_linenumber AS n, l_partkey AS p, l_quantity AS q, l_extendedprice AS x FROM lineitem), s AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY n, p, x) AS seq, CAST(q AS BIGINT) AS q FROM l)
SELECT run_id, CAST(seq AS BIGINT) AS seq, 'event:' || run_id || ':' || seq AS event_ref, q % 3 <> 0 AND q % 2 = 0 AS changed_state, q % 5 <> 0 AND q % 2 = 0 AS logged FROM s""")
def call_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls numbered at ingest, whether they changed the state, and whether their changes enter the log."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("q"))
    e = state.number_events(li, ["l_linenumber", "l_partkey", "l_extendedprice"])
    q = F.col("q")
    change = F.struct(F.lit("update").alias("operation"), F.lit("t").alias("tbl"), F.lit("i").alias("identity"), F.create_map(F.lit("a"), q.cast("string")).alias("after"))
    e = e.withColumn("changes", F.when(q % 2 == 0, F.array(change)).otherwise(F.array().cast("array<struct<operation:string,tbl:string,identity:string,after:map<string,string>>>")))
    log = contracts.successful_changes(e.select("run_id", "seq", at(q, 5, False, F.lit(None).cast("boolean")).alias("ok"), "changes")).select("run_id", "seq", F.lit(True).alias("_logged"))
    pairs = F.transform("changes", lambda c: F.struct(at(q, 3, q.cast("string"), "old").alias("before"), q.cast("string").alias("after")))
    flagged = state.state_changing(e.withColumn("changes", pairs))
    return flagged.join(log, ["run_id", "seq"], "left").select("run_id", "seq", "event_ref", "changed_state", F.coalesce("_logged", F.lit(False)).alias("logged"))


# --- audio ----------------------------------------------------------------------------------------------

PROFILE = {
    "sample_rate_hz": [8000], "channels": [1], "sample_width_bits": [8], "rms_dbfs_min": -18.0, "rms_dbfs_max": -3.0, "peak_dbfs_max": 0.0, "clip_ratio_max": 0.05, "flat_top_max_ms": 20.0, "dropout_max_ms": 1500.0,
    "snr_min_db": 0.0, "rolloff_min_hz": 300.0, "rolloff_max_hz": 3800.0, "dc_max_dbfs": -20.0, "active_level_dbov_min": -50.0, "active_level_dbov_max": -3.0, "required_facets": ["decode_format", "rms_peak"], "inapplicable_facets": {"snr": "no reference"},
}


def wave_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 bit files at 8 kHz, every eleventh cut off."""
    byte = lambda v: F.lpad(F.hex(F.least(F.greatest(F.floor(v.cast("double") * 300 + 128), F.lit(0)), F.lit(255)).cast("bigint")), 2, "0")
    payload = F.array_join(F.transform("embedding", byte), "")
    n = F.size("embedding")
    size = lambda c: F.concat(F.lpad(F.hex((c % 256).cast("bigint")), 2, "0"), F.lpad(F.hex(F.floor(c / 256).cast("bigint")), 2, "0"), F.lit("0000"))
    form = "57415645666D7420100000000100010040" + "1F0000401F000001000800" + "64617461"
    whole = F.concat(F.lit("52494646"), size(n + 36), F.lit(form), size(n), payload)
    cut = F.when(F.col("vec_id") % 11 == 0, F.left(whole, F.length(whole) - 8)).otherwise(whole)
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").cast("string").alias("path"), F.unhex(cut).alias("content"))


SAMPLES = """WITH b AS (SELECT vec_id, len(embedding) AS n, [least(greatest(floor(x::DOUBLE * 300 + 128), 0), 255)::INT FOR x IN embedding] AS bytes FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 11 <> 0),
s AS (SELECT vec_id, n, [(x - 128) / 128.0::DOUBLE FOR x IN bytes] AS s FROM b),
w AS (SELECT vec_id, n, s, [s[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) FOR i IN range(n)] AS h FROM s),
f AS (SELECT vec_id, n, k, pow(list_sum([h[i + 1] * cos(2 * pi() * k * i / n) FOR i IN range(n)]), 2) + pow(list_sum([h[i + 1] * sin(2 * pi() * k * i / n) FOR i IN range(n)]), 2) AS p FROM (SELECT *, unnest(range(n // 2 + 1)) AS k FROM w)),
c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY k) AS upto, sum(p) OVER (PARTITION BY vec_id) AS total FROM f), r AS (SELECT vec_id, min(k) * 8000.0 / any_value(n) AS rolloff FROM c WHERE upto >= 0.95 * total GROUP BY 1),
x AS (SELECT s.vec_id, n, sqrt(list_avg([v * v FOR v IN s])) AS rms, list_max([abs(v) FOR v IN s]) AS peak, list_avg([CASE WHEN abs(v) >= 1 - 1 / 128.0 THEN 1.0 ELSE 0.0 END FOR v IN s]) AS clip, abs(list_avg(s)) AS dc, rolloff FROM s JOIN r USING (vec_id))"""


@query(SAMPLES + """ SELECT CAST(vec_id AS VARCHAR) AS path, NULL AS error, n AS frames, round(20 * log10(rms), 6) AS rms_dbfs, round(20 * log10(peak), 6) AS peak_dbfs, round(clip, 9) AS clip_ratio, round(CASE WHEN dc > 0 THEN 20 * log10(dc) ELSE -300 END, 6) AS dc_dbfs, round(rolloff, 6) AS rolloff_hz FROM x
UNION ALL SELECT CAST(vec_id AS VARCHAR), 'truncated chunk', NULL, NULL, NULL, NULL, NULL, NULL FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 11 = 0""")
def wav_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded files and their features; the spectrum of each is worked out by the oracle too."""
    f = audio.wav_features(wave_files(spark, sf_dir))
    return f.select("path", "error", "frames", *[F.round(c, 6).alias(c) for c in ("rms_dbfs", "peak_dbfs", "dc_dbfs", "rolloff_hz")], F.round("clip_ratio", 9).alias("clip_ratio"))


@query(SAMPLES + """, y AS (SELECT *, 20 * log10(rms) BETWEEN -18 AND -3 AS level, clip <= 0.05 AS clips, CASE WHEN dc > 0 THEN 20 * log10(dc) ELSE -300 END <= -20 AS dcs, rolloff BETWEEN 300 AND 3800 AS band FROM x)
SELECT CAST(vec_id AS VARCHAR) AS path, CASE WHEN level AND clips AND dcs AND band THEN 'passed' ELSE 'failed' END AS status, concat_ws(',', CASE WHEN NOT level THEN 'rms_peak' END, CASE WHEN NOT clips THEN 'clipping' END, CASE WHEN NOT band THEN 'bandwidth' END, CASE WHEN NOT dcs THEN 'dc' END) AS violations FROM y
UNION ALL SELECT CAST(vec_id AS VARCHAR), 'contract_invalid', '' FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 11 = 0""")
def signal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = audio.signal_status(audio.wav_features(wave_files(spark, sf_dir)), PROFILE)
    return s.select("path", "status", F.coalesce(F.array_join("violations", ","), F.lit("")).alias("violations"))


@query("""WITH e AS (SELECT vec_id AS k, len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL)
SELECT CAST(k AS VARCHAR) AS path, 'rate_differs' AS rule, '16000 declared, 8000 decoded' AS detail FROM e WHERE k % 3 = 0 AND k % 11 <> 0 UNION ALL SELECT CAST(k AS VARCHAR), 'frames_differs', (n + 1) || ' declared, ' || n || ' decoded' FROM e WHERE k % 5 = 0 AND k % 11 <> 0 UNION ALL SELECT CAST(k AS VARCHAR), 'malformed', 'truncated chunk' FROM e WHERE k % 11 = 0""")
def declared_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    declared = table(spark, sf_dir, "embeddings").where("embedding is not null").select(k.cast("string").alias("path"), F.lit(None).cast("string").alias("sha256"), at(k, 3, 16000, 8000).alias("rate"), F.lit(1).alias("channels"), F.lit(8).alias("bits"), at(k, 5, F.size("embedding") + 1, F.size("embedding")).alias("frames"))
    return audio.undeclared_facts(audio.wav_features(wave_files(spark, sf_dir)), declared)


@query("""WITH u AS (SELECT l_orderkey % 200 AS run_id, 'M2' || l_linenumber % 3 AS metric_id, ['passed', 'failed', 'N/M', 'contract_invalid', 'N/A'][l_suppkey % 5 + 1] AS status FROM lineitem WHERE NOT (l_orderkey % 3 = 0 AND l_suppkey % 5 IN (1, 3)) AND NOT (l_orderkey % 10 = 1 AND l_suppkey % 5 < 4))
SELECT run_id, metric_id, CASE max(CASE status WHEN 'failed' THEN 4 WHEN 'contract_invalid' THEN 3 WHEN 'N/M' THEN 2 WHEN 'passed' THEN 1 ELSE 0 END) WHEN 4 THEN 'failed' WHEN 3 THEN 'contract_invalid' WHEN 2 THEN 'N/M' WHEN 1 THEN 'passed' ELSE 'N/A' END AS status, count(*) FILTER (WHERE status <> 'N/A') AS applicable FROM u GROUP BY ALL""")
def audio_metric_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.metric_status(audio_units(spark, sf_dir))


def audio_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.col("l_suppkey") % 5
    li = table(spark, sf_dir, "lineitem").where(~((F.col("l_orderkey") % 3 == 0) & j.isin(1, 3)) & ~((F.col("l_orderkey") % 10 == 1) & (j < 4)))
    return li.select((F.col("l_orderkey") % 200).alias("run_id"), text("M2", F.col("l_linenumber") % 3).alias("metric_id"), F.element_at(words("passed", "failed", "N/M", "contract_invalid", "N/A"), (j + 1).cast("int")).alias("status"), F.col("l_quantity").cast("bigint").alias("opportunity"), F.lit(20).cast("bigint").alias("target"))


@query("""WITH u AS (SELECT 'M2' || l_linenumber % 3 AS metric_id, l_suppkey % 5 AS j, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE NOT (l_orderkey % 3 = 0 AND l_suppkey % 5 IN (1, 3)) AND NOT (l_orderkey % 10 = 1 AND l_suppkey % 5 < 4))
SELECT metric_id, avg(CAST(j = 0 AS INT)) FILTER (WHERE j < 3) AS rate, count(*) FILTER (WHERE j < 3) AS n, sum(least(q, 20))::DOUBLE / (20 * count(*)) AS observation FROM u GROUP BY 1""")
def audio_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.audio_table(audio_units(spark, sf_dir))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber % 3 AS s, l_suppkey AS c FROM lineitem) SELECT run_id, 's' || s AS segment_id, bool_and(c % 9 <> 0 AND c % 7 <> 0) AS continuous FROM l GROUP BY ALL""")
def continuous_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), text("s", F.col("l_linenumber") % 3).alias("segment_id"), F.col("l_suppkey").cast("string").alias("chunk_id"), F.col("l_suppkey").alias("c")).distinct()
    segments = li.groupBy("run_id", "segment_id").agg(F.collect_set("chunk_id").alias("chunk_ids"))
    return audio.continuous(segments, li.where("c % 9 <> 0").select("run_id", "chunk_id"), li.where("c % 7 = 0").select("run_id", "chunk_id"))


@query("""WITH l AS (SELECT l_orderkey AS run_id, l_linenumber AS n, l_partkey AS p, l_suppkey % 4 AS s, l_suppkey % 3 AS h FROM lineitem), d AS (SELECT DISTINCT run_id, s, h FROM l WHERE s < 3), k AS (SELECT run_id, s FROM d GROUP BY ALL HAVING count(*) = 1),
e AS (SELECT l.run_id, n || '-' || p AS event_id, n * 10 AS ns, l.s FROM l) SELECT run_id, event_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ns, event_id) AS INT) AS seq FROM (SELECT DISTINCT e.* FROM e WHERE s = 3 OR EXISTS (SELECT 1 FROM k WHERE k.run_id = e.run_id AND k.s = e.s))""")
def measured_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that repeat alike or clash, and the events of those that hold, by the clock."""
    s = F.col("l_suppkey") % 4
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), text(F.col("l_linenumber"), "-", F.col("l_partkey")).alias("event_id"), (F.col("l_linenumber") * 10).alias("monotonic_ns"), F.when(s < 3, text("s", s)).alias("segment_id"), (F.col("l_suppkey") % 3).cast("string").alias("sha256"))
    listed = li.groupBy("run_id").agg(F.collect_list(F.when(F.col("segment_id").isNotNull(), F.struct("segment_id", "sha256", F.lit(1).alias("frames")))).alias("segments"))
    good, _ = audio.segments_of(listed)
    return audio.measured_events(li.select("run_id", "event_id", "monotonic_ns", "segment_id").distinct(), good).select("run_id", "event_id", "seq")


@query("""SELECT o_orderkey AS run_id, 'M' || m AS metric_id, 'no joinable evidence' AS reason FROM orders, (SELECT unnest([1, 2]) AS m) WHERE (m = 1 AND o_orderkey % 3 = 0) OR (m = 2 AND o_orderkey % 5 = 0)""")
def plan_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = orders_by(spark, sf_dir)
    entry = lambda m, s, e: F.struct(F.lit(m).alias("metric_id"), F.lit(s).alias("segment_id"), F.lit(e).alias("event_id"))
    plan = o.select("run_id", F.explode(F.array(entry("M1", "a", "x"), entry("M2", "b", "y"))).alias("p")).select("run_id", "p.*")
    named = lambda df, name, value: df.select("run_id", F.lit(value).alias(name))
    segments = named(o, "segment_id", "b").unionByName(named(o.where(k % 3 != 0), "segment_id", "a"))
    events = named(o, "event_id", "x").unionByName(named(o.where(k % 5 != 0), "event_id", "y"))
    return contracts.joinable_plan(plan, segments, events)[1]


@query("""WITH l AS (SELECT l_orderkey AS run_id, CASE WHEN l_suppkey % 50 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN 'c' || l_linenumber % 2 ELSE 'c' END AS c, l_suppkey AS ns FROM lineitem)
SELECT run_id, min(ns) AS first_ns, max(ns) AS last_ns, CASE WHEN bool_or(c IS NULL) THEN 'clock missing' WHEN count(DISTINCT c) <> 1 THEN 'several clocks' END AS reason FROM l GROUP BY 1""")
def clock_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.when(F.col("l_suppkey") % 50 == 0, None).when(F.col("l_orderkey") % 7 == 0, text("c", F.col("l_linenumber") % 2)).otherwise("c")
    return contracts.clock_receipt(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), clock.alias("clock_id"), F.col("l_suppkey").alias("monotonic_ns")))


# --- records and reports --------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey AS run_id, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'hard' ELSE 'baseline' END AS v FROM orders WHERE o_orderkey % 6 <> 5), m AS (SELECT unnest(['M01', 'M04', 'M09', 'M24']) AS metric_id)
SELECT run_id, metric_id, CASE WHEN metric_id = 'M24' THEN 'N/A' WHEN k % 11 = 0 THEN CASE WHEN metric_id = 'M04' AND v <> 'hard' THEN 'N/A' ELSE 'N/M' END WHEN metric_id = 'M01' THEN CASE WHEN k % 3 = 0 THEN 'fail' ELSE 'pass' END WHEN metric_id = 'M09' AND k % 5 <> 0 THEN 'measured' ELSE 'N/M' END AS status,
CASE WHEN metric_id = 'M24' THEN 'audio_output_is_speech' WHEN k % 11 = 0 THEN 'run_failed: boom' WHEN metric_id = 'M01' OR (metric_id = 'M09' AND k % 5 <> 0) THEN 'r' ELSE 'not scored' END AS reason FROM o, m
UNION ALL SELECT o_orderkey, 'skipped', 'N/M', '' FROM orders WHERE o_orderkey % 6 = 5""")
def score_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored runs scored with every declared metric: failed runs, metrics nobody scored, and scenarios
    without a record."""
    o, k = orders_by(spark, sf_dir)
    runs = o.where(k % 6 != 5).select("run_id", k.alias("scenario_id"), at(k, 2, "hard", "baseline").alias("variant_id"), at(k, 11, "failed_runtime", "success").alias("status"), F.lit("boom").alias("error_message"))
    metrics = spark.createDataFrame([("M01", False), ("M04", True), ("M09", False), ("M24", False)], "metric_id string, hard_only boolean")
    score = lambda df, m, status: df.select("run_id", F.lit(m).alias("metric_id"), status.alias("status"), F.lit("r").alias("reason"))
    scores = [score(o, "M01", at(k, 3, "fail", "pass")), score(o.where(k % 5 != 0), "M09", F.lit("measured")), score(o, "M24", F.lit("pass"))]
    rows, skipped = records.score_stored(o.select(k.alias("scenario_id")), runs, metrics, scores, "audio")
    return rows.unionByName(skipped.select(F.col("scenario_id").alias("run_id"), F.lit("skipped").alias("metric_id"), F.lit("N/M").alias("status"), F.lit("").alias("reason")))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS run_id, 'M05' AS metric_id, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'fail' WHEN k % 3 = 0 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'judged' ELSE 'core' END AS reason FROM o
UNION ALL SELECT k, 'M15', CASE WHEN k % 2 = 0 THEN 'fail' ELSE 'N/M' END, CASE WHEN k % 2 = 0 THEN 'judged' ELSE 'core' END FROM o""")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged rows replace placeholders; an obligation is only ever downgraded from a pass."""
    o, k = orders_by(spark, sf_dir)
    row = lambda df, m, status, why: df.select("run_id", F.lit(m).alias("metric_id"), status.alias("status"), F.lit(why).alias("reason"))
    judged = row(o.where(k % 2 == 0), "M15", F.lit("fail"), "judged").unionByName(row(o.where(k % 2 == 0), "M05", F.lit("fail"), "judged"))
    plain = report.override(row(o, "M15", F.lit("N/M"), "core"), judged)
    return plain.unionByName(report.override(row(o, "M05", at(k, 3, "pass", "fail"), "core"), judged, only_from="pass"))


@query("""WITH o AS (SELECT o_orderkey AS run_id, o_custkey % 50 AS scenario_id, CASE WHEN o_orderkey % 7 = 0 THEN 'failed_runtime' ELSE 'success' END AS status, o_totalprice AS w FROM orders)
SELECT scenario_id, count(*) AS n, count(*) FILTER (WHERE status = 'failed_runtime') AS failed, round(sum(w), 4) AS wall_sec FROM o GROUP BY 1 UNION ALL SELECT -1, count(*), count(*) FILTER (WHERE status = 'failed_runtime'), round(max(w), 4) FROM o""")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scenario, and over all (scenario -1, with the longest run)."""
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("scenario_id"), at(k, 7, "failed_runtime", "success").alias("status"), F.col("o_totalprice").alias("wall_time_sec"))
    whole = report.run_summary(runs).select(F.lit(-1).cast("bigint").alias("scenario_id"), "n", "failed", F.round("longest_sec", 4).alias("wall_sec"))
    return report.scenario_times(runs).withColumn("wall_sec", F.round("wall_sec", 4)).unionByName(whole)


@query("""WITH l AS (SELECT l_orderkey AS run_id, l_suppkey % 3 AS j, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem) SELECT run_id, sum(CASE j WHEN 0 THEN p WHEN 1 THEN p END)::BIGINT AS input_tokens, sum(CASE j WHEN 0 THEN q WHEN 1 THEN q END)::BIGINT AS output_tokens FROM l GROUP BY 1""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, p, q = F.col("l_suppkey") % 3, F.col("l_partkey"), F.col("l_quantity").cast("bigint")
    return report.token_usage(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(j == 0, p).alias("prompt_tokens"), F.when(j == 1, p).alias("input_tokens"), F.when(j == 0, q).alias("completion_tokens"), F.when(j == 1, q).alias("output_tokens")))


@query("""SELECT o_orderkey AS run_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS schema_repairs, CAST(o_orderkey % 3 = 0 AS BIGINT) AS ticket_repairs, CASE WHEN o_orderkey % 2 = 0 THEN 'b' ELSE '' END AS missing, 'z' AS excluded FROM orders""")
def repairs_and_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs counted per run, and root keys of the state against the reference."""
    o, k = orders_by(spark, sf_dir)
    kinds = F.when(k % 3 == 0, words("schema", "schema", "ticket")).when(k % 3 == 1, words("schema")).otherwise(F.array().cast("array<string>"))
    counted = quality.repair_counts(o, o.select("run_id", F.explode(kinds).alias("kind")))
    roots = quality.root_keys(o.select("run_id", words("a", "b").alias("reference"), at(k, 2, words("a", "z"), words("z", "b", "a")).alias("actual")))
    return counted.join(roots, "run_id").select("run_id", "schema_repairs", "ticket_repairs", F.array_join("missing", ",").alias("missing"), F.array_join("excluded", ",").alias("excluded"))


@query("""WITH t AS (SELECT p_partkey AS k FROM part)
SELECT k AS scenario_id, CASE WHEN k % 3 = 0 THEN 'missing_solution' WHEN k % 5 = 0 THEN 'repeated_keys: x' END AS error FROM t WHERE k % 3 = 0 OR k % 5 = 0 UNION ALL SELECT k, 'ok' FROM t WHERE k % 3 <> 0 AND k % 5 <> 0 AND k <= 900 UNION ALL SELECT -k - 1, 'not found' FROM t WHERE k % 100 = 0 UNION ALL SELECT k, 'not found' FROM t WHERE k <= 900 AND (k % 3 = 0 OR k % 5 = 0)""")
def assembled_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with their solutions, what is wrong with them, a wanted subset, and wanted ids that don't exist."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scenario_id"))
    k = F.col("scenario_id")
    tasks = p.select("scenario_id", F.lit('{"x": 1, "metadata": 1}').alias("body"))
    good, bad = records.assemble(tasks, p.where(k % 3 != 0).select("scenario_id", at(k, 5, '{"x": 2, "metadata": 2}', '{"y": 2, "metadata": 2}').alias("body")))
    wanted = p.where(k <= 900).unionByName(p.where(k % 100 == 0).select((-k - 1).alias("scenario_id")))
    picked, lost = records.pick_scenarios(good, wanted)
    named = lambda df, e: df.select("scenario_id", F.lit(e).alias("error"))
    return bad.unionByName(named(picked, "ok")).unionByName(named(lost, "not found"))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT CASE WHEN k % 2 = 0 THEN 'hard' ELSE 'baseline' END AS variant_id, 's' || k AS scenario_id, 'place' AS kind FROM o WHERE k % 3 = 0 OR k % 5 = 0 UNION ALL SELECT '', 's' || k % 100, 'repeated' FROM o GROUP BY k % 100 HAVING count(*) > 1""")
def run_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with a score or a record, and scenario ids that repeat."""
    o, k = orders_by(spark, sf_dir)
    place = o.select("run_id", at(k, 2, "hard", "baseline").alias("variant_id"), text("s", k).alias("scenario_id"))
    found = records.scored_or_recorded(place.where("run_id % 3 = 0"), place.where("run_id % 5 = 0")).withColumn("kind", F.lit("place"))
    twice = records.repeated_scenarios(o.select(text("s", k % 100).alias("scenario_id"))).select(F.lit("").alias("variant_id"), "scenario_id", F.lit("repeated").alias("kind"))
    return found.unionByName(twice)


@query("""WITH n AS (SELECT c_nationkey AS key, c_custkey AS item FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY item) - 1 AS rn, count(*) OVER (PARTITION BY key) AS n FROM n),
p AS (SELECT key, item, ((rn - CAST('0x' || substr(sha256(CAST(key AS VARCHAR)), 1, 8) AS BIGINT) % n) % n + n) % n AS turn FROM k WHERE item % 2 = 1) SELECT key, arg_min(item, turn) AS item FROM p GROUP BY 1""")
def peer_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("item"))
    return retrieval.hash_offset_pick(c, c.where(F.col("item") % 2 == 0))


@query("""WITH o AS (SELECT o_custkey AS d, o_orderkey AS s FROM orders) SELECT DISTINCT a.s AS scenario_id, 'notice ' || b.s % 7 AS disclosure FROM o a JOIN o b ON a.d = b.d AND a.s <> b.s""")
def peer_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as the scenarios of a domain."""
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.col("o_custkey").alias("domain_id"), F.array(text("notice ", F.col("o_orderkey") % 7)).alias("disclosures"))
    return records.peer_disclosures(n)


@query("""WITH m AS (SELECT l_orderkey AS run_id, l_suppkey AS c FROM lineitem) SELECT run_id, avg(CAST(c % 7 <> 0 AND c % 3 = 0 AS INT)) AS score, count(*) AS fired, 'measured' AS status FROM m GROUP BY 1""")
def fired_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    return judge.fired_mean(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), s.alias("criterion"), (s % 7 != 0).alias("valid"), at(s, 3, "yes", "no").alias("answer"), F.lit("yes").alias("expected")))
