"""Queries over contract tables with planted defects: one row per violation, each rule planted at rows
that a residue of the key picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import contract_rules as rules
from ..operators import quality
from ..operators.common import dealt
from .traces import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def at(k: Column, residue: int, bad, good) -> Column:
    """bad where the key is a multiple, else good."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(k % residue == 0, lit(bad)).otherwise(lit(good))


def words(*xs: str | None) -> Column:
    return F.array(*[F.lit(x).cast("string") for x in xs])


@query("""WITH t AS (SELECT p_partkey AS k, 'p' || p_partkey AS tool, CASE p_partkey % 7 WHEN 0 THEN 'delete' WHEN 1 THEN 'filtered_search' WHEN 2 THEN 'filtered_search' WHEN 3 THEN 'update' WHEN 4 THEN 'update' ELSE 'create' END AS op, p_partkey % 11 = 0 AS ghost FROM part),
f AS (SELECT *, k % 5 = 0 AS weight FROM t WHERE op = 'filtered_search'), s AS (SELECT * FROM t WHERE (op IN ('update', 'create') AND k % 31 <> 0) OR (op = 'filtered_search' AND k % 41 = 0))
SELECT tool, 'operation_unsupported' AS rule, op AS detail FROM t WHERE op = 'delete' UNION ALL SELECT tool, 'table_unknown', 'ghost' FROM t WHERE ghost
UNION ALL SELECT tool, 'search_mutates', '1' FROM t WHERE op = 'filtered_search' AND k % 41 = 0 UNION ALL SELECT tool, 'mutation_missing', op FROM t WHERE op IN ('update', 'create') AND k % 31 = 0
UNION ALL SELECT tool, 'required_not_boolean', 'a' FROM t, range(2) r(i) WHERE k % 17 = 0 AND (i = 0 OR k % 13 = 0) UNION ALL SELECT tool, 'argument_repeated', 'a' FROM t WHERE k % 13 = 0
UNION ALL SELECT tool, 'filter_column_undeclared', CASE WHEN weight THEN 'weight' ELSE 'price' END FROM f WHERE weight OR ghost UNION ALL SELECT tool, 'filter_source_not_single', CASE WHEN weight THEN 'weight' ELSE 'price' END FROM f WHERE k % 23 = 0
UNION ALL SELECT tool, 'filter_argument_unknown', 'z' FROM f WHERE k % 19 = 0 UNION ALL SELECT tool, 'filter_constant_mistyped', 'price' FROM f WHERE k % 23 = 0 AND NOT weight AND NOT ghost UNION ALL SELECT tool, 'operator_unsupported', 'like' FROM f WHERE k % 29 = 0
UNION ALL SELECT tool, 'mutation_column_undeclared', 'size' FROM s WHERE ghost UNION ALL SELECT tool, 'mutation_constant_mistyped', 'size' FROM s WHERE k % 37 = 0 AND NOT ghost""")
def tool_contract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    k, j = F.col("k"), F.col("k") % 7
    operation = F.when(j == 0, "delete").when(j < 3, "filtered_search").when(j < 5, "update").otherwise("create")
    tools = p.select("k", F.concat(F.lit("p"), k.cast("string")).alias("tool"), operation.alias("operation"), at(k, 11, "ghost", "parts").alias("entity"))
    copies = F.explode(F.sequence(F.lit(1), at(k, 13, 2, 1)))
    args = tools.select("tool", copies.alias("_i"), F.lit("a").alias("name"), F.lit("integer").alias("type"), at(k, 17, F.lit(None).cast("boolean"), F.lit(True)).alias("required")).drop("_i")
    search = F.col("operation") == "filtered_search"
    none = F.lit(None).cast("string")
    filters = tools.where(search).select("tool", at(k, 5, "weight", "price").alias("column"), at(k, 19, "z", "a").alias("argument"), at(k, 23, "dear", none).alias("constant"), at(k, 29, "like", "eq").alias("op"))
    sets = tools.where((F.col("operation").isin("update", "create") & (k % 31 != 0)) | (search & (k % 41 == 0))).select("tool", F.lit("size").alias("column"), none.alias("argument"), at(k, 37, "big", "3").alias("constant"))
    columns = spark.createDataFrame([("parts", "price", "number"), ("parts", "name", "string"), ("parts", "size", "integer")], "tbl string, column string, type string")
    return rules.tool_contracts(tools, args, filters, sets, columns)


@query("""WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 13 = 0 THEN s_suppkey - 1 ELSE s_suppkey END AS sop_id FROM supplier WHERE s_suppkey > 0), n AS (SELECT n_nationkey AS c FROM nation)
SELECT sop_id, 'title_missing' AS rule, 'title' AS detail FROM s WHERE k % 3 = 0 UNION ALL SELECT sop_id, 'escalation_missing', 'escalation' FROM s WHERE k % 5 = 0 UNION ALL SELECT k - 1, 'sop_repeated', '2' FROM s WHERE k % 13 = 0 AND k > 1
UNION ALL SELECT sop_id, 'no_steps', '' FROM s WHERE sop_id % 7 = 0 UNION ALL SELECT k, 'step_id_missing', 'tool' FROM s WHERE k % 7 <> 0 AND k % 8 = 0 UNION ALL SELECT k, 'kind_unknown', '2' FROM s WHERE k % 7 <> 0 AND k % 9 = 0
UNION ALL SELECT k, 'tool_missing', CASE WHEN k % 8 = 0 THEN '' ELSE '1' END FROM s WHERE k % 7 <> 0 AND k % 10 = 0 UNION ALL SELECT k, 'description_missing', '2' FROM s WHERE k % 7 <> 0 AND k % 11 = 0 AND k % 9 <> 0
UNION ALL SELECT NULL, 'category_title_missing', CAST(c AS VARCHAR) FROM n WHERE c % 4 = 0 UNION ALL SELECT NULL, 'category_empty', CAST(c AS VARCHAR) FROM n WHERE c NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey > 0)""")
def procedure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("category_id"))
    k = F.col("k")
    texts = [at(k, 3, "", "t").alias("title"), *[F.lit("x").alias(c) for c in ("applicability", "completion", "prohibition")], at(k, 5, F.lit(None).cast("string"), "e").alias("escalation")]
    sops = s.select(F.when(k % 13 == 0, k - 1).otherwise(k).alias("sop_id"), "category_id", *texts)
    step = lambda i, kind, tool, said: F.struct(i.cast("string").alias("step_id"), kind.alias("kind"), tool.cast("string").alias("tool_id"), said.cast("string").alias("description"))
    both = F.array(step(at(k, 8, "", "1"), F.lit("tool"), at(k, 10, "", "find"), F.lit(None)), step(F.lit("2"), at(k, 9, "think", "explain"), F.lit(None), at(k, 11, "", "say")))
    steps = s.where(k % 7 != 0).select(k.alias("sop_id"), F.explode(both).alias("s")).select("sop_id", "s.*")
    n = table(spark, sf_dir, "nation")
    categories = n.select(F.col("n_nationkey").alias("category_id"), at(F.col("n_nationkey"), 4, "", "t").alias("title"))
    return rules.procedures(sops, steps, categories)


@query("""WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k AS scenario_id, 'trigger_type_missing' AS rule, 'e1' AS detail FROM c WHERE k % 5 = 0 UNION ALL SELECT k, 'required_tools_invalid', 'e1' FROM c WHERE k % 7 = 0 UNION ALL SELECT k, 'edge_id_repeated', 'e1' FROM c WHERE k % 11 = 0
UNION ALL SELECT k, 'required_tools_invalid', CASE WHEN k % 11 = 0 THEN 'e1' ELSE 'e2' END FROM c WHERE k % 13 = 0 UNION ALL SELECT k, 'action_tool_repeated', 'pay' FROM c WHERE k % 3 = 0
UNION ALL SELECT k, 'deadline_tool_missing', 'o1' FROM c WHERE k % 4 = 0 UNION ALL SELECT k, 'consent_event_blank', 'o1' FROM c WHERE k % 6 = 0 UNION ALL SELECT k, 'consent_without_action', 'o1' FROM c WHERE k % 9 = 0 UNION ALL SELECT k, 'required_events_invalid', 'o1' FROM c WHERE k % 8 = 0""")
def order_contract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scenario_id"))
    k = F.col("scenario_id")
    edge = lambda i, trigger, action, need: F.struct(i.alias("edge_id"), trigger.alias("trigger_type"), action.alias("action_tool"), need.alias("required_tools"))
    both = F.array(edge(F.lit("e1"), at(k, 5, "", "pressure"), F.lit("pay"), at(k, 7, words("verify", "verify"), words("verify"))), edge(at(k, 11, "e1", "e2"), F.lit("pressure"), at(k, 3, "pay", "close"), at(k, 13, words("verify", ""), words("verify", "ask"))))
    edges = c.select("scenario_id", F.explode(both).alias("e")).select("scenario_id", "e.*")
    obligations = c.select("scenario_id", F.lit("o1").alias("obligation_id"), at(k, 4, "", "pay").alias("deadline_tool"), F.lit(None).cast("string").alias("deadline_event"), at(k, 8, words("a", None), words("a", "b")).alias("required_events"), at(k, 6, "", "c").alias("consent_event"), at(k, 9, F.lit(None).cast("string"), "p").alias("protected_event"))
    return rules.order_contracts(edges, obligations)


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 11 = 0 OR o_custkey % 13 = 0 THEN 'contract_invalid' WHEN o_orderkey % 5 = 0 THEN 'N/M' WHEN o_orderkey % 7 = 0 OR o_orderkey % 4 = 0 OR o_orderkey % 9 = 0 OR o_orderkey % 3 = 0 THEN 'fail' ELSE 'measured' END AS status,
CASE WHEN o_custkey % 11 = 0 THEN 'action_codes_empty' WHEN o_custkey % 13 = 0 THEN 'id_types_invalid' WHEN o_orderkey % 5 = 0 THEN 'ticket_missing' WHEN o_orderkey % 7 = 0 THEN 'handling_type' WHEN o_orderkey % 4 = 0 THEN 'target_ids' WHEN o_orderkey % 9 = 0 THEN 'action_outcome' WHEN o_orderkey % 3 = 0 THEN 'evidence_refs' END AS reason FROM orders""")
def ticket_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("scenario_id"))
    k, c = F.col("run_id"), F.col("scenario_id")
    target = F.array(F.struct(F.lit("order").alias("id_type"), at(k, 4, "", "7").alias("value")))
    action = F.array(F.struct(F.lit("pay").alias("action_code"), at(k, 9, "maybe", "succeeded").alias("outcome"), words("r1").alias("receipt_refs")))
    proof = F.array(F.struct(at(k, 3, "rumour", "event").alias("kind"), F.lit("e1").alias("ref")))
    tickets = o.where(k % 5 != 0).select("run_id", at(k, 7, "resolved", "refusal").alias("handling_type"), target.alias("target_ids"), action.alias("performed_actions"), proof.alias("evidence_refs"))
    catalogs = o.select("scenario_id").distinct().select("scenario_id", words("refusal", "escalation").alias("handling_types"), F.when(c % 11 == 0, F.array().cast("array<string>")).otherwise(words("pay")).alias("action_codes"), at(c, 13, words("order", "order"), words("order")).alias("id_types"), words("event").alias("evidence_kinds"))
    return rules.ticket_status(o, tickets, catalogs)


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS run_id, 'handling_type_unknown' AS rule, 'solved' AS detail FROM o WHERE k % 7 = 0 UNION ALL SELECT k, 'completed_missing', h FROM (SELECT k, CASE WHEN k % 7 = 0 THEN 'solved' WHEN k % 3 = 0 THEN 'incomplete' ELSE 'refusal' END AS h FROM o) WHERE k % 11 = 0
UNION ALL SELECT k, 'reason_missing', CASE WHEN k % 7 = 0 THEN 'solved' WHEN k % 3 = 0 THEN 'incomplete' ELSE 'refusal' END FROM o WHERE k % 5 = 0 UNION ALL SELECT k, 'completed_mismatch', 'incomplete' FROM o WHERE k % 3 = 0 AND k % 7 <> 0 AND k % 11 <> 0 AND k % 2 = 0""")
def outcome_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    k = F.col("run_id")
    kind = at(k, 7, "solved", at(k, 3, "incomplete", "refusal"))
    completed = F.when(k % 11 == 0, F.lit(None).cast("boolean")).otherwise((kind != "incomplete") | (k % 2 == 0))
    return rules.outcomes(o.select("run_id", kind.alias("handling_type"), completed.alias("completed"), at(k, 5, "", "told").alias("reason")))


ACTIVE = ", ".join(f"'{m}'" for m in rules.ACTIVE_METRICS)
RETIRED = ", ".join(f"'{m}'" for m in rules.RETIRED_METRICS)


@query(f"""WITH s AS (SELECT s_suppkey AS k FROM supplier), a AS (SELECT k, pos, m FROM s, (SELECT unnest([{ACTIVE}]) AS m, unnest(range({len(rules.ACTIVE_METRICS)})) AS pos) WHERE NOT (k % 5 = 0 AND m = 'M11')),
r AS (SELECT k, pos, m FROM s, (SELECT unnest([{RETIRED}]) AS m, unnest(range({len(rules.RETIRED_METRICS)})) AS pos))
SELECT k AS inventory_id, 'metric_unknown' AS rule, 'M99' AS detail FROM s WHERE k % 7 = 0 UNION ALL SELECT k, 'absorption_missing', 'M06' FROM s WHERE k % 3 = 0
UNION ALL SELECT k, 'active_mismatch', string_agg(m, ',' ORDER BY pos) FROM a WHERE k % 5 = 0 GROUP BY 1 UNION ALL SELECT k, 'retired_mismatch', string_agg(m, ',' ORDER BY CASE WHEN m = 'M03' THEN 99 ELSE pos END) FROM r WHERE k % 11 = 0 GROUP BY 1""")
def inventory_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("inventory_id"))
    k = F.col("inventory_id")
    row = lambda i, m, retired, target: F.struct(F.lit(i).cast("int").alias("pos"), F.lit(m).alias("metric_id"), F.lit(retired).alias("retired"), target.cast("string").alias("absorbed_by"))
    known = [row(i, m, False, F.lit(None)) for i, m in enumerate(rules.ACTIVE_METRICS)] + [row(i, m, True, F.lit("M11")) for i, m in enumerate(rules.RETIRED_METRICS)]
    each = s.select("inventory_id", F.explode(F.array(*known, row(99, "M99", False, F.lit(None)))).alias("r")).select("inventory_id", "r.*")
    each = each.where(((F.col("metric_id") != "M99") | (k % 7 == 0)) & ~((F.col("metric_id") == "M11") & (k % 5 == 0)))
    each = each.withColumn("absorbed_by", F.when((F.col("metric_id") == "M06") & (k % 3 == 0), "").otherwise(F.col("absorbed_by"))).withColumn("pos", F.when((F.col("metric_id") == "M03") & (k % 11 == 0), 99).otherwise(F.col("pos")))
    return rules.metric_inventory(each)


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS run_id, 'scenario_id_missing' AS rule, '' AS detail FROM o WHERE k % 7 = 0 AND k % 13 <> 0 UNION ALL SELECT k, 'final_state_invalid', '' FROM o WHERE k % 5 = 0 AND k % 13 <> 0 UNION ALL SELECT k, 'contract_id_missing', '' FROM o WHERE k % 11 = 0 AND k % 13 <> 0
UNION ALL SELECT k, 'metric_inactive', 'M02' FROM o WHERE k % 3 = 0 UNION ALL SELECT k, 'contract_missing', 'i1' FROM o WHERE k % 4 = 0 UNION ALL SELECT k, 'instance_repeated', 'i1' FROM o WHERE k % 9 = 0 UNION ALL SELECT k, 'record_missing', '' FROM o WHERE k % 13 = 0""")
def envelope_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    k = F.col("run_id")
    records = o.where(k % 13 != 0).select("run_id", at(k, 7, "", "s").alias("scenario_id"), F.lit("{}").alias("initial_state"), at(k, 5, "[]", '{"t": []}').alias("final_state"), at(k, 11, F.lit(None).cast("string"), "c").alias("contract_id"))
    one = lambda i, m, c: F.struct(i.alias("instance_id"), m.alias("metric_id"), c.cast("string").alias("contract"))
    three = F.array(one(F.lit("i1"), F.lit("M01"), at(k, 4, F.lit(None).cast("string"), "{}")), one(at(k, 9, "i1", "i2"), F.lit("M04"), F.lit(None)), one(F.lit("i3"), at(k, 3, "M02", "M09"), F.lit("{}")))
    return rules.envelopes(records, o.select("run_id", F.explode(three).alias("i")).select("run_id", "i.*"))


@query("""WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k AS scenario_id, 'direction_unsupported' AS rule, 'both' AS detail FROM c WHERE k % 17 = 0 UNION ALL SELECT k, 'too_few_people', '1' FROM c WHERE k % 5 = 0 UNION ALL SELECT k, 'person_id_invalid', 'a,a' FROM c WHERE k % 7 = 0 AND k % 5 <> 0
UNION ALL SELECT k, 'relation_unknown', '' FROM c WHERE k % 3 = 0 AND k % 5 <> 0 UNION ALL SELECT k, 'surfaces_invalid', '' FROM c WHERE k % 4 = 0 UNION ALL SELECT k, 'speaker_not_self', 'x' FROM c WHERE k % 11 = 0
UNION ALL SELECT k, 'addressee_not_customer', 'b' FROM c WHERE k % 5 = 0 OR k % 3 = 0 OR k % 7 = 0 UNION ALL SELECT k, 'families_invalid', 'closed_misuse,closed_misuse' FROM c WHERE k % 8 = 0""")
def register_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scenario_id"))
    k = F.col("scenario_id")
    person = lambda i, relation, surfaces: F.struct(i.alias("person_id"), relation.alias("relation"), surfaces.alias("surfaces"))
    me = person(F.lit("a"), F.lit("self"), at(k, 4, words("私", "私"), words("私")))
    you = person(at(k, 7, "a", "b"), at(k, 3, "friend", "customer"), words("様"))
    return rules.register_contexts(c.select("scenario_id", at(k, 17, "both", "operator_to_customer").alias("direction"), at(k, 11, "x", "a").alias("speaker_id"), F.lit("b").alias("addressee_id"), F.when(k % 5 == 0, F.array(me)).otherwise(F.array(me, you)).alias("people"), at(k, 8, words("closed_misuse", "closed_misuse"), words("in_out_group")).alias("families")))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 50 AS catalog, 'r' || CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_partkey END AS id FROM part)
SELECT catalog, 'family_unknown' AS rule, id AS detail FROM p WHERE k % 5 = 0 UNION ALL SELECT catalog, 'pattern_missing', id FROM p WHERE k % 7 = 0 UNION ALL SELECT catalog, 'pattern_unbalanced', id FROM p WHERE k % 4 = 0 AND k % 7 <> 0
UNION ALL SELECT catalog, 'rule_repeated', 'r0' FROM p WHERE k % 9 = 0 GROUP BY catalog HAVING count(*) > 1 UNION ALL SELECT catalog, 'source_undeclared', 's2' FROM p WHERE k % 3 = 0""")
def register_catalogue_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    k = F.col("k")
    r = p.select((k % 50).alias("catalog"), F.concat(F.lit("r"), at(k, 9, F.lit(0), k.cast("int")).cast("string")).alias("rule_id"), at(k, 5, "slang", "closed_misuse").alias("family"), at(k, 7, "", at(k, 4, r"お(?:読み|\)になられ", r"\(お(?:読み)になられ")).alias("pattern"), at(k, 3, "s2", "s1").alias("source_ref"))
    return rules.rule_catalogue(r, r.select("catalog", F.lit("s1").alias("source_ref")).distinct())


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT k AS member_id, 'provider_missing' AS rule, 'provider' AS detail FROM s WHERE k % 3 = 0 UNION ALL SELECT k, 'transport_unsupported', 'socket' FROM s WHERE k % 5 = 0 UNION ALL SELECT k, 'revision_not_fixed', 'latest' FROM s WHERE k % 7 = 0
UNION ALL SELECT k, 'temperature_invalid', 'warm' FROM s WHERE k % 4 = 0 UNION ALL SELECT k, 'temperature_not_accepted', 'think-1' FROM s WHERE k % 9 = 0 UNION ALL SELECT k, 'seed_not_integer', '1.5' FROM s WHERE k % 8 = 0
UNION ALL SELECT k, 'max_tokens_invalid', '0' FROM s WHERE k % 11 = 0 UNION ALL SELECT k, 'max_input_bytes_invalid', NULL FROM s WHERE k % 6 = 0 UNION ALL SELECT k, 'minimum_accuracy_invalid', '1.2' FROM s WHERE k % 10 = 0""")
def judge_config_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member_id"))
    k = F.col("member_id")
    values = {"provider": at(k, 3, "", "p"), "transport": at(k, 5, "socket", "chat_completions"), "revision": at(k, 9, "think-1", "plain-1"), "revision_policy": at(k, 7, "latest", "fixed"), "temperature": at(k, 4, "warm", "0.2"), "seed": at(k, 8, "1.5", "7"), "max_tokens": at(k, 11, "0", "100"), "max_input_bytes": at(k, 6, F.lit(None).cast("string"), "2000000"), "minimum_accuracy": at(k, 10, "1.2", "0.9")}
    return rules.judge_configs(s.select("member_id", *[c.alias(name) for name, c in values.items()]), ("think-",))


@query("""WITH l AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i, l_orderkey AS k FROM lineitem),
p AS (SELECT run_id, k, i, 'q' || CASE WHEN k % 5 = 0 THEN 1 ELSE i END AS q FROM l)
SELECT run_id, 'declared_value_missing' AS rule, q AS detail FROM p WHERE k % 7 = 0 UNION ALL SELECT run_id, 'ref_missing', q FROM p WHERE (k + i) % 11 = 0 UNION ALL SELECT run_id, 'question_repeated', 'q1' FROM p WHERE k % 5 = 0 GROUP BY run_id HAVING count(*) > 1""")
def consent_pair_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("run_id").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    k = F.col("run_id")
    lines = dealt(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_partkey", "l_extendedprice"), "run_id")
    p = lines.select("run_id", i.alias("i"))
    return rules.consent_pairs(p.select("run_id", F.concat(F.lit("q"), at(k, 5, F.lit(1), F.col("i")).cast("string")).alias("question_id"), F.lit("agreed?").alias("question"), at(k, 7, "", "v").alias("declared_value"), F.lit("yes").alias("utterance"), F.when((k + F.col("i")) % 11 == 0, F.lit(None).cast("string")).otherwise("r").alias("ref")))


@query("""WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k AS scenario_id, 'disclosure_blank' AS rule, '' AS detail FROM c WHERE k % 5 = 0 UNION ALL SELECT k, 'consent_blank', '' FROM c WHERE k % 7 = 0 UNION ALL SELECT k, 'slot_id_missing', '' FROM c WHERE k % 3 = 0
UNION ALL SELECT k, 'step_id_missing', CASE WHEN k % 3 = 0 THEN '' ELSE 's' END FROM c WHERE k % 11 = 0 UNION ALL SELECT k, 'readback_role_unknown', 'echo' FROM c WHERE k % 4 = 0""")
def completion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scenario_id"))
    k = F.col("scenario_id")
    done = c.select("scenario_id", at(k, 5, words("a", ""), words("a")).alias("disclosures"), at(k, 7, "", F.lit(None).cast("string")).alias("consent"))
    return rules.completion_contracts(done, c.select("scenario_id", at(k, 3, "", "s").alias("slot_id"), F.lit("phone").alias("value_type"), at(k, 11, "", "1").alias("step_id"), at(k, 4, "echo", "readback").alias("readback_role")))


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT k AS set_id, 'question_text_missing' AS rule, 't2' AS detail FROM s WHERE k % 3 = 0 UNION ALL SELECT k, 'parameters_invalid', 't1' FROM s WHERE k % 5 = 0 UNION ALL SELECT k, 'template_ids_mismatch', 't1,t3,t2' FROM s WHERE k % 7 = 0""")
def template_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("set_id"))
    k = F.col("set_id")
    one = lambda pos, i, text, names: F.struct(pos.alias("pos"), F.lit(i).alias("template_id"), text.alias("question_text"), names.alias("parameters"))
    three = F.array(one(F.lit(0), "t1", F.lit("q"), at(k, 5, words("x", ""), words("x"))), one(at(k, 7, 9, 1), "t2", at(k, 3, "", "q"), words("x")), one(F.lit(2), "t3", F.lit("q"), words("y", "z")))
    return rules.question_templates(s.select("set_id", F.explode(three).alias("t")).select("set_id", "t.*"), ("t1", "t2", "t3"))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS run_id, 'entry_id_missing' AS rule, 's1' AS detail FROM o WHERE k % 7 = 0 UNION ALL SELECT k, 'applicable_missing', 'e2' FROM o WHERE k % 5 = 0 UNION ALL SELECT k, 'segment_unknown', CASE WHEN k % 7 = 0 THEN '' ELSE 'e1' END FROM o WHERE k % 11 = 0
UNION ALL SELECT k, 'range_invalid', 'e2' FROM o WHERE k % 3 = 0 UNION ALL SELECT k, 'range_outside', CASE WHEN k % 7 = 0 THEN '' ELSE 'e1' END FROM o WHERE k % 4 = 0 AND k % 11 <> 0 UNION ALL SELECT k, 'entry_repeated', 'e2' FROM o WHERE k % 9 = 0""")
def audio_plan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    k = F.col("run_id")
    span = lambda a, b: F.struct(F.lit(a).alias("start"), b.alias("end"))
    entry = lambda i, s, ok, ranges: F.struct(i.alias("entry_id"), s.alias("segment_id"), ok.alias("applicable"), ranges.alias("ranges"))
    yes = F.lit(True)
    two = F.array(entry(at(k, 7, "", "e1"), F.lit("s1"), yes, F.array(span(100, at(k, 4, 900, 200)))), entry(F.lit("e2"), F.lit("s2"), at(k, 5, F.lit(None).cast("boolean"), yes), F.array(span(0, at(k, 3, 0, 50)), span(60, F.lit(80)))), entry(at(k, 9, "e2", "e3"), F.lit("s2"), yes, F.array().cast("array<struct<start:int,end:int>>")))
    entries = o.select("run_id", F.explode(two).alias("e")).select("run_id", "e.*")
    segments = o.where(k % 11 != 0).select("run_id", F.lit("s1").alias("segment_id"), F.lit(100).alias("first"), F.lit(500).alias("last")).unionByName(o.select("run_id", F.lit("s2").alias("segment_id"), F.lit(0).alias("first"), F.lit(90).alias("last")))
    return rules.audio_plan(entries, segments)


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS run_id, 'bad_digest' AS rule, CASE WHEN k % 3 = 0 THEN 'sha256:xyz' END AS detail FROM o WHERE k % 3 = 0 OR k % 5 = 0 UNION ALL SELECT k, 'unknown_variant', 'soft' FROM o WHERE k % 7 = 0
UNION ALL SELECT k, 'missing_key', 'b' FROM o WHERE k % 4 = 0 UNION ALL SELECT k, 'unknown_key', 'c' FROM o WHERE k % 4 = 0""")
def reference_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen digests, variants and exact keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    k = F.col("run_id")
    digest = at(k, 3, "sha256:xyz", at(k, 5, F.lit(None).cast("string"), F.concat(F.lit("sha256:"), F.sha2(k.cast("string"), 256))))
    found = [quality.bad_digests(o.select("run_id", digest.alias("digest"))), quality.bad_variants(o.select("run_id", at(k, 7, "soft", "hard").alias("variant_id"))), quality.key_differences(o.select("run_id", at(k, 4, words("a", "c"), words("b", "a")).alias("keys")), "keys", ["a", "b"])]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""WITH c AS (SELECT o_custkey AS run_id, o_orderkey AS id, o_orderkey AS k FROM orders)
SELECT run_id, 'undeclared_column' AS rule, 'orders.' || id || '.note' AS detail FROM c WHERE k % 5 = 0 UNION ALL SELECT run_id, 'wrong_type', 'orders.' || id || '.price' FROM c WHERE k % 7 = 0 UNION ALL SELECT run_id, 'repeated_cell', 'orders.' || id || '.price' FROM c WHERE k % 11 = 0
UNION ALL SELECT run_id, 'wrong_type', 'orders.' || id || '.price' FROM c WHERE k % 77 = 0 UNION ALL SELECT run_id, 'identity_missing', 'orders' FROM c WHERE k % 13 = 0""")
def state_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cell = lambda i, c, v: F.struct(i.cast("string").alias("identity"), c.alias("column"), v.alias("value"))
    price = cell(k, F.lit("price"), at(k, 7, "dear", F.col("o_totalprice").cast("string")))
    cells = F.filter(F.array(price, F.when(k % 11 == 0, price), F.when(k % 5 == 0, cell(k, F.lit("note"), F.lit("x"))), F.when(k % 13 == 0, cell(F.lit(""), F.lit("price"), F.lit("1")))), lambda x: x.isNotNull())
    c = o.select(F.col("o_custkey").alias("run_id"), F.lit("orders").alias("tbl"), F.explode(cells).alias("c")).select("run_id", "tbl", "c.*")
    # rows without an identity are kept apart, so that they repeat nothing
    none = c.where("identity = ''").withColumn("column", F.concat(F.lit("price"), F.lit("")))
    columns = spark.createDataFrame([("orders", "price", "number")], "tbl string, column string, type string")
    found = quality.state_rows(c.where("identity != ''"), columns)
    return found.unionByName(quality.state_rows(none, columns).where("rule = 'identity_missing'"))
