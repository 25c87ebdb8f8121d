"""Validity of contracts: tools, procedures, obligations, tickets, outcomes, metrics, envelopes, register
contexts, judges and audio plans. Every function returns one row per violation: its key, rule, detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, broken, dim, lost, repeated, union
from .quality import matches_type
from .tickets import HANDLING_TYPES, INCOMPLETE

#: Fixed values of the contracts.
OPERATIONS = ("filtered_search", "update", "create")
COMPARISONS = ("eq", "lte", "gte")
STEP_KINDS = ("question", "explain", "tool")
PROCEDURE_TEXTS = ("title", "applicability", "completion", "prohibition", "escalation")
ACTIVE_METRICS = ("M01", "M04", "M05", "M09", "M11", "M14", "M15", "M16", "M17", "M19", "M20", "M21", "M22", "M23", "M25", "M26", "M24")
RETIRED_METRICS = ("M02", "M03", "M06", "M08", "M10", "M12", "M13", "M18")
NULLABLE_METRICS = ("M04", "M05")
RELATIONS = ("self", "in_group", "customer", "out_group")
RULE_FAMILIES = ("closed_misuse", "honorific_direction", "in_out_group")
DIRECTION = "operator_to_customer"
ACTION_OUTCOMES = ("succeeded", "failed")
READBACK_ROLES = ("readback", "consent", "statement")
CATALOGS = ("handling_types", "action_codes", "id_types", "evidence_kinds")


def _twice(c: Column) -> Column:
    return F.size(c) != F.size(F.array_distinct(c))


def _has_blank(c: Column) -> Column:
    return F.exists(c, lambda x: blank(x))


def tool_contracts(tools: DataFrame, args: DataFrame, filters: DataFrame, sets: DataFrame, columns: DataFrame) -> DataFrame:
    """Tools, their arguments, search filters and mutations against the state's columns.

    tools: tool, operation, entity; args: tool, name, type, required; filters: tool, column, argument,
    constant, op; sets: tool, column, argument, constant; columns: tbl, column, type.
    """
    entity = tools.select("tool", F.col("entity").alias("tbl"), "operation")
    names = args.select("tool", F.col("name").alias("argument"), F.lit(True).alias("_arg")).distinct()
    types = dim(columns.select("tbl", "column", "type"))
    one = F.col("argument").isNull() != F.col("constant").isNull()

    def sources(df: DataFrame, what: str) -> DataFrame:
        d = df.join(entity, "tool", "left").join(types, ["tbl", "column"], "left").join(names, ["tool", "argument"], "left")
        rules = {
            f"{what}_column_undeclared": (F.col("type").isNull(), F.col("column")),
            f"{what}_source_not_single": (~one, F.col("column")),
            f"{what}_argument_unknown": (F.col("argument").isNotNull() & F.col("_arg").isNull(), F.col("argument")),
            f"{what}_constant_mistyped": (F.col("type").isNotNull() & F.col("constant").isNotNull() & ~matches_type(F.col("constant"), F.col("type")), F.col("column")),
        }
        if what == "filter":
            rules["operator_unsupported"] = (~F.coalesce(F.col("op").isin(*COMPARISONS), F.lit(False)), F.col("op"))
        return broken(d, "tool", rules)

    changed = sets.groupBy("tool").agg(F.count("*").alias("_sets"))
    t = tools.join(changed, "tool", "left").join(dim(columns.select(F.col("tbl").alias("entity"), F.lit(True).alias("_tbl")).distinct()), "entity", "left")
    search = F.col("operation") == OPERATIONS[0]
    own = broken(
        t,
        "tool",
        {
            "operation_unsupported": (~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), F.col("operation")),
            "table_unknown": (F.col("_tbl").isNull(), F.col("entity")),
            "search_mutates": (search & F.col("_sets").isNotNull(), F.col("_sets")),
            "mutation_missing": (F.col("operation").isin(*OPERATIONS[1:]) & F.col("_sets").isNull(), F.col("operation")),
        },
    )
    given = broken(args, "tool", {"required_not_boolean": (F.col("required").isNull(), F.col("name")), "argument_type_missing": (blank(F.col("type")), F.col("name"))})
    return union([own, given, repeated(args, ["tool", "name"], "argument_repeated", "tool"), sources(filters, "filter"), sources(sets, "mutation")])


def procedures(sops: DataFrame, steps: DataFrame, categories: DataFrame) -> DataFrame:
    """The procedure catalogue: unique ids, required texts, steps of a known kind with what they need.

    sops: sop_id, category_id and the texts; steps: sop_id, step_id, kind, tool_id, description;
    categories: category_id, title. Key: sop_id (null for a category's own violation).
    """
    own = broken(sops, "sop_id", {f"{c}_missing": (blank(F.col(c)), F.lit(c)) for c in PROCEDURE_TEXTS})
    none = sops.join(steps.select("sop_id").distinct(), "sop_id", "left_anti").select("sop_id", F.lit("no_steps").alias("rule"), F.lit("").alias("detail"))
    kind = F.col("kind")
    step = broken(
        steps,
        "sop_id",
        {
            "step_id_missing": (blank(F.col("step_id")), kind),
            "kind_unknown": (~F.coalesce(kind.isin(*STEP_KINDS), F.lit(False)), F.col("step_id")),
            "tool_missing": ((kind == "tool") & blank(F.col("tool_id")), F.col("step_id")),
            "description_missing": (kind.isin("question", "explain") & blank(F.col("description")), F.col("step_id")),
        },
    )
    c = categories.join(sops.select("category_id", F.lit(True).alias("_used")).distinct(), "category_id", "left").withColumn("sop_id", F.lit(None).cast(sops.schema["sop_id"].dataType))
    group = broken(c, "sop_id", {"category_title_missing": (blank(F.col("title")), F.col("category_id")), "category_empty": (F.col("_used").isNull(), F.col("category_id"))})
    n = sops.groupBy("sop_id").agg(F.count("*").alias("_n")).where("_n > 1").select("sop_id", F.lit("sop_repeated").alias("rule"), F.col("_n").cast("string").alias("detail"))
    return union([own, none, step, group, n])


def order_contracts(edges: DataFrame, obligations: DataFrame) -> DataFrame:
    """Order edges and obligations of each scenario.

    edges: scenario_id, edge_id, trigger_type, action_tool, required_tools; obligations: scenario_id,
    obligation_id, deadline_tool, deadline_event, required_events, consent_event, protected_event.
    """
    e = broken(
        edges,
        "scenario_id",
        {
            **{f"{c}_missing": (blank(F.col(c)), F.col("edge_id")) for c in ("edge_id", "trigger_type", "action_tool")},
            "required_tools_invalid": (F.col("required_tools").isNull() | _has_blank(F.col("required_tools")) | _twice(F.col("required_tools")), F.col("edge_id")),
        },
    )
    o = broken(
        obligations,
        "scenario_id",
        {
            **{f"{c}_missing": (blank(F.col(c)), F.col("obligation_id")) for c in ("obligation_id", "deadline_tool")},
            **{f"{c}_blank": (F.col(c) == "", F.col("obligation_id")) for c in ("deadline_event", "consent_event", "protected_event")},
            "required_events_invalid": (F.col("required_events").isNull() | _has_blank(F.col("required_events")) | _twice(F.col("required_events")), F.col("obligation_id")),
            "consent_without_action": (F.col("consent_event").isNull() != F.col("protected_event").isNull(), F.col("obligation_id")),
        },
    )
    unique = [repeated(edges, ["scenario_id", c], f"{c}_repeated", "scenario_id") for c in ("edge_id", "action_tool")]
    return union([e, o, *unique, repeated(obligations, ["scenario_id", "obligation_id"], "obligation_id_repeated", "scenario_id")])


def catalog_defects(catalogs: DataFrame) -> DataFrame:
    """Enum catalogues of a scenario's ticket: not empty, no blanks, no repeats."""
    rules = {}
    for c in CATALOGS:
        rules[f"{c}_empty"] = (F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit(c))
        rules[f"{c}_invalid"] = (_has_blank(F.col(c)) | _twice(F.col(c)), F.lit(c))
    return broken(catalogs, "scenario_id", rules)


def ticket_status(runs: DataFrame, tickets: DataFrame, catalogs: DataFrame) -> DataFrame:
    """(run_id, status, reason): an invalid catalogue is an invalid contract, a missing ticket isn't
    measurable, a ticket outside the catalogue fails, any other is measured.

    runs: run_id, scenario_id; tickets: run_id, handling_type, target_ids (array of id_type, value),
    performed_actions (array of action_code, outcome, receipt_refs), evidence_refs (array of kind, ref);
    catalogs: scenario_id and the four catalogues.
    """
    bad = catalog_defects(catalogs).groupBy("scenario_id").agg(F.min("rule").alias("_defect"))
    t = runs.join(catalogs, "scenario_id", "left").join(bad, "scenario_id", "left").join(tickets.withColumn("_has", F.lit(True)), "run_id", "left")
    within = lambda catalog, c: F.coalesce(F.array_contains(F.col(catalog), c), F.lit(False))
    checks = [
        ("handling_type", ~within("handling_types", F.col("handling_type"))),
        *[(f"{c}_missing", F.col(c).isNull()) for c in ("target_ids", "performed_actions", "evidence_refs")],
        ("target_ids", F.exists("target_ids", lambda x: ~within("id_types", x["id_type"]) | blank(x["value"]))),
        ("action_code", F.exists("performed_actions", lambda x: ~within("action_codes", x["action_code"]))),
        ("action_outcome", F.exists("performed_actions", lambda x: ~F.coalesce(x["outcome"].isin(*ACTION_OUTCOMES), F.lit(False)))),
        ("receipt_refs", F.exists("performed_actions", lambda x: x["receipt_refs"].isNull() | _has_blank(x["receipt_refs"]))),
        ("evidence_refs", F.exists("evidence_refs", lambda x: ~within("evidence_kinds", x["kind"]) | blank(x["ref"]))),
    ]
    wrong = F.lit(None).cast("string")
    for reason, test in reversed(checks):
        wrong = F.when(F.coalesce(test, F.lit(False)), reason).otherwise(wrong)
    t = t.withColumn("_wrong", wrong)
    invalid = F.col("_defect").isNotNull() | F.col(CATALOGS[0]).isNull()
    status = F.when(invalid, "contract_invalid").when(F.col("_has").isNull(), "N/M").when(F.col("_wrong").isNotNull(), "fail").otherwise("measured")
    reason = F.when(invalid, F.coalesce("_defect", F.lit("catalog_missing"))).when(F.col("_has").isNull(), "ticket_missing").otherwise(F.col("_wrong"))
    return t.select("run_id", status.alias("status"), reason.alias("reason"))


def outcomes(rows: DataFrame) -> DataFrame:
    """Stored run outcomes. rows: run_id, handling_type, completed, reason."""
    kind = F.col("handling_type")
    return broken(
        rows,
        "run_id",
        {
            "handling_type_unknown": (~F.coalesce(kind.isin(*HANDLING_TYPES, INCOMPLETE), F.lit(False)), kind),
            "completed_missing": (F.col("completed").isNull(), kind),
            "reason_missing": (blank(F.col("reason")), kind),
            "completed_mismatch": (F.col("completed") != (kind != INCOMPLETE), kind),
        },
    )


def metric_inventory(rows: DataFrame) -> DataFrame:
    """Inventories of metrics. rows: inventory_id, pos, metric_id, retired, absorbed_by. Active and retired
    metrics must be exactly the known ones in their order, and a retired one names what took it over."""
    known = F.col("metric_id").isin(*ACTIVE_METRICS, *RETIRED_METRICS)
    each = broken(
        rows,
        "inventory_id",
        {
            "metric_unknown": (~F.coalesce(known, F.lit(False)), F.col("metric_id")),
            "absorption_missing": (F.col("retired") & blank(F.col("absorbed_by")), F.col("metric_id")),
        },
    )
    listed = lambda retired: F.transform(F.array_sort(F.collect_list(F.when(F.col("retired") == retired, F.struct("pos", "metric_id")))), lambda x: x["metric_id"])
    whole = rows.where(known).groupBy("inventory_id").agg(listed(False).alias("_active"), listed(True).alias("_retired"))
    fixed = lambda ids: F.array(*[F.lit(x) for x in ids])
    order = broken(whole, "inventory_id", {"active_mismatch": (F.col("_active") != fixed(ACTIVE_METRICS), F.array_join("_active", ",")), "retired_mismatch": (F.col("_retired") != fixed(RETIRED_METRICS), F.array_join("_retired", ","))})
    return union([each, order])


def envelopes(records: DataFrame, instances: DataFrame) -> DataFrame:
    """Records and their measurement contracts. records: run_id, scenario_id, initial_state, final_state
    (JSON objects as text), contract_id; instances: run_id, instance_id, metric_id, contract."""
    is_object = lambda c: F.coalesce(F.col(c).rlike(r"^\s*\{"), F.lit(False))
    own = broken(
        records,
        "run_id",
        {
            "scenario_id_missing": (blank(F.col("scenario_id")), F.lit("")),
            "initial_state_invalid": (~is_object("initial_state"), F.lit("")),
            "final_state_invalid": (~is_object("final_state"), F.lit("")),
            "contract_id_missing": (blank(F.col("contract_id")), F.lit("")),
        },
    )
    each = broken(
        instances,
        "run_id",
        {
            "instance_id_missing": (blank(F.col("instance_id")), F.col("metric_id")),
            "metric_inactive": (~F.coalesce(F.col("metric_id").isin(*ACTIVE_METRICS), F.lit(False)), F.col("metric_id")),
            "contract_missing": (F.col("contract").isNull() & ~F.coalesce(F.col("metric_id").isin(*NULLABLE_METRICS), F.lit(False)), F.col("instance_id")),
        },
    )
    return union([own, each, repeated(instances, ["run_id", "instance_id"], "instance_repeated", "run_id"), lost(instances, records, ["run_id"], "record_missing", "run_id").distinct()])


def register_contexts(contexts: DataFrame) -> DataFrame:
    """Who speaks to whom. contexts: scenario_id, direction, speaker_id, addressee_id, families (array),
    people (array of person_id, relation, surfaces)."""
    people = F.col("people")
    relation = lambda who, want: F.exists(people, lambda p: (p["person_id"] == F.col(who)) & (p["relation"] == want))
    ids = F.transform(people, lambda p: p["person_id"])
    return broken(
        contexts,
        "scenario_id",
        {
            "direction_unsupported": (~F.coalesce(F.col("direction") == DIRECTION, F.lit(False)), F.col("direction")),
            "too_few_people": (F.coalesce(F.size(people), F.lit(0)) < 2, F.size(people)),
            "person_id_invalid": (_has_blank(ids) | _twice(ids), F.array_join(ids, ",")),
            "relation_unknown": (F.exists(people, lambda p: ~F.coalesce(p["relation"].isin(*RELATIONS), F.lit(False))), F.lit("")),
            "surfaces_invalid": (F.exists(people, lambda p: (F.coalesce(F.size(p["surfaces"]), F.lit(0)) <= 0) | _has_blank(p["surfaces"]) | _twice(p["surfaces"])), F.lit("")),
            "speaker_not_self": (~F.coalesce(relation("speaker_id", "self"), F.lit(False)), F.col("speaker_id")),
            "addressee_not_customer": (~F.coalesce(relation("addressee_id", "customer"), F.lit(False)), F.col("addressee_id")),
            "families_invalid": ((F.coalesce(F.size("families"), F.lit(0)) <= 0) | _twice(F.col("families")) | F.exists("families", lambda f: ~F.coalesce(f.isin(*RULE_FAMILIES), F.lit(False))), F.array_join("families", ",")),
        },
    )


def rule_catalogue(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """Register rules: ids unique, patterns given and compilable, sources declared.
    rules: catalog, rule_id, family, pattern, source_ref; sources: catalog, source_ref."""
    own = broken(
        rules,
        "catalog",
        {
            "rule_id_missing": (blank(F.col("rule_id")), F.col("pattern")),
            "family_unknown": (~F.coalesce(F.col("family").isin(*RULE_FAMILIES), F.lit(False)), F.col("rule_id")),
            "pattern_missing": (blank(F.col("pattern")), F.col("rule_id")),
            "pattern_unbalanced": (F.char_length(F.regexp_replace("pattern", r"\\.|[^(]", "")) != F.char_length(F.regexp_replace("pattern", r"\\.|[^)]", "")), F.col("rule_id")),
        },
    )
    return union([own, repeated(rules, ["catalog", "rule_id"], "rule_repeated", "catalog"), lost(rules, sources, ["catalog", "source_ref"], "source_undeclared", "catalog")])


def judge_configs(configs: DataFrame, without_temperature: tuple[str, ...] = ()) -> DataFrame:
    """Judges: fixed revision, integer seed, temperature rules, bounds. configs: member_id, provider,
    transport, revision, revision_policy, temperature, seed, max_tokens, max_input_bytes,
    minimum_accuracy, all as text."""
    is_int = lambda c: F.coalesce(F.col(c).rlike(r"^-?\d+$"), F.lit(False))
    number = lambda c: F.col(c).try_cast("double")
    fixed_temperature = F.lit(False)
    for name in without_temperature:
        fixed_temperature = fixed_temperature | F.startswith(F.col("revision"), F.lit(name))
    return broken(
        configs,
        "member_id",
        {
            **{f"{c}_missing": (blank(F.col(c)), F.lit(c)) for c in ("provider", "revision")},
            "transport_unsupported": (~F.coalesce(F.col("transport") == "chat_completions", F.lit(False)), F.col("transport")),
            "revision_not_fixed": (~F.coalesce(F.col("revision_policy") == "fixed", F.lit(False)), F.col("revision_policy")),
            "temperature_invalid": (F.col("temperature").isNotNull() & number("temperature").isNull(), F.col("temperature")),
            "temperature_not_accepted": (fixed_temperature & F.col("temperature").isNotNull(), F.col("revision")),
            "seed_not_integer": (~is_int("seed"), F.col("seed")),
            "max_tokens_invalid": (~is_int("max_tokens") | (number("max_tokens") <= 0), F.col("max_tokens")),
            "max_input_bytes_invalid": (~is_int("max_input_bytes") | (number("max_input_bytes") < 1), F.col("max_input_bytes")),
            "minimum_accuracy_invalid": (~F.coalesce(number("minimum_accuracy").between(0, 1), F.lit(False)), F.col("minimum_accuracy")),
        },
    )


def consent_pairs(pairs: DataFrame) -> DataFrame:
    """Consent questions: every field given, ids unique. pairs: run_id, question_id, question,
    declared_value, utterance, ref."""
    fields = ("question_id", "question", "declared_value", "utterance", "ref")
    own = broken(pairs, "run_id", {f"{c}_missing": (blank(F.col(c)), F.col("question_id")) for c in fields})
    return union([own, repeated(pairs, ["run_id", "question_id"], "question_repeated", "run_id")])


def completion_contracts(contracts: DataFrame, values: DataFrame) -> DataFrame:
    """What completes a scenario, and its important values. contracts: scenario_id, disclosures (array),
    consent; values: scenario_id, slot_id, value_type, step_id, readback_role."""
    own = broken(contracts, "scenario_id", {"disclosure_blank": (_has_blank(F.col("disclosures")), F.lit("")), "consent_blank": (F.col("consent") == "", F.lit(""))})
    each = broken(
        values,
        "scenario_id",
        {
            **{f"{c}_missing": (blank(F.col(c)), F.col("slot_id")) for c in ("slot_id", "value_type", "step_id")},
            "readback_role_unknown": (~F.coalesce(F.col("readback_role").isin(*READBACK_ROLES), F.lit(False)), F.col("readback_role")),
        },
    )
    return union([own, each])


def question_templates(templates: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """Question templates of each set: exactly the known ids in order, with a text and named parameters.
    templates: set_id, pos, template_id, question_text, parameters (array)."""
    own = broken(templates, "set_id", {"question_text_missing": (blank(F.col("question_text")), F.col("template_id")), "parameters_invalid": (F.col("parameters").isNull() | _has_blank(F.col("parameters")), F.col("template_id"))})
    whole = templates.groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "template_id"))), lambda x: x["template_id"]).alias("_ids"))
    return union([own, broken(whole, "set_id", {"template_ids_mismatch": (F.col("_ids") != F.array(*[F.lit(x) for x in ids]), F.array_join("_ids", ","))})])


def audio_plan(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """Entries of an audio plan: ids given and unique, sample ranges ordered and inside their segment.
    entries: run_id, entry_id, segment_id, applicable, ranges (array of start, end); segments: run_id,
    segment_id, first, last."""
    e = entries.join(segments.select("run_id", "segment_id", "first", "last"), ["run_id", "segment_id"], "left")
    own = broken(
        e,
        "run_id",
        {
            "entry_id_missing": (blank(F.col("entry_id")), F.col("segment_id")),
            "applicable_missing": (F.col("applicable").isNull(), F.col("entry_id")),
            "segment_unknown": (F.col("first").isNull(), F.col("entry_id")),
            "range_invalid": (F.exists("ranges", lambda r: r["start"].isNull() | r["end"].isNull() | (r["start"] < 0) | (r["end"] <= r["start"])), F.col("entry_id")),
            "range_outside": (F.exists("ranges", lambda r: (r["start"] < F.col("first")) | (r["end"] > F.col("last"))), F.col("entry_id")),
        },
    )
    return union([own, repeated(entries, ["run_id", "entry_id"], "entry_repeated", "run_id")])
