"""Post-call tickets: facts derived from events, comparison, handling type and run outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, union

#: Handling types, and how state rows write them: fixed values.
HANDLING_TYPES = ("change_procedure", "guidance_inquiry_answer", "refusal", "escalation", "callback_commitment")
INCOMPLETE = "incomplete"
WRITTEN = {"change": "change_procedure", "guidance": "guidance_inquiry_answer", "refusal": "refusal", "escalation": "escalation", "callback": "callback_commitment"}


def facts(attempts: DataFrame) -> DataFrame:
    """Per run, in call order: actions (tool:outcome), distinct targets and distinct evidence.

    attempts: run_id, call_seq, tool, outcome, target, evidence.
    """
    line = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("call_seq", F.col(c).alias("x")))), lambda s: s["x"])
    a = attempts.withColumn("_action", F.concat_ws(":", "tool", "outcome"))
    seen = lambda c: F.array_distinct(F.filter(line(c), lambda x: x.isNotNull()))
    return a.groupBy("run_id").agg(line("_action").alias("actions"), seen("target").alias("targets"), seen("evidence").alias("evidence"))


def same_multiset(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_sort(a).eqNullSafe(F.array_sort(b)), F.lit(False))


def same_set(a: Column, b: Column) -> Column:
    return F.coalesce((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0), F.lit(False))


def same_list(a: Column, b: Column) -> Column:
    return F.coalesce(a.eqNullSafe(b), F.lit(False))


#: Catalogue calls that a ticket may list and no expected action names: fixed values.
CATALOG_ACTIONS = ("search_sop_categories", "search_sops_in_category", "get_sop")


def actions_match(observed: Column, expected: Column) -> Column:
    """Whether two action lists agree place by place, catalogue calls aside; a target may be any of the
    candidates that the call's result carried.

    observed: array of (action_code, target_ref, outcome, receipt_refs); expected: the same with
    candidates (array).
    """
    own = F.filter(observed, lambda x: ~F.coalesce(x["action_code"].isin(*CATALOG_ACTIONS), F.lit(False)))
    target = lambda x, y: x["target_ref"].eqNullSafe(y["target_ref"]) | F.coalesce(F.array_contains(y["candidates"], x["target_ref"]), F.lit(False))
    same = lambda x, y: F.lit(True) if x is None else target(x, y) & x["action_code"].eqNullSafe(y["action_code"]) & x["outcome"].eqNullSafe(y["outcome"]) & x["receipt_refs"].eqNullSafe(y["receipt_refs"])
    return F.coalesce((F.size(own) == F.size(expected)) & F.forall(F.zip_with(own, expected, same), lambda ok: F.coalesce(ok, F.lit(False))), F.lit(False))


def compare(tickets: DataFrame, derived: DataFrame) -> DataFrame:
    """Four fields right or wrong, and the share that is right; a missing ticket is not measurable.

    tickets: run_id, handling_type, targets, actions, evidence; derived the same.
    """
    d = derived.select("run_id", *[F.col(c).alias(f"_{c}") for c in ("handling_type", "targets", "actions", "evidence")])
    both = d.join(tickets.withColumn("_has", F.lit(True)), "run_id", "left")
    right = {
        "handling_ok": F.coalesce(F.col("handling_type") == F.col("_handling_type"), F.lit(False)),
        "targets_ok": same_multiset(F.col("targets"), F.col("_targets")),
        "actions_ok": same_list(F.col("actions"), F.col("_actions")),
        "evidence_ok": same_set(F.col("evidence"), F.col("_evidence")),
    }
    has = F.coalesce("_has", F.lit(False))
    score = sum((c.cast("double") for c in right.values()), F.lit(0.0)) / 4
    return both.select("run_id", *[c.alias(k) for k, c in right.items()], F.when(has, score).alias("score"), F.when(has, "measured").otherwise("N/M").alias("status"))


def _fold(kinds: Column, first: tuple[str, ...], then: tuple[str, ...] = ()) -> Column:
    """The first of `first` that occurs; guidance if nothing else does; then the first of `then`; else
    a change. Null for no kinds."""
    held = lambda k: F.array_contains(kinds, k)
    guidance = HANDLING_TYPES[1]
    out = F.lit(HANDLING_TYPES[0])
    for k in reversed(then):
        out = F.when(held(k), k).otherwise(out)
    out = F.when(F.forall(kinds, lambda k: F.coalesce(k == guidance, F.lit(False))), guidance).otherwise(out)
    for k in reversed(first):
        out = F.when(held(k), k).otherwise(out)
    return F.when(F.coalesce(F.size(kinds), F.lit(0)) > 0, out)


def handling_type(roles: Column) -> Column:
    """Handling type of a ticket from the roles of its successful operations (null: no role)."""
    return _fold(roles, ("escalation", "callback_commitment"), ("refusal",))


def outcome_handling(kinds: Column) -> Column:
    """Handling type of a run from what its events or final state name; unknown names don't count."""
    known = F.filter(kinds, lambda k: F.coalesce(k.isin(*HANDLING_TYPES), F.lit(False)))
    return _fold(known, ("escalation", "callback_commitment", "refusal"))


def observed_handling(written: Column) -> tuple[Column, Column]:
    """The one handling type that changed rows name, and why there is none: not observed, ambiguous."""
    names = F.create_map(*[F.lit(x) for pair in WRITTEN.items() for x in pair])
    known = F.array_distinct(F.filter(F.transform(written, lambda w: F.try_element_at(names, w)), lambda x: x.isNotNull()))
    n = F.coalesce(F.size(known), F.lit(0))
    reason = F.when(n == 0, "handling_type_not_observed").when(n > 1, "handling_type_ambiguous")
    return F.when(n == 1, F.get(known, F.lit(0))), reason


def completed_without_record(status: Column, target_reached: Column, ended: Column) -> Column:
    """Whether a run without a stored outcome came to its end: by its status, its target, or an event
    that offers to end the call."""
    return F.coalesce(status.isin("success", "ok"), F.lit(False)) | F.coalesce(target_reached, F.lit(False)) | F.coalesce(ended, F.lit(False))


def run_outcome(runs: DataFrame) -> DataFrame:
    """(run_id, handling_type, completed, reason) of every run.

    runs: run_id, stored (handling type in the record, or null), completed, from_events and from_state
    (arrays of handling types), changed (whether a result changed the state).
    """
    seen = F.coalesce(outcome_handling(F.col("from_events")), outcome_handling(F.col("from_state")), F.when(F.col("changed"), HANDLING_TYPES[0]))
    kind = F.when(F.col("stored").isNotNull(), F.col("stored")).when(~F.col("completed"), INCOMPLETE).otherwise(F.coalesce(seen, F.lit(INCOMPLETE)))
    reason = F.when(F.col("stored").isNotNull(), "stored").when(~F.col("completed"), "run_not_completed").when(seen.isNull(), "completion_record_missing").otherwise("observed_run_evidence")
    return runs.select("run_id", kind.alias("handling_type"), (kind != INCOMPLETE).alias("completed"), reason.alias("reason"))


def confirmed_evidence(claimed: DataFrame, valid: DataFrame, mandatory: DataFrame) -> DataFrame:
    """Claimed references that exist, in their order, then the mandatory ones that were not claimed.

    claimed: run_id, pos, kind, ref; valid and mandatory: run_id, kind, ref. All three are dealt by run once,
    and sorted once.
    """
    keys = ["run_id", "kind", "ref"]
    place = claimed.schema["pos"].dataType
    side = lambda df, name, pos: df.select(*keys, F.lit(name).alias("_side"), pos.cast(place).alias("pos"))
    rows = dealt(union([side(claimed, "claimed", F.col("pos")), side(valid, "valid", F.lit(None)), side(mandatory, "mandatory", F.lit(None))]), "run_id")
    of = lambda name: F.col("_side") == name
    same, run = Window.partitionBy(*keys), Window.partitionBy("run_id")
    # a reference without a run, kind or name equals no other
    whole = F.col("run_id").isNotNull() & F.col("kind").isNotNull() & F.col("ref").isNotNull()
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_side").orderBy("pos")))
    rows = rows.withColumns({"_valid": whole & F.max(of("valid")).over(same), "_claimed": F.max(of("claimed")).over(same)})
    extra = of("mandatory") & (F.col("_nth") == 1) & ~(F.col("_valid") & F.col("_claimed"))
    last = F.when(F.col("run_id").isNotNull(), F.max(F.when(of("claimed"), F.col("pos"))).over(run))
    rows = rows.withColumns({"_extra": extra, "_last": last})
    number = F.sum(F.col("_extra").cast("int")).over(run.orderBy("kind", "ref").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.withColumn("_number", number).where(of("claimed") & F.col("_valid") | F.col("_extra"))
    return rows.select(*keys, F.when(F.col("_extra"), F.coalesce("_last", F.lit(-1)) + F.col("_number")).otherwise(F.col("pos")).alias("pos"))
