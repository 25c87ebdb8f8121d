"""Important values over transcripts and tool arguments: retention, disclosure, read-back, grounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import core_keywords, same_shape, sequence_ratio, spoken_value, value_kind, value_tokens
from .common import checkpointed, merged

CUSTOMERS = ("user", "customer")
#: Least likeness of a token that counts as an attempt at a value: fixed values.
LIKE_DIGITS, LIKE_KANA = 0.7, 0.5


def read_backs(turns: DataFrame, slots: DataFrame) -> DataFrame:
    """Operator turns between a customer turn that holds a slot's value and the next customer turn.

    turns: run_id, seq, actor, text; slots: run_id, slot_id, value. One row per opportunity, with the
    number of operator turns in it and whether one of them holds the value.
    """
    w = Window.partitionBy("run_id").orderBy("seq")
    users = turns.where(F.col("actor") == "user").withColumn("_next", F.lead("seq").over(w))
    said = users.join(slots, "run_id").where(F.contains("text", "value")).select("run_id", "slot_id", "value", F.col("seq").alias("said_seq"), "_next")
    back = turns.where(F.col("actor") == "operator").select("run_id", "seq", "text")
    inside = said.join(back, "run_id", "left").where(F.col("seq").isNull() | ((F.col("seq") > F.col("said_seq")) & (F.col("_next").isNull() | (F.col("seq") < F.col("_next")))))
    counted = inside.groupBy("run_id", "slot_id", "said_seq").agg(F.count("seq").alias("n_turns"), F.max(F.coalesce(F.contains("text", "value"), F.lit(False))).alias("read_back"))
    keys = ["run_id", "slot_id", "said_seq"]
    return said.select(*keys).join(counted, keys, "left").select(*keys, F.coalesce("n_turns", F.lit(0)).alias("n_turns"), F.coalesce("read_back", F.lit(False)).alias("read_back"))


def read_back_rates(opportunities: DataFrame, target: int = 1) -> DataFrame:
    """Accuracy over opportunities, and observation = sum(min(opportunities, target)) / sum(target)."""
    per = opportunities.groupBy("run_id", "slot_id").agg(F.count("*").alias("n"), F.sum(F.col("read_back").cast("int")).alias("right"))
    return per.groupBy("run_id").agg(F.try_divide(F.sum("right"), F.sum("n")).alias("accuracy"), F.try_divide(F.sum(F.least(F.col("n"), F.lit(target))), F.sum(F.lit(target))).alias("observation"))


def grounded(args: DataFrame, slots: DataFrame) -> DataFrame:
    """Arguments that equal a slot's value must have a known recorded source; one without a ledger
    makes the run not measurable. args: run_id, field, value, source_kind (null: no ledger)."""
    hit = args.join(slots.select("run_id", "value").distinct(), ["run_id", "value"])
    out = hit.groupBy("run_id").agg(F.avg((F.coalesce("source_kind", F.lit("unknown")) != "unknown").cast("double")).alias("rate"), F.max(F.col("source_kind").isNull()).alias("_gap"))
    return out.select("run_id", F.when(~F.col("_gap"), F.col("rate")).alias("rate"), F.when(F.col("_gap"), "N/M").when(F.col("rate") == 1.0, "pass").otherwise("fail").alias("status"))


def agreed_tokens(profiles: DataFrame, kind: str = "digits", least: int = 1) -> DataFrame:
    """Tokens on which all transcripts of a turn agree, if it has at least so many.
    profiles: run_id, seq, transcripts (array)."""
    said = profiles.select("run_id", "seq", F.size("transcripts").alias("_n"), F.posexplode_outer("transcripts").alias("_at", "_t"))
    tokens = said.select("run_id", "seq", "_n", F.explode(value_tokens(F.col("_t"), F.lit(kind))).alias("token")).groupBy("run_id", "seq", "token", "_n").agg(F.count("*").alias("_k"))
    agreed = tokens.where((F.col("_k") == F.col("_n")) & (F.col("_n") >= least)).groupBy("run_id", "seq").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return profiles.select("run_id", "seq").join(merged(agreed), ["run_id", "seq"], "left").select("run_id", "seq", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def disclosed(keywords: DataFrame, profiles: DataFrame) -> DataFrame:
    """A disclosure counts when each of its keywords is in all transcripts of at least one turn.

    keywords: run_id, disclosure_id, keyword; profiles: run_id, seq, transcripts.
    """
    hit = keywords.join(profiles, "run_id", "left").withColumn("_in", F.coalesce(F.forall("transcripts", lambda t: F.contains(t, F.col("keyword"))) & (F.size("transcripts") > 0), F.lit(False)))
    per = hit.groupBy("run_id", "disclosure_id", "keyword").agg(F.max("_in").alias("_in"))
    return per.groupBy("run_id", "disclosure_id").agg(F.bool_and("_in").alias("disclosed"))


def retained(slots: DataFrame, args: DataFrame, spoken: DataFrame) -> DataFrame:
    """Tool arguments that name a slot must hold its value; wrong values that the customer said are
    excused. slots: run_id, slot_id, value; args: run_id, name, value; spoken: run_id, text."""
    s = slots.select("run_id", "slot_id", F.col("value").alias("want"))
    given = args.join(s, (args["run_id"] == s["run_id"]) & (args["name"] == s["slot_id"])).drop(s["run_id"])
    given = given.where(same_shape(F.col("value"), F.col("want"), value_kind(F.col("want"))))
    wrong = given.where("value != want").select("run_id", "slot_id", F.col("value").alias("_bad")).distinct()
    talk = spoken.select(F.col("run_id").alias("_run"), "text")
    real = wrong.join(talk, (F.col("run_id") == F.col("_run")) & F.contains("text", "_bad"), "left_anti")
    bad = real.groupBy("run_id", "slot_id").agg(F.count("*").alias("wrong"))
    seen = given.groupBy("run_id", "slot_id").agg(F.count_if(F.col("value") == F.col("want")).alias("right"))
    out = slots.select("run_id", "slot_id").join(seen, ["run_id", "slot_id"], "left").join(bad, ["run_id", "slot_id"], "left")
    status = F.when(F.coalesce("wrong", F.lit(0)) > 0, "fail").when(F.coalesce("right", F.lit(0)) > 0, "pass").otherwise("N/M")
    return out.select("run_id", "slot_id", status.alias("status"))


def slots(important: DataFrame, gold_args: DataFrame) -> DataFrame:
    """Important values as slots: run_id, slot_id, value, normalized, kind, and the names of the gold
    arguments that carry the value.

    important: run_id, slot_id, name, value, value_type (slot_id or name must be there); gold_args:
    run_id, name, value.
    """
    i = important.select("run_id", F.coalesce("slot_id", "name").alias("slot_id"), "value", spoken_value(F.col("value")).alias("normalized"), value_kind(F.col("value"), F.col("value_type")).alias("kind"))
    g = gold_args.select("run_id", F.col("name").alias("_name"), spoken_value(F.col("value")).alias("normalized"))
    named = i.join(merged(g), ["run_id", "normalized"]).groupBy("run_id", "slot_id").agg(F.array_sort(F.collect_set("_name")).alias("argument_names"))
    has_gold = gold_args.select("run_id", F.lit(True).alias("_gold")).distinct()
    out = i.join(merged(named), ["run_id", "slot_id"], "left").join(merged(has_gold), "run_id", "left")
    none = F.when(F.coalesce("_gold", F.lit(False)), F.array().cast("array<string>"))
    return out.select("run_id", "slot_id", "value", "normalized", "kind", F.coalesce("argument_names", none).alias("argument_names"))


def _customer_texts(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("actor").isin(*CUSTOMERS)).select("run_id", "seq", spoken_value(F.coalesce("text", F.lit(""))).alias("_said"))


def said_slots(slots_: DataFrame, turns: DataFrame) -> DataFrame:
    """Customer turns that hold a slot's value: the slot's columns and said_seq."""
    return slots_.join(merged(_customer_texts(turns)), "run_id").where(F.contains("_said", "normalized")).drop("_said").withColumnRenamed("seq", "said_seq")


def spoken_slots(slots_: DataFrame, turns: DataFrame) -> DataFrame:
    """Slots whose value the customer says at all."""
    return slots_.join(merged(said_slots(slots_, turns).select("run_id", "slot_id").distinct()), ["run_id", "slot_id"], "left_semi")


def transcript_evidence(slots_: DataFrame, turns: DataFrame) -> DataFrame:
    """Attempts of the operator at a slot's value, as all transcripts (two at least) have them: run_id,
    slot_id, seq, token, correct. Other numbers and words that aren't like the value are no attempts.

    turns: run_id, seq, actor, text, transcripts.
    """
    ours = turns.where(F.col("actor") == "operator")
    heard = [agreed_tokens(ours, kind, 2).select("run_id", "seq", F.explode("tokens").alias("token"), F.lit(kind).alias("kind")) for kind in ("digits", "kana")]
    near = reduce(DataFrame.unionByName, heard).join(merged(slots_.select("run_id", "slot_id", "kind", "normalized")), ["run_id", "kind"])
    same, long = F.col("token") == F.col("normalized"), F.char_length("token") == F.char_length("normalized")
    near = near.where(same | (long & ~((F.col("kind") == "kana") & F.contains("normalized", "token"))))
    like = F.when(same, F.lit(1.0)).otherwise(sequence_ratio("token", "normalized"))
    near = near.withColumn("_like", like).where(F.col("_like") >= F.when(F.col("kind") == "digits", LIKE_DIGITS).otherwise(LIKE_KANA))
    # where the operator's own text has the number, another one may be misheard
    texts = ours.select("run_id", "seq", spoken_value(F.coalesce("text", F.lit(""))).alias("_text"))
    near = near.join(merged(texts), ["run_id", "seq"]).where(same | (F.col("kind") != "digits") | ~F.contains("_text", "normalized"))
    return near.select("run_id", "slot_id", "seq", "token", same.alias("correct"))


def argument_evidence(slots_: DataFrame, args: DataFrame, turns: DataFrame) -> DataFrame:
    """Tool arguments that stand for a slot: run_id, slot_id, correct. A wrong one counts if it was not
    copied from a result and the customer never said it. args: run_id, name, value, source_kind."""
    given = args.select("run_id", "name", "source_kind", spoken_value(F.col("value")).alias("_given"), F.col("value").alias("_raw"))
    names, slot = F.col("argument_names"), F.col("slot_id")
    by_kind = F.when(F.col("kind") == "kana", F.contains("name", F.lit("kana"))).when(F.contains(slot, F.lit("phone")), F.contains("name", F.lit("phone"))).otherwise(F.lit(False))
    stands = (F.col("name") == slot) | F.when(names.isNotNull(), F.array_contains(names, F.col("name"))).otherwise(by_kind)
    hit = slots_.join(merged(given), "run_id").where(stands & same_shape(F.col("_raw"), F.col("value"), F.col("kind")))
    hit = hit.withColumn("correct", F.col("_given") == F.col("normalized")).where(F.col("correct") | F.col("source_kind").isin("customer_utterance", "unknown"))
    wrong = hit.where(~F.col("correct")).join(merged(_customer_texts(turns).select(F.col("run_id").alias("_run"), "_said")), (F.col("run_id") == F.col("_run")) & F.contains("_said", "_given"), "left_anti")
    return hit.where("correct").select("run_id", "slot_id", "correct").unionByName(wrong.select("run_id", "slot_id", "correct"))


def retention_units(slots_: DataFrame, args: DataFrame, turns: DataFrame, heard: DataFrame | None = None) -> DataFrame:
    """M20, a unit per slot: passed if there's evidence and all of it is right. Free text that isn't
    ASCII, and values that no gold argument carries and nobody reads back, are left out. heard:
    transcript_evidence, if it's there already."""
    heard = transcript_evidence(slots_, turns) if heard is None else heard
    found = argument_evidence(slots_, args, turns).unionByName(heard.select("run_id", "slot_id", "correct"))
    per = found.groupBy("run_id", "slot_id").agg(F.bool_and("correct").alias("_ok"), F.count("*").alias("evidence"))
    u = slots_.join(merged(per), ["run_id", "slot_id"], "left").where(~((F.col("kind") == "text") & ~F.col("normalized").rlike(r"^\p{ASCII}*$")))
    u = u.where(F.col("evidence").isNotNull() | F.col("argument_names").isNull() | (F.size("argument_names") > 0))
    return u.select("run_id", F.lit("M20").alias("metric_id"), F.col("slot_id").alias("unit_id"), F.coalesce("_ok", F.lit(False)).alias("passed"))


def read_back_units(slots_: DataFrame, turns: DataFrame, heard: DataFrame | None = None) -> DataFrame:
    """M25, a unit per customer turn with a slot's value whose answer, up to the next customer turn,
    attempts the value: passed if every attempt is right. heard as above."""
    heard = transcript_evidence(slots_, turns) if heard is None else heard
    w = Window.partitionBy("run_id").orderBy("seq")
    after = turns.where(F.col("actor").isin(*CUSTOMERS)).withColumn("_next", F.lead("seq").over(w)).select("run_id", F.col("seq").alias("said_seq"), "_next")
    said = said_slots(slots_, turns).join(merged(after), ["run_id", "said_seq"])
    tries = said.join(merged(heard), ["run_id", "slot_id"]).where((F.col("seq") > F.col("said_seq")) & (F.col("_next").isNull() | (F.col("seq") < F.col("_next"))))
    per = tries.groupBy("run_id", "slot_id", "said_seq").agg(F.bool_and("correct").alias("passed"))
    return per.select("run_id", F.lit("M25").alias("metric_id"), F.concat_ws("@", "slot_id", F.col("said_seq").cast("string")).alias("unit_id"), "passed")


def grounded_units(slots_: DataFrame, args: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M26, a unit per argument that equals a slot's value: passed if its source is known; and runs that
    can't be measured, as a call has no ledger or such an argument no entry.

    args: run_id, call_seq, name, value, ledger (whether the call has one), source_kind.
    """
    given = args.withColumn("normalized", spoken_value(F.col("value")))
    hit = given.join(merged(slots_.select("run_id", "normalized").distinct()), ["run_id", "normalized"])
    gaps = args.where(~F.coalesce("ledger", F.lit(False))).select("run_id").unionByName(hit.where(F.col("source_kind").isNull()).select("run_id")).distinct()
    name = F.concat_ws(":", F.col("call_seq").cast("string"), "name")
    return hit.select("run_id", F.lit("M26").alias("metric_id"), name.alias("unit_id"), (F.col("source_kind") != "unknown").alias("passed")), gaps


def disclosure_units(contracts: DataFrame, turns: DataFrame, called: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M22, a unit per disclosure that was due: passed if each core keyword is in all transcripts (two at
    least) of some operator turn; and runs whose disclosure has no keyword. It's due once the deadline
    tool is called. contracts: run_id, disclosure, deadline_tool; called: run_id, tool."""
    due = contracts.join(merged(called.select("run_id", F.col("tool").alias("deadline_tool"), F.lit(True).alias("_called")).distinct()), ["run_id", "deadline_tool"], "left")
    due = due.where(F.col("deadline_tool").isNull() | F.col("_called")).withColumn("_words", core_keywords(F.col("disclosure")))
    words = due.select("run_id", F.coalesce("deadline_tool", F.lit("disclosure")).alias("unit_id"), F.explode("_words").alias("_word"))
    words = words.withColumn("_word", spoken_value(F.col("_word")))
    ours = turns.where((F.col("actor") == "operator") & (F.size("transcripts") >= 2)).select("run_id", "seq", F.explode("transcripts").alias("_t")).withColumn("_t", spoken_value(F.col("_t")))
    heard = words.select("run_id", "_word").distinct().join(merged(ours), "run_id").groupBy("run_id", "_word", "seq").agg(F.bool_and(F.contains("_t", "_word")).alias("_all"))
    heard = heard.groupBy("run_id", "_word").agg(F.max("_all").alias("_in"))
    per = words.join(merged(heard), ["run_id", "_word"], "left").groupBy("run_id", "unit_id").agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("passed"))
    return per.select("run_id", F.lit("M22").alias("metric_id"), "unit_id", "passed"), due.where(F.size("_words") == 0).select("run_id")


def value_metrics(runs: DataFrame, slots_: DataFrame, turns: DataFrame, args: DataFrame, contracts: DataFrame) -> DataFrame:
    """M20, M22, M25 and M26 of every run: run_id, metric_id, status, units, passed_units. A run whose
    input is malformed isn't measurable in any of them; a metric without units doesn't apply.

    runs: run_id, malformed; the rest as above, args with tool.
    """
    # three and two metrics read these
    spoken = checkpointed(spoken_slots(slots_, turns))
    heard = checkpointed(transcript_evidence(spoken, turns))
    grounded_, gaps = grounded_units(spoken, args)
    told, wordless = disclosure_units(contracts, turns, args.select("run_id", "tool"))
    units = reduce(DataFrame.unionByName, [retention_units(spoken, args, turns, heard), told, read_back_units(spoken, turns, heard), grounded_])
    per = units.groupBy("run_id", "metric_id").agg(F.count("*").alias("units"), F.count_if("passed").alias("passed_units"))
    none = gaps.select("run_id", F.lit("M26").alias("metric_id")).unionByName(wordless.select("run_id", F.lit("M22").alias("metric_id"))).distinct().withColumn("_open", F.lit(True))
    every = runs.select("run_id", "malformed", F.explode(F.array(*[F.lit(m) for m in ("M20", "M22", "M25", "M26")])).alias("metric_id"))
    out = every.join(merged(per), ["run_id", "metric_id"], "left").join(merged(none), ["run_id", "metric_id"], "left")
    n, good = F.coalesce("units", F.lit(0)), F.coalesce("passed_units", F.lit(0))
    status = F.when(F.col("malformed") | F.col("_open"), "N/M").when(n == 0, "N/A").when(good == n, "passed").otherwise("failed")
    measured = ~status.isin("N/M")
    return out.select("run_id", "metric_id", status.alias("status"), F.when(measured, n).otherwise(0).alias("units"), F.when(measured, good).otherwise(0).alias("passed_units"))
