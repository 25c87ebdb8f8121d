"""Audio: decoding, signal features and thresholds, response latency, segment evidence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt

FEATURES = "path string, error string, rate int, channels int, bits int, frames bigint, file_sha256 string, payload_sha256 string, rms_dbfs double, peak_dbfs double, clip_ratio double, flat_top_ms double, dc_dbfs double, rolloff_hz double, dropout_ms double, snr_db double"
#: What silence counts as, in decibels, and amplitudes that count as silence: fixed values.
FLOOR_DB = -300.0
NEAR_ZERO = 0.00001


def db(amplitude: float) -> float:
    return 20.0 * float(np.log10(amplitude)) if amplitude > 0 else FLOOR_DB


def longest_run(mask: np.ndarray) -> int:
    """Length of the longest run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def decode(data: bytes) -> tuple[int, int, int, bytes, np.ndarray, bool]:
    """(rate, channels, bits, payload, samples as [frames, channels] in -1..1, whether they are
    integers) of a RIFF WAVE file with integer (8, 16, 24, 32 bit) or float (32, 64 bit) samples; ValueError if it is malformed."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, form, payload = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("truncated chunk")
        if name == b"fmt ":
            form = body
        elif name == b"data":
            payload = body
        at += 8 + size + (size & 1)
    if form is None or payload is None or len(form) < 16:
        raise ValueError("fmt or data chunk missing")
    tag, channels, rate, bits = (int.from_bytes(form[i:j], "little") for i, j in ((0, 2), (2, 4), (4, 8), (14, 16)))
    if tag == 0xFFFE and len(form) >= 26:
        tag = int.from_bytes(form[24:26], "little")
    if not channels or not rate or not bits or len(payload) % (channels * bits // 8):
        raise ValueError("frame size doesn't divide the payload")
    if tag == 3 and bits in (32, 64):
        samples = np.frombuffer(payload, dtype=f"<f{bits // 8}").astype(np.float64)
    elif tag == 1 and bits == 8:
        samples = (np.frombuffer(payload, dtype=np.uint8).astype(np.float64) - 128) / 128
    elif tag == 1 and bits == 24:
        raw = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        samples = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) ^ 0x800000) - 0x800000
        samples = samples.astype(np.float64) / (1 << 23)
    elif tag == 1 and bits in (16, 32):
        samples = np.frombuffer(payload, dtype=f"<i{bits // 8}").astype(np.float64) / (1 << (bits - 1))
    else:
        raise ValueError(f"format {tag} with {bits} bits")
    return rate, channels, bits, payload, samples.reshape(-1, channels), tag == 1


def rolloff(samples: np.ndarray, rate: int, share: float = 0.95) -> float:
    """The frequency under which a share of the power lies, through a Hann window; 0 for silence."""
    total = np.cumsum(np.abs(np.fft.rfft(samples * np.hanning(len(samples)))) ** 2)
    if not len(total) or total[-1] <= 0:
        return 0.0
    return float(min(np.searchsorted(total, share * total[-1]), len(total) - 1) * rate / len(samples))


def _cut(samples: np.ndarray, ranges) -> np.ndarray:
    return np.concatenate([samples[int(r["start"]) : int(r["end"])] for r in ranges])


def signal(samples: np.ndarray, rate: int, clip: float = 1.0, speech=None, noise=None, near_zero: float = NEAR_ZERO) -> dict:
    """Features of one channel's samples; dropouts are looked for in the speech ranges, and the ratio of
    speech to noise needs both (else null)."""
    level = np.abs(samples)
    clipped = level >= clip
    flat = longest_run(clipped[1:] & (samples[1:] == samples[:-1])) + 1 if clipped.any() else 0
    ms = 1000.0 / rate
    out = {
        "rms_dbfs": db(float(np.sqrt(np.mean(samples**2)))),
        "peak_dbfs": db(float(level.max())),
        "clip_ratio": float(clipped.mean()),
        "flat_top_ms": flat * ms,
        "dc_dbfs": db(abs(float(samples.mean()))),
        "rolloff_hz": rolloff(samples, rate),
        "dropout_ms": None,
        "snr_db": None,
    }
    if speech is not None and len(speech):
        heard = _cut(samples, speech)
        out["dropout_ms"] = longest_run(np.abs(heard) <= near_zero) * ms
        if noise is not None and len(noise):
            loud, quiet = (float(np.sqrt(np.mean(x**2))) for x in (heard, _cut(samples, noise)))
            out["snr_db"] = float("inf") if quiet == 0 else 20.0 * float(np.log10(loud / quiet)) if loud else FLOOR_DB
    return out


def wav_features(files: DataFrame) -> DataFrame:
    """Features of files read as binaryFile (path, content); malformed ones keep a reason in error.
    Optional columns speech_ranges and noise_ranges (arrays of start and end in samples) say where
    speech and noise are. Integer samples clip one step under full scale."""
    ranges = [c for c in ("speech_ranges", "noise_ranges") if c in files.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at in range(len(pdf)):
                row = dict.fromkeys([c.split()[0] for c in FEATURES.split(", ")])
                row["path"], content = pdf["path"].iat[at], bytes(pdf["content"].iat[at])
                row["file_sha256"] = hashlib.sha256(content).hexdigest()
                try:
                    rate, channels, bits, payload, samples, whole = decode(content)
                    if not len(samples):
                        raise ValueError("no samples")
                    given = {c.split("_")[0]: pdf[c].iat[at] for c in ranges}
                    clip = 1.0 - 2.0 ** (1 - bits) if whole else 1.0
                    row |= {"rate": rate, "channels": channels, "bits": bits, "frames": len(samples), "payload_sha256": hashlib.sha256(payload).hexdigest(), **signal(samples.mean(axis=1), rate, clip, **given)}
                except ValueError as e:
                    row["error"] = str(e)
                rows.append(row)
            out = pd.DataFrame(rows)
            for c in ("rate", "channels", "bits", "frames"):
                out[c] = out[c].astype("Int64")
            yield out

    return files.select("path", "content", *ranges).mapInPandas(run, FEATURES)


def undeclared_facts(features: DataFrame, declared: DataFrame) -> DataFrame:
    """Facts that a manifest declares and the decoded file doesn't have: (path, rule, detail).

    declared: path, sha256, rate, channels, bits, frames (null: not declared).
    """
    pairs = [("sha256", "file_sha256"), ("rate", "rate"), ("channels", "channels"), ("bits", "bits"), ("frames", "frames")]
    d = declared.select("path", *[F.col(a).cast("string").alias(f"_d_{a}") for a, _ in pairs])
    f = features.select("path", F.lit(True).alias("_has"), "error", *[F.col(b).cast("string").alias(f"_f_{a}") for a, b in pairs])
    both = d.join(f, "path", "left")
    differs = lambda a: F.when(F.col(f"_d_{a}").isNotNull() & ~F.col(f"_d_{a}").eqNullSafe(F.col(f"_f_{a}")), F.struct(F.lit(f"{a}_differs").alias("rule"), F.concat_ws(" ", F.col(f"_d_{a}"), F.lit("declared,"), F.coalesce(f"_f_{a}", F.lit("none")), F.lit("decoded")).alias("detail")))
    broken = F.when(F.col("_has").isNull(), F.array(F.struct(F.lit("file_missing").alias("rule"), F.lit("").alias("detail"))))
    broken = broken.when(F.col("error").isNotNull(), F.array(F.struct(F.lit("malformed").alias("rule"), F.col("error").alias("detail"))))
    found = F.filter(F.array(*[differs(a) for a, _ in pairs]), lambda x: x.isNotNull())
    return both.select("path", F.explode(broken.otherwise(found)).alias("v")).select("path", "v.*")


def against(value: Column, bound: Column, uncertainty: Column, least: Column | None = None) -> Column:
    """'passed', 'failed', or 'N/M' where the uncertainty interval, cut at 0, straddles the bound: a maximum,
    or, where least holds, a minimum."""
    low, high = F.greatest(F.lit(0.0), value - uncertainty), value + uncertainty
    most = F.when(high <= bound, "passed").when(low > bound, "failed").otherwise("N/M")
    if least is None:
        return most
    return F.when(least, F.when(low >= bound, "passed").when(high < bound, "failed").otherwise("N/M")).otherwise(most)


#: Kinds of a turn's latency with the name of their bound, the kind that is held to a minimum, and why a
#: probe has its status: fixed values.
LATENCY_BOUNDS = {"stop": "stop_latency_max_ms", "response": "response_latency_max_ms", "resume": "resume_latency_max_ms", "pause_hold": "pause_hold_min_ms"}
HELD = "pause_hold"
REASONS = {
    "absent": "probe_opportunity_not_present",
    "unselected": "M21_threshold_profile_unselected",
    "mismatch": "turn_control_classification_mismatch",
    "matches": "turn_control_classification_matches",
    "clock": "clock_uncertainty_exceeds_policy",
    "crosses": "clock_uncertainty_crosses_latency_threshold",
    "within": "latency_interval_within_maximum",
    "exceeds": "latency_interval_exceeds_maximum",
    "meets": "hold_interval_meets_minimum",
    "below": "hold_interval_below_minimum",
}


def _met(probes: DataFrame, events: DataFrame, clocks: DataFrame) -> DataFrame:
    """Probes with the events that they name (_seen, _start, _end: ns; _seen_control), their run's
    uncertainty_ns and _twice: what left joins give, but all is dealt by run once."""
    refs = {"_seen": "observed_control_event_id", "_start": "start_event_id", "_end": "end_event_id"}
    given = ["probe_id", "applicable", "expected_control", "latency_kind"]
    kind = lambda name: F.lit(name).alias("_row")
    own = probes.select(kind("probe"), "run_id", *given, *refs.values())
    seen = events.select(kind("event"), "run_id", "event_id", F.struct("ns", "control").alias("_e"))
    clock = clocks.select(kind("clock"), "run_id", F.struct("uncertainty_ns").alias("_c"))
    rows = dealt(own.unionByName(seen, True).unionByName(clock, True), "run_id")
    run, probe = Window.partitionBy("run_id"), Window.partitionBy("run_id", "probe_id", "_row")
    known, is_probe = F.col("run_id").isNotNull(), F.col("_row") == "probe"
    rows = rows.withColumn("_nth", F.row_number().over(probe.orderBy(*refs.values())))
    rows = rows.withColumn("_twice", known & F.col("probe_id").isNotNull() & (F.count("*").over(probe) > 1))
    rows = rows.withColumn("_clocks", F.when(known, F.collect_list("_c").over(run))).where("_row != 'clock'").drop("_c")
    # a row a reference, beside the events themselves
    entry = lambda name, i: F.struct(name.cast("string").alias("name"), F.col(i).alias("id"))
    named = F.array(*[entry(F.lit(name), ref) for name, ref in refs.items()])
    rows = rows.select("*", F.inline(F.when(is_probe, named).otherwise(F.array(entry(F.lit(None), "event_id"))))).drop("event_id", *refs.values())
    found = F.when(known & F.col("id").isNotNull(), F.collect_list("_e").over(Window.partitionBy("run_id", "id")))
    rows = rows.withColumn("_found", found).where(is_probe)
    same = [F.first(c).alias(c) for c in (*given[1:], "_twice", "_clocks")]
    rows = rows.groupBy("run_id", "probe_id", "_nth").agg(*same, *[F.first(F.when(F.col("name") == name, F.col("_found")), True).alias(name) for name in refs])
    # several events of one id, or clocks of one run, give several rows
    for name in refs:
        rows = rows.withColumn(name, F.explode_outer(name))
    rows = rows.withColumn("_c", F.explode_outer("_clocks"))
    return rows.select("run_id", *given, "_twice", "_c.uncertainty_ns", F.col("_seen.control").alias("_seen_control"), *[F.col(f"{name}.ns").alias(name) for name in refs])


def turn_probes(probes: DataFrame, events: DataFrame, clocks: DataFrame, policy: dict[str, float] | None) -> DataFrame:
    """run_id, probe_id, status, reason, latency_ms, threshold_ms: whether a turn was controlled as expected,
    and in time.

    probes: run_id, probe_id, applicable, expected_control, observed_control_event_id, latency_kind,
    start_event_id, end_event_id; events: run_id, event_id, ns, control; clocks: run_id, uncertainty_ns;
    policy: the bounds by name, and clock_uncertainty_max_ms; None where no profile is selected. A probe that
    contradicts itself is contract_invalid, with what is wrong: its id occurs twice, an event isn't there, the
    control is empty, the kind is unknown, its bound is missing or negative, or it ends before it starts.
    """
    bounds = policy or {}
    p = _met(probes, events, clocks)
    kind = F.col("latency_kind")
    bound = F.lit(None).cast("double")
    for k, name in LATENCY_BOUNDS.items():
        bound = F.when(kind == k, F.lit(bounds.get(name)).cast("double")).otherwise(bound)
    p = p.withColumns({"threshold_ms": bound, "latency_ms": (F.col("_end") - F.col("_start")) / F.lit(1e6), "_u": F.col("uncertainty_ns") / F.lit(1e6)})
    same = F.col("_seen_control") == F.col("expected_control")
    timed = kind.isNotNull()
    wrong = (
        F.when(F.col("_twice"), "duplicate probe_id")
        .when(~F.col("applicable") | F.lit(policy is None), None)
        .when(F.col("_seen").isNull(), "observed control event missing")
        .when(F.col("_seen_control").isNull(), "observed control empty")
        .when(F.coalesce(F.col("expected_control"), F.lit("")) == "", "expected control empty")
        .when(~same | ~timed, None)
        .when(~kind.isin(*LATENCY_BOUNDS), "latency kind unknown")
        .when(F.col("threshold_ms").isNull() | (F.col("threshold_ms") < 0), "threshold missing or negative")
        .when(F.col("_start").isNull() | F.col("_end").isNull(), "start or end event missing")
        .when(F.col("latency_ms") < 0, "latency negative")
        .when(F.col("_u").isNull(), "clock missing")
    )
    held = kind == HELD
    interval = against(F.col("latency_ms"), F.col("threshold_ms"), F.col("_u"), held)
    pick = lambda least, most: F.when(held, REASONS[least]).otherwise(REASONS[most])
    told = F.when(interval == "passed", pick("meets", "within")).when(interval == "failed", pick("below", "exceeds")).otherwise(REASONS["crosses"])
    most = F.lit(bounds.get("clock_uncertainty_max_ms")).cast("double")
    vague = F.coalesce(F.col("_u") > most, F.lit(False))

    def chosen(rows: list[tuple[Column, Column]], last: Column) -> Column:
        out = last
        for when, then in reversed(rows):
            out = F.when(when, then).otherwise(out)
        return out

    cases = [(F.col("_wrong").isNotNull(), "contract_invalid", F.col("_wrong")), (~F.col("applicable"), "N/A", F.lit(REASONS["absent"])), (F.lit(policy is None), "N/M", F.lit(REASONS["unselected"])), (~same, "failed", F.lit(REASONS["mismatch"])), (~timed, "passed", F.lit(REASONS["matches"])), (vague, "N/M", F.lit(REASONS["clock"]))]
    p = p.withColumn("_wrong", wrong)
    status, reason = chosen([(w, F.lit(s)) for w, s, _ in cases], interval), chosen([(w, r) for w, _, r in cases], told)
    measured = F.col("_wrong").isNull() & F.col("applicable") & F.lit(policy is not None) & same & timed & ~vague
    return p.select("run_id", "probe_id", status.alias("status"), reason.alias("reason"), *[F.when(measured, F.col(c)).alias(c) for c in ("latency_ms", "threshold_ms")])


FACETS = ("decode_format", "rms_peak", "clipping", "flat_top", "dropout", "snr", "bandwidth", "dc", "continuity", "active_level")


def signal_facets(features: DataFrame, profile: dict) -> DataFrame:
    """Per file the facets of its signal, 'passed', 'failed', 'N/M' or 'N/A', as column expressions over
    the features: a new profile needs no code. Optional columns: expected_frames, continuous,
    active_level_dbov."""
    have = set(features.columns)
    none = F.lit(None)
    column = lambda c: F.col(c) if c in have else none
    frames = F.col("frames") == F.col("expected_frames") if "expected_frames" in have else F.lit(True)
    holds = {
        "decode_format": F.col("rate").isin(*profile["sample_rate_hz"]) & F.col("channels").isin(*profile["channels"]) & F.col("bits").isin(*profile["sample_width_bits"]) & frames,
        "rms_peak": F.col("rms_dbfs").between(profile["rms_dbfs_min"], profile["rms_dbfs_max"]) & (F.col("peak_dbfs") <= profile["peak_dbfs_max"]),
        "clipping": F.col("clip_ratio") <= profile["clip_ratio_max"],
        "flat_top": F.col("flat_top_ms") <= profile["flat_top_max_ms"],
        "dropout": F.col("dropout_ms") <= profile["dropout_max_ms"],
        "snr": F.col("snr_db") >= profile["snr_min_db"],
        "bandwidth": F.col("rolloff_hz").between(profile["rolloff_min_hz"], profile.get("rolloff_max_hz") or float("inf")),
        "dc": F.col("dc_dbfs") <= profile["dc_max_dbfs"],
        "continuity": column("continuous").cast("boolean"),
        "active_level": column("active_level_dbov").cast("double").between(profile["active_level_dbov_min"], profile["active_level_dbov_max"]),
    }
    aside = set(profile.get("inapplicable_facets", {}))
    status = lambda k: F.lit("N/A") if k in aside else F.when(holds[k].isNull(), "N/M").when(holds[k], "passed").otherwise("failed")
    return features.withColumns({k: F.when(F.col("error").isNull(), status(k)) for k in FACETS})


def signal_status(features: DataFrame, profile: dict) -> DataFrame:
    """The facets, which of them fail, and the file's status: a malformed file is an invalid contract;
    one failed facet fails it; a required facet that can't be measured leaves it not measurable."""
    f = signal_facets(features, profile)
    named = lambda kinds, want: F.filter(F.array(*[F.when(F.col(k) == want, F.lit(k)) for k in kinds]), lambda x: x.isNotNull())
    required = [k for k in profile.get("required_facets", FACETS) if k in FACETS]
    bad, open_ = named(FACETS, "failed"), named(required, "N/M")
    status = F.when(F.col("error").isNotNull(), "contract_invalid").when(F.size(bad) > 0, "failed").when(F.size(open_) > 0, "N/M").otherwise("passed")
    return f.withColumn("violations", bad).withColumn("status", status)


def latency_probes(events: DataFrame) -> DataFrame:
    """For each response start: the last customer receipt before it and the first playback after it.

    events: run_id, ns, kind ('customer_received', 'response_started', 'playback'), segment. Latency
    is from the receipt to the playback of the same segment.
    """
    w = Window.partitionBy("run_id").orderBy("ns")
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("run_id", "segment").orderBy("ns").rowsBetween(1, Window.unboundedFollowing)
    e = events.withColumn("received_ns", F.last(F.when(F.col("kind") == "customer_received", F.col("ns")), ignorenulls=True).over(back))
    e = e.withColumn("played_ns", F.min(F.when(F.col("kind") == "playback", F.col("ns"))).over(ahead))
    p = e.where(F.col("kind") == "response_started").select("run_id", "segment", F.col("ns").alias("started_ns"), "received_ns", "played_ns")
    return p.withColumn("latency_ms", (F.col("played_ns") - F.col("received_ns")) / F.lit(1e6))


def latency_status(probes: DataFrame, most_ms: float = 3000.0, uncertainty_ms: float = 0.0) -> DataFrame:
    return probes.withColumn("status", F.when(F.col("latency_ms").isNull(), "N/M").otherwise(against(F.col("latency_ms"), F.lit(most_ms), F.lit(uncertainty_ms))))


def metric_status(units: DataFrame) -> DataFrame:
    """Per run and metric the worst unit: failed, contract_invalid, N/M, passed; N/A without any."""
    rank = F.when(F.col("status") == "failed", 4).when(F.col("status") == "contract_invalid", 3).when(F.col("status") == "N/M", 2).when(F.col("status") == "passed", 1).otherwise(0)
    out = units.groupBy("run_id", "metric_id").agg(F.max(rank).alias("_r"), F.count_if(F.col("status") != "N/A").alias("applicable"))
    return out.withColumn("status", F.element_at(F.array(*[F.lit(x) for x in ("N/A", "passed", "N/M", "contract_invalid", "failed")]), F.col("_r") + 1)).drop("_r")


def segments_of(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct segments, and ids whose repeated entries disagree. events: run_id, segments
    (array<struct<segment_id, sha256, frames>>)."""
    s = events.select("run_id", F.explode("segments").alias("s")).select("run_id", "s.*").distinct()
    clash = s.groupBy("run_id", "segment_id").agg(F.count("*").alias("n")).where("n > 1").select("run_id", "segment_id")
    return s.join(clash, ["run_id", "segment_id"], "left_anti"), clash


def continuous(segments: DataFrame, delivered: DataFrame, dropped: DataFrame) -> DataFrame:
    """A segment is continuous when all its chunks were delivered and none was dropped.

    segments: run_id, segment_id, chunk_ids; delivered and dropped: run_id, chunk_id.
    """
    c = segments.select("run_id", "segment_id", F.explode("chunk_ids").alias("chunk_id"))
    c = c.join(delivered.select("run_id", "chunk_id", F.lit(True).alias("_in")).distinct(), ["run_id", "chunk_id"], "left")
    c = c.join(dropped.select("run_id", "chunk_id", F.lit(True).alias("_out")).distinct(), ["run_id", "chunk_id"], "left")
    ok = F.coalesce("_in", F.lit(False)) & F.col("_out").isNull()
    return c.groupBy("run_id", "segment_id").agg(F.bool_and(ok).alias("continuous"))


def measured_events(events: DataFrame, segments: DataFrame) -> DataFrame:
    """Events that belong to a known segment, or to none, numbered anew by the clock.
    events: run_id, event_id, monotonic_ns, segment_id (or null); segments: run_id, segment_id."""
    known = segments.select("run_id", "segment_id", F.lit(True).alias("_known")).distinct()
    kept = events.join(known, ["run_id", "segment_id"], "left").where(F.col("segment_id").isNull() | F.col("_known")).drop("_known")
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("monotonic_ns", "event_id")))
