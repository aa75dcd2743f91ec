"""Evaluation against ground truth: replay of two detectors and matching of real alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PRODUCTION, Settings
from ..functions.ordered import exact_quantiles
from ..functions.scalars import magnitude_label, plus_seconds, seconds_between
from .alerts import consecutive_onsets
from .joins import interval_join

WINDOW_KEY = ("window_id",)


def with_window_id(injections: DataFrame) -> DataFrame:
    """Stable id of a fault window from all its columns."""
    return injections.withColumn(
        "window_id",
        F.sha2(
            F.concat_ws(
                "|", "source_file", "scenario_id", "fault_type", "target_endpoint",
                F.unix_micros("injected_at").cast("string"), F.unix_micros("cleared_at").cast("string"),
            ),
            256,
        ),
    )


def in_span(rows: DataFrame, injections: DataFrame, pad_seconds: int, time: str = "time") -> DataFrame:
    """Rows between the first fault begin and the last fault end, padded on both sides."""
    low = injections.select(plus_seconds(F.min("injected_at"), -pad_seconds)).scalar()
    high = injections.select(plus_seconds(F.max("cleared_at"), pad_seconds)).scalar()
    return rows.where(F.col(time).between(low, high))


def span_hours(injections: DataFrame, pad_seconds: int) -> Column:
    """Length of the padded evaluation span in hours, as an aggregate expression."""
    return (seconds_between(F.max("cleared_at"), F.min("injected_at")) + 2 * pad_seconds) / 3600.0


# --------------------------------------------------------------------------- replay


def replay_onsets(flags: DataFrame, settings: Settings = PRODUCTION, extra_key: Sequence[str] = ()) -> DataFrame:
    """Onsets per detector: the second consecutive firing cycle of an endpoint.

    ``flags`` has one row per (endpoint, cycle) with ``static_fire`` and ``layered_fire``.
    """
    m = settings.offline_fire_after
    key = [*extra_key, "endpoint_id"]
    marked = flags.select(
        *key, "time",
        consecutive_onsets(flags, "static_fire", m, key).alias("static"),
        consecutive_onsets(flags, "layered_fire", m, key).alias("layered"),
    ).where(F.col("static") | F.col("layered"))
    return (
        marked.unpivot([*key, "time"], ["static", "layered"], "detector", "_on")
        .where("_on")
        .select(*key, "detector", F.col("time").alias("onset"))
    )


def detections(
    onsets: DataFrame, injections: DataFrame, settings: Settings = PRODUCTION,
    bucket_seconds: int = 3600, extra_key: Sequence[str] = (), variants: dict[str, list] | None = None,
) -> DataFrame:
    """One row per fault window (and variant): delay of the first onset of each detector, or null.

    An onset may serve several windows.  ``variants`` lists the values of each ``extra_key``, so
    that windows without any onset are kept for each of them.
    """
    windows = with_window_id(injections).withColumn("magnitude_label", magnitude_label("source_file"))
    reach = windows.select(
        "window_id", F.col("target_endpoint").alias("endpoint_id"), "injected_at",
        plus_seconds("cleared_at", settings.grace_seconds).alias("_to"),
    )
    hits = interval_join(
        onsets, reach, "onset", "injected_at", "_to", ["endpoint_id"], "inner", bucket_seconds
    ).withColumn("_delay", seconds_between("onset", "injected_at"))
    first = hits.groupBy(*extra_key, "window_id").agg(
        F.min(F.when(F.col("detector") == "static", F.col("_delay"))).alias("delay_static"),
        F.min(F.when(F.col("detector") == "layered", F.col("_delay"))).alias("delay_layered"),
    )
    base = windows.select(
        "window_id", "scenario_id", "fault_type", "target_endpoint", "source_file",
        "magnitude_label", "injected_at", "cleared_at",
    )
    for name, values in (variants or {}).items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return base.join(first, [*extra_key, "window_id"], "left")


def onsets_outside(
    onsets: DataFrame, injections: DataFrame, settings: Settings = PRODUCTION, bucket_seconds: int = 3600
) -> DataFrame:
    """Onsets while no fault of any endpoint is active: the false positives."""
    active = injections.select(
        F.col("injected_at").alias("_from"), plus_seconds("cleared_at", settings.grace_seconds).alias("_to")
    )
    return interval_join(onsets, active, "onset", "_from", "_to", (), "left_anti", bucket_seconds)


def _rate(delay: str) -> Column:
    return F.count(delay) / F.nullif(F.count(F.lit(1)), F.lit(0))


def detection_stats(found: DataFrame) -> DataFrame:
    """Counts, rates and median delays by fault type, by (fault type, magnitude) and overall.

    One pass with grouping sets; a row counts one fault window, so the groups stay small next to
    the telemetry and the exact native median is used.
    """
    rows = found.select("fault_type", "magnitude_label", "delay_static", "delay_layered")
    g = rows.groupingSets(
        [["fault_type"], ["fault_type", "magnitude_label"], []], "fault_type", "magnitude_label"
    ).agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("n"),
        F.count("delay_static").alias("tp_static"),
        F.count("delay_layered").alias("tp_layered"),
        _rate("delay_static").alias("dr_static"),
        _rate("delay_layered").alias("dr_layered"),
        F.median("delay_static").alias("delay_static_s"),
        F.median("delay_layered").alias("delay_layered_s"),
    )
    level = F.when(F.col("_gid") == 3, "overall").when(F.col("_gid") == 1, "type").otherwise("magnitude")
    return g.select(
        level.alias("level"),
        F.coalesce("fault_type", F.lit("OVERALL")).alias("fault_type"),
        F.coalesce("magnitude_label", F.lit("all")).alias("magnitude"),
        "n", "tp_static", (F.col("n") - F.col("tp_static")).alias("fn_static"),
        "tp_layered", (F.col("n") - F.col("tp_layered")).alias("fn_layered"),
        "dr_static", "dr_layered", "delay_static_s", "delay_layered_s",
    )


def lead_time(found: DataFrame) -> DataFrame:
    """Median head start of the layered detector over the static one, windows seen by both."""
    both = found.where(F.col("delay_static").isNotNull() & F.col("delay_layered").isNotNull())
    return both.agg(
        F.median(F.col("delay_static") - F.col("delay_layered")).alias("lead_time_s"),
        F.count(F.lit(1)).alias("n"),
    )


def false_positives(
    onsets: DataFrame, injections: DataFrame, settings: Settings = PRODUCTION, bucket_seconds: int = 3600
) -> DataFrame:
    """One row: false positives of each detector, and per hour of the evaluated span."""
    outside = onsets_outside(onsets, injections, settings, bucket_seconds).agg(
        F.count_if(F.col("detector") == "static").alias("fp_static"),
        F.count_if(F.col("detector") == "layered").alias("fp_layered"),
    )
    hours = injections.select(span_hours(injections, settings.pad_seconds)).scalar()
    return outside.withColumn("span_hours", hours).select(
        "fp_static", "fp_layered",
        (F.col("fp_static") / F.nullif(F.col("span_hours"), F.lit(0.0))).alias("fp_per_hour_static"),
        (F.col("fp_layered") / F.nullif(F.col("span_hours"), F.lit(0.0))).alias("fp_per_hour_layered"),
        "span_hours",
    )


def eval_runs(
    found: DataFrame, fp: DataFrame, run_id: str, input_set: str
) -> DataFrame:
    """Rows of one evaluation run: per type, per type and known magnitude, and OVERALL."""
    stats = detection_stats(found).where(
        (F.col("level") != "magnitude") | (F.col("magnitude") != "all")
    )
    only = F.col("level") == "overall"
    names = ["fp_static", "fp_layered", "fp_per_hour_static", "fp_per_hour_layered"]
    out = stats
    for n in names:
        out = out.withColumn(n, F.when(only, fp.select(n).scalar()))
    return out.withColumn("span_hours", fp.select("span_hours").scalar()).select(
        F.lit(run_id).alias("run_id"), F.lit(input_set).alias("input_set"),
        "fault_type", "magnitude", "n", "dr_static", "dr_layered",
        "delay_static_s", "delay_layered_s", *names, "span_hours",
    )


# --------------------------------------------------------------------------- real alerts


def match_alerts(
    alerts: DataFrame, injections: DataFrame, settings: Settings = PRODUCTION, bucket_seconds: int = 3600
) -> DataFrame:
    """Alert and window pairs; each alert belongs to the earliest window that contains it.

    This is what a greedy pass over windows in time order gives, as a plain minimum per alert.
    """
    reach = with_window_id(injections).select(
        "window_id", F.col("target_endpoint").alias("endpoint_id"), "injected_at",
        plus_seconds("cleared_at", settings.grace_seconds).alias("_to"),
    )
    pairs = interval_join(
        alerts.select("alert_id", "endpoint_id", "opened_at"), reach,
        "opened_at", "injected_at", "_to", ["endpoint_id"], "inner", bucket_seconds,
    )
    first = F.min_by("window_id", F.struct("injected_at", "window_id"))
    return pairs.groupBy("alert_id", "opened_at").agg(first.alias("window_id"))


def window_results(
    alerts: DataFrame, injections: DataFrame, settings: Settings = PRODUCTION,
    by_scenario: bool = True, bucket_seconds: int = 3600,
) -> DataFrame:
    """One row per fault window: first alert, delay and whether the attribution is right.

    The attribution counts only for bad deployments; ``by_scenario`` recognises them by scenario
    or fault type, otherwise by fault type alone.
    """
    windows = with_window_id(injections)
    matched = match_alerts(alerts, injections, settings, bucket_seconds)
    known = matched.join(alerts.select("alert_id", "suspected_fault"), "alert_id")
    first = known.groupBy("window_id").agg(
        F.min("opened_at").alias("first_opened_at"),
        F.min_by(
            F.struct("alert_id", "suspected_fault"), F.struct("opened_at", "alert_id")
        ).alias("_first"),
    )
    is_deploy = F.col("fault_type") == "bad_deploy"
    if by_scenario:
        is_deploy = is_deploy | (F.col("scenario_id") == "bad_deploy")
    expected = F.concat_ws(":", "scenario_id", "fault_type", "target_endpoint")
    out = windows.join(first, "window_id", "left")
    hit = F.col("first_opened_at").isNotNull()
    return out.select(
        "window_id", "scenario_id", "fault_type", "target_endpoint", "source_file",
        "injected_at", "cleared_at",
        F.col("_first.alert_id").alias("alert_id"),
        hit.alias("detected"),
        seconds_between("first_opened_at", "injected_at").alias("delay_seconds"),
        F.when(
            hit & is_deploy, F.coalesce(F.col("_first.suspected_fault") == expected, F.lit(False))
        ).alias("attribution_correct"),
    )


def unmatched_alerts(
    alerts: DataFrame, injections: DataFrame, settings: Settings = PRODUCTION, bucket_seconds: int = 3600
) -> DataFrame:
    matched = match_alerts(alerts, injections, settings, bucket_seconds)
    return alerts.join(matched.select("alert_id"), "alert_id", "left_anti")


def drop_siblings(
    unmatched: DataFrame, injections: DataFrame, settings: Settings = PRODUCTION
) -> DataFrame:
    """Unmatched alerts that are not reliably explained by a known fault.

    With a threshold of 0 any known fault explains an alert.
    """
    faults = injections.select(
        F.concat_ws(":", "scenario_id", "fault_type", "target_endpoint").alias("_fault")
    ).distinct()
    reliable = (
        F.lit(True)
        if settings.sibling_score == 0.0
        else F.coalesce(F.col("imputation_score") >= settings.sibling_score, F.lit(False))
    )
    return unmatched.join(
        faults, (F.col("suspected_fault") == F.col("_fault")) & reliable, "left_anti"
    )


def scenario_report(
    alerts: DataFrame, injections: DataFrame, settings: Settings = PRODUCTION, bucket_seconds: int = 3600,
) -> DataFrame:
    """Per ground-truth file: hits, misses, false positives in its own span, hours, delays.

    Every file is judged on the alerts of its own padded span, against its own windows.
    """
    margin = settings.evaluation_margin_seconds
    files = injections.groupBy("source_file").agg(
        plus_seconds(F.min("injected_at"), -margin).alias("_since"),
        plus_seconds(F.max("cleared_at"), settings.grace_seconds + margin).alias("_until"),
    )
    spanned = interval_join(
        alerts.where(F.col("opened_at").isNotNull()), files, "opened_at", "_since", "_until",
        (), "inner", bucket_seconds,
    ).drop("_since", "_until")
    # the file becomes part of the identity of an alert
    per_file = spanned.withColumn("_alert", F.col("alert_id")).withColumn(
        "alert_id", F.concat_ws("|", "alert_id", "source_file")
    )
    reach = with_window_id(injections).select(
        "window_id", "source_file", F.col("target_endpoint").alias("endpoint_id"), "injected_at",
        "scenario_id", "fault_type", plus_seconds("cleared_at", settings.grace_seconds).alias("_to"),
    )
    pairs = interval_join(
        per_file.select("alert_id", "endpoint_id", "source_file", "opened_at", "suspected_fault"),
        reach, "opened_at", "injected_at", "_to", ["endpoint_id", "source_file"], "inner", bucket_seconds,
    )
    taken = pairs.groupBy("alert_id", "opened_at", "suspected_fault").agg(
        F.min_by("window_id", F.struct("injected_at", "window_id")).alias("window_id")
    )
    first = taken.groupBy("window_id").agg(
        F.min("opened_at").alias("_first_at"),
        F.min_by("suspected_fault", F.struct("opened_at", "alert_id")).alias("_fault"),
    )
    is_deploy = (F.col("fault_type") == "bad_deploy") | (F.col("scenario_id") == "bad_deploy")
    expected = F.concat_ws(":", "scenario_id", "fault_type", "target_endpoint")
    win = with_window_id(injections).join(first, "window_id", "left")
    hits = win.groupBy("source_file").agg(
        F.count("_first_at").alias("tp"),
        (F.count(F.lit(1)) - F.count("_first_at")).alias("fn"),
        F.median(seconds_between("_first_at", "injected_at")).alias("median_delay_seconds"),
        F.count_if(is_deploy & F.col("_first_at").isNotNull()).alias("attribution_total"),
        F.count_if(
            is_deploy & F.col("_first_at").isNotNull() & (F.col("_fault") == expected)
        ).alias("attribution_correct"),
    )
    known = injections.select(
        "source_file", F.concat_ws(":", "scenario_id", "fault_type", "target_endpoint").alias("suspected_fault")
    ).distinct().withColumn("_known", F.lit(True))
    rest = per_file.join(taken.select("alert_id"), "alert_id", "left_anti").join(
        known, ["source_file", "suspected_fault"], "left"
    )
    reliable = (
        F.lit(True)
        if settings.sibling_score == 0.0
        else F.coalesce(F.col("imputation_score") >= settings.sibling_score, F.lit(False))
    )
    fp = rest.where(~(F.coalesce("_known", F.lit(False)) & reliable)).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("fp")
    )
    return (
        files.join(hits, "source_file")
        .join(fp, "source_file", "left")
        .select(
            "source_file", "tp", F.coalesce("fp", F.lit(0)).alias("fp"), "fn",
            (seconds_between("_until", "_since") / 3600.0).alias("duration_hours"),
            "median_delay_seconds", "attribution_correct", "attribution_total",
        )
    )


def summary_metrics(results: DataFrame, fp_count: Column, hours: Column) -> DataFrame:
    """Overall precision, recall, F1, false positives per hour, median delay, attribution."""
    g = results.agg(
        F.count_if("detected").alias("tp"),
        F.count_if(~F.col("detected")).alias("fn"),
        F.median("delay_seconds").alias("median_detection_delay_seconds"),
        F.count_if("attribution_correct").alias("_right"),
        F.count("attribution_correct").alias("attribution_sample_size"),
    ).withColumn("fp", fp_count).withColumn("_hours", hours)
    return with_ratios(g).select(
        "tp", "fp", "fn", "precision", "recall", "f1",
        (F.col("fp") / F.nullif(F.col("_hours"), F.lit(0.0))).alias("false_positives_per_hour"),
        "median_detection_delay_seconds",
        (F.col("_right") / F.nullif(F.col("attribution_sample_size"), F.lit(0))).alias("attribution_accuracy"),
        "attribution_sample_size",
    )


def with_ratios(counts: DataFrame, zero_f1: bool = False) -> DataFrame:
    """Add precision, recall and F1 from tp, fp and fn.

    Missing ratios are null; F1 is null when a ratio is missing or zero.  ``zero_f1`` writes 0.0
    for all of these instead.
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = tp / F.nullif(tp + fp, F.lit(0))
    r = tp / F.nullif(tp + fn, F.lit(0))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(
        (F.col("precision") > 0) & (F.col("recall") > 0),
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
    )
    out = out.withColumn("f1", f1)
    return out.fillna(0.0, ["precision", "recall", "f1"]) if zero_f1 else out


def overall_report(
    alerts: DataFrame, injections: DataFrame, settings: Settings = PRODUCTION, bucket_seconds: int = 3600
) -> DataFrame:
    """Totals over all files: counts from the per-file reports, median over all delays."""
    per_file = scenario_report(alerts, injections, settings, bucket_seconds)
    t = per_file.agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.sum("duration_hours").alias("hours"),
        F.sum("attribution_correct").alias("right"), F.sum("attribution_total").alias("asked"),
    )
    median = window_results(alerts, injections, settings, True, bucket_seconds).select(
        F.median("delay_seconds")
    ).scalar()
    return with_ratios(t).select(
        "tp", "fp", "fn", "precision", "recall", "f1",
        (F.col("fp") / F.nullif(F.col("hours"), F.lit(0.0))).alias("false_positives_per_hour"),
        median.alias("median_detection_delay_seconds"),
        (F.col("right") / F.nullif(F.col("asked"), F.lit(0))).alias("attribution_accuracy"),
        F.col("asked").alias("attribution_sample_size"),
    )


# --------------------------------------------------------------------------- campaigns


def campaign_summary(runs: DataFrame, min_core_seconds: int) -> DataFrame:
    """One row per (scenario, tier): the newest run with its effective duration and metrics."""
    effective = F.when(
        F.col("tier") == "core", F.greatest(F.col("duration_yaml_s"), F.lit(min_core_seconds))
    ).otherwise(F.col("duration_yaml_s"))
    rest = [c for c in runs.columns if c not in ("scenario", "tier")]
    newest = runs.groupBy("scenario", "tier").agg(F.max_by(F.struct(*rest), "started_at").alias("_r"))
    return newest.select("scenario", "tier", "_r.*").withColumn("duration_effective_s", effective)


def campaign_completeness(summary: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Expected runs (two tiers per scenario) against successful ones."""
    expected = scenarios.select("scenario").distinct().select(
        "scenario", F.explode(F.array(F.lit("core"), F.lit("stress"))).alias("tier")
    )
    done = summary.where(F.col("status").isin("ok", "ok_no_metrics")).select(
        "scenario", "tier", F.lit(1).alias("_ok")
    ).distinct()
    g = expected.join(done, ["scenario", "tier"], "left").agg(
        F.count(F.lit(1)).alias("expected_runs"), F.count("_ok").alias("ok_runs")
    )
    return g.withColumn("complete", F.col("expected_runs") == F.col("ok_runs"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Row of largest F1; the smallest threshold wins ties."""
    best = F.max_by(F.struct(*sweep.columns), F.struct("f1", (-F.col("threshold")).alias("t")))
    return sweep.agg(best.alias("_b")).select("_b.*")


def latest_run(runs: DataFrame) -> DataFrame:
    """Rows of the newest run, OVERALL last."""
    newest = runs.select(F.max_by("run_id", "run_at")).scalar()
    return runs.where(F.col("run_id") == newest).orderBy(
        F.col("fault_type") == "OVERALL", "fault_type", "magnitude"
    )


def median_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {"median": 0.5})
