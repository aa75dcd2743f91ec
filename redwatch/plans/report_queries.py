"""Queries on evaluation, the model layer, explanations and self-observability."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from ..config import MODEL_FEATURES, SUMMARY_COLUMNS
from ..functions.scalars import half_even
from ..operators import evaluation, explain, features, forest, model_ops, scoring, selfobs, supervised
from ..operators.alerts import alert_history, current_alerts
from ..sources import model_store, tables
from ..streaming import outbox
from .detection_queries import FEATURES
from .model_sql import forest_blocks, score_blocks
from .fixture import AS_OF, BUCKET, at
from .registry import query
from .sql import BLOCKS, num, stamp

# --------------------------------------------------------------------------- evaluation


def _onsets(t):
    return tables.stored(evaluation.replay_onsets(t.replayed, t.settings), "onsets")


def _found(t, onsets=None):
    return evaluation.detections(onsets or _onsets(t), t.injections, t.settings, BUCKET)


@query("replay_onsets", ("onsets",), f"SELECT endpoint_id, detector, {stamp('onset')} FROM onsets")
def replay_onsets(t):
    return _onsets(t)


@query("detections", ("found",), f"""
    SELECT scenario_id, source_file, magnitude, {num('delay_static')}, {num('delay_layered')} FROM found""")
def detections(t):
    return _found(t).select(
        "scenario_id", "source_file", F.col("magnitude_label").alias("magnitude"), "delay_static", "delay_layered"
    )


@query("match_onset_window", ("found",), f"""
    SELECT source_file, {num('delay_layered')}, delay_layered IS NOT NULL AS detected FROM found""")
def match_onset_window(t):
    return _found(t).select("source_file", "delay_layered", F.col("delay_layered").isNotNull().alias("detected"))


@query("onsets_outside", ("outside",), f"SELECT endpoint_id, detector, {stamp('onset')} FROM outside")
def onsets_outside(t):
    return evaluation.onsets_outside(_onsets(t), t.injections, t.settings, BUCKET)


FP_SQL = """
    SELECT (SELECT count(*) FROM outside WHERE detector = 'static') AS fp_static,
           (SELECT count(*) FROM outside WHERE detector = 'layered') AS fp_layered, h FROM hours"""
BLOCKS["fp"] = (("outside", "hours"), FP_SQL)


@query("false_positives", ("fp",), f"""
    SELECT fp_static, fp_layered, {num('fp_static / h', 'fp_per_hour_static')}, {num('fp_layered / h', 'fp_per_hour_layered')}, {num('h', 'span_hours')} FROM fp""")
def false_positives(t):
    return evaluation.false_positives(_onsets(t), t.injections, t.settings, BUCKET)


BLOCKS["stats"] = (("found",), """
    SELECT CASE WHEN grouping(fault_type) = 1 THEN 'overall' WHEN grouping(magnitude) = 1 THEN 'type' ELSE 'magnitude' END AS level,
           coalesce(fault_type, 'OVERALL') AS fault_type, coalesce(magnitude, 'all') AS magnitude, count(*) AS n,
           count(delay_static) AS tp_static, count(delay_layered) AS tp_layered,
           count(delay_static) / count(*) AS dr_static, count(delay_layered) / count(*) AS dr_layered,
           median(delay_static) AS delay_static_s, median(delay_layered) AS delay_layered_s
    FROM found GROUP BY GROUPING SETS ((fault_type), (fault_type, magnitude), ())""")
STATS = f"{num('dr_static')}, {num('dr_layered')}, {num('delay_static_s')}, {num('delay_layered_s')}"


@query("detection_stats", ("stats",), f"""
    SELECT level, fault_type, magnitude, n, tp_static, n - tp_static AS fn_static, tp_layered, n - tp_layered AS fn_layered, {STATS} FROM stats""")
def detection_stats(t):
    return evaluation.detection_stats(_found(t))


@query("two_detectors", ("found",), f"""
    SELECT source_file, delay_static IS NOT NULL AS by_static, delay_layered IS NOT NULL AS by_layered, {num('delay_static - delay_layered', 'head_start')} FROM found""")
def two_detectors(t):
    return _found(t).select(
        "source_file", F.col("delay_static").isNotNull().alias("by_static"),
        F.col("delay_layered").isNotNull().alias("by_layered"),
        (F.col("delay_static") - F.col("delay_layered")).alias("head_start"),
    )


@query("per_fault_table", ("stats",), f"SELECT fault_type, n, {STATS} FROM stats WHERE level = 'type'")
def per_fault_table(t):
    s = evaluation.detection_stats(_found(t)).where("level = 'type'")
    return s.select("fault_type", "n", "dr_static", "dr_layered", "delay_static_s", "delay_layered_s")


@query("sensitivity", ("stats",), f"""
    SELECT fault_type, magnitude, n, {num('dr_static')}, {num('dr_layered')} FROM stats WHERE level = 'magnitude' AND magnitude <> 'all'""")
def sensitivity(t):
    s = evaluation.detection_stats(_found(t)).where("level = 'magnitude' AND magnitude <> 'all'")
    return s.select("fault_type", "magnitude", "n", "dr_static", "dr_layered")


@query("lead_time", ("found",), f"""
    SELECT {num('median(delay_static - delay_layered)', 'lead_time_s')}, count(*) AS n FROM found WHERE delay_static IS NOT NULL AND delay_layered IS NOT NULL""")
def lead_time(t):
    return evaluation.lead_time(_found(t))


def _eval_runs(t):
    onsets = _onsets(t)
    fp = evaluation.false_positives(onsets, t.injections, t.settings, BUCKET)
    return evaluation.eval_runs(_found(t, onsets), fp, "run-1", "january")


BLOCKS["runs"] = (("stats", "fp"), f"""
    SELECT 'run-1' AS run_id, 'january' AS input_set, fault_type, magnitude, n, {STATS},
           CASE WHEN level = 'overall' THEN fp_static END AS fps, CASE WHEN level = 'overall' THEN fp_layered END AS fpl, h
    FROM stats, fp WHERE level <> 'magnitude' OR magnitude <> 'all'""")


@query("eval_runs", ("runs",), f"""
    SELECT * EXCLUDE (fps, fpl, h), {num('fps', 'fp_static')}, {num('fpl', 'fp_layered')}, {num('fps / h', 'fp_per_hour_static')}, {num('fpl / h', 'fp_per_hour_layered')}, {num('h', 'span_hours')} FROM runs""")
def eval_runs(t):
    d = lambda c: F.col(c).cast("double").alias(c)
    r = _eval_runs(t)
    return r.select(*[d(c) if c in ("fp_static", "fp_layered") else F.col(c) for c in r.columns])


@query("eval_runs_sink", ("runs",), "SELECT run_id, fault_type, magnitude, n FROM runs")
def eval_runs_sink(t):
    path = tables.fresh_path(t.spark, "eval")
    tables.write_log(_eval_runs(t), path)
    return t.spark.read.parquet(path).select("run_id", "fault_type", "magnitude", "n")


@query("latest_run", ("runs",), f"SELECT fault_type, magnitude, n, {num('dr_layered')} FROM runs")
def latest_run(t):
    now = _eval_runs(t)
    older = now.withColumn("run_id", F.lit("run-0")).withColumn("run_at", at(datetime(2024, 1, 30)))
    both = tables.stored(older.unionByName(now.withColumn("run_at", t.as_of)), "runs")
    return evaluation.latest_run(both).select("fault_type", "magnitude", "n", "dr_layered")


@query("eval_panels", ("runs",), f"SELECT fault_type, n, {num('round(dr_static * 100)', 'dr_static_pct')}, {num('round(dr_layered * 100)', 'dr_layered_pct')} FROM runs WHERE magnitude = 'all'")
def eval_panels(t):
    runs = _eval_runs(t).withColumn("run_at", t.as_of)
    return evaluation.latest_run(runs).where("magnitude = 'all'").select(
        "fault_type", "n", F.round(F.col("dr_static") * 100).alias("dr_static_pct"), F.round(F.col("dr_layered") * 100).alias("dr_layered_pct")
    )


BLOCKS["matched"] = (("attributed", "injections"), """
    SELECT a.*, i.source_file, i.scenario_id, i.fault_type, i.injected_at, i.cleared_at FROM attributed a
    JOIN injections i ON i.target_endpoint = a.endpoint_id AND a.opened_at BETWEEN i.injected_at AND i.cleared_at + INTERVAL 12 HOUR
    QUALIFY row_number() OVER (PARTITION BY a.endpoint_id, a.signal_type, a.opened_at ORDER BY i.injected_at, i.source_file) = 1""")
BLOCKS["window_results"] = (("matched", "injections"), """
    SELECT i.source_file, i.scenario_id, count(m.opened_at) > 0 AS detected, epoch(min(m.opened_at)) - epoch(i.injected_at) AS delay_seconds,
           CASE WHEN count(m.opened_at) > 0 AND (i.scenario_id = 'bad_deploy' OR i.fault_type = 'bad_deploy')
             THEN coalesce(arg_min(m.suspected_fault, m.opened_at) = i.scenario_id || ':' || i.fault_type || ':' || i.target_endpoint, false) END AS attribution_correct
    FROM injections i LEFT JOIN matched m ON m.source_file = i.source_file GROUP BY i.source_file, i.scenario_id, i.fault_type, i.target_endpoint, i.injected_at""")
BLOCKS["unmatched"] = (("attributed", "matched"), """
    SELECT * FROM attributed a WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.endpoint_id = a.endpoint_id AND m.signal_type = a.signal_type AND m.opened_at = a.opened_at)""")
BLOCKS["fp_alerts"] = (("unmatched", "injections"), """
    SELECT * FROM unmatched u WHERE NOT (coalesce(u.suspected_fault IN (SELECT scenario_id || ':' || fault_type || ':' || target_endpoint FROM injections), false)
      AND u.imputation_score >= 0.9)""")


def _alerts(t):
    return tables.stored(t.attributed, "alerts")


@query("match_alert_window", ("matched",), f"SELECT endpoint_id, signal_type, {stamp('opened_at')}, source_file FROM matched")
def match_alert_window(t):
    a = _alerts(t)
    m = evaluation.match_alerts(a, t.injections, t.settings, BUCKET).drop("opened_at")
    files = evaluation.with_window_id(t.injections).select("window_id", "source_file")
    return m.join(files, "window_id").join(a, "alert_id").select("endpoint_id", "signal_type", "opened_at", "source_file")


@query("alert_matching", ("window_results",), f"""
    SELECT source_file, scenario_id, detected, {num('delay_seconds')}, attribution_correct FROM window_results""")
def alert_matching(t):
    return evaluation.window_results(_alerts(t), t.injections, t.settings, True, BUCKET).select(
        "source_file", "scenario_id", "detected", "delay_seconds", "attribution_correct"
    )


@query("unmatched_alerts", ("unmatched",), f"SELECT endpoint_id, signal_type, {stamp('opened_at')} FROM unmatched")
def unmatched_alerts(t):
    return evaluation.unmatched_alerts(_alerts(t), t.injections, t.settings, BUCKET).select("endpoint_id", "signal_type", "opened_at")


@query("sibling_anti", ("fp_alerts",), f"SELECT endpoint_id, signal_type, {stamp('opened_at')}, suspected_fault FROM fp_alerts")
def sibling_anti(t):
    rest = evaluation.unmatched_alerts(_alerts(t), t.injections, t.settings, BUCKET)
    return evaluation.drop_siblings(rest, t.injections, t.settings).select("endpoint_id", "signal_type", "opened_at", "suspected_fault")


@query("fp_alerts", ("fp_alerts",), "SELECT signal_type, count(*) AS fp FROM fp_alerts GROUP BY signal_type")
def fp_alerts(t):
    rest = evaluation.unmatched_alerts(_alerts(t), t.injections, t.settings, BUCKET)
    return evaluation.drop_siblings(rest, t.injections, t.settings).groupBy("signal_type").agg(F.count(F.lit(1)).alias("fp"))


BLOCKS["summary"] = (("window_results", "fp_alerts", "hours"), """
    SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM (
      SELECT count(*) FILTER (detected) AS tp, count(*) FILTER (NOT detected) AS fn, (SELECT count(*) FROM fp_alerts) AS fp,
             median(delay_seconds) AS delay, count(*) FILTER (attribution_correct) AS good, count(attribution_correct) AS asked, (SELECT h FROM hours) AS h
      FROM window_results)""")


@query("summary_metrics", ("summary",), f"""
    SELECT tp, fp, fn, {num('precision')}, {num('recall')}, {num('CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) END', 'f1')},
           {num('fp / h', 'false_positives_per_hour')}, {num('delay', 'median_detection_delay_seconds')}, {num('good / nullif(asked, 0)', 'attribution_accuracy')},
           asked AS attribution_sample_size FROM summary""")
def summary_metrics(t):
    a = _alerts(t)
    r = evaluation.window_results(a, t.injections, t.settings, True, BUCKET)
    rest = evaluation.drop_siblings(evaluation.unmatched_alerts(a, t.injections, t.settings, BUCKET), t.injections, t.settings)
    hours = t.injections.select(evaluation.span_hours(t.injections, t.settings.pad_seconds)).scalar()
    return evaluation.summary_metrics(r, rest.select(F.count(F.lit(1))).scalar(), hours)


BLOCKS["file_spans"] = (("injections",), """
    SELECT source_file, min(injected_at) - INTERVAL 5 MINUTE AS since, max(cleared_at) + INTERVAL 12 HOUR + INTERVAL 5 MINUTE AS until_ FROM injections GROUP BY 1""")
BLOCKS["file_alerts"] = (("attributed", "file_spans", "injections"), """
    SELECT a.*, s.source_file, i.injected_at, i.injected_at IS NOT NULL AS hit, i.scenario_id,
           a.suspected_fault = f.scenario_id || ':' || f.fault_type || ':' || f.target_endpoint AND a.imputation_score >= 0.9 AS sibling,
           coalesce(a.suspected_fault = i.scenario_id || ':' || i.fault_type || ':' || i.target_endpoint, false) AS right_
    FROM attributed a JOIN file_spans s ON a.opened_at BETWEEN s.since AND s.until_
    JOIN injections f ON f.source_file = s.source_file
    LEFT JOIN injections i ON i.source_file = s.source_file AND i.target_endpoint = a.endpoint_id
      AND a.opened_at BETWEEN i.injected_at AND i.cleared_at + INTERVAL 12 HOUR""")
BLOCKS["reports"] = (("file_alerts", "file_spans", "injections"), """
    SELECT s.source_file, count(*) FILTER (hit) > 0 AS seen, count(*) FILTER (NOT hit AND NOT coalesce(sibling, false)) AS fp,
           (epoch(any_value(s.until_)) - epoch(any_value(s.since))) / 3600.0 AS duration_hours,
           min(epoch(a.opened_at) - epoch(a.injected_at)) AS delay,
           coalesce(arg_min(right_, a.opened_at) FILTER (hit), false) AS first_right, any_value(i.scenario_id) = 'bad_deploy' AS deploy
    FROM file_spans s JOIN injections i USING (source_file) LEFT JOIN (SELECT * EXCLUDE (scenario_id) FROM file_alerts) a USING (source_file) GROUP BY 1""")


@query("scenario_report", ("reports",), f"""
    SELECT source_file, CAST(seen AS BIGINT) AS tp, fp, CAST(NOT seen AS BIGINT) AS fn, {num('duration_hours')}, {num('delay', 'median_delay_seconds')},
           CAST(seen AND deploy AND first_right AS BIGINT) AS attribution_correct, CAST(seen AND deploy AS BIGINT) AS attribution_total FROM reports""")
def scenario_report(t):
    return evaluation.scenario_report(_alerts(t), t.injections, t.settings, BUCKET)


BLOCKS["overall"] = (("reports",), """
    SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM
    (SELECT CAST(sum(CAST(seen AS INTEGER)) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(CAST(NOT seen AS INTEGER)) AS BIGINT) AS fn,
            sum(duration_hours) AS h, median(delay) AS delay FROM reports)""")


@query("overall_report", ("overall",), f"""
    SELECT tp, fp, fn, {num('precision')}, {num('recall')}, {num('fp / h', 'false_positives_per_hour')}, {num('delay', 'median_detection_delay_seconds')} FROM overall""")
def overall_report(t):
    r = evaluation.overall_report(_alerts(t), t.injections, t.settings, BUCKET)
    return r.select("tp", "fp", "fn", "precision", "recall", "false_positives_per_hour", "median_detection_delay_seconds")


BLOCKS["sweep_fire"] = (("replayed",), """
    SELECT endpoint_id, time, threshold, fire, lag(fire, 1, false) OVER w AS f1, lag(fire, 2, false) OVER w AS f2 FROM
    (SELECT endpoint_id, time, threshold, static_fire OR combined >= threshold AS fire FROM replayed, (VALUES (0.3), (0.4), (0.5), (0.6), (0.7)) v(threshold))
    WINDOW w AS (PARTITION BY threshold, endpoint_id ORDER BY time)""")
BLOCKS["sweep"] = (("sweep_fire", "injections", "hours"), """
    SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM (
      SELECT v.threshold, count(*) FILTER (d) AS tp, count(*) FILTER (NOT d) AS fn,
             (SELECT count(*) FROM sweep_fire o WHERE o.threshold = v.threshold AND fire AND f1 AND NOT f2 AND NOT EXISTS
               (SELECT 1 FROM injections i WHERE o.time BETWEEN i.injected_at AND i.cleared_at + INTERVAL 12 HOUR)) AS fp, (SELECT h FROM hours) AS h
      FROM (SELECT t.threshold, EXISTS (SELECT 1 FROM sweep_fire o WHERE o.threshold = t.threshold AND fire AND f1 AND NOT f2 AND o.endpoint_id = i.target_endpoint
              AND o.time BETWEEN i.injected_at AND i.cleared_at + INTERVAL 12 HOUR) AS d
            FROM injections i, (SELECT DISTINCT threshold FROM sweep_fire) t) v GROUP BY v.threshold)""")
F1 = "coalesce(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) END, 0)"
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]


def _sweep(t):
    return model_ops.threshold_sweep(tables.stored(t.replayed, "replayed"), t.injections, THRESHOLDS, t.settings, BUCKET)


@query("threshold_sweep", ("sweep",), f"""
    SELECT {num('threshold')}, tp, fn, fp, {num('coalesce(p, 0)', 'precision')}, {num('coalesce(r, 0)', 'recall')}, {num(F1, 'f1')}, {num('fp / h', 'fp_per_hour')} FROM sweep""")
def threshold_sweep(t):
    return _sweep(t)


@query("best_threshold", ("sweep",), f"SELECT {num('threshold')}, {num(F1, 'f1')} FROM sweep ORDER BY {F1} DESC, threshold LIMIT 1")
def best_threshold(t):
    return evaluation.best_threshold(_sweep(t)).select("threshold", "f1")


# contamination moves only the binary cut, which the calibrated score does not use: one row of the sweep serves each value
@query("contamination_sweep", ("sweep",), f"""
    SELECT {num('contamination')}, tp, fn, fp FROM sweep, (VALUES (0.01), (0.02), (0.05), (0.1)) v(contamination) WHERE threshold = 0.6""")
def contamination_sweep(t):
    args = (t.features, t.baseline, t.injections, t.slos, AS_OF, [0.01, 0.02, 0.05, 0.1])
    return model_ops.contamination_sweep(*args, t.settings, BUCKET).select("contamination", "tp", "fn", "fp")


def _campaign(t):
    """Campaign runs from orders: customers are scenarios, the order parity is the tier."""
    o = t.table("orders")
    return o.select(
        F.concat(F.lit("s"), F.col("o_custkey") % 60).alias("scenario"),
        F.when(F.col("o_orderkey") % 2 == 0, "core").otherwise("stress").alias("tier"),
        (F.col("o_custkey") % 60 * 10).cast("int").alias("duration_yaml_s"),
        F.when(F.col("o_orderkey") % 3 == 0, "error").otherwise("ok").alias("status"),
        F.struct("o_orderdate", "o_orderkey").alias("started_at"),
        F.col("o_totalprice").alias("delay_median_s"),
    )


BLOCKS["campaign"] = ((), """
    SELECT 's' || CAST(o_custkey % 60 AS VARCHAR) AS scenario, CASE WHEN o_orderkey % 2 = 0 THEN 'core' ELSE 'stress' END AS tier,
           o_custkey % 60 * 10 AS duration_yaml_s, CASE WHEN o_orderkey % 3 = 0 THEN 'error' ELSE 'ok' END AS status, o_totalprice AS delay_median_s
    FROM orders QUALIFY row_number() OVER (PARTITION BY 1, 2 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""".replace("PARTITION BY 1, 2", "PARTITION BY o_custkey % 60, o_orderkey % 2"))


@query("campaign_summary", ("campaign",), f"""
    SELECT scenario, tier, CASE WHEN tier = 'core' THEN greatest(duration_yaml_s, 300) ELSE duration_yaml_s END AS duration_effective_s, status, {num('delay_median_s')} FROM campaign""")
def campaign_summary(t):
    return evaluation.campaign_summary(_campaign(t), 300).select(
        "scenario", "tier", "duration_effective_s", "status", "delay_median_s"
    )


@query("campaign_completeness", ("campaign",), """
    SELECT 120 AS expected_runs, count(*) FILTER (status = 'ok') AS ok_runs, count(*) FILTER (status = 'ok') = 120 AS complete FROM campaign""")
def campaign_completeness(t):
    s = tables.stored(evaluation.campaign_summary(_campaign(t), 300), "campaign")
    return evaluation.campaign_completeness(s, s)


@query("csv_report", ("campaign",), "SELECT scenario, tier, status FROM campaign")
def csv_report(t):
    path = tables.fresh_path(t.spark, "csv")
    s = evaluation.campaign_summary(_campaign(t), 300)
    missing = [c for c in SUMMARY_COLUMNS if c not in s.columns]
    s = s.withColumns({c: F.lit(None).cast("string") for c in missing})
    tables.write_csv_report(s, path, list(SUMMARY_COLUMNS))
    back = t.spark.read.schema(", ".join(f"{c} string" for c in SUMMARY_COLUMNS)).csv(path, header=True)
    return back.select("scenario", "tier", "status")


@query("json_report", ("stats",), f"SELECT level, fault_type, magnitude, n, {num('dr_layered')} FROM stats")
def json_report(t):
    path = tables.fresh_path(t.spark, "json")
    tables.write_json_report(evaluation.detection_stats(_found(t)), path)
    schema = "level string, fault_type string, magnitude string, n bigint, dr_layered double"
    return t.spark.read.schema(schema).json(path)

# --------------------------------------------------------------------------- model layer


BLOCKS["matrix"] = (("derived_usable", "injections"), """
    SELECT * FROM derived_usable d WHERE window_rows >= 3 AND NOT EXISTS (SELECT 1 FROM injections i WHERE d.time BETWEEN i.injected_at AND i.cleared_at)""")


def _matrix(t):
    return model_ops.training_matrix(t.features, t.baseline, t.injections, t.as_of, t.settings, BUCKET)


@query("training_matrix", ("matrix",), f"SELECT endpoint_id, {stamp('time')}, " + ", ".join(num(c) for c in FEATURES) + " FROM matrix")
def training_matrix(t):
    return _matrix(t).select("endpoint_id", "time", *FEATURES)


@query("feature_medians", ("matrix",), " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {num(f'median({c})', 'median')} FROM matrix" for n, c in zip(MODEL_FEATURES, FEATURES)))
def feature_medians(t):
    return forest.feature_medians(_matrix(t), t.settings.features)


@query("calibration_params", ("spans",), f"""
    SELECT {num('quantile_cont(latency_ms, 0.5)', 'p50')}, {num('quantile_cont(latency_ms, 0.95)', 'p95')}, {num('quantile_cont(latency_ms, 0.99)', 'p99')}, {num('max(latency_ms)', 'max')} FROM spans""")
def calibration_params(t):
    return forest.calibration_params(t.spans, "latency_ms")


@query("calibrate", ("spans",), f"SELECT span_id, {num('least(1.0, greatest(0.0, (latency_ms - 70.0) / 380.0))', 'score')} FROM spans")
def calibrate(t):
    return t.spans.select("span_id", forest.calibrate("latency_ms", 70.0, 450.0).alias("score"))


def _fitted(t):
    return model_ops.fit(_matrix(t), AS_OF, t.settings)


@query("iforest_train", ("forest_nodes",), f"""
    SELECT tree, node, feature, {num('threshold')}, CASE WHEN is_leaf THEN -1 ELSE 2 * node + 1 END AS left,
           CASE WHEN is_leaf THEN -1 ELSE 2 * node + 2 END AS right, is_leaf, depth, size FROM forest_nodes""")
def iforest_train(t):
    return _fitted(t).nodes


@query("iforest_train_shape", ("matrix",), """
    SELECT range AS tree, least(256, (SELECT count(*) FROM matrix)) AS leaf_rows, true AS is_binary, true AS within_depth FROM range(200)""")
def iforest_train_shape(t):
    leaf = F.col("is_leaf")
    return _fitted(t).nodes.groupBy("tree").agg(
        F.sum(F.when(leaf, F.col("size")).otherwise(0)).alias("leaf_rows"),
        (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("is_binary"),
        (F.max("depth") <= 8).alias("within_depth"),
    )


@query("iforest_score", ("ml", "usable"), f"""
    SELECT endpoint_id, {stamp('time')}, {num('raw_ml')}, {num('ml_norm')} FROM ml SEMI JOIN usable USING (endpoint_id, time) WHERE window_rows >= 3""")
def iforest_score(t):
    rows = model_ops.feature_matrix(t.features, t.baseline, t.settings)
    return model_ops.layer_ml(rows, _fitted(t), t.settings).select("endpoint_id", "time", "raw_ml", "ml_norm")


@query("iforest_score_range", ("derived_usable",), f"""
    SELECT endpoint_id, {stamp('time')}, true AS raw_in_range, true AS norm_in_range FROM derived_usable WHERE window_rows >= 3""")
def iforest_score_range(t):
    rows = model_ops.feature_matrix(t.features, t.baseline, t.settings)
    s = model_ops.layer_ml(rows, _fitted(t), t.settings)
    inside = (F.col("raw_ml") > 0) & (F.col("raw_ml") < 1)
    return s.select("endpoint_id", "time", inside.alias("raw_in_range"), F.col("ml_norm").between(0, 1).alias("norm_in_range"))


@query("layer_ml", ("replayed",), f"""
    SELECT endpoint_id, {stamp('time')}, direction, {num('ml_norm')}, {num('ml_gated')}, {num('combined')}, layer, layered_fire FROM replayed""")
def layer_ml(t):
    s = model_ops.scored_history(t.features, t.baseline, t.slos, _fitted(t), t.settings)
    return s.select("endpoint_id", "time", "direction", "ml_norm", "ml_gated", "combined", "layer", "layered_fire")


# every row seven times, each time with another feature at its median
BLOCKS["medians"] = (("train",), "SELECT [" + ", ".join(f"median(x[{i}])" for i in range(1, 8)) + "] AS center FROM train")
BLOCKS["targets"] = (("model_rows", "usable"), "SELECT * FROM model_rows SEMI JOIN usable USING (endpoint_id, time) WHERE window_rows >= 3")
BLOCKS["ablated_rows"] = (("targets", "medians"), """
    SELECT row_id || '#' || j AS row_id, list_transform(range(1, 8), lambda i: CASE WHEN i = j THEN center[i] ELSE x[i] END) AS x
    FROM targets, range(1, 8) r(j), medians""")
score_blocks("ablated", "ablated_rows", "forest")
BLOCKS["drops"] = (("targets", "forest_score_raw", "ablated_raw", "calibration"), """
    SELECT endpoint_id, time, j, (b.raw - a.raw) / greatest(p99 - p50, 1e-9) AS fall
    FROM targets t JOIN forest_score_raw b USING (row_id), range(1, 8) r(j), calibration, ablated_raw a WHERE a.row_id = t.row_id || '#' || j""")


@query("ablation_attribution", ("drops",), f"""
    SELECT endpoint_id, {stamp('time')}, rank, {list(MODEL_FEATURES)}[j] AS feature, {num('round_even(fall, 4)', 'contribution')} FROM
    (SELECT *, row_number() OVER (PARTITION BY endpoint_id, time ORDER BY abs(fall) DESC, j) - 1 AS rank FROM drops) WHERE rank < 3""")
def ablation_attribution(t):
    m = _fitted(t)
    rows = model_ops.feature_matrix(t.features, t.baseline, t.settings)
    top = model_ops.with_attribution(rows, m, t.settings)
    return top.select("endpoint_id", "time", F.posexplode("ml_top").alias("rank", "f")).select(
        "endpoint_id", "time", "rank", F.col("f.name").alias("feature"), F.col("f.score").alias("contribution")
    )


@query("model_meta", ("matrix",), f"""
    SELECT count(*) AS n_samples, least(256, count(*)) AS subsample, 200 AS trees, {num('0.02', 'contamination')}, 10 AS window_size FROM matrix""")
def model_meta(t):
    return _fitted(t).meta.select("n_samples", "subsample", "trees", "contamination", "window_size")


@query("model_store", ("matrix",), """
    SELECT 'v1' AS promoted, 'v2' AS newest, count(*) AS n_samples FROM matrix""")
def model_store_query(t):
    store = model_store.ModelStore(t.spark, tables.fresh_path(t.spark, "models"))
    m = _fitted(t)
    store.save(m.nodes, m.meta, "v1", True, AS_OF)
    later = m.meta.withColumn("version", F.lit("v2")).withColumn("trained_at", F.col("trained_at") + F.expr("INTERVAL 1 DAY"))
    store.save(m.nodes, later, "v2", False, AS_OF)
    latest, previous = store.load_latest(), store.load_previous()
    return m.meta.select(F.lit(latest.version).alias("promoted"), F.lit(previous.version).alias("newest"), "n_samples")


@query("reference_window", ("matrix",), f"""
    SELECT row_id, {num(FEATURES[2], 'dev_p99')} FROM (SELECT *, sha256(endpoint_id || '|' || CAST(epoch_us(time) AS VARCHAR)) AS row_id FROM matrix)
    ORDER BY md5(row_id || '|42'), row_id LIMIT 500""")
def reference_window(t):
    return model_store.reference_window(_matrix(t), t.settings).select("row_id", F.get("features", F.lit(2)).alias("dev_p99"))


# a second forest from another seed, both scored on the reference window
forest_blocks("forest_old", "train", 7)
BLOCKS["ref_rows"] = (("train",), "SELECT row_id, x FROM train ORDER BY md5(row_id || '|42'), row_id LIMIT 500")
score_blocks("ref_new", "ref_rows", "forest")
score_blocks("ref_old", "ref_rows", "forest_old")
BLOCKS["gate"] = (("ref_new_raw", "ref_old_raw"), """
    SELECT max(abs(a / ta - b / tb)) AS ks FROM (
      SELECT sum(na) OVER (ORDER BY v) AS a, sum(nb) OVER (ORDER BY v) AS b, sum(na) OVER () AS ta, sum(nb) OVER () AS tb
      FROM (SELECT raw AS v, sum(n) AS na, sum(o) AS nb FROM
            (SELECT raw, 1 AS n, 0 AS o FROM ref_new_raw UNION ALL SELECT raw, 0, 1 FROM ref_old_raw) GROUP BY raw))""")


@query("sanity_gate", ("train", "gate"), f"SELECT (SELECT count(*) FROM train) AS rows, ks <= 0.35 AS ok, {num('ks')} FROM gate")
def sanity_gate(t):
    matrix = tables.stored(_matrix(t).select("row_id", "features"), "matrix")
    old = model_ops.fit(matrix, AS_OF, replace(t.settings, seed=7))
    new = model_ops.fit(matrix, AS_OF, t.settings)
    ok, ks = model_ops.sanity_gate(new, old, model_store.reference_window(matrix, t.settings), t.settings)
    return matrix.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(ok).alias("ok"), F.lit(ks).alias("ks"))


@query("promote")
def promote(t):
    store = model_store.ModelStore(t.spark, tables.fresh_path(t.spark, "models"))
    args = (store, t.features, t.baseline, t.injections, t.slos)
    first = model_ops.train_and_promote(*args, datetime(2024, 1, 30), t.settings, bucket_seconds=BUCKET)
    second = model_ops.train_and_promote(*args, datetime(2024, 1, 31), t.settings, bucket_seconds=BUCKET)
    rows = [(i, r["sanity"], r["validation"], r["fresh"], r["promoted"]) for i, r in enumerate((first, second))]
    return t.spark.createDataFrame(rows, "run int, sanity boolean, validation boolean, fresh boolean, promoted boolean")


@query("promotion_check", ("sweep",), f"""
    SELECT {num('c.r', 'recall_candidate')}, c.fp AS fp_candidate, {num('d.r', 'recall_current')}, d.fp AS fp_current,
           c.r >= d.r - 0.05 AS recall_ok, c.fp <= d.fp + greatest(2, floor(d.fp * 0.5)) AS fp_ok,
           c.r >= d.r - 0.05 AND c.fp <= d.fp + greatest(2, floor(d.fp * 0.5)) AS ok
    FROM sweep c, sweep d WHERE c.threshold = 0.4 AND d.threshold = 0.6""")
def promotion_check(t):
    scored = tables.stored(t.replayed, "replayed")
    loose = scored.withColumn("layered_fire", F.col("static_fire") | (F.col("combined") >= 0.4))
    new = model_ops.recall_and_fp(loose, t.injections, t.settings, BUCKET)
    old = model_ops.recall_and_fp(scored, t.injections, t.settings, BUCKET)
    return model_ops.promotion_check(new, old, t.settings)


@query("freshness_gate", ("features",), f"""
    SELECT {num("(epoch(TIMESTAMP '2024-01-31') - epoch(max(time))) / 3600.0", 'age_hours')}, (epoch(TIMESTAMP '2024-01-31') - epoch(max(time))) / 3600.0 <= 24 AS fresh FROM features""")
def freshness_gate(t):
    return model_ops.freshness_gate(t.features, t.as_of, t.settings)


BLOCKS["norms"] = (("spans",), "SELECT ts, least(1.0, latency_ms / 400.0) AS ml_norm FROM spans")
BLOCKS["live_norms"] = (("scored",), "SELECT time AS ts, ml_norm FROM scored")
BLOCKS["drift_counts"] = (("norms",), """
    SELECT ml_norm AS v, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS b FROM norms GROUP BY 1""")
BLOCKS["drift_cdf"] = (("drift_counts",), """
    SELECT max(abs(ca / ta - cb / tb)) AS ks FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM drift_counts)""")
BLOCKS["live_cdf"] = (("live_norms",), """
    SELECT max(abs(ca / ta - cb / tb)) AS ks FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb
      FROM (SELECT ml_norm AS v, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS b FROM live_norms GROUP BY 1))""")
LIVE = "FILTER (ts >= TIMESTAMP '2024-01-15')"


def _norms(t):
    rows = t.spans.select("ts", F.least(F.lit(1.0), F.col("latency_ms") / 400.0).alias("ml_norm"))
    cut = at(datetime(2024, 1, 15))
    return rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)


def _model_norms(t):
    """Calibrated forest scores of the cycles of the first and the second half of the month."""
    rows = t.scored.select(F.col("time").alias("ts"), "ml_norm")
    cut = at(datetime(2024, 1, 15))
    return rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)


@query("ks_statistic", ("drift_cdf",), f"SELECT {num('ks')} FROM drift_cdf")
def ks_statistic(t):
    ref, live = _norms(t)
    return model_ops.ks_statistic(ref, live, "ml_norm", "ml_norm").select("ks")


@query("drift_summary", ("live_norms",), f"""
    SELECT count(*) {LIVE} AS n_live, {num("avg(ml_norm) FILTER (ts < TIMESTAMP '2024-01-15')", 'ref_mean')}, {num(f'avg(ml_norm) {LIVE}', 'live_mean')},
           {num(f'quantile_cont(ml_norm, 0.95) {LIVE}', 'live_p95')}, {num(f'avg(CAST(ml_norm >= 0.5 AS DOUBLE)) {LIVE}', 'live_anomaly_rate')} FROM live_norms""")
def drift_summary(t):
    return model_ops.drift_summary(*_model_norms(t), t.settings)


@query("drift_check", ("live_norms", "live_cdf"), f"""
    SELECT count(*) {LIVE} AS n_live, {num('round_even((SELECT ks FROM live_cdf), 4)', 'ks_drift')}, {num(f'round_even(avg(ml_norm) {LIVE}, 4)', 'live_mean')},
           (SELECT ks FROM live_cdf) > 0.3 AS drift_flag FROM live_norms""")
def drift_check(t):
    ref, live = _model_norms(t)
    return model_ops.drift_check(ref, live, t.as_of, t.as_of, t.settings).select("n_live", "ks_drift", "live_mean", "drift_flag")


def _health(t):
    """One drift check per day of events."""
    return t.spans.groupBy(F.to_date("ts").alias("d")).agg(
        (F.avg(F.least(F.lit(1.0), F.col("latency_ms") / 400.0)) * 1.8).alias("ks_drift"),
        F.avg((F.col("latency_ms") > 200).cast("double")).alias("live_anomaly_rate"),
    ).select(F.col("d").cast("timestamp").alias("checked_at"), "ks_drift", "live_anomaly_rate")


BLOCKS["health"] = (("spans",), """
    SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS checked_at, avg(least(1.0, latency_ms / 400.0)) * 1.8 AS ks_drift,
           avg(CAST(latency_ms > 200 AS DOUBLE)) AS live_anomaly_rate FROM spans GROUP BY 1""")
HEALTH_SQL = f"SELECT {stamp('checked_at')}, {num('ks_drift')}, {num('live_anomaly_rate')} FROM health"


@query("model_health_sink", ("health",), HEALTH_SQL)
def model_health_sink(t):
    path = tables.fresh_path(t.spark, "health")
    tables.write_log(_health(t), path)
    return t.spark.read.parquet(path)


@query("drift_state", ("health",), "SELECT CAST(arg_max(ks_drift, checked_at) >= 0.3 AS BIGINT) AS drift FROM health")
def drift_state(t):
    return selfobs.drift_state(_health(t), t.settings)


@query("drift_history", ("health",), HEALTH_SQL)
def drift_history(t):
    return selfobs.drift_history(_health(t))


BLOCKS["labelled"] = (("spans", "injections"), """
    SELECT span_id, latency_ms AS score, latency_ms > 300 AS pred, EXISTS (SELECT 1 FROM injections i WHERE i.target_endpoint = s.endpoint_id
           AND s.ts BETWEEN i.injected_at AND i.cleared_at) AS label FROM spans s""")
BLOCKS["curve"] = (("labelled",), """
    SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp
    FROM (SELECT score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM labelled GROUP BY 1)""")
_H, _S, _P = "count(*) FILTER (label AND pred)", "count(*) FILTER (pred)", "count(*) FILTER (label)"


@query("binary_metrics", ("labelled", "curve"), f"""
    SELECT {num(f'{_H} / {_S}', 'precision')}, {num(f'{_H} / {_P}', 'recall')}, {num(f'2 * {_H} / ({_S} + {_P})', 'f1')},
           {num(f'(SELECT sum(neg * (tp - pos / 2.0)) FROM curve) / ({_P} * count(*) FILTER (NOT label))', 'roc_auc')},
           {num(f'(SELECT sum(pos * tp / (tp + fp)) FROM curve) / {_P}', 'pr_auc')} FROM labelled""")
def binary_metrics(t):
    rows = supervised.label_windows(t.spans.select("endpoint_id", "ts", "latency_ms"), t.injections, 0, "ts", BUCKET)
    rows = rows.select("label", F.col("latency_ms").alias("score"), (F.col("latency_ms") > 300).cast("int").alias("pred"))
    return supervised.binary_metrics(rows)


def _labelled(t):
    m = model_ops.feature_matrix(t.features, t.baseline, t.settings).withColumn("features", features.feature_vector(t.settings))
    m = supervised.label_windows(m.select("row_id", "endpoint_id", "time", "features"), t.injections, 12 * 3600, "time", BUCKET)
    return tables.stored(m, "labelled")


def _compared(t):
    """Metrics, boosting model and test rows; both queries share one fit of 300 rounds."""
    if not hasattr(t, "compared"):
        t.compared = supervised.supervised_compare(_labelled(t), t.settings)
    return t.compared


@query("supervised_compare")
def supervised_compare(t):
    return _compared(t)[0]


@query("permutation_importance")
def permutation_importance(t):
    _, model, test = _compared(t)
    return supervised.permutation_importance(model, test, t.settings.features)


# --------------------------------------------------------------------------- explanations


def _context(t):
    """Alerts with limit, band, faults and history: the input of the explanation."""
    alerts = tables.stored(t.attributed, "alerts")
    bands = t.scored.select("endpoint_id", F.col("time").alias("opened_at"), "slo_p99_ms", "slo_error_rate_5xx", "p10", "expected", "p90")
    rows = alerts.join(bands, ["endpoint_id", "opened_at"], "left")
    latency = F.col("signal_type") == "p99_ms"
    rows = rows.withColumn("slo_threshold", F.when(latency, F.col("slo_p99_ms")).otherwise(F.col("slo_error_rate_5xx")))
    rows = rows.withColumn("band", F.when(latency, F.struct("p10", F.col("expected").alias("p50"), "p90")))
    rows = explain.recent_history(rows, alerts, t.settings)
    return explain.alert_context(rows)


@query("alert_context", ("attributed", "slos"), f"""
    SELECT a.endpoint_id, a.signal_type, {stamp('opened_at')}, {num('round_even(raw_value, 2)', 'observed_value')}, {num("CASE WHEN a.signal_type = 'p99_ms' THEN slo_p99_ms ELSE slo_error_rate_5xx END", 'slo_threshold')},
           suspected_fault, {num('round_even(imputation_score, 2)', 'imputation_score')}, severity, layer,
           least(5, (SELECT count(*) FROM attributed b WHERE b.endpoint_id = a.endpoint_id AND b.opened_at BETWEEN a.opened_at - INTERVAL 336 HOUR AND a.opened_at)) AS history
    FROM attributed a JOIN slos USING (endpoint_id)""")
def alert_context(t):
    c = F.col("context")
    return _context(t).select(
        "endpoint_id", "signal_type", "opened_at", c["observed_value"].alias("observed_value"), c["slo_threshold"].alias("slo_threshold"),
        c["correlation"]["suspected_fault"].alias("suspected_fault"), c["correlation"]["imputation_score"].alias("imputation_score"),
        c["severity"].alias("severity"), c["detection_layer"].alias("layer"), F.size(c["recent_history"]).alias("history"),
    )


@query("recent_history", ("attributed",), f"""
    SELECT a.endpoint_id, a.signal_type, {stamp('a.opened_at')}, strftime(b.opened_at, '%Y-%m-%d %H:%M:%S') AS past_opened_at, b.signal_type AS past_signal
    FROM attributed a JOIN attributed b ON b.endpoint_id = a.endpoint_id AND b.opened_at BETWEEN a.opened_at - INTERVAL 336 HOUR AND a.opened_at
    QUALIFY row_number() OVER (PARTITION BY a.endpoint_id, a.signal_type, a.opened_at ORDER BY b.opened_at DESC, b.signal_type) <= 5""")
def recent_history(t):
    alerts = tables.stored(t.attributed, "alerts")
    h = explain.recent_history(alerts, alerts, t.settings)
    return h.select("endpoint_id", "signal_type", "opened_at", F.explode("recent_history").alias("h")).select(
        "endpoint_id", "signal_type", "opened_at", F.col("h.opened_at").alias("past_opened_at"), F.col("h.signal_type").alias("past_signal")
    )


def _best_candidate(t):
    """Best degraded dependency of every cycle."""
    a = t.anomalies.select("endpoint_id", "detected_at", "score", "direction")
    g = tables.stored(_graph_candidates(t, a), "candidates")
    return g


def _graph_candidates(t, a):
    from ..operators import graph

    g = graph.service_graph(a, t.edges, a, t.settings)
    return g.select("endpoint_id", F.col("detected_at").alias("opened_at"), F.get("root_cause_candidates", F.lit(0)).alias("candidate"))


BLOCKS["best_rca"] = (("rca",), """
    SELECT root AS endpoint_id, detected_at AS opened_at, endpoint_id AS who, service, call_type, anomaly_score, confidence_score, confidence
    FROM rca QUALIFY row_number() OVER (PARTITION BY root, detected_at ORDER BY confidence_score DESC, endpoint_id) = 1""")
BLOCKS["explained"] = (("attributed", "slos", "best_rca"), """
    SELECT a.*, l.*, signal_type || ' of ' || endpoint_id || ': ' || printf('%.2f', round_even(raw_value, 2)) || ' against a limit of ' ||
           printf('%.2f', CASE WHEN signal_type = 'p99_ms' THEN slo_p99_ms ELSE slo_error_rate_5xx END) || ' [score ' || printf('%.2f', round_even(score, 2)) || ', ' || severity || ']' AS summary,
           CASE WHEN who IS NOT NULL THEN 'Suspected dependency: ' || who || ' [' || concat_ws(', ', rca_service, CASE WHEN call_type IN ('direct', 'cascade') THEN call_type END,
                  'anomaly ' || printf('%.2f', anomaly_score), CASE WHEN confidence IN ('high', 'medium') THEN 'confidence ' || printf('%.2f', confidence_score) END)
                  || '], degraded before ' || endpoint_id || '; ' || CASE confidence WHEN 'high' THEN 'start the investigation there' WHEN 'medium' THEN 'look there before other leads' ELSE 'a weak hint only' END
                WHEN suspected_fault IS NOT NULL AND round_even(imputation_score, 2) >= 0.5 THEN 'Onset falls into ' || suspected_fault || ' (score ' || printf('%.2f', round_even(imputation_score, 2)) || ')'
                ELSE 'No lead: neither a fault, a deployment nor a dependency suspected so far' END AS suspected_cause
    FROM attributed a JOIN slos l USING (endpoint_id) LEFT JOIN (SELECT * EXCLUDE (service), service AS rca_service FROM best_rca) r USING (endpoint_id, opened_at)""")


def _explained(t):
    rows = _context(t).join(_best_candidate(t), ["endpoint_id", "opened_at"], "left")
    return explain.template_explanation(rows, F.col("candidate"))


@query("template_explanation", ("explained",), f"""
    SELECT endpoint_id, signal_type, {stamp('opened_at')}, summary, suspected_cause, 'Read the logs behind ' || endpoint_id || ' from shortly before the onset' AS first_check, 3 AS checks FROM explained""")
def template_explanation(t):
    e = F.col("explanation")
    return _explained(t).select(
        "endpoint_id", "signal_type", "opened_at", e["summary"].alias("summary"), e["suspected_cause"].alias("suspected_cause"),
        F.get(e["checks"], F.lit(0)).alias("first_check"), F.size(e["checks"]).alias("checks"),
    )


@query("prompt_text", ("attributed",), f"SELECT endpoint_id, signal_type, {stamp('opened_at')}, true AS names_endpoint, true AS names_signal FROM attributed")
def prompt_text(t):
    p = explain.prompt_text()
    return _context(t).select(
        "endpoint_id", "signal_type", "opened_at", F.contains(p, F.concat(F.lit('"endpoint_id":"'), "endpoint_id")).alias("names_endpoint"),
        F.contains(p, F.concat(F.lit('"signal_type":"'), "signal_type")).alias("names_signal"),
    )


def _responses(t):
    """Model replies from events: eight kinds of well and badly formed texts."""
    kind = F.col("event_id") % 8
    good = F.concat(F.lit('{"summary":" seen '), F.col("event_id"), F.lit('","suspected_cause":"probable","checks":["look at '), "event_type", F.lit('","x"]}'))
    text = (
        F.when(kind == 0, good)
        .when(kind == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(kind == 2, F.lit('{"summary":"  ","suspected_cause":"c","checks":["x"]}'))
        .when(kind == 3, F.lit('{"summary":"s","suspected_cause":"c","checks":[]}'))
        .when(kind == 4, F.lit('{"summary":"s","suspected_cause":"c","checks":"x"}'))
        .when(kind == 5, F.lit("no json at all"))
        .when(kind == 6, F.lit('{"summary":"s","suspected_cause":"c","checks":["x"," "]}'))
        .otherwise(F.lit('{"summary":"s","checks":["x"]}'))
    )
    return t.events.select("event_id", "user_id", "event_type", "value", text.alias("response"))


@query("response_validate", (), """
    SELECT event_id, event_id % 8 < 2 AS valid, CASE WHEN event_id % 8 < 2 THEN 'seen ' || CAST(event_id AS VARCHAR) END AS summary,
           CASE WHEN event_id % 8 < 2 THEN 'look at ' || event_type END AS first_check FROM events""")
def response_validate(t):
    v = explain.response_validate(_responses(t))
    return v.select("event_id", "valid", F.col("parsed.summary").alias("summary"), F.get("parsed.checks", F.lit(0)).alias("first_check"))


BLOCKS["rated"] = ((), """
    SELECT *, 1 AS r1, CASE WHEN event_id % 4 = 3 THEN 0 WHEN abs(n - value) <= greatest(value * 0.05, 1.0) THEN 2 ELSE 1 END AS r2,
           CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS r3, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS r4
    FROM (SELECT event_id, event_type, value, CASE event_id % 4 WHEN 0 THEN floor(value) WHEN 1 THEN floor(value * 1.04) WHEN 2 THEN floor(value * 2) + 7 END AS n FROM events)""")


def _rated(t):
    n = (
        F.when(F.col("event_id") % 4 == 0, F.floor("value")).when(F.col("event_id") % 4 == 1, F.floor(F.col("value") * 1.04))
        .when(F.col("event_id") % 4 == 2, F.floor(F.col("value") * 2) + 7)
    )
    long_check = F.lit("Examiner les logs du service et son pool de connexions")
    checks = (
        F.when(F.col("event_id") % 3 == 0, F.array(long_check, long_check))
        .when(F.col("event_id") % 3 == 1, F.array(long_check, F.lit("short logs")))
        .otherwise(F.array(F.lit("a sentence that is quite long but names no action at all")))
    )
    rows = t.events.select(
        "event_id", F.col("event_type").alias("source"), F.col("value").alias("raw_value"),
        F.struct(
            F.concat(F.lit("observed "), F.coalesce(n.cast("string"), F.lit("nothing")), F.lit(" here")).alias("summary"),
            F.when(F.col("event_id") % 5 == 0, "the disk is full").otherwise("probable saturation").alias("suspected_cause"),
            checks.alias("checks"),
        ).alias("explanation"),
    )
    return explain.explanation_rubric(rows)


@query("explanation_rubric", ("rated",), """
    SELECT event_id, r1 AS r1_structure, r2 AS r2_numbers, r3 AS r3_checks, r4 AS r4_caution, r1 + r2 + r3 + r4 AS rubric_total FROM rated""")
def explanation_rubric(t):
    return _rated(t).select("event_id", "r1_structure", "r2_numbers", "r3_checks", "r4_caution", "rubric_total")


@query("rubric_mean", ("rated",), f"SELECT event_type AS source, {num('avg(r1 + r2 + r3 + r4)', 'mean_total')}, count(*) AS n FROM rated GROUP BY 1")
def rubric_mean(t):
    return explain.rubric_mean(_rated(t))


def _judged(t):
    k = F.col("event_id") % 5
    text = (
        F.when(k == 0, F.concat(F.lit('{"correctness":3,"quality":'), F.col("event_id") % 4, F.lit(',"checks_actionability":1,"cause_calibration":0,"comment":"fine"}')))
        .when(k == 1, F.lit('{"correctness":4,"quality":2,"checks_actionability":1,"cause_calibration":0,"comment":"too high"}'))
        .when(k == 2, F.lit('{"correctness":3,"quality":2,"checks_actionability":1,"comment":"one is missing"}'))
        .when(k == 3, F.lit("nothing"))
        .otherwise(F.concat(F.lit('```\n{"correctness":2,"quality":2,"checks_actionability":1,"cause_calibration":2,"comment":"'), "event_type", F.lit('"}\n```')))
    )
    return explain.judge_validate(t.events.withColumn("judge", text))


@query("judge_validate", (), """
    SELECT event_id, event_id % 5 IN (0, 4) AS valid, CASE event_id % 5 WHEN 0 THEN event_id % 4 WHEN 4 THEN 2 END AS quality,
           CASE event_id % 5 WHEN 0 THEN 'fine' WHEN 4 THEN event_type END AS comment FROM events""")
def judge_validate(t):
    return _judged(t).select(
        "event_id", F.col("judge_score").isNotNull().alias("valid"), F.col("judge_score.quality").alias("quality"), F.col("judge_score.comment").alias("comment")
    )


BLOCKS["reply_runs"] = ((), """
    SELECT event_type AS model, event_id, value * 10 AS latency_ms, user_id % 9 = 0 AS failed, event_id % 8 <> 5 AS valid_json, event_id % 8 < 2 AS valid_schema, user_id AS tokens,
           CASE event_id % 5 WHEN 0 THEN 4 + event_id % 4 WHEN 4 THEN 7 END AS total FROM events""")


@query("llm_run_stats", ("reply_runs",), f"""
    SELECT model, count(*) AS n, count(*) FILTER (failed) AS errors, {num('avg(CAST(valid_json AS DOUBLE))', 'json_valid_rate')}, {num('avg(CAST(valid_schema AS DOUBLE))', 'schema_valid_rate')},
           {num('avg(latency_ms) FILTER (NOT failed)', 'latency_mean_ms')}, {num('median(latency_ms) FILTER (NOT failed)', 'latency_median_ms')},
           {num('list_sort(list(latency_ms) FILTER (NOT failed))[CAST(least(floor(count(*) FILTER (NOT failed) * 0.9e0), count(*) FILTER (NOT failed) - 1) AS BIGINT) + 1]', 'latency_p90_ms')},
           {num('list_sort(list(latency_ms) FILTER (NOT failed))[CAST(least(floor(count(*) FILTER (NOT failed) * 0.95e0), count(*) FILTER (NOT failed) - 1) AS BIGINT) + 1]', 'latency_p95_ms')},
           {num('avg(tokens)', 'input_tokens_mean')}, {num('avg(total)', 'score_total_mean')} FROM reply_runs GROUP BY model""")
def llm_run_stats(t):
    runs = _judged(t).select(
        F.col("event_type").alias("model"), (F.col("value") * 10).alias("latency_ms"), F.when(F.col("user_id") % 9 == 0, "timeout").alias("error"),
        (F.col("event_id") % 8 != 5).alias("valid_json"), (F.col("event_id") % 8 < 2).alias("valid_schema"), F.col("user_id").alias("input_tokens"),
        F.col("user_id").alias("output_tokens"), "judge_score",
    )
    return selfobs.response_run_stats(runs, ["model"]).select(
        "model", "n", "errors", "json_valid_rate", "schema_valid_rate", "latency_mean_ms", "latency_median_ms", "latency_p90_ms",
        "latency_p95_ms", "input_tokens_mean", "score_total_mean",
    )


@query("explanation_sink", ("explained",), f"SELECT endpoint_id, signal_type, {stamp('opened_at')}, summary, true AS fallback FROM explained")
def explanation_sink(t):
    path = tables.fresh_path(t.spark, "explanations")
    tables.write_log(_explained(t).select("alert_id", "endpoint_id", "signal_type", "opened_at", "explanation"), path)
    return t.spark.read.parquet(path).select(
        "endpoint_id", "signal_type", "opened_at", F.col("explanation.summary").alias("summary"), F.col("explanation.fallback").alias("fallback")
    )


@query("alert_outbox", ("attributed", "slos"), f"""
    SELECT endpoint_id, signal_type, {stamp('opened_at')}, suspected_fault, deploy_version,
           signal_type || ' of ' || endpoint_id || ': ' || printf('%.2f', round_even(raw_value, 2)) || ' against a limit of ' ||
           printf('%.2f', CASE WHEN signal_type = 'p99_ms' THEN slo_p99_ms ELSE slo_error_rate_5xx END) || ' [score ' || printf('%.2f', round_even(score, 2)) || ', ' || severity || ']' AS summary,
           CASE WHEN suspected_fault IS NOT NULL AND round_even(imputation_score, 2) >= 0.5 THEN 'Onset falls into ' || suspected_fault || ' (score ' || printf('%.2f', round_even(imputation_score, 2)) || ')'
                ELSE 'No lead: neither a fault, a deployment nor a dependency suspected so far' END AS suspected_cause,
           'FIRING [' || upper(severity) || ']' AS first_line
    FROM attributed a JOIN slos l USING (endpoint_id)""")
def alert_outbox(t):
    """The alert log as a stream, and once more under another checkpoint: one message per incident."""
    path, root = tables.fresh_path(t.spark, "log-stream"), tables.fresh_path(t.spark, "outbox")
    t.log.write.parquet(path)
    log = t.spark.readStream.schema(t.log.schema).option("maxFilesPerTrigger", 4).parquet(path)

    def text(fired, past):
        return outbox.write_up(fired, past, t.injections, t.deploys, t.slos, t.settings, BUCKET)

    sent = outbox.run_outbox(log, root, tables.fresh_path(t.spark, "outbox-checkpoint"), text)
    # a second stream over the same log finds all incidents written
    sent = outbox.run_outbox(log, root, tables.fresh_path(t.spark, "outbox-checkpoint"), text, "repeat")
    return sent.select(
        "endpoint_id", "signal_type", "opened_at", "suspected_fault", "deploy_version", F.col("explanation.summary").alias("summary"),
        F.col("explanation.suspected_cause").alias("suspected_cause"), F.substring_index("message", "\n", 1).alias("first_line"),
    )


@query("notification_text", ("explained",), f"""
    SELECT endpoint_id, signal_type, {stamp('opened_at')}, concat_ws(chr(10), 'FIRING [' || upper(severity) || ']', 'Endpoint: ' || endpoint_id, 'Signal: ' || signal_type,
        'Detail: ' || CASE WHEN signal_type = 'p99_ms' THEN 'p99 ' || printf('%.0f', raw_value) || ' ms' ELSE 'error rate ' || printf('%.1f', raw_value) || ' %' END,
        'Score: ' || printf('%.2f', round_even(score, 2)),
        CASE WHEN deploy_version IS NOT NULL THEN 'Suspected deployment: ' || deploy_service || ' ' || deploy_version || ' (score ' || printf('%.2f', round_even(deploy_score, 2)) || ')' END,
        CASE WHEN suspected_fault IS NOT NULL THEN 'Suspected cause: ' || suspected_fault || ' (score ' || printf('%.2f', round_even(imputation_score, 2)) || ')' END,
        '> ' || summary, 'Probable cause (template): ' || suspected_cause) AS message FROM explained""")
def notification_text(t):
    two = {c: half_even(c, 2) for c in ("score", "deploy_score", "imputation_score")}
    rows = _explained(t).withColumns(two).withColumn("explanation", F.col("explanation").withField("checks", F.array().cast("array<string>")))
    return explain.notification_text(rows).select("endpoint_id", "signal_type", "opened_at", "message")


# --------------------------------------------------------------------------- self-observability


@query("state_counts", ("log",), """
    SELECT s.state, count(c.state) AS n FROM (VALUES ('ok'), ('pending'), ('firing'), ('resolving')) s(state)
    LEFT JOIN (SELECT * FROM log WHERE (endpoint_id, signal_type) IN (SELECT (endpoint_id, signal_type) FROM log WHERE state <> 'ok')
               QUALIFY row_number() OVER (PARTITION BY endpoint_id, signal_type ORDER BY time DESC) = 1) c USING (state) GROUP BY s.state""")
def state_counts(t):
    return selfobs.state_counts(current_alerts(t.log), t.spark)


@query("freshness", ("spans",), f"SELECT {num('''epoch(TIMESTAMP '2024-01-31') - epoch(max(ts))''', 'lag_seconds')} FROM spans")
def freshness(t):
    return selfobs.freshness(t.spans, t.as_of, "ts")


@query("component_up", ("spans",), "SELECT CAST(epoch(TIMESTAMP '2024-01-31') - epoch(max(ts)) < 300 AS BIGINT) AS up FROM spans")
def component_up(t):
    return selfobs.component_up(t.spans, t.as_of, "ts")


@query("lag_seconds", ("features", "anomalies"), f"""
    SELECT {num("epoch(TIMESTAMP '2024-01-31') - epoch((SELECT max(time) FROM features))", 'feature_lag')}, {num("epoch(TIMESTAMP '2024-01-31') - epoch((SELECT max(detected_at) FROM anomalies))", 'anomaly_lag')}""")
def lag_seconds(t):
    a = selfobs.freshness(t.features, t.as_of, "time", "feature_lag")
    b = selfobs.freshness(t.anomalies, t.as_of, "detected_at", "anomaly_lag")
    return a.withColumn("anomaly_lag", b.select("anomaly_lag").scalar())


@query("firing_now", ("log",), """
    SELECT count(*) FILTER (state = 'firing') AS firing FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY endpoint_id, signal_type ORDER BY time DESC) = 1)""")
def firing_now(t):
    return selfobs.firing_now(current_alerts(t.log))


@query("firings_in_range", ("log",), """
    SELECT count(*) AS firings FROM log WHERE state = 'firing' AND prev_state <> 'firing' AND time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""")
def firings_in_range(t):
    return selfobs.firings_in_range(alert_history(t.log), at(datetime(2024, 1, 10)), at(datetime(2024, 1, 20)))


@query("fallback_rate", (), f"SELECT {num('100.0 * count(*) FILTER (event_id % 8 >= 2) / count(*)', 'fallback_rate')} FROM events")
def fallback_rate(t):
    v = explain.response_validate(_responses(t))
    template = F.struct(F.lit("s").alias("summary"), F.lit("c").alias("suspected_cause"), F.array(F.lit("x")).alias("checks"), F.lit(True).alias("fallback"))
    return selfobs.fallback_rate(explain.with_fallback(v.withColumn("explanation", template)))


@query("firing_duration", ("episodes",), f"""
    SELECT {num('median(epoch(resolved_at) - epoch(opened_at))', 'median_seconds')} FROM episodes WHERE resolved_at IS NOT NULL""")
def firing_duration(t):
    return selfobs.firing_duration(t.episodes)


@query("distinct_cycles", ("spans",), "SELECT DISTINCT strftime(make_timestamp(epoch_us(ts) // 60000000 * 60000000), '%Y-%m-%d %H:%M:%S') AS cycle FROM spans")
def distinct_cycles(t):
    from ..functions.scalars import cycle_start

    return selfobs.distinct_cycles(t.spans.select(cycle_start("ts", 60).alias("time")))


@query("cadence", ("features",), f"""
    SELECT {stamp('cycle')}, {num('epoch(cycle) - epoch(lag(cycle) OVER (ORDER BY cycle))', 'gap_seconds')} FROM (SELECT DISTINCT time AS cycle FROM features)""")
def cadence(t):
    return selfobs.cadence(t.features)


BLOCKS["all_hist"] = (("hist",), "SELECT time, le, sum(n) AS n FROM hist GROUP BY ALL")
BLOCKS["placed"] = (("all_hist",), """
    SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS lower_, max(n) OVER (PARTITION BY time) * 0.95e0 AS rank_
    FROM all_hist WINDOW w AS (PARTITION BY time ORDER BY le)""")


@query("cycle_p95", ("placed",), f"""
    SELECT {stamp('time')}, {num('arg_min(CASE WHEN isinf(le) THEN lower_ ELSE lower_ + (le - lower_) * ((rank_ - below) / (n - below)) END, le)', 'p95')} FROM placed WHERE n >= rank_ GROUP BY time""")
def cycle_p95(t):
    from ..operators import red

    h = red.sum_by_le(red.span_histogram(t.spans, t.settings.cycle_seconds), ("time",))
    return red.histogram_quantile(h, 0.95, ("time",), "p95")


@query("call_rate_per_min", ("increases",), f"""
    SELECT endpoint_id, strftime(make_timestamp(epoch_us(ts) // 900000000 * 900000000), '%Y-%m-%d %H:%M:%S') AS time, {num('60 * coalesce(sum(increase), 0) / 900.0', 'calls_per_minute')}
    FROM increases GROUP BY 1, 2""")
def call_rate_per_min(t):
    from ..operators import red
    from .telemetry_queries import _counter

    return red.call_rate_per_minute(_counter(t), ["endpoint_id"], 900)


@query("min_over_time", ("spans",), f"""
    SELECT endpoint_id, strftime(make_timestamp(epoch_us(ts) // 120000000 * 120000000), '%Y-%m-%d %H:%M:%S') AS time, {num('min(latency_ms)', 'min_value')} FROM spans GROUP BY 1, 2""")
def min_over_time(t):
    from ..operators import red

    return red.min_over_time(t.spans.select("endpoint_id", "ts", F.col("latency_ms").alias("value")), ["endpoint_id"], 120)


@query("detector_metrics", ("log", "anomalies", "attributed"), """
    SELECT 'anomaly_writes' AS metric, count(*) AS value FROM anomalies UNION ALL SELECT 'endpoints_with_features', count(DISTINCT endpoint_id) FROM anomalies
    UNION ALL SELECT 'firing_transitions', count(*) FROM log WHERE state = 'firing' AND prev_state <> 'firing'
    UNION ALL SELECT 'resolved_transitions', count(*) FROM log WHERE state = 'ok' AND prev_state <> 'ok'
    UNION ALL SELECT 'explanations_template', count(*) FROM attributed UNION ALL SELECT 'explanations_model', 0""")
def detector_metrics(t):
    explained = explain.template_explanation(_context(t))
    return selfobs.detector_metrics(t.anomalies, t.log, explained)


@query("health_panel", ("features", "bands"), f"""
    SELECT endpoint_id, {stamp('time')}, {num('p50_ms')}, {num('p99_ms')}, {num('p99_ms_p10', 'band_p10')}, {num('p99_ms_p50', 'band_p50')}, {num('p99_ms_p90', 'band_p90')},
           {num('error_rate_5xx')}, {num('error_rate_4xx')}, {num('rps')} FROM features JOIN bands USING (endpoint_id, time)""")
def health_panel(t):
    return selfobs.health_panel(t.features, t.baseline)


@query("layer_timeline", ("scored",), f"""
    SELECT endpoint_id, {stamp('time')}, layer, {num('score')} FROM (
      SELECT endpoint_id, time, 'static' AS layer, round_even(static_norm, 4) AS score FROM scored UNION ALL SELECT endpoint_id, time, 'baseline', round_even(baseline_norm, 4) FROM scored
      UNION ALL SELECT endpoint_id, time, 'iforest', round_even(ml_gated, 4) FROM scored UNION ALL SELECT endpoint_id, time, 'combined', round_even(combined, 4) FROM scored)""")
def layer_timeline(t):
    return selfobs.layer_timeline(t.anomalies)


@query("annotations", ("episodes", "deploys"), f"""
    SELECT {stamp('time')}, kind, label FROM (SELECT opened_at AS time, 'firing' AS kind, endpoint_id || ' ' || signal_type AS label FROM episodes
      UNION ALL SELECT resolved_at, 'resolved', endpoint_id || ' ' || signal_type FROM episodes WHERE resolved_at IS NOT NULL
      UNION ALL SELECT deployed_at, 'deploy', service || ' ' || version FROM deploys)""")
def annotations(t):
    return selfobs.annotations(t.episodes, t.deploys)


@query("latest_anomaly", ("scored",), f"""
    SELECT endpoint_id, {stamp('time', 'detected_at')}, {num('round_even(combined, 4)', 'score')}, direction, {num('round_even(static_norm, 4)', 'static_score')} FROM scored
    QUALIFY row_number() OVER (PARTITION BY endpoint_id ORDER BY time DESC) = 1""")
def latest_anomaly(t):
    return selfobs.latest_anomaly(t.anomalies).select(
        "endpoint_id", "detected_at", "score", "direction", F.col("contributing.layers.static").alias("static_score")
    )


@query("alerts_list", ("episodes",), f"""
    SELECT endpoint_id, signal_type, {stamp('opened_at')}, state FROM episodes WHERE service = 'orders' AND severity = 'critical' AND opened_at >= TIMESTAMP '2024-01-03'""")
def alerts_list(t):
    return selfobs.alerts_list(t.episodes, service="orders", severity="critical", since=at(datetime(2024, 1, 3))).select(
        "endpoint_id", "signal_type", "opened_at", "state"
    )
