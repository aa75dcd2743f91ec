"""Attribution of alerts to fault windows and deployments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PRODUCTION, Settings
from ..functions.scalars import endpoint_match, plus_seconds, seconds_between, half_even
from .joins import interval_join


def imputation_score(onset, injected, cleared, window_seconds: float) -> Column:
    """1 inside the fault window, falling to 0 over ``window_seconds`` on either side."""
    o, i, c = F.col(onset), F.col(injected), F.col(cleared)
    away = F.when(o < i, seconds_between(i, o)).otherwise(seconds_between(o, c))
    return F.when((o >= i) & (o <= c), 1.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - away / F.lit(float(window_seconds)))
    )


def _with_bonus(score: Column, match: Column, settings: Settings) -> Column:
    return F.when(match, F.least(F.lit(1.0), score * F.lit(settings.match_bonus))).otherwise(score)


def fault_candidates(
    alerts: DataFrame, injections: DataFrame, settings: Settings = PRODUCTION, onset: str = "opened_at",
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Alert and fault pairs whose onset lies near the fault window, with score and match flag."""
    wide = injections.select(
        "scenario_id", "fault_type", "target_service", "target_endpoint",
        "injected_at", "cleared_at", "source_file",
        plus_seconds("injected_at", -settings.causal_window_seconds).alias("_from"),
        plus_seconds("cleared_at", settings.causal_window_seconds).alias("_to"),
    )
    pairs = interval_join(
        alerts, wide, onset, "_from", "_to", (), "inner", bucket_seconds or 2 * settings.causal_window_seconds
    )
    pairs = pairs.withColumn(
        "service_match", endpoint_match("target_endpoint", "target_service", "endpoint_id")
    )
    score = imputation_score(onset, "injected_at", "cleared_at", settings.causal_window_seconds)
    return (
        pairs.withColumn("imputation_score", half_even(_with_bonus(score, F.col("service_match"), settings), 4))
        .where(_with_bonus(score, F.col("service_match"), settings) > 0)
        .drop("_from", "_to")
    )


def fault_attribution(
    alerts: DataFrame, injections: DataFrame, settings: Settings = PRODUCTION, onset: str = "opened_at",
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Add the suspected fault of each alert (by ``alert_id``): null and 0.0 without a candidate.

    The best candidate is a mergeable maximum; ties go to the earliest fault, then by name.
    """
    cand = fault_candidates(
        alerts.select("alert_id", "endpoint_id", onset), injections, settings, onset, bucket_seconds
    )
    payload = F.struct(
        F.concat_ws(":", "scenario_id", "fault_type", "target_endpoint").alias("suspected_fault"),
        "imputation_score", "service_match", "scenario_id", "fault_type", "source_file",
    )
    rank = F.struct(
        "imputation_score", "service_match",
        (-F.unix_micros("injected_at")).alias("early"), "scenario_id", "source_file",
    )
    best = cand.groupBy("alert_id").agg(F.max_by(payload, rank).alias("_b"))
    return alerts.join(best, "alert_id", "left").select(
        *alerts.columns,
        F.col("_b.suspected_fault").alias("suspected_fault"),
        F.coalesce(F.col("_b.imputation_score"), F.lit(0.0)).alias("imputation_score"),
        F.coalesce(F.col("_b.service_match"), F.lit(False)).alias("fault_service_match"),
    )


def service_of_endpoint(features: DataFrame) -> DataFrame:
    """Latest service seen for each endpoint."""
    return features.groupBy("endpoint_id").agg(F.max_by("service", "time").alias("service"))


def deploy_candidates(
    alerts: DataFrame, deploys: DataFrame, settings: Settings = PRODUCTION, onset: str = "opened_at",
    kind_prior: dict[str, float] | None = None,
) -> DataFrame:
    """Deployments of the window before the onset; newer and same-service ones score higher.

    ``kind_prior`` maps a deployment kind (column ``kind``) to a factor, 1.0 when unknown.
    """
    columns = ["deploy_id", F.col("service").alias("deploy_service"), "version", "deployed_at"]
    if kind_prior:
        columns.append("kind")
    reach = deploys.select(
        *columns, plus_seconds("deployed_at", settings.deploy_window_seconds).alias("_to")
    )
    pairs = interval_join(
        alerts, reach, onset, "deployed_at", "_to", (), "inner", settings.deploy_window_seconds
    )
    age = seconds_between(onset, "deployed_at") / F.lit(float(settings.deploy_window_seconds))
    match = F.coalesce(F.col("deploy_service") == F.col("service"), F.lit(False))
    score = _with_bonus(F.greatest(F.lit(0.0), 1.0 - age), match, settings)
    if kind_prior:
        prior = F.create_map(*[F.lit(x) for kv in kind_prior.items() for x in kv])
        score = score * F.coalesce(F.element_at(prior, F.col("kind")), F.lit(1.0))
    return (
        pairs.withColumn("deploy_service_match", match)
        .withColumn("_raw", score)
        .where(F.col("_raw") > 0)
        .withColumn("deploy_score", half_even("_raw", 4))
        .drop("_to", "_raw")
    )


def deploy_attribution(
    alerts: DataFrame, deploys: DataFrame, settings: Settings = PRODUCTION, onset: str = "opened_at",
    kind_prior: dict[str, float] | None = None,
) -> DataFrame:
    """Add the suspected deployment and its score to each alert."""
    cand = deploy_candidates(
        alerts.select("alert_id", "endpoint_id", "service", onset), deploys, settings, onset, kind_prior
    )
    payload = F.struct(
        F.col("deploy_id").alias("suspected_deploy_id"), "deploy_service",
        F.col("version").alias("deploy_version"), "deployed_at", "deploy_score", "deploy_service_match",
    )
    rank = F.struct("deploy_score", "deploy_service_match", F.unix_micros("deployed_at").alias("at"), "deploy_id")
    best = cand.groupBy("alert_id").agg(F.max_by(payload, rank).alias("_b"))
    return alerts.join(best, "alert_id", "left").select(*alerts.columns, "_b.*")


def alert_deploy_join(alerts: DataFrame, deploys: DataFrame) -> DataFrame:
    """Alerts with a printable label of their suspected deployment, '-' without one."""
    d = deploys.select(
        F.col("deploy_id").cast("string").alias("suspected_deploy_id"),
        F.concat_ws(" ", "service", "version").alias("_label"),
    )
    return alerts.join(d, "suspected_deploy_id", "left").withColumn(
        "suspected_deploy", F.coalesce("_label", F.lit("-"))
    ).drop("_label")
