"""Alert context, template explanation, response validation, rubric and message text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import ACTION_TERMS, HEDGE_TERMS, PRODUCTION, Settings
from ..functions.scalars import clean_round, half_even, plus_seconds
from .joins import asof_latest

# --------------------------------------------------------------------------- context


def recent_history(
    alerts: DataFrame, episodes: DataFrame, settings: Settings = PRODUCTION, onset: str = "opened_at"
) -> DataFrame:
    """Newest alerts of the same endpoint in the hours up to each alert, as a short array.

    Past alerts are numbered per endpoint; the newest number at the onset comes from an as-of join
    and the few numbers below it from an equi-join, so alerts are never paired with all others.
    """
    seconds = settings.history_hours * 3600
    order = W.partitionBy("endpoint_id").orderBy("opened_at", F.desc("signal_type"))
    past = episodes.select(
        "endpoint_id",
        F.col("opened_at").alias("_at"),
        F.row_number().over(order).alias("_pos"),
        F.struct("signal_type", "state", "opened_at", "severity", "suspected_fault").alias("_h"),
    )
    latest = asof_latest(
        alerts.select("alert_id", "endpoint_id", F.col(onset).alias("_onset")), past.drop("_h"),
        "_onset", "_at", ["endpoint_id"], seconds, ["_pos"],
    ).where(F.col("_pos").isNotNull())
    wanted = latest.withColumn(
        "_pos", F.explode(F.sequence(F.col("_pos"), F.greatest(F.col("_pos") - settings.history_limit + 1, F.lit(1)), F.lit(-1)))
    )
    kept = wanted.join(past, ["endpoint_id", "_pos"]).where(
        F.col("_at") >= plus_seconds("_onset", -seconds)
    )
    item = F.struct((-F.col("_pos")).alias("_n"), F.col("_h"))
    lists = kept.groupBy("alert_id").agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_h"]).alias("recent_history")
    )
    return alerts.join(lists, "alert_id", "left")


def alert_context(alerts: DataFrame) -> DataFrame:
    """Add the context document of each alert.

    Expects the alert columns, its limit ``slo_threshold``, the band struct ``band`` of its
    metric, ``suspected_fault``, ``imputation_score``, ``recent_history`` and, optionally,
    ``service_attribution``.
    """
    graph = (
        F.col("service_attribution")
        if "service_attribution" in alerts.columns
        else F.lit(None).cast("string")
    )
    doc = F.struct(
        "endpoint_id", "signal_type",
        clean_round("raw_value").alias("observed_value"),
        F.col("slo_threshold").alias("slo_threshold"),
        F.struct(*[clean_round(F.col(f"band.{p}")).alias(p) for p in ("p10", "p50", "p90")]).alias("baseline"),
        F.col("layer").alias("detection_layer"),
        "severity",
        clean_round("score").alias("score"),
        "opened_at",
        F.struct(
            "suspected_fault", clean_round("imputation_score").alias("imputation_score")
        ).alias("correlation"),
        graph.alias("service_attribution"),
        F.col("recent_history"),
    )
    return alerts.withColumn("context", doc)


PROMPT_HEAD = (
    "Explain this API performance alert to an on-call engineer. Reply with one JSON object and "
    "nothing else, with the keys summary (two sentences, with the observed value, the limit and "
    "the usual band), suspected_cause (careful wording, the dependency analysis first when there "
    "is one) and checks (two or three concrete actions). Never state a cause as certain.\n\n"
    "Alert context:\n"
)


def prompt_text(context: str = "context") -> Column:
    return F.concat(F.lit(PROMPT_HEAD), F.to_json(context))


# --------------------------------------------------------------------------- template


def _number(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", half_even(c, digits))


def template_summary(c: str = "context") -> Column:
    """What was measured: signal, endpoint, value against limit, then score and severity if known."""
    f = lambda n: F.col(f"{c}.{n}")
    subject = F.concat(f("signal_type"), F.lit(" of "), f("endpoint_id"))
    known = f("observed_value").isNotNull() & f("slo_threshold").isNotNull()
    values = F.concat(_number(f("observed_value")), F.lit(" against a limit of "), _number(f("slo_threshold")))
    marks = F.concat_ws(
        ", ",
        F.when(f("score").isNotNull(), F.concat(F.lit("score "), _number(f("score")))),
        F.when(known, f("severity")),
    )
    tail = F.when(marks != "", F.concat(F.lit(" ["), marks, F.lit("]"))).otherwise("")
    return F.when(known, F.concat(subject, F.lit(": "), values, tail)).otherwise(F.concat(F.lit("Alert on "), subject, tail))


#: What to make of a degraded dependency, by its rating.
ADVICE = {"high": "start the investigation there", "medium": "look there before other leads", "low": "a weak hint only"}


def template_cause(c: str = "context", candidate: Column | None = None) -> Column:
    """Lead by priority: best degraded dependency, then a strong correlation, then none.

    ``candidate`` is the best root-cause struct (endpoint_id, service, call_type, anomaly_score,
    confidence_score, confidence) or null.
    """
    fault, imputed = F.col(f"{c}.correlation.suspected_fault"), F.col(f"{c}.correlation.imputation_score")
    strong = fault.isNotNull() & (fault != "") & (imputed >= 0.5)
    correlated = F.concat(F.lit("Onset falls into "), fault, F.lit(" (score "), _number(imputed), F.lit(")"))
    unknown = F.lit("No lead: neither a fault, a deployment nor a dependency suspected so far")
    if candidate is None:
        return F.when(strong, correlated).otherwise(unknown)
    level = candidate["confidence"]
    facts = F.concat_ws(
        ", ",
        F.coalesce(candidate["service"], F.lit("service unknown")),
        F.when(candidate["call_type"].isin("direct", "cascade"), candidate["call_type"]),
        F.when(candidate["anomaly_score"].isNotNull(), F.concat(F.lit("anomaly "), _number(candidate["anomaly_score"]))),
        F.when(
            level.isin("high", "medium") & candidate["confidence_score"].isNotNull(),
            F.concat(F.lit("confidence "), _number(candidate["confidence_score"])),
        ),
    )
    advice = F.lit("not rated, compare the timelines")
    for rating, words in ADVICE.items():
        advice = F.when(level == rating, words).otherwise(advice)
    text = F.concat(
        F.lit("Suspected dependency: "), F.coalesce(candidate["endpoint_id"], F.lit("unknown")), F.lit(" ["), facts,
        F.lit("], degraded before "), F.col(f"{c}.endpoint_id"), F.lit("; "), advice,
    )
    return F.when(candidate.isNotNull(), text).when(strong, correlated).otherwise(unknown)


def template_checks(c: str = "context") -> Column:
    return F.array(
        F.concat(F.lit("Read the logs behind "), F.col(f"{c}.endpoint_id"), F.lit(" from shortly before the onset")),
        F.lit("List what was deployed in the half hour before the onset"),
        F.lit("Check pool usage, waits and errors of the services it calls"),
    )


def template_explanation(rows: DataFrame, candidate: Column | None = None, context: str = "context") -> DataFrame:
    """Add the deterministic explanation, marked as a fallback."""
    return rows.withColumn(
        "explanation",
        F.struct(
            template_summary(context).alias("summary"),
            template_cause(context, candidate).alias("suspected_cause"),
            template_checks(context).alias("checks"),
            F.lit(True).alias("fallback"),
        ),
    )


# --------------------------------------------------------------------------- responses


def strip_fences(text) -> Column:
    """Remove a leading ``` line and a trailing ``` line."""
    t = F.trim(F.col(text) if isinstance(text, str) else text, F.lit(" \t\r\n"))
    fenced = F.startswith(t, F.lit("```"))
    body = F.regexp_replace(t, r"^```[^\n]*(\n|$)", "")
    body = F.regexp_replace(body, r"(^|\n)[ \t\r]*```[ \t\r]*$", "")
    return F.trim(F.when(fenced, body).otherwise(t), F.lit(" \t\r\n"))


def response_validate(rows: DataFrame, text: str = "response") -> DataFrame:
    """Add ``parsed`` (summary, suspected_cause, checks) and ``valid`` for a model response."""
    body = strip_fences(text)
    # fields of another JSON type are kept as raw text, so their type can be checked
    raw = F.from_json(body, "struct<summary:string,suspected_cause:string,checks:string>")
    checks = F.from_json(F.get_json_object(body, "$.checks"), "array<string>")
    blank = lambda v: F.coalesce(F.trim(v) == "", F.lit(True))
    is_list = F.startswith(F.trim(F.coalesce(raw["checks"], F.lit(""))), F.lit("["))
    out = rows.withColumn("_raw", raw).withColumn("_checks", checks)
    ok = (
        F.col("_raw").isNotNull()
        & ~blank(F.col("_raw.summary"))
        & ~blank(F.col("_raw.suspected_cause"))
        & is_list
        & (F.coalesce(F.size("_checks"), F.lit(0)) > 0)
        & F.coalesce(F.forall("_checks", lambda c: ~blank(c)), F.lit(False))
    )
    return out.withColumn("valid", F.coalesce(ok, F.lit(False))).withColumn(
        "parsed",
        F.when(
            F.col("valid"),
            F.struct(
                F.trim("_raw.summary").alias("summary"),
                F.trim("_raw.suspected_cause").alias("suspected_cause"),
                F.transform("_checks", lambda c: F.trim(c)).alias("checks"),
                F.lit(False).alias("fallback"),
            ),
        ),
    ).drop("_raw", "_checks")


def with_fallback(rows: DataFrame, template: str = "explanation", parsed: str = "parsed") -> DataFrame:
    """The valid response, else the template."""
    return rows.withColumn("explanation", F.coalesce(parsed, template)).drop(parsed)


def judge_validate(rows: DataFrame, text: str = "judge") -> DataFrame:
    """Add ``judge_score``: four marks from 0 to 3 and a comment, or null."""
    marks = ("correctness", "quality", "checks_actionability", "cause_calibration")
    body = strip_fences(text)
    doc = F.from_json(body, "struct<" + ",".join(f"{m}:double" for m in marks) + ",comment:string>")
    fields = [doc[m] for m in marks]
    ok = doc["comment"].isNotNull()
    for v in fields:
        ok = ok & v.isNotNull() & v.between(0, 3)
    return rows.withColumn(
        "judge_score",
        F.when(
            ok,
            F.struct(*[v.cast("int").alias(m) for v, m in zip(fields, marks)], doc["comment"].alias("comment")),
        ),
    )


# --------------------------------------------------------------------------- rubric


def _numbers(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+[.,]?\d*)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def _contains_any(text: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def explanation_rubric(
    rows: DataFrame, explanation: str = "explanation", raw_value: str = "raw_value"
) -> DataFrame:
    """Add the four rubric marks and their total (0 to 6)."""
    blank = lambda v: F.trim(F.coalesce(v, F.lit("")))
    summary, cause = blank(F.col(f"{explanation}.summary")), blank(F.col(f"{explanation}.suspected_cause"))
    checks = F.coalesce(F.col(f"{explanation}.checks"), F.array().cast("array<string>"))
    value = F.col(raw_value)
    numbers = F.concat(_numbers(summary), _numbers(cause))
    near = F.exists(numbers, lambda n: F.abs(n - value) <= F.greatest(value * 0.05, F.lit(1.0)))
    specific = F.size(
        F.filter(
            checks,
            lambda c: (F.length(F.coalesce(c, F.lit(""))) >= 40)
            & _contains_any(F.lower(F.coalesce(c, F.lit(""))), ACTION_TERMS),
        )
    )
    return (
        rows.withColumn(
            "r1_structure", ((summary != "") & (cause != "") & (F.size(checks) >= 1)).cast("int")
        )
        .withColumn(
            "r2_numbers",
            F.when(value.isNotNull() & near, 2).when(F.size(numbers) > 0, 1).otherwise(0),
        )
        .withColumn("r3_checks", F.least(specific, F.lit(2)))
        .withColumn(
            "r4_caution", ((cause == "") | _contains_any(F.lower(cause), HEDGE_TERMS)).cast("int")
        )
        .withColumn(
            "rubric_total",
            F.col("r1_structure") + F.col("r2_numbers") + F.col("r3_checks") + F.col("r4_caution"),
        )
    )


def rubric_mean(rated: DataFrame, source: str = "source") -> DataFrame:
    return rated.groupBy(source).agg(
        F.avg("rubric_total").alias("mean_total"), F.count(F.lit(1)).alias("n")
    )


# --------------------------------------------------------------------------- message


def notification_text(rows: DataFrame) -> DataFrame:
    """Add ``message``: one text per firing, optional lines only when their data exist.

    Uses severity, signal_type, raw_value, score and, when present: deploy_service,
    deploy_version, deploy_score, suspected_fault, imputation_score, ttd and explanation.
    """
    has = set(rows.columns)
    value, null = F.col("raw_value"), F.lit(None).cast("string")
    detail = F.when(
        F.col("signal_type") == "p99_ms", F.concat(F.lit("p99 "), _number(value, 0), F.lit(" ms"))
    ).otherwise(F.concat(F.lit("error rate "), _number(value, 1), F.lit(" %")))
    lines = [
        F.concat(F.lit("FIRING ["), F.upper("severity"), F.lit("]")),
        F.concat(F.lit("Endpoint: "), F.col("endpoint_id")),
        F.concat(F.lit("Signal: "), F.col("signal_type")),
        F.concat(F.lit("Detail: "), detail),
        F.concat(F.lit("Score: "), _number(F.col("score"))),
    ]
    if "deploy_version" in has:
        lines.append(F.when(F.col("deploy_version").isNotNull(), F.concat(
            F.lit("Suspected deployment: "), F.col("deploy_service"), F.lit(" "), F.col("deploy_version"),
            F.lit(" (score "), _number(F.col("deploy_score")), F.lit(")"))).otherwise(null))
    if "suspected_fault" in has:
        lines.append(F.when(F.col("suspected_fault").isNotNull(), F.concat(
            F.lit("Suspected cause: "), F.col("suspected_fault"),
            F.lit(" (score "), _number(F.col("imputation_score")), F.lit(")"))).otherwise(null))
    if "ttd" in has:
        whole = lambda c: _number(c, 0)
        bounds = F.when(
            F.col("ttd.ttd_low").isNotNull() & F.col("ttd.ttd_high").isNotNull(),
            F.concat(F.lit(" ["), whole(F.col("ttd.ttd_low")), F.lit("-"), whole(F.col("ttd.ttd_high")), F.lit("]")),
        ).otherwise("")
        lines.append(F.when(F.col("ttd").isNotNull() & ~F.col("ttd.already_breaching"), F.concat(
            F.lit("Trend: limit reached in about "), whole(F.col("ttd.ttd_minutes")), F.lit(" min"), bounds,
            F.lit(", +"), _number(F.col("ttd.slope_ms_per_min"), 1),
            F.lit(" ms/min (extrapolated)"))).otherwise(null))
    if "explanation" in has:
        source = F.when(F.col("explanation.fallback"), "template").otherwise("model")
        lines += [
            F.concat(F.lit("> "), F.col("explanation.summary")),
            F.concat(F.lit("Probable cause ("), source, F.lit("): "), F.col("explanation.suspected_cause")),
            F.when(F.size("explanation.checks") > 0, F.concat(
                F.lit("Checks:\n"),
                F.array_join(F.transform("explanation.checks", lambda c: F.concat(F.lit("  - "), c)), "\n"),
            )).otherwise(null),
        ]
    return rows.withColumn("message", F.concat_ws("\n", *lines))
