"""Alert life cycle in batch: one state machine, written once as data.

A signal is OK, PENDING (counting anomalous cycles), FIRING or RESOLVING (counting clean cycles).
The machine has few states, so a run of cycles is a function from state to state.  Functions compose, so
the states of a long history are an associative scan: runs of cycles are folded apart from each other, their functions are
combined level by level, and the state at the start of each run is handed down again.
The streaming operator uses the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import PRODUCTION, Settings
from ..functions.scalars import col
from ..sources.tables import stored

KEY = ("endpoint_id", "signal_type")
#: Cycles of a run, by the clock, and parts of a block on each level of the scan.
RUN = 64
FAN = 1024
LEVELS = 2


CLEAN, BAD, BETWEEN = 0, 1, 2


def machine(settings: Settings = PRODUCTION) -> list[tuple[str, int, int, int, int]]:
    """States in order, as (name, counter, next on clean, next on anomaly, next in between).

    ``fire_after`` anomalous cycles in a row open an alert and ``resolve_after`` clean ones close
    it.  With ``compat_resolving`` an anomaly in the last resolving step closes the alert too,
    instead of going back to firing.  A cycle between the clear and the fire threshold is clean
    for a closed alert and anomalous for an open one.
    """
    pend = max(settings.fire_after - 1, 0)
    res = max(settings.resolve_after - 1, 0)
    firing = 1 + pend
    states = [("ok", 0, 0, 1)]
    for i in range(pend):
        states.append(("pending", i, 0, 1 + i + 1))
    states.append(("firing", 0, firing + 1 if res else 0, firing))
    for i in range(1, res + 1):
        on_clean = 0 if i == res else firing + i + 1
        on_bad = 0 if (settings.compat_resolving and i == res) else firing
        states.append(("resolving", i, on_clean, on_bad))
    return [(n, c, clean, bad, clean if n in ("ok", "pending") else bad) for n, c, clean, bad in states]


def symbol(settings: Settings = PRODUCTION, flag: str = "anomaly") -> Column:
    """Input of the machine for a cycle; the in-between level exists for latency scores only."""
    bad = F.coalesce(F.col(flag), F.lit(False))
    if settings.clear_threshold is None:
        return F.when(bad, BAD).otherwise(CLEAN)
    held = (F.col("signal_type") == "p99_ms") & (F.col("level") >= settings.clear_threshold)
    return F.when(bad, BAD).when(held, BETWEEN).otherwise(CLEAN)


def _step(states) -> Column:
    """Next-state arrays by input: clean, anomaly, in between."""
    return F.array(*[F.array(*[F.lit(s[2 + i]) for s in states]) for i in (CLEAN, BAD, BETWEEN)])


def _after(states, step: Column, before: Column, item: Column) -> Column:
    """State after a cycle, with the times when the incident began, fired and closed last."""
    firing = next(i for i, st in enumerate(states) if st[0] == "firing")
    code = F.get(F.get(step, item["_a"]), before["code"])
    return F.struct(
        code.alias("code"),
        F.when((before["code"] == 0) & (code != 0), item["_t"]).otherwise(before["began"]).alias("began"),
        F.when((before["code"] < firing) & (code == firing), item["_t"]).otherwise(before["fired"]).alias("fired"),
        F.when((before["code"] != 0) & (code == 0), item["_t"]).otherwise(before["closed"]).alias("closed"),
    )


def _applied(function: Column, before: Column) -> Column:
    """State after the cycles that ``function`` (an end for each start state) stands for."""
    end = F.get(function, before["code"])
    return F.struct(end["code"].alias("code"), *[F.coalesce(end[c], before[c]).alias(c) for c in ("began", "fired", "closed")])


def _start(code, kind: str) -> Column:
    return F.struct(F.lit(code).cast("int").alias("code"), *[F.lit(None).cast(kind).alias(c) for c in ("began", "fired", "closed")])


def _entries(parts: DataFrame, key: Sequence[str], states, kind: str, levels: int) -> DataFrame:
    """(key, _pos, _entry): the state before each part, for parts (key, _pos, _map) in the order of _pos.

    Parts are combined to blocks of ``FAN``, the blocks' entries are found in the same way, and each block hands its own on.
    """
    key = list(key)
    listed = F.sort_array(F.collect_list(F.struct("_pos", "_map"))).alias("_parts")
    if not levels:
        blocks = parts.groupBy(*key).agg(listed).withColumn("_entry", _start(0, kind))
    else:
        grouped = parts.groupBy(*key, F.floor(F.col("_pos") / FAN).cast("long").alias("_up")).agg(listed)
        every = F.array(*[_start(i, kind) for i in range(len(states))])
        whole = F.aggregate("_parts", every, lambda f, p: F.transform(f, lambda s: _applied(p["_map"], s)))
        above = _entries(grouped.select(*key, F.col("_up").alias("_pos"), whole.alias("_map")), key, states, kind, levels - 1)
        blocks = grouped.join(above.withColumnRenamed("_pos", "_up"), [*key, "_up"])
    before = F.aggregate("_parts", F.array("_entry"), lambda acc, p: F.array_append(acc, _applied(p["_map"], F.element_at(acc, -1))))
    return blocks.select(*key, F.explode(F.arrays_zip(F.col("_parts._pos").alias("_pos"), before.alias("_entry"))).alias("_z")).select(
        *key, "_z._pos", "_z._entry"
    ).where(F.col("_pos").isNotNull())


def fold_states(
    rows: DataFrame, settings: Settings = PRODUCTION, key: Sequence[str] = KEY,
    time: str = "time", flag: str = "anomaly",
) -> DataFrame:
    """Add ``prev_code`` and ``code``, the state before and after each cycle, and ``_began``, ``_fired`` and ``_closed``: when
    the incident last began, fired and closed.

    A run holds the cycles of 64 cycle lengths by the clock, so no task needs a whole signal and nothing is sorted globally. Each run
    is folded from every possible start state; the functions are scanned in blocks of ``FAN``, whatever the
    length of the history. Cycles at the same time are taken clean ones first; cycles without a time come before all others.
    """
    key = list(key)
    states = machine(settings)
    step, kind = _step(states), rows.schema[time].dataType.simpleString()
    run = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / F.lit(RUN * settings.cycle_seconds)).cast("long")
    item = F.struct(
        F.col(time).alias("_t"), symbol(settings, flag).alias("_a"),
        F.struct(*[c for c in rows.columns if c not in key]).alias("_row"),
    )
    placed = rows.withColumn("_pos", F.coalesce(run, F.lit(-(1 << 40))))
    runs = placed.groupBy(*key, "_pos").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    every = F.array(*[_start(i, kind) for i in range(len(states))])
    ends = F.aggregate("_items", every, lambda f, x: F.transform(f, lambda s: _after(states, step, s, x)))
    # written: read once for the scan and once for the states inside the runs
    runs = stored(runs.withColumn("_map", ends), "runs")
    entries = _entries(runs.select(*key, "_pos", "_map"), key, states, kind, LEVELS)
    known = runs.select(*key, "_pos", "_items").join(entries, [*key, "_pos"])
    inside = F.aggregate("_items", F.array("_entry"), lambda acc, x: F.array_append(acc, _after(states, step, F.element_at(acc, -1), x)))
    out = known.withColumn("_codes", inside).select(*key, F.posexplode("_items").alias("_i", "_item"), "_codes")
    after = F.get(F.col("_codes"), F.col("_i") + 1)
    return out.select(
        *key, "_item._row.*", F.get(F.col("_codes"), F.col("_i"))["code"].alias("prev_code"), after["code"].alias("code"),
        *[after[c].alias(f"_{c}") for c in ("began", "fired", "closed")],
    )


def _name(states, code) -> Column:
    return F.get(F.array(*[F.lit(s[0]) for s in states]), col(code))


def _count(states, code, state: str) -> Column:
    return F.get(F.array(*[F.lit(s[1] if s[0] == state else 0) for s in states]), col(code))


def alert_log(
    signals: DataFrame, settings: Settings = PRODUCTION, key: Sequence[str] = KEY, time: str = "time"
) -> DataFrame:
    """Every cycle of every signal with its alert state, counters and times.

    pending_since is the first anomalous cycle of the incident, opened_at the cycle that fired,
    resolved_at the cycle that closed it (kept until the next incident starts).
    """
    states = machine(settings)
    rows = fold_states(signals, settings, key, time)
    rows = (
        rows.withColumn("prev_state", _name(states, "prev_code"))
        .withColumn("state", _name(states, "code"))
        .withColumn("pending_count", _count(states, "code", "pending"))
        .withColumn("resolving_count", _count(states, "code", "resolving"))
    )
    state = F.col("state")
    return (
        rows.withColumn("pending_since", F.when(state != "ok", F.col("_began")))
        .withColumn("opened_at", F.when(F.col("_fired") >= F.col("_began"), F.col("_fired")))
        .withColumn("resolved_at", F.when(state == "ok", F.col("_closed")))
        .withColumn("episode_start", F.col("_began"))
        .drop("_began", "_fired", "_closed", "prev_code", "code")
    )


def current_alerts(log: DataFrame, key: Sequence[str] = KEY, time: str = "time") -> DataFrame:
    """Newest state of every signal that ever left OK; a mergeable latest-by-key.

    Score, raw value, severity and layer are those of the last anomalous cycle: clean cycles move the state on but do not
    wipe what the alert was about.
    """
    evidence = ["score", "raw_value", "severity", "layer"]
    rest = [c for c in log.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.col(time))
    bad = F.when(F.coalesce(F.col("anomaly"), F.lit(False)), F.col(time))
    kept = F.coalesce(F.col("_e"), F.struct(*[F.col(f"_n.{c}").alias(c) for c in evidence]))
    return (
        log.groupBy(*key)
        .agg(newest.alias("_n"), F.max_by(F.struct(*evidence), bad).alias("_e"), F.max("episode_start").alias("_seen"))
        .where(F.col("_seen").isNotNull())
        .select(*key, *[(kept[c] if c in evidence else F.col(f"_n.{c}")).alias(c) for c in rest])
        .withColumnRenamed(time, "updated_at")
    )


def upsert_current(old: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """New rows replace old rows of the same signal; one that saw no anomaly keeps what the old row says about it."""
    evidence = ["score", "raw_value", "severity", "layer"]
    before = old.select(*key, F.struct(*evidence).alias("_e"))
    kept = F.when(F.col("severity").isNull(), F.col("_e"))
    merged = new.join(before, list(key), "left").select(
        *[(F.when(kept.isNotNull(), kept[c]).otherwise(F.col(c))).alias(c) if c in evidence else F.col(c) for c in new.columns]
    )
    return old.join(new.select(*key), list(key), "left_anti").unionByName(merged)


def transitions(log: DataFrame) -> DataFrame:
    return log.where(~F.col("state").eqNullSafe(F.col("prev_state")))


def alert_history(log: DataFrame) -> DataFrame:
    """A row whenever a signal becomes firing, also when it comes back from resolving."""
    return log.where(
        (F.col("state") == "firing") & ~F.col("prev_state").eqNullSafe(F.lit("firing"))
    )


def newly_fired(log: DataFrame) -> DataFrame:
    """Transitions that notify: firing for the first time in an incident."""
    return alert_history(log).where(F.col("prev_state").isin("ok", "pending"))


def episodes(log: DataFrame, key: Sequence[str] = KEY, time: str = "time") -> DataFrame:
    """One row per fired incident: begin, opening, end (null while open), peak and last values."""
    inside = log.where(F.col("opened_at").isNotNull())
    first = F.min_by(F.struct("severity", "score", "raw_value", "layer"),
                     F.when(F.col(time) == F.col("opened_at"), F.col(time)))
    return (
        inside.groupBy(*key, "opened_at")
        .agg(
            F.max("service").alias("service"),
            F.min("episode_start").alias("pending_since"),
            F.min("resolved_at").alias("resolved_at"),
            F.max("score").alias("peak_score"),
            F.max_by("state", time).alias("state"),
            first.alias("_f"),
        )
        .select(
            F.sha2(
                F.concat_ws("|", *key, F.unix_micros("opened_at").cast("string")), 256
            ).alias("alert_id"),
            *key, "service", "pending_since", "opened_at", "resolved_at", "state", "peak_score",
            "_f.severity", "_f.score", "_f.raw_value", "_f.layer",
        )
    )


def consecutive_onsets(
    rows: DataFrame, flag: str, m: int, key: Sequence[str] = ("endpoint_id",), time: str = "time"
) -> Column:
    """True at the m-th consecutive true cycle of a run; looks back m rows only."""
    order = W.partitionBy(*key).orderBy(time)
    recent = order.rowsBetween(-(m - 1), 0)
    hit = (F.sum(F.col(flag).cast("int")).over(recent) == m)
    before = F.coalesce(F.lag(F.col(flag), m).over(order), F.lit(False))
    return hit & ~before


def state_audit(stored: DataFrame, decided: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Signals whose stored state differs from the decided one; a missing row counts as OK."""
    s = stored.select(*key, F.col("state").alias("stored_state"))
    d = decided.select(*key, F.col("state").alias("decided_state"))
    both = d.join(s, list(key), "left").withColumn(
        "stored_state", F.coalesce("stored_state", F.lit("absent"))
    )
    fine = (F.col("stored_state") == F.col("decided_state")) | (
        (F.col("stored_state") == "absent") & (F.col("decided_state") == "ok")
    )
    return both.where(~fine)


def not_at_rest(current: DataFrame, signal: str = "error_rate_5xx") -> DataFrame:
    return current.where(
        (F.col("signal_type") == signal)
        & (F.col("state").isin("firing", "pending", "resolving") | (F.col("pending_count") > 0))
    )


def silence(fired: DataFrame, silences: DataFrame, time: str = "opened_at", bucket_seconds: int = 3600) -> DataFrame:
    """Firings outside every silence window (endpoint_id, silent_from, silent_to)."""
    from .joins import interval_join

    return interval_join(
        fired, silences.select("endpoint_id", "silent_from", "silent_to"),
        time, "silent_from", "silent_to", ["endpoint_id"], "left_anti", bucket_seconds,
    )


def escalations(log: DataFrame, key: Sequence[str] = KEY, time: str = "time") -> DataFrame:
    """Firing cycles of an incident whose severity is above every earlier one of that incident."""
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    w = (
        W.partitionBy(*key, "opened_at").orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    )
    firing = log.where((F.col("state") == "firing") & F.col("opened_at").isNotNull())
    return (
        firing.withColumn("_rank", rank)
        .withColumn("_before", F.max("_rank").over(w))
        .where(F.col("_rank") > F.col("_before"))
        .drop("_rank", "_before")
    )
