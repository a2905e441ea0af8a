"""Pace and readiness of collecting past and coming days, as columns over progress tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_where, half_up

# Batches by phase, and calls an hour by mode (a safe one calls every five minutes, the others every two).
PHASE_BATCH, CALLS_PER_HOUR, EFFICIENCY, VENUES_PER_DAY, LEAST_DURATIONS = {1: 3, 2: 5, 3: 8}, {"SAFE": 12}, 0.8, 5, 5


def batch_size(phase: Column, mode: Column, errors: Column) -> Column:
    """Venue days of one call: more in later phases and in a hurry, fewer after errors, none while deferred."""
    base = F.when(phase >= 3, PHASE_BATCH[3]).when(phase >= 2, PHASE_BATCH[2]).otherwise(PHASE_BATCH[1])
    paced = F.when(mode == "TURBO", F.least(F.lit(10), half_up(base * 1.5))).when(mode == "SAFE", F.least(F.lit(3), base)).otherwise(base)
    slowed = F.when(errors >= 3, 1).when(errors >= 1, F.floor(paced / 2)).otherwise(paced)
    return F.when(mode == "DEFERRED", 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), slowed))).cast("long")


def with_eta(progress: DataFrame) -> DataFrame:
    """Adds ``batch_size``, ``venue_days_per_hour`` and ``remaining_days`` to ``phase, mode, errors, target_days, done_days, n_durations``; fewer than five durations give no estimate."""
    c = F.col
    out = progress.withColumn("batch_size", batch_size(c("phase"), c("mode"), c("errors")))
    calls = F.when(c("mode") == "SAFE", CALLS_PER_HOUR["SAFE"]).otherwise(30)
    out = out.withColumn("venue_days_per_hour", F.when(c("n_durations") >= LEAST_DURATIONS, half_up(F.round(c("batch_size") * calls * EFFICIENCY, 6))))
    hours = F.greatest(c("target_days") - c("done_days"), F.lit(0)) * VENUES_PER_DAY / F.when(c("venue_days_per_hour") > 0, c("venue_days_per_hour"))
    return out.withColumn("remaining_days", F.ceil(hours / 24))


def readiness(races: DataFrame, venue: list[str]) -> DataFrame:
    """State of each venue day from its races' flags ``all_boats, core, evaluated, structured, pre, warmed_up, odds, final`` and ``expected``.

    Everything before the day must be whole for all expected races, then the
    day's own steps: WAITING, PRE_RACE_COMPLETE, COMPLETE.
    """
    flags = ["all_boats", "core", "evaluated", "structured", "pre", "warmed_up", "odds", "final"]
    per = races.groupBy(*venue).agg(F.max("expected").alias("expected"), F.count(F.lit(1)).alias("races"), *[count_where(F.col(f)).alias(f"n_{f}") for f in flags])
    whole = lambda names: F.forall(F.array(*[F.col(f"n_{f}") for f in names]), lambda n: n == F.col("expected")) & (F.col("expected") > 0)
    before = whole(flags[:5]) & (F.col("races") == F.col("expected"))
    status = F.when(before & whole(flags[5:]), "COMPLETE").when(before, "PRE_RACE_COMPLETE").otherwise("WAITING")
    return per.select(*venue, "expected", "races", *[f"n_{f}" for f in flags], status.alias("status"))


def due(deadline: Column, now: Column, unresolved: Column, short: Column, minutes: dict[str, int], grace: int = 1) -> Column:
    """What a race calls for at ``now``, as an array of works.

    ``exhibition``, ``final`` and ``scratch_guard`` in the minutes before the
    deadline, ``urgent_entries`` there for races ``short`` of boats (on the deadline
    still), and ``result`` from ``grace`` minutes after it while it is ``unresolved``.  A
    race without a deadline calls for nothing.
    """
    left = (F.unix_micros(deadline) - F.unix_micros(now)) / 60e6
    tests = {w: (left > 0) & (left <= minutes[w]) for w in ("exhibition", "final", "scratch_guard")}
    tests |= {"urgent_entries": short & (left >= 0) & (left <= minutes["urgent_entries"]), "result": unresolved & (left <= -grace)}
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
