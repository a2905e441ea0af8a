"""Racer evaluation: statistics per course and period, term profiles, period scores, race structure."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions.numbers import count_where
from ..functions.text import is_false_start, is_late_start, period_starts, start_timing

# Weights of the latest six terms and of the evaluation periods.
TERM_WEIGHTS = (0.34, 0.24, 0.16, 0.11, 0.08, 0.07)
PERIOD_WEIGHTS = {"6m": 0.5, "1y": 0.3, "3y": 0.2}


def course_stats(entries: DataFrame, *more: str) -> DataFrame:
    """Per racer and course: finishes, means, population deviation, timing; one map-side combined aggregation."""
    sums = entries.where(F.col("course").between(1, 6)).groupBy("registration_number", "course", *more).agg(
        F.count(F.lit(1)).alias("race_count"),
        *[count_where(F.col("finish_order") == i).alias(f"f{i}") for i in range(1, 7)],
        F.avg("finish_order").alias("avg_finish"),
        F.stddev_pop("finish_order").alias("std_finish"),
        # timings are decimals: their exact sum keeps a mean that ends in a half from falling to either side
        (F.sum(start_timing("start_timing").cast("decimal(9,6)")).cast("double") / F.count(start_timing("start_timing"))).alias("avg_st"),
        count_where(is_false_start("start_timing")).alias("f_count"),
        count_where(is_late_start("start_timing")).alias("l_count"),
    )
    n = F.col("race_count")
    return sums.withColumns({"win_rate": F.col("f1") / n, "second_rate": F.col("f2") / n, "third_rate": F.col("f3") / n, "top2_rate": (F.col("f1") + F.col("f2")) / n, "top3_rate": (F.col("f1") + F.col("f2") + F.col("f3")) / n})


MEANS = ["win_rate", "second_rate", "third_rate", "top2_rate", "top3_rate", "avg_finish", "avg_st", "std_finish"]


def over_courses(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Courses of a group together: means weighted by races (a missing one counts as 0), sums of counts."""
    n = F.sum("race_count")
    return stats.groupBy(*keys).agg(n.alias("race_count"), *[(F.sum(F.coalesce(c, F.lit(0.0)) * F.col("race_count")) / n).alias(c) for c in MEANS], F.sum("f_count").alias("f_count"), F.sum("l_count").alias("l_count"))


def in_periods(entries: DataFrame, day: Column, date: str = "race_date") -> DataFrame:
    """Each row once for every period up to ``day`` that holds it: at most three rows."""
    starts = period_starts(day)
    own = F.array_compact(F.array(*[F.when(F.col(date) >= s, F.lit(p)) for p, s in starts.items()]))
    return entries.where(F.col(date) <= day).withColumn("period", F.explode(own))


def _weighted(value: Column, first: int, last: int) -> Column:
    """Weighted mean over terms ``first`` to ``last``, the weights starting anew, over terms that have the value."""
    weight = F.element_at(F.array(*map(F.lit, TERM_WEIGHTS)), F.col("place") - (first - 1))
    here = F.col("place").between(first, last) & value.isNotNull()
    w = F.sum(F.when(here, weight))
    return F.when(w > 0, F.sum(F.when(here, value * weight)) / F.when(w > 0, w))


def term_profile(terms: DataFrame) -> DataFrame:
    """Weighted profile over a racer's latest six terms, and the trend of the last two against the four before."""
    from ..operators.ranking import first_n

    own = first_n(terms, ["registration_number"], 6, F.col("term_no").desc())
    share = lambda c: F.when(F.col("race_count") > 0, F.col(c) / F.when(F.col("race_count") > 0, F.col("race_count")) * 100)
    win, ability = F.col("win_rate"), F.col("ability_index")
    trend = lambda v: F.coalesce(_weighted(v, 1, 2) - _weighted(v, 3, 6), F.lit(0.0))
    return own.groupBy("registration_number").agg(
        F.count(F.lit(1)).alias("terms"), _weighted(win, 1, 6).alias("win_rate"), _weighted(ability, 1, 6).alias("ability"), _weighted(share("first_place_count"), 1, 6).alias("first_rate"), _weighted(share("second_place_count"), 1, 6).alias("second_rate"),
        _weighted(F.col("average_start_timing"), 1, 6).alias("avg_st"), trend(win).alias("win_trend"), trend(ability).alias("ability_trend"),
    )


def _shrunk(score: Column, n: Column, least: int) -> Column:
    """A raw score drawn towards 50 for small samples, rounded and held to 0..100; the ninth digit goes first, so that the order of sums does not show."""
    return num.score(F.round(50 + (score - 50) * F.least(F.lit(1.0), n / least), 9))


def in_strength(s: Column) -> Column:
    """Strength in course 1 from a struct of its statistics."""
    st = s["avg_st"]
    timing = F.when(st < 0.10, 10).when(st < 0.13, 7).when(st < 0.16, 5).when(st < 0.20, 2).otherwise(0)
    raw = 40 + s["win_rate"] * 60 + (s["top2_rate"] - s["win_rate"]) * 30 + timing + F.least(F.lit(10.0), s["top3_rate"] * 20) - s["f_count"] * 2 - s["l_count"]
    return F.when(s["race_count"] > 0, _shrunk(raw, s["race_count"], 30))


def mid_second(s: Column) -> Column:
    finish, win = s["avg_finish"], s["win_rate"]
    raw = 30 + s["second_rate"] * 80 + (s["top2_rate"] - s["second_rate"] - win) * 30 - F.when(win > 0.15, (win - 0.15) * 200).otherwise(0.0) + F.when(finish < 2.5, 5).when(finish < 3.0, 3).otherwise(0)
    return F.when(s["race_count"] > 0, _shrunk(raw, s["race_count"], 30))


def mid_third(s: Column) -> Column:
    raw = 30 + s["third_rate"] * 80 + (s["top3_rate"] - s["third_rate"]) * 30 + F.when(s["avg_finish"] < 3.0, 5).otherwise(0)
    return F.when(s["race_count"] > 0, _shrunk(raw, s["race_count"], 30))


def outside_third(s: Column) -> Column:
    finish = s["avg_finish"]
    raw = 25 + s["third_rate"] * 100 + (s["top3_rate"] - s["third_rate"]) * 30 + F.when(finish < 3.5, 10).when(finish < 4.0, 7).when(finish < 4.5, 3).otherwise(0) + F.when(s["avg_st"] < 0.15, 5).otherwise(0)
    return F.when(s["race_count"] > 0, _shrunk(raw, s["race_count"], 20))


def outside_second(s: Column) -> Column:
    finish = s["avg_finish"]
    raw = 20 + s["second_rate"] * 120 + (s["top2_rate"] - s["second_rate"]) * 30 + F.when(finish < 3.5, 10).when(finish < 4.0, 5).otherwise(0)
    return F.when(s["race_count"] > 0, _shrunk(raw, s["race_count"], 20))


SCORES = {"in_strength": ("1", in_strength), "mid_second": ("mid", mid_second), "mid_third": ("mid", mid_third), "outside_third": ("outer", outside_third), "outside_second": ("outer", outside_second)}


def period_scores(entries: DataFrame, day: Column) -> DataFrame:
    """Five scores per racer and period from course statistics grouped to course 1, 2-4 and 5-6, and their sample sizes."""
    per_course = course_stats(in_periods(entries, day), "period")
    zone = F.when(F.col("course") == 1, "1").when(F.col("course") <= 4, "mid").otherwise("outer")
    zones = over_courses(per_course.withColumn("zone", zone), ["registration_number", "period", "zone"])
    # means are compared with thresholds: the order of a sum must not decide
    zones = zones.withColumns({c: F.round(c, 9) for c in ("avg_finish", "avg_st")})
    wide = zones.groupBy("registration_number", "period").agg(*[F.first(F.when(F.col("zone") == z, F.struct("race_count", *MEANS, "f_count", "l_count")), ignorenulls=True).alias(f"z_{z}") for z in ("1", "mid", "outer")])
    return wide.select("registration_number", "period", *[f(F.col(f"z_{z}")).alias(n) for n, (z, f) in SCORES.items()], *[F.coalesce(F.col(f"z_{z}")["race_count"], F.lit(0)).alias(f"n_{z}") for z in ("1", "mid", "outer")])


def blended(scores: DataFrame) -> DataFrame:
    """Current scores: periods weighted .5/.3/.2, a small sample counting less, over periods that have the score."""
    out = []
    weight = F
    for p, w in PERIOD_WEIGHTS.items():
        weight = weight.when(F.col("period") == p, w)
    for name, (zone, _) in SCORES.items():
        n, least = F.col(f"n_{zone}"), 10 if name == "in_strength" else 8
        own = F.when(F.col(name).isNotNull(), weight * F.when(n >= least, 1.0).otherwise(F.greatest(F.lit(0.1), n / least)))
        out.append(num.score(F.round(F.when(F.sum(own) > 0, F.sum(F.col(name) * own) / F.sum(own)), 9)).alias(name))
    return scores.groupBy("registration_number").agg(*out)


# Kinds of racers, the score and least value of each, and the courses whose year must hold 20 races.
PLAYER_TYPES = {"IN_SPECIALIST": ("in_strength", 75, "n_1"), "MID_SECOND_SPECIALIST": ("mid_second", 70, "n_mid"), "MID_THIRD_SPECIALIST": ("mid_third", 70, "n_mid")}


def player_types(scores: DataFrame, entries: DataFrame, day: Column) -> DataFrame:
    """Current scores with ``player_types``, the kinds of racer that they and the last year's courses make."""
    year = in_periods(entries, day).where("period = '1y'")
    c = F.col("course")
    groups = {"1": c == 1, "mid": c.between(2, 4), "outer": c >= 5, "all": F.lit(True)}
    n = lambda test: F.sum(F.when(test, F.col("race_count")))
    mean = lambda test, x: F.sum(F.when(test, F.coalesce(x, F.lit(0.0)) * F.col("race_count"))) / n(test)
    per = course_stats(year).groupBy("registration_number").agg(*[n(t).alias(f"n_{g}") for g, t in groups.items()], (F.sum(F.when(groups["outer"], F.col("f1"))) / n(groups["outer"])).alias("w_outer"), mean(groups["all"], F.col("std_finish")).alias("std_all"))
    both = scores.join(per, "registration_number", "left")
    kinds = [F.when((F.col(s) >= least) & (F.col(count) >= 20), name) for name, (s, least, count) in PLAYER_TYPES.items()]
    kinds += [
        F.when((F.col("outside_third") >= 65) & (F.coalesce("outside_second", F.lit(0)) < 55), "UICHI_OUTSIDE_SPECIALIST"), F.when(F.col("outside_second") >= 65, "URA_UICHI_OUTSIDE_SPECIALIST"),
        F.when((F.col("w_outer") > 0.08) & (F.col("n_outer") >= 20), "OUTSIDE_DANGER"), F.when((F.round("std_all", 9) > 1.8) & (F.col("n_all") >= 20), "UNSTABLE"),
    ]
    return both.select(*scores.columns, F.array_compact(F.array(*kinds)).alias("player_types"))


def race_structure(boats: DataFrame) -> DataFrame:
    """Two structure indices per race from the six boats' evaluations (``boat_number``, the five scores and ``player_types``)."""
    c = F.col
    inner, outer = c("boat_number").between(2, 4), c("boat_number") >= 5
    best = lambda x, test: F.coalesce(F.max(F.when(test, c(x))), F.lit(50))
    kind = lambda name, test: count_where(test & F.array_contains("player_types", name))
    sums = boats.groupBy("race_id").agg(
        best("in_strength", c("boat_number") == 1).alias("s"), best("mid_second", inner).alias("m2"), best("outside_third", outer).alias("o3"), best("outside_second", outer).alias("o2"), best("mid_third", inner).alias("m3"),
        kind("OUTSIDE_DANGER", outer).alias("danger"), kind("UNSTABLE", inner).alias("unstable"),
    )
    main = c("s") * 0.4 + c("m2") * 0.3 + c("o3") * 0.3 - c("danger") * 5 - c("unstable") * 3 - F.when(c("m2") < 60, 10).otherwise(0) - F.when(c("o3") < 55, 10).otherwise(0)
    ura = c("s") * 0.4 + c("o2") * 0.35 + c("m3") * 0.25 - F.when(c("o2") < 55, 15).otherwise(0) - F.when(c("m3") < 55, 10).otherwise(0)
    return sums.select("race_id", num.score(F.round(main, 9)).alias("main_structure"), num.score(F.round(ura, 9)).alias("ura_structure"))


def best_course(stats: DataFrame) -> DataFrame:
    """Per racer the course of the best rate over periods (first places in 1, first two in 2-4, first three beyond)."""
    c = F.col("course")
    suits = F.round(F.when(c == 1, F.col("win_rate") * 100).when(c <= 4, F.col("top2_rate") * 80).otherwise(F.col("top3_rate") * 100), 9)
    turn = F
    for i, p in enumerate(PERIOD_WEIGHTS):
        turn = turn.when(F.col("period") == p, -i)
    return stats.groupBy("registration_number").agg(F.max(F.struct(suits.alias("s"), turn.alias("p"), (-c).alias("c"))).alias("b")).select("registration_number", (-F.col("b.c")).alias("best_course"))


# Points of a finish, and what a lane adds to a good and to a bad one; gains of a start against the field.
FINISH_POINTS = (8, 5, 2, -1, -4, -7)
LANE_GOOD, LANE_BAD = (-1.5, -0.5, 0.0, 1.0, 2.0, 3.0), (-3.0, -2.0, -1.0, 0.0, 0.5, 1.0)
SERIES_LABELS = (("HOT", 75), ("UP", 60), ("NEUTRAL", 42), ("DOWN", 28))


def series_scores(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Form over a series from ``lane, finish, adv`` (hundredths of a second gained on the field at the start) of each race.

    The mean over all races counts 70 %, that of the last three 30 %; few races
    draw the score to 50.  Only a race's place from the end needs its key's order.
    """
    from pyspark.sql import Window

    pick = lambda values, i: F.element_at(F.array(*[F.lit(float(v)) for v in values]), i)
    lane, finish, adv = F.col("lane").cast("int"), F.col("finish").cast("int"), F.col("adv")
    start = F.when(adv >= 5, 1.25).when(adv >= 3, 0.75).when(adv <= -5, -1.0).when(adv <= -3, -0.5).otherwise(0.0)
    delta = pick(FINISH_POINTS, finish) + F.when(finish <= 3, pick(LANE_GOOD, lane)).otherwise(pick(LANE_BAD, lane)) + start
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    own = history.where(lane.between(1, 6) & finish.between(1, 6)).withColumns({"delta": delta, "back": back})
    last = F.when(F.col("back") <= 3, num.half_up("delta", 1))
    per = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("m"), F.avg(last).alias("r"), count_where(F.col("lane") <= 3).alias("inner_lanes"))
    raw = num.clamp(num.clamp(50 + F.col("m") * 5, 0, 100) * 0.7 + num.clamp(50 + F.col("r") * 5, 0, 100) * 0.3, 0, 100)
    s = F.round(50 + (raw - 50) * (F.col("n") / (F.col("n") + 2)), 9)
    label = F
    for name, least in SERIES_LABELS:
        label = label.when(F.col("s") >= least, name)
    return per.withColumn("s", s).select(*keys, "n", num.half_up("s", 1).alias("series_score"), label.otherwise("COLD").alias("series_label"), "inner_lanes")


def from_term(terms: DataFrame, scale: float = 100.0) -> dict[str, Column]:
    """Strength inside and for second place from a half-year record, for racers without results.

    The rates are told as shares; ``scale`` turns them to percent.  False starts and late
    starts of the term take ten points at most.
    """
    c = F.col
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    st = c("average_start_timing")
    faults = F.least(F.lit(10.0), zero("start_accident_count") * 0.1 + zero("late_count") * 0.05)
    inside = 40 + zero("win_rate") * scale * 0.6 + F.when(st < 0.15, 5).when(st < 0.20, 2).otherwise(0) - faults
    return {"in_strength": num.score(inside), "mid_second": num.score(30 + zero("top2_rate") * scale * 0.5)}
