"""Scores of one race, as column expressions over a wide row with a struct per boat.

Sub-scores are rounded where the rules round them, so that totals agree digit for
digit; every expression stays inside generated code.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import clamp, half_up, peak_and_mean, score, total

# Strength of the racer classes.
GRADES = {"A1": 1.0, "A2": 0.85, "B1": 0.65, "B2": 0.45}


# Text fields of boats with their possible values; they travel through the aggregation as numbers.
CODES = {"grade_class": ("A1", "A2", "B1", "B2")}


def wide(entries: DataFrame, key: str = "race_id") -> DataFrame:
    """One row per race with structs ``b1`` to ``b6``, whose field ``here`` is null where a boat is missing (see :func:`missing`).

    One hash aggregation on the race: every field of every boat is a maximum of
    fixed width, which text would not be, so coded texts go as numbers (one that is
    not listed comes back as ``OTHER``).  A boat that occurs twice gets the greater
    value of each field.
    """
    rest = [c for c in entries.columns if c not in (key, "boat_number")]
    coded = [c for c in rest if c in CODES]
    numbers = entries.withColumns({c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.array_position(F.array(*map(F.lit, CODES[c])), F.upper(c)).cast("int")) for c in coded})
    # the structs are never null themselves: the optimiser then reads their fields as plain columns
    here = [F.max(F.when(F.col("boat_number") == n, F.lit(1))).alias(f"_{n}") for n in range(1, 7)]
    best = numbers.groupBy(key).agg(*here, *[F.max(F.when(F.col("boat_number") == n, F.col(c))).alias(f"_{n}_{c}") for n in range(1, 7) for c in rest])

    def field(n: int, c: str) -> Column:
        value = F.col(f"_{n}_{c}")
        if c in coded:
            value = F.when(value > 0, F.element_at(F.array(*map(F.lit, CODES[c])), F.greatest(value, F.lit(1)))).when(value == 0, "OTHER")
        return value.alias(c)

    return best.select(key, *[F.struct(F.col(f"_{n}").alias("here"), *[field(n, c) for c in rest]).alias(f"b{n}") for n in range(1, 7)])


def missing(b: Column) -> Column:
    return b["here"].isNull()


def boat(n: int) -> Column:
    return F.col(f"b{n}")


def zero(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def part(x: Column, most: float, points: float) -> Column:
    """``points`` times the share of ``x`` in ``most``, held to 0..1."""
    return clamp(x / most, 0, 1) * points


def grade_points(grade: Column) -> Column:
    out = F.when(grade.isNull() | (grade == ""), F.lit(None).cast("double"))
    for name, value in GRADES.items():
        out = out.when(F.upper(grade) == name, value)
    return out.otherwise(0.5)


def boat1_grade(b: Column) -> Column:
    """S, A, B, C or D for the boat in lane 1."""
    points = part(zero(b["national_win_rate"]), 8, 30) + part(zero(b["local_win_rate"]), 8, 20) + part(zero(b["c1_win_rate"]), 70, 25)
    points = points + part(0.25 - F.coalesce(F.nullif(b["avg_st"], F.lit(0.0)), F.lit(0.25)), 0.15, 15) - F.when(zero(b["f_count"]) > 0, 10).otherwise(0)
    points = points + F.when(zero(b["exhibition_time"]) > 0, part(6.6 - b["exhibition_time"], 0.6, 10)).otherwise(0.0)
    return F.when(missing(b), "D").when(points >= 80, "S").when(points >= 65, "A").when(points >= 50, "B").when(points >= 35, "C").otherwise("D")


def outer_score(b: Column) -> Column:
    """How likely a boat in lane 5 or 6 takes third place: each item rounded on its own."""
    items = [
        half_up(grade_points(b["grade_class"]) * 15),
        half_up(part(b["national_3rate"], 65, 25)),
        half_up(part(b["local_3rate"], 65, 20)),
        half_up(part(b["motor_3rate"], 60, 20)),
        half_up(part(b["motor_2rate"], 45, 10)),
        F.when(b["avg_st"] > 0, half_up(part(0.23 - b["avg_st"], 0.15, 10))),
    ]
    return score(total([F.coalesce(x, F.lit(0)) for x in items]))


def outer_potential() -> dict[str, Column]:
    s5, s6 = outer_score(boat(5)), outer_score(boat(6))
    return {"boat5_score": s5, "boat6_score": s6, "outer_score": F.greatest(s5, s6), "outer_boat": F.when(s6 > s5, 6).otherwise(5)}


def base_strength(b: Column) -> Column:
    return F.when(missing(b), F.lit(0).cast("long")).otherwise(score(F.coalesce(grade_points(b["grade_class"]), F.lit(0.5)) * 55 + part(zero(b["national_win_rate"]), 8, 30) + part(zero(b["national_2rate"]), 60, 15)))


def _mean(xs: list[Column]) -> Column:
    return total(xs) / len(xs)


def program_intent(races: DataFrame, main_rate: str, ura_rate: str, n: str) -> DataFrame:
    """What the programme of each race aims at: lane placement, strength and the habit of the venue and race number.

    Adds ``main_intent``, ``ura_intent``, ``hypothesis``, ``intent_confidence`` and
    ``axis_placement``.  Each stage is a projection of its own, so that no
    sub-score is computed twice within one expression.
    """
    c = F.col
    out = races.withColumns({f"_s{i}": base_strength(boat(i)) for i in range(1, 7)})
    s = [c(f"_s{i}") for i in range(1, 7)]
    habit = clamp((c(main_rate) - c(ura_rate)) * 420 * clamp(c(n) / (c(n) + 120), 0, 0.7), -24, 24)
    out = out.withColumns({"_mid": _mean(s[1:4]), "_outer": _mean(s[4:]), "_others": _mean(s[1:]), "_peak": F.greatest(s[4], s[5]), "_habit": habit})
    out = out.withColumns({
        "_axis": clamp(45 + (c("_s1") - c("_others")) * 0.9, 0, 100),
        "_main": clamp(55 + (c("_mid") - c("_outer")) * 0.85 + F.greatest(F.lit(0.0), c("_peak") - 45.0) * 0.25, 0, 100),
        "_ura": clamp(45 + (c("_peak") - c("_mid")) * 1.15 + F.greatest(F.lit(0.0), c("_mid") - 45.0) * 0.30, 0, 100),
    })
    aim = lambda shape, own: half_up(clamp(c("_axis") * 0.35 + c(shape) * 0.50 + F.greatest(own, F.lit(0.0)), 0, 100))
    out = out.withColumns({"main_intent": aim("_main", c("_habit")), "ura_intent": aim("_ura", -c("_habit"))})
    gap = c("main_intent") - c("ura_intent")
    sure = half_up(clamp(F.abs(gap) * 2.4 + F.greatest("main_intent", "ura_intent") * 0.45 + F.abs("_habit") * 0.8, 0, 100))
    out = out.withColumns({"hypothesis": F.when(gap >= 10, "MAIN").when(gap <= -10, "URA").otherwise("NEUTRAL"), "intent_confidence": sure, "axis_placement": half_up(c("_axis"))})
    return out.drop(*[x for x in out.columns if x.startswith("_") and x not in races.columns])


def motor_support() -> dict[str, Column]:
    """Whether the motors back the aim of the programme."""
    two = lambda n: half_up(part(zero(boat(n)["motor_2rate"]), 50, 70) + part(zero(boat(n)["boat_2rate"]), 50, 30))
    three = lambda n: half_up(part(zero(boat(n)["motor_3rate"]), 65, 70) + part(zero(boat(n)["boat_3rate"]), 65, 30))
    own = half_up(two(1) * 0.70 + three(1) * 0.30)
    pool = lambda f, boats: peak_and_mean([f(n) for n in boats], 0.60, 0.40)
    return {
        "boat1_motor": own,
        "main_support": half_up(clamp(own * 0.35 + pool(two, (2, 3, 4)) * 0.35 + pool(three, (5, 6)) * 0.30, 0, 100)),
        "ura_support": half_up(clamp(own * 0.35 + pool(two, (5, 6)) * 0.38 + pool(three, (2, 3, 4)) * 0.27, 0, 100)),
    }


def rank_pressure(rank: Column, remaining: Column, day: Column, days: Column, cut: int = 18) -> Column:
    """How much is at stake near the qualifying cut."""
    d = rank - cut
    # Scores by distance from the cut.
    base = F.when(d <= -8, 25).when(d <= -4, 40).when(d <= 0, 75).when(d <= 3, 90).when(d <= 7, 75).otherwise(45)
    progress = F.when(days > 1, (day - 1) / F.when(days > 1, days - 1)).otherwise(0.0)
    return F.when(rank.isNull() | (rank < 1), 50.0).otherwise(half_up(clamp(base + progress * 8 + F.when(remaining <= 1, 5).otherwise(0), 0, 100), 1))


# Weights of the parts of the short trust score; per part, the fields with the value that counts in full and their points.
TRUST_WEIGHTS = {"basic": 20, "lane1": 20, "venue": 15, "st": 10, "motor": 10}
TRUST_FIELDS = {
    "basic": (("national_win_rate", 8, 50), ("national_2rate", 60, 20)),
    "lane1": (("c1_win_rate", 70, 60), ("c1_2rate", 90, 40)),
    "venue": (("local_win_rate", 8, 50), ("local_2rate", 60, 50)),
    "motor": (("motor_2rate", 50, 60), ("motor_3rate", 70, 40)),
}


def trust_lite(b: Column, weights: dict[str, int] | None = None) -> dict[str, Column]:
    """Trust in the boat of lane 1 from its entry alone: ``score, raw_score, max_possible, evaluated_count``.

    A part counts if one of its fields is there, and its fields share its weight; the
    score is the share of what the parts that count can give.  False starts take
    four points each, fifteen at most.
    """
    w = TRUST_WEIGHTS | (weights or {})
    parts = []
    for name, most in w.items():
        if name == "st":
            parts.append((b["avg_st"] > 0, half_up(clamp((0.25 - b["avg_st"]) / 0.20, 0, 1) * most), most))
            continue
        given = [(b[c].isNotNull(), part(b[c], full, points), points) for c, full, points in TRUST_FIELDS[name]]
        if name == "basic":
            grade = grade_points(b["grade_class"])
            given.append((grade.isNotNull(), grade * 30, 30))
        points = total([F.when(there, x).otherwise(F.lit(0.0)) for there, x, _ in given])
        share = total([F.when(there, F.lit(p)).otherwise(F.lit(0)) for there, _, p in given])
        parts.append((share > 0, half_up(points / F.when(share > 0, share) * most), most))
    sums = lambda value: total([F.when(there, value(x, most)).otherwise(F.lit(0)) for there, x, most in parts])
    faults = F.coalesce(b["f_count"].cast("int"), F.lit(0))
    raw = sums(lambda x, most: x) - F.when(faults > 0, F.least(faults * 4, F.lit(15))).otherwise(0)
    reach = sums(lambda x, most: F.lit(most))
    out = {"score": F.when(reach > 0, half_up(raw / F.when(reach > 0, reach) * 100)).otherwise(0), "raw_score": raw, "max_possible": reach, "evaluated_count": sums(lambda x, most: F.lit(1))}
    return {k: F.when(~missing(b), v.cast("long")) for k, v in out.items()}
