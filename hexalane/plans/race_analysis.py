"""The analysis of a race: what the programme aims at, whether racers and motors can carry it, and what a bet on it is worth.

A chain of projections over one wide row per race (structs ``b1`` to ``b6``) with
its looked-up statistics; nothing but the look-ups and the widening shuffles.
Each stage names its results, so that no sub-score is computed twice within one
expression and rounded scores go on as rounded.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions import patterns
from ..functions.kernels import boat, part, zero
from ..functions.numbers import clamp, half_up, peak_and_mean, rate, total

# Caps of the calibrated rates, thresholds of the buying gate and of the grades before the race.
RATE_CAP = {"MAIN": 0.45, "URA": 0.45, "NEW_MAIN": 0.45, "NEW_URA": 0.40}
LEAST_RACES, PRE_RATE, BUY_EV = 30, 20, 115
GATE_PROBABILITY = {"MAIN": 0.22, "URA": 0.22, "NEW_MAIN": 0.18, "NEW_URA": 0.18}
GATE_TRUST = {"MAIN": 68, "URA": 68, "NEW_MAIN": 68, "NEW_URA": 62}
GATE_MATCH, GATE_STRUCTURE = 60, 58
# Fields of a boat that the warm-up gate reads of all, and trust and the gate of lane 1, and the pattern rates of lane 2.
GATE_READS = ("warmup_time", "warmup_st", "is_scratched")
TRUST_READS = ("national_win_rate", "national_2rate", "grade_class", "c1_win_rate", "c1_2rate", "local_win_rate", "local_2rate", "avg_st", "motor_2rate", "motor_3rate", "f_count", "warmup_rank", "warmup_false_start", "entry_course")
PATTERN_READS = ("avg_st", "national_2rate", "local_2rate", "motor_2rate")


def _whole(x: Column) -> Column:
    return half_up(clamp(x, 0, 100))


def _of(field: str, values: dict) -> Column:
    """The value that belongs to the name in a column."""
    out = F
    for name, value in values.items():
        out = out.when(F.col(field) == name, value)
    return out


def with_racer_execution(races: DataFrame) -> DataFrame:
    """Whether the racers can carry out the main or the reverse scenario: latest terms first, then the programme's rates.

    Adds ``escape``, ``mid_second``, ``mid_third``, ``outer_second``,
    ``outer_third``, ``main_execution`` and ``ura_execution``.
    """

    def trend(b):
        return clamp(zero(b["term_ability_trend"]) * 1.2 + zero(b["term_win_trend"]) * 4, -8, 8)

    def risk(b):
        return clamp(zero(b["term_f"]) * 3 + zero(b["term_l"]) * 2, 0, 12)

    def grade(b, points):
        return F.coalesce(k.grade_points(b["grade_class"]), F.lit(0.5)) * points

    def term(b, *names):
        return F.coalesce(*[b[n].cast("double") if isinstance(n, str) else F.lit(float(n)) for n in names])

    def second(n):
        b = boat(n)
        points = grade(b, 10) + part(term(b, "term_course_top2", "term_top2", "national_2rate", 0), 60, 27) + part(term(b, "term_course_second", "term_second", 0), 25, 16)
        points = points + part(zero(b["local_2rate"]), 60, 12) + part(0.23 - term(b, "term_st", "avg_st", 0.23), 0.15, 14) + part(term(b, "term_ability", 50), 60, 13)
        points = points + part(zero(b["term_championship_entry"]), 8, 5) + trend(b) - risk(b)
        return F.when(~k.missing(b), points)

    def third(n):
        b = boat(n)
        points = grade(b, 8) + part(term(b, "term_course_top3", "term_top3", "national_3rate", 0), 70, 29) + part(term(b, "term_course_third", "term_third", 0), 25, 18)
        points = points + part(zero(b["local_3rate"]), 70, 11) + part(0.24 - term(b, "term_st", "avg_st", 0.24), 0.16, 12) + part(term(b, "term_ability", 50), 60, 12)
        points = points + part(zero(b["term_championship_entry"]), 8, 4) + trend(b) - risk(b) * 0.7
        return F.when(~k.missing(b), points)

    b = boat(1)
    clean = F.when(zero(b["f_count"]) == 0, 8).otherwise(0)
    first = F.coalesce(b["term_course_first"], b["term_first"])
    by_term = part(first, 35, 29) + part(term(b, "term_win", "national_win_rate", 0), 8, 18) + part(0.24 - term(b, "term_st", "avg_st", 0.24), 0.16, 16) + part(term(b, "term_ability", 50), 60, 14)
    by_term = by_term + grade(b, 10) + part(zero(b["term_championship_win"]), 3, 5) + trend(b) + clean - risk(b)
    st = F.coalesce(F.nullif(b["avg_st"], F.lit(0.0)), F.lit(0.24))
    direct = part(zero(b["c1_win_rate"]), 70, 36) + part(zero(b["national_win_rate"]), 8, 20) + part(zero(b["local_win_rate"]), 8, 18) + part(0.24 - st, 0.16, 18) + clean
    c = F.col
    places = [(f, n) for f in ("second", "third") for n in range(2, 7)]
    raw = {f"_{f}{n}": (second if f == "second" else third)(n) for f, n in places}
    out = races.withColumns(raw | {"_escape": F.when(b["c1_win_rate"].isNull() & first.isNotNull(), by_term).otherwise(direct)})
    out = out.withColumns({name: F.coalesce(_whole(c(name)), F.lit(0)) for name in raw} | {"escape": _whole(c("_escape"))})
    pool = lambda f, boats: peak_and_mean([c(f"_{f}{n}") for n in boats], 0.62, 0.38)
    out = out.withColumns({f"{zone}_{f}": pool(f, boats) for zone, boats in (("mid", (2, 3, 4)), ("outer", (5, 6))) for f in ("second", "third")})
    return out.withColumns({
        "main_execution": _whole(c("escape") * 0.40 + c("mid_second") * 0.32 + c("outer_third") * 0.28),
        "ura_execution": _whole(c("escape") * 0.40 + c("outer_second") * 0.34 + c("mid_third") * 0.26),
    }).drop("_escape", *raw)


def with_series_context(races: DataFrame) -> DataFrame:
    """What the series so far says: its mode, whether yesterday's state is in, and signals from placement and form.

    Reads ``race_name, race_phase, grade, series_day, race_date`` and each boat's
    ``series_*`` fields.
    """
    c = F.col
    b = boat(1)
    name, phase = F.coalesce("race_name", F.lit("")), F.coalesce("race_phase", F.lit("OTHER"))
    day = F.coalesce("series_day", F.lit(1))
    semi = name.contains("準優") | (phase == "SEMIFINAL")
    final = (name.contains("優勝") & ~semi) | (phase == "FINAL")
    general = name.contains("一般") | (F.coalesce("grade", F.lit("GENERAL")) == "GENERAL")
    mode = F.when(semi, "SEMIFINAL").when(final, "FINAL").when((day >= 6) & name.rlike("特選|選抜"), "SPECIAL_SELECTION").when((day >= 5) & general, "PROGRAM_GENERAL")
    mode = mode.when(day >= 4, "QUALIFYING_LATE").otherwise("QUALIFYING")
    runs = F.coalesce(b["series_runs"], F.lit(0))
    own = F.when(runs > 0, F.coalesce(b["series_score"], F.lit(50.0))).otherwise(50.0)

    def b2(n):
        return F.coalesce(boat(n)["grade_class"] == "B2", F.lit(False))

    def routine(n):
        x = boat(n)
        usual = (F.coalesce(x["series_runs"], F.lit(0)) >= 2) & (zero(x["series_avg_lane"]) >= 4.5) & (F.coalesce(x["series_inner_lanes"], F.lit(0)) == 0)
        return b2(n) & (F.coalesce(x["series_exclusion"], F.lit(False)) | usual)

    out = races.withColumns({
        "logic_mode": mode, "boat1_runs": runs, "boat1_series_score": own, "pressure": F.coalesce(b["series_pressure"], F.lit(50.0)),
        "snapshot_ready": (day <= 1) | F.coalesce(b["series_as_of"] == F.date_sub("race_date", 1), F.lit(False)),
        "routine_outer_exclusion": (F.coalesce("grade", F.lit("GENERAL")) == "GENERAL") & ((b2(5) & b2(6)) | routine(5) | routine(6)),
    })
    placed = c("logic_mode").isin("QUALIFYING", "QUALIFYING_LATE") & (c("pressure") >= 80) & ((zero(b["series_avg_lane"]) >= 3.3) | (F.coalesce(b["series_inner_lanes"], F.lit(0)) <= 1))
    held = c("logic_mode").isin("SEMIFINAL", "FINAL", "SPECIAL_SELECTION") | (c("boat1_runs") < 2)
    return out.withColumns({
        "placement_signal": placed, "weak_series": (c("boat1_runs") >= 2) & (c("boat1_series_score") < 35),
        "score_adjustment": F.when(held, 0.0).otherwise(clamp((c("boat1_series_score") - 50) * 0.20, -8, 8)),
    })


def with_direction(races: DataFrame) -> DataFrame:
    """Which of the two scenarios the programme, racers and motors point to, how strongly, and what breaks it.

    Needs the results of :func:`functions.kernels.program_intent`,
    :func:`with_racer_execution`, the motor support and :func:`with_series_context`.
    """
    c = F.col
    adjusted = c("boat1_runs") >= 2
    shift = lambda x, by: F.when(adjusted, _whole(c(x) + c("score_adjustment") * by)).otherwise(c(x))
    out = races.withColumns({"escape": shift("escape", 1.0), "main_execution": shift("main_execution", 0.7), "ura_execution": shift("ura_execution", 0.7)})
    suits = lambda side: _whole((c(f"{side}_intent") * 0.50 + c(f"{side}_execution") * 0.32 + c(f"{side}_support") * 0.18) * (0.55 + c(f"{side}_intent") / 220))
    out = out.withColumns({"main_suitability": suits("main"), "ura_suitability": suits("ura")})
    index = half_up(clamp((c("main_suitability") - c("ura_suitability")) * 2.6, -100, 100))
    neutral = c("hypothesis") == "NEUTRAL"
    out = out.withColumns({"direction_index": index})
    out = out.withColumns({"direction_index": F.when(neutral, half_up(c("direction_index") * 0.55)).otherwise(c("direction_index"))})
    side = lambda x: F.when(c("direction_index") >= 0, c(f"main_{x}")).otherwise(c(f"ura_{x}"))
    out = out.withColumns({"chosen_execution": side("execution"), "chosen_support": side("support")})
    broken = (c("escape") < 52) | (c("chosen_execution") < 52)
    out = out.withColumns({"scenario_status": F.when(neutral, "NEUTRAL").when(broken, "PLAYER_BREAK").when(c("chosen_support") < 38, "MOTOR_BREAK").otherwise("VALID")})
    # What a broken scenario costs in confidence, and how far it damps the direction.
    penalty = F.coalesce(_of("scenario_status", {"NEUTRAL": 25, "PLAYER_BREAK": 40, "MOTOR_BREAK": 22}).otherwise(0), F.lit(0))
    damping = _of("scenario_status", {"PLAYER_BREAK": 0.35, "MOTOR_BREAK": 0.72}).otherwise(1.0)
    bump = lambda x, by: F.when(c("placement_signal"), _whole(c(x) + by)).otherwise(c(x))
    out = out.withColumns({
        "direction_index": half_up(c("direction_index") * damping), "scenario_penalty": penalty,
        "axis_placement": bump("axis_placement", 8), "intent_confidence": bump("intent_confidence", 6), "main_intent": bump("main_intent", 4), "ura_intent": bump("ura_intent", 4),
    })
    out = out.withColumns({"direction_confidence": _whole(c("intent_confidence") * 0.50 + c("chosen_execution") * 0.32 + c("chosen_support") * 0.18 - c("scenario_penalty"))})
    i, sure = c("direction_index"), c("direction_confidence") >= 60
    label = F.when((i >= 60) & sure, "MAIN_STRONG").when(i >= 25, "MAIN_LEANING").when((i <= -60) & sure, "URA_STRONG").when(i <= -25, "URA_LEANING").otherwise("NEUTRAL")
    return out.withColumns({"direction_label": label})


def with_trust(races: DataFrame) -> DataFrame:
    """Trust in lane 1 from its own rates and its record at the venue, over all and in this weather; and the share of conditions met.

    Reads ``venue_rate, venue_races, overall_rate, overall_races, weather_rate,
    weather_races``; a part without data is left out of both sides of the rate.
    """
    c = F.col
    b = boat(1)

    def component(most: int, items: list[tuple[Column, float, float]]) -> tuple[Column, Column]:
        weight = total([F.when(x.isNotNull(), w).otherwise(0) for x, _, w in items])
        got = total([F.coalesce(part(x, top, w), F.lit(0.0)) for x, top, w in items])
        points = half_up(F.when(weight > 0, got / F.when(weight > 0, weight)).otherwise(0.0) * most)
        return F.when(weight > 0, points).otherwise(0), F.when(weight > 0, most).otherwise(0)

    at_venue, overall = F.when(c("venue_races") >= 5, c("venue_rate")), F.when(c("overall_races") >= 10, c("overall_rate"))
    # Maximum points and, per item, the value for full points and its weight.
    parts = [
        component(20, [(b["national_win_rate"], 8, 50), (b["national_2rate"], 60, 20), (k.grade_points(b["grade_class"]), 1, 30)]),
        component(20, [(at_venue, 0.7, 45), (F.when(at_venue.isNull(), overall), 0.7, 35), (b["c1_win_rate"], 70, 35), (b["c1_2rate"], 90, 20)]),
        component(15, [(b["local_win_rate"], 8, 50), (b["local_2rate"], 60, 50)]),
        component(10, [(F.when(b["avg_st"] > 0, 0.25 - b["avg_st"]), 0.20, 1)]),
        component(10, [(b["motor_2rate"], 50, 60), (b["motor_3rate"], 70, 40)]),
        component(10, [(F.when(c("weather_races") >= 5, c("weather_rate")), 0.7, 1)]),
    ]
    raw, most = total([p for p, _ in parts]) - F.least(zero(b["f_count"]) * 4, F.lit(15.0)), total([m for _, m in parts])
    checks = [
        at_venue >= 0.6, overall >= 0.55, b["national_win_rate"] >= 6.0, b["local_win_rate"] >= 6.0, F.when(b["avg_st"] > 0, b["avg_st"] <= 0.13),
        b["motor_2rate"] >= 40, b["c1_win_rate"] >= 55, b["f_count"] == 0,
    ]
    known = total([x.isNotNull().cast("int") for x in checks])
    met = total([F.coalesce(x, F.lit(False)).cast("int") for x in checks])
    out = races.withColumns({"trust_raw": raw, "trust_most": most, "conditions": known, "matched": met, "trust_sample": F.coalesce("venue_races", F.lit(0)) + F.coalesce("overall_races", F.lit(0))})
    return out.withColumns({
        "trust_score": half_up(F.when(c("trust_most") > 0, c("trust_raw") / F.when(c("trust_most") > 0, c("trust_most"))).otherwise(0.0) * 100),
        "condition_match": half_up(rate("matched", "conditions") * 100), "trust_reliability": patterns.reliability("trust_sample"),
    })


def with_exhibition_gate(races: DataFrame) -> DataFrame:
    """PASS, CAUTION, FAIL or MISSING for lane 1 after the warm-up, against the boats that take part.

    Needs ``escape``, ``boat1_motor`` and the weather look-up.
    """
    c = F.col
    b = boat(1)
    field = F.filter(F.array(*[F.struct(*[boat(n)[f].alias(f) for f in ("here", *GATE_READS)]) for n in range(1, 7)]), lambda x: ~k.missing(x) & ~x["is_scratched"])
    out = races.withColumns({
        "_times": F.transform(F.filter(field, lambda x: x["warmup_time"].isNotNull()), lambda x: x["warmup_time"]),
        "_starts": F.transform(F.filter(field, lambda x: x["warmup_st"].isNotNull()), lambda x: x["warmup_st"]),
    })
    ready = F.coalesce("exhibition_ready", F.lit(False)) & ~k.missing(b) & b["warmup_time"].isNotNull() & (F.size("_starts") >= 3)
    best, worst = F.coalesce(F.array_min("_times"), b["warmup_time"]), F.coalesce(F.array_max("_times"), b["warmup_time"])
    place = F.coalesce(F.nullif(b["warmup_rank"], F.lit(0)), F.size(F.filter("_times", lambda t: t < b["warmup_time"])) + 1)
    out = out.withColumns({"_ready": ready, "_best": best, "_worst": worst, "exhibition_rank": F.when(ready, place)})
    relative = clamp(100 - ((b["warmup_time"] - c("_best")) / F.greatest(c("_worst") - c("_best"), F.lit(0.01))) * 80, 20, 100)
    mean = F.aggregate("_starts", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("_starts"), F.lit(1))
    start = F.when(b["warmup_st"].isNull(), 50.0).otherwise(clamp(55 + (mean - b["warmup_st"]) * 220, 20, 95))
    start = F.when(F.coalesce(b["warmup_false_start"], F.lit(False)), F.least(start, F.lit(68.0))).otherwise(start)
    course = F.when(b["entry_course"] == 1, 100).when(b["entry_course"] == 2, 35).otherwise(10)
    weather = F.when(c("weather_races") >= 5, _whole(c("weather_rate") / 0.70 * 100)).otherwise(50)
    out = out.withColumns({"_relative": relative, "_start": start, "_course": course, "weather_score": F.when(c("_ready"), weather)})
    out = out.withColumns({"exhibition_score": F.when(c("_ready"), _whole(c("_relative") * 0.38 + clamp(110 - c("exhibition_rank") * 15, 20, 100) * 0.22 + c("_start") * 0.25 + c("_course") * 0.15))})
    out = out.withColumns({"final_escape_score": F.when(c("_ready"), _whole(c("escape") * 0.38 + c("boat1_motor") * 0.17 + c("weather_score") * 0.15 + c("exhibition_score") * 0.30))})
    failed = ~F.coalesce(b["entry_course"] == 1, F.lit(False)) | (c("final_escape_score") < 52) | (c("exhibition_score") < 42)
    status = F.when(~c("_ready"), "MISSING").when(failed, "FAIL").when((c("final_escape_score") < 62) | (c("exhibition_score") < 55), "CAUTION").otherwise("PASS")
    return out.withColumns({"exhibition_gate_status": status}).drop("_times", "_starts", "_ready", "_best", "_worst", "_relative", "_start", "_course")


def with_pattern_rates(races: DataFrame) -> DataFrame:
    """Calibrated rates and scores of the four patterns, and the one to recommend.

    Reads the venue and race number's rates ``<pattern>_base`` and ``base_win``.
    """
    c = F.col
    b2 = boat(2)
    st = F.coalesce(F.nullif(b2["avg_st"], F.lit(0.0)), F.lit(0.22))
    quick = part(0.22 - st, 0.12, 1) * 100
    remain = clamp((zero(b2["national_2rate"]) * 0.45 + zero(b2["local_2rate"]) * 0.25 + zero(b2["motor_2rate"]) * 0.20 + quick * 0.10) / 100, 0.45, 1.25)
    attack = clamp(zero(b2["national_2rate"]) * 0.35 + zero(b2["local_2rate"]) * 0.20 + zero(b2["motor_2rate"]) * 0.25 + quick * 0.20, 0, 100)
    racer_rate = F.coalesce("venue_rate", "overall_rate", "base_win")
    out = races.withColumns({
        "_escape": F.when(c("base_win") > 0.05, clamp(racer_rate / F.when(c("base_win") > 0.05, c("base_win")), 0.75, 1.25)).otherwise(1.0),
        "_trust": clamp(0.88 + c("trust_score") / 650.0, 0.88, 1.04),
        "_remain": F.when(k.missing(b2), 0.8).otherwise(remain), "_attack": F.when(k.missing(b2), 0.0).otherwise(attack),
    })
    out = out.withColumns({
        "main_structure": c("main_execution").cast("double"), "ura_structure": c("ura_execution").cast("double"),
        "new_main_structure": clamp(c("mid_second") * 0.55 + c("outer_second") * 0.25 + c("_remain") * 100 * 0.20, 0, 100),
        "new_ura_structure": clamp(c("_attack") * 0.62 + c("trust_score") * 0.38, 0, 100),
    })
    usual = c("_escape") * c("_trust")
    factors = {
        "MAIN": usual * clamp(0.78 + c("main_structure") / 300, 0.78, 1.12),
        "URA": usual * clamp(0.78 + c("ura_structure") / 300, 0.78, 1.12),
        "NEW_MAIN": usual * clamp(0.8 + c("new_main_structure") / 320, 0.8, 1.12),
        "NEW_URA": clamp(0.82 + c("_attack") / 300, 0.82, 1.16) * clamp(0.9 + c("trust_score") / 900.0, 0.9, 1.02),
    }
    low = {p: p.lower() for p in patterns.PATTERNS}
    out = out.withColumns({f"{low[p]}_rate": F.when(c(f"{low[p]}_base") > 0, F.round(clamp(c(f"{low[p]}_base") * f, 0, RATE_CAP[p]), 9)).otherwise(0.0) for p, f in factors.items()})
    out = out.withColumns({f"{low[p]}_score": F.round(c(f"{low[p]}_rate") * (0.65 + c(f"{low[p]}_structure") / 285), 9) for p in low})
    best = F.greatest(*[c(f"{low[p]}_score") for p in low])
    pick = F.when(best <= 0, "NEUTRAL")
    for p in low:
        pick = pick.when(c(f"{low[p]}_score") == best, p)
    out = out.withColumns({"recommended_pattern": pick})
    chosen = lambda kind: F.coalesce(_of("recommended_pattern", {p: c(f"{low[p]}_{kind}") for p in low}), F.greatest(*[c(f"{low[p]}_{kind}") for p in low]))
    out = out.withColumns({"recommended_rate": chosen("rate"), "recommended_structure": chosen("structure")})
    weighted = c("recommended_rate") * (0.55 + c("trust_score") / 400.0 + c("recommended_structure") / 500 + c("direction_confidence") / 1000.0)
    return out.withColumns({"weighted_probability": F.round(weighted, 9)}).drop("_escape", "_trust", "_remain", "_attack")


def with_judgment(races: DataFrame) -> DataFrame:
    """The final judgment: BUY needs the strict gate, a passed warm-up and enough races, not the odds alone.

    Reads the synthetic odds ``<pattern>_odds``, ``has_scratch`` and ``n_similar``.
    """
    c = F.col
    low = {p: p.lower() for p in patterns.PATTERNS}
    odds = F.when(c("has_scratch"), 0.0).otherwise(F.coalesce(_of("recommended_pattern", {p: F.coalesce(f"{low[p]}_odds", F.lit(0.0)) for p in low}), F.lit(0.0)))
    neutral = c("recommended_pattern") == "NEUTRAL"
    out = races.withColumns({"synthetic_odds": odds})
    out = out.withColumns({"expected_value": F.when(~neutral & ~c("has_scratch"), half_up(F.round(c("recommended_rate") * c("synthetic_odds") * 100, 9), 4))})
    strict = (c("weighted_probability") >= _of("recommended_pattern", GATE_PROBABILITY)) & (c("trust_score") >= _of("recommended_pattern", GATE_TRUST)) & (c("condition_match") >= GATE_MATCH)
    strict = F.coalesce(strict & (c("recommended_structure") >= GATE_STRUCTURE) & (c("exhibition_gate_status") == "PASS") & (c("expected_value") >= BUY_EV), F.lit(False))
    judged = patterns.judge("expected_value", "n_similar")
    held = F.when((judged == "BUY") & ~strict, "WATCH").otherwise(judged)
    skip = c("has_scratch") | neutral | c("exhibition_gate_status").isin("MISSING", "FAIL") | (c("n_similar") < LEAST_RACES)
    return out.withColumns({"buy_gate": strict, "judgment": F.when(skip, "SKIP").otherwise(held)})


def with_pre_grade(races: DataFrame) -> DataFrame:
    """S, A, B or C before the race: clear intent first, then racers able to carry it, then motors that do not object."""
    c = F.col
    support = F.when(c("recommended_pattern") == "URA", c("ura_support")).otherwise(c("main_support"))
    valid = (c("scenario_status") == "VALID") & (c("recommended_pattern") != "NEUTRAL")
    percent = F.round(c("recommended_rate") * 100, 7)

    def reaches(rate_, intent, escape, structure, motor, sure):
        return valid & (percent >= rate_) & (c("intent_confidence") >= intent) & (c("escape") >= escape) & (c("recommended_structure") >= structure) & (support >= motor) & (c("direction_confidence") >= sure)

    # What the two best grades ask for.
    grade = F.when(reaches(PRE_RATE + 2, 60, 70, 70, 55, 62), "S").when(reaches(PRE_RATE, 50, 60, 62, 45, 52), "A").when(percent >= PRE_RATE, "B").otherwise("C")
    grade = F.when(c("routine_outer_exclusion"), "C").when(c("weak_series") & grade.isin("S", "A"), "B").otherwise(grade)
    return races.withColumns({"pre_grade": grade})


def alert_gate(stage: str) -> Column:
    """Whether an analysis raises an alert: graded S or A before the race, BUY or WATCH after the warm-up."""
    return F.col("pre_grade").isin("S", "A") if stage == "pre" else F.col("judgment").isin("BUY", "WATCH")


def analysed(races: DataFrame, store: str | None = None) -> DataFrame:
    """All stages over wide rows with their look-ups (see each stage for the columns it reads).

    With ``store``, a folder that driver and executors share, the rows are written and
    read again between groups of stages: one plan over all of them grows with every
    score that names another one, beyond what is compiled.  Only what a later stage
    reads of a boat is written.  Store the result before filtering on it: the
    optimiser would push the filter down through the stages.
    """
    from ..operators.repairs import rebuilt

    def cut(rows, fields):
        kept = {f"b{n}": F.struct(*[boat(n)[f].alias(f) for f in ("here", *own)]) for n, own in fields.items()}
        return rebuilt(rows.withColumns(kept).drop(*[f"b{n}" for n in range(1, 7) if n not in fields]), store) if store else rows

    out = k.program_intent(races, "main_base", "ura_base", "n_similar").withColumns(k.motor_support())
    out = cut(with_series_context(with_racer_execution(out)), {n: [*GATE_READS, *(TRUST_READS if n == 1 else PATTERN_READS if n == 2 else ())] for n in range(1, 7)})
    out = cut(with_exhibition_gate(with_trust(with_direction(out))), {2: PATTERN_READS})
    return with_pre_grade(with_judgment(with_pattern_rates(out)))
