"""The analysis of races: its layers one by one and as a whole."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions import patterns
from ..functions.text import wind_group
from ..operators import aggregates as agg
from ..operators.repairs import rebuilt
from ..plans import race_analysis as ra
from ..sources.fixtures import fixture
from .registry import query, sql_in

RATES = ["national_win_rate", "national_2rate", "national_3rate", "local_win_rate", "local_2rate", "local_3rate", "c1_win_rate", "c1_2rate", "motor_2rate", "motor_3rate", "boat_2rate", "boat_3rate", "avg_st", "f_count"]
TERMS = ["term_course_first", "term_first", "term_course_second", "term_second", "term_course_third", "term_third", "term_course_top2", "term_top2", "term_course_top3", "term_top3", "term_ability", "term_st", "term_win", "term_ability_trend", "term_win_trend", "term_f", "term_l", "term_championship_entry", "term_championship_win"]
SERIES = ["series_runs", "series_score", "series_pressure", "series_avg_lane", "series_inner_lanes", "series_exclusion", "series_as_of"]
WARMUP = ["warmup_time", "warmup_st", "warmup_false_start", "warmup_rank", "entry_course", "is_scratched"]
EVERY = ["grade_class", *RATES, *TERMS, *SERIES, *WARMUP]


def _wide(spark, d, *columns) -> DataFrame:
    return k.wide(fixture(spark, d, "race_entry").select("race_id", "boat_number", *columns))


def _with_lookups(spark, d, races: DataFrame) -> DataFrame:
    """The venue's, racer's and weather's records next to each race, on logical keys."""
    r, head = fixture(spark, d, "race_result"), fixture(spark, d, "race_head")
    base = agg.venue_race_stats(agg.venue_race_partial(r)).select(
        "venue_code", "race_number", F.col("total_races").alias("n_similar"), F.col("uichi_rate").alias("main_base"), F.col("ura_uichi_rate").alias("ura_base"),
        F.col("new_uichi_rate").alias("new_main_base"), F.col("new_ura_uichi_rate").alias("new_ura_base"), F.col("boat1_win_rate").alias("base_win"),
    )
    own = r.select("race_id", F.col("boat1_registration_number").alias("registration_number"))
    venue = agg.racer_venue_stats(r).select("registration_number", "venue_code", F.col("boat1_races").alias("venue_races"), F.col("boat1_win_rate").alias("venue_rate"))
    overall = agg.racer_lane_stats(r).select("registration_number", F.col("races").alias("overall_races"), F.col("win_rate").alias("overall_rate"))
    weather = agg.racer_weather_stats(r, fixture(spark, d, "race")).select("registration_number", "venue_code", "weather", F.col("wind_speed_group").alias("wind"), F.col("races").alias("weather_races"), F.col("win_rate").alias("weather_rate"))
    # the wide rows come last: whatever is shuffled for a record is a narrow row
    out = head.join(own, "race_id", "left").withColumn("wind", wind_group("wind_speed"))
    out = out.join(base, ["venue_code", "race_number"], "left").join(venue, ["registration_number", "venue_code"], "left").join(overall, "registration_number", "left").join(weather, ["registration_number", "venue_code", "weather", "wind"], "left")
    out = out.na.fill(0, ["n_similar", "main_base", "ura_base", "new_main_base", "new_ura_base"]).withColumn("base_win", F.coalesce("base_win", F.lit(0.5)))
    return races.join(out, "race_id")


def _odds(spark, d) -> DataFrame:
    """Odds of a bet spread over each pattern, from the sums of the inverse odds above 1."""
    o = fixture(spark, d, "odds_final").where("odds > 1")
    sums = o.groupBy("race_id").agg(*[F.round(F.sum(F.when(patterns.hit(p, "combo"), 1.0 / F.col("odds"))), 12).alias(p) for p in patterns.PATTERNS])
    return sums.select("race_id", *[F.when(F.col(p) > 0, 1.0 / F.when(F.col(p) > 0, F.col(p))).otherwise(0.0).alias(f"{p.lower()}_odds") for p in patterns.PATTERNS])


def _analysed(spark, d) -> DataFrame:
    races = _with_lookups(spark, d, _wide(spark, d, *EVERY))
    return ra.analysed(races.join(_odds(spark, d), "race_id", "left"), _store(spark))


def _store(spark) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


# ---- the same rules as SQL ----------------------------------------------------------------------------


def _cl(x, lo=0, hi=100):
    return f"greatest({lo}e0, least({hi}e0, ({x})))"


def _w(x):
    return f"floor({_cl(x)} + 0.5e0)"


def _p(x, most, points):
    return f"(greatest(0e0, least(1e0, ({x}) / {most}e0)) * {points}e0)"


def _g(n):
    return f"(case grade_class_{n} when 'A1' then 1e0 when 'A2' then 0.85e0 when 'B1' then 0.65e0 when 'B2' then 0.45e0 else 0.5e0 end)"


def _z(c):
    return f"coalesce({c}, 0e0)"


WIDE = "w as (select race_id, " + ", ".join(f"max(case when boat_number = {n} then {c} end) {c}_{n}" for n in range(1, 7) for c in EVERY) + " from race_entry group by race_id)"


def _trend(n):
    return f"greatest(-8e0, least(8e0, term_ability_trend_{n} * 1.2e0 + term_win_trend_{n} * 4e0))"


def _risk(n):
    return f"greatest(0e0, least(12e0, term_f_{n} * 3e0 + term_l_{n} * 2e0))"


def _second(n):
    return _w(f"{_g(n)} * 10e0 + {_p(f'coalesce(term_course_top2_{n}, term_top2_{n}, national_2rate_{n}, 0e0)', 60, 27)} + {_p(f'coalesce(term_course_second_{n}, term_second_{n}, 0e0)', 25, 16)} + {_p(f'local_2rate_{n}', 60, 12)}"
              f" + {_p(f'0.23e0 - coalesce(term_st_{n}, avg_st_{n})', 0.15, 14)} + {_p(f'coalesce(term_ability_{n}, 50e0)', 60, 13)} + {_p(f'term_championship_entry_{n}', 8, 5)} + {_trend(n)} - {_risk(n)}")  # fmt: skip


def _third(n):
    return _w(f"{_g(n)} * 8e0 + {_p(f'coalesce(term_course_top3_{n}, term_top3_{n}, national_3rate_{n}, 0e0)', 70, 29)} + {_p(f'coalesce(term_course_third_{n}, term_third_{n}, 0e0)', 25, 18)} + {_p(f'local_3rate_{n}', 70, 11)}"
              f" + {_p(f'0.24e0 - coalesce(term_st_{n}, avg_st_{n})', 0.16, 12)} + {_p(f'coalesce(term_ability_{n}, 50e0)', 60, 12)} + {_p(f'term_championship_entry_{n}', 8, 4)} + {_trend(n)} - {_risk(n)} * 0.7e0")  # fmt: skip


def _pool(xs, peak=0.62, mean=0.38):
    return f"floor(greatest({', '.join(xs)}) * {peak}e0 + ({' + '.join(xs)}) / {len(xs)} * {mean}e0 + 0.5e0)"


BY_TERM = _w(f"{_p('coalesce(term_course_first_1, term_first_1)', 35, 29)} + {_p('coalesce(term_win_1, national_win_rate_1, 0e0)', 8, 18)} + {_p('0.24e0 - coalesce(term_st_1, avg_st_1)', 0.16, 16)} + {_p('coalesce(term_ability_1, 50e0)', 60, 14)} + {_g(1)} * 10e0 + {_p('term_championship_win_1', 3, 5)} + {_trend(1)} + (case when f_count_1 = 0 then 8 else 0 end) - {_risk(1)}")
DIRECT = _w(f"{_p(_z('c1_win_rate_1'), 70, 36)} + {_p('national_win_rate_1', 8, 20)} + {_p(_z('local_win_rate_1'), 8, 18)} + {_p('0.24e0 - avg_st_1', 0.16, 18)} + case when f_count_1 = 0 then 8 else 0 end")
RACERS = f"""{WIDE}, rx as (select *, {', '.join(f'{_second(n)} sec{n}, {_third(n)} thi{n}' for n in range(2, 7))}, case when c1_win_rate_1 is null and coalesce(term_course_first_1, term_first_1) is not null then {BY_TERM} else {DIRECT} end as escape0 from w),
ry as (select *, {_pool(['sec2', 'sec3', 'sec4'])} mid_second, {_pool(['thi2', 'thi3', 'thi4'])} mid_third, {_pool(['sec5', 'sec6'])} outer_second, {_pool(['thi5', 'thi6'])} outer_third from rx),
rz as (select *, {_w('escape0 * 0.40e0 + mid_second * 0.32e0 + outer_third * 0.28e0')} main0, {_w('escape0 * 0.40e0 + outer_second * 0.34e0 + mid_third * 0.26e0')} ura0 from ry)"""


def _ints(*pairs):
    return ", ".join(f"cast({x} as bigint) as {n}" for n, x in pairs)


@query(RACERS + " select race_id, " + _ints(("escape", "escape0"), ("mid_second", "mid_second"), ("mid_third", "mid_third"), ("outer_second", "outer_second"), ("outer_third", "outer_third"), ("main_execution", "main0"), ("ura_execution", "ura0")) + " from rz")
def racer_execution(spark, d):
    out = ra.with_racer_execution(_wide(spark, d, "grade_class", *RATES, *TERMS))
    return out.select("race_id", "escape", "mid_second", "mid_third", "outer_second", "outer_third", "main_execution", "ura_execution")


def _b2(n):
    return f"coalesce(grade_class_{n} = 'B2', false)"


def _routine(n):
    return f"({_b2(n)} and (series_exclusion_{n} or (coalesce(series_runs_{n}, 0) >= 2 and series_avg_lane_{n} >= 4.5e0 and series_inner_lanes_{n} = 0)))"


SEMI = "(coalesce(race_name, '') like '%準優%' or coalesce(race_phase, 'OTHER') = 'SEMIFINAL')"
CONTEXT = f"""c1 as (select s.*, h.race_date, h.venue_code, h.race_number, h.weather, h.wind_speed, h.exhibition_ready, h.has_scratch, h.grade,
 case when {SEMI} then 'SEMIFINAL' when coalesce(race_name, '') like '%優勝%' or coalesce(race_phase, 'OTHER') = 'FINAL' then 'FINAL' when series_day >= 6 and (coalesce(race_name, '') like '%特選%' or coalesce(race_name, '') like '%選抜%') then 'SPECIAL_SELECTION'
  when series_day >= 5 and (coalesce(race_name, '') like '%一般%' or grade = 'GENERAL') then 'PROGRAM_GENERAL' when series_day >= 4 then 'QUALIFYING_LATE' else 'QUALIFYING' end logic_mode,
 coalesce(series_runs_1, 0) boat1_runs, case when coalesce(series_runs_1, 0) > 0 then series_score_1 else 50e0 end boat1_series_score, coalesce(series_pressure_1, 50e0) pressure,
 series_day <= 1 or series_as_of_1 = cast(h.race_date - interval '1' day as date) snapshot_ready, grade = 'GENERAL' and (({_b2(5)} and {_b2(6)}) or {_routine(5)} or {_routine(6)}) routine_outer_exclusion from rz s join race_head h on h.race_id = s.race_id),
c2 as (select *, logic_mode in ('QUALIFYING', 'QUALIFYING_LATE') and pressure >= 80 and (series_avg_lane_1 >= 3.3e0 or series_inner_lanes_1 <= 1) placement_signal, boat1_runs >= 2 and boat1_series_score < 35 weak_series,
 case when logic_mode in ('SEMIFINAL', 'FINAL', 'SPECIAL_SELECTION') or boat1_runs < 2 then 0e0 else greatest(-8e0, least(8e0, (boat1_series_score - 50) * 0.20e0)) end score_adjustment from c1)"""


@query(f"{RACERS}, {CONTEXT} select race_id, logic_mode, cast(boat1_runs as bigint) boat1_runs, boat1_series_score, pressure, snapshot_ready, routine_outer_exclusion, placement_signal, weak_series, round(score_adjustment, 6) score_adjustment from c2")
def series_context(spark, d):
    out = ra.with_series_context(_wide(spark, d, "grade_class", *SERIES).join(fixture(spark, d, "race_head"), "race_id"))
    return out.select("race_id", "logic_mode", F.col("boat1_runs").cast("long").alias("boat1_runs"), "boat1_series_score", "pressure", "snapshot_ready", "routine_outer_exclusion", "placement_signal", "weak_series", F.round("score_adjustment", 6).alias("score_adjustment"))


def _base(n):
    return _w(f"{_g(n)} * 55e0 + {_p(f'national_win_rate_{n}', 8, 30)} + {_p(f'national_2rate_{n}', 60, 15)}")


def _m(n, i):
    most = 50 if i == 2 else 65
    return f"floor({_p(f'motor_{i}rate_{n}', most, 70)} + {_p(f'boat_{i}rate_{n}', most, 30)} + 0.5e0)"


VENUE = f"""v as (select venue_code, race_number, count(*) n_similar, {', '.join(f'round(count(*) filter (where trifecta in {sql_in(p)}) / count(*), 6) {p.lower()}_base' for p in patterns.PATTERNS)}, round(count(*) filter (where result_1 = 1) / count(*), 6) base_win from race_result group by 1, 2)"""
INTENT = f"""{VENUE}, d0 as (select c2.*, v.* exclude (venue_code, race_number), {', '.join(f'{_base(n)} s{n}' for n in range(1, 7))}, {', '.join(f'{_m(n, i)} m{n}{i}' for n in range(1, 7) for i in (2, 3))} from c2 join v on v.venue_code = c2.venue_code and v.race_number = c2.race_number),
d1 as (select *, (s2 + s3 + s4) / 3 mid, (s5 + s6) / 2 outr, greatest(s5, s6) peak, (s2 + s3 + s4 + s5 + s6) / 5 others, greatest(-24e0, least(24e0, (main_base - ura_base) * 420e0 * least(0.7e0, n_similar / (n_similar + 120)))) habit, floor(m12 * 0.70e0 + m13 * 0.30e0 + 0.5e0) boat1_motor from d0),
d2 as (select *, {_cl('45 + (s1 - others) * 0.9e0')} ax, {_cl('55 + (mid - outr) * 0.85e0 + greatest(0, peak - 45) * 0.25e0')} ms, {_cl('45 + (peak - mid) * 1.15e0 + greatest(0, mid - 45) * 0.30e0')} us,
 {_w(f"boat1_motor * 0.35e0 + {_pool(['m22', 'm32', 'm42'], 0.60, 0.40)} * 0.35e0 + {_pool(['m53', 'm63'], 0.60, 0.40)} * 0.30e0")} main_support, {_w(f"boat1_motor * 0.35e0 + {_pool(['m52', 'm62'], 0.60, 0.40)} * 0.38e0 + {_pool(['m23', 'm33', 'm43'], 0.60, 0.40)} * 0.27e0")} ura_support from d1),
d3 as (select *, {_w('ax * 0.35e0 + ms * 0.50e0 + greatest(habit, 0e0)')} mi0, {_w('ax * 0.35e0 + us * 0.50e0 + greatest(-habit, 0e0)')} ui0 from d2),
d4 as (select *, case when mi0 - ui0 >= 10 then 'MAIN' when mi0 - ui0 <= -10 then 'URA' else 'NEUTRAL' end hypothesis, {_w('abs(mi0 - ui0) * 2.4e0 + greatest(mi0, ui0) * 0.45e0 + abs(habit) * 0.8e0')} ic0, floor(ax + 0.5e0) axis0,
 {', '.join(f"case when boat1_runs >= 2 then {_w(f'{o} + score_adjustment * {by}e0')} else {o} end as {n}" for n, o, by in (('escape', 'escape0', 1.0), ('main_execution', 'main0', 0.7), ('ura_execution', 'ura0', 0.7)))} from d3),
d5 as (select *, {_w('(mi0 * 0.50e0 + main_execution * 0.32e0 + main_support * 0.18e0) * (0.55e0 + mi0 / 220)')} main_suitability, {_w('(ui0 * 0.50e0 + ura_execution * 0.32e0 + ura_support * 0.18e0) * (0.55e0 + ui0 / 220)')} ura_suitability from d4),
d6 as (select *, floor(greatest(-100e0, least(100e0, (main_suitability - ura_suitability) * 2.6e0)) + 0.5e0) di0 from d5), d7 as (select *, case when hypothesis = 'NEUTRAL' then floor(di0 * 0.55e0 + 0.5e0) else di0 end di1 from d6),
d8 as (select *, case when di1 >= 0 then main_execution else ura_execution end ch_x, case when di1 >= 0 then main_support else ura_support end ch_m from d7),
d9 as (select *, case when hypothesis = 'NEUTRAL' then 'NEUTRAL' when escape < 52 or ch_x < 52 then 'PLAYER_BREAK' when ch_m < 38 then 'MOTOR_BREAK' else 'VALID' end scenario_status from d8),
da as (select *, case scenario_status when 'NEUTRAL' then 25 when 'PLAYER_BREAK' then 40 when 'MOTOR_BREAK' then 22 else 0 end scenario_penalty, case scenario_status when 'PLAYER_BREAK' then floor(di1 * 0.35e0 + 0.5e0) when 'MOTOR_BREAK' then floor(di1 * 0.72e0 + 0.5e0) else di1 end direction_index,
 {', '.join(f"case when placement_signal then {_w(f'{o} + {by}')} else {o} end as {n}" for n, o, by in (('axis_placement', 'axis0', 8), ('intent_confidence', 'ic0', 6), ('main_intent', 'mi0', 4), ('ura_intent', 'ui0', 4)))} from d9),
db as (select *, {_w('intent_confidence * 0.50e0 + ch_x * 0.32e0 + ch_m * 0.18e0 - scenario_penalty')} direction_confidence from da)"""
LABEL = "case when direction_index >= 60 and direction_confidence >= 60 then 'MAIN_STRONG' when direction_index >= 25 then 'MAIN_LEANING' when direction_index <= -60 and direction_confidence >= 60 then 'URA_STRONG' when direction_index <= -25 then 'URA_LEANING' else 'NEUTRAL' end"
DIRECTION = ["direction_index", "direction_confidence", "main_suitability", "ura_suitability", "axis_placement", "intent_confidence", "main_intent", "ura_intent", "scenario_penalty"]


@query(f"{RACERS}, {CONTEXT}, {INTENT} select race_id, {_ints(*[(n, n) for n in DIRECTION])}, hypothesis, scenario_status, {LABEL} direction_label from db")
def direction(spark, d):
    races = _with_lookups(spark, d, _wide(spark, d, "grade_class", *RATES, *TERMS, *SERIES))
    out = k.program_intent(races, "main_base", "ura_base", "n_similar").withColumns(k.motor_support())
    out = ra.with_direction(ra.with_series_context(ra.with_racer_execution(out)))
    return out.select("race_id", *[F.col(n).cast("long").alias(n) for n in DIRECTION], "hypothesis", "scenario_status", "direction_label")


LOOKUPS = """l1 as (select boat1_registration_number reg, venue_code, count(*) n, round(count(*) filter (where result_1 = 1) / count(*), 6) r from race_result group by 1, 2),
l2 as (select boat1_registration_number reg, count(*) n, round(count(*) filter (where result_1 = 1) / count(*), 6) r from race_result group by 1),
l3 as (select x.boat1_registration_number reg, x.venue_code, r.weather, case when r.wind_speed is null then 'unknown' when r.wind_speed <= 1 then '0-1' when r.wind_speed <= 3 then '2-3' when r.wind_speed <= 5 then '4-5' else '6+' end wind, count(*) n, round(count(*) filter (where x.result_1 = 1) / count(*), 6) r
  from race_result x join race r on r.race_id = x.race_id where r.weather is not null group by 1, 2, 3, 4),
tk as (select {0}.*, l1.n venue_races, l1.r venue_rate, l2.n overall_races, l2.r overall_rate, l3.n weather_races, l3.r weather_rate from {0} join race_result o on o.race_id = {0}.race_id left join l1 on l1.reg = o.boat1_registration_number and l1.venue_code = {0}.venue_code
  left join l2 on l2.reg = o.boat1_registration_number left join l3 on l3.reg = o.boat1_registration_number and l3.venue_code = {0}.venue_code and l3.weather = {0}.weather and l3.wind = case when {0}.wind_speed is null then 'unknown' when {0}.wind_speed <= 1 then '0-1' when {0}.wind_speed <= 3 then '2-3' when {0}.wind_speed <= 5 then '4-5' else '6+' end),
tl as (select *, case when venue_races >= 5 then venue_rate end vr, case when overall_races >= 10 then overall_rate end orr, case when weather_races >= 5 then weather_rate end wr from tk)"""


def _comp(most, items):
    got = " + ".join(f"coalesce({_p(x, top, w)} + 0e0 * ({x}), 0e0)" for x, top, w in items)
    weight = " + ".join(f"(case when ({x}) is null then 0 else {w} end)" for x, _, w in items)
    return f"(case when {weight} > 0 then floor(({got}) / nullif({weight}, 0) * {most}e0 + 0.5e0) else 0 end)", f"(case when {weight} > 0 then {most} else 0 end)"


TRUST_PARTS = [_comp(20, [("national_win_rate_1", 8, 50), ("national_2rate_1", 60, 20), (_g(1), 1, 30)]), _comp(20, [("vr", 0.7, 45), ("case when vr is null then orr end", 0.7, 35), ("c1_win_rate_1", 70, 35), ("c1_2rate_1", 90, 20)]), _comp(15, [("local_win_rate_1", 8, 50), ("local_2rate_1", 60, 50)]), _comp(10, [("0.25e0 - avg_st_1", 0.20, 1)]), _comp(10, [("motor_2rate_1", 50, 60), ("motor_3rate_1", 70, 40)]), _comp(10, [("wr", 0.7, 1)])]
TRUST_CHECKS = ["vr >= 0.6e0", "orr >= 0.55e0", "national_win_rate_1 >= 6", "local_win_rate_1 >= 6", "avg_st_1 <= 0.13e0", "motor_2rate_1 >= 40", "c1_win_rate_1 >= 55", "f_count_1 = 0"]
TRUST = f"""tm as (select *, {' + '.join(p for p, _ in TRUST_PARTS)} - least(f_count_1 * 4, 15) trust_raw, {' + '.join(m for _, m in TRUST_PARTS)} trust_most, {' + '.join(f'(case when ({x}) is null then 0 else 1 end)' for x in TRUST_CHECKS)} conditions, {' + '.join(f'(case when {x} then 1 else 0 end)' for x in TRUST_CHECKS)} matched, coalesce(venue_races, 0) + coalesce(overall_races, 0) trust_sample from tl),
tn as (select *, floor(trust_raw / trust_most * 100 + 0.5e0) trust_score, floor(matched / conditions * 100 + 0.5e0) condition_match, case when trust_sample >= 500 then 'A' when trust_sample >= 250 then 'B' when trust_sample >= 100 then 'C' else 'D' end trust_reliability from tm)"""
HEADED = "hw as (select w.*, h.race_date, h.venue_code, h.race_number, h.weather, h.wind_speed, h.exhibition_ready, h.has_scratch, h.grade from w join race_head h on h.race_id = w.race_id)"
TRUST_COLUMNS = ["trust_raw", "trust_most", "trust_score", "conditions", "matched", "condition_match", "trust_sample"]


@query(f"{WIDE}, {HEADED}, {LOOKUPS.format('hw')}, {TRUST} select race_id, {_ints(*[(n, n) for n in TRUST_COLUMNS])}, trust_reliability from tn")
def trust_score(spark, d):
    """Trust in lane 1 with the records at the venue, over all and in this weather, and all eight conditions."""
    out = ra.with_trust(_with_lookups(spark, d, _wide(spark, d, "grade_class", *RATES)))
    return out.select("race_id", *[F.col(n).cast("long").alias(n) for n in TRUST_COLUMNS], "trust_reliability")


@query(f"{WIDE}, {HEADED}, {LOOKUPS.format('hw')}, {TRUST} select race_id, {_ints(*[(n, n) for n in ('conditions', 'matched', 'condition_match')])} from tn")
def condition_match(spark, d):
    """Share of the eight conditions known for lane 1 that speak for it."""
    out = ra.with_trust(_with_lookups(spark, d, _wide(spark, d, "grade_class", *RATES)))
    return out.select("race_id", *[F.col(n).cast("long").alias(n) for n in ("conditions", "matched", "condition_match")])


ON = [f"(not is_scratched_{n} and warmup_time_{n} is not null)" for n in range(1, 7)]
SON = [f"(not is_scratched_{n} and warmup_st_{n} is not null)" for n in range(1, 7)]
GATE = f"""g1 as (select *, {' + '.join(f'(case when {x} then 1 else 0 end)' for x in SON)} n_st, {' + '.join(f'(case when {x} then warmup_st_{n} else 0e0 end)' for n, x in enumerate(SON, 1))} s_st,
 coalesce(least({', '.join(f'case when {x} then warmup_time_{n} end' for n, x in enumerate(ON, 1))}), warmup_time_1) best, coalesce(greatest({', '.join(f'case when {x} then warmup_time_{n} end' for n, x in enumerate(ON, 1))}), warmup_time_1) worst,
 1 + {' + '.join(f'(case when {x} and warmup_time_{n} < warmup_time_1 then 1 else 0 end)' for n, x in enumerate(ON, 1))} place from tn),
g2 as (select *, exhibition_ready and warmup_time_1 is not null and n_st >= 3 ready, coalesce(nullif(warmup_rank_1, 0), place) rk from g1),
g3 as (select *, {_cl('100 - ((warmup_time_1 - best) / greatest(worst - best, 0.01e0)) * 80', 20)} rel, case when warmup_st_1 is null then 50e0 else {_cl('55 + (s_st / greatest(n_st, 1) - warmup_st_1) * 220', 20, 95)} end st0, case entry_course_1 when 1 then 100 when 2 then 35 else 10 end course, case when weather_races >= 5 then {_w('weather_rate / 0.70e0 * 100')} else 50 end ws from g2),
g4 as (select *, case when warmup_false_start_1 then least(st0, 68e0) else st0 end st1 from g3), g5 as (select *, {_w(f"rel * 0.38e0 + {_cl('110 - rk * 15', 20)} * 0.22e0 + st1 * 0.25e0 + course * 0.15e0")} ex from g4), g6 as (select *, {_w('escape * 0.38e0 + boat1_motor * 0.17e0 + ws * 0.15e0 + ex * 0.30e0')} fin from g5),
g7 as (select *, case when not ready then 'MISSING' when entry_course_1 <> 1 or fin < 52 or ex < 42 then 'FAIL' when fin < 62 or ex < 55 then 'CAUTION' else 'PASS' end exhibition_gate_status from g6)"""


@query(f"{RACERS}, {CONTEXT}, {INTENT}, {LOOKUPS.format('db')}, {TRUST}, {GATE} select race_id, exhibition_gate_status, " + ", ".join(f"case when ready then cast({x} as bigint) end {n}" for n, x in (("exhibition_rank", "rk"), ("exhibition_score", "ex"), ("weather_score", "ws"), ("final_escape_score", "fin"))) + " from g7")
def exhibition_gate(spark, d):
    """The gate after the warm-up with its status, the weather's record and the total score."""
    out = _analysed(spark, d)
    return out.select("race_id", "exhibition_gate_status", *[F.col(n).cast("long").alias(n) for n in ("exhibition_rank", "exhibition_score", "weather_score", "final_escape_score")])


LOW = [p.lower() for p in patterns.PATTERNS]
FACTOR = {"main": f"esc * tr * {_cl('0.78e0 + main_structure / 300', 0.78, 1.12)}", "ura": f"esc * tr * {_cl('0.78e0 + ura_structure / 300', 0.78, 1.12)}", "new_main": f"esc * tr * {_cl('0.8e0 + new_main_structure / 320', 0.8, 1.12)}", "new_ura": f"{_cl('0.82e0 + attack / 300', 0.82, 1.16)} * {_cl('0.9e0 + trust_score / 900', 0.9, 1.02)}"}
CAPS = {"main": "0.45", "ura": "0.45", "new_main": "0.45", "new_ura": "0.40"}
RATED = f"""q1 as (select *, case when base_win > 0.05e0 then {_cl('coalesce(venue_rate, overall_rate, base_win) / base_win', 0.75, 1.25)} else 1e0 end esc, {_cl('0.88e0 + trust_score / 650', 0.88, 1.04)} tr, {_p('0.22e0 - avg_st_2', 0.12, 1)} * 100 quick from g7),
q2 as (select *, {_cl('(national_2rate_2 * 0.45e0 + local_2rate_2 * 0.25e0 + motor_2rate_2 * 0.20e0 + quick * 0.10e0) / 100', 0.45, 1.25)} remain, {_cl('national_2rate_2 * 0.35e0 + local_2rate_2 * 0.20e0 + motor_2rate_2 * 0.25e0 + quick * 0.20e0')} attack, main_execution main_structure, ura_execution ura_structure from q1),
q3 as (select *, {_cl('mid_second * 0.55e0 + outer_second * 0.25e0 + remain * 100 * 0.20e0')} new_main_structure, {_cl('attack * 0.62e0 + trust_score * 0.38e0')} new_ura_structure from q2),
q4 as (select *, {', '.join(f"case when {p}_base > 0 then round({_cl(f'{p}_base * ({f})', 0, CAPS[p])}, 9) else 0e0 end {p}_rate" for p, f in FACTOR.items())} from q3),
q5 as (select *, {', '.join(f'round({p}_rate * (0.65e0 + {p}_structure / 285), 9) {p}_score' for p in LOW)} from q4), q6 as (select *, greatest({', '.join(f'{p}_score' for p in LOW)}) top from q5),
q7 as (select *, case when top <= 0 then 'NEUTRAL' {' '.join(f"when {p}_score = top then '{p.upper()}'" for p in LOW)} end recommended_pattern from q6),
os as (select race_id, {', '.join(f"round(sum(1 / odds) filter (where combo in {sql_in(p)}), 12) {p.lower()}_inv" for p in patterns.PATTERNS)} from odds_final where odds > 1 group by race_id),
q8 as (select q7.*, {', '.join(f'case recommended_pattern {" ".join(f"when {chr(39)}{p.upper()}{chr(39)} then {p}_{kind}" for p in LOW)} else greatest({", ".join(f"{p}_{kind}" for p in LOW)}) end recommended_{kind}' for kind in ("rate", "structure"))},
 case when has_scratch then 0e0 else coalesce(case recommended_pattern {' '.join(f"when '{p.upper()}' then 1 / {p}_inv" for p in LOW)} end, 0e0) end synthetic_odds from q7 left join os on os.race_id = q7.race_id),
q9 as (select *, round(recommended_rate * (0.55e0 + trust_score / 400 + recommended_structure / 500 + direction_confidence / 1000), 9) weighted_probability, case when recommended_pattern <> 'NEUTRAL' and not has_scratch then floor(round(recommended_rate * synthetic_odds * 100, 9) * 10000e0 + 0.5e0) / 10000e0 end expected_value, round(recommended_rate * 100, 7) pct,
 case when recommended_pattern = 'URA' then ura_support else main_support end sup, scenario_status = 'VALID' and recommended_pattern <> 'NEUTRAL' valid from q8),
qa as (select *, coalesce(weighted_probability >= case when recommended_pattern like 'NEW%' then 0.18e0 else 0.22e0 end and trust_score >= case when recommended_pattern = 'NEW_URA' then 62 else 68 end and condition_match >= 60 and recommended_structure >= 58 and exhibition_gate_status = 'PASS' and expected_value >= 115, false) buy_gate,
 case when expected_value is null then 'PENDING' when expected_value >= 110 then case when n_similar < 100 then 'WATCH' else 'BUY' end when expected_value >= 100 then 'WATCH' else 'SKIP' end j0,
 case when valid and pct >= 22 and intent_confidence >= 60 and escape >= 70 and recommended_structure >= 70 and sup >= 55 and direction_confidence >= 62 then 'S' when valid and pct >= 20 and intent_confidence >= 50 and escape >= 60 and recommended_structure >= 62 and sup >= 45 and direction_confidence >= 52 then 'A' when pct >= 20 then 'B' else 'C' end p0 from q9),
qb as (select *, case when has_scratch or recommended_pattern = 'NEUTRAL' or exhibition_gate_status in ('MISSING', 'FAIL') or n_similar < 30 then 'SKIP' when j0 = 'BUY' and not buy_gate then 'WATCH' else j0 end judgment, case when routine_outer_exclusion then 'C' when weak_series and p0 in ('S', 'A') then 'B' else p0 end pre_grade from qa)"""
WHOLE = f"{RACERS}, {CONTEXT}, {INTENT}, {LOOKUPS.format('db')}, {TRUST}, {GATE}, {RATED}"
# rates and values are rounded where they are made; structures and odds here
MADE = [*[f"{p}_rate" for p in LOW], "recommended_rate", "weighted_probability", "expected_value"]
ROUNDED = ["recommended_structure", "synthetic_odds"]


@query(WHOLE + f" select race_id, recommended_pattern, {', '.join(MADE)}, {', '.join(f'round({n}, 6) {n}' for n in ROUNDED)}, cast(trust_score as bigint) trust_score, cast(condition_match as bigint) condition_match, exhibition_gate_status, scenario_status, buy_gate, judgment, pre_grade from qb")
def race_analysis(spark, d):
    """The whole analysis of every race, before and after the warm-up."""
    out = _analysed(spark, d)
    return out.select("race_id", "recommended_pattern", *MADE, *[F.round(n, 6).alias(n) for n in ROUNDED], "trust_score", "condition_match", "exhibition_gate_status", "scenario_status", "buy_gate", "judgment", "pre_grade")


@query(WHOLE + " select race_id, 'pre' as stage, pre_grade as verdict from qb where pre_grade in ('S', 'A') union all select race_id, 'final', judgment from qb where judgment in ('BUY', 'WATCH')")
def alert_gate(spark, d):
    """Races that raise an alert at either stage, from the stored verdicts.

    The analysis is a table of its own: a filter on it as a view would be pushed
    through all its stages and work every score out again.
    """
    out = rebuilt(_analysed(spark, d).select("race_id", "pre_grade", "judgment"), _store(spark))
    stages = [out.where(ra.alert_gate(s)).select("race_id", F.lit(s).alias("stage"), F.col(v).alias("verdict")) for s, v in (("pre", "pre_grade"), ("final", "judgment"))]
    return stages[0].unionByName(stages[1])
