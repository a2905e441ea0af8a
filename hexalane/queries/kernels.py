"""Kernels: patterns, odds, judgments and scores of a race."""

from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions import patterns
from ..operators import aggregates as agg
from ..operators.spread import dealt
from ..plans import evaluation
from ..sources.fixtures import fixture, tasks_for
from .registry import query, sql_in


def _cl(x, lo, hi):
    return f"greatest({lo}, least({hi}, {x}))"


def _r(x):
    return f"floor({x} + 0.5e0)"


def _part(x, most, points):
    return f"({_cl(f'({x}) / {most}e0', '0e0', '1e0')} * {points}e0)"


def _gp(b):
    return f"(case {b}.grade_class when 'A1' then 1e0 when 'A2' then 0.85e0 when 'B1' then 0.65e0 when 'B2' then 0.45e0 else 0.5e0 end)"


KERNEL_COLUMNS = ["race_id", "boat_number", "grade_class", "national_win_rate", "national_2rate", "national_3rate", "local_win_rate", "local_2rate", "local_3rate", "c1_win_rate", "motor_2rate", "motor_3rate", "boat_2rate", "boat_3rate", "avg_st", "f_count", "exhibition_time", "exhibition_st", "entry_course"]
# one row per race with a struct per boat, from one aggregation
_STRUCT = "{" + ", ".join(f"'{c}': {c}" for c in dict.fromkeys((*KERNEL_COLUMNS, "venue_code", "race_number"))) + "}"
BOATS = "from (select " + ", ".join(f"any_value({_STRUCT}) filter (where boat_number = {n}) b{n}" for n in range(1, 7)).replace("{", "{{").replace("}", "}}") + " from race_entry group by race_id) bb {}"


def _wide(spark, d, *columns):
    """Wide rows with the columns that a kernel reads: fields of a struct are not pruned by the optimiser."""
    return k.wide(fixture(spark, d, "race_entry").select(*(("race_id", "boat_number", *columns) if columns else KERNEL_COLUMNS)))


def _named(columns):
    return [c.alias(n) for n, c in columns.items()]


@query("select race_id, " + ", ".join(f"trifecta in {sql_in(p)} as hit_{p.lower()}" for p in patterns.PATTERNS) + f", case when trifecta in {sql_in('MAIN')} then 'MAIN' when trifecta in {sql_in('URA')} then 'URA' when trifecta in {sql_in('NEW_MAIN')} then 'NEW_MAIN' when trifecta in {sql_in('NEW_URA')} then 'NEW_URA' else 'OTHER' end pattern, case when trifecta in {sql_in('MAIN')} then trifecta end combo from race_result")
def pattern_hits(spark, d):
    return fixture(spark, d, "race_result").select("race_id", *[patterns.hit(p, "trifecta").alias(f"hit_{p.lower()}") for p in patterns.PATTERNS], patterns.pattern_of("trifecta").alias("pattern"), patterns.main_combo("trifecta").alias("combo"))


LATEST = "l as (select race_id, combo, odds from (select *, row_number() over (partition by race_id, combo order by captured_at desc, tick_id desc) w from odds_snapshot) where w = 1)"


@query(LATEST + " select race_id, cast(count(*) filter (where odds > 1) as bigint) n_valid, round(coalesce(1 / sum(1 / odds) filter (where odds > 1), 0), 6) synthetic_odds from l group by race_id")
def synthetic_odds(spark, d):
    from ..operators.ranking import latest

    last = latest(fixture(spark, d, "odds_snapshot"), ["race_id", "combo"], "captured_at", "tick_id")
    per = last.groupBy("race_id").agg(F.collect_list("odds").alias("odds"))  # six combinations at most
    return per.select("race_id", F.size(F.filter("odds", lambda x: x > 1)).cast("long").alias("n_valid"), F.round(patterns.synthetic_odds("odds"), 6).alias("synthetic_odds"))


@query("select race_id, dup_no, round(boat1_trust_score / 400e0 * coalesce(expected_value, 0) * 100, 6) ev from uichi_analysis")
def expected_value(spark, d):
    return fixture(spark, d, "uichi_analysis").select("race_id", "dup_no", F.round(patterns.expected_value(F.col("boat1_trust_score") / 400.0, "expected_value"), 6).alias("ev"))


@query("""select race_id, dup_no, case when expected_value is null then 'PENDING' when expected_value >= 110 then case when boat1_trust_score * 3 < 100 then 'WATCH' else 'BUY' end when expected_value >= 100 then 'WATCH' else 'SKIP' end judged,
 case when boat1_trust_score * 7 >= 500 then 'A' when boat1_trust_score * 7 >= 250 then 'B' when boat1_trust_score * 7 >= 100 then 'C' else 'D' end reliability from uichi_analysis""")
def judge(spark, d):
    return fixture(spark, d, "uichi_analysis").select("race_id", "dup_no", patterns.judge("expected_value", F.col("boat1_trust_score") * 3).alias("judged"), patterns.reliability(F.col("boat1_trust_score") * 7).alias("reliability"))


GB = f"{_part('b1.national_win_rate', 8, 30)} + {_part('coalesce(b1.local_win_rate, 0)', 8, 20)} + {_part('coalesce(b1.c1_win_rate, 0)', 70, 25)} + {_part('0.25e0 - b1.avg_st', 0.15, 15)} - case when b1.f_count > 0 then 10 else 0 end + {_part('6.6e0 - b1.exhibition_time', 0.6, 10)}"


@query(f"g as (select race_id, {GB} s from race_entry b1 where boat_number = 1) select race_id, case when s >= 80 then 'S' when s >= 65 then 'A' when s >= 50 then 'B' when s >= 35 then 'C' else 'D' end grade from g")
def grade_boat1(spark, d):
    return _wide(spark, d).select("race_id", k.boat1_grade(k.boat(1)).alias("grade"))


def _outer(b):
    return f"least(100, {_r(_gp(b) + ' * 15e0')} + coalesce({_r(_part(f'{b}.national_3rate', 65, 25))} * case when {b}.national_3rate is null then 0 else 1 end, 0) + {_r(_part(f'{b}.local_3rate', 65, 20))} + {_r(_part(f'{b}.motor_3rate', 60, 20))} + {_r(_part(f'{b}.motor_2rate', 45, 10))} + {_r(_part(f'0.23e0 - {b}.avg_st', 0.15, 10))})"


@query(f"o as (select b1.race_id, cast({_outer('b5')} as bigint) boat5_score, cast({_outer('b6')} as bigint) boat6_score {BOATS.format('')}) select *, greatest(boat5_score, boat6_score) outer_score, case when boat6_score > boat5_score then 6 else 5 end outer_boat from o")
def outer_potential(spark, d):
    return _wide(spark, d).select("race_id", *_named(k.outer_potential()))


def _base(b):
    return _cl(_r(f"{_gp(b)} * 55e0 + {_part(f'{b}.national_win_rate', 8, 30)} + {_part(f'{b}.national_2rate', 60, 15)}"), 0, 100)


INTENT = f"""v as (select venue_code, race_number, count(*) n, round(count(*) filter (where trifecta in {sql_in('MAIN')}) / count(*), 6) hm, round(count(*) filter (where trifecta in {sql_in('URA')}) / count(*), 6) hu from race_result group by 1, 2),
s as (select b1.race_id, v.n, v.hm, v.hu, {', '.join(f'{_base(f"b{n}")} s{n}' for n in range(1, 7))} {BOATS.format('join v on v.venue_code = b1.venue_code and v.race_number = b1.race_number')}),
p as (select *, (s2 + s3 + s4) / 3 mid, (s5 + s6) / 2 outr, greatest(s5, s6) peak, (s2 + s3 + s4 + s5 + s6) / 5 others, {_cl('(hm - hu) * 420e0 * least(0.7e0, n / (n + 120))', '-24e0', '24e0')} habit from s),
q as (select *, {_cl('45 + (s1 - others) * 0.9e0', 0, 100)} ax, {_cl('55 + (mid - outr) * 0.85e0 + greatest(0, peak - 45) * 0.25e0', 0, 100)} ms, {_cl('45 + (peak - mid) * 1.15e0 + greatest(0, mid - 45) * 0.30e0', 0, 100)} us from p),
w as (select *, cast({_r(_cl('ax * 0.35e0 + ms * 0.50e0 + greatest(habit, 0)', 0, 100))} as bigint) main_intent, cast({_r(_cl('ax * 0.35e0 + us * 0.50e0 + greatest(-habit, 0)', 0, 100))} as bigint) ura_intent from q)"""


@query(INTENT + f" select race_id, main_intent, ura_intent, case when main_intent - ura_intent >= 10 then 'MAIN' when main_intent - ura_intent <= -10 then 'URA' else 'NEUTRAL' end hypothesis, cast({_r(_cl('abs(main_intent - ura_intent) * 2.4e0 + greatest(main_intent, ura_intent) * 0.45e0 + abs(habit) * 0.8e0', 0, 100))} as bigint) intent_confidence, cast({_r('ax')} as bigint) axis_placement from w")
def program_intent(spark, d):
    r = fixture(spark, d, "race_result")
    habit = agg.venue_race_stats(agg.venue_race_partial(r)).select("venue_code", "race_number", "total_races", "uichi_rate", "ura_uichi_rate")
    own = _wide(spark, d, "grade_class", "national_win_rate", "national_2rate").join(r.select("race_id", "venue_code", "race_number"), "race_id").join(habit, ["venue_code", "race_number"])
    return k.program_intent(own, "uichi_rate", "ura_uichi_rate", "total_races").select("race_id", "main_intent", "ura_intent", "hypothesis", "intent_confidence", "axis_placement")


def _m(b, i):
    most = 50 if i == 2 else 65
    return _r(f"{_part(f'{b}.motor_{i}rate', most, 70)} + {_part(f'{b}.boat_{i}rate', most, 30)}")


def _pool(xs, peak, mean):
    return _r(f"greatest({', '.join(xs)}) * {peak}e0 + ({' + '.join(xs)}) / {len(xs)} * {mean}e0")


@query(f"""m as (select b1.race_id, {', '.join(f'{_m(f"b{n}", i)} m{n}{i}' for n in range(1, 7) for i in (2, 3))} {BOATS.format('')}), o as (select *, {_r('m12 * 0.70e0 + m13 * 0.30e0')} own from m)
select race_id, cast(own as bigint) boat1_motor, cast({_r(_cl(f"own * 0.35e0 + {_pool(['m22', 'm32', 'm42'], 0.60, 0.40)} * 0.35e0 + {_pool(['m53', 'm63'], 0.60, 0.40)} * 0.30e0", 0, 100))} as bigint) main_support,
 cast({_r(_cl(f"own * 0.35e0 + {_pool(['m52', 'm62'], 0.60, 0.40)} * 0.38e0 + {_pool(['m23', 'm33', 'm43'], 0.60, 0.40)} * 0.27e0", 0, 100))} as bigint) ura_support from o""")
def motor_support(spark, d):
    return _wide(spark, d, "motor_2rate", "motor_3rate", "boat_2rate", "boat_3rate").select("race_id", *_named(k.motor_support()))


@query("""select point_id, floor(greatest(0, least(100, (case when rank_no - 18 <= -8 then 25 when rank_no - 18 <= -4 then 40 when rank_no - 18 <= 0 then 75 when rank_no - 18 <= 3 then 90 when rank_no - 18 <= 7 then 75 else 45 end) + races_run / 5e0 * 8 + case when 5 - races_run <= 1 then 5 else 0 end)) * 10 + 0.5) / 10 pressure from series_point""")
def rank_pressure(spark, d):
    return fixture(spark, d, "series_point").select("point_id", k.rank_pressure(F.col("rank_no"), 5 - F.col("races_run"), F.col("races_run") + 1, F.lit(6)).alias("pressure"))


REF = "date '1998-08-02'"
ZONE = "case when boat_number = 1 then '1' when boat_number <= 4 then 'mid' else 'outer' end"
PERIOD_SQL = f"""p(period, months) as (values ('6m', 6), ('1y', 12), ('3y', 36)),
c as (select registration_number, period, boat_number, count(*) n, count(*) filter (where finish_order = 1) f1, count(*) filter (where finish_order = 2) f2, count(*) filter (where finish_order = 3) f3, avg(finish_order) af,
  avg(case when start_timing not in ('F', 'L') then cast(start_timing as double) end) st, count(*) filter (where start_timing = 'F') nf, count(*) filter (where start_timing = 'L') nl
  from race_entry cross join p where not is_scratched and race_date >= cast({REF} - to_months(months) as date) and race_date <= {REF} group by 1, 2, 3),
z as (select registration_number, period, {ZONE} zone, sum(n) n, sum(f1) / sum(n) w, sum(f2) / sum(n) s, sum(f3) / sum(n) t, sum(f1 + f2) / sum(n) t2, sum(f1 + f2 + f3) / sum(n) t3, round(sum(af * n) / sum(n), 9) af, round(sum(coalesce(st, 0) * n) / sum(n), 9) st, sum(nf) nf, sum(nl) nl from c group by 1, 2, 3),
raw as (select *, 40 + w * 60 + (t2 - w) * 30 + case when st < 0.10 then 10 when st < 0.13 then 7 when st < 0.16 then 5 when st < 0.20 then 2 else 0 end + least(10, t3 * 20) - nf * 2 - nl ins,
  30 + s * 80 + (t2 - s - w) * 30 - case when w > 0.15 then (w - 0.15) * 200 else 0 end + case when af < 2.5 then 5 when af < 3 then 3 else 0 end ms, 30 + t * 80 + (t3 - t) * 30 + case when af < 3 then 5 else 0 end mt,
  25 + t * 100 + (t3 - t) * 30 + case when af < 3.5 then 10 when af < 4 then 7 when af < 4.5 then 3 else 0 end + case when st < 0.15 then 5 else 0 end ot, 20 + s * 120 + (t2 - s) * 30 + case when af < 3.5 then 10 when af < 4 then 5 else 0 end os from z)"""


def _sc(x, least, zone):
    return f"cast(max(case when zone = '{zone}' then greatest(0, least(100, floor(round(50 + ({x} - 50) * least(1, n / {least}), 9) + 0.5))) end) as bigint)"


PERIOD_ROWS = PERIOD_SQL + f""", sc as (select registration_number, period, {_sc('ins', 30, '1')} in_strength, {_sc('ms', 30, 'mid')} mid_second, {_sc('mt', 30, 'mid')} mid_third, {_sc('ot', 20, 'outer')} outside_third, {_sc('os', 20, 'outer')} outside_second,
  cast(coalesce(max(n) filter (where zone = '1'), 0) as bigint) n_1, cast(coalesce(max(n) filter (where zone = 'mid'), 0) as bigint) n_mid, cast(coalesce(max(n) filter (where zone = 'outer'), 0) as bigint) n_outer from raw group by 1, 2)"""


def _scores(spark, d):
    entries = fixture(spark, d, "race_entry").where("not is_scratched").withColumnRenamed("boat_number", "course")
    return evaluation.period_scores(entries, F.lit("1998-08-02").cast("date"))


@query(PERIOD_ROWS + " select * from sc")
def period_scores(spark, d):
    return _scores(spark, d)


def _bl(name, zone, least):
    w = f"(case period when '6m' then 0.5e0 when '1y' then 0.3e0 else 0.2e0 end * case when n_{zone} >= {least} then 1 else greatest(0.1e0, n_{zone} / {least}) end)"
    own = f"sum({w}) filter (where {name} is not null)"
    return f"case when {own} > 0 then cast(greatest(0, least(100, floor(round(sum({name} * {w}) / {own}, 9) + 0.5))) as bigint) end {name}"


@query(PERIOD_ROWS + f" select registration_number, {_bl('in_strength', '1', 10)}, {_bl('mid_second', 'mid', 8)}, {_bl('mid_third', 'mid', 8)}, {_bl('outside_third', 'outer', 8)}, {_bl('outside_second', 'outer', 8)} from sc group by 1")
def blend_scores(spark, d):
    return evaluation.blended(_scores(spark, d))


def _total(test):
    """Means over a racer's courses of the last year, weighted by races."""
    return f"(select registration_number, sum(n) n, sum(f1) / sum(n) w, sum(sd * n) / sum(n) sd from cs where {test} group by 1)"


TYPES = PERIOD_ROWS + f""", bl as (select registration_number, {_bl('in_strength', '1', 10)}, {_bl('mid_second', 'mid', 8)}, {_bl('mid_third', 'mid', 8)}, {_bl('outside_third', 'outer', 8)}, {_bl('outside_second', 'outer', 8)} from sc group by 1),
cs as (select registration_number, boat_number c, count(*) n, count(*) filter (where finish_order = 1) f1, stddev_pop(finish_order) sd from race_entry where not is_scratched and race_date >= cast({REF} - to_months(12) as date) and race_date <= {REF} group by 1, 2),
ty as (select bl.*, coalesce(in_strength >= 75 and x1.n >= 20, false) t1, coalesce(mid_second >= 70 and xm.n >= 20, false) t2, coalesce(mid_third >= 70 and xm.n >= 20, false) t3, coalesce(outside_third >= 65 and coalesce(outside_second, 0) < 55, false) t4, coalesce(outside_second >= 65, false) t5, coalesce(xo.w > 0.08e0 and xo.n >= 20, false) t6, coalesce(round(xa.sd, 9) > 1.8e0 and xa.n >= 20, false) t7
  from bl left join {_total('c = 1')} x1 on x1.registration_number = bl.registration_number left join {_total('c between 2 and 4')} xm on xm.registration_number = bl.registration_number left join {_total('c >= 5')} xo on xo.registration_number = bl.registration_number left join {_total('true')} xa on xa.registration_number = bl.registration_number)"""
NAMES = ("IN_SPECIALIST", "MID_SECOND_SPECIALIST", "MID_THIRD_SPECIALIST", "UICHI_OUTSIDE_SPECIALIST", "URA_UICHI_OUTSIDE_SPECIALIST", "OUTSIDE_DANGER", "UNSTABLE")


def _typed(spark, d):
    entries = fixture(spark, d, "race_entry").where("not is_scratched").withColumnRenamed("boat_number", "course")
    return evaluation.player_types(evaluation.blended(_scores(spark, d)), entries, F.lit("1998-08-02").cast("date"))


@query(TYPES + " select registration_number, concat_ws(',', " + ", ".join(f"case when t{i} then '{n}' end" for i, n in enumerate(NAMES, 1)) + ") types from ty")
def player_types(spark, d):
    """What kind of racer someone is, by current scores and the last year's courses."""
    return _typed(spark, d).select("registration_number", F.array_join("player_types", ",").alias("types"))


@query(TYPES + """, m as (select e.race_id, coalesce(max(in_strength) filter (where boat_number = 1), 50) s, coalesce(max(mid_second) filter (where boat_number between 2 and 4), 50) m2, coalesce(max(outside_third) filter (where boat_number >= 5), 50) o3, coalesce(max(outside_second) filter (where boat_number >= 5), 50) o2, coalesce(max(mid_third) filter (where boat_number between 2 and 4), 50) m3,
  count(*) filter (where boat_number >= 5 and t6) danger, count(*) filter (where boat_number between 2 and 4 and t7) unstable from race_entry e left join ty on ty.registration_number = e.registration_number group by 1)
select race_id, cast(greatest(0, least(100, floor(round(s * 0.4e0 + m2 * 0.3e0 + o3 * 0.3e0 - danger * 5 - unstable * 3 - case when m2 < 60 then 10 else 0 end - case when o3 < 55 then 10 else 0 end, 9) + 0.5))) as bigint) main_structure,
 cast(greatest(0, least(100, floor(round(s * 0.4e0 + o2 * 0.35e0 + m3 * 0.25e0 - case when o2 < 55 then 15 else 0 end - case when m3 < 55 then 10 else 0 end, 9) + 0.5))) as bigint) ura_structure from m""")
def race_structure(spark, d):
    """Structure of every race from the evaluations and kinds of its racers."""
    n, own = tasks_for(spark, d, "orders", 6), fixture(spark, d, "race_entry").select("race_id", "boat_number", "registration_number")
    boats = dealt(own, n, "registration_number").join(dealt(_typed(spark, d), n, "registration_number"), "registration_number", "left")
    return evaluation.race_structure(dealt(boats, n, "race_id"))
