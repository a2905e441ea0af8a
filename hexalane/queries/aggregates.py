"""Aggregates and reports."""

from pyspark.sql import functions as F

from ..functions.numbers import count_where, rate
from ..functions.patterns import hit
from ..operators import aggregates as agg
from ..plans import reports
from ..sources.fixtures import fixture
from .registry import ORACLES, QUERIES, query, sql_in

HIT = f"trifecta in {sql_in('MAIN')}"
VRS = f"""cast(count(*) as bigint) total_races, cast(count(*) filter (where {HIT}) as bigint) uichi_hits, cast(count(*) filter (where trifecta in {sql_in('URA')}) as bigint) ura_uichi_hits,
  cast(count(*) filter (where trifecta in {sql_in('NEW_MAIN')}) as bigint) new_uichi_hits, cast(count(*) filter (where trifecta in {sql_in('NEW_URA')}) as bigint) new_ura_uichi_hits, cast(count(*) filter (where result_1 = 1) as bigint) boat1_wins"""
VRS_RATES = """round(uichi_hits / total_races, 6) uichi_rate, round(ura_uichi_hits / total_races, 6) ura_uichi_rate, round(new_uichi_hits / total_races, 6) new_uichi_rate, round(new_ura_uichi_hits / total_races, 6) new_ura_uichi_rate, round(boat1_wins / total_races, 6) boat1_win_rate"""
VRS_SQL = f"s as (select venue_code, race_number, {VRS} from race_result group by venue_code, race_number) select *, {VRS_RATES} from s"
ST = "case when count(*) filter (where st_hundredths > 0) > 0 then round(sum(st_hundredths) filter (where st_hundredths > 0) / count(*) filter (where st_hundredths > 0) / 100, 6) end"


@query(VRS_SQL)
def venue_race_stats(spark, d):
    return agg.venue_race_stats(agg.venue_race_partial(fixture(spark, d, "race_result")))


@query(VRS_SQL)
def merge_daily(spark, d):
    """The same statistics from partials per day, as a nightly job keeps them."""
    days = agg.venue_race_partial(fixture(spark, d, "race_result"), "race_date")
    return agg.venue_race_stats(agg.merge(days.drop("race_date"), ["venue_code", "race_number"]))


@query(f"""o as (select *, boat1_registration_number reg, row_number() over (partition by boat1_registration_number order by race_date desc, race_id desc) place from race_result),
l as (select reg, string_agg(cast(race_id as string), ',' order by place) recent_races from o where place <= 20 group by reg),
n as (select reg, arg_min(boat1_racer_name, (race_date, race_id)) racer_name from o where boat1_racer_name is not null group by reg)
select o.reg registration_number, coalesce(any_value(n.racer_name), '') racer_name, cast(count(*) as bigint) boat1_races, cast(count(*) filter (where result_1 = 1) as bigint) boat1_wins, cast(count(*) filter (where result_2 = 1) as bigint) boat1_2nd,
  cast(count(*) filter (where result_3 = 1) as bigint) boat1_3rd, cast(count(*) filter (where {HIT}) as bigint) uichi_count, max(boat1_f_count) f_count, cast(count(*) filter (where st_hundredths > 0) as bigint) st_count,
  round(count(*) filter (where result_1 = 1) / count(*), 6) boat1_win_rate, round(count(*) filter (where result_1 = 1 or result_2 = 1) / count(*), 6) boat1_2rate,
  round(count(*) filter (where result_1 = 1 or result_2 = 1 or result_3 = 1) / count(*), 6) boat1_3rate, {ST} avg_st, any_value(l.recent_races) recent_races
from o join l on l.reg = o.reg left join n on n.reg = o.reg group by o.reg""")
def racer_stats(spark, d):
    return agg.racer_stats(fixture(spark, d, "race_result"))


@query(f"""select boat1_registration_number registration_number, venue_code, cast(count(*) as bigint) boat1_races, cast(count(*) filter (where result_1 = 1) as bigint) boat1_wins, cast(count(*) filter (where {HIT}) as bigint) uichi_hits,
  round(count(*) filter (where result_1 = 1) / count(*), 6) boat1_win_rate, round(count(*) filter (where {HIT}) / count(*), 6) uichi_rate, {ST} avg_st, cast(count(*) filter (where st_hundredths > 0) as bigint) st_count from race_result group by 1, 2""")
def racer_venue_stats(spark, d):
    return agg.racer_venue_stats(fixture(spark, d, "race_result"))


@query(f"""select boat1_registration_number registration_number, 1 as lane, cast(count(*) as bigint) races, cast(count(*) filter (where result_1 = 1) as bigint) wins, cast(count(*) filter (where result_2 = 1) as bigint) as second, cast(count(*) filter (where result_3 = 1) as bigint) third,
  round(count(*) filter (where result_1 = 1) / count(*), 6) win_rate, round(count(*) filter (where result_1 = 1 or result_2 = 1) / count(*), 6) second_rate, round(count(*) filter (where result_1 = 1 or result_2 = 1 or result_3 = 1) / count(*), 6) third_rate, {ST} avg_st from race_result group by 1""")
def racer_lane_stats(spark, d):
    return agg.racer_lane_stats(fixture(spark, d, "race_result"))


WIND = "case when {0} is null then 'unknown' when {0} <= 1 then '0-1' when {0} <= 3 then '2-3' when {0} <= 5 then '4-5' else '6+' end"


@query(f"""select r.boat1_registration_number registration_number, r.venue_code, h.weather, {WIND.format('h.wind_speed')} wind_speed_group, cast(count(*) as bigint) races, cast(count(*) filter (where result_1 = 1) as bigint) wins,
  round(count(*) filter (where result_1 = 1) / count(*), 6) win_rate, {ST} avg_st from race_result r join race h on h.race_id = r.race_id where h.weather is not null group by 1, 2, 3, 4""")
def racer_weather_stats(spark, d):
    return agg.racer_weather_stats(fixture(spark, d, "race_result"), fixture(spark, d, "race"))


def _rerun(spark, d, partial):
    """Daily partials as stored, those of one day in ten from half its races, and those days run again whole."""
    r = fixture(spark, d, "race_result")
    again = F.dayofmonth("race_date") % 10 == 3
    return agg.replaced(partial(r.where(~again | (F.col("race_id") % 2 == 0))), partial(r.where(again))).drop("race_date")


def merge_daily_racer(spark, d):
    """Racers from daily partials after days ran again: counters, maxima, earliest names and the latest twenty races."""
    days = _rerun(spark, d, lambda r: agg.racer_partial(r, "race_date"))
    return agg.racer_final(agg.merge(days, [agg.RACER], **agg.RACER_STATE))


def merge_daily_racer_venue(spark, d):
    return agg.racer_venue_final(agg.merge(_rerun(spark, d, lambda r: agg.racer_venue_partial(r, "race_date")), [agg.RACER, "venue_code"]))


def merge_daily_lane(spark, d):
    return agg.racer_lane_final(agg.merge(_rerun(spark, d, lambda r: agg.racer_lane_partial(r, "race_date")), [agg.RACER]))


def merge_daily_weather(spark, d):
    races = fixture(spark, d, "race")
    return agg.racer_weather_final(agg.merge(_rerun(spark, d, lambda r: agg.racer_weather_partial(r, races, "race_date")), agg.WEATHER_KEYS))


# merged days have to give what a full rebuild gives
for _merged, _whole in ((merge_daily_racer, "racer_stats"), (merge_daily_racer_venue, "racer_venue_stats"), (merge_daily_lane, "racer_lane_stats"), (merge_daily_weather, "racer_weather_stats")):
    QUERIES[_merged.__name__], ORACLES[_merged.__name__] = _merged, ORACLES[_whole]


@query(f"""v as (select lpad(cast(n as string), 2, '0') venue_code from (select unnest(range(1, 25)) n)), s as (select venue_code, count(*) total, count(*) filter (where {HIT}) hits, count(*) filter (where result_1 = 1) c1,
  {', '.join(f"count(*) filter (where trifecta = '{c}') x{i}" for i, c in enumerate(('1-2-5', '1-2-6', '1-3-5', '1-3-6', '1-4-5', '1-4-6')))} from race_result group by venue_code)
select v.venue_code, cast(coalesce(total, 0) as bigint) total_races, cast(coalesce(hits, 0) as bigint) uichi_hits, coalesce(round(c1 / total, 4), 0) c1_win_rate, coalesce(round(hits / total, 4), 0) uichi_rate,
  {', '.join(f"coalesce(round(x{i} / total, 4), 0) combo_{c}_rate" for i, c in enumerate(('1_2_5', '1_2_6', '1_3_5', '1_3_6', '1_4_5', '1_4_6')))} from v left join s on s.venue_code = v.venue_code""")
def venue_stats(spark, d):
    venues = spark.range(1, 25).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("venue_code"))
    return agg.venue_stats(fixture(spark, d, "race_result"), venues)


def _returns_sql(key: str, stake: int, source: str, more: str = "") -> str:
    lead = f"{key}, " if key else ""
    tail = f"group by {key}" if key else ""
    return f"""s as (select {lead}cast(count(*) as bigint) total, cast(count(*) filter (where {HIT}) as bigint) hits, cast(coalesce(sum(payout_trifecta) filter (where {HIT}), 0) as bigint) payout{more} from {source} {tail})
    select *, cast(total * {stake} as bigint) investment, case when total > 0 then round(hits / total, 6) else 0 end rate, case when total > 0 then round(payout / (total * {stake}), 6) else 0 end return_rate from s"""


MONTH = "(select *, strftime(race_date, '%Y-%m') as month from race_result)"


@query(_returns_sql("month", 600, MONTH))
def trends_month(spark, d):
    return reports.trends(fixture(spark, d, "race_result"), "month")


@query(_returns_sql("venue_code", 600, "race_result") + " where total >= 10")
def trends_venue(spark, d):
    return reports.trends(fixture(spark, d, "race_result"), "venue_code", 10)


@query(_returns_sql("", 600, "race_result"))
def trends_overall(spark, d):
    return reports.trends(fixture(spark, d, "race_result"))


@query(f"select boat1_grade_class, cast(count(*) as bigint) total, cast(count(*) filter (where {HIT}) as bigint) hits from race_result where boat1_racer_name is not null group by 1")
def stats_by_grade(spark, d):
    return reports.stats_by(fixture(spark, d, "race_result").where("boat1_racer_name is not null"), "boat1_grade_class")


@query(f"select n.n race_number, cast(count(race_id) as bigint) total, cast(count(race_id) filter (where {HIT}) as bigint) hits from (select unnest(range(1, 13)) n) n left join race_result on race_number = n.n group by n.n")
def stats_by_racenum(spark, d):
    return reports.stats_by_race_number(fixture(spark, d, "race_result"))


@query(f"select trifecta, cast(count(*) as bigint) as count, cast(sum(payout_trifecta) as bigint) sum_payout from race_result where {HIT} group by trifecta")
def stats_by_combo(spark, d):
    return reports.stats_by_combo(fixture(spark, d, "race_result"))


@query(f"""b as (select count(*) n, count(*) filter (where {HIT}) h, sum(payout_trifecta) filter (where {HIT}) p from uichi_analysis a join race_result r on r.race_id = a.race_id where judgment = 'BUY')
select cast(count(*) as bigint) total, cast(count(boat1_racer_name) as bigint) total_with_details, cast(count(*) filter (where {HIT}) as bigint) hits, cast(any_value(b.n) as bigint) buy_count, round(any_value(b.h / b.n), 6) buy_hit_rate, round(any_value(b.p / (b.n * 600)), 6) buy_recovery from race_result, b""")
def stats_overall(spark, d):
    r = fixture(spark, d, "race_result")
    main = hit("MAIN", "trifecta")
    buys = reports.with_result(fixture(spark, d, "uichi_analysis").where("judgment = 'BUY'"), r).agg(F.count(F.lit(1)).alias("buy_count"), count_where(main).alias("h"), F.sum(F.when(main, F.col("payout_trifecta"))).alias("p"))
    whole = r.agg(F.count(F.lit(1)).alias("total"), F.count("boat1_racer_name").alias("total_with_details"), count_where(main).alias("hits"))
    both = whole.withColumn("one", F.lit(1)).join(buys.withColumn("one", F.lit(1)), "one")
    return both.select("total", "total_with_details", "hits", "buy_count", F.round(rate("h", "buy_count"), 6).alias("buy_hit_rate"), F.round(rate("p", F.col("buy_count") * 600), 6).alias("buy_recovery"))


BUYS = "(select a.*, r.trifecta, r.payout_trifecta, strftime(a.race_date, '%Y-%m') as month from uichi_analysis a join race_result r on r.race_id = a.race_id where stage = 'final' and judgment = 'BUY')"


@query(_returns_sql("month", 100, BUYS, ", cast(floor(avg(coalesce(expected_value, 0)) + 0.5) as bigint) avg_ev"))
def buy_performance(spark, d):
    return reports.buy_performance(fixture(spark, d, "uichi_analysis"), fixture(spark, d, "race_result"))


@query(f"""e(band, low, high) as (values ('100-120', 100, 120), ('120-140', 120, 140), ('140-160', 140, 160), ('160-200', 160, 200), ('200+', 200, 1000000)), x as {BUYS},
s as (select band, cast(count(race_id) as bigint) total, cast(count(race_id) filter (where {HIT}) as bigint) hits, cast(coalesce(sum(payout_trifecta) filter (where {HIT}), 0) as bigint) payout from e left join x on coalesce(expected_value, 0) >= low and coalesce(expected_value, 0) < high group by band)
select *, cast(total * 100 as bigint) investment, case when total > 0 then round(hits / total, 6) else 0 end rate, case when total > 0 then round(payout / (total * 100), 6) else 0 end return_rate from s""")
def ev_bins(spark, d):
    return reports.ev_bins(fixture(spark, d, "uichi_analysis"), fixture(spark, d, "race_result"))


BAND = "case when s < 40 then '0-39' when s < 55 then '40-54' when s < 70 then '55-69' when s < 85 then '70-84' else '85-100' end"


@query(f"""x as (select 'MAIN' kind, main_score s, trifecta in {sql_in('MAIN')} h from player_structure p join race_result r on r.race_id = p.race_id union all select 'URA', ura_score, trifecta in {sql_in('URA')} from player_structure p join race_result r on r.race_id = p.race_id)
select kind, {BAND} band, cast(count(*) as bigint) total, cast(count(*) filter (where h) as bigint) hits, round(count(*) filter (where h) / count(*), 6) hit_rate from x group by 1, 2""")
def structure_bins(spark, d):
    return reports.structure_bins(fixture(spark, d, "player_structure"), fixture(spark, d, "race_result"))


ALERTS = f"""al as (select * from (select *, row_number() over (partition by race_id order by case when final_judgment is not null and final_judgment <> 'PENDING' then 1 else 0 end desc, dup_no desc) w from alert where status <> 'filtered_out') where w = 1),
fa as (select * from (select race_id, judgment, expected_value, row_number() over (partition by race_id order by captured_at desc, dup_no desc) w from uichi_analysis where stage = 'final') where w = 1),
rr as (select * from (select *, row_number() over (partition by race_date, venue_code, race_number order by race_id desc) w from race_result) where w = 1),
rows_ as (select al.race_id, al.race_date, al.venue_code, al.race_number, pre_grade, pre_appearance_rate, coalesce(fa.judgment, al.final_judgment) judgment, coalesce(fa.expected_value, al.final_expected_value) expected_value,
  rr.trifecta is not null completed, rr.trifecta, rr.payout_trifecta, case when rr.trifecta is not null then rr.{HIT} end is_hit
from al left join fa on fa.race_id = al.race_id left join rr on rr.race_date = al.race_date and rr.venue_code = al.venue_code and rr.race_number = al.race_number where pre_grade is not null or pre_appearance_rate is not null)"""


@query(ALERTS + " select * from rows_")
def alert_verification(spark, d):
    return reports.alert_rows(fixture(spark, d, "alert"), fixture(spark, d, "uichi_analysis"), fixture(spark, d, "race_result"))


@query(ALERTS + """ select cast(count(*) as bigint) alert_count, cast(count(*) filter (where completed) as bigint) completed_count, cast(count(*) filter (where is_hit) as bigint) hit_count, cast(count(*) filter (where judgment = 'BUY') as bigint) buy_count,
  cast(count(*) filter (where judgment = 'BUY' and is_hit) as bigint) buy_hit_count, cast(count(*) filter (where judgment = 'WATCH') as bigint) watch_count, cast(count(*) filter (where judgment = 'WATCH' and is_hit) as bigint) watch_hit_count,
  cast(count(*) filter (where judgment is null or judgment = 'PENDING') as bigint) no_final_count, round(count(*) filter (where is_hit) / count(*) filter (where completed), 6) hit_rate, round(count(*) filter (where judgment = 'BUY' and is_hit) / count(*) filter (where judgment = 'BUY'), 6) buy_hit_rate,
  round(count(*) filter (where judgment = 'WATCH' and is_hit) / count(*) filter (where judgment = 'WATCH'), 6) watch_hit_rate from rows_""")
def alert_summary(spark, d):
    return reports.alert_summary(alert_verification(spark, d))


def _b(x: str) -> str:
    return f"case when coalesce({x}, 0) < 40 then '0-39' when {x} < 50 then '40-49' when {x} < 60 then '50-59' when {x} < 70 then '60-69' when {x} < 80 then '70-79' else '80-100' end"


OUT = f"""o as (select *, coalesce(program_hypothesis, 'UNKNOWN') hy, coalesce(program_scenario_status, 'UNKNOWN') sc, coalesce(recommended_pattern, 'UNKNOWN') pa, coalesce(logic_mode, 'OTHER') mo, trifecta in {sql_in('MAIN')} m, trifecta in {sql_in('URA')} u, trifecta in {sql_in('NEW_MAIN')} nm, trifecta in {sql_in('NEW_URA')} nu from learning_sample)"""
OUTCOME = "case when m then 'MAIN' when u then 'URA' when nm then 'NEW_MAIN' when nu then 'NEW_URA' else 'OTHER' end"
RECOMMENDED = "case recommended_pattern when 'MAIN' then m when 'URA' then u when 'NEW_MAIN' then nm when 'NEW_URA' then nu else false end"
DIMS = {"program_hypothesis": "hy", "scenario_status": "sc", "recommended_pattern": "pa", "intent_confidence_bucket": _b("program_intent_confidence"), "escape_execution_bucket": _b("racer_escape_execution"), "direction_confidence_bucket": _b("direction_confidence"), "hypothesis_x_escape": f"concat(hy, '|', {_b('racer_escape_execution')})", "scenario_x_pattern": "concat(sc, '|', pa)", "logic_mode": "mo", "series_day": "cast(series_day as string)", "logic_x_pattern": "concat(mo, '|', pa)", "venue_x_logic": "concat(venue_code, '|', mo)"}
CNT = "cast(count(*) filter (where {}) as bigint)"


@query(OUT + ", f as (" + " union all ".join(f"select '{k}' dimension, {v} as value, * from o" for k, v in DIMS.items()) + f"""), g as (select dimension, value, cast(count(*) as bigint) sample_count, {CNT.format('result_1 = 1')} boat1_win_count, {CNT.format('m')} main_hit_count, {CNT.format('u')} ura_hit_count,
  {CNT.format('nm')} new_main_hit_count, {CNT.format('nu')} new_ura_hit_count, {CNT.format(RECOMMENDED)} recommended_hit_count, {CNT.format("(m or u or nm or nu) and final_judgment = 'SKIP'")} false_skip_count, {CNT.format("(m or u or nm or nu) and final_judgment = 'WATCH'")} false_watch_count from f group by 1, 2)
select *, case greatest(main_hit_count, ura_hit_count, new_main_hit_count, new_ura_hit_count) when main_hit_count then 'MAIN' when ura_hit_count then 'URA' when new_main_hit_count then 'NEW_MAIN' else 'NEW_URA' end candidate_pattern,
  round(greatest(main_hit_count, ura_hit_count, new_main_hit_count, new_ura_hit_count) / sample_count, 6) candidate_lift, case when sample_count >= 100 then 'RELIABLE' when sample_count >= 30 then 'CANDIDATE' else 'LEARNING' end candidate_status, sample_count >= 100 reliable from g""")
def learning_metrics(spark, d):
    return reports.learning_metrics(fixture(spark, d, "learning_sample"))


@query(OUT + f" select race_id, result_1 = 1 boat1_win, m main_hit, u ura_hit, nm new_main_hit, nu new_ura_hit, {RECOMMENDED} recommended_hit, {OUTCOME} outcome_pattern, (m or u or nm or nu) and final_judgment = 'SKIP' false_skip, (m or u or nm or nu) and final_judgment = 'WATCH' false_watch from o")
def outcome_attach(spark, d):
    return reports.outcomes(fixture(spark, d, "learning_sample")).select("race_id", "boat1_win", "main_hit", "ura_hit", "new_main_hit", "new_ura_hit", "recommended_hit", "outcome_pattern", "false_skip", "false_watch")


@query("select race_date, cast(count(*) as bigint) races, cast(count(*) filter (where status = 'finished') as bigint) finished, cast(count(distinct venue_code) as bigint) venues, bool_and(status = 'finished') all_done from race group by race_date")
def range_summary(spark, d):
    done = F.col("status") == "finished"
    return fixture(spark, d, "race").groupBy("race_date").agg(F.count(F.lit(1)).alias("races"), count_where(done).alias("finished"), F.count_distinct("venue_code").alias("venues"), F.bool_and(done).alias("all_done"))


DETAIL = "case when race_id % 7 = 0 then 'error' when race_id % 5 = 0 then 'pending' when race_id % 3 = 0 then 'done' end"


@query(f"""x as (select case when datediff('day', race_date, date '1998-08-02') < 30 then '0-29' when datediff('day', race_date, date '1998-08-02') < 90 then '30-89' else '90-179' end tier, {DETAIL} s, boat1_racer_name from race_result where datediff('day', race_date, date '1998-08-02') between 1 and 179)
select tier, cast(count(*) as bigint) total, cast(count(*) filter (where s = 'done' or (s is null and boat1_racer_name is not null)) as bigint) done, cast(count(*) filter (where s = 'error') as bigint) error, cast(count(*) filter (where s is null or s = 'pending') as bigint) pending, round(count(*) filter (where s = 'done' or (s is null and boat1_racer_name is not null)) / count(*), 6) rate from x group by tier""")
def backfill_tiers(spark, d):
    """Detail of past results by age, yesterday the newest: done, failed and open ones."""
    from ..operators.joins import bin_of

    age = F.datediff(F.lit("1998-08-02").cast("date"), "race_date")
    own = fixture(spark, d, "race_result").withColumn("tier", bin_of(age, [("0-29", 1, 30), ("30-89", 30, 90), ("90-179", 90, 180)])).where("tier is not null").withColumn("s", F.expr(DETAIL))
    done = F.coalesce(F.col("s") == "done", F.col("boat1_racer_name").isNotNull())
    per = own.groupBy("tier").agg(F.count(F.lit(1)).alias("total"), count_where(done).alias("done"), count_where(F.col("s") == "error").alias("error"), count_where(F.coalesce("s", F.lit("pending")) == "pending").alias("pending"))
    return per.withColumn("rate", F.round(F.col("done") / F.col("total"), 6))


@query("""d as (select race_date, venue_code, bool_and(status = 'finished') whole, count(*) n, count(*) filter (where status = 'finished') f from race group by 1, 2), s as (select race_date, bool_and(whole) whole, sum(n) n, sum(f) f from d group by 1)
select cast(year(race_date) as int) year_, cast(count(*) as bigint) n_days, cast(count(*) filter (where whole) as bigint) days_done, cast(sum(n) as bigint) races, cast(sum(f) as bigint) finished from s group by 1""")
def historical_summary(spark, d):
    """Days, and days of which every venue is done, per year."""
    done = F.col("status") == "finished"
    venues = fixture(spark, d, "race").groupBy("race_date", "venue_code").agg(F.bool_and(done).alias("whole"), F.count(F.lit(1)).alias("n"), count_where(done).alias("f"))
    days = venues.groupBy("race_date").agg(F.bool_and("whole").alias("whole"), F.sum("n").alias("n"), F.sum("f").alias("f"))
    return days.groupBy(F.year("race_date").alias("year_")).agg(F.count(F.lit(1)).alias("n_days"), count_where(F.col("whole")).alias("days_done"), F.sum("n").alias("races"), F.sum("f").alias("finished"))


@query("select race_date, cast(count(*) filter (where stage = 'pre') as bigint) pre, cast(count(*) filter (where stage = 'final') as bigint) final_, cast(count(*) filter (where stage = 'final' and judgment = 'BUY') as bigint) buy, cast(count(*) filter (where stage = 'pre' and pre_grade in ('S', 'A')) as bigint) candidates from uichi_analysis group by race_date")
def batch_history(spark, d):
    a = fixture(spark, d, "uichi_analysis")
    pre, final = F.col("stage") == "pre", F.col("stage") == "final"
    return a.groupBy("race_date").agg(count_where(pre).alias("pre"), count_where(final).alias("final_"), count_where(final & (F.col("judgment") == "BUY")).alias("buy"), count_where(pre & F.col("pre_grade").isin("S", "A")).alias("candidates"))


@query("select race_id, boat_number, round(round(avg(exhibition_st) over (partition by race_id), 6) - exhibition_st, 4) st_advantage from race_entry where not is_scratched qualify count(*) over (partition by race_id) = 6")
def st_advantage(spark, d):
    """Lead of each boat over its field's mean timing, only where all six have one."""
    from pyspark.sql import Window

    field = Window.partitionBy("race_id")
    own = fixture(spark, d, "race_entry").where("not is_scratched").select("race_id", "boat_number", "exhibition_st", F.count(F.lit(1)).over(field).alias("n"), F.avg("exhibition_st").over(field).alias("mean"))
    return own.where("n = 6").select("race_id", "boat_number", F.round(F.round("mean", 6) - F.col("exhibition_st"), 4).alias("st_advantage"))


@query("select race_date, venue_code, string_agg(distinct cast(race_number as string), ',' order by cast(race_number as string)) numbers from race group by 1, 2")
def ids_by_venue_day(spark, d):
    """Race numbers per venue day, from textual keys."""
    from ..functions.text import race_key

    parts = fixture(spark, d, "race").select(F.split(race_key(), "_").alias("p")).select(F.col("p")[0].cast("date").alias("race_date"), F.col("p")[1].alias("venue_code"), F.col("p")[2].cast("int").cast("string").alias("n"))
    return parts.groupBy("race_date", "venue_code").agg(F.array_join(F.array_sort(F.collect_set("n")), ",").alias("numbers"))


@query("select cast(count(distinct venue_code) as bigint) venues, cast(count(distinct race_date) as bigint) n_days, cast(count(distinct (race_date, venue_code)) as bigint) venue_days from race")
def distinct_counts(spark, d):
    return fixture(spark, d, "race").agg(F.count_distinct("venue_code").alias("venues"), F.count_distinct("race_date").alias("n_days"), F.count_distinct("race_date", "venue_code").alias("venue_days"))


@query("""c as (select registration_number, boat_number course, cast(count(*) as bigint) race_count, cast(count(*) filter (where finish_order = 1) as bigint) f1, cast(count(*) filter (where finish_order = 2) as bigint) f2, cast(count(*) filter (where finish_order = 3) as bigint) f3,
 round(avg(finish_order), 6) avg_finish, round(stddev_pop(finish_order), 5) std_finish, cast(count(*) filter (where start_timing = 'F') as bigint) f_count, cast(count(*) filter (where start_timing = 'L') as bigint) l_count,
 round(avg(case when start_timing not in ('F', 'L') then cast(start_timing as double) end), 6) avg_st from race_entry where not is_scratched group by 1, 2)
select *, round(f1 / race_count, 6) win_rate, round((f1 + f2) / race_count, 6) top2_rate, round((f1 + f2 + f3) / race_count, 6) top3_rate from c""")
def course_stats(spark, d):
    from ..plans.evaluation import course_stats as stats

    c = stats(fixture(spark, d, "race_entry").where("not is_scratched").withColumnRenamed("boat_number", "course"))
    return c.select("registration_number", "course", "race_count", "f1", "f2", "f3", F.round("avg_finish", 6).alias("avg_finish"), F.round("std_finish", 5).alias("std_finish"), "f_count", "l_count", F.round("avg_st", 6).alias("avg_st"), F.round("win_rate", 6).alias("win_rate"), F.round("top2_rate", 6).alias("top2_rate"), F.round("top3_rate", 6).alias("top3_rate"))


TERM = "t as (select *, row_number() over (partition by registration_number order by term_no desc) w from racer_term), u as (select *, case w when 1 then .34 when 2 then .24 when 3 then .16 when 4 then .11 when 5 then .08 when 6 then .07 end x from t where w <= 6)"


@query(TERM + """ select registration_number, cast(count(*) as bigint) terms, round(cast(sum(win_rate * x) / sum(x) as double), 6) win_rate, round(cast(sum(ability_index * x) / sum(x) filter (where ability_index is not null) as double), 6) ability,
 round(cast(sum(first_place_count / race_count * 100 * x) / sum(x) as double), 6) first_rate from u group by registration_number""")
def term_weighted(spark, d):
    from ..plans.evaluation import term_profile

    p = term_profile(fixture(spark, d, "racer_term"))
    return p.select("registration_number", "terms", *[F.round(c, 6).alias(c) for c in ("win_rate", "ability", "first_rate")])


@query(TERM + """, v as (select *, case w when 1 then .34 when 2 then .24 when 3 then .34 when 4 then .24 when 5 then .16 when 6 then .11 end y from u)
select registration_number, round(coalesce(sum(win_rate * y) filter (where w <= 2) / sum(y) filter (where w <= 2) - sum(win_rate * y) filter (where w > 2) / sum(y) filter (where w > 2), 0), 6) win_trend from v group by registration_number""")
def term_trend(spark, d):
    from ..plans.evaluation import term_profile

    return term_profile(fixture(spark, d, "racer_term")).select("registration_number", F.round("win_trend", 6).alias("win_trend"))


@query("""p(period, months) as (values ('6m', 6), ('1y', 12), ('3y', 36)) select period, registration_number, cast(count(*) as bigint) races, cast(count(*) filter (where finish_order = 1) as bigint) wins from race_entry cross join p
where race_date >= cast(date '1998-08-02' - to_months(months) as date) and race_date <= date '1998-08-02' group by 1, 2""")
def period_fanout(spark, d):
    from ..plans.evaluation import in_periods

    return in_periods(fixture(spark, d, "race_entry"), F.lit("1998-08-02").cast("date")).groupBy("period", "registration_number").agg(F.count(F.lit(1)).alias("races"), count_where(F.col("finish_order") == 1).alias("wins"))


@query("""c as (select registration_number, boat_number, count(*) n, avg(finish_order) a from race_entry where not is_scratched and boat_number between 2 and 4 group by 1, 2)
select registration_number, cast(sum(n) as bigint) race_count, round(sum(a * n) / sum(n), 5) avg_finish from c group by 1""")
def course_weighted(spark, d):
    from ..plans.evaluation import course_stats as stats
    from ..plans.evaluation import over_courses

    c = stats(fixture(spark, d, "race_entry").where("not is_scratched").withColumnRenamed("boat_number", "course"))
    return over_courses(c.where("course between 2 and 4"), ["registration_number"]).select("registration_number", "race_count", F.round("avg_finish", 5).alias("avg_finish"))


@query(f"""s as (select venue_code, race_number, {VRS} from race_result where race_id % 3 <> 0 group by 1, 2), w as (select venue_code, race_number, count(*) n, count(*) filter (where {HIT}) h from race_result group by 1, 2)
select w.venue_code, w.race_number, round(coalesce(case when w.race_number <> 5 then s.uichi_hits / s.total_races end, w.h / w.n), 6) uichi_rate from w left join s on s.venue_code = w.venue_code and s.race_number = w.race_number""")
def pattern_fallback(spark, d):
    """Stored rates, with those that are missing computed from all results."""
    r = fixture(spark, d, "race_result")
    stored = agg.venue_race_stats(agg.venue_race_partial(r.where("race_id % 3 <> 0"))).select("venue_code", "race_number", F.when(F.col("race_number") != 5, F.col("uichi_rate")).alias("stored"))
    own = agg.venue_race_stats(agg.venue_race_partial(r)).select("venue_code", "race_number", F.col("uichi_rate").alias("own"))
    return own.join(stored, ["venue_code", "race_number"], "left").select("venue_code", "race_number", F.coalesce("stored", "own").alias("uichi_rate"))
