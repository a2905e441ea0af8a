"""Joins: nesting, look-ups, as-of, orphans, mismatches."""

from pyspark.sql import functions as F

from ..functions.text import wind_group
from ..operators import aggregates as agg
from ..operators import joins as jn
from ..operators.ranking import latest
from ..sources.fixtures import fixture
from .registry import query


@query("select race_id, string_agg(registration_number, ',' order by boat_number) regs, cast(count(*) as bigint) n from race_entry group by race_id")
def entries_nested(spark, d):
    return fixture(spark, d, "race_entry").groupBy("race_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("boat_number", "registration_number"))), lambda x: x["registration_number"]), ",").alias("regs"), F.count(F.lit(1)).alias("n"))


@query("select race_id, combo, tick_id, odds from (select *, row_number() over (partition by race_id, combo order by captured_at desc, tick_id desc) w from odds_snapshot) where w = 1")
def latest_odds(spark, d):
    return latest(fixture(spark, d, "odds_snapshot"), ["race_id", "combo"], "captured_at", "tick_id").select("race_id", "combo", "tick_id", "odds")


ASOF = """select race_id, point_id, series_score from (select r.race_id, s.point_id, s.series_score, row_number() over (partition by r.race_id order by s.as_of_date desc nulls last, s.point_id desc) w
 from race_result r left join series_point s on s.series_key = concat(r.venue_code, '_', substr(cast(r.race_date as string), 1, 7)) and s.registration_number = r.boat1_registration_number and s.as_of_date {} r.race_date) where w = 1"""


def _points(spark, d, strict):
    key = F.concat_ws("_", "venue_code", F.date_format("race_date", "yyyy-MM"))
    left = fixture(spark, d, "race_result").select("race_id", "race_date", key.alias("series_key"), F.col("boat1_registration_number").alias("registration_number"))
    return jn.as_of(left, fixture(spark, d, "series_point"), ["series_key", "registration_number"], "race_date", "as_of_date", "point_id", ["point_id", "series_score"], "race_id", strict).select("race_id", "point_id", "series_score")


@query(ASOF.format("<"))
def asof_series(spark, d):
    return _points(spark, d, True)


@query(ASOF.format("<="))
def asof_on_or_before(spark, d):
    return _points(spark, d, False)


@query("select n.entry_key, n.registration_number from official_new n where not exists (select 1 from official_old o where o.entry_key = n.entry_key)")
def anti_orphans(spark, d):
    return jn.orphans(fixture(spark, d, "official_new"), fixture(spark, d, "official_old"), ["entry_key"]).select("entry_key", "registration_number")


@query("select n.entry_key, o.entry_key is null missing from official_new n left join official_old o on o.entry_key = n.entry_key where o.entry_key is null or n.registration_number is distinct from o.registration_number or n.motor_number is distinct from o.motor_number")
def entry_mismatch(spark, d):
    return jn.mismatches(fixture(spark, d, "official_new"), fixture(spark, d, "official_old"), ["entry_key"], ["registration_number", "motor_number"]).select("entry_key", "missing")


@query("""c as (select race_date, venue_code, race_number, min(race_id) canonical from race group by 1, 2, 3) select r.race_id, c.canonical from race r join c on c.race_date = r.race_date and c.venue_code = r.venue_code and c.race_number = r.race_number where r.race_id <> c.canonical""")
def id_remap(spark, d):
    """Duplicate ids and the canonical id of their logical key."""
    r = fixture(spark, d, "race").select("race_date", "venue_code", "race_number", "race_id")
    keys = ["race_date", "venue_code", "race_number"]
    return r.join(r.groupBy(*keys).agg(F.min("race_id").alias("canonical")), keys).where("race_id <> canonical").select("race_id", "canonical")


@query("""p as (select race_id, arg_max(boat1_trust_score, dup_no) t from uichi_analysis where stage = 'pre' group by 1) select a.race_id, a.dup_no, a.boat1_trust_score - p.t delta from uichi_analysis a left join p on p.race_id = a.race_id where a.stage = 'final'""")
def pre_final_delta(spark, d):
    a = fixture(spark, d, "uichi_analysis")
    pre = a.where("stage = 'pre'").groupBy("race_id").agg(F.max(F.struct("captured_at", "dup_no", "boat1_trust_score")).alias("latest")).select("race_id", F.col("latest.boat1_trust_score").alias("t"))
    return a.where("stage = 'final'").join(pre, "race_id", "left").select("race_id", "dup_no", (F.col("boat1_trust_score") - F.col("t")).alias("delta"))


WIND = "case when {0} is null then 'unknown' when {0} <= 1 then '0-1' when {0} <= 3 then '2-3' when {0} <= 5 then '4-5' else '6+' end"


@query(f"""w as (select r.boat1_registration_number reg, r.venue_code, h.weather, {WIND.format('h.wind_speed')} wg, count(*) n from race_result r join race h on h.race_id = r.race_id where h.weather is not null group by 1, 2, 3, 4)
select r.race_id, cast(w.n as bigint) same_weather_races from race_result r join race h on h.race_id = r.race_id left join w on w.reg = r.boat1_registration_number and w.venue_code = r.venue_code and w.weather = h.weather and w.wg = {WIND.format('h.wind_speed')}""")
def weather_join(spark, d):
    r, h = fixture(spark, d, "race_result"), fixture(spark, d, "race")
    stats = agg.racer_weather_stats(r, h).select("registration_number", "venue_code", "weather", "wind_speed_group", F.col("races").alias("same_weather_races"))
    own = r.select("race_id", "venue_code", F.col("boat1_registration_number").alias("registration_number")).join(h.select("race_id", "weather", wind_group("wind_speed").alias("wind_speed_group")), "race_id")
    return jn.lookup(own, stats, ["registration_number", "venue_code", "weather", "wind_speed_group"]).select("race_id", "same_weather_races")


@query("""v as (select venue_code, race_number, count(*) n from race_result group by 1, 2), b as (select boat1_registration_number reg, venue_code, count(*) n from race_result group by 1, 2)
select r.race_id, cast(v.n as bigint) total_races, cast(b.n as bigint) racer_races from race_result r left join v on v.venue_code = r.venue_code and v.race_number = r.race_number left join b on b.reg = r.boat1_registration_number and b.venue_code = r.venue_code""")
def feature_join(spark, d):
    r = fixture(spark, d, "race_result")
    vrs = agg.venue_race_stats(agg.venue_race_partial(r)).select("venue_code", "race_number", "total_races")
    rvs = agg.racer_venue_stats(r).select(F.col("registration_number").alias("boat1_registration_number"), "venue_code", F.col("boat1_races").alias("racer_races"))
    return jn.lookup(jn.lookup(r, vrs, ["venue_code", "race_number"]), rvs, ["boat1_registration_number", "venue_code"]).select("race_id", "total_races", "racer_races")


@query("""t as (select registration_number, max(term_no) term_no from racer_term group by 1) select e.race_id, e.boat_number, t.term_no from race_entry e left join t on t.registration_number = e.registration_number""")
def entry_eval_join(spark, d):
    e = fixture(spark, d, "race_entry").select("race_id", "boat_number", "registration_number")
    last = latest(fixture(spark, d, "racer_term").select("registration_number", "term_no", "term_code"), ["registration_number"], "term_no").select("registration_number", "term_no")
    return jn.lookup(e, last, ["registration_number"]).select("race_id", "boat_number", "term_no")
