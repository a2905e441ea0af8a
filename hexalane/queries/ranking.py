"""Ranking, de-duplication and rolling windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking as rk
from ..operators.merge import analysis_rank
from ..sources.fixtures import fixture
from .registry import query


@query("select race_id, stage, dup_no, judgment from (select *, row_number() over (partition by race_id, stage order by captured_at desc, dup_no desc) w from uichi_analysis) where w = 1")
def latest_per_key(spark, d):
    return rk.latest(fixture(spark, d, "uichi_analysis"), ["race_id", "stage"], "captured_at", "dup_no").select("race_id", "stage", "dup_no", "judgment")


@query("select race_id, dup_no, final_judgment from (select *, row_number() over (partition by race_id order by case when final_judgment in ('BUY', 'WATCH', 'SKIP') then 0 else 1 end, dup_no desc) w from alert where status <> 'filtered_out') where w = 1")
def dedup_alerts(spark, d):
    decided = F.when(F.col("final_judgment").isin("BUY", "WATCH", "SKIP"), 0).otherwise(1)
    return rk.first_by(fixture(spark, d, "alert").where("status <> 'filtered_out'"), ["race_id"], decided, F.desc("dup_no")).select("race_id", "dup_no", "final_judgment")


@query("select race_id, stage, judgment from (select *, row_number() over (partition by race_id order by case when stage = 'final' and judgment <> 'PENDING' then 4 when stage = 'pre' then 2 else 1 end desc, dup_no desc) w from uichi_analysis) where w = 1")
def effective_analysis(spark, d):
    order = F.when((F.col("stage") == "final") & (F.col("judgment") != "PENDING"), 4).when(F.col("stage") == "day", 3).when(F.col("stage") == "pre", 2).otherwise(1)
    return rk.first_by(fixture(spark, d, "uichi_analysis"), ["race_id"], order.desc(), F.desc("dup_no")).select("race_id", "stage", "judgment")


@query("""select race_id, dup_no, judgment from (select *, row_number() over (partition by race_id order by case when exhibition_ready then 1000 else 0 end + case exhibition_gate_status when 'PASS' then 500 when 'CAUTION' then 400 when 'FAIL' then 300 else 0 end
 + case when exhibition_time is not null then 50 else 0 end + case when judgment <> 'PENDING' then 100 else 0 end desc, dup_no desc) w from uichi_analysis) where w = 1""")
def dedup_analysis(spark, d):
    a = fixture(spark, d, "uichi_analysis")
    return rk.first_by(a, ["race_id"], analysis_rank(a).desc(), F.desc("dup_no")).select("race_id", "dup_no", "judgment")


@query("select race_date, venue_code, race_number, race_id, filled from (select *, row_number() over (partition by race_date, venue_code, race_number order by filled desc, race_id desc) w from (select *, case when race_name is null then 0 else 1 end + case when weather is null then 0 else 1 end + case when wind_speed is null then 0 else 1 end + case when data_source is null then 0 else 1 end filled from race)) where w = 1")
def dedup_races(spark, d):
    """One race per logical key: the one with most fields, then the newest."""
    r = fixture(spark, d, "race").withColumn("filled", rk.filled(["race_name", "weather", "wind_speed", "data_source"]))
    return rk.latest(r, ["race_date", "venue_code", "race_number"], "filled", "race_id").select("race_date", "venue_code", "race_number", "race_id", "filled")


@query("""select race_date, venue_code, race_number, arg_max(race_name, race_id) filter (where race_name is not null) race_name, arg_max(weather, race_id) filter (where weather is not null) weather, arg_max(wind_speed, race_id) filter (where wind_speed is not null) wind_speed from race group by 1, 2, 3""")
def merge_entries(spark, d):
    """Duplicates merged: of each column the newest value that is there."""
    return rk.merged(fixture(spark, d, "race"), ["race_date", "venue_code", "race_number"], ["race_name", "weather", "wind_speed"], "race_id")


@query("select race_id, boat_number, cast(row_number() over (partition by race_id order by exhibition_time, boat_number) as int) place, cast(rank() over (partition by race_id order by exhibition_time) as int) tied from race_entry where not is_scratched")
def exhibition_rank(spark, d):
    w = Window.partitionBy("race_id")
    e = fixture(spark, d, "race_entry").where("not is_scratched")
    return e.select("race_id", "boat_number", F.row_number().over(w.orderBy("exhibition_time", "boat_number")).alias("place"), F.rank().over(w.orderBy("exhibition_time")).alias("tied"))


@query("select boat1_registration_number, race_id, cast(w as int) place from (select *, row_number() over (partition by boat1_registration_number order by race_date desc, race_id desc) w from race_result) where w <= 10")
def recent_n(spark, d):
    r = fixture(spark, d, "race_result").select("boat1_registration_number", "race_date", "race_id")
    return rk.first_n(r, ["boat1_registration_number"], 10, F.desc("race_date"), F.desc("race_id")).select("boat1_registration_number", "race_id", "place")


@query("""v as (select venue_code, race_number, round(count(*) filter (where trifecta in ('1-2-5','1-2-6','1-3-5','1-3-6','1-4-5','1-4-6')) / count(*), 6) a, round(count(*) filter (where trifecta in ('1-5-2','1-5-3','1-5-4','1-6-2','1-6-3','1-6-4')) / count(*), 6) b,
  round(count(*) filter (where trifecta in ('1-3-2','1-4-2','1-5-2','1-6-2')) / count(*), 6) c, round(count(*) filter (where trifecta in ('2-1-3','2-1-4','2-1-5','2-1-6')) / count(*), 6) e from race_result group by 1, 2)
select r.race_id, case greatest(a, b, c, e) when a then 'MAIN' when b then 'URA' when c then 'NEW_MAIN' else 'NEW_URA' end best from race r join v on v.venue_code = r.venue_code and v.race_number = r.race_number""")
def argmax_pattern(spark, d):
    """The pattern of the highest rate at each race's venue and number; of equal ones the first."""
    from ..operators import aggregates as agg

    rates = agg.venue_race_stats(agg.venue_race_partial(fixture(spark, d, "race_result")))
    both = fixture(spark, d, "race").select("race_id", "venue_code", "race_number").join(rates, ["venue_code", "race_number"])
    return both.select("race_id", rk.argmax({p: F.col(c) for p, c in agg.RATES.items()}).alias("best"))


@query("""b as (select *, case grade_class when 'A1' then 1e0 when 'A2' then 0.85e0 when 'B1' then 0.65e0 else 0.45e0 end g from race_entry where boat_number = 5),
r as (select race_id, unnest([{'l': 'grade', 's': floor(g * 15 + 0.5), 'i': 0}, {'l': 'national', 's': floor(least(1e0, national_3rate / 65e0) * 25e0 + 0.5e0), 'i': 1}, {'l': 'local', 's': floor(least(1e0, local_3rate / 65e0) * 20e0 + 0.5e0), 'i': 2}, {'l': 'motor3', 's': floor(least(1e0, motor_3rate / 60e0) * 20e0 + 0.5e0), 'i': 3}, {'l': 'motor2', 's': floor(least(1e0, motor_2rate / 45e0) * 10e0 + 0.5e0), 'i': 4}]) x, national_3rate n3 from b)
select race_id, string_agg(x.l, ',' order by w) reasons from (select race_id, x, row_number() over (partition by race_id order by x.s desc, x.i) w from r where not (x.l = 'national' and n3 is null)) where w <= 3 group by race_id""")
def topk_reasons(spark, d):
    """The three strongest reasons for the boat in lane 5, equal ones in their given order."""
    from ..functions.kernels import grade_points, part
    from ..functions.numbers import half_up

    reason = lambda label, s: F.when(s.isNotNull(), F.struct(F.lit(label).alias("label"), half_up(s).alias("strength")))
    c = F.col
    all_ = F.array(
        reason("grade", grade_points(c("grade_class")) * 15), reason("national", part(c("national_3rate"), 65, 25)), reason("local", part(c("local_3rate"), 65, 20)),
        reason("motor3", part(c("motor_3rate"), 60, 20)), reason("motor2", part(c("motor_2rate"), 45, 10)),
    )
    return fixture(spark, d, "race_entry").where("boat_number = 5").select("race_id", F.array_join(F.transform(rk.top_reasons(all_, 3), lambda r: r["label"]), ",").alias("reasons"))


@query("select race_id, dup_no, (race_id * 7 + dup_no) % 101 as weighted_probability from uichi_analysis where stage = 'final' and expected_value is not null order by 3 desc, race_id, dup_no")
def ranked_races(spark, d):
    """All races with an analysis that says how likely the pattern is, the likeliest first."""
    a = fixture(spark, d, "uichi_analysis").where("stage = 'final' and expected_value is not null")
    return a.select("race_id", "dup_no", F.expr("(race_id * 7 + dup_no) % 101").alias("weighted_probability")).orderBy(F.desc("weighted_probability"), "race_id", "dup_no")


@query("""v as (select boat1_registration_number reg, venue_code, count(*) n, count(*) filter (where result_1 = 1) w from race_result group by 1, 2 having count(*) >= 8) select reg, venue_code, cast(n as bigint) n, cast(p as int) place from (select *, row_number() over (partition by reg order by w / n desc, venue_code) p from v) where p <= 5""")
def best_venues(spark, d):
    from ..functions.numbers import count_where

    v = fixture(spark, d, "race_result").groupBy(F.col("boat1_registration_number").alias("reg"), "venue_code").agg(F.count(F.lit(1)).alias("n"), count_where(F.col("result_1") == 1).alias("w")).where("n >= 8")
    return rk.first_n(v, ["reg"], 5, (F.col("w") / F.col("n")).desc(), F.col("venue_code")).select("reg", "venue_code", "n", "place")


@query("select race_id, round(avg(st_hundredths) over (partition by venue_code order by race_id rows between 49 preceding and current row), 6) mean_50 from race_result")
def rolling_mean_50(spark, d):
    """Mean of a venue's last 50 values, its races dealt to runs so that a venue is many tasks."""
    r, w = rk.in_runs(fixture(spark, d, "race_result").select("venue_code", "race_id", "st_hundredths"), "venue_code", "race_id", 100_000, 50)
    return r.withColumn("mean_50", F.round(F.avg("st_hundredths").over(w), 6)).where("_own").select("race_id", "mean_50")


@query("""select race_id, case when count(*) over w >= 10 and avg(case when race_id % 3 = 0 then 1 else 0 end) over w > 0.34 then 1 else 2 end concurrency from race window w as (partition by venue_code order by race_id rows between 29 preceding and current row)""")
def rolling_error_rate(spark, d):
    r, w = rk.in_runs(fixture(spark, d, "race").select("venue_code", "race_id"), "venue_code", "race_id", 100_000, 30)
    bad, n = F.avg((F.col("race_id") % 3 == 0).cast("int")).over(w), F.count(F.lit(1)).over(w)
    return r.withColumn("concurrency", F.when((n >= 10) & (bad > 0.34), 1).otherwise(2)).where("_own").select("race_id", "concurrency")


@query("select race_id, tick_id from (select race_id, tick_id, row_number() over (partition by race_id order by captured_at, tick_id) w from (select distinct race_id, tick_id, captured_at from odds_snapshot)) where w <= 10")
def odds_history(spark, d):
    t = fixture(spark, d, "odds_snapshot").select("race_id", "tick_id", "captured_at").distinct()
    return rk.first_n(t, ["race_id"], 10, F.col("captured_at"), F.col("tick_id")).select("race_id", "tick_id")
