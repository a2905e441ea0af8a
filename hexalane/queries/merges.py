"""Imports, upserts and audits."""

from pyspark.sql import functions as F

from ..functions.numbers import count_where
from ..operators import merge as mg
from ..sources.fixtures import fixture, tasks_for
from .registry import query

COLUMNS = ["registration_number", "motor_number"]


@query("""select coalesce(n.entry_key, o.entry_key) entry_key, case when n.entry_key is null then 'absent' when o.entry_key is null then 'create' when n.registration_number is not distinct from o.registration_number and n.motor_number is not distinct from o.motor_number then 'unchanged' else 'update' end as action
 from official_new n full join official_old o on o.entry_key = n.entry_key""")
def import_classify(spark, d):
    return mg.classify(fixture(spark, d, "official_new"), fixture(spark, d, "official_old"), "entry_key", COLUMNS)


@query("""select coalesce(n.entry_key, o.entry_key) entry_key, coalesce(n.registration_number, o.registration_number) registration_number, coalesce(n.motor_number, o.motor_number) motor_number, case when o.record_status = 'CONFIRMED' then 'CONFIRMED' else coalesce(n.record_status, o.record_status) end record_status
 from official_new n full join official_old o on o.entry_key = n.entry_key""")
def upsert_race(spark, d):
    return mg.merge_non_null(fixture(spark, d, "official_new"), fixture(spark, d, "official_old"), "entry_key", [*COLUMNS, "record_status"], {"record_status": "CONFIRMED"})


G = "case {}.exhibition_gate_status when 'PASS' then 4 when 'CAUTION' then 3 when 'FAIL' then 2 when 'MISSING' then 1 else 0 end"


@query(f"""a as (select * from uichi_analysis where dup_no = 0), b as (select * from uichi_analysis where dup_no = 1),
x as (select a.race_id, b.race_id is null or (a.race_id is not null and ((a.exhibition_ready and not b.exhibition_ready) or ({G.format('a')} >= 2 and {G.format('b')} = 1) or (a.judgment <> 'PENDING' and b.judgment = 'PENDING'))) keep, a.judgment ja, b.judgment jb, a.exhibition_gate_status ga, b.exhibition_gate_status gb, a.exhibition_ready ra, b.exhibition_ready rb from a join b on a.race_id = b.race_id)
select race_id, case when keep then ja else jb end judgment, case when keep then ga else gb end exhibition_gate_status, case when keep then ra else rb end exhibition_ready from x""")
def upsert_analysis(spark, d):
    """Later analyses replace earlier ones unless they would be a step back."""
    from ..streaming.ticks import upserted

    a = fixture(spark, d, "uichi_analysis").select("race_id", "dup_no", "judgment", "exhibition_gate_status", "exhibition_ready")
    return upserted(a.where("dup_no = 0").drop("dup_no"), a.where("dup_no = 1").drop("dup_no"), ["race_id"])


@query("""o as (select * from race where race_id % 5 <> 0), n as (select race_id, weather, wind_speed, venue_code from race_result where race_id % 7 <> 0)
select coalesce(o.race_id, n.race_id) race_id, o.race_id is null created, coalesce(o.venue_code, n.venue_code) venue_code, coalesce(o.weather, n.weather) weather, coalesce(o.wind_speed, n.wind_speed) wind_speed from o full join n on n.race_id = o.race_id""")
def v2_to_v1(spark, d):
    """The official table taken into the working one: missing races are added, gaps filled; values that are there stay."""
    n = fixture(spark, d, "race_result").where("race_id % 7 <> 0").select("race_id", F.col("venue_code").alias("v"), F.col("weather").alias("w"), F.col("wind_speed").alias("s"))
    o = fixture(spark, d, "race").where("race_id % 5 <> 0").select("race_id", "venue_code", "weather", "wind_speed", F.lit(False).alias("created"))
    return o.join(n, "race_id", "full").select("race_id", F.coalesce("created", F.lit(True)).alias("created"), F.coalesce("venue_code", "v").alias("venue_code"), F.coalesce("weather", "w").alias("weather"), F.coalesce("wind_speed", "s").alias("wind_speed"))


@query("""c as (select race_date, venue_code, race_number, min(race_id) race_id, count(*) over (partition by race_date, venue_code) x, bool_or(exhibition_ready) warmed_up from race group by 1, 2, 3),
e as (select e.race_id, count(distinct boat_number) filter (where not is_scratched) = 6 all_boats, bool_and(warmup_time is not null) core, bool_and(t.registration_number is not null) evaluated from race_entry e left join (select distinct registration_number from racer_term where term_no < 7) t on t.registration_number = e.registration_number group by 1),
f as (select c.race_date, c.venue_code, c.race_id, case when c.x > 1 then 2 else 1 end expected, e.all_boats, e.core and e.all_boats core, e.evaluated, exists (select 1 from player_structure s where s.race_id = c.race_id and s.race_id % 6 <> 0) structured, exists (select 1 from uichi_analysis a where a.race_id = c.race_id and a.stage = 'pre') pre, c.warmed_up,
  exists (select 1 from odds_final o where o.race_id = c.race_id and o.odds > 1) odds, exists (select 1 from uichi_analysis a where a.race_id = c.race_id and a.stage = 'final' and a.judgment <> 'PENDING') final_ from c join e on e.race_id = c.race_id),
g as (select race_date, venue_code, max(expected) expected, count(*) races, count(*) filter (where all_boats) n_all_boats, count(*) filter (where core) n_core, count(*) filter (where evaluated) n_evaluated, count(*) filter (where structured) n_structured, count(*) filter (where pre) n_pre, count(*) filter (where warmed_up) n_warmed_up, count(*) filter (where odds) n_odds, count(*) filter (where final_) n_final from f group by 1, 2)
select *, case when races = expected and n_all_boats = expected and n_core = expected and n_evaluated = expected and n_structured = expected and n_pre = expected then case when n_warmed_up = expected and n_odds = expected and n_final = expected then 'COMPLETE' else 'PRE_RACE_COMPLETE' end else 'WAITING' end status from g""")
def venue_readiness(spark, d):
    """How far every venue day is, from the flags of its races."""
    from pyspark.sql import Window

    from ..plans.backfill import readiness

    day = ["race_date", "venue_code"]
    own = fixture(spark, d, "race").groupBy(*day, "race_number").agg(F.min("race_id").alias("race_id"), F.bool_or("exhibition_ready").alias("warmed_up"))
    own = own.withColumn("expected", F.when(F.count(F.lit(1)).over(Window.partitionBy(*day)) > 1, 2).otherwise(1))
    known = fixture(spark, d, "racer_term").where("term_no < 7").select("registration_number").distinct().withColumn("_known", F.lit(True))
    e = fixture(spark, d, "race_entry").join(known, "registration_number", "left").groupBy("race_id").agg(
        (F.count_distinct(F.when(~F.col("is_scratched"), F.col("boat_number"))) == 6).alias("all_boats"), F.bool_and(F.col("warmup_time").isNotNull()).alias("whole"), F.bool_and(F.coalesce("_known", F.lit(False))).alias("evaluated")
    )
    a, o = fixture(spark, d, "uichi_analysis"), fixture(spark, d, "odds_final")
    out = own.join(e, "race_id").withColumn("core", F.col("whole") & F.col("all_boats"))
    for name, rows in (("structured", fixture(spark, d, "player_structure").where("race_id % 6 <> 0")), ("pre", a.where("stage = 'pre'")), ("odds", o.where("odds > 1")), ("final", a.where("stage = 'final' and judgment <> 'PENDING'"))):
        out = out.join(rows.select("race_id").distinct().withColumn(name, F.lit(True)), "race_id", "left")
    return readiness(out, day)


@query("""p as (select venue_code, count(distinct race_date) done_days, cast(venue_code as int) v from race group by 1), q as (select venue_code, done_days, 400 target_days, case when v % 3 = 0 then 3 when v % 3 = 1 then 2 else 1 end phase, case v % 4 when 0 then 'TURBO' when 1 then 'SAFE' when 2 then 'DEFERRED' else 'NORMAL' end as "mode", v % 5 errors, v n_durations from p),
b as (select *, case phase when 3 then 8 when 2 then 5 else 3 end b0 from q), c as (select *, case "mode" when 'TURBO' then least(10, floor(b0 * 1.5 + 0.5)) when 'SAFE' then least(3, b0) else b0 end b1 from b),
e as (select *, case when "mode" = 'DEFERRED' then 0 when errors >= 3 then 1 when errors >= 1 then greatest(1, floor(b1 / 2)) else b1 end bs from c), f as (select *, case when n_durations >= 5 then floor(round(bs * case when "mode" = 'SAFE' then 12 else 30 end * 0.8e0, 6) + 0.5e0) end h from e)
select venue_code, cast(bs as bigint) batch_size, cast(h as bigint) venue_days_per_hour, cast(ceil(greatest(target_days - done_days, 0) * 5 / nullif(h, 0) / 24) as bigint) remaining_days from f""")
def eta(spark, d):
    """Batch size, pace and days to go of each venue's backfill."""
    from ..plans.backfill import with_eta

    v = F.col("venue_code").cast("int")
    p = fixture(spark, d, "race").groupBy("venue_code").agg(F.count_distinct("race_date").alias("done_days"))
    p = p.select("venue_code", "done_days", F.lit(400).alias("target_days"), F.when(v % 3 == 0, 3).when(v % 3 == 1, 2).otherwise(1).alias("phase"), F.when(v % 4 == 0, "TURBO").when(v % 4 == 1, "SAFE").when(v % 4 == 2, "DEFERRED").otherwise("NORMAL").alias("mode"), (v % 5).alias("errors"), v.alias("n_durations"))
    return with_eta(p).select("venue_code", "batch_size", "venue_days_per_hour", "remaining_days")


@query("select venue_code, race_number, cast(count(*) as bigint) total_races, cast(count(*) filter (where result_1 = 1) as bigint) boat1_wins from race_result group by 1, 2")
def rebuild_aggregates(spark, d):
    """A full rebuild written whole and read back from its new place."""
    from ..operators import aggregates as agg
    from ..operators.repairs import rebuilt

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return rebuilt(agg.venue_race_partial(fixture(spark, d, "race_result")), root).select("venue_code", "race_number", "total_races", "boat1_wins")


@query("""n as (select race_id, count(*) n from race_entry where not is_scratched group by 1),
v as (select r.race_id, 'few_entries' as rule, cast(coalesce(n.n, 0) as bigint) n from (select distinct race_id from race) r left join n on n.race_id = r.race_id where coalesce(n.n, 0) < 6
 union all select e.race_id, 'orphaned_entries', cast(count(*) as bigint) from race_entry e where not exists (select 1 from race r where r.race_id = e.race_id) group by 1
 union all select race_id, 'pending_final', cast(count(*) as bigint) from uichi_analysis where stage = 'final' and judgment in ('PENDING', 'MISSING') group by 1
 union all select race_id, 'lost_exhibition', cast(count(*) as bigint) from race_entry where exhibition_time is not null and exhibition_st is null and entry_course is null group by 1
 union all select min(race_id), 'duplicate_race', cast(count(*) as bigint) from race group by race_date, venue_code, race_number having count(*) > 1) select * from v""")
def integrity_check(spark, d):
    """Violations of all five rules as one table."""
    from ..operators.quality import integrity_rules, violations

    e, a, r = (fixture(spark, d, t) for t in ("race_entry", "uichi_analysis", "race"))
    return violations(integrity_rules(r, e, a, ~F.col("is_scratched"), tasks=tasks_for(spark, d, "orders", 6)))


@query("""n as (select race_id, count(*) n from race_entry where not is_scratched group by 1),
v as (select r.race_id, 'few_entries' as rule, cast(coalesce(n.n, 0) as bigint) n from (select distinct race_id from race) r left join n on n.race_id = r.race_id where coalesce(n.n, 0) < 6
 union all select e.race_id, 'orphaned_entries', cast(count(*) as bigint) from race_entry e where not exists (select 1 from race r where r.race_id = e.race_id) group by 1
 union all select race_id, 'pending_final', cast(count(*) as bigint) from uichi_analysis where stage = 'final' and judgment in ('PENDING', 'MISSING') group by 1
 union all select race_id, 'lost_exhibition', cast(count(*) as bigint) from race_entry where exhibition_time is not null and exhibition_st is null and entry_course is null group by 1
 union all select min(race_id), 'duplicate_race', cast(count(*) as bigint) from race group by race_date, venue_code, race_number having count(*) > 1) select * from v""")
def integrity_check_whole(spark, d):
    return integrity_check(spark, d)


@query("select race_id, case when status = 'finished' then 'resolved' when pre_grade is null then 'filtered_out' else 'active' end state from (select r.race_id, r.status, a.pre_grade from race r join (select race_id, max(pre_grade) pre_grade from alert group by 1) a on a.race_id = r.race_id)")
def alert_state(spark, d):
    a = fixture(spark, d, "alert").groupBy("race_id").agg(F.max("pre_grade").alias("pre_grade"))
    state = F.when(F.col("status") == "finished", "resolved").when(F.col("pre_grade").isNull(), "filtered_out").otherwise("active")
    return fixture(spark, d, "race").join(a, "race_id").select("race_id", state.alias("state"))


NOTIFY = {"watch": True, "least_ev": 110.0, "least_trust": 60, "only_strong": False, "strong": 85}


@query("""l as (select * from (select *, row_number() over (partition by race_id, stage order by captured_at desc, dup_no desc) w from uichi_analysis) where w = 1),
n as (select race_id, max(case when status = 'resolved' and dup_no = 0 and final_judgment is not null then 1 else 0 end) = 1 told from alert group by 1)
select l.race_id, 'push' as channel, l.judgment from l left join n on n.race_id = l.race_id where stage = 'final' and judgment in ('BUY', 'WATCH') and coalesce(expected_value, 110) >= 110 and coalesce(boat1_trust_score, 60) >= 60 and not coalesce(n.told, false)
union all select l.race_id, concat('chat_', l.stage), l.judgment from l left join n on n.race_id = l.race_id where not coalesce(n.told, false) and ((stage = 'pre' and pre_grade in ('S', 'A')) or (stage = 'final' and judgment in ('BUY', 'WATCH')))
union all select l.race_id, 'chat_result', l.judgment from l left join n on n.race_id = l.race_id where not coalesce(n.told, false) and stage = 'final' and judgment = 'BUY'""")
def notify_candidates(spark, d):
    """Judgments worth a message, per channel; what was told once is not told again, and sending is up to the caller."""
    from ..operators.ranking import latest
    from ..plans.reports import notifications

    last = latest(fixture(spark, d, "uichi_analysis"), ["race_id", "stage"], "captured_at", "dup_no")
    told = fixture(spark, d, "alert").groupBy("race_id").agg(F.max((F.col("status") == "resolved") & (F.col("dup_no") == 0) & F.col("final_judgment").isNotNull()).alias("told"))
    a = last.join(told, "race_id", "left").withColumn("told", F.coalesce("told", F.lit(False)))
    flags = {channel: F.col("told") for channel in ("push", "chat_pre", "chat_final", "chat_result")}
    return a.select("race_id", "judgment", F.explode(notifications(a, flags, **NOTIFY)).alias("channel"))
