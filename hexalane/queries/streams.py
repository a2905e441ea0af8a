"""Time-driven work and Structured Streaming."""

from pyspark.sql import functions as F

from ..sources.fixtures import fixture
from ..streaming import ticks
from .registry import query


WORKS = {"exhibition": 25, "final": 13, "scratch_guard": 5, "urgent_entries": 90}
DUE = "d as (select race_id, cast(cast(race_date as timestamp) + interval 12 hour as timestamp) as noon, cast(race_date as timestamp) + to_minutes(cast(360 + race_id * 37 % 720 as int)) as closes, status, race_id % 5 = 0 short from race)"


@query(DUE + """ select race_id, case w.n when 0 then 'exhibition' when 1 then 'final' when 2 then 'scratch_guard' when 3 then 'urgent_entries' else 'result' end as work from d cross join (values (0, 25), (1, 13), (2, 5), (3, 90), (4, 0)) w(n, m)
 where case when w.n in (0, 2) then closes > noon and closes <= noon + to_minutes(w.m) when w.n = 1 then closes > noon and closes - to_minutes(13) <= noon when w.n = 3 then short and closes >= noon and closes <= noon + to_minutes(90) else status = 'scheduled' and noon >= closes + to_minutes(1) end""")
def due_work(spark, d):
    """What every race calls for at noon of its day: warm-up data, the final judgment, a guard against scratches, missing entries, or the result."""
    from ..plans.backfill import due

    day = F.col("race_date").cast("timestamp")
    minute = lambda m: F.make_dt_interval(mins=m.cast("int"))
    r = fixture(spark, d, "race").select("race_id", (day + F.expr("interval 12 hours")).alias("at"), (day + minute(360 + F.col("race_id") * 37 % 720)).alias("closes"), (F.col("status") == "scheduled").alias("open"), (F.col("race_id") % 5 == 0).alias("short"))
    return r.select("race_id", F.explode(due(F.col("closes"), F.col("at"), F.col("open"), F.col("short"), WORKS)).alias("work"))


@query("""r as (select race_id, cast(race_date as timestamp) + to_hours(cast(race_id % 24 as int)) as closes from race), x as (select race_id, cast(race_date as timestamp) + to_hours(cast(race_id % 24 + race_id * 7 % 40 as int)) as told from race where race_id % 6 <> 0),
w as (select least((select max(closes) from r), (select max(told) from x)) - interval 10 minute as mark)
select r.race_id, cast(epoch(x.told) as bigint) told from r left join x on x.race_id = r.race_id and x.told <= r.closes + interval 1 day cross join w where x.told is not null or r.closes + interval 1 day < w.mark""")
def stream_late_results(spark, d):
    """Two streams, races and results: each race with the result of its next day, or without one once the day is over."""
    day = F.col("race_date").cast("timestamp")
    hours = lambda h: F.make_dt_interval(hours=h.cast("int"))
    race = fixture(spark, d, "race").select("race_id", "race_date")
    tables = race.select("race_id", (day + hours(F.col("race_id") % 24)).alias("closes")), race.where("race_id % 6 <> 0").select("race_id", (day + hours(F.col("race_id") % 24 + F.col("race_id") * 7 % 40)).alias("told"))
    feeds = [ticks.landed(t, files=4) for t in tables]
    races, results = (spark.readStream.schema(f.schema).parquet(ticks.folder_of(f)) for f in feeds)
    out = ticks.run_available(spark, ticks.awaited(races, results, "race_id", "closes", "told"))
    return out.select("race_id", F.unix_timestamp("told").alias("told"))


@query("""a as (select * from uichi_analysis where dup_no = 0), b as (select * from uichi_analysis where dup_no = 1), g(s, o) as (values ('PASS', 4), ('CAUTION', 3), ('FAIL', 2), ('MISSING', 1), ('PRE', 0)),
x as (select a.race_id, (a.exhibition_ready and not b.exhibition_ready) or (ga.o >= 2 and gb.o = 1) or (a.judgment <> 'PENDING' and b.judgment = 'PENDING') keep, a.judgment ja, b.judgment jb, a.exhibition_gate_status sa, b.exhibition_gate_status sb, a.exhibition_ready ra, b.exhibition_ready rb from a join b on a.race_id = b.race_id join g ga on ga.s = a.exhibition_gate_status join g gb on gb.s = b.exhibition_gate_status)
select race_id, case when keep then ja else jb end judgment, case when keep then sa else sb end exhibition_gate_status, case when keep then ra else rb end exhibition_ready from x""")
def stream_guarded(spark, d):
    """A stream in which races come repeatedly, folded by keyed state that refuses steps back; only changes are written."""
    a = fixture(spark, d, "uichi_analysis").select("race_id", F.col("dup_no").cast("int").alias("dup_no"), F.col("captured_at").cast("timestamp").alias("captured_at"), "judgment", "exhibition_gate_status", "exhibition_ready")
    feed = ticks.landed(a, files=3)
    changes = ticks.guarded(spark.readStream.schema(feed.schema).parquet(ticks.folder_of(feed)), "race_id", "dup_no", "captured_at")
    return ticks.current(ticks.run_available(spark, changes), "race_id", "dup_no")


@query("""t as (select distinct race_id, tick_id, captured_at from odds_snapshot), c as (select t.*, row_number() over (partition by race_id order by captured_at, tick_id) i from t),
k as (with recursive k as (select race_id, captured_at, tick_id from c where i = 1 union all select n.race_id, n.captured_at, n.tick_id from (select t.race_id, t.captured_at, t.tick_id, row_number() over (partition by t.race_id order by t.captured_at, t.tick_id) w from k join t on t.race_id = k.race_id and t.captured_at > k.captured_at + interval 120 second) n where n.w = 1) select * from k) select race_id, tick_id from k""")
def tick_thinning(spark, d):
    """Complete ticks more than two minutes after the last one kept."""
    from ..operators.repairs import spaced

    t = fixture(spark, d, "odds_snapshot").groupBy("race_id", "tick_id", "captured_at").agg(F.count_distinct("combo").alias("n")).where("n = 6")
    return spaced(t, "race_id", "captured_at", "tick_id", 120)


@query("""select r.race_id, r.race_date from race r where r.race_date between date '1998-07-01' and date '1998-07-02' and r.status = 'scheduled' and not exists (select 1 from race_result x where x.race_id = r.race_id and x.race_id % 2 = 0)""")
def late_results(spark, d):
    """Races of today and yesterday that still have no result: tried again at every tick."""
    today = F.lit("1998-07-02").cast("date")
    known = fixture(spark, d, "race_result").where("race_id % 2 = 0").select("race_id")
    return fixture(spark, d, "race").where(F.col("race_date").between(F.date_sub(today, 1), today) & (F.col("status") == "scheduled")).join(known, "race_id", "left_anti").select("race_id", "race_date")


@query("""a as (select * from uichi_analysis where dup_no = 0), b as (select * from uichi_analysis where dup_no = 1), g(s, o) as (values ('PASS', 4), ('CAUTION', 3), ('FAIL', 2), ('MISSING', 1), ('PRE', 0)),
x as (select a.race_id, (a.exhibition_ready and not b.exhibition_ready) or (ga.o >= 2 and gb.o = 1) or (a.judgment <> 'PENDING' and b.judgment = 'PENDING') keep, a.judgment ja, b.judgment jb, a.exhibition_gate_status sa, b.exhibition_gate_status sb, a.exhibition_ready ra, b.exhibition_ready rb from a join b on a.race_id = b.race_id join g ga on ga.s = a.exhibition_gate_status join g gb on gb.s = b.exhibition_gate_status)
select race_id, case when keep then ja else jb end judgment, case when keep then sa else sb end exhibition_gate_status, case when keep then ra else rb end exhibition_ready from x""")
def stream_upsert(spark, d):
    """A stream of analyses merged into a stored table batch by batch, refusing steps back."""
    columns = ["race_id", "judgment", "exhibition_gate_status", "exhibition_ready"]
    feed = ticks.landed(fixture(spark, d, "uichi_analysis").where("dup_no = 1").select(columns), files=3)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(ticks.folder_of(feed))
    return ticks.upsert_available(stream, fixture(spark, d, "uichi_analysis").where("dup_no = 0").select(columns), ["race_id"])


@query("select event_type, cast(epoch(date_trunc('hour', ts)) as bigint) as hour_start, cast(count(*) as bigint) n from events group by 1, 2", derived=False)
def stream_hourly(spark, d):
    """A file stream of events counted per hour and type with a watermark; every batch writes the hours it changed."""
    table = spark.read.parquet(f"{d}/events.parquet")
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 64)
    # a stream reads folders: the table's own, or the one that holds it if the table is a single file
    alone = table.inputFiles()[0].rstrip("/").endswith("/events.parquet")
    stream = source.option("pathGlobFilter", "events.parquet").parquet(d) if alone else source.parquet(f"{d}/events.parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = ticks.run_updates(spark, ticks.windowed_counts(stream, "ts", ["event_type"], lateness="60 days"), ["window_start", "event_type"])
    return out.select("event_type", F.unix_timestamp("window_start").alias("hour_start"), "n")
