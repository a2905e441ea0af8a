"""Scans, predicates, sorts, sets and sequences."""

from pyspark.sql import functions as F

from ..operators import repairs as of
from ..sources.fixtures import fixture
from .registry import query


@query("select race_id, race_date, venue_code, deadline from race where venue_code = '05' and status = 'finished'")
def scan_filter(spark, d):
    return fixture(spark, d, "race").where("venue_code = '05' and status = 'finished'").select("race_id", "race_date", "venue_code", "deadline")


@query("select race_id, grade, race_number from race where grade in ('SG', 'G1') and race_number between 3 and 9 and venue_code <> '01' and series_day < 5")
def scan_predicates(spark, d):
    r = fixture(spark, d, "race")
    return r.where(F.col("grade").isin("SG", "G1") & F.col("race_number").between(3, 9) & (F.col("venue_code") != "01") & (F.col("series_day") < 5)).select("race_id", "grade", "race_number")


@query("select race_id, data_source from race where data_source is distinct from 'sample'")
def scan_ne_null(spark, d):
    return fixture(spark, d, "race").where(~F.col("data_source").eqNullSafe("sample")).select("race_id", "data_source")


@query("select * from race_result where race_id = 42")
def scan_point(spark, d):
    return fixture(spark, d, "race_result").where("race_id = 42")


@query("select race_id, judgment from uichi_analysis where race_id in (select race_id from race where grade = 'SG')")
def semi_join_keys(spark, d):
    return fixture(spark, d, "uichi_analysis").join(fixture(spark, d, "race").where("grade = 'SG'").select("race_id"), "race_id", "left_semi").select("race_id", "judgment")


@query("select race_id, payout_trifecta from race_result order by payout_trifecta desc, race_id limit 50")
def sort_limit(spark, d):
    return fixture(spark, d, "race_result").orderBy(F.desc("payout_trifecta"), "race_id").limit(50).select("race_id", "payout_trifecta")


@query("select race_id, race_date, deadline, race_number from race where status = 'finished' order by race_date desc, deadline desc, race_number desc, race_id")
def verification_order(spark, d):
    """Finished races, newest first."""
    return fixture(spark, d, "race").where("status = 'finished'").orderBy(F.desc("race_date"), F.desc("deadline"), F.desc("race_number"), "race_id").select("race_id", "race_date", "deadline", "race_number")


@query("select race_id, race_date, deadline, race_number from race where status = 'finished' order by race_date desc, deadline desc, race_number desc, race_id")
def verification_order_whole(spark, d):
    return verification_order(spark, d)


@query("""n as (select race_id, count(*) n from race_entry where not is_scratched group by race_id),
c as (select r.race_id, r.race_date, r.venue_code, r.status, r.deadline, coalesce(n.n, 0) n from race r left join n on n.race_id = r.race_id),
v as (select race_date, venue_code, sum(n) filled from c group by all),
t as (select c.*, v.filled > 0 as partly_filled, coalesce(c.deadline >= timestamp '1996-01-01 23:00:00' and c.deadline <= timestamp '1996-01-02 00:30:00', false) soon from c join v on v.race_date = c.race_date and v.venue_code = c.venue_code where c.status = 'scheduled' and c.n < 6)
select race_id, cast(n as bigint) n_entries, soon, partly_filled from t order by soon desc, case when soon then deadline end nulls last, partly_filled desc, deadline nulls last, race_id limit 48""")
def repair_queue(spark, d):
    """The 48 open races to repair first: a round's share of ``repair_queue_whole``."""
    return repair_queue_whole(spark, d).limit(48)


@query("""n as (select race_id, count(*) n from race_entry where not is_scratched group by race_id),
c as (select r.race_id, r.race_date, r.venue_code, r.status, r.deadline, coalesce(n.n, 0) n from race r left join n on n.race_id = r.race_id),
v as (select race_date, venue_code, sum(n) filled from c group by all),
t as (select c.*, v.filled > 0 as partly_filled, coalesce(c.deadline >= timestamp '1996-01-01 23:00:00' and c.deadline <= timestamp '1996-01-02 00:30:00', false) soon from c join v on v.race_date = c.race_date and v.venue_code = c.venue_code where c.status = 'scheduled' and c.n < 6)
select race_id, cast(n as bigint) n_entries, soon, partly_filled from t order by soon desc, case when soon then deadline end nulls last, partly_filled desc, deadline nulls last, race_id""")
def repair_queue_whole(spark, d):
    """Every open race that lacks entries, in the order of repair; a caller takes as many as it can fetch."""
    from ..operators.ranking import repair_order

    own = fixture(spark, d, "race_entry").where("not is_scratched")
    return repair_order(fixture(spark, d, "race"), own, F.lit("1996-01-01 23:00:00").cast("timestamp"), F.col("status") == "scheduled").select("race_id", "n_entries", "soon", "partly_filled")


@query("""x as (select race_date, venue_code, count(*) filter (where trifecta in ('1-2-5','1-2-6','1-3-5','1-3-6','1-4-5','1-4-6')) hits from race_result group by race_date, venue_code)
select race_date, venue_code, cast(hits as bigint) as hits from x order by case when race_date >= date '1998-07-01' then 0 else 1 end, race_date desc, case when hits > 0 then 0 else 1 end, venue_code""")
def enrich_queue(spark, d):
    """Venue days to enrich: recent ones first, then newest, those with hits first."""
    return enrich_queue_whole(spark, d)


@query("""x as (select race_date, venue_code, count(*) filter (where trifecta in ('1-2-5','1-2-6','1-3-5','1-3-6','1-4-5','1-4-6')) hits from race_result group by race_date, venue_code)
select race_date, venue_code, cast(hits as bigint) as hits from x order by case when race_date >= date '1998-07-01' then 0 else 1 end, race_date desc, case when hits > 0 then 0 else 1 end, venue_code""")
def enrich_queue_whole(spark, d):
    """Venue days to enrich: recent ones first, then newest, those with hits first."""
    from ..functions.numbers import count_where
    from ..functions.patterns import hit

    days = fixture(spark, d, "race_result").groupBy("race_date", "venue_code").agg(count_where(hit("MAIN", "trifecta")).alias("hits"))
    recent = F.col("race_date") >= F.lit("1998-07-01").cast("date")
    return days.orderBy(F.when(recent, 0).otherwise(1), F.desc("race_date"), F.when(F.col("hits") > 0, 0).otherwise(1), "venue_code")


@query("select race_id, 'v2' as source, result_1 from race_result where race_id % 2 = 0 union all select r.race_id, 'v1', r.result_1 from race_result r where r.race_id % 3 = 0 and r.race_id % 2 <> 0")
def union_results(spark, d):
    """Newer results and those older ones that they lack: no race counts twice."""
    r = fixture(spark, d, "race_result").select("race_id", "result_1")
    new, old = r.where("race_id % 2 = 0"), r.where("race_id % 3 = 0")
    return new.withColumn("source", F.lit("v2")).unionByName(old.join(new.select("race_id"), "race_id", "left_anti").withColumn("source", F.lit("v1"))).select("race_id", "source", "result_1")


@query("""have as (select race_date, venue_code, race_number from race group by all), days as (select distinct race_date, venue_code from race)
select d.race_date, d.venue_code, n.n as missing from days d cross join (select unnest(range(1, 13)) n) n left join have h on h.race_date = d.race_date and h.venue_code = d.venue_code and h.race_number = n.n where h.race_number is null""")
def missing_races(spark, d):
    have = fixture(spark, d, "race").groupBy("race_date", "venue_code").agg(F.collect_set("race_number").alias("have"))
    return have.select("race_date", "venue_code", F.explode(F.array_except(F.sequence(F.lit(1), F.lit(12)).cast("array<bigint>"), "have")).alias("missing"))


@query("""s as (select race_id, list(distinct cast(x as int)) seen from (select race_id, unnest(string_split(combo, '-')) x from odds_final where odds > 1) group by race_id), c as (select race_id, count(*) filter (where odds > 1) n from odds_final group by race_id)
select c.race_id, string_agg(cast(i.n as varchar), ',' order by i.n) filter (where not list_contains(s.seen, i.n)) scratched, cast(c.n as bigint) n_odds, len(s.seen) < 6 and len(s.seen) * (len(s.seen) - 1) * (len(s.seen) - 2) = c.n consistent from c join s on s.race_id = c.race_id cross join (values (1), (2), (3), (4), (5), (6)) i(n) group by c.race_id, c.n, s.seen""")
def scratched_boats(spark, d):
    """Boats that no combination with odds above 1 names, and whether the others' combinations are all there."""
    return of.inferred_scratches(fixture(spark, d, "odds_final").select("race_id", "combo", "odds"))


@query("select race_id, count(distinct boat_number) = 6 as all_present, cast(count(*) filter (where exhibition_time > 6.9) as bigint) as slow from race_entry where not is_scratched group by race_id")
def all_boats_present(spark, d):
    own = fixture(spark, d, "race_entry").where("not is_scratched").groupBy("race_id").agg(F.collect_set("boat_number").alias("boats"), F.count_if(F.col("exhibition_time") > 6.9).alias("slow"))
    return own.select("race_id", (F.size(F.array_except(F.sequence(F.lit(1), F.lit(6)), "boats")) == 0).alias("all_present"), "slow")


@query("""lim as (select min(race_date) a, max(race_date) b from race) select cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from lim""")
def date_spine(spark, d):
    return fixture(spark, d, "race").agg(F.min("race_date").alias("a"), F.max("race_date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
