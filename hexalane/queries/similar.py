"""Similar past races, what they say about a race, and trust from an entry alone."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions import patterns
from ..operators.similar import Term, similar_counts, similar_in_groups
from ..sources.fixtures import fixture
from .kernels import GB
from .registry import query, sql_in

LEAST_SIMILAR, LEAST_BUY, SIMILAR = 30, 100, 55
# Points for equal fields; points, the distance at which they end, and what stands for a missing number.
LEGACY = [Term("venue_code", 30), Term("grade", 20), Term("nat", 20, 8), Term("loc", 15, 8), Term("st", 10, 0.15)]
POOL = [Term("venue_code", 25), Term("grade_class", 15), Term("nat", 15, 8), Term("loc", 10, 8), Term("st", 10, 0.15), Term("f", 5, 3, True), Term("m2", 10, 30), Term("m3", 10, 30)]
MISSING = {"nat": ("national_win_rate", 0), "loc": ("local_win_rate", 0), "st": ("avg_st", 0.2), "f": ("f_count", 0), "m2": ("motor_2rate", 35), "m3": ("motor_3rate", 50)}

FEATURES = "g as (select race_id, race_date, venue_code, grade_class, c1_win_rate, " + ", ".join(f"coalesce(nullif(cast({c} as double), 0), {v}e0) {n}" for n, (c, v) in MISSING.items()) + f""", case when {GB} >= 80 then 'S' when {GB} >= 65 then 'A' when {GB} >= 50 then 'B' when {GB} >= 35 then 'C' else 'D' end grade from race_entry b1 where boat_number = 1),
o as (select race_id, coalesce(1 / sum(1 / odds) filter (where odds > 1), 0) synth from odds_final where combo in {sql_in('MAIN')} group by race_id),
x as (select r.race_id, r.trifecta in {sql_in('MAIN')} hit, r.boat1_racer_name is not null done, c.data_source is not distinct from 'official' official from race_result r join race c on c.race_id = r.race_id)"""


def _score(terms):
    one = lambda t: f"case when p.{t.column} = t.{t.column} then {t.points}e0 else 0e0 end" if t.width is None else (f"{t.points}e0 * greatest(0e0, 1 - abs(t.{t.column} - p.{t.column}) / {t.width}e0)" if t.floored else f"{t.points}e0 * (1 - abs(t.{t.column} - p.{t.column}) / {t.width}e0)")
    return " + ".join(map(one, terms))


def _features(spark, d):
    """Lane 1 of every race, missing numbers filled, with its grade."""
    columns = ("race_date", "venue_code", "grade_class", "national_win_rate", "local_win_rate", "c1_win_rate", "avg_st", "f_count", "exhibition_time", "motor_2rate", "motor_3rate")
    e = fixture(spark, d, "race_entry").where("boat_number = 1").select("race_id", *columns)
    b = F.struct(F.lit(1).alias("here"), *columns)
    filled = [F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(float(v))).alias(n) for n, (c, v) in MISSING.items()]
    return e.withColumn("b", b).select(F.col("race_id").alias("id"), F.col("race_date").alias("day"), "venue_code", "grade_class", *filled, k.boat1_grade(F.col("b")).alias("grade"))


def _past(spark, d, features):
    """Features of finished races, whether each was a hit, and whether its detail is whole and official."""
    r = fixture(spark, d, "race_result").select(F.col("race_id").alias("id"), patterns.hit("MAIN", "trifecta").alias("hit"), F.col("boat1_racer_name").isNotNull().alias("done"))
    source = fixture(spark, d, "race").select(F.col("race_id").alias("id"), F.col("data_source").eqNullSafe("official").alias("official"))
    return features.join(r, "id").join(source, "id")


def _synthetic(spark, d):
    odds = fixture(spark, d, "odds_final").where(F.col("combo").isin(patterns.combos("MAIN"))).groupBy("race_id").agg(F.collect_list("odds").alias("odds"))  # six combinations
    return odds.select(F.col("race_id").alias("id"), patterns.synthetic_odds("odds").alias("synth"))


@query(FEATURES + f""", s as (select t.race_id, count(*) n, count(*) filter (where hit) h from g t join (select g.*, x.hit from g join x on x.race_id = g.race_id) p on p.race_date < t.race_date and {_score(LEGACY)} >= 55 group by t.race_id),
q as (select g.race_id, coalesce(n, 0) n, coalesce(h, 0) h, coalesce(h / n, 0) * coalesce(o.synth, 0) * 100 ev from g left join s on s.race_id = g.race_id left join o on o.race_id = g.race_id)
select race_id, n similar_count, h uichi_hits, round(ev, 6) expected_value, case when n < 30 then 'PENDING' when ev >= 110 then 'BUY' when ev >= 100 then 'WATCH' else 'SKIP' end judgment from q""")
def similar_legacy(spark, d):
    """Races of all venues that were similar before a race's day, their hits, and the judgment they give.

    Neither an equal venue nor an equal grade leaves 45 points at most, below the
    threshold: so races of the venue are compared, and races of the grade elsewhere.
    """
    t = _features(spark, d)
    p = _past(spark, d, t)
    counts = similar_in_groups(t, p, [("venue_code", None), ("grade", "venue_code")], LEGACY, SIMILAR)
    out = t.select("id").join(counts, "id", "left").join(_synthetic(spark, d), "id", "left").fillna(0)
    rate = F.when(F.col("similar") > 0, F.col("hits") / F.when(F.col("similar") > 0, F.col("similar"))).otherwise(0.0)
    out = out.withColumn("ev", patterns.expected_value(rate, "synth"))
    judged = F.when(F.col("similar") < LEAST_SIMILAR, "PENDING").otherwise(patterns.judge("ev"))
    return out.select(F.col("id").alias("race_id"), F.col("similar").alias("similar_count"), F.col("hits").alias("uichi_hits"), F.round("ev", 6).alias("expected_value"), judged.alias("judgment"))


@query(FEATURES + f""", p as (select g.*, x.hit, x.done from g join x on x.race_id = g.race_id where x.official), s as (select t.race_id, count(*) n, count(*) filter (where hit) h from g t join p on p.venue_code = t.venue_code and p.race_date < t.race_date and p.done and {_score(POOL)} >= 55 group by t.race_id),
v as (select t.race_id, count(*) total_pool, count(*) filter (where p.done) valid_pool from g t join p on p.venue_code = t.venue_code and p.race_date < t.race_date group by t.race_id),
q as (select g.race_id, g.grade, coalesce(n, 0) n, coalesce(h, 0) h, coalesce(h / n, 0) * coalesce(o.synth, 0) * 100 ev, coalesce(total_pool, 0) total_pool, coalesce(valid_pool, 0) valid_pool, coalesce(valid_pool / total_pool, 0) suf from g left join s on s.race_id = g.race_id left join v on v.race_id = g.race_id left join o on o.race_id = g.race_id)
select race_id, grade boat1_grade, n similar_count, h uichi_hits, round(ev, 6) expected_value, case when n < 30 then 'PENDING' when ev >= 100 then case when ev >= 110 and n >= 100 then 'BUY' else 'WATCH' end else 'SKIP' end judgment, n >= 30 min_similar_ok, total_pool, valid_pool, round(suf, 6) data_sufficiency,
 case when n >= 500 then 'A' when n >= 250 then 'B' when n >= 100 then 'C' else 'D' end reliability, suf < 0.5 or n < 100 is_reference from q""")
def similar_pool(spark, d):
    """The venue's similar official races with whole detail before a race's day, and how far they can be relied on."""
    t = _features(spark, d)
    p = _past(spark, d, t).where("official")
    counts = similar_counts(t, p.where("done"), "venue_code", POOL, SIMILAR)
    # the pool of a day is what the venue had before it: a running total over its days
    days = p.groupBy("venue_code", "day").agg(F.count(F.lit(1)).alias("n"), F.count_if("done").alias("done"))
    every = days.unionByName(t.select("venue_code", "day").distinct().withColumns({"n": F.lit(0).cast("long"), "done": F.lit(0).cast("long")}))
    before = Window.partitionBy("venue_code").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    per_day = every.groupBy("venue_code", "day").agg(F.sum("n").alias("n"), F.sum("done").alias("done"))
    pool = per_day.select("venue_code", "day", (F.sum("n").over(before) - F.col("n")).alias("total_pool"), (F.sum("done").over(before) - F.col("done")).alias("valid_pool"))
    out = t.select("id", "venue_code", "day", "grade").join(counts, "id", "left").join(pool, ["venue_code", "day"], "left").join(_synthetic(spark, d), "id", "left").fillna(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))).otherwise(0.0)
    out = out.withColumns({"ev": patterns.expected_value(share("hits", "similar"), "synth"), "sufficiency": share("valid_pool", "total_pool")})
    enough = F.col("similar") >= LEAST_SIMILAR
    return out.select(
        F.col("id").alias("race_id"), F.col("grade").alias("boat1_grade"), F.col("similar").alias("similar_count"), F.col("hits").alias("uichi_hits"), F.round("ev", 6).alias("expected_value"),
        F.when(enough, patterns.judge("ev", "similar", least=LEAST_BUY)).otherwise("PENDING").alias("judgment"), enough.alias("min_similar_ok"), "total_pool", "valid_pool", F.round("sufficiency", 6).alias("data_sufficiency"),
        patterns.reliability("similar").alias("reliability"), ((F.col("sufficiency") < 0.5) | (F.col("similar") < LEAST_BUY)).alias("is_reference"),
    )


def _norm(*fields):
    share = " + ".join(f"case when {c} is null then 0 else {p} end" for c, _, p in fields)
    points = " + ".join(f"coalesce(least(1e0, greatest(0e0, {c} / {most}e0)) * {p}e0, 0)" for c, most, p in fields)
    return f"case when {share} > 0 then ({points}) / ({share}) end"


GRADE = "case grade_class when 'A1' then 1e0 when 'A2' then 0.85e0 when 'B1' then 0.65e0 when 'B2' then 0.45e0 end"


@query(f"""a as (select race_id, f_count, {_norm(('national_win_rate', 8, 50), ('national_2rate', 60, 20), (GRADE, 1, 30))} * 20 basic, {_norm(('c1_win_rate', 70, 60), ('c1_2rate', 90, 40))} * 20 lane1, {_norm(('local_win_rate', 8, 50), ('local_2rate', 60, 50))} * 15 venue,
 case when avg_st > 0 then least(1e0, greatest(0e0, (0.25e0 - avg_st) / 0.20e0)) * 10 end st, {_norm(('motor_2rate', 50, 60), ('motor_3rate', 70, 40))} * 10 motor from race_entry where boat_number = 1),
r as (select race_id, {' + '.join(f'coalesce(floor({c} + 0.5e0), 0)' for c in ('basic', 'lane1', 'venue', 'st', 'motor'))} - least(f_count * 4, 15) raw, {' + '.join(f'case when {c} is null then 0 else {m} end' for c, m in (('basic', 20), ('lane1', 20), ('venue', 15), ('st', 10), ('motor', 10)))} reach,
 {' + '.join(f'case when {c} is null then 0 else 1 end' for c in ('basic', 'lane1', 'venue', 'st', 'motor'))} n from a)
select race_id, cast(floor(raw / reach * 100 + 0.5e0) as bigint) score, cast(raw as bigint) raw_score, cast(reach as bigint) max_possible, cast(n as bigint) evaluated_count from r""")
def trust_lite(spark, d):
    """Trust in lane 1 from the entry alone."""
    columns = ("national_win_rate", "national_2rate", "grade_class", "c1_win_rate", "c1_2rate", "local_win_rate", "local_2rate", "avg_st", "motor_2rate", "motor_3rate", "f_count")
    e = fixture(spark, d, "race_entry").where("boat_number = 1").select("race_id", F.struct(F.lit(1).alias("here"), *columns).alias("b"))
    return e.select("race_id", *[v.alias(n) for n, v in k.trust_lite(F.col("b")).items()])
