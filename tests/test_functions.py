"""Hand-computed values of the functions, and properties of merges and as-of joins."""

import pytest
from pyspark.sql import functions as F

from hexalane.functions import kernels, numbers, patterns, text
from hexalane.operators import aggregates, joins, merge
from hexalane.sources.fixtures import fixture


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, digits, want", [(-2.5, 0, -2), (2.5, 0, 3), (0.25, 1, 0.3), (-0.25, 1, -0.2)])
def test_half_up(spark, value, digits, want):
    assert one(spark, numbers.half_up(F.lit(value), digits)) == want


def test_missing_values(spark):
    assert one(spark, numbers.clamp(F.lit(None), 0, 1)) is None
    assert one(spark, numbers.rate(F.lit(3), F.lit(0))) == 0.0
    assert one(spark, numbers.default(F.lit(0), 7)) == 7
    assert one(spark, numbers.clamp_or_zero(F.lit("abc"))) == 0.0


def test_patterns_overlap_and_priority(spark):
    assert [len(patterns.combos(p)) for p in patterns.PATTERNS] == [6, 6, 4, 4]
    assert one(spark, patterns.pattern_of(F.lit("1-5-2"))) == "URA"
    assert one(spark, patterns.hit("NEW_MAIN", F.lit("1-5-2"))) is True
    assert one(spark, patterns.pattern_of(F.lit(None).cast("string"))) == "OTHER"


def test_odds(spark):
    assert one(spark, patterns.synthetic_odds(F.array(F.lit(2.0), F.lit(2.0), F.lit(0.5)))) == 1.0
    assert one(spark, patterns.synthetic_odds(F.array().cast("array<double>"))) == 0.0
    assert one(spark, patterns.judge(F.lit(120.0), F.lit(50))) == "WATCH"
    assert one(spark, patterns.judge(F.lit(None).cast("double"))) == "PENDING"


def test_texts(spark):
    assert one(spark, text.half_width(F.lit("Ａ１　ｚ漢"))) == "A1 z漢"
    assert one(spark, text.leading_int(F.lit("12abc"))) == 12
    assert one(spark, text.exhibition_timing(F.lit("F.05"))) == -0.05
    assert one(spark, text.start_timing(F.lit("F"))) is None
    assert one(spark, text.strip_tags(F.lit("<td>a&nbsp;<b>b</b></td>"))) == "a b"
    assert str(one(spark, text.date_of_file(F.lit("B260906.TXT"), "B"))) == "2026-09-06"
    assert one(spark, text.date_of_file(F.lit("B261306.TXT"), "B")) is None
    assert one(spark, text.race_key(F.lit("2024-01-01").cast("date"), F.lit("1"), F.lit(1))) == "2024-01-01_01_01"
    assert str(one(spark, text.nearest_year(F.lit(12), F.lit(30), F.lit("2025-01-02").cast("date")))) == "2024-12-30"
    assert one(spark, text.race_seconds(F.lit("1.50.3"))) == pytest.approx(110.3)


def test_rank_pressure(spark):
    assert one(spark, kernels.rank_pressure(F.lit(20), F.lit(3), F.lit(1), F.lit(6))) == 90.0
    assert one(spark, kernels.rank_pressure(F.lit(None).cast("int"), F.lit(3), F.lit(1), F.lit(6))) == 50.0


def test_daily_partials_merge_to_the_rebuild(spark, data):
    r = fixture(spark, data, "race_result")
    days = aggregates.merge(aggregates.venue_race_partial(r, "race_date").drop("race_date"), ["venue_code", "race_number"])
    assert aggregates.venue_race_stats(days).exceptAll(aggregates.venue_race_stats(aggregates.venue_race_partial(r))).isEmpty()


def test_as_of_never_sees_the_future(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id long, k string, at int")
    right = spark.createDataFrame([(10, "a", 5, 1.0), (11, "a", 4, 2.0), (12, "a", 4, 3.0), (13, "b", None, 4.0)], "p long, k string, at2 int, v double")
    got = {r["id"]: r["v"] for r in joins.as_of(left, right, ["k"], "at", "at2", "p", ["v"], "id", strict=True).collect()}
    assert got == {1: 3.0, 2: None, 3: None}


def test_import_is_idempotent(spark, data):
    new, old = fixture(spark, data, "official_new"), fixture(spark, data, "official_old")
    once = merge.merge_non_null(new, old, "entry_key", ["registration_number", "motor_number", "record_status"], {"record_status": "CONFIRMED"})
    again = merge.merge_non_null(new, once, "entry_key", ["registration_number", "motor_number", "record_status"], {"record_status": "CONFIRMED"})
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()


def test_an_empty_table_gives_no_rows(spark, data):
    r = fixture(spark, data, "race_result").limit(0)
    assert aggregates.venue_race_stats(aggregates.venue_race_partial(r)).isEmpty() and aggregates.racer_stats(r).isEmpty()


def test_mean_timing_is_an_exact_sum(spark):
    """32 timings whose mean ends in a half at the seventh decimal, which sums of doubles miss on either side."""
    from hexalane.plans.evaluation import course_stats

    times = ["0.12", "0.25", "0.18", "0.21"] * 7 + ["0.17", "0.13", "0.14", "0.11"]
    rows = spark.createDataFrame([("4001", 1, 1, t) for t in times], "registration_number string, course int, finish_order int, start_timing string")
    assert course_stats(rows).first()["avg_st"] == sum(int(t[2:]) for t in times) / 100 / 32
