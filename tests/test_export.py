"""The export of two days: duplicates, planted faults, files per day and a manifest that comes last."""

import os

from pyspark.sql import functions as F

from hexalane.plans import export
from hexalane.queries import QUERIES
from hexalane.sources.fixtures import fixture


def test_bundle_of_two_days(spark, tmp_path):
    def table(schema, rows):
        return spark.createDataFrame(rows, schema)

    races = table("race_id long, race_date string, venue_code string, race_number int, venue_name string, data_source string, race_name string, series_key string, deadline timestamp, exhibition_ready boolean", [
        (1, "2026-09-06", "01", 1, "桐生", "official", None, "s", None, False), (2, "2026-09-06", "01", 1, "桐生", "official", "final", "s", None, True), (3, "2026-09-06", "01", 13, "桐生", "official", None, None, None, False),
        (4, "2026-09-07", "02", 2, "桐生", "official", None, None, None, False), (5, "2026-09-07", "02", 3, "戸田", "sample", None, None, None, False), (6, "2026-09-07", "02", 4, "戸田", "official", None, None, None, False),
    ]).selectExpr("race_id", "cast(race_date as date) race_date", "venue_code", "race_number", "venue_name", "data_source", "race_name", "series_key", "deadline", "exhibition_ready")
    entries = table("race_id long, boat_number int, registration_number string", [(1, 1, "4001"), (2, 1, "4001"), (1, 2, "4002"), (1, 9, "4009"), (4, 1, "4004"), (6, 1, "4001"), (6, None, "4001")])
    results = table("race_id long, race_date string, result_1 int", [(1, "x", 1), (3, "x", None), (6, "x", 2), (5, "x", 1)])
    odds = table("race_id long, combo string, odds double", [(1, "1-2-3", 5.0), (2, "1-2-3", 6.0), (4, "1-2-3", 6.0)])
    analyses = table("race_id long, stage string, captured_at timestamp, dup_no int, race_date string, score int", [(1, "final", None, 0, "x", 7), (2, "pre", None, 0, "x", 9), (2, "day", None, 0, "x", 8)])
    series = table("series_key string, venue_code string, registration_number string, as_of_date date, point_id long, series_score double", [("s", "01", "4001", None, 1, 50.0)]).selectExpr("series_key", "venue_code", "registration_number", "date '2026-09-01' as_of_date", "point_id", "series_score")
    sets = export.bundle(races, entries, results, odds, analyses, series, str(tmp_path))
    manifest = {str(r["race_date"]): r for r in export.write(sets, str(tmp_path / "out")).collect()}
    a, b = manifest["2026-09-06"], manifest["2026-09-07"]
    assert [a[f"n_{s}"] for s in (*export.SETS, "warnings", "errors")] == [2, 2, 1, 1, 2, 1, 4, 0] and a["venue_codes"] == "01"
    assert [b[f"n_{s}"] for s in (*export.SETS, "warnings", "errors")] == [1, 1, 0, 1, 0, 0, 1, 1] and b["venue_codes"] == "02"
    assert sorted(os.listdir(tmp_path / "out")) == sorted([*export.SETS, "errors", "manifest", "warnings"]) and "race_date=2026-09-06" in os.listdir(tmp_path / "out" / "races")
    one = spark.read.json(f"{tmp_path}/out/races/race_date=2026-09-06").where("race_number = 1").first()
    assert (one["race_id"], one["race_key"], one["race_name"]) == (2, "2026-09-06_01_01", "final")
    assert sorted((r["race_key"], r["type"], r["n"]) for r in sets["warnings"].collect()) == [("2026-09-06_01_01", "boat_number_out_of_range", 1), ("2026-09-06_01_01", "duplicate_boat", 1), ("2026-09-06_01_01", "duplicate_race_key_normalized", 2), ("2026-09-06_01_13", "race_number_out_of_range", 1), ("2026-09-07_02_04", "boat_number_out_of_range", 1)]
    assert [r["score"] for r in sets["features"].collect()] == [7] and [(r["race_key"], r["type"]) for r in sets["errors"].collect()] == [("2026-09-07_02_02", "venue_mismatch")]


def test_odds_of_every_combination_are_exported(spark, data):
    """The odds counted by the manifest are all rows of the races that are exported, each of six combinations."""
    odds = fixture(spark, data, "odds_snapshot")
    assert odds.select("combo").distinct().count() == 6
    r = fixture(spark, data, "race").where("data_source = 'official' and race_id % 37 <> 0")
    # copies of races have ids that no odds have
    want = {x["race_date"]: x["n"] for x in odds.join(r.select("race_id", "race_date"), "race_id").groupBy("race_date").agg(F.count("*").alias("n")).collect()}
    got = {x["race_date"]: x["n_odds"] for x in QUERIES["export_bundle"](spark, data).collect() if x["n_odds"]}
    assert got == want and want
