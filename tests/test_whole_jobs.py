"""Queries that return the whole job: rows and order against hand-made tables and SQL."""

import glob
import os

import duckdb
from pyspark.sql import functions as F

from hexalane.operators import quality, ranking
from hexalane.queries import ORACLES, QUERIES


def in_order(spark, data, name):
    """Rows of the query and of its SQL, in their order."""
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, want = QUERIES[name](spark, data).toPandas(), con.execute(ORACLES[name]).df()
    return got.astype(str).values.tolist(), want[list(got.columns)].astype(str).values.tolist()


def test_repair_queue_holds_only_incomplete_races_in_order(spark, data):
    races = [(1, "01", "10:00"), (2, "01", "09:00"), (3, "02", "08:30"), (4, "01", "23:00"), (5, "02", "12:00"), (6, "01", "11:00"), (7, "01", None)]
    r = spark.createDataFrame(races, "race_id long, venue_code string, at string").selectExpr("race_id", "venue_code", "date '2024-01-01' race_date", "cast('2024-01-01 ' || at as timestamp) deadline")
    e = spark.createDataFrame([(2, b) for b in range(6)] + [(6, 1)], "race_id long, boat_number long")
    got = ranking.repair_order(r, e, F.lit("2024-01-01 08:00:00").cast("timestamp"), F.lit(True)).collect()
    assert [(x["race_id"], x["n_entries"]) for x in got] == [(3, 0), (1, 0), (6, 1), (4, 0), (7, 0), (5, 0)]
    got, want = in_order(spark, data, "repair_queue_whole")
    assert got == want and len(got) > 48


def test_ordered_lists_are_not_cut(spark, data):
    for name, cut in (("verification_order_whole", 200), ("enrich_queue_whole", 100)):
        got, want = in_order(spark, data, name)
        assert got == want and len(got) > cut


def test_integrity_check_has_all_five_rules(spark):
    r = spark.createDataFrame([(i, "2024-01-01", "01", min(i, 3)) for i in (1, 2, 3, 4)], "race_id long, race_date string, venue_code string, race_number long")
    rows = [(i, b, 6.8, 0.1, b, False) for i in (1, 3, 4) for b in range(1, 7)] + [(1, 7, 6.8, None, None, False), (1, 8, 6.8, None, 2, False), (9, 1, None, None, None, False)]
    e = spark.createDataFrame(rows, "race_id long, boat_number long, exhibition_time double, exhibition_st double, entry_course long, is_scratched boolean")
    a = spark.createDataFrame([(1, "final", "MISSING"), (1, "final", "PENDING"), (3, "pre", "MISSING"), (4, "final", "BUY")], "race_id long, stage string, judgment string")
    got = quality.violations(quality.integrity_rules(r, e, a, ~F.col("is_scratched"))).collect()
    assert sorted(tuple(x) for x in got) == [(1, "lost_exhibition", 1), (1, "pending_final", 2), (2, "few_entries", 0), (3, "duplicate_race", 2), (9, "orphaned_entries", 1)]
