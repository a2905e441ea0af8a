"""Hand-computed cases of the repairs, gates, parsers and the race analysis."""

from pyspark.sql import functions as F

from hexalane.functions import kernels, official
from hexalane.operators import ranking, repairs
from hexalane.plans import evaluation, race_analysis


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ticks_are_spaced_from_the_last_one_kept(spark):
    ticks = spark.range(8).select(F.lit(1).alias("race"), F.timestamp_seconds(F.col("id") * 60).alias("at"), F.col("id").alias("tick"))
    assert sorted(r["tick"] for r in repairs.spaced(ticks, "race", "at", "tick").collect()) == [0, 3, 6]
    two = spark.createDataFrame([(1, 0, 0), (1, 120, 1), (1, 121, 2), (2, 5, 3)], "race int, s long, tick long").withColumn("at", F.timestamp_seconds("s"))
    assert sorted(r["tick"] for r in repairs.spaced(two, "race", "at", "tick").collect()) == [0, 2, 3]


def test_fallback_key_only_where_the_exact_one_does_not_exist(spark):
    left = spark.createDataFrame([(1, "s", "v", 5), (2, "none", "v", 5), (3, "late", "v", 5)], "id long, series string, venue string, at int")
    right = spark.createDataFrame([("s", "v", 5, 10), ("s", "v", 4, 11), ("late", "v", 9, 12), ("x", "v", 3, 13)], "series string, venue string, stamp int, point long")
    got = repairs.two_tier_as_of(left, right, ["series"], ["venue"], "at", "stamp", "point", ["point"], "id").collect()
    assert {r["id"]: r["point"] for r in got} == {1: 10, 2: 10, 3: None}


def test_orphans_are_moved_merged_or_left(spark):
    races = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "race_id long, key string")
    rows = [(2, "a", 1, None, 0.1), (90, "a", 1, 6.7, 0.2), (91, "a", 2, 6.8, None), (92, "z", 1, 6.9, None)]
    got = repairs.relinked(spark.createDataFrame(rows, "race_id long, key string, boat_number int, time double, st double"), races, ["key"], ["time", "st"]).collect()
    assert {r["race_id"]: (r["target_id"], r["action"], r["time"], r["st"]) for r in got} == {90: (2, "merged", 6.7, 0.1), 91: (2, "moved", 6.8, None), 92: (None, "unresolved", 6.9, None)}


def test_ledger_skips_equal_bytes(spark):
    batches = spark.createDataFrame([(1, "a", "v"), (2, "a", "v"), (3, "b", "v"), (4, "c", "v"), (5, "c", "w")], "batch_id long, checksum string, parser_version string")
    stored = spark.createDataFrame([("b", "v", "COMPLETED"), ("c", "v", "FAILED")], "checksum string, parser_version string, status string")
    assert {r["batch_id"]: r["action"] for r in repairs.ledger(batches, stored).collect()} == {1: "import", 2: "skip", 3: "skip", 4: "retry", 5: "import"}


def test_samples_are_frozen(spark):
    kind = "race_id long, f int, o string"
    stored, pre, final = (spark.createDataFrame(r, kind) for r in ([(1, 10, None), (2, 20, "done")], [(1, 99, None), (3, 30, None)], [(1, 0, "x"), (2, 0, "y"), (4, 0, "z")]))
    got = repairs.frozen(stored, pre, final, "race_id", ["f"], ["o"]).collect()
    assert {r["race_id"]: (r["f"], r["o"]) for r in got} == {1: (10, "x"), 2: (20, "done"), 3: (30, None)}


def test_scratches_from_odds(spark):
    six = [f"{a}-{b}-{c}" for a in range(1, 7) for b in range(1, 7) for c in range(1, 7) if len({a, b, c}) == 3]
    rows = [(1, c, 5.0) for c in six] + [(2, c, 0.0 if "4" in c else 5.0) for c in six] + [(3, c, 0.0 if "4" in c or c == "1-2-3" else 5.0) for c in six]
    got = {r["race_id"]: (r["scratched"], r["n_odds"], r["consistent"]) for r in repairs.inferred_scratches(spark.createDataFrame(rows, "race_id long, combo string, odds double")).collect()}
    assert got == {1: (None, 120, False), 2: ("4", 60, True), 3: ("4", 59, False)}


def test_lines_of_official_files(spark):
    s = one(spark, official.programme_stats(F.lit("5.40 34.13 5.33 38.10 24 57.14158 42.86 56           5")))
    assert (s["motor_number"], s["boat_number_official"], s["series_results_raw"], s["early_race_number"]) == (24, 158, "56", 5)
    s = one(spark, official.programme_stats(F.lit("5.40 34.13")))
    assert (s["national_win_rate"], s["national_top2_rate"], s["local_win_rate"], s["motor_number"]) == (5.4, 34.13, None, None)
    assert one(spark, official.programme_stats(F.lit(None).cast("string")))["early_race_number"] is None
    assert one(spark, official.programme_racer(F.lit("払戻金"))) is None
    rows = one(spark, official.payouts(F.lit("複勝     4          130  1          110")))
    assert [(r["combination"], r["payout_amount"]) for r in rows] == [("4", 130), ("1", 110)]
    assert one(spark, official.payouts(F.lit(" nothing "))) == []
    h = one(spark, official.result_header(F.lit("   1R       朝1戦                    H1800m  雨 風  南   2m  波   2cm")))
    assert h is None or h["race_number"] == 1
    assert one(spark, official.result_header(F.lit("   1R       朝1戦                    H1800m  雨  風  南   2m  波   2cm")))["wind_speed"] == 2
    odds = one(spark, official.odds_of_feed(F.lit(2), F.lit("2\t" + "\t".join(map(str, range(1, 21))))))
    assert len(odds) == 20 and odds["2-1-3"] == 1.0 and odds["2-6-5"] == 20.0
    assert one(spark, official.venues_of_page(F.lit('<a href="?jcd=12"><a href="?jcd=02"><a href="?jcd=12">'))) == ["02", "12"]


def test_series_score_of_one_win_from_outside(spark):
    h = spark.createDataFrame([("r", 1, 6, 1, 6)], "reg string, at int, lane int, finish int, adv int")
    r = evaluation.series_scores(h, ["reg"], ["at"]).first()
    # 8 for the win, 3 for the lane, 1.25 for the start: 50 + 12.25 * 5 is above 100; one race counts a third; the last three round 12.25 to 12.3
    assert (r["n"], r["series_score"], r["series_label"], r["inner_lanes"]) == (1, 66.7, "UP", 0)


def test_wide_rows_of_missing_boats_and_other_grades(spark):
    e = spark.createDataFrame([(1, 1, "A1", 6.0), (1, 2, "x9", 5.0), (1, 3, None, None)], "race_id long, boat_number int, grade_class string, national_win_rate double")
    r = kernels.wide(e).select("b1.*", F.col("b2.grade_class").alias("g2"), F.col("b3.grade_class").alias("g3"), kernels.missing(F.col("b3")).alias("m3"), kernels.missing(F.col("b4")).alias("m4")).first()
    assert (r["grade_class"], r["national_win_rate"], r["g2"], r["g3"], r["m3"], r["m4"]) == ("A1", 6.0, "OTHER", None, False, True)
    plan = kernels.wide(e)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_alert_gate(spark):
    a = spark.createDataFrame([("S", "SKIP"), ("B", "WATCH"), (None, "BUY")], "pre_grade string, judgment string")
    assert [a.where(race_analysis.alert_gate(s)).count() for s in ("pre", "final")] == [1, 2]


def test_runs_give_the_rolling_means_of_whole_keys(spark):
    rows = [(k, i * 7 + k, (i * 31 + k) % 17) for k in (1, 2) for i in range(500)]
    df = spark.createDataFrame(rows, "key long, at long, v long")
    runs, w = ranking.in_runs(df, "key", "at", 100, 10, size=60)
    got = {(r["key"], r["at"]): r["m"] for r in runs.withColumn("m", F.avg("v").over(w)).where("_own").collect()}
    want = {}
    for k in (1, 2):
        own = sorted((a, v) for q, a, v in rows if q == k)
        for i, (a, _) in enumerate(own):
            last = [v for _, v in own[max(0, i - 9) : i + 1]]
            want[k, a] = sum(last) / len(last)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_protected_fields_and_repeated_keys(spark):
    kind = "race_id long, weather string, race_name string"
    stored = spark.createDataFrame([(1, "晴", "a"), (2, None, "b"), (3, "雨", "c")], kind)
    incoming = spark.createDataFrame([(1, None, None), (2, "曇", None), (2, None, "x"), (4, None, "new")], kind)
    once = repairs.protected_upsert(stored, incoming, ["race_id"])
    want = [(1, "晴", None), (2, "曇", "x"), (3, "雨", "c"), (4, None, "new")]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, repairs.protected_upsert(once, incoming, ["race_id"]).collect())) == want


def test_consolidation_is_idempotent(spark):
    races = spark.createDataFrame([(1, "k", None, "finished", False), (2, "k", "name", None, True), (3, "z", None, None, False)], "race_id long, race_number string, race_name string, status string, exhibition_ready boolean")
    entries = spark.createDataFrame([(1, "k", 1, "4001", 6.7), (2, "x", 1, "4001", None), (1, "k", 2, None, 6.9), (2, "x", 7, "4007", 6.0), (3, "z", 1, "4003", None)], "race_id long, race_number string, boat_number int, reg string, time double")
    alerts = spark.createDataFrame([(1, "a"), (2, "b")], "race_id long, note string")

    def run(t):
        ids = repairs.canonical(t["races"], {"entries": (t["entries"], 10)}, ["race_number"], ["race_name"])
        return repairs.consolidated(t["races"], t["entries"], {"alerts": t["alerts"]}, ids)

    once = run({"races": races, "entries": entries, "alerts": alerts})
    want = {"races": [(2, "k", "name", "finished", True), (3, "z", None, None, False)], "entries": [(2, "k", 1, "4001", 6.7), (2, "k", 2, None, 6.9), (3, "z", 1, "4003", None)], "alerts": [(2, "a"), (2, "b")]}
    rows = lambda t: {n: sorted(map(tuple, x.collect())) for n, x in t.items()}
    assert rows(once) == want and rows(run(once)) == want


def test_spaced_ticks_of_equal_stamps_and_long_keys(spark, monkeypatch):
    """Stamps that come many times are gathered once, and what is kept grows by short lists; the ticks are those of a plain loop."""
    import datetime as dt
    import random

    from hexalane.operators import repairs

    monkeypatch.setattr(repairs, "LIST", 3)
    r, start = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=20 * r.randrange(200)), n) for k in (1, 2) for n in range(600)]
    ticks = spark.createDataFrame(rows, "k int, at timestamp, id int")
    want, last = [], {}
    for k, at, n in sorted(rows):
        if k not in last or (at - last[k]).total_seconds() > 120:
            last[k] = at
            want.append((k, n))
    assert sorted(map(tuple, repairs.spaced(ticks, "k", "at", "id").collect())) == sorted(want) and len(want) > 20
