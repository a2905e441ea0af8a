"""Streams batch by batch: repeated keys, late rows, bounded state."""

import datetime as dt

from pyspark.sql import functions as F

from hexalane.streaming import ticks

KIND = "race_id long, judgment string, exhibition_gate_status string, exhibition_ready boolean"


def at(hours):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hours)


def test_a_key_that_a_batch_repeats_gives_one_row(spark):
    stored = spark.createDataFrame([(1, "BUY", "PASS", True)], KIND)
    batch = spark.createDataFrame([(1, "SKIP", "PASS", True), (1, "PENDING", "MISSING", False), (2, "PENDING", "PRE", False), (2, "WATCH", "FAIL", True)], KIND)
    once = ticks.upserted(stored, batch, ["race_id"])
    assert sorted(map(tuple, once.collect())) == [(1, "SKIP", "PASS", True), (2, "WATCH", "FAIL", True)]
    assert sorted(map(tuple, ticks.upserted(once, batch, ["race_id"]).collect())) == [(1, "SKIP", "PASS", True), (2, "WATCH", "FAIL", True)]


def feed(spark, folder, batches, kind):
    """Files that come one per batch, in order of their names and times."""
    import os

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in{n}")
        part = next(f for f in os.listdir(f"{folder}/in{n}") if f.endswith(".parquet"))
        os.makedirs(f"{folder}/feed", exist_ok=True)
        os.rename(f"{folder}/in{n}/{part}", f"{folder}/feed/{n}.parquet")
        os.utime(f"{folder}/feed/{n}.parquet", (1_700_000_000 + n * 60,) * 2)
    return spark.readStream.schema(spark.createDataFrame([], kind).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed")


def test_keyed_state_refuses_steps_back_and_ends(spark, tmp_path):
    kind = "race_id long, n int, captured_at timestamp, judgment string, exhibition_gate_status string, exhibition_ready boolean"
    stream = feed(spark, str(tmp_path), [
        [(1, 1, at(0), "PENDING", "PRE", False), (1, 2, at(1), "BUY", "PASS", True), (1, 3, at(1), "PENDING", "MISSING", False), (2, 1, at(1), "PENDING", "MISSING", False)],
        [(1, 4, at(2), "SKIP", "FAIL", True), (1, 4, at(2), "SKIP", "FAIL", True), (2, 2, at(2), "WATCH", "CAUTION", True)],
        [(3, 1, at(200), "BUY", "PASS", True)],
        [(3, 1, at(200), "BUY", "PASS", True)],
        [(2, 3, at(3), "SKIP", "PASS", True), (3, 2, at(201), "PENDING", "MISSING", True)],
        [(4, 1, at(202), "BUY", "PASS", True)],
    ], kind)
    states = []
    out = ticks.guarded(stream, "race_id", "n", "captured_at")
    path = str(tmp_path / "out")
    query = out.writeStream.outputMode("append").option("checkpointLocation", path + "-state").trigger(availableNow=True).format("parquet").start(path)
    query.awaitTermination()
    states = [p["stateOperators"][0] for p in query.recentProgress]
    changes = spark.read.schema(out.schema).parquet(path)
    assert sorted((r["race_id"], r["n"]) for r in changes.collect()) == [(1, 1), (1, 2), (1, 4), (2, 1), (2, 2), (3, 1), (4, 1)]
    now = {r["race_id"]: tuple(r)[1:] for r in ticks.current(changes, "race_id", "n").collect()}
    assert now == {1: ("SKIP", "FAIL", True), 2: ("WATCH", "CAUTION", True), 3: ("BUY", "PASS", True), 4: ("BUY", "PASS", True)}
    # the row that came eight days late was dropped, and the state of the races of the first day has gone
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1 and states[-1]["numRowsTotal"] <= 2


def test_keys_share_the_state_of_a_bucket(spark, tmp_path, monkeypatch):
    """Many keys, one of none, large ones apart by one, rows of a key far apart in a batch: few states, each key its own result."""
    monkeypatch.setattr(ticks, "BUCKETS", 3)
    kind = "race_id long, n int, captured_at timestamp, judgment string, exhibition_gate_status string, exhibition_ready boolean"
    big = 2**60
    first = [(big + i, n, at(1), "BUY" if n else "WATCH", "PASS", True) for n in (1, 0) for i in range(12_000)] + [(None, 1, at(1), "SKIP", None, None)]
    stream = feed(spark, str(tmp_path / "in"), [first, [(big + 7, 2, at(2), "PENDING", "PASS", True), (big + 8, 2, at(2), "SKIP", "PASS", True)]], kind)
    out = ticks.guarded(stream, "race_id", "n", "captured_at")
    path = str(tmp_path / "out")
    query = out.writeStream.outputMode("append").option("checkpointLocation", path + "-state").trigger(availableNow=True).format("parquet").start(path)
    query.awaitTermination()
    assert query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] == 3
    now = {r["race_id"]: tuple(r)[1:] for r in ticks.current(spark.read.schema(out.schema).parquet(path), "race_id", "n").collect()}
    assert len(now) == 12_001 and now.pop(None) == ("SKIP", None, None) and now.pop(big + 8) == ("SKIP", "PASS", True) and set(now.values()) == {("BUY", "PASS", True)}


def test_results_beyond_the_watermark_are_dropped(spark, tmp_path):
    races = feed(spark, str(tmp_path / "r"), [[(1, at(0)), (2, at(1)), (3, at(2))], [(4, at(72))], [(6, at(73))], [(5, at(100))]], "race_id long, closes timestamp")
    results = feed(spark, str(tmp_path / "x"), [[(1, at(3), 10)], [(9, at(72), 0)], [(9, at(73), 0)], [(2, at(20), 20), (4, at(80), 40)], [(9, at(120), 0)]], "race_id long, told timestamp, payout long")
    out = ticks.run_available(spark, ticks.awaited(races, results, "race_id", "closes", "told"))
    got = {r["race_id"]: r["payout"] for r in out.collect()}
    assert got[1] == 10 and got[2] is None and got[3] is None and got[4] == 40 and 5 not in got


def test_late_events_are_not_counted(spark, tmp_path):
    stream = feed(spark, str(tmp_path), [[("a", at(0)), ("a", at(0.5))], [("a", at(100))], [("a", at(100))], [("a", at(0.1)), ("a", at(100.1))], [("b", at(101))]], "kind string, ts timestamp")
    got = ticks.run_updates(spark, ticks.windowed_counts(stream, "ts", ["kind"], lateness="2 hours"), ["window_start", "kind"])
    assert sorted((r["kind"], r["n"]) for r in got.collect()) == [("a", 2), ("a", 3), ("b", 1)]


def test_due_work_at_the_edges(spark):
    from hexalane.plans.backfill import due

    minutes = {"exhibition": 25, "final": 13, "scratch_guard": 5, "urgent_entries": 90}
    left = spark.createDataFrame([(m,) for m in (91, 90, 26, 25, 13, 5, 0, -1, None)], "m int")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    works = left.select("m", due(now + F.make_dt_interval(mins="m"), now, F.lit(True), F.lit(True), minutes).alias("w")).collect()
    assert {r["m"]: r["w"] for r in works} == {
        91: [], 90: ["urgent_entries"], 26: ["urgent_entries"], 25: ["exhibition", "urgent_entries"], 13: ["exhibition", "final", "urgent_entries"], 5: ["exhibition", "final", "scratch_guard", "urgent_entries"], 0: ["urgent_entries"], -1: ["result"], None: [],
    }
