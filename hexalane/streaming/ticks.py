"""Structured Streaming over odds ticks and results: windows, late data, de-duplication, guarded upserts."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import GATES, gate_order, is_downgrade


def windowed_counts(stream: DataFrame, stamp: str, keys: list[str], width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Rows per window and key; rows later than ``lateness`` behind the newest are left out."""
    return stream.withWatermark(stamp, lateness).groupBy(F.window(stamp, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def strongest(batch: DataFrame, keys: list[str]) -> DataFrame:
    """One analysis per key: what has the warm-up first, then the better gate, then a judgment; the other columns break ties."""
    rest = [c for c in batch.columns if c not in keys]
    rank = [F.coalesce("exhibition_ready", F.lit(False)).alias("_ready"), gate_order(F.col("exhibition_gate_status")).alias("_gate"), (F.coalesce("judgment", F.lit("PENDING")) != "PENDING").alias("_judged")]
    return batch.groupBy(*keys).agg(F.max(F.struct(*rank, *rest)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upserted(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """A micro-batch merged into a table of analyses, refusing downgrades; for ``foreachBatch``.

    A key that the batch repeats counts once, by :func:`strongest`; the stored table
    holds a key once.
    """
    rest = [c for c in stored.columns if c not in keys]
    one = strongest(batch.select(*keys, *rest), keys)
    both = stored.select(*keys, F.struct(*rest).alias("old")).join(one.select(*keys, F.struct(*rest).alias("new")), keys, "full")
    chosen = F.when(F.col("new").isNull() | is_downgrade(F.col("old"), F.col("new")), F.col("old")).otherwise(F.col("new"))
    return both.select(*keys, chosen.alias("row")).select(*keys, "row.*")


CHANGE = "judgment string, exhibition_gate_status string, exhibition_ready boolean"
#: Keys share the state of a bucket: a call of Python costs far more than the few rows of a key.
BUCKETS = 8192


def guarded(stream: DataFrame, key: str, order: str, stamp: str, lateness: str = "1 day", keep: str = "2 days") -> DataFrame:
    """The accepted changes of a stream of analyses: ``key, order`` and the three columns of ``CHANGE``, in append mode.

    The last accepted analysis of each key is state; a row that would take back what
    it has established is refused, and a repeated one changes nothing.  Rows of a
    key within a batch are taken in their order.  Rows later than ``lateness`` are
    dropped, and a key's state goes ``keep`` after its last row, so state is bounded
    by what is under way.  Keys are held in ``BUCKETS`` by their hash, each with the
    moment at which it ends.  Only changes are written: :func:`current` reads the last.
    """
    import pandas as pd

    field = stream.schema[key].dataType.simpleString()
    number = stream.schema[order].dataType.simpleString()
    span = int(pd.Timedelta(keep).total_seconds() * 1000)
    names = ["judgment", "exhibition_gate_status", "exhibition_ready"]
    # keys travel as text: a null among integers would make floats of them
    held = "keys array<string>, judgments array<string>, gates array<string>, ready array<boolean>, ends array<bigint>"

    def fold(who, parts, state):
        mark = state.getCurrentWatermarkMs()
        now = {k: (new, end) for k, *new, end in zip(*state.get)} if state.exists else {}
        rows, out = [], []
        for part in () if state.hasTimedOut else parts:
            rows += zip(part[key].tolist(), part[order].tolist(), part["_at"].tolist(), *[[None if pd.isna(x) else x for x in part[c].tolist()] for c in names])
        rows.sort(key=lambda row: (True, 0) if pd.isna(row[1]) else (False, row[1]))
        seen = {}
        for k, n, at, judgment, gate, ready in rows:
            new = [judgment, gate, None if ready is None else bool(ready)]
            old = now.get(k, (None,))[0]
            if new != old and not (old and _steps_back(old, new)):
                now[k] = (new, 0)
                out.append((k, n, *new))
            seen[k] = max(seen.get(k, mark), at)
        # a key that came again lasts from its latest row, others end at their time
        now = {k: (new, seen[k] + span if k in seen else end) for k, (new, end) in now.items() if k in seen or end >= mark}
        if now:
            state.update(tuple(map(list, zip(*[(k, *new, end) for k, (new, end) in now.items()]))))
            state.setTimeoutTimestamp(max(min(end for _, end in now.values()), mark + 1))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=[key, order, *names])

    rows = stream.withWatermark(stamp, lateness).select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket"), F.col(key).cast("string").alias(key), order, stamp, F.coalesce(F.unix_millis(F.col(stamp).cast("timestamp")), F.lit(0)).alias("_at"), *names)
    changes = rows.groupBy("_bucket").applyInPandasWithState(fold, f"{key} string, {order} {number}, {CHANGE}", held, "append", "EventTimeTimeout")
    return changes.withColumn(key, F.col(key).cast(field))


def _steps_back(old: list, new: list) -> bool:
    """The rule of :func:`is_downgrade` for two analyses in hand."""
    return bool(old[2] and not new[2]) or (GATES.get(old[1], 0) >= 2 and GATES.get(new[1], 0) == 1) or (old[0] not in (None, "PENDING") and new[0] == "PENDING")


def current(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last accepted analysis of every key."""
    last = changes.groupBy(key).agg(F.max(F.struct(order, "judgment", "exhibition_gate_status", "exhibition_ready")).alias("row"))
    return last.select(key, "row.judgment", "row.exhibition_gate_status", "row.exhibition_ready")


def awaited(races: DataFrame, results: DataFrame, key: str, deadline: str, stamp: str, wait: str = "1 day", lateness: str = "10 minutes") -> DataFrame:
    """Races with the result that came within ``wait`` of the deadline, or with nulls once it can no longer come.

    Two streams joined by key and time: watermarks on both tell when a race is given
    up, so state holds the races of the last ``wait`` only.  Results later than the
    watermark are dropped.
    """
    r = results.withWatermark(stamp, lateness).withColumnRenamed(key, f"_{key}")
    race = races.withWatermark(deadline, lateness)
    inside = (F.col(key) == F.col(f"_{key}")) & (F.col(stamp) >= F.col(deadline)) & (F.col(stamp) <= F.col(deadline) + F.expr(f"interval {wait}"))
    return race.join(r, inside, "leftOuter").drop(f"_{key}")


def _folder(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder or, without one, its warehouse: both are shared by the cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def landed(table: DataFrame, files: int) -> DataFrame:
    """A table written as ``files`` files of a landing folder, to be read as a stream."""
    path = _folder(table.sparkSession)
    table.repartition(files).write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def folder_of(table: DataFrame) -> str:
    """The folder of a table made by :func:`landed`."""
    return table.inputFiles()[0].rsplit("/", 1)[0]


def run_available(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Run a stream over what is there, appending what it settles, and return that.

    Files are committed per batch, so a batch that runs again after a failure adds
    nothing twice.
    """
    path = _folder(spark)
    done = rows.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").option("path", f"{path}/table")
    done.start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/table")


def run_updates(spark: SparkSession, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Run an aggregating stream over what is there in update mode, and return the last row of every key.

    A batch writes the keys it changed, under its number: one that runs again after
    a failure replaces its own rows.  The watermark drops late rows and old state.
    """
    path = _folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rest = [c for c in counts.columns if c not in keys]
    changed = spark.read.option("basePath", f"{path}/table").parquet(f"{path}/table")
    return changed.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def upsert_available(stream: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream of analyses over what is there, merge every micro-batch into the table, and return the table.

    Each batch writes a version named by its number, so a batch that runs again
    after a failure replaces its own version and merges into the one before.
    """
    spark, path = stored.sparkSession, _folder(stored.sparkSession)
    stored.write.parquet(f"{path}/v0")

    def merge(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(stored.schema).parquet(f"{path}/v{number}")
        upserted(before, batch, keys).write.mode("overwrite").parquet(f"{path}/v{number + 1}")

    query = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else -1
    return spark.read.schema(stored.schema).parquet(f"{path}/v{last + 1}")
