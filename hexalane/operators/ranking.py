"""Ranking and de-duplication per key, always with a total order.

A key of a large share of all rows is no problem for the aggregate forms
(:func:`latest`, :func:`merged`), which combine before and after the shuffle (by
sorting, since Spark hashes no buffers of structs); the window forms keep at most
``n`` rows per key, and group limits reach below the shuffle.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key with the greatest ``order`` columns, in one aggregation with partial results."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, "row.*")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key under an order of columns, nulls and directions as given."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def first_n(df: DataFrame, keys: list[str], n: int, *order: Column, rank_name: str = "place") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank_name, place.cast("int")).where(F.col(rank_name) <= n)


def filled(columns: list[str]) -> Column:
    """Number of columns that are not null."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def merged(df: DataFrame, keys: list[str], columns: list[str], *order: str) -> DataFrame:
    """One row per key: of each column the value of the row with the greatest ``order`` among rows where it is not null."""
    best = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*best)


def argmax(scores: dict[str, Column]) -> Column:
    """Name of the largest score; the one named first wins a tie."""
    values = list(scores.values())
    top = F.greatest(*values)
    out = F
    for name, value in scores.items():
        out = out.when(value == top, name)
    return out


def top_reasons(reasons: Column, k: int) -> Column:
    """The ``k`` strongest reasons of an array of ``(label, strength)``; equal ones in their given order, nulls left out."""
    indexed = F.transform(F.filter(reasons, lambda r: r.isNotNull()), lambda r, i: F.struct((-r["strength"]).alias("s"), i.alias("i"), r["label"].alias("label"), r["strength"].alias("strength")))
    return F.transform(F.slice(F.array_sort(indexed), 1, k), lambda r: F.struct(r["label"].alias("label"), r["strength"].alias("strength")))


def repair_order(races: DataFrame, entries: DataFrame, now: Column, open_: Column, full: int = 6, minutes: int = 90) -> DataFrame:
    """Open races of fewer than ``full`` entries (none at all is 0), most urgent first.

    Deadlines within ``minutes`` of ``now`` lead, the nearest first; then venues that
    have entries of any race of that day; then the deadline, unknown ones last.
    """
    venue = ["race_date", "venue_code"]
    n = entries.groupBy("race_id").agg(F.count(F.lit(1)).alias("n_entries"))
    counted = races.join(n, "race_id", "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0)))
    filled = counted.groupBy(*venue).agg((F.sum("n_entries") > 0).alias("partly_filled"))
    soon = F.coalesce((F.col("deadline") >= now) & (F.col("deadline") <= now + F.make_interval(mins=F.lit(minutes))), F.lit(False))
    queue = counted.where(open_ & (F.col("n_entries") < full)).join(filled, venue).withColumn("soon", soon)
    return queue.orderBy(F.desc("soon"), F.when(F.col("soon"), F.col("deadline")).asc_nulls_last(), F.desc("partly_filled"), F.asc_nulls_last("deadline"), "race_id")


def in_runs(df: DataFrame, key: str, order: str, width: int, n: int, size: int = 65_536) -> tuple[DataFrame, "Window"]:
    """``df`` dealt to runs of ``size`` rows per key in its order, and the window of the last ``n`` rows within a run.

    A rolling window over few keys would be as many tasks as keys.  Here rows are
    numbered within slices of ``width`` of the integer ``order``, the slices' sizes
    (a row each) give every row its place in its key, and each run also holds the
    ``n - 1`` rows before it, marked ``_own`` false: keep ``_own`` rows after
    applying the window.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order) / width))
    sizes = sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sliced.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_slice").orderBy(order)) - 1).join(sizes.select(key, "_slice", before.alias("_before")), [key, "_slice"])
    at = F.col("_before") + F.col("_in")
    run = F.floor(at / size)
    later = F.when(at % size >= size - (n - 1), F.struct((run + 1).alias("run"), F.lit(False).alias("own")))
    both = placed.withColumn("_at", at).withColumn("_r", F.explode(F.array_compact(F.array(F.struct(run.alias("run"), F.lit(True).alias("own")), later))))
    out = both.select(*df.columns, "_at", F.col("_r.run").alias("_run"), F.col("_r.own").alias("_own"))
    return out, Window.partitionBy(key, "_run").orderBy("_at").rowsBetween(-(n - 1), 0)
