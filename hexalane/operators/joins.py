"""Join shapes of the race data: as-of, anti, mismatch, remapping."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a dimension of one row per key.

    No hint: the optimiser broadcasts a dimension below its size threshold and
    sorts and merges beyond it, and adaptive execution splits skewed keys.
    """
    return left.join(right, keys, "left")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, stamp: str, tie: str, values: list[str], row_id: str, strict: bool = True) -> DataFrame:
    """Latest row of ``right`` before ``left.at`` (or at it, if not strict) per key; nulls if there is none.

    Both sides are laid on one time line per key and the last value seen is
    carried forward by a window, so that a key with many rows on both sides costs
    a sort and not a product.
    """
    event = F.struct(*values)
    a = left.select(*keys, F.col(at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.col(row_id).alias("_row"))
    b = right.where(F.col(stamp).isNotNull()).select(*keys, F.col(stamp).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.col(tie).alias("_tie"), event.alias("_value"))
    line = a.unionByName(b, allowMissingColumns=True)
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy("_at", "_side", F.col("_tie").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = line.withColumn("_value", F.last("_value", ignorenulls=True).over(before)).where("_row is not null")
    return left.join(carried.select(F.col("_row").alias(row_id), "_value"), row_id, "left").select(*left.columns, *[F.col("_value")[v].alias(v) for v in values])


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``left`` whose partner is missing or differs in a column (nulls are equal to nulls)."""
    other = right.select(*keys, F.struct(*columns).alias("_other"))
    same = F.col("_other").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col("_other")[c])
    return left.join(other, keys, "left").where(~same).withColumn("missing", F.col("_other").isNull()).drop("_other")


def carried_rank(today: DataFrame, yesterday: DataFrame, keys: list[str], rank: str, history: str) -> DataFrame:
    """Today's missing rank takes yesterday's if all of yesterday's history is part of today's."""
    old = yesterday.select(*keys, F.col(rank).alias("_rank"), F.col(history).alias("_history"))
    kept = F.size(F.array_except("_history", history)) == 0
    return today.join(old, keys, "left").withColumn(rank, F.coalesce(F.col(rank), F.when(kept, F.col("_rank")))).drop("_rank", "_history")


def bin_of(value: Column, edges: list[tuple]) -> Column:
    """Label of the half-open range ``[low, high)`` that holds a value; null outside all of them."""
    out = F
    for label, low, high in edges:
        test = (value >= low) if high is None else (value >= low) & (value < high)
        out = out.when(test, label)
    return out
