"""Idempotent imports: classify incoming rows, merge without losing values, never go back in state."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(incoming: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, action`` for every key of both sides: create, update, unchanged or absent; keys given twice are errors."""
    new = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in columns])
    both = new.select(key, "n", F.struct(*columns).alias("new")).join(stored.select(key, F.struct(*columns).alias("old")), key, "full")
    same = reduce(lambda a, b: a & b, [F.col("new")[c].eqNullSafe(F.col("old")[c]) for c in columns])
    return both.select(key, F.when(F.col("n") > 1, "duplicate").when(F.col("new").isNull(), "absent").when(F.col("old").isNull(), "create").when(same, "unchanged").otherwise("update").alias("action"))


def merge_non_null(incoming: DataFrame, stored: DataFrame, key: str, columns: list[str], guarded: dict[str, str]) -> DataFrame:
    """Stored rows with incoming values laid over them: null never overwrites, and a guarded column keeps its final state."""
    new = incoming.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = stored.select(key, *columns).join(new, key, "full")

    def one(c: str) -> Column:
        value = F.coalesce(f"_{c}", c)
        return (F.when(F.col(c) == guarded[c], F.col(c)).otherwise(value) if c in guarded else value).alias(c)

    return out.select(key, *map(one, columns))


# Order of the exhibition gate.
GATES = {"PASS": 4, "CAUTION": 3, "FAIL": 2, "MISSING": 1, "PRE": 0}


def gate_order(gate: Column) -> Column:
    out = F
    for name, order in GATES.items():
        out = out.when(gate == name, order)
    return out.otherwise(0)


def is_downgrade(old: Column, new: Column) -> Column:
    """Whether a new analysis would take back what an old one has established."""
    lost = F.coalesce(old["exhibition_ready"], F.lit(False)) & ~F.coalesce(new["exhibition_ready"], F.lit(False))
    gate = (gate_order(old["exhibition_gate_status"]) >= 2) & (gate_order(new["exhibition_gate_status"]) == 1)
    open_again = F.coalesce(old["judgment"] != "PENDING", F.lit(False)) & (new["judgment"] == "PENDING")
    return old.isNotNull() & (lost | gate | F.coalesce(open_again, F.lit(False)))


def analysis_rank(df: DataFrame) -> Column:
    """Completeness score by which one of several analyses of a race and stage stays."""
    gate = F.when(F.col("exhibition_gate_status") == "PASS", 500).when(F.col("exhibition_gate_status") == "CAUTION", 400).when(F.col("exhibition_gate_status") == "FAIL", 300).otherwise(0)
    return F.when(F.col("exhibition_ready"), 1000).otherwise(0) + gate + F.when(F.col("exhibition_time").isNotNull(), 50).otherwise(0) + F.when(F.col("judgment") != "PENDING", 100).otherwise(0)
