"""Connected components of a distributed edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import drop_path, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each
    step hangs neighbours below the smallest node in sight, so paths halve and a
    long chain takes a logarithmic number of rounds.  Only the minimum of a
    neighbourhood is aggregated, which combines on the map side; no
    neighbourhood is gathered into one row, and nothing goes to the driver but
    two counters per round.  Self-loops and repeated edges are allowed; an empty
    table gives an empty table.
    """
    current = materialise(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        near = _both_ways(current)
        lowest = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.where("v > u").join(lowest, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # small star: each node links its smaller neighbours and itself to the smallest of them
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("u"), F.explode(F.array("v", "u")).alias("v"))
        after = materialise(small.where("u < v").distinct(), "edges")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop_path(after.sparkSession, current)
        current = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
