"""Vectors keep their place over the levels of the index, however many parts a level has."""

import numpy as np
from pyspark.sql import functions as F

from hexalane.llm import ann


def test_rows_of_parts_that_are_not_cut_stay(spark):
    r = np.random.default_rng(4)
    rows = spark.createDataFrame([(1 + i % 3, i, r.normal(size=6).tolist()) for i in range(900)], "part long, id long, v array<double>")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size")).where("part = 2")
    routers = ann._learnt(rows, sizes, 4, 0.95, 5, 1000)
    down = ann._descend(rows, routers, sizes, 4, False).select("id", "part").collect()
    assert sorted(x["id"] for x in down) == list(range(900))
    assert all((x["part"] == 1 + x["id"] % 3) == (x["id"] % 3 != 1) for x in down)
    many = spark.range(3, 400).select(F.col("id").alias("part"), F.lit(1).alias("probes"), F.array(F.lit(8), F.lit(1), F.lit(2), F.lit(1)).alias("shape"), F.lit(bytes(80)).alias("weights"))
    again = ann._descend(rows, routers.unionByName(many.where("part > 3")), sizes, 4, False).select("id", "part").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, down))
