"""Audits: every rule gives rows ``(race_id, n)``; all rules together are one table."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import orphans
from .spread import dealt


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select("race_id", F.lit(name).alias("rule"), F.col("n").cast("long").alias("n")) for name, df in rules.items()])


def integrity_rules(races: DataFrame, entries: DataFrame, analyses: DataFrame, active: Column, full: int = 6, tasks: int | None = None) -> dict[str, DataFrame]:
    """The five rules of the integrity check; ``active`` says which entries count towards ``full``.

    A race without any entry has 0 of them; ``n`` of ``few_entries`` is the number
    there is, ``n`` of the others the number of rows at fault.  Rows meet in ``tasks``
    tasks, if a number is given.
    """
    key = ["race_date", "venue_code", "race_number"]
    same = dealt(races.select("race_id", *key), tasks, *key).groupBy(*key).agg(F.min("race_id").alias("race_id"), F.count(F.lit(1)).alias("n"))
    races, entries, analyses = (dealt(x, tasks, "race_id") for x in (races.select("race_id"), entries, analyses))

    def per_race(df):
        return df.groupBy("race_id").agg(F.count(F.lit(1)).alias("n"))

    filled = races.select("race_id").distinct().join(per_race(entries.where(active)), "race_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return {
        "few_entries": filled.where(F.col("n") < full),
        "orphaned_entries": per_race(orphans(entries, races, ["race_id"])),
        "pending_final": per_race(analyses.where("stage = 'final' and judgment in ('PENDING', 'MISSING')")),
        "lost_exhibition": per_race(entries.where("exhibition_time is not null and exhibition_st is null and entry_course is null")),
        "duplicate_race": same.where("n > 1"),
    }
