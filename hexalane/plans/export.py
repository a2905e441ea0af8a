"""The export of days: six result sets under one logical race key, with warnings, errors and a manifest.

Races of one date, venue and number are one race in the export: the richest stands
for all, and what hangs on any of them moves to the common key.  All sets come from
one stored map of race ids, so they agree with each other; the manifest is written
last, from the files themselves, and a reader takes only what a manifest names.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import race_key
from ..operators.ranking import first_by
from ..operators.repairs import rebuilt, two_tier_as_of
from ..operators.spread import dealt
from ..sources.official_files import VENUES

# The fields that make a race rich, the points of a ready warm-up, and the order of stages.
RICH = ("race_name", "grade", "event_name", "series_key", "series_start_date", "series_end_date", "series_day", "race_phase", "deadline", "beforeinfo_fetched_at", "entries_fetched_at", "odds_fetched_at")
READY, STAGES = 3, {"final": 3, "day": 2, "pre": 1}
SETS = ("races", "entries", "series", "results", "odds", "features")


def richness(races: DataFrame) -> Column:
    there = [F.col(c).isNotNull().cast("int") for c in RICH if c in races.columns]
    return reduce(lambda a, b: a + b, there, F.lit(0)) + F.when(F.coalesce("exhibition_ready", F.lit(False)), READY).otherwise(0)


def _named(code: Column) -> Column:
    n = code.try_cast("int")
    return F.try_element_at(F.array(*map(F.lit, VENUES)), F.when(n > 0, n))


def bundle(races: DataFrame, entries: DataFrame, results: DataFrame, odds: DataFrame, analyses: DataFrame, series: DataFrame, store: str, tasks: int | None = None) -> dict[str, DataFrame]:
    """The six sets by name, and ``warnings`` and ``errors`` (``race_date, race_key, type, n``).

    Only official races are exported.  Errors: ``venue_mismatch``, a name that is not that
    of the venue's code; such races are left out with all that hangs on them.
    Warnings: ``race_number_out_of_range``, ``duplicate_race_key_normalized``,
    ``boat_number_out_of_range`` and ``duplicate_boat`` (those entries are left out) and
    ``too_many_entries``.  Results without a first place are left out; of the analyses of a
    race the latest of the furthest stage is a feature row; a racer's series points are
    those known at the deadline, of the series or else of the venue.  ``store`` is a folder for the
    stored map.  Entries meet in ``tasks`` tasks, if a number is given.
    """
    official = races.where("data_source = 'official'").withColumn("race_key", race_key())
    right = F.coalesce(F.col("venue_name") == _named(F.col("venue_code")), F.lit(False))
    fault = lambda df, kind, n=None: df.groupBy("race_date", "race_key").agg((F.count(F.lit(1)) if n is None else n).alias("n")).select("race_date", "race_key", F.lit(kind).alias("type"), "n")
    errors = fault(official.where(~right), "venue_mismatch")
    valid = official.where(right)
    canonical = rebuilt(first_by(valid, ["race_key"], richness(valid).desc(), F.col("race_id").desc()), store)
    ids = rebuilt(valid.select("race_id", "race_key", F.col("race_date").alias("day")), store)
    head = canonical.select("race_key", F.col("race_id").alias("canonical_id"), F.col("race_date").alias("day"), F.col("venue_code").alias("venue"), F.col("race_number").alias("number"))
    under = lambda table: table.join(ids.drop("day"), "race_id")
    dated = lambda table: table.join(head.select("race_key", "day"), "race_key").withColumn("race_date", F.col("day")).drop("day")

    e = dealt(dealt(entries, tasks, "race_id").join(dealt(ids.drop("day"), tasks, "race_id"), "race_id"), tasks, "race_key").join(dealt(head, tasks, "race_key"), "race_key").withColumn("race_date", F.col("day"))
    fit = F.coalesce(F.col("boat_number").between(1, 6), F.lit(False))
    own = e.where(fit)
    kept = first_by(own, ["race_key", "boat_number"], (F.col("race_id") == F.col("canonical_id")).desc(), "race_id", "registration_number")
    twice = own.groupBy("race_date", "race_key", "boat_number").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    kept = kept.withColumns({"venue_code": F.col("venue"), "race_number": F.col("number")}).drop("venue", "number", "day", "canonical_id")
    warnings = [
        fault(valid.where(~F.coalesce(F.col("race_number").between(1, 12), F.lit(False))), "race_number_out_of_range"), fault(valid, "duplicate_race_key_normalized").where("n > 1"), fault(e.where(~fit), "boat_number_out_of_range"),
        fault(twice, "duplicate_boat", F.sum(F.col("m") - 1)), fault(kept, "too_many_entries").where("n > 6"),
    ]

    stage = reduce(lambda w, s: w.when(F.col("stage") == s, STAGES[s]), STAGES, F).otherwise(0)
    features = first_by(under(analyses), ["race_key"], stage.desc(), F.desc_nulls_last("captured_at"), F.desc("race_id"), F.desc("dup_no"))
    racers = kept.select("race_key", "registration_number", "boat_number").join(canonical.select("race_key", "series_key", "venue_code", F.coalesce(F.col("deadline").cast("date"), F.lit("9999-12-31").cast("date")).alias("at")), "race_key")
    racers = racers.where("registration_number <> ''").withColumn("line", F.concat_ws("_", "race_key", F.col("boat_number").cast("string")))
    points = two_tier_as_of(racers, series, ["series_key", "registration_number"], ["venue_code", "registration_number"], "at", "as_of_date", "point_id", ["point_id", "series_score"], "line")
    lean = lambda table: table.drop("race_id")
    return {
        "races": canonical.drop("data_source"), "entries": lean(kept), "series": dated(points.where("point_id is not null").select("race_key", "registration_number", "point_id", "series_score")),
        "results": lean(dated(under(results.where("result_1 is not null").drop("race_date")))), "odds": lean(dated(under(odds))), "features": lean(dated(features.drop("race_date"))),
        "warnings": reduce(DataFrame.unionByName, warnings), "errors": errors,
    }


def write(sets: dict[str, DataFrame], path: str, folders: bool = True) -> DataFrame:
    """Write every set as packed JSON lines below ``path``, and the manifest last; return the manifest read back.

    A set has a folder of its own, with a folder per day in it where ``folders`` is set
    (for some days; a whole history would be as many small files).

    The manifest has a row per day: the rows of each set, counted in the files, and the
    venues.  A job that fails before it leaves files that no manifest names; it runs
    again under a new path.
    """
    spark: SparkSession = sets["races"].sparkSession
    for name, rows in sets.items():
        # with folders a day of a set is one task and one file; without, rows are written where they are
        (rows.repartition("race_date").write.partitionBy("race_date") if folders else rows.write).json(f"{path}/{name}", compression="gzip")  # a tenth of the text

    def count(name):
        # a set without a row has no file to infer a schema from
        rows = spark.read.schema(sets[name].schema).json(f"{path}/{name}")
        return rows.groupBy(F.col("race_date").cast("date").alias("race_date"), F.lit(name).alias("set")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("venue_code" if name == "races" else F.lit(None).cast("string"))).alias("venues"))  # 24 venues at most

    rows = reduce(DataFrame.unionByName, [count(n) for n in sets])
    counts = [F.coalesce(F.sum(F.when(F.col("set") == n, F.col("n"))), F.lit(0)).alias(f"n_{n}") for n in sets]
    manifest = rows.groupBy("race_date").agg(*counts, F.coalesce(F.max(F.when(F.col("set") == "races", F.array_join("venues", ","))), F.lit("")).alias("venue_codes"))
    manifest.write.json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")
