"""Aggregates per venue, race number, racer, lane and weather, and their daily merge.

Each aggregate is kept as sums and counts (a *partial*), which merge by adding;
rates are computed last.  A day is written as a partial of its own, so that
running it again replaces it instead of counting it twice.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_where, rate
from ..functions.patterns import PATTERNS, hit_places
from ..functions.text import wind_group

# Names of the pattern counters.
HITS = {"MAIN": "uichi_hits", "URA": "ura_uichi_hits", "NEW_MAIN": "new_uichi_hits", "NEW_URA": "new_ura_uichi_hits"}
RATES = {"MAIN": "uichi_rate", "URA": "ura_uichi_rate", "NEW_MAIN": "new_uichi_rate", "NEW_URA": "new_ura_uichi_rate"}
RACER = "boat1_registration_number"
HUNDREDTHS = "st_hundredths"


def won(place: int) -> Column:
    return F.col(f"result_{place}") == 1


def _timing() -> list[Column]:
    """Timing as a sum of whole hundredths and a count, which add up without rounding."""
    valid = F.col(HUNDREDTHS) > 0
    return [F.coalesce(F.sum(F.when(valid, F.col(HUNDREDTHS))), F.lit(0)).cast("long").alias("st_sum"), count_where(valid).alias("st_count")]


def _mean_timing() -> Column:
    return F.round(F.when(F.col("st_count") > 0, F.col("st_sum") / F.when(F.col("st_count") > 0, F.col("st_count")) / 100), 6)


def venue_race_partial(results: DataFrame, *more: str) -> DataFrame:
    counters = [count_where(hit_places(p)).alias(HITS[p]) for p in PATTERNS]
    return results.groupBy("venue_code", "race_number", *more).agg(F.count(F.lit(1)).alias("total_races"), *counters, count_where(won(1)).alias("boat1_wins"))


def merge(partials: DataFrame, keys: list[str], largest: tuple = (), least: tuple = (), latest: dict[str, int] | None = None) -> DataFrame:
    """One partial of many: counters add up, ``largest`` and ``least`` columns take their maximum and minimum.

    Columns of ``latest`` hold lists in falling order and keep their first ``n``
    together.  A list is bounded before it is gathered: a window keeps the ``n`` greatest
    of a key, below the shuffle as well, so a key with a long history costs no more.
    """
    latest = latest or {}
    numbers = [c for c in partials.columns if c not in (*keys, *latest)]
    pick = lambda c: F.max(c) if c in largest else F.min(c) if c in least else F.sum(c)
    out = partials.groupBy(*keys).agg(*[pick(c).alias(c) for c in numbers])
    for c, n in latest.items():
        each = partials.select(*keys, F.explode(c).alias("_one"))
        lists = _first(each, keys, n).groupBy(*keys).agg(F.sort_array(F.collect_list("_one"), False).alias(c))
        out = out.join(lists, keys, "left")
    return out.select(*partials.columns)


def _first(each: DataFrame, keys: list[str], n: int) -> DataFrame:
    from .ranking import first_n

    return first_n(each, keys, n, F.col("_one").desc()).drop("place")


def replaced(stored: DataFrame, incoming: DataFrame, day: str = "race_date", days: DataFrame | None = None) -> DataFrame:
    """Daily partials with those of the days run again in place of what was stored for them, so that a day counts once.

    The days are those of ``incoming``, or ``days`` where some may have no rows any more.
    """
    again = (incoming if days is None else days).select(day).distinct()
    return stored.join(again, day, "left_anti").select(*stored.columns).unionByName(incoming)


def venue_race_stats(partial: DataFrame) -> DataFrame:
    shares = [F.round(rate(HITS[p], "total_races"), 6).alias(RATES[p]) for p in PATTERNS]
    return partial.select("venue_code", "race_number", "total_races", *HITS.values(), "boat1_wins", *shares, F.round(rate("boat1_wins", "total_races"), 6).alias("boat1_win_rate"))


def _own(results: DataFrame) -> DataFrame:
    return results.where(F.col(RACER).isNotNull())


def _places(names: tuple[str, ...]) -> list[Column]:
    return [count_where(won(i + 1)).alias(n) for i, n in enumerate(names)]


#: How the columns of a racer's partial merge: the maximum, the earliest name, and the latest races.
RACER_STATE = {"largest": ("f_count",), "least": ("first_name",), "latest": {"recent": 20}}


def racer_partial(results: DataFrame, *more: str, recent: int = 20) -> DataFrame:
    """Counters of a racer in lane 1, the largest number of false starts, the earliest name, and the latest races as a bounded list."""
    own, keys = _own(results), [RACER, *more]
    name = F.min(F.when(F.col("boat1_racer_name").isNotNull(), F.struct("race_date", "race_id", "boat1_racer_name")))
    sums = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("boat1_races"), *_places(("boat1_wins", "boat1_2nd", "boat1_3rd")), count_where(hit_places("MAIN")).alias("uichi_count"), F.max("boat1_f_count").alias("f_count"), *_timing(), name.alias("first_name"))
    each = own.select(*keys, F.struct(F.col("race_date").alias("date"), "race_id").alias("_one"))
    lists = _first(each, keys, recent).groupBy(*keys).agg(F.sort_array(F.collect_list("_one"), False).alias("recent"))
    return sums.join(lists, keys)


def racer_final(partial: DataFrame) -> DataFrame:
    races = F.col("boat1_races")
    top2, top3 = F.col("boat1_wins") + F.col("boat1_2nd"), F.col("boat1_wins") + F.col("boat1_2nd") + F.col("boat1_3rd")
    return partial.select(
        F.col(RACER).alias("registration_number"), F.coalesce("first_name.boat1_racer_name", F.lit("")).alias("racer_name"), "boat1_races", "boat1_wins", "boat1_2nd", "boat1_3rd", "uichi_count", "f_count", "st_count",
        F.round(rate("boat1_wins", races), 6).alias("boat1_win_rate"), F.round(rate(top2, races), 6).alias("boat1_2rate"), F.round(rate(top3, races), 6).alias("boat1_3rate"), _mean_timing().alias("avg_st"),
        F.array_join(F.transform("recent", lambda x: x["race_id"].cast("string")), ",").alias("recent_races"),
    )


def racer_stats(results: DataFrame, recent: int = 20) -> DataFrame:
    """Per racer in lane 1; the most recent races are kept as a bounded, sorted list of ids."""
    return racer_final(racer_partial(results, recent=recent))


def racer_venue_partial(results: DataFrame, *more: str) -> DataFrame:
    return _own(results).groupBy(RACER, "venue_code", *more).agg(F.count(F.lit(1)).alias("boat1_races"), count_where(won(1)).alias("boat1_wins"), count_where(hit_places("MAIN")).alias("uichi_hits"), *_timing())


def racer_venue_final(partial: DataFrame) -> DataFrame:
    return partial.select(F.col(RACER).alias("registration_number"), "venue_code", "boat1_races", "boat1_wins", "uichi_hits", F.round(rate("boat1_wins", "boat1_races"), 6).alias("boat1_win_rate"), F.round(rate("uichi_hits", "boat1_races"), 6).alias("uichi_rate"), _mean_timing().alias("avg_st"), "st_count")


def racer_venue_stats(results: DataFrame) -> DataFrame:
    return racer_venue_final(racer_venue_partial(results))


def racer_lane_partial(results: DataFrame, *more: str) -> DataFrame:
    return _own(results).groupBy(RACER, *more).agg(F.count(F.lit(1)).alias("races"), *_places(("wins", "second", "third")), *_timing())


def racer_lane_final(partial: DataFrame) -> DataFrame:
    top2, top3 = F.col("wins") + F.col("second"), F.col("wins") + F.col("second") + F.col("third")
    return partial.select(F.col(RACER).alias("registration_number"), F.lit(1).alias("lane"), "races", "wins", "second", "third", F.round(rate("wins", "races"), 6).alias("win_rate"), F.round(rate(top2, "races"), 6).alias("second_rate"), F.round(rate(top3, "races"), 6).alias("third_rate"), _mean_timing().alias("avg_st"))


def racer_lane_stats(results: DataFrame) -> DataFrame:
    """Cumulative first, first two and first three rates in lane 1."""
    return racer_lane_final(racer_lane_partial(results))


WEATHER_KEYS = [RACER, "venue_code", "race_weather", "wind_speed_group"]


def racer_weather_partial(results: DataFrame, races: DataFrame, *more: str) -> DataFrame:
    """Joined to the race header on its logical key: results do not carry the weather themselves."""
    weather = races.where(F.col("weather").isNotNull()).select("race_id", "race_date", "venue_code", "race_number", F.col("weather").alias("race_weather"), wind_group("wind_speed").alias("wind_speed_group"))
    own = _own(results).join(weather, ["race_id", "race_date", "venue_code", "race_number"])
    return own.groupBy(*WEATHER_KEYS, *more).agg(F.count(F.lit(1)).alias("races"), count_where(won(1)).alias("wins"), *_timing())


def racer_weather_final(partial: DataFrame) -> DataFrame:
    return partial.select(F.col(RACER).alias("registration_number"), "venue_code", F.col("race_weather").alias("weather"), "wind_speed_group", "races", "wins", F.round(rate("wins", "races"), 6).alias("win_rate"), _mean_timing().alias("avg_st"))


def racer_weather_stats(results: DataFrame, races: DataFrame) -> DataFrame:
    return racer_weather_final(racer_weather_partial(results, races))


def venue_stats(results: DataFrame, venues: DataFrame) -> DataFrame:
    """A row for every venue, with zeros where it has no race."""
    from ..functions.patterns import combos

    shares = {c: f"combo_{c.replace('-', '_')}" for c in combos("MAIN")}
    sums = results.groupBy("venue_code").agg(F.count(F.lit(1)).alias("total_races"), count_where(won(1)).alias("c1_wins"), count_where(hit_places("MAIN")).alias("uichi_hits"), *[count_where(F.col("trifecta") == c).alias(n) for c, n in shares.items()])
    full = venues.join(sums, "venue_code", "left").na.fill(0)
    return full.select("venue_code", "total_races", "uichi_hits", F.round(rate("c1_wins", "total_races"), 4).alias("c1_win_rate"), F.round(rate("uichi_hits", "total_races"), 4).alias("uichi_rate"), *[F.round(rate(n, "total_races"), 4).alias(f"{n}_rate") for n in shares.values()])
