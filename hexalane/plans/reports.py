"""Read-side reports: statistics, trends, back-tests of judgments, learning metrics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_where, half_up, rate
from ..functions.patterns import PATTERNS, hit, hit_places
from ..functions.text import score_bucket
from ..operators.joins import bin_of
from ..operators.ranking import argmax, latest

# Bands of expected value and of structure scores, and sample sizes of the learning tiers.
EV_BANDS = [("100-120", 100, 120), ("120-140", 120, 140), ("140-160", 140, 160), ("160-200", 160, 200), ("200+", 200, None)]
STRUCTURE_BANDS = [("0-39", 0, 40), ("40-54", 40, 55), ("55-69", 55, 70), ("70-84", 70, 85), ("85-100", 85, 101)]
RELIABLE, CANDIDATE = 100, 30
STAKE_SIX, STAKE_ONE = 600, 100


def _returns(df: DataFrame, keys: list[str], stake: int) -> DataFrame:
    """Races, hits, payout of hits, and the share of the stakes that came back, per key."""
    main = hit("MAIN", "trifecta")
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), count_where(main).alias("hits"), F.coalesce(F.sum(F.when(main, F.col("payout_trifecta"))), F.lit(0)).cast("long").alias("payout"))
    out = sums.withColumn("investment", F.col("total") * F.lit(stake))
    return out.withColumn("rate", F.round(rate("hits", "total"), 6)).withColumn("return_rate", F.round(rate("payout", "investment"), 6))


def trends(results: DataFrame, by: str | None = None, least: int = 0) -> DataFrame:
    """Hit and return rates by ``month`` or ``venue_code``, or overall."""
    rows = results.withColumn("month", F.date_format("race_date", "yyyy-MM")) if by == "month" else results
    out = _returns(rows, [by] if by else [], STAKE_SIX)
    return out.where(F.col("total") >= least) if least else out


def stats_by(results: DataFrame, key: str) -> DataFrame:
    return results.groupBy(key).agg(F.count(F.lit(1)).alias("total"), count_where(hit("MAIN", "trifecta")).alias("hits"))


def stats_by_race_number(results: DataFrame) -> DataFrame:
    """Race numbers 1 to 12, with zeros where there is none."""
    spine = results.sparkSession.range(1, 13).select(F.col("id").alias("race_number"))
    return spine.join(stats_by(results, "race_number"), "race_number", "left").na.fill(0)


def stats_by_combo(results: DataFrame) -> DataFrame:
    return results.where(hit("MAIN", "trifecta")).groupBy("trifecta").agg(F.count(F.lit(1)).alias("count"), F.sum("payout_trifecta").cast("long").alias("sum_payout"))


def with_result(analyses: DataFrame, results: DataFrame) -> DataFrame:
    """Analyses that have a result, joined on the race."""
    return analyses.join(results.select("race_id", "trifecta", "payout_trifecta"), "race_id")


def buy_performance(analyses: DataFrame, results: DataFrame) -> DataFrame:
    """Final BUY judgments by month, with the mean expected value rounded half up."""
    own = with_result(analyses.where("stage = 'final' and judgment = 'BUY'"), results).withColumn("month", F.date_format("race_date", "yyyy-MM"))
    ev = own.groupBy("month").agg(half_up(F.avg(F.coalesce("expected_value", F.lit(0.0)))).alias("avg_ev"))
    return _returns(own, ["month"], STAKE_ONE).join(ev, "month")


def ev_bins(analyses: DataFrame, results: DataFrame) -> DataFrame:
    """Final BUY judgments by band of expected value; bands without rows show zeros, values below the first band drop out."""
    own = with_result(analyses.where("stage = 'final' and judgment = 'BUY'"), results).withColumn("band", bin_of(F.coalesce("expected_value", F.lit(0.0)), EV_BANDS))
    spine = own.sparkSession.createDataFrame([(b[0],) for b in EV_BANDS], "band string")
    return spine.join(_returns(own.where("band is not null"), ["band"], STAKE_ONE), "band", "left").na.fill(0).na.fill(0.0)


def structure_bins(structure: DataFrame, results: DataFrame) -> DataFrame:
    """Hit rates by band of the two structure scores, in one pass over both."""
    both = with_result(structure, results).select("trifecta", F.explode(F.array(F.struct(F.lit("MAIN").alias("kind"), F.col("main_score").alias("score")), F.struct(F.lit("URA").alias("kind"), F.col("ura_score").alias("score")))).alias("x"))
    own = both.select("x.kind", bin_of(F.col("x.score"), STRUCTURE_BANDS).alias("band"), F.when(F.col("x.kind") == "MAIN", hit("MAIN", "trifecta")).otherwise(hit("URA", "trifecta")).alias("hit"))
    return own.where("band is not null").groupBy("kind", "band").agg(F.count(F.lit(1)).alias("total"), count_where(F.col("hit")).alias("hits")).withColumn("hit_rate", F.round(rate("hits", "total"), 6))


def alert_rows(alerts: DataFrame, analyses: DataFrame, results: DataFrame) -> DataFrame:
    """One alert per race (a final one before others, then the newest) with its final analysis and result."""
    final = F.coalesce(F.col("final_judgment") != "PENDING", F.lit(False)).cast("int")
    own = latest(alerts.where("status <> 'filtered_out'").withColumn("is_final", final), ["race_id"], "is_final", "dup_no")
    last = latest(analyses.where("stage = 'final'").select("race_id", "judgment", F.col("expected_value").alias("analysis_ev"), "captured_at", "dup_no"), ["race_id"], "captured_at", "dup_no").drop("captured_at", "dup_no")
    found = results.select("race_date", "venue_code", "race_number", "race_id", "trifecta", "payout_trifecta").withColumnRenamed("race_id", "result_id")
    one = latest(found, ["race_date", "venue_code", "race_number"], "result_id")
    rows = own.join(last, "race_id", "left").join(one, ["race_date", "venue_code", "race_number"], "left")
    return rows.where("pre_grade is not null or pre_appearance_rate is not null").select(
        "race_id", "race_date", "venue_code", "race_number", "pre_grade", "pre_appearance_rate", F.coalesce("judgment", "final_judgment").alias("judgment"), F.coalesce("analysis_ev", "final_expected_value").alias("expected_value"),
        F.col("trifecta").isNotNull().alias("completed"), "trifecta", "payout_trifecta", F.when(F.col("trifecta").isNotNull(), hit("MAIN", "trifecta")).alias("is_hit"),
    )


def alert_summary(rows: DataFrame) -> DataFrame:
    done, good = F.col("completed"), F.coalesce("is_hit", F.lit(False))
    kind = lambda j: done & (F.col("judgment") == j)
    counts = rows.agg(
        F.count(F.lit(1)).alias("alert_count"), count_where(done).alias("completed_count"), count_where(done & good).alias("hit_count"), count_where(kind("BUY")).alias("buy_count"), count_where(kind("BUY") & good).alias("buy_hit_count"),
        count_where(kind("WATCH")).alias("watch_count"), count_where(kind("WATCH") & good).alias("watch_hit_count"), count_where(done & F.coalesce(F.col("judgment") == "PENDING", F.lit(True))).alias("no_final_count"),
    )
    return counts.withColumn("hit_rate", F.round(rate("hit_count", "completed_count"), 6)).withColumn("buy_hit_rate", F.round(rate("buy_hit_count", "buy_count"), 6)).withColumn("watch_hit_rate", F.round(rate("watch_hit_count", "watch_count"), 6))


def outcomes(samples: DataFrame) -> DataFrame:
    """Which pattern came in, whether the recommended one did, and hits that the judgment passed over."""
    from ..functions.patterns import pattern_of

    s = samples.withColumn("outcome_pattern", pattern_of("trifecta"))
    for p, name in zip(PATTERNS, ("main_hit", "ura_hit", "new_main_hit", "new_ura_hit")):
        s = s.withColumn(name, hit_places(p))
    missed = F.col("outcome_pattern") != "OTHER"
    own = F.coalesce(*[F.when(F.col("recommended_pattern") == p, hit_places(p)) for p in PATTERNS], F.lit(False))
    return s.withColumn("boat1_win", F.col("result_1") == 1).withColumn("recommended_hit", own).withColumn("false_skip", missed & (F.col("final_judgment") == "SKIP")).withColumn("false_watch", missed & (F.col("final_judgment") == "WATCH"))


def learning_metrics(samples: DataFrame) -> DataFrame:
    """Each sample counts in twelve dimensions; per dimension and value, outcome rates and the best pattern.

    The fan-out is a constant twelve rows per sample and is combined on the map
    side before the shuffle.
    """
    text = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d))
    hypothesis, scenario, pattern, mode = text("program_hypothesis", "UNKNOWN"), text("program_scenario_status", "UNKNOWN"), text("recommended_pattern", "UNKNOWN"), text("logic_mode", "OTHER")
    escape = score_bucket("racer_escape_execution")
    # Names of the dimensions.
    dimensions = {
        "program_hypothesis": hypothesis, "scenario_status": scenario, "recommended_pattern": pattern, "intent_confidence_bucket": score_bucket("program_intent_confidence"), "escape_execution_bucket": escape,
        "direction_confidence_bucket": score_bucket("direction_confidence"), "hypothesis_x_escape": F.concat_ws("|", hypothesis, escape), "scenario_x_pattern": F.concat_ws("|", scenario, pattern), "logic_mode": mode,
        "series_day": text("series_day", "0"), "logic_x_pattern": F.concat_ws("|", mode, pattern), "venue_x_logic": F.concat_ws("|", text("venue_code", "00"), mode),
    }
    flags = ["boat1_win", "main_hit", "ura_hit", "new_main_hit", "new_ura_hit", "recommended_hit", "false_skip", "false_watch"]
    fan = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in dimensions.items()]))
    counts = outcomes(samples).select(*flags, fan.alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("sample_count"), *[count_where(F.col(f)).alias(f"{f}_count") for f in flags])
    n = F.col("sample_count")
    rates = {p: F.col(f"{f}_count") / n for p, f in zip(PATTERNS, ("main_hit", "ura_hit", "new_main_hit", "new_ura_hit"))}
    return counts.select(
        "dimension", "value", "sample_count", *[f"{f}_count" for f in flags], argmax(rates).alias("candidate_pattern"), F.round(F.greatest(*rates.values()), 6).alias("candidate_lift"),
        F.when(n >= RELIABLE, "RELIABLE").when(n >= CANDIDATE, "CANDIDATE").otherwise("LEARNING").alias("candidate_status"), (n >= RELIABLE).alias("reliable"),
    )


def notifications(analyses: DataFrame, told: dict[str, Column], watch: bool = False, least_ev: float = 110.0, least_trust: float = 0, only_strong: bool = False, strong: float = 85) -> Column:
    """The channels on which the latest analysis of a race and stage is worth a message, as an array.

    ``push`` takes final BUYs (and WATCHes with ``watch``) whose expected value and
    trust, where known, reach their thresholds; with ``only_strong`` the trust has to
    be known and reach ``strong``.  ``chat_pre`` takes grades S and A before the race,
    ``chat_final`` final BUYs and WATCHes, ``chat_result`` final BUYs.  ``told`` says per
    channel what was sent before: that is not sent again.
    """
    c = F.col
    final, judgment = c("stage") == "final", c("judgment")
    wanted = judgment.isin("BUY", "WATCH") if watch else judgment == "BUY"
    push = final & wanted & (c("expected_value").isNull() | (c("expected_value") >= least_ev))
    if least_trust > 0:
        push = push & (c("boat1_trust_score").isNull() | (c("boat1_trust_score") >= least_trust))
    if only_strong:
        push = push & F.coalesce(c("boat1_trust_score") >= strong, F.lit(False))
    tests = {"push": push, "chat_pre": (c("stage") == "pre") & c("pre_grade").isin("S", "A"), "chat_final": final & judgment.isin("BUY", "WATCH"), "chat_result": final & (judgment == "BUY")}
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)) & ~told[name], name) for name, test in tests.items()]))
