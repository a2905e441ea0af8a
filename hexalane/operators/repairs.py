"""Repairs and gates between tables: relinking, canonical rows, freezing, cross-file checks, spacing of ticks."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import as_of, orphans
from .ranking import filled, first_by, merged


def two_tier_as_of(left: DataFrame, right: DataFrame, exact: list[str], fallback: list[str], at: str, stamp: str, tie: str, values: list[str], row_id: str) -> DataFrame:
    """Latest row of ``right`` at or before ``left.at`` on the exact key, or on the fallback key if no row has the exact one at all.

    A key that exists, but only later, gives nulls and not the fallback.
    """
    known = right.select(*exact).distinct().withColumn("_known", F.lit(True))
    marked = left.join(known, exact, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    parts = [as_of(marked.where(test), right, keys, at, stamp, tie, values, row_id, strict=False) for test, keys in ((F.col("_known"), exact), (~F.col("_known"), fallback))]
    return parts[0].unionByName(parts[1]).drop("_known")


def canonical(races: DataFrame, children: dict[str, tuple[DataFrame, int]], key: list[str], fields: list[str]) -> DataFrame:
    """``key, race_id, canonical_id, completeness`` for every race: the most complete of those that share a logical key stands for all.

    ``children`` are tables by name with the points that each of their rows counts;
    a field that is there counts 3, a ready warm-up 20, a finished race 10.
    """
    out = races.withColumn("completeness", filled(fields) * 3 + F.when(F.coalesce("exhibition_ready", F.lit(False)), 20).otherwise(0) + F.when(F.coalesce(F.col("status") == "finished", F.lit(False)), 10).otherwise(0))
    for name, (table, points) in children.items():
        n = table.groupBy("race_id").agg((F.count(F.lit(1)) * points).alias(f"_{name}"))
        out = out.join(n, "race_id", "left").withColumn("completeness", F.col("completeness") + F.coalesce(f"_{name}", F.lit(0))).drop(f"_{name}")
    best = out.groupBy(*key).agg(F.max(F.struct("completeness", (-F.col("race_id")).alias("turn"))).alias("best")).select(*key, (-F.col("best.turn")).alias("canonical_id"))
    return out.join(best, key).select(*key, "race_id", "canonical_id", F.col("completeness").cast("long").alias("completeness"))


def relinked(entries: DataFrame, races: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """What becomes of entries whose race is gone: ``race_id, boat_number, target_id, action`` and the merged ``fields``.

    They go to the race of the same key with the greatest id: moved if it lacks the
    boat, else merged into its entry (whose values stay where it has them); without
    such a race they are unresolved.
    """
    lost = orphans(entries, races, ["race_id"])
    target = races.groupBy(*key).agg(F.max("race_id").alias("target_id"))
    there = entries.join(races.select("race_id"), "race_id", "left_semi").select(F.col("race_id").alias("target_id"), "boat_number", F.struct(*fields).alias("_own"), F.lit(True).alias("_there"))
    out = lost.join(target, key, "left").join(there, ["target_id", "boat_number"], "left")
    action = F.when(F.col("target_id").isNull(), "unresolved").when(F.col("_there"), "merged").otherwise("moved")
    return out.select("race_id", "boat_number", "target_id", action.alias("action"), *[F.coalesce(F.col("_own")[f], f).alias(f) for f in fields])


#: Kept ticks of a list of the fold.
LIST = 128


def spaced(ticks: DataFrame, key: str, stamp: str, tie: str, seconds: int = 120) -> DataFrame:
    """The ticks of each key that come more than ``seconds`` after the last one kept; the first is kept.

    Each decision rests on the one before, so a key's stamps (one race's, a day of
    polling) are folded in order; no other column is gathered.  Of equal stamps only
    the first by ``tie`` can be kept, so a stamp is gathered once.  The fold holds the
    last kept one and a list in the order of the stamps, which grows by a part of its
    length at a time: one list of all would be copied for each tick kept.
    """
    first = ticks.groupBy(key, F.col(stamp).alias("at")).agg(F.min(tie).alias("tie"))
    order = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "tie"))).alias("ticks"))
    kind = ticks.schema[tie].dataType.simpleString()
    none = F.struct(F.lit(None).cast(ticks.schema[stamp].dataType).alias("at"), F.array().cast(f"array<{kind}>").alias("kept"), F.array().cast(f"array<array<{kind}>>").alias("full"))
    late = lambda s, t: s["at"].isNull() | (F.unix_micros(t["at"].cast("timestamp")) - F.unix_micros(s["at"].cast("timestamp")) > seconds * 1_000_000)
    more = lambda s, t: F.concat(s["kept"], F.array(t["tie"]))
    step = lambda s, t: F.when(F.size(s["kept"]) < LIST, F.struct(t["at"].alias("at"), more(s, t).alias("kept"), s["full"].alias("full"))).otherwise(F.struct(t["at"].alias("at"), F.array(t["tie"]).alias("kept"), F.concat(s["full"], F.array(s["kept"])).alias("full")))
    kept = F.aggregate("ticks", none, lambda s, t: F.when(late(s, t), step(s, t)).otherwise(s), lambda s: F.flatten(F.concat(s["full"], F.array(s["kept"]))))
    return order.select(key, F.explode(kept).alias(tie))


def preserved(new: DataFrame, old: DataFrame, keys: list[str], kept: list[str], flag: str) -> DataFrame:
    """New rows with the old values of ``kept`` where there are any, and a flag that once set stays set."""
    before = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*kept, flag)])
    both = new.join(before, keys, "left")
    rest = [c for c in new.columns if c not in (*kept, flag)]
    return both.select(*rest, *[F.coalesce(f"_{c}", c).alias(c) for c in kept], (F.coalesce(f"_{flag}", F.lit(False)) | F.coalesce(flag, F.lit(False))).alias(flag))


def from_caches(rows: DataFrame, venue: DataFrame, national: DataFrame, venue_fields: list[str], national_fields: list[str]) -> DataFrame:
    """Rows completed from a venue's and a national snapshot of the racer, if both have all their fields; else as ``pending``."""
    v = venue.select("race_date", "venue_code", "registration_number", F.struct(*venue_fields).alias("_v"))
    n = first_by(national, ["registration_number"], F.col("as_of").desc(), F.col("snapshot_id").desc()).select("registration_number", F.struct(*national_fields).alias("_n"))
    both = rows.join(v, ["race_date", "venue_code", "registration_number"], "left").join(n, "registration_number", "left")
    whole = reduce(lambda a, b: a & b, [F.col(s)[c].isNotNull() for s, cs in (("_v", venue_fields), ("_n", national_fields)) for c in cs])
    done = F.coalesce(whole, F.lit(False))
    return both.select(*rows.columns, *[F.when(done, F.col(s)[c]).alias(c) for s, cs in (("_v", venue_fields), ("_n", national_fields)) for c in cs], F.when(done, "cache").otherwise("pending").alias("source"))


def frozen(stored: DataFrame, pre: DataFrame, final: DataFrame, key: str, features: list[str], outcome: list[str]) -> DataFrame:
    """Learning samples: features of the analysis before the race, written once and never again, and the final outcome once it is there.

    A stored sample keeps its features; a final analysis without an earlier sample gives none.
    """
    p = pre.select(key, F.struct(*features).alias("_pre"))
    s = stored.select(key, F.struct(*features).alias("_old"), F.struct(*outcome).alias("_done"))
    f = final.select(key, F.struct(*outcome).alias("_final"))
    both = s.join(p, key, "full").join(f, key, "left")
    return both.select(key, *[F.when(F.col("_old").isNotNull(), F.col("_old")[c]).otherwise(F.col("_pre")[c]).alias(c) for c in features], *[F.coalesce(F.col("_done")[c], F.col("_final")[c]).alias(c) for c in outcome])


def ledger(batches: DataFrame, stored: DataFrame) -> DataFrame:
    """Each incoming batch with what to do: ``skip`` if the same bytes were imported by the same parser, ``retry`` after a failure, else ``import``.

    Of batches with equal bytes in one call the first is taken and the others are skipped.
    """
    done = stored.groupBy("checksum", "parser_version").agg(F.max(F.when(F.col("status") == "COMPLETED", 2).when(F.col("status") == "FAILED", 1).otherwise(0)).alias("_state"))
    first = F.row_number().over(Window.partitionBy("checksum", "parser_version").orderBy("batch_id")) == 1
    both = batches.withColumn("_first", first).join(done, ["checksum", "parser_version"], "left")
    return both.select("batch_id", "checksum", F.when(~F.col("_first") | (F.col("_state") == 2), "skip").when(F.col("_state") == 1, "retry").otherwise("import").alias("action"))


def gate(results: DataFrame, programme: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``entry_key, reason``: why a result file may not be imported; an empty table lets it pass."""
    a = results.select(key, F.struct(*columns).alias("_r"))
    b = programme.select(key, F.struct(*columns).alias("_p"))
    reason = F.when(F.col("_p").isNull(), "not_in_programme").when(F.col("_r").isNull(), "missing_result").when(~F.col("_r").eqNullSafe(F.col("_p")), "mismatch")
    return a.join(b, key, "full").select(key, reason.alias("reason")).where("reason is not null")


def checked(rules: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """``rule, unit, n`` for rules ``name -> (rows, unit column, condition)``: rows at fault per unit, one aggregation per table."""
    parts = [df.where(test).groupBy(F.col(unit).cast("string").alias("unit")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "unit", "n") for name, (df, unit, test) in rules.items()]
    return reduce(DataFrame.unionByName, parts)


# Fields of a race that a missing value never overwrites.
PROTECTED = ("exhibition_ready", "beforeinfo_fetched_at", "weather", "wind_dir", "wind_speed", "wave_height", "air_temperature", "water_temperature", "result_trifecta", "is_uichi", "payout_trifecta", "scratched_boats", "entries_fetched_at", "odds_fetched_at")
#: Columns that place an entry and are set by its race.
PLACED = ("race_id", "race_date", "venue_code", "race_number", "boat_number")


def protected_upsert(stored: DataFrame, incoming: DataFrame, key: list[str], protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """Stored rows with the incoming ones of their key laid over them; missing values never overwrite the ``protected`` columns.

    Rows that the incoming side repeats are merged first, column by column, the fullest
    row first (and then the one with the greater values), so a repeated key gives one
    row; a second run changes nothing.
    """
    rest = [c for c in stored.columns if c not in key]
    full = incoming.select(*key, *rest).withColumns({"_filled": filled(rest), "_row": F.to_json(F.struct(*rest))})
    new = merged(full, key, rest, "_filled", "_row").withColumn("_new", F.lit(True))
    both = stored.select(*key, *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_old")).join(new, key, "full")

    def one(c):
        laid = F.coalesce(c, f"_{c}") if c in protected else F.col(c)
        return F.when(F.col("_new").isNull(), F.col(f"_{c}")).when(F.col("_old").isNull(), F.col(c)).otherwise(laid).alias(c)

    return both.select(*key, *map(one, rest))


def consolidated(races: DataFrame, entries: DataFrame, children: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """``races``, ``entries`` and the child tables with one race per logical key, from the map of :func:`canonical`.

    A race gets of each column the value of the most complete race that has it; an
    entry, per boat 1 to 6 of the common race, that of the fullest entry that has it, under the
    race's key.  Child rows move to the common race.  Consolidated tables stay as they are.
    """
    known = ids.select("race_id", "canonical_id", "completeness")
    moved = lambda table: table.join(known.select("race_id", "canonical_id"), "race_id").drop("race_id").withColumnRenamed("canonical_id", "race_id")
    ranked = races.join(known, "race_id").withColumn("_turn", -F.col("race_id"))
    whole = merged(ranked, ["canonical_id"], [c for c in races.columns if c != "race_id"], "completeness", "_turn").withColumnRenamed("canonical_id", "race_id").select(*races.columns)
    own = [c for c in entries.columns if c not in PLACED]
    scored = entries.where(F.col("boat_number").between(1, 6)).withColumns({"_filled": filled(own), "_turn": -F.col("race_id")})
    boats = merged(moved(scored.select("race_id", "boat_number", "_filled", "_turn", *own)), ["race_id", "boat_number"], own, "_filled", "_turn")
    placed = boats.join(whole.select("race_id", *[c for c in PLACED if c in races.columns and c != "race_id"]), "race_id").select(*[c for c in entries.columns])
    return {"races": whole, "entries": placed, **{n: moved(t).select(*t.columns) for n, t in children.items()}}


def inferred_scratches(odds: DataFrame) -> DataFrame:
    """``race_id, scratched, n_odds, consistent`` from ``race_id, combo, odds``: boats that no odds above 1 name, comma-joined."""
    valid = odds.withColumn("boats", F.when(F.col("odds") > 1, F.split("combo", "-").cast("array<int>")))
    boat = lambda n: F.max(F.coalesce(F.array_contains("boats", n), F.lit(False)).cast("int")).alias(f"b{n}")
    per = valid.groupBy("race_id").agg(F.count_if(F.col("odds") > 1).alias("n_odds"), *[boat(n) for n in range(1, 7)])
    lost = F.array_compact(F.array(*[F.when(F.col(f"b{n}") == 0, F.lit(str(n))) for n in range(1, 7)]))
    active = 6 - F.size(lost)
    return per.where("n_odds > 0").select("race_id", F.nullif(F.array_join(lost, ","), F.lit("")).alias("scratched"), "n_odds", ((active < 6) & (active * (active - 1) * (active - 2) == F.col("n_odds"))).alias("consistent"))


def rebuilt(table: DataFrame, root: str) -> DataFrame:
    """A full rebuild: the table written whole under a new name below ``root`` and read from there; readers of the old one go on until it is dropped."""
    import uuid

    spark, path = table.sparkSession, f"{root.rstrip('/')}/rebuilt-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
