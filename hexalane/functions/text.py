"""Text, key and date functions: width folding, lenient numbers, keys, timings, race names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

FULL_WIDTH = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
# HTML entities that pages of the source use.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))
# 16 wind directions by code 1 to 16; code 17 or no wind is calm.
DIRECTIONS = ("北", "北北東", "北東", "東北東", "東", "東南東", "南東", "南南東", "南", "南南西", "南西", "西南西", "西", "西北西", "北西", "北北西")


def half_width(x) -> Column:
    """Full-width ASCII and the ideographic space as plain ASCII; other characters stay."""
    return F.translate(col(x), FULL_WIDTH, HALF_WIDTH)


def let(x: Column, f) -> Column:
    """``f`` of ``x``, which is named once: expressions that use a field many times stay small."""
    return F.transform(F.array(x), f)[0]


def strip_tags(x) -> Column:
    """Text of an HTML fragment: tags out, five entities decoded, runs of white space one space."""

    def decoded(text):
        out = text
        for name, plain in ENTITIES:
            out = F.replace(out, F.lit(name), F.lit(plain))
        return F.when(text.contains("&"), out).otherwise(text)

    spaced = lambda text: F.trim(F.regexp_replace(let(F.regexp_replace(text, "<[^>]*>", " "), decoded), r"(?U)\s+", " "))  # noqa: E731  # wide and fixed spaces, too
    # most cells are a bare word
    return let(col(x), lambda text: F.when(text.rlike(r"(?U)[<&\s]"), spaced(text)).otherwise(text))


def _first(x: Column, pattern: str) -> Column:
    """The first group of a pattern's match; null for none, which costs less than to read a number in an empty text."""
    return F.get(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.lit(0))


def leading_int(x) -> Column:
    """The integer at the start of a text (``12abc`` is 12); no number gives null."""
    return _first(F.replace(col(x), F.lit(","), F.lit("")), r"^\s*([+-]?\d+)").try_cast("long")


def leading_float(x) -> Column:
    return _first(F.replace(col(x), F.lit(","), F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))").try_cast("double")


def blank_to_null(x) -> Column:
    """Null for an empty field or one that holds a dash only."""
    x = F.trim(col(x))
    return F.when(~x.isin("", "-", "—"), x)


def int_or_null(x) -> Column:
    return leading_int(blank_to_null(x))


def float_or_null(x) -> Column:
    return leading_float(blank_to_null(x))


def scaled(x, by: float) -> Column:
    """A fixed-width number with implied decimals, as a double; blanks give null."""
    return blank_to_null(x).try_cast("double") / by


def combination(x) -> Column:
    """A bet's combination without white space of any width."""
    return F.regexp_replace(col(x), r"[\s\u3000]", "")


def two(x) -> Column:
    return F.lpad(col(x).cast("string"), 2, "0")


def race_key(date="race_date", venue="venue_code", number="race_number") -> Column:
    """``date_VV_RR``: the logical key on which everything joins."""
    return F.concat_ws("_", F.date_format(col(date), "yyyy-MM-dd"), two(venue), two(number))


def entry_key(date="race_date", venue="venue_code", number="race_number", boat="boat_number") -> Column:
    return F.concat_ws("_", race_key(date, venue, number), col(boat).cast("string"))


def date_of_key(key) -> Column:
    """The date at the start of a key; null if there is none."""
    head = F.substring(col(key), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def date_of_file(name, letter: str) -> Column:
    """The date in a file name like ``B260906.TXT``; null for months or days that do not exist."""
    digits = F.regexp_extract(col(name), rf"(?i){letter}(\d{{6}})", 1)
    stamp = F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 5, 2))
    return F.when(digits != "", stamp.try_cast("date"))


def start_timing(x) -> Column:
    """Seconds of a start timing from 0 up to 5; false starts, late starts and codes give null."""
    seconds = leading_float(F.trim(col(x)))
    return F.when((seconds >= 0) & (seconds < 5), seconds)


def is_false_start(x) -> Column:
    return F.coalesce(F.upper(col(x)).contains("F"), F.lit(False))


def is_late_start(x) -> Column:
    return F.coalesce(F.upper(col(x)).contains("L"), F.lit(False))


def exhibition_timing(x) -> Column:
    """Signed exhibition timing: ``F.05`` is -0.05, ``L.05`` and ``.05`` are 0.05."""
    raw = F.trim(col(x))
    value = leading_float(F.regexp_replace(raw, "^[FLfl]", ""))
    return F.when(F.upper(raw).startswith("F"), -value).otherwise(value)


def race_seconds(x) -> Column:
    """Seconds of a race time ``m'ss"t`` or ``m.ss.t``."""
    time = r"""^\s*(\d+)['.](\d{1,2})["'.](\d+)"""

    def seconds(parts):
        part = lambda i: parts[i].cast("double")
        return part(0) * 60 + part(1) + part(2) / F.pow(F.lit(10.0), F.length(parts[2]))

    return let(col(x), lambda t: F.when(t.rlike(time), let(F.split(F.regexp_replace(t, rf"(?s){time}.*$", "$1,$2,$3"), ","), seconds)))


def wind_group(speed) -> Column:
    """Bucket of a wind speed in m/s."""
    w = col(speed)
    return F.when(w.isNull(), "unknown").when(w <= 1, "0-1").when(w <= 3, "2-3").when(w <= 5, "4-5").otherwise("6+")


def wind_direction(code, speed) -> Column:
    names = F.array(*map(F.lit, DIRECTIONS))
    return F.when((col(speed) == 0) | (col(code) == 17), "無風").when(col(code).between(1, 16), F.element_at(names, F.when(col(code).between(1, 16), col(code)).otherwise(1).cast("int")))


def score_bucket(x) -> Column:
    """Bucket of a score; a missing one counts as 0."""
    v = F.coalesce(col(x).cast("double"), F.lit(0.0))
    return F.when(v < 40, "0-39").when(v < 50, "40-49").when(v < 60, "50-59").when(v < 70, "60-69").when(v < 80, "70-79").otherwise("80-100")


def time_slot(deadline, zone: str = "Asia/Tokyo") -> Column:
    """Morning, day or night by the local hour of the deadline."""
    hour = F.hour(F.from_utc_timestamp(col(deadline), zone))
    return F.when(hour < 10, "morning").when(hour < 14, "day").when(hour.isNotNull(), "night")


def race_phase(name) -> Column:
    """Kind of race by words in its name, first match wins."""
    n = F.coalesce(col(name), F.lit(""))
    return F.when(n.contains("準優"), "SEMIFINAL").when(n.contains("優勝"), "FINAL").when(n.contains("特選") | n.contains("選抜"), "SPECIAL").when(n.contains("ドリーム"), "DREAM").when(n.contains("予選"), "QUALIFYING").when(n.contains("一般"), "GENERAL").otherwise("OTHER")


def grade_of(text) -> Column:
    t = F.upper(half_width(F.coalesce(col(text), F.lit(""))))
    return F.when(t.contains("SG"), "SG").when(t.rlike("G1|GⅠ|PG1"), "G1").when(t.rlike("G2|GⅡ"), "G2").when(t.rlike("G3|GⅢ"), "G3").otherwise("GENERAL")


def period_starts(day) -> dict[str, Column]:
    """Starts of the evaluation periods, clamped to the last day of a short month."""
    return {"6m": F.add_months(col(day), -6), "1y": F.add_months(col(day), -12), "3y": F.add_months(col(day), -36)}


def minutes_until(deadline, now) -> Column:
    return (F.unix_timestamp(col(deadline)) - F.unix_timestamp(col(now))) / 60.0


def nearest_year(month, day, reference) -> Column:
    """The date of a month and day whose year lies nearest to a reference date."""
    ref = col(reference)
    dates = F.array(*[F.try_make_timestamp(F.year(ref) + k, col(month), col(day), F.lit(0), F.lit(0), F.lit(0)).cast("date") for k in (-1, 0, 1)])
    near = F.transform(dates, lambda d, k: F.struct(F.abs(F.datediff(d, ref)).alias("gap"), k.alias("k"), d.alias("date")))
    return F.array_min(F.filter(near, lambda s: s["date"].isNotNull()))["date"]
