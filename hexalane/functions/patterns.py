"""Bet patterns over the first three places, odds and judgments."""

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

# The boats that each pattern allows on the first, second and third place, in order of priority.
PATTERNS = {
    "MAIN": ((1,), (2, 3, 4), (5, 6)),
    "URA": ((1,), (5, 6), (2, 3, 4)),
    "NEW_MAIN": ((1,), (3, 4, 5, 6), (2,)),
    "NEW_URA": ((2,), (1,), (3, 4, 5, 6)),
}
# Thresholds of expected value in percent, of samples, and the reliability classes.
BUY, WATCH, LEAST_SAMPLE = 110.0, 100.0, 100
RELIABILITY = (("A", 500), ("B", 250), ("C", 100))


def combos(pattern: str) -> list[str]:
    """The trifectas ``a-b-c`` of a pattern."""
    return ["-".join(map(str, places)) for places in product(*PATTERNS[pattern])]


def hit(pattern: str, trifecta) -> Column:
    """Whether a trifecta belongs to a pattern; a missing one does not."""
    return F.coalesce(col(trifecta).isin(combos(pattern)), F.lit(False))


def hit_places(pattern: str, r1="result_1", r2="result_2", r3="result_3") -> Column:
    tests = [col(r).isin(*boats) for r, boats in zip((r1, r2, r3), PATTERNS[pattern])]
    return F.coalesce(tests[0] & tests[1] & tests[2], F.lit(False))


def trifecta(r1="result_1", r2="result_2", r3="result_3") -> Column:
    return F.concat_ws("-", *[col(r).cast("string") for r in (r1, r2, r3)])


def pattern_of(value) -> Column:
    """The first pattern, by priority, that a trifecta belongs to, or ``OTHER``."""
    out = F
    for name in PATTERNS:
        out = out.when(hit(name, value), name)
    return out.otherwise("OTHER")


def main_combo(value) -> Column:
    """The trifecta itself if it belongs to the main pattern, else null."""
    return F.when(hit("MAIN", value), col(value))


def synthetic_odds(odds) -> Column:
    """The odds of a bet spread over several combinations: 1 / sum(1 / odds), over odds above 1; 0 if there are none."""
    valid = F.filter(col(odds), lambda x: x > 1)
    inverse = F.aggregate(valid, F.lit(0.0), lambda a, x: a + 1.0 / x)
    return F.when(inverse > 0, 1.0 / F.when(inverse > 0, inverse)).otherwise(F.lit(0.0))


def expected_value(appearance, odds) -> Column:
    """Percent of the stake that comes back on average."""
    return F.coalesce(col(appearance), F.lit(0.0)) * F.coalesce(col(odds), F.lit(0.0)) * 100


def judge(expected, sample=None, buy=BUY, watch=WATCH, least=LEAST_SAMPLE) -> Column:
    """BUY, WATCH, SKIP, or PENDING without an expected value; a small sample never gives more than WATCH."""
    ev = col(expected)
    best = F.lit("BUY") if sample is None else F.when(col(sample) < least, "WATCH").otherwise("BUY")
    return F.when(ev.isNull(), "PENDING").when(ev >= buy, best).when(ev >= watch, "WATCH").otherwise("SKIP")


def reliability(sample) -> Column:
    out = F
    for name, least in RELIABILITY:
        out = out.when(col(sample) >= least, name)
    return out.otherwise("D")
