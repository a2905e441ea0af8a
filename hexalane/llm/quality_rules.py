"""Robust multivariate outlier rules per language and source.

Each document gets whole-text counts and a short vector of transformed
statistics.  For every (language, source) cell the minimum-covariance-
determinant centre and scatter are estimated over all its rows, and rows whose
squared Mahalanobis distance passes a chi-square cutoff are rejected.

The estimator is the deterministic variant of the concentration algorithm
(Hubert, Rousseeuw and Verdonck, 2012): two robust starting points per cell, then
concentration steps that keep the nearest ``H_SHARE`` of the rows and re-estimate
until nothing moves, and one reweighting step.  Every cell is estimated from its
own rows, however few; its estimate is then drawn towards that of its language as
if ``PRIOR`` rows of it were the cell's own (regularised MCD), so a small cell is
ruled by its language and a large one by itself.  A step is one hash aggregation of
moment sums over bins of distance, which combines on the map side, so a cell may
hold any share of the corpus.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import Powers, Words, blocks, text_buffers, tidy, windows
from .work import drop_path, materialise

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LOWERCASE = np.zeros(256, bool)
LOWERCASE[0x61:0x7B] = True
SPACES = " \t\n\v\f\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VECTOR = ["v_length", "v_symbols", "v_lines", "v_repeats", "v_capitals"]
#: Least spread in any direction of the statistics: below it, differences between documents carry no meaning.
FLOOR = 0.12
#: Share of a cell's rows that the concentration steps keep.
H_SHARE = 0.75
# Fixed values for 5 degrees of freedom: factors that make the scatter of the nearest 75 % and of the rows within the
# 97.5 % quantile consistent for normal data, that quantile, and the quantile of order 1 - 1e-6 that is the cut-off.
H_FACTOR, REWEIGHT_FACTOR, REWEIGHT_CUT, CUTOFF = 1.41207, 1.05553, 12.8325, 35.888
#: Rows that the estimate of the next wider level counts for in that of a cell.
PRIOR = 25.0
#: Concentration steps go on until no log-determinant moves by more than this; the number is a guard only.
SETTLED, MOST_STEPS = 0.01, 30


def _counts(data, offsets, powers, texts):
    """Whole-text counts of a block; ``texts`` are the same texts as Python strings (for lines)."""
    words = Words(data, offsets, powers)
    rows = len(offsets) - 1
    h = words.hashes()
    tri = windows(h, 3)
    first = words.first
    out = np.zeros((rows, 5), np.int64)
    out[:, 0] = np.diff(first)

    def per_row(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    out[:, 1] = per_row(words.inside & ((data & 0xC0) != 0x80)) if len(data) else 0
    out[:, 2] = per_row(SYMBOL[data]) if len(data) else 0
    for i in range(rows):
        a, b = first[i], first[i + 1]
        if b - a >= 3:
            t = tri[a : b - 2]
            order = np.argsort(t, kind="stable")
            same = t[order[1:]] == t[order[:-1]]
            twice = np.zeros(len(t), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(b - a, bool)
            covered[:-2] |= twice
            covered[1:-1] |= twice
            covered[2:] |= twice
            out[i, 4] = covered.sum()
        text = texts[i]
        if text and "\n" in text:
            seen, repeated = set(), 0
            for line in text.split("\n"):
                if line.strip(SPACES):
                    if line in seen:
                        repeated += 1
                    else:
                        seen.add(line)
            out[i, 3] = repeated
    capitals = per_row(UPPER[data]) if len(data) else np.zeros(rows, np.int64)
    letters = capitals + (per_row(LOWERCASE[data]) if len(data) else 0)
    lines = np.array([(t or "").count("\n") + 1 for t in texts])
    return out, capitals, letters, lines


def _vector(counts, capitals, letters, lines):
    """Variance-stabilised statistics; all are shares or means, so a long text is no outlier for its length."""
    n = np.maximum(counts[:, 0], 1)
    return np.column_stack(
        [
            4 * np.log((counts[:, 1] + 4.0) / (n + 1.0)),
            np.sqrt((counts[:, 2] + 0.375) / (n + 0.75)) * 2,
            np.arcsin(np.sqrt(counts[:, 3] / (lines + 3.0))),
            np.arcsin(np.sqrt(np.minimum(counts[:, 4] / (n + 30.0), 1.0))),
            np.arcsin(np.sqrt((capitals + 0.375) / (letters + 0.75))),
        ]
    )


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple = ("doc_id", "lang", "source")) -> DataFrame:
    """Columns ``keep`` with the whole-text counts and the statistic vector of every row."""
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [f"{c} long" for c in COUNTS] + [f"{v} double" for v in VECTOR])
    names = list(keep) + COUNTS + VECTOR

    def run(batches):
        powers = Powers()
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            data, offsets = text_buffers(column)
            for a, b in blocks(offsets):
                counts, capitals, letters, lines = _counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], powers, column.slice(a, b - a).to_pylist())
                vector = _vector(counts, capitals, letters, lines)
                arrays = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                arrays += [pa.array(counts[:, i]) for i in range(5)] + [pa.array(vector[:, i]) for i in range(5)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return kept.mapInArrow(tidy(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _key(stats: DataFrame) -> DataFrame:
    return stats.withColumn("__l", F.coalesce(F.col("lang").cast("string"), F.lit("\0"))).withColumn("__s", F.coalesce(F.col("source").cast("string"), F.lit("\0")))


P = len(VECTOR)
UPPER_TRIANGLE = [(i, j) for i in range(P) for j in range(i, P)]
PARAMS = "cell string, start int, n double, centre array<double>, scatter array<double>, inverse array<double>, logdet double, moved double"


def _levels() -> Column:
    """The cells that a row is counted in: its language and source, its language, and all rows."""
    return F.array(F.concat_ws("\1", F.lit("c"), "__l", "__s"), F.concat_ws("\1", F.lit("l"), "__l"), F.lit("all"))


def floored(scatter: np.ndarray) -> np.ndarray:
    """The scatter with no direction's spread below ``FLOOR``; spreads above it stay as they are."""
    values, axes = np.linalg.eigh(scatter)
    return (axes * np.maximum(values, FLOOR * FLOOR)[..., None, :]) @ np.swapaxes(axes, -1, -2)


def _params(cells: pd.DataFrame, centre: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    """Rows of ``PARAMS`` for stacked centres and scatters; ``cells`` has ``cell``, ``start``, ``n`` and the ``logdet`` before."""
    scatter = floored(scatter)
    logdet = np.linalg.slogdet(scatter)[1]
    flat = lambda x: list(x.reshape(len(cells), -1))
    return pd.DataFrame({
        "cell": cells["cell"], "start": cells["start"], "n": cells["n"], "centre": flat(centre), "scatter": flat(scatter),
        "inverse": flat(np.linalg.inv(scatter)), "logdet": logdet, "moved": np.abs(logdet - cells["logdet"].fillna(np.inf)),
    })


def _square(pdf: pd.DataFrame) -> np.ndarray:
    """The symmetric matrices whose upper triangles are in columns ``q<i>_<j>``."""
    out = np.zeros((len(pdf), P, P))
    for i, j in UPPER_TRIANGLE:
        out[:, i, j] = out[:, j, i] = pdf[f"q{i}_{j}"]
    return out


def _estimates(bins: DataFrame, share: float, factor: float) -> DataFrame:
    """``PARAMS`` of every cell and start from the moment sums of its bins: of the nearest ``share`` of its rows.

    Whole bins count as far as they go, and of the next one the part that is
    missing; a cell has a few hundred bins at most.
    """
    own = Window.partitionBy("cell", "start")
    below = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.ceil(F.sum("n").over(own) * share) - below) / F.col("n")))
    sums = [f"s{i}" for i in range(P)] + [f"q{i}_{j}" for i, j in UPPER_TRIANGLE]
    summed = bins.withColumn("w", weight).groupBy("cell", "start").agg(F.first("logdet").alias("logdet"), F.sum("n").alias("n"), F.sum(F.col("w") * F.col("n")).alias("near"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in sums])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near = pdf["near"].to_numpy()
        centre = pdf[[f"s{i}" for i in range(P)]].to_numpy() / near[:, None]
        scatter = _square(pdf) / near[:, None, None] - centre[:, :, None] * centre[:, None, :]
        return _params(pdf, centre, scatter * factor)

    return summed.mapInPandas(_in_pandas(run), PARAMS)


def _in_pandas(f):
    def run(frames):
        for x in frames:
            yield f(x)

    return run


def _placed(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Every row with the estimates of its cells and its squared distances to them."""
    named = rows.select(F.explode(_levels()).alias("cell"), *VECTOR)
    return named.join(_bounded(params), "cell").withColumn("d2", _distance())


def _bins(placed: DataFrame) -> DataFrame:
    """Moment sums per cell, start and bin of distance.

    One hash aggregation that combines on the map side; the bins, an eighth of an
    octave wide, also spread a cell of a large share of all rows over tasks.
    """
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(VECTOR)]
    squares = [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"q{i}_{j}") for i, j in UPPER_TRIANGLE]
    return placed.groupBy("cell", "start", "logdet", F.floor(F.log2(F.col("d2") + 2.0**-20) * 8).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"), *sums, *squares)


def _distance() -> Column:
    """Squared Mahalanobis distance to the joined ``centre`` and ``inverse``."""
    d = [F.col(v) - F.col("centre")[i] for i, v in enumerate(VECTOR)]
    terms = [(1 if i == j else 2) * d[i] * d[j] * F.col("inverse")[i * P + j] for i, j in UPPER_TRIANGLE]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def _starts(rows: DataFrame) -> DataFrame:
    """Two deterministic starting points per cell: median and MAD, and the same with the correlations of tanh scores."""
    named = rows.select(F.explode(_levels()).alias("cell"), *VECTOR)
    centre = materialise(named.groupBy("cell").agg(*[F.percentile_approx(v, 0.5, 1000).alias(f"m{i}") for i, v in enumerate(VECTOR)]), "mcd")
    near = named.join(_bounded(centre), "cell")
    spread = near.groupBy("cell", *[f"m{i}" for i in range(P)]).agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.abs(F.col(v) - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i, v in enumerate(VECTOR)])
    spread = materialise(spread, "mcd")
    z = [F.tanh((F.col(v) - F.col(f"m{i}")) / F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOOR))) for i, v in enumerate(VECTOR)]
    known = ["cell", "n", *[f"{k}{i}" for k in "md" for i in range(P)]]
    agg = named.join(_bounded(spread), "cell").groupBy(*known).agg(*[F.sum(z[i] * z[j]).alias(f"q{i}_{j}") for i, j in UPPER_TRIANGLE])

    def start(x: pd.DataFrame) -> pd.DataFrame:
        centre = x[[f"m{i}" for i in range(P)]].to_numpy(float)
        spread = np.maximum(1.4826 * x[[f"d{i}" for i in range(P)]].to_numpy(float), FLOOR)
        joint = _square(x)
        scale = np.sqrt(np.maximum(np.diagonal(joint, axis1=1, axis2=2), 1e-12))
        corr = joint / (scale[:, :, None] * scale[:, None, :])
        corr[:, range(P), range(P)] = 1.0
        plain = np.broadcast_to(np.eye(P), corr.shape)
        area = spread[:, :, None] * spread[:, None, :]
        return pd.concat([_params(x.assign(start=k, logdet=np.nan), centre, c * area) for k, c in enumerate((plain, corr))])

    return agg.mapInPandas(_in_pandas(start), PARAMS)


def mcd(rows: DataFrame, most_steps: int = MOST_STEPS) -> DataFrame:
    """``cell`` and its estimate from ``rows`` (``__l, __s`` and the vector), for every cell of every level.

    Concentration steps run until no cell's log-determinant moves; after two of
    them only the start of smaller determinant goes on.  One last step estimates
    from all rows within the 97.5 % quantile of the distances (reweighting).
    """
    spark = rows.sparkSession
    params = materialise(_starts(rows), "mcd")
    for step in range(most_steps):
        if step == 2:
            best = params.groupBy("cell").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
            params = materialise(params.join(best, ["cell", "start"]).select(params.columns), "mcd")
        after = materialise(_estimates(_bins(_placed(rows, params)), H_SHARE, H_FACTOR), "mcd")
        drop_path(spark, params)
        params = after
        if step > 2 and (params.agg(F.max("moved")).first()[0] or 0.0) < SETTLED:
            break
    inner = _bins(_placed(rows, params).where(F.col("d2") <= REWEIGHT_CUT))
    return materialise(_estimates(inner, 1.0, REWEIGHT_FACTOR).select("cell", "n", "centre", "scatter"), "mcd")


#: Rows of a table of cells that may be broadcast: 20,000 estimates of some 65 doubles are 10 MB.
BROADCAST_CELLS = 20_000


def _bounded(cells: DataFrame) -> DataFrame:
    """A broadcast hint behind a count; a table of more cells is joined by a shuffle."""
    return F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells


def _shrunk(cells: DataFrame) -> DataFrame:
    """Estimates per language and source, drawn to their language's as if ``PRIOR`` rows of it were theirs, and that one to all rows'."""
    fields = ["n", "centre", "scatter"]
    level = lambda name: [F.col(c).alias(f"{name}_{c}") for c in fields]
    parts = F.split("cell", "\1", -1)
    own = cells.where(F.col("cell").startswith("c\1")).select(parts[1].alias("__l"), parts[2].alias("__s"), *level("own"))
    lang = cells.where(F.col("cell").startswith("l\1")).select(parts[1].alias("__l"), *level("lang"))
    every = cells.where("cell = 'all'").select("cell", *level("all"))
    joined = own.withColumn("cell", F.lit("all")).join(lang, "__l").join(F.broadcast(every), "cell").drop("cell")  # ``every`` is one row

    def run(x: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in x.itertuples(index=False):
            x_, own_, lang_ = row[:2], row[2:5], row[5:8]
            at, spread = np.array(row[9]), np.array(row[10])
            for n, centre, scatter in (lang_, own_):
                at, spread = ((n * np.array(v) + PRIOR * u) / (n + PRIOR) for v, u in ((centre, at), (scatter, spread)))
            out.append((*x_, at.tolist(), np.linalg.inv(floored(spread.reshape(P, P))).ravel().tolist()))
        return pd.DataFrame(out, columns=["__l", "__s", "centre", "inverse"])

    return joined.mapInPandas(_in_pandas(run), "__l string, __s string, centre array<double>, inverse array<double>")


def model(stats: DataFrame) -> DataFrame:
    """``__l, __s, centre, inverse`` for every language and source among the rows of ``stats`` that pass the base rule."""
    rows = materialise(_key(stats.where(~base_failed()).select("lang", "source", *VECTOR)).select("__l", "__s", *VECTOR), "vectors")
    found = materialise(_shrunk(mcd(rows)), "model")
    drop_path(stats.sparkSession, rows)
    return found


def judge(stats: DataFrame, cells: DataFrame, keep: tuple, cutoff: float = CUTOFF) -> DataFrame:
    """Adds ``base_failed``, ``distance2`` and ``kept`` to rows of :func:`statistics`."""
    failed = base_failed()
    distance = F.when(~failed, _distance())
    rows = _key(stats).join(_bounded(cells), ["__l", "__s"], "left")
    return rows.withColumn("distance2", distance).select(*keep, *COUNTS, failed.alias("base_failed"), "distance2", F.coalesce(F.col("distance2") <= cutoff, F.lit(False)).alias("kept"))


def quality_rules(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", cutoff: float = CUTOFF) -> DataFrame:
    """The id, the counts, ``base_failed``, ``distance2`` and ``kept`` for every row.

    A null text counts as an empty one: all counts 0, so the base rule fails.
    Null languages or sources form cells of their own.  Rows that fail the base
    rule take no part in the estimates and have a null distance.  Repeated rows
    count as often as they occur; equal rows get equal verdicts.  An empty table
    gives no rows; other columns are ignored.
    """
    keep = (id_col, "lang", "source")
    stats = materialise(statistics(docs, text_col, keep), "stats")
    return judge(stats, model(stats), keep, cutoff)


def keep_good(docs: DataFrame, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; texts are never shuffled or written.

    The first pass over the texts leaves only statistics for the estimates; the
    second computes them again next to the texts and applies the verdict.
    """
    stats = materialise(statistics(docs, text_col, ("lang", "source")), "stats")
    cells = model(stats)
    drop_path(docs.sparkSession, stats)
    names = tuple(docs.columns)
    if not {*names} & {*COUNTS, *VECTOR, "__l", "__s", "__text", "centre", "inverse", "distance2", "base_failed", "kept"}:
        return judge(statistics(docs, text_col, names), cells, names, cutoff).where("kept").select(*names)
    # clashing names travel inside a struct
    packed = docs.select(F.struct(*names).alias("__row"), "lang", "source", F.col(text_col).alias("__t"))
    return judge(statistics(packed, "__t", ("__row", "lang", "source")), cells, ("__row",), cutoff).where("kept").select("__row.*")
