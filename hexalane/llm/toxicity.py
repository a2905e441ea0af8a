"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text are the distinct hashes, into ``2 ** BITS`` places, of its
words, word beginnings, neighbouring word pairs (2-grams) and skip-grams (a word
with the next but one).  FTRL-proximal (McMahan et al., 2013) learns them with
per-coordinate rates and an L1 term that leaves most weights at exactly zero, so
the model that scoring broadcasts is a short table: at most ``2 ** BITS`` places,
in practice a few thousand.

Learning uses at most ``max_rows`` labelled rows, those of the smallest id hash,
and runs in one task; scoring is a plain map over all rows.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import BASE, LOWER, NON_WORD, Powers, Words, blocks, mix, text_buffers, tidy

BITS = 20
BEGINNING = 5
#: Labelled rows that learning may see.
MAX_ROWS = 8_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 0.2, 1.0, 10.0, 0.1
#: Gradient weight of label 1, the rarer one.
POSITIVE = 2.0
#: Features in fewer learning rows, or in a larger share of them, get no weight.
LEAST_ROWS, LARGEST_SHARE = 2, 0.2


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of a block, and the row of each."""
    h = words.hashes()
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    kinds = [(h, row)]
    long = np.flatnonzero(words.end - words.start > BEGINNING)
    kinds.append((words.span_hash(words.start[long], words.start[long] + BEGINNING) ^ np.uint64(0x5EED), row[long]))
    for gap, salt in ((1, 0xB1), (2, 0x5C)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            kinds.append(((h[:-gap] * BASE + h[gap:] + np.uint64(salt))[same], row[gap:][same]))
    places = np.concatenate([mix(k) & np.uint64((1 << BITS) - 1) for k, _ in kinds]).astype(np.int32)
    return places, np.concatenate([r for _, r in kinds])


def _word_blocks(column, powers):
    data, offsets = text_buffers(column)
    for a, b in blocks(offsets):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], powers, separators=NON_WORD, fold=LOWER)


def feature_rows(rows: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """``label`` and the sorted distinct feature places of each labelled row."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            for a, b, words in _word_blocks(batch.column(0), powers):
                places, row = _features(words)
                key = np.unique(row.astype(np.int64) << BITS | places)
                counts = np.bincount(key >> BITS, minlength=b - a)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), lists], names=["turn", "label", "places"])

    return rows.select(F.col(text_col).cast("string").alias("text"), "turn", F.col(label_col).cast("double").alias("label")).mapInArrow(tidy(run), "turn long, label double, places array<int>")


def ftrl(examples, epochs: int = EPOCHS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
    """Weights (bias last) after ``epochs`` passes of FTRL-proximal over ``(label, places)``."""
    bias = 1 << BITS
    rows = np.zeros(bias, np.int32)
    for _, places in examples:
        rows[places] += 1
    used = (rows >= LEAST_ROWS) & (rows <= max(LEAST_ROWS, LARGEST_SHARE * len(examples)))
    examples = [(label, np.append(places[used[places]], bias)) for label, places in examples]
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    for _ in range(epochs):
        for label, i in examples:
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            penalty = np.where(i == bias, 0.0, l1)
            w = np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + root) / alpha + l2))
            g = (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (POSITIVE if label else 1.0)
            after = ni + g * g
            z[i] = zi + g - (np.sqrt(after) - root) / alpha * w
            n[i] = after
    penalty = np.full(bias + 1, l1)
    penalty[bias] = 0.0
    return np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n)) / alpha + l2))


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero places and weights (the bias has place ``2 ** BITS``).

    At most ``max_rows`` rows are used: up to a third from label 1, the rest from
    label 0, each by smallest hash of the id and text.  No labelled rows: a model
    that scores 0.5 everywhere.  Rows with a null label are left out; a repeated
    row counts as often as it occurs; equal hashes go by label.
    """
    chosen = labelled.where(F.col(label_col).isin(0, 1)).withColumn("turn", F.xxhash64(F.lit("order"), id_col, text_col))
    parts = [chosen.where(F.col(label_col) == k).orderBy("turn").limit(m) for k, m in ((1, max_rows // 3), (0, max_rows - max_rows // 3))]
    examples = feature_rows(parts[0].unionByName(parts[1]).repartition(16, "turn"), text_col, label_col)

    def fit(batches):
        rows = [(t, y, p.values.to_numpy()) for b in batches for t, y, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))]
        rows.sort(key=lambda r: (r[0], r[1]))
        w = ftrl([(y, p) for _, y, p in rows], epochs)
        keep = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(w[keep])], names=["place", "weight"])

    model = examples.repartition(1).mapInArrow(fit, "place long, weight double").toPandas().sort_values("place")
    return model["place"].to_numpy(), model["weight"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``score`` for every row.

    A null or empty text gets the score of the bias alone.  Rows are mapped one by
    one: texts are read whole, repeated rows get equal scores, an empty table gives
    no rows, and columns that are not kept may have any name.
    """
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["score double"])
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.int64), model[1]))

    def run(batches):
        powers = Powers()
        places, weights = shared.value
        table = np.zeros((1 << BITS) + 1, np.float32)
        table[places] = weights
        bias = float(table[-1])
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for a, b, words in _word_blocks(batch.column(batch.num_columns - 1), powers):
                p, row = _features(words)
                w = table[p]
                hit = np.flatnonzero(w)
                key = np.unique(row[hit].astype(np.int64) << BITS | p[hit])
                margin = bias + np.bincount(key >> BITS, weights=table[key & ((1 << BITS) - 1)], minlength=b - a)
                scores[a:b] = 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(scores)], names=[*keep, "score"])

    return kept.mapInArrow(tidy(run), schema)


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """Documents of a bounded sample of labels: of each label the ``max_rows`` ids of smallest hash.

    Repeated labels of an id count once and only if they agree; null labels and
    ids are left out.  The sample is drawn from the labels alone, so its ids (at
    most ``2 * max_rows``) are broadcast and no text but those of the sample moves.
    """
    agreed = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("__low"), F.max(label_col).alias("__high"))
    agreed = agreed.where("__low = __high").select(id_col, F.col("__low").alias("__label"))
    parts = [agreed.where(F.col("__label") == k).orderBy(F.xxhash64(F.lit("order"), id_col), id_col).limit(max_rows) for k in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    return docs.select(id_col, text_col).join(sample, id_col).withColumnRenamed("__label", label_col)


def held_out(id_col: str, folds: int, fold: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold
