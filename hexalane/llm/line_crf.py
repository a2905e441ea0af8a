"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad.  Its features are statistics
of the line itself and of the lines before and after it; one transition weight
per label pair ties neighbours together.  Line labels for learning are inherited
from the document's label.  A document's score is the mean of its lines'
forward-backward marginals for *good*, weighted by line length.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Powers, Words, blocks, text_buffers, tidy

#: Labelled documents that learning may see, and the passes over them.
MAX_ROWS = 6_000
EPOCHS = 60
L2 = 1e-4

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?")] = True
STOP = np.zeros(256, bool)
STOP[list(b".,;:")] = True
CLASSES = np.stack([LETTER, UPPER, DIGIT, SYMBOL, MARK, STOP])
BASE_FEATURES = 17
FEATURES = 3 * BASE_FEATURES + 1
#: Lines whose features are held at a time when a text is scored: some 10 MB.
LINES = 65_536
#: Bound of the transition weights.  Where all lines of a document share its label, the likelihood grows with them for ever;
#: the bound lets a run of a few clear lines outweigh its neighbours.
MOST_TRANSITION = 2.0


def _own_features(data, offsets, powers):
    """Features of the lines themselves in a block, line lengths, and the first line of each text.

    Lines end at ``\\n``; every text has at least one line, which may be empty.
    """
    n, rows = len(data), len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A) if n else np.zeros(0, np.int64)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    first = np.searchsorted(np.sort(breaks), offsets[:-1]) + np.arange(rows)
    first = np.append(first, len(start))
    ends = np.concatenate([breaks, offsets[1:]])
    end = np.sort(ends, kind="stable")
    length = (end - start).astype(float)
    safe = np.maximum(length, 1.0)
    share = []
    for kind in CLASSES:
        total = np.concatenate([[0], np.cumsum(kind[data])]) if n else np.zeros(1, np.int64)
        share.append((total[end] - total[start]) / safe)
    words = Words(data, offsets, powers)
    h = words.hashes()
    w0, w1 = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    count = (w1 - w0).astype(float)
    # words of a line that occur in it before, and words equal to the word before
    line = np.repeat(np.arange(len(start)), w1 - w0)
    order = np.lexsort((h, line))
    again = (h[order][1:] == h[order][:-1]) & (line[order][1:] == line[order][:-1]) if len(h) else np.zeros(0, bool)
    repeats = np.bincount(line[order][1:][again], minlength=len(start)) if len(h) else np.zeros(len(start))
    runs = (h[1:] == h[:-1]) & (line[1:] == line[:-1]) if len(h) else np.zeros(0, bool)
    run = np.bincount(line[1:][runs], minlength=len(start)) if len(h) else np.zeros(len(start))
    wn = np.maximum(count, 1.0)
    last = np.where(length > 0, data[np.minimum(np.maximum(end - 1, 0), max(n - 1, 0))], 0) if n else np.zeros(len(start), np.uint8)
    lead = np.where(length > 0, data[np.minimum(start, max(n - 1, 0))], 0) if n else np.zeros(len(start), np.uint8)
    width = np.where(count > 0, (length - count + 1) / wn, 0.0)
    base = np.column_stack(
        [
            np.log1p(length) / 8.0,
            share[0],
            share[1],
            np.minimum(share[1] * 2.0, 1.0) > 0.6,
            share[2] * 4.0,
            np.minimum(share[3] * 10.0, 2.0),
            share[3] > 0.05,
            np.minimum(share[4] * 10.0, 2.0),
            share[4] > 0.03,
            np.minimum(share[5] * 5.0, 1.0),
            np.isin(last, (0x2E, 0x21, 0x3F)),
            UPPER[lead] | (lead >= 0x80),
            np.minimum(width / 10.0, 3.0),
            repeats / wn,
            run / wn,
            (run / wn) > 0.3,
            count < 3,
        ]
    ).astype(np.float64)
    return base, length, first


def _beside(own, first):
    """Rows of the lines before and after each line within its text, zeros where there is none."""
    head, tail = np.zeros(len(own), bool), np.zeros(len(own), bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    before = np.concatenate([own[:1] * 0, own[:-1]])
    before[head] = 0
    after = np.concatenate([own[1:], own[:1] * 0])
    after[tail] = 0
    return before, after


def line_features(data, offsets, powers):
    """Feature matrix of all lines of a block (own, before, after, constant), line lengths, and the first line of each text."""
    own, length, first = _own_features(data, offsets, powers)
    return np.hstack([own, *_beside(own, first), np.ones((len(own), 1))]), length, first


def emissions(data, offsets, powers, w):
    """Scores of *good* of all lines of a block, line lengths, and the first line of each text.

    The same numbers as ``line_features(...) @ w``, but features are held for
    ``LINES`` lines at a time: three numbers a line are enough to add up the
    lines' own parts and those of their neighbours.
    """
    parts = w[: 3 * BASE_FEATURES].reshape(3, BASE_FEATURES).T
    breaks = int(np.count_nonzero(data == 0x0A))
    if breaks + len(offsets) <= 2 * LINES:
        own, length, first = _own_features(data, offsets, powers)
        own = own @ parts
    else:
        first = np.concatenate([[0], np.cumsum([1 + np.count_nonzero(data[a:b] == 0x0A) for a, b in zip(offsets[:-1], offsets[1:])])])
        own, length = np.zeros((first[-1], 3)), np.zeros(first[-1])
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            at, text = first[i], data[a:b]
            ends = np.flatnonzero(text == 0x0A) + 1
            cuts = [0, *ends[LINES - 1 :: LINES].tolist(), len(text)]
            for k, (x, y) in enumerate(zip(cuts, cuts[1:]), 2):
                # the line break that ends a range is the border to the next one; the last range may be one empty line
                piece = text[x : y - 1] if k < len(cuts) else text[x:y]
                some, size, _ = _own_features(piece, np.array([0, len(piece)]), powers)
                own[at : at + len(some)], length[at : at + len(some)] = some @ parts, size
                at += len(some)
    before, after = _beside(own, first)
    return own[:, 0] + before[:, 1] + after[:, 2] + w[-1], length, first


def _log_sum(a, b):
    return np.logaddexp(a, b)


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray):
    """P(good) of every line, the expected transition counts and the log-partitions.

    ``emission`` is the score of *good* against *bad* (whose score is 0).  All
    texts advance together, one line position at a time; longest texts first, so
    that the texts still running are a prefix.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, lens = first[:-1][order], lengths[order]
    steps = int(lens[0]) if len(lens) else 0
    alive = np.searchsorted(-lens, -np.arange(steps), "left")  # texts longer than t
    a0, a1 = np.zeros(len(emission)), np.zeros(len(emission))
    b0, b1 = np.zeros(len(emission)), np.zeros(len(emission))
    for t in range(steps):
        i = starts[: alive[t]] + t
        if t == 0:
            a0[i], a1[i] = 0.0, emission[i]
        else:
            p0, p1 = a0[i - 1], a1[i - 1]
            a0[i] = _log_sum(p0 + transition[0, 0], p1 + transition[1, 0])
            a1[i] = _log_sum(p0 + transition[0, 1], p1 + transition[1, 1]) + emission[i]
    for t in range(steps - 2, -1, -1):
        i = starts[: alive[t + 1]] + t
        n0, n1 = b0[i + 1], b1[i + 1] + emission[i + 1]
        b0[i] = _log_sum(transition[0, 0] + n0, transition[0, 1] + n1)
        b1[i] = _log_sum(transition[1, 0] + n0, transition[1, 1] + n1)
    good = 1.0 / (1.0 + np.exp(np.clip(a0 + b0 - a1 - b1, -700, 700)))
    final = first[1:] - 1
    logz = _log_sum(a0[final], a1[final])
    pair = np.zeros((2, 2))
    inner = np.ones(len(emission), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    if len(j):
        z = np.repeat(logz, lengths)[j]
        for x, ax in ((0, a0), (1, a1)):
            for y, by in ((0, b0[j]), (1, b1[j] + emission[j])):
                pair[x, y] = np.exp(ax[j - 1] + transition[x, y] + by - z).sum()
    return good, pair, logz


def fit_crf(x, first, labels, epochs: int = EPOCHS):
    """Feature weights and transitions by Adam on the mean per-document conditional log-likelihood."""
    rng = np.random.default_rng(3)
    docs = len(labels)
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v, step = np.zeros(len(w) + 4), np.zeros(len(w) + 4), 0
    for _ in range(epochs):
        order = rng.permutation(docs)
        for part in np.array_split(order, max(1, docs // 500)):
            spans = [np.arange(first[d], first[d + 1]) for d in part]
            own = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
            rows = np.concatenate(spans)
            y = np.repeat(labels[part], np.diff(own))
            scale = np.repeat(1.0 / np.diff(own), np.diff(own))
            good, pair, _ = marginals(x[rows] @ w, own, t)
            seen = np.zeros((2, 2))
            inner = np.diff(own) - 1
            seen[1, 1], seen[0, 0] = inner[labels[part] == 1].sum(), inner[labels[part] == 0].sum()
            g = np.concatenate([x[rows].T @ ((good - y) * scale), ((pair - seen) / max(1, inner.sum())).ravel() * len(part)]) / len(part)
            g += L2 * np.concatenate([w, t.ravel()])
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            delta = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, t = w - delta[:-4], t - delta[-4:].reshape(2, 2)
            t = np.clip(t, -MOST_TRANSITION, MOST_TRANSITION)
    return w, t


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", max_rows: int = MAX_ROWS, epochs: int = EPOCHS):
    """Weights learnt in one task from at most ``max_rows`` labelled rows (a third at most of label 0), by smallest id hash.

    Without labelled rows the model scores 0.5 everywhere.
    """
    chosen = labelled.where(F.col(label_col).isin(0, 1)).withColumn("turn", F.xxhash64(F.lit("order"), id_col, text_col))
    parts = [chosen.where(F.col(label_col) == k).orderBy("turn").limit(m) for k, m in ((0, max_rows // 3), (1, max_rows - max_rows // 3))]
    rows = parts[0].unionByName(parts[1]).select(F.col(text_col).cast("string").alias("text"), "turn", F.col(label_col).cast("int").alias("label"))

    def features(batches):
        powers = Powers()
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in blocks(offsets):
                x, _, first = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], powers)
                packed = [x[first[i] : first[i + 1]].astype(np.float32).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(packed, pa.binary())], names=["turn", "label", "lines"])

    def fit(batches):
        got = sorted((t, y, x) for b in batches for t, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        if got:
            parts = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, _, x in got]
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            w, t = fit_crf(np.vstack(parts).astype(float), first, np.array([y for _, y, _ in got]), epochs)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w) + 4)), pa.array(np.concatenate([w, t.ravel()]))], names=["i", "w"])

    packed = rows.repartition(16, "turn").mapInArrow(tidy(features), "turn long, label int, lines binary")
    model = packed.repartition(1).mapInArrow(fit, "i long, w double").toPandas().sort_values("i")["w"].to_numpy()
    if not len(model):
        model = np.zeros(FEATURES + 4)
    return model[:-4], model[-4:].reshape(2, 2)


def score(docs: DataFrame, model, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep``, ``score``, ``n_lines`` and ``n_bad_lines`` for every row.

    A null or empty text is one empty line.  Rows are mapped one by one: repeated
    rows get equal scores, an empty table gives no rows, and columns that are not
    kept may have any name.  Long texts are read whole, ``LINES`` lines at a time.
    """
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["score double", "n_lines long", "n_bad_lines long"])
    w, t = model

    def run(batches):
        powers = Powers()
        for batch in batches:
            out, lines, bad = np.empty(batch.num_rows), np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            data, offsets = text_buffers(batch.column(batch.num_columns - 1))
            for a, b in blocks(offsets):
                own, length, first = emissions(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], powers, w)
                good, _, _ = marginals(own, first, t)
                weight = length + 1.0
                out[a:b] = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
                lines[a:b] = np.diff(first)
                bad[a:b] = np.add.reduceat((good < 0.5).astype(np.int64), first[:-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(out), pa.array(lines), pa.array(bad)], names=[*keep, "score", "n_lines", "n_bad_lines"])

    return kept.mapInArrow(tidy(run), schema)
