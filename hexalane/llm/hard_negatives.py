"""Hard negatives of anchors by a vector-approximation file.

Every dimension of the integer vectors is cut into cells of equal width, and a
row is filed as one byte per dimension beside its vector.  A scan looks up, for
an anchor and each dimension, what the cell contributes to the inner product at
least; the sum is a **lower bound** of the score, and since all cells of a
dimension are equally wide, the **upper bound** is a constant of the anchor away
from it.  Only rows whose bounds allow them into a result are scored exactly:

* *positives*, the first rows of the anchor's label: rows whose upper bound
  reaches the k-th largest lower bound or exact score seen;
* *negatives*, the first rows of other labels in each positive's score window:
  rows whose bounds overlap the window and reach its k-th best row so far, where
  rows certain to lie inside count by their lower bounds.

Both scans read the file in parallel and send on a few rows per anchor and task.
Anchors are taken in blocks of bounded size, a pair of scans for each block.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import tidy
from .work import drop_path, fresh_path, materialise

#: Cells of a dimension.
CELLS = 64
#: Anchors of a block: with their positives the most that the driver holds and sends out.
ANCHORS = 1024
#: Rows bounded at once, and pairs that a task should look at.
ROWS, PAIRS = 2048, 1 << 23
#: Larger components would not leave room for a score in 64 bits.
MOST = 1 << 26
NONE = np.iinfo(np.int64).min


def scaled(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, computed in double precision."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(rows: DataFrame, id_col: str, vec_col: str, label: Column, scale: int = 256) -> DataFrame:
    """``id, label, v``: rows with an id, a label and a vector whose components are all finite (and scaled below ``MOST``)."""
    fine = F.coalesce(F.forall(vec_col, lambda x: F.coalesce(F.abs(x.cast("double")) < MOST / scale, F.lit(False))), F.lit(False))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("v"), fine.alias("fine"))
    return kept.where("fine and id is not null and label is not null").select("id", "label", scaled(F.col("v"), scale).alias("v"))


def _matrix(column, dim: int, dtype: str) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    if dim == 0:
        return np.zeros((len(column), 0), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dim)


def filed(rows: DataFrame, dim: int, cells: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The file of rows of ``dim`` components, the least value of each dimension and the width of its cells."""
    spark = rows.sparkSession
    own = rows.where(F.size("v") == dim)
    edges = own.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("pos").collect() if dim else []
    low, high = (np.array([r[c] for r in edges], np.int64) for c in ("low", "high"))
    width = -(-(high - low + 1) // cells)

    def run(batches):
        for batch in batches:
            v = batch.column(2)
            m = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), dim)
            code = ((m - low) // width).astype(np.uint8)
            pack = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pack(code), pack(m.astype(np.int32))], names=["id", "label", "cells", "v"])

    file = own.select("id", "label", "v").mapInArrow(tidy(run), "id long, label long, cells binary, v binary")
    # numbered, so that an anchor stays itself even where its id occurs twice
    return materialise(file.withColumn("row", F.monotonically_increasing_id()), "approximations"), low, width


class Anchors:
    """A block of anchors, and the bounds and exact scores of rows against them."""

    def __init__(self, table: pa.Table, low: np.ndarray, width: np.ndarray, cells: int):
        self.row, self.id, self.label = (table[c].to_numpy() for c in ("row", "id", "label"))
        self.v = _matrix(table["v"], len(low), "<i4").astype(np.int64)
        start = low[:, None] + width[:, None] * np.arange(cells)
        self.edges = np.stack([start, start + width[:, None] - 1], axis=2) if len(low) else np.zeros((0, cells, 2), np.int64)
        #: upper minus lower bound
        self.gap = np.abs(self.v) @ (width - 1)
        largest = (np.abs(self.v) * np.abs(self.edges).max(axis=(1, 2))).sum(axis=1) if len(low) else np.zeros(len(self.row), np.int64)
        self.kind = np.int32 if len(largest) == 0 or int((largest + self.gap).max()) < 1 << 30 else np.int64

    def lower(self, codes: np.ndarray, pick: np.ndarray) -> np.ndarray:
        """Lower bounds of the rows of ``codes`` (a column per dimension) for the anchors ``pick``."""
        out = np.zeros((len(pick), codes.shape[1]), self.kind)
        for d in range(len(self.edges)):
            a = self.v[pick, d][:, None]
            table = np.where(a >= 0, a * self.edges[d, :, 0], a * self.edges[d, :, 1]).astype(self.kind)
            out += table.take(codes[d], axis=1)
        return out

    def exact(self, a: np.ndarray, v: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        for i in range(0, len(a), 1 << 14):
            s = slice(i, i + (1 << 14))
            out[s] = np.einsum("ij,ij->i", self.v[a[s]], v[r[s]].astype(np.int64))
        return out


class Best:
    """The ``k`` first rows of each slot by score, then id."""

    def __init__(self, slots: int, k: int):
        self.k, self.slot, self.score, self.id = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.last = np.full(slots, NONE)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        nth = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = nth < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = nth == self.k - 1
        self.last[slot[full]] = score[full]


def _chunks(batches, dim: int):
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), dim, np.uint8).T.copy(), _matrix(part.column(3), dim, "<i4")


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k] if values.shape[1] >= k else np.full(len(values), NONE)


def _positives(shared, dim: int, k: int):
    """Of each anchor of the block, the task's first ``k`` other rows of its label: ``slot, id, score``."""

    def run(batches):
        block: Anchors = shared.value
        best = Best(len(block.id), k)
        by_label = {int(x): np.flatnonzero(block.label == x) for x in np.unique(block.label)}
        for ids, labels, codes, v in _chunks(batches, dim):
            for label in np.unique(labels):
                pick, rows = by_label.get(int(label)), np.flatnonzero(labels == label)
                if pick is None:
                    continue
                low = block.lower(codes[:, rows], pick).astype(np.int64)
                low[block.id[pick][:, None] == ids[rows][None, :]] = NONE
                reach = np.maximum(best.last[pick], _kth(low, k))
                a, r = np.nonzero((low != NONE) & (low + block.gap[pick][:, None] >= reach[:, None]))
                a, r = pick[a], rows[r]
                best.add(a, block.exact(a, v, r), ids[r])
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.id), pa.array(best.score)], names=["slot", "id", "score"])

    return tidy(run)


def _negatives(shared, dim: int, k: int):
    """Of each anchor's window, the task's first ``k`` rows of other labels: ``slot, id, score``; a slot is anchor times windows plus window."""

    def run(batches):
        block, below, above = shared.value
        m, n = below.shape
        best = Best(m * n, k)
        some = np.arange(m)
        for ids, labels, codes, v in _chunks(batches, dim):
            low = block.lower(codes, some).astype(np.int64)
            high = low + block.gap[:, None]
            other = block.label[:, None] != labels[None, :]
            wanted = np.zeros(low.shape, bool)
            for w in range(n):
                reach = np.maximum(below[:, w], best.last[w::n])
                new = np.flatnonzero((best.last[w::n] == NONE) & (below[:, w] <= above[:, w]))
                if len(new):
                    sure = other[new] & (low[new] >= below[new, w][:, None]) & (high[new] <= above[new, w][:, None])
                    reach[new] = np.maximum(reach[new], _kth(np.where(sure, low[new], NONE), k))
                wanted |= (low <= above[:, w][:, None]) & (high >= reach[:, None])
            a, r = np.nonzero(wanted & other)
            score = block.exact(a, v, r)
            for w in range(n):
                inside = (score >= below[a, w]) & (score <= above[a, w])
                best.add(a[inside] * n + w, score[inside], ids[r[inside]])
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.id), pa.array(best.score)], names=["slot", "id", "score"])

    return tidy(run)


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


FOUND = "slot long, id long, score long"


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, cells: int = CELLS, block: int = ANCHORS) -> DataFrame:
    """Per anchor and positive its first ``negatives`` rows of other labels with ``least`` to ``most`` percent of the positive's score.

    ``rows`` holds ``id, label, v`` as from :func:`usable`; ``anchor`` is a
    condition on ``id`` and ``label``.  Higher scores come first, ties by smaller id;
    an anchor's positives are its first rows of the same label and another id.
    Equal rows are rows of their own on both sides.  Vectors meet vectors of the
    same number of components only.  A positive of negative score has an empty
    window.  An empty table, and a table without anchors, give no rows.

    Columns: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, "negatives")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], out).write.parquet(path)
    for dim, in rows.where(anchor).select(F.size("v")).distinct().collect():
        file, low, width = filed(rows, dim, cells)
        total, asked = file.agg(F.count(F.lit(1)), F.count_if(anchor)).first()
        blocks = math.ceil(asked / block)
        tasks = min(max(1, total * block // PAIRS), 100_000)
        spread = file.repartition(tasks) if file.rdd.getNumPartitions() < tasks else file
        rows_of = spread.select("id", "label", "cells", "v")
        for b in range(blocks):
            # rows are numbered, so even anchors of one id are dealt evenly to blocks
            own = file.where(anchor & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).select("row", "id", "label", "v")
            anchors = Anchors(own.orderBy("row").toArrow(), low, width, cells)
            if not len(anchors.id):
                continue
            near = _first(rows_of.mapInArrow(_positives(spark.sparkContext.broadcast(anchors), dim, positives), FOUND), positives).toArrow()
            slot, rank = near["slot"].to_numpy(), near["rank"].to_numpy() - 1
            ids, score = (np.zeros((len(anchors.id), positives), np.int64) for _ in range(2))
            # a window that is not there is empty: it begins above its end
            below, above = np.ones_like(score), np.zeros_like(score)
            ids[slot, rank], score[slot, rank] = near["id"].to_numpy(), near["score"].to_numpy()
            below[slot, rank], above[slot, rank] = -((-least * score[slot, rank]) // 100), most * score[slot, rank] // 100
            shared = spark.sparkContext.broadcast((anchors, below, above))
            found = _first(rows_of.mapInArrow(_negatives(shared, dim, negatives), FOUND), negatives)
            known = spark.createDataFrame(pa.table({"slot": np.arange(ids.size), "anchor_id": np.repeat(anchors.id, positives), "positive_id": ids.ravel(), "positive_score": score.ravel()}))
            found.join(F.broadcast(known), "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
        drop_path(spark, file)
    return spark.read.schema(out).parquet(path)
