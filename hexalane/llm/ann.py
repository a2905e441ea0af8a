"""Approximate nearest neighbours by learned partitions.

Following neural locality-sensitive hashing (Dong et al., 2020): the neighbour
graph of a bounded sample is cut into balanced parts, a small classifier learns
the part of a vector from its coordinates, every vector is filed under its most
probable part, and a query searches its most probable parts and ranks what they
hold by exact inner products in double precision.

A part of more than ``LEAF`` vectors is cut again in the same way, with a
classifier of its own learnt from a sample of its vectors, so the number of parts
grows with the table while each stays within a constant factor of ``LEAF``, and a
query meets a bounded number of vectors whatever the size of the table.

Queries meet vectors in blocks: a part is dealt to places of about ``BLOCK``
vectors, queries routed to the part go to each of its places in blocks of
``QUERIES``, and a place multiplies two matrices and keeps each query's best.  No
pair is ever a row.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import materialise

#: Vectors that the partition and the classifier are learnt from.
SAMPLE = 5_000
PARTS, NEIGHBOURS = 16, 10
#: A query searches as many of its most probable parts as reach this recall on vectors kept out of learning.
RECALL, HELD_OUT = 0.95, 500
HIDDEN, EPOCHS = 128, 25
#: Parts of more vectors are cut again; vectors of a place that is routed or searched in one task; queries of a round.
LEAF, BLOCK, QUERIES = 65_536, 4_096, 1_024
#: Parts whose numbers of places may be broadcast: 16 bytes each.
BROADCAST_PARTS = 500_000
#: Share of the largest possible score by which a matrix product may differ from a sum in the order of the components.
ROUNDING = 1e-13


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` of the rows with an id and a vector that is not null, empty, zero, or holds null, NaN or infinite components."""
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0))


def _inputs(x: np.ndarray) -> np.ndarray:
    """Direction and log-length."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.hstack([x / norm * np.sqrt(x.shape[1]), np.log(norm), np.ones((len(x), 1))])


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` vectors of largest inner product to each, itself left out, in blocks of rows."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 12, slack: float = 1.08) -> np.ndarray:
    """A part for each vector: halves along principal directions to start, then moves along graph edges under a size bound.

    A vector moves to the part that most of its graph neighbours are in, if that
    cuts fewer edges and the part has room (``slack`` times the mean size).
    """
    part = np.zeros(len(x), np.int64)
    count = 1
    while count < parts:
        for p in range(count):
            rows = np.flatnonzero(part == p)
            if len(rows) > 1:
                centred = x[rows] - x[rows].mean(axis=0)
                direction = np.linalg.svd(centred, full_matrices=False)[2][0]
                order = np.argsort(centred @ direction, kind="stable")
                part[rows[order[len(rows) // 2 :]]] = p + count
        count *= 2
    n, k = graph.shape
    source = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()])
    target = np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    order = np.argsort(source, kind="stable")
    target, ends = target[order], np.searchsorted(source[order], np.arange(n + 1))
    room = int(np.ceil(slack * n / count))
    sizes = np.bincount(part, minlength=count)
    for _ in range(sweeps):
        moved = 0
        for i in range(n):
            votes = np.bincount(part[target[ends[i] : ends[i + 1]]], minlength=count)
            own = part[i]
            votes[(sizes >= room) & (np.arange(count) != own)] = -1
            best = int(np.argmax(votes))
            if votes[best] > votes[own]:
                part[i] = best
                sizes[own] -= 1
                sizes[best] += 1
                moved += 1
        if moved < n // 200:
            break
    return part


def fit_router(x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS):
    """A one-hidden-layer classifier of parts, by Adam on cross-entropy to the parts of a vector and its neighbours."""
    rng = np.random.default_rng(17)
    f = _inputs(x)
    w1 = rng.normal(0, 1 / np.sqrt(f.shape[1]), (f.shape[1], hidden))
    w2 = rng.normal(0, 1 / np.sqrt(hidden), (hidden + 1, target.shape[1])) * 0.1
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (w1, w2)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            i = order[a : a + 256]
            h = np.maximum(f[i] @ w1, 0)
            hb = np.hstack([h, np.ones((len(i), 1))])
            z = hb @ w2
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - target[i]) / len(i)
            g2 = hb.T @ d
            g1 = f[i].T @ ((d @ w2[:-1].T) * (h > 0))
            step += 1
            for w, g, s in ((w1, g1, state[0]), (w2, g2, state[1])):
                g = g + 1e-5 * w
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                w -= 2e-3 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
    return w1, w2


def route(x: np.ndarray, router, probes: int) -> np.ndarray:
    """The ``probes`` most probable parts of each vector, most probable first."""
    w1, w2 = router
    z = np.maximum(_inputs(x) @ w1, 0) @ w2[:-1] + w2[-1]
    return np.argsort(-z, axis=1, kind="stable")[:, :probes]


def learn(sample: np.ndarray, parts: int = PARTS, neighbours: int = NEIGHBOURS, recall: float = RECALL, k: int = 20):
    """The router learnt from a sample of vectors, and the number of parts to search for ``recall``.

    The last ``HELD_OUT`` vectors (a tenth at most) are kept out of learning; the
    parts to search are counted on them, as queries against the whole sample.
    Parts are fewer where the sample is small; one part is searched whole.
    """
    held = min(HELD_OUT, len(sample) // 10)
    known = sample[: len(sample) - held]
    while parts > 1 and len(known) < 16 * parts:
        parts //= 2
    if parts <= 1:
        return (np.zeros((sample.shape[1] + 2, 1)), np.zeros((2, 1))), 1
    graph = neighbour_graph(known, min(neighbours, len(known) - 1))
    part = balanced_parts(known, graph, parts)
    target = np.zeros((len(known), parts))
    np.add.at(target, (np.arange(len(known)), part), 0.5)
    for column in graph.T:
        np.add.at(target, (np.arange(len(known)), part[column]), 0.5 / graph.shape[1])
    router = fit_router(known, target)
    home = route(sample, router, 1)[:, 0]
    asked = sample[len(known) :]
    scores = asked @ sample.T
    scores[np.arange(held), np.arange(len(known), len(sample))] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    order = np.argsort(route(asked, router, parts), axis=1)  # place of each part in a query's order
    depth = np.take_along_axis(order, home[best], axis=1)
    reached = [(depth < p).mean() for p in range(1, parts + 1)]
    return router, 1 + next(i for i, r in enumerate(reached) if r >= recall)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of ``q`` with the rows of ``x``, summed in the order of the components: equal rows give equal scores."""
    out = np.zeros(len(x))
    for j in range(len(q)):
        out += q[j] * x[:, j]
    return out


def nearest(q: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """``query id, id, score`` of the ``k`` rows of ``x`` of largest score to each row of ``q``; equal scores go to the smaller id.

    A matrix product, whose last bits depend on a row's place, only says which
    rows may be among the best; those within its rounding error of the ``k``-th are
    scored by :func:`exact_scores`.
    """
    found = []
    longest = np.linalg.norm(x, axis=1).max()
    for s in range(0, len(q), 256):
        rough = q[s : s + 256] @ x.T
        rough[qids[s : s + 256, None] == ids[None, :]] = -np.inf
        slack = ROUNDING * x.shape[1] * longest * np.linalg.norm(q[s : s + 256], axis=1)
        border = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
        for r in range(len(rough)):
            c = np.flatnonzero((rough[r] >= border[r] - 2 * slack[r]) & (rough[r] > -np.inf))
            score = exact_scores(q[s + r], x[c])
            first = np.lexsort((ids[c], -score))[:k]
            found.append((np.full(len(first), qids[s + r]), ids[c[first]], score[first]))
    return [np.concatenate(v) for v in zip(*found)]


# Routers travel between tasks as the bytes of their weights.
ROUTER = "part long, probes int, shape array<int>, weights binary"


def _packed(router, probes: int, part: int):
    w1, w2 = router
    return part, probes, [*w1.shape, *w2.shape], np.concatenate([w1.ravel(), w2.ravel()]).astype(np.float64).tobytes()


def _unpacked(shape, weights):
    flat = np.frombuffer(weights, np.float64)
    cut = shape[0] * shape[1]
    return flat[:cut].reshape(shape[0], shape[1]), flat[cut:].reshape(shape[2], shape[3])


def _learnt(filed: DataFrame, large: DataFrame, parts: int, recall: float, k: int, sample: int) -> DataFrame:
    """``ROUTER`` of each part in ``large(part, size)``, each learnt in a task of its own from about ``sample`` of its vectors."""
    share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 40)) < F.lit(float(sample << 40)) / F.col("size")
    chosen = filed.join(large, "part").where(share).select("part", "id", "v")

    def fit(pdf):
        pdf = pdf.sort_values("id", kind="stable")
        order = np.argsort(np.random.default_rng(23).random(len(pdf)), kind="stable")
        router, probes = learn(np.array(pdf["v"].tolist(), float)[order], parts, recall=recall, k=k)
        return pd.DataFrame([_packed(router, probes, int(pdf["part"].iloc[0]))], columns=["part", "probes", "shape", "weights"])

    return chosen.groupBy("part").applyInPandas(fit, ROUTER)


def _descend(rows: DataFrame, routers: DataFrame, sizes: DataFrame, parts: int, every: bool) -> DataFrame:
    """Rows ``part, id, v`` one level down: to the most probable part below their own, or to as many as a query searches if ``every``.

    Rows of parts that are not cut stay as they are.  A part that is cut is dealt to
    places of ``BLOCK`` rows, and its router goes to each of them; the way is the
    same for any number of parts.
    """

    def down(part, ids, x, router, probes):
        near = route(x, router, probes if every else 1)
        width = near.shape[1]
        return pa.record_batch({"part": pa.array(np.repeat(part, len(x) * width) * parts + near.ravel() + 1), "id": ids.take(pa.array(np.repeat(np.arange(len(x)), width))), "v": _lists(np.repeat(x, width, axis=0))})

    kind = "part long, id long, v array<double>"
    places = sizes.select("part", F.ceil(F.col("size") / BLOCK).cast("int").alias("places"))
    dealt = rows.join(places, "part").withColumn("place", F.pmod(F.xxhash64("id"), F.col("places")).cast("int")).select("part", "place", "id", "v")
    spread = routers.join(places, "part").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).select("part", "place", "probes", "shape", "weights")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            r = b.slice(0, 1).to_pylist()[0]
            a = a.combine_chunks()
            return pa.Table.from_batches([down(r["part"], a["id"].combine_chunks(), _matrix(a["v"].combine_chunks()), _unpacked(r["shape"], r["weights"]), r["probes"])])
        return a.select(["part", "id", "v"]) if a.num_rows else pa.table({"part": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64()))})

    kept = rows.join(sizes.select("part"), "part", "left_anti").select("part", "id", "v")
    return dealt.groupBy("part", "place").cogroup(spread.groupBy("part", "place")).applyInArrow(meet, kind).unionByName(kept)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, parts: int = PARTS, recall: float = RECALL, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query.

    ``vectors`` and ``queries`` hold ``id, v`` as from :func:`usable`.  Vectors of
    another dimension than the most frequent one take no part.  A vector is no
    neighbour of a query of its own id.  Equal scores go to the smaller id; an id
    that occurs several times is returned once, with its best score.  Parts of
    more than ``leaf`` vectors are cut by a router learnt from about ``sample`` of
    their vectors; every vector is filed.  A table is always cut once; small ones
    have fewer parts, the smallest one, which is searched whole.  Empty inputs
    give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usual = vectors.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), "n").first()
    if usual is None:
        return nothing
    first = lambda rows: rows.where(F.size("v") == usual["n"]).select(F.lit(0).cast("long").alias("part"), "id", "v")
    filed, asked = first(vectors), first(queries)
    # every level loses some neighbours; what all levels keep together is to be ``recall``
    levels = max(1, math.ceil(math.log(max(usual["rows"] / leaf, 1.0), parts)))
    sizes = filed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    while True:
        routers = materialise(_learnt(filed, sizes, parts, recall ** (1 / levels), k, sample), "routers")
        filed = materialise(_descend(filed, routers, sizes, parts, False), "filed")
        asked = materialise(_descend(asked, routers, sizes, parts, True), "asked")
        # a part that still holds most of the one above it does not come apart (equal vectors): it is searched in blocks as it is
        held = filed.groupBy("part").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > leaf)
        above = sizes.select(F.col("part").alias("above"), F.col("size").alias("whole"))
        sizes = materialise(held.join(above, (F.floor((F.col("part") - 1) / parts) == F.col("above")) & (F.col("size") * 4 <= F.col("whole"))).select("part", "size"), "sizes")
        if sizes.isEmpty():
            return _ranked(filed, asked, k)


def _ranked(filed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The nearest of each query among the vectors of the parts it is sent to."""
    # places and query blocks of a part come from counts (a row per part)
    places = filed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("places"))
    rounds = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("rounds"))
    plan = materialise(places.join(rounds, "part"), "places")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_PARTS else plan
    left = filed.join(plan, "part").withColumn("place", F.pmod(F.xxhash64("id"), F.col("places")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    right = asked.join(plan, "part").withColumn("turn", F.pmod(F.xxhash64("id"), F.col("rounds")).cast("int")).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    key = ["part", "place", "turn"]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not (a.num_rows and b.num_rows):
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        a, b = a.combine_chunks(), b.combine_chunks()
        return pa.table(dict(zip(names, nearest(_matrix(b["v"].combine_chunks()), b["id"].to_numpy(), _matrix(a["v"].combine_chunks()), a["id"].to_numpy(), k))))

    near = left.select(*key, "id", "v").groupBy(*key).cogroup(right.select(*key, "id", "v").groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
