"""Near-duplicate documents by circulant MinHash.

Two permutations make every signature coordinate (C-MinHash, Li and Li 2022): the
first scatters shingles over a circle of ``CIRCLE`` places, the second gives each
place a rank, and coordinate *k* is the least rank after shifting the ranks by
*k* places.  The ranks of all shifts of one shingle are one contiguous slice of
the rank table, so a whole signature is a gather and a column minimum.

Steps, all as Spark jobs:

1. one pass over the texts: shingle set, set digest and band keys of each row;
2. rows of equal sets become one class (its smallest id stands for it);
3. every band bucket with two or more classes pairs each member with the
   bucket's most central member only, never all with all;
4. pairs are verified on full shingle sets (``100 * |A & B| >= 75 * |A | B|``);
5. buckets that still hold several components are looked at again: members
   outside the main component meet a few more of its members, and what is still
   apart is compared in blocks, through an index of shingles; a large group of
   copies, which is one component by now, costs nothing more;
6. connected components of all links.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, Powers, Words, blocks, mix, shingle_sets, text_buffers, tidy
from .components import components
from .work import drop_path, materialise

CIRCLE = 1 << 20
SHINGLE = 5
#: 50 bands of 5 coordinates: a pair at 0.75 is missed by every band with probability 1.3e-6.
BANDS, ROWS = 50, 5
#: Classes per task when members of one leader are verified.
MEMBERS = 256
#: Ids that may be broadcast to pick the texts to verify: 16 MB of longs.
BROADCAST_IDS = 2_000_000


def _rank_table(coordinates: int, seed: int) -> np.ndarray:
    """Row s holds the ranks of place s under all shifts (a view on one table)."""
    ranks = np.random.default_rng(seed).permutation(CIRCLE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:coordinates]]), coordinates)


def signature(shingles: np.ndarray, table: np.ndarray, seed: int) -> np.ndarray:
    """All coordinates of one set: places by the first permutation, then least ranks over all shifts of the second."""
    places = (mix(shingles ^ np.uint64(seed)) & np.uint64(CIRCLE - 1)).astype(np.int64)
    best = None
    for i in range(0, len(places), 1024):
        low = table[places[i : i + 1024]].min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; a band's coordinates lie far apart on the circle of shifts."""
    parts = sig.astype(np.uint64).reshape(rows, bands)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[r])
    return key.view(np.int64)


#: Further leaders that each mixed bucket tries before its components are compared in blocks.
LEADERS = 2
#: Shingles per place when components are compared in blocks: 24 MB of index.
PLACE_SHINGLES = 1_000_000
SKETCH = "id long, n_shingles long, d1 long, d2 long, bands array<long>"


def sketch(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """Per row: set size, a 128-bit digest of the shingle set, and its band keys (null for an empty set)."""

    def run(batches):
        powers, table = Powers(), _rank_table(bands * rows, seed)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0)
            for a, b in blocks(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], powers, fold=LOWER)
                n, d1, d2, keys = [], [], [], []
                for s in shingle_sets(words, SHINGLE):
                    n.append(len(s))
                    d1.append(int(np.add.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                    d2.append(int(np.add.reduce(mix(s ^ np.uint64(0xABCDEF))).view(np.int64)) if len(s) else 0)
                    keys.append(_band_keys(signature(s, table, seed), bands, rows) if len(s) else None)
                filled = [k for k in keys if k is not None]
                ends = np.cumsum([0] + [0 if k is None else bands for k in keys])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(filled) if filled else np.zeros(0, np.int64)), mask=pa.array([k is None for k in keys]))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists], names=["id", "n_shingles", "d1", "d2", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), SKETCH)


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets reach ``percent``; streams the members of a leader past its set.

    A leader's members are dealt to ``ceil(members / MEMBERS)`` places, so a
    leader of a third of all rows is spread like any other work.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("places"))
    dealt = pairs.join(sizes, "a").withColumn("place", F.pmod(F.xxhash64("b"), F.col("places")).cast("int"))
    member = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "place", F.lit(1).alias("role"), F.col("b").alias("id"), "text")
    # one leader row for each place in use: places of a leader are numbered, so no distinct over members is needed
    leader = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place")).join(texts.withColumnRenamed("id", "a"), "a")
    leader = leader.select("a", "place", F.lit(0).alias("role"), F.col("a").alias("id"), "text")
    rows = member.unionByName(leader)
    slots = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ready = rows.repartition(int(slots), "a", "place").sortWithinPartitions("a", "place", "role")

    def run(batches):
        powers, key, sets = Powers(), None, []
        for batch in batches:
            leaders, places, roles, ids = (batch.column(i).to_pylist() for i in range(4))
            data, offsets = text_buffers(batch.column(4))
            out_a, out_b = [], []
            for x, y in blocks(offsets):
                words = Words(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], powers, fold=LOWER)
                for i, s in enumerate(shingle_sets(words, SHINGLE), x):
                    if key != (leaders[i], places[i]):
                        key, sets = (leaders[i], places[i]), []
                    if roles[i] == 0:
                        sets.append(s)
                        continue
                    for t in sets:
                        if not 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                            continue
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        if both and 100 * both >= percent * (len(s) + len(t) - both):
                            out_a.append(leaders[i])
                            out_b.append(ids[i])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["u", "v"])

    return ready.mapInArrow(tidy(run), "u long, v long")


def small(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if their counted number allows, or else as they are (a shuffled join)."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts of the given ids."""
    wanted = small(ids)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null").join(wanted, "id", "left_semi")


def _mixed(held: DataFrame, label: DataFrame) -> DataFrame:
    """``key, rep, degree, n_shingles, c, main`` of the buckets that hold several components; ``main`` is that of the most central member."""
    now = held.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "degree", "n_shingles", F.coalesce("component", "rep").alias("c"))
    mixed = now.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max(F.struct("degree", "rep", "c")).alias("top")).where("c0 <> c1").select("key", F.col("top.c").alias("main"))
    return materialise(now.join(mixed, "key"), "mixed")


def _leads(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs ``(a, b)`` of a member of the bucket's main component, drawn by hash, and each member of the others."""
    drawn = mixed.where("c = main").groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key", F.lit(turn)), "rep")).alias("lead")).select("key", F.col("lead.rep").alias("a"))
    return mixed.where("c <> main").join(drawn, "key").select("a", F.col("rep").alias("b")).distinct()


def _verify_blocks(mixed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links ``(u, v)`` across components among the members of mixed buckets, found in blocks; no pair is ever a row.

    Members of the buckets with one main component form a group.  Those of other
    components are its queries; every pair across components that shares a bucket
    holds at least one.  A group's members are dealt to places of about
    ``PLACE_SHINGLES`` shingles, its queries go to each place, and a place counts
    common shingles through an index of its members.
    """
    member = mixed.groupBy("main", "rep").agg(F.first("c").alias("c"), F.first("n_shingles").alias("n_shingles"))
    places = member.groupBy("main").agg(F.ceil(F.sum("n_shingles") / PLACE_SHINGLES).cast("int").alias("places"))
    member = materialise(member.join(places, "main"), "members")
    node = member.select("main", F.pmod(F.xxhash64("rep"), F.col("places")).cast("int").alias("place"), F.lit(0).alias("role"), "rep", "c")
    query = member.where("c <> main").select("main", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(1).alias("role"), "rep", "c")
    rows = node.unionByName(query).join(texts.withColumnRenamed("id", "rep"), "rep").select("main", "place", "role", "rep", "c", "text")
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = rows.repartition(slots, "main", "place").sortWithinPartitions("main", "place", "role")

    def run(batches):
        powers, key, block = Powers(), None, None
        for batch in batches:
            mains, places, roles, reps, comps = (batch.column(i).to_pylist() for i in range(5))
            data, offsets = text_buffers(batch.column(5))
            out = []
            for x, y in blocks(offsets):
                words = Words(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], powers, fold=LOWER)
                for i, s in enumerate(shingle_sets(words, SHINGLE), x):
                    if key != (mains[i], places[i]):
                        key, block = (mains[i], places[i]), _Block()
                    if roles[i] == 0:
                        block.add(s, reps[i], comps[i])
                    else:
                        out += [(reps[i], v) for v in block.links(s, comps[i], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])

    return ready.mapInArrow(tidy(run), "u long, v long")


class _Block:
    """Shingle sets of a place, and an index from shingle to sets."""

    def __init__(self):
        self.sets, self.reps, self.comps, self.index = [], [], [], None

    def add(self, shingles, rep, component):
        self.sets.append(shingles)
        self.reps.append(rep)
        self.comps.append(component)

    def links(self, shingles, component, percent):
        """One member of each other component that reaches ``percent``."""
        if not self.sets:
            return []
        if self.index is None:
            sizes = np.array([len(s) for s in self.sets])
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            self.index = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes, np.array(self.comps), np.array(self.reps)
        flat, owner, sizes, comps, reps = self.index
        low, high = np.searchsorted(flat, shingles, "left"), np.searchsorted(flat, shingles, "right")
        n = high - low
        both = np.bincount(owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sizes))
        hit = np.flatnonzero((100 * both >= percent * (len(shingles) + sizes - both)) & (both > 0) & (comps != component))
        _, first = np.unique(comps[hit], return_index=True)
        return reps[hit[first]].tolist()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """``(id, n_shingles, component_id)`` per input row.

    Words are lower-cased (A-Z) runs of ``[^\\x20\\x09-\\x0D]``; a document's set
    holds its distinct 5-word shingles, or its whole word sequence when it has
    fewer words.  Rows without words, or with a null text, have an empty set and
    are linked with nothing.  Rows with a null id keep their ``n_shingles``, get a
    null component and are linked with nothing.  A repeated id stands for one
    node: its rows share a component even where their texts differ.  An empty
    table gives no rows.  Long texts are scanned whole; ties do not occur, since
    the component is the smallest id.
    """
    rows_ = materialise(sketch(docs, id_col, text_col, bands, rows, seed), "sketch")
    full = rows_.where("id is not null and n_shingles > 0")
    classes = full.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("bands").alias("bands"))
    classes = materialise(classes, "classes")
    # buckets of two classes or more; the class that meets most others leads: less altered copies meet more of a group
    keys = classes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(keys.join(buckets, "key"), "members")
    central = members.groupBy("rep").agg(F.sum("n").alias("degree"))
    members = materialise(members.join(central, "rep"), "members")
    leads = members.groupBy("key").agg(F.max(F.struct("degree", "rep")).alias("lead")).select("key", F.col("lead.rep").alias("a"))
    pairs = materialise(members.join(leads, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    texts = materialise(_texts(docs, members.select(F.col("rep").alias("id")).distinct(), id_col, text_col), "texts")
    links = materialise(_verify(pairs, texts, percent), "links")
    # an id in several classes links them
    several = materialise(full.groupBy("id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low <> high").select("id"), "several")
    if not several.isEmpty():
        of_id = full.join(several, "id").join(classes.select("d1", "d2", "n_shingles", "rep"), ["d1", "d2", "n_shingles"]).select("id", "rep")
        lowest = of_id.groupBy("id").agg(F.min("rep").alias("u"))
        links = links.unionByName(of_id.join(lowest, "id").where("rep <> u").select("u", F.col("rep").alias("v")))
    label = components(links)
    # buckets that still hold several components: other leaders first, then in blocks
    mixed = members.where("n > 2")
    for turn in range(LEADERS + 1):
        mixed = _mixed(mixed.select("key", "rep", "degree", "n_shingles"), label)
        if mixed.isEmpty():
            break
        more = _verify(_leads(mixed, turn), texts, percent) if turn < LEADERS else _verify_blocks(mixed, texts, percent)
        more = materialise(more, "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            label = components(links)
    by_class = classes.select("d1", "d2", "n_shingles", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    hit = full.join(by_class, ["d1", "d2", "n_shingles"]).select("id", "n_shingles", "component_id")
    rest = rows_.where("id is null or n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    drop_path(docs.sparkSession, texts)
    return hit.unionByName(rest)
