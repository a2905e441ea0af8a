"""Trie of shared conversation prefixes from chained digests.

1. every turn becomes a SHA-256 digest of its role and text and a count of bytes:
   from here on rows are short, whatever the texts;
2. turns are dealt by conversation family and sorted; one pass per family chains
   the digests and gives **every prefix** of every rebuilt conversation as a row;
3. rows of one ``(depth, digest)`` are one **node**;
4. **subtree sums**: each node is exploded to its ancestors and summed per
   ancestor.  Depths are cut into blocks of ``BLOCK``: a node meets the ancestors
   of its own block, the tops of the blocks form a trie of their own that is
   summed the same way, and a top's total goes to the block above.  A node is
   thus exploded to ``BLOCK`` ancestors at most per level, and a conversation of a
   million turns needs five levels;
5. the digest over a node's ended conversations streams over sorted runs of ids,
   so a node where a third of all conversations end is never held as one list.
"""

import hashlib
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import tidy
from .work import drop_path, materialise

#: Depths of a block.
BLOCK = 16
#: Ids of a run whose text is hashed at once.
RUN = 50_000
ROOT = hashlib.sha256(b"").digest()
PREFIX = "depth long, digest binary, conv_id long, bytes long, levels array<array<binary>>, ends boolean"


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the head of its family."""
    return F.crc32(conv_id.cast("string")) % 9


def family(conv_id: Column) -> Column:
    return conv_id - conv_id % 5


class Chain:
    """The chained digest of one conversation and, for each level of blocks, the digests a node is exploded to."""

    def __init__(self, block: int):
        self.block, self.depth, self.digest, self.recent = block, 0, ROOT, [deque(maxlen=block)]

    def add(self, turn: bytes) -> None:
        d, level = self.depth, 0
        while d % self.block ** level == 0:  # the node that is left behind becomes an ancestor on each level it belongs to
            if level == len(self.recent):  # the root is on every level
                self.recent.append(deque([ROOT], maxlen=self.block))
            self.recent[level].append(self.digest)
            if d == 0:
                break
            level += 1
        self.depth, self.digest = d + 1, hashlib.sha256(self.digest + turn).digest()

    def levels(self) -> list[list[bytes]]:
        """Per level the ancestors of this node, the nearest last: those of its block, or of the block above if it is a block's top."""
        out, d, level = [], self.depth, 0
        while d and d % self.block ** level == 0:
            near = d // self.block**level % self.block or self.block
            own = list(self.recent[level]) if level < len(self.recent) else [ROOT]
            out.append(own[-near:])
            level += 1
        return out


def _chained(block: int):
    kind = pa.list_(pa.list_(pa.binary()))

    def run(batches):
        base = conv = chain = None
        head, own, taken, held = [], 0, 0, None
        out = []

        def flush(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], kind), pa.array(cols[5], pa.bool_())], names=["depth", "digest", "conv_id", "bytes", "levels", "ends"])

        def node(n_bytes):
            nonlocal held
            if held is not None:
                out.append((*held, False))
            held = (chain.depth, chain.digest, conv, n_bytes, chain.levels())

        for batch in batches:
            for b, c, take, turn, n_bytes in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if c != conv:
                    if held is not None:
                        out.append((*held, True))
                    if b != base:
                        base, head = b, []
                    conv, chain, held, own, taken = c, Chain(block), None, 0, take
                    node(0)
                    if c != b:
                        for t, n in head[:taken]:
                            chain.add(t)
                            node(n)
                if c == b and len(head) < 8:
                    head.append((turn, n_bytes))
                own += 1
                if c == b or own > taken:
                    chain.add(turn)
                    node(n_bytes)
                if len(out) >= 4096:
                    yield flush(out)
                    out.clear()
        if held is not None:
            out.append((*held, True))
        if out:
            yield flush(out)

    return tidy(run)


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per rebuilt conversation and prefix of it, the empty one included; ``ends`` marks the whole conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id is not null").select(family(conv).alias("b"), conv.alias("c"), head_turns(conv).cast("long").alias("take"), digest.alias("turn_digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.col("turn").alias("turn"))
    ready = rows.repartition("b").sortWithinPartitions("b", F.col("c") != F.col("b"), "c", F.col("turn").asc_nulls_first(), "turn_digest").drop("turn")
    return ready.mapInArrow(_chained(block), PREFIX)


def _runs(batches):
    """Sorted (digest, conv_id) rows to runs: digest, smallest id, and the ids joined by commas."""
    now, ids, out = None, [], []
    for batch in batches:
        for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != now or len(ids) == RUN:
                if ids:
                    out.append((now, ids[0], ",".join(map(str, ids))))
                now, ids = digest, []
            ids.append(conv)
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(("digest", "first", "ids"), x)) for x in out], RUNS)
            out = []
    if ids:
        out.append((now, ids[0], ",".join(map(str, ids))))
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(("digest", "first", "ids"), x)) for x in out], RUNS)


def _hashed(batches):
    """Sorted runs to one SHA-256 per digest, fed run by run."""
    now, state, out = None, None, []
    for batch in batches:
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if digest != now:
                if state is not None:
                    out.append({"digest": now, "ends_sha256": state.hexdigest()})
                now, state = digest, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, HASHED)
            out = []
    if state is not None:
        out.append({"digest": now, "ends_sha256": state.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out, HASHED)


RUNS = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
HASHED = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])


def ends_digest(ended: DataFrame) -> DataFrame:
    """``digest, ends_sha256``: SHA-256 over the sorted decimal ids of the conversations that end at a node."""
    slots = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = ended.select("digest", "conv_id").repartitionByRange(slots, "digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(tidy(_runs), "digest binary, first long, ids string")
    return runs.repartition(slots, "digest").sortWithinPartitions("digest", "first").mapInArrow(tidy(_hashed), "digest binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str], depth: int, block: int = BLOCK, level: int = 0) -> DataFrame:
    """``digest`` and the sum of each value over the node's subtree, the node included.

    ``nodes`` holds ``digest, depth, levels`` and the values; ``depth`` is the
    largest depth.  The value of a node goes to the ancestors of its block, and the
    total of a block's top to the block above.
    """
    size = block**level
    near = F.coalesce(F.try_element_at("levels", F.lit(level + 1)), F.expr("cast(array() as array<binary>)"))
    top = F.col("depth") % (size * block) == 0

    def total(rows):
        return rows.groupBy("digest").agg(*(F.sum(v).alias(v) for v in values))

    inside = total(nodes.select(F.explode(F.when(top, F.array("digest")).otherwise(F.concat(F.array("digest"), near))).alias("digest"), *values))
    if depth < size * block:
        return inside
    inside = materialise(inside, "inside")
    tops = nodes.where(top).select("digest", "depth", "levels").join(inside, "digest")
    above = materialise(subtree_sums(tops, values, depth, block, level + 1), "tops")
    below = nodes.where(top & (F.col("depth") > 0)).select("digest", near.alias("near")).join(above, "digest")
    return total(inside.unionByName(below.select(F.explode("near").alias("digest"), *values)))


def trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``turns`` holds ``conv_id, turn, role, text``; other columns are ignored.  Null
    roles and texts count as empty; turns come in order of ``turn``, nulls first,
    and turns of equal numbers in order of the SHA-256 of their role and text, so
    repeated rows are turns of their own.  Rows without a ``conv_id`` belong to no
    conversation.  A conversation whose rebuilt form has no turn is a member of the
    root and ends there.  An empty table has no node.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    spark = turns.sparkSession
    every = materialise(prefixes(turns, block), "prefixes")
    # all members of a node have its levels and its last text
    node = every.groupBy("depth", "digest").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.first("levels").alias("levels"))
    node = materialise(node.withColumn("parent", F.element_at(F.try_element_at("levels", F.lit(1)), -1)), "nodes")
    kids = node.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    known = node.join(kids, "digest", "left").select("digest", "depth", "levels", "parent", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    known = materialise(known.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")), "known")
    deepest = known.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    sums = subtree_sums(known, ["n_leaves", "saved_tokens"], deepest, block)
    parents = known.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = ends_digest(every.where("ends"))
    out = known.drop("n_leaves", "saved_tokens", "levels").join(sums, "digest").join(ends, "digest", "left").join(parents, "parent", "left")
    drop_path(spark, node)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
