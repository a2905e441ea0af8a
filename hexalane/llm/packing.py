"""Variable-capacity best-fit packing of documents into training sequences.

A document's length is its number of words (``[^\\x20\\x09-\\x0D]+``) unless a
length column is named.  Documents longer than the largest permitted sequence are
cut into pieces; nothing is dropped.  Pieces are dealt by a salted hash to groups of about
``GROUP`` pieces, and each group is packed on its own with bounded memory, so the
work spreads over any number of tasks whatever the lengths' distribution; a group
costs at most a few partly filled sequences.
"""

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import materialise

#: Permitted sequence lengths.
CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Cost of a sequence of c places: a fixed part, the places, and attention over them.
FIXED_COST, ATTENTION = 64.0, 1 / 16384
GROUP = 5_000
WORD = r"[^\x20\x09-\x0D]+"


def cost(capacity: int) -> float:
    return FIXED_COST + capacity + ATTENTION * capacity * capacity


def best_fit(lengths, sizes, price=cost, limit=None):
    """Bins for ``lengths`` given in falling order: ``(bin of each piece, [size of bin], [content of bin], total cost)``.

    A piece goes to the open bin that it leaves fullest; the older bin wins a
    tie.  If none has room, the permitted size of least price per place that
    holds the piece is opened, among those up to ``limit`` if the piece fits one
    of them, or else the least that holds it.  In the end each bin is downsized to the least
    permitted size that holds its contents.
    """
    by_room, rooms = {}, []
    where, room, size = [], [], []
    unit = sorted((c for c in sizes if limit is None or c <= limit), key=lambda c: (price(c) / c, -c))
    for length in lengths:
        k = bisect_left(rooms, length)
        if k == len(rooms):
            b = len(size)
            size.append(next((c for c in unit if c >= length), None) or next(c for c in sizes if c >= length))
            left = size[b] - length
        else:
            r = rooms[k]
            waiting = by_room[r]
            b = waiting.pop(0)
            if not waiting:
                del by_room[r]
                rooms.pop(k)
            left = r - length
        where.append(b)
        if b == len(room):
            room.append(left)
        else:
            room[b] = left
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            insort(by_room[left], b)
    used = [s - r for s, r in zip(size, room)]
    final = [next(c for c in sizes if c >= u) for u in used]
    return where, final, used, sum(map(price, final))


def pack_group(lengths, capacities=CAPACITIES, price=cost):
    """The cheapest of the packings that open sizes up to each permitted one in turn; the smaller limit wins a tie."""
    return min((best_fit(lengths, capacities, price, limit) for limit in capacities), key=lambda packed: packed[3])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, largest: int = CAPACITIES[-1]) -> DataFrame:
    """``doc_id, piece, start, length`` with ``length`` at most ``largest``; texts without words give one piece of length 0."""
    length = F.col(length_col).cast("long") if length_col else F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(length, F.lit(0)).alias("total"))
    count = F.greatest(F.ceil(F.col("total") / largest), F.lit(1)).cast("int")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("piece").cast("long") * largest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(largest), F.col("total") - start).alias("length"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, capacities: tuple = CAPACITIES, group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, bin_size, bin_used, bin_offset`` for every piece of every row.

    Null texts and texts without words have one piece of length 0 that lies in no
    bin (null ``bin_id``).  Repeated rows and null ids are packed as often as they
    occur, and dealt like any others: the hash that deals pieces to groups takes in
    a row's place in the input.  Equal lengths are taken by id, then piece.  Long
    texts are cut.  An empty table gives no rows; other columns are ignored.
    """
    cut = pieces(docs, id_col, text_col, length_col, capacities[-1]).withColumn("turn", F.monotonically_increasing_id())
    cut = materialise(cut, "pieces")
    filled = cut.where("length > 0")
    groups = max(1, -(-filled.count() // group))
    sizes = tuple(sorted(capacities))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        where, size, used, _ = pack_group(pdf["length"].tolist(), sizes)
        pdf["b"] = where
        pdf["bin_size"] = pdf["b"].map(dict(enumerate(size)))
        pdf["bin_used"] = pdf["b"].map(dict(enumerate(used)))
        pdf["bin_offset"] = pdf.groupby("b")["length"].cumsum() - pdf["length"]
        pdf["bin_id"] = pdf["g"] * (1 << 32) + pdf["b"]
        return pdf[["doc_id", "piece", "start", "length", "bin_id", "bin_size", "bin_used", "bin_offset"]]

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, bin_id long, bin_size long, bin_used long, bin_offset long"
    dealt = filled.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "turn"), F.lit(groups)))
    packed = dealt.groupBy("g").applyInPandas(run, schema)
    nothing = cut.where("length = 0").select("doc_id", "piece", "start", "length", *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_size", "bin_used", "bin_offset")])
    return packed.unionByName(nothing)
