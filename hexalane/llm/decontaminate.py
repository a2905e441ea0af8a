"""Benchmark passages in documents by Wu-Manber multi-pattern search.

The symbols of the search are words: a text is its sequence of folded words, a
pattern is a window of an item.  For the patterns of one length:

* a **shift table**, indexed by the hash of a block of words, holds how far a
  search may move on when it sees that block at the end of its frame: blocks of
  no pattern skip almost a whole pattern, and the words between are never hashed;
* a frame whose block ends some pattern (shift 0) looks into the **bucket of that
  suffix** for the patterns that also begin with the frame's first block;
* **direct comparison** of the words' bytes confirms each occurrence.

All frames of a block of texts move at once: a text is cut into lanes, and every
lane takes one step of its own shift per round, so a long text is many lanes.

The windows of a benchmark are dealt to tables of bounded size.  Documents are
searched for one table per pass and no row is shuffled; what a pass finds
travels with the row.
"""

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .bytewords import LOWER, NON_WORD, Powers, Words, blocks, mix, text_buffers, tidy
from .work import drop_path, materialise

#: Words of a window.
WIDTH = 10
#: Windows and bytes of a table of patterns: what a pass broadcasts.
TABLE_WINDOWS, TABLE_BYTES = 200_000, 32 << 20
#: Frames of a lane, and occurrences whose bytes are compared at once.
LANE, COMPARED = 64, 1 << 13
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Columns that a search adds.
FOUND = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))), StructField("items", ArrayType(StringType()))])


def windows(items: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """Distinct windows of the items: ``window, n, items``; words are joined by single spaces, ``n`` counts them.

    ``items`` lists the ids, as strings, of the items that hold the window; an
    item without an id gives windows and no id.  A null text gives nothing.
    """
    words = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, SMALL), F.lit(WORDS), F.lit(0))
    cut = items.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).where("size(w) > 0")
    each = cut.select("item", "w", F.explode(F.expr(f"sequence(1, greatest(size(w) - {width - 1}, 1))")).alias("i"))
    each = each.select("item", F.array_join(F.slice("w", F.col("i"), width), " ").alias("window"))
    return each.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("n", F.size(F.split("window", " ")))


def _add(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _both(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return _add(_add(np.zeros(len(suffix), np.uint64), suffix), prefix)


class Patterns:
    """Shift table and suffix buckets of windows of one length ``m``, over blocks of ``b`` words."""

    def __init__(self, m: int, texts: list[bytes], ids: np.ndarray, powers: Powers):
        self.m, self.b, self.ids = m, 2 if m > 3 else 1, ids
        offsets = np.cumsum([0] + [len(t) for t in texts])
        self.words = Words(np.frombuffer(b"".join(texts), np.uint8), offsets, powers, NON_WORD, LOWER)
        first = self.words.first[:-1]
        h = self.words.hashes()
        places = m - self.b + 1
        grid = np.zeros((places, len(texts)), np.uint64)
        for q, j in itertools.product(range(places), range(self.b)):
            grid[q] = _add(grid[q], h[first + q + j])
        bits = max(12, int(len(texts) * places * 8).bit_length())
        self.low = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, places, np.uint8)
        for q in range(places):  # a block that ends q blocks into a pattern lets the frame move to that pattern's end
            np.minimum.at(self.shift, (grid[q] >> self.low).astype(np.int64), np.uint8(places - 1 - q))
        self.suffix = np.unique(grid[-1])
        key = _both(grid[-1], grid[0])
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def search(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of every occurrence, windows that run across texts left out."""
        m, b = self.m, self.b
        per = np.maximum(np.diff(text.first) - m + 1, 0)
        lanes = -(-per // LANE)
        row = np.repeat(np.arange(len(per)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = text.first[row] + nth * LANE
        end = np.minimum(at + LANE, text.first[row] + per[row])
        hits = []
        while len(at):
            tail = at + m - b
            h = np.zeros(len(at), np.uint64)
            for j in range(b):
                h = _add(h, text.span_hash(text.start[tail + j], text.end[tail + j]))
            step = self.shift[(h >> self.low).astype(np.int64)].astype(np.int64)
            looks = np.flatnonzero(step == 0)
            if len(looks):
                hits.append(self._confirm(text, at[looks], h[looks]))
            at = at + np.maximum(step, 1)
            going = at < end
            at, end = at[going], end[going]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in hits]), np.concatenate([y for _, y in hits])

    def _confirm(self, text: Words, at: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The frames at ``at``, whose last blocks are ``suffix``, that equal a pattern, and that pattern."""
        place = np.minimum(np.searchsorted(self.suffix, suffix), len(self.suffix) - 1)
        ends = self.suffix[place] == suffix
        at, suffix = at[ends], suffix[ends]
        head = np.zeros(len(at), np.uint64)
        for j in range(self.b):
            head = _add(head, text.span_hash(text.start[at + j], text.end[at + j]))
        key = _both(suffix, head)
        place, last = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        found_at, found = [at[:0]], [at[:0]]
        while len(at):
            left = place < last
            at, place, last = at[left], place[left], last[left]
            pattern = self.order[place]
            equal = self._equal(text, at, pattern)
            found_at.append(at[equal])
            found.append(pattern[equal])
            place = place + 1
        return np.concatenate(found_at), np.concatenate(found)

    def _equal(self, text: Words, at: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        """Whether the words from ``at`` on are those of ``pattern``, byte for byte."""
        a = at[:, None] + np.arange(self.m)
        p = self.words.first[pattern][:, None] + np.arange(self.m)
        size = text.end[a] - text.start[a]
        same = (size == self.words.end[p] - self.words.start[p]).all(axis=1)
        for i in range(0, len(at), COMPARED):
            rows = i + np.flatnonzero(same[i : i + COMPARED])
            n = size[rows].ravel()
            row, step = np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            other = LOWER[text.data[text.start[a[rows]].ravel()[row] + step]] != self.words.data[self.words.start[p[rows]].ravel()[row] + step]
            same[rows[row[other] // self.m]] = False
        return same


class Table:
    """The patterns of one pass: windows by their number of words, and the items of each."""

    def __init__(self, rows: list[tuple[str, int, list[str]]]):
        self.rows = rows

    def build(self) -> tuple[list[Patterns], list[list[str]]]:
        powers, lengths = Powers(), {}
        for k, (_, n, _) in enumerate(self.rows):
            lengths.setdefault(n, []).append(k)
        return [Patterns(n, [self.rows[k][0].encode() for k in ks], np.array(ks), powers) for n, ks in sorted(lengths.items())], [items for _, _, items in self.rows]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as disjoint spans that do not touch, in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def _pass(table, names: list[str], text_at: int, found_at: int | None, kept: list[int]) -> Callable:
    """Search every row for the patterns of ``table``; ``found_at`` is the column of earlier passes, ``kept`` go on."""
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def run(batches):
        powers = Powers()
        patterns, items = table.value.build()
        for batch in batches:
            data, offsets = text_buffers(batch.column(text_at))
            before = batch.column(found_at).to_pylist() if found_at is not None else None
            out = []
            for a, b in blocks(offsets):
                text = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], powers, NON_WORD, LOWER)
                hit = [(at, at + p.m, p.ids[k]) for p in patterns for at, k in [p.search(text)]]
                start, end, which = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*hit)) if hit else [np.zeros(0, np.int64)] * 3
                order = np.argsort(start, kind="stable")
                start, end, which = start[order], end[order], which[order]
                cut = np.searchsorted(start, text.first)
                for i in range(b - a):
                    own, first = slice(cut[i], cut[i + 1]), int(text.first[i])
                    old = before[a + i] if before else {"spans": [], "items": []}
                    if cut[i] == cut[i + 1]:
                        out.append({"n_words": int(text.first[i + 1]) - first, "spans": old["spans"], "items": old["items"]})
                        continue
                    s, e = merged(np.append(start[own] - first, [x["start"] for x in old["spans"]]).astype(np.int64), np.append(end[own] - first, [x["end"] for x in old["spans"]]).astype(np.int64))
                    held = set(old["items"]).union(*(items[w] for w in np.unique(which[own])))
                    out.append({"n_words": int(text.first[i + 1]) - first, "spans": [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())], "items": sorted(held)})
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(out, kind)], names=[*(names[i] for i in kept), "__found"])

    return tidy(run)


def search(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, table_windows: int = TABLE_WINDOWS, table_bytes: int = TABLE_BYTES, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and ``__found``: ``n_words``, the hit ``spans`` and the ids of the ``items`` found.

    A span is a range of word positions, end exclusive; spans of a document are
    disjoint, in order, and cover exactly the words inside an occurrence of a
    window.  Items come as distinct strings in order.  Null and empty texts have
    no words and no hits; a null, empty or wordless item is found nowhere; items of
    fewer than ``width`` words are one window.  Repeated documents are searched as
    often as they occur, repeated items count once.  No items or no documents give
    empty results of the same columns.  ``docs`` must not hold a column ``__found``.

    Windows beyond ``table_windows`` or ``table_bytes`` are dealt by their hash to
    further tables, each searched in a pass of its own, so a broadcast is bounded
    whatever the size of the benchmark.
    """
    spark = docs.sparkSession
    patterns = materialise(windows(items, id_col, item_text_col, width), "windows")
    n, size = patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window") + F.expr("aggregate(items, 0L, (s, x) -> s + octet_length(x))")), F.lit(0))).first()
    tables = max(1, -(-n // table_windows), -(-size // table_bytes))
    names = docs.columns
    before, found = None, docs
    for k in range(tables):
        last = k + 1 == tables
        rows = patterns.where(F.pmod(F.xxhash64("window"), F.lit(tables)) == k).select("window", "n", "items").collect()
        table = spark.sparkContext.broadcast(Table([(r["window"], r["n"], list(r["items"])) for r in rows]))
        kept = [i for i, name in enumerate(names) if not last or keep is None or name in keep]
        schema = StructType([*(docs.schema.fields[i] for i in kept), StructField("__found", FOUND)])
        found = found.mapInArrow(_pass(table, names, names.index(text_col), len(names) if k else None, kept), schema)
        if not last:  # the next pass has its own table in memory, so it starts when this one is done
            found = materialise(found, "searched")
            if before is not None:
                drop_path(spark, before)
            before = found
    drop_path(spark, patterns)
    return found


def verdicts(found: DataFrame) -> DataFrame:
    """The columns of the documents with ``n_words, n_hit, n_items, items_sha256, contaminated`` in place of ``__found``."""
    hit = F.expr("aggregate(__found.spans, 0L, (s, x) -> s + x.end - x.start)")
    return found.select(
        *[c for c in found.columns if c != "__found"], F.col("__found.n_words").alias("n_words"), hit.alias("n_hit"), F.size("__found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__found.items", ","), 256).alias("items_sha256"), (F.size("__found.spans") > 0).alias("contaminated"),
    )
