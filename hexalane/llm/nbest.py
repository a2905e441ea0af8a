"""N-best SentencePiece segmentation, and decoding.

The pieces of a vocabulary form a lattice over a text.  Forward Viterbi gives, for
every position, the best score of reaching it; these are exact heuristics for an
A-star search that walks backward from the end, so hypotheses leave the agenda in
order of their full score.

No piece continues past a space that follows other characters, so the lattice of
a text is a chain of small lattices, one per *chunk* (spaces and the characters up
to the next space), and equal chunks have equal lattices.  The forward pass, with
the score gap to a chunk's second-best path, runs in numpy over many distinct
chunks at once.  A text's *n* best segmentations can only
differ from its best in the ``n - 1`` chunk occurrences of smallest gap; the
backward A-star search runs in those, and a second A-star search over the chain
picks the *n* best combinations.  Both are exact.

Scores: a unigram model's own log-probabilities.  A BPE model's file holds merge
ranks instead; it gets Zipf log-probabilities ``-log(rank + 1) - log(H)`` with
``H`` the sum of ``1 / (rank + 1)``, which makes it a unigram model without training.
Characters that no piece covers fall back to byte pieces at ``UNKNOWN`` below the
least score.  A literal U+2581 is written in bytes, too, so decoding is exact.
"""

import heapq
import math
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import Powers, blocks, mix, text_buffers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = 10.0
MARK = "▁"


@dataclass
class Vocabulary:
    """Pieces as byte strings (a space for U+2581), their scores, and the ids of the 256 byte pieces (or of the unknown piece)."""

    pieces: list
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown_score: float


def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file (read on the driver; tasks get it as a broadcast)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, byte_ids = [], [], np.full(256, max(model.unk_id(), 0))
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            pieces.append(None)
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(None)
        else:
            pieces.append(piece.replace(MARK, " ").encode())
        scores.append(model.get_score(i))
    # the lattice of a text falls into chunks at spaces only if no piece goes on after one
    if any(p and b" " in p.lstrip(b" ") for p in pieces):
        raise ValueError(f"{path}: a piece holds a space between other characters")
    scores = np.array(scores)
    real = np.array([p is not None for p in pieces])
    if len(scores) and real.any() and scores[real].min() < -1000:  # merge ranks
        rank = np.empty(real.sum(), np.int64)
        rank[np.lexsort((np.flatnonzero(real), -scores[real]))] = np.arange(real.sum())
        scores[real] = -np.log(rank + 1.0) - math.log((1.0 / np.arange(1, real.sum() + 1)).sum())
    return Vocabulary(pieces, scores, byte_ids, float(scores[real].min() - UNKNOWN) if real.any() else -UNKNOWN)


class _Lookup:
    """Hash tables of pieces by byte length; :meth:`matches` finds the piece of each length at every byte of a block."""

    NONE, BYTES = -1, -2

    def __init__(self, vocabulary: Vocabulary, powers: Powers):
        self.powers = powers
        by_length = {length: [] for length in (1, 2, 3, 4)}  # a character may have to be spelt in bytes
        for i, p in enumerate(vocabulary.pieces):
            if p:
                by_length.setdefault(len(p), []).append(i)
        self.lengths = sorted(by_length)
        self.tables = []
        for length in self.lengths:
            ids = by_length[length]
            data = np.frombuffer(b"".join(vocabulary.pieces[i] for i in ids), np.uint8).reshape(-1, length)
            up, _ = powers.get(length + 1)
            h = mix(((data.astype(np.uint64) + np.uint64(1)) * up[:length]).sum(axis=1, dtype=np.uint64))
            order = np.argsort(h)
            self.tables.append((h[order], np.array(ids, np.int32)[order]))
        #: scores by piece; the last two are those of BYTES and NONE
        self.scores = np.concatenate([vocabulary.scores, [vocabulary.unknown_score, -np.inf]])

    def matches(self, data, limit):
        """For each length the piece that starts at each byte and ends at ``limit`` at most, or NONE; BYTES for a character without a piece."""
        n = len(data)
        up, down = self.powers.get(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        at = np.flatnonzero((data & 0xC0) != 0x80)  # pieces are whole characters, so they match at character starts only
        lead = data[at]
        width = np.minimum(1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), limit[at] - at)
        out = []
        for length, (hashes, own) in zip(self.lengths, self.tables):
            found = np.full(n, self.NONE, np.int32)
            room = limit[at] - at >= length
            at_, width_ = at[room], width[room]
            if len(hashes) and len(at_):
                h = mix((sums[at_ + length] - sums[at_]) * down[at_])
                k = np.searchsorted(hashes, h)
                k[k == len(hashes)] = 0
                found[at_] = np.where(hashes[k] == h, own[k], self.NONE)
            if length <= 4:
                bare = at_[(width_ == length) & (found[at_] == self.NONE)]
                found[bare] = self.BYTES
            out.append(found)
            at, width = at_, width_
        return out


def a_star(edges, forward, start: int, end: int, n: int):
    """Up to ``n`` best paths from ``start`` to ``end``: ``(score, ids of each edge)`` in falling order.

    ``edges(at)`` gives the edges that end at a position as ``(from, ids, score)``.
    Backward search: a hypothesis stands for the pieces from its position to the
    end; its priority is its own score plus the forward score of the position,
    which is exactly the best full score it can have.  Of equal priorities the one
    nearest to the start goes on, then the one met first.  Hypotheses share their
    tails, and no position is left more than ``n`` times: paths through any further
    one are no better than those ``n``.
    """
    agenda, out, left, met = [(-forward(end), end, 0, 0.0, None)], [], {}, 0
    while agenda and len(out) < n:
        full, at, _, done, tail = heapq.heappop(agenda)
        if left.get(at, 0) == n:
            continue
        left[at] = left.get(at, 0) + 1
        if at == start:
            path = []
            while tail is not None:
                path.append(tail[0])
                tail = tail[1]
            out.append((-full, path))
            continue
        for a, ids, s in edges(at):
            met += 1
            heapq.heappush(agenda, (-(done + s + forward(a)), a, met, done + s, (ids, tail)))
    return out


#: Distinct chunks whose best paths a task keeps (some 100 bytes each), bytes of new chunks looked at together, and bytes of text per block.
KEPT, TOGETHER, BLOCK = 200_000, 1 << 17, 1 << 18
#: Bytes of a chunk from which it is looked at on its own, and ids of best paths that a task keeps.
LONG, KEPT_IDS = 256, 4_000_000


class _Coder:
    """Segments blocks of texts; keeps the best paths of the chunks it has met, and the n best of those that A-star has searched."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.v, self.n, self.powers = vocabulary, n, Powers()
        self.lookup = _Lookup(vocabulary, self.powers)
        self.by_piece = {p: i for i, p in enumerate(vocabulary.pieces) if p}
        self._forget()

    def _forget(self):
        """Empty the caches: a chunk that left them is looked at again."""
        self.known, self.paths = {}, {}
        self.best, self.gap, self.flat, self.ends = np.zeros(0), np.zeros(0), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def block(self, data, offsets):
        """For each text of a block, up to ``n`` pairs of score and ids."""
        rows = len(offsets) - 1
        # a space before every text that is not empty (the dummy prefix)
        filled = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[filled], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        space = data == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(data))
        if not len(start):
            return [[(0.0, np.zeros(0, np.int32))] for _ in range(rows)]
        up, down = self.powers.get(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        key = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        keys, sample, kind = np.unique(key, return_index=True, return_inverse=True)
        kind = self._slots(keys, data, start[sample], end[sample])[kind]
        chunk = np.searchsorted(start, offsets)
        sizes = np.diff(self.ends)[kind]
        place = np.concatenate([[0], np.cumsum(sizes)])
        # the best ids of all chunks of the block, by one gather
        flat = self.flat[np.repeat(self.ends[kind] - place[:-1], sizes) + np.arange(place[-1])]
        out = []
        for r in range(rows):
            a, b = chunk[r], chunk[r + 1]
            if a == b:
                out.append([(0.0, np.zeros(0, np.int32))])
                continue
            one = flat[place[a] : place[b]]
            results = [(float(self.best[kind[a:b]].sum()), one)]
            if self.n > 1:
                results = self._variants(results[0][0], one, self.gap[kind[a:b]], place[a : b + 1] - place[a], data, start[a:b], end[a:b])
            out.append(results)
        return out

    def _slots(self, keys, data, start, end):
        """Places of chunks in the caches; chunks not met before are looked at, some bytes together."""
        if len(self.known) + len(keys) > KEPT or len(self.flat) > KEPT_IDS:
            self._forget()
        known = self.known.get
        slot = np.array([known(k, -1) for k in keys.tolist()], np.int64)
        for i in np.flatnonzero((slot < 0) & (end - start > LONG)):
            best, gap, ids = self._long(data[start[i] : end[i]].tobytes())
            slot[i] = self.known[int(keys[i])] = len(self.best)
            self.best, self.gap = np.append(self.best, best), np.append(self.gap, gap)
            self.ends, self.flat = np.append(self.ends, len(self.flat) + len(ids)), np.concatenate([self.flat, ids])
        new = np.flatnonzero(slot < 0)
        turn = np.cumsum(end[new] - start[new]) // TOGETHER
        for part in np.split(new, np.flatnonzero(np.diff(turn)) + 1):
            if not len(part):
                continue
            best, gap, ids, ends = self._chunks(data, start[part], end[part])
            slot[part] = len(self.best) + np.arange(len(part))
            self.known.update(zip(keys[part].tolist(), slot[part].tolist()))
            self.best, self.gap = np.concatenate([self.best, best]), np.concatenate([self.gap, gap])
            self.ends = np.concatenate([self.ends, ends[1:] + len(self.flat)])
            self.flat = np.concatenate([self.flat, ids])
        return slot

    def _chunks(self, data, start, end):
        """Best score, gap to the second-best path, and best ids of each chunk.

        Forward Viterbi with the two best scores of every position; all chunks
        advance together, longest first, so that those still running are a prefix.
        Equal scores go to the shortest last piece.
        """
        order = np.argsort(start - end, kind="stable")
        size = (end - start)[order]
        at = np.concatenate([[0], np.cumsum(size)])
        joined = data[np.repeat(start[order] - at[:-1], size) + np.arange(at[-1])]
        lengths, pieces, scores = self.lookup.lengths, self.lookup.matches(joined, np.repeat(at[1:], size)), self.lookup.scores
        running = np.searchsorted(-size, -np.arange(size[0] + 1), "right")  # chunks of d bytes at least
        node = at[:-1] + np.arange(len(size))  # a chunk has one position more than bytes
        one = np.full(at[-1] + len(size), -np.inf)
        two, back = one.copy(), np.zeros(len(one), np.int16)
        one[node] = 0.0
        for d in range(1, int(size[0]) + 1):
            m = running[d]
            best, second, arg = np.full(m, -np.inf), np.full(m, -np.inf), np.zeros(m, np.int16)
            for j, length in enumerate(lengths):
                if length > d:
                    break
                gain = scores[pieces[j][at[:m] + (d - length)]]
                source = node[:m] + (d - length)
                first, other = one[source] + gain, two[source] + gain
                second = np.maximum(np.maximum(second, other), np.minimum(best, first))
                arg[first > best] = j
                best = np.maximum(best, first)
            one[node[:m] + d], two[node[:m] + d], back[node[:m] + d] = best, second, arg
        goal = node + size
        with np.errstate(invalid="ignore"):
            gap = np.maximum(one[goal] - two[goal], 0.0)
        # walk back from all goals in step; a character without a piece gives its bytes
        taken, depth, live = [], size.copy(), np.arange(len(size))
        count = np.zeros(len(size), np.int64)
        width_of = np.array(lengths)
        while len(live):
            j = back[node[live] + depth[live]]
            depth[live] -= width_of[j]
            source = at[live] + depth[live]
            piece = np.empty(len(live), np.int32)
            for k in np.unique(j):
                piece[j == k] = pieces[k][source[j == k]]
            n = np.where(piece == self.lookup.BYTES, width_of[j], 1)
            count[live] += n
            taken.append((live, piece, n, source))
            live = live[depth[live] > 0]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids, tail = np.empty(ends[-1], np.int32), ends[1:].copy()
        for live, piece, n, source in taken:
            tail[live] -= n
            whole = piece != self.lookup.BYTES
            ids[tail[live[whole]]] = piece[whole]
            for k in range(4):
                spelt = ~whole & (n > k)
                ids[tail[live[spelt]] + k] = self.v.byte_ids[joined[source[spelt] + k]]
        # back in the order of the arguments
        place = np.argsort(order, kind="stable")
        sizes = count[place]
        final = np.concatenate([[0], np.cumsum(sizes)])
        return one[goal][place], gap[place], ids[np.repeat(ends[:-1][place] - final[:-1], sizes) + np.arange(final[-1])], final

    def _edges(self, name: bytes):
        """The edges of a chunk's lattice that end at a position, shortest first; a character without a piece is spelt in bytes."""
        lengths, piece, scores, byte_ids, unknown = self.lookup.lengths, self.by_piece.get, self.v.scores, self.v.byte_ids, self.v.unknown_score

        def at(b: int):
            if b < len(name) and name[b] & 0xC0 == 0x80:
                return
            for length in lengths:
                a = b - length
                if a < 0:
                    return
                if (i := piece(name[a:b])) is not None:
                    yield a, (i,), float(scores[i])
                elif length <= 4 and name[a] & 0xC0 != 0x80 and length == 1 + (name[a] >= 0xC0) + (name[a] >= 0xE0) + (name[a] >= 0xF0):
                    yield a, tuple(int(byte_ids[x]) for x in name[a:b]), unknown

        return at

    def _forward(self, name: bytes):
        """Best and second-best score of reaching every position of a chunk, and the length of the last piece of the best."""
        none = array("d", [-math.inf])
        one, two, back, edges = none * (len(name) + 1), none * (len(name) + 1), array("i", [0]) * (len(name) + 1), self._edges(name)
        one[0] = 0.0
        for b in range(1, len(name) + 1):
            best = second = -math.inf
            for a, _, s in edges(b):
                first, other = one[a] + s, two[a] + s
                if first > best:
                    best, second, back[b] = first, max(best, other), b - a
                else:
                    second = max(second, first, other)
            one[b], two[b] = best, second
        return one, two, back

    def _long(self, name: bytes):
        """Best score, gap to the second-best path, and best ids of one long chunk: one step per position, whatever else runs."""
        one, two, back = self._forward(name)
        edges, out, b = self._edges(name), [], len(name)
        while b:
            a = b - back[b]
            out.append(next(ids for x, ids, _ in edges(b) if x == a))
            b = a
        gap = max(one[-1] - two[-1], 0.0) if two[-1] > -math.inf else math.inf
        return one[-1], gap, np.array([i for ids in reversed(out) for i in ids], np.int32)

    def _search(self, name: bytes):
        """The n best paths of a chunk by backward A-star, as score losses and ids."""
        if name not in self.paths:
            one, _, _ = self._forward(name)
            found = a_star(self._edges(name), one.__getitem__, 0, len(name), self.n)
            paths = [(found[0][0] - score, np.array([y for t in path for y in t], np.int32)) for score, path in found]
            if len(name) > LONG:
                return paths
            self.paths[name] = paths
        return self.paths[name]

    def _variants(self, top, one, own, place, data, start, end):
        """The n best segmentations of a text: A-star over the few chunk occurrences that can differ."""
        k = min(self.n - 1, len(own))
        border = np.partition(own, k - 1)[k - 1]
        near = np.flatnonzero(own < border)
        near = np.concatenate([near, np.flatnonzero(own == border)[: k - len(near)]])
        near = np.sort(near[np.isfinite(own[near])])
        choices = [self._search(data[start[c] : end[c]].tobytes()) for c in near]
        # hypotheses by loss; the loss of the chunks not yet decided is 0 at best, which is exact
        agenda, found = [(0.0, 0, ())], []
        while agenda and len(found) < self.n:
            loss, depth, picks = heapq.heappop(agenda)
            if depth == len(near):
                found.append((loss, picks))
                continue
            for p, (extra, _) in enumerate(choices[depth]):
                heapq.heappush(agenda, (loss + extra, depth + 1, (*picks, p)))
        out = []
        for loss, picks in found:
            parts, at = [], 0
            for c, paths, p in zip(near, choices, picks):
                if p:
                    parts += [one[at : place[c]], paths[p][1]]
                    at = place[c + 1]
            parts.append(one[at:])
            out.append((top - loss, np.concatenate(parts) if len(parts) > 1 else one))
        return out


#: Columns that encoding adds.
ADDED = ("rank", "score", "ids", "round_trip")


class _Decoder:
    """Bytes of piece ids; ids outside the vocabulary give nothing."""

    def __init__(self, v: Vocabulary):
        pieces = list(v.pieces)
        for byte, i in enumerate(v.byte_ids):
            pieces[i] = bytes([byte])
        pieces = [p or b"" for p in pieces] + [b""]
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([len(p) for p in pieces])
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def raw(self, flat, ends):
        """The bytes of all ids together, and where each list of them ends in those."""
        last = len(self.size) - 1
        flat = np.where((flat >= 0) & (flat < last), flat, last)
        size = self.size[flat]
        place = np.concatenate([[0], np.cumsum(size)])
        return self.data[np.repeat(self.start[flat] - place[:-1], size) + np.arange(place[-1])].tobytes(), place[ends]


def encode(docs: DataFrame, vocabulary: Vocabulary, n: int = 3, text_col: str = "text", keep: tuple | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all of them if not named) and ``rank`` (from 1), ``score``, ``ids``, ``round_trip``: up to ``n`` rows per input row.

    A null or empty text has one segmentation, the empty one, of score 0; an empty
    table gives no rows.  Long texts without spaces are one chunk each: time and
    memory grow with its length.  A text
    with fewer than ``n`` segmentations gives what it has.  Of equal scores of one
    chunk the best path has the shorter last pieces, and the others come as the
    search meets them, shorter last pieces first.
    ``round_trip`` tells whether the ids decode to the text, byte for byte.  Columns
    of ``docs`` with the names of the added ones give way to them.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    kept = docs.select(*names, F.col(text_col).cast("string").alias("__text"))
    at = len(names)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    added = [T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType([*kept.schema.fields[:-1], *added])

    def run(batches):
        coder, decoder = _Coder(shared.value, n), _Decoder(shared.value)
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            own = batch.select(range(at))
            for a, b in blocks(offsets, BLOCK):
                coded = coder.block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row = np.repeat(np.arange(a, b), [len(x) for x in coded])
                flat = [y for x in coded for y in x]
                ends = np.concatenate([[0], np.cumsum([len(ids) for _, ids in flat])]).astype(np.int32)
                ids = np.concatenate([ids for _, ids in flat])
                raw, bounds = decoder.raw(ids, ends)
                texts = [data[offsets[r] : offsets[r + 1]].tobytes() for r in range(a, b)]
                same = [raw[x:y] == (b" " + texts[r - a] if texts[r - a] else b"") for r, x, y in zip(row.tolist(), bounds.tolist(), bounds[1:].tolist())]
                rank = pa.array([r for x in coded for r in range(1, len(x) + 1)], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*own.take(pa.array(row)).columns, rank, pa.array([s for s, _ in flat], pa.float64()), lists, pa.array(same)], names=[*names, "rank", "score", "ids", "round_trip"])

    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the text of each row's ids, without the dummy prefix; null ids give null, unknown ids nothing."""
    coded = coded.drop("decoded")
    names = coded.columns
    at = names.index(ids_col)
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        decoder = _Decoder(shared.value)
        for batch in batches:
            column = batch.column(at)
            counts = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
            raw, bounds = decoder.raw(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(counts)]))
            texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(bounds, bounds[1:])]
            texts = [None if not ok else t[1:] if t[:1] == " " else t for t, ok in zip(texts, column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return coded.mapInArrow(run, schema)
