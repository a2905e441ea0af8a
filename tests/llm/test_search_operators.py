"""Hard negatives, prefix trie and decontamination against SQL and brute force; edge cases of each."""

import glob
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hexalane.llm import decontaminate, hard_negatives, prefix_trie, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EMPTY = hashlib.sha256(b"").hexdigest()


def rows_of(frame):
    return sorted(map(tuple, frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_prefix_trie", "op13_decontaminate"])
def test_queries_equal_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = queries.queries()[name](spark, folder).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert len(want) and rows_of(got) == rows_of(want)


# hard negatives


def mined(rows, positives=5, negatives=3, least=50, most=95):
    """By scoring all pairs: rows are (id, label, vector)."""
    out = []
    for i, a, va in rows:
        if i % 50:
            continue
        score = lambda v: sum(x * y for x, y in zip(va, v))
        own = sorted((-score(v), j) for j, b, v in rows if b == a and j != i and len(v) == len(va))[:positives]
        for p, j in own:
            inside = sorted((-score(v), k) for k, b, v in rows if b != a and len(v) == len(va) and least * -p <= 100 * score(v) <= most * -p)
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k) in enumerate(inside[:negatives])]
    return sorted(out)


def integers(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, v array<long>")


@pytest.mark.parametrize("cells, block, spread", [(64, 1024, 100), (3, 4, 5), (256, 7, 100_000)])
def test_mining_equals_all_pairs(spark, cells, block, spread):
    """Coarse and fine cells, several blocks of anchors, ties, negative scores, repeated rows, and components beyond 32-bit bounds."""
    r = np.random.default_rng(5)
    rows = [(i, int(r.integers(3)), [int(x) for x in r.integers(-spread, spread, 8)]) for i in range(0, 1500, 5)]
    rows += [(100, 1, [0] * 8), (101, 2, [0] * 8), (150, 1, [spread] * 8), (1501, 2, [spread - 1] * 8), *rows[10:20]]
    got = hard_negatives.mine(integers(spark, rows).repartition(7), F.col("id") % 50 == 0, cells=cells, block=block)
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_mining_of_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, label int, id string, row int"
    nan, inf = float("nan"), float("inf")
    raw = [
        (0, [1.0, 0.5], 1, "x", 1), (50, None, 1, "x", 1), (100, [nan, 1.0], 1, "x", 1), (150, [inf, 1.0], 1, "x", 1), (200, [None, 1.0], 1, "x", 1), (250, [1.0, 1.0], None, "x", 1),
        (None, [1.0, 1.0], 1, "x", 1), (2, [1.0, 0.25], 1, "x", 1), (3, [0.5, 0.5], 2, "x", 1), (4, [0.5, 0.5], 2, "x", 1), (5, [0.5, 0.5, 9.0], 2, "x", 1), (300, [], 1, "x", 1), (301, [], 1, "x", 1), (302, [], 2, "x", 1), (6, [3e38, 1.0], 2, "x", 1),
    ]
    usable = hard_negatives.usable(spark.createDataFrame(raw, schema), "vec_id", "embedding", F.col("label"))
    kept = [(r["id"], r["label"], list(r["v"])) for r in usable.collect()]
    assert sorted(i for i, _, _ in kept) == [0, 2, 3, 4, 5, 300, 301, 302]
    got = sorted(map(tuple, hard_negatives.mine(usable, F.col("id") % 50 == 0).collect()))
    assert got == mined(kept) and (0, 2, 1, 3, 73728, 49152) in got and (300, 301, 1, 302, 0, 0) in got
    assert hard_negatives.mine(integers(spark, []), F.col("id") % 50 == 0).count() == 0
    assert hard_negatives.mine(integers(spark, [(1, 1, [1])]), F.col("id") % 50 == 0).count() == 0


def test_bounds_hold_for_every_row(spark):
    r = np.random.default_rng(2)
    rows = [(i, 0, [int(x) for x in r.integers(-90, 300, 16)]) for i in range(200)]
    file, low, width = hard_negatives.filed(integers(spark, rows), 16, 16)
    anchors = hard_negatives.Anchors(file.where("id < 20").orderBy("id").toArrow(), low, width, 16)
    table = file.orderBy("id").toArrow()
    lower = anchors.lower(np.stack([np.frombuffer(x, np.uint8) for x in table["cells"].to_pylist()]).T.copy(), np.arange(20))
    v = np.array([x[2] for x in rows])
    exact = v[:20] @ v.T
    assert (lower <= exact).all() and (exact <= lower + anchors.gap[:, None]).all()


# prefix trie

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    told = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    told = {c: [x[3:] for x in sorted(t)] for c, t in told.items()}
    out = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = told.get(base, [])[:h] + own[h:]
    return out


def nodes_of(convs):
    members, last = {}, {}
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members)]
        ended = sorted(c for c in own if len(convs[c]) == len(key))
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), sum(len(k) == len(key) + 1 for k in below), len(leaves), saved, hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2, 3, 16])
def test_trie_equals_brute_force(spark, block):
    """Long and turnless conversations, negative ids, null and repeated turns, null roles and texts, absent bases; blocks so small that tops form levels."""
    r = np.random.default_rng(9)
    rows = [(int(c), int(t), ("user", "assistant", None)[t % 3], f"t{r.integers(2)}" if t else None) for c in range(-12, 40) for t in range(int(r.integers(1, 14)))]
    rows += [(3, None, "user", "first"), (3, 2, "user", "again"), (3, 2, "user", "again"), (3, 2, None, None), (None, 1, "user", "nobody"), (55, 1, "user", "é"), (61, 0, "user", ""), (1003, 0, "x", "one")]
    rows = [x for x in rows if x[0] not in (20, -5)]
    turns = spark.createDataFrame(rows, TURNS).withColumn("digest", F.lit("clash")).withColumn("depth", F.lit(1)).repartition(5)
    got = sorted(map(tuple, prefix_trie.trie(turns, block).collect()), key=str)
    assert got == nodes_of(rebuilt(rows))


def test_trie_of_one_long_conversation_and_of_nothing(spark):
    """A node of a conversation of 700 turns is exploded to a block of ancestors at most per level."""
    rows = [(0, t, "user", f"turn {t}") for t in range(700)]
    turns = spark.createDataFrame(rows, TURNS)
    longest = prefix_trie.prefixes(turns, 4).select(F.max(F.size(F.flatten("levels")))).first()[0]
    assert longest <= 4 * 5
    got = {r["depth"]: r for r in prefix_trie.trie(turns, 4).collect()}
    assert len(got) == 701 and all(r["n_leaves"] == 1 and r["saved_tokens"] == 0 for r in got.values())
    assert got[700]["ends_sha256"] == hashlib.sha256(b"0").hexdigest() and got[0]["ends_sha256"] == EMPTY
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0


def test_ends_of_a_node_stream_over_runs(spark, monkeypatch):
    """Most conversations end at one node; its ids come in sorted runs from many tasks."""
    monkeypatch.setattr(prefix_trie, "RUN", 100)
    ended = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.lit(b"b")).otherwise(F.lit(b"a")).alias("digest"), F.col("id").alias("conv_id"))
    got = {bytes(r["digest"]): r["ends_sha256"] for r in prefix_trie.ends_digest(ended.repartition(8)).collect()}
    want = {k: hashlib.sha256(",".join(str(i) for i in range(5000) if (i % 10 == 0) == (k == b"b")).encode()).hexdigest() for k in (b"a", b"b")}
    assert got == want


# decontamination


def searched(docs, items, width=10):
    fold = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    window = {}
    for item, text in items:
        w = fold(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            window.setdefault(tuple(w[i : i + width]), set()).update({str(item)} - {"None"})
    lengths, out = {len(k) for k in window}, []
    for doc, text in docs:
        w, hit, found = fold(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (own := window.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("table_windows", [200_000, 40])
def test_search_equals_brute_force(spark, table_windows):
    """Items of every length from one word on, shared and self-overlapping windows, hits at both ends and across lanes, one table and several."""
    r = np.random.default_rng(4)
    words = ["a", "B", "c", "Éa", "d9", "x"]
    say = lambda n, of=words: " ".join(of[k] for k in r.integers(0, len(of), n))
    items = [(i, say(int(n), words[:3])) for i, n in enumerate([*range(1, 9), 9, 10, 11, 30, 40])] + [(99, "a " * 25), (98, "a " * 25), (None, "no id at all"), (7, None), (8, ""), (9, " .,! "), (10, "qq rr ss tt uu vv ww xx yy zz aa")]
    items = [x for x in items if x[0] not in (0, 1, 2)]
    docs = [(i, say(int(n), words[: 3 + i % 4])) for i, n in enumerate(r.integers(0, 400, 60))]
    docs += [(100, None), (101, ""), (102, "..."), (103, "a " * 70), (104, "qq, rr-SS tt uu vv ww xx yy zz"), (104, "qq, rr-SS tt uu vv ww xx yy zz"), (105, "zz qq rr ss tt uu vv ww xx yy zz aa! end"), (106, "no id\x00AT all"), (None, "no id at all"), (107, "qq rr ss tt uu vv ww xx yy z z")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("clash"))
    found = decontaminate.search(table.repartition(3), bench, keep=("doc_id",), table_windows=table_windows)
    assert sorted(map(tuple, decontaminate.verdicts(found).collect()), key=str) == searched(docs, items)


def test_search_skips_and_handles_long_texts_and_nothing(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000)) + " qq rr ss tt uu vv ww xx yy zz"
    docs = spark.createDataFrame([(1, long), (2, "qq rr ss tt uu vv ww xx yy")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "qq rr ss tt uu vv ww xx yy zz")], "item_id long, text string")
    got = {r["doc_id"]: r["__found"] for r in decontaminate.search(docs, bench).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(30_000, 30_010)] and got[1]["n_words"] == 30_010 and got[1]["items"] == ["5"] and not got[2]["spans"]
    nothing = decontaminate.verdicts(decontaminate.search(docs, bench.limit(0))).collect()
    assert [(r["n_hit"], r["n_items"], r["contaminated"], r["items_sha256"]) for r in nothing] == [(0, 0, False, EMPTY)] * 2
    assert decontaminate.search(docs.limit(0), bench).count() == 0


def test_shift_table_skips_most_words():
    """Over text that shares no word pair with the patterns, a search looks at every ninth word."""
    from hexalane.llm.bytewords import LOWER, NON_WORD, Powers, Words

    powers = Powers()
    patterns = decontaminate.Patterns(10, [" ".join(f"p{i}" for i in range(k, k + 10)).encode() for k in range(40)], np.arange(40), powers)
    data = " ".join(f"t{i}" for i in range(900)).encode()
    text, seen = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), powers, NON_WORD, LOWER), []
    real = text.span_hash
    text.span_hash = lambda s, e: seen.append(len(s)) or real(s, e)
    assert len(patterns.search(text)[0]) == 0 and sum(seen) < 900 * 2 / 9 * 1.3


# n-best segmentation of texts without spaces


def test_nbest_of_one_long_chunk_grows_with_its_length():
    """300,000 letters without a space: the best three decode to the text, and memory stays far below a path per hypothesis."""
    import tracemalloc

    from hexalane.llm import nbest

    r = np.random.default_rng(1)
    v = nbest.load(nbest.MODEL)
    text = "".join("abcdefghij山川"[k] for k in r.integers(0, 12, 300_000)).encode()
    coder, decoder = nbest._Coder(v, 3), nbest._Decoder(v)
    tracemalloc.start()
    out = coder.block(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 3 and all(a >= b for (a, _), (b, _) in zip(out, out[1:])) and most < 1 << 30
    for _, ids in out:
        assert decoder.raw(ids, np.array([0, len(ids)]))[0] == b" " + text


def test_long_chunks_equal_the_vectorised_pass(monkeypatch):
    from hexalane.llm import nbest

    v = nbest.load(nbest.MODEL)
    r = np.random.default_rng(3)
    texts = ["".join("abcde é山▁\U0001f600"[k] for k in r.integers(0, 10, int(n))).encode() for n in r.integers(1, 600, 40)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    monkeypatch.setattr(nbest, "LONG", 1 << 30)
    want = nbest._Coder(v, 3).block(data, offsets)
    monkeypatch.setattr(nbest, "LONG", 3)
    got = nbest._Coder(v, 3).block(data, offsets)
    for a, b in zip(got, want):
        assert np.allclose([s for s, _ in a], [s for s, _ in b]) and (a[0][1] == b[0][1]).all()


def test_models_with_pieces_across_spaces_are_refused(monkeypatch):
    import sentencepiece

    from hexalane.llm import nbest

    class Model:
        def __init__(self, model_file):
            pass

        get_piece_size, unk_id, get_score, id_to_piece = lambda self: 1, lambda self: 0, lambda self, i: -1.0, lambda self, i: "a▁b"
        is_byte = is_control = is_unknown = is_unused = lambda self, i: False

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="space"):
        nbest.load("x")


# personal data in texts of very many entities and terms


def spans_of(row):
    return sorted((s["start"], s["end"], s["kind"], s["value"]) for s in row["extra"])


@pytest.fixture(scope="module")
def crowded(spark):
    """One text of 30,000 addresses and 30,000 rare terms, among texts of common words, some of which share addresses with it."""
    text = " ".join(f"u{i}@x{i}.org Rare{i}q" for i in range(30_000))
    rows = [(0, text), (1, text)] + [(10 + i, f"plain words of every day u{i}@x{i}.org {i % 7}") for i in range(300)] + [(1000 + i, f"plain words of every day {i}") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_text_of_many_entities_and_terms(crowded):
    from hexalane.llm import pii

    got = {r["id"]: r for r in pii.sanitise(crowded).where("id < 12").collect()}
    assert len(got[0]["base"]) == 30_000 and spans_of(got[0]) == spans_of(got[1])
    kinds = {s["value"]: s["kind"] for s in got[0]["extra"]}
    assert all(kinds.get(f"Rare{i}q") == "removed" for i in (0, 1, 299, 300, 29_999)) and len(got[0]["extra"]) == 30_000
    assert "plain" not in {s["value"] for s in got[10]["extra"]}


def test_long_texts_by_joins_equal_lookups(spark, monkeypatch):
    from hexalane.llm import pii

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    near = {r["id"]: (spans_of(r), r["base"]) for r in pii.sanitise(docs).collect()}
    monkeypatch.setattr(pii, "SHORT", 200)
    monkeypatch.setattr(pii, "PAIRS", 3)
    far = {r["id"]: (spans_of(r), r["base"]) for r in pii.sanitise(docs).collect()}
    assert sum(len(s) for s, _ in near.values()) > 50 and near == far


def test_pipeline_keeps_the_smallest_id_of_a_group_with_repeated_ids(spark):
    import corpus_pipeline

    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(2, a, "en", "s", 1), (5, a + " end", "en", "s", 1), (5, b, "en", "s", 1), (7, b, "en", "s", 1), (9, None, "en", "s", None), (9, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r["doc_id"], (r["text"] or "")[:2]) for r in got) == [(2, "a0"), (5, "b0"), (9, ""), (9, "")]
