"""The ``opN_<name>`` queries of this subpackage, and their SQL where SQL can express them.

Each query applies its operator with production parameters to the whole table
and derives the contract's columns from the operator's output.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, hard_negatives, line_crf, minhash_dedup, nbest, packing, pii, prefix_trie, quality_rules, secret_scan, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = toxicity.held_out("doc_id", 5, 0)
    model = toxicity.train(toxicity.labelled_rows(docs, labels.where(~out), "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(spark, warc.archive(_table(spark, sf_dir, "pages")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), model)
    spans = F.concat_ws(",", F.transform("__spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("doc_id", F.col("__n_candidates").alias("n_candidates"), F.size("__spans").cast("long").alias("n_secrets"), spans.alias("spans"), F.sha2(F.coalesce("__redacted", F.lit("")), 256).alias("redacted_sha256"))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = toxicity.held_out("doc_id", 3, 1)
    model = line_crf.train(toxicity.labelled_rows(docs, labels.where(~out), "quality", max_rows=line_crf.MAX_ROWS))
    scored = line_crf.score(docs, model)
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("id") % 20 == 0), k=20)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(_table(spark, sf_dir, "documents"), with_text=True)

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = pii.digest(F.col("base"))
    spans = pii.digest(F.concat("base", F.array_sort(F.col("extra"))))
    return found.select(F.col("id").alias("doc_id"), *map(count, pii.KINDS), F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), F.sha2(pii.redact(F.col("text"), F.col("base"), F.col("extra")), 256).alias("sanitised_sha256"))


def op10_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the three best segmentations of each whole text, and whether each decodes to the text."""
    coded = nbest.encode(_table(spark, sf_dir, "documents"), nbest.load(nbest.MODEL), n=3, keep=("doc_id",))
    return coded.select("doc_id", "rank", "score", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.usable(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return hard_negatives.mine(vectors, F.col("id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.verdicts(decontaminate.search(docs, _table(spark, sf_dir, "benchmark"), keep=("doc_id",)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_minhash_dedup, op2_quality_rules, op3_toxicity, op4_warc, op5_best_fit_packing, op6_secret_scan, op7_line_crf, op8_ann, op9_pii, op10_nbest, op11_hard_negatives, op12_prefix_trie, op13_decontaminate]
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n n1 ON n1.doc_id = x JOIN n n2 ON n2.doc_id = y WHERE 100 * i >= 75 * (n1.n + n2.n - i)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, b.y FROM r JOIN both_ways b ON b.x = r.c)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id, n.n
"""


OP4 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT d.page_id, cast(d.n AS bigint) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON f.h = d.h
"""


OP11 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, cast(list_inner_product(a.q, b.q) AS bigint) AS score
  FROM e a, e b WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k
  FROM s WHERE label = anchor_label AND vec_id <> anchor_id),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    cast(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS int) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
  WHERE p.k <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

OP12 = """
WITH byte AS (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
  FROM (SELECT cast(unnest(range(256)) AS bigint) AS i)),
crc AS (SELECT list(c ORDER BY i) AS table_ FROM byte),
said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(cast(octet_length(encode(role)) AS varchar) || ':' || role || text)) AS n
  FROM said),
code AS (SELECT c, list_prepend(4294967295, list_transform(string_split(cast(c AS varchar), ''), lambda x: cast(ascii(x) AS bigint))) AS bytes FROM (SELECT DISTINCT c FROM t)),
hh AS (SELECT c, xor(list_reduce(bytes, lambda x, y: xor(x >> 8, table_[(xor(x, y) & 255) + 1])), 4294967295) % 9 AS h FROM code, crc),
r AS (
  SELECT hh.c, 0 AS part, t.n, t.role, t.text FROM hh JOIN t ON t.c = hh.c - hh.c % 5 AND t.n <= hh.h
  UNION ALL SELECT hh.c, 1, t.n, t.role, t.text FROM hh JOIN t ON t.c = hh.c AND t.n > hh.h),
px AS (
  SELECT c, row_number() OVER w AS d, list([role, text]) OVER w AS said, octet_length(encode(text)) AS b FROM r WINDOW w AS (PARTITION BY c ORDER BY part, n)
  UNION ALL SELECT c, 0, [], 0 FROM hh),
ends AS (SELECT c, max(d) AS d FROM px GROUP BY c),
node AS (
  SELECT px.d AS depth, px.said, min(px.c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(px.b) AS saved,
    coalesce(string_agg(cast(px.c AS varchar), ',' ORDER BY px.c) FILTER (WHERE px.d = ends.d), '') AS ids
  FROM px JOIN ends ON ends.c = px.c GROUP BY px.d, px.said),
kids AS (SELECT depth - 1 AS depth, said[1 : depth - 1] AS said, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.depth = node.depth AND kids.said = node.said),
up AS (SELECT k AS depth, said[1 : k] AS said, n_children, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_node)),
sums AS (SELECT depth, said, count(*) FILTER (WHERE n_children = 0) AS n_leaves, cast(sum(saved) AS bigint) AS saved_tokens FROM up GROUP BY depth, said)
SELECT f.conv_id, cast(f.depth AS bigint) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ids) AS ends_sha256
FROM full_node f JOIN sums s ON s.depth = f.depth AND s.said = f.said LEFT JOIN node p ON p.depth = f.depth - 1 AND p.said = f.said[1 : f.depth - 1]
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
grams AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w)),
o AS (SELECT g.doc_id, g.i, g.n, w.item_id FROM grams g JOIN w ON w.n = g.n AND w.s = array_to_string(g.ws[g.i : g.i + g.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM o) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS s FROM o WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.ws) AS bigint) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(found.n_items, 0) AS n_items, sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1, "op4_warc": OP4, "op11_hard_negatives": OP11, "op12_prefix_trie": OP12, "op13_decontaminate": OP13}
