"""The corpus pipeline: quality rules, toxicity, near-dedup, secret scans, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor
kept, and returns a DataFrame; all but the last return the columns of
``documents``.  The driver of a stage writes its result as Parquet and hands the
reread table to the next one.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexalane.llm import minhash_dedup, packing, quality_rules, secret_scan, toxicity
from hexalane.llm.work import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule or the multivariate outlier rule rejects go: null and empty texts among them.

    Equal rows get equal verdicts; an empty table stays empty.
    """
    return quality_rules.keep_good(docs.select(COLUMNS))


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored toxic (0.5 or more) go.

    The model learns from the labelled rows of ``docs``; without any, all rows
    score 0.5 by default and stay.  Null and empty texts score the model's bias;
    rows of null or repeated ids are scored like any others.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.labelled_rows(docs, labels, "toxic"))
    return toxicity.score(docs, model, keep=tuple(COLUMNS)).where("score < 0.5").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the smallest id.

    Rows without an id and texts without words all stay, since they are linked with
    nothing.  Where an id occurs several times, each of its distinct texts is a
    document of its own with a negative key made from both, so no text is lost for
    its id alone; of rows equal in id and text the one of the smallest lang, source
    and n_chars stays.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = materialise(ids, "twice")
    if not twice.isEmpty():
        own = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("row")).select("doc_id", "text", "row.*")
        key = F.xxhash64("doc_id", "text").bitwiseOR(F.lit(-(1 << 63)))
        docs = docs.join(twice, "doc_id", "left_anti").select(*COLUMNS, F.col("doc_id").cast("long").alias("key")).unionByName(own.select(*COLUMNS, key.alias("key")))
        docs = materialise(docs, "keyed")
    else:
        docs = docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("key"))
    groups = minhash_dedup.near_duplicates(docs, "key").select(F.col("id").alias("key"), F.col("component_id").alias("group"))
    if twice.isEmpty():
        gone = groups.where(F.col("key") != F.col("group")).select("key")
    else:  # keys of repeated ids say nothing about their order
        groups = materialise(groups.where("group is not null"), "groups")
        first = groups.join(docs.select("key", "doc_id"), "key").groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.key")
        gone = groups.select("key").join(first, "key", "left_anti")
    gone = materialise(gone, "gone")
    return docs.join(minhash_dedup.small(gone), "key", "left_anti").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; ``n_chars`` follows the new text.

    No row goes; null texts stay null, and rows without a secret stay as they are.
    """
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    found = secret_scan.scan(docs.select(COLUMNS), model)
    return found.select("doc_id", F.col("__redacted").alias("text"), "lang", "source", F.when(F.size("__spans") > 0, F.length("__redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept text, cut where it is longer than the largest sequence, in training sequences.

    Texts without words lie in no sequence; repeated rows are packed as often as they occur.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", clean_language),
    ("minhash_dedup", near_dedup),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]
#: Learnt and estimated stages have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
