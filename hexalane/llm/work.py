"""Shared storage for intermediate tables.

Lineage is cut by writing Parquet below the folder the cluster names in
``spark.checkpoint.dir``: every executor and the driver can read it, so a lost
executor costs at most the running tasks.  A session without that setting uses its
warehouse, which driver and executors share as well.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's checkpoint folder, or one in the session's warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/hexalane-work"
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/hexalane-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` once no later step reads it."""
    jvm = spark.sparkContext._jvm
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in parents:
        if "/hexalane-" in path:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
