"""Sinks. Spark's committer makes each write all or nothing; existing outputs are never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.contracts import row_sum


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").options(header=True, quote='"', escape='"').csv(path)


def write_splits(df: DataFrame, path: str, split: str) -> None:
    """A folder for each split."""
    df.write.mode("errorifexists").option("compression", "zstd").partitionBy(split).parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't there yet, and returns their number; a run that broke off can be repeated."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        before = spark.read.parquet(path).select(key)
        new = df.join(before, key, "left_anti")
        start = before.count()
    else:
        new, start = df, 0
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - start


def content_hash(df: DataFrame) -> DataFrame:
    """(n_rows, content): a hash that doesn't depend on the order of rows or on files; repeated rows count."""
    return df.agg(F.count("*").alias("n_rows"), row_sum(df).alias("content"))


def copy_files(spark: SparkSession, source: str, target: str) -> None:
    """Files as they are, byte by byte, into a folder that doesn't exist yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    if b.getFileSystem(conf).exists(b):
        raise FileExistsError(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
