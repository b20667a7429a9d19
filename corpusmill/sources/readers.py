"""Sources: JSONL (plain or gzip), strict CSV, rows of XML, members of ZIP archives, and schema conforming."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """Parquet of all paths that match; none is an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(pattern)
    return spark.read.parquet(*sorted(str(f.getPath()) for f in found))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; .gz files are read as they are. A line that is no object is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Text columns of a CSV with quoted multi-line fields. The header must be exactly as given (a byte-order mark is ignored)."""
    df = spark.read.options(header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1).csv(path)
    names = [c.lstrip("\ufeff") for c in df.columns]
    if names != header:
        raise ValueError(f"the header is {names}, not {header}")
    return df.toDF(*names)


def read_xml_rows(spark: SparkSession, path: str, attributes: list[str], tag: str = "row") -> DataFrame:
    """Attributes of <row .../> elements as text columns."""
    schema = T.StructType([T.StructField(f"_{a}", T.StringType()) for a in attributes])
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).toDF(*attributes)


def read_zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, line_no, line) of the text members of ZIP archives; an archive is one task's work."""

    def members(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        lines = z.read(name).decode("utf-8-sig").splitlines()
                        yield pd.DataFrame({"archive": where, "member": name, "line_no": range(1, len(lines) + 1), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, line_no int, line string")


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with exactly the columns of schema: cast where they exist, the default (or null) where they don't."""
    defaults = defaults or {}
    return df.select(*[
        (F.coalesce(F.col(f"`{f.name}`").cast(f.dataType), F.lit(defaults.get(f.name)).cast(f.dataType)) if f.name in df.columns else F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in schema
    ])
