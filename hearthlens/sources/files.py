"""File sources and sinks.

Readers take explicit schemas (no inference on large inputs); writers use
Spark's partitioned writers.  Nothing here collects rows to the driver.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlens.session import ensure_checkpoint_dir

EXTRA = "__extra_field"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def all_string_schema(cols: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


# S01 -----------------------------------------------------------------------
def scan_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t",
                   encoding: str = "ISO-8859-1", header: bool = True) -> DataFrame:
    """Delimited text, Latin-1, explicit schema.  Short rows are padded with
    nulls; rows with too many fields are skipped (the pandas
    ``on_bad_lines='skip'`` rule).  Over-long rows are detected with a
    sentinel column appended to the schema: only a row with more fields
    than the schema fills it."""
    sch = T.StructType(schema.fields + [T.StructField(EXTRA, T.StringType())])
    df = (spark.read.option("sep", sep).option("header", header).option("encoding", encoding)
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .option("mode", "PERMISSIVE").schema(sch).csv(path))
    return df.where(F.col(EXTRA).isNull()).drop(EXTRA)


# S02 / S03 -----------------------------------------------------------------
def scan_csv_columns(spark: SparkSession, path: str, schema: T.StructType, cols: Sequence[str]) -> DataFrame:
    """CSV with header, only the named columns (pruned by the CSV reader)."""
    return _csv_reader(spark).schema(schema).csv(path).select(*cols)


def scan_csv_except(spark: SparkSession, path: str, schema: T.StructType, drop: Sequence[str]) -> DataFrame:
    return _csv_reader(spark).schema(schema).csv(path).drop(*drop)


def _csv_reader(spark: SparkSession):
    # keep blanks inside values (text columns may carry trailing blanks)
    return (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False))


# S05 -----------------------------------------------------------------------
def scan_random_lines(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), seeded and independent of partitioning: the
    rows with the smallest hashes of their key."""
    from hearthlens.operators.ml import hash_sample

    return hash_sample(df, n, key_cols, seed)


# S10 / S11 / S12 -------------------------------------------------------------
def sink_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    w = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def sink_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> str:
    """CSV with header; ``single_file`` only for small group tables."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def sink_delimited(df: DataFrame, path: str, sep: str = "\t", encoding: str = "ISO-8859-1", compression: str = "gzip") -> str:
    """Delimited text.  Compressed files are read by one task each; a writing
    task makes one file, so they stay as small as its partition."""
    (df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", encoding).option("compression", compression)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


# S13 -----------------------------------------------------------------------
def convert_delimited(spark: SparkSession, src: str, dst: str, schema: T.StructType, sep: str = "\t") -> DataFrame:
    """TSV -> Parquet (typed) in one job; returns the Parquet reader."""
    sink_parquet(scan_delimited(spark, src, schema, sep=sep), dst)
    return spark.read.parquet(dst)


# S14 -----------------------------------------------------------------------
def split_complete_incomplete(df: DataFrame, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Write rows partitioned by ``is_complete`` (no null in the columns) and
    return the row counts per side (one aggregate over the written data)."""
    cols = list(cols or df.columns)
    cond = None
    for c in cols:
        x = F.col(c).isNotNull()
        cond = x if cond is None else cond & x
    tagged = df.withColumn("is_complete", cond)
    sink_parquet(tagged, path, ["is_complete"])
    back = df.sparkSession.read.parquet(path).withColumn("is_complete", F.col("is_complete").cast("boolean"))
    return back.groupBy("is_complete").agg(F.count(F.lit(1)).alias("rows"))


# S15 -----------------------------------------------------------------------
def markdown_rows(df: DataFrame, fmt: Sequence[tuple[str, str]]) -> DataFrame:
    """One Markdown table line per row: ``| v1 | v2 | ... |`` with per-column
    formats ('text', 'int', '1f', '1f%')."""
    parts = []
    for c, kind in fmt:
        x = F.col(c)
        if kind == "int":
            parts.append(F.format_number(x.cast("long"), 0))
        elif kind == "1f":
            parts.append(F.format_string("%.1f", F.round(x, 1)))
        elif kind == "1f%":
            parts.append(F.concat(F.format_string("%.1f", F.round(x, 1)), F.lit("%")))
        else:
            parts.append(x.cast("string"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |")).alias("line"), *[c for c, _ in fmt[:1]])
