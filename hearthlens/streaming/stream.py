"""Structured Streaming forms of the chunk loops.

Arriving files are read with ``readStream`` and an explicit schema; the same
clean function as the batch path runs on each micro-batch with statistics
fitted once on the reference data (frozen), and results go to a file sink
with a checkpoint, so a restarted query resumes exactly where it stopped.
``trigger(availableNow=True)`` processes everything present and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from hearthlens.operators import clean as C
from hearthlens.plans import dwelling


def stream_files(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Arriving files; all that are there in one batch unless ``max_files`` is set."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def stream_clean(spark: SparkSession, src: str, schema: T.StructType, stats: C.ImputeStats,
                 out: str, checkpoint: str) -> DataFrame:
    """Clean arriving Parquet files with frozen statistics into a
    Parquet sink; returns the sink read back as a batch table."""
    s = stream_files(spark, src, schema)
    cleaned = dwelling.clean_pipeline_with_stats(s, stats)
    q = (cleaned.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(cleaned.schema).parquet(out)


def stream_append(spark: SparkSession, src: str, schema: T.StructType, out: str, checkpoint: str) -> DataFrame:
    """Append every arriving file to one Parquet dataset (schema fixed
    by the declared schema, not by the first file)."""
    s = stream_files(spark, src, schema)
    q = (s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def committed_epoch(spark: SparkSession, out: str) -> int:
    """The last epoch whose state is whole; -1 before the first."""
    marks = spark.read.schema("epoch long").parquet(out + "/commits") if _exists(spark, out + "/commits") else None
    last = marks.agg(F.max("epoch").alias("e")).first()["e"] if marks is not None else None
    return -1 if last is None else int(last)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_state(batch: DataFrame, epoch: int, out: str) -> None:
    """Keep the running state of one epoch: a folder of its own first, then a
    marker row.  No earlier epoch is touched, so the last whole state can be
    read at any moment; an epoch that is replayed after its marker changes
    nothing, one replayed before it overwrites only its own folder."""
    spark = batch.sparkSession
    if committed_epoch(spark, out) >= epoch:
        return
    batch.write.mode("overwrite").parquet(f"{out}/state/{epoch:012d}")
    spark.range(epoch, epoch + 1, 1, 1).select(F.col("id").alias("epoch")).write.mode("append").parquet(out + "/commits")


def read_state(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """State of the last committed epoch; no rows before the first."""
    epoch = committed_epoch(spark, out)
    return spark.read.schema(schema).parquet(f"{out}/state/{epoch:012d}") if epoch >= 0 else spark.createDataFrame([], schema)


def stream_null_profile(spark: SparkSession, src: str, schema: T.StructType, checkpoint: str,
                        cols: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """Running null counters over arriving files (streaming global
    aggregate, complete mode).  Each micro-batch keeps its one-row state under
    its epoch (``write_state``); the last committed one is returned."""
    cols = cols or [f.name for f in schema.fields]
    s = stream_files(spark, src, schema, max_files)
    agg = s.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    out = checkpoint.rstrip("/") + "-state"
    q = (agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, epoch: write_state(batch, epoch, out)).trigger(availableNow=True).start())
    q.awaitTermination()
    state = read_state(spark, out, agg.schema)
    long = state.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls"))
                                                    for c in cols])).alias("s"))
    return long.select("s.column_name", "s.nulls", "rows", (F.col("s.nulls") / F.col("rows")).alias("null_share"))
