"""Spark session and lineage helpers.

The library never creates a session inside an operator; callers pass one in.
``local_session`` is for tests, the bench and the driver smoke check.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "hearthlens") -> SparkSession:
    """A local session tuned for small test data (UI off, AQE on)."""
    parts = shuffle_partitions or (8 if cores == "*" else max(2, int(cores)))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("HEARTHLENS_DRIVER_MEM", "12g"))
        .config("spark.sql.ansi.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder.

    ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...) and is used
    as given.  A fresh temporary folder is taken only in local mode (tests,
    bench), where one machine is the cluster; anywhere else it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="hearthlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BLOCK_ROWS = 50_000


def _block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    out = pa.BufferOutputStream()
    pq.write_table(pa.Table.from_batches(batches), out, compression="zstd")
    return pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK_ROWS:
            yield _block(held)
            held = []
    if any(x.num_rows for x in held):
        yield _block(held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for v in b.column(0):
            yield from pq.read_table(pa.BufferReader(v.as_buffer()), use_threads=False).to_batches(max_chunksize=10_000)


def cut_compressed(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for wide tables: the checkpoint holds blocks of rows
    coded as Parquet (column dictionaries, zstd).  Partitions and the order of
    the rows in them stay, so what depends on these (sketches, draws) stays too."""
    ship_package(df.sparkSession)
    return cut_lineage(df.mapInArrow(_blocks, "block binary")).mapInArrow(_rows, df.schema)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``hearthlens`` importable on executors (the ``--py-files``
    mechanism): zip the package once per application and ``addPyFile`` it.
    Needed only by the Python-on-executor path (Tree SHAP)."""
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    fd, zpath = tempfile.mkstemp(prefix="hearthlens-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for p in root.rglob("*"):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, Path("hearthlens") / p.relative_to(root))
    spark.sparkContext.addPyFile(zpath)
    _SHIPPED.add(app)
