"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlens.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: the six ASCII blanks that separate words (space, tab, LF, VT, FF, CR)
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and gives every
    later reader exactly the same rows (no task is ever run twice with another
    outcome)."""
    path = scratch_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    """Words between ASCII blanks; null and blank text give an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), BLANKS), lambda w: w != "")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of fewer rows for the session, so that wide rows (whole
    texts, whole shingle sets) keep the Python workers small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside; the
    session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def keep_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (its columns, at most two longs);
    with ``left_anti`` those whose key is not.

    The ids are written and counted: a list of proven small size is broadcast,
    so that wide rows need not be shuffled; a larger one is joined by shuffle."""
    ids = materialize(ids.distinct(), "ids")
    small = ids.count() * 16 * len(ids.columns) <= broadcast_bytes
    return df.join(F.broadcast(ids) if small else ids, ids.columns, how)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node id reachable over undirected ``edges`` (columns a, b).

    Returns ``id, comp`` for every node that has an edge and a smaller node in
    its component; others are their own component and are not listed.
    Alternating large-star / small-star steps: every step is a grouped minimum
    (combined map-side) and a join on a node, nothing leaves the executors,
    and each round is written to the shared folder.  Hub nodes appear as one key with many rows, which
    only ever meets ``min`` and an equi-join that AQE may split.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: each larger neighbour links to the smallest of the neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node and its smaller neighbours link to the smallest one
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        new = materialize(small, "cc")
        # fixed point: every node hangs on exactly one root that hangs on nothing
        bad = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        chained = bad or new.select("u").join(new.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        cur = new
        if not chained:
            return cur.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
