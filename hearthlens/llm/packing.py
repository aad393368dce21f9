"""Best-fit packing of documents into fixed-size training bins.

Conflict-constrained best fit: bins are kept in order of their residual space
and carry bitmaps of the sources and duplicate clusters they hold.  A piece
goes to the tightest bin that has room and no conflict; the successor search
walks up the residual order until it finds one, or opens a new bin.

Spark shards the (narrow) piece table by a hash into shards of a bounded
number of pieces; shards are packed independently on the executors.  A hot
source or cluster spreads over all shards like everything else.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlens.llm.common import materialize, words_of
from hearthlens.session import ship_package


def best_fit(items: list[tuple[int, int | None, int | None]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item (length, source, cluster) in the given order.

    A null source or cluster conflicts with nothing.  Ties of residual go to
    the oldest bin."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    source_bit: dict[int, int] = {}
    cluster_bit: dict[int, int] = {}
    out = []
    for length, source, cluster in items:
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        i = bisect_left(order, (length, -1))
        while i < len(order) and (sources[order[i][1]] & s or clusters[order[i][1]] & c):
            i += 1
        if i < len(order):
            residual, b = order.pop(i)
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        if residual > length:
            insort(order, (residual - length, b))
        out.append((b, capacity - residual))
    return out


def _pack_shard(capacity: int):
    def run(key, t):
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        got = best_fit(list(zip(*(t.column(c).to_pylist() for c in ("length", "source", "cluster")), strict=True)), capacity)
        shard = key[0].as_py()
        return t.select(["doc_id", "copy", "piece", "length"]).append_column("bin_id", pa.array([(shard << 32) + b for b, _ in got], pa.int64())).append_column(
            "offset", pa.array([o for _, o in got], pa.int64()))

    return run


def pack(docs: DataFrame, length: Column, source: Column, cluster: Column, doc_id: str = "doc_id", capacity: int = 2048,
         shard_pieces: int = 4096) -> DataFrame:
    """Packs every document: doc_id, copy, piece, length, bin_id, offset.

    ``length`` (tokens), ``source`` and ``cluster`` are columns of ``docs``.
    A document longer than ``capacity`` is cut into full pieces and a rest, a
    document without tokens gets one piece of length 0 and no bin.  No bin
    holds two pieces of one source or of one cluster (nulls are free), nor
    more than ``capacity`` tokens.  Rows equal in doc_id, length, source and
    cluster are told apart by ``copy`` (from 0); an empty table gives no rows;
    other columns are ignored.  Shards hold about ``shard_pieces`` pieces
    whatever the input; that sets the packing window, not what is packed.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n"),
                       F.xxhash64(source).alias("source"), source.isNull().alias("no_source"), cluster.cast("long").alias("cluster"))
    rows = rows.select("doc_id", "n", F.when(~F.col("no_source"), F.col("source")).alias("source"), "cluster")
    rows = rows.groupBy("doc_id", "n", "source", "cluster").agg(F.count("*").alias("copies"))
    rows = rows.select("doc_id", "n", "source", "cluster", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).withColumn("copy", F.col("copy") - 1)
    pieces = (rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)))).alias("piece"))
              .select("doc_id", "copy", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("length"), "source", "cluster"))
    total = docs.select(F.sum(F.greatest(F.ceil(F.coalesce(length.cast("long"), F.lit(0)) / capacity), F.lit(1))).alias("t")).first()["t"] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    some = pieces.where("length > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece", "source"), F.lit(shards)))
    packed = some.groupBy("shard").applyInArrow(_pack_shard(capacity), "doc_id long, copy long, piece long, length long, bin_id long, offset long")
    none = pieces.where("length = 0").select("doc_id", "copy", "piece", "length", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("offset"))
    return packed.unionByName(none)


def word_count(text: Column) -> Column:
    return F.size(words_of(text))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = 2048, shard_pieces: int = 4096,
                   clusters: DataFrame | None = None) -> DataFrame:
    """``pack`` with words as tokens.  ``clusters`` (doc_id, cluster; one row an
    id) names the duplicate cluster of each document; documents without one,
    and all where it is not given, form a cluster with those of equal text."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), word_count(F.col(text).cast("string")).alias("n"), F.col(source).cast("string").alias("source"), F.xxhash64(F.col(text).cast("string")).alias("cluster"))
    if clusters is not None:
        named = clusters.select("doc_id", F.col("cluster").alias("named"))
        sized = materialize(sized.join(named, "doc_id", "left").select("doc_id", "n", "source", F.coalesce("named", "cluster").alias("cluster")), "packing-sizes")
    return pack(sized, F.col("n"), F.col("source"), F.col("cluster"), "doc_id", capacity, shard_pieces)
