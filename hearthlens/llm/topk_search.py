"""Exact top-k search by inner product, a block of documents at a time.

Vectors are read as sparse documents: a component is a term with an integer
weight.  Documents are put in an order that keeps alike vectors together
(nearest of a few pivots, then distance to it) and cut into blocks of
neighbours.  A block keeps its forward index (the documents' weights) and each
term's largest and smallest weight.

* A query's bound of a block is the sum over its terms of weight x largest
  weight (smallest, for negative weights): no document of the block scores
  more.
* Blocks are taken in descending order of that bound and scored through their
  forward index, until a bound falls below the k-th score so far.  A block at
  the k-th score itself is still taken if it may hold a smaller id.
* A first pass scores each query among its own neighbours in the order: their
  k-th score is where pruning starts in every other part of the index.

All is integer arithmetic, so the result is that of comparing all rows.
Queries go around in bounded groups, each against the whole index in one scan;
nothing is shuffled but k rows a query and part of the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlens.llm.common import arrow_rows, materialize
from hearthlens.session import ship_package

#: documents of a block
BLOCK = 64
#: blocks scored together by a task (an Arrow batch)
BATCH = 64
#: vectors that the order is fitted on, and how many of them become pivots;
#: only the order depends on them (speed, not results)
SAMPLE, PIVOTS = 4096, 64
#: bytes of the queries that go around at a time
QUERY_BYTES = 16 << 20
#: id that a missing id sorts as, behind all others
NO_ID = np.iinfo(np.int64).max
LOW = np.iinfo(np.int64).min


def weights(vector: Column, scale: int = 256) -> Column:
    """Components as integers, floor(scale * x); null for a vector that is null
    or holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


# matrices -------------------------------------------------------------------
def pad(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of any lengths as one matrix; terms that a row lacks weigh 0."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)), dtype=np.int64)
    for o, r in zip(out, rows, strict=True):
        o[:len(r)] = r
    return out


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """q x d' in exact integers: through doubles where every partial sum fits
    their 53 bits, in 64-bit integers else; scores beyond those are an error."""
    n = min(q.shape[1], d.shape[1])
    q, d = q[:, :n], d[:, :n]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * n
    if most < 2.0**53:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("scores do not fit 64 bits")
    return q @ d.T


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What no document of a block exceeds: (queries x blocks) summed term maxima.
    A term that a block lacks counts nothing, one that some of its documents
    lack has 0 among its weights."""
    return products(np.maximum(q, 0), high) + products(np.minimum(q, 0), low)


class Best:
    """The k best (score, id) of each query so far, best first."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None, floor_id: np.ndarray | None = None):
        self.score, self.id = np.full((n, k), LOW), np.full((n, k), NO_ID)
        self.floor = np.full(n, LOW) if floor is None else floor
        self.floor_id = np.full(n, NO_ID) if floor_id is None else floor_id

    def wants(self, bound: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """Whether a block of that bound and smallest id may still change a query's best."""
        s, i = self.score[:, -1:], self.id[:, -1:]
        own = (bound > s) | (bound == s) & (first_id < i) | (s == LOW)
        f, fi = self.floor[:, None], self.floor_id[:, None]
        return own & ((bound > f) | (bound == f) & (first_id <= fi) | (f == LOW))

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.score[who], score], axis=1)
        i = np.concatenate([self.id[who], np.broadcast_to(ids, score.shape)], axis=1)
        k = self.score.shape[1]
        order = np.lexsort((i, -np.maximum(s, LOW + 1)), axis=-1)[:, :k]
        self.score[who], self.id[who] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


class Blocks:
    """Blocks of the index as arrays."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        col = {c: batch.column(c).to_pylist() for c in ("block", "n", "width", "ids", "forward", "high", "low")}
        self.number = np.array(col["block"], dtype=np.int64)
        ids = [np.frombuffer(b, dtype="<i8") for b in col["ids"]]
        docs = [np.frombuffer(f, dtype=f"<i{len(f) // max(1, n * w)}" if n * w else "<i8").reshape(n, w).astype(np.int64) for f, n, w in zip(col["forward"], col["n"], col["width"], strict=True)]
        self.ids, self.docs = ids, docs
        self.high, self.low = (pad([np.frombuffer(b, dtype="<i8") for b in col[c]]) for c in ("high", "low"))
        self.first = np.array([i.min() for i in ids])


def search(q: np.ndarray, home: np.ndarray, place: np.ndarray, blocks: Blocks, best: Best) -> int:
    """Scores queries (rows of ``q``, from position ``place`` of block ``home``)
    against blocks in the order of their bounds; returns how many (query,
    block) pairs were scored."""
    bound = bounds(q, blocks.high, blocks.low)
    order = np.argsort(-bound, axis=1, kind="stable")
    scored, at, step = 0, 0, 1
    while at < order.shape[1]:
        now = order[:, at:at + step]
        want = best.wants(np.take_along_axis(bound, now, 1), blocks.first[now])
        if not want.any():
            # bounds only fall from here on, but a later block of the same bound may hold a smaller id
            rest = order[:, at:]
            if not best.wants(np.take_along_axis(bound, rest, 1), blocks.first[rest]).any():
                break
        row, col = np.nonzero(want)
        wanted = now[row, col]
        turn = np.argsort(wanted, kind="stable")
        for pairs in np.split(turn, np.flatnonzero(np.diff(wanted[turn])) + 1) if len(turn) else []:
            b, who = wanted[pairs[0]], row[pairs]
            s = products(q[who], blocks.docs[b])
            mine = np.flatnonzero(home[who] == blocks.number[b])
            s[mine, place[who[mine]]] = LOW  # the query's own row
            best.add(who, s, blocks.ids[b])
            scored += len(who)
        at, step = at + step, step * 2
    return scored


# index ----------------------------------------------------------------------
def _unpack(batch: pa.RecordBatch | pa.Table, name: str = "w") -> list[np.ndarray]:
    col = batch.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat, off = col.values.to_numpy(), col.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]


def _placer(shared):
    """Adds each vector's pivot and its squared distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value.astype(np.float64)
        for batch in batches:
            x = pad(_unpack(batch)).astype(np.float64)
            n = min(x.shape[1], pivots.shape[1])
            far = (pivots**2).sum(1)[None, :] - 2 * x[:, :n] @ pivots[:, :n].T if len(pivots) else np.zeros((len(x), 1))
            cell = far.argmin(1) if len(x) else np.zeros(0, dtype=np.int64)
            dist = far[np.arange(len(x)), cell] + (x**2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("w"), pa.array(cell.astype(np.int32)), pa.array(dist)], names=["id", "w", "cell", "dist"])

    return run


_INDEX = "block long, n int, width int, ids binary, forward binary, high binary, low binary"


def _packer(size: int):
    """Cuts the rows of a partition, in their order, into blocks."""

    def block(number: int, ids: list[np.ndarray], rows: list[np.ndarray]) -> list:
        w = pad(rows)
        most = int(np.abs(w).max(initial=0))
        kind = next(k for k in ("<i2", "<i4", "<i8") if most < 1 << (8 * int(k[2]) - 1))
        return [number, len(rows), w.shape[1], np.array(ids, dtype="<i8").tobytes(), w.astype(kind).tobytes(), w.max(0).astype("<i8").tobytes(), w.min(0).astype("<i8").tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, rows = TaskContext.get().partitionId() << 32, [], []
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        names = [c.split()[0] for c in _INDEX.split(", ")]
        for batch in batches:
            ids += batch.column("id").to_pylist()
            rows += _unpack(batch)
            out = []
            while len(rows) >= size:
                out.append(block(number, ids[:size], rows[:size]))
                number, ids, rows = number + 1, ids[size:], rows[size:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(block(number, ids, rows), kinds, strict=True)], names=names)

    return run


def build_index(rows: DataFrame, vec_id: str, vector: str, scale: int = 256, block: int = BLOCK, rows_per_part: int = 1 << 17) -> DataFrame:
    """The written index: one row a block.

    Every row with a whole vector is in it; a bounded sample (``SAMPLE`` rows
    of smallest hash) gives the pivots of the order alone."""
    spark = rows.sparkSession
    ship_package(spark)
    v = rows.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("id"), weights(F.col(vector), scale).alias("w")).where("w is not null")
    sample = pad(_unpack(v.orderBy(F.xxhash64("id", "w")).limit(SAMPLE).select("w").toArrow()))
    shared = spark.sparkContext.broadcast(_centres(sample, np.unique(sample, axis=0)[:: -(-len(sample) // PIVOTS) or 1]))
    parts = max(spark.sparkContext.defaultParallelism, -(-v.count() // rows_per_part))
    placed = materialize(v.mapInArrow(_placer(shared), "id long, w array<long>, cell int, dist double"), "vectors")
    # the id and the row last: equal vectors, however many, are dealt over several parts
    by = ["cell", "dist", "id", "row"]
    ranged = placed.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return materialize(ranged.select("id", "w").mapInArrow(_packer(block), _INDEX), "topk-index")


def _centres(x: np.ndarray, pivots: np.ndarray, rounds: int = 8) -> np.ndarray:
    """A few rounds of moving each pivot to the mean of its sample vectors."""
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    if not len(x):
        return p
    for _ in range(rounds):
        near = ((p**2).sum(1)[None, :] - 2 * x @ p.T).argmin(1)
        n = np.bincount(near, minlength=len(p))
        sums = np.zeros_like(p)
        np.add.at(sums, near, x)
        p = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], p)
    return p


# queries --------------------------------------------------------------------
def _kth(best: Best) -> tuple[np.ndarray, np.ndarray]:
    return best.score[:, -1], best.id[:, -1]


def _seed(every: int, k: int):
    """Queries among their own neighbours: the batch of blocks they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Blocks(batch)
            where = [(i, np.flatnonzero((ids % every == 0) & (ids != NO_ID))) for i, ids in enumerate(b.ids)]
            home = np.concatenate([np.full(len(p), b.number[i]) for i, p in where])
            place = np.concatenate([p for _, p in where])
            if not len(home):
                continue
            rows = [b.docs[i][j] for i, p in where for j in p]
            q = pad(rows)
            best = Best(len(q), k)
            search(q, home, place, b, best)
            s, i = _kth(best)
            ids = np.concatenate([b.ids[i][p] for i, p in where])
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(place), pa.array(ids), pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary()), pa.array(s), pa.array(i)], names=["home", "place", "query_id", "w", "floor", "floor_id"])

    return run


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        q = pad([np.frombuffer(b, dtype="<i8") for b in t["w"]])
        best = Best(len(q), k, t["floor"], t["floor_id"])
        scored = 0
        for batch in batches:
            scored += search(q, t["home"], t["place"], Blocks(batch), best)
        floor, floor_id = best.floor[:, None], best.floor_id[:, None]
        who, rank = np.nonzero((best.score > LOW) & ((best.score > floor) | (best.score == floor) & (best.id <= floor_id)))
        yield pa.RecordBatch.from_arrays([pa.array(t["home"][who]), pa.array(t["place"][who]), pa.array(t["query_id"][who]), pa.array(best.id[who, rank]), pa.array(best.score[who, rank])],
                                         names=["home", "place", "query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, query_bytes: int = QUERY_BYTES, block: int = BLOCK) -> DataFrame:
    """The k best scores of each row whose id is divisible by ``every``, among
    all other rows: query_id, rank (from 1), vec_id, score; fewer if there are
    fewer rows.  Ties go to the smaller vec_id.

    The score is the inner product of floor(scale * x); of vectors of unequal
    lengths the longer one's further components count nothing.  Vectors that
    are null or hold a null or non-finite component take no part; empty ones
    score 0.  A row without vec_id is no query and, as a candidate, comes last
    among ties with a null vec_id.  Rows that repeat a vec_id are rows of their
    own (each a query, and a candidate of the other).  An empty table gives no
    rows; other columns are ignored.  Scores beyond 64 bits are an error.
    """
    spark = rows.sparkSession
    with arrow_rows(spark, BATCH):
        index = build_index(rows, vec_id, vector, scale, block)
        queries = materialize(index.mapInArrow(_seed(every, k), "home long, place long, query_id long, w binary, floor long, floor_id long"), "topk-queries")
        size = queries.agg(F.sum(F.octet_length("w") + 40).alias("b")).first()["b"] or 0
        groups = max(1, -(-int(size) // query_bytes))
        found = []
        for g in range(groups):
            t = queries.where(F.pmod(F.xxhash64("home", "place"), F.lit(groups)) == g).toArrow()
            if not t.num_rows:
                continue
            held = {c: t.column(c).to_numpy() for c in ("home", "place", "query_id", "floor", "floor_id")} | {"w": t.column("w").to_pylist()}
            shared = spark.sparkContext.broadcast(held)
            part = materialize(index.mapInArrow(_searcher(shared, k), "home long, place long, query_id long, vec_id long, score long"), "topk-found")
            found.append(part)
            shared.unpersist()
    empty = spark.createDataFrame([], "home long, place long, query_id long, vec_id long, score long")
    one = Window.partitionBy("home", "place").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionAll, found, empty).withColumn("rank", F.row_number().over(one)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.w, v.w)::BIGINT AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
