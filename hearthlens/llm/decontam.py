"""Benchmark decontamination by the q-gram lemma.

A benchmark text of m characters that occurs in a document with at most e
edits shares at least ``m + 1 - q - e q`` of its q-grams with it, all of them
on diagonals less than e apart.  Hits of document q-grams in the benchmark's
q-grams are therefore counted in overlapping diagonal bands (each 2 w wide and
w apart, w = e + 1); regions that reach the bound are verified by banded
alignment.  Texts are compared as lower-case letters and digits with single
blanks between words, so layout and punctuation do not hide a passage.

The benchmark is the stated query set: it is held against all documents in
blocks of a bounded number of characters, a pass over the documents for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlens.llm import codepoints
from hearthlens.llm.common import keep_ids, small_batches
from hearthlens.session import ship_package

_GAP = 1
_U = np.uint64
_FILTER_BITS = 22


def qgram_hashes(f: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each place (len(f) - q + 1 of them), joined from
    halves of doubling width."""
    if len(f) < q:
        return np.zeros(0, dtype=_U)
    parts: list[tuple[int, np.ndarray]] = []
    h, width, left = f.astype(_U) * _U(0x9E3779B97F4A7C15), 1, q
    while True:
        if left & 1:
            parts.append((width, h))
        left >>= 1
        if not left:
            break
        m = (0xD6E8FEB86659FD93 * (2 * width + 1)) & ((1 << 64) - 1) | 1
        h = h[:-width] * _U(m) + (h[width:] ^ (h[width:] >> _U(29)))
        width *= 2
    n, at = len(f) - q + 1, 0
    out = np.zeros(n, dtype=_U)
    for i, (w, p) in enumerate(parts):
        out = out * _U(0xBF58476D1CE4E5B9) + p[at : at + n] * _U(2 * i + 3)
        at += w
    return (out ^ (out >> _U(31))) * _U(0x94D049BB133111EB)


def budget(m: int, q: int, rate: float) -> int:
    """Edits allowed for a text of m characters: ``rate * m``, but so few that
    the lemma still asks for at least two shared q-grams."""
    return max(0, min(int(rate * m), (m + 1 - q - 2) // q))


class QgramIndex:
    """The q-grams of a block of benchmark texts."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q = q
        self.ids, self.texts, self.edits = [], [], []
        keys, owners, places = [], [], []
        for item, text in items:
            f, _, _ = codepoints.points([text], True, _GAP)
            f = f[: len(f) - 1]
            f = f[:-1] if len(f) and f[-1] == 0 else f  # no blank at the end
            if len(f) < q:
                continue
            h = qgram_hashes(f, q)
            keys.append(h)
            owners.append(np.full(len(h), len(self.ids)))
            places.append(np.arange(len(h)))
            self.ids.append(item)
            self.texts.append(f)
            self.edits.append(budget(len(f), q, rate))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        keys, owners, places = cat(keys, _U), cat(owners, np.int64), cat(places, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners, self.places = keys[order], owners[order], places[order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[(self.keys >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray):
        """(place in the document run, item, place in the item) of every
        shared q-gram."""
        at = np.flatnonzero(self.filter[(h >> _U(64 - _FILTER_BITS)).astype(np.int64)])
        lo = np.searchsorted(self.keys, h[at])
        hi = np.searchsorted(self.keys, h[at], side="right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        into = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(at, n), self.owners[into], self.places[into]


def banded_distance(pattern: np.ndarray, window: np.ndarray, shift: int, width: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best place of ``pattern`` in ``window`` on
    the diagonals ``shift - width .. shift + width`` (place in the window less
    place in the pattern).  Row by row over the pattern, the band as a vector."""
    m, n, b = len(pattern), len(window), 2 * width + 1
    diag = shift - width + np.arange(b)
    big = m + n + 1
    cost = np.where((diag >= 0) & (diag <= n), 0, big)
    start = diag.copy()
    steps = np.arange(b)
    for i in range(m):
        j = i + diag  # window place compared with pattern[i]
        inside = (j >= 0) & (j < n)
        same = np.zeros(b, dtype=bool)
        same[inside] = window[j[inside]] == pattern[i]
        best = np.where(inside, cost + ~same, big)
        frm = start
        up = np.append(cost[1:], big) + 1  # pattern character left out of the document
        take = up < best
        best, frm = np.where(take, up, best), np.where(take, np.append(start[1:], 0), frm)
        # document characters added: a running minimum along the band
        low = np.minimum.accumulate(best - steps)
        first = np.where(np.concatenate([[True], low[1:] < low[:-1]]), steps, 0)
        src = np.maximum.accumulate(first)
        cost, start = np.minimum(low + steps, big), frm[src]
        cost = np.where((j + 1 >= 0) & (j + 1 <= n), cost, big)
    k = int(cost.argmin())
    return int(cost[k]), int(start[k]), int(m + diag[k])


def find_in_run(index: QgramIndex, run: list[str]):
    """(text number, item number, start, end, edits) of each passage, places
    counted in code points of the raw text."""
    f, at, starts = codepoints.points(run, True, _GAP)
    h = qgram_hashes(f, index.q)
    pos, item, place = index.hits(h)
    if not len(pos):
        return
    doc = np.searchsorted(starts, pos, side="right") - 1
    inside = pos + index.q < starts[doc + 1]  # no q-gram over the end of a text
    pos, item, place, doc = pos[inside], item[inside], place[inside], doc[inside]
    edits = np.array(index.edits)[item]
    need = np.array([len(t) for t in index.texts])[item] + 1 - index.q * (edits + 1)
    width = edits + 1
    # diagonals are counted from the start of the text and bands are kept by
    # text: what stands beside a text in the run changes nothing
    far = max(map(len, index.texts))
    diag = pos - starts[doc] - place + far
    regions: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for half in (0, 1):  # two sets of bands, each 2 w wide, shifted by w
        band = (diag + half * width) // (2 * width)
        order = np.lexsort((place, band, doc, item))
        bi, bd, bb, bp = item[order], doc[order], band[order], place[order]
        new = np.concatenate([[True], (bi[1:] != bi[:-1]) | (bd[1:] != bd[:-1]) | (bb[1:] != bb[:-1])])
        # each q-gram of the item counts once in a band
        fresh = new | np.concatenate([[True], bp[1:] != bp[:-1]])
        head = np.flatnonzero(new)
        count = np.add.reduceat(fresh.astype(np.int64), head) if len(head) else head
        for g in np.flatnonzero(count >= need[order][head]):
            one = order[head[g]]
            w = int(width[one])
            tail = head[g + 1] if g + 1 < len(head) else len(order)
            mine = diag[order[head[g] : tail]] - far
            most = int(mine.min() + np.bincount(mine - mine.min()).argmax())
            regions.setdefault((int(item[one]), int(doc[one])), set()).add((int(bb[head[g]]) * 2 * w - half * w - far, most))
    for (i, d), lows in sorted(regions.items()):
        m, e, w = len(index.texts[i]), index.edits[i], index.edits[i] + 1
        a, b = int(starts[d]), int(starts[d + 1]) - _GAP
        done = -1
        for low, most in sorted(lows):  # diagonals low .. low + 2 w - 1
            low, most = low + int(starts[d]), most + int(starts[d])
            if most < done:
                continue  # the other band of a passage that was found
            if a <= most and most + m <= b and np.array_equal(f[most : most + m], index.texts[i]):
                cost, first, s, t = 0, most, 0, m  # the banded alignment without an edit
            else:
                first, last = max(a, low - e), min(b, low + 2 * w + m + e)
                cost, s, t = banded_distance(index.texts[i], f[first:last], low + w - first, w + 1)
            if cost <= e and first + s >= done:
                done = first + t
                raw = _raw_start(run, d)
                yield d, i, int(at[first + s] - raw), int(at[max(first + t - 1, first + s)] + 1 - raw), cost


def _raw_start(run: list[str], d: int) -> int:
    return sum(len(t) + _GAP for t in run[:d])


def _finder(shared):
    def run_all(batches):
        index = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [(ids[first + d], index.ids[i], s, t, c) for first, run in codepoints.runs(batch.column(1).to_pylist()) for d, i, s, t, c in find_in_run(index, run)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "item", "start", "end", "edits"])

    return run_all


def blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int):
    """The benchmark in driver-sized blocks of about ``block_chars`` characters."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        if block and size + len(r["t"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  q: int = 10, rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """One row per benchmark passage found: doc_id, item_id, start, end (code
    points of the raw text, end excluded), edits.

    A passage is the whole benchmark text with at most ``rate`` edits a
    character (fewer where the lemma needs it, see ``budget``).  Benchmark
    texts under ``q`` characters after folding are not searched; null texts
    and ids match nothing, empty texts neither.  Repeated documents each give
    their rows, repeated benchmark rows count once; empty tables give no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    d = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("key is not null")
    schema = "key long, item long, start long, end long, edits long"
    found = None
    for block in blocks(benchmark, item_id, item_text, block_chars):
        shared = spark.sparkContext.broadcast(QgramIndex(block, q, rate))
        part = d.mapInArrow(_finder(shared), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "start", "end", "edits")


def _keeper(shared, place: int):
    def run_all(batches):
        index = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for first, run in codepoints.runs(batch.column(place).to_pylist()):
                for d, *_ in find_in_run(index, run):
                    keep[first + d] = False
            yield batch.filter(pa.array(keep))

    return run_all


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
               q: int = 10, rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` (all columns) in whose own text no benchmark
    passage occurs, whatever their id; see ``find_passages``."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    place, out = docs.columns.index(text), docs
    for block in blocks(benchmark, item_id, item_text, block_chars):
        shared = spark.sparkContext.broadcast(QgramIndex(block, q, rate))
        out = out.mapInArrow(_keeper(shared, place), docs.schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark passage occurs, all columns
    kept, by id: rows without an id are searched for nothing and stay, rows that
    repeat the id of a contaminated one go.  ``keep_clean`` judges each row."""
    bad = find_passages(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias(doc_id))
    return keep_ids(docs, bad, "left_anti").select(*docs.columns)
