"""Language-model scores: stupid backoff, leave-one-out over the corpus.

The score of a word given its history is ``f(history word) / f(history)`` if
that n-gram occurs, else ``backoff`` times the score with a history one word
shorter; at the end ``f(word) / N``.  All counts f are taken over all *other*
documents: the counts of the whole corpus less the document's own.

Relational form.  Documents are dealt into blocks; a block lists its distinct
n-grams with counts, sorted by hash and cut into hash partitions.  Count
tables are built per hash partition by adding the lists of all blocks, joined
back to each block's list, and the blocks sum the logarithms per document.  An
n-gram is on a block's list once however often it occurs there, so a very
frequent one is no hot key, and blocks and partitions keep their size as the
corpus grows (their number grows).  Lists travel as packed arrays, about 5
bytes an n-gram: hashes have 24 bits more than the number of words of the
corpus (64 at most), so one n-gram in 16 million shares its hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlens.llm.texthash import _PLACE, U, mix, pack_sorted, planes, text_chunks, unpack_sorted, unplanes, word_hashes
from hearthlens.session import ship_package

_LISTS = "ord int, part int, block long, keys binary, counts binary"
_TOTALS = "block long, ord int, part int, totals binary"


def _block_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, offsets) of the texts of a block in row order."""
    hashes, counts = [], []
    for _, run in text_chunks(table.column("text").to_pylist()):
        h, off = word_hashes(run)
        hashes.append(h)
        counts.append(np.diff(off))
    return np.concatenate([*hashes, np.zeros(0, U)]), np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))]).astype(np.int64)


def _grams(h: np.ndarray, off: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, of ``width`` bits, of the k-gram that ends at each of the places,
    the places)."""
    n = np.diff(off)
    place = np.arange(len(h)) - np.repeat(off[:-1], n)
    at = np.flatnonzero(place >= k - 1)
    if k == 1:
        return h >> U(64 - width), at
    g = np.zeros(len(at), dtype=U)
    for j in range(k):
        g += h[at - (k - 1) + j] * _PLACE[j]
    return mix(g) >> U(64 - width), at


def _lists(order: int, bits: int, width: int):
    def run(key, table):
        h, off = _block_words(table)
        rows = []
        for k in range(1, order + 1):
            keys, counts = np.unique(_grams(h, off, k, width)[0], return_counts=True)
            if not len(keys):
                continue
            part = (keys >> U(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(keys)], strict=True):
                rows.append((k, int(part[a]), key[0].as_py(), pack_sorted(keys[a:b]), planes((counts[a:b] - 1).astype(np.uint32))))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["ord", "part", "block", "keys", "counts"])

    return run


def _totals(key, table):
    """Adds the lists of a hash partition and gives each block the counts of
    the other blocks (mostly zeros, which compress well)."""
    keys = [unpack_sorted(b.as_py()) for b in table.column("keys")]
    counts = np.concatenate([unplanes(b.as_py(), np.uint32) for b in table.column("counts")]).astype(np.int64) + 1
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=counts).astype(np.int64)[inverse] - counts
    ends = np.cumsum([len(k) for k in keys])
    n = table.num_rows
    return pa.table([table.column("block"), pa.array([key[0].as_py()] * n, pa.int32()), pa.array([key[1].as_py()] * n, pa.int32()),
                     pa.array([planes(total[e - len(k) : e]) for k, e in zip(keys, ends, strict=True)], pa.binary())], names=["block", "ord", "part", "totals"])


def _score(order: int, width: int, backoff: float, corpus: int):
    def run(key, docs, totals):
        h, off = _block_words(docs)
        n = np.diff(off)
        doc = np.repeat(np.arange(len(n)), n)
        others = corpus - n[doc]
        got: dict[int, list] = {k: [] for k in range(1, order + 1)}
        for o, p, b in zip(totals.column("ord").to_pylist(), totals.column("part").to_pylist(), totals.column("totals"), strict=True):
            got[o].append((p, b))
        f = np.zeros((order + 1, len(h)))  # counts in the other documents of the k-gram ending at each place
        for k in range(1, order + 1):
            g, at = _grams(h, off, k, width)
            if not len(g):
                continue
            _, inverse, here = np.unique(g, return_inverse=True, return_counts=True)
            whole = (np.concatenate([unplanes(b.as_py(), np.int64) for _, b in sorted(got[k], key=lambda x: x[0])]) + here).astype(np.float64)
            _, own, times = np.unique(doc[at] * len(whole) + inverse, return_inverse=True, return_counts=True)
            f[k, at] = whole[inverse] - times[own]
        # from the longest history down; an unseen word counts as half a time
        logs = np.log(np.where(f[1] > 0, f[1], 0.5) / np.maximum(others, 1)) if len(h) else np.zeros(0)
        used = np.ones(len(h), dtype=np.int64)
        for k in range(2, order + 1):
            history = np.concatenate([[0.0], f[k - 1][:-1]]) if len(h) else np.zeros(0)
            seen = f[k] > 0
            possible = np.arange(len(h)) - off[:-1][doc] >= k - 1
            logs = np.where(seen, np.log(np.where(seen, f[k], 1.0) / np.where(seen, history, 1.0)), np.where(possible, np.log(backoff) + logs, logs))
            used = np.where(seen, k, used)
        sums = np.array([logs[a:b].sum() for a, b in zip(off[:-1], off[1:], strict=True)])
        hits = np.array([(used[a:b] == order).sum() for a, b in zip(off[:-1], off[1:], strict=True)], dtype=np.int64)
        mean = [float(s / c) if c else None for s, c in zip(sums, n, strict=True)]
        return pa.table([docs.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.float64()), pa.array(mean, pa.float64()), pa.array(hits, pa.int64())],
                        names=["doc_id", "n_words", "log_score", "mean_log_score", "n_full"])

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 3, backoff: float = 0.4, block_bytes: int = 6_000_000) -> DataFrame:
    """One row per row: doc_id, n_words, log_score (sum of natural logarithms
    of the words' scores), mean_log_score (null without words), n_full (words
    scored with the longest history).

    Words are runs of non-blanks with A-Z lower-cased, whole texts count.
    Null and blank texts have no words and score 0; a word in no other
    document counts as half an occurrence.  Repeated rows are documents of
    their own; an empty table gives no rows; other columns are ignored.
    ``block_bytes`` sets the size of a block, not what is counted.
    """
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text").cast("long")).alias("b"), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")).alias("w")).first()
    blocks = max(1, -(-int(size["b"] or 0) // block_bytes))
    bits = max(0, blocks - 1).bit_length()
    width = min(64, int(size["w"] or 0).bit_length() + 24)
    d = d.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text")
    lists = d.groupBy("block").applyInArrow(_lists(order, bits, width), _LISTS)
    totals = lists.groupBy("ord", "part").applyInArrow(_totals, _TOTALS)
    return (d.groupBy("block").cogroup(totals.groupBy("block"))
            .applyInArrow(_score(order, width, backoff, int(size["w"] or 0)), "doc_id long, n_words long, log_score double, mean_log_score double, n_full long"))

