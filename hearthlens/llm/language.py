"""Language identification.

Sparse multinomial logistic regression on TF-IDF weighted character n-grams
(1 to 3 letters, hashed), trained with follow-the-regularised-leader (FTRL
proximal) with an elastic-net penalty, then calibrated with a temperature.

Document frequencies come from every document that may be learned from; the
weights are fitted on a bounded sample of them (``per_language`` documents a
language at most, in expectation, chosen by a hash).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlens.llm import codepoints
from hearthlens.llm.common import small_batches
from hearthlens.session import ship_package

UNKNOWN = "und"
BITS = 16
_GAP = 3


def _grams(run: list[str]):
    """(hashed 1-, 2- and 3-grams at each place, valid places of each size,
    starts, letters in each text)."""
    f, _, starts = codepoints.points(run, False, _GAP)
    c = f.astype(np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    h1 = c
    h2 = h1[:-1] * np.uint64(0x1000003) + c[1:]
    h3 = h2[:-1] * np.uint64(0x1000003) + c[2:]
    letters = np.add.reduceat((f != 0).astype(np.int64), starts[:-1])
    ids, ok = [], []
    for k, h in enumerate((h1, h2, h3)):
        n = len(f) - k
        good = f[:n] != 0 if k == 0 else (f[:n] != 0) | (f[1 : n + 1] != 0)
        ids.append(((h + np.uint64(k << 60)) * m >> np.uint64(64 - BITS)).astype(np.int32))
        ok.append(good)
    # n-grams that start in a gap belong to no text
    gap = np.zeros(len(f), dtype=bool)
    for g in range(1, _GAP + 1):
        gap[starts[1:] - g] = True
    for k in range(3):
        ok[k] &= ~gap[: len(ok[k])]
    return ids, ok, starts, letters


def _texts(batches, column):
    for batch in batches:
        for first, run in codepoints.runs(batch.column(column).to_pylist()):
            yield batch, first, run


def _doc_ids(run):
    """For each text its n-gram numbers (with repeats)."""
    ids, ok, starts, letters = _grams(run)
    where = [np.flatnonzero(o) for o in ok]
    got = [i[w] for i, w in zip(ids, where, strict=True)]
    cuts = [np.searchsorted(w, starts) for w in where]
    for d in range(len(run)):
        yield letters[d], np.concatenate([g[c[d] : c[d + 1]] for g, c in zip(got, cuts, strict=True)])


def _frequencies(batches):
    df, n = np.zeros(1 << BITS, dtype=np.int64), 0
    for _, _, run in _texts(batches, 0):
        for letters, ids in _doc_ids(run):
            if letters:
                seen = np.zeros(1 << BITS, dtype=bool)
                seen[ids] = True
                df += seen
                n += 1
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], names=["id", "n"])


def _vectors(batches):
    for batch, first, run in _texts(batches, 1):
        langs = batch.column(0).slice(first, len(run)).to_pylist()
        rows = [(lang, *np.unique(ids, return_counts=True)) for lang, (letters, ids) in zip(langs, _doc_ids(run), strict=True) if letters]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype(np.int32).tobytes() for r in rows], pa.binary()),
                                          pa.array([r[2].astype(np.int32).tobytes() for r in rows], pa.binary())], names=["lang", "ids", "counts"])


def ftrl(rows, classes: int, dim: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4, seed: int = 7):
    """FTRL-proximal for softmax regression.  rows: (ids, values, class)."""
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))
    rng = np.random.default_rng(seed)

    def weights(zz, nn):
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            ids, x, y = rows[r]
            zz, nn = z[ids], n[ids]
            w = weights(zz, nn)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            z[ids] = zz + g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha * w
            n[ids] = nn + g * g
    return weights(z, n)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss (grid, then golden section)."""

    def loss(t):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    grid = np.geomspace(0.05, 20, 61)
    i = int(np.argmin([loss(t) for t in grid]))
    lo, hi = np.log(grid[max(i - 1, 0)]), np.log(grid[min(i + 1, len(grid) - 1)])
    for _ in range(30):
        a, b = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
        lo, hi = (lo, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class LanguageModel:
    """Learned languages, the weight table (idf times weight) and temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, temp: float):
        self.languages, self.table, self.temp = languages, table.astype(np.float32), temp

    @classmethod
    def fit(cls, labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 500, calibrate: float = 0.25) -> LanguageModel:
        """labelled: rows that may be learned from; rows with a null text or
        language teach nothing.  ``key`` only chooses the sample."""
        spark = labelled.sparkSession
        ship_package(spark)
        small_batches(spark)
        rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key), F.lit("sample")).alias("h")).where("text is not null and lang is not null")
        counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        languages = sorted(counts)
        if not languages:
            return cls([], np.zeros((1 << BITS, 0)), 1.0)
        freq = rows.select("text").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        df = np.zeros(1 << BITS)
        total = 1
        for r in freq.collect():  # 2**16 + 1 rows at most
            if r["id"] < 0:
                total = r["n"]
            else:
                df[r["id"]] = r["n"]
        idf = np.where(df > 0, np.log((1.0 + total) / (1.0 + df)) + 1.0, 0.0)
        # the bounded sample: a hash threshold for each language
        share = F.element_at(F.create_map(*[x for l in languages for x in (F.lit(l), F.lit(min(1.0, per_language / counts[l])))]), F.col("lang"))
        picked = rows.where(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003)
        vectors = picked.select("lang", "text").mapInArrow(_vectors, "lang string, ids binary, counts binary").collect()
        data = []
        for r in sorted(vectors, key=lambda r: (r["lang"], bytes(r["ids"]), bytes(r["counts"]))):
            ids, c = np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32)
            data.append((ids, 3.0 * idf[ids] * c / c.sum(), languages.index(r["lang"])))
        order = np.random.default_rng(11).permutation(len(data))
        held = set(order[: int(calibrate * len(data))].tolist())
        w = ftrl([d for i, d in enumerate(data) if i not in held], len(languages), 1 << BITS)
        scores = np.array([data[i][1] @ w[data[i][0]] for i in sorted(held)]).reshape(-1, len(languages))
        temp = temperature(scores, np.array([data[i][2] for i in sorted(held)])) if len(held) else 1.0
        return cls(languages, 3.0 * idf[:, None] * w, temp)

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, calibrated probability) of each text."""
        k = len(self.languages)
        langs, best = [], []
        for _, run in codepoints.runs(texts):
            ids, ok, starts, letters = _grams(run)
            sums, grams = np.zeros((len(run), k)), np.zeros(len(run))
            for i, o in zip(ids, ok, strict=True):
                cut = np.minimum(starts[:-1], len(i) - 1)
                kept = np.where(o, i, 0)
                for c in range(k):
                    sums[:, c] += np.add.reduceat(np.where(o, self.table[kept, c], 0.0), cut)
                grams += np.add.reduceat(o.astype(np.int64), cut)
            s = sums / np.maximum(grams, 1)[:, None] / self.temp
            p = np.exp(s - s.max(axis=1, keepdims=True)) if k else s
            p = p / p.sum(axis=1, keepdims=True) if k else p
            top = p.argmax(axis=1) if k else np.zeros(len(run), dtype=int)
            for d in range(len(run)):
                known = k and letters[d] > 0
                langs.append(self.languages[top[d]] if known else UNKNOWN)
                best.append(float(p[d, top[d]]) if known else 0.0)
        return langs, best

    def predict(self, batches):
        """Arrow batches (key, text) to (key, lang_pred, score)."""
        for batch in batches:
            langs, best = self.judge(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(best, pa.float64())], names=["key", "lang_pred", "score"])

    def keep(self, place: int, least: float):
        def run(batches):
            for batch in batches:
                langs, best = self.judge(batch.column(place).to_pylist())
                yield batch.filter(pa.array([x != UNKNOWN and p >= least for x, p in zip(langs, best, strict=True)], pa.bool_()))

        return run


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is 2 modulo 4; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, lang_pred, score (calibrated probability).

    ``und`` with score 0 where the text is null or has no letter (empty text
    included), or where no language was learned.  Whole texts count, however
    long; equal texts get equal predictions; repeated rows stay; an empty
    table gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 weights a language
    return (docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(lambda batches: shared.value.predict(batches), "key long, lang_pred string, score double").withColumnRenamed("key", "doc_id"))


def keep_known(docs: DataFrame, model: LanguageModel, text: str = "text", min_score: float = 0.35) -> DataFrame:
    """The rows of ``docs`` (all columns) whose language is known with at least
    ``min_score``; rows that would be ``und`` go."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    return docs.mapInArrow(lambda batches: shared.value.keep(place, min_score)(batches), docs.schema)
