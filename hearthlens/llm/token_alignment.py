"""Cross-tokenizer alignment by sparse incidence matrices.

Two tokenizers cut the same bytes (a space and the text) into tokens.  The
token-byte incidence matrix of a tokenizer has a row a token and a one at each
byte that the token covers.  With both in compressed sparse rows,

* A x B' (Gustavson's row products: for each one of a row of A, the row of B'
  at that byte, added up) holds the bytes that an A and a B token share: its
  entries are the overlap links;
* offsets where tokens of both end cut the text into groups; the product of
  the token-group incidence matrices holds the shared-group links.

Many texts stand one after the other in one pair of matrices (both tokenizers
end a token where a text ends, so the product is block diagonal), and the
product is taken in blocks of rows, so memory follows the block.

How often an id pair is linked in the whole corpus is counted by Spark.  Texts
are tokenized once; a chunk of texts is written as its distinct pairs with
their counts (few: the map-side combine) and its (document, pair) entries in
packed form.  Totals are summed by pair, joined back to the chunks' pairs and
meet the entries per chunk.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthlens.llm.common import arrow_rows, materialize
from hearthlens.session import ship_package

#: FIXED VALUE: how the byte-level tokenizer cuts a text into words
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: where the public vocabularies lie
A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: code points of the texts of one chunk (a longer text is a chunk alone)
CHUNK = 2_000_000
#: bytes whose tokens are multiplied at a time
BLOCK = 1 << 20


# tokenizers -----------------------------------------------------------------
def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible
    Latin-1 letters stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Byte-level BPE read from a ``tokenizers`` JSON file.

    The file's merges must stand in the order of the ids that they make; the
    ids are then ranks and the fast engine gives the file's own tokens.
    Special tokens are left out: their strings are plain text."""

    def __init__(self, data: bytes):
        import tiktoken

        doc = json.loads(data)
        letters, vocab = byte_letters(), doc["model"]["vocab"]
        special = {t["id"] for t in doc["added_tokens"] if t["special"]}
        ranks = {bytes(letters[c] for c in k): i for k, i in vocab.items() if i not in special}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in doc["model"]["merges"]]
        if any(b <= a for a, b in zip(made, made[1:], strict=False)) or doc["normalizer"] or doc["pre_tokenizer"]["type"] != "ByteLevel" or doc["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE whose merges follow its ids")
        self.size = 1 + max(vocab.values())
        self.bytes_of = [b""] * self.size
        for k, i in ranks.items():
            self.bytes_of[i] = k
        self._engine = tiktoken.Encoding("byte_bpe", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it."""
        return [self._engine.encode_ordinary(" " + t) for t in texts]


class PieceBpe:
    """Sentence pieces with byte fallback; the model adds the space."""

    def __init__(self, data: bytes):
        import sentencepiece

        self._engine = sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.size = sp.get_piece_size()
        self.bytes_of = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._engine.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _load(kind: type, digest: str, holder: _Bytes):
    return kind(holder.data)


class _Bytes:
    """File contents that count as equal under ``lru_cache`` (the digest tells)."""

    def __init__(self, data: bytes):
        self.data = data

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Bytes)


def load(kind: type, data: bytes):
    """A tokenizer, kept by the worker process."""
    return _load(kind, hashlib.sha256(data).hexdigest(), _Bytes(data))


# sparse rows ----------------------------------------------------------------
@dataclass
class Csr:
    """A 0/1 matrix in compressed sparse rows."""

    ptr: np.ndarray
    idx: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.ptr) - 1

    def transposed(self) -> Csr:
        row = np.repeat(np.arange(self.height), np.diff(self.ptr))
        order = np.argsort(self.idx, kind="stable")
        return Csr(np.concatenate([[0], np.bincount(self.idx, minlength=self.width).cumsum()]), row[order], self.height)


def incidence(lengths: np.ndarray) -> Csr:
    """Rows of ``lengths`` ones side by side: the tokens over their bytes."""
    ptr = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return Csr(ptr, np.arange(ptr[-1]), int(ptr[-1]))


def membership(group: np.ndarray, n: int) -> Csr:
    """One one a row: the tokens in their groups."""
    return Csr(np.arange(len(group) + 1), group, n)


def row_products(a: Csr, b: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's product a x b in blocks of rows of about ``block`` terms:
    (row, column, value) of its entries, rows and columns ascending."""
    terms = np.concatenate([[0], np.cumsum(b.ptr[a.idx + 1] - b.ptr[a.idx])])[a.ptr]  # before each row
    at = 0
    while at < a.height:
        to = max(at + 1, int(np.searchsorted(terms, terms[at] + block, "right")) - 1)
        k = a.idx[a.ptr[at]:a.ptr[to]]
        n = b.ptr[k + 1] - b.ptr[k]
        row = np.repeat(np.repeat(np.arange(at, to), np.diff(a.ptr[at:to + 1])), n)
        col = b.idx[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b.ptr[k], n)]
        key = row * b.width + col
        if len(key) and (key[1:] < key[:-1]).any():
            key = np.sort(key)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        yield key[new] // b.width, key[new] % b.width, np.diff(np.append(new, len(key)))
        at = to


# texts ----------------------------------------------------------------------
class Alignment:
    """Both tokenizations of a list of texts as one pair of matrices.

    Texts that are null or empty, or that a tokenizer does not give back byte
    by byte, have no tokens."""

    def __init__(self, texts: list[str | None], a, b):
        given = [i for i, t in enumerate(texts) if t]
        raw = [(" " + texts[i]).encode("utf-8", "surrogatepass") for i in given]
        ids = [x.encode([texts[i] for i in given]) if given else [] for x in (a, b)]
        same = [all(b"".join(map(x.bytes_of.__getitem__, row)) == r for x, row in zip((a, b), rows, strict=True)) for r, *rows in zip(raw, *ids, strict=True)]
        self.kept = [i for i, s in zip(given, same, strict=True) if s]
        own = [[row for row, s in zip(x, same, strict=True) if s] for x in ids]
        self.n_texts = len(texts)
        self.n_tokens = [np.zeros(len(texts), dtype=np.int64) for _ in own]
        for n, rows in zip(self.n_tokens, own, strict=True):
            n[self.kept] = [len(r) for r in rows]
        self.ids = [np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=sum(map(len, rows))) for rows in own]
        sizes = [np.array([len(t) for t in x.bytes_of], dtype=np.int64)[i] for x, i in zip((a, b), self.ids, strict=True)]
        self.over_bytes = [incidence(s) for s in sizes]
        ends = [m.ptr[1:] for m in self.over_bytes]
        marks = [np.bincount(e, minlength=self.over_bytes[0].width + 1) > 0 for e in ends]
        common = np.flatnonzero((marks[0] & marks[1])[1:]) + 1  # where tokens of both end
        self.n_groups_all = len(common)
        self.group = [np.searchsorted(common, e) for e in ends]
        self.doc = [np.repeat(np.arange(len(texts)), n) for n in self.n_tokens]
        self.in_groups = [membership(g, len(common)) for g in self.group]
        self.n_groups = np.zeros(len(texts), dtype=np.int64)
        if len(common):
            last_a = np.flatnonzero(np.append(np.diff(self.group[0]) > 0, True))
            self.n_groups += np.bincount(self.doc[0][last_a], minlength=len(texts))

    def overlap_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, shared bytes) in blocks; tokens are counted over all texts."""
        a, b = self.over_bytes
        return row_products(a, b.transposed())

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, 1) of tokens in the same group, in blocks."""
        a, b = self.in_groups
        return row_products(a, b.transposed())

    def n_group_links(self) -> np.ndarray:
        """Shared-group links of each text, from the lengths of the product's rows alone."""
        a, b = self.in_groups
        per_row = np.diff(b.transposed().ptr)[a.idx]
        return np.bincount(self.doc[0], weights=per_row, minlength=self.n_texts).astype(np.int64)

    def group_digests(self) -> list[str]:
        """SHA-256 of each text's ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        out = [""] * self.n_texts
        if not self.kept:
            return out
        last = [np.append(np.diff(g) > 0, True) for g in self.group]
        size = [int(i.max()) + 1 for i in self.ids]
        written = pa.array([f"{i}{c}" for n, marks in zip(size, (",|", ",;"), strict=True) for i in range(n) for c in marks], pa.large_string())
        seq = np.empty(len(self.ids[0]) + len(self.ids[1]), dtype=np.int64)
        before = [np.concatenate([[0], np.bincount(g, minlength=self.n_groups_all).cumsum()]) for g in self.group]
        seq[np.arange(len(self.ids[0])) + before[1][self.group[0]]] = 2 * self.ids[0] + last[0]
        seq[np.arange(len(self.ids[1])) + before[0][self.group[1] + 1]] = 2 * size[0] + 2 * self.ids[1] + last[1]
        string = written.take(pa.array(seq))
        offsets = np.frombuffer(string.buffers()[1], dtype=np.int64)
        data = memoryview(string.buffers()[2])
        ends = np.cumsum(self.n_tokens[0] + self.n_tokens[1])
        for i in self.kept:
            start = offsets[ends[i] - self.n_tokens[0][i] - self.n_tokens[1][i]]
            out[i] = hashlib.sha256(data[start:offsets[ends[i]] - 1]).hexdigest()
        return out


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if ids and size + len(t or "") > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t or "") + 1
    if ids:
        yield ids, texts


_CHUNK_SCHEMA = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, n_group_links array<long>, "
                 "groups_sha256 array<string>, pairs array<long>, counts array<long>, entries array<long>, docs binary, times binary")


def _small(x: np.ndarray) -> bytes:
    """An array of counts in the smallest type that holds it, compressed; the
    first byte is the type's size."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + len(x).to_bytes(8, "little") + pa.compress(x.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unsmall(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[1:9], "little")
    return np.frombuffer(pa.decompress(b[9:], decompressed_size=n * b[0], codec="zstd", asbytes=True), dtype=f"<u{b[0]}").astype(np.int64)


def _align_chunks(shared, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = load(ByteBpe, shared.value[0]), load(PieceBpe, shared.value[1])
        first = TaskContext.get().partitionId() << 32
        for seq, (ids, texts) in enumerate(_chunks(batches, limit)):
            al = Alignment(texts, a, b)
            keys = []
            n_links = np.zeros(len(texts), dtype=np.int64)
            for i, j, _ in al.overlap_links():
                doc = al.doc[0][i]
                n_links += np.bincount(doc, minlength=len(texts))
                keys.append((al.ids[0][i] * b.size + al.ids[1][j]) * len(texts) + doc)
            key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
            times = np.diff(np.append(new, len(key)))
            pair, doc = key[new] // len(texts), key[new] % len(texts)
            p = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, dtype=np.int64)
            counts = np.add.reduceat(times, p) if len(p) else p
            row = {"chunk": first + seq, "doc_id": ids, "n_a": al.n_tokens[0], "n_b": al.n_tokens[1], "n_groups": al.n_groups, "n_links": n_links, "n_group_links": al.n_group_links(),
                   "groups_sha256": al.group_digests(), "pairs": pair[p], "counts": counts, "entries": np.diff(np.append(p, len(pair))), "docs": _small(doc), "times": _small(times)}
            kinds = {"chunk": pa.int64(), "groups_sha256": pa.list_(pa.string()), "docs": pa.binary(), "times": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.list_(pa.int64()))) for k, v in row.items()], names=list(row))

    return run


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_group_links long"


def _sum_up(chunk: pa.Table, stats: pa.Table) -> pa.Table:
    """Adds the corpus counts of a chunk's pairs up per document."""
    c = {k: chunk.column(k)[0] for k in chunk.column_names}
    n = len(c["doc_id"])
    order = np.argsort(stats.column("at").to_numpy())
    count, best = stats.column("count").to_numpy()[order], stats.column("best").to_numpy(zero_copy_only=False)[order]
    per = np.repeat(np.arange(len(order)), np.array(c["entries"].as_py(), dtype=np.int64))
    doc, times = _unsmall(c["docs"].as_py()), _unsmall(c["times"].as_py())
    total, n_best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    np.add.at(total, doc, times * count[per])
    np.add.at(n_best, doc, times * best[per])
    plain = {k: c[k].values for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_group_links")}
    cols = plain | {"n_best": pa.array(n_best), "count_sum": pa.array(total)}
    names = [f.split()[0] for f in _OUT.split(", ")]
    return pa.table([cols[k] for k in names], names=names)


def _shared(spark: SparkSession, a_path: str, b_path: str):
    """The two vocabulary files (fixed, a few MB), read by the driver."""
    ship_package(spark)
    return spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (a_path, b_path)))


def _input(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


_LINKS = ("doc_id long, a_ids array<int>, a_ends array<long>, b_ids array<int>, b_ends array<long>, links array<struct<a:int,b:int,bytes:int>>, group_ends array<long>")


def _list_links(shared, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = load(ByteBpe, shared.value[0]), load(PieceBpe, shared.value[1])
        for ids, texts in _chunks(batches, limit):
            for i, t in zip(ids, texts, strict=True):
                al = Alignment([t], a, b)
                links = [(int(x), int(y), int(z)) for block in al.overlap_links() for x, y, z in zip(*block, strict=True)]
                ends = [m.ptr[1:].tolist() for m in al.over_bytes]
                row = [i, al.ids[0].tolist(), ends[0], al.ids[1].tolist(), ends[1], [{"a": x, "b": y, "bytes": z} for x, y, z in links], sorted(set(ends[0]) & set(ends[1]))]
                kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.struct([(k, pa.int32()) for k in ("a", "b", "bytes")])), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in _LINKS.split(", ")])

    return run


def token_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """The alignment itself, one row per row: token ids of both tokenizers with
    the byte offsets (in space + text) where they end, the overlap links
    (positions of an A and a B token, shared bytes) and the offsets that end a
    group.  Texts without tokens have empty lists."""
    d = _input(docs, doc_id, text)
    return d.mapInArrow(_list_links(_shared(docs.sparkSession, a_path, b_path), CHUNK), _LINKS)


def alignment_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str = A_PATH, b_path: str = B_PATH, chunk: int = CHUNK) -> DataFrame:
    """One row per row: doc_id, n_a, n_b (tokens), n_groups, n_links (overlap
    links), n_best (links whose id pair is linked as often in the corpus as any
    pair of their B id), count_sum (corpus counts of the links, added up),
    groups_sha256 and n_group_links (shared-group links).

    Whole texts count.  Null and empty texts, and texts that a tokenizer does
    not give back byte by byte, have zeros and ''.  Repeated rows are documents
    of their own, a null doc_id stays null; an empty table gives no rows; other
    columns are ignored.  ``chunk`` sets the size of a piece of work alone."""
    spark = docs.sparkSession
    with arrow_rows(spark, 500):
        chunks = materialize(_input(docs, doc_id, text).mapInArrow(_align_chunks(_shared(spark, a_path, b_path), chunk), _CHUNK_SCHEMA), "token-chunks")
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "p")).select("chunk", "at", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    b_id = F.pmod("pair", F.lit(load(PieceBpe, open(b_path, "rb").read()).size))
    count = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    # pairs of a B id are distinct here: at most as many as A has ids
    known = count.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(b_id)))
    stats = pairs.select("chunk", "at", "pair").join(known, "pair").select(F.col("chunk").alias("of"), "at", "count", "best")
    return chunks.groupBy("chunk").cogroup(stats.groupBy("of")).applyInArrow(_sum_up, _OUT)
