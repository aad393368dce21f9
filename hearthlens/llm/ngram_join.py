"""N-gram Jaccard join: exact links between documents that share word shingles.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets
of distinct k-word shingles.  Method:

1. Documents with equal sets form a class; one representative goes on.
2. Tokens are ordered rarest first (frequencies from a count sketch over all
   documents, then the hash; any total order keeps the filter exact).  Two
   linked sets share at least two tokens of their *extended* prefixes of
   ``n - ceil(t n) + 2`` tokens.
3. Tokens of those prefixes that few representatives have are indexed as
   single tokens.  Tokens that many have are indexed in combinations of two:
   a linked pair shares either a rare token or two frequent ones.  Sets so
   small that one shared token may link them are indexed by single tokens.
4. Before pairs are made inside a posting list, its members are compared with
   a hub of the list and linked members are merged into components; pairs are
   then made only between members of different components.  Links inside one
   component cannot change the result, so nothing is lost and a large group of
   near copies costs a line of comparisons and not a square.
5. Every candidate pair is verified on the whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlens.llm.common import components, keep_ids, materialize, small_batches
from hearthlens.llm.texthash import U, mix, pack_sorted, shingle_sets, text_chunks, unpack_sorted
from hearthlens.session import ship_package

SKETCH_BITS, CHUNK_BITS = 20, 14


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


def _sets(batches, k):
    """(doc_ids, sets) for each run of texts of the Arrow batches."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for first, run in text_chunks(texts):
            yield ids.slice(first, len(run)), list(shingle_sets(run, k))


def _profile(k):
    """Rows of kind 0: a document's set size and set fingerprint; of kind 1: a
    part of this task's frequency sketch."""

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for ids, sets in _sets(batches, k):
            n = np.array([len(s) for s in sets], dtype=np.int64)
            flat = np.concatenate([*sets, np.zeros(1, dtype=U)])
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            sketch += np.bincount((flat[:-1] >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            f1, f2 = (np.where(n > 0, np.add.reduceat(np.append(mix(flat[:-1] ^ U(c)), U(0)), at), U(0)) for c in (0x1234567, 0x89ABCDEF01))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), dtype=np.int32)), ids, pa.array(n), pa.array(_signed(f1)), pa.array(_signed(f2)), pa.nulls(len(n), pa.binary())],
                                             names=["kind", "doc_id", "n", "f1", "f2", "part"])
        parts = sketch.reshape(-1, 1 << CHUNK_BITS)
        used = [i for i in range(len(parts)) if parts[i].any()]
        if used:
            task = TaskContext.get().partitionId()
            m = len(used)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, dtype=np.int32)), pa.nulls(m, pa.int64()), pa.array(np.array(used, dtype=np.int64)), pa.array(np.full(m, task // 64, dtype=np.int64)),
                                              pa.nulls(m, pa.int64()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["kind", "doc_id", "n", "f1", "f2", "part"])

    return run


def _add_parts(key, table):
    out = np.zeros(1 << CHUNK_BITS, dtype=np.int64)
    for b in table.column("part"):
        out += np.frombuffer(b.as_py(), dtype=np.int64)
    names = table.column_names
    row = {"chunk": [key[0].as_py()], "part": [out.tobytes()]}
    if "f1" in names:
        row["f1"] = [key[1].as_py()]
    return pa.table(row, schema=pa.schema([("chunk", pa.int64())] + ([("f1", pa.int64())] if "f1" in names else []) + [("part", pa.binary())]))


def frequency_levels(parts: DataFrame) -> bytes:
    """The sketch over all documents as one byte per bucket (quarters of a
    power of two).  Its size is fixed (2**20 bytes) whatever the input; parts
    are added in two steps so that no group holds those of all tasks."""
    once = parts.groupBy("chunk", "f1").applyInArrow(_add_parts, "chunk long, f1 long, part binary")
    total = once.drop("f1").groupBy("chunk").applyInArrow(_add_parts, "chunk long, part binary")
    levels = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for r in total.collect():  # 64 rows of 128 KB at most
        c = np.frombuffer(r["part"], dtype=np.int64)
        levels[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.minimum(127, 4 * np.log2(1.0 + c)).astype(np.uint8)
    return levels.tobytes()


def prefix_length(n: int, percent: int, extra: int) -> int:
    """Tokens of a set of n that must hold ``extra`` shared ones of any linked set."""
    return min(n, n - -(-percent * n // 100) + extra)


def _prefixes(k, percent, extra, levels):
    def run(batches):
        lv = np.frombuffer(levels.value, dtype=np.uint8).astype(U)
        for ids, sets in _sets(batches, k):
            n, out = [], []
            for s in sets:
                key = np.sort((lv[(s >> U(64 - SKETCH_BITS)).astype(np.int64)] << U(56)) | (s >> U(8)))
                n.append(len(s))
                out.append(_signed(key[: prefix_length(len(s), percent, extra)]))
            at = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            flat = np.concatenate([*out, np.zeros(0, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["doc_id", "n", "tokens"])

    return run


def _whole_sets(k):
    def run(batches):
        for ids, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([ids, pa.array([pack_sorted(s) for s in sets], pa.binary())], names=["doc_id", "set"])

    return run


def _verify(percent):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep, last, left = [], None, None
            for i in range(batch.num_rows):
                raw = x[i].as_buffer()
                if last is None or not raw.equals(last):
                    last, left = raw, unpack_sorted(raw)
                right = unpack_sorted(y[i].as_buffer())
                at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                inter = int((left[at] == right).sum())
                keep.append(100 * inter >= percent * (len(left) + len(right) - inter))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verify_pairs(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose whole shingle sets are similar enough.
    docs: doc_id, text with distinct ids."""
    pairs = materialize(pairs, "ngram-pairs")
    need = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    sets = keep_ids(docs, need).mapInArrow(_whole_sets(k), "doc_id long, set binary")
    both = (pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
            .join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a"))
    return both.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")


def _close(percent: int, before: int):
    """Length and positional filters for sets of n and m tokens with a common
    token at places i and j that has at most ``before`` common ones before it.
    A similar pair passes at the first or second common token."""
    n, m, i, j = (F.col(c) for c in "nmij")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * (F.least(n - i, m - j) + before) >= percent * (n + m))


def links(docs: DataFrame, k: int, percent: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """(classes, links between representatives).

    docs: doc_id (long, not null), text.  classes: doc_id, n, rep (smallest
    doc_id with an equal set; null for an empty set).  links: a, b
    representatives; enough of them that the components are exact.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    prof = materialize(docs.mapInArrow(_profile(k), "kind int, doc_id long, n long, f1 long, f2 long, part binary"), "ngram-profile")
    levels = spark.sparkContext.broadcast(frequency_levels(prof.where("kind = 1").select(F.col("n").alias("chunk"), "f1", "part")))
    sizes = prof.where("kind = 0").select("doc_id", "n", "f1", "f2")
    reps = sizes.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    classes = sizes.join(reps, ["n", "f1", "f2"], "left").select("doc_id", "n", "rep")

    pre = keep_ids(docs, reps.select(F.col("rep").alias("doc_id"))).mapInArrow(_prefixes(k, percent, 2, levels), "doc_id long, n long, tokens array<long>")
    pre = materialize(pre, "ngram-prefixes")
    post = pre.select(F.col("doc_id").alias("rep"), "n", F.posexplode("tokens").alias("i", "tok"))
    lists = post.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    post = materialize(post.join(lists, "tok").select("tok", "rep", "n", "i", "df"), "ngram-postings")
    hubs = post.groupBy("tok").agg(F.min(F.struct("rep", "n", "i")).alias("hub")).select("tok", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("m"), F.col("hub.i").alias("j"))

    found = materialize(verify_pairs(docs, post.join(hubs, "tok").where((F.col("rep") != F.col("hub")) & _close(percent, 1)).groupBy(F.col("hub").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("c")).where("c > 1").select("a", "b"), k, percent), "ngram-links")

    # the lists that still hold several components, once more with another hub:
    # a member of the last component
    def open_lists(found):
        named = post.join(components(found).withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        mixed = named.groupBy("tok").agg(F.min("comp").alias("lo"), F.max(F.struct("comp", "rep", "n", "i")).alias("top")).where("lo <> top.comp")
        return named.join(mixed, "tok")

    second = open_lists(found).where("comp <> top.comp").select("rep", "n", "i", F.col("top.rep").alias("hub"), F.col("top.n").alias("m"), F.col("top.i").alias("j"))
    pairs = second.where(_close(percent, 1)).select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    found = materialize(found.union(verify_pairs(docs, pairs, k, percent)).distinct(), "ngram-links")

    # the rest, exactly: a similar pair shares two tokens or more of its
    # prefixes, so one of the first two is rare or both are frequent; where one
    # shared token is enough (n + m <= 1 + 100 / percent) both sets are small
    rest = materialize(open_lists(found).select("tok", "rep", "n", "i", "df", "comp"), "ngram-rest")
    rare = rest.where((F.col("df") <= frequent) | (F.col("n") * percent <= 100)).select("tok", F.lit(0).cast("long").alias("tok2"), "rep", "n", "i", "comp")
    combos = (rest.where(F.col("df") > frequent).groupBy("rep", "n", "comp").agg(F.sort_array(F.collect_set(F.struct("i", "tok"))).alias("t"))
              .select("rep", "n", "comp", "t", F.posexplode("t").alias("at", "first"))
              .select("rep", "n", "comp", F.col("first.i").alias("i"), F.col("first.tok").alias("tok"), F.explode(F.slice("t", F.col("at") + 2, F.size("t"))).alias("second")))
    combos = combos.select("tok", F.col("second.tok").alias("tok2"), "rep", "n", "i", "comp")
    for index, before in ((rare, 1), (combos, 0)):
        mixed = index.groupBy("tok", "tok2").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok", "tok2")
        index = index.join(mixed, ["tok", "tok2"], "left_semi")
        x = index.select("tok", "tok2", F.col("rep").alias("a"), "n", "i", F.col("comp").alias("ca"))
        y = index.select("tok", "tok2", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("comp").alias("cb"))
        pairs = x.join(y, (x.tok == y.tok) & (x.tok2 == y.tok2) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _close(percent, before)).select("a", "b").distinct()
        found = materialize(found.union(verify_pairs(docs, pairs, k, percent)).distinct(), "ngram-links")
    return classes, found


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, frequent: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest
    doc_id reachable by links, itself included).

    Words are runs of non-blanks with A-Z lower-cased; blank or null text has
    an empty set and links with nothing.  Rows that repeat a doc_id each give
    a row, and a link of any of their texts counts for the id; rows without a
    doc_id are left out.  An empty table gives no rows; other columns are
    ignored.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    classes, found = links(d, k, percent, frequent)
    comp = components(found).select(F.col("id").alias("rep"), "comp")
    return (classes.join(comp, "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "doc_id").alias("component_id")))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id
    (rows that repeat that id stay together); everything else stays, rows
    without an id included, with all columns."""
    comp = ngram_components(docs, doc_id, text, **options).where("doc_id <> component_id")
    return keep_ids(docs, comp.select(F.col("doc_id").alias(doc_id)), "left_anti").select(*docs.columns)
