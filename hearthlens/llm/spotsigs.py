"""Document fingerprints: SpotSigs.

A spot signature is a common word (anchor) with the chain of content words
that follows it.  So that texts with few anchors have a fingerprint too, a
share of the pairs of neighbouring words, chosen by their own hash, and the
pair of smallest hash are signatures as well; this one rule holds for every
text, so a small edit moves the set by a few members only.  A fingerprint is
the set of distinct signatures, written as sorted 32-bit hashes in hex.

Fingerprints are compared by Jaccard similarity.  For a search with a floor,
sets are put in length classes such that only equal or neighbouring classes
can reach it, and the ratio of lengths bounds the similarity before any
intersection is made.

Column expressions and DataFrame operators only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlens.llm.common import materialize

#: Very common words of English, French, German and Spanish.
ANCHORS = ["the", "of", "and", "to", "is", "that", "de", "la", "le", "les", "et", "des", "der", "die", "und", "das", "den", "el", "los", "que", "en"]


def spot_pattern(chain: int, anchors: list[str] = ANCHORS) -> str:
    """An anchor and the ``chain`` next content words; anchors between them
    are passed over (and kept in the text of the signature)."""
    a = f"(?:{'|'.join(anchors)})(?![^ ])"
    return f"(?<![^ ])(?=({a}(?: (?:{a} )*+(?!{a})[^ ]+){{{chain}}}))"


def with_signatures(df: DataFrame, text: str, out: str, chain: int = 2, one_in: int = 4) -> DataFrame:
    """Adds ``out``: the sorted distinct signature hashes of column ``text``
    (not null): its spots, the pairs of neighbouring words whose hash is a
    multiple of ``one_in``, and the pair of smallest hash.  The last word pairs
    with nothing; a text without words stands for itself; an empty text has
    none."""
    df = df.withColumn("__norm", F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")))
    df = df.withColumn("__spots", F.transform(F.regexp_extract_all("__norm", F.lit(spot_pattern(chain)), F.lit(1)), lambda s: F.hash(s))).withColumn("__words", F.split("__norm", " "))
    df = df.withColumn("__pairs", F.transform("__words", lambda w, i: F.hash(w, F.get("__words", i + 1))))
    chosen = F.filter("__pairs", lambda h: F.pmod(h, F.lit(one_in)) == 0)
    sigs = (F.when(F.col(text) == "", F.array().cast("array<int>")).when(F.col("__norm") == "", F.array(F.hash(text)))
            .otherwise(F.concat("__spots", chosen, F.array(F.array_min("__pairs")))))
    return df.withColumn(out, F.sort_array(F.array_distinct(sigs))).drop("__norm", "__spots", "__words", "__pairs")


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def length_class(sigs: Column, floor: float) -> Column:
    """Partition of a set by its length: lengths of classes two apart differ
    by more than the floor allows."""
    return F.floor(F.log(F.size(sigs) + 1) / math.log(1 / floor)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity; two empty sets are alike."""
    n, m = F.size(a), F.size(b)
    inter = F.size(F.array_intersect(a, b))
    return F.when((n == 0) & (m == 0), 1.0).otherwise(inter / F.greatest(n + m - inter, F.lit(1)))


def pruned_jaccard(a: Column, b: Column, floor: float) -> Column:
    """Jaccard similarity for a search: 0 where the lengths alone keep it below
    ``floor``."""
    n, m = F.size(a), F.size(b)
    apart = F.abs(length_class(a, floor) - length_class(b, floor)) > 1
    return F.when(apart | (F.least(n, m) < floor * F.greatest(n, m)), 0.0).otherwise(jaccard(a, b))


def _next_key(keys: DataFrame, most: int = 100_000) -> DataFrame:
    """bucket, after: the next lower bucket of ``keys`` (distinct); after the
    lowest the highest.

    Up to ``most`` keys are ordered by one window, keys alone.  More are
    ordered within their parents (the key without its last ten bits, 1024 at
    most), and the last of a parent takes the highest of the next parent, which
    is found in the same way; so sparse ids just have more levels.  ``most`` is
    2 at least (0 and -1 are their own parents)."""
    if keys.count() <= most:
        w = Window.orderBy(F.desc("bucket"))
        return keys.select("bucket", F.lead("bucket").over(w).alias("after"), F.max("bucket").over(Window.partitionBy()).alias("top")).select("bucket", F.coalesce("after", "top").alias("after"))
    keys = keys.select("bucket", F.shiftright("bucket", 10).alias("__sup"))
    tops = materialize(keys.groupBy("__sup").agg(F.max("bucket").alias("__top")), "next-keys")
    after = _next_key(tops.select(F.col("__sup").alias("bucket")), most).select(F.col("bucket").alias("__sup"), F.col("after").alias("__after"))
    low = after.join(tops.select(F.col("__sup").alias("__after"), F.col("__top").alias("__low")), "__after").select("__sup", "__low")
    w = Window.partitionBy("__sup").orderBy(F.desc("bucket"))
    return keys.withColumn("__lead", F.lead("bucket").over(w)).join(low, "__sup").select("bucket", F.coalesce("__lead", "__low").alias("after"))


def with_next(raw: DataFrame, carried: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda d: d, bits: int = 10, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``prepare(raw)`` with ``next_<c>`` of the next row by descending doc_id
    (ties by the hash of the first carried column, one of ``raw``); after the
    last comes the first.

    Rows are shuffled once, by blocks of 2**bits ids; the first row of each
    block is looked up for the last row of the block before it.  These first
    rows are picked before ``prepare`` runs on them."""
    tie = F.xxhash64(carried[0])
    raw = raw.withColumn("bucket", F.shiftright("doc_id", bits))
    heads = materialize(raw.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")), "next-heads")
    ids = heads.select("doc_id")
    if heads.count() * 16 <= broadcast_bytes:  # else a shuffle join, by size
        ids = F.broadcast(ids)
    first = raw.join(ids, "doc_id", "left_semi").withColumn("__r", F.row_number().over(Window.partitionBy("bucket").orderBy(tie))).where("__r = 1")
    first = prepare(first).select(F.col("bucket").alias("after"), F.struct(*carried).alias("__first"))
    first = _next_key(heads.select("bucket")).join(first, "after").drop("after")
    rows = prepare(raw)
    w = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), tie)
    led = rows.withColumn("__lead", F.lead(F.struct(*carried)).over(w))
    return (led.join(first, "bucket", "left").withColumn("__next", F.coalesce("__lead", "__first"))
            .select(*rows.columns, *[F.col(f"__next.{c}").alias(f"next_{c}") for c in carried]).drop("bucket"))


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chain: int = 2) -> DataFrame:
    """Fingerprints of every whole text and of its edited text: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    Edited: the last floor(n_chars / 3) code points give way to the first as
    many (or all) of the next document by descending doc_id; after the last
    comes the first.  Null text is empty.  Rows that repeat a doc_id stand in
    the order of their text's hash; rows without a doc_id have no place in the
    order and are their own next.  An empty table gives no rows; other columns
    are ignored.  Likenesses are whole Jaccard similarities, without a floor.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def signed(d):
        return with_signatures(d, "text", "sigs", chain)

    placed = with_next(rows.where("doc_id is not null"), ["text", "sigs"], signed)
    lone = signed(rows.where("doc_id is null")).select("*", F.col("text").alias("next_text"), F.col("sigs").alias("next_sigs"))
    both = placed.unionByName(lone).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    both = with_signatures(both, "edited", "edited_sigs", chain)
    return both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"),
                       fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                       jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
