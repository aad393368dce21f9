"""Filter interaction audit: what each filter removes in every order.

A chain of filters removes a row at the first filter that it fails.  Rows
matter only through the set of filters they fail (their mask), so Spark counts
rows by (part, mask) and the orders are worked out on masks:

* mask matrix M (masks x filters): 0 where the mask fails the filter, infinity
  elsewhere; position matrix P (filters x orders): the inverse permutation of
  each order, i.e. the step at which the order applies a filter;
* the min-plus product M (x) P, min over filters of M + P, is the step that
  removes a mask in an order (infinity: never);
* counts are scattered to (order, removal step), weighted by the rows of a
  mask; a step's redundancies are the failures of its filter less its removals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlens.llm.common import UPPER, words_of
from hearthlens.session import ship_package

#: step of a mask that no filter removes
NEVER = np.iinfo(np.int32).max // 2

_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
           "good_lost long, toxic_lost long, shapley long")


def all_orders(n: int) -> np.ndarray:
    """Every order of n filters, one row each: order[o, s] is the filter at step s."""
    return np.array(list(permutations(range(n))), dtype=np.int64).reshape(-1, n)


def positions(orders: np.ndarray) -> np.ndarray:
    """Inverse permutations, steps counted from 1: positions[o, f]."""
    out = np.empty_like(orders)
    np.put_along_axis(out, orders, np.arange(1, orders.shape[1] + 1)[None, :].repeat(len(orders), 0), axis=1)
    return out


def mask_matrix(masks: np.ndarray, n: int) -> np.ndarray:
    """0 where bit f of a mask is set (the filter is failed), NEVER elsewhere."""
    return np.where(masks[:, None] >> np.arange(n) & 1, 0, NEVER)


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of a (m x f) and b (f x o) with minimum for sum and sum for product."""
    out = np.full((a.shape[0], b.shape[1]), NEVER, dtype=np.int64)
    for f in range(a.shape[1]):
        np.minimum(out, a[:, f, None] + b[f][None, :], out=out)
    return out


def removal_steps(masks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The step (from 1) at which each order removes each mask, NEVER if none."""
    return np.minimum(min_plus(mask_matrix(masks, orders.shape[1]), positions(orders).T), NEVER)


def audit_counts(weights: np.ndarray, orders: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of one part.

    ``weights`` (kinds x 2**n): rows of each mask; kind 0 counts rows, further
    kinds any other weights.  Returns removed (kinds x orders x n), kept and
    redundant (orders x n) of kind 0, and unique_fails and shapley (n)."""
    n = orders.shape[1]
    masks = np.arange(1 << n)
    rank = removal_steps(masks, orders)
    m, o = np.nonzero(rank < NEVER)
    step = rank[m, o] - 1
    removed = np.zeros((len(weights), len(orders), n), dtype=np.int64)
    for kind, w in enumerate(weights):
        np.add.at(removed[kind], (o, step), w[m])
    fails = (masks[:, None] >> np.arange(n) & 1).T @ weights[0]
    shapley = np.zeros(n, dtype=np.int64)
    np.add.at(shapley, orders, removed[0])
    return {"removed": removed, "kept": weights[0].sum() - removed[0].cumsum(axis=1), "redundant": fails[orders] - removed[0],
            "unique_fails": weights[0][1 << np.arange(n)], "shapley": shapley}


def _expander(names: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = all_orders(len(names))
        n_rows = orders.size
        order_names = np.repeat(["".join(names[f] for f in o) for o in orders], len(names)).tolist()
        steps = np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                weights = np.zeros((3, 1 << len(names)), dtype=np.int64)
                for c in cells:
                    weights[:, c["mask"]] += (c["n"], c["good"], c["toxic"])
                a = audit_counts(weights, orders)
                cols = [a["kept"], a["removed"][0], a["redundant"], a["unique_fails"][orders], a["removed"][1], a["removed"][2], a["shapley"][orders]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * n_rows, pa.string()), pa.array(order_names, pa.string()), pa.array(steps), *(pa.array(c.ravel(), pa.int64()) for c in cols)],
                                                 names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    return run


def audit(cells: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Every part in every order at every step.

    ``cells``: part, mask (bit i: filter ``names[i]`` is failed), n, good and
    toxic (longs); rows of the same part and mask are added up.  A part has at
    most 2**len(names) cells, so one part is a bounded piece of work."""
    ship_package(cells.sparkSession)
    packed = (cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
              .groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))
    return packed.mapInArrow(_expander(names), _SCHEMA)


def text_filters(text: Column, words: Column) -> list[Column]:
    """The failure conditions A to D of a text that is not null and its words."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Audit of the five filters over whole documents.

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic.  A: under
    50 words; B: distinct words under 65 % of the words; C: A-Z over 5 % of the
    code points; D: one of ``#$%&*|``; E: the text of a smaller doc_id.

    Null text is empty, null source is the empty part.  A row without doc_id
    never fails E, makes no other row fail it and has no label.  Rows that
    repeat a doc_id are rows of their own; equal ids are not smaller.  A
    document is good (toxic) if any label row of its id says so.  Empty tables
    give no rows; other columns are ignored.

    Texts are read once; after that a row is its id, part, four bits and a
    SHA-256.  Copies meet as (hash, part) sums, built map-side, so a text that
    holds a third of all rows is never gathered in one task.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_filters(F.col("t"), F.col("w")))), F.lit(0))
    rows = d.withColumn("w", words_of(F.col("t"))).select("doc_id", "part", bits.cast("int").alias("mask"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("h"))
    said = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("g"), (F.col("toxic") == 1).cast("int").alias("x"))
            .groupBy("doc_id").agg(F.max("g").alias("g"), F.max("x").alias("x")))
    each = (rows.join(said, "doc_id", "left").groupBy("doc_id", "h", "part", "mask")
            .agg(F.count("*").alias("n"), F.max(F.coalesce("g", F.lit(0))).cast("long").alias("g"), F.max(F.coalesce("x", F.lit(0))).cast("long").alias("x"))
            .select("doc_id", "h", "part", "mask", F.struct("n", (F.col("g") * F.col("n")).alias("good"), (F.col("x") * F.col("n")).alias("toxic")).alias("c")))
    kinds = ("n", "good", "toxic")
    no_id = F.col("doc_id").isNull()
    copies = each.groupBy("h", "part", "mask").agg(
        F.min(F.when(~no_id, F.struct("doc_id", "c"))).alias("first"),
        *(F.sum(F.col(f"c.{k}")).alias(k) for k in kinds), *(F.sum(F.when(no_id, F.col(f"c.{k}")).otherwise(0)).alias(f"{k}0") for k in kinds))
    # a text has one row a part here, so this window holds at most the parts
    least = F.min("first.doc_id").over(Window.partitionBy("h"))
    own = F.col("first.doc_id") == F.col("least")
    spared = {k: F.col(f"{k}0") + F.when(own, F.col(f"first.c.{k}")).otherwise(0) for k in kinds}
    cells = copies.withColumn("least", least).select("part", F.explode(F.array(
        F.struct("mask", *(spared[k].alias(k) for k in kinds)),
        F.struct((F.col("mask") + 16).alias("mask"), *((F.col(k) - spared[k]).alias(k) for k in kinds)))).alias("c")).select("part", "c.*")
    return audit(cells)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS g, max((toxic = 1)::INT) AS x FROM labels GROUP BY doc_id),
w AS (SELECT d.*, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS ws,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS fe FROM d),
f AS (SELECT part, len(ws) < 50 AS fa, 100 * len(list_distinct(ws)) < 65 * len(ws) AS fb,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS fc,
             regexp_matches(t, '[#$%&*|]') AS fd, fe, count(*) AS n, sum(coalesce(g, 0)) AS g, sum(coalesce(x, 0)) AS x
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT c1.k || c2.k || c3.k || c4.k || c5.k AS filter_order FROM c c1, c c2, c c3, c c4, c c5
      WHERE len(list_distinct([c1.k, c2.k, c3.k, c4.k, c5.k])) = 5),
r AS (SELECT f.*, filter_order, least(CASE WHEN fa THEN strpos(filter_order, 'A') ELSE 9 END, CASE WHEN fb THEN strpos(filter_order, 'B') ELSE 9 END,
             CASE WHEN fc THEN strpos(filter_order, 'C') ELSE 9 END, CASE WHEN fd THEN strpos(filter_order, 'D') ELSE 9 END,
             CASE WHEN fe THEN strpos(filter_order, 'E') ELSE 9 END) AS gone FROM f, o),
s AS (SELECT *, substr(filter_order, step, 1) AS k,
             CASE substr(filter_order, step, 1) WHEN 'A' THEN fa WHEN 'B' THEN fb WHEN 'C' THEN fc WHEN 'D' THEN fd ELSE fe END AS own,
             fa::INT + fb::INT + fc::INT + fd::INT + fe::INT AS fails
      FROM r, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
a AS (SELECT part, filter_order, step, k, sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN own AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN own AND fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN gone = step THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = step THEN x ELSE 0 END)::BIGINT AS toxic_lost
      FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM a
"""
