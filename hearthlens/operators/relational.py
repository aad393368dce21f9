"""Joins, grouping, windows, ordering.

Scale rules followed here:
* grouping always goes through hash aggregation with map-side partials, so a
  hot group is pre-combined before the shuffle;
* row-level global order (row numbers, ECDF, running sums) is computed by
  range buckets with fixed bounds plus per-bucket offsets (a table with one
  row per bucket), never by one window over all rows in a single task;
* duplicate detection counts keys first (partial aggregation), then
  semi-joins back, instead of a window partitioned by a possibly hot key;
* broadcasts are limited to tables with a fixed or checked size.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# J01 -----------------------------------------------------------------------
def enrich_join(base: DataFrame, extra: DataFrame, base_key: Sequence[str], extra_key: Sequence[str],
                columns: Mapping[str, str], check_unique: bool = True) -> DataFrame:
    """Left join that adds renamed columns from a second source.

    The extra side must be unique on its key (checked with one aggregate:
    rows vs. distinct keys), so the join never multiplies base rows."""
    if check_unique:
        r = extra.agg(F.count(F.lit(1)).alias("n"),
                      F.count_distinct(*[F.col(k) for k in extra_key]).alias("d")).first()
        if r["n"] != r["d"]:
            raise ValueError(f"enrichment key not unique: {r['n']} rows, {r['d']} keys")
    sel = extra.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(extra_key)],
                       *[F.col(src).alias(dst) for src, dst in columns.items()])
    cond = [base[b] == sel[f"__k{i}"] for i, b in enumerate(base_key)]
    out = base.join(sel, cond, "left")
    return out.drop(*[f"__k{i}" for i in range(len(extra_key))])


def attach_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Ingest-order row number for key-less files (file order), via
    ``zipWithIndex`` -- the one place an RDD is needed."""
    schema = df.schema.add(name, "long")
    rdd = df.rdd.zipWithIndex().map(lambda t: (*t[0], t[1]))
    return df.sparkSession.createDataFrame(rdd, schema)


def positional_merge(base: DataFrame, extra: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Join two frames on an explicit row id; a row-count mismatch fails."""
    nb, ne = base.count(), extra.count()
    if nb != ne:
        raise ValueError(f"row-count mismatch in positional merge: {nb} vs {ne}")
    return base.join(extra, id_col, "inner")


# J02 -----------------------------------------------------------------------
def lookup_join(df: DataFrame, lookup: DataFrame, keys: Sequence[str], value: str, default=None,
                out: str | None = None, broadcast: bool = False) -> DataFrame:
    """Left lookup by a (compound) key with a default; ``broadcast`` is for
    lookups of fixed, small size alone (code tables, config)."""
    out = out or value
    lk = F.broadcast(lookup) if broadcast else lookup
    res = df.join(lk.select(*keys, F.col(value).alias("__lv")), list(keys), "left")
    v = F.coalesce(F.col("__lv"), F.lit(default)) if default is not None else F.col("__lv")
    return res.withColumn(out, v).drop("__lv")


# J03 -----------------------------------------------------------------------
def expand_by_catalogue(df: DataFrame, items: Sequence[Mapping], name: str = "scenario") -> DataFrame:
    """Every row x every catalogue item, as a per-row ``explode`` of a literal
    array (a narrow Generate, no join): the catalogue is config of fixed size."""
    arr = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in it.items()]) for it in items])
    return df.withColumn(name, F.explode(arr))


# G02 / G03 -----------------------------------------------------------------
def group_mean_median_count(df: DataFrame, keys: Sequence[str], value: str, approx: bool = False) -> DataFrame:
    """Mean, median, count per group.  The exact median per group comes from
    the distributed counting quantile (no per-group value map in one task)
    and is joined to the group-level aggregate (one row per group)."""
    from hearthlens.operators.quantiles import group_quantiles

    if approx:
        med = F.percentile_approx(value, 0.5, 10000)
        return df.groupBy(*keys).agg(F.avg(value).alias("mean"), med.alias("median"), F.count(value).alias("count"))
    g = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
    med = group_quantiles(df, keys, value, [0.5], ["median"])
    return join_groups(g, med, keys).select(*keys, "mean", "median", "count")


def group_mean_std_count(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                 F.count(value).alias("count"))


# G05 -----------------------------------------------------------------------
def quantiles_table(df: DataFrame, value: str, probs: Sequence[float], approx: bool = False) -> DataFrame:
    """(p, value) for every probability: exact by distributed counting, or approx."""
    if approx:
        arr = df.agg(F.percentile_approx(value, list(probs), 10000).alias("q"))
        return arr.select(F.posexplode("q").alias("i", "value")).select(
            F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1).alias("p"), "value")
    from hearthlens.operators.quantiles import column_quantiles

    res = column_quantiles(df, [value], probs)[value]
    return df.sparkSession.createDataFrame([(float(p), v) for p, v in zip(probs, res)], "p double, value double")


# G06 - G09 -----------------------------------------------------------------
def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r for every pair (a < b by list position), pairwise-complete
    rows (the pandas rule), from two passes of plain sums; the p x p result
    is a long table (col_a, col_b, pos_a, pos_b, r)."""
    from hearthlens.operators.stats import pairwise_moments

    cols = list(cols)
    _, _, corr = pairwise_moments(df, cols)
    rows = [(cols[i], cols[j], i, j, None if corr[i, j] != corr[i, j] else float(corr[i, j]))
            for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, pos_a int, pos_b int, r double")


def correlated_pairs(corr: DataFrame, limit: float = 0.7, inclusive: bool = False) -> DataFrame:
    cond = F.abs("r") >= limit if inclusive else F.abs("r") > limit
    return corr.where(cond)


def redundant_columns(corr: DataFrame, limit: float = 0.95, protect: Sequence[str] = ()) -> DataFrame:
    """The later column (by position) of every pair above the limit."""
    hits = corr.where(F.abs("r") > limit).where(~F.col("col_b").isin(list(protect)))
    return hits.select(F.col("col_b").alias("column_name")).distinct()


# G10 -----------------------------------------------------------------------
def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


# G11 / G12 -----------------------------------------------------------------
def unpivot_features(df: DataFrame, ids: Sequence[str], features: Sequence[str],
                     name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(features), name, value)


def group_feature_abs_mean(long: DataFrame, group: str, feature: str = "feature", value: str = "value",
                           signed_first: bool = True) -> DataFrame:
    """Per group: |mean| per feature (``signed_first``) or mean |v|; then the
    mean over features as ``mean_abs_overall``."""
    v = F.col(value)
    per = long.groupBy(group, feature).agg((F.abs(F.avg(v)) if signed_first else F.avg(F.abs(v))).alias("value"))
    overall = per.groupBy(group).agg(F.avg("value").alias("mean_abs_overall"))
    return per, overall


def mean_abs_by_feature(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    return long.groupBy(feature).agg(F.avg(F.abs(value)).alias("mean_abs"))


# G13 -----------------------------------------------------------------------
def histogram(df: DataFrame, value: str, bins: int = 80) -> DataFrame:
    """Equal-width bins over [min, max]; the last edge is inclusive."""
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = float(r["lo"]), float(r["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("bin_lo", F.lit(lo) + F.col("bin") * F.lit(width)))


# G14 -----------------------------------------------------------------------
def band_counts(df: DataFrame, band_col: str, bands: Sequence[str]) -> DataFrame:
    """Count per band with every band kept (0 when empty): left join from the
    fixed band list (a literal table of config size)."""
    spark = df.sparkSession
    blist = spark.createDataFrame([(b, i) for i, b in enumerate(bands)], f"{band_col} string, band_order int")
    counts = df.groupBy(band_col).agg(F.count(F.lit(1)).alias("n"))
    return blist.join(counts, band_col, "left").select(band_col, "band_order", F.coalesce("n", F.lit(0)).alias("n"))


# W02 / W05 / W06 -------------------------------------------------------------
def range_buckets(df: DataFrame, order: Sequence[Column], per_bucket: int = 32) -> Column:
    """Bucket number of a row as a pure function of its order keys.

    Bounds come from one small job (a random sample of ``per_bucket`` rows a
    bucket; they decide balance, never results) and are written into the
    expression, so every branch of a plan agrees on them.  Keys compare as one
    struct: nulls first, NaN last, and a constant leading key does not pile up."""
    spark = df.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    sample = df.select(key.alias("k")).orderBy(F.rand(17)).limit(per_bucket * buckets)
    types = sample.schema["k"].dataType.fields
    rows = [r["k"] for r in sample.orderBy("k").collect()]
    picked = [rows[i * len(rows) // buckets] for i in range(1, buckets)] if rows else []
    bounds = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, types)]) for r in dict.fromkeys(picked)]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key <= bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def distributed_running(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column],
                        row_number: str | None = None) -> DataFrame:
    """Running sums (and an optional global row number) in the ascending order
    of the ``order`` expressions, without a single-partition window: rows get
    a range bucket that depends on their keys alone, totals per bucket (one
    row per bucket) become offsets, and bucket-local running sums are added."""
    metrics = dict(sums) | ({"__one": F.lit(1)} if row_number else {})
    ranged = df.withColumn("__b", range_buckets(df, order)).withColumns({f"__v_{k}": v for k, v in metrics.items()})
    tot = ranged.groupBy("__b").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in metrics])
    w_off = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("__b", *[F.coalesce(F.sum(f"__t_{k}").over(w_off), F.lit(0)).alias(f"__o_{k}") for k in metrics])
    w = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"__c_{k}": F.sum(f"__v_{k}").over(w) for k in metrics})
    joined = local.join(F.broadcast(offs), "__b")  # a row per bucket
    outs = {k: F.col(f"__c_{k}") + F.col(f"__o_{k}") for k in sums}
    if row_number:
        outs[row_number] = (F.col("__c___one") + F.col("__o___one")).cast("long")
    keep = [c for c in df.columns if c not in outs]
    return joined.select(*keep, *[c.alias(k) for k, c in outs.items()])


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of two group-level tables that keeps null groups."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(r, cond, "left").drop(*[f"__r_{k}" for k in keys])


def row_position(df: DataFrame, key: Sequence[str], name: str = "row_pos") -> DataFrame:
    """Stable 1-based row number by key, distributed (see ``distributed_running``)."""
    return distributed_running(df, [F.col(k) for k in key], {}, row_number=name)


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, n, cum_n, F) per distinct value; rows collapse to distinct
    values first (partial aggregation), then the running count."""
    total = df.where(F.col(value).isNotNull()).count()
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    run = distributed_running(counts, [F.col(value)], {"cum_n": F.col("n")})
    return run.withColumn("ecdf", F.col("cum_n") / F.lit(float(total)))


# W04 -----------------------------------------------------------------------
def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once (count per key with map-side
    partials, then a semi join back -- AQE splits a hot key on the big side)."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).drop("__n")
    return df.join(dup, list(keys), "left_semi")


# T03 / T04 -----------------------------------------------------------------
def top_k_abs_per_row(df: DataFrame, row_keys: Sequence[str], features: Sequence[str], k: int = 3) -> DataFrame:
    """Row keys, feature, value, rank: the k features of largest |value| of each
    row, ties by name; nulls take no part.

    The row's features are sorted inside an array, so nothing is shuffled."""
    items = F.array(*[F.struct((-F.abs(F.col(c).cast("double"))).alias("s"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    best = F.slice(F.array_sort(F.filter(items, lambda x: x["value"].isNotNull())), 1, k)
    return (df.select(*row_keys, F.posexplode(best).alias("at", "f"))
            .select(*row_keys, F.col("f.feature").alias("feature"), F.col("f.value").alias("value"), (F.col("at") + 1).alias("rank")))


def argmax_by_group(df: DataFrame, group: str, item: str, score: Column) -> DataFrame:
    """The item with the largest score of each group; ties go to the smallest item."""
    best = df.groupBy(group, F.col(item).alias("__i")).agg(F.max(score).alias("__s"))
    best = best.groupBy(group).agg(F.min(F.struct((-F.col("__s")).alias("s"), F.col("__i").alias("i"))).alias("__b"))
    return best.select(group, F.col("__b.i").alias(item), (-F.col("__b.s")).alias("score"))
