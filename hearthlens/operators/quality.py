"""Data-quality profiling.

Profiles are computed as *one wide aggregate* per batch of columns (partial
aggregation map-side, one tiny shuffle), then turned into a long table
``(column_name, ...)`` with ``unpivot``.  Batches are capped at
``MAX_EXPRS`` aggregate expressions so generated code stays under the JVM
method-size limit even for tables with hundreds of columns.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlens.session import cut_lineage

from hearthlens.operators.clean import numeric_columns, string_columns

MAX_EXPRS = 120

# FIXED VALUES — tokens treated as "missing" in text columns by the profile.
SUSPICIOUS_TOKENS = [".", "-", "*", "?", "0", "0.0", "None", "nan", "none", "?", "N/A", "NAN"]
# FIXED VALUES — yes/no vocabulary for binary text detection.
YES_NO_VALUES = ["yes", "no", "y", "n", "true", "false", "t", "f", "1", "0"]


def _wide_to_long(df: DataFrame, metrics: dict[str, callable], cols: Sequence[str]) -> DataFrame:
    """For each metric name -> fn(col) build one aggregate per column, in
    batches, and return a long table (column_name, <metric>...)."""
    out = None
    cols = list(cols)
    per_batch = max(1, MAX_EXPRS // max(1, len(metrics)))
    for start in range(0, len(cols), per_batch):
        batch = cols[start:start + per_batch]
        exprs = [fn(c).alias(f"{m}__{i}") for i, c in enumerate(batch) for m, fn in metrics.items()]
        wide = df.agg(*exprs)
        structs = [F.struct(F.lit(c).alias("column_name"),
                            *[F.col(f"{m}__{i}").alias(m) for m in metrics]) for i, c in enumerate(batch)]
        long = wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
        out = long if out is None else out.unionByName(long)
    return out


# Q01 / Q02 -----------------------------------------------------------------
def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, rows, nulls, null_share)."""
    cols = list(cols or df.columns)
    prof = _wide_to_long(df, {"nulls": lambda c: F.count_if(F.col(c).isNull()),
                              "rows": lambda c: F.count(F.lit(1))}, cols)
    return prof.withColumn("null_share", F.col("nulls") / F.col("rows"))


def sparse_columns(df: DataFrame, limit: float = 0.5, cols: Sequence[str] | None = None) -> DataFrame:
    return null_profile(df, cols).where(F.col("null_share") > limit)


# Q03 -----------------------------------------------------------------------
def placeholder_profile(df: DataFrame, cols: Sequence[str] | None = None,
                        tokens: Sequence[str] = tuple(SUSPICIOUS_TOKENS), limit: float = 0.5) -> DataFrame:
    """Text columns where nulls + placeholder tokens exceed ``limit`` of rows.

    As in the original check, a null is rendered as the text 'nan' before the
    token test, so it counts once as null and once as a token."""
    cols = list(cols or string_columns(df))
    toks = list(dict.fromkeys(tokens))
    prof = _wide_to_long(df, {
        "nulls": lambda c: F.count_if(F.col(c).isNull()),
        "tokens": lambda c: F.count_if(F.coalesce(F.col(c), F.lit("nan")).isin(toks)),
        "rows": lambda c: F.count(F.lit(1))}, cols)
    prof = prof.withColumn("missing_like", F.col("nulls") + F.col("tokens"))
    return prof.withColumn("flagged", F.col("missing_like") > F.col("rows") * limit)


# Q04 -----------------------------------------------------------------------
def zero_profile(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 0.5) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    prof = _wide_to_long(df, {"zeros_or_nulls": lambda c: F.count_if(F.col(c).isNull() | (F.col(c) == 0)),
                              "rows": lambda c: F.count(F.lit(1))}, cols)
    prof = prof.withColumn("zero_share", F.col("zeros_or_nulls") / F.col("rows"))
    return prof.withColumn("flagged", F.col("zero_share") > limit)


# Q05 / Q06 -----------------------------------------------------------------
def _values_long(df: DataFrame, cols: Sequence[str], value) -> DataFrame:
    """(column_name, v): one record per row and column, a narrow explode."""
    recs = F.array(*[F.struct(F.lit(c).alias("column_name"), value(c).cast("string").alias("v")) for c in cols])
    return df.select(F.explode(recs).alias("r")).select("r.*")


def distinct_counts(df: DataFrame, cols: Sequence[str], value=F.col) -> DataFrame:
    """(column_name, n_distinct, rows), exact; nulls are no value.

    Values are counted once as (column, value, n): partials combine before the
    shuffle, so a hot value is one record per task whatever its rows, and the
    row itself is never expanded per distinct set.  Columns of an empty table
    have zeros."""
    counts = _values_long(df, cols, value).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("column_name").agg(F.count("v").alias("n_distinct"), F.sum("n").alias("rows"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return names.join(per, "column_name", "left").select("column_name", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_distinct", "rows")])


def distinct_sketches(df: DataFrame, cols: Sequence[str] | None = None, value=F.col, lg_k: int = 12) -> DataFrame:
    """(column_name, rows, sketch): mergeable distinct counts (HyperLogLog of
    2**lg_k registers, a relative error of about 1.04 / 2**(lg_k / 2)).

    The table is state that can be stored; ``merge_sketches`` adds later data
    without reading the earlier rows again."""
    return (_values_long(df, list(cols or string_columns(df)), value).groupBy("column_name")
            .agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("v", lg_k).alias("sketch")))


def merge_sketches(first: DataFrame, *later: DataFrame) -> DataFrame:
    """The sketch table of all parts together."""
    for part in later:
        first = first.unionByName(part)
    return first.groupBy("column_name").agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def sketched_counts(sketches: DataFrame) -> DataFrame:
    return sketches.select("column_name", F.hll_sketch_estimate("sketch").alias("n_distinct"), "rows")


def cardinality_class(df: DataFrame, cols: Sequence[str] | None = None, high: int = 15,
                      id_share: float = 0.5, approx: bool = False) -> DataFrame:
    """Distinct values per text column -> 'id_like' / 'high' / 'normal'.

    Exact by counting (column, value) pairs; ``approx`` reads the same numbers
    from HyperLogLog sketches, for very large tables."""
    cols = list(cols or string_columns(df))
    prof = sketched_counts(distinct_sketches(df, cols)) if approx else distinct_counts(df, cols)
    cls = (F.when(F.col("n_distinct") > F.col("rows") * id_share, "id_like")
            .when(F.col("n_distinct") > high, "high").otherwise("normal"))
    return prof.withColumn("cardinality_class", cls)


def cardinality_ci(df: DataFrame, cols: Sequence[str] | None = None, high: int = 15) -> DataFrame:
    """Distinct lower-cased values (null counted as the value 'nan')."""
    cols = list(cols or string_columns(df))
    prof = distinct_counts(df, cols, lambda c: F.coalesce(F.lower(c), F.lit("nan")))
    return prof.select("column_name", F.col("n_distinct").alias("distinct_ci"), (F.col("n_distinct") > high).alias("many_values"))


# Q07 -----------------------------------------------------------------------
def binary_text_columns(df: DataFrame, cols: Sequence[str] | None = None,
                        vocabulary: Sequence[str] = tuple(YES_NO_VALUES)) -> DataFrame:
    """Text columns whose non-null lower-cased values all lie in a yes/no set.

    Bounded per column: counts of values outside the vocabulary, no value sets."""
    cols = list(cols or string_columns(df))
    voc = list(vocabulary)
    prof = _wide_to_long(df, {
        "outside": lambda c: F.count_if(F.col(c).isNotNull() & ~F.lower(F.col(c)).isin(voc)),
        "non_null": lambda c: F.count(F.col(c))}, cols)
    return prof.withColumn("is_binary", (F.col("outside") == 0) & (F.col("non_null") > 0))


# Q08 / G16 -----------------------------------------------------------------
def null_block_overlap(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns sharing a null count form a block; are they null in the same rows?

    One pass for the null counts, one pass for the all-null row count of
    every block (each block is one ``count_if(AND isNull)``)."""
    cols = list(cols or df.columns)
    counts = null_profile(df, cols).where(F.col("nulls") > 0).select("column_name", "nulls").collect()
    blocks: dict[int, list[str]] = {}
    for r in counts:
        blocks.setdefault(r["nulls"], []).append(r["column_name"])
    blocks = {n: sorted(cs) for n, cs in blocks.items() if len(cs) > 1}
    spark = df.sparkSession
    if not blocks:
        return spark.createDataFrame([], "null_count long, columns string, n_columns int, rows_all_null long, verdict string")
    aggs = []
    order = sorted(blocks)
    for n in order:
        cond = None
        for c in blocks[n]:
            cond = F.col(c).isNull() if cond is None else cond & F.col(c).isNull()
        aggs.append(F.count_if(cond).alias(f"b{n}"))
    row = df.agg(*aggs).first()
    data = [(int(n), ",".join(blocks[n]), len(blocks[n]), int(row[f"b{n}"]),
             "identical rows" if row[f"b{n}"] == n else "partial overlap") for n in order]
    return spark.createDataFrame(data, "null_count long, columns string, n_columns int, rows_all_null long, verdict string")


def all_null_rows(df: DataFrame, cols: Sequence[str]) -> Column:
    """count_if(every column of the group is null) -- use inside ``agg``."""
    cond = None
    for c in cols:
        cond = F.col(c).isNull() if cond is None else cond & F.col(c).isNull()
    return F.count_if(cond)


# Q09 / Q10 -----------------------------------------------------------------
def near_zero_variance_text(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 0.95) -> DataFrame:
    """Top category share (among non-null values) per text column.

    Unpivot to (column, value), count per pair (map-side partial counts, so a
    dominant value does not concentrate rows), then pick the top per column."""
    cols = list(cols or string_columns(df))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))
                                          for c in cols])).alias("s")).select("s.*").where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("column_name").agg(
        F.max("n").alias("top_n"), F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("n_unique"))
    return (per.withColumn("top_share", F.col("top_n") / F.col("non_null"))
               .withColumn("nzv_flag", F.col("top_share") >= limit))


def near_zero_variance_num(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 1e-6) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    prof = _wide_to_long(df, {"std": lambda c: F.stddev_samp(F.col(c).cast("double"))}, cols)
    return prof.withColumn("nzv_flag", F.col("std") < limit)


# Q11 -----------------------------------------------------------------------
def describe(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """count, mean, std (ddof 1), min, quartiles (linear interpolation), max.

    Moments in one aggregate; exact quartiles of all columns by sketched
    brackets (``quantiles.column_quantiles``), or
    ``percentile_approx`` with ``approx``."""
    from hearthlens.operators.quantiles import column_quantiles

    cols = list(cols or numeric_columns(df))
    df = cut_lineage(df.select(*cols))  # the moments and the quantiles read it, the plan above runs once
    mom = _wide_to_long(df, {
        "count": lambda c: F.count(F.col(c)),
        "mean": lambda c: F.avg(F.col(c)),
        "std": lambda c: F.stddev_samp(F.col(c)),
        "min": lambda c: F.min(F.col(c)).cast("double"),
        "max": lambda c: F.max(F.col(c)).cast("double")}, cols)
    if approx:
        qs = _wide_to_long(df, {"q": lambda c: F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75], 10000)}, cols)
        q = qs.select("column_name", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))
    else:
        res = column_quantiles(df, cols, [0.25, 0.5, 0.75])  # one row per column
        q = df.sparkSession.createDataFrame([(c, *res[c]) for c in cols],
                                            "column_name string, q25 double, q50 double, q75 double")
    return mom.join(q, "column_name").select("column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


# Q13 -----------------------------------------------------------------------
def target_correlations(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Pearson r of every column with the target (pairwise-complete rows)."""
    prof = _wide_to_long(df, {"r": lambda c: F.corr(F.col(c).cast("double"), F.col(target).cast("double"))},
                         [c for c in cols if c != target])
    return prof.withColumnRenamed("column_name", "feature").withColumn("abs_r", F.abs("r"))


def target_correlation_alert(df: DataFrame, cols: Sequence[str], target: str, limit: float = 0.8) -> DataFrame:
    return target_correlations(df, cols, target).where(F.col("abs_r") > limit)


# Q14 -----------------------------------------------------------------------
def band_shares(df: DataFrame, c: str, edges: Sequence[float] = (100.0, 200.0, 300.0)) -> DataFrame:
    """Share (%) of rows per value band (<= e1, (e1, e2], ..., > e_last); one row."""
    x = F.col(c)
    exprs, prev = [], None
    for e in edges:
        cond = x <= e if prev is None else (x > prev) & (x <= e)
        exprs.append((F.avg(F.coalesce(cond, F.lit(False)).cast("double")) * 100.0).alias(f"pct_le_{int(e)}"))
        prev = e
    exprs.append((F.avg(F.coalesce(x > prev, F.lit(False)).cast("double")) * 100.0).alias(f"pct_gt_{int(prev)}"))
    return df.agg(*exprs)


# Q16 -----------------------------------------------------------------------
def value_counts(df: DataFrame, c: str, k: int | None = None, by_key: bool = False) -> DataFrame:
    """Value distribution with share; top-k by count (ties by value) or by key."""
    # the total is one count job; the distinct-value table can be large
    # (an id-like column), so no global window over it
    total = df.count()
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("share", F.col("n") / F.lit(float(max(total, 1))))
    out = out.orderBy(c) if by_key else out.orderBy(F.desc("n"), F.asc_nulls_first(c))
    return out.limit(k) if k is not None else out


# Q17 -----------------------------------------------------------------------
def validation_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, leftover nulls and type per column (long table)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    prof = null_profile(df)
    spark = df.sparkSession
    tdf = spark.createDataFrame(list(types.items()), "column_name string, data_type string")
    return prof.join(tdf, "column_name").withColumn("n_columns", F.lit(len(types)))
