"""Cleaning and imputation operators.

Fit/apply pairs: a *fit* step runs one aggregate job over the whole table and
returns a one-row statistics object (a bounded result: one value per column);
the *apply* step is a narrow projection with those values as literals, so it
runs in the same stage as the scan and can be reused on new files (batch or
streaming) without refitting.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Iterable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlens.functions.features import col_, nan_to_null, strip_all
from hearthlens.session import cut_lineage

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def require(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Fail with the list of missing columns (schema check, no job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


# C01 -----------------------------------------------------------------------
def trim_strings(df: DataFrame, cols: Sequence[str] | None = None, all_whitespace: bool = False) -> DataFrame:
    cols = [c for c in (cols or string_columns(df)) if c in df.columns]
    fn = strip_all if all_whitespace else F.trim
    return df.withColumns({c: fn(F.col(c)) for c in cols})


# C02 -----------------------------------------------------------------------
def placeholder_to_null(df: DataFrame, placeholders: Mapping[str, Sequence[str]]) -> DataFrame:
    todo = {c: F.when(F.col(c).isin(list(v)), F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c))
            for c, v in placeholders.items() if c in df.columns}
    return df.withColumns(todo) if todo else df


# C03 -----------------------------------------------------------------------
def coerce_numeric(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    """Mixed text -> number; failures (and NaN) -> null."""
    return df.withColumns({c: nan_to_null(F.col(c).cast("string").try_cast(to)) for c in cols
                           if c in df.columns})


# C04 -----------------------------------------------------------------------
def harmonise_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """All numeric columns to double (NaN -> null) so every input file agrees."""
    cols = cols or numeric_columns(df)
    return df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in cols})


# C05 -----------------------------------------------------------------------
def narrow_types(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """double -> float, bigint -> int at the sink (values must fit)."""
    todo = {}
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.DoubleType):
            todo[f.name] = F.col(f.name).cast("float")
        elif isinstance(f.dataType, T.LongType):
            todo[f.name] = F.col(f.name).cast("int")
    return df.withColumns(todo) if todo else df


# C06 / C07 -----------------------------------------------------------------
def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    present = {c: v for c, v in values.items() if c in df.columns}
    todo = {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in present.items()}
    return df.withColumns(todo) if todo else df


def fill_zero_block(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero-fill of a structurally absent block (not missing at random)."""
    return fill_constant(df, {c: 0 for c in cols})


# C12 -----------------------------------------------------------------------
def missing_flag(df: DataFrame, source: str, name: str) -> DataFrame:
    """Presence flag made before any fill (1 = value present)."""
    return df.withColumn(name, F.col(source).isNotNull().cast("tinyint"))


# C08 / C09 / C10 -----------------------------------------------------------
@dataclass
class ImputeStats:
    """Fitted fill values: one per column (median for numbers, mode for text)."""

    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"medians": self.medians, "modes": self.modes}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "ImputeStats":
        d = json.loads(text)
        return cls(d.get("medians", {}), d.get("modes", {}))

    def as_row_df(self, spark) -> DataFrame:
        """Long form (column, kind, value) for saving next to the data."""
        rows = [(c, "median", json.dumps(v)) for c, v in self.medians.items()]
        rows += [(c, "mode", json.dumps(v)) for c, v in self.modes.items()]
        return spark.createDataFrame(rows, "column_name string, kind string, value string")


def median_exprs(cols: Sequence[str], approx: bool = False, accuracy: int = 10000) -> list[Column]:
    if approx:
        return [F.percentile_approx(F.col(c), 0.5, accuracy).alias(c) for c in cols]
    return [F.median(F.col(c)).alias(c) for c in cols]


def mode_exprs(cols: Sequence[str]) -> list[Column]:
    # deterministic=True: ties go to the smallest value (pandas ``mode()[0]``)
    return [F.mode(F.col(c), True).alias(c) for c in cols]


def text_modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-null value per column, ties -> smallest value.

    Two-level counting (value counts with map-side partials, then an argmax
    over the small count table) -- no per-group value map in one task."""
    cols = list(cols)
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v"))
                                         for i, c in enumerate(cols)])).alias("s")).select("s.*")
    counts = long.where(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c").agg(F.min_by("v", F.struct((-F.col("n")).alias("nn"), F.col("v"))).alias("mode"))
    got = {r["c"]: r["mode"] for r in best.collect()}  # one row per column
    return {c: got.get(i) for i, c in enumerate(cols)}


def fit_impute_stats(df: DataFrame, numeric: Sequence[str] | None = None,
                     text: Sequence[str] | None = None, approx: bool = False,
                     default_mode: str = "Unknown", default_median: float = 0.0) -> ImputeStats:
    """Medians (numeric) and modes (text) of every column over the full table.

    Exact medians come from the distributed counting quantile (bounded task
    memory); ``approx`` switches to ``percentile_approx`` in one aggregate.
    Modes take the smallest of tied values.  The result is one value per
    column.
    """
    from hearthlens.operators.quantiles import column_quantiles

    numeric = list(numeric if numeric is not None else numeric_columns(df))
    text = list(text if text is not None else string_columns(df))
    if not numeric and not text:
        return ImputeStats()
    # the fit jobs read only the fitted columns: persist that narrow
    # projection once instead of re-running the upstream plan per job
    df = df.select(*dict.fromkeys(numeric + text)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(df, numeric, text, approx, default_mode, default_median)
    finally:
        df.unpersist()


def _fit(df, numeric, text, approx, default_mode, default_median) -> ImputeStats:
    from hearthlens.operators.quantiles import column_quantiles

    if approx and numeric:
        row = df.agg(*median_exprs(numeric, approx=True)).first()
        med = {c: row[i] for i, c in enumerate(numeric)}
    else:
        med = {c: (v[0] if v else None) for c, v in column_quantiles(df, numeric, [0.5]).items()}
    modes = text_modes(df, text)
    meds = {c: (float(med[c]) if med.get(c) is not None else default_median) for c in numeric}
    modes = {c: (modes[c] if modes.get(c) is not None else default_mode) for c in text}
    return ImputeStats(meds, modes)


def apply_impute_stats(df: DataFrame, stats: ImputeStats, skip: Sequence[str] = ()) -> DataFrame:
    fills = {c: v for c, v in {**stats.medians, **stats.modes}.items() if c not in skip}
    return fill_constant(df, fills)


def fill_median(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    return apply_impute_stats(df, fit_impute_stats(df, numeric=cols, text=[], approx=approx))


def fill_mode(df: DataFrame, cols: Sequence[str], default: str = "Unknown") -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    return apply_impute_stats(df, fit_impute_stats(df, numeric=[], text=cols, default_mode=default))


# C11 -----------------------------------------------------------------------
def group_mode_lookup(df: DataFrame, target: str, levels: Sequence[Sequence[str]]) -> DataFrame:
    """One row per group of the finest grain (all keys of all levels, nulls
    included): the keys and ``__mode``, the mode of the first level that has
    one; after the last level the mode of all rows.

    Rows are counted once, at the finest grain (a hot group is combined before
    the shuffle); wider levels roll those counts up.  Ties go to the smallest
    value; a null key has no group at its level."""
    grain = list(dict.fromkeys(c for ks in levels for c in ks))
    counts = cut_lineage(df.groupBy(*grain, target).agg(F.count(F.lit(1)).alias("__n")))
    known = counts.where(F.col(target).isNotNull())
    best = F.min_by(target, F.struct((-F.col("__n")).alias("nn"), F.col(target)))

    def rolled(ks):
        return known.groupBy(*ks, target).agg(F.sum("__n").alias("__n"))

    lookup = counts.select(*grain).distinct()
    for i, ks in enumerate(levels):
        lookup = lookup.join(rolled(ks).groupBy(*ks).agg(best.alias(f"__gm{i}")), list(ks), "left")
    whole = rolled([]).agg(best.alias("m")).first()["m"]  # one value
    return lookup.select(*grain, F.coalesce(*[F.col(f"__gm{i}") for i in range(len(levels))], F.lit(whole)).alias("__mode"))


def fill_group_mode(df: DataFrame, target: str, keys: Sequence[str],
                    fallbacks: Sequence[Sequence[str]] = (), out: str | None = None,
                    broadcast_groups: int = 50_000, salts: int = 32) -> DataFrame:
    """Fill ``target`` with the mode of its group, then of wider groups, then global.

    One pass of counts gives a lookup by the finest group (``group_mode_lookup``)
    and one null-safe join brings it back.  The lookup is written and counted:
    up to ``broadcast_groups`` rows it is broadcast and the rows do not move;
    a larger one is joined on the group and a salt, each lookup row standing
    once per salt, so that a hot group is spread over ``salts`` tasks."""
    out = out or target
    lookup = cut_lineage(group_mode_lookup(df, target, [list(keys), *map(list, fallbacks)]))
    grain = [c for c in lookup.columns if c != "__mode"]
    lookup = lookup.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(grain)], "__mode")
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(grain)]
    columns = [c for c in df.columns if c != out]
    if lookup.count() <= broadcast_groups:
        lookup = F.broadcast(lookup)
    else:
        lookup = lookup.withColumn("__k_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        df = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        same.append(F.col("__salt") == F.col("__k_salt"))
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return df.join(lookup, cond, "left").select(*columns, F.coalesce(F.col(target), F.col("__mode")).alias(out))


# C13 -----------------------------------------------------------------------
def fill_by_regression(df: DataFrame, target: str, features: Sequence[str],
                       decimals: int | None = 1, out: str | None = None) -> DataFrame:
    """Ordinary least squares on complete rows; fill nulls of ``target``.

    The normal equations are built by one distributed aggregate of sums of
    products (p+1 x p+1 values, p = number of features) and solved on the
    driver; prediction is a column expression, so no model object ships.
    """
    import numpy as np

    out = out or target
    xs = [F.lit(1.0)] + [F.col(c).cast("double") for c in features]
    names = ["_1"] + list(features)
    complete = df.where(F.col(target).isNotNull())
    for c in features:
        complete = complete.where(F.col(c).isNotNull())
    y = F.col(target).cast("double")
    aggs = []
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            aggs.append(F.sum(xs[i] * xs[j]))
        aggs.append(F.sum(xs[i] * y))
    row = complete.agg(*aggs).first()
    p = len(xs)
    xtx = np.zeros((p, p))
    xty = np.zeros(p)
    k = 0
    for i in range(p):
        for j in range(i, p):
            xtx[i, j] = xtx[j, i] = row[k] or 0.0
            k += 1
        xty[i] = row[k] or 0.0
        k += 1
    beta = np.linalg.lstsq(xtx, xty, rcond=None)[0]
    pred = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], names[1:]):
        pred = pred + F.lit(float(b)) * F.col(c).cast("double")
    if decimals is not None:
        pred = F.round(pred, decimals)
    return df.withColumn(out, F.coalesce(F.col(target).cast("double"), pred))


# C14 -----------------------------------------------------------------------
def fill_by_classification(df: DataFrame, target: str, features: Sequence[str],
                           out: str | None = None, max_iter: int = 100):
    """Multinomial logistic model (Spark ML) predicts a missing category."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    out = out or target
    train = df.where(F.col(target).isNotNull())
    for c in features:
        train = train.where(F.col(c).isNotNull())
    idx = StringIndexer(inputCol=target, outputCol="__label", stringOrderType="alphabetAsc")
    vec = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep")
    lr = LogisticRegression(featuresCol="__features", labelCol="__label", predictionCol="__pred",
                            maxIter=max_iter, family="multinomial")
    model = Pipeline(stages=[idx, vec, lr]).fit(train)
    labels = model.stages[0].labels
    back = IndexToString(inputCol="__pred", outputCol="__pred_label", labels=labels)
    scored = back.transform(model.stages[2].transform(model.stages[1].transform(df)))
    res = scored.withColumn(out, F.coalesce(F.col(target), F.col("__pred_label")))
    return res.drop("__features", "__pred", "__pred_label", "rawPrediction", "probability")


# C15 / C16 / C17 / P08 -----------------------------------------------------
def quantiles(df: DataFrame, c: str, probs: Sequence[float], approx: bool = False) -> list[float]:
    """Global quantiles of one column: exact (distributed counting) or approx."""
    from hearthlens.operators.quantiles import column_quantiles

    if approx:
        row = df.agg(F.percentile_approx(F.col(c), list(probs), 10000).alias("q")).first()
        return list(row["q"]) if row["q"] is not None else [None] * len(probs)
    return column_quantiles(df, [c], probs)[c]


def iqr_fence(df: DataFrame, c: str, k: float = 1.5, fit_on: DataFrame | None = None) -> DataFrame:
    """Keep rows within Q1 - k*IQR .. Q3 + k*IQR (fence fitted on ``fit_on``,
    e.g. training rows only).  No filtering when the IQR is zero."""
    q1, q3 = quantiles(fit_on if fit_on is not None else df, c, [0.25, 0.75])
    if q1 is None or q3 - q1 == 0:
        return df
    iqr = q3 - q1
    return df.where(F.col(c).between(q1 - k * iqr, q3 + k * iqr))


def quantile_trim(df: DataFrame, c: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    a, b = quantiles(df, c, [lo, hi])
    return df.where(F.col(c).between(a, b))


def three_sigma_smooth(df: DataFrame, cols: Sequence[str], k: float = 3.0) -> DataFrame:
    """Values outside mean +- k * stddev_samp are replaced by the mean."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c), F.stddev_samp(c)]
    row = df.agg(*aggs).first()
    todo = {}
    for i, c in enumerate(cols):
        m, s = row[2 * i], row[2 * i + 1]
        if m is None or s is None:
            continue
        todo[c] = F.when(F.abs(F.col(c) - m) > k * s, F.lit(float(m))).otherwise(F.col(c))
    return df.withColumns(todo) if todo else df


def residual_outlier_filter(df: DataFrame, label: str, prediction: str, limit: float = 3.0) -> DataFrame:
    """Drop rows whose residual has |z| >= limit (population std, ddof = 0)."""
    r = F.col(label) - F.col(prediction)
    row = df.agg(F.avg(r).alias("m"), F.stddev_pop(r).alias("s")).first()
    if row["s"] in (None, 0.0):
        return df
    return df.where(F.abs((r - row["m"]) / row["s"]) < limit)


# P07 / P10 / Q15 -----------------------------------------------------------
def filter_range(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Inclusive ranges, nulls rejected (pushed to the Parquet scan when the
    column comes straight from a file)."""
    cond = None
    for c, (lo, hi) in ranges.items():
        x = F.col(c).between(lo, hi)
        cond = x if cond is None else cond & x
    return df.where(cond)


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def reject_reason(ranges: Mapping[str, tuple[float, float]]) -> Column:
    """First failing rule per row: '<col>_null', '<col>_range' or 'kept'."""
    expr = None
    for c, (lo, hi) in ranges.items():
        for cond, tag in ((F.col(c).isNull(), f"{c}_null"), (~F.col(c).between(lo, hi), f"{c}_range")):
            expr = F.when(cond, F.lit(tag)) if expr is None else expr.when(cond, F.lit(tag))
    return expr.otherwise(F.lit("kept"))


def reject_counts(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Row accounting: rows per reason; read = kept + sum of rejects."""
    return df.groupBy(reject_reason(ranges).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
