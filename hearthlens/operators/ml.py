"""Model training, evaluation and scoring.

Metrics are plain aggregates over (label, prediction) so they are exact,
distributed and oracle-checkable.  Rank-based metrics (AUC, curves) collapse
rows to *distinct scores* first (a count per score), then run the cumulative
sums over that table range-partitioned by score -- never one global window
over all rows.

Learners are Spark ML estimators (trees, forests, boosted trees, linear and
logistic models); the fixed key-hash split replaces ``randomSplit`` so the
split is stable under any repartitioning or recomputation.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# FIXED VALUES — multipliers of the key hash used by the deterministic split.
SPLIT_MULTIPLIERS = [7919, 104729, 31, 17, 1]


# M01 -----------------------------------------------------------------------
def split_bucket(key_cols: Sequence[str], buckets: int = 100) -> Column:
    """Deterministic bucket 0..buckets-1 from integer key columns (arithmetic
    so the SQL oracle can reproduce it; stable under repartitioning)."""
    expr = None
    for c, m in zip(key_cols, SPLIT_MULTIPLIERS):
        term = F.col(c).cast("bigint") * F.lit(m)
        expr = term if expr is None else expr + term
    return F.pmod(expr, F.lit(buckets))


def split_label(key_cols: Sequence[str], train: int = 70, validation: int = 15) -> Column:
    b = split_bucket(key_cols)
    return (F.when(b < train, "train").when(b < train + validation, "validation").otherwise("test"))


def fold_column(key_cols: Sequence[str], k: int = 5) -> Column:
    """k folds of equal size (buckets are taken modulo a multiple of k)."""
    return split_bucket(key_cols, 100 * k).cast("int") % k


def hash_sample(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows, seeded, independent of partitioning (T05): order by a
    hash of the key and keep the first n -- a top-k, planned as
    TakeOrderedAndProject (each task keeps n rows, the driver merges)."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))))
    return df.withColumn("__h", h).orderBy("__h", *key_cols).limit(n).drop("__h")


# M09 -----------------------------------------------------------------------
def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       group: Sequence[str] = ()) -> DataFrame:
    """R2, RMSE, MAE, MAPE (|label| + 1e-6 denominator) per group."""
    y, p = F.col(label), F.col(prediction)
    g = df.groupBy(*group) if group else df.groupBy()
    m = g.agg(F.count(y).alias("n"), F.sum((y - p) * (y - p)).alias("sse"), F.var_pop(y).alias("var"), F.avg(F.abs(y - p)).alias("mae"),
              F.avg(F.abs(y - p) / (F.abs(y) + F.lit(1e-6))).alias("mape"))
    sst = F.col("var") * F.col("n")  # centred (Welford) sums, no cancellation
    return m.select(*group, "n", (F.lit(1.0) - F.col("sse") / sst).alias("r2"),
                    F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", (F.col("mape") * 100.0).alias("mape_pct"))


# M10 / M11 -----------------------------------------------------------------
def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg) per distinct score -- the input of every curve."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"))


def _cumulative(counts: DataFrame, descending: bool) -> DataFrame:
    """Running sums of pos/neg over distinct scores (tp, fp), distributed:
    range partitions + per-partition offsets, no single-partition window."""
    from hearthlens.operators.relational import distributed_running

    order = -F.col("score") if descending else F.col("score")
    run = distributed_running(counts, [order], {"tp": F.col("pos"), "fp": F.col("neg")})
    return run.select("score", "pos", "neg", "tp", "fp")


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC curve: one point per distinct score (thresholds descending)."""
    c = _cumulative(score_counts(df, label, score), descending=True)
    tot = df.agg(F.sum(F.col(label).cast("long")).alias("P"), F.sum((1 - F.col(label)).cast("long")).alias("N")).first()
    return c.select("score", (F.col("fp") / F.lit(float(tot["N"]))).alias("fpr"),
                    (F.col("tp") / F.lit(float(tot["P"]))).alias("tpr"))


def pr_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    c = _cumulative(score_counts(df, label, score), descending=True)
    tot = df.agg(F.sum(F.col(label).cast("long")).alias("P")).first()
    return c.select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.col("tp") / F.lit(float(tot["P"]))).alias("recall"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """AUC by the rank-sum (Mann-Whitney) form with ties counted half:
    sum over distinct scores of pos * (negatives below + neg / 2)."""
    c = _cumulative(score_counts(df, label, score), descending=False)
    # fp here = cumulative negatives up to and including this score (ascending)
    s = c.agg(F.sum(F.col("pos") * (F.col("fp") - F.col("neg") + F.col("neg") / 2.0)).alias("u"),
              F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return s.select((F.col("u") / (F.col("P") * F.col("N"))).alias("auc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """AP = sum over thresholds of (recall step) * precision (sklearn form)."""
    c = _cumulative(score_counts(df, label, score), descending=True)
    return c.agg((F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))) / F.sum("pos")).alias("average_precision"))


# G15 / M12 -----------------------------------------------------------------
def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts and row-normalised shares; the window runs per actual class
    over the (class x class) count table, which is bounded by the classes."""
    cm = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    return cm.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(actual)))


def per_class_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 per class (empty -> 0) from one count table.

    Each (actual, predicted) count is emitted twice -- once for the actual
    class (support, true positives) and once for the predicted class -- and
    one aggregate sums them: no joins."""
    cm = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    recs = F.array(F.struct(F.col("a").alias("cls"), hit.alias("tp"), F.col("n").alias("support"),
                            F.lit(0).cast("long").alias("predicted")),
                   F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"),
                            F.col("n").alias("predicted")))
    t = (cm.select(F.explode(recs).alias("r")).select("r.*")
           .groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    t = t.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return t.withColumn("f1", f1)


# M22 -----------------------------------------------------------------------
def class_weight_column(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Positive rows weighted neg / max(pos, 1); negatives weight 1."""
    r = df.agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos = r["pos"] or 0
    w = (r["n"] - pos) / max(pos, 1)
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(w))).otherwise(F.lit(1.0)))


# Learners ------------------------------------------------------------------
def feature_pipeline(cat_cols: Sequence[str], num_cols: Sequence[str], features: str = "features",
                     scale: bool = False, impute: bool = True):
    """Stages: ordinal encoding (alphabetical, unseen -> reserved index),
    median imputation, assembly, optional scaling."""
    from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler

    stages = []
    enc = [f"{c}__idx" for c in cat_cols]
    if cat_cols:
        stages.append(StringIndexer(inputCols=list(cat_cols), outputCols=enc, stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
    nums = list(num_cols)
    if impute and nums:
        imp = [f"{c}__imp" for c in nums]
        stages.append(Imputer(inputCols=nums, outputCols=imp, strategy="median"))
        nums = imp
    raw = features if not scale else f"{features}__raw"
    stages.append(VectorAssembler(inputCols=enc + nums, outputCol=raw, handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol=features, withMean=True, withStd=True))
    return stages


def gbt_regressor(label: str = "label", max_iter: int = 1500, max_depth: int = 8, step: float = 0.1,
                  max_bins: int = 64, validation_col: str | None = None, seed: int = 42):
    from pyspark.ml.regression import GBTRegressor

    kw = dict(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=max_depth, stepSize=step,
              maxBins=max_bins, subsamplingRate=0.8, featureSubsetStrategy="all", minInstancesPerNode=20, seed=seed)
    if validation_col:
        kw["validationIndicatorCol"] = validation_col
    return GBTRegressor(**kw)


def gbt_classifier(label: str = "label", weight: str | None = None, max_iter: int = 800, max_depth: int = 7,
                   max_bins: int = 64, seed: int = 42):
    from pyspark.ml.classification import GBTClassifier

    kw = dict(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=max_depth, maxBins=max_bins, seed=seed)
    if weight:
        kw["weightCol"] = weight
    return GBTClassifier(**kw)


def forest_regressor(label: str = "label", trees: int = 300, depth: int = 20, min_leaf: int = 10,
                     max_bins: int = 64, seed: int = 42):
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth,
                                 minInstancesPerNode=min_leaf, maxBins=max_bins, seed=seed)


def ridge(label: str = "label", alpha: float = 1.0, n_rows: int = 1):
    """sklearn Ridge(alpha) on standardised inputs == Spark L2 with regParam = alpha / n."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(labelCol=label, featuresCol="features", elasticNetParam=0.0,
                            regParam=alpha / max(n_rows, 1), standardization=False)
