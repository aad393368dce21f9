"""Logistic regression over hashed binary features, JVM-side.

Fitting uses Spark ML on a small labelled table; scoring is a plain column
expression over an array of feature numbers, so it needs no UDF and no join.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(train: DataFrame, dim: int, reg: float, elastic: float, max_iter: int = 60) -> tuple[list[list[float]], list[float]]:
    """train: ``ids`` (array<int> feature numbers below ``dim``), ``label``
    (double class number).  Returns coefficient rows and intercepts; a binary
    problem gives two rows of which the first is zero."""
    # kept: a projection that inlined ``ids`` would compute it once per feature
    train = train.select("label", "ids").coalesce(1).cache()
    dense = train.select("label", array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.array_contains("ids", i).cast("double"))).alias("features"))
    model = LogisticRegression(regParam=reg, elasticNetParam=elastic, maxIter=max_iter, family="auto", standardization=False).fit(dense)
    train.unpersist()
    rows = model.coefficientMatrix.toArray().tolist()
    bias = model.interceptVector.toArray().tolist()
    if len(rows) == 1:
        rows, bias = [[0.0] * dim, rows[0]], [0.0, bias[0]]
    return rows, bias


def literal(values: list[float]) -> Column:
    """An array<double> constant (folded once when the plan is optimised)."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def log_odds(ids: Column, weights: list[float], bias: float) -> Column:
    """bias + sum of the weights of the given feature numbers."""
    w = literal(weights)
    return F.aggregate(ids, F.lit(float(bias)), lambda acc, i: acc + F.get(w, i))


def softmax(scores: list[float]) -> list[float]:
    m = max(scores)
    e = [math.exp(s - m) for s in scores]
    return [x / sum(e) for x in e]
