"""Registered model queries fit with the reference's sizes."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator

from hearthlens.plans.registry import load_all

def test_booster_sizes():
    from hearthlens.plans import q_ml

    assert [(p.rounds, p.depth, p.patience) for p in (q_ml.REGRESSOR, q_ml.CLASSIFIER, q_ml.ALTERNATIVE)] == [(1500, 8, 50), (800, 7, 50), (1000, 6, 50)]


@pytest.mark.parametrize("key", ["kfold_cv", "gbt_regressor", "loss_curve"])
def test_boosted_queries_give_results(spark, key):
    from dataclasses import replace

    from hearthlens.plans import q_ml

    rows = load_all()[key].run(spark, "/root/testdata/sf0.001", params=replace(q_ml.REGRESSOR, rounds=3, depth=3)).collect()
    if key == "kfold_cv":
        r2 = [r["r2"] for r in rows if r["fold"] >= 0]
        assert len(r2) == 5 and [r["r2"] for r in rows if r["fold"] < 0] == pytest.approx([sum(r2) / 5, (sum((x - sum(r2) / 5) ** 2 for x in r2) / 5) ** 0.5])
    elif key == "loss_curve":
        assert [(r["split"], r["round"]) for r in rows] == [(s, i) for s in ("train", "validation", "test") for i in (1, 2, 3)]
        assert sum(r["best"] for r in rows) == 3
    else:
        assert {r["split"] for r in rows} == {"train", "validation", "test"} and {r["rounds"] for r in rows} == {3}


SIZES = ("maxIter", "numTrees", "maxDepth")


class _Enough(Exception):
    pass


@pytest.mark.parametrize("key, want, fits", [
    ("imputation_compare", {("RandomForestRegressor", 50, 10)}, 2),
    ("fill_by_classification", {("LogisticRegression", 500)}, 1),
    ("representation_compare", {("LogisticRegression", 500), ("RandomForestClassifier", 100, 10)}, 2),
])
def test_learner_sizes(spark, monkeypatch, key, want, fits):
    seen, fit = [], Estimator.fit

    def recorded(self, *args, **kw):
        learner = self.getStages()[-1] if isinstance(self, Pipeline) else self
        sizes = tuple(learner.getOrDefault(p) for p in SIZES if learner.hasParam(p))
        if not sizes:
            return fit(self, *args, **kw)
        name = type(learner).__name__
        seen.append((name, *sizes))
        if len(seen) >= fits:
            raise _Enough
        return fit(self, *args, **kw)

    monkeypatch.setattr(Estimator, "fit", recorded)
    with pytest.raises(_Enough):
        load_all()[key].run(spark, "/root/testdata/sf0.001").count()
    assert set(seen) == want
