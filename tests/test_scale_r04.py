"""Round 4: the model frame's checkpoint as compressed blocks."""

import os

from pyspark.sql import functions as F

from hearthlens.plans import model as MD
from hearthlens.session import cut_compressed, cut_lineage, ensure_checkpoint_dir


def _kept(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files)


def test_compressed_checkpoint_keeps_rows_places_and_little_disk(spark):
    df = spark.range(120_000, numPartitions=3).select("id", *((F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)) / 7.0).alias(f"c{i}") for i in range(12)),
                                                     F.when(F.col("id") % 3 > 0, F.concat(F.lit("some longer text "), (F.col("id") % 9).cast("string"))).alias("t"),
                                                     F.when(F.col("id") % 5 == 0, float("nan")).otherwise(-0.0).alias("v"), (F.col("id") % 2).cast("tinyint").alias("b"))
    sizes, rows = [], []
    for cut in (cut_lineage, cut_compressed):
        before = _kept(spark)
        out = cut(df)
        sizes.append(_kept(spark) - before)
        assert out.schema == df.schema and out.rdd.getNumPartitions() == 3
        rows.append([str(r) for r in out.withColumn("p", F.spark_partition_id()).collect()])
    assert rows[0] == rows[1] and len(rows[0]) == 120_000
    assert sizes[1] < sizes[0] / 2


def test_compressed_checkpoint_of_empty_partitions(spark):
    assert cut_compressed(spark.range(3, numPartitions=5)).count() == 3
    assert cut_compressed(spark.range(3).where("id > 5").withColumn("t", F.lit("x"))).count() == 0


def test_model_frame_is_kept_without_derived_columns(spark):
    before = _kept(spark)
    frame = MD.model_frame(spark, "/root/testdata/sf0.01")
    assert (_kept(spark) - before) / frame.count() < 80
    plain = MD.model_frame(spark, "/root/testdata/sf0.01", checkpoint=False)
    assert frame.columns == plain.columns
    assert frame.exceptAll(plain).count() == 0 and frame.count() == plain.count()


def _brute(row, paths, p):
    """Shapley values over all coalitions of the path-dependent game."""
    import itertools
    import math

    def value(known, path):
        out = path["w"] * path["value"]
        for feat, kind, arg, left, frac in path["conds"]:
            met = (row[feat] <= arg if kind == "num" else row[feat] in arg) == left
            out *= float(met) if feat in known else frac
        return out

    phi = [0.0] * p
    for path in paths:
        feats = sorted({c[0] for c in path["conds"]})
        k = len(feats)
        for f in feats:
            rest = [x for x in feats if x != f]
            for r in range(k):
                for s in itertools.combinations(rest, r):
                    phi[f] += math.factorial(r) * math.factorial(k - r - 1) / math.factorial(k) * (value({*s, f}, path) - value({*s}, path))
    return phi


def test_tree_shap_looks_up_the_cases_of_a_path(monkeypatch):
    import random

    import numpy as np

    from hearthlens.operators import attribution as AT

    rng = random.Random(4)
    conds = [(0, "num", 0.5, True, 0.3), (1, "cat", (0.0, 2.0), True, 0.6), (0, "num", 0.2, False, 0.4), (2, "num", 0.7, False, 0.5)]
    paths = [{"w": 0.1, "value": 3.0, "cover": 0.1, "conds": conds}, {"w": 1.0, "value": -2.0, "cover": 0.1, "conds": conds[1:2]}, {"w": 1.0, "value": 5.0, "cover": 1.0, "conds": []}]
    X = np.array([[rng.random(), rng.choice([-1.0, 0.0, 1.0, 2.0, 1.5]), rng.random()] for _ in range(200)])
    model = {"paths": paths, "expected": 0.0}
    model["tables"] = AT.path_tables(model)
    shares, widest = AT._shares, []
    monkeypatch.setattr(AT, "_shares", lambda z, o, s: widest.append(o.shape[1]) or shares(z, o, s))
    got = AT.shap_batch(X, model, 3)
    assert not widest  # nothing is worked out for the rows of a batch
    assert np.allclose(got, [_brute(r, paths, 3) for r in X])
    # the same bits as by rows
    monkeypatch.setattr(AT, "TABLE_FEATURES", 0)
    assert (AT.shap_batch(X, {"paths": paths, "expected": 0.0}, 3) == got).all() and 200 in widest


def test_shap_values_pass_keys_through(spark):
    from pyspark.ml.feature import VectorAssembler

    from hearthlens.operators import attribution as AT

    df = spark.createDataFrame([(2**60 + 1, "a", 0.1, 0.2), (None, None, float("nan"), 0.9)], "k long, t string, x double, y double")
    v = VectorAssembler(inputCols=["x", "y"], outputCol="features", handleInvalid="keep").transform(df)
    model = {"paths": [{"w": 1.0, "value": 2.0, "cover": 0.5, "conds": [(0, "num", 0.0, True, 0.25)]}], "expected": 0.5}
    rows = {r["k"]: r for r in AT.shap_values(v, "features", model, 2, ["k", "t"]).collect()}
    assert rows[2**60 + 1]["shap"] == [-0.5, 0.0] and rows[2**60 + 1]["t"] == "a"  # x > 0: not met
    assert rows[None]["shap"] == [1.5, 0.0] and rows[None]["t"] is None and rows[None]["base_value"] == 0.5  # null as -1: met


def test_dense_deltas_equal_the_expressions_and_sort_no_structs(spark):
    from hearthlens.operators import attribution as AT

    names = ["y", "x", "z", "Z", "w"]
    v = lambda s: F.array(*((F.pmod(F.xxhash64("id", F.lit(s), F.lit(i)), F.lit(4)) / 3.0) for i in range(5)))
    df = spark.range(500).select("id", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("t"), v(1).alias("b"), F.when(F.col("id") % 7 > 0, v(2)).alias("a"))
    df = df.unionByName(spark.range(1).select("id", F.lit(None).cast("string").alias("t"), F.array(*[F.lit(0.5)] * 5).alias("b"), F.array(*[F.lit(0.5)] * 5).alias("a")))
    for top in (None, 3):
        want, got = (AT.delta_long(df, ["id", "t"], "b", "a", names, top, dense=d) for d in (False, True))
        assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "sort_array" not in plan and "MapInArrow" in plan


def test_forest_has_the_references_size(spark, monkeypatch):
    from hearthlens.operators import forest as FO
    from hearthlens.plans import q_ml

    p = q_ml.FOREST
    assert (p.trees, p.depth, p.min_leaf) == (300, 20, 10) and p.bags == 10
    seen, fit = [], FO.RandomForestRegressor.fit
    monkeypatch.setattr(FO.RandomForestRegressor, "fit", lambda self, df: seen.append((self.getNumTrees(), self.getMaxDepth())) or fit(self.copy({self.numTrees: 1, self.maxDepth: 2}), df))
    q_ml.forest_regressor(spark, "/root/testdata/sf0.001")
    assert seen == [(30, 20)] * 10


def test_search_draws_the_references_space(spark):
    import inspect

    from hearthlens.plans import q_ml

    default = {k: v.default for k, v in inspect.signature(q_ml.random_search).parameters.items()}
    assert (default["draws"], default["folds"]) == (20, 2) and default["space"] is q_ml.SEARCH
    assert len(q_ml.SEARCH) == 9 and q_ml.SEARCH["rounds"] == [500, 800, 1000, 1500]
    small = {k: v[:2] for k, v in q_ml.SEARCH.items()} | {"rounds": [2], "depth": [-1], "leaves": [3, 5]}
    rows = q_ml.random_search(spark, "/root/testdata/sf0.001", draws=2, space=small).collect()
    assert len(rows) == 2 and sum(r["refit_r2"] is not None for r in rows) == 1
    assert all(r["cv_r2"] < 0.5 and r["rounds"] == 2 for r in rows)


def test_leaves_and_shrinkage(spark):
    import numpy as np
    from pyspark.ml.feature import VectorAssembler

    from hearthlens.operators import boosting as B

    data = [(i, float(i % 10), float(i % 3), float((i % 10) ** 2 + 5 * (i % 3)), "train") for i in range(300)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(data, "i long, a double, b double, label double, role string")).withColumn("row_hash", F.xxhash64("i"))
    plain = dict(rounds=2, depth=6, step=1.0, min_leaf=1, row_share=1.0, column_share=1.0, patience=None, max_bins=32)
    leaves = [B.boost(df, B.BoostParams(**plain, leaves=n)).model.trees[1].numNodes for n in (2, 4, 7)]
    assert leaves == [3, 7, 13]
    one = B.boost(df, B.BoostParams(**plain | {"depth": 1}, l1=30.0, l2=10.0)).model.trees[1]
    y = np.array([r[3] for r in data]) - np.mean([r[3] for r in data])
    a = np.array([r[1] for r in data])
    found = [(sum((np.sign(s) * max(abs(s) - 30, 0)) ** 2 / (n + 10) for s, n in ((y[a <= t].sum(), (a <= t).sum()), (y[a > t].sum(), (a > t).sum()))), t) for t in range(9)]
    t = max(found)[1]
    want = [np.sign(s) * max(abs(s) - 30, 0) / (n + 10) for s, n in ((y[a <= t].sum(), (a <= t).sum()), (y[a > t].sum(), (a > t).sum()))]
    scored = one.setFeaturesCol("features").transform(df).select("a", "prediction").distinct().collect()
    assert all(abs(r["prediction"] - want[int(r["a"] > t)]) < 1e-9 for r in scored)


def test_draws_and_bounds_equal_sparks(spark):
    import numpy as np

    from hearthlens.operators import boosting as B
    from hearthlens.operators import histogram as HG

    rows = spark.range(2000).withColumn("row_hash", F.xxhash64("id")).select(F.xxhash64("row_hash").alias("h"), B.row_draw("row_hash", 7, 0.4, 42).alias("d")).collect()
    assert (HG.drawn(np.array([r["h"] for r in rows], np.int64), 7, 0.4, 42) == np.array([r["d"] for r in rows])).all()
    assert list(HG.bounds(np.array([1.0, 3.0, 1.0, 2.0]), np.ones(4), 31)) == [1.5, 2.5]
    assert len(HG.bounds(np.arange(1000.0), np.ones(1000), 31)) == 31
