"""Group modes, distinct counts, streaming state, indicator moments, array
top-k and the out-of-bag forest, each against a plain version."""

from collections import Counter
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlens.operators import clean as C
from hearthlens.operators import quality as Q
from hearthlens.operators import relational as R
from hearthlens.operators import stats as ST
from hearthlens.operators.forest import ForestParams, bag_count, fit_forest
from hearthlens.session import ensure_checkpoint_dir
from hearthlens.streaming import stream


def _rows(n=600, seed=5):
    r = random.Random(seed)
    some = lambda values, null: None if r.random() < null else r.choice(values)
    return [(i, "hot" if r.random() < 0.4 else some("abcdef", 0.1), some("xy", 0.2), some(["p", "q", "s"], 0.4)) for i in range(n)]


def _mode(values):
    count = Counter(v for v in values if v is not None)
    return min(count, key=lambda v: (-count[v], v)) if count else None


@pytest.mark.parametrize("groups", [50_000, 0])
def test_group_mode_equals_plain_lookups(spark, groups):
    rows = _rows()
    df = spark.createDataFrame(rows, "id int, a string, b string, t string")
    got = {r["id"]: r["f"] for r in C.fill_group_mode(df, "t", ["a", "b"], [["b"]], out="f", broadcast_groups=groups, salts=3).collect()}
    whole = _mode(r[3] for r in rows)

    def want(row):
        _, a, b, t = row
        fine = _mode(x[3] for x in rows if (x[1], x[2]) == (a, b)) if a is not None and b is not None else None
        wide = _mode(x[3] for x in rows if x[2] == b) if b is not None else None
        return t or fine or wide or whole

    assert got == {r[0]: want(r) for r in rows}


def test_group_mode_without_values(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], "id int, a string, t string")
    assert {r["id"]: r["t"] for r in C.fill_group_mode(df, "t", ["a"]).collect()} == {1: None, 2: None}
    assert C.fill_group_mode(df.limit(0), "t", ["a"]).collect() == []


def test_distinct_counts_and_mergeable_sketches(spark):
    df = spark.createDataFrame(_rows(2000), "id int, a string, b string, t string").withColumn("wide", F.concat(F.lit("v"), "id"))
    cols = ["a", "b", "t", "wide"]
    exact = {r["column_name"]: (r["n_distinct"], r["rows"]) for r in Q.distinct_counts(df, cols).collect()}
    plain = df.agg(*[F.count_distinct(c).alias(c) for c in cols]).first().asDict()
    assert exact == {c: (n, 2000) for c, n in plain.items()}
    assert {r["n_distinct"] for r in Q.distinct_counts(df.limit(0), cols).collect()} == {0}
    parts = [Q.distinct_sketches(df.where(F.col("id") % 3 == i), cols) for i in range(3)]
    merged = {r["column_name"]: (r["n_distinct"], r["rows"]) for r in Q.sketched_counts(Q.merge_sketches(*parts)).collect()}
    whole = {r["column_name"]: (r["n_distinct"], r["rows"]) for r in Q.sketched_counts(Q.distinct_sketches(df, cols)).collect()}
    stepwise = Q.sketched_counts(Q.merge_sketches(Q.merge_sketches(parts[2], parts[0]), parts[1])).collect()
    assert {r["column_name"]: r["rows"] for r in stepwise} == {c: 2000 for c in cols}
    # the estimate of a merged sketch differs a little from that of one run over all rows
    assert all(abs(merged[c][0] - whole[c][0]) <= 0.02 * whole[c][0] for c in cols)
    assert all(abs(merged[c][0] - exact[c][0]) <= 0.05 * exact[c][0] for c in cols)
    assert "Expand" not in Q.cardinality_class(df, cols)._jdf.queryExecution().optimizedPlan().toString()


def test_streaming_state_survives_replays(spark):
    out = ensure_checkpoint_dir(spark) + "/state-" + str(random.random())
    state = lambda n: spark.createDataFrame([(n,)], "rows long")
    read = lambda: [r["rows"] for r in stream.read_state(spark, out, state(0).schema).collect()]
    assert read() == []
    stream.write_state(state(10), 0, out)
    stream.write_state(state(20), 1, out)
    assert read() == [20]
    stream.write_state(state(99), 1, out)  # replayed after its marker
    assert read() == [20]
    # ended between state and marker: the earlier state stands, a replay completes it
    state(5).write.parquet(f"{out}/state/{2:012d}")
    assert read() == [20]
    stream.write_state(state(30), 2, out)
    assert read() == [30] and stream.committed_epoch(spark, out) == 2


def test_streamed_null_profile_over_several_batches(spark):
    base = ensure_checkpoint_dir(spark) + "/arriving-" + str(random.random())
    df = spark.createDataFrame(_rows(), "id int, a string, b string, t string")
    df.repartition(5).write.parquet(base)
    got = stream.stream_null_profile(spark, base, df.schema, base + "-ckpt", max_files=2).collect()
    assert {(r["column_name"], r["nulls"], r["rows"]) for r in got} == {(c, df.where(F.col(c).isNull()).count(), 600) for c in df.columns}
    assert stream.committed_epoch(spark, base + "-ckpt-state") >= 2


def test_variance_gain_from_sparse_moments(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 3)) @ np.array([[1, 0.7, 0], [0, 1, 0.2], [0, 0, 1]]) + 50
    cat = [f"l{int(abs(v) * 2) % 6}" for v in x[:, 0]]
    df = spark.createDataFrame([(*map(float, a), c) for a, c in zip(x, cat)], "x double, y double, z double, c string")
    levels = sorted(set(cat))[1:]
    whole = np.corrcoef(np.column_stack([x, *[[float(c == lv) for c in cat] for lv in levels]]).T)
    lam, alone = (np.sort(np.linalg.eigvalsh(m))[::-1] for m in (whole, np.corrcoef(x.T)))
    for dense in (500, 1):
        got = ST.variance_gain(df, ["x", "y", "z"], "c", k=2, dense=dense).first()
        assert got["share_with"] == pytest.approx(lam[:2].sum() / lam.sum(), abs=1e-9)
        assert got["share_without"] == pytest.approx(alone[:2].sum() / 3, abs=1e-9)


def test_variance_gain_with_thousands_of_levels(spark):
    df = spark.range(9000).select((F.col("id") % 3000).cast("string").alias("c"), F.sin("id").alias("x"), F.cos(F.col("id") * 3).alias("y"))
    got = ST.variance_gain(df, ["x", "y"], "c", k=2).first()
    assert 0 < got["share_with"] < got["share_without"] == pytest.approx(1.0)


def test_mca_refuses_too_many_categories(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("a"), (F.col("id") % 2).cast("string").alias("b"))
    with pytest.raises(ValueError, match="52 categories"):
        ST.mca(df, ["a", "b"], most=51)


def test_top_k_in_the_row(spark):
    df = spark.createDataFrame([(1, 1.0, -3.0, 3.0), (2, None, 0.0, None), (3, None, None, None)], "id int, a double, b double, c double")
    out = R.top_k_abs_per_row(df, ["id"], ["a", "b", "c"], 2)
    assert sorted(map(tuple, out.collect())) == [(1, "b", -3.0, 1), (1, "c", 3.0, 2), (2, "b", 0.0, 1)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_forest_predicts_rows_by_bags_without_them(spark):
    from pyspark.ml.feature import VectorAssembler

    r = np.random.default_rng(1)
    x = r.uniform(-2, 2, size=(800, 2))
    noise = r.normal(scale=0.3, size=800)
    df = spark.createDataFrame([(i, float(a), float(b), float(a * a + b + e)) for i, ((a, b), e) in enumerate(zip(x, noise))], "id long, a double, b double, label double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).withColumn("row_hash", F.xxhash64("id"))
    p = ForestParams(trees=12, depth=8, min_leaf=2, bags=6, feature_share="all", parallel=2)
    counts = df.select(*[bag_count("row_hash", i, p.seed).alias(f"n{i}") for i in range(p.bags)]).toPandas()
    assert abs(counts.values.mean() - 1) < 0.06 and abs((counts.values == 0).mean() - np.exp(-1)) < 0.03
    forest = fit_forest(df, p)
    assert [b.getNumTrees for b in forest.bags] == [2] * 6
    got = forest.predict(df).orderBy("id").toPandas()
    each = np.array([b.transform(df).orderBy("id").toPandas()["prediction"] for b in forest.bags]).T
    unseen = df.select(*[(bag_count("row_hash", i, p.seed) == 0).alias(f"n{i}") for i in range(p.bags)], "id").orderBy("id").toPandas().values[:, : p.bags].astype(bool)
    for i in range(len(got)):
        assert got["prediction"][i] == pytest.approx(each[i].mean())
        assert got["oob_bags"][i] == unseen[i].sum()
        assert (np.isnan(got["oob"][i]) and not unseen[i].any()) or got["oob"][i] == pytest.approx(each[i][unseen[i]].mean())
    y, held = got["label"].values, unseen.any(1)
    error = lambda p_: np.mean((y[held] - p_[held]) ** 2)
    assert error(got["prediction"].values) < error(got["oob"].values) < 0.5 * y.var()
