"""Property tests: invariants of the statistical and scoring operators."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from hearthlens.operators import policy, stats as ST
from hearthlens.plans import common
from hearthlens.plans.q_stats import CATS, PCA_COLS


def test_pca_shares_and_orthonormal_loadings(spark):
    cl = common.clean(spark, SF_SMALL)
    expl, load, fit = ST.pca(cl, PCA_COLS)
    shares = [r["share"] for r in expl.collect()]
    assert abs(sum(shares) - 1.0) < 1e-9 and all(a >= b - 1e-12 for a, b in zip(shares, shares[1:]))
    V = fit["components"]
    assert np.allclose(V.T @ V, np.eye(V.shape[1]), atol=1e-8)


def test_vif_at_least_one(spark):
    cl = common.clean(spark, SF_SMALL)
    vals = [r["vif"] for r in ST.vif(cl, ["UValueWall", "UValueRoof", "FloorArea", "Year_of_Construction"]).collect()]
    assert all(v >= 1.0 - 1e-9 for v in vals)


def test_ks_bounds_and_symmetry(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    rows = ST.ks_two_sample(ev, "value", "event_type").collect()
    assert all(0.0 <= r["statistic"] <= 1.0 and 0.0 <= r["p_value"] <= 1.0 for r in rows)
    swapped = ev.withColumn("event_type", F.concat(F.lit("z"), "event_type"))
    a = sorted(r["statistic"] for r in rows)
    b = sorted(r["statistic"] for r in ST.ks_two_sample(swapped, "value", "event_type").collect())
    assert np.allclose(a, b)


def test_cramers_v_bounds(spark):
    cl = common.clean(spark, SF_SMALL)
    assert all(0.0 <= r["cramers_v"] <= 1.0 for r in ST.cramers_v(cl, CATS[:3]).collect())


def test_profile_invariant_to_partitioning(spark):
    cl = common.clean(spark, SF_SMALL)
    base = sorted(tuple(r) for r in policy.county_profile(cl, sort=False).collect())
    for n in (1, 7, 50):
        other = sorted(tuple(r) for r in policy.county_profile(cl.repartition(n), sort=False).collect())
        assert other == base


def test_fills_idempotent(spark):
    from hearthlens.operators import clean as C
    d = common.proxy(spark, SF_SMALL)
    once = C.fill_median(d, ["GroundFloorAreasq_m"])
    twice = C.fill_median(once, ["GroundFloorAreasq_m"])
    assert once.exceptAll(twice).count() == 0


def test_mca_and_famd_shares(spark):
    cl = common.clean(spark, SF_SMALL)
    inertia, _ = ST.mca(cl, CATS[:3], dims=5)
    assert all(r["share"] >= 0 for r in inertia.collect())
    famd = ST.famd(cl, PCA_COLS[:4], CATS[:2], dims=5).collect()
    assert famd[-1]["cum_share"] <= 1.0 + 1e-9


def test_shap_additivity(spark):
    from hearthlens.plans.registry import load_all
    df = load_all()["shap_values"].run(spark, SF_SMALL)
    assert df.agg(F.max("additivity_error")).first()[0] < 1e-6


def test_counting_quantiles_equal_percentile(spark):
    """Counting quantiles equal Spark's exact percentile, globally and per group."""
    from hearthlens.operators import quantiles as QQ
    cl = common.clean(spark, SF_SMALL)
    cols = ["BerRating", "FabricHeatLossProxy", "HSMainSystemEfficiency"]
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    mine = QQ.column_quantiles(cl, cols, probs)
    ref = cl.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in cols]).first()
    for c in cols:
        assert np.allclose(mine[c], ref[c], rtol=1e-12, atol=1e-9)
    g = {r[0]: r[1] for r in QQ.group_quantiles(cl, ["CountyName"], "BerRating", [0.5], ["m"]).collect()}
    r2 = {r[0]: r[1] for r in cl.groupBy("CountyName").agg(F.median("BerRating")).collect()}
    assert g.keys() == r2.keys() and all(abs(g[k] - r2[k]) < 1e-9 for k in g)


def test_quantiles_hot_and_null_groups(spark):
    """A group holding a third of all rows and a null group key."""
    from hearthlens.operators import quantiles as QQ
    rows = [("hot", float(i % 997)) for i in range(3000)] + \
           [(f"g{i % 20}", float(i) / 7.0) for i in range(6000)] + [(None, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    mine = {r["g"]: r["m"] for r in QQ.group_quantiles(df, ["g"], "v", [0.5], ["m"]).collect()}
    ref = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert mine.keys() == ref.keys() and None in mine
    assert all(abs(mine[k] - ref[k]) < 1e-9 for k in ref)


def test_stream_clean_equals_batch(spark):
    from hearthlens.plans import common, dwelling
    from hearthlens.plans.registry import load_all
    batch = dwelling.clean_pipeline(common.proxy(spark, SF_SMALL))
    stream = load_all()["stream_clean"].run(spark, SF_SMALL)
    cols = sorted(batch.columns)
    assert sorted(stream.columns) == cols
    assert batch.select(*cols).exceptAll(stream.select(*cols)).count() == 0
    assert stream.select(*cols).exceptAll(batch.select(*cols)).count() == 0


def test_pairwise_moments_many_columns(spark):
    """60 columns -> 1770 pairs, split over several aggregate jobs; equals corr()."""
    cols = [f"c{i}" for i in range(60)]
    df = spark.range(2000).select(*[((F.col("id") * (i + 3)) % (97 + i)).cast("double").alias(c) for i, c in enumerate(cols)])
    df = df.withColumn("c5", F.when(F.col("c5") > 50, None).otherwise(F.col("c5")))  # a nullable column
    _, _, corr = ST.pairwise_moments(df, cols)
    for i, j in [(0, 1), (5, 7), (10, 59), (33, 34)]:
        d = df.where(F.col(cols[i]).isNotNull() & F.col(cols[j]).isNotNull())
        ref = d.agg(F.corr(cols[i], cols[j])).first()[0]
        assert abs(corr[i, j] - ref) < 1e-9
