"""Running sums, row numbers, quantiles and curves on inputs larger than any
sample a partitioner takes: extra columns, cached and Parquet input, AQE on
and off, a constant leading key and null groups."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthlens.operators import ml as ML
from hearthlens.operators import quantiles as Q
from hearthlens.operators import relational as R

N = 2_200_000


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("big") / "t")
    h = F.xxhash64("id")
    (spark.range(N).select("id", F.lit(1).alias("one"), (F.pmod(h, F.lit(10**12)) / 7.0).alias("v"), F.pmod(h, F.lit(3)).alias("label"),
                           F.when(F.col("id") % 10 > 0, F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 7))).alias("g"),
                           F.repeat(F.lit("x"), 20).alias("pad")).write.parquet(path))
    return spark.read.parquet(path)


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("cached", [True, False])
def test_row_position_is_a_permutation_in_order(spark, big, aqe, cached):
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        df = big.cache() if cached else big
        out = R.row_position(df, ["one", "v", "id"])
        r = out.agg(F.count("*"), F.min("row_pos"), F.max("row_pos"), F.count_distinct("row_pos")).first()
        assert tuple(r) == (N, 1, N, N)
        # neighbours in position are neighbours in order
        w = Window.partitionBy(F.floor(F.col("row_pos") / 10000)).orderBy("row_pos")
        assert out.withColumn("p", F.lag("v").over(w)).where("p > v").count() == 0
        assert set(out.columns) == {*big.columns, "row_pos"}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        big.unpersist()


def test_ecdf_reaches_one(big):
    r = R.ecdf(big, "v").agg(F.max("cum_n"), F.max("ecdf"), F.sum("n")).first()
    assert tuple(r) == (N, 1.0, N)


def test_quantiles_equal_percentile(big):
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    ref = big.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs]))).first()[0]
    assert Q.column_quantiles(big, ["v"], probs)["v"] == pytest.approx(ref, rel=1e-12)
    mine = {r["g"]: r["m"] for r in Q.group_quantiles(big, ["g"], "v", [0.5], ["m"]).collect()}
    ref = {r["g"]: r["m"] for r in big.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert mine.keys() == ref.keys() and None in mine
    assert all(mine[k] == pytest.approx(ref[k], rel=1e-12) for k in ref)


def test_quantiles_when_a_sketch_misses_or_brackets_are_full(big, monkeypatch):
    df = big.where("id < 60000").withColumn("w", F.when(F.col("id") % 4 == 0, F.lit(5.0)).when(F.col("id") % 1000 == 1, F.lit(float("nan"))).otherwise(F.col("v") % 100))
    probs = [0.1, 0.25, 0.26, 1.0]
    ref = {r["g"]: r["q"] for r in df.where(~F.isnan("w")).groupBy("g").agg(F.percentile("w", F.array(*map(F.lit, probs))).alias("q")).collect()}

    def same():
        got = {r["g"]: r["q"] for r in Q.quantile_frame(df, ["g"], "w", probs).collect()}
        assert got.keys() == ref.keys() and all(got[k] == pytest.approx(ref[k], rel=1e-12) for k in ref)

    def never(*_):
        raise AssertionError("a sketch missed")

    with monkeypatch.context() as m:  # neither form needs the second way here
        m.setattr(Q, "_by_counting", never)
        same()
        cols = Q.column_quantiles(df, ["w", "v"], probs)
        assert cols["w"] == pytest.approx(df.where(~F.isnan("w")).agg(F.percentile("w", F.array(*map(F.lit, probs)))).first()[0], rel=1e-12)
    monkeypatch.setattr(Q, "WINDOW_VALUES", 10)  # range buckets
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 1)
    same()
    monkeypatch.setattr(Q, "SMALL", 50)
    monkeypatch.setattr(Q, "MARGIN", -0.06)  # every bracket misses its rank
    same()


def test_many_quantiles_count_few_values(big, monkeypatch):
    probs = [(i + 0.5) / 99 for i in range(99)][::-1]
    ref = big.agg(F.percentile("v", F.array(*map(F.lit, probs)))).first()[0]
    chosen, sizes = Q._chosen, []
    monkeypatch.setattr(Q, "_chosen", lambda counts, *a: sizes.append(counts.count()) or chosen(counts, *a))
    assert Q.column_quantiles(big, ["v"], probs)["v"] == pytest.approx(ref, rel=1e-12)
    assert sizes[0] < N / 4  # the brackets of 99 ranks do not cover the column
    two = big.where("id < 300").select("v", F.when(F.col("id") % 2 == 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))).alias("w"))
    got = Q.column_quantiles(two, ["v", "w"], [0.9, 0.1, 0.9])
    assert got["v"] == pytest.approx(two.agg(F.percentile("v", F.array(F.lit(0.9), F.lit(0.1), F.lit(0.9)))).first()[0], rel=1e-12)
    assert got["w"] == [float("inf"), float("-inf"), float("inf")]


def test_column_quantiles_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5, float("nan")), (3.0, None, 5, -0.0), (None, None, 7, 0.0)], "a double, b double, c int, d double")
    got = Q.column_quantiles(df, ["a", "b", "c", "d"], [0.0, 0.5, 0.9])
    assert got == {"a": [1.0, 2.0, pytest.approx(2.8)], "b": [None] * 3, "c": [5.0, 5.0, pytest.approx(6.6)], "d": [0.0, 0.0, 0.0]}
    assert Q.column_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
    assert Q.quantile_frame(df.limit(0), ["c"], "a", [0.5]).count() == 0


def test_group_mean_median_keeps_the_null_group(big):
    out = {r["g"]: r for r in R.group_mean_median_count(big, ["g"], "v").collect()}
    assert out[None]["median"] is not None
    two = R.group_mean_median_count(big.withColumn("k", F.col("id") % 2), ["g", "k"], "v")
    assert two.where("median is null").count() == 0 and two.count() == 2 * len(out) - 1  # ids without a group are even


def test_auc_equals_rank_sum(big):
    scored = big.select((F.col("label") == 0).cast("int").alias("label"), F.col("v").alias("score"))
    w = Window.orderBy("score")
    ranked = scored.withColumn("r", F.row_number().over(w))
    p = ranked.agg(F.sum(F.col("label") * F.col("r")).alias("s"), F.sum("label").alias("p"), F.count("*").alias("n")).first()
    auc = (p["s"] - p["p"] * (p["p"] + 1) / 2) / (p["p"] * (p["n"] - p["p"]))
    assert ML.roc_auc(scored).first()[0] == pytest.approx(auc, abs=1e-9)


def test_argmax_breaks_ties_by_item(spark):
    df = spark.createDataFrame([("a", "y", 2.0), ("a", "x", 2.0), ("a", "z", 1.0), (None, "q", 5.0)], "g string, i string, s double")
    assert {(r["g"], r["i"], r["score"]) for r in R.argmax_by_group(df, "g", "i", F.col("s")).collect()} == {("a", "x", 2.0), (None, "q", 5.0)}
