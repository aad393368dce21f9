"""Join / aggregation / window / ordering queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthlens import config
from hearthlens.functions import features as fx
from hearthlens.operators import ml
from hearthlens.operators import quality as Q
from hearthlens.operators import relational as R
from hearthlens.plans import common
from hearthlens.plans.oracle import grade_sql, sql_str, with_clean
from hearthlens.plans.q_clean import FORMULA_SCORE, formula_score
from hearthlens.plans.q_features import ONE_HOT_SQL
from hearthlens.plans.registry import register
from hearthlens.sources.tables import DWELLING_KEY

K = ", ".join(DWELLING_KEY)
CK = ", ".join(f"clean.{k}" for k in DWELLING_KEY)
CORR_COLS = ["BerRating", "UValueWall", "UValueRoof", "UValueFloor", "UValueWindow", "WallArea", "RoofArea",
             "FloorArea", "WindowArea", "GroundFloorAreasq_m", "HSMainSystemEfficiency", "FabricHeatLossProxy",
             "WindowToWallRatio", "EstCO2_kg_per_m2"]


@register("J01", "enrich_join", with_clean(
    f"SELECT {CK}, o_totalprice AS order_value, o_orderstatus AS order_status FROM clean LEFT JOIN orders ON clean.l_orderkey = orders.o_orderkey"))
def enrich_join(spark, sf):
    orders = common.table(spark, sf, "orders")
    out = R.enrich_join(common.clean(spark, sf), orders, ["l_orderkey"], ["o_orderkey"],
                        {"o_totalprice": "order_value", "o_orderstatus": "order_status"})
    return out.select(*DWELLING_KEY, "order_value", "order_status")


def _fuel_sql():
    rows = ", ".join(f"({sql_str(k)}, {v!r}e0)" for k, v in config.CO2_FACTORS.items())
    return f"fuel_factors AS (SELECT * FROM (VALUES {rows}) t(fuel, factor))"


@register("J02", "lookup_join", with_clean(
    f"SELECT {CK}, coalesce(factor, 0.25e0) AS co2_factor FROM clean LEFT JOIN fuel_factors ON clean.MainSpaceHeatingFuel = fuel_factors.fuel",
    _fuel_sql()))
def lookup_join(spark, sf):
    # the factor table is fixed config (27 rows): broadcast has a fixed bound
    fac = spark.createDataFrame(list(config.CO2_FACTORS.items()), "MainSpaceHeatingFuel string, factor double")
    out = R.lookup_join(common.clean(spark, sf), fac, ["MainSpaceHeatingFuel"], "factor",
                        default=config.DEFAULT_CO2_FACTOR, out="co2_factor", broadcast=True)
    return out.select(*DWELLING_KEY, "co2_factor")


SCEN_KEYS = list(config.scenarios().keys())


@register("J03", "scenario_cross", with_clean(
    f"SELECT {K}, scenario FROM clean CROSS JOIN (VALUES " + ", ".join(f"({sql_str(k)})" for k in SCEN_KEYS) + ") s(scenario)"))
def scenario_cross(spark, sf):
    out = R.expand_by_catalogue(common.clean(spark, sf).select(*DWELLING_KEY), [{"key": k} for k in SCEN_KEYS])
    return out.select(*DWELLING_KEY, F.col("scenario.key").alias("scenario"))


@register("J04", "column_concat", ONE_HOT_SQL)
def column_concat(spark, sf):
    """Aligned columns side by side: numerics and dummies stay in one frame
    keyed by the row key (no positional concat, no join)."""
    from hearthlens.plans.q_features import one_hot
    return one_hot(spark, sf)


@register("J05", "small_table_join", with_clean(
    "SELECT n.column_name, n.nulls, round(c.r, 6) AS r FROM (" +
    " UNION ALL ".join(f"SELECT {sql_str(c)} AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM clean" for c in CORR_COLS[1:]) +
    ") n JOIN (" + " UNION ALL ".join(f"SELECT {sql_str(c)} AS feature, corr({c}, BerRating) AS r FROM clean" for c in CORR_COLS[1:]) +
    ") c ON n.column_name = c.feature"))
def small_table_join(spark, sf):
    cl = common.clean(spark, sf)
    nulls = Q.null_profile(cl, CORR_COLS[1:]).select("column_name", "nulls")
    corr = Q.target_correlations(cl, CORR_COLS[1:], "BerRating").select(F.col("feature").alias("column_name"), "r")
    return nulls.join(corr, "column_name").select("column_name", "nulls", F.round("r", 6).alias("r"))


@register("G02", "group_mean_median_count", with_clean(
    "SELECT AgeBand, round(avg(BerRating), 6) AS mean, round(median(BerRating), 6) AS median, count(BerRating) AS count FROM clean GROUP BY AgeBand"))
def group_mean_median_count(spark, sf):
    g = R.group_mean_median_count(common.clean(spark, sf), ["AgeBand"], "BerRating")
    return g.select("AgeBand", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "count")


@register("G03", "group_mean_std_count", with_clean(
    "SELECT DwellingTypeDescr, round(avg(BerRating), 6) AS mean, round(stddev_samp(BerRating), 6) AS std, count(BerRating) AS count "
    "FROM clean GROUP BY DwellingTypeDescr"))
def group_mean_std_count(spark, sf):
    g = R.group_mean_std_count(common.clean(spark, sf), ["DwellingTypeDescr"], "BerRating")
    return g.select("DwellingTypeDescr", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "count")


PROBS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


@register("G05", "quantile", with_clean(
    " UNION ALL ".join(f"SELECT {p!r}e0 AS p, round(quantile_cont(BerRating, {p}), 6) AS value FROM clean" for p in PROBS)))
def quantile(spark, sf):
    q = R.quantiles_table(common.clean(spark, sf), "BerRating", PROBS)
    return q.select("p", F.round("value", 6).alias("value"))


def _pairs_sql(cols):
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            parts.append(f"SELECT {sql_str(cols[i])} AS col_a, {sql_str(cols[j])} AS col_b, {i} AS pos_a, {j} AS pos_b, "
                         f"corr({cols[i]}, {cols[j]}) AS r FROM clean")
    return "corr_long AS (" + " UNION ALL ".join(parts) + ")"


@register("G06", "correlation_matrix", with_clean(
    "SELECT col_a, col_b, pos_a, pos_b, round(r, 6) AS r FROM corr_long", _pairs_sql(CORR_COLS)))
def correlation_matrix(spark, sf):
    c = R.correlation_long(common.clean(spark, sf), CORR_COLS)
    return c.select("col_a", "col_b", "pos_a", "pos_b", F.round("r", 6).alias("r"))


@register("G07", "correlated_pairs", with_clean(
    "SELECT col_a, col_b, round(r, 6) AS r FROM corr_long WHERE abs(r) > 0.7e0", _pairs_sql(CORR_COLS)))
def correlated_pairs(spark, sf):
    c = R.correlated_pairs(R.correlation_long(common.clean(spark, sf), CORR_COLS), 0.7)
    return c.select("col_a", "col_b", F.round("r", 6).alias("r"))


@register("G08", "redundant_columns", with_clean(
    "SELECT DISTINCT col_b AS column_name FROM corr_long WHERE abs(r) > 0.95e0 AND col_b <> 'BerRating'", _pairs_sql(CORR_COLS)))
def redundant_columns(spark, sf):
    return R.redundant_columns(R.correlation_long(common.clean(spark, sf), CORR_COLS), 0.95, protect=["BerRating"])


@register("G09", "weak_columns", with_clean(
    "SELECT feature, round(abs_r, 6) AS abs_r FROM (" + " UNION ALL ".join(
        f"SELECT {sql_str(c)} AS feature, abs(corr(CAST({c} AS DOUBLE), BerRating)) AS abs_r FROM clean"
        for c in CORR_COLS[1:] + ["Year_of_Construction", "l_linenumber", "NoOfSidesSheltered"]) + ") WHERE abs_r < 0.01e0"))
def weak_columns(spark, sf):
    t = Q.target_correlations(common.clean(spark, sf), CORR_COLS[1:] + ["Year_of_Construction", "l_linenumber",
                                                                        "NoOfSidesSheltered"], "BerRating")
    return t.where(F.col("abs_r") < 0.01).select("feature", F.round("abs_r", 6).alias("abs_r"))


@register("G10", "crosstab", with_clean(
    "SELECT AgeBand, MainSpaceHeatingFuel, count(*) AS n FROM clean GROUP BY AgeBand, MainSpaceHeatingFuel"))
def crosstab(spark, sf):
    return R.crosstab_long(common.clean(spark, sf), "AgeBand", "MainSpaceHeatingFuel")


ATTR = ["UValueWall", "UValueRoof", "UValueFloor", "UValueWindow", "WindowToWallRatio"]


def _dev_sql():
    devs = ", ".join(f"{c} - (SELECT avg({c}) FROM clean) AS {c}" for c in ATTR)
    return f"dev AS (SELECT {K}, CountyName, {devs} FROM clean)"


def _dev(spark, sf):
    cl = common.clean(spark, sf)
    means = cl.agg(*[F.avg(c).alias(c) for c in ATTR]).first()
    return cl.select(*DWELLING_KEY, "CountyName", *[(F.col(c) - F.lit(means[c])).alias(c) for c in ATTR])


def _dev_long(spark, sf):
    return R.unpivot_features(_dev(spark, sf), DWELLING_KEY + ["CountyName"], ATTR)


@register("G11", "group_feature_abs_mean", with_clean(
    "SELECT CountyName, round(avg(v), 6) AS mean_abs_overall FROM (SELECT CountyName, feature, abs(avg(value)) AS v FROM "
    "(UNPIVOT dev ON " + ", ".join(ATTR) + " INTO NAME feature VALUE value) GROUP BY CountyName, feature) GROUP BY CountyName",
    _dev_sql()))
def group_feature_abs_mean(spark, sf):
    _per, overall = R.group_feature_abs_mean(_dev_long(spark, sf), "CountyName")
    return overall.select("CountyName", F.round("mean_abs_overall", 6).alias("mean_abs_overall"))


@register("G12", "mean_abs_by_feature", with_clean(
    "SELECT feature, round(avg(abs(value)), 6) AS mean_abs, CAST(rank() OVER (ORDER BY round(avg(abs(value)), 6) DESC) AS INT) AS rank "
    "FROM (UNPIVOT dev ON " + ", ".join(ATTR) + " INTO NAME feature VALUE value) GROUP BY feature", _dev_sql()))
def mean_abs_by_feature(spark, sf):
    m = R.mean_abs_by_feature(_dev_long(spark, sf)).withColumn("mean_abs", F.round("mean_abs", 6))
    # ranking a per-feature table: bounded by the feature count
    return m.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean_abs"))).cast("int"))


@register("G13", "histogram", with_clean(
    "SELECT CAST(least(floor((BerRating - lo) / w), 79) AS INT) AS bin, count(*) AS n, lo + CAST(least(floor((BerRating - lo) / w), 79) AS INT) * w AS bin_lo "
    "FROM clean, (SELECT min(BerRating) AS lo, (max(BerRating) - min(BerRating)) / 80 AS w FROM clean) GROUP BY ALL"))
def histogram(spark, sf):
    return R.histogram(common.clean(spark, sf), "BerRating", 80)


GRADES = [b[2] for b in config.GRADE_BANDS]


@register("G14", "band_counts", with_clean(
    "SELECT b.grade, b.band_order, coalesce(n, 0) AS n FROM (VALUES " +
    ", ".join(f"({sql_str(g)}, {i})" for i, g in enumerate(GRADES)) + ") b(grade, band_order) LEFT JOIN "
    f"(SELECT {grade_sql('BerRating')} AS grade, count(*) AS n FROM clean GROUP BY 1) c ON b.grade = c.grade"))
def band_counts(spark, sf):
    g = common.clean(spark, sf).withColumn("grade", fx.rating_grade("BerRating"))
    return R.band_counts(g, "grade", GRADES)


@register("G15", "confusion_matrix", with_clean(
    "SELECT actual, predicted, n, n / sum(n) OVER (PARTITION BY actual) AS row_share FROM "
    f"(SELECT {grade_sql('BerRating')} AS actual, {grade_sql('(' + FORMULA_SCORE + ')')} AS predicted, count(*) AS n FROM clean GROUP BY 1, 2)"))
def confusion_matrix(spark, sf):
    d = common.clean(spark, sf).withColumn("s", formula_score(None)).select(
        fx.rating_grade("BerRating").alias("actual"), fx.rating_grade("s").alias("predicted"))
    return ml.confusion_matrix(d, "actual", "predicted")


NUM_FEATS = ["UValueWall", "UValueRoof", "UValueFloor", "UValueWindow", "WallArea", "RoofArea", "FloorArea", "WindowArea"]


@register("W02", "cumulative_share", with_clean(
    "SELECT feature, pos, round(share, 6) AS share, round(cum_share, 6) AS cum_share, "
    "min(CASE WHEN cum_share >= 0.8e0 THEN pos END) OVER () AS k80, min(CASE WHEN cum_share >= 0.9e0 THEN pos END) OVER () AS k90, "
    "min(CASE WHEN cum_share >= 0.95e0 THEN pos END) OVER () AS k95 FROM (SELECT feature, pos, share, "
    "sum(share) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_share FROM "
    "(SELECT feature, share, CAST(row_number() OVER (ORDER BY share DESC, feature) AS INT) AS pos FROM "
    "(SELECT feature, v / sum(v) OVER () AS share FROM (" +
    " UNION ALL ".join(f"SELECT {sql_str(c)} AS feature, var_samp({c}) AS v FROM clean" for c in NUM_FEATS) + "))))"))
def cumulative_share(spark, sf):
    """Explained-variance style share of each feature's variance, running sum
    in descending order and the first position reaching 80/90/95 %.  The
    windows run on a per-feature table (bounded by the feature count)."""
    v = Q._wide_to_long(common.clean(spark, sf), {"v": lambda c: F.var_samp(c)}, NUM_FEATS).withColumnRenamed("column_name", "feature")
    w_all = Window.partitionBy()
    v = v.withColumn("share", F.col("v") / F.sum("v").over(w_all))
    v = v.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("share"), "feature")).cast("int"))
    v = v.withColumn("cum_share", F.sum("share").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    ks = {f"k{int(t * 100)}": F.min(F.when(F.col("cum_share") >= t, F.col("pos"))).over(w_all) for t in (0.8, 0.9, 0.95)}
    return v.withColumns(ks).select("feature", "pos", F.round("share", 6).alias("share"),
                                    F.round("cum_share", 6).alias("cum_share"), "k80", "k90", "k95")


@register("W03", "share_of_total", with_clean(
    "SELECT DwellingTypeDescr, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM clean GROUP BY DwellingTypeDescr"))
def share_of_total(spark, sf):
    c = common.clean(spark, sf).groupBy("DwellingTypeDescr").agg(F.count(F.lit(1)).alias("n"))
    # the window runs on the per-value count table (bounded by the cardinality)
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@register("W04", "duplicate_groups", with_clean(
    f"SELECT {K} FROM clean WHERE (l_orderkey, l_linenumber) IN "
    "(SELECT (l_orderkey, l_linenumber) FROM clean GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"))
def duplicate_groups(spark, sf):
    return R.duplicate_groups(common.clean(spark, sf), ["l_orderkey", "l_linenumber"]).select(*DWELLING_KEY)


@register("W05", "row_position", with_clean(f"SELECT {K}, row_number() OVER (ORDER BY {K}) AS row_pos FROM clean"))
def row_position(spark, sf):
    return R.row_position(common.clean(spark, sf).select(*DWELLING_KEY), DWELLING_KEY)


@register("W06", "ecdf", with_clean(
    "SELECT BerRating, n, CAST(sum(n) OVER (ORDER BY BerRating) AS BIGINT) AS cum_n, "
    "round(sum(n) OVER (ORDER BY BerRating) / sum(n) OVER (), 9) AS ecdf FROM "
    "(SELECT BerRating, count(*) AS n FROM clean WHERE BerRating IS NOT NULL GROUP BY BerRating)"))
def ecdf(spark, sf):
    e = R.ecdf(common.clean(spark, sf), "BerRating")
    return e.select("BerRating", "n", "cum_n", F.round("ecdf", 9).alias("ecdf"))


@register("T03", "top_k_abs_per_row", with_clean(
    f"SELECT {K}, feature, round(value, 9) AS value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {K} "
    "ORDER BY abs(value) DESC, feature) AS INT) AS rank FROM (UNPIVOT dev ON " + ", ".join(ATTR) +
    " INTO NAME feature VALUE value)) WHERE rank <= 3", _dev_sql()))
def top_k_abs_per_row(spark, sf):
    t = R.top_k_abs_per_row(_dev(spark, sf), DWELLING_KEY, ATTR, 3)
    return t.select(*DWELLING_KEY, "feature", F.round("value", 9).alias("value"), F.col("rank").cast("int"))


@register("T04", "argmax_by_group", with_clean(
    "SELECT CountyName, arg_max(feature, abs_r) AS feature, round(max(abs_r), 6) AS score FROM (" +
    " UNION ALL ".join(f"SELECT CountyName, {sql_str(c)} AS feature, abs(corr({c}, BerRating)) AS abs_r FROM clean GROUP BY CountyName"
                       for c in ["UValueWall", "UValueRoof", "UValueFloor", "UValueWindow", "FabricHeatLossProxy"]) +
    ") GROUP BY CountyName"))
def argmax_by_group(spark, sf):
    feats = ["UValueWall", "UValueRoof", "UValueFloor", "UValueWindow", "FabricHeatLossProxy"]
    per = common.clean(spark, sf).groupBy("CountyName").agg(*[F.abs(F.corr(c, "BerRating")).alias(c) for c in feats])
    long = per.unpivot(["CountyName"], feats, "feature", "abs_r")
    a = R.argmax_by_group(long, "CountyName", "feature", F.col("abs_r"))
    return a.select("CountyName", "feature", F.round("score", 6).alias("score"))


@register("T05", "sample_n", with_clean(f"SELECT {K}, BerRating FROM clean ORDER BY md5(concat_ws('|', {K}, 42)), {K} LIMIT 200"))
def sample_n(spark, sf):
    """Exactly n rows, seeded and partition-independent (a sampling operator:
    here the limit is the feature)."""
    return ml.hash_sample(common.clean(spark, sf), 200, DWELLING_KEY, seed=42).select(*DWELLING_KEY, "BerRating")
