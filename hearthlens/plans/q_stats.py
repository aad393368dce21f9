"""Statistical-test and factor-method queries."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthlens.operators import relational as R
from hearthlens.operators import stats as ST
from hearthlens.plans import common
from hearthlens.plans.oracle import sql_str, with_clean
from hearthlens.plans.q_clean import FORMULA_SCORE
from hearthlens.plans.registry import register

PCA_COLS = ["UValueWall", "UValueRoof", "UValueFloor", "UValueWindow", "WallArea", "RoofArea", "FloorArea",
            "WindowArea", "HSMainSystemEfficiency", "HSSupplHeatFraction", "NoOfSidesSheltered", "FabricHeatLossProxy",
            "WindowToWallRatio", "Year_of_Construction"]
CATS = ["DwellingTypeDescr", "AgeBand", "MainSpaceHeatingFuel", "StructureType", "SolarHotWaterHeating"]
MEASURES = ["BerRating", "UValueWall", "FabricHeatLossProxy"]


def _ks_sql():
    p_expr = ("CASE WHEN lam < 1e-3 THEN 1e0 ELSE greatest(0e0, least(1e0, 2e0 * list_sum([(CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END)"
              " * exp(-2e0 * k * k * lam * lam) FOR k IN range(1, 101)]))) END")
    return f"""
WITH c AS (SELECT value, event_type, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
vals AS (SELECT DISTINCT value FROM c),
types AS (SELECT event_type, sum(n) AS tot FROM c GROUP BY 1),
grid AS (SELECT v.value, t.event_type, t.tot, coalesce(c.n, 0) AS n FROM vals v CROSS JOIN types t
         LEFT JOIN c ON c.value = v.value AND c.event_type = t.event_type),
cum AS (SELECT value, event_type, tot, sum(n) OVER (PARTITION BY event_type ORDER BY value) / tot AS F FROM grid),
d AS (SELECT a.event_type AS group_a, b.event_type AS group_b, CAST(any_value(a.tot) AS BIGINT) AS n_a,
             CAST(any_value(b.tot) AS BIGINT) AS n_b, max(abs(a.F - b.F)) AS statistic
      FROM cum a JOIN cum b ON a.value = b.value AND a.event_type < b.event_type GROUP BY 1, 2),
l AS (SELECT *, (sqrt(n_a * n_b / (n_a + n_b)) + 0.12e0 + 0.11e0 / sqrt(n_a * n_b / (n_a + n_b))) * statistic AS lam FROM d)
SELECT group_a, group_b, n_a, n_b, round(statistic, 9) AS statistic, round({p_expr}, 6) AS p_value FROM l"""


@register("A01", "ks_two_sample", _ks_sql())
def ks_two_sample(spark, sf):
    ev = common.table(spark, sf, "events")
    r = ST.ks_two_sample(ev, "value", "event_type")
    return r.select("group_a", "group_b", "n_a", "n_b", F.round("statistic", 9).alias("statistic"),
                    F.round("p_value", 6).alias("p_value"))


@register("A02", "anova_f", with_clean(
    "SELECT 'DwellingTypeDescr' AS category, 'BerRating' AS measure, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, "
    "round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(ssw) / (sum(n) - count(*))), 6) AS f FROM "
    "(SELECT DwellingTypeDescr, count(BerRating) AS n, avg(BerRating) AS m, var_pop(BerRating) * count(BerRating) AS ssw "
    "FROM clean WHERE BerRating IS NOT NULL GROUP BY DwellingTypeDescr), (SELECT avg(BerRating) AS gm FROM clean)"))
def anova_f(spark, sf):
    r = ST.anova_f(common.clean(spark, sf), "DwellingTypeDescr", "BerRating")
    return r.select("category", "measure", "groups", "n", F.round("f", 6).alias("f"))


def _eta_sql(cats, measures):
    parts = []
    for c in cats:
        for m in measures:
            parts.append(
                f"SELECT {sql_str(c)} AS category, {sql_str(m)} AS measure, round(CASE WHEN sst > 0 THEN ssb / sst ELSE 0e0 END, 6) AS eta_squared "
                f"FROM (SELECT sum(CASE WHEN n > 1 THEN n * (a - gm) * (a - gm) ELSE 0e0 END) AS ssb FROM "
                f"(SELECT coalesce(CAST({c} AS VARCHAR), 'nan') AS v, count({m}) AS n, avg({m}) AS a FROM clean GROUP BY 1), "
                f"(SELECT avg({m}) AS gm FROM clean)), (SELECT var_pop({m}) * count({m}) AS sst FROM clean)")
    return " UNION ALL ".join(parts)


@register("A03", "eta_squared", with_clean(_eta_sql(CATS, MEASURES)))
def eta_squared(spark, sf):
    r = ST.eta_squared(common.clean(spark, sf), CATS, MEASURES)
    return r.select("category", "measure", F.round("eta_squared", 6).alias("eta_squared"))


def _cramer_sql(pairs):
    parts = []
    for a, b in pairs:
        va, vb = f"coalesce(CAST({a} AS VARCHAR), 'nan')", f"coalesce(CAST({b} AS VARCHAR), 'nan')"
        parts.append(f"""SELECT {sql_str(a)} AS col_a, {sql_str(b)} AS col_b, n, r, k, chi2 FROM (
  SELECT any_value(n) AS n, any_value(r) AS r, any_value(k) AS k,
         sum(CASE WHEN (r - 1) * (k - 1) = 1 THEN greatest(abs(o - e) - 0.5e0, 0e0) ELSE abs(o - e) END
           * CASE WHEN (r - 1) * (k - 1) = 1 THEN greatest(abs(o - e) - 0.5e0, 0e0) ELSE abs(o - e) END / e) AS chi2
  FROM (SELECT rm.va, cm.vb, CAST(coalesce(cells.o, 0) AS DOUBLE) AS o, rm.ri * cm.cj / t.n AS e, t.n, t.r, t.k
        FROM (SELECT {va} AS va, count(*) AS ri FROM clean GROUP BY 1) rm
        JOIN (SELECT {vb} AS vb, count(*) AS cj FROM clean GROUP BY 1) cm ON TRUE
        LEFT JOIN (SELECT {va} AS va, {vb} AS vb, count(*) AS o FROM clean GROUP BY 1, 2) cells ON cells.va = rm.va AND cells.vb = cm.vb,
        (SELECT count(*) AS n, count(DISTINCT {va}) AS r, count(DISTINCT {vb}) AS k FROM clean) t))""")
    body = " UNION ALL ".join(parts)
    return f"""SELECT col_a, col_b, n, r, k, round(chi2, 6) AS chi2,
  round(CASE WHEN least(r - (r - 1) * (r - 1) / (n - 1) - 1, k - (k - 1) * (k - 1) / (n - 1) - 1) > 0
    THEN sqrt(greatest(0e0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) /
              least(r - (r - 1) * (r - 1) / (n - 1) - 1, k - (k - 1) * (k - 1) / (n - 1) - 1)) ELSE 0e0 END, 6) AS cramers_v
FROM ({body})"""


PAIRS = [(a, b) for i, a in enumerate(CATS) for b in CATS[i + 1:]]


@register("A04", "cramers_v", with_clean(_cramer_sql(PAIRS)))
def cramers_v(spark, sf):
    r = ST.cramers_v(common.clean(spark, sf), CATS)
    return r.select("col_a", "col_b", "n", "r", "k", F.round("chi2", 6).alias("chi2"),
                    F.round("cramers_v", 6).alias("cramers_v"))


VIF_COLS = ["UValueWall", "UValueRoof", "UValueFloor", "UValueWindow", "WallArea", "RoofArea", "FloorArea",
            "HSMainSystemEfficiency", "NoOfSidesSheltered", "Year_of_Construction", "WindowToWallRatio"]


@register("A05", "vif")
def vif(spark, sf):
    return ST.vif(common.clean(spark, sf), VIF_COLS)


# FIXED VALUES — collinearity clusters used by the keep/drop decision (proxy columns).
CLUSTERS = {
    "Size": ["WallArea", "RoofArea", "FloorArea", "WindowArea"],
    "Insulation": ["UValueWall", "UValueRoof", "UValueFloor", "UValueWindow"],
    "Building": ["NoOfSidesSheltered", "Year_of_Construction"],
    "Efficiency": ["HSMainSystemEfficiency"],
    "Ratio": ["WindowToWallRatio"],
}


@register("A06", "collinearity_decision")
def collinearity_decision(spark, sf):
    """Keep / Drop / Monitor per feature: VIF > 10 keeps only the cluster
    member with the highest |r| with the target; 5 < VIF <= 10 keeps when
    |r| > 0.2; otherwise keep."""
    cl = common.clean(spark, sf)
    v = ST.vif(cl, VIF_COLS)
    from hearthlens.operators import quality as Q
    r = Q.target_correlations(cl, VIF_COLS, "BerRating").select("feature", "abs_r")
    cl_rows = [(f, c) for c, fs in CLUSTERS.items() for f in fs]
    clusters = spark.createDataFrame(cl_rows, "feature string, cluster string")
    t = v.join(r, "feature").join(clusters, "feature", "left")
    keeper = t.groupBy("cluster").agg(F.max_by("feature", F.struct("abs_r", "feature")).alias("keeper"))
    t = t.join(keeper, "cluster", "left")
    dec = (F.when(F.col("vif") > 10, F.when(F.col("keeper") == F.col("feature"), "Keep").otherwise("Drop"))
            .when(F.col("vif") > 5, F.when(F.col("abs_r") > 0.2, "Keep").otherwise("Monitor")).otherwise("Keep"))
    return t.select("feature", "cluster", F.round("vif", 6).alias("vif"), F.round("abs_r", 6).alias("abs_r"),
                    "keeper", dec.alias("decision"))


A7_COLS = ["BerRating", "UValueWall", "UValueRoof", "UValueFloor", "UValueWindow", "WallArea", "RoofArea", "FloorArea",
           "WindowArea", "HSMainSystemEfficiency", "FabricHeatLossProxy", "EstCO2_kg_per_m2"]
A7_CANDIDATES = ["WallArea", "RoofArea", "WindowArea", "FabricHeatLossProxy", "UValueWindow"]


def _a7_sql():
    pairs = []
    for i, a in enumerate(A7_COLS):
        for b in A7_COLS[i + 1:]:
            pairs.append(f"SELECT {sql_str(a)} AS a, {sql_str(b)} AS b, round(abs(corr({a}, {b})), 9) AS r FROM clean")
    ctes = [f"""pr AS ({" UNION ALL ".join(pairs)}),
sym AS (SELECT a, b, r FROM pr UNION ALL SELECT b, a, r FROM pr),
tgt AS (SELECT b AS feature, r AS r_target FROM sym WHERE a = 'BerRating'),
top3 AS (SELECT a AS candidate, b AS other, r, row_number() OVER (PARTITION BY a ORDER BY r DESC, b) AS rk
         FROM sym WHERE b <> 'BerRating' AND a IN ({", ".join(sql_str(c) for c in A7_CANDIDATES)})),
t3 AS (SELECT * FROM top3 WHERE rk <= 3),
grp AS (SELECT candidate, candidate AS member FROM t3 GROUP BY candidate
        UNION SELECT candidate, other FROM t3 WHERE r > 0.7e0),
keep AS (SELECT candidate, arg_max(member, (r_target, member)) AS keeper, CAST(count(*) - 1 AS INT) AS n_group
         FROM grp JOIN tgt ON grp.member = tgt.feature GROUP BY candidate)"""]
    body = f"""SELECT t3.candidate, string_agg(other || ':' || printf('%.4f', r), ',' ORDER BY rk) AS top3, any_value(keeper) AS keeper,
       any_value(n_group) AS n_group
FROM t3 JOIN keep USING (candidate) GROUP BY t3.candidate"""
    return with_clean(body, *ctes)


@register("A07", "removal_candidates", _a7_sql())
def removal_candidates(spark, sf):
    cl = common.clean(spark, sf)
    corr = R.correlation_long(cl, A7_COLS).select("col_a", "col_b", F.round(F.abs("r"), 9).alias("r"))
    sym = corr.select(F.col("col_a").alias("a"), F.col("col_b").alias("b"), "r").unionByName(
        corr.select(F.col("col_b").alias("a"), F.col("col_a").alias("b"), "r"))
    tgt = sym.where(F.col("a") == "BerRating").select(F.col("b").alias("feature"), F.col("r").alias("r_target"))
    w = Window.partitionBy("a").orderBy(F.desc("r"), "b")  # per candidate: bounded by the feature count
    t3 = (sym.where((F.col("b") != "BerRating") & F.col("a").isin(A7_CANDIDATES))
             .withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= 3))
    members = t3.select(F.col("a").alias("candidate"), F.col("a").alias("member")).distinct().unionByName(
        t3.where(F.col("r") > 0.7).select(F.col("a").alias("candidate"), F.col("b").alias("member"))).distinct()
    keep = members.join(tgt, members.member == tgt.feature).groupBy("candidate").agg(
        F.max_by("member", F.struct("r_target", "member")).alias("keeper"),
        (F.count(F.lit(1)) - 1).cast("int").alias("n_group"))
    top = t3.groupBy(F.col("a").alias("candidate")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "b", "r"))),
                                 lambda s: F.concat(s["b"], F.lit(":"), F.format_string("%.4f", s["r"]))), ",").alias("top3"))
    return top.join(keep, "candidate").select("candidate", "top3", "keeper", "n_group")


@register("A08", "pca")
def pca(spark, sf):
    expl, _load, _fit = ST.pca(common.clean(spark, sf), PCA_COLS)
    return expl


@register("A09", "pca_loading_rank")
def pca_loading_rank(spark, sf):
    expl, load, _ = ST.pca(common.clean(spark, sf), PCA_COLS)
    k = ST.components_needed(expl).first()["k90"]
    return ST.loading_rank(load, int(k))


@register("A10", "pc_target_correlation")
def pc_target_correlation(spark, sf):
    cl = common.clean(spark, sf)
    _, _, fit = ST.pca(cl, PCA_COLS)
    scored = ST.pca_scores(ST.complete_rows(cl, PCA_COLS), fit, 5)
    return scored.agg(*[F.corr(f"pc{j}", "BerRating").alias(f"r_pc{j}") for j in range(1, 6)])


@register("A11", "lda")
def lda(spark, sf):
    expl, _coef = ST.lda(common.clean(spark, sf), PCA_COLS, "DwellingTypeDescr")
    return expl


@register("A12", "mca")
def mca(spark, sf):
    inertia, _coords = ST.mca(common.clean(spark, sf), CATS, dims=20)
    return inertia


@register("A13", "famd")
def famd(spark, sf):
    return ST.famd(common.clean(spark, sf), PCA_COLS, CATS, dims=30)


@register("A14", "variance_gain")
def variance_gain(spark, sf):
    return ST.variance_gain(common.clean(spark, sf), PCA_COLS, "StructureType", k=5)


@register("A15", "keep_drop_rule", with_clean(
    "SELECT e.category, round(e.eta, 6) AS eta_squared, round(v.cramers_v, 6) AS cramers_v, "
    "CASE WHEN e.eta > 0.06e0 OR v.cramers_v > 0.3e0 THEN 'KEEP' ELSE 'DROP' END AS verdict FROM "
    "(SELECT category, eta_squared AS eta FROM (" + _eta_sql(["AgeBand", "StructureType", "SolarHotWaterHeating"], ["BerRating"]) + ")) e JOIN "
    "(SELECT col_a AS category, cramers_v FROM (" + _cramer_sql([("AgeBand", "DwellingTypeDescr"), ("StructureType", "DwellingTypeDescr"),
                                                                 ("SolarHotWaterHeating", "DwellingTypeDescr")]) + ")) v USING (category)"))
def keep_drop_rule(spark, sf):
    cl = common.clean(spark, sf)
    cats = ["AgeBand", "StructureType", "SolarHotWaterHeating"]
    eta = ST.eta_squared(cl, cats, ["BerRating"]).select(F.col("category"), F.col("eta_squared").alias("eta"))
    v = ST.cramers_v(cl, ["DwellingTypeDescr"] + cats).where(F.col("col_a") == "DwellingTypeDescr") \
          .select(F.col("col_b").alias("category"), "cramers_v")
    j = eta.join(v, "category")
    verdict = F.when((F.col("eta") > 0.06) | (F.col("cramers_v") > 0.3), "KEEP").otherwise("DROP")
    return j.select("category", F.round("eta", 6).alias("eta_squared"), F.round("cramers_v", 6).alias("cramers_v"),
                    verdict.alias("verdict"))


QQ_PROBS = [(i + 0.5) / 99 for i in range(99)]


@register("A16", "qq_points", with_clean(
    "SELECT p, theoretical, round((q - m) / s, 6) AS sample FROM (SELECT avg(r) AS m, stddev_pop(r) AS s, "
    f"unnest([{', '.join(f'{p!r}e0' for p in QQ_PROBS)}]) AS p, unnest([{', '.join(f'{NormalDist().inv_cdf(p)!r}e0' for p in QQ_PROBS)}]) AS theoretical, "
    f"unnest(quantile_cont(r, [{', '.join(f'{p!r}' for p in QQ_PROBS)}])) AS q FROM (SELECT BerRating - ({FORMULA_SCORE}) AS r FROM clean))"))
def qq_points(spark, sf):
    from hearthlens.plans.q_clean import formula_score
    d = common.clean(spark, sf).withColumn("resid", F.col("BerRating") - formula_score(None))
    return ST.qq_points(d, "resid").withColumn("sample", F.round("sample", 6))
