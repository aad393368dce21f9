"""Statistical tests and factor methods.

Everything that touches rows is a distributed aggregate (moments, per-group
sums, contingency counts, Burt tables).  Only the resulting p x p (or J x J)
matrices -- bounded by the number of columns / categories, never by rows --
come to the driver, where numpy does the eigen-decomposition or inverse.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlens.operators import relational as R
from hearthlens.session import cut_lineage


# ---------------------------------------------------------------------------
# moments
# ---------------------------------------------------------------------------
def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = None
    for c in cols:
        x = F.col(c).isNotNull()
        cond = x if cond is None else cond & x
    return df.where(cond)


MAX_AGG_EXPRS = 400  # aggregate expressions per job (generated-code size)


def _moment_rows(df: DataFrame, cols: Sequence[str]):
    p = len(cols)
    xs = [F.col(c) for c in cols]
    r1 = df.agg(F.count(F.lit(1)).alias("N"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)],
                *[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)]).first()
    N = r1["N"]
    m = [r1[f"m{i}"] or 0.0 for i in range(p)]
    nullable = [r1[f"n{i}"] != N for i in range(p)]
    d = [xs[i] - F.lit(float(m[i])) for i in range(p)]
    exprs = [F.sum(d[i]).alias(f"s{i}") for i in range(p)] + [F.sum(d[i] * d[i]).alias(f"q{i}") for i in range(p)]
    for i in range(p):
        for j in range(i + 1, p):
            if nullable[i] or nullable[j]:
                both = xs[i].isNotNull() & xs[j].isNotNull()
                exprs += [F.count_if(both).alias(f"n{i}_{j}"),
                          F.sum(F.when(both, d[i])).alias(f"a{i}_{j}"), F.sum(F.when(both, d[j])).alias(f"b{i}_{j}"),
                          F.sum(F.when(both, d[i] * d[i])).alias(f"aa{i}_{j}"),
                          F.sum(F.when(both, d[j] * d[j])).alias(f"bb{i}_{j}")]
            exprs.append(F.sum(d[i] * d[j]).alias(f"x{i}_{j}"))
    r2 = {}
    for start in range(0, len(exprs), MAX_AGG_EXPRS):
        r2.update(df.agg(*exprs[start:start + MAX_AGG_EXPRS]).first().asDict())
    return r1, r2


def pairwise_moments(df: DataFrame, cols: Sequence[str]):
    """Pairwise-complete centred moments of every column pair, in two passes
    of plain sums (codegen-friendly; ``corr``/``covar`` buffers are far
    slower when there are hundreds of them).

    Pass 1: mean and non-null count per column.  Pass 2: sums of centred
    cross products; pairs where a column has nulls also get masked counts
    and masked first/second moments.  Returns (n, cov, corr) p x p arrays
    with population covariance over the rows where both columns are set."""
    cols = list(cols)
    p = len(cols)
    # several aggregate jobs read only these columns: persist the narrow
    # projection (spills to disk) so the upstream plan runs once
    df = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        r1, r2 = _moment_rows(df, cols)
    finally:
        df.unpersist()
    N = r1["N"]
    nullable = [r1[f"n{i}"] != N for i in range(p)]
    n = np.zeros((p, p))
    cov = np.zeros((p, p))
    corr = np.eye(p)
    for i in range(p):
        ni = r1[f"n{i}"]
        n[i, i] = ni
        cov[i, i] = ((r2[f"q{i}"] or 0.0) - (r2[f"s{i}"] or 0.0) ** 2 / ni) / ni if ni else float("nan")
    for i in range(p):
        for j in range(i + 1, p):
            if nullable[i] or nullable[j]:
                nij = r2[f"n{i}_{j}"]
                a, b = r2[f"a{i}_{j}"] or 0.0, r2[f"b{i}_{j}"] or 0.0
                va = ((r2[f"aa{i}_{j}"] or 0.0) - a * a / nij) / nij if nij else float("nan")
                vb = ((r2[f"bb{i}_{j}"] or 0.0) - b * b / nij) / nij if nij else float("nan")
            else:
                nij = N
                a, b = r2[f"s{i}"] or 0.0, r2[f"s{j}"] or 0.0
                va, vb = cov[i, i], cov[j, j]
            c = ((r2[f"x{i}_{j}"] or 0.0) - a * b / nij) / nij if nij else float("nan")
            n[i, j] = n[j, i] = nij
            cov[i, j] = cov[j, i] = c
            den = math.sqrt(va * vb) if va > 0 and vb > 0 else 0.0
            corr[i, j] = corr[j, i] = c / den if den > 0 else float("nan")
    return n, cov, corr


def covariance_matrix(df: DataFrame, cols: Sequence[str], complete: bool = True):
    """(n, means, population covariance) on complete rows (two passes of sums)."""
    cols = list(cols)
    d = complete_rows(df, cols) if complete else df
    r = d.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    means = np.array([r[f"m{i}"] or 0.0 for i in range(len(cols))])
    n, cov, _ = pairwise_moments(d, cols)
    return int(n[0, 0]) if len(cols) else 0, means, cov


def correlation_from_cov(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    sd[sd == 0] = 1.0
    return cov / np.outer(sd, sd)


def _long(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# A01 -----------------------------------------------------------------------
def ks_two_sample(df: DataFrame, value: str, group: str, groups: Sequence[str] | None = None) -> DataFrame:
    """Two-sample KS statistic for every pair of groups + asymptotic p-value.

    Counts per (value, group) (partial aggregation), pivoted to one count
    column per group (groups are few and listed first), running sums over
    the distinct values (range partitioned), then D = max |F_a - F_b|."""
    d = df.where(F.col(value).isNotNull())
    if groups is None:
        groups = sorted(r[0] for r in d.select(group).distinct().collect())
    groups = list(groups)
    wide = d.groupBy(value).pivot(group, groups).agg(F.count(F.lit(1))).na.fill(0)
    totals = d.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r[0]: r[1] for r in totals}
    run = R.distributed_running(wide, [F.col(value)], {f"cum_{i}": F.col(f"`{g}`") for i, g in enumerate(groups)})
    pairs = [(i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
    aggs = [F.max(F.abs(F.col(f"cum_{i}") / float(n[groups[i]]) - F.col(f"cum_{j}") / float(n[groups[j]]))).alias(f"d{i}_{j}")
            for i, j in pairs]
    row = run.agg(*aggs).first()
    out = []
    for i, j in pairs:
        D = float(row[f"d{i}_{j}"])
        n1, n2 = n[groups[i]], n[groups[j]]
        out.append((groups[i], groups[j], int(n1), int(n2), D, ks_pvalue(D, n1, n2)))
    return _long(df.sparkSession, out, "group_a string, group_b string, n_a long, n_b long, statistic double, p_value double")


def kolmogorov_q(lam: float, terms: int = 100) -> float:
    """Q_KS(lambda) = 2 sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lambda^2)."""
    if lam < 1e-3:
        return 1.0
    s = 0.0
    for k in range(1, terms + 1):
        s += (-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam)
    return max(0.0, min(1.0, 2.0 * s))


def ks_pvalue(D: float, n1: int, n2: int) -> float:
    en = math.sqrt(n1 * n2 / (n1 + n2))
    return kolmogorov_q((en + 0.12 + 0.11 / en) * D)


# A02 / A03 -----------------------------------------------------------------
def eta_squared(df: DataFrame, cats: Sequence[str], measures: Sequence[str], skip_singletons: bool = True) -> DataFrame:
    """eta^2 = SS_between / SS_total for every (category, measure) pair.

    One pass for the global moments; one pass for per-group counts and means
    of every (category column, value): rows emit one record per category
    column (narrow explode) and a single hash aggregate groups them.  With
    ``skip_singletons`` groups of size <= 1 are left out of SS_between."""
    spark = df.sparkSession
    glob_exprs = []
    for m in measures:
        x = F.col(m).cast("double")
        glob_exprs += [F.avg(x).alias(f"mean__{m}"), (F.var_pop(x) * F.count(x)).alias(f"sst__{m}")]
    g = df.agg(*glob_exprs).first()
    recs = F.array(*[F.struct(F.lit(c).alias("category"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("v"))
                     for c in cats])
    aggs = []
    for m in measures:
        x = F.col(m).cast("double")
        aggs += [F.count(x).alias(f"n__{m}"), F.avg(x).alias(f"a__{m}")]
    per = df.select(F.explode(recs).alias("r"), *measures).groupBy("r.category", "r.v").agg(*aggs)
    ss = []
    for m in measures:
        keep = F.col(f"n__{m}") > (1 if skip_singletons else 0)
        ss.append(F.sum(F.when(keep, F.col(f"n__{m}") * (F.col(f"a__{m}") - F.lit(g[f"mean__{m}"])) ** 2)
                        .otherwise(0.0)).alias(m))
    rows = {r["category"]: r for r in per.groupBy("category").agg(*ss).collect()}  # one row per category column
    out = []
    for c in cats:
        for m in measures:
            sst = g[f"sst__{m}"]
            out.append((c, m, float(rows[c][m] / sst) if sst and sst > 0 else 0.0))
    return _long(spark, out, "category string, measure string, eta_squared double")


def anova_f(df: DataFrame, cat: str, measure: str) -> DataFrame:
    """One-way ANOVA F statistic (and p-value) of a measure across groups."""
    x = F.col(measure).cast("double")
    per = df.where(x.isNotNull()).groupBy(cat).agg(F.count(x).alias("n"), F.avg(x).alias("m"),
                                                    (F.var_pop(x) * F.count(x)).alias("ssw"))
    g = df.where(x.isNotNull()).agg(F.avg(x).alias("gm"), F.count(x).alias("N")).first()
    s = per.agg(F.sum(F.col("n") * (F.col("m") - F.lit(g["gm"])) ** 2).alias("ssb"), F.sum("ssw").alias("ssw"),
                F.count(F.lit(1)).alias("k")).first()
    k, N = int(s["k"]), int(g["N"])
    df1, df2 = k - 1, N - k
    f = (s["ssb"] / df1) / (s["ssw"] / df2) if df1 > 0 and df2 > 0 and s["ssw"] > 0 else float("nan")
    p = f_sf(f, df1, df2) if not math.isnan(f) else float("nan")
    return _long(df.sparkSession, [(cat, measure, k, N, float(s["ssb"]), float(s["ssw"]), float(f), float(p))],
                 "category string, measure string, groups long, n long, ss_between double, ss_within double, f double, p_value double")


def _betacf(a, b, x, itmax=300, eps=3e-14):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, itmax + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc_reg(a, b, x):
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbeta) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbeta) * _betacf(b, a, 1 - x) / b


def f_sf(f, d1, d2):
    """Survival function of the F distribution via the regularised incomplete beta."""
    if f <= 0:
        return 1.0
    return betainc_reg(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


# A04 -----------------------------------------------------------------------
def cramers_v(df: DataFrame, cats: Sequence[str], yates: bool = True) -> DataFrame:
    """Bias-corrected Cramer's V for every pair of category columns
    (nulls as the value 'nan').  Cells come from one count per pair, and only
    observed cells are needed: chi2 = n (sum o^2 / (r_i c_j) - 1).  A 2 x 2
    table has the same |o - e| in all four cells, which gives Yates' form."""
    cats = list(cats)
    pairs = [(a, b) for i, a in enumerate(cats) for b in cats[i + 1:]]
    cells = pair_cells(df, pairs).withColumnRenamed("n", "o").withColumn(
        "pair", F.concat_ws("|", "col_a", "col_b")).drop("col_a", "col_b")
    rows_m = cells.groupBy("pair", "va").agg(F.sum("o").cast("double").alias("ri"))
    cols_m = cells.groupBy("pair", "vb").agg(F.sum("o").cast("double").alias("cj"))
    dims = rows_m.groupBy("pair").agg(F.count(F.lit(1)).alias("r"), F.sum("ri").alias("n"), F.sum(1.0 / F.col("ri")).alias("ir")).join(
        cols_m.groupBy("pair").agg(F.count(F.lit(1)).alias("k"), F.sum(1.0 / F.col("cj")).alias("ic")), "pair")
    seen = cells.join(rows_m, ["pair", "va"]).join(cols_m, ["pair", "vb"]).join(dims, "pair")
    o, rc_ = F.col("o").cast("double"), F.col("ri") * F.col("cj")
    chi = seen.groupBy("pair", F.col("n").cast("long").alias("n"), "r", "k", "ir", "ic").agg(
        F.sum(o * o / rc_).alias("s"), F.max(F.abs(o - rc_ / F.col("n"))).alias("d"))
    off = F.greatest(F.col("d") - 0.5, F.lit(0.0))
    two = F.lit(yates) & ((F.col("r") - 1) * (F.col("k") - 1) == 1)
    chi = chi.withColumn("chi2", F.when(two, off * off * F.col("n") * F.col("ir") * F.col("ic")).otherwise(F.greatest(F.col("n") * (F.col("s") - 1), F.lit(0.0))))
    n, r, k = F.col("n").cast("double"), F.col("r").cast("double"), F.col("k").cast("double")
    phi2 = F.col("chi2") / n
    phi2c = F.greatest(F.lit(0.0), phi2 - (k - 1) * (r - 1) / (n - 1))
    rc = r - (r - 1) * (r - 1) / (n - 1)
    kc = k - (k - 1) * (k - 1) / (n - 1)
    den = F.least(rc - 1, kc - 1)
    v = F.when(den > 0, F.sqrt(phi2c / den)).otherwise(0.0)
    out = chi.select(F.split("pair", r"\|")[0].alias("col_a"), F.split("pair", r"\|")[1].alias("col_b"),
                     "n", "r", "k", "chi2", v.alias("cramers_v"))
    return out


# A05 -----------------------------------------------------------------------
def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """VIF_j = (R^-1)_jj on complete rows (equal to 1 / (1 - R_j^2) of the
    regression with constant); infinite for a column that is a linear
    combination of the others.  R is one distributed pass; the eigenvalues
    are p x p on the driver."""
    _, _, cov = covariance_matrix(df, cols)
    R_ = correlation_from_cov(cov)
    w, v = np.linalg.eigh(R_)
    null = w <= 1e-10 * len(cols)
    dependent = (np.abs(v[:, null]) > 1e-6).any(axis=1)
    inv = (v[:, ~null] / w[~null]) @ v[:, ~null].T
    rows = [(c, float("inf") if dependent[i] else float(max(inv[i, i], 1.0))) for i, c in enumerate(cols)]
    return _long(df.sparkSession, rows, "feature string, vif double")


# A08 / A09 / A10 / A14 -------------------------------------------------------
def pca(df: DataFrame, cols: Sequence[str], k: int | None = None):
    """PCA of standardised columns (complete rows): eigen-decomposition of
    the correlation matrix.  Returns (explained, loadings, fitted) where
    ``fitted`` carries means / stds / components for scoring."""
    cols = list(cols)
    n, means, cov = covariance_matrix(df, cols)
    sd = np.sqrt(np.diag(cov))
    sd[sd == 0] = 1.0
    Rm = cov / np.outer(sd, sd)
    w, v = np.linalg.eigh(Rm)
    order = np.argsort(w)[::-1]
    w, v = w[order], v[:, order]
    for j in range(v.shape[1]):  # sign: largest |loading| positive
        i = int(np.argmax(np.abs(v[:, j])))
        if v[i, j] < 0:
            v[:, j] = -v[:, j]
    k = k or len(cols)
    share = w / w.sum()
    cum = np.cumsum(share)
    spark = df.sparkSession
    expl = _long(spark, [(j + 1, float(w[j]), float(share[j]), float(cum[j])) for j in range(k)],
                 "component int, eigenvalue double, share double, cum_share double")
    load = _long(spark, [(j + 1, c, float(v[i, j])) for j in range(k) for i, c in enumerate(cols)],
                 "component int, feature string, loading double")
    return expl, load, {"means": means, "sds": sd, "components": v[:, :k], "cols": cols, "eigen": w}


def pca_scores(df: DataFrame, fitted: dict, k: int, prefix: str = "pc") -> DataFrame:
    """Project rows onto the first k components as column expressions."""
    cols, m, s, V = fitted["cols"], fitted["means"], fitted["sds"], fitted["components"]
    z = [(F.col(c).cast("double") - float(m[i])) / float(s[i]) for i, c in enumerate(cols)]
    out = {}
    for j in range(k):
        e = None
        for i in range(len(cols)):
            t = z[i] * float(V[i, j])
            e = t if e is None else e + t
        out[f"{prefix}{j + 1}"] = e
    return df.withColumns(out)


def components_needed(explained: DataFrame, thresholds=(0.8, 0.9, 0.95)) -> DataFrame:
    return explained.agg(*[F.min(F.when(F.col("cum_share") >= t - 1e-12, F.col("component"))).alias(f"k{int(t * 100)}")
                           for t in thresholds])


def loading_rank(loadings: DataFrame, n_components: int) -> DataFrame:
    s = loadings.where(F.col("component") <= n_components).groupBy("feature").agg(F.sum(F.abs("loading")).alias("abs_loading_sum"))
    return s.withColumn("rank", F.rank().over(Window.orderBy(F.desc("abs_loading_sum"))))


def _leading(product, size: int, k: int) -> np.ndarray:
    """The k largest eigenvalues of a symmetric matrix given by its product
    with a vector (Lanczos steps, each made orthogonal to all before)."""
    rng = np.random.default_rng(0)
    q = [np.zeros(size), rng.standard_normal(size)]
    q[1] /= np.linalg.norm(q[1])
    alpha, beta, last = [], [0.0], None
    for step in range(1, size + 1):
        z = product(q[-1])
        alpha.append(float(q[-1] @ z))
        basis = np.array(q[1:])
        for _ in range(2):
            z = z - basis.T @ (basis @ z)
        beta.append(float(np.linalg.norm(z)))
        done = beta[-1] < 1e-12 or step == size
        if done or step % 10 == 0:
            t = np.diag(alpha) + np.diag(beta[1:step], 1) + np.diag(beta[1:step], -1)
            top = np.sort(np.linalg.eigvalsh(t))[::-1][:k]
            if done or (last is not None and len(top) == len(last) == k and np.max(np.abs(top - last)) < 1e-11 * max(1.0, abs(top[0]))):
                return top
            last = top
        q.append(z / beta[-1])
    return top


def variance_gain(df: DataFrame, cols: Sequence[str], cat: str, k: int = 5, dense: int = 500) -> DataFrame:
    """Share of variance in the first k PCs without / with the one-hot
    (first level dropped) encoding of ``cat``.

    No indicator column is made: the indicators' correlations follow from the
    level counts, those with numeric columns from grouped sums.  A count and
    p sums per level reach the driver; the indicators' block is a diagonal
    less a rank-one matrix, so beyond ``dense`` columns the leading eigenvalues
    come from products with vectors and no L x L matrix exists."""
    cols = list(cols)
    d = complete_rows(df, cols).where(F.col(cat).isNotNull())
    n, means, cov = covariance_matrix(d, cols, complete=False)
    sd = np.sqrt(np.diag(cov))
    sd[sd == 0] = 1.0
    R = cov / np.outer(sd, sd)
    z = [F.sum((F.col(c).cast("double") - float(means[i])) / float(sd[i])).alias(f"z{i}") for i, c in enumerate(cols)]
    got = sorted(d.groupBy(F.col(cat).alias("level")).agg(F.count(F.lit(1)).alias("n"), *z).collect(), key=lambda r: r["level"])[1:]
    p = np.array([r["n"] for r in got]) / n
    u = np.sqrt(p / (1 - p))
    C = np.array([[r[f"z{i}"] for r in got] for i in range(len(cols))]).reshape(len(cols), len(got)) / n / np.sqrt(p * (1 - p))[None, :]
    size = len(cols) + len(got)
    if size <= dense:
        whole = np.block([[R, C], [C.T, np.diag(1 / (1 - p)) - np.outer(u, u)]])
        top = np.sort(np.linalg.eigvalsh(whole))[::-1][:k]
    else:
        def product(x):
            a, b = x[: len(cols)], x[len(cols):]
            return np.concatenate([R @ a + C @ b, C.T @ a + b / (1 - p) - u * (u @ b)])

        top = _leading(product, size, k)
    alone = np.sort(np.linalg.eigvalsh(R))[::-1]
    without = float(alone[:k].sum() / alone.sum())
    with_ = float(top.sum() / (alone.sum() + len(got)))
    return _long(df.sparkSession, [(cat, k, without, with_, with_ - without)],
                 "category string, k int, share_without double, share_with double, gain double")


# A11 -----------------------------------------------------------------------
def lda(df: DataFrame, cols: Sequence[str], label: str):
    """Fisher discriminant axes from the centred moments of the classes (one
    pass); the generalised eigenproblem is p x p, on the driver."""
    from hearthlens.operators import moments as mo

    cols = list(cols)
    by_class = mo.grouped_moments(complete_rows(df, cols + [label]), cols, [label])
    lam, axes = mo.discriminants(by_class.values())
    share = lam / lam.sum() if lam.sum() > 0 else lam
    m = len(lam)
    spark = df.sparkSession
    expl = _long(spark, [(j + 1, float(lam[j]), float(share[j])) for j in range(m)],
                 "axis int, eigenvalue double, share double")
    coef = _long(spark, [(j + 1, c, float(axes[i, j])) for j in range(m) for i, c in enumerate(cols)],
                 "axis int, feature string, coefficient double")
    return expl, coef


# A12 -----------------------------------------------------------------------
def pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Contingency counts of many column pairs in ONE pass: every row emits
    one (col_a, va, col_b, vb) record per pair (a narrow explode), then one
    hash aggregate counts them (map-side partials keep the shuffle to the
    number of distinct cells).  Nulls are the value 'nan'."""
    v = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    recs = F.array(*[F.struct(F.lit(a).alias("col_a"), v(a).alias("va"), F.lit(b).alias("col_b"), v(b).alias("vb"))
                     for a, b in pairs])
    return (df.select(F.explode(recs).alias("r")).select("r.*")
              .groupBy("col_a", "va", "col_b", "vb").agg(F.count(F.lit(1)).alias("n")))


def burt_table(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Counts for every pair of (column, value), a column with itself
    included: J x J cells, one pass (``pair_cells``)."""
    return pair_cells(df, [(a, b) for i, a in enumerate(cats) for b in cats[i:]])


def _bounded_cells(df: DataFrame, cats: Sequence[str], most: int) -> list:
    """Cells of the Burt table, after the categories were counted: more than
    ``most`` of them are refused, since a matrix of their square is solved on
    the driver."""
    cells = cut_lineage(burt_table(df, cats))
    j = cells.where((F.col("col_a") == F.col("col_b")) & (F.col("va") == F.col("vb"))).count()
    if j > most:
        raise ValueError(f"{j} categories in {list(cats)}; at most {most} are analysed together: group rare values first")
    return cells.collect()


def mca(df: DataFrame, cats: Sequence[str], dims: int = 20, most: int = 4000):
    """Multiple correspondence analysis from the Burt table: principal
    inertias and category coordinates.  Returns (inertia, coordinates)."""
    cats = list(cats)
    cells = _bounded_cells(df, cats, most)
    labels = sorted({(r["col_a"], r["va"]) for r in cells} | {(r["col_b"], r["vb"]) for r in cells})
    idx = {l: i for i, l in enumerate(labels)}
    J, Q = len(labels), len(cats)
    B = np.zeros((J, J))
    for r in cells:
        i, j = idx[(r["col_a"], r["va"])], idx[(r["col_b"], r["vb"])]
        B[i, j] = B[j, i] = r["n"]
    n = B[[idx[l] for l in labels if l[0] == cats[0]]].sum() if cats else 0
    n = float(sum(B[idx[l], idx[l]] for l in labels if l[0] == cats[0]))
    c = np.diag(B) / (n * Q)
    S = B / (n * Q * Q) - np.outer(c, c)
    Dm = np.diag(1.0 / np.sqrt(c))
    lam, U = np.linalg.eigh(Dm @ S @ Dm)
    order = np.argsort(lam)[::-1]
    lam, U = np.clip(lam[order], 0, None), U[:, order]
    total = (J - Q) / Q
    k = min(dims, J - Q)
    coords = Dm @ U[:, :k] * np.sqrt(lam[:k])
    for j in range(k):
        i = int(np.argmax(np.abs(coords[:, j])))
        if coords[i, j] < 0:
            coords[:, j] = -coords[:, j]
    spark = df.sparkSession
    inertia = _long(spark, [(j + 1, float(lam[j]), float(lam[j] / total), float(lam[:j + 1].sum() / total)) for j in range(k)],
                    "dim int, eigenvalue double, share double, cum_share double")
    co = _long(spark, [(labels[i][0], labels[i][1], j + 1, float(coords[i, j])) for i in range(J) for j in range(k)],
               "column_name string, value string, dim int, coordinate double")
    return inertia, co


# A13 -----------------------------------------------------------------------
def famd(df: DataFrame, nums: Sequence[str], cats: Sequence[str], dims: int = 30, most: int = 4000) -> DataFrame:
    """Factor analysis of mixed data: eigenvalues of the covariance of
    [z-scored numerics, centred indicators / sqrt(share)], assembled from
    moments, per-category numeric sums and the Burt table."""
    nums, cats = list(nums), list(cats)
    d = complete_rows(df, nums)
    cells = _bounded_cells(d, cats, most)
    n, means, cov = covariance_matrix(d, nums, complete=False)
    sd = np.sqrt(np.diag(cov))
    sd[sd == 0] = 1.0
    Rm = cov / np.outer(sd, sd)
    vals = {c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cats}
    levels, zsum = [], []
    for c in cats:
        g = d.groupBy(vals[c].alias("v")).agg(F.count(F.lit(1)).alias("n"),
                                              *[F.sum((F.col(x).cast("double") - float(means[i])) / float(sd[i])).alias(f"z{i}")
                                                for i, x in enumerate(nums)]).collect()
        for r in sorted(g, key=lambda r: r["v"]):
            levels.append((c, r["v"], r["n"]))
            zsum.append([r[f"z{i}"] for i in range(len(nums))])
    li = {(c, v): i for i, (c, v, _) in enumerate(levels)}
    L = len(levels)
    P2 = np.zeros((L, L))
    for r in cells:
        i, j = li[(r["col_a"], r["va"])], li[(r["col_b"], r["vb"])]
        P2[i, j] = P2[j, i] = r["n"] / n
    pj = np.array([lv[2] / n for lv in levels])
    NI = np.array(zsum).T / n / np.sqrt(pj)[None, :]  # E[z * (I - p)] / sqrt(p)
    II = (P2 - np.outer(pj, pj)) / np.sqrt(np.outer(pj, pj))
    G = np.block([[Rm, NI], [NI.T, II]])
    lam = np.clip(np.sort(np.linalg.eigvalsh(G))[::-1], 0, None)
    k = min(dims, len(lam))
    share = lam / lam.sum()
    cum = np.cumsum(share)
    return _long(df.sparkSession, [(j + 1, float(lam[j]), float(share[j]), float(cum[j])) for j in range(k)],
                 "dim int, eigenvalue double, share double, cum_share double")


# A16 -----------------------------------------------------------------------
def qq_points(df: DataFrame, value: str, points: int = 99) -> DataFrame:
    """Sample quantiles (exact, by counting) against standard normal
    quantiles of the same probabilities, for standardised values."""
    from statistics import NormalDist

    from hearthlens.operators.quantiles import column_quantiles

    probs = [(i + 0.5) / points for i in range(points)]
    df = cut_lineage(df.select(value))
    row = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).first()
    quantiles = column_quantiles(df, [value], probs)[value]
    nd = NormalDist()
    rows = [(p, nd.inv_cdf(p), float((q - row["m"]) / row["s"])) for p, q in zip(probs, quantiles)]
    return _long(df.sparkSession, rows, "p double, theoretical double, sample double")
