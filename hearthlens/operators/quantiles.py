"""Exact quantiles that scale (used by medians, quartiles, fences, describe).

Spark's exact ``percentile`` keeps a map of every distinct value of a group
and merges it in one task -- unbounded for a continuous column of a hot
group.  Here a quantile is bracketed first and counted then:

1. the narrow projection (groups, value) is written once to the checkpoint folder;
2. a mergeable KLL sketch per group, built map-side, gives a bracket around
   each asked-for rank: values at the rank less and plus a few times the
   sketch's rank error;
3. one aggregate counts the rows below the bracket and the rows of every value
   inside it (a percent or two of the rows);
4. the 0-based rank h = p (n - 1) falls among the counted values, and the
   result is interpolated linearly (the ``percentile`` / ``quantile_cont`` rule).

The counts prove the result: a rank outside its bracket (a sketch that missed)
is seen, and the values are then counted without brackets.  The values inside
are ordered by a window per group where they are counted to be few, by range
buckets (``relational.distributed_running``) where they are not.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlens.operators import relational as R
from hearthlens.session import cut_lineage


#: size of a sketch; its rank error is about 2.296 / SKETCH ** 0.9723 (99 % of the time)
SKETCH = 1000
#: half of a bracket, in ranks: three times that error
MARGIN = 3 * 2.296 / SKETCH**0.9723
#: groups of so few rows are counted whole
SMALL = 2000
#: groups whose brackets are broadcast, and values inside one bracket that a window orders
BROADCAST_GROUPS, WINDOW_VALUES = 50_000, 500_000


def _number(c: Column) -> Column:
    """NaN becomes null by projection, not by a filter: a filter on a computed
    value lets the optimizer infer not-null constraints and push the whole
    expression into upstream join conditions."""
    v = c.cast("double")
    return F.when(F.isnan(v), F.lit(None)).otherwise(v + F.lit(0.0))  # -0.0 is 0.0


def _bracket(sketch: Column, t: Column, p: float, finer: int = 1) -> Column:
    """(lo, hi) around rank p (t - 1); infinite at the ends and in small groups.
    The sketch takes constant ranks only: beyond SMALL rows p is off by under
    2 / SMALL.  ``finer``: how many times larger the sketch and SMALL are."""
    small = SMALL * finer
    low, high = p - MARGIN * finer**-0.9723 - 2 / small, p + MARGIN * finer**-0.9723 + 2 / small

    def at(rank: float, end: float) -> Column:
        if not 0 < rank < 1:
            return F.lit(end)
        return F.when(t > small, F.kll_sketch_get_quantile_double(sketch, F.lit(rank))).otherwise(F.lit(end))

    return F.struct(at(low, float("-inf")).alias("lo"), at(high, float("inf")).alias("hi"))


def _inside(v: Column, brackets: Sequence[tuple[Column, Column]], *more: Column) -> Column:
    """An element for each prob: its number and the value inside the bracket
    (null below it); a null element above it or without a value.  Plain
    conditions and no lambdas, so that the whole pass is generated code."""
    return F.array(*(F.when(v <= hi, F.struct(*more, F.lit(i).alias("__i"), F.when(v >= lo, v).alias("__v"))) for i, (lo, hi) in enumerate(brackets)))


def _interpolated(counts: DataFrame, g: Sequence[str], totals: DataFrame, probs: Sequence[float], wide: bool) -> DataFrame:
    """(g, __i, __q) from counts (g, __i, __v, __n) whose null value stands for
    all rows below; __q is null where a rank is not among them."""
    keys = [*g, "__i"]
    if wide:
        run = R.distributed_running(counts, [F.col(c) for c in [*keys, "__v"]], {"__cum": F.col("__n")})
        sums = counts.groupBy(*keys).agg(F.sum("__n").alias("__m"))
        starts = R.distributed_running(sums, [F.col(c) for c in keys], {"__upto": F.col("__m")}).withColumn("__s", F.col("__upto") - F.col("__m"))
        run = R.join_groups(run, starts, keys).withColumn("__cum", F.col("__cum") - F.col("__s"))
    else:
        run = counts.withColumn("__cum", F.sum("__n").over(Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    both = R.join_groups(run, totals, g) if g else run.crossJoin(F.broadcast(totals))  # one row without groups
    prob = F.element_at(F.array(*(F.lit(float(p)) for p in probs)), F.col("__i") + 1)
    h = prob * (F.col("__t") - 1)
    first, last = F.col("__cum") - F.col("__n"), F.col("__cum") - 1
    at = {name: F.max(F.when((first <= k) & (k <= last), F.col("__v"))).alias(name) for name, k in (("__a", F.floor(h)), ("__b", F.ceil(h)))}
    picked = both.groupBy(*keys).agg(F.max(h - F.floor(h)).alias("__f"), *at.values())
    a, b = F.col("__a"), F.col("__b")
    return picked.select(*keys, F.when(a == b, a).otherwise(a + (b - a) * F.col("__f")).alias("__q"))


def _by_counting(narrow: DataFrame, g: Sequence[str], totals: DataFrame, probs: Sequence[float]) -> DataFrame:
    """All values counted, without brackets."""
    counts = cut_lineage(narrow.where(F.col("__v").isNotNull()).groupBy(*g, "__v").agg(F.count("__v").alias("__n")))
    every = counts.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(len(probs) - 1))))
    return _interpolated(every, g, totals, probs, wide=True)


def _chosen(counts: DataFrame, narrow: DataFrame, g: Sequence[str], totals: DataFrame, probs: Sequence[float]) -> DataFrame:
    most = counts.groupBy(*g, "__i").agg(F.count("__v").alias("m")).agg(F.max("m")).first()[0] or 0
    out = _interpolated(counts, g, totals, probs, wide=most > WINDOW_VALUES)
    out = cut_lineage(out)
    whole = out.where("__q is not null").count() == totals.count() * len(probs)
    return out if whole else _by_counting(narrow, g, totals, probs)


def quantile_frame(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(groups, q: array of the quantiles in the order of ``probs``), a row per
    group with a value.  Nulls and NaN are ignored; a null group is a group."""
    g = [f"__g{i}" for i in range(len(groups))]
    narrow = cut_lineage(df.select(*[F.col(c).alias(a) for c, a in zip(groups, g)], _number(F.col(value)).alias("__v")))
    sketched = narrow.groupBy(*g).agg(F.count("__v").alias("__t"), F.kll_sketch_agg_double("__v", SKETCH).alias("__k")).where("__t > 0")
    brackets = cut_lineage(sketched.select(*g, "__t", F.array(*(_bracket(F.col("__k"), F.col("__t"), p) for p in probs)).alias("__br")))
    few = brackets.count() <= BROADCAST_GROUPS
    b = brackets.withColumnsRenamed({c: f"__r{c}" for c in g})
    on = [F.col(c).eqNullSafe(F.col(f"__r{c}")) for c in g] or F.lit(True)
    both = narrow.where(F.col("__v").isNotNull()).join(F.broadcast(b) if few else b, on, "inner")
    counts = cut_lineage(both.select(*g, F.explode(_inside(F.col("__v"), [(F.col("__br")[i]["lo"], F.col("__br")[i]["hi"]) for i in range(len(probs))])).alias("__x")).where("__x is not null").select(*g, "__x.*").groupBy(*g, "__i", "__v").agg(F.count("*").alias("__n")))
    totals = brackets.select(*g, "__t")
    found = _chosen(counts, narrow, g, totals, probs)
    wide = found.groupBy(*g).agg(*(F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(f"__q{i}") for i in range(len(probs))))
    return wide.select(*[F.col(a).alias(c) for c, a in zip(groups, g)], F.array(*(F.col(f"__q{i}") for i in range(len(probs)))).alias("q"))


def _below(v: Column, ends: Sequence[float], strict: bool) -> Column:
    """How many of the ascending ``ends`` are below v (``strict``) or at most
    v: a tree of comparisons, as deep as the logarithm of their number."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        e = F.lit(ends[mid])
        return F.when(v > e if strict else v >= e, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(ends))


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict:
    """Exact quantiles of many columns in two passes over their projection:
    sketches of all columns in one aggregate (a row), then one aggregate that
    counts the values inside the brackets and the rows between them.  The
    brackets are literals.  One row per column and prob is collected.

    Sketches grow with the number of probs, so that many brackets together
    still hold few of the rows."""
    cols = list(dict.fromkeys(cols))
    if not cols:
        return {}
    names = [f"__c{i}" for i in range(len(cols))]
    asked = sorted(set(probs))
    finer = max(1, len(asked) // 5)
    narrow = cut_lineage(df.select(*(_number(F.col(c)).alias(n) for c, n in zip(cols, names))))
    spark = df.sparkSession
    size = min(SKETCH * finer, 65535)
    sketched = narrow.agg(*(F.count(n).alias(f"t{n}") for n in names), *(F.kll_sketch_agg_double(n, size).alias(f"k{n}") for n in names)).first()
    some = [(i, n) for i, n in enumerate(names) if sketched[f"t{n}"]]
    if not some:
        return {c: [None] * len(probs) for c in cols}
    each = spark.createDataFrame([(i, int(sketched[f"t{n}"]), sketched[f"k{n}"]) for i, n in some], "__g0 int, __t long, k binary")
    found = {r[0]: r[1] for r in each.select("__g0", F.array(*(_bracket(F.col("k"), F.col("__t"), p, size // SKETCH) for p in asked))).collect()}

    def placed(i: int, n: str) -> Column:
        """The value's place: it is above ``a`` brackets and not below ``b``, so inside a .. b - 1."""
        v = F.col(n)
        los = [min(x["lo"] for x in found[i][j:]) for j in range(len(asked))]
        his = [max(x["hi"] for x in found[i][:j + 1]) for j in range(len(asked))]
        return F.struct(F.lit(i).alias("__g0"), v.alias("__v"), _below(v, his, True).alias("a"), _below(v, los, False).alias("b"))

    long = narrow.select(F.explode(F.array(*(placed(i, n) for i, n in some))).alias("x")).select("x.*").where("__v is not null")
    # rows in no bracket are counted by place alone
    cells = cut_lineage(long.groupBy("__g0", "a", "b", F.when(F.col("b") > F.col("a"), F.col("__v")).alias("__v")).agg(F.count("*").alias("__n")))
    inside = cells.where("b > a").select("__g0", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("__i"), "__v", "__n")
    under = cells.groupBy("__g0", "b").agg(F.sum("__n").alias("__n")).where(F.col("b") < len(asked))
    under = under.select("__g0", F.explode(F.sequence(F.col("b"), F.lit(len(asked) - 1))).alias("__i"), "__n").groupBy("__g0", "__i").agg(F.sum("__n").alias("__n"))
    counts = inside.unionByName(under.withColumn("__v", F.lit(None).cast("double")))
    totals = each.select("__g0", "__t")
    res = {(r["__g0"], r["__i"]): r["__q"] for r in _chosen(counts, long.select("__g0", "__v"), ["__g0"], totals, asked).collect()}
    return {c: [res.get((i, asked.index(p))) for p in probs] for i, c in enumerate(cols)}


def group_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """(groups, q columns) of exact per-group quantiles; one row per group,
    joinable to a group-level aggregate (``relational.join_groups``)."""
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    q = quantile_frame(df, groups, value, probs)
    return q.select(*groups, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
