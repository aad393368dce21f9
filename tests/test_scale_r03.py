"""Round 3: scenario overrides and attributions without per-row lookups, compressed delimited files, one clean table a model frame."""

import glob

from pyspark.sql import functions as F

from hearthlens.operators import attribution as AT
from hearthlens.operators import scenario as SC
from hearthlens.plans import model as MD
from hearthlens.sources import files as FS

MEASURES = {"a": {"name": "a", "label": "A", "overrides": {"u": 0.5, "fuel": "gas", "flag": 1, "gone": 3}, "recompute_derived": False},
            "b": {"name": "b", "label": "B", "overrides": {"u": "no number"}, "recompute_derived": False}}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_overrides_are_literals_and_equal_the_lookups(spark):
    df = spark.createDataFrame([(1, 2.0, "oil", 0), (2, None, None, None), (2, None, None, None)], "i long, u double, fuel string, flag tinyint")
    x = SC.expand(df, MEASURES)
    got, want = SC.apply_scenarios(df, MEASURES), SC.apply_overrides(x)
    out = [d.select("i", F.col("scenario.key").alias("k"), "u", "fuel", "flag") for d in (got, want)]
    assert sorted(map(str, out[0].collect())) == sorted(map(str, out[1].collect()))
    assert out[0].count() == 6 and out[0].schema == out[1].schema
    assert "element_at" not in _plan(out[0]) and "element_at" in _plan(out[1])


def test_deltas_without_lambdas(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [2.0, 1.0, 3.0]), (2, [0.0] * 3, [0.0] * 3), (3, None, [1.0] * 3)], "i long, b array<double>, a array<double>")
    out = AT.delta_long(df, ["i"], "b", "a", ["y", "x", "z"], top=2)
    assert "lambda" not in _plan(out)
    rows = [tuple(r) for r in out.orderBy("i", "rank").collect()]
    assert rows == [(1, "x", 2.0, 1.0, -1.0, 50.0, 1), (1, "y", 1.0, 2.0, 1.0, 50.0, 2), (2, "x", 0.0, 0.0, 0.0, 0.0, 1), (2, "y", 0.0, 0.0, 0.0, 0.0, 2)]
    name, delta = AT.top_driver("b", "a", ["y", "x", "z"])
    top = df.where("i < 3").select(name.alias("f"), delta.alias("d"))
    assert "lambda" not in _plan(top) and [tuple(r) for r in top.collect()] == [("x", -1.0), ("x", 0.0)]


def test_delimited_files_are_compressed(spark, tmp_path):
    df = spark.range(3000).select("id", F.lit("some  text ").alias("t"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("v"))
    path = FS.sink_delimited(df, str(tmp_path / "t"))
    assert glob.glob(f"{path}/*.gz")
    back = FS.convert_delimited(spark, path, str(tmp_path / "p"), df.schema)
    assert back.exceptAll(df).count() == 0 and back.count() == 3000


def test_model_frame_fits_the_clean_table_once(spark, monkeypatch):
    seen, clean = [], MD.common.clean
    monkeypatch.setattr(MD.common, "clean", lambda *a: seen.append(a) or clean(*a))
    MD.model_frame(spark, "/root/testdata/sf0.001", checkpoint=False)
    assert len(seen) == 1
