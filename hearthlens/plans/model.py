"""Model inputs and training wiring for the certificate table.

County and policy labels are never features; categorical columns are
ordinal-encoded inside the pipeline (fitted on training rows only); the
split is a key hash, so it is identical in every run and under any
partitioning.  The model frame is checkpointed (reliable checkpoint in the
cluster's checkpoint folder, as compressed blocks) before any learner iterates
over it; columns that follow from others are computed when it is read.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlens.functions import features as fx
from hearthlens.operators import clean as C
from hearthlens.operators import ml
from hearthlens.operators import select as S
from hearthlens.plans import common
from hearthlens.session import cut_compressed
from hearthlens.sources.tables import DWELLING_KEY

CAT_FEATURES = ["DwellingTypeDescr", "AgeBand", "StructureType", "MainSpaceHeatingFuel",
                "SolarHotWaterHeating", "HESSchemeUpgrade", "StorageLosses"]
NUM_FEATURES = ["UValueWall", "UValueRoof", "UValueFloor", "UValueWindow", "UvalueDoor", "WallArea", "RoofArea",
                "FloorArea", "WindowArea", "DoorArea", "GroundFloorAreasq_m", "HSMainSystemEfficiency",
                "HSSupplHeatFraction", "NoOfSidesSheltered", "Year_of_Construction", "DeclaredLossFactor",
                "IsHeatPump", "HasSolarWaterHeating", "HasRoofInsulation", "HasWallInsulation", "HasDoubleGlazing",
                "WindowToWallRatio", "FabricHeatLossProxy", "FabricHeatLossPerM2"]
FORBIDDEN = ["BerRating", "EnergyRating", "is_retrofitted", "EstCO2_kg_per_m2", "CountyName", "label", "clf_label"]  # never features
MAX_BINS = 64  # >= the largest category count of the encoded columns


def model_frame(spark: SparkSession, sf: str, checkpoint: bool = True) -> DataFrame:
    """Clean table + label (log1p rating) + split + fold, checkpointed."""
    clean = common.clean(spark, sf)  # its fills are fitted by jobs: once a frame
    S.require_no_leakage(clean.select(*CAT_FEATURES, *NUM_FEATURES), FORBIDDEN)
    cl = C.coerce_numeric(clean, ["DeclaredLossFactor"])
    d = cl.select(*DWELLING_KEY, "CountyName", "BerRating", "is_retrofitted", *CAT_FEATURES,
                  *[F.col(c).cast("double").alias(c) for c in NUM_FEATURES])
    if checkpoint:
        d = cut_compressed(d)
    return d.withColumns({"label": fx.log1p_target("BerRating"), "split": ml.split_label(DWELLING_KEY),
                          "fold": ml.fold_column(DWELLING_KEY, 5),
                          "is_val": ml.split_label(DWELLING_KEY) == "validation",
                          "clf_label": F.col("is_retrofitted").cast("double")})


def regression_pipeline(learner, scale: bool = False, cat=CAT_FEATURES, num=NUM_FEATURES) -> Pipeline:
    return Pipeline(stages=ml.feature_pipeline(cat, num, scale=scale) + [learner])


def fit_gbt(train: DataFrame, max_iter: int = 30, max_depth: int = 5, use_validation: bool = True) -> PipelineModel:
    learner = ml.gbt_regressor("label", max_iter=max_iter, max_depth=max_depth, max_bins=MAX_BINS,
                               validation_col="is_val" if use_validation else None)
    return regression_pipeline(learner).fit(train)


def prepared(frame: DataFrame, cat=CAT_FEATURES, num=NUM_FEATURES) -> tuple[PipelineModel, DataFrame]:
    """Encoders fitted on training rows, and the frame with its feature vector,
    role (the split) and row hash: what every learner of a query shares."""
    enc = Pipeline(stages=ml.feature_pipeline(cat, num)).fit(frame.where(F.col("split") == "train"))
    return enc, enc.transform(frame).withColumns({"role": F.col("split"), "row_hash": F.xxhash64(*DWELLING_KEY)})


def predict_original(model: PipelineModel, df: DataFrame, out: str = "pred_ber") -> DataFrame:
    """Score and back-transform: expm1, clipped at 0.  Numeric features that a
    table lacks are padded with 0."""
    return back_transformed(model.transform(S.pad_features(df, dict.fromkeys(NUM_FEATURES, 0.0))), out)


def back_transformed(scored: DataFrame, out: str = "pred_ber") -> DataFrame:
    return scored.withColumn(out, fx.expm1_clipped("prediction"))


def split_metrics(scored: DataFrame, label: str = "BerRating", prediction: str = "pred_ber") -> DataFrame:
    return ml.regression_metrics(scored, label, prediction, group=["split"])
