"""Shared inputs for the registered queries (all lazily derived from the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthlens.operators import policy
from hearthlens.plans import dwelling
from hearthlens.sources.tables import dwellings, table


def proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwellings(spark, sf_dir)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwelling.clean_pipeline(dwellings(spark, sf_dir))


def profile(spark: SparkSession, sf_dir: str, sort: bool = False) -> DataFrame:
    return policy.county_profile(clean(spark, sf_dir), sort=sort)


__all__ = ["proxy", "clean", "profile", "table"]
