"""Projection, column selection and name-set operators.

Column-level operators are schema operations: they run no job; Catalyst
prunes the dropped columns all the way down to the Parquet scan.
"""

from __future__ import annotations

import re
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlens.operators.clean import NUMERIC_TYPES, require


# P01 -----------------------------------------------------------------------
def drop_columns(df: DataFrame, groups: Mapping[str, Sequence[str]], only: Sequence[str] | None = None) -> DataFrame:
    """Drop named column groups (leakage, administrative, outcome, ...)."""
    names = [c for g, cols in groups.items() if only is None or g in only for c in cols]
    return df.drop(*names)


# P02 -----------------------------------------------------------------------
def drop_if_present(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Drop what exists; return the absent names for the log."""
    absent = [c for c in cols if c not in df.columns]
    return df.drop(*[c for c in cols if c in df.columns]), absent


# P03 -----------------------------------------------------------------------
def keep_columns(df: DataFrame, cols: Sequence[str], strict: bool = True) -> DataFrame:
    if strict:
        require(df, cols)
    return df.select(*[c for c in cols if c in df.columns])


# P04 -----------------------------------------------------------------------
def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


# P05 / P06 (schema helpers) -------------------------------------------------
def select_by_name_pattern(df: DataFrame, words: Iterable[str], case: bool = False) -> list[str]:
    flags = 0 if case else re.IGNORECASE
    pats = [re.compile(re.escape(w), flags) for w in words]
    return [c for c in df.columns if any(p.search(c) for p in pats)]


def select_by_type(df: DataFrame, kind: str) -> list[str]:
    """kind: 'numeric' | 'string' | 'non_string'."""
    out = []
    for f in df.schema.fields:
        is_num = isinstance(f.dataType, NUMERIC_TYPES)
        is_str = isinstance(f.dataType, T.StringType)
        if (kind == "numeric" and is_num) or (kind == "string" and is_str) or (kind == "non_string" and not is_str):
            out.append(f.name)
    return out


# P09 -----------------------------------------------------------------------
def filter_threshold_fallback(df: DataFrame, cond: Column, min_rows: int) -> DataFrame:
    """Rows matching ``cond``; the whole table when fewer than ``min_rows``
    match (one count job decides, the result stays a lazy plan)."""
    n = df.where(cond).count()
    return df.where(cond) if n > min_rows else df


# U01 -----------------------------------------------------------------------
def union_rows(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


# U02 / U03 -----------------------------------------------------------------
def union_distinct_names(*name_tables: DataFrame) -> DataFrame:
    out = name_tables[0]
    for d in name_tables[1:]:
        out = out.union(d)
    return out.distinct()


def intersect_names(a: DataFrame, b: DataFrame, col: str = "feature") -> DataFrame:
    """(name, membership) with membership 'both' / 'only_a' / 'only_b'."""
    both = a.select(col).intersect(b.select(col)).withColumn("membership", F.lit("both"))
    only_a = a.select(col).exceptAll(b.select(col)).withColumn("membership", F.lit("only_a"))
    only_b = b.select(col).exceptAll(a.select(col)).withColumn("membership", F.lit("only_b"))
    return both.unionByName(only_a).unionByName(only_b)


# Q12 / J06 -------------------------------------------------------------------
def leakage_check(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """(column_name, present) for every forbidden feature column."""
    return df.sparkSession.createDataFrame([(c, c in df.columns) for c in forbidden], "column_name string, present boolean")


def require_no_leakage(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """``df`` itself; an error names forbidden columns that it still has."""
    found = [c for c in forbidden if c in df.columns]
    if found:
        raise ValueError(f"target-derived columns among the features: {found}")
    return df


def pad_features(df: DataFrame, expected: Mapping[str, float]) -> DataFrame:
    """Every expected feature, in order after the other columns; a missing one
    is filled with its default."""
    missing = {c: F.lit(float(v)) for c, v in expected.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df
