"""Streaming queries (R01, R02): arriving files through Structured Streaming."""

from __future__ import annotations

from hearthlens.plans import common, dwelling
from hearthlens.plans.oracle import with_clean, with_proxy
from hearthlens.plans.q_quality import PROXY_COLUMNS, per_column_sql
from hearthlens.plans.registry import register
from hearthlens.sources import files as FS
from hearthlens.streaming import stream as ST


@register("R01", "stream_clean", with_clean("SELECT * FROM clean"))
def stream_clean(spark, sf):
    """Statistics fitted once on the reference table (pass 1), then arriving
    files cleaned by a streaming query (pass 2): equals the batch clean."""
    d = common.proxy(spark, sf)
    stats = dwelling.fit_clean_stats(d)
    src = FS.sink_parquet(d, FS.scratch_path(spark, "arriving"))
    return ST.stream_clean(spark, src, d.schema, stats, FS.scratch_path(spark, "stream-clean"),
                           FS.scratch_path(spark, "ckpt"))


@register("R02", "stream_null_profile", with_proxy(per_column_sql(
    PROXY_COLUMNS, "count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows, "
    "count(*) FILTER (WHERE {c} IS NULL) / count(*) AS null_share")))
def stream_null_profile(spark, sf):
    d = common.proxy(spark, sf)
    src = FS.sink_parquet(d, FS.scratch_path(spark, "arriving"))
    return ST.stream_null_profile(spark, src, d.schema, FS.scratch_path(spark, "ckpt"), PROXY_COLUMNS)
