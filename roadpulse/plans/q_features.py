"""Registered queries: feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import features as FE
from ..operators.analytics import r6
from . import base
from .catalog import register
from .oracle import in_list, with_base


def _cols(*cols):
    return ", ".join(cols)


@register("feat_duration", with_base("SELECT id, round(duration_minutes, 6) AS duration_minutes FROM feat"))
def feat_duration(spark, sf):
    d = FE.feat_duration(base.incidents(spark, sf))
    return d.select("id", r6(F.col("duration_minutes")).alias("duration_minutes"))


@register("feat_severity", with_base("SELECT id, severity_class FROM feat"))
def feat_severity(spark, sf):
    return FE.feat_severity(base.incidents(spark, sf)).select("id", "severity_class")


@register("feat_temporal", with_base(
    "SELECT id, hour_of_day, day_of_week, month, is_peak_hour, is_weekend FROM feat"))
def feat_temporal(spark, sf):
    return FE.feat_temporal(base.incidents(spark, sf)).select(
        "id", "hour_of_day", "day_of_week", "month", "is_peak_hour", "is_weekend")


@register("feat_junction_repeat", with_base("SELECT id, junction, junction_repeat_count FROM feat"))
def feat_junction_repeat(spark, sf):
    return FE.feat_junction_repeat(base.incidents(spark, sf)).select("id", "junction", "junction_repeat_count")


@register("feat_corridor_7d", with_base("SELECT id, corridor, corridor_7d_score FROM feat"))
def feat_corridor_7d(spark, sf):
    return FE.feat_corridor_7d(base.incidents(spark, sf)).select("id", "corridor", "corridor_7d_score")


@register("feat_cause_weight", with_base("SELECT id, cause_severity_weight FROM feat"))
def feat_cause_weight(spark, sf):
    return FE.feat_cause_weight(base.incidents(spark, sf)).select("id", "cause_severity_weight")


@register("feat_closure_binary", with_base("SELECT id, road_closure_binary FROM feat"))
def feat_closure_binary(spark, sf):
    return FE.feat_closure_binary(base.incidents(spark, sf)).select("id", "road_closure_binary")


@register("feat_veh_encoded", with_base("SELECT id, veh_type, veh_type_encoded FROM feat"))
def feat_veh_encoded(spark, sf):
    return FE.feat_veh_encoded(base.incidents(spark, sf)).select("id", "veh_type", "veh_type_encoded")


@register("text_semantic_type", with_base("SELECT id, event_semantic_type FROM feat"))
def text_semantic_type(spark, sf):
    return FE.text_semantic_type(base.incidents(spark, sf)).select("id", "event_semantic_type")


@register("text_semantic_encode", with_base(
    "SELECT event_semantic_type, event_semantic_encoded, CAST(count(*) AS BIGINT) AS n, "
    "round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct FROM feat GROUP BY ALL"))
def text_semantic_encode(spark, sf):
    d = FE.text_semantic_encode(FE.text_semantic_type(base.incidents(spark, sf)))
    g = d.groupBy("event_semantic_type", "event_semantic_encoded").agg(F.count(F.lit(1)).alias("n"))
    tot = d.agg(F.count(F.lit(1)).alias("__t"))
    return g.crossJoin(F.broadcast(tot)).select(
        "event_semantic_type", "event_semantic_encoded", "n", r6(100.0 * F.col("n") / F.col("__t")).alias("share_pct"))


_FEAT_CORE_COLS = ["id", "event_type", "status", "latitude", "longitude", "corridor", "junction", "zone",
                   "event_cause", "priority", "requires_road_closure", "veh_type", "start_datetime",
                   "cause_severity_weight", "road_closure_binary", "veh_type_encoded", "event_semantic_type",
                   "event_semantic_encoded", "hour_of_day", "day_of_week", "month", "is_peak_hour", "is_weekend",
                   "junction_repeat_count", "corridor_7d_score", "severity_class", "duration_minutes"]


@register("project_model_ready", with_base(
    "SELECT " + ", ".join(c if c != "duration_minutes" else "round(duration_minutes, 6) AS duration_minutes"
                          for c in _FEAT_CORE_COLS) + " FROM feat"))
def project_model_ready(spark, sf):
    d = FE.project_model_ready(base.features(spark, sf))
    return d.withColumn("duration_minutes", r6(F.col("duration_minutes")))


@register("peak_hours_derive", with_base(
    "SELECT hour_of_day, n FROM (SELECT CAST(hour(start_datetime) AS INTEGER) AS hour_of_day, "
    "CAST(count(*) AS BIGINT) AS n, avg(count(*)) OVER () AS m FROM clean GROUP BY 1) t WHERE n > m",
    upto="clean"))
def peak_hours_derive(spark, sf):
    return FE.peak_hours_derive(base.incidents(spark, sf))


@register("peak_hour_flag", with_base(
    "SELECT id, CAST(CAST(hour(start_datetime) AS INTEGER) IN (SELECT h FROM ph) AS INTEGER) AS is_peak_hour FROM clean",
    upto="clean", extra=["ph AS (SELECT h FROM (SELECT CAST(hour(start_datetime) AS INTEGER) AS h, count(*) AS n, "
                         "avg(count(*)) OVER () AS m FROM clean GROUP BY 1) t WHERE n > m)"]))
def peak_hour_flag(spark, sf):
    """Peak flag against the data-derived set (<= 24 rows, broadcast semi join)."""
    inc = base.incidents(spark, sf)
    hours = FE.peak_hours_derive(inc).select(F.col("hour_of_day").alias("__h"), F.lit(1).alias("__pk"))
    j = inc.join(F.broadcast(hours), F.hour("start_datetime") == F.col("__h"), "left")
    return j.select("id", F.coalesce(F.col("__pk"), F.lit(0)).cast("int").alias("is_peak_hour"))
