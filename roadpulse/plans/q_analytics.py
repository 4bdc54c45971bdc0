"""Registered queries: analytics roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import analytics as A
from . import base
from .catalog import register
from .oracle import case_map, in_list, q, with_base

# Page-filter parameters used by the filtered KPIs.
FILTER_ZONES = ["North Zone 1", "Central Zone 1", "South Zone 2", "Unknown", "Mystery Zone"]
FILTER_CAUSES = ["vehicle_breakdown", "accident", "construction", "other", "water_logging"]
FILTER_FROM, FILTER_TO = "2024-01-05", "2024-01-20"

_FILTER_SQL = (f"zone IN {in_list(FILTER_ZONES)} AND event_cause IN {in_list(FILTER_CAUSES)} "
               f"AND CAST(start_datetime AS DATE) BETWEEN DATE '{FILTER_FROM}' AND DATE '{FILTER_TO}'")
_LABEL = f"coalesce({case_map('event_cause', vocab.CAUSE_DISPLAY)}, event_cause)"


def _filtered(spark, sf):
    return A.analytics_filter(base.features(spark, sf), FILTER_ZONES, FILTER_CAUSES, FILTER_FROM, FILTER_TO)


@register("kpi_home", with_base(
    "SELECT CAST(count(*) AS BIGINT) AS total_events, CAST(count(DISTINCT corridor) AS BIGINT) AS corridors, "
    "CAST(count(DISTINCT CASE WHEN junction <> 'unknown' THEN junction END) AS BIGINT) AS junctions, "
    "CAST(count(*) FILTER (WHERE severity_class = 'High') AS BIGINT) AS high_events, "
    "round(100 * avg(CAST(severity_class = 'High' AS DOUBLE)), 6) AS high_pct, "
    "round(quantile_cont(duration_minutes, 0.5), 6) AS median_duration FROM feat"))
def kpi_home(spark, sf):
    return A.kpi_home(base.features(spark, sf))


@register("severity_breakdown", with_base(
    "SELECT severity_class, CAST(count(*) AS BIGINT) AS n, "
    "CAST(CASE severity_class WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END AS INTEGER) "
    "AS sort_key FROM feat GROUP BY 1"))
def severity_breakdown(spark, sf):
    return A.severity_breakdown(base.features(spark, sf))


@register("top_corridors", with_base(
    "SELECT corridor, CAST(count(*) AS BIGINT) AS n FROM feat WHERE corridor <> 'Non-corridor' "
    "GROUP BY 1 ORDER BY n DESC, corridor LIMIT 5"))
def top_corridors(spark, sf):
    return A.top_corridors(base.features(spark, sf))


@register("top_junctions", with_base(
    f"SELECT junction, CAST(count(*) AS BIGINT) AS n FROM feat WHERE {_FILTER_SQL} AND junction <> 'unknown' "
    "GROUP BY 1 ORDER BY n DESC, junction LIMIT 10"))
def top_junctions(spark, sf):
    return A.top_junctions(_filtered(spark, sf))


@register("analytics_filter", with_base(f"SELECT id, zone, event_cause, start_datetime FROM feat WHERE {_FILTER_SQL}"))
def analytics_filter(spark, sf):
    return _filtered(spark, sf).select("id", "zone", "event_cause", "start_datetime")


@register("kpi_filtered", with_base(
    "SELECT CAST(count(*) AS BIGINT) AS events, "
    "CAST(count(*) FILTER (WHERE severity_class = 'High') AS BIGINT) AS high_events, "
    "CAST(count(duration_minutes) AS BIGINT) AS with_duration, "
    "round(quantile_cont(duration_minutes, 0.5), 6) AS median_duration, "
    f"CAST(count(DISTINCT corridor) AS BIGINT) AS corridors FROM feat WHERE {_FILTER_SQL}"))
def kpi_filtered(spark, sf):
    return A.kpi_filtered(_filtered(spark, sf))


@register("cause_distribution", with_base(
    f"SELECT {_LABEL} AS cause_label, CAST(count(*) AS BIGINT) AS n FROM feat WHERE {_FILTER_SQL} GROUP BY 1"))
def cause_distribution(spark, sf):
    return A.cause_distribution(_filtered(spark, sf))


@register("hourly_load", with_base(
    "SELECT hour_of_day, CAST(count(*) AS BIGINT) AS n, "
    f"CASE WHEN hour_of_day IN {in_list(vocab.PEAK_HOURS)} THEN 'High-incident' ELSE 'Off-peak' END AS load "
    "FROM feat GROUP BY 1"))
def hourly_load(spark, sf):
    return A.hourly_load(base.features(spark, sf))


@register("dow_distribution", with_base(
    "SELECT day_of_week, CAST(count(*) AS BIGINT) AS n, CASE day_of_week "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(A.DAY_NAMES))
    + " END AS day, CASE WHEN day_of_week >= 5 THEN 'Weekend' ELSE 'Weekday' END AS weekend FROM feat GROUP BY 1"))
def dow_distribution(spark, sf):
    return A.dow_distribution(base.features(spark, sf))


@register("corridor_weekly", with_base(
    "SELECT CAST(date_trunc('week', start_datetime) AS TIMESTAMP) AS week, corridor, "
    "round(avg(corridor_7d_score), 6) AS avg_7d_score FROM feat WHERE corridor IN ("
    "SELECT corridor FROM feat WHERE corridor <> 'Non-corridor' GROUP BY 1 ORDER BY count(*) DESC, corridor LIMIT 6) "
    "GROUP BY 1, 2"))
def corridor_weekly(spark, sf):
    return A.corridor_weekly(base.features(spark, sf))


@register("resolution_by_cause", with_base(
    f"SELECT {_LABEL} AS cause_label, round(avg(duration_minutes), 6) AS mean_minutes, "
    "round(quantile_cont(duration_minutes, 0.5), 6) AS median_minutes, CAST(count(*) AS BIGINT) AS n "
    "FROM feat WHERE duration_minutes IS NOT NULL GROUP BY 1"))
def resolution_by_cause(spark, sf):
    return A.resolution_by_cause(base.features(spark, sf))


@register("semantic_distribution", with_base(
    "SELECT " + case_map("event_semantic_type",
                         {t: t.replace("_", " ").title() for t in vocab.SEMANTIC_TYPE_ORDER}) + " AS label, "
    "CAST(count(*) AS BIGINT) AS n, "
    "round(100.0 * (SELECT count(*) FROM feat WHERE event_semantic_type <> 'other') / (SELECT count(*) FROM feat), 6)"
    " AS matched_pct FROM feat WHERE event_semantic_type <> 'other' GROUP BY event_semantic_type"))
def semantic_distribution(spark, sf):
    return A.semantic_distribution(base.features(spark, sf))


@register("mode", with_base(
    "SELECT zone, min_by(event_cause, (-n, event_cause)) AS mode_event_cause FROM ("
    "SELECT zone, event_cause, count(*) AS n FROM feat GROUP BY 1, 2) t GROUP BY zone"))
def mode(spark, sf):
    return A.deterministic_mode(base.features(spark, sf), ["zone"], "event_cause")


_CLEAR_SQL = with_base(
    "SELECT cause, round(q[2], 6) AS median, round(q[1], 6) AS p25, round(q[3], 6) AS p75, n FROM ("
    "SELECT CASE WHEN GROUPING(event_cause) = 1 THEN '_overall' ELSE event_cause END AS cause, "
    "quantile_cont(duration_minutes, [0.25, 0.5, 0.75]) AS q, CAST(count(*) AS BIGINT) AS n, "
    "GROUPING(event_cause) AS g FROM feat WHERE duration_minutes > 0 AND duration_minutes <= 1440 "
    "GROUP BY GROUPING SETS ((event_cause), ())) t WHERE g = 1 OR n >= 5")


@register("clearance_stats", _CLEAR_SQL)
def clearance_stats(spark, sf):
    return A.clearance_stats(base.features(spark, sf))


@register("corridor_list", with_base("SELECT DISTINCT corridor FROM feat ORDER BY corridor"))
def corridor_list(spark, sf):
    return A.corridor_list(base.features(spark, sf))
