"""Registered queries: sources and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import clean as C
from . import base
from .catalog import register
from .oracle import CLEAN, RAW, _nt, case_map, in_list, q, with_base


def _raw_sql(final: str) -> str:
    return f"WITH {RAW}\n{final}"


@register("clean_zero_coords", _raw_sql(
    "SELECT id, nullif(endlatitude, 0) AS endlatitude, nullif(endlongitude, 0) AS endlongitude FROM raw"))
def clean_zero_coords(spark, sf):
    return C.clean_zero_coords(base.raw(spark, sf)).select("id", "endlatitude", "endlongitude")


# Datetimes arrive as text with a "+00" tag; every 97th value is unparseable.
@register("clean_datetimes", _raw_sql(
    "SELECT id, CASE WHEN id % 97 = 0 THEN NULL ELSE start_datetime END AS start_datetime, "
    "resolved_datetime FROM raw"))
def clean_datetimes(spark, sf):
    r = base.raw(spark, sf)
    txt = lambda c: F.concat(F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00"))
    r = r.select("id",
                 F.when(F.col("id") % 97 == 0, F.lit("not a date")).otherwise(txt("start_datetime")).alias("start_datetime"),
                 txt("resolved_datetime").alias("resolved_datetime"))
    return C.clean_datetimes(r)


@register("clean_closure_flag", _raw_sql(
    "SELECT id, CASE upper(trim(requires_road_closure)) WHEN 'TRUE' THEN true WHEN 'FALSE' THEN false END "
    "AS requires_road_closure FROM raw"))
def clean_closure_flag(spark, sf):
    return C.clean_closure_flag(base.raw(spark, sf)).select("id", "requires_road_closure")


@register("clean_cause", _raw_sql(
    f"SELECT id, coalesce({case_map(f'lower(trim({_nt('event_cause')}))', vocab.CAUSE_MAP)}, 'other') "
    "AS event_cause FROM raw"))
def clean_cause(spark, sf):
    return C.clean_cause(base.raw_nt(spark, sf)).select("id", "event_cause")


@register("clean_drop_missing_start", _raw_sql(
    "SELECT count(*) AS n_kept FROM raw WHERE start_datetime IS NOT NULL"))
def clean_drop_missing_start(spark, sf):
    return C.clean_drop_missing_start(base.raw(spark, sf)).agg(F.count(F.lit(1)).alias("n_kept"))


@register("clean_priority", _raw_sql(
    f"SELECT id, CASE WHEN priority IN {in_list(vocab.VALID_PRIORITIES)} THEN priority ELSE 'Low' END "
    "AS priority FROM raw"))
def clean_priority(spark, sf):
    return C.clean_priority(base.raw_nt(spark, sf)).select("id", "priority")


@register("clean_corridor", _raw_sql("SELECT id, trim(coalesce(corridor, 'Non-corridor')) AS corridor FROM raw"))
def clean_corridor(spark, sf):
    return C.clean_corridor(base.raw_nt(spark, sf)).select("id", "corridor")


@register("clean_zone", _raw_sql("SELECT id, trim(coalesce(zone, 'Unknown')) AS zone FROM raw"))
def clean_zone(spark, sf):
    return C.clean_zone(base.raw_nt(spark, sf)).select("id", "zone")


@register("clean_veh_type", _raw_sql("SELECT id, lower(trim(coalesce(veh_type, 'unknown'))) AS veh_type FROM raw"))
def clean_veh_type(spark, sf):
    return C.clean_veh_type(base.raw_nt(spark, sf)).select("id", "veh_type")


@register("clean_junction", _raw_sql("SELECT id, trim(coalesce(junction, 'unknown')) AS junction FROM raw"))
def clean_junction(spark, sf):
    return C.clean_junction(base.raw_nt(spark, sf)).select("id", "junction")


_DQ_SQL = _raw_sql(f"""
SELECT issue, column_name, n FROM (
 SELECT 'out_of_range' AS issue, 'latitude' AS column_name,
        CAST(count(*) FILTER (WHERE latitude < {vocab.BBOX_LAT[0]} OR latitude > {vocab.BBOX_LAT[1]}) AS BIGINT) AS n FROM raw
 UNION ALL SELECT 'out_of_range', 'longitude',
        CAST(count(*) FILTER (WHERE longitude < {vocab.BBOX_LON[0]} OR longitude > {vocab.BBOX_LON[1]}) AS BIGINT) FROM raw
 UNION ALL SELECT 'unparseable', 'start_datetime', CAST(count(*) FILTER (WHERE start_datetime IS NULL) AS BIGINT) FROM raw
 UNION ALL SELECT 'null', 'event_cause', CAST(count(*) FILTER (WHERE {_nt('event_cause')} IS NULL) AS BIGINT) FROM raw
 UNION ALL SELECT 'null', 'status', CAST(count(*) FILTER (WHERE {_nt('status')} IS NULL) AS BIGINT) FROM raw
 UNION ALL SELECT 'null', 'id', CAST(count(*) FILTER (WHERE id IS NULL) AS BIGINT) FROM raw
) t WHERE n > 0""")


@register("dq_validate", _DQ_SQL)
def dq_validate(spark, sf):
    return C.dq_validate(base.raw_nt(spark, sf))


@register("clean_pipeline", with_base("SELECT * FROM clean", upto="clean"))
def clean_pipeline(spark, sf):
    cols = ["id", "start_datetime", "end_datetime", "resolved_datetime", "closed_datetime", "status",
            "event_type", "latitude", "longitude", "endlatitude", "endlongitude", "requires_road_closure",
            "event_cause", "priority", "corridor", "zone", "veh_type", "junction", "address", "description"]
    return base.incidents(spark, sf).select(*cols)


@register("src_features_pruned", with_base(
    "SELECT id, latitude, longitude, start_datetime FROM clean WHERE latitude IS NOT NULL", upto="clean"))
def src_features_pruned(spark, sf):
    """Column-pruned consumer scan: only 4 columns reach the output."""
    return base.incidents(spark, sf).filter(F.col("latitude").isNotNull()).select(
        "id", "latitude", "longitude", "start_datetime")
