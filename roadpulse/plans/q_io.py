"""Registered queries: sources and sinks, each a write + read-back round trip."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import clean as C
from ..operators import features as FE
from ..operators import roads as R
from ..operators import spatial as S
from ..sources import io as IO
from ..streaming.live import scratch
from . import base
from .catalog import ORACLES, register
from .oracle import with_base
from .q_roads import NET, network

_CLEAN_COLS = ["id", "start_datetime", "end_datetime", "resolved_datetime", "closed_datetime", "status", "event_type",
               "latitude", "longitude", "endlatitude", "endlongitude", "requires_road_closure", "event_cause",
               "priority", "corridor", "zone", "veh_type", "junction", "address", "description"]


@register("src_raw_csv", with_base("SELECT " + ", ".join(_CLEAN_COLS) + " FROM clean", upto="clean"))
def src_raw_csv(spark, sf):
    """The raw feed as CSV text (missing tokens, padded values, quoted fields) -> schema'd read -> cleaning."""
    raw = base.raw(spark, sf)
    path = os.path.join(scratch(spark, "rawcsv"), "raw.csv")
    IO.write_csv(raw, path)
    back = IO.read_incident_csv(spark, path, raw.columns)
    return C.clean_pipeline(back).select(*_CLEAN_COLS)


@register("sink_clean", with_base(
    "SELECT CAST(start_datetime AS DATE) AS start_date, CAST(count(*) AS BIGINT) AS n FROM clean GROUP BY 1",
    upto="clean"))
def sink_clean(spark, sf):
    """Clean table written partitioned by start date; read back with partition discovery."""
    path = scratch(spark, "clean")
    d = base.incidents(spark, sf).withColumn("start_date", F.to_date("start_datetime"))
    IO.write_table(d, path, ["start_date"])
    return spark.read.parquet(path).groupBy("start_date").agg(F.count(F.lit(1)).alias("n"))


def _register_roundtrip(key: str, src_key: str, build):
    from .catalog import QUERIES  # noqa: F401

    @register(key, ORACLES.get(src_key))
    def q(spark, sf, _build=build, _key=key):
        path = scratch(spark, _key)
        IO.write_table(_build(spark, sf), path)
        return spark.read.parquet(path)
    return q


def _features_table(spark, sf):
    return FE.project_model_ready(base.features(spark, sf)).withColumn(
        "duration_minutes", A.r6(F.col("duration_minutes")))


def _register_sinks():
    from . import q_analytics, q_features, q_spatial  # noqa: F401  (oracles registered there)
    _register_roundtrip("sink_features", "project_model_ready", _features_table)
    _register_roundtrip("sink_clearance_stats", "clearance_stats",
                        lambda spark, sf: A.clearance_stats(base.features(spark, sf)))
    _register_roundtrip("sink_validation", "hotspot_holdout",
                        lambda spark, sf: S.hotspot_holdout(base.incidents(spark, sf), period="week"))
    _register_roundtrip("sink_hotspot_summary", "hotspot_rank",
                        lambda spark, sf: S.hotspot_rank(q_spatial.labelled(spark, sf)))
    _register_roundtrip("sink_heatmap", "kde_heatmap",
                        lambda spark, sf: S.kde_heatmap(base.incidents(spark, sf)).select(
                            *[F.round(c, 6).alias(c) for c in ("lat", "lon", "weight")]))


_register_sinks()


def _ways(spark, sf):
    pts = network(spark, sf)
    return (pts.groupBy("way_id").agg(F.first("highway").alias("h"), F.first("lanes_raw").alias("l"),
                                      F.sort_array(F.collect_list(F.struct("seq", "lat_e5", "lon_e5"))).alias("p"))
               .select("way_id", "h", "l", F.transform("p", lambda x: F.array(x["lat_e5"] / 1e5, x["lon_e5"] / 1e5))
                       .alias("g")))


_WAYS_SQL = ("SELECT way_id, CAST(count(*) AS BIGINT) AS points, round(min(lat_e5) / 1e5, 5) AS min_lat, "
             "round(max(lon_e5) / 1e5, 5) AS max_lon FROM rp GROUP BY way_id")


@register("src_road_ways", with_base(_WAYS_SQL, upto="clean", extra=NET))
def src_road_ways(spark, sf):
    """Road ways as gzip JSON lines (one way per line) -> schema'd read -> posexplode to points."""
    path = scratch(spark, "ways")
    IO.write_road_ways(_ways(spark, sf), path)
    pts = R.ways_to_points(IO.read_road_ways(spark, path))
    return pts.groupBy("way_id").agg(F.count(F.lit(1)).alias("points"),
                                     F.round(F.min("lat_e5") / 1e5, 5).alias("min_lat"),
                                     F.round(F.max("lon_e5") / 1e5, 5).alias("max_lon"))


@register("road_slim", with_base(_WAYS_SQL, upto="clean", extra=NET))
def road_slim(spark, sf):
    """Raw map-API elements (ways plus node elements) -> slim ways -> points."""
    w = _ways(spark, sf)
    ways = w.select(F.lit("way").alias("type"), F.col("way_id").alias("id"),
                    F.struct(F.col("h").alias("highway"), F.col("l").alias("lanes")).alias("tags"),
                    F.transform("g", lambda p: F.struct(p[0].alias("lat"), p[1].alias("lon"))).alias("geometry"))
    nodes = w.select(F.lit("node").alias("type"), (F.col("way_id") + 100000).alias("id"),
                     F.struct(F.lit(None).cast("string").alias("highway"), F.lit(None).cast("string").alias("lanes"))
                     .alias("tags"), F.lit(None).cast(IO.ELEMENT_SCHEMA["geometry"].dataType).alias("geometry"))
    slim = R.road_slim(ways.unionByName(nodes))
    pts = R.ways_to_points(slim)
    return pts.groupBy("way_id").agg(F.count(F.lit(1)).alias("points"),
                                     F.round(F.min("lat_e5") / 1e5, 5).alias("min_lat"),
                                     F.round(F.max("lon_e5") / 1e5, 5).alias("max_lon"))
