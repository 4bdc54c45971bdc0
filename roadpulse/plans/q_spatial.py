"""Registered queries: spatial operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import vocab
from ..functions import geo as G
from ..operators import dbscan as DB
from ..operators import spatial as S
from ..operators.decide import round_binary
from ..sources import fixtures
from . import base
from .catalog import register
from .oracle import in_list, q, with_base

CENTRE = (12.97, 77.59)  # map centre of the deployment
HAV = G.haversine_sql
LABELS = ("lab AS (SELECT CAST(event_id AS BIGINT) AS id, CAST(CASE WHEN event_id % 50 = 7 THEN -1 ELSE user_id END "
          "AS INT) AS cluster_label FROM events)")
LF = "lf AS (SELECT f.*, l.cluster_label FROM feat f JOIN lab l USING (id))"


def rb(x: str, n: int) -> str:
    k = float(10 ** n)
    return f"(floor({x} * {k} + 0.5) / {k})"


def labelled(spark, sf):
    return base.features(spark, sf).join(fixtures.given_labels(spark, sf), "id")


# --- scalar geodesy ---------------------------------------------------------------

@register("geo_haversine", with_base(
    f"SELECT id, round({HAV(str(CENTRE[0]), str(CENTRE[1]), 'latitude', 'longitude')}, 6) AS km_to_centre "
    "FROM clean", upto="clean"))
def geo_haversine(spark, sf):
    d = base.incidents(spark, sf)
    return d.select("id", F.round(G.haversine_km(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("latitude"),
                                                 F.col("longitude")), 6).alias("km_to_centre"))


@register("geo_project", with_base(
    "SELECT id, round(radians(latitude) * 6371000.0, 3) AS y_m, "
    "round(radians(longitude) * 6371000.0 * cos(radians(12.97)), 3) AS x_m FROM clean", upto="clean"))
def geo_project(spark, sf):
    y, x = G.project_m(F.col("latitude"), F.col("longitude"), F.lit(CENTRE[0]))
    return base.incidents(spark, sf).select("id", F.round(y, 3).alias("y_m"), F.round(x, 3).alias("x_m"))


def _bearing_sql(lat1, lon1, lat2, lon2):
    x = f"(sin(radians({lon2} - {lon1})) * cos(radians({lat2})))"
    y = (f"(cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) "
         f"* cos(radians({lon2} - {lon1})))")
    return f"((degrees(atan2({x}, {y})) + 360.0) % 360.0)"


@register("geo_bearing", with_base(
    f"SELECT id, round({_bearing_sql(CENTRE[0], CENTRE[1], 'latitude', 'longitude')}, 6) AS bearing_deg, "
    f"round(CASE WHEN abs({_bearing_sql(CENTRE[0], CENTRE[1], 'latitude', 'longitude')} - 90.0) % 360.0 > 180.0 "
    f"THEN 360.0 - abs({_bearing_sql(CENTRE[0], CENTRE[1], 'latitude', 'longitude')} - 90.0) % 360.0 "
    f"ELSE abs({_bearing_sql(CENTRE[0], CENTRE[1], 'latitude', 'longitude')} - 90.0) % 360.0 END, 6) AS gap_to_east "
    "FROM clean", upto="clean"))
def geo_bearing(spark, sf):
    """Bearing from the map centre to each incident, and its angular gap to due east."""
    b = G.bearing_deg(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("latitude"), F.col("longitude"))
    d = base.incidents(spark, sf).select("id", b.alias("__b"))
    return d.select("id", F.round("__b", 6).alias("bearing_deg"),
                    F.round(G.angle_gap(F.col("__b"), F.lit(90.0)), 6).alias("gap_to_east"))


@register("geo_bbox", with_base(
    "SELECT min(latitude) - 0.01 AS south, min(longitude) - 0.01 AS west, max(latitude) + 0.01 AS north, "
    "max(longitude) + 0.01 AS east FROM clean WHERE latitude IS NOT NULL AND longitude IS NOT NULL", upto="clean"))
def geo_bbox(spark, sf):
    d = base.incidents(spark, sf).dropna(subset=["latitude", "longitude"])
    return d.agg((F.min("latitude") - 0.01).alias("south"), (F.min("longitude") - 0.01).alias("west"),
                 (F.max("latitude") + 0.01).alias("north"), (F.max("longitude") + 0.01).alias("east"))


# --- hold-out -------------------------------------------------------------------

_FRAME = ("SELECT min(latitude) AS lat_min, min(longitude) AS lon_min, "
          f"CAST({vocab.HOLDOUT_CELL_KM} AS DOUBLE) / {vocab.KM_PER_DEG_LAT} AS dlat, "
          f"CAST({vocab.HOLDOUT_CELL_KM} AS DOUBLE) / ({vocab.KM_PER_DEG_LON_EQ} * cos(radians(avg(latitude)))) AS dlon "
          "FROM {src}")


@register("grid_cells", with_base(
    "SELECT id, CAST(floor((latitude - lat_min) / dlat) AS INTEGER) AS cell_r, "
    "CAST(floor((longitude - lon_min) / dlon) AS INTEGER) AS cell_c FROM clean, fr "
    "WHERE latitude IS NOT NULL AND longitude IS NOT NULL", upto="clean",
    extra=["fr AS (" + _FRAME.format(src="clean WHERE latitude IS NOT NULL AND longitude IS NOT NULL") + ")"]))
def grid_cells(spark, sf):
    d = base.incidents(spark, sf).dropna(subset=["latitude", "longitude"])
    return S.grid_cells(d, S.grid_frame(d)).select("id", "cell_r", "cell_c")


def _holdout_sql(period: str) -> list[str]:
    return [
        f"hp AS (SELECT latitude, longitude, date_trunc('{period}', start_datetime) AS p FROM clean "
        "WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND start_datetime IS NOT NULL)",
        "hb AS (SELECT max(p) AS last, count(DISTINCT p) AS np FROM hp)",
        "htr AS (SELECT hp.* FROM hp, hb WHERE p < last)", "hte AS (SELECT hp.* FROM hp, hb WHERE p = last)",
        "fr AS (" + _FRAME.format(src="htr") + ")",
        "trc AS (SELECT floor((latitude - lat_min) / dlat) AS r, floor((longitude - lon_min) / dlon) AS c, "
        "count(*) AS train_n FROM htr, fr GROUP BY 1, 2)",
        "tec AS (SELECT floor((latitude - lat_min) / dlat) AS r, floor((longitude - lon_min) / dlon) AS c, "
        "count(*) AS test_n FROM hte, fr GROUP BY 1, 2)",
        "cells AS (SELECT coalesce(trc.train_n, 0) AS train_n, coalesce(tec.test_n, 0) AS test_n "
        "FROM trc FULL JOIN tec ON trc.r = tec.r AND trc.c = tec.c)",
        "th AS (SELECT unnest(" + "[" + ", ".join(str(t) for t in vocab.HOLDOUT_THRESHOLDS) + "]) AS threshold)",
        "pt AS (SELECT threshold, CAST(count(*) FILTER (WHERE train_n >= threshold) AS BIGINT) AS n_hot_cells, "
        "CAST(sum(CASE WHEN train_n >= threshold THEN test_n ELSE 0 END) AS BIGINT) AS hits FROM cells, th "
        "GROUP BY threshold)",
        "ho AS (SELECT CAST(threshold AS INTEGER) AS threshold, n_hot_cells, hits, "
        "(SELECT CAST(count(*) AS BIGINT) FROM htr) AS n_train, (SELECT CAST(count(*) AS BIGINT) FROM hte) AS n_test, "
        "(SELECT CAST(count(*) AS BIGINT) FROM trc) AS occupied_cells FROM pt, hb "
        "WHERE n_hot_cells > 0 AND np >= 2)",
        "hv AS (SELECT *, " + rb("n_hot_cells / occupied_cells", 4) + " AS area_share, "
        + rb("hits / n_test", 4) + " AS hit_rate, " + rb("(hits / n_test) / (n_hot_cells / occupied_cells)", 2)
        + " AS pai FROM ho WHERE n_train >= 50 AND n_test >= 20)",
    ]


@register("hotspot_holdout", with_base("SELECT * FROM hv", upto="clean", extra=_holdout_sql("week")))
def hotspot_holdout(spark, sf):
    return S.hotspot_holdout(base.incidents(spark, sf), period="week")


@register("hotspot_headline", with_base(
    "SELECT * FROM hv ORDER BY abs(area_share - 0.05), threshold LIMIT 1", upto="clean", extra=_holdout_sql("week")))
def hotspot_headline(spark, sf):
    return S.hotspot_headline(S.hotspot_holdout(base.incidents(spark, sf), period="week"))


# --- zones --------------------------------------------------------------------

@register("zone_centroids", with_base(
    "SELECT zone, round(avg(latitude), 6) AS zlat, round(avg(longitude), 6) AS zlon FROM clean "
    "WHERE zone IS NOT NULL AND zone <> 'Unknown' GROUP BY zone", upto="clean"))
def zone_centroids(spark, sf):
    z = S.zone_centroids(base.incidents(spark, sf))
    return z.select("zone", F.round("zlat", 6).alias("zlat"), F.round("zlon", 6).alias("zlon"))


@register("zone_impute", with_base(
    "SELECT id, CASE WHEN (zone IS NULL OR zone = 'Unknown') AND latitude IS NOT NULL AND longitude IS NOT NULL "
    "THEN (SELECT min_by(zc.zone, (pow(c.latitude - zc.zlat, 2) + pow(c.longitude - zc.zlon, 2), zc.zone)) "
    "FROM zc) ELSE zone END AS zone FROM clean c", upto="clean",
    extra=["zc AS (SELECT zone, avg(latitude) AS zlat, avg(longitude) AS zlon FROM clean "
           "WHERE zone IS NOT NULL AND zone <> 'Unknown' GROUP BY zone)"]))
def zone_impute(spark, sf):
    return S.zone_impute(base.incidents(spark, sf)).select("id", "zone")


# --- clusters (given labels) ----------------------------------------------------

_CENT = ("cc0 AS (SELECT cluster_label AS cluster, avg(latitude) AS clat, avg(longitude) AS clon FROM lf "
         "WHERE cluster_label >= 0 AND latitude IS NOT NULL GROUP BY 1)",
         "cc AS (SELECT cc0.cluster, clat, clon, max(" + HAV("clat", "clon", "latitude", "longitude")
         + ") AS radius_km FROM cc0 JOIN lf ON lf.cluster_label = cc0.cluster GROUP BY ALL)")


@register("cluster_centroids", with_base(
    "SELECT cluster, round(clat, 5) AS clat, round(clon, 5) AS clon, round(radius_km, 6) AS radius_km FROM cc",
    extra=[LABELS, LF, *_CENT]))
def cluster_centroids(spark, sf):
    c = S.cluster_centroids(labelled(spark, sf))
    return c.select("cluster", F.round("clat", 5).alias("clat"), F.round("clon", 5).alias("clon"),
                    F.round("radius_km", 6).alias("radius_km"))


@register("cluster_assign", with_base(
    "SELECT id, CAST(coalesce((SELECT min_by(cluster, (d, cluster)) FROM (SELECT cluster, "
    + HAV("clat", "clon", "f.latitude", "f.longitude") + " AS d, radius_km FROM cc) x "
    f"WHERE d <= radius_km + {vocab.DBSCAN_EPS_KM}), -1) AS INTEGER) AS assigned_cluster FROM feat f",
    extra=[LABELS, LF, *_CENT]))
def cluster_assign(spark, sf):
    """Online assignment of every incident to the learned cluster footprints."""
    places = base.incidents(spark, sf).select("id", "latitude", "longitude")
    cents = S.cluster_centroids(places.join(fixtures.given_labels(spark, sf), "id"))
    return S.cluster_assign(places, cents) \
        .select("id", "assigned_cluster")


@register("cluster_summary_stats", with_base(
    "SELECT CAST(count(DISTINCT CASE WHEN cluster_label >= 0 THEN cluster_label END) AS BIGINT) AS n_clusters, "
    "CAST(count(*) FILTER (WHERE cluster_label = -1) AS BIGINT) AS n_noise, "
    + rb("100 * (1 - count(*) FILTER (WHERE cluster_label = -1) / count(*))", 6) + " AS coverage_pct FROM lf",
    extra=[LABELS, LF]))
def cluster_summary_stats(spark, sf):
    return S.cluster_summary_stats(labelled(spark, sf))


def _mode_sql(col: str) -> str:
    return (f"m_{col} AS (SELECT cluster_label, min_by({col}, (-n, {col})) AS mode_{col} FROM ("
            f"SELECT cluster_label, {col}, count(*) AS n FROM lf WHERE cluster_label >= 0 AND {col} IS NOT NULL "
            f"GROUP BY 1, 2) t GROUP BY 1)")


_LANDMARK_DUCK = S.LANDMARK_PATTERN


def _label_sql(j: str, a: str, cid: str) -> str:
    parts = f"list_filter(list_transform(string_split(coalesce({a}, ''), ','), lambda p: trim(p)), lambda p: p <> '')"
    land = f"list_filter({parts}, lambda p: regexp_matches(p, {q(_LANDMARK_DUCK)}))"
    first_land = f"substring(trim(string_split({land}[1], '.')[1]), 1, 40)"
    lab = (f"(CASE WHEN len({land}) > 0 THEN {first_land} WHEN len({parts}) > 0 THEN substring({parts}[1], 1, 40) "
           "ELSE '' END)")
    return (f"CASE WHEN {j} IS NOT NULL AND lower({j}) <> 'unknown' THEN {j} WHEN {lab} <> '' THEN {lab} "
            f"ELSE 'Cluster-' || CAST({cid} AS VARCHAR) END")


_PROFILE = [LABELS, LF, _mode_sql("event_cause"), _mode_sql("junction"), _mode_sql("address"), _mode_sql("zone"),
            _mode_sql("severity_class"),
            "prof AS (SELECT cluster_label, CAST(count(*) AS BIGINT) AS event_count, "
            "quantile_cont(duration_minutes, 0.5) AS med, avg(latitude) AS clat, avg(longitude) AS clon "
            "FROM lf WHERE cluster_label >= 0 GROUP BY 1)",
            "pr AS (SELECT * FROM prof LEFT JOIN m_event_cause USING (cluster_label) LEFT JOIN m_junction "
            "USING (cluster_label) LEFT JOIN m_address USING (cluster_label) LEFT JOIN m_zone USING (cluster_label) "
            "LEFT JOIN m_severity_class USING (cluster_label))"]


@register("hotspot_features", with_base(
    "SELECT cluster_label AS cluster_id, event_count, coalesce(mode_event_cause, 'other') AS dominant_cause, "
    f"CASE WHEN med IS NOT NULL AND med <> 0 THEN {rb('med', 1)} END AS avg_duration_minutes, "
    f"{_label_sql('mode_junction', 'mode_address', 'cluster_label')} AS top_junction, "
    f"coalesce(mode_zone, 'Unknown') AS zone, {rb('clat', 5)} AS centroid_lat, {rb('clon', 5)} AS centroid_lon "
    "FROM pr", extra=_PROFILE))
def hotspot_features(spark, sf):
    return S.hotspot_features(labelled(spark, sf)).drop("ring")


@register("hotspot_rank", with_base(
    f"SELECT cluster_label AS cluster_id, {_label_sql('mode_junction', 'mode_address', 'cluster_label')} AS junction, "
    "event_count, mode_event_cause AS dominant_cause, coalesce(mode_severity_class, 'Medium') AS dominant_severity, "
    f"CASE WHEN med IS NOT NULL AND med <> 0 THEN {rb('med', 1)} END AS avg_duration_minutes, "
    f"coalesce(mode_zone, 'Unknown') AS zone, {rb('clat', 5)} AS centroid_lat, {rb('clon', 5)} AS centroid_lon "
    "FROM pr ORDER BY event_count DESC, cluster_label LIMIT 10", extra=_PROFILE))
def hotspot_rank(spark, sf):
    return S.hotspot_rank(labelled(spark, sf))


_SEL_ZONES = ["North Zone 1", "East Zone 2", "South Zone 1", "West Zone 1", "Mystery Zone"]
_SEL_CAUSES = ["vehicle_breakdown", "accident"]


@register("hotspot_feature_filter", with_base(
    "SELECT cluster_label AS cluster_id, event_count FROM pr "
    f"WHERE coalesce(mode_zone, 'Unknown') IN {in_list(_SEL_ZONES)} "
    f"AND coalesce(mode_event_cause, 'other') IN {in_list(_SEL_CAUSES)}", extra=_PROFILE))
def hotspot_feature_filter(spark, sf):
    f = S.hotspot_features(labelled(spark, sf))
    return S.hotspot_feature_filter(f, _SEL_ZONES, _SEL_CAUSES).select("cluster_id", "event_count")


@register("address_label", with_base(
    f"SELECT id, {_label_sql('junction', 'address', 'id')} AS label FROM clean", upto="clean"))
def address_label(spark, sf):
    d = base.incidents(spark, sf)
    return d.select("id", S.best_junction_label(F.col("junction"), F.col("address"), F.col("id")).alias("label"))


@register("circle_ring", with_base(
    "SELECT cluster_id, CAST(i AS INTEGER) AS vertex, round(clon + dlon * cos(t), 6) AS lon, "
    "round(clat + dlat * sin(t), 6) AS lat FROM ("
    f"SELECT cluster AS cluster_id, clat, clon, CAST({vocab.CLUSTER_BUFFER_KM} AS DOUBLE) / {vocab.KM_PER_DEG_LAT} AS dlat, "
    f"CAST({vocab.CLUSTER_BUFFER_KM} AS DOUBLE) / ({vocab.KM_PER_DEG_LON_EQ} * cos(radians(clat)) + 1e-9) AS dlon, "
    f"i, CASE WHEN i = 27 OR i = 28 THEN (CASE WHEN i = 27 THEN 2 * pi() ELSE 0.0 END) "
    f"ELSE i * (2 * pi() / 27) END AS t FROM cc0, range(29) r(i)) x", extra=[LABELS, LF, _CENT[0]]))
def circle_ring(spark, sf):
    """28-vertex ring (+ closing vertex) around each cluster centroid, one row per vertex."""
    c = S.cluster_centroids(labelled(spark, sf))
    r = c.select(F.col("cluster").alias("cluster_id"), F.posexplode(G.circle_ring(F.col("clat"), F.col("clon")))
                 .alias("vertex", "xy"))
    return r.select("cluster_id", F.col("vertex").cast("int").alias("vertex"),
                    F.round(F.col("xy")[0], 6).alias("lon"), F.round(F.col("xy")[1], 6).alias("lat"))


def _kde_sql() -> list[str]:
    b2 = vocab.KDE_BANDWIDTH ** 2
    g = vocab.KDE_GRID
    return [
        "kp AS (SELECT latitude AS la, longitude AS lo FROM clean WHERE latitude IS NOT NULL AND longitude IS NOT NULL)",
        f"ks AS (SELECT min(la) AS la0, max(la) AS la1, min(lo) AS lo0, max(lo) AS lo1, var_samp(lo) * {b2!r} AS sxx, "
        f"var_samp(la) * {b2!r} AS syy, covar_samp(lo, la) * {b2!r} AS sxy, count(*) AS n FROM kp)",
        f"ks2 AS (SELECT *, sxx * syy - sxy * sxy AS det, lo0 - {vocab.KDE_PAD_DEG} AS glo0, lo1 + {vocab.KDE_PAD_DEG} "
        f"AS glo1, la0 - {vocab.KDE_PAD_DEG} AS gla0, la1 + {vocab.KDE_PAD_DEG} AS gla1 FROM ks)",
        f"ks3 AS (SELECT *, (glo1 - glo0) / {g - 1} AS stx, (gla1 - gla0) / {g - 1} AS sty, "
        "1.0 / (n * 2 * pi() * sqrt(det)) AS norm FROM ks2)",
        f"kg AS (SELECT CAST(range % {g} AS INTEGER) AS gi, CAST(range // {g} AS INTEGER) AS gj FROM range({g * g}))",
        f"kgg AS (SELECT gi, gj, CASE WHEN gi = {g - 1} THEN glo1 ELSE glo0 + gi * stx END AS glon, "
        f"CASE WHEN gj = {g - 1} THEN gla1 ELSE gla0 + gj * sty END AS glat, sxx, syy, sxy, det, norm FROM kg, ks3)",
        "kz AS (SELECT gi, gj, glat, glon, sum(exp(-0.5 * ((syy * (glon - lo) * (glon - lo) - 2 * sxy * (glon - lo) "
        "* (glat - la) + sxx * (glat - la) * (glat - la)) / det))) * any_value(norm) AS z FROM kgg, kp GROUP BY ALL)",
        "kw AS (SELECT glat AS lat, glon AS lon, (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER () + 1e-9) "
        "AS weight FROM kz)",
    ]


@register("kde_heatmap", with_base(
    f"SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, round(weight, 6) AS weight FROM kw "
    f"WHERE weight > {vocab.KDE_MIN_WEIGHT}", upto="clean", extra=_kde_sql()))
def kde_heatmap(spark, sf):
    h = S.kde_heatmap(base.incidents(spark, sf))
    return h.select(*[F.round(c, 6).alias(c) for c in ("lat", "lon", "weight")])


@register("heatmap_raw", with_base(
    "SELECT latitude AS lat, longitude AS lon, CAST(1.0 AS DOUBLE) AS weight FROM clean WHERE latitude IS NOT NULL "
    "AND longitude IS NOT NULL", upto="clean"))
def heatmap_raw(spark, sf):
    return S.heatmap_raw(base.incidents(spark, sf))


# --- clustering itself (iterative: checked against FIXTURES counts in tests) ----------

@register("dbscan")
def dbscan(spark, sf):
    return DB.dbscan(base.incidents(spark, sf))


@register("dbscan_summary")
def dbscan_summary(spark, sf):
    lab = DB.dbscan(base.incidents(spark, sf))
    return lab.agg(F.count_distinct(F.when(F.col("cluster_label") >= 0, F.col("cluster_label"))).alias("n_clusters"),
                   F.count_if(F.col("cluster_label") == -1).alias("n_noise"),
                   F.count_if(F.col("is_core")).alias("n_core"),
                   F.count_if((~F.col("is_core")) & (F.col("cluster_label") >= 0)).alias("n_border"))


@register("sink_hotspots_geojson")
def sink_hotspots_geojson(spark, sf):
    """GeoJSON Feature text per hotspot (write with ``.write.text`` to a shared folder)."""
    return S.geojson_features(S.hotspot_features(labelled(spark, sf)))


@register("morans_i")
def morans_i(spark, sf):
    """Spatial autocorrelation of cluster membership (fixture labels), kNN k=8."""
    return S.morans_i(labelled(spark, sf))
