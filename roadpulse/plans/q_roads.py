"""Registered queries: road network join and full feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import analytics as A
from ..operators import dbscan as DB
from ..operators import features as FE
from ..operators import roads as R
from ..functions.geo import haversine_km, haversine_sql
from ..sources import fixtures
from ..session import cut_lineage
from . import base
from .catalog import register
from .oracle import case_map, with_base
from .q_spatial import LABELS

_R = vocab.EARTH_RADIUS_M


def network(spark, sf):
    """The street network clipped to the incidents' padded extent (what a map-API bbox fetch returns),
    written once per session and input."""
    def build():
        inc = base.incidents(spark, sf).dropna(subset=["latitude", "longitude"])
        box = inc.agg((F.min("latitude") - 0.01).alias("s"), (F.max("latitude") + 0.01).alias("n"),
                      (F.min("longitude") - 0.01).alias("w"), (F.max("longitude") + 0.01).alias("e"))
        pts = fixtures.road_points(spark, sf)
        lat, lon = F.col("lat_e5") / 100000.0, F.col("lon_e5") / 100000.0
        return (pts.crossJoin(F.broadcast(box))
                   .filter(lat.between(F.col("s"), F.col("n")) & lon.between(F.col("w"), F.col("e")))
                   .drop("s", "n", "w", "e"))
    return base._stage(spark, "network", sf, build)


_LANES_SQL = ("CASE WHEN lanes_raw IS NULL THEN NULL WHEN list_bool_and(list_transform(string_split("
              "replace(lanes_raw, ',', ';'), ';'), lambda t: TRY_CAST(t AS DOUBLE) IS NOT NULL AND "
              "NOT isnan(TRY_CAST(t AS DOUBLE)))) THEN CAST(list_max(list_transform(string_split(replace(lanes_raw, ',', "
              "';'), ';'), lambda t: floor(TRY_CAST(t AS DOUBLE)))) AS DOUBLE) END")
_RANK_SQL = f"CAST(coalesce({case_map('highway', vocab.ROAD_CLASS_RANK)}, 0) AS INTEGER)"

NET = [
    "bx AS (SELECT min(latitude) - 0.01 AS s, max(latitude) + 0.01 AS n, min(longitude) - 0.01 AS w, "
    "max(longitude) + 0.01 AS e FROM clean WHERE latitude IS NOT NULL AND longitude IS NOT NULL)",
    f"rp AS (SELECT r.* FROM ({fixtures.road_points_sql()}) r, bx "
    "WHERE lat_e5 / 100000.0 BETWEEN s AND n AND lon_e5 / 100000.0 BETWEEN w AND e)",
    f"rpp AS (SELECT way_id, seq, highway, {_RANK_SQL} AS road_class_rank, {_LANES_SQL} AS lanes, "
    "lat_e5 / 100000.0 AS lat, lon_e5 / 100000.0 AS lon FROM rp)",
]

_JOIN = NET + [
    "l0 AS (SELECT avg(latitude) AS lat0 FROM clean WHERE latitude IS NOT NULL AND longitude IS NOT NULL)",
    f"ip AS (SELECT id, radians(latitude) * {_R} AS iy, radians(longitude) * {_R} * cos(radians(lat0)) AS ix "
    "FROM clean, l0 WHERE latitude IS NOT NULL AND longitude IS NOT NULL)",
    f"rq AS (SELECT way_id, seq, highway, road_class_rank, lanes, radians(lat) * {_R} AS ry, "
    f"radians(lon) * {_R} * cos(radians(lat0)) AS rx FROM rpp, l0)",
    # exact within 120 m via buckets; brute force for the rest
    "ipc AS (SELECT *, floor(iy / 120.0) AS cy, floor(ix / 120.0) AS cx FROM ip)",
    "rqc AS (SELECT rq.*, floor(ry / 120.0) + dy AS cy, floor(rx / 120.0) + dx AS cx FROM rq, "
    "(SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) b)",
    "nb AS (SELECT id, arg_min({'d': d, 'way_id': way_id, 'seq': seq, 'highway': highway, "
    "'road_class_rank': road_class_rank, 'lanes': lanes}, (round(d, 6), way_id, seq)) AS b FROM ("
    "SELECT ipc.id, rqc.*, sqrt(pow(iy - ry, 2) + pow(ix - rx, 2)) AS d FROM ipc JOIN rqc USING (cy, cx)) t "
    "GROUP BY id)",
    "nb_ok AS (SELECT * FROM nb WHERE b.d <= 120.0)",
    "far AS (SELECT id, arg_min({'d': d, 'way_id': way_id, 'seq': seq, 'highway': highway, "
    "'road_class_rank': road_class_rank, 'lanes': lanes}, (round(d, 6), way_id, seq)) AS b FROM ("
    "SELECT ip.id, rq.*, sqrt(pow(iy - ry, 2) + pow(ix - rx, 2)) AS d FROM ip JOIN rq ON true "
    "WHERE ip.id NOT IN (SELECT id FROM nb_ok)) t GROUP BY id)",
    "nn AS (SELECT * FROM nb_ok UNION ALL SELECT * FROM far)",
    "rj AS (SELECT c.id, CASE WHEN b.d <= 120.0 THEN b.highway ELSE 'minor_or_unknown' END AS road_class, "
    "CAST(CASE WHEN b.d <= 120.0 THEN b.road_class_rank ELSE 0 END AS INTEGER) AS road_class_rank, "
    "coalesce(CASE WHEN b.d <= 120.0 THEN coalesce(b.lanes, "
    + case_map("b.road_class_rank", {k: float(v) for k, v in vocab.DEFAULT_LANES_BY_RANK.items()})
    + ") ELSE 1.0 END, 1.0) AS lane_count, round_even(b.d * 10, 0) / 10 AS road_dist_m "
    "FROM clean c LEFT JOIN nn ON c.id = nn.id)",
]


@register("road_points", with_base(
    "SELECT way_id, seq, road_class_rank, lanes, lat, lon FROM rpp", upto="clean", extra=NET))
def road_points(spark, sf):
    return R.road_points(network(spark, sf)).select("way_id", "seq", "road_class_rank", "lanes", "lat", "lon")


@register("road_lanes_parse", with_base(
    "SELECT way_id, lanes_raw, lanes, CAST(count(*) AS BIGINT) AS points FROM ("
    f"SELECT way_id, lanes_raw, {_LANES_SQL} AS lanes FROM rp) t GROUP BY ALL", upto="clean", extra=NET))
def road_lanes_parse(spark, sf):
    return (network(spark, sf).select("way_id", "lanes_raw", R.lanes_parse(F.col("lanes_raw")).alias("lanes"))
            .groupBy("way_id", "lanes_raw", "lanes").agg(F.count(F.lit(1)).alias("points")))


def joined(spark, sf, inc=None):
    inc = inc if inc is not None else base.incidents(spark, sf)
    return R.road_join(inc, network(spark, sf))


@register("road_join", with_base(
    "SELECT id, road_class, road_class_rank, lane_count, road_dist_m FROM rj", upto="clean", extra=_JOIN))
def road_join(spark, sf):
    return joined(spark, sf).select("id", "road_class", "road_class_rank", "lane_count", "road_dist_m")


@register("road_match_quality", with_base(
    "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE road_dist_m <= 120) AS BIGINT) AS matched, "
    "round(avg(CAST(road_dist_m <= 120 AS DOUBLE)), 6) AS match_share, round(avg(lane_count), 6) AS mean_lanes, "
    "round(avg(road_class_rank), 6) AS mean_rank FROM rj", upto="clean", extra=_JOIN))
def road_match_quality(spark, sf):
    return R.road_match_quality(joined(spark, sf))


@register("road_edges", with_base(
    "SELECT way_id, CAST(count(*) AS BIGINT) AS edges, round(sum(m), 3) AS metres FROM ("
    "SELECT way_id, " + "1000.0 * (2 * 6371.0 * asin(sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * "
    "cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2)))) AS m FROM ("
    "SELECT way_id, lat_e5 / 1e5 AS lat, lon_e5 / 1e5 AS lon, lead(lat_e5) OVER w / 1e5 AS lat2, "
    "lead(lon_e5) OVER w / 1e5 AS lon2 FROM rp WINDOW w AS (PARTITION BY way_id ORDER BY seq)) t "
    "WHERE lat2 IS NOT NULL) e WHERE m > 0 GROUP BY way_id", upto="clean", extra=NET))
def road_edges(spark, sf):
    e = R.road_edges(network(spark, sf))
    return e.groupBy("way_id").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("m"), 3).alias("metres"))


# --- full feature table with given cluster labels (exact oracle) --------------------------

_GIVEN = ["id", "start_datetime", "status", "corridor", "latitude", "longitude", "severity_class", "duration_minutes", "hour_of_day",
          "day_of_week", "is_peak_hour", "is_weekend", "junction_repeat_count", "corridor_7d_score", "cause_severity_weight",
          "road_closure_binary", "veh_type_encoded", "event_semantic_encoded"]


def features_given(spark, sf):
    """What models and history medians read of: core features + road context + fixture cluster labels + leakage-free
    cluster history (a stage output: materialised once per session and input folder).

    Only these columns are shuffled and written; the road join and the labels meet the rows in one shuffle by id.
    Where the core feature table is already written, they are read from it.
    """
    def build():
        if base.held(spark, "features", sf):
            core = base.features(spark, sf).select(*_GIVEN)
        else:
            core = cut_lineage(FE.feat_model(base.incidents(spark, sf), _GIVEN))
        f = R.road_join(core, network(spark, sf)).drop("latitude", "longitude", "road_class", "road_dist_m")
        f = f.join(fixtures.given_labels(spark, sf), "id", "left").fillna(-1, ["cluster_label"])
        return FE.feat_cluster_history(cut_lineage(f))
    return base._stage(spark, "features_given", sf, build, cluster=False)


_CH = [LABELS,
       "ch0 AS (SELECT f.id, f.corridor, f.start_datetime, f.road_closure_binary, coalesce(l.cluster_label, -1) "
       "AS cluster_label FROM feat f LEFT JOIN lab l USING (id))",
       "ch1 AS (SELECT *, count(*) OVER cw AS c_n, coalesce(sum(road_closure_binary) OVER cw, 0) AS c_s, "
       "count(*) OVER gw AS g_n, coalesce(sum(road_closure_binary) OVER gw, 0) AS g_s FROM ch0 "
       "WINDOW cw AS (PARTITION BY cluster_label ORDER BY start_datetime, id ROWS BETWEEN UNBOUNDED PRECEDING "
       "AND 1 PRECEDING), gw AS (ORDER BY start_datetime, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
       "ch AS (SELECT id, corridor, cluster_label, CAST(CASE WHEN cluster_label = -1 THEN 0 ELSE c_n END AS INTEGER) "
       "AS cluster_prior_events, CASE WHEN cluster_label = -1 OR c_n = 0 THEN (CASE WHEN g_n > 0 THEN g_s / g_n "
       "ELSE 0.0 END) ELSE c_s / c_n END AS cluster_closure_rate FROM ch1)"]


@register("feat_cluster_history", with_base(
    "SELECT id, cluster_label, cluster_prior_events, round(cluster_closure_rate, 6) AS cluster_closure_rate FROM ch",
    extra=_CH))
def feat_cluster_history(spark, sf):
    f = FE.feat_core(base.incidents(spark, sf)).join(fixtures.given_labels(spark, sf), "id", "left") \
        .fillna(-1, ["cluster_label"])
    h = FE.feat_cluster_history(f)
    return h.select("id", "cluster_label", "cluster_prior_events",
                    F.round("cluster_closure_rate", 6).alias("cluster_closure_rate"))


_HIST = _CH + _JOIN[0:0] + [c for c in _JOIN] + [
    "hf AS (SELECT f.corridor, f.corridor_7d_score, f.junction_repeat_count, ch.cluster_prior_events, "
    "ch.cluster_closure_rate, rj.road_class_rank, rj.lane_count FROM feat f JOIN ch USING (id) JOIN rj USING (id))",
    "hm AS (SELECT CASE WHEN GROUPING(corridor) = 0 THEN corridor END AS corridor, GROUPING(corridor) = 1 AS is_global, "
    "CAST(round_even(quantile_cont(corridor_7d_score, 0.5), 0) AS BIGINT) AS corridor_7d_score, "
    "CAST(round_even(quantile_cont(junction_repeat_count, 0.5), 0) AS BIGINT) AS junction_repeat_count, "
    "CAST(round_even(quantile_cont(cluster_prior_events, 0.5), 0) AS BIGINT) AS cluster_prior_events, "
    "round_even(quantile_cont(cluster_closure_rate, 0.5), 4) AS cluster_closure_rate, "
    "CAST(round_even(quantile_cont(road_class_rank, 0.5), 0) AS BIGINT) AS road_class_rank, "
    "round_even(quantile_cont(lane_count, 0.5), 4) AS lane_count FROM hf GROUP BY GROUPING SETS ((corridor), ()))",
]


def medians(spark, sf):
    return A.corridor_history_medians(features_given(spark, sf))


@register("corridor_history_medians", with_base("SELECT * FROM hm", extra=_HIST))
def corridor_history_medians(spark, sf):
    return medians(spark, sf)


@register("history_lookup", with_base(
    "SELECT q.id, q.corridor, coalesce(p.corridor_7d_score, g.corridor_7d_score) AS corridor_7d_score, "
    "coalesce(p.junction_repeat_count, g.junction_repeat_count) AS junction_repeat_count, "
    "coalesce(p.cluster_prior_events, g.cluster_prior_events) AS cluster_prior_events, "
    "CASE WHEN p.corridor IS NOT NULL THEN p.cluster_closure_rate ELSE g.cluster_closure_rate END AS cluster_closure_rate, "
    "coalesce(p.road_class_rank, g.road_class_rank) AS road_class_rank, "
    "CASE WHEN p.corridor IS NOT NULL THEN p.lane_count ELSE g.lane_count END AS lane_count "
    "FROM (SELECT id, CASE WHEN id % 2 = 0 THEN NULL ELSE corridor END AS corridor FROM clean "
    "WHERE status = 'active') q LEFT JOIN (SELECT * FROM hm WHERE NOT is_global) p ON q.corridor = p.corridor "
    "CROSS JOIN (SELECT * FROM hm WHERE is_global) g", extra=_HIST))
def history_lookup(spark, sf):
    """History features for new events by corridor (every other event arrives without one -> global)."""
    q = (base.incidents(spark, sf).filter(F.col("status") == "active")
         .select("id", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("corridor")).alias("corridor")))
    return A.history_lookup(q, medians(spark, sf))


@register("history_asof", with_base(
    "SELECT f.id, f.corridor, s.at, coalesce(s.events, 0) AS events, s.median_7d FROM feat f ASOF LEFT JOIN (SELECT corridor, "
    "CAST(date_trunc('day', start_datetime) AS TIMESTAMP) + INTERVAL 1 DAY AS at, CAST(count(*) AS BIGINT) AS events, "
    "quantile_cont(CAST(corridor_7d_score AS DOUBLE), 0.5) AS median_7d FROM feat WHERE corridor IS NOT NULL GROUP BY 1, 2) s "
    "ON f.corridor = s.corridor AND f.start_datetime >= s.at"))
def history_asof(spark, sf):
    """Corridor history as of each event's time: the latest day with events that had ended by then."""
    f = base.features(spark, sf).select("id", "corridor", "start_datetime", "corridor_7d_score")
    daily = f.withColumn("day", F.date_trunc("day", "start_datetime").cast("timestamp_ntz"))
    return A.history_asof(f.drop("corridor_7d_score"), A.corridor_days(daily)).drop("start_datetime").fillna(0, ["events"])


@register("feat_all")
def feat_all(spark, sf):
    """The full feature table: core + road context + DBSCAN labels + cluster history (model-ready projection)."""
    f = cut_lineage(FE.feat_core(base.incidents(spark, sf)))
    f = cut_lineage(R.road_join(f, network(spark, sf)))
    lab = DB.dbscan(base.incidents(spark, sf)).select("id", "cluster_label")
    f = f.join(lab, "id", "left").fillna(-1, ["cluster_label"])
    return FE.project_model_ready(FE.feat_cluster_history(f))


# --- diversion planning for incidents that need it ------------------------------------

def _diversion_targets(spark, sf):
    """Active, located incidents whose recommendation asks for a diversion."""
    from ..operators import decide as D
    from .q_decide import scored
    r = D.recommend(scored(spark, sf).filter(F.col("status") == "active"), prob_col="closure_prob")
    return r.filter(F.col("diversion_recommended") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()) \
        .select("id", "latitude", "longitude")


def _members(spark, sf):
    """(id, site) of the diversion targets: targets at the same place have one site, its smallest id."""
    def build():
        at = F.array_sort(F.collect_set(F.struct("latitude", "longitude"))).alias("at")
        per = _diversion_targets(spark, sf).filter(F.col("id").isNotNull()).groupBy("id").agg(at)
        return per.join(per.groupBy("at").agg(F.min("id").alias("site")), "at").select("id", "site", "at")
    return base._stage(spark, "diversion-members", sf, build)


def _places(spark, sf):
    """The sites as incidents of their own (id, latitude, longitude)."""
    return _members(spark, sf).filter(F.col("id") == F.col("site")).select("id", F.inline("at"))


def _of_targets(spark, sf, per_site, how="inner"):
    """``per_site`` (id = site) for every target row."""
    own = _diversion_targets(spark, sf).select("id").join(_members(spark, sf).select("id", "site"), "id", "left")
    return own.join(per_site.withColumnRenamed("id", "site"), "site", how).select("id", *[c for c in per_site.columns if c != "id"])


def _subgraph(spark, sf):
    """The edges around every site of diversion targets, written once per session and input."""
    from ..operators import diversion as DV
    return base._stage(spark, "subgraph", sf, lambda: DV.local_subgraph(_places(spark, sf), network(spark, sf)))


def _sites(spark, sf):
    """(arcs, nodes) of the sites' subgraphs, written once per session and input."""
    from ..operators import diversion as DV
    arc = base._stage(spark, "site-arcs", sf, lambda: DV.arcs(_subgraph(spark, sf)))
    return arc, base._stage(spark, "site-nodes", sf, lambda: DV.site_nodes(_subgraph(spark, sf), arc))


def _subgraph_sql(query: str | None = None, more: list[str] = ()) -> str:
    from .oracle import SCORE, recommend_sql
    tg = ("tg AS (SELECT id, latitude AS ilat, longitude AS ilon FROM (" + recommend_sql(
        "(SELECT f.*, s.closure_prob FROM feat f LEFT JOIN score s USING (id) WHERE f.status = 'active')",
        "closure_prob", with_clearance=False) + ") r WHERE diversion_recommended AND latitude IS NOT NULL "
        "AND longitude IS NOT NULL)")
    box = ("bxw AS (SELECT DISTINCT tg.id, rp.way_id FROM tg JOIN rp ON "
           "rp.lat_e5 / 1e5 BETWEEN ilat - 2.0 / 110.574 AND ilat + 2.0 / 110.574 AND "
           "rp.lon_e5 / 1e5 BETWEEN ilon - 2.0 / (111.320 * cos(radians(ilat)) + 1e-9) "
           "AND ilon + 2.0 / (111.320 * cos(radians(ilat)) + 1e-9))")
    edges = ("we AS (SELECT way_id, m FROM (SELECT way_id, 1000.0 * (2 * 6371.0 * asin(sqrt(pow(sin(radians(lat2 - lat) "
             "/ 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2)))) AS m FROM ("
             "SELECT way_id, lat_e5 / 1e5 AS lat, lon_e5 / 1e5 AS lon, lead(lat_e5) OVER w / 1e5 AS lat2, "
             "lead(lon_e5) OVER w / 1e5 AS lon2 FROM rp WINDOW w AS (PARTITION BY way_id ORDER BY seq)) t "
             "WHERE lat2 IS NOT NULL) e WHERE m > 0)")
    if query:
        ed = edges.replace("we AS (SELECT way_id, m FROM", "ed AS (SELECT way_id, lat_i AS lat, lon_i AS lon, lat2_i AS lat2, lon2_i AS lon2, m FROM") \
            .replace("SELECT way_id, 1000.0", "SELECT way_id, lat_i, lon_i, lat2_i, lon2_i, 1000.0") \
            .replace("lat_e5 / 1e5 AS lat,", "lat_e5 AS lat_i, lon_e5 AS lon_i, lead(lat_e5) OVER w AS lat2_i, lead(lon_e5) OVER w AS lon2_i, lat_e5 / 1e5 AS lat,")
        return with_base(query, extra=NET + [SCORE, tg, box, ed, *more])
    return with_base("SELECT id, CAST(count(DISTINCT bxw.way_id) AS BIGINT) AS ways, CAST(count(*) AS BIGINT) AS edges, "
                     "round(sum(m), 1) AS metres FROM bxw JOIN we USING (way_id) GROUP BY id",
                     extra=NET + [SCORE, tg, box, edges])


@register("local_subgraph", _subgraph_sql())
def local_subgraph(spark, sf):
    sums = _subgraph(spark, sf).groupBy("id").agg(F.sum("ways").alias("ways"), F.sum("edges").alias("edges"), F.round(F.sum("metres"), 1).alias("metres"))
    return _of_targets(spark, sf, sums).distinct()


def _routes(spark, sf):
    """Routes of all diversion targets, planned once per session and input."""
    from ..operators import diversion as DV
    return base._stage(spark, "routes", sf, lambda: _of_targets(
        spark, sf, DV.plan_routes(_places(spark, sf), network(spark, sf)), "left"))


@register("diversion_route")
def diversion_route(spark, sf):
    return _routes(spark, sf)


_SITE = [
    "arc AS (SELECT id, u, v, min(m) AS m FROM (SELECT bxw.id, CAST(lat AS BIGINT) * 100000000 + lon AS u, "
    "CAST(lat2 AS BIGINT) * 100000000 + lon2 AS v, m FROM bxw JOIN ed USING (way_id) UNION ALL SELECT bxw.id, "
    "CAST(lat2 AS BIGINT) * 100000000 + lon2 AS u, CAST(lat AS BIGINT) * 100000000 + lon AS v, m FROM bxw JOIN ed USING (way_id)) t "
    "GROUP BY ALL)",
    "nd AS (SELECT DISTINCT arc.id, arc.u AS node, tg.ilat, tg.ilon, round(arc.u / 1e8) / 1e5 AS la, "
    "(arc.u - CAST(round(arc.u / 1e8) AS BIGINT) * 100000000) / 1e5 AS lo FROM arc JOIN tg USING (id))",
    "nw AS (SELECT *, 1000.0 * " + haversine_sql("ilat", "ilon", "la", "lo") + " AS away FROM nd)",
    "fs AS (SELECT id, arg_min(node, (away, node)) AS nearest, min(away) AS snap, count(*) AS n_nodes FROM nw GROUP BY id)",
    "sn AS (SELECT nw.*, nearest, snap, n_nodes, away <= 80.0 OR node = nearest AS shut FROM nw JOIN fs USING (id))",
    "xt AS (SELECT DISTINCT o.id, o.node, o.la, o.lo, o.ilat, o.ilon FROM arc JOIN sn c ON c.id = arc.id AND c.node = arc.u AND c.shut "
    "JOIN sn o ON o.id = arc.id AND o.node = arc.v AND NOT o.shut)",
    "xb AS (SELECT id, node, la, lo, (degrees(atan2(sin(radians(lo - ilon)) * cos(radians(la)), cos(radians(ilat)) * sin(radians(la)) "
    "- sin(radians(ilat)) * cos(radians(la)) * cos(radians(lo - ilon)))) + 360.0) % 360.0 AS bear FROM xt)",
    "pr AS (SELECT id, arg_min({'a': a, 'b': b, 'ala': ala, 'alo': alo, 'bla': bla, 'blo': blo}, (-gap, a, b)) AS p FROM (SELECT x.id, x.node AS a, y.node AS b, "
    "x.la AS ala, x.lo AS alo, y.la AS bla, y.lo AS blo, round(CASE WHEN abs(x.bear - y.bear) % 360.0 > 180.0 THEN 360.0 - "
    "abs(x.bear - y.bear) % 360.0 ELSE abs(x.bear - y.bear) % 360.0 END, 9) AS gap FROM xb x JOIN xb y ON x.id = y.id AND x.node < y.node) t GROUP BY id)",
]


def _site_sql(query: str) -> str:
    return _subgraph_sql(query, _SITE)


@register("closure_zone", _site_sql(
    "SELECT tg.id, CASE WHEN n_nodes >= 3 THEN round(round(nearest / 1e8) / 1e5, 5) END AS blocked_lat, CASE WHEN n_nodes >= 3 THEN "
    "round((nearest - CAST(round(nearest / 1e8) AS BIGINT) * 100000000) / 1e5, 5) END AS blocked_lon, "
    "CAST(coalesce(c.n_shut, 0) AS BIGINT) AS n_shut, CAST(coalesce(x.n_exits, 0) AS BIGINT) AS n_exits FROM tg LEFT JOIN fs USING (id) "
    "LEFT JOIN (SELECT id, count(*) AS n_shut FROM sn WHERE shut GROUP BY 1) c USING (id) "
    "LEFT JOIN (SELECT id, count(*) AS n_exits FROM xb GROUP BY 1) x USING (id)"))
def closure_zone(spark, sf):
    """Blocked point, shut nodes and exits of every diversion target."""
    from ..operators import diversion as DV
    arc, nodes = _sites(spark, sf)
    site = nodes.groupBy("id").agg(F.first("nearest").alias("nearest"), F.first("n_nodes").alias("n_nodes"),
                                   F.count_if("shut").alias("n_shut"))
    out = DV.exits(arc, nodes).groupBy("id").agg(F.count(F.lit(1)).alias("n_exits"))
    r = _of_targets(spark, sf, site.join(out, "id", "left"), "left")
    near = lambda f: F.when(F.col("n_nodes") >= 3, F.round(f(F.col("nearest")), 5))
    return r.select("id", near(DV.node_lat).alias("blocked_lat"), near(DV.node_lon).alias("blocked_lon"),
                    *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_shut", "n_exits")])


@register("diversion_exits", _site_sql(
    "SELECT id, p.ala AS entry_lat, p.alo AS entry_lon, p.bla AS exit_lat, p.blo AS exit_lon, round(1000.0 * "
    + haversine_sql("p.ala", "p.alo", "p.bla", "p.blo") + ", 1) AS direct_m FROM pr JOIN fs USING (id) WHERE n_nodes >= 3"))
def diversion_exits(spark, sf):
    """The pair of exits most opposite across the closure, and the straight distance between them."""
    from ..operators import diversion as DV
    arc, nodes = _sites(spark, sf)
    p = DV.exit_pair(DV.exits(arc, nodes)).filter("entry is not null").join(
        nodes.filter("n_nodes >= 3").select("id").distinct(), "id")
    at = {f"{e}_{n}": f(F.col(e)) for e in ("entry", "exit") for n, f in (("lat", DV.node_lat), ("lon", DV.node_lon))}
    p = p.select("id", *[c.alias(k) for k, c in at.items()])
    p = p.withColumn("direct_m", F.round(1000.0 * haversine_km(*[F.col(k) for k in at]), 1))
    return _of_targets(spark, sf, p).distinct()


@register("diversion_hull")
def diversion_hull(spark, sf):
    from ..operators import diversion as DV
    return DV.hulls(_routes(spark, sf), _diversion_targets(spark, sf))
