"""Registered queries: planned events, calendar and roster."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions.geo import haversine_sql
from ..operators import analytics as A
from ..operators import planning as P
from ..operators import roster as RO
from ..session import prepare
from ..sources import fixtures
from ..sources.fixtures import _ZONE_NAMES
from . import base
from .catalog import register
from .oracle import CLEAR, in_list, q, recommend_sql, with_base

_TYPES = vocab.PLANNABLE_EVENTS + ["sports_event"]


def _cal_sql(dialect: str, orders: str) -> str:
    types = " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(_TYPES))
    zones = " ".join(f"WHEN {i} THEN {q(z)}" for i, z in enumerate(_ZONE_NAMES))
    if dialect == "spark":
        date = "date_format(date_add(DATE'2024-02-01', CAST(o_orderkey % 60 AS INT)), 'yyyy-MM-dd')"
        s = "STRING"
    else:
        date = "strftime(DATE '2024-02-01' + CAST(o_orderkey % 60 AS INTEGER), '%Y-%m-%d')"
        s = "VARCHAR"
    return f"""
SELECT CAST(o_orderkey AS BIGINT) AS cal_id,
  CASE WHEN o_orderkey % 97 = 0 THEN 'TBD' ELSE {date} END AS date,
  concat(lpad(CAST(o_orderkey % 24 AS {s}), 2, '0'), ':00') AS start_time,
  concat('Venue ', CAST(o_custkey AS {s})) AS venue,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS DOUBLE)
       ELSE CAST(12.8 AS DOUBLE) + ((o_custkey*7) % 41)*CAST(0.01 AS DOUBLE) END AS latitude,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS DOUBLE)
       ELSE CAST(77.4 AS DOUBLE) + ((o_custkey*11) % 43)*CAST(0.01 AS DOUBLE) END AS longitude,
  CASE o_orderkey % 6 {types} END AS event_type,
  CAST(CAST(o_totalprice AS BIGINT) % 10000 AS BIGINT) AS expected_attendance,
  o_orderpriority AS notes,
  CASE o_custkey % 16 {zones} END AS zone
FROM {orders}"""


def calendar(spark, sf):
    """Planned-event calendar derived from ``orders`` (one planned event per order)."""
    prepare(spark)
    o = fixtures.read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    return spark.sql(_cal_sql("spark", "{o}"), o=o)


CAL = "cal AS (" + _cal_sql("duckdb", "orders") + ")"


@register("calendar_read", with_base(
    "SELECT cal_id, TRY_CAST(date AS TIMESTAMP) AS date, event_type, zone FROM cal", upto="clean", extra=[CAL]))
def calendar_read(spark, sf):
    return P.calendar_read(calendar(spark, sf)).select("cal_id", "date", "event_type", "zone")


@register("upcoming_events", with_base(
    "SELECT cal_id, event_type, venue FROM cal WHERE CAST(TRY_CAST(date AS TIMESTAMP) AS DATE) = DATE '2024-02-15'",
    upto="clean", extra=[CAL]))
def upcoming_events(spark, sf):
    return P.upcoming_events(P.calendar_read(calendar(spark, sf)), "2024-02-15").select("cal_id", "event_type", "venue")


def _queries(spark, sf):
    c = P.calendar_read(calendar(spark, sf)).filter(F.col("date").isNotNull())
    return c.select(F.col("cal_id").alias("qid"), F.col("event_type").alias("cause"), "zone", "latitude",
                    "longitude", F.substring("start_time", 1, 2).cast("int").alias("hour"))


def _history(spark, sf):
    return base.features(spark, sf)


_AN = [
    CAL,
    "cq AS (SELECT cal_id AS qid, event_type AS cause, zone, latitude, longitude, "
    "CAST(substring(start_time, 1, 2) AS INTEGER) AS hour FROM cal WHERE TRY_CAST(date AS TIMESTAMP) IS NOT NULL)",
    "h AS (SELECT id, event_cause, zone, latitude, longitude, start_datetime, duration_minutes, road_closure_binary, "
    "severity_class FROM feat)",
    "nc AS (SELECT event_cause AS cause, count(*) AS n_cause FROM h GROUP BY 1)",
    "ncz AS (SELECT event_cause AS cause, zone, count(*) AS n_cz FROM h GROUP BY 1, 2)",
    "qq AS (SELECT q.*, coalesce(n_cause, 0) AS n_cause, coalesce(n_cz, 0) AS n_cz, CASE "
    "WHEN q.latitude IS NOT NULL AND q.longitude IS NOT NULL AND coalesce(n_cause, 0) > 0 THEN 'nearby' "
    "WHEN q.zone IS NOT NULL AND q.zone <> '' AND coalesce(n_cz, 0) >= 3 THEN 'type_in_zone' "
    "WHEN coalesce(n_cause, 0) >= 3 THEN 'type_citywide' ELSE 'similar_citywide' END AS tier "
    "FROM cq q LEFT JOIN nc USING (cause) LEFT JOIN ncz USING (cause, zone))",
    "near AS (SELECT qid, id, pool_rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, "
    "start_datetime, id) AS pool_rank FROM (SELECT qq.qid, h.id, h.start_datetime, "
    + haversine_sql("qq.latitude", "qq.longitude", "h.latitude", "h.longitude")
    + " AS d FROM qq JOIN h ON h.event_cause = qq.cause AND h.latitude IS NOT NULL AND h.longitude IS NOT NULL "
    "WHERE qq.tier = 'nearby') a) b WHERE pool_rank <= 10)",
    "pz AS (SELECT * FROM (SELECT event_cause AS cause, zone, id, row_number() OVER (PARTITION BY event_cause, zone "
    "ORDER BY start_datetime, id) AS pool_rank FROM h) t WHERE pool_rank <= 10)",
    "pc AS (SELECT * FROM (SELECT event_cause AS cause, id, row_number() OVER (PARTITION BY event_cause "
    "ORDER BY start_datetime, id) AS pool_rank FROM h) t WHERE pool_rank <= 25)",
    "ps AS (SELECT * FROM (SELECT id, row_number() OVER (ORDER BY start_datetime, id) AS pool_rank FROM h "
    f"WHERE event_cause IN {in_list(vocab.PLANNABLE_EVENTS)}) t WHERE pool_rank <= 25)",
    "pool AS (SELECT qid, id, pool_rank FROM near UNION ALL "
    "SELECT qq.qid, pz.id, pz.pool_rank FROM qq JOIN pz ON pz.cause = qq.cause AND pz.zone = qq.zone "
    "WHERE qq.tier = 'type_in_zone' UNION ALL "
    "SELECT qq.qid, pc.id, pc.pool_rank FROM qq JOIN pc ON pc.cause = qq.cause WHERE qq.tier = 'type_citywide' "
    "UNION ALL SELECT qq.qid, ps.id, ps.pool_rank FROM qq, ps WHERE qq.tier = 'similar_citywide')",
    "pj AS (SELECT pool.qid, pool.pool_rank, h.* FROM pool JOIN h USING (id))",
    "sm AS (SELECT qid, min_by(severity_class, (-n, severity_class)) AS smode FROM (SELECT qid, severity_class, "
    "count(*) AS n FROM pj WHERE severity_class IS NOT NULL GROUP BY 1, 2) t GROUP BY 1)",
    "su AS (SELECT qid, count(*) AS found, quantile_cont(duration_minutes, [0.25, 0.5, 0.75]) AS qs, "
    "avg(road_closure_binary) AS cr, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pool_rank) "
    "FILTER (WHERE pool_rank <= 8) AS sample_ids FROM pj GROUP BY qid)",
    "an AS (SELECT qq.qid, qq.cause, qq.zone, qq.hour, CASE WHEN coalesce(found, 0) > 0 THEN tier ELSE 'none' END AS tier, "
    "CAST(coalesce(found, 0) AS BIGINT) AS found, CASE WHEN coalesce(found, 0) = 0 THEN 'none' "
    "WHEN found >= 8 AND tier IN ('nearby', 'type_in_zone') THEN 'high' "
    "WHEN found >= 8 OR (found >= 3 AND tier IN ('nearby', 'type_in_zone')) THEN 'medium' ELSE 'low' END "
    "AS confidence, CASE WHEN coalesce(found, 0) > 0 THEN coalesce(smode, 'Medium') END AS expected_severity, "
    "round_even(qs[2], 0) AS median_clearance, round_even(qs[1], 0) AS p25_clearance, "
    "round_even(qs[3], 0) AS p75_clearance, round_even(cr * 100, 0) AS closure_rate, sample_ids "
    "FROM qq LEFT JOIN su USING (qid) LEFT JOIN sm USING (qid))",
]

_AN_COLS = ("qid, cause, zone, tier, found, confidence, expected_severity, median_clearance, p25_clearance, "
            "p75_clearance, closure_rate, sample_ids")


@register("analogs", with_base(f"SELECT {_AN_COLS} FROM an", extra=_AN))
def analogs(spark, sf):
    return P.analogs(_queries(spark, sf), _history(spark, sf))


@register("analog_confidence", with_base(
    "SELECT tier, confidence, CAST(count(*) AS BIGINT) AS queries FROM an GROUP BY 1, 2", extra=_AN))
def analog_confidence(spark, sf):
    a = P.analogs(_queries(spark, sf), _history(spark, sf))
    return a.groupBy("tier", "confidence").agg(F.count(F.lit(1)).alias("queries"))


_PLAN_SRC = ("(SELECT qid, cause, coalesce(zone, 'Unknown') AS zone, coalesce(expected_severity, 'Medium') AS "
             "severity_class, closure_rate / 100.0 AS closure_prob, cause AS event_cause, hour AS hour_of_day, "
             "0 AS road_closure_binary, confidence FROM an)")
_PLAN_COLS = ("qid, severity_class, confidence, closure_prob, personnel_count, barricade_required, "
              "diversion_recommended, dispatch_from, estimated_clearance_minutes, is_obstruction")


@register("plan_calendar", with_base(
    f"SELECT {_PLAN_COLS} FROM (SELECT *, cause IN {in_list(vocab.PLANNED_OBSTRUCTIONS)} AS is_obstruction "
    f"FROM ({recommend_sql(_PLAN_SRC, 'closure_prob')}) r) t", extra=_AN + [CLEAR]))
def plan_calendar(spark, sf):
    """The planner over every dated calendar row: analogs -> severity/closure forecast -> deployment."""
    stats = A.clearance_stats(base.features(spark, sf))
    p = P.plan_events(_queries(spark, sf), _history(spark, sf), stats)
    return p.select(*[c.strip() for c in _PLAN_COLS.split(",")])


@register("plan_event", with_base(
    f"SELECT {_PLAN_COLS} FROM (SELECT *, cause IN {in_list(vocab.PLANNED_OBSTRUCTIONS)} AS is_obstruction "
    f"FROM ({recommend_sql(_PLAN_SRC, 'closure_prob')}) r) t WHERE qid IN (SELECT cal_id FROM cal "
    "WHERE CAST(TRY_CAST(date AS TIMESTAMP) AS DATE) = DATE '2024-02-15')", extra=_AN + [CLEAR]))
def plan_event(spark, sf):
    """Plans for one day's events (the calendar rows of 2024-02-15)."""
    stats = A.clearance_stats(base.features(spark, sf))
    day = P.upcoming_events(P.calendar_read(calendar(spark, sf)), "2024-02-15").select(F.col("cal_id").alias("qid"))
    p = P.plan_events(_queries(spark, sf).join(day, "qid", "left_semi"), _history(spark, sf), stats)
    return p.select(*[c.strip() for c in _PLAN_COLS.split(",")])


# --- roster ------------------------------------------------------------------------

_FIRST = {z: s[0] for z, s in vocab.ZONE_STATIONS.items()}
_STATION_SQL = ("coalesce(CASE zone " + " ".join(f"WHEN {q(z)} THEN {q(s)}" for z, s in _FIRST.items())
                + f" END, {q(vocab.ZONE_STATIONS[vocab.FALLBACK_ZONE][0])})")
OVERRIDES = [("Cubbon Park", 1), ("Hebbala", 2), ("Peenya", 10)]
_ST = [f"st AS (SELECT {_STATION_SQL} AS station, avg(latitude) AS slat, avg(longitude) AS slon FROM feat "
       "WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND zone IS NOT NULL GROUP BY 1)",
       "cap AS (SELECT station, CAST(coalesce(o.capacity, 6) AS INTEGER) AS capacity FROM st LEFT JOIN (VALUES "
       + ", ".join(f"({q(s)}, {c})" for s, c in OVERRIDES) + ") o(station, capacity) USING (station))"]


def _stations(spark, sf):
    return P.station_centroids(base.features(spark, sf))


def _capacity(spark, sf):
    ov = spark.createDataFrame(OVERRIDES, "station string, capacity int")
    return P.roster_capacity(_stations(spark, sf), ov)


@register("station_centroids", with_base("SELECT station, round(slat, 6) AS slat, round(slon, 6) AS slon FROM st",
                                         extra=_ST))
def station_centroids(spark, sf):
    s = _stations(spark, sf)
    return s.select("station", F.round("slat", 6).alias("slat"), F.round("slon", 6).alias("slon"))


@register("roster_capacity", with_base("SELECT * FROM cap", extra=_ST))
def roster_capacity(spark, sf):
    return _capacity(spark, sf)


_SCEN = [f"sc0 AS (SELECT *, CAST(date_trunc('hour', start_datetime) AS TIMESTAMP) AS \"window\", "
         "CAST(hour(date_trunc('hour', start_datetime)) AS INTEGER) AS hod FROM feat WHERE status = 'active' "
         "AND latitude IS NOT NULL AND longitude IS NOT NULL AND start_datetime IS NOT NULL)",
         "scn AS (SELECT \"window\", id, latitude, longitude, zone, event_cause, severity_class, personnel_count AS demand, "
         "dispatch_from AS nearest_station, priority_flag AS priority FROM ("
         + recommend_sql("(SELECT * EXCLUDE (hour_of_day), hod AS hour_of_day FROM sc0)", None, with_clearance=False)
         + ") r)"]


def _scenario(spark, sf):
    return P.scenario(base.features(spark, sf), "hour")


@register("scenario", with_base("SELECT * FROM scn", extra=_SCEN))
def scenario(spark, sf):
    return _scenario(spark, sf)


@register("busiest_windows", with_base(
    "SELECT \"window\", CAST(count(*) AS BIGINT) AS events FROM scn GROUP BY 1 ORDER BY events DESC, \"window\" LIMIT 15",
    extra=_SCEN))
def busiest_windows(spark, sf):
    return P.busiest_windows(_scenario(spark, sf))


@register("roster_totals", with_base(
    "SELECT \"window\", severity, CAST(demand AS BIGINT) AS demand, CAST(least(demand, greatest(capacity - before, 0)) "
    "AS BIGINT) AS sent, CAST(demand - least(demand, greatest(capacity - before, 0)) AS BIGINT) AS short FROM ("
    "SELECT *, coalesce(sum(demand) OVER (PARTITION BY \"window\" ORDER BY CASE severity WHEN 'High' THEN 0 "
    "WHEN 'Medium' THEN 1 ELSE 2 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ("
    "SELECT \"window\", severity_class AS severity, sum(demand) AS demand, (SELECT sum(capacity) FROM cap) AS capacity "
    "FROM scn GROUP BY 1, 2) g) t", extra=_ST + _SCEN))
def roster_totals(spark, sf):
    tot = _capacity(spark, sf).agg(F.sum("capacity").alias("capacity"))
    return P.roster_totals(_scenario(spark, sf), tot)


def _alloc(spark, sf):
    """The scenario and its allocation (one auction per session and input)."""
    scen = _scenario(spark, sf)
    return scen, base._stage(spark, "roster", sf, lambda: RO.roster_allocate(scen, _stations(spark, sf), _capacity(spark, sf)))


def _least_cost_sql(n_stations: int, n_events: int = 3) -> str:
    """Least cost per window by trying every split of one station's officers after the other (windows of a few events)."""
    ev = range(1, n_events + 1)
    left = ", ".join(f"r{i}" for i in ev)
    steps = ["f0 AS (SELECT \"window\", " + ", ".join(f"d{i} AS r{i}" for i in ev) + ", CAST(0 AS BIGINT) AS cost FROM we)"]
    for k in range(1, n_stations + 1):
        splits = " ".join(f"JOIN range(0, 1 + (SELECT max(capacity) FROM stc)) t{i}(x{i}) ON x{i} <= r{i}" for i in ev)
        steps.append(f"f{k} AS (SELECT f.\"window\", " + ", ".join(f"r{i} - x{i} AS r{i}" for i in ev) + ", min(cost + "
                     + " + ".join(f"x{i} * coalesce(c{i}, 0)" for i in ev) + f") AS cost FROM f{k - 1} f JOIN wc ON wc.\"window\" = f.\"window\" "
                     f"AND wc.k = {k} {splits} WHERE {' + '.join(f'x{i}' for i in ev)} <= capacity GROUP BY ALL)")
    steps.append("lc AS (SELECT f.\"window\", min(cost + " + " + ".join(f"r{i} * coalesce(p{i}, 0)" for i in ev)
                 + f") AS cost FROM f{n_stations} f JOIN we USING (\"window\") GROUP BY 1)")
    pivot = ", ".join(f"coalesce(max(demand) FILTER (WHERE n = {i}), 0) AS d{i}, max(penalty) FILTER (WHERE n = {i}) AS p{i}" for i in ev)
    costs = ", ".join(f"max(cost) FILTER (WHERE n = {i}) AS c{i}" for i in ev)
    return ", ".join([
        "stc AS (SELECT station, slat, slon, capacity, row_number() OVER (ORDER BY station) AS k FROM st JOIN cap USING (station) WHERE capacity > 0)",
        "en AS (SELECT *, row_number() OVER (PARTITION BY \"window\" ORDER BY id) AS n, CASE severity_class "
        + " ".join(f"WHEN {q(s)} THEN {p}" for s, p in vocab.UNMET_PENALTY.items()) + f" ELSE {vocab.UNMET_PENALTY['Medium']} END AS penalty FROM scn WHERE demand > 0)",
        f"we AS (SELECT \"window\", {pivot} FROM en GROUP BY 1)",
        f"wc AS (SELECT \"window\", k, capacity, {costs} FROM (SELECT *, CAST(round(10 * " + haversine_sql("slat", "slon", "latitude", "longitude")
        + ") AS BIGINT) AS cost FROM en, stc) x GROUP BY 1, 2, 3)", *steps])


@register("roster_allocate")
def roster_allocate(spark, sf):
    return _alloc(spark, sf)[1]


@register("roster_cost", with_base("SELECT \"window\", CAST(cost AS BIGINT) AS cost FROM lc", extra=_ST + _SCEN + [
    _least_cost_sql(len(set(_FIRST.values())))]))
def roster_cost(spark, sf):
    """Per window: the least total of travel and unmet demand."""
    scen, alloc = _alloc(spark, sf)
    return RO.roster_cost(scen, alloc).select("window", "cost")


# what every least-cost allocation has in common: officers run out for Low, then Medium, then High events
_SENT = ["tt AS (SELECT \"window\", severity, demand, least(demand, greatest(capacity - before, 0)) AS sent FROM ("
         "SELECT *, coalesce(sum(demand) OVER (PARTITION BY \"window\" ORDER BY CASE severity WHEN 'High' THEN 0 "
         "WHEN 'Medium' THEN 1 ELSE 2 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ("
         "SELECT \"window\", severity_class AS severity, sum(demand) AS demand, (SELECT sum(capacity) FROM cap) AS capacity "
         "FROM scn GROUP BY 1, 2) g) t)"]


@register("roster_table")
def roster_table(spark, sf):
    scen, alloc = _alloc(spark, sf)
    return RO.roster_event_table(scen, alloc)


@register("roster_kpis")
def roster_kpis(spark, sf):
    scen, alloc = _alloc(spark, sf)
    return RO.roster_kpis(RO.roster_event_table(scen, alloc))


@register("roster_shortage", with_base(
    "SELECT \"window\", round(100.0 * sum(sent) / sum(demand), 6) AS pct_demand_met, CAST(sum(demand - sent) AS BIGINT) AS shortage "
    "FROM tt GROUP BY 1", extra=_ST + _SCEN + _SENT))
def roster_shortage(spark, sf):
    """The part of the KPIs that every least-cost allocation shares."""
    return roster_kpis(spark, sf).select("window", "pct_demand_met", "shortage")


@register("severity_alloc_unpivot", with_base(
    "SELECT \"window\", severity AS severity_class, kind, CAST(officers AS BIGINT) AS officers FROM (SELECT \"window\", severity, 'sent' AS kind, "
    "sent AS officers FROM tt UNION ALL SELECT \"window\", severity, 'short' AS kind, demand - sent AS officers FROM tt) t",
    extra=_ST + _SCEN + _SENT))
def severity_alloc_unpivot(spark, sf):
    scen, alloc = _alloc(spark, sf)
    return RO.severity_alloc_unpivot(RO.roster_event_table(scen, alloc))
