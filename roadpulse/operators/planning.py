"""Planned events: case retrieval (analogs), planner, calendar, roster.

Retrieval runs for a *table* of planned-event queries at once.  Pools that do
not depend on the query location (zone / citywide tiers) are computed once per
key with a skew-safe two-phase top-k; the location tier is an exact k-nearest
join by expanding cell rings.
"""

from __future__ import annotations

import datetime as _dt
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.geo import haversine_km
from ..session import cut_lineage
from .decide import recommend, station_for


# --------------------------------------------------------------------------
# generic helpers
# --------------------------------------------------------------------------

def topk_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, salt: int = 64) -> DataFrame:
    """Exact top-k rows per group in two phases (salted local top-k, then merge).

    A hot group is split over ``salt`` partitions in phase one, so no task ever
    sorts more than one salt slice of a group; phase two sees <= k*salt rows per group.
    """
    s = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns[:1]]), F.lit(salt)))
    w1 = Window.partitionBy(*keys, "__salt").orderBy(*order)
    s = s.withColumn("__r1", F.row_number().over(w1)).filter(F.col("__r1") <= k)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return s.withColumn("pool_rank", F.row_number().over(w2)).filter(F.col("pool_rank") <= k) \
        .drop("__salt", "__r1")


FINEST_KM = 0.05        # side of the smallest cells of the search grid


def knn_join(queries: DataFrame, points: DataFrame, keys: list[str], k: int, metric: str = "haversine",
             exclude_self: bool = False) -> DataFrame:
    """Exact k nearest ``points`` (ties by start, then id) per query with equal ``keys``: ``qid, pid, distance_km, pool_rank``.

    * Places, not rows, are searched: of the points at one place and key only the first
      k can be among a query's nearest, and queries at one place have the same nearest.
      So a place with a third of all rows is one row, its points are cut to k before a
      shuffle.
    * The grid is a quadtree: each place of queries starts at the smallest cell around it
      that holds k points, so that dense areas are searched with small cells.
    * Every point within one side of a cell lies in the 3 x 3 cells around the query; if
      there are k within that distance the search is over, else it goes on with cells
      twice as large, at last with one that covers everything.
    * Of the candidates, places are kept while those strictly nearer hold less than k points.
    """
    need = k + exclude_self
    spots = [*keys, "latitude", "longitude"]
    q = queries.select("qid", *spots).dropna(subset=["latitude", "longitude"])
    p = points.select("pid", *spots, "start_datetime").dropna(subset=["latitude", "longitude"])
    ext = p.select("latitude", "longitude").union(q.select("latitude", "longitude")).agg(
        F.min("latitude").alias("a"), F.max("latitude").alias("b"), F.min("longitude").alias("c"), F.max("longitude").alias("d"),
        F.max(F.abs("latitude")).alias("m")).first()
    if ext["a"] is None:
        return queries.sparkSession.createDataFrame([], "qid long, pid long, distance_km double, pool_rank int")
    coslat = max(math.cos(math.radians(min(ext["m"] + 1.0, 89.0))), 1e-3)
    span = max((ext["b"] - ext["a"]) * 111.2, (ext["d"] - ext["c"]) * 111.2) + 1.0
    levels = max(0, math.floor(math.log2(span / FINEST_KM)))
    side = F.lit(span) / F.pow(F.lit(2.0), F.col("level"))
    # euclidean distance in degrees: cells of side/111 degrees
    dlat, dlon = (side / 111.0, side / 111.0) if metric == "euclid_deg" else (side / 110.0, side / (111.4 * coslat))
    row, col = F.floor(F.col("latitude") / dlat).cast("long"), F.floor(F.col("longitude") / dlon).cast("long")
    in_cells = lambda df: df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("row", row).withColumn("col", col)
    cell = [*keys, "level", "row", "col"]

    at_place = Window.partitionBy(*spots).orderBy("start_datetime", "pid")
    held = cut_lineage(p.withColumn("n", F.row_number().over(at_place)).filter(F.col("n") <= need).drop("n"))
    placed = cut_lineage(in_cells(held.groupBy(*spots).agg(F.count(F.lit(1)).alias("n"))))
    full = placed.groupBy(*cell).agg(F.sum("n").alias("n")).filter(F.col("n") >= need)
    asked = cut_lineage(q.select(*spots).distinct().withColumn("spot", F.monotonically_increasing_id()))
    start = in_cells(asked).join(full, cell, "left_semi").groupBy("spot").agg(F.max("level").alias("level"))
    pending = cut_lineage(asked.join(start, "spot", "left").fillna(0, ["level"]))
    theirs = placed.select(*cell, "n", F.col("latitude").alias("plat"), F.col("longitude").alias("plon"))
    found = []
    while not pending.isEmpty():
        around = pending.withColumn("row", row).withColumn("col", col)
        for c in ("row", "col"):
            around = around.withColumn(c, F.explode(F.array(*[F.col(c) + o for o in (-1, 0, 1)])))
        if metric == "euclid_deg":
            dist, reach = F.sqrt(F.pow(F.col("latitude") - F.col("plat"), 2) + F.pow(F.col("longitude") - F.col("plon"), 2)), 0.99 * side / 111.0
        else:
            dist, reach = haversine_km(F.col("latitude"), F.col("longitude"), F.col("plat"), F.col("plon")), 0.99 * side
        cand = around.join(theirs, cell).withColumn("distance_km", dist)
        inside = F.sum(F.when(F.col("distance_km") <= reach, F.col("n")).otherwise(0))
        sure = cand.groupBy("spot", "level").agg(inside.alias("n")).filter((F.col("n") >= need) | (F.col("level") == 0)).select("spot")
        near = Window.partitionBy("spot").orderBy("distance_km").rangeBetween(Window.unboundedPreceding, 0)
        peers = Window.partitionBy("spot", "distance_km")
        kept = (cand.join(sure, "spot", "left_semi").withColumn("nearer", F.sum("n").over(near) - F.sum("n").over(peers))
                    .filter(F.col("nearer") < need))
        kept = cut_lineage(kept.select("spot", *keys, "plat", "plon", "distance_km"))
        found.append(kept)
        # at level 0 a spot without any candidate is done as well
        pending = cut_lineage(pending.filter("level > 0").join(kept.select("spot").distinct(), "spot", "left_anti")
                                     .withColumn("level", F.col("level") - 1))
    if not found:
        return queries.sparkSession.createDataFrame([], "qid long, pid long, distance_km double, pool_rank int")
    places = reduce(DataFrame.unionByName, found)
    theirs = held.withColumnsRenamed({"latitude": "plat", "longitude": "plon"})
    first = Window.partitionBy("spot").orderBy("distance_km", "start_datetime", "pid")
    of_spot = (places.join(theirs, [*keys, "plat", "plon"]).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= need)
                     .select("spot", "pid", "distance_km", "start_datetime"))
    own = q.join(asked, spots).select("qid", "spot").join(of_spot, "spot")
    if exclude_self:
        own = own.filter(F.col("pid") != F.col("qid"))
    rank = Window.partitionBy("qid").orderBy("distance_km", "start_datetime", "pid")
    return own.withColumn("pool_rank", F.row_number().over(rank)).filter(F.col("pool_rank") <= k).select(
        "qid", "pid", "distance_km", "pool_rank")


# --------------------------------------------------------------------------
# analogs
# --------------------------------------------------------------------------

def analog_confidence(found: Column, local: Column) -> Column:
    return (F.when(found == 0, "none").when((found >= 8) & local, "high")
             .when((found >= 8) | ((found >= 3) & local), "medium").otherwise("low"))


def analogs(queries: DataFrame, history: DataFrame, k: int = 10, samples: int = 8) -> DataFrame:
    """Case retrieval for every query row ``(qid, cause, zone, latitude, longitude)``.

    ``history``: ``id, event_cause, zone, latitude, longitude, start_datetime,
    duration_minutes, road_closure_binary, severity_class``.

    Queries of equal cause, zone and place have the same answer, so each such question is
    answered once and joined back.  Rows that share a qid, or have none, are answered
    together, by that qid.
    """
    q = queries.select("qid", "cause", "zone", "latitude", "longitude")
    shared = cut_lineage(q.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("qid").isNull())
                          .select(F.col("qid").alias("__qid")))
    none_shared = shared.isEmpty()
    same = F.col("qid").eqNullSafe(F.col("__qid"))
    single = q if none_shared else q.join(shared, same, "left_anti")
    asked = ["cause", "zone", "latitude", "longitude"]
    asks = cut_lineage(single.select(*asked).distinct().withColumn("qid", F.monotonically_increasing_id()))
    answers = _answers(asks, history, k, samples)
    theirs = asks.select("qid", *[F.col(c).alias(f"__{c}") for c in asked]).join(answers.drop("cause", "zone"), "qid").drop("qid")
    found = single.join(theirs, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in asked]).select(*answers.columns)
    return found if none_shared else found.unionByName(_answers(q.join(shared, same, "left_semi"), history, k, samples))


def _answers(queries: DataFrame, history: DataFrame, k: int, samples: int) -> DataFrame:
    """The answers of ``analogs`` to each query row, by qid."""
    h = cut_lineage(history.select("id", "event_cause", "zone", "latitude", "longitude", "start_datetime",
                                   "duration_minutes", "road_closure_binary", "severity_class"))
    q = queries.select("qid", "cause", "zone", "latitude", "longitude")
    big = max(k, 25)
    n_cause = h.groupBy(F.col("event_cause").alias("cause")).agg(F.count(F.lit(1)).alias("n_cause"))
    n_cz = h.groupBy(F.col("event_cause").alias("cause"), "zone").agg(F.count(F.lit(1)).alias("n_cz"))
    qq = (q.join(F.broadcast(n_cause), "cause", "left").join(n_cz, ["cause", "zone"], "left")
           .fillna(0, ["n_cause", "n_cz"]))
    has_xy = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    tier = (F.when(has_xy & (F.col("n_cause") > 0), "nearby")
             .when(F.col("zone").isNotNull() & (F.col("zone") != "") & (F.col("n_cz") >= vocab.ANALOG_MIN_LOCAL),
                   "type_in_zone")
             .when(F.col("n_cause") >= vocab.ANALOG_MIN_LOCAL, "type_citywide")
             .otherwise("similar_citywide"))
    qq = cut_lineage(qq.withColumn("tier", tier))

    order = [F.col("start_datetime"), F.col("id")]
    # nearby: exact kNN among same-cause located events
    near_q = qq.filter(F.col("tier") == "nearby").select("qid", F.col("cause").alias("event_cause"),
                                                         "latitude", "longitude")
    near_p = h.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).withColumnRenamed("id", "pid")
    near = knn_join(near_q, near_p, ["event_cause"], k).select("qid", F.col("pid").alias("id"), "pool_rank",
                                                               "distance_km")
    # zone / citywide / similar pools: computed once per key
    pz = topk_per_group(h, ["event_cause", "zone"], order, k).select(
        F.col("event_cause").alias("cause"), "zone", "id", "pool_rank")
    pc = topk_per_group(h, ["event_cause"], order, big).select(F.col("event_cause").alias("cause"), "id", "pool_rank")
    ps = topk_per_group(h.filter(F.col("event_cause").isin(vocab.PLANNABLE_EVENTS)).withColumn("__all", F.lit(1)),
                        ["__all"], order, big).select("id", "pool_rank")
    zq = qq.filter(F.col("tier") == "type_in_zone").select("qid", "cause", "zone").join(pz, ["cause", "zone"]) \
        .select("qid", "id", "pool_rank", F.lit(None).cast("double").alias("distance_km"))
    cq = qq.filter(F.col("tier") == "type_citywide").select("qid", "cause").join(pc, "cause") \
        .select("qid", "id", "pool_rank", F.lit(None).cast("double").alias("distance_km"))
    sq = qq.filter(F.col("tier") == "similar_citywide").select("qid").crossJoin(F.broadcast(ps)) \
        .select("qid", "id", "pool_rank", F.lit(None).cast("double").alias("distance_km"))
    pool = near.unionByName(zq).unionByName(cq).unionByName(sq).join(h, "id")

    sev_mode = (pool.filter(F.col("severity_class").isNotNull()).groupBy("qid", "severity_class")
                    .agg(F.count(F.lit(1)).alias("__n"))
                    .groupBy("qid").agg(F.min_by("severity_class", F.struct(-F.col("__n"), F.col("severity_class")))
                                         .alias("__mode")))
    pct = F.percentile(F.col("duration_minutes"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    summ = pool.groupBy("qid").agg(
        F.count(F.lit(1)).alias("found"), pct.alias("__q"),
        F.avg("road_closure_binary").alias("__cr"),
        F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("pool_rank", "id"))), 1, samples),
                                 lambda s: s["id"].cast("string")), ",").alias("sample_ids"))
    out = (qq.join(summ, "qid", "left").join(sev_mode, "qid", "left").fillna(0, ["found"]))
    local = F.col("tier").isin("nearby", "type_in_zone") & (F.col("found") > 0)
    return out.select(
        "qid", "cause", "zone", F.when(F.col("found") > 0, F.col("tier")).otherwise(F.lit("none")).alias("tier"),
        F.col("found").cast("bigint").alias("found"),
        analog_confidence(F.col("found"), local).alias("confidence"),
        F.when(F.col("found") > 0, F.coalesce(F.col("__mode"), F.lit("Medium"))).alias("expected_severity"),
        F.bround(F.col("__q")[1], 0).alias("median_clearance"), F.bround(F.col("__q")[0], 0).alias("p25_clearance"),
        F.bround(F.col("__q")[2], 0).alias("p75_clearance"),
        F.bround(F.col("__cr") * 100, 0).alias("closure_rate"), "sample_ids")


def plan_events(queries: DataFrame, history: DataFrame, stats: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Analogs -> expected severity + closure likelihood -> deployment recommendation, per query.

    ``queries`` also carries ``hour`` (planned start hour).
    """
    a = analogs(queries, history, k)
    d = (a.join(queries.select("qid", "hour"), "qid")
          .withColumn("severity_class", F.coalesce(F.col("expected_severity"), F.lit("Medium")))
          .withColumn("closure_prob", F.col("closure_rate") / 100.0)
          .withColumn("event_cause", F.col("cause")).withColumn("hour_of_day", F.col("hour"))
          .withColumn("road_closure_binary", F.lit(0))
          .withColumn("zone", F.coalesce(F.col("zone"), F.lit("Unknown"))))
    r = recommend(d, stats, prob_col="closure_prob")
    return r.withColumn("is_obstruction", F.col("cause").isin(vocab.PLANNED_OBSTRUCTIONS))


# --------------------------------------------------------------------------
# calendar
# --------------------------------------------------------------------------

def calendar_read(df: DataFrame) -> DataFrame:
    """Validate a calendar table: needs ``date`` and ``event_type``; unparseable dates -> NULL."""
    missing = [c for c in ("date", "event_type") if c not in df.columns]
    if missing:
        raise ValueError(f"calendar missing columns: {missing}")
    return df.withColumn("date", F.try_to_timestamp(F.col("date").cast("string")).cast("timestamp_ntz"))


def upcoming_events(cal: DataFrame, on_date: str) -> DataFrame:
    try:
        d = _dt.date.fromisoformat(on_date)
    except ValueError:
        return cal.limit(0)
    return cal.filter(F.to_date("date") == F.lit(d))


# --------------------------------------------------------------------------
# roster
# --------------------------------------------------------------------------

def station_centroids(df: DataFrame) -> DataFrame:
    pts = df.dropna(subset=["latitude", "longitude", "zone"])
    return (pts.groupBy(station_for(F.col("zone")).alias("station"))
               .agg(F.avg("latitude").alias("slat"), F.avg("longitude").alias("slon")))


def roster_capacity(stations: DataFrame, overrides: DataFrame | None = None,
                    default: int = vocab.DEFAULT_OFFICERS_PER_STATION) -> DataFrame:
    s = stations.select("station")
    if overrides is not None:
        s = s.join(F.broadcast(overrides), "station", "left")
    else:
        s = s.withColumn("capacity", F.lit(None).cast("int"))
    return s.select("station", F.coalesce(F.col("capacity"), F.lit(default)).cast("int").alias("capacity"))


def scenario(df: DataFrame, window: str = "hour", status: str = "active") -> DataFrame:
    """Every window's located events with demand, nearest station and priority (all windows at once)."""
    pool = df.filter((F.col("status") == status) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
                     & F.col("start_datetime").isNotNull())
    pool = pool.withColumn("window", F.date_trunc(window, "start_datetime").cast("timestamp_ntz"))
    r = recommend(pool.withColumn("hour_of_day", F.hour("window")))
    return r.select("window", "id", "latitude", "longitude", "zone", "event_cause", "severity_class",
                    F.col("personnel_count").alias("demand"), F.col("dispatch_from").alias("nearest_station"),
                    F.col("priority_flag").alias("priority"))


def busiest_windows(scen: DataFrame, k: int = 15) -> DataFrame:
    return (scen.groupBy("window").agg(F.count(F.lit(1)).alias("events"))
                .orderBy(F.desc("events"), F.asc("window")).limit(k))


def roster_totals(scen: DataFrame, capacity_total: DataFrame) -> DataFrame:
    """Closed form of the min-cost flow totals: met = min(demand, capacity); shortfall
    lands on Low, then Medium, then High (penalties dominate travel cost)."""
    order = vocab.map_lit({"Low": 0, "Medium": 1, "High": 2})
    g = (scen.groupBy("window", F.col("severity_class").alias("severity"))
             .agg(F.sum("demand").alias("demand"))
             .crossJoin(F.broadcast(capacity_total)))
    w = Window.partitionBy("window").orderBy(F.desc(order[F.col("severity")]))  # High first
    g = g.withColumn("__before", F.coalesce(F.sum("demand").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                            F.lit(0)))
    met = F.least(F.col("demand"), F.greatest(F.col("capacity") - F.col("__before"), F.lit(0)))
    return g.select("window", "severity", F.col("demand").cast("bigint").alias("demand"),
                    met.cast("bigint").alias("sent"), (F.col("demand") - met).cast("bigint").alias("short"))
