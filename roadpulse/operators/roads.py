"""Road network: way points, lane parsing, nearest-road join, graph edges.

The nearest-road join searches distinct places with a quadtree of cells in projected
metres: of the road points at one place one can be the nearest, incidents at one
place have the same nearest, and every place starts at the smallest cell around it
that holds a road.  Way points are whole 1e-5 degrees, so a smallest cell holds some
dozens of places, whatever the number of ways.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..session import cut_lineage


def lanes_parse(raw: Column) -> Column:
    """``"2;3"`` / ``"2,3"`` -> max integer part; any unparseable token -> NULL."""
    toks = F.split(F.regexp_replace(raw.cast("string"), ",", ";"), ";")
    nums = F.transform(toks, lambda t: t.try_cast("double"))
    ok = F.forall(nums, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e18))
    best = F.array_max(F.transform(nums, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))))
    return F.when(raw.isNotNull() & ok, best.cast("double"))


def road_points(points: DataFrame) -> DataFrame:
    """Way points with class rank (unknown class 0) and parsed lanes."""
    return (points.withColumn("lat", F.col("lat_e5") / 100000.0).withColumn("lon", F.col("lon_e5") / 100000.0)
                  .withColumn("road_class_rank", vocab.lookup(vocab.ROAD_CLASS_RANK, F.col("highway"), 0).cast("int"))
                  .withColumn("lanes", lanes_parse(F.col("lanes_raw"))))


def road_slim(elements: DataFrame) -> DataFrame:
    """Raw map-API elements -> slim ways: keep ``type = 'way'``, coords rounded to 5 dp, drop empty geometry."""
    w = elements.filter(F.col("type") == "way")
    g = F.transform(F.coalesce(F.col("geometry"), F.array()),
                    lambda p: F.array(F.round(p["lat"], 5), F.round(p["lon"], 5)))
    return (w.select(F.col("id").alias("way_id"), F.coalesce(F.col("tags.highway"), F.lit("")).alias("h"),
                     F.col("tags.lanes").alias("l"), g.alias("g"))
             .filter(F.size("g") > 0))


def ways_to_points(ways: DataFrame) -> DataFrame:
    """Slim ways (``way_id, h, l, g``) -> one row per point (``posexplode``)."""
    return ways.select("way_id", F.col("h").alias("highway"), F.col("l").alias("lanes_raw"),
                       F.posexplode("g").alias("seq", "p")).select(
        "way_id", "seq", "highway", "lanes_raw",
        F.round(F.col("p")[0] * 100000).cast("bigint").alias("lat_e5"),
        F.round(F.col("p")[1] * 100000).cast("bigint").alias("lon_e5"))


def _proj(df: DataFrame, lat: str, lon: str, lat0: Column, prefix: str) -> DataFrame:
    r = vocab.EARTH_RADIUS_M
    return (df.withColumn(f"{prefix}y", F.radians(F.col(lat)) * r)
              .withColumn(f"{prefix}x", F.radians(F.col(lon)) * r * F.cos(F.radians(lat0))))


FINEST = 16        # smallest cells of the search: max_m / FINEST metres


def _nearest(spots: DataFrame, rds: DataFrame, finest: float) -> DataFrame:
    """(spot, b): the nearest road place of each spot (spot, iy, ix), ties within a micrometre by way and point.

    Cells of level k have sides of ``finest * 4**k``.  All roads within one side lie in the 3 x 3
    cells around a spot; where the nearest is farther, the spot goes on to the next level,
    at last to cells that cover everything.
    """
    ext = rds.select(F.col("ry").alias("y"), F.col("rx").alias("x")).union(spots.select("iy", "ix")).agg(
        F.max(F.greatest(F.abs("y"), F.abs("x"))).alias("m")).first()
    top = max(0, math.ceil(math.log(max(ext["m"] or 0.0, finest) / finest, 4)))
    side = F.lit(float(finest)) * F.pow(F.lit(4.0), F.col("level"))
    cell = lambda y, x: [F.floor(c / side).cast("long").alias(n) for c, n in ((F.col(y), "cy"), (F.col(x), "cx"))]
    every = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")
    taken = rds.select("ry", "rx", every).select("level", *cell("ry", "rx")).distinct()
    start = (spots.select("*", every).select("spot", "level", *cell("iy", "ix")).join(taken, ["level", "cy", "cx"], "left_semi")
             .groupBy("spot").agg(F.min("level").alias("level")))
    pending = cut_lineage(spots.join(start, "spot", "left").fillna(top, ["level"]))
    found = []
    while True:
        around = pending.select("*", *cell("iy", "ix"))
        for c in ("cy", "cx"):
            around = around.withColumn(c, F.explode(F.array(*[F.col(c) + o for o in (-1, 0, 1)])))
        levels = pending.select("level").distinct()
        roads = rds.crossJoin(F.broadcast(levels)).select("*", *cell("ry", "rx"))
        cand = around.join(roads, ["level", "cy", "cx"]).withColumn(
            "d", F.sqrt(F.pow(F.col("iy") - F.col("ry"), 2) + F.pow(F.col("ix") - F.col("rx"), 2)))
        best = cand.groupBy("spot", "level").agg(F.min_by(F.struct("d", "way_id", "seq", "highway", "road_class_rank", "lanes"),
                                                          F.struct(F.round("d", 6), "way_id", "seq")).alias("b"))
        # a little below the side: a tie of the nearest is among the candidates too
        ok = cut_lineage(best.filter((F.col("b.d") <= 0.999 * side) | (F.col("level") == top)).select("spot", "b"))
        found.append(ok)
        # at the top level a spot without any candidate is done as well
        pending = cut_lineage(pending.filter(F.col("level") < top).join(ok.select("spot"), "spot", "left_anti")
                                     .withColumn("level", F.col("level") + 1))
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, found)


def road_places(roads: DataFrame) -> DataFrame:
    """Of the points at one place the first by way and point: no other can be the nearest."""
    first = F.min(F.struct("way_id", "seq", "highway", "lanes_raw")).alias("p")
    return roads.dropna(subset=["lat_e5", "lon_e5"]).groupBy("lat_e5", "lon_e5").agg(first).select("lat_e5", "lon_e5", "p.*")


def road_join(incidents: DataFrame, roads: DataFrame, max_m: float = vocab.ROAD_MATCH_MAX_M) -> DataFrame:
    """Nearest road point per incident; road attributes only within ``max_m``.

    Returns ``incidents`` + ``road_class, road_class_rank, lane_count,
    road_dist_m`` (distance kept for every located row; NULL without coords).
    """
    located = incidents.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    located = cut_lineage(located.select("id", "latitude", "longitude"))
    lat0 = cut_lineage(located.agg(F.avg("latitude").alias("__lat0")))
    rp = road_points(road_places(roads))
    rds = cut_lineage(_proj(rp.crossJoin(F.broadcast(lat0)), "lat", "lon", F.col("__lat0"), "r").select(
        "way_id", "seq", "highway", "road_class_rank", "lanes", "ry", "rx"))
    spots = located.select("latitude", "longitude").distinct().withColumn("spot", F.monotonically_increasing_id())
    spots = cut_lineage(_proj(spots.crossJoin(F.broadcast(lat0)), "latitude", "longitude", F.col("__lat0"), "i").drop("__lat0"))
    near = _nearest(spots.select("spot", "iy", "ix"), rds, max_m / FINEST).join(spots.select("spot", "latitude", "longitude"), "spot")
    # rows of one id share its nearest road
    found = (located.join(near.drop("spot"), ["latitude", "longitude"])
             .groupBy("id").agg(F.min_by("b", F.struct(F.round("b.d", 6), "b.way_id", "b.seq")).alias("b")))

    d = F.col("b.d")
    near = d <= max_m
    rank = F.when(near, F.col("b.road_class_rank")).otherwise(F.lit(0))
    default_lanes = vocab.map_lit({k: float(v) for k, v in vocab.DEFAULT_LANES_BY_RANK.items()})
    lanes = F.when(near, F.coalesce(F.col("b.lanes"), default_lanes[F.col("b.road_class_rank")])) \
        .otherwise(F.lit(float(vocab.DEFAULT_LANES_BY_RANK[0])))
    j = incidents.join(found, "id", "left")
    return (j.withColumn("road_class", F.when(near, F.col("b.highway")).otherwise(F.lit(vocab.UNMATCHED_ROAD_CLASS)))
             .withColumn("road_class_rank", F.coalesce(rank, F.lit(0)).cast("int"))
             .withColumn("lane_count", F.coalesce(lanes, F.lit(float(vocab.DEFAULT_LANES_BY_RANK[0]))))
             .withColumn("road_dist_m", F.rint(d * 10) / 10)
             .drop("b"))


def road_match_quality(joined: DataFrame, max_m: float = vocab.ROAD_MATCH_MAX_M) -> DataFrame:
    return joined.agg(F.count(F.lit(1)).alias("rows"),
                      F.count_if(F.col("road_dist_m") <= max_m).cast("bigint").alias("matched"),
                      F.round(F.avg((F.col("road_dist_m") <= max_m).cast("double")), 6).alias("match_share"),
                      F.round(F.avg("lane_count"), 6).alias("mean_lanes"),
                      F.round(F.avg("road_class_rank"), 6).alias("mean_rank"))


def road_edges(points: DataFrame) -> DataFrame:
    """Consecutive points of each way -> undirected edges in metres (zero-length dropped).

    Node identity is the integer micro-degree pair.  ``lead`` over each way is a
    per-way window: ways are short, so no partition is large.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("way_id").orderBy("seq")
    p = points.select("way_id", "seq", "lat_e5", "lon_e5",
                      F.lead("lat_e5").over(w).alias("lat2"), F.lead("lon_e5").over(w).alias("lon2"))
    from ..functions.geo import haversine_km
    e = (p.filter(F.col("lat2").isNotNull())
          .withColumn("m", haversine_km(F.col("lat_e5") / 1e5, F.col("lon_e5") / 1e5,
                                        F.col("lat2") / 1e5, F.col("lon2") / 1e5) * 1000.0)
          .filter(F.col("m") > 0))
    u = F.struct(F.col("lat_e5").alias("lat_e5"), F.col("lon_e5").alias("lon_e5"))
    v = F.struct(F.col("lat2").alias("lat_e5"), F.col("lon2").alias("lon_e5"))
    return e.select("way_id", F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), "m", "seq")
