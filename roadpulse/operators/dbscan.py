"""Exact DBSCAN (haversine eps, min_samples incl. self) as Spark jobs.

Plan
----
1. **Fine grid.**  Cell side ``a = 0.999 * eps / (2R)`` radians.  Two points in
   one cell are closer than ``R*(dphi + dlambda) <= 2Ra < eps``, so every cell
   is a clique of the eps-graph.
2. **Core points.**  A cell with ``>= min_samples`` points is all-core with no
   distance work (a hot cell costs one count).  Points of *sparse* cells
   (< min_samples points, so at most min_samples-1 per cell) count their
   neighbours by an equi-join of distinct places against the neighbouring cells:
   a place meets a bounded number of sparse ones, never quadratic in a hot cell.
3. **Cluster graph on cells.**  Core points of one cell are connected, so the
   node is the cell (key = smallest core row key in it).  Neighbouring cells have
   an edge where two of their outermost core places are near (exact haversine);
   only pairs of cells that this leaves open are searched, over distinct core places.
4. **Connected components** by star contraction (``functions.graph``); each
   round is a table in the shared folder, and the rounds end at convergence.
5. **Labels.**  Component key = smallest core row key; clusters are numbered
   by that key (the sequential algorithm's discovery order when row keys
   follow row order).  A border point takes the smallest label among its core
   neighbours; everything else is noise (-1).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.geo import haversine_km
from ..functions.graph import connected_components
from ..functions.windows import rank_dense_by
from ..session import cut_lineage


def _cell_plan(df: DataFrame, eps_km: float) -> tuple[float, int, int]:
    a_rad = 0.999 * eps_km / (2 * vocab.EARTH_RADIUS_KM)
    a_deg = math.degrees(a_rad)
    max_abs_lat = df.agg(F.max(F.abs("latitude")).alias("m")).first()["m"] or 0.0
    eps_lat_deg = math.degrees(eps_km / vocab.EARTH_RADIUS_KM)
    cos_min = max(math.cos(math.radians(min(max_abs_lat + 1e-6, 89.0))), 1e-6)
    eps_lon_deg = eps_lat_deg / cos_min
    return a_deg, int(eps_lat_deg // a_deg) + 1, int(eps_lon_deg // a_deg) + 1


def dbscan(df: DataFrame, eps_km: float = vocab.DBSCAN_EPS_KM, min_samples: int = vocab.DBSCAN_MIN_SAMPLES,
           id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """Return ``(id, cluster_label, is_core)`` for every located row of ``df``.

    ``order_col`` (default ``id_col``) is the row order that numbers clusters.
    """
    order_col = order_col or id_col
    pts = (df.select(F.col(id_col).alias("pid"), F.col(order_col).alias("okey"), "latitude", "longitude")
             .dropna(subset=["latitude", "longitude"]))
    a_deg, klat, klon = _cell_plan(pts, eps_km)
    pts = (pts.withColumn("cr", F.floor(F.col("latitude") / a_deg).cast("long"))
              .withColumn("cc", F.floor(F.col("longitude") / a_deg).cast("long")))
    pts = cut_lineage(pts)

    place = ["cr", "cc", "latitude", "longitude"]
    places = cut_lineage(pts.groupBy(*place).agg(F.count(F.lit(1)).alias("n")))
    cell_n = places.groupBy("cr", "cc").agg(F.sum("n").alias("cell_n"))
    offs = [(i, j) for i in range(-klat, klat + 1) for j in range(-klon, klon + 1)]
    off_df = df.sparkSession.createDataFrame(offs, "dr int, dc int")

    def probe(side: DataFrame) -> DataFrame:
        return (side.crossJoin(F.broadcast(off_df))
                    .withColumn("ncr", F.col("cr") + F.col("dr")).withColumn("ncc", F.col("cc") + F.col("dc"))
                    .drop("dr", "dc"))

    other = {"latitude": "qlat", "longitude": "qlon", "cr": "ncr", "cc": "ncc"}
    near = haversine_km(F.col("latitude"), F.col("longitude"), F.col("qlat"), F.col("qlon")) <= eps_km

    # --- 2. neighbour counts for places of sparse cells ---------------------
    sparse = places.join(cell_n.filter(F.col("cell_n") < min_samples), ["cr", "cc"], "left_semi").drop("n")
    sp_pairs = cut_lineage(probe(sparse).join(places.withColumnsRenamed(other), ["ncr", "ncc"]).filter(near))
    spot_n = sp_pairs.groupBy(*place).agg(F.sum("n").alias("n"))
    sp_counts = pts.join(spot_n, place).groupBy("pid").agg(F.sum("n").alias("nbrs"))
    pts = (pts.join(cell_n, ["cr", "cc"]).join(sp_counts, "pid", "left")
              .withColumn("is_core", (F.col("cell_n") >= min_samples) | (F.coalesce("nbrs", F.lit(0)) >= min_samples))
              .drop("nbrs", "cell_n"))
    pts = cut_lineage(pts)

    core = pts.filter("is_core")
    cells = core.groupBy("cr", "cc").agg(F.min("okey").alias("node"))

    # --- 3. cell graph edges among core places of neighbouring cells ------------
    spots = cut_lineage(core.select(*place).distinct())
    at = F.struct("latitude", "longitude")
    lat, lon = F.col("latitude"), F.col("longitude")
    # the outermost places of a cell settle most pairs of cells
    ends = [f(at, by) for by in (lat, lon, lat + lon, lat - lon) for f in (F.min_by, F.max_by)]
    outer = cut_lineage(spots.groupBy("cr", "cc").agg(F.array_distinct(F.array(*ends)).alias("ends")))
    pairs = (probe(outer).filter((F.col("ncr") > F.col("cr")) | ((F.col("ncr") == F.col("cr")) & (F.col("ncc") > F.col("cc"))))
             .join(outer.select(F.col("cr").alias("ncr"), F.col("cc").alias("ncc"), F.col("ends").alias("nends")), ["ncr", "ncc"]))
    touch = F.exists("ends", lambda p: F.exists("nends", lambda q: haversine_km(
        p["latitude"], p["longitude"], q["latitude"], q["longitude"]) <= eps_km))
    pairs = cut_lineage(pairs.select("cr", "cc", "ncr", "ncc", touch.alias("touch")))
    rest = (spots.join(pairs.filter(~F.col("touch")).select("cr", "cc", "ncr", "ncc"), ["cr", "cc"])
                 .join(spots.withColumnsRenamed(other), ["ncr", "ncc"]).filter(near))
    edges = pairs.filter("touch").select("cr", "cc", "ncr", "ncc").unionByName(rest.select("cr", "cc", "ncr", "ncc").distinct())
    n1 = cells.select(F.col("cr"), F.col("cc"), F.col("node").alias("a"))
    n2 = cells.select(F.col("cr").alias("ncr"), F.col("cc").alias("ncc"), F.col("node").alias("b"))
    e = edges.join(n1, ["cr", "cc"]).join(n2, ["ncr", "ncc"]).select("a", "b")
    # --- 4. connected components (ends when no edge changes) ------------------
    linked = connected_components(e).withColumnRenamed("root", "lab")
    labels = cut_lineage(cells.select("node").join(linked, "node", "left")
                         .select("node", F.coalesce("lab", "node").alias("lab")))

    comp = rank_dense_by(labels.select("lab").distinct(), "lab", "cluster_label")
    cell_lab = (cells.join(labels, "node").join(comp, "lab")
                     .select("cr", "cc", "cluster_label"))

    # --- 5. labels for core, border, noise ---------------------------------------
    core_lab = core.join(cell_lab, ["cr", "cc"]).select("pid", "cluster_label")
    # all core rows of a cell have its label; rows without an id lend none
    lent = (core.filter(F.col("pid").isNotNull()).select(*place).distinct().withColumnsRenamed(other)
                .join(cell_lab.select(F.col("cr").alias("ncr"), F.col("cc").alias("ncc"), F.col("cluster_label").alias("ql")), ["ncr", "ncc"]))
    spot_lab = sp_pairs.join(lent, ["ncr", "ncc", "qlat", "qlon"]).groupBy(*place).agg(F.min("ql").alias("ql"))
    border = (pts.join(pts.filter(~F.col("is_core")).select("pid").distinct(), "pid", "left_semi")
                 .join(spot_lab, place).groupBy("pid").agg(F.min("ql").alias("cluster_label")))
    lab = core_lab.unionByName(border)
    return (pts.select("pid", "is_core").join(lab, "pid", "left")
               .select(F.col("pid").alias(id_col),
                       F.coalesce(F.col("cluster_label"), F.lit(-1)).cast("int").alias("cluster_label"),
                       "is_core"))
