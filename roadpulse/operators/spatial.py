"""Spatial operators: hold-out validation, zone imputation, cluster geometry, KDE.

Nearest-neighbour and range joins are cell-bucketed equi-joins (Spark has no
spatial index): both sides get integer cell keys, the smaller side is
replicated to the neighbouring cells, and the join is a plain hash /
sort-merge equi-join followed by an exact distance filter and ``min_by``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..session import cut_lineage
from ..functions.geo import circle_ring, haversine_km
from ..functions.quantiles import group_quantiles
from .analytics import deterministic_mode
from .decide import round_binary


# --------------------------------------------------------------------------
# Hold-out validation of grid hotspots
# --------------------------------------------------------------------------

def grid_frame(train: DataFrame, cell_km: float = vocab.HOLDOUT_CELL_KM) -> DataFrame:
    """One-row frame: cell size in degrees anchored at the train extent."""
    return train.agg(F.avg("latitude").alias("lat0"), F.min("latitude").alias("lat_min"),
                     F.min("longitude").alias("lon_min")).select(
        "lat_min", "lon_min", F.lit(cell_km / vocab.KM_PER_DEG_LAT).alias("dlat"),
        (F.lit(cell_km) / (vocab.KM_PER_DEG_LON_EQ * F.cos(F.radians("lat0")))).alias("dlon"))


def grid_cells(df: DataFrame, frame: DataFrame) -> DataFrame:
    """Attach integer ``(cell_r, cell_c)`` (floor: points outside the frame get negative cells)."""
    j = df.crossJoin(F.broadcast(frame))
    return (j.withColumn("cell_r", F.floor((F.col("latitude") - F.col("lat_min")) / F.col("dlat")).cast("int"))
             .withColumn("cell_c", F.floor((F.col("longitude") - F.col("lon_min")) / F.col("dlon")).cast("int"))
             .drop("lat_min", "lon_min", "dlat", "dlon"))


def _period(unit: str) -> Column:
    return F.date_trunc(unit, F.col("start_datetime")).cast("timestamp_ntz")


def hotspot_holdout(df: DataFrame, thresholds: list[int] = vocab.HOLDOUT_THRESHOLDS, period: str = "month",
                    cell_km: float = vocab.HOLDOUT_CELL_KM) -> DataFrame:
    """Train on all periods but the last, test on the last; one row per threshold.

    Columns: threshold, n_hot_cells, hits, n_train, n_test, occupied_cells,
    area_share, hit_rate, pai.  Guards (>= 2 periods, train >= 50,
    test >= 20) yield an empty result.
    """
    spark = df.sparkSession
    pts = df.select("latitude", "longitude", "start_datetime").dropna().withColumn("__p", _period(period))
    bounds = pts.agg(F.max("__p").alias("__last"), F.count_distinct("__p").alias("__np"))
    pts = pts.crossJoin(F.broadcast(bounds)).withColumn("__test", F.col("__p") == F.col("__last"))
    train, test = pts.filter(~F.col("__test")), pts.filter(F.col("__test"))
    frame = grid_frame(train, cell_km)
    tr = grid_cells(train, frame).groupBy("cell_r", "cell_c").agg(F.count(F.lit(1)).alias("train_n"))
    te = grid_cells(test, frame).groupBy("cell_r", "cell_c").agg(F.count(F.lit(1)).alias("test_n"))
    sizes = pts.agg(F.count_if(~F.col("__test")).alias("n_train"), F.count_if(F.col("__test")).alias("n_test"),
                    F.first("__np").alias("n_periods"))
    occupied = tr.agg(F.count(F.lit(1)).alias("occupied_cells"))
    th = spark.createDataFrame([(int(t),) for t in thresholds], "threshold int")
    cells = tr.join(te, ["cell_r", "cell_c"], "full").fillna(0, ["train_n", "test_n"])
    per_t = (cells.crossJoin(F.broadcast(th))
                  .groupBy("threshold")
                  .agg(F.count_if(F.col("train_n") >= F.col("threshold")).alias("n_hot_cells"),
                       F.sum(F.when(F.col("train_n") >= F.col("threshold"), F.col("test_n")).otherwise(0))
                        .cast("bigint").alias("hits")))
    out = (per_t.filter(F.col("n_hot_cells") > 0)
                .crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(occupied))
                .filter((F.col("n_periods") >= 2) & (F.col("n_train") >= 50) & (F.col("n_test") >= 20)))
    area = F.col("n_hot_cells") / F.col("occupied_cells")
    hit = F.col("hits") / F.col("n_test")
    return out.select("threshold", "n_hot_cells", "hits", "n_train", "n_test", "occupied_cells",
                      round_binary(area, 4).alias("area_share"), round_binary(hit, 4).alias("hit_rate"),
                      round_binary(hit / area, 2).alias("pai"))


def hotspot_headline(holdout: DataFrame, target: float = vocab.HOLDOUT_TARGET_AREA) -> DataFrame:
    """The threshold row whose (rounded) area share is closest to the target; ties -> lower threshold."""
    key = F.struct(F.abs(F.col("area_share") - target), F.col("threshold"))
    return holdout.agg(F.min_by(F.struct(*holdout.columns), key).alias("h")).select("h.*")


# --------------------------------------------------------------------------
# Zones
# --------------------------------------------------------------------------

def zone_centroids(df: DataFrame) -> DataFrame:
    known = df.filter(F.col("zone").isNotNull() & (F.col("zone") != "Unknown"))
    return known.groupBy("zone").agg(F.avg("latitude").alias("zlat"), F.avg("longitude").alias("zlon"))


MANY_ZONES = 10_000        # centroids that may travel as one row


def zone_impute(df: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """``Unknown`` zones -> nearest known-zone centroid by squared degrees, ties by name.

    Up to ``MANY_ZONES`` centroids are folded into one array (a one-row broadcast) and the
    argmin is evaluated per row: no shuffle of the fact table.  Beyond that, which is
    checked, the places of the rows to fill meet the centroids in a nearest-neighbour
    join by cells.
    """
    cents = cut_lineage(centroids if centroids is not None else zone_centroids(df))
    unknown = (F.col("zone").isNull() | (F.col("zone") == "Unknown")) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    if cents.count() <= MANY_ZONES:
        arr = cents.agg(F.collect_list(F.struct("zone", "zlat", "zlon")).alias("__zc"))
        best = F.array_min(F.transform(F.col("__zc"), lambda c: F.struct(
            (F.pow(F.col("latitude") - c["zlat"], 2) + F.pow(F.col("longitude") - c["zlon"], 2)).alias("d2"),
            c["zone"].alias("zone"))))
        filled = F.when(unknown & (F.size("__zc") > 0), best["zone"]).otherwise(F.col("zone"))
        return df.crossJoin(F.broadcast(arr)).withColumn("zone", filled).drop("__zc")
    from .planning import knn_join
    spots = cut_lineage(df.filter(unknown).select("latitude", "longitude").distinct().withColumn("qid", F.monotonically_increasing_id()))
    every = F.lit(1).alias("__all")
    pts = cents.select(F.col("zone").alias("pid"), F.col("zlat").alias("latitude"), F.col("zlon").alias("longitude"), every,
                       F.lit(0).alias("start_datetime"))
    near = knn_join(spots.select("*", every), pts, ["__all"], 1, metric="euclid_deg")
    near = near.join(spots, "qid").select(F.col("latitude").alias("__la"), F.col("longitude").alias("__lo"), F.col("pid").alias("__zone"))
    j = df.join(near, unknown & (F.col("latitude") == F.col("__la")) & (F.col("longitude") == F.col("__lo")), "left")
    return j.withColumn("zone", F.coalesce("__zone", "zone")).drop("__la", "__lo", "__zone")


# --------------------------------------------------------------------------
# Cluster geometry
# --------------------------------------------------------------------------

def cluster_centroids(df: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Mean position + radius (max haversine km to the centroid) per cluster."""
    pts = df.filter((F.col(label) >= 0) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    c = pts.groupBy(label).agg(F.avg("latitude").alias("clat"), F.avg("longitude").alias("clon"))
    j = pts.select(label, "latitude", "longitude").join(c, label)
    return (j.groupBy(label, "clat", "clon")
             .agg(F.max(haversine_km(F.col("clat"), F.col("clon"), F.col("latitude"), F.col("longitude")))
                  .alias("radius_km"))
             .withColumnRenamed(label, "cluster"))


CELL_CENTROIDS = 1000      # centroids of a cell that one row holds


def cluster_assign(points: DataFrame, centroids: DataFrame, margin_km: float = vocab.DBSCAN_EPS_KM,
                   cell_deg: float = 0.01) -> DataFrame:
    """Nearest centroid whose reach (radius + margin) contains the point, else -1; rows of one id share the nearest of all.

    Centroids are replicated to every ``cell_deg`` cell their reach box touches
    (cluster count grows with data, so no blind broadcast) and folded there into rows of up to
    about ``CELL_CENTROIDS``.  Distinct places meet the rows of their own cell and take the least
    (distance, cluster) within reach from each: pairs of places and centroids are never rows.
    """
    c = centroids.withColumn("__reach", F.col("radius_km") + margin_km)
    dlat = F.col("__reach") / 110.574
    dlon = F.col("__reach") / (111.320 * F.cos(F.radians(F.lit(0.0)) * 0 + F.radians(F.col("clat"))) + 1e-9)
    c = (c.withColumn("__r", F.explode(F.sequence(F.floor((F.col("clat") - 1.5 * dlat) / cell_deg).cast("long"),
                                                  F.floor((F.col("clat") + 1.5 * dlat) / cell_deg).cast("long"))))
          .withColumn("__c", F.explode(F.sequence(F.floor((F.col("clon") - 1.5 * dlon) / cell_deg).cast("long"),
                                                  F.floor((F.col("clon") + 1.5 * dlon) / cell_deg).cast("long")))))
    c = cut_lineage(c.select("cluster", "clat", "clon", "__reach", (1.5 * F.col("__reach") / 110.574).alias("__dlat"), "__r", "__c"))
    rows = c.groupBy("__r", "__c").agg(F.ceil(F.count(F.lit(1)) / CELL_CENTROIDS).alias("__rows"))
    cells = (c.join(rows, ["__r", "__c"]).groupBy("__r", "__c", F.pmod(F.xxhash64("cluster", "clat", "clon"), "__rows"))
              .agg(F.collect_list(F.struct("cluster", "clat", "clon", "__reach", "__dlat")).alias("__near")))
    spots = (points.select(F.col("latitude").alias("__la"), F.col("longitude").alias("__lo")).dropna().distinct()
                   .withColumn("__r", F.floor(F.col("__la") / cell_deg).cast("long"))
                   .withColumn("__c", F.floor(F.col("__lo") / cell_deg).cast("long")))
    # a centroid that is too far north or south is left without its distance
    close = F.filter("__near", lambda x: F.abs(x["clat"] - F.col("__la")) <= x["__dlat"])
    far = F.transform(close, lambda x: F.struct(haversine_km(x["clat"], x["clon"], F.col("__la"), F.col("__lo")).alias("d"),
                                                x["cluster"].alias("cluster"), x["__reach"].alias("reach")))
    best = F.array_min(F.filter(far, lambda x: x["d"] <= x["reach"]))
    found = spots.join(cells, ["__r", "__c"]).select("__la", "__lo", best.alias("__best")).filter("__best is not null")
    found = found.groupBy("__la", "__lo").agg(F.min(F.struct("__best.d", "__best.cluster")).alias("__best"))
    placed = points.join(found, (F.col("latitude") == F.col("__la")) & (F.col("longitude") == F.col("__lo")), "left").drop("__la", "__lo")
    again = points.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = cut_lineage(again.select("id"))
    if not again.isEmpty():
        shared = placed.join(again, "id", "left_semi").groupBy("id").agg(F.min("__best").alias("__shared"))
        placed = placed.join(shared, "id", "left").withColumn("__best", F.coalesce("__shared", "__best")).drop("__shared")
    own = F.when(F.col("id").isNotNull(), F.col("__best")["cluster"])
    return placed.select(*points.columns, F.coalesce(own, F.lit(-1)).cast("int").alias("assigned_cluster"))


def cluster_summary_stats(labelled: DataFrame, label: str = "cluster_label") -> DataFrame:
    return labelled.agg(
        F.count_distinct(F.when(F.col(label) >= 0, F.col(label))).alias("n_clusters"),
        F.count_if(F.col(label) == -1).cast("bigint").alias("n_noise"),
        round_binary(100 * (1 - F.count_if(F.col(label) == -1) / F.count(F.lit(1))), 6).alias("coverage_pct"))


# --------------------------------------------------------------------------
# Hotspot summaries
# --------------------------------------------------------------------------

# FIXED VALUES: landmark words that make an address part a good label.
LANDMARK_PATTERN = r"(?i)\b(junction|junc|circle|cross|flyover|bridge|signal|toll|gate|layout|nagar|road)\b"


def address_label(address: Column) -> Column:
    """First comma part with a landmark word (cut at '.', 40 chars), else the first part."""
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.trim(p)),
                     lambda p: p != "")
    land = F.filter(parts, lambda p: p.rlike(LANDMARK_PATTERN))
    first_land = F.substring(F.trim(F.split(land[0], r"\.")[0]), 1, 40)
    return F.when(F.size(land) > 0, first_land).when(F.size(parts) > 0, F.substring(parts[0], 1, 40)) \
        .otherwise(F.lit(""))


def best_junction_label(junction: Column, address: Column, cluster: Column) -> Column:
    lab = address_label(address)
    return (F.when(junction.isNotNull() & (F.lower(junction) != "unknown"), junction)
             .when(lab != "", lab).otherwise(F.concat(F.lit("Cluster-"), cluster.cast("string"))))


def _cluster_profile(labelled: DataFrame, label: str) -> DataFrame:
    cl = labelled.filter(F.col(label) >= 0)
    agg = cl.groupBy(label).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg("latitude").alias("__clat"), F.avg("longitude").alias("__clon"))
    agg = agg.join(group_quantiles(cl, [label], "duration_minutes", {"__med": 0.5}), label, "left")
    modes = [deterministic_mode(cl, [label], c, f"__mode_{c}")
             for c in ("event_cause", "junction", "address", "zone", "severity_class") if c in cl.columns]
    for m in modes:
        agg = agg.join(m, label, "left")
    return agg


def hotspot_features(labelled: DataFrame, label: str = "cluster_label",
                     buffer_km: float = vocab.CLUSTER_BUFFER_KM) -> DataFrame:
    """One feature per cluster: ring polygon + properties (mode cause/zone, label, median duration)."""
    p = _cluster_profile(labelled, label)
    med = F.col("__med")
    return p.select(
        F.col(label).alias("cluster_id"), "event_count",
        F.coalesce(F.col("__mode_event_cause"), F.lit("other")).alias("dominant_cause"),
        F.when(med.isNotNull() & (med != 0), round_binary(med, 1)).alias("avg_duration_minutes"),
        best_junction_label(F.col("__mode_junction"), F.col("__mode_address"), F.col(label)).alias("top_junction"),
        F.coalesce(F.col("__mode_zone"), F.lit("Unknown")).alias("zone"),
        round_binary(F.col("__clat"), 5).alias("centroid_lat"), round_binary(F.col("__clon"), 5).alias("centroid_lon"),
        circle_ring(F.col("__clat"), F.col("__clon"), buffer_km).alias("ring"))


def geojson_features(features: DataFrame) -> DataFrame:
    """One GeoJSON Feature per row as JSON text (``write.text`` makes a splittable FeatureCollection body)."""
    props = [c for c in features.columns if c != "ring"]
    return features.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.col("ring")).alias("coordinates")).alias("geometry"),
        F.struct(*props).alias("properties"))).alias("feature"))


def hotspot_rank(labelled: DataFrame, top_n: int = 10, label: str = "cluster_label") -> DataFrame:
    p = _cluster_profile(labelled, label)
    med = F.col("__med")
    return p.select(
        F.col(label).alias("cluster_id"),
        best_junction_label(F.col("__mode_junction"), F.col("__mode_address"), F.col(label)).alias("junction"),
        "event_count", F.col("__mode_event_cause").alias("dominant_cause"),
        F.coalesce(F.col("__mode_severity_class"), F.lit("Medium")).alias("dominant_severity"),
        F.when(med.isNotNull() & (med != 0), round_binary(med, 1)).alias("avg_duration_minutes"),
        F.coalesce(F.col("__mode_zone"), F.lit("Unknown")).alias("zone"),
        round_binary(F.col("__clat"), 5).alias("centroid_lat"), round_binary(F.col("__clon"), 5).alias("centroid_lon"),
    ).orderBy(F.desc("event_count"), F.asc("cluster_id")).limit(top_n)


def hotspot_feature_filter(features: DataFrame, zones: list[str], causes: list[str]) -> DataFrame:
    return features.filter(F.col("zone").isin(zones) & F.col("dominant_cause").isin(causes))


# --------------------------------------------------------------------------
# Kernel density heat map
# --------------------------------------------------------------------------

def kde_heatmap(df: DataFrame, bandwidth: float = vocab.KDE_BANDWIDTH, grid: int = vocab.KDE_GRID,
                pad: float = vocab.KDE_PAD_DEG, min_weight: float = vocab.KDE_MIN_WEIGHT) -> DataFrame:
    """Gaussian KDE on a ``grid x grid`` lattice over the padded extent, min-max normalised.

    Kernel covariance = bandwidth^2 x sample covariance (lon, lat).  Points are
    counted by coordinate first; each distinct coordinate then meets the fixed
    lattice, and the per-node sums are partial aggregates.
    """
    spark = df.sparkSession
    pts = df.select("latitude", "longitude").dropna()
    st = pts.agg(F.min("latitude").alias("la0"), F.max("latitude").alias("la1"),
                 F.min("longitude").alias("lo0"), F.max("longitude").alias("lo1"),
                 F.var_samp("longitude").alias("vxx"), F.var_samp("latitude").alias("vyy"),
                 F.covar_samp("longitude", "latitude").alias("vxy"), F.count(F.lit(1)).alias("n"))
    b2 = bandwidth * bandwidth
    st = (st.withColumn("sxx", F.col("vxx") * b2).withColumn("syy", F.col("vyy") * b2)
            .withColumn("sxy", F.col("vxy") * b2)
            .withColumn("det", F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy"))
            .withColumn("glo0", F.col("lo0") - pad).withColumn("glo1", F.col("lo1") + pad)
            .withColumn("gla0", F.col("la0") - pad).withColumn("gla1", F.col("la1") + pad)
            .withColumn("stx", (F.col("glo1") - F.col("glo0")) / (grid - 1))
            .withColumn("sty", (F.col("gla1") - F.col("gla0")) / (grid - 1))
            .withColumn("norm", 1.0 / (F.col("n") * 2 * math.pi * F.sqrt(F.col("det")))))
    places = pts.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("here"))
    axis = F.sequence(F.lit(0), F.lit(grid - 1))
    j = (places.crossJoin(F.broadcast(st)).withColumn("gi", F.explode(axis)).withColumn("gj", F.explode(axis)))
    gx = F.when(F.col("gi") == grid - 1, F.col("glo1")).otherwise(F.col("glo0") + F.col("gi") * F.col("stx"))
    gy = F.when(F.col("gj") == grid - 1, F.col("gla1")).otherwise(F.col("gla0") + F.col("gj") * F.col("sty"))
    dx, dy = gx - F.col("longitude"), gy - F.col("latitude")
    m = (F.col("syy") * dx * dx - 2 * F.col("sxy") * dx * dy + F.col("sxx") * dy * dy) / F.col("det")
    dens = j.groupBy("gi", "gj").agg(F.sum(F.col("here") * F.exp(-0.5 * m)).alias("__s"))
    lattice = (spark.range(grid * grid).select((F.col("id") % grid).cast("int").alias("gi"),
                                               (F.col("id") / grid).cast("int").alias("gj")))
    z = (lattice.join(dens, ["gi", "gj"], "left").crossJoin(F.broadcast(st))
                .withColumn("z", F.coalesce(F.col("__s"), F.lit(0.0)) * F.col("norm"))
                .withColumn("lon", F.when(F.col("gi") == grid - 1, F.col("glo1"))
                            .otherwise(F.col("glo0") + F.col("gi") * F.col("stx")))
                .withColumn("lat", F.when(F.col("gj") == grid - 1, F.col("gla1"))
                            .otherwise(F.col("gla0") + F.col("gj") * F.col("sty"))))
    w = Window.partitionBy()  # over the fixed grid x grid lattice only
    z = z.withColumn("zmin", F.min("z").over(w)).withColumn("zmax", F.max("z").over(w))
    out = z.withColumn("weight", (F.col("z") - F.col("zmin")) / (F.col("zmax") - F.col("zmin") + 1e-9))
    return out.filter(F.col("weight") > min_weight).select("lat", "lon", "weight")


def heatmap_raw(df: DataFrame) -> DataFrame:
    return df.select("latitude", "longitude").dropna().select(
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.lit(1.0).alias("weight"))


# --------------------------------------------------------------------------
# Moran's I of cluster membership
# --------------------------------------------------------------------------

def morans_i(labelled: DataFrame, k: int = vocab.MORAN_K, label: str = "cluster_label",
             alpha: float = vocab.MORAN_SIGNIFICANCE) -> DataFrame:
    """Global Moran's I of the clustered flag with row-standardised k-nearest weights
    (euclidean in degree space), normal-approximation two-sided p-value.

    Weights come from an exact kNN join; S0/S1/S2 and the cross-products are
    aggregations; only the final one-row statistic is evaluated on the driver.
    """
    from .planning import knn_join
    pts = (labelled.select(F.col("id").alias("pid"), "latitude", "longitude", "start_datetime",
                           (F.col(label) >= 0).cast("double").alias("y"))
                   .dropna(subset=["latitude", "longitude"]).withColumn("__all", F.lit(1)))
    q = pts.select(F.col("pid").alias("qid"), "__all", "latitude", "longitude")
    nn = knn_join(q, pts.drop("y"), ["__all"], k, metric="euclid_deg", exclude_self=True)
    # the neighbours are read by every sum: written once
    nn = cut_lineage(nn.select("qid", "pid", F.count(F.lit(1)).over(Window.partitionBy("qid")).alias("__k")))
    w = nn.select(F.col("qid").alias("i"), F.col("pid").alias("j"), (1.0 / F.col("__k")).alias("w"))
    ybar = pts.agg(F.avg("y").alias("__m"), F.count(F.lit(1)).alias("n"))
    z = pts.crossJoin(F.broadcast(ybar)).select(F.col("pid"), (F.col("y") - F.col("__m")).alias("z"))
    zi = z.select(F.col("pid").alias("i"), F.col("z").alias("zi"))
    zj = z.select(F.col("pid").alias("j"), F.col("z").alias("zj"))
    cross = w.join(zi, "i").join(zj, "j").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"),
                                               F.sum("w").alias("s0"))
    zz = z.agg(F.sum(F.col("z") * F.col("z")).alias("den"))
    # half the sum over ordered pairs of (w_ij + w_ji)^2: each pair once, whichever way it was found
    s1 = w.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("w").alias("t")).agg(
        F.sum(F.col("t") * F.col("t")).alias("s1"))
    rs = w.groupBy(F.col("i").alias("v")).agg(F.sum("w").alias("r"))
    cs = w.groupBy(F.col("j").alias("v")).agg(F.sum("w").alias("c"))
    s2 = rs.join(cs, "v", "full").fillna(0.0).agg(F.sum(F.pow(F.col("r") + F.col("c"), 2)).alias("s2"))
    row = cross.crossJoin(zz).crossJoin(s1).crossJoin(s2).crossJoin(ybar).first()
    import math as _m
    n, s0 = float(row["n"]), float(row["s0"] or 0.0)
    spark = labelled.sparkSession
    schema = "n long, I double, expected_I double, z_norm double, p_value double, significant boolean"
    if n < 3 or not row["den"] or s0 == 0:
        return spark.createDataFrame([(int(n), None, None, None, None, False)], schema)
    i_stat = n / s0 * row["num"] / row["den"]
    ei = -1.0 / (n - 1)
    vi = (n * n * row["s1"] - n * row["s2"] + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - ei * ei
    zn = (i_stat - ei) / _m.sqrt(vi)
    p = _m.erfc(abs(zn) / _m.sqrt(2.0))  # two-sided normal tail
    return spark.createDataFrame([(int(n), float(i_stat), ei, float(zn), float(p), bool(p < alpha))], schema)
