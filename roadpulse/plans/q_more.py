"""Registered queries: remaining inventory keys (joins, samples, live store appends, model jobs)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import vocab
from ..functions import geo as G
from ..operators import clean as C
from ..operators import decide as D
from ..operators import feedback as FB
from ..streaming import live as L
from ..streaming.live import scratch
from . import base
from .catalog import register
from .oracle import with_base
from .q_roads import _HIST, _JOIN, joined, network
from .q_stream import _BATCHES


@register("validate_live_event", with_base(
    "SELECT valid, CAST(count(*) AS BIGINT) AS n FROM (SELECT coalesce(hour_of_day BETWEEN 0 AND 23 AND "
    "day_of_week BETWEEN 0 AND 6 AND (latitude IS NULL OR latitude BETWEEN 12.5 AND 13.5) AND (longitude IS NULL "
    "OR longitude BETWEEN 77.2 AND 77.9) AND corridor_7d_score >= 0 AND junction_repeat_count >= 0 AND "
    "coalesce(length(description), 0) <= 2000, false) AS valid FROM feat) t GROUP BY 1"))
def validate_live_event(spark, sf):
    """The live-event input contract applied to every incident: valid / quarantine counts."""
    valid, bad = C.validate_live_event(base.features(spark, sf))
    return (valid.select(F.lit(True).alias("valid")).unionByName(bad.select(F.lit(False).alias("valid")))
                 .groupBy("valid").agg(F.count(F.lit(1)).alias("n")))


@register("geo_angle_gap", with_base(
    "SELECT a.id, round(CASE WHEN abs(a.b - b.b) % 360.0 > 180.0 THEN 360.0 - abs(a.b - b.b) % 360.0 "
    "ELSE abs(a.b - b.b) % 360.0 END, 6) AS gap_deg FROM (SELECT id, latitude, longitude, "
    "(degrees(atan2(sin(radians(longitude - 77.59)) * cos(radians(latitude)), cos(radians(12.97)) * "
    "sin(radians(latitude)) - sin(radians(12.97)) * cos(radians(latitude)) * cos(radians(longitude - 77.59)))) "
    "+ 360.0) % 360.0 AS b FROM clean) a JOIN (SELECT id, (degrees(atan2(sin(radians(endlongitude - 77.59)) * "
    "cos(radians(endlatitude)), cos(radians(12.97)) * sin(radians(endlatitude)) - sin(radians(12.97)) * "
    "cos(radians(endlatitude)) * cos(radians(endlongitude - 77.59)))) + 360.0) % 360.0 AS b FROM clean "
    "WHERE endlatitude IS NOT NULL) b USING (id)", upto="clean"))
def geo_angle_gap(spark, sf):
    """Angular separation, seen from the map centre, between each incident's start and end point."""
    d = base.incidents(spark, sf).filter(F.col("endlatitude").isNotNull())
    b1 = G.bearing_deg(F.lit(12.97), F.lit(77.59), F.col("latitude"), F.col("longitude"))
    b2 = G.bearing_deg(F.lit(12.97), F.lit(77.59), F.col("endlatitude"), F.col("endlongitude"))
    return d.select("id", F.round(G.angle_gap(b1, b2), 6).alias("gap_deg"))


@register("join_left_features", with_base(
    "SELECT c.id, c.zone, round(f.duration_minutes, 6) AS duration_minutes, f.severity_class FROM clean c "
    "LEFT JOIN (SELECT id, duration_minutes, severity_class FROM feat) f USING (id)"))
def join_left_features(spark, sf):
    """Clean rows left-joined to two feature columns on id (the hotspot job's input)."""
    f = base.features(spark, sf).select("id", F.round("duration_minutes", 6).alias("duration_minutes"),
                                        "severity_class")
    return base.incidents(spark, sf).select("id", "zone").join(f, "id", "left")


@register("road_factor", with_base(
    "SELECT id, round(CASE WHEN road_class_rank IS NOT NULL OR lane_count IS NOT NULL THEN 0.6 * "
    "(least(greatest(coalesce(road_class_rank, 0), 0), 6) / 6.0) + 0.4 * (least(greatest(coalesce(lane_count, 0.0), "
    "0.0), 6.0) / 6.0) ELSE 0.5 END, 6) AS road_factor FROM rj", upto="clean", extra=_JOIN))
def road_factor(spark, sf):
    """Road capacity factor of every incident from its matched road (class rank, lanes)."""
    j = joined(spark, sf)
    f, _ = D.road_factor(F.col("road_class_rank"), F.col("lane_count"))
    return j.select("id", F.round(f, 6).alias("road_factor"))


@register("sample_500")
def sample_500(spark, sf):
    """Reproducible fixed-size sample (500 rows, seed 42): order by a seeded hash, not by partition layout."""
    return base.incidents(spark, sf).orderBy(F.xxhash64(F.col("id"), F.lit(42)), "id").limit(500) \
        .select("id", "latitude", "longitude", "zone")


@register("event_append", with_base(
    "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT id) AS BIGINT) AS ids FROM ("
    "SELECT id FROM feat UNION ALL SELECT id FROM feat WHERE status = 'active')"))
def event_append(spark, sf):
    """Append live rows (the active incidents) to a store table; the store keeps every appended row."""
    path = scratch(spark, "store")
    f = base.features(spark, sf)
    cols = ["id", "start_datetime", "event_cause", "zone", "corridor", "junction", "latitude", "longitude",
            "severity_class", "status"]
    f.select(*cols).withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
    f.filter(F.col("status") == "active").select(*cols).withColumn("logged_at", F.current_timestamp()) \
        .write.mode("append").parquet(path)
    s = spark.read.parquet(path)
    return s.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


from .q_feedback import _SNAP  # noqa: E402

_HIST_SQL = with_base(
    "SELECT recorded_at, n_decisions, n_outcomes, round(rec_clearance_mae, 6) AS rec_clearance_mae, "
    "CAST(rec_severity_accuracy AS DOUBLE) AS rec_severity_accuracy FROM snap UNION ALL "
    "SELECT recorded_at, n_decisions, n_outcomes, round(rec_clearance_mae, 6), CAST(NULL AS DOUBLE) FROM snap",
    extra=_SNAP)


@register("snapshot_append", _HIST_SQL)
def snapshot_append(spark, sf):
    """Append metric snapshots (weekly, from the decision log) twice and read the history back aligned."""
    from .q_feedback import decisions
    path = scratch(spark, "history")
    snap = FB.weekly_snapshots(decisions(spark, sf)).withColumn(
        "rec_clearance_mae", F.round("rec_clearance_mae", 6)).withColumn(
        "rec_severity_accuracy", F.col("rec_severity_accuracy").cast("double"))
    snap.write.mode("append").parquet(path)
    snap.drop("rec_severity_accuracy").write.mode("append").parquet(path)   # an older, narrower writer
    return spark.read.option("mergeSchema", "true").parquet(path).select(
        "recorded_at", "n_decisions", "n_outcomes", "rec_clearance_mae", "rec_severity_accuracy")


@register("history_read", _HIST_SQL)
def history_read(spark, sf):
    """Snapshot history read with a fixed column set (missing columns NULL), newest first."""
    h = snapshot_append(spark, sf)
    cols = ["recorded_at", "n_decisions", "n_outcomes", "rec_clearance_mae", "rec_severity_accuracy"]
    empty = spark.createDataFrame([], "recorded_at timestamp_ntz, n_decisions long, n_outcomes long, "
                                      "rec_clearance_mae double, rec_severity_accuracy double")
    return empty.unionByName(h, allowMissingColumns=True).select(*cols).orderBy(F.desc("recorded_at"))


# --- streaming: enrichment, road snap and diversion per micro-batch ----------------------------

def _replay(spark, sf, name):
    from .q_stream import _replayed
    return _replayed(spark, sf, name, 8)


_ENRICH = _HIST + _BATCHES + [
    "bn AS (SELECT b.batch, max(l.start_datetime) AS newest FROM (SELECT DISTINCT batch FROM lb) b JOIN lb l ON l.batch < b.batch GROUP BY 1)",
    "lc AS (SELECT bn.batch, corridor, count(*) AS n FROM bn JOIN lb ON lb.batch < bn.batch AND start_datetime >= newest - INTERVAL 7 DAY GROUP BY ALL)",
    "lj AS (SELECT bn.batch, junction, count(*) AS n FROM bn JOIN lb ON lb.batch < bn.batch AND junction <> 'unknown' GROUP BY ALL)"]


def _precedence_sql(own: str, live: str, name: str) -> str:
    return (f"CAST(CASE WHEN e.id % 5 = 0 AND e.{own} IS NOT NULL THEN e.{own} WHEN bn.batch IS NOT NULL THEN coalesce({live}.n, 0) "
            f"ELSE coalesce(p.{own}, g.{own}) END AS BIGINT) AS {own}, CASE WHEN e.id % 5 = 0 AND e.{own} IS NOT NULL THEN 'override' "
            f"WHEN bn.batch IS NOT NULL THEN 'live' ELSE 'median' END AS {name}_source")


@register("stream_enrich", with_base(
    "SELECT e.id, e.event_semantic_type, " + _precedence_sql("corridor_7d_score", "lc", "corridor_7d") + ", " + _precedence_sql("junction_repeat_count", "lj", "junction_repeat")
    + ", CASE WHEN p.corridor IS NOT NULL THEN p.lane_count ELSE g.lane_count END AS lane_count FROM lb e LEFT JOIN bn ON bn.batch = e.batch "
    "LEFT JOIN lc ON lc.batch = e.batch AND lc.corridor = e.corridor LEFT JOIN lj ON lj.batch = e.batch AND lj.junction = e.junction "
    "LEFT JOIN (SELECT * FROM hm WHERE NOT is_global) p ON e.corridor = p.corridor CROSS JOIN (SELECT * FROM hm WHERE is_global) g", extra=_ENRICH))
def stream_enrich(spark, sf):
    """Live events with history by precedence: own value (every fifth event brings one), live store, corridor median."""
    from .q_stream import _static
    folder, s = _replay(spark, sf, "enrich")
    med, _ = _static(spark, sf)
    own = {c: F.when(F.col("id") % 5 == 0, F.col(c)) for c in ("corridor_7d_score", "junction_repeat_count")}
    return L.enrich_live(s.withColumns(own), med, folder).select(
        "id", "event_semantic_type", "corridor_7d_score", "corridor_7d_source", "junction_repeat_count", "junction_repeat_source", "lane_count")


@register("road_snap_stream")
def road_snap_stream(spark, sf):
    """Each micro-batch of live events snapped to the road network (batch nearest-road join in foreachBatch)."""
    from ..operators import roads as R
    folder, s = _replay(spark, sf, "snap")
    out = os.path.join(folder, "snapped")
    roads = base._stage(spark, "road_places", sf, lambda: R.road_places(network(spark, sf)))

    def handle(batch, batch_id):
        R.road_join(L.without_closing(batch).drop("event_time"), roads).select("id", "road_class", "road_class_rank", "lane_count",
                                                            "road_dist_m") \
            .write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))
    L.run_foreach(s, folder, "snap", handle)
    return spark.read.parquet(out)


@register("stream_divert")
def stream_divert(spark, sf):
    """Reroute live events whose recommendation asks for a diversion (per micro-batch)."""
    from ..operators import diversion as DV
    folder, s = _replay(spark, sf, "divert")
    out = os.path.join(folder, "routes")
    roads = network(spark, sf)

    def handle(batch, batch_id):
        r = D.recommend(L.without_closing(batch).withColumn("severity_class", F.col("severity")), prob_col="closure_prob")
        t = r.filter(F.col("diversion_recommended") & F.col("latitude").isNotNull()).select(
            "id", "latitude", "longitude")
        DV.plan_routes(t, roads).drop("path") \
            .write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))
    L.run_foreach(s, folder, "divert", handle)
    return spark.read.parquet(out)


@register("train_all")
def train_all(spark, sf):
    """The three stored models' hold-out metrics, one row per model."""
    from ..operators import metrics as M
    from . import q_models as Q
    s = Q.severity_model(spark, sf).agg(F.first("accuracy").alias("value")).select(F.lit("severity_accuracy").alias("metric"), "value")
    d = Q.duration_model(spark, sf).select(F.lit("duration_mae").alias("metric"), F.col("mae").alias("value"))
    c = M.roc_auc(Q._closure(spark, sf), "road_closure_binary", "closure_prob") \
        .select(F.lit("closure_roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
    return s.unionByName(d).unionByName(c)


@register("retrain_job")
def retrain_job(spark, sf):
    """Retrain and record a snapshot row (model metrics x feedback accuracy) appended to a history table."""
    from .q_feedback import decisions
    m = train_all(spark, sf).groupBy().pivot("metric").agg(F.first("value"))
    ev = FB.feedback_severity_accuracy(decisions(spark, sf)).select(
        F.col("severity_accuracy").alias("rec_severity_accuracy"))
    row = m.crossJoin(ev).withColumn("recorded_at", F.current_timestamp())
    path = scratch(spark, "retrain")
    row.write.mode("append").parquet(path)
    return spark.read.parquet(path)
