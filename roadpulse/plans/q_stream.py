"""Registered queries: live store (batch, exact oracles) and Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import analytics as A
from ..operators import spatial as S
from ..sources import fixtures
from ..streaming import live as L
from . import base
from .catalog import register
from .oracle import SCORE, recommend_sql, with_base
from .q_roads import medians as corridor_medians
from .q_spatial import _CENT, HAV, LABELS, LF, labelled


def store(spark, sf):
    """The live event store: every incident in store shape (with the fixture cluster labels)."""
    f = base.features(spark, sf).join(fixtures.given_labels(spark, sf), "id", "left")
    return f.select("id", F.col("start_datetime").alias("ts"), "event_cause", "zone", "corridor", "junction",
                    "latitude", "longitude", F.col("severity_class").alias("severity"), "status",
                    F.col("cluster_label").alias("cluster"))


_STORE = ["lab AS (SELECT CAST(event_id AS BIGINT) AS id, CAST(CASE WHEN event_id % 50 = 7 THEN -1 ELSE user_id END "
          "AS INT) AS cluster_label FROM events)",
          "store AS (SELECT f.id, f.start_datetime AS ts, event_cause, zone, corridor, junction, latitude, longitude, "
          "severity_class AS severity, status, l.cluster_label AS cluster FROM feat f LEFT JOIN lab l USING (id))"]


@register("live_history", with_base(
    "SELECT q.id, CAST(coalesce(c.n, 0) AS BIGINT) AS corridor_7d_live, CAST(coalesce(j.n, 0) AS BIGINT) "
    "AS junction_count_live FROM (SELECT id, corridor, junction FROM store WHERE status = 'active') q "
    "LEFT JOIN (SELECT corridor, count(*) AS n FROM store WHERE ts >= (SELECT max(ts) FROM store) - INTERVAL 7 DAYS "
    "GROUP BY 1) c USING (corridor) LEFT JOIN (SELECT junction, count(*) AS n FROM store WHERE junction <> 'unknown' "
    "GROUP BY 1) j USING (junction)", extra=_STORE))
def live_history(spark, sf):
    """Store-relative history for every active event: corridor events since (latest - 7 days), junction total."""
    s = store(spark, sf)
    latest = s.agg(F.max("ts").alias("__l"))
    c7 = (s.crossJoin(F.broadcast(latest)).filter(F.col("ts") >= F.col("__l") - F.expr("INTERVAL 7 DAYS"))
            .groupBy("corridor").agg(F.count(F.lit(1)).alias("__c")))
    jr = s.filter(F.col("junction") != "unknown").groupBy("junction").agg(F.count(F.lit(1)).alias("__j"))
    qy = s.filter(F.col("status") == "active").select("id", "corridor", "junction")
    return (qy.join(c7, "corridor", "left").join(jr, "junction", "left")
              .select("id", F.coalesce("__c", F.lit(0)).cast("bigint").alias("corridor_7d_live"),
                      F.coalesce("__j", F.lit(0)).cast("bigint").alias("junction_count_live")))


@register("active_set", with_base(
    "SELECT id, ts, event_cause, zone, severity FROM (SELECT * FROM store QUALIFY row_number() OVER "
    "(PARTITION BY id ORDER BY ts DESC) = 1) t WHERE status = 'active' ORDER BY ts DESC, id LIMIT 500", extra=_STORE))
def active_set(spark, sf):
    """Latest row per id (max_by), active only, newest first, top 500."""
    s = store(spark, sf)
    cols = [c for c in s.columns if c != "id"]
    latest = s.groupBy("id").agg(F.max_by(F.struct(*cols), F.col("ts")).alias("r"))
    cur = latest.select("id", *[F.col("r")[c].alias(c) for c in cols])
    return (cur.filter(F.col("status") == "active").orderBy(F.desc("ts"), "id").limit(500)
               .select("id", "ts", "event_cause", "zone", "severity"))


@register("store_count", with_base("SELECT CAST(count(*) AS BIGINT) AS n FROM store", extra=_STORE))
def store_count(spark, sf):
    return store(spark, sf).agg(F.count(F.lit(1)).alias("n"))


@register("event_seed", with_base(
    "SELECT 1 AS run, CAST(count(*) AS BIGINT) AS inserted FROM store WHERE status = 'active' "
    "UNION ALL SELECT 2 AS run, CAST(0 AS BIGINT) AS inserted", extra=_STORE))
def event_seed(spark, sf):
    """Seed a store with the historical active rows, twice: the second run inserts nothing (anti join by key)."""
    path = L.scratch(spark, "seed")
    s = store(spark, sf)
    s.limit(0).write.parquet(path)
    runs = []
    for run in (1, 2):
        held = spark.read.parquet(path).select("id")
        new = s.filter(F.col("status") == "active").join(held, "id", "left_anti")
        before = held.count()
        new.write.mode("append").parquet(path)
        runs.append((run, spark.read.parquet(path).count() - before))
    return spark.createDataFrame(runs, "run int, inserted long")


@register("live_merge", with_base(
    "SELECT id, start_datetime, severity_class, cluster_label, event_cause FROM ("
    "SELECT f.id, f.start_datetime, f.severity_class, l.cluster_label, f.event_cause FROM feat f LEFT JOIN lab l "
    "USING (id) WHERE f.status = 'active' UNION ALL SELECT id, ts AS start_datetime, severity AS severity_class, "
    "cluster AS cluster_label, event_cause FROM store WHERE id NOT IN (SELECT id FROM feat WHERE status = 'active')) t",
    extra=_STORE))
def live_merge(spark, sf):
    """Batch active rows plus live-store rows whose id the batch does not know (renamed to batch names)."""
    f = base.features(spark, sf).join(fixtures.given_labels(spark, sf), "id", "left")
    act = f.filter(F.col("status") == "active").select("id", "start_datetime", "severity_class", "cluster_label",
                                                         "event_cause")
    lv = (store(spark, sf).withColumnRenamed("ts", "start_datetime").withColumnRenamed("severity", "severity_class")
          .withColumnRenamed("cluster", "cluster_label"))
    adds = lv.join(act.select("id"), "id", "left_anti")
    return act.unionByName(adds.select(*act.columns), allowMissingColumns=True)


# --- Structured Streaming jobs (file replay of the whole table) ----------------------------

def _static(spark, sf):
    """Stream-static side tables, written once (rows by corridor and by cause)."""
    return (base._stage(spark, "medians", sf, lambda: corridor_medians(spark, sf)),
            base._stage(spark, "clearance", sf, lambda: A.clearance_stats(base.features(spark, sf))))


def _replayed(spark, sf, name, files_per_trigger=1):
    folder = L.scratch(spark, name)
    live = L.live_rows(base.features(spark, sf).join(fixtures.closure_score(spark, sf), "id", "left"))
    return folder, L.read_live(spark, L.write_replay(live, folder), live.schema, files_per_trigger)


# Late rows reach a window while the watermark they are judged by has not passed its end.  They arrive after the last
# day's block and are judged by the watermark of the batch before that one: the newest row of the earlier days - 1 day.
_REPLAY = ["nw AS (SELECT max(start_datetime) AS newest FROM feat WHERE id % 37 <> 0)",
           "wm AS (SELECT CAST(date_trunc('milliseconds', max(start_datetime)) AS TIMESTAMP) - INTERVAL 1 DAY AS wm FROM feat, nw "
           "WHERE id % 37 <> 0 AND CAST(start_datetime AS DATE) < CAST(newest AS DATE))"]


@register("stream_ingest", with_base(
    "SELECT id, coalesce(hour_of_day BETWEEN 0 AND 23 AND day_of_week BETWEEN 0 AND 6 AND (latitude IS NULL OR latitude "
    "BETWEEN 12.5 AND 13.5) AND (longitude IS NULL OR longitude BETWEEN 77.2 AND 77.9) AND corridor_7d_score >= 0 AND "
    "junction_repeat_count >= 0 AND coalesce(length(description), 0) <= 2000, false) AS valid FROM feat"))
def stream_ingest(spark, sf):
    """The input contract on the stream: valid and quarantined events."""
    folder, s = _replayed(spark, sf, "ingest", 8)
    return L.run_to_table(L.ingest(s).drop("event_time"), folder, "judged").select("id", "valid")


def _pipeline(spark, sf):
    """The three sinks of the live pipeline, run once per session and input."""
    def run():
        folder, s = _replayed(spark, sf, "pipeline", 8)
        footprints = L.scratch(spark, "footprints")
        L.publish_footprints(S.cluster_centroids(labelled(spark, sf)), footprints)
        out = L.live_pipeline(s, *_static(spark, sf), folder, footprints)
        return spark.createDataFrame(sorted(out.items()), "sink string, path string")
    return {r.sink: spark.read.parquet(r.path) for r in base._stage(spark, "live_pipeline", sf, run).collect()}


_LIVE_R = ("(SELECT f.* EXCLUDE (corridor_7d_score), s.closure_prob FROM feat f LEFT JOIN score s USING (id))")


@register("stream_score", with_base(
    "SELECT id, severity_class, CAST(personnel_count AS INTEGER) AS personnel_count, barricade_required FROM ("
    + recommend_sql(_LIVE_R, "closure_prob", with_clearance=False) + ") r", extra=[SCORE]))
def stream_score(spark, sf):
    """Every live event scored with its closure probability: officers and barricade."""
    return _pipeline(spark, sf)["scored"].select("id", "severity_class", F.col("personnel_count").cast("int").alias("personnel_count"),
                                                 "barricade_required")


@register("stream_alerts", with_base(
    "SELECT id FROM (" + recommend_sql(_LIVE_R, "closure_prob", with_clearance=False) + ") r WHERE barricade_required", extra=[SCORE]))
def stream_alerts(spark, sf):
    """Events whose alert was sent (the text is checked by ``alert_message``)."""
    return _pipeline(spark, sf)["alerts"].filter("alert_text is not null").select("id")


@register("stream_log", with_base(
    "SELECT id, event_cause, zone, severity_class AS predicted_severity, CAST(personnel_count AS VARCHAR) AS recommended_personnel "
    "FROM (" + recommend_sql(_LIVE_R, "closure_prob", with_clearance=False) + ") r", extra=[SCORE]))
def stream_log(spark, sf):
    """The decision log written per batch."""
    return _pipeline(spark, sf)["log"].select("id", "event_cause", "zone", "predicted_severity", "recommended_personnel")


@register("stream_store", with_base(
    "SELECT id, corridor, severity_class AS severity, 'active' AS status, CAST(coalesce((SELECT min_by(cluster, (d, cluster)) FROM (SELECT cluster, "
    + HAV("clat", "clon", "f.latitude", "f.longitude") + " AS d, radius_km FROM cc) x "
    f"WHERE d <= radius_km + {vocab.DBSCAN_EPS_KM}), -1) AS INTEGER) AS cluster FROM feat f", extra=[LABELS, LF, *_CENT]))
def stream_store(spark, sf):
    """The store rows written per batch, with the online cluster of every event."""
    return _pipeline(spark, sf)["store"].select("id", "corridor", "severity", "status", "cluster")


@register("stream_hourly_tumbling", with_base(
    "SELECT CAST(date_trunc('hour', start_datetime) AS TIMESTAMP) AS window_start, CAST(count(*) AS BIGINT) AS events FROM feat, wm "
    "WHERE id % 37 <> 0 OR CAST(date_trunc('hour', start_datetime) AS TIMESTAMP) + INTERVAL 1 HOUR > wm GROUP BY 1", extra=_REPLAY))
def stream_hourly_tumbling(spark, sf):
    folder, s = _replayed(spark, sf, "hourly")
    return L.run_to_table(L.hourly_tumbling(s), folder, "hourly")


@register("stream_corridor_sliding", with_base(
    "SELECT corridor, CAST(d - k * INTERVAL 1 DAY AS TIMESTAMP) AS window_start, CAST(d - k * INTERVAL 1 DAY + INTERVAL 7 DAY AS TIMESTAMP) "
    "AS window_end, CAST(count(*) AS BIGINT) AS events FROM (SELECT id, corridor, CAST(date_trunc('day', start_datetime) AS TIMESTAMP) AS d "
    "FROM feat) f, range(7) r(k), wm WHERE id % 37 <> 0 OR d - k * INTERVAL 1 DAY + INTERVAL 7 DAY > wm GROUP BY ALL", extra=_REPLAY))
def stream_corridor_sliding(spark, sf):
    folder, s = _replayed(spark, sf, "sliding")
    return L.run_to_table(L.corridor_sliding(s), folder, "sliding")


@register("stream_site_session", with_base(
    "SELECT junction, min(start_datetime) AS session_start, max(start_datetime) + INTERVAL 30 MINUTE AS session_end, "
    "CAST(count(*) AS BIGINT) AS events FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY junction "
    "ORDER BY start_datetime, id) AS grp FROM (SELECT id, junction, start_datetime, coalesce(start_datetime > lag(start_datetime) OVER "
    "(PARTITION BY junction ORDER BY start_datetime, id) + INTERVAL 30 MINUTE, true) AS gap FROM feat, wm WHERE junction <> 'unknown' "
    "AND (id % 37 <> 0 OR start_datetime + INTERVAL 30 MINUTE > wm)) a) b GROUP BY junction, grp", extra=_REPLAY))
def stream_site_session(spark, sf):
    folder, s = _replayed(spark, sf, "session")
    return L.run_to_table(L.site_sessions(s), folder, "sessions")


@register("stream_late", with_base(
    "SELECT id, start_datetime AS ts, corridor FROM feat, nw WHERE id % 37 = 0 AND start_datetime < newest - INTERVAL 24 HOUR", extra=_REPLAY))
def stream_late(spark, sf):
    folder, s = _replayed(spark, sf, "late")
    return spark.read.parquet(L.late_rows(s, folder)).select("id", "ts", "corridor")


# A day's file is a block, late rows are the last one; eight files make a batch.
_BATCHES = ["lb AS (SELECT f.*, (dense_rank() OVER (ORDER BY CASE WHEN id % 37 = 0 THEN DATE '9999-01-01' ELSE CAST(start_datetime AS DATE) END) - 1) // 8 "
            "AS batch FROM feat f)"]


@register("live_history_state", with_base(
    "SELECT a.id, a.corridor, a.start_datetime AS ts, CAST(count(b.id) AS INTEGER) AS corridor_7d_live FROM lb a LEFT JOIN lb b ON a.corridor = b.corridor "
    "AND b.start_datetime >= a.start_datetime - INTERVAL 7 DAY AND b.start_datetime < a.start_datetime AND b.batch <= a.batch GROUP BY 1, 2, 3",
    extra=_BATCHES))
def live_history_state(spark, sf):
    folder, s = _replayed(spark, sf, "state", 8)
    return L.corridor_live_history(s, folder)
