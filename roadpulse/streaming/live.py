"""Live events with Structured Streaming.

The per-event HTTP path of the source system becomes micro-batches over a
file source: ``readStream`` (explicit schema) -> validate -> stream-static
joins (history medians, clearance table) -> rules -> sinks.  Every query uses
``trigger(availableNow=True)`` and a checkpoint folder under the cluster's
shared checkpoint directory, so a restarted job resumes exactly-once.

Event-time watermarks need ``timestamp`` (not ``timestamp_ntz``): the stream
edge casts under a UTC session and results are cast back.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.windows import count_in_lookback
from ..operators import analytics as A
from ..operators import clean as C
from ..operators import decide as D
from ..operators import features as FE
from ..operators import spatial as S
from ..session import checkpoint_dir, prepare

LAST_BLOCK = 1_000_000   # after every day number


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local on a cluster)."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


LATE_MOD = 37          # replayed rows whose id is a multiple arrive last
ROW_GROUP = 8 << 20    # bytes of a block's file that one task reads at least
CLOSING = "30 DAYS"    # event time of the closing rows after the newest row


def live_rows(features: DataFrame) -> DataFrame:
    """Every incident in store shape; ``closure_prob`` is taken over where the features carry it."""
    prob = F.col("closure_prob") if "closure_prob" in features.columns else F.lit(None).cast("double")
    return features.select("id", F.col("start_datetime").alias("ts"), "event_cause", "zone", "corridor", "junction",
                           "latitude", "longitude", F.col("severity_class").alias("severity"),
                           prob.alias("closure_prob"), "status", "description", "hour_of_day",
                           "day_of_week", "road_closure_binary", "corridor_7d_score", "junction_repeat_count")


def write_replay(live: DataFrame, folder: str, late_mod: int = LATE_MOD) -> str:
    """Write the live rows once, a folder per day of event time, and date the files in that order.

    Rows with ``id % late_mod == 0`` form a last block (late data).  Two closing
    rows without id, far in the future, follow: they move the watermark past all
    windows, so that every window is emitted.  A file source reads files by date.
    """
    spark = live.sparkSession
    src = os.path.join(folder, "in")
    day = F.unix_date(F.to_date("ts"))
    order = F.when(F.col("id") % late_mod == 0, F.lit(LAST_BLOCK)).otherwise(day)
    newest = live.agg(F.max("ts").alias("newest"))
    # a junction of their own lets the closing rows through the filter of the site sessions
    known = {"ts": F.col("newest") + F.expr(f"INTERVAL {CLOSING}"), "junction": F.lit("closing")}
    empty = [known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in live.schema.fields]
    closing = newest.filter("newest is not null").select(*empty)
    closing = closing.withColumn("blk", F.explode(F.array(F.lit(LAST_BLOCK + 1), F.lit(LAST_BLOCK + 2))))
    (live.withColumn("blk", order).unionByName(closing).repartition("blk").sortWithinPartitions("blk", "ts", "id")
     .write.option("parquet.block.size", ROW_GROUP).partitionBy("blk").parquet(src))
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(src).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    blocks = sorted((int(f.getPath().getName().split("=")[1]), f.getPath()) for f in fs.listStatus(hadoop.Path(src)) if f.isDirectory())
    for i, (_, path) in enumerate(blocks):
        for f in fs.listStatus(path):
            fs.setTimes(f.getPath(), 1_600_000_000_000 + 10_000 * i, -1)
    return src


def read_live(spark: SparkSession, src: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """The replay as a stream; ``schema`` is that of the live rows (the block is a folder, not a column)."""
    prepare(spark)
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
         .option("recursiveFileLookup", "true").parquet(src))
    return s.withColumn("event_time", F.col("ts").cast("timestamp"))


def version(folder: str, batch_id: int) -> str:
    """The folder of a table as it is after a batch; a batch that runs again overwrites its own."""
    return os.path.join(folder, f"batch_id={batch_id}")


def without_closing(stream: DataFrame) -> DataFrame:
    return stream.filter(F.col("id").isNotNull())


def run_to_table(stream_df: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame to a Parquet sink with availableNow; return the sink as a batch table."""
    spark = stream_df.sparkSession
    out, chk = os.path.join(folder, name), os.path.join(folder, f"{name}_chk")
    q = (stream_df.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk)
                  .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def run_foreach(stream_df: DataFrame, folder: str, name: str, fn) -> None:
    chk = os.path.join(folder, f"{name}_chk")
    q = (stream_df.writeStream.foreachBatch(fn).option("checkpointLocation", chk)
                  .trigger(availableNow=True).start())
    q.awaitTermination()


# --------------------------------------------------------------------------
# stateless pipeline: validate -> enrich -> score -> alerts / log
# --------------------------------------------------------------------------

def ingest(stream: DataFrame) -> DataFrame:
    """Every event with ``valid``: whether it meets the input contract (the others are quarantined)."""
    valid, bad = C.validate_live_event(without_closing(stream))
    return valid.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


def with_medians(events: DataFrame, medians: DataFrame) -> DataFrame:
    """Each event with the history of its corridor.

    Rows meet the medians themselves; where ids repeat or are missing, which is counted
    over the ids alone, they meet the histories of all rows of their id.
    """
    several = events.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL")
    if several.isEmpty():
        return A.history_lookup(events, medians)
    return events.join(A.history_lookup(events.select("id", "corridor"), medians).drop("corridor"), "id", "left")


def enrich_score(batch: DataFrame, medians: DataFrame, stats: DataFrame) -> DataFrame:
    """One micro-batch: text mining, corridor history (medians, else global), rules, impact."""
    d = FE.text_semantic_encode(FE.text_semantic_type(batch))
    d = d.withColumn("severity_class", F.col("severity")).drop("corridor_7d_score", "junction_repeat_count")
    d = with_medians(d, medians)
    d = d.withColumn("is_peak_hour", F.col("hour_of_day").isin(vocab.PEAK_HOURS).cast("int"))
    r = D.recommend(d, stats, prob_col="closure_prob")
    r = D.impact_score(r, prob_col="closure_prob", cluster_rate_col="cluster_closure_rate",
                       rank_col="road_class_rank", lanes_col="lane_count")
    return r


def publish_footprints(centroids: DataFrame, folder: str, since: int = 0) -> None:
    """Publish cluster footprints that hold from batch ``since`` on."""
    centroids.write.mode("overwrite").parquet(version(folder, since))


def footprints_at(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """The newest footprints published for a batch; a batch that runs again sees the same ones."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path) if f.isDirectory()]
    return spark.read.parquet(version(folder, max(v for v in known if v <= batch_id)))


def live_pipeline(stream: DataFrame, medians: DataFrame, stats: DataFrame, folder: str, footprints: str | None = None) -> dict:
    """foreachBatch: scored events, alerts, decision-log and store rows, each written idempotently per batch id.

    A store row carries the cluster whose footprint holds the event (-1: none), by the
    ``footprints`` that are newest for the batch; without them it is null.
    """
    out = {k: os.path.join(folder, k) for k in ("scored", "alerts", "log", "store")}

    def handle(batch: DataFrame, batch_id: int) -> None:
        # the batch id is the partition folder (idempotent overwrite on replay)
        s = enrich_score(without_closing(batch), medians, stats).drop("event_time")
        s.write.mode("overwrite").parquet(version(out["scored"], batch_id))
        # the other sinks read the columns they need of the written rows
        s = batch.sparkSession.read.schema(s.schema).parquet(version(out["scored"], batch_id))
        a = D.alert_message(s.filter("barricade_required"), prob_col="closure_probability")
        a.select("id", "alert_text").write.mode("overwrite").parquet(
            os.path.join(out["alerts"], f"batch_id={batch_id}"))
        s.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("logged_at"), "event_cause", "zone",
                 F.col("hour_of_day").cast("string").alias("hour_of_day"),
                 F.col("severity_class").alias("predicted_severity"),
                 F.col("estimated_clearance_minutes").cast("string").alias("predicted_clearance_min"),
                 F.col("personnel_count").cast("string").alias("recommended_personnel"),
                 F.lit("").alias("actual_clearance_min"), F.lit("").alias("actual_severity"),
                 F.lit("").alias("followed"), "id").write.mode("overwrite").parquet(
            os.path.join(out["log"], f"batch_id={batch_id}"))
        e = s.select("id", "ts", "event_cause", "zone", "corridor", "latitude", "longitude", F.col("severity_class").alias("severity"),
                     F.col("closure_probability").alias("closure_prob"), F.lit("active").alias("status"))
        if footprints is None:
            e = e.withColumn("cluster", F.lit(None).cast("int"))
        else:
            e = S.cluster_assign(e, footprints_at(batch.sparkSession, footprints, batch_id)).withColumnRenamed("assigned_cluster", "cluster")
        e.write.mode("overwrite").parquet(version(out["store"], batch_id))

    run_foreach(stream, folder, "pipeline", handle)
    return out


# --------------------------------------------------------------------------
# windows, late rows
# --------------------------------------------------------------------------

def hourly_tumbling(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    w = stream.withWatermark("event_time", watermark).groupBy(F.window("event_time", "1 hour").alias("w")) \
        .agg(F.count(F.lit(1)).alias("events"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "events")


def corridor_sliding(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    w = (stream.withWatermark("event_time", watermark)
               .groupBy("corridor", F.window("event_time", "7 days", "1 day").alias("w"))
               .agg(F.count(F.lit(1)).alias("events")))
    return w.select("corridor", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "events")


def site_sessions(stream: DataFrame, gap: str = "30 minutes", watermark: str = "1 day") -> DataFrame:
    s = (stream.filter(F.col("junction") != "unknown").withWatermark("event_time", watermark)
               .groupBy("junction", F.session_window("event_time", gap).alias("s"))
               .agg(F.count(F.lit(1)).alias("events")))
    return s.select("junction", F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "events")


def late_rows(stream: DataFrame, folder: str, lateness_hours: int = 24) -> str:
    """Rows older than (max event time of earlier batches - lateness) go to a side table.

    The aggregate drops them silently, so this branch compares each row with the
    newest event time *before* aggregation.  That time is a running maximum, a row per
    batch id: a batch reads the row of the batch before it and overwrites its own.
    """
    spark = stream.sparkSession
    side, state = os.path.join(folder, "late"), os.path.join(folder, "late_state")
    row = stream.drop("event_time").schema
    spark.createDataFrame([], row).write.parquet(os.path.join(side, "batch_id=-1"))
    spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS max_ts").write.parquet(version(state, -1))

    def handle(batch: DataFrame, batch_id: int) -> None:
        own = without_closing(batch)
        seen = batch.sparkSession.read.parquet(version(state, batch_id - 1)).select(F.col("max_ts").alias("__seen"))
        late = own.crossJoin(F.broadcast(seen)).filter(
            F.col("event_time") < F.col("__seen") - F.expr(f"INTERVAL {int(lateness_hours)} HOURS"))
        late.drop("event_time", "__seen").write.mode("overwrite").parquet(os.path.join(side, f"batch_id={batch_id}"))
        newest = own.agg(F.max("event_time").alias("own")).crossJoin(seen).select(F.greatest("own", "__seen").alias("max_ts"))
        newest.write.mode("overwrite").parquet(version(state, batch_id))

    run_foreach(stream, folder, "late", handle)
    return side


# --------------------------------------------------------------------------
# history of live events: look-back counts, and the store that enriches events
# --------------------------------------------------------------------------

WEEK = "INTERVAL 7 DAYS"


def corridor_live_history(stream: DataFrame, folder: str) -> DataFrame:
    """(id, corridor, ts, corridor_7d_live): events of the corridor in [t - 7 days, t) that had arrived by the row's batch.

    Rows in order need the last week of the store, late rows that of their own time: the
    store is kept by day of event time, and a batch reads the days its rows look back
    on.  The counts are differences of bucketed prefix counts, so no task holds a corridor.
    A batch that runs again overwrites its rows in the store and in the result.
    """
    spark = stream.sparkSession
    store, out = os.path.join(folder, "week_store"), os.path.join(folder, "week_counts")
    row = "id long, corridor string, ts timestamp_ntz"
    spark.createDataFrame([], row + ", corridor_7d_live int").write.parquet(version(out, -1))
    spark.createDataFrame([], row + ", day date, batch_id int").write.parquet(os.path.join(store, "day=1970-01-01", "batch_id=-1"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        own = without_closing(batch).select("id", "corridor", "ts").persist()
        first, last = own.agg(F.min("ts"), F.max("ts")).first()
        if first is not None:
            held = session.read.schema(row + ", day date, batch_id int").parquet(store).filter(
                (F.col("batch_id") < batch_id) & F.col("day").between(F.to_date(F.lit(first) - F.expr(WEEK)), F.to_date(F.lit(last))))
            both = held.select("id", "corridor", "ts", F.lit(False).alias("fresh")).unionByName(own.withColumn("fresh", F.lit(True)))
            counted = count_in_lookback(both, ["corridor"], "ts", "id", "corridor_7d_live")
            counted.filter("fresh").drop("fresh").write.mode("overwrite").parquet(version(out, batch_id))
            (own.withColumn("day", F.to_date("ts")).withColumn("batch_id", F.lit(batch_id)).repartition("day")
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(store))
        own.unpersist()

    run_foreach(stream, folder, "week", handle)
    return spark.read.parquet(out).drop("batch_id")


STORE = {"recent": "corridor string, ts timestamp_ntz, n long", "junctions": "junction string, n long", "newest": "ts timestamp_ntz"}


def store_after(before: dict[str, DataFrame], rows: DataFrame) -> dict[str, DataFrame]:
    """The live store after more rows: events of its last week by corridor and time, totals by junction, the newest time.

    The week ends at the newest row, which only moves on, so older rows can go.
    """
    newest = before["newest"].unionByName(rows.select("ts")).agg(F.max("ts").alias("ts"))
    recent = (before["recent"].unionByName(rows.groupBy("corridor", "ts").agg(F.count(F.lit(1)).alias("n")))
              .join(F.broadcast(newest.select(F.col("ts").alias("__newest"))), F.col("ts") >= F.col("__newest") - F.expr(WEEK))
              .groupBy("corridor", "ts").agg(F.sum("n").alias("n")))
    junctions = (before["junctions"].unionByName(rows.filter("junction <> 'unknown'").groupBy("junction").agg(F.count(F.lit(1)).alias("n")))
                 .groupBy("junction").agg(F.sum("n").alias("n")))
    return {"recent": recent, "junctions": junctions, "newest": newest}


def with_live_history(events: DataFrame, store: dict[str, DataFrame], medians: DataFrame) -> DataFrame:
    """``events`` with the two history values and where each comes from: the caller's own value, else the live store
    once it holds an event, else the corridor's median (all corridors' where it has none)."""
    own = {"corridor_7d_score": "corridor", "junction_repeat_count": "junction"}
    e = events.withColumnsRenamed({c: f"__own_{c}" for c in own})
    week = store["recent"].groupBy("corridor").agg(F.sum("n").alias("__live_corridor_7d_score"))
    e = e.join(week, "corridor", "left").join(store["junctions"].withColumnRenamed("n", "__live_junction_repeat_count"), "junction", "left")
    e = e.crossJoin(F.broadcast(store["newest"].agg(F.max("ts").isNotNull().alias("__warm"))))      # one row
    e = A.history_lookup(e, medians)
    for c in own:
        live = F.when(F.col("__warm"), F.coalesce(F.col(f"__live_{c}"), F.lit(0)))
        e = e.withColumn(c.rsplit("_", 1)[0] + "_source", F.when(F.col(f"__own_{c}").isNotNull(), "override").when(F.col("__warm"), "live").otherwise("median"))
        e = e.withColumn(c, F.coalesce(F.col(f"__own_{c}"), live, F.col(c)).cast("long"))
    return e.drop("__warm", *[f"__{k}_{c}" for k in ("own", "live") for c in own])


def enrich_live(stream: DataFrame, medians: DataFrame, folder: str) -> DataFrame:
    """Live events with text type and history; a batch sees the store of the batches before it and leaves the next version."""
    spark = stream.sparkSession
    state, out = os.path.join(folder, "store"), os.path.join(folder, "enriched")
    for name, schema in STORE.items():
        spark.createDataFrame([], schema).write.parquet(version(os.path.join(state, name), -1))

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        own = without_closing(batch).drop("event_time")
        before = {k: session.read.schema(s).parquet(version(os.path.join(state, k), batch_id - 1)) for k, s in STORE.items()}
        d = FE.text_semantic_encode(FE.text_semantic_type(own))
        with_live_history(d, before, medians).write.mode("overwrite").parquet(version(out, batch_id))
        for name, table in store_after(before, own).items():
            table.write.mode("overwrite").parquet(version(os.path.join(state, name), batch_id))

    run_foreach(stream, folder, "enrich", handle)
    return spark.read.parquet(out).drop("batch_id")
