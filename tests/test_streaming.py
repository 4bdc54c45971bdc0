"""Structured Streaming: replayed files, watermarked windows vs batch, stateful counts vs batch."""

from pyspark.sql import functions as F

from conftest import SF0001
from roadpulse.plans import base
from roadpulse.streaming import live as L


def _replay(spark, name):
    folder = L.scratch(spark, name)
    rows = L.live_rows(base.features(spark, SF0001))
    return folder, L.read_live(spark, L.write_replay(rows, folder), rows.schema), rows


def test_hourly_windows_equal_batch(spark):
    """Every window comes out; late rows count where the watermark had not passed their window."""
    import datetime as dt
    folder, s, rows = _replay(spark, "t_hourly")
    got = {r.window_start: r.events for r in L.run_to_table(L.hourly_tumbling(s), folder, "hourly").collect()}
    data = rows.select("id", "ts").collect()
    newest = max(r.ts for r in data if r.id % L.LATE_MOD)
    # judged by the watermark of the batch before the last day's
    mark = max(r.ts for r in data if r.id % L.LATE_MOD and r.ts.date() < newest.date()) - dt.timedelta(days=1)
    exp = {}
    for r in data:
        start = r.ts.replace(minute=0, second=0, microsecond=0)
        if r.id % L.LATE_MOD or start + dt.timedelta(hours=1) > mark:
            exp[start] = exp.get(start, 0) + 1
    assert got == exp


def test_late_rows_are_set_aside(spark):
    import datetime as dt
    folder, s, rows = _replay(spark, "t_late")
    got = {r.id for r in spark.read.parquet(L.late_rows(s, folder)).collect()}
    data = rows.select("id", "ts").collect()
    newest = max(r.ts for r in data if r.id % L.LATE_MOD)
    assert got == {r.id for r in data if r.id % L.LATE_MOD == 0 and r.ts < newest - dt.timedelta(hours=24)} and got


def _batch_of(data, files=8):
    """The micro-batch of each row: a day's file is a block, late rows are the last one."""
    import datetime as dt
    block = {r.id: dt.date.max if r.id % L.LATE_MOD == 0 else r.ts.date() for r in data}
    order = {b: i // files for i, b in enumerate(sorted(set(block.values())))}
    return {i: order[b] for i, b in block.items()}


def _eight_files(spark, name):
    folder = L.scratch(spark, name)
    rows = L.live_rows(base.features(spark, SF0001))
    return folder, L.read_live(spark, L.write_replay(rows, folder), rows.schema, 8), rows


def test_look_back_counts_of_all_rows(spark):
    """Late rows too: what had arrived by the row's batch, in the week before its own time."""
    import datetime as dt
    folder, s, rows = _eight_files(spark, "t_state")
    out = {r.id: r.corridor_7d_live for r in L.corridor_live_history(s, folder).collect()}
    data = rows.select("id", "ts", "corridor").collect()
    batch = _batch_of(data)
    assert len(out) == len(data) and any(r.id % L.LATE_MOD == 0 for r in data)
    for r in data:
        assert out[r.id] == sum(x.corridor == r.corridor and r.ts - dt.timedelta(days=7) <= x.ts < r.ts and batch[x.id] <= batch[r.id] for x in data)


def test_history_by_precedence(spark):
    """Own value, else the store of the batches before, else the medians; the store keeps its last week only."""
    import datetime as dt
    folder, s, rows = _eight_files(spark, "t_enrich")
    med = spark.createDataFrame([("Corridor 1", False, 70, 71, 5.0), (None, True, 90, 91, 7.0)],
                                "corridor string, is_global boolean, corridor_7d_score long, junction_repeat_count long, lane_count double")
    own = {c: F.when(F.col("id") % 5 == 0, F.lit(1000) + F.col("id")) for c in ("corridor_7d_score", "junction_repeat_count")}
    got = {r.id: r for r in L.enrich_live(s.withColumns(own), med, folder).collect()}
    data = rows.select("id", "ts", "corridor", "junction").collect()
    batch = _batch_of(data)
    assert len(got) == len(data)
    for r in data:
        g, seen = got[r.id], [x for x in data if batch[x.id] < batch[r.id]]
        if r.id % 5 == 0:
            want = (1000 + r.id, "override", 1000 + r.id, "override")
        elif seen:
            since = max(x.ts for x in seen) - dt.timedelta(days=7)
            want = (sum(x.corridor == r.corridor and x.ts >= since for x in seen), "live",
                    sum(x.junction == r.junction != "unknown" for x in seen), "live")
        else:
            want = (70, "median", 71, "median") if r.corridor == "Corridor 1" else (90, "median", 91, "median")
        assert (g.corridor_7d_score, g.corridor_7d_source, g.junction_repeat_count, g.junction_repeat_source) == want
    assert {g.corridor_7d_source for g in got.values()} == {"override", "live", "median"}
    last = max(batch.values())
    newest = max(r.ts for r in data)
    # the closing rows' batch has no event: the store's newest time and its last week stay
    recent = spark.read.parquet(L.version(f"{folder}/store/recent", last)).collect()
    assert min(r.ts for r in recent) >= newest - dt.timedelta(days=7)
    assert sum(r.n for r in recent) == sum(r.ts >= newest - dt.timedelta(days=7) for r in data)


def test_a_batch_that_runs_again_changes_nothing(spark):
    rows = L.live_rows(base.features(spark, SF0001)).select("corridor", "ts", "junction")
    empty = {k: spark.createDataFrame([], v) for k, v in L.STORE.items()}
    half = rows.filter(F.dayofmonth("ts") < 15)
    one = L.store_after(empty, half)
    again = L.store_after(empty, half)
    for k in one:
        assert sorted(map(tuple, one[k].collect()), key=str) == sorted(map(tuple, again[k].collect()), key=str)
    assert L.store_after(one, rows.limit(0))["newest"].first()[0] == one["newest"].first()[0]


def test_online_clusters_follow_the_newest_footprints(spark):
    """Every store row has the cluster of the footprints published for its batch."""
    from roadpulse.operators import spatial as S
    from roadpulse.plans.q_spatial import labelled
    from roadpulse.plans.q_stream import _static
    folder, s, rows = _eight_files(spark, "t_store")
    cents = S.cluster_centroids(labelled(spark, SF0001))
    path = L.scratch(spark, "t_footprints")
    L.publish_footprints(cents, path)
    L.publish_footprints(cents.withColumn("cluster", F.col("cluster") + 5000), path, 2)
    out = L.live_pipeline(s, *_static(spark, SF0001), folder, path)
    got = {r.id: r.cluster for r in spark.read.parquet(out["store"]).collect()}
    want = {r.id: r.assigned_cluster for r in S.cluster_assign(rows.select("id", "latitude", "longitude"), cents).collect()}
    batch = _batch_of(rows.select("id", "ts").collect())
    assert max(batch.values()) >= 2 and len(got) == len(want)
    assert all(got[i] == (c + 5000 if c >= 0 and batch[i] >= 2 else c) for i, c in want.items())
