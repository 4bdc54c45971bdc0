"""DBSCAN, k-nearest, road join and hold-out: brute force on small fixtures + golden counts."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, SF001
from roadpulse.operators import dbscan as DB
from roadpulse.operators import planning as P
from roadpulse.operators import spatial as S
from roadpulse.plans import base


def _hav_km(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    dphi, dl = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(dphi / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def _sequential_dbscan(pts, eps, min_samples):
    """Textbook sequential DBSCAN in row order (the brute-force reference)."""
    n = len(pts)
    nb = [[j for j in range(n) if _hav_km(pts[i], pts[j]) <= eps] for i in range(n)]
    core = [len(x) >= min_samples for x in nb]
    lab = [-1] * n
    c = 0
    for i in range(n):
        if lab[i] != -1 or not core[i]:
            continue
        lab[i] = c
        stack = [i]
        while stack:
            u = stack.pop()
            if not core[u]:
                continue
            for v in nb[u]:
                if lab[v] == -1:
                    lab[v] = c
                    stack.append(v)
        c += 1
    return lab


def test_dbscan_matches_sequential_bruteforce(spark):
    inc = base.incidents(spark, SF0001).select("id", "latitude", "longitude").orderBy("id")
    rows = inc.collect()
    expect = _sequential_dbscan([(r.latitude, r.longitude) for r in rows], 0.2, 5)
    got = {r.id: r.cluster_label for r in DB.dbscan(inc).collect()}
    assert [got[r.id] for r in rows] == expect


@pytest.mark.slow
def test_dbscan_fixture_counts(spark):
    lab = DB.dbscan(base.incidents(spark, SF001))
    r = lab.agg(F.count_distinct(F.when(F.col("cluster_label") >= 0, F.col("cluster_label"))).alias("c"),
                F.count_if(F.col("cluster_label") == -1).alias("noise"), F.count_if("is_core").alias("core")).first()
    assert (r.c, r.noise, r.core) == (150, 193, 9802)


def test_knn_join_matches_bruteforce(spark):
    inc = base.features(spark, SF0001).select("id", "event_cause", "latitude", "longitude", "start_datetime")
    pts = inc.withColumnRenamed("id", "pid")
    q = inc.filter(F.col("id") % 7 == 0).select(F.col("id").alias("qid"), "event_cause", "latitude", "longitude")
    got = {}
    for r in P.knn_join(q, pts, ["event_cause"], 5).collect():
        got.setdefault(r.qid, []).append((r.pool_rank, r.pid))
    P_rows = pts.collect()
    for qr in q.collect():
        cand = sorted(((_hav_km((qr.latitude, qr.longitude), (p.latitude, p.longitude)), p.start_datetime, p.pid)
                       for p in P_rows if p.event_cause == qr.event_cause))[:5]
        assert [pid for _, pid in sorted(got[qr.qid])] == [c[2] for c in cand]


def _hot_points(n, seed):
    """A third of the rows in one place, a third in a dense block of places, the rest spread widely; some keys are rare."""
    import datetime as dt
    import random
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        la, lo = ((12.97, 77.59) if i % 3 == 0 else (12.9 + rng.randrange(12) / 5000, 77.5 + rng.randrange(12) / 5000) if i % 3 == 1
                  else (12.5 + rng.random(), 77.2 + rng.random() * 0.7))
        rows.append((i, "rare" if i % 101 == 0 else "a" if i % 4 else "b", la, lo, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(50))))
    return rows


@pytest.mark.parametrize("metric,own", [("haversine", False), ("euclid_deg", True)])
def test_knn_join_with_a_hot_place(spark, metric, own):
    rows = _hot_points(600, 3)
    pts = spark.createDataFrame(rows, "pid long, key string, latitude double, longitude double, start_datetime timestamp_ntz")
    far = [(10_000, "a", 40.0, 10.0), (10_001, "none", 12.9, 77.5), (10_002, "rare", 12.97, 77.59)]
    asked = [r[:4] for r in rows if r[0] % 4 == 0] + far
    q = spark.createDataFrame(asked, "qid long, key string, latitude double, longitude double")
    got = {}
    for r in P.knn_join(q, pts, ["key"], 5, metric=metric, exclude_self=own).collect():
        got.setdefault(r.qid, []).append((r.pool_rank, r.pid, r.distance_km))
    for i, key, la, lo in asked:
        dist = (lambda r: _hav_km((la, lo), (r[2], r[3]))) if metric == "haversine" else (lambda r: math.hypot(la - r[2], lo - r[3]))
        able = {r[0]: r for r in rows if r[1] == key and not (own and r[0] == i)}
        mine = [pid for _, pid, _ in sorted(got.get(i, []))]
        assert [n for n, _, _ in sorted(got.get(i, []))] == list(range(1, min(5, len(able)) + 1))
        # the distances are the least ones (equal up to rounding), and of a place the first rows are taken in order
        assert [dist(able[p]) for p in mine] == pytest.approx(sorted(map(dist, able.values()))[:5], abs=1e-9), i
        for place in {able[p][2:4] for p in mine}:
            there = [p for p in mine if able[p][2:4] == place]
            assert there == [r[0] for r in sorted((r for r in able.values() if r[2:4] == place), key=lambda r: (r[4], r[0]))][:len(there)]


def test_candidates_of_a_hot_place_are_bounded(spark, monkeypatch):
    """What meets a query's place does not grow with the rows in one place."""
    seen = []
    for n in (600, 2400):
        pts = spark.createDataFrame(_hot_points(n, 3), "pid long, key string, latitude double, longitude double, start_datetime timestamp_ntz")
        pts = pts.withColumn("key", F.lit("all"))
        sizes = []
        cut = P.cut_lineage
        monkeypatch.setattr(P, "cut_lineage", lambda df, *a: (out := cut(df, *a), sizes.append(
            out.filter("latitude = 12.97").count() if "pid" in out.columns else 0))[0])
        P.knn_join(pts.withColumnRenamed("pid", "qid"), pts, ["key"], 5)
        monkeypatch.setattr(P, "cut_lineage", cut)
        seen.append(max(sizes))
    assert seen == [5, 5]


def test_zones_filled_by_array_or_by_join(spark, monkeypatch):
    from roadpulse.operators import spatial as S
    rows = [(i, None if i % 3 == 0 else "Unknown" if i % 3 == 1 else f"Z{i % 11}", None if i % 17 == 0 else 12.5 + (i * 37 % 100) / 100,
             77.2 + (i * 53 % 70) / 100) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, zone string, latitude double, longitude double")
    a = {r.id: r.zone for r in S.zone_impute(df).collect()}
    monkeypatch.setattr(S, "MANY_ZONES", 2)
    b = {r.id: r.zone for r in S.zone_impute(df).collect()}
    assert a == b and len(a) == 300 and sum(z in (None, "Unknown") for z in a.values()) == sum(r[2] is None and r[0] % 3 < 2 for r in rows)


def test_holdout_fixture_numbers(spark):
    from roadpulse.operators import spatial as S
    h = {r.threshold: (r.n_hot_cells, r.hits, r.n_train, r.n_test, r.occupied_cells)
         for r in S.hotspot_holdout(base.incidents(spark, SF001), period="week").collect()}
    assert h[3][:2] == (287, 659) and h[35][:2] == (123, 452) and h[60][:2] == (34, 161)
    assert h[3][2:] == (9326, 674, 476)


def test_road_join_fixture_match_count(spark):
    from roadpulse.plans.q_roads import joined
    j = joined(spark, SF001)
    assert j.filter(F.col("road_dist_m") <= 120).count() == 9475
    assert j.filter(F.col("road_dist_m").isNull()).count() == 0


def test_lanes_parse(spark):
    from roadpulse.operators.roads import lanes_parse
    df = spark.createDataFrame([("2;3",), ("4",), (None,), ("two",), ("2,2",), ("2;",)], "l string")
    assert [r[0] for r in df.select(lanes_parse(F.col("l"))).collect()] == [3.0, 4.0, None, None, 2.0, None]


def test_dbscan_of_two_hot_places(spark):
    """Copies of a place are one place of the search (F33, F41): 300,000 rows at each of two near places, 9e10 pairs of rows."""
    import time
    from pyspark.sql import functions as F
    n = 300_000
    hot = spark.range(2 * n).select("id", F.when(F.col("id") < n, 12.97).otherwise(12.9708).alias("latitude"), F.lit(77.59).alias("longitude"))
    far = spark.createDataFrame([(2 * n, 12.972, 77.59), (2 * n + 1, 13.5, 77.59)], "id long, latitude double, longitude double")
    began = time.time()
    got = DB.dbscan(hot.unionByName(far)).groupBy("cluster_label", "is_core").agg(F.count("*").alias("n"), F.max("id").alias("top")).collect()
    assert sorted(tuple(r) for r in got) == [(-1, False, 1, 2 * n + 1), (0, True, 2 * n + 1, 2 * n)]
    assert time.time() - began < 120


def test_dbscan_pairs_of_cells_without_near_ends(spark):
    """Cells whose outermost places are all too far apart are still linked by places within."""
    import random
    from math import cos, degrees, radians
    rng = random.Random(5)
    m = degrees(0.001 / 6371.0)     # a metre of latitude
    pts = [(12.9 + rng.uniform(0, 900) * m, 77.5 + rng.uniform(0, 900) * m / cos(radians(12.9))) for _ in range(400)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, latitude double, longitude double")
    for eps in (0.03, 0.06):
        expect = _sequential_dbscan(pts, eps, 4)
        got = {r.id: r.cluster_label for r in DB.dbscan(df, eps, 4).collect()}
        assert [got[i] for i in range(len(pts))] == list(expect)


def test_morans_i_writes_the_neighbours_once(spark, monkeypatch):
    """Each of the sums ranked the neighbours anew, and pairs were counted in both directions."""
    import datetime as dt
    import math
    import random

    rnd = random.Random(5)
    rows = [(i, rnd.random(), rnd.random(), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i % 3 - 1) for i in range(40)]
    d = spark.createDataFrame(rows, "id long, latitude double, longitude double, start_datetime timestamp_ntz, cluster_label int")
    written = []
    cut = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df, *a: written.append(df.columns) or cut(df, *a))
    got = S.morans_i(d, k=3).first()
    assert written == [["qid", "pid", "__k"]]
    near = {i: [j for _, j in sorted((math.hypot(a - x, b - y), j) for j, x, y, *_ in rows if j != i)[:3]] for i, a, b, *_ in rows}
    w = {(i, j): 1 / 3 for i in near for j in near[i]}
    y = [float(r[4] >= 0) for r in rows]
    n, m = len(rows), sum(y) / len(rows)
    stat = n / sum(w.values()) * sum(v * (y[i] - m) * (y[j] - m) for (i, j), v in w.items()) / sum((v - m) ** 2 for v in y)
    s0, s1 = sum(w.values()), 0.5 * sum((w.get((i, j), 0) + w.get((j, i), 0)) ** 2 for i in range(n) for j in range(n))
    s2 = sum((sum(v for (i, _), v in w.items() if i == x) + sum(v for (_, j), v in w.items() if j == x)) ** 2 for x in range(n))
    var = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1 / (n - 1) ** 2
    assert abs(got.I - stat) < 1e-9 and abs(got.z_norm - (stat + 1 / (n - 1)) / math.sqrt(var)) < 1e-6
