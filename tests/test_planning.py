"""Roster allocation, planner confidence, feedback and alert fixtures, diversion invariants."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF0001
from roadpulse.operators import decide as D
from roadpulse.operators import feedback as FB
from roadpulse.operators import planning as P
from roadpulse.operators import roster as RO


def _alloc(spark, cap):
    w = dt.datetime(2024, 3, 1, 18)
    scen = spark.createDataFrame([(w, 1, 12.97, 77.60, "High", 3), (w, 2, 12.98, 77.58, "Low", 3)],
                                 "window timestamp_ntz, id long, latitude double, longitude double, "
                                 "severity_class string, demand int")
    if cap is None:
        st = spark.createDataFrame([], "station string, slat double, slon double")
        cp = spark.createDataFrame([], "station string, capacity int")
    else:
        st = spark.createDataFrame([("S", 12.97, 77.59)], "station string, slat double, slon double")
        cp = spark.createDataFrame([("S", cap)], "station string, capacity int")
    a = RO.roster_allocate(scen, st, cp).collect()
    sent = {i: sum(r.officers for r in a if r.id == i and r.station) for i in (1, 2)}
    short = {i: sum(r.officers for r in a if r.id == i and not r.station) for i in (1, 2)}
    return sent, short


def test_roster_conservation_and_priority(spark):
    sent, short = _alloc(spark, 4)
    assert sum(sent.values()) + sum(short.values()) == 6 and sum(sent.values()) == 4
    sent, short = _alloc(spark, 10)
    assert sum(short.values()) == 0
    sent, short = _alloc(spark, 3)
    assert short == {1: 0, 2: 3}
    sent, short = _alloc(spark, None)
    assert sum(sent.values()) == 0 and short == {1: 3, 2: 3}


def test_analog_confidence_table(spark):
    df = spark.createDataFrame([(0, True), (12, True), (12, False), (2, True)], "found int, local boolean")
    got = [r[0] for r in df.select(P.analog_confidence(F.col("found"), F.col("local"))).collect()]
    assert got == ["none", "high", "medium", "low"]


def test_plan_every_plannable_type(spark):
    from roadpulse.plans import base
    hist = base.features(spark, SF0001)
    q = spark.createDataFrame([(i, c, "Central Zone 1", None, None, 18) for i, c in
                               enumerate(["procession", "vip_movement", "protest", "public_event", "construction"])],
                              "qid long, cause string, zone string, latitude double, longitude double, hour int")
    p = {r.qid: r for r in P.plan_events(q, hist).collect()}
    assert len(p) == 5
    assert all(r.severity_class in ("Low", "Medium", "High") and r.personnel_count >= 1 for r in p.values())
    assert p[4].is_obstruction and not p[0].is_obstruction


def test_feedback_fixture(spark):
    log = spark.createDataFrame([("accident", "High", "High", "60", "50"), ("protest", "Medium", "High", "40", "90")],
                                "event_cause string, predicted_severity string, actual_severity string, "
                                "predicted_clearance_min string, actual_clearance_min string")
    log = FB.decision_read(FB.decision_align(log))
    s = FB.feedback_summary(log).first()
    acc = FB.feedback_severity_accuracy(log).first()
    assert (s.total, s.with_outcome, s.mae) == (2, 2, 30.0) and acc.severity_accuracy == 50.0


def test_alert_text(spark):
    df = spark.createDataFrame([("High", "vip_movement", "Central Zone 1", 0.62, 7, "Cubbon Park", True,
                                 "via Ring Road", 12.97, 77.59)],
                               "severity_class string, event_cause string, zone string, p double, personnel_count int, "
                               "dispatch_from string, barricade_required boolean, div string, latitude double, "
                               "longitude double")
    t = D.alert_message(df, prob_col="p", diversion="div").first().alert_text
    for s in ("High", "Vip Movement", "Central Zone 1", "62%", "Barricade", "Diversion", "maps.google.com"):
        assert s in t


def _grid_network(spark):
    """Own streets: a grid of 9 x 9 crossings 0.003 degree apart, and a dead end of its own in the north."""
    pts = []
    for i in range(9):
        pts += [(i, j, 1_290_000 + 300 * i, 7_750_000 + 300 * j) for j in range(9)]
        pts += [(100 + i, j, 1_290_000 + 300 * j, 7_750_000 + 300 * i) for j in range(9)]
    pts += [(200, j, 1_300_000 + 300 * j, 7_750_000) for j in range(3)]
    return spark.createDataFrame([(*p, "primary", "2") for p in pts],
                                 "way_id long, seq long, lat_e5 long, lon_e5 long, highway string, lanes_raw string")


def test_diversion_against_plain_search(spark):
    """Distances equal a plain shortest-path search over the same open edges; incidents without roads or exits say so."""
    import heapq
    from roadpulse import vocab
    from roadpulse.operators import diversion as DV
    inc = spark.createDataFrame([(1, 12.912, 77.512), (2, 0.0, 0.0), (3, 13.003, 77.5), (4, 12.9031, 77.5061), (5, 12.9, 77.5)],
                                "id long, latitude double, longitude double")
    net = _grid_network(spark)
    routes = DV.plan_routes(inc, net).cache()
    got = {x.id: x for x in routes.collect()}
    assert len(got) == 5 and not got[2].feasible and got[2].reason == vocab.NO_ROADS
    sub = DV.local_subgraph(inc, net)
    arc = DV.arcs(sub)
    nodes = DV.site_nodes(sub, arc)
    pairs = {r.id: (r.entry, r.exit) for r in DV.exit_pair(DV.exits(arc, nodes)).collect()}
    shut = {(r.id, r.node) for r in nodes.filter("shut").collect()}
    edges = {}
    for r in arc.collect():
        if (r.id, r.u) not in shut and (r.id, r.v) not in shut:
            edges.setdefault((r.id, r.u), []).append((r.v, r.m))
    for i in (1, 3, 4, 5):
        entry, goal = pairs.get(i, (None, None))
        r = got[i]
        if entry is None:
            assert not r.feasible and r.reason == vocab.NO_THROUGH_ROUTE
            continue
        best, heap = {}, [(0.0, entry)]
        while heap:
            d, n = heapq.heappop(heap)
            if n not in best:
                best[n] = d
                for v, m in edges.get((i, n), []):
                    heapq.heappush(heap, (d + m, v))
        assert r.feasible == (goal in best) and (r.feasible or r.reason == vocab.NO_ALTERNATE)
        if r.feasible:
            assert abs(r.detour_m - best[goal]) < 0.1 and r.detour_m >= r.direct_m and len(r.path) == r.n_segments + 1
            assert r.path[0] == [r.entry_lat, r.entry_lon] and r.path[-1] == [r.exit_lat, r.exit_lon]
    assert [got[i].feasible for i in (1, 3, 4)] == [True, False, True]
    hull = {r.id: r.hull for r in DV.hulls(routes, inc).collect()}
    assert set(hull) == {i for i in got if got[i].feasible}
    for i, h in hull.items():
        pts = {tuple(p) for p in got[i].path} | {(r.latitude, r.longitude) for r in inc.collect() if r.id == i}
        assert [tuple(p) for p in h] == _hull(pts)
        for a, b in zip(h, h[1:] + h[:1]):
            assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-9 for x, y in pts)


def _hull(points):
    """Convex hull by testing every pair of points as an edge: lower side from the left, then the upper side back."""
    def right_of(a, b, p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    at, out = min(points), []
    while at not in out:
        out.append(at)
        at = next(q for q in sorted(points) if q != at and all(
            (c := right_of(at, q, p)) > 1e-12 or (abs(c) <= 1e-12 and (p[0] - at[0]) ** 2 + (p[1] - at[1]) ** 2
                                                   <= (q[0] - at[0]) ** 2 + (q[1] - at[1]) ** 2) for p in points))
    return out


def test_hulls_of_random_routes(spark):
    import random
    from roadpulse.operators import diversion as DV
    rng = random.Random(4)
    rows, places = [], []
    for i in range(30):
        n = rng.choice([1, 2, 3, 10, 60])
        pts = [[rng.randrange(8) / 8.0, rng.randrange(8) / 8.0] for _ in range(n)]
        if i % 7 == 0:
            pts = [[0.25 * k, 0.25 * k] for k in range(n)]          # all on one line
        rows.append((i, True, pts))
        places.append((i, rng.randrange(8) / 8.0, rng.randrange(8) / 8.0))
    routes = spark.createDataFrame(rows, "id long, feasible boolean, path array<array<double>>")
    inc = spark.createDataFrame(places, "id long, latitude double, longitude double")
    got = {r.id: r for r in DV.hulls(routes, inc).collect()}
    for (i, _, pts), (_, la, lo) in zip(rows, places):
        own = {tuple(p) for p in pts} | {(la, lo)}
        assert [tuple(p) for p in got[i].hull] == (_hull(own) if len(own) > 1 else list(own)), (i, own)
        assert got[i].hull_vertices == len(got[i].hull)


def test_analogs_answers_equal_questions_once(spark, monkeypatch):
    """Queries of one cause, zone and place were searched, pooled and summed up one by one."""
    from roadpulse.plans import base
    hist = base.features(spark, SF0001)
    places = [("procession", "Central Zone 1", 12.97, 77.60), ("procession", None, None, None), (None, None, 12.9, 77.5),
              ("vip_movement", "Central Zone 1", None, None)]
    rows = [(i, *places[i % 4]) for i in range(40)]
    schema = "qid long, cause string, zone string, latitude double, longitude double"
    one = P._answers
    sizes = []
    monkeypatch.setattr(P, "_answers", lambda q, *a: sizes.append(q.count()) or one(q, *a))
    got = P.analogs(spark.createDataFrame(rows, schema), hist)
    want = one(spark.createDataFrame(rows, schema), hist, 10, 8)
    assert sizes == [4] and got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_analogs_of_shared_and_missing_qids(spark):
    from roadpulse.plans import base
    hist = base.features(spark, SF0001)
    rows = [(1, "procession", "Central Zone 1", 12.97, 77.60), (1, "procession", "Central Zone 1", 12.97, 77.60),
            (None, "protest", None, 12.9, 77.5), (2, "procession", "Central Zone 1", 12.97, 77.60)]
    q = spark.createDataFrame(rows, "qid long, cause string, zone string, latitude double, longitude double")
    got, want = P.analogs(q, hist), P._answers(q, hist, 10, 8)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
