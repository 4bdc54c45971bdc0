"""Cluster assignment against brute force: overlapping clusters, repeated places, repeated and missing ids."""

import math
import random

from roadpulse import vocab
from roadpulse.operators import spatial as S

POINTS = "id long, note string, latitude double, longitude double"
CENTROIDS = "cluster int, clat double, clon double, radius_km double"


def km(a, b, c, d):
    h = (math.sin(math.radians(c - a) / 2) ** 2
         + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2)
    return 2 * vocab.EARTH_RADIUS_KM * math.asin(math.sqrt(h))


def brute(points, centroids):
    least = {}
    for i, _, la, lo in points:
        if None not in (i, la, lo):
            near = [(d, k) for k, a, b, r in centroids if (d := km(a, b, la, lo)) <= r + vocab.DBSCAN_EPS_KM]
            least[i] = min([*near, *([least[i]] if i in least else [])], default=None) or least.get(i)
            if least[i] is None:
                del least[i]
    return sorted(((p[0], p[1], least[p[0]][1] if p[0] in least else -1) for p in points), key=str)


def rows(df):
    return sorted(((r.id, r.note, r.assigned_cluster) for r in df.collect()), key=str)


def made(n_points, n_clusters):
    rnd = random.Random(4)
    centroids = [(k, 12.9 + rnd.random() * 0.004, 77.5 + rnd.random() * 0.004, rnd.random() * 0.4) for k in range(n_clusters)]
    centroids += [(900, 12.95, 77.55, 3.0), (901, 12.95, 77.55, 3.0)]        # equal distance, many cells
    places = [(12.88 + rnd.random() * 0.1, 77.48 + rnd.random() * 0.1) for _ in range(n_points)]
    points = [(i, "a", *p) for i, p in enumerate(places + places[:20])]
    points += [(3, "b", 12.9001, 77.5001), (3, "c", None, 77.5), (None, "d", 12.9001, 77.5001), (7_000, "e", 12.9, None),
               (7_001, "f", 0.0, 0.0), (7_001, "g", *places[5]), (7_002, "h", -0.0, 0.0)]
    return points, centroids


def test_nearest_footprint(spark, monkeypatch):
    points, centroids = made(150, 60)
    p, c = spark.createDataFrame(points, POINTS), spark.createDataFrame(centroids, CENTROIDS)
    want = brute(points, centroids)
    assert rows(S.cluster_assign(p, c)) == want
    assert S.cluster_assign(p, c).columns == ["id", "note", "latitude", "longitude", "assigned_cluster"]
    monkeypatch.setattr(S, "CELL_CENTROIDS", 4)         # the centroids of a cell in many rows
    assert rows(S.cluster_assign(p, c)) == want
    assert rows(S.cluster_assign(p, c.limit(0))) == sorted(((i, t, -1) for i, t, _, _ in points), key=str)


def test_pairs_of_places_and_clusters_are_no_rows(spark):
    """Many rows at one place within many clusters: no step of the plan makes a row for each pair."""
    points = [(i, "a", 12.9, 77.5) for i in range(300)]
    centroids = [(k, 12.9 + k * 1e-6, 77.5, 0.1) for k in range(200)]
    out = S.cluster_assign(spark.createDataFrame(points, POINTS), spark.createDataFrame(centroids, CENTROIDS))
    assert {r.assigned_cluster for r in out.collect()} == {0}
    plan, made = [out._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            node = node.executedPlan()
            name = node.nodeName()
        if name.endswith("QueryStage"):
            plan.append(node.plan())
        metrics = node.metrics()
        if "Join" in name and metrics.contains("numOutputRows"):
            made = max(made, metrics.apply("numOutputRows").value())
        kids = node.children()
        plan += [kids.apply(i) for i in range(kids.size())]
    assert 0 < made <= 1000          # not 300 x 200
