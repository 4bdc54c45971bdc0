"""Local subgraphs against a plain search: distinct edges, and the count, edges and length of the ways that touch a box."""

import math
import random

from pyspark.sql import functions as F

from roadpulse import vocab
from roadpulse.operators import diversion as DV

_POINTS = "way_id long, seq long, lat_e5 long, lon_e5 long, highway string, lanes_raw string"


def _ways():
    rng = random.Random(8)
    ways = {}
    for w in range(120):
        y, x = 1_290_000 + 300 * rng.randrange(-20, 20), 7_750_000 + 300 * rng.randrange(-20, 20)
        ways[w] = [(y, x)]
        for _ in range(rng.randrange(1, 9)):
            # courses turn back, leave a box and come again, and stand still
            dy, dx = rng.choice([(0, 300), (300, 0), (0, -300), (-300, 0), (0, 900), (0, 0)])
            y, x = y + dy, x + dx
            ways[w].append((y, x))
    for w in range(40):
        ways[1000 + w] = ways[w]            # the same course again
    ways[2000] = [(1_290_000, 7_750_000)]   # a way without an edge
    return ways


def test_subgraph_against_plain_search(spark):
    ways = _ways()
    net = spark.createDataFrame([(w, i, y, x, "primary", "2") for w, c in ways.items() for i, (y, x) in enumerate(c)], _POINTS)
    inc = [(1, 12.9, 77.5), (2, 12.9123, 77.5051), (3, 12.96, 77.44), (4, 0.0, 0.0), (5, 12.9, 77.5), (6, 12.8999, 77.5004)]
    sub = DV.local_subgraph(spark.createDataFrame(inc, "id long, latitude double, longitude double"), net, radius_km=1.0)
    rows = {}
    for r in sub.collect():
        assert (r.lat, r.lon) == next(t[1:] for t in inc if t[0] == r.id)
        key = tuple(sorted([(r.u_lat, r.u_lon), (r.v_lat, r.v_lon)]))
        assert rows.setdefault(r.id, {}).setdefault(key, r) is r          # an edge once
    for i, la, lo in inc:
        hy, hx = 1.0 / vocab.KM_PER_DEG_LAT, 1.0 / (vocab.KM_PER_DEG_LON_EQ * math.cos(math.radians(la)) + 1e-9)
        want, n_ways = {}, 0
        for c in ways.values():
            edges = [tuple(sorted(e)) for e in zip(c, c[1:]) if e[0] != e[1]]
            if edges and any(abs(y / 1e5 - la) <= hy and abs(x / 1e5 - lo) <= hx for y, x in c):
                n_ways += 1
                for e in edges:
                    want[e] = want.get(e, 0) + 1
        got = rows.get(i, {})
        assert {e: r.edges for e, r in got.items()} == want and sum(r.ways for r in got.values()) == n_ways
        assert all(abs(r.metres - r.edges * r.m) < 1e-6 for r in got.values())
    assert rows[1].keys() == rows[5].keys() and 4 not in rows


def test_places_of_roads_keep_the_first_way(spark):
    from roadpulse.operators import roads as R
    pts = [(3, 0, 10, 20, "trunk", "4"), (2, 5, 10, 20, "primary", None), (2, 4, 10, 21, "primary", "2"), (1, 1, None, 20, "x", "1")]
    p = R.road_places(spark.createDataFrame(pts, _POINTS))
    assert {(r.lat_e5, r.lon_e5, r.way_id, r.seq, r.highway) for r in p.collect()} == {(10, 20, 2, 5, "primary"), (10, 21, 2, 4, "primary")}
    assert R.road_places(p).exceptAll(p).isEmpty() and p.filter(F.col("way_id") == 1).isEmpty()
