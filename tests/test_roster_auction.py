"""The roster auction against the least cost found by trying every split of small windows."""

import datetime as dt
import random
from functools import lru_cache
from itertools import product

import pytest

from roadpulse.operators import roster as RO

W0 = dt.datetime(2024, 3, 1)
SCEN = "window timestamp_ntz, id long, latitude double, longitude double, severity_class string, demand int"


def least_cost(costs, penalties, demands, rooms) -> int:
    """costs[event][station]; every way to deal out the stations' officers one station after the other."""
    @lru_cache(None)
    def best(k, left):
        if k == len(rooms):
            return sum(n * p for n, p in zip(left, penalties))
        return min(sum(x * costs[e][k] for e, x in enumerate(xs)) + best(k + 1, tuple(n - x for n, x in zip(left, xs)))
                   for xs in product(*[range(min(n, rooms[k]) + 1) for n in left]) if sum(xs) <= rooms[k])

    return best(0, tuple(demands))


def build(spark, windows, stations):
    """windows: lists of (lat, lon, severity, demand); stations: (name, lat, lon, capacity)."""
    rows = [(W0 + dt.timedelta(hours=w), 100 * w + i, la, lo, s, d) for w, ev in enumerate(windows) for i, (la, lo, s, d) in enumerate(ev)]
    st = spark.createDataFrame([x[:3] for x in stations], "station string, slat double, slon double")
    cp = spark.createDataFrame([(x[0], x[3]) for x in stations], "station string, capacity int")
    return spark.createDataFrame(rows, SCEN), st, cp


def check(spark, windows, stations):
    scen, st, cp = build(spark, windows, stations)
    alloc = RO.roster_allocate(scen, st, cp).cache()
    rows = alloc.collect()
    ev, used = RO.priced_events(scen, st, cp)
    arcs = {r.id: (r.costs, r.penalty) for r in ev.collect()}
    rooms = [s.capacity for s in used]
    names = [s.station for s in used]
    cost = {r.window: r.cost for r in RO.roster_cost(scen, alloc).collect()}
    for w, events in enumerate(windows):
        own = [r for r in rows if r.id // 100 == w]
        for i, e in enumerate(events):
            assert sum(r.officers for r in own if r.id == 100 * w + i) == e[3]
        for name, room in zip(names, rooms):
            assert sum(r.officers for r in own if r.station == name) <= room
        some = [(i, e) for i, e in enumerate(events) if e[3] > 0]
        want = least_cost([arcs[100 * w + i][0] for i, _ in some], [arcs[100 * w + i][1] for i, _ in some], [e[3] for _, e in some], rooms)
        assert cost.get(W0 + dt.timedelta(hours=w), 0) == want, (w, events)
    alloc.unpersist()
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_least_cost_of_random_windows(spark, seed):
    rng = random.Random(seed)
    grid = [round(12.9 + i / 50, 6) for i in range(4)]          # few places, so that many costs are equal
    stations = [(f"S{i}", rng.choice(grid), rng.choice(grid) + 64.7, rng.randint(0, 4)) for i in range(4)]
    windows = [[(rng.choice(grid), rng.choice(grid) + 64.7, rng.choice(["High", "Medium", "Low"]), rng.randint(0, 5))
                for _ in range(rng.randint(1, 3))] for _ in range(60)]
    check(spark, windows, stations)


def test_travel_decides_who_serves_whom(spark):
    """Running sums by station name would send A's officers to the far event."""
    stations = [("A", 12.9, 77.5, 2), ("B", 13.0, 77.6, 2)]
    rows = check(spark, [[(13.0, 77.6, "High", 2), (12.9, 77.5, "Low", 2)]], stations)
    assert {(r.id, r.station, r.officers) for r in rows} == {(0, "B", 2), (1, "A", 2)}


def test_penalties_far_stations_and_no_officers(spark):
    far = [("A", 12.9, 77.5, 3), ("F", 14.5, 77.5, 5)]          # F is about 178 km off: beyond the penalty of a Low officer
    rows = check(spark, [[(12.9, 77.5, "Low", 4), (12.9, 77.5, "High", 2)]], far)
    assert sum(r.officers for r in rows if r.station is None) == 3
    none = RO.roster_allocate(*build(spark, [[(12.9, 77.5, "Low", 4)]], [("A", 12.9, 77.5, 0)])).collect()
    assert [(r.station, r.officers) for r in none] == [(None, 4)]


def test_bids_are_cut_to_the_capacity_before_the_shuffle(spark):
    scen, st, cp = build(spark, [[(12.9, 77.5, "High", 2)] * 50], [("A", 12.9, 77.5, 3), ("B", 12.95, 77.5, 4)])
    offers = spark.range(100).selectExpr("timestampadd(HOUR, id % 2, timestamp_ntz'2024-03-01') AS window", "id", "cast(id % 2 AS int) AS k", "1L AS units", "id AS bid", "true AS fresh")
    plan = RO.kept(offers, [3, 4])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    got = RO.roster_allocate(scen, st, cp)
    assert sorted((r.station or "", r.sum) for r in got.groupBy("station").agg({"officers": "sum"}).toDF("station", "sum").collect()) == [
        ("", 93), ("A", 3), ("B", 4)]


def test_only_events_within_reach_take_part_in_the_rounds(spark, monkeypatch):
    """Every event of a contested window went through every round, however few officers there were."""
    rng = random.Random(3)
    stations = [("A", 12.9, 77.5, 2), ("B", 12.95, 77.55, 3), ("C", 13.0, 77.6, 1)]
    few = [(13.0 - i / 100, 77.5 + i / 50, s, d) for i, (s, d) in enumerate([("High", 2), ("Medium", 3), ("High", 1)])]
    low = [(round(12.9 + rng.randrange(10) / 100, 6), round(77.5 + rng.randrange(10) / 100, 6), "Low", 1 + i % 3) for i in range(80)]
    seen: list[int] = []
    auction = RO.auction
    monkeypatch.setattr(RO, "auction", lambda ev, *a: seen.append(ev.count()) or auction(ev, *a))
    scen, st, cp = build(spark, [few + low], stations)
    alloc = RO.roster_allocate(scen, st, cp).cache()
    assert seen[0] < 25                       # 83 before
    # the High and Medium events want all officers, so the least cost is theirs alone
    small, _, _ = build(spark, [few], stations)
    ev, used = RO.priced_events(small, st, cp)
    arcs = ev.orderBy("id").collect()
    want = least_cost([r.costs for r in arcs], [r.penalty for r in arcs], [r.demand for r in arcs], [s.capacity for s in used])
    assert RO.roster_cost(scen, alloc).first()["cost"] == want + 1000 * sum(e[3] for e in low)
    given = {r.id: r.n for r in alloc.groupBy("id").agg({"officers": "sum"}).toDF("id", "n").collect()}
    assert given == {i: e[3] for i, e in enumerate(few + low)}
    alloc.unpersist()


def test_reach_of_random_windows_keeps_the_least_cost(spark):
    rng = random.Random(9)
    stations = [("A", 12.9, 77.5, 1), ("B", 13.0, 77.6, 2)]
    windows = [[(round(12.9 + rng.randrange(4) / 30, 6), round(77.5 + rng.randrange(4) / 30, 6), rng.choice(["High", "Low", "Low"]), rng.randint(1, 2))
                for _ in range(7)] for _ in range(25)]
    check(spark, windows, stations)
