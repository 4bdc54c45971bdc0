"""Officer allocation per time window: least total of travel and unmet demand.

A window's events want officers (``demand``), its stations have some (``capacity``).  An
officer of a station costs round(10 km) at an event, an unmet one the penalty of the
event's severity.  The allocation of least cost is found for all windows at once, by
joins and aggregates over (window, station, event) arcs:

1. A window where every event's nearest station can hold all that want it is settled
   without bids.
2. Auction.  In a round, every event with officers still missing looks at its arcs'
   costs plus the stations' prices, takes the cheapest stations that can hold what it
   misses and bids for them up to the level of the next choice plus a step.  A station
   keeps its highest bids up to its capacity; a full station's price is its lowest
   kept bid.  A few rounds with a coarse step come near the least cost.
3. Exchanges.  For each pair of stations (unmet demand counts as one) the cheapest
   move of an officer is a minimum over the window's events.  Where moves along a
   cycle lower the cost, they are made; a cycle may pass free officers.  Without such
   a cycle the cost is the least, so the rounds end there: windows settle one by one.

Bids with steps small enough to be exact by themselves would take thousands of rounds
where stations are contested (measured); exchanges take about ten.

Bids and exchanges look only at events within the stations' reach (``within_reach``): all
others are unmet in an allocation of least cost, so a window's rounds are bounded by its
stations' officers, however many events it has.

A round's outcome is a table in the shared folder, so an executor that is lost costs a
round at most.  Stations are a closed vocabulary; an event is one row with an array of
its arcs.  No window sits in one task: a station's bids are cut to its capacity before
they are shuffled, moves are reduced in the tasks, and what is looked at per window is
a row for each pair of stations.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.geo import haversine_km
from ..session import cut_lineage

AUCTION_ROUNDS = 4
STEP = 30                   # of bids, in cost units


def priced_events(scen: DataFrame, stations: DataFrame, capacity: DataFrame) -> tuple[DataFrame, list]:
    """(events with ``penalty``, ``costs`` and ``km`` by station; the stations with officers, by name)."""
    st = stations.join(capacity, "station").filter(F.col("capacity") > 0).orderBy("station").collect()   # a closed vocabulary
    km = [haversine_km(F.lit(s.slat), F.lit(s.slon), F.col("latitude"), F.col("longitude")) for s in st]
    costs = F.array(*[F.round(k * vocab.TRAVEL_SCALE).cast("bigint") for k in km]) if st else F.expr("cast(array() as array<bigint>)")
    penalty = vocab.map_lit(vocab.UNMET_PENALTY)
    cost = F.coalesce(penalty[F.col("severity_class")], penalty[F.lit("Medium")]).cast("bigint")
    ev = scen.filter(F.col("demand") > 0).select(
        "window", "id", F.col("demand").cast("bigint").alias("demand"), cost.alias("penalty"), costs.alias("costs"),
        (F.array(*[F.round(k, 6) for k in km]) if st else F.expr("cast(array() as array<double>)")).alias("km"))
    return ev, st


def bids(missing: DataFrame, rooms: list[int]) -> DataFrame:
    """Rows (window, id, k, units, bid) of events with ``missing`` officers, their costs and the window's prices; what no station is worth stays missing."""
    room = F.array(*[F.lit(r).cast("bigint") for r in rooms])
    arcs = F.array_sort(F.filter(F.transform(F.col("costs"), lambda c, i: F.struct(
        (c + F.col("prices")[i]).alias("v"), i.cast("int").alias("k"), c.alias("c"), room[i].alias("room"))),
        lambda x: x["v"] < F.col("penalty")))
    start = F.struct(F.col("missing").alias("left"), F.lit(None).cast("bigint").alias("level"),
                     F.expr("cast(array() as array<struct<k:int,c:bigint,units:bigint>>)").alias("got"))

    def take(acc, x):
        units = F.least(acc["left"], x["room"])
        more = F.struct(
            (acc["left"] - units).alias("left"),
            # a station that is not taken whole sets the level itself
            F.when((units == acc["left"]) & (units < x["room"]), x["v"]).cast("bigint").alias("level"),
            F.concat(acc["got"], F.array(F.struct(x["k"].alias("k"), x["c"].alias("c"), units.alias("units")))).alias("got"))
        # the first choice not needed sets the level for stations that are taken whole
        done = F.struct(acc["left"].alias("left"), F.coalesce(acc["level"], x["v"]).cast("bigint").alias("level"), acc["got"].alias("got"))
        return F.when(acc["left"] > 0, more).otherwise(done)

    plan = missing.withColumn("plan", F.aggregate(arcs, start, take))
    level = F.coalesce(F.col("plan.level"), F.col("penalty")) + STEP
    return plan.select("window", "id", F.inline(F.transform(F.col("plan.got"), lambda x: F.struct(
        x["k"].alias("k"), x["units"].alias("units"), (level - x["c"]).alias("bid")))))


def kept(offers: DataFrame, rooms: list[int]) -> DataFrame:
    """Each station's highest bids up to its capacity; among equal ones who held before, then by id."""
    order = Window.partitionBy("window", "k").orderBy(F.desc("bid"), "fresh", "id")
    # an offer is for one officer at least, so no more offers than the largest capacity matter: cut before the shuffle
    first = offers.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max(rooms))
    room = F.element_at(F.array(*[F.lit(r).cast("bigint") for r in rooms]), F.col("k") + 1)
    before = F.coalesce(F.sum("units").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("units", F.least(F.col("units"), room - before)).filter(F.col("units") > 0)


def settled_at_once(ev: DataFrame, rooms: list[int]) -> DataFrame:
    """(window, contested): whether the nearest stations cannot hold all that want them, or are too far."""
    near = F.array_min("costs")
    want = ev.select("window", "demand", "penalty", near.alias("near"), (F.array_position("costs", near) - 1).cast("int").alias("k"))
    per = want.groupBy("window", "k").agg(F.sum("demand").alias("units"), F.max(F.col("near") > F.col("penalty")).alias("far"))
    room = F.element_at(F.array(*[F.lit(r).cast("bigint") for r in rooms]), F.col("k") + 1)
    return per.groupBy("window").agg(F.max((F.col("units") > room) | F.col("far")).alias("contested"))


def within_reach(ev: DataFrame, rooms: list[int]) -> DataFrame:
    """``ev`` with ``near``: whether some station would come to the event before all officers are asked for.

    A station's order is by travel less penalty.  Where it serves an event behind others that want as
    many officers as there are, one of those is short, and an officer sent there instead costs no
    more: some allocation of least cost sends no one to events that are so far back for all stations.
    """
    total = sum(rooms)
    arcs = ev.select("window", "id", "demand", F.posexplode(F.transform("costs", lambda c: c - F.col("penalty"))).alias("k", "gain"))
    order = Window.partitionBy("window", "k").orderBy("gain", "id", "demand")
    # an event wants one officer at least: cut before the shuffle
    first = arcs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= total)
    before = F.coalesce(F.sum("demand").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = first.withColumn("before", before).filter(F.col("before") < total).groupBy("window", "k").agg(F.max(F.struct("gain", "id")).alias("last"))
    per = last.groupBy("window").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "last"))), lambda x: x["last"]).alias("last"))
    near = F.exists(F.arrays_zip("costs", "last"), lambda x: F.struct((x["costs"] - F.col("penalty")).alias("gain"), F.col("id").alias("id")) <= x["last"])
    return ev.join(per, "window").withColumn("near", near).drop("last")


HELD = "array<struct<id:bigint,k:int,units:bigint,bid:bigint>>"


def bidding_round(state: DataFrame, ev: DataFrame, rooms: list[int]) -> DataFrame:
    """(window, prices, held, moved) after a round; ``held`` has at most as many rows as the stations have officers."""
    held = state.select("window", F.inline("held"))
    got = F.aggregate(F.filter("held", lambda x: x["id"] == F.col("id")), F.lit(0).cast("bigint"), lambda t, x: t + x["units"])
    missing = (ev.join(state.select("window", "prices", "held"), "window").withColumn("missing", F.col("demand") - got)
                 .filter(F.col("missing") > 0).drop("held", "demand"))
    offers = held.withColumn("fresh", F.lit(False)).unionByName(bids(missing, rooms).withColumn("fresh", F.lit(True)))
    won = kept(offers, rooms).groupBy("window").agg(
        F.max("fresh").alias("moved"), F.collect_list(F.struct("id", "k", "units", "bid")).alias("got"))
    s = state.select("window", "prices").join(won, "window", "left").withColumn("got", F.coalesce("got", F.expr(f"cast(array() as {HELD})")))
    rates = []
    for k, room in enumerate(rooms):
        own = F.filter("got", lambda x, k=k: x["k"] == k)
        full = F.aggregate(own, F.lit(0).cast("bigint"), lambda t, x: t + x["units"]) == room
        rates.append(F.when(full, F.array_min(F.transform(own, lambda x: x["bid"]))).otherwise(F.col("prices")[k]))
    return s.select("window", F.array(*rates).alias("prices"), F.col("got").alias("held"), F.coalesce("moved", F.lit(False)).alias("moved"))


def auction(ev: DataFrame, windows: DataFrame, rooms: list[int]) -> DataFrame:
    """Rows (window, id, k, units), near the least cost; k = number of stations: unmet."""
    state = cut_lineage(windows.select("window", F.array_repeat(F.lit(0).cast("bigint"), len(rooms)).alias("prices"),
                                       F.expr(f"cast(array() as {HELD})").alias("held"), F.lit(True).alias("moved")))
    for _ in range(AUCTION_ROUNDS):
        state = cut_lineage(bidding_round(state, ev, rooms))
        if state.filter("moved").isEmpty():
            break
    held = state.select("window", F.inline("held")).groupBy("window", "id", "k").agg(F.sum("units").alias("units"))
    rest = (ev.join(held.groupBy("window", "id").agg(F.sum("units").alias("sent")), ["window", "id"], "left")
              .select("window", "id", F.lit(len(rooms)).alias("k"), (F.col("demand") - F.coalesce("sent", F.lit(0))).alias("units")))
    return held.unionByName(rest.filter(F.col("units") > 0))


MOVE = "window timestamp_ntz, id long, k int, units long"


def cheaper_cycles(rooms: list[int]):
    """A function of one window's moves, a row for each pair of stations: those along cycles that lower the cost.

    Rows: (k, to, gain, id, units) the cheapest move from station k; to = -1: the officers k has sent.
    """
    unmet, free = len(rooms), len(rooms) + 1

    def cycles(window: pd.DataFrame) -> pd.DataFrame:
        sent = {r.k: r.units for r in window.itertuples() if r.to < 0}
        # (from, to) -> (cost, most officers, event): via `free`, officers come from nowhere and go where there is room
        arcs = {(r.k, r.to): (r.gain, r.units, r.id) for r in window.itertuples() if r.to >= 0}
        arcs |= {(k, free): (0, room - sent.get(k, 0), None) for k, room in enumerate(rooms) if sent.get(k, 0) < room}
        arcs |= {(unmet, free): (0, 1 << 40, None)} | {(free, k): (0, 1 << 40, None) for k in range(unmet + 1)}
        out = []
        while True:
            cost, back, last = dict.fromkeys(range(free + 1), 0), {}, None
            for _ in range(free + 1):
                last = None
                for (x, y), (c, _, _) in arcs.items():
                    if cost[x] + c < cost[y]:
                        cost[y], back[y], last = cost[x] + c, x, y
                if last is None:
                    break
            if last is None:
                return pd.DataFrame(out, columns=["window", "id", "k", "units"])
            for _ in range(free + 1):
                last = back[last]
            cycle = [last]
            while back[cycle[-1]] != last:
                cycle.append(back[cycle[-1]])
            steps = [(back[y], y) for y in cycle]
            n = min(arcs[s][1] for s in steps)
            for x, y in steps:
                if arcs[x, y][2] is not None:
                    out += [(window["window"].iloc[0], arcs[x, y][2], x, -n), (window["window"].iloc[0], arcs[x, y][2], y, n)]
            met = set(cycle) - {unmet, free}        # the stations' cheapest moves are not known behind a cycle
            gone = {arcs[s][2] for s in steps}
            arcs = {(x, y): a for (x, y), a in arcs.items() if x not in met and y not in met and (a[2] is None or a[2] not in gone)}

    return cycles


def exchanged(ev: DataFrame, held: DataFrame, rooms: list[int]) -> DataFrame:
    """``held`` (window, id, k, units) brought to the least cost of its window."""
    arcs = ev.select("window", "id", F.concat("costs", F.array("penalty")).alias("costs"))
    held = cut_lineage(held)
    tasks = int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = []
    while True:
        cost = held.join(arcs, ["window", "id"]).select("window", "id", "k", "units", F.get("costs", F.col("k")).alias("now"),
                                                        F.posexplode("costs").alias("to", "then"))
        moves = cost.filter(F.col("to") != F.col("k")).groupBy("window", "k", "to").agg(
            F.min(F.struct((F.col("then") - F.col("now")).alias("gain"), "id", "units")).alias("best")).select("window", "k", "to", "best.*")
        sent = held.groupBy("window", "k").agg(F.sum("units").alias("units")).select(
            "window", "k", F.lit(-1).alias("to"), F.lit(0).cast("bigint").alias("gain"), F.lit(0).cast("bigint").alias("id"), "units")
        # few bytes but much to search: not left to be put into one task
        made = cut_lineage(moves.unionByName(sent).repartition(tasks, "window").groupBy("window").applyInPandas(cheaper_cycles(rooms), MOVE))
        live = made.select("window").distinct()
        parts.append(held.join(live, "window", "left_anti"))
        if made.isEmpty():
            break
        held = cut_lineage(held.join(live, "window", "left_semi").unionByName(made).groupBy("window", "id", "k").agg(
            F.sum("units").alias("units")).filter(F.col("units") > 0))
    return reduce(DataFrame.unionByName, parts)


def roster_allocate(scen: DataFrame, stations: DataFrame, capacity: DataFrame) -> DataFrame:
    """Rows (window, id, station, officers, km) of least cost; ``station`` null: unmet demand."""
    ev, st = priced_events(scen, stations, capacity)
    if not st:
        return ev.select("window", "id", F.lit(None).cast("string").alias("station"), F.col("demand").cast("int").alias("officers"),
                         F.lit(0.0).alias("km"))
    rooms = [int(s.capacity) for s in st]
    ev = cut_lineage(ev)
    windows = cut_lineage(settled_at_once(ev, rooms))
    easy = ev.join(windows.filter(~F.col("contested")).select("window"), "window", "left_semi")
    near = easy.select("window", "id", (F.array_position("costs", F.array_min("costs")) - 1).cast("int").alias("k"), F.col("demand").alias("units"))
    hard = windows.filter("contested")
    if not hard.isEmpty():
        contested = cut_lineage(within_reach(ev.join(hard.select("window"), "window", "left_semi"), rooms))
        far = contested.filter(~F.col("near")).select("window", "id", F.lit(len(rooms)).alias("k"), F.col("demand").alias("units"))
        contested = cut_lineage(contested.filter("near").drop("near"))
        near = near.unionByName(exchanged(contested, auction(contested, hard, rooms), rooms)).unionByName(far)
    name = F.array(*[F.lit(s.station) for s in st])
    return near.join(ev.select("window", "id", "km"), ["window", "id"]).select(
        "window", "id", F.get(name, F.col("k")).alias("station"), F.col("units").cast("int").alias("officers"),
        F.coalesce(F.get("km", F.col("k")), F.lit(0.0)).alias("km"))


def roster_cost(scen: DataFrame, alloc: DataFrame) -> DataFrame:
    """Per window: the cost of unmet demand, of travel, and their sum."""
    penalty = vocab.map_lit(vocab.UNMET_PENALTY)
    a = alloc.join(scen.select("window", "id", "severity_class"), ["window", "id"])
    unmet = F.when(F.col("station").isNull(), F.coalesce(penalty[F.col("severity_class")], penalty[F.lit("Medium")]) * F.col("officers")).otherwise(0)
    travel = F.when(F.col("station").isNotNull(), F.round(F.col("km") * vocab.TRAVEL_SCALE) * F.col("officers")).otherwise(0)
    return a.groupBy("window").agg(F.sum(unmet).cast("bigint").alias("unmet_cost"), F.sum(travel).cast("bigint").alias("travel_cost"),
                                   F.sum(unmet + travel).cast("bigint").alias("cost"))


def roster_event_table(scen: DataFrame, alloc: DataFrame) -> DataFrame:
    """Per event: sent, short, travel and the ``station×n`` list by station."""
    sent = alloc.filter(F.col("station").isNotNull())
    per = sent.groupBy("window", "id").agg(
        F.sum("officers").alias("sent"), F.round(F.sum(F.col("officers") * F.col("km")), 3).alias("travel_km"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("station", "officers"))),
                                 lambda x: F.concat(x["station"], F.lit("×"), x["officers"].cast("string"))), ", ")
        .alias("from_stations"))
    j = scen.join(per, ["window", "id"], "left").fillna(0, ["sent"]).fillna(0.0, ["travel_km"])
    return j.select("window", "id", "severity_class", "demand", F.col("sent").cast("bigint").alias("sent"),
                    (F.col("demand") - F.col("sent")).cast("bigint").alias("short"), "travel_km", "from_stations")


def roster_kpis(table: DataFrame) -> DataFrame:
    status = F.when(F.col("short") == 0, "fulfilled").when(F.col("sent") > 0, "partial").otherwise("unmet")
    return table.groupBy("window").agg(
        F.count_if(F.col("short") > 0).cast("bigint").alias("events_short"),
        F.round(100.0 * F.sum("sent") / F.sum("demand"), 6).alias("pct_demand_met"),
        F.sum("short").cast("bigint").alias("shortage"),
        F.count_if(status == "fulfilled").cast("bigint").alias("fulfilled"),
        F.count_if(status == "partial").cast("bigint").alias("partial"),
        F.count_if(status == "unmet").cast("bigint").alias("unmet"))


def severity_alloc_unpivot(table: DataFrame) -> DataFrame:
    g = table.groupBy("window", "severity_class").agg(F.sum("sent").alias("sent"), F.sum("short").alias("short"))
    return g.unpivot(["window", "severity_class"], ["sent", "short"], "kind", "officers")
