"""The nearest-road join against brute force; repeated places are searched once."""

import math
import random

from pyspark.sql import functions as F

from roadpulse import vocab
from roadpulse.operators import roads as R

_POINTS = "way_id long, seq long, lat_e5 long, lon_e5 long, highway string, lanes_raw string"


def test_dense_and_far_places_against_brute_force(spark):
    rng = random.Random(3)
    pts = [(w, q, 1_290_000 + rng.randrange(60), 7_750_000 + rng.randrange(60), "primary", "2") for w in range(40) for q in range(4)]
    pts += [(100 + w, 0, 1_290_000 + rng.randrange(3000), 7_750_000 + rng.randrange(3000), "trunk", "4") for w in range(40)]
    inc = [(i, round(12.9 + rng.randrange(60) * 1e-5, 5), round(77.5 + rng.randrange(60) * 1e-5, 5)) for i in range(60)]
    inc += [(100 + i, round(12.9 + rng.uniform(-0.3, 0.3), 5), round(77.5 + rng.uniform(-0.3, 0.3), 5)) for i in range(40)]
    df = spark.createDataFrame(inc + [(900, None, None), (None, 12.9, 77.5)], "id long, latitude double, longitude double")
    got = {r.id: r for r in R.road_join(df, spark.createDataFrame(pts, _POINTS)).collect()}
    lat0 = (sum(r[1] for r in inc) + 12.9) / (len(inc) + 1)
    r, c = vocab.EARTH_RADIUS_M, math.cos(math.radians(lat0))
    for i, la, lo in inc:
        d, _, _, hw = min((round(math.hypot(math.radians(la - p[2] / 1e5) * r, math.radians(lo - p[3] / 1e5) * r * c), 6), p[0], p[1], p[4]) for p in pts)
        assert abs(got[i].road_dist_m - d) < 0.06
        assert got[i].road_class == (hw if d <= 120 else vocab.UNMATCHED_ROAD_CLASS) or abs(d - 120) < 1e-3
    assert got[900].road_dist_m is None and got[None].road_dist_m is None and len(got) == len(inc) + 2


def test_repeated_places_are_searched_once(spark, monkeypatch):
    sizes, search = [], R._nearest

    def seen(spots, rds, finest):
        sizes.append((spots.count(), rds.count()))
        return search(spots, rds, finest)
    monkeypatch.setattr(R, "_nearest", seen)
    inc = spark.range(20_000).select("id", (12.9 + F.col("id") % 2 * 1e-4).alias("latitude"), F.lit(77.5).alias("longitude"))
    pts = spark.range(20_000).select(F.col("id").alias("way_id"), F.lit(1).cast("long").alias("seq"), F.lit(1_290_000).cast("long").alias("lat_e5"),
                                     (F.lit(7_750_000) + F.col("id") % 3).alias("lon_e5"), F.lit("primary").alias("highway"), F.lit("2").alias("lanes_raw"))
    j = R.road_join(inc, pts)
    assert j.count() == 20_000 and j.filter(F.col("road_dist_m") == F.rint(F.lit(0.0))).count() == 10_000
    assert sizes == [(2, 3)]
