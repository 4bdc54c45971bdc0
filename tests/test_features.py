"""Unit fixtures for cleaning, leakage-free windows, data quality and impact."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import clean as C
from roadpulse.operators import decide as D
from roadpulse.operators import features as FE


def _ts(s):
    return dt.datetime.fromisoformat(s)


def test_junction_repeat_is_backward_looking(spark):
    rows = [(1, "MG Road", _ts("2024-01-01 08:00")), (2, "MG Road", _ts("2024-01-02 08:00")),
            (3, "MG Road", _ts("2024-01-03 08:00")), (4, "BTM", _ts("2024-01-05 08:00"))]
    df = spark.createDataFrame(rows, "id long, junction string, start_datetime timestamp_ntz")
    got = {r.id: r.junction_repeat_count for r in FE.feat_junction_repeat(df).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 0}


def test_unknown_junction_is_zero(spark):
    rows = [(i, "unknown", _ts(f"2024-01-0{i} 08:00")) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "id long, junction string, start_datetime timestamp_ntz")
    assert [r.junction_repeat_count for r in FE.feat_junction_repeat(df).collect()] == [0, 0, 0]


def test_corridor_7d_window(spark):
    rows = [(1, "ORR", _ts("2024-01-01 08:00")), (2, "ORR", _ts("2024-01-03 08:00")),
            (3, "ORR", _ts("2024-01-06 08:00")), (4, "ORR", _ts("2024-01-20 08:00"))]
    df = spark.createDataFrame(rows, "id long, corridor string, start_datetime timestamp_ntz")
    got = {r.id: r.corridor_7d_score for r in FE.feat_corridor_7d(df).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 0}


def test_corridor_7d_boundary_and_skew_safe_equals_window(spark):
    # exactly 7 days earlier is inside the window; strictly earlier only
    rows = [(1, "A", _ts("2024-01-01 00:00")), (2, "A", _ts("2024-01-08 00:00")),
            (3, "A", _ts("2024-01-08 00:00:00.000001")), (4, "B", _ts("2024-01-08 00:00"))]
    df = spark.createDataFrame(rows, "id long, corridor string, start_datetime timestamp_ntz")
    a = {r.id: r.corridor_7d_score for r in FE.feat_corridor_7d(df).collect()}
    from roadpulse.functions.windows import count_in_lookback_window
    b = {r.id: r.corridor_7d_score for r in count_in_lookback_window(df, ["corridor"], "start_datetime",
                                                                     "corridor_7d_score").collect()}
    assert a == b == {1: 0, 2: 1, 3: 1, 4: 0}


def test_dq_clean_and_bad(spark):
    good = spark.createDataFrame([(1, 12.97, 77.59, _ts("2024-01-01 00:00"), "accident", "active"),
                                  (2, 12.98, 77.60, _ts("2024-01-01 01:00"), "flood", "closed")],
                                 "id long, latitude double, longitude double, start_datetime timestamp_ntz, "
                                 "event_cause string, status string")
    assert C.dq_validate(good).count() == 0
    bad = good.withColumn("latitude", F.when(F.col("id") == 1, 28.6).otherwise(F.col("latitude")))
    issues = C.dq_validate(bad).collect()
    assert [(r.issue, r.column_name, r.n) for r in issues] == [("out_of_range", "latitude", 1)]
    with pytest.raises(C.MissingColumnsError):
        C.dq_validate(good.drop("status"))
    soft = C.dq_validate(good.drop("status"), raise_on_critical=False).collect()
    assert soft[0].issue == "missing_required_column"


def test_clean_rules(spark):
    raw = spark.createDataFrame(
        [(1, "2024-01-01 08:00:00+00", " TRUE ", " Water_Logging ", "P1", None, None, " LCV ", None, 0.0),
         (2, "garbage", "maybe", "NULL", "High", " ORR ", "East Zone 1", None, "J1", 12.9)],
        "id long, start_datetime string, requires_road_closure string, event_cause string, priority string, "
        "corridor string, zone string, veh_type string, junction string, endlatitude double")
    out = {r.id: r for r in C.clean_pipeline(raw).collect()}
    assert list(out) == [1]
    r = out[1]
    assert r.start_datetime == _ts("2024-01-01 08:00") and r.requires_road_closure is True
    assert (r.event_cause, r.priority, r.corridor, r.zone, r.veh_type, r.junction, r.endlatitude) == \
        ("water_logging", "Low", "Non-corridor", "Unknown", "lcv", "unknown", None)


def test_semantic_types(spark):
    texts = [("Cricket match at [LOCATION]", "sports_event"), ("VIP convoy", "vip_movement"),
             ("ಮರ ಬಿದ್ದಿದೆ", "tree_fall"), ("white car", "accident"), ("   ", "other"), (None, "other"),
             ("[PERSON] asked", "other")]
    df = spark.createDataFrame([(t,) for t, _ in texts], "description string")
    got = [r.event_semantic_type for r in FE.text_semantic_type(df).collect()]
    assert got == [e for _, e in texts]


def _impact(spark, rows):
    df = spark.createDataFrame(rows, "id long, road_closure_binary int, corridor_7d_score int, is_peak_hour int, "
                                     "closure_prob double")
    return {r.id: r for r in D.impact_score(df, prob_col="closure_prob", cluster_rate_col=None, rank_col=None,
                                            lanes_col=None).collect()}


def test_impact_bounds_and_monotonic(spark):
    r = _impact(spark, [(1, 0, 0, 0, None), (2, 1, 100, 1, None), (3, 0, 5, 0, 0.1), (4, 0, 5, 0, 0.9),
                        (5, 1, 5, 0, 0.1)])
    assert r[1].impact_label == "Low" and r[2].impact_label == "Severe"
    assert all(0 <= x.impact_score <= 100 for x in r.values())
    assert r[3].impact_score < r[4].impact_score and r[3].impact_score < r[5].impact_score


def test_recommend_rules(spark):
    df = spark.createDataFrame([(1, "High", "accident", 1, 18, "North Zone 1"),
                                (2, "Low", "vehicle_breakdown", 0, 3, "Nowhere")],
                               "id long, severity_class string, event_cause string, road_closure_binary int, "
                               "hour_of_day int, zone string")
    out = {r.id: r for r in D.recommend(df).collect()}
    assert out[1].personnel_count == 5 + 1 + 1 and out[1].barricade_required and out[1].diversion_recommended
    assert out[1].dispatch_from == "Hebbala" and out[1].priority_flag == "URGENT"
    assert out[2].personnel_count == 2 and not out[2].barricade_required and out[2].dispatch_from == "Cubbon Park"
    assert out[2].rationale == "Low severity event; high-incident window"


def test_prefix_counts_shuffle_the_rows_once(spark):
    """No join with the bucket totals, so the rows of a running count cross one exchange (F25-F44: the feature table)."""
    from roadpulse.functions.windows import count_in_lookback, running_before
    rows = [(1, "A", _ts("2024-01-01 08:00"), 1), (2, "A", _ts("2024-01-01 08:30"), 0), (2, "A", _ts("2024-01-01 08:30"), 0),
            (None, "A", _ts("2024-01-02 08:00"), 1), (5, None, _ts("2024-01-02 08:00"), None), (6, None, _ts("2024-01-03 08:00"), 1)]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp_ntz, v int")
    r = running_before(df, ["k"], "t", "id", "n", value="v", out_sum="s")
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert sorted((str(x.id), str(x.k), x.n, x.s) for x in r.collect()) == sorted([
        ("1", "A", 0, 0), ("2", "A", 1, 1), ("2", "A", 2, 1), ("None", "A", 3, 1), ("5", "None", 0, 0), ("6", "None", 1, 0)])
    assert r.columns == ["id", "k", "t", "v", "n", "s"]
    c = count_in_lookback(df, ["k"], "t", "id", "c")
    assert c._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = sorted((str(x.id), x.c) for x in c.collect())
    # the rows of one id share the sum of their counts, a missing id has none
    assert got == [("1", 0), ("2", 2), ("2", 2), ("5", 0), ("6", 1), ("None", None)]


def test_stage_runs_once_before_it_is_clustered(spark):
    from roadpulse.session import cut_lineage
    runs = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            runs.add(1)
            yield r
    df = spark.createDataFrame(spark.range(50, numPartitions=2).rdd.mapPartitions(seen), "id long")
    assert cut_lineage(df, "id").count() == 50
    assert runs.value == 50
