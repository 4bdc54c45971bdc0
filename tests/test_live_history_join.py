"""Live events meet the corridor medians without a shuffle by id; repeated and missing ids have what they had."""

from pyspark.sql import functions as F

from conftest import SF0001
from roadpulse.operators import analytics as A
from roadpulse.operators import features as FE
from roadpulse.plans import base, q_roads
from roadpulse.plans.q_stream import _static
from roadpulse.streaming import live as L

MEDIANS = [(None, True, 7, 2, 0.5), ("", False, 8, 3, 0.25), ("A", False, 1, 4, 0.75), ("B", False, None, 5, 0.0)]
EVENTS = [(1, "A", "t"), (2, "B", None), (3, "C", "t"), (4, None, "t"), (5, "", "u")]


def tables(spark, extra=()):
    medians = spark.createDataFrame(MEDIANS, "corridor string, is_global boolean, corridor_7d_score long, road_class_rank long, lane_count double")
    return spark.createDataFrame(EVENTS + list(extra), "id long, corridor string, description string"), medians


def by_id(events, medians):
    return events.join(A.history_lookup(events.select("id", "corridor"), medians).drop("corridor"), "id", "left")


def test_history_by_corridor_is_that_by_id(spark):
    for extra in ([], [(3, "A", "again")], [(None, "A", "no id")], [(3, "C", "t"), (None, None, None)]):
        events, medians = tables(spark, extra)
        got, want = L.with_medians(events, medians), by_id(events, medians)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_batch_is_not_joined_with_itself(spark):
    """Each batch was shuffled whole by id to meet the histories of its own rows."""
    medians, stats = _static(spark, SF0001)
    rows = L.live_rows(base.features(spark, SF0001))
    plan = L.enrich_score(rows, medians, stats)._jdf.queryExecution().optimizedPlan().toString()
    source = rows._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    assert plan.count("Relation") == source + 4         # medians and clearance table twice each, the events once


def test_given_features_read_the_written_feature_table(spark, monkeypatch):
    """The same counts were made a second time beside a feature table that was already there."""
    core = base.features(spark, SF0001)
    monkeypatch.setattr(base, "_STAGES", {k: v for k, v in base._STAGES.items() if k[1] in ("clean", "features", "network")})
    monkeypatch.setattr(FE, "feat_model", lambda *a: 1 / 0)
    got = q_roads.features_given(spark, SF0001)
    cols = [c for c in q_roads._GIVEN if c in got.columns]
    a, b = got.select(*cols), core.select(*cols)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert got.filter(F.col("cluster_label").isNull()).isEmpty()
