"""Physical-plan checks: no Python in the hot path, pruned scans, no single-partition fact windows."""

from conftest import SF0001
from roadpulse.operators import clean as C
from roadpulse.operators import decide as D
from roadpulse.operators import features as FE
from roadpulse.plans import base, catalog
from roadpulse.sources import fixtures


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_stage_is_jvm_only_and_partitioned(spark):
    p = _plan(FE.feat_core(C.clean_pipeline(base.raw(spark, SF0001))))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "SinglePartition" not in p


def test_rules_are_jvm_only(spark):
    f = base.features(spark, SF0001).join(fixtures.closure_score(spark, SF0001), "id", "left")
    p = _plan(D.impact_score(D.recommend(f, prob_col="closure_prob"), prob_col="closure_prob"))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_reads_only_needed_columns(spark):
    ev = fixtures.read_table(spark, SF0001, "events", ["event_id", "ts", "user_id", "value", "props"])
    p = _plan(ev.select("event_id", "ts").filter("event_id > 10"))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,10)]" in p


def _query_plan(spark, key):
    catalog.load_all()
    return _plan(catalog.QUERIES[key](spark, SF0001))


def test_registered_queries_prune_their_stage_reads(spark):
    """A stage is a Parquet table: consumers read only their columns and push their filters."""
    p = _query_plan(spark, "src_features_pruned")
    assert "ExistingRDD" not in p and "FileScan parquet" in p and "description" not in p
    p = _query_plan(spark, "kpi_home")
    assert "ExistingRDD" not in p and "FileScan parquet" in p and "description" not in p and "address" not in p
    p = _query_plan(spark, "store_count")
    assert "ExistingRDD" not in p and "description" not in p
    p = _query_plan(spark, "analytics_filter")
    assert "ExistingRDD" not in p and "PushedFilters: [" in p and "PushedFilters: []," not in p.split("stage-")[-1].split("ReadSchema")[0]


def test_cluster_without_shared_folder_is_an_error():
    import pytest
    from roadpulse import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda s: type("S", (), {"getCheckpointDir": lambda t: type("O", (), {"isDefined": lambda u: False})()})()})()

        def getConf(self):
            return Conf()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(type("Spark", (), {"conf": Conf(), "sparkContext": Context()})())
