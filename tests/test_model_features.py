"""The models' feature table: the values of the whole feature table, without columns that no model reads."""

import datetime as dt
import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import SF0001
from roadpulse.operators import features as FE
from roadpulse.operators import models as MD
from roadpulse.plans import base, q_roads


def test_model_features_are_those_of_the_feature_table(spark):
    want = base.features(spark, SF0001).select(*q_roads._GIVEN)
    got = FE.feat_model(base.incidents(spark, SF0001), q_roads._GIVEN)
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_repeated_rows_and_missing_junctions_stay(spark):
    t = dt.datetime(2024, 3, 1, 8)
    rows = [(1, t, "A", "c"), (1, t, "A", "c"), (2, t + dt.timedelta(hours=1), "unknown", "c"), (3, t + dt.timedelta(hours=2), "A", None)]
    d = spark.createDataFrame(rows, "id long, start_datetime timestamp_ntz, junction string, corridor string")
    clean = base.incidents(spark, SF0001).limit(1).drop("id", "start_datetime", "junction", "corridor").crossJoin(d)
    cols = ["id", "junction_repeat_count", "corridor_7d_score", "event_semantic_encoded"]
    want, got = FE.feat_core(clean).select(*cols), FE.feat_model(clean, cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_given_features_hold_no_texts(spark):
    """Texts and other columns that no model reads were shuffled and written several times."""
    cols = q_roads.features_given(spark, SF0001).columns
    assert not {"description", "address", "road_class", "end_datetime"} & set(cols)
    assert {*MD.CLF_FEATURES, *MD.REG_FEATURES, *MD.CLOSURE_FEATURES, "corridor", "status", "duration_minutes", "severity_class"} <= set(cols)


def test_permutation_importance_deals_every_feature_in_one_join(spark):
    rows = [(i, float(i % 2), float(i % 2), float(i % 7), float(i % 5)) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, y double, a double, b double, c double")
    feats = ["a", "b", "c"]
    model = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features"),
                             DecisionTreeClassifier(labelCol="y", featuresCol="features", seed=1)]).fit(d)
    loss = MD.permutation_importance(model, d, feats, "y")
    n = len(rows)
    want = {}
    for i, f in enumerate(feats):
        step = next(s for s in range(n // 2 + i + 1, n * 2 + 2) if math.gcd(s, n) == 1)
        other = {(p * step + i + 1) % n: rows[p][2 + i] for p in range(n)}
        dealt = [list(r) for r in rows]
        for p in range(n):
            dealt[p][2 + i] = other[p]
        p = model.transform(spark.createDataFrame([tuple(r) for r in dealt], d.schema))
        want[f] = 1.0 - p.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert {r.feature: r.permutation_importance for r in loss.collect()} == want
    assert loss._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3    # three a feature before
