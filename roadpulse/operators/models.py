"""Model training and scoring with Spark ML (distributed tree learners).

Label maps and feature lists are the source system's; learners are Spark's
(histogram-split trees over partitions).  Spark's GBT is binary-only, so the
3-class severity model is a class-weighted random forest.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..session import checkpoint_dir, cut_lineage
from . import metrics as M

# FIXED VALUES: model inputs and label coding.
CLF_FEATURES = ["hour_of_day", "day_of_week", "is_peak_hour", "is_weekend", "junction_repeat_count",
                "corridor_7d_score", "cluster_prior_events", "road_class_rank", "lane_count", "veh_type_encoded"]
REG_FEATURES = ["cause_severity_weight", "road_closure_binary", "event_semantic_encoded", "hour_of_day",
                "day_of_week", "is_peak_hour", "is_weekend", "junction_repeat_count", "corridor_7d_score",
                "cluster_prior_events", "cluster_closure_rate", "road_class_rank", "lane_count", "veh_type_encoded"]
CLOSURE_FEATURES = ["cause_severity_weight", "event_semantic_encoded", "hour_of_day", "day_of_week", "is_peak_hour",
                    "is_weekend", "junction_repeat_count", "corridor_7d_score", "road_class_rank", "lane_count",
                    "veh_type_encoded"]
SEVERITY_LABEL = {"Low": 0, "Medium": 1, "High": 2}
SEVERITY_NAME = {0: "Low", 1: "Medium", 2: "High"}

# FIXED VALUES: learner settings (tree depth, learning rate, number of trees, row and column sampling).
TREE_PARAMS = dict(maxDepth=5, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
GBT_ITER = 300
GBT_STEP = 0.05
RF_TREES = 300
ROWS_A_TASK = 100_000


def train_frame(features: DataFrame) -> DataFrame:
    """Label 0/1/2; drop rows missing any model feature; numeric features as double."""
    from .. import vocab
    cols = list(dict.fromkeys(CLF_FEATURES + REG_FEATURES))
    d = features.dropna(subset=cols + ["severity_class"])
    d = d.withColumn("severity_label", vocab.map_lit(SEVERITY_LABEL)[F.col("severity_class")].cast("double"))
    for c in cols:
        d = d.withColumn(c, F.col(c).cast("double"))
    return d


def _assembler(cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


def _tree_checkpoints(df: DataFrame) -> None:
    """Boosting cuts its lineage every few rounds: into the shared folder."""
    df.sparkSession.sparkContext.setCheckpointDir(checkpoint_dir(df.sparkSession))


def _rows_together(df: DataFrame, rows: int) -> DataFrame:
    """Fewer partitions where they would hold less than ROWS_A_TASK rows: a boosting round is a few passes over all of them."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def severity_model(train: DataFrame) -> PipelineModel:
    w = M.class_weights(train, "severity_label").select("severity_label", F.col("weight").alias("w"))
    t = train.join(F.broadcast(w), "severity_label")
    rf = RandomForestClassifier(labelCol="severity_label", featuresCol="features", weightCol="w",
                                numTrees=RF_TREES, **TREE_PARAMS)
    return Pipeline(stages=[_assembler(CLF_FEATURES), rf]).fit(t)


def duration_model(train: DataFrame) -> PipelineModel:
    _tree_checkpoints(train)
    t = train.filter(F.col("duration_minutes").isNotNull() & (F.col("duration_minutes") <= 1440)) \
        .withColumn("log_duration", F.log1p("duration_minutes"))
    gbt = GBTRegressor(labelCol="log_duration", featuresCol="features", maxIter=GBT_ITER, stepSize=GBT_STEP,
                       **TREE_PARAMS)
    return Pipeline(stages=[_assembler(REG_FEATURES), gbt]).fit(_rows_together(t, train.count()))


def closure_model(train: DataFrame) -> tuple[PipelineModel, object]:
    """GBT on the first 80 % of train, positive-class weight neg/pos over all of train; isotonic calibration on the rest."""
    _tree_checkpoints(train)
    d = M.chrono_split(train, 0.8).withColumnRenamed("is_train", "__fit").drop("row_idx")
    cnt = train.agg(F.count_if(F.col("road_closure_binary") == 1).alias("p"),
                    F.count_if(F.col("road_closure_binary") == 0).alias("n"))
    fit = d.filter("__fit").crossJoin(F.broadcast(cnt)).withColumn(
        "w", F.when(F.col("road_closure_binary") == 1, F.col("n") / F.greatest(F.col("p"), F.lit(1))).otherwise(1.0))
    gbt = GBTClassifier(labelCol="label", featuresCol="features", weightCol="w", maxIter=GBT_ITER, stepSize=GBT_STEP,
                        **TREE_PARAMS)
    model = Pipeline(stages=[_assembler(CLOSURE_FEATURES), gbt]).fit(_rows_together(
        fit.withColumn("label", F.col("road_closure_binary").cast("double")), train.count()))
    cal = model.transform(d.filter(~F.col("__fit"))).select(
        F.col("road_closure_binary").cast("double").alias("label"),
        vector_to_array("probability")[1].alias("raw_score"))
    iso = IsotonicRegression(featuresCol="raw_score", labelCol="label", predictionCol="closure_prob").fit(cal)
    return model, iso


def score_closure(model: PipelineModel, iso, df: DataFrame) -> DataFrame:
    s = model.transform(df).withColumn("raw_score", vector_to_array("probability")[1])
    return iso.transform(s).drop("features", "rawPrediction", "probability", "prediction")


def score_batch(sev: PipelineModel, dur: PipelineModel, clo: PipelineModel, iso, df: DataFrame) -> DataFrame:
    """Severity (argmax), expected clearance minutes (expm1) and calibrated P(closure) for a table."""
    from .. import vocab
    s = sev.transform(df).select("*", F.col("prediction").alias("__sev")).drop(
        "features", "rawPrediction", "probability", "prediction")
    s = dur.transform(s).withColumn("predicted_minutes", F.expm1("prediction")).drop("features", "prediction")
    s = score_closure(clo, iso, s)
    return s.withColumn("predicted_severity", vocab.map_lit(SEVERITY_NAME)[F.col("__sev").cast("int")]).drop("__sev")


def at_once(spark: SparkSession, jobs: list) -> list:
    """Results of functions that each run Spark jobs, run side by side in threads of their own scheduler pools.

    Boosting rounds are many short jobs that leave most executors idle; side by side
    they share the cluster.  Under FAIR scheduling the pools get equal shares; without
    it the jobs still overlap.
    """
    def run(job, i):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i}")
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), job, i) for i, job in enumerate(jobs)]]


def walk_forward(frame: DataFrame, n_splits: int = 5) -> DataFrame:
    """Expanding-window closure backtest: one fit per fold, all folds at once over one table of feature vectors.

    The vectors are written once in the order of time, so that a fold's filter on the
    row number skips the files beyond it.  Folds whose test rows are all of one class, or
    whose training rows hold no closure, are left out.
    """
    spark = frame.sparkSession
    _tree_checkpoints(frame)
    d = _assembler(CLOSURE_FEATURES).transform(M.row_index(frame, ["start_datetime", "id"])).select(
        "row_idx", F.col("road_closure_binary").cast("double").alias("label"), "features")
    d = cut_lineage(d, "row_idx")
    folds = M.walk_forward_folds(frame, n_splits)
    test = (F.col("row_idx") >= F.col("test_start")) & (F.col("row_idx") < F.col("test_end"))
    train = F.col("row_idx") < F.col("test_start")
    facts = d.join(F.broadcast(folds), F.col("row_idx") < F.col("test_end")).groupBy("fold", "test_start", "test_end").agg(  # n_splits rows
        F.count_if(test & (F.col("label") == 1)).alias("test_pos"), F.count_if(test & (F.col("label") == 0)).alias("test_neg"),
        F.count_if(train & (F.col("label") == 1)).alias("pos"), F.count_if(train & (F.col("label") == 0)).alias("neg"))

    def fit(f):
        t = _rows_together(d.filter(F.col("row_idx") < f.test_start), f.pos + f.neg).withColumn("w", F.when(F.col("label") == 1, f.neg / f.pos).otherwise(1.0))
        gbt = GBTClassifier(labelCol="label", featuresCol="features", weightCol="w", maxIter=GBT_ITER, stepSize=GBT_STEP, **TREE_PARAMS)
        te = d.filter((F.col("row_idx") >= f.test_start) & (F.col("row_idx") < f.test_end))
        p = cut_lineage(gbt.fit(t).transform(te).select("label", vector_to_array("probability")[1].alias("p")))
        return (f.fold, float(M.roc_auc(p, "label", "p").first()["roc_auc"]),
                float(M.average_precision(p, "label", "p").first()["average_precision"]))

    usable = [f for f in facts.orderBy("fold").collect() if f.pos and f.test_pos and f.test_neg]
    rows = at_once(spark, [lambda f=f: fit(f) for f in usable])
    return spark.createDataFrame(rows, "fold int, roc_auc double, pr_auc double")


def permutation_importance(model: PipelineModel, test: DataFrame, features: list[str], label: str) -> DataFrame:
    """Loss of accuracy when one feature's values are dealt to other rows, per feature.

    Row i gets the feature of the row that follows it in a hash order of its own:
    an exact permutation by one join on row numbers, in which a row is shuffled once
    and each dealt value as a number of its own.  All features are scored in one pass.
    """
    t = M.row_index(test.select("id", label, *features), ["id"], "pos")
    total = t.count()
    hit = (F.col("prediction") == F.col(label)).cast("double")
    plain = model.transform(t).agg(F.avg(hit).alias("a")).first()["a"]
    # multiplication by a unit of the residue ring is a permutation of the row numbers
    units = [next(s for s in range(total // 2 + i + 1, total * 2 + 2) if math.gcd(s, total) == 1) for i in range(len(features))]
    dealt = t.select(F.inline(F.array(*[F.struct(((F.col("pos") * F.lit(u) + i + 1) % total).alias("pos"), F.lit(i).alias("__f"),
                                                 F.col(f).alias("__dealt")) for i, (u, f) in enumerate(zip(units, features))])))
    other = t.join(dealt, "pos").withColumns({f: F.when(F.col("__f") == i, F.col("__dealt")).otherwise(F.col(f)) for i, f in enumerate(features)})
    lost = model.transform(other).groupBy("__f").agg((F.lit(plain) - F.avg(hit)).alias("permutation_importance"))
    return lost.select(F.get(F.array(*[F.lit(f) for f in features]), F.col("__f")).alias("feature"), "permutation_importance")


def feature_importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """Impurity importances of the fitted trees, one row per input feature."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature string, importance double")


def quality_gate(metrics: DataFrame) -> DataFrame:
    """Gate rows (rule, value, floor, pass) from a one-row metrics table."""
    rules = [("closure_roc_auc", "closure_roc_auc", ">=", 0.66), ("closure_pr_auc_vs_base", "closure_pr_lift", ">", 0.0),
             ("walk_forward_roc_auc", "wf_roc_auc", ">=", 0.60), ("severity_acc_vs_majority", "severity_lift", ">", 0.0),
             ("severity_macro_f1", "severity_macro_f1", ">=", 0.55), ("duration_mae_vs_median", "duration_lift", ">=", 0.0),
             ("road_features_present", "road_features", ">=", 1.0)]
    parts = []
    for rule, col, op, floor in rules:
        v = F.col(col).cast("double")
        ok = v >= floor if op == ">=" else v > floor
        parts.append(metrics.select(F.lit(rule).alias("rule"), v.alias("value"), F.lit(floor).alias("floor"),
                                    F.coalesce(ok, F.lit(False)).alias("passed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
