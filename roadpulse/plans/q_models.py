"""Registered queries: models and evaluation.

Metric operators are checked exactly against DuckDB using the fixture's
deterministic score column; model fits are checked by invariants (tests).
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import functions as F

from ..functions.quantiles import group_quantiles
from ..operators import metrics as M
from ..operators import models as MD
from ..session import checkpoint_dir
from . import base
from .catalog import register
from .oracle import SCORE, with_base
from .q_decide import scored
from .q_roads import features_given

_SC = "sc AS (SELECT f.id, f.road_closure_binary AS y, s.closure_prob AS p FROM feat f JOIN score s USING (id))"
_G = "g AS (SELECT p AS s, count(*) AS n_s, sum(y) AS pos_s FROM sc GROUP BY 1)"


def _scored(spark, sf):
    return scored(spark, sf).select("id", "road_closure_binary", "closure_prob")


@register("roc_auc", with_base(
    "SELECT round((sum(pos_s * ((cum_n - n_s) + (n_s + 1) / 2.0)) - sum(pos_s) * (sum(pos_s) + 1) / 2.0) "
    "/ (sum(pos_s) * (sum(n_s) - sum(pos_s))), 6) AS roc_auc, CAST(sum(pos_s) AS BIGINT) AS n_pos, "
    "CAST(sum(n_s) - sum(pos_s) AS BIGINT) AS n_neg FROM (SELECT *, sum(n_s) OVER (ORDER BY s ROWS UNBOUNDED "
    "PRECEDING) AS cum_n FROM g) t", extra=[SCORE, _SC, _G]))
def roc_auc(spark, sf):
    r = M.roc_auc(_scored(spark, sf), "road_closure_binary", "closure_prob")
    return r.select(F.round("roc_auc", 6).alias("roc_auc"), F.col("n_pos").cast("bigint"),
                    F.col("n_neg").cast("bigint"))


@register("average_precision", with_base(
    "SELECT round(sum(pos_s / P * (cum_pos / cum_n)), 6) AS average_precision FROM (SELECT *, "
    "sum(n_s) OVER w AS cum_n, sum(pos_s) OVER w AS cum_pos, sum(pos_s) OVER () AS P FROM g "
    "WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) t", extra=[SCORE, _SC, _G]))
def average_precision(spark, sf):
    r = M.average_precision(_scored(spark, sf), "road_closure_binary", "closure_prob")
    return r.select(F.round("average_precision", 6).alias("average_precision"))


@register("precision_recall_at", with_base(
    "SELECT CAST(count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS BIGINT) AS tp, "
    "CAST(count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS BIGINT) AS fp, "
    "CAST(count(*) FILTER (WHERE p < 0.5 AND y = 1) AS BIGINT) AS fn, "
    "CAST(count(*) FILTER (WHERE p < 0.5 AND y = 0) AS BIGINT) AS tn, "
    "round(count(*) FILTER (WHERE p >= 0.5 AND y = 1) / count(*) FILTER (WHERE p >= 0.5), 6) AS precision, "
    "round(count(*) FILTER (WHERE p >= 0.5 AND y = 1) / count(*) FILTER (WHERE y = 1), 6) AS recall FROM sc",
    extra=[SCORE, _SC]))
def precision_recall_at(spark, sf):
    c = M.confusion_at(_scored(spark, sf), "road_closure_binary", "closure_prob", 0.5)
    return c.select("tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"),
                    F.round("recall", 6).alias("recall"))


_CURVE = [SCORE, _SC, "th AS (SELECT CAST(round(0.05 * i, 2) AS DOUBLE) AS threshold FROM range(1, 19) t(i))",
          "cv AS (SELECT threshold, CAST(count(*) FILTER (WHERE p >= threshold AND y = 1) AS BIGINT) AS tp, "
          "CAST(count(*) FILTER (WHERE p >= threshold AND y = 0) AS BIGINT) AS fp, "
          "CAST(count(*) FILTER (WHERE p < threshold AND y = 1) AS BIGINT) AS fn FROM sc, th GROUP BY threshold)"]


@register("cost_threshold", with_base(
    "SELECT threshold, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, "
    "round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, CAST(5.0 AS DOUBLE) * fn + fp AS cost FROM cv",
    extra=_CURVE))
def cost_threshold(spark, sf):
    c = M.cost_curve(_scored(spark, sf), "road_closure_binary", "closure_prob")
    return c.select("threshold", "tp", "fp", "fn", F.round("precision", 6).alias("precision"),
                    F.round("recall", 6).alias("recall"), "cost")


@register("cost_threshold_best", with_base(
    "SELECT min_by(threshold, (CAST(5.0 AS DOUBLE) * fn + fp, threshold)) AS threshold, "
    "min(CAST(5.0 AS DOUBLE) * fn + fp) AS cost FROM cv",
    extra=_CURVE))
def cost_threshold_best(spark, sf):
    return M.cost_threshold(M.cost_curve(_scored(spark, sf), "road_closure_binary", "closure_prob"))


def frame(spark, sf):
    return MD.train_frame(features_given(spark, sf))


_ORD = "row_number() OVER (ORDER BY start_datetime, id) - 1"


@register("train_frame", with_base(
    "SELECT severity_class, CAST(CASE severity_class WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END "
    "AS DOUBLE) AS severity_label, CAST(count(*) AS BIGINT) AS n FROM feat GROUP BY 1"))
def train_frame(spark, sf):
    return frame(spark, sf).groupBy("severity_class", "severity_label").agg(F.count(F.lit(1)).alias("n"))


@register("chrono_split", with_base(
    "SELECT is_train, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id, max(id) AS last_id, "
    "min(start_datetime) AS first_start, max(start_datetime) AS last_start FROM ("
    f"SELECT *, {_ORD} < floor((SELECT count(*) FROM feat) * 0.8) AS is_train FROM feat) t GROUP BY 1"))
def chrono_split(spark, sf):
    d = M.chrono_split(frame(spark, sf), 0.8)
    return d.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"),
                                     F.max("id").alias("last_id"), F.min("start_datetime").alias("first_start"),
                                     F.max("start_datetime").alias("last_start"))


_SPLIT = [f"sp AS (SELECT *, {_ORD} < floor((SELECT count(*) FROM feat) * 0.8) AS is_train, "
          "CAST(CASE severity_class WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS DOUBLE) "
          "AS severity_label FROM feat)"]


@register("class_weights", with_base(
    "SELECT severity_label, CAST(count(*) AS BIGINT) AS n_c, round((SELECT count(*) FROM sp WHERE is_train) / "
    "(3.0 * count(*)), 6) AS weight FROM sp WHERE is_train GROUP BY 1", extra=_SPLIT))
def class_weights(spark, sf):
    d = M.chrono_split(frame(spark, sf), 0.8).filter("is_train")
    w = M.class_weights(d, "severity_label")
    return w.select("severity_label", "n_c", F.round("weight", 6).alias("weight"))


@register("majority_baseline", with_base(
    "SELECT (SELECT min_by(severity_label, (-n, severity_label)) FROM (SELECT severity_label, count(*) AS n FROM sp "
    "WHERE is_train GROUP BY 1) m) AS majority_label, round(avg(CAST(severity_label = (SELECT min_by(severity_label, "
    "(-n, severity_label)) FROM (SELECT severity_label, count(*) AS n FROM sp WHERE is_train GROUP BY 1) m2) AS DOUBLE)), 6)"
    " AS baseline_accuracy FROM sp WHERE NOT is_train", extra=_SPLIT))
def majority_baseline(spark, sf):
    from ..operators.analytics import deterministic_mode
    d = M.chrono_split(frame(spark, sf), 0.8)
    mode = deterministic_mode(d.filter("is_train").withColumn("__k", F.lit(1)), ["__k"], "severity_label",
                              "majority_label")
    t = d.filter(~F.col("is_train")).crossJoin(F.broadcast(mode.drop("__k")))
    return t.agg(F.first("majority_label").alias("majority_label"),
                 F.round(F.avg((F.col("severity_label") == F.col("majority_label")).cast("double")), 6)
                 .alias("baseline_accuracy"))


@register("walk_forward", with_base(
    "SELECT CAST(i AS INTEGER) AS fold, CAST(n - (5 - i) * (n // 6) AS BIGINT) AS test_start, "
    "CAST(n - (4 - i) * (n // 6) AS BIGINT) AS test_end, CAST(n - (5 - i) * (n // 6) AS BIGINT) AS train_rows "
    "FROM range(5) r(i), (SELECT count(*) AS n FROM feat) c"))
def walk_forward(spark, sf):
    """Fold bounds of the expanding-window backtest (the fits run in ``closure_walk_forward``)."""
    return M.walk_forward_folds(frame(spark, sf), 5)


_DUR = ["dd AS (SELECT id, start_datetime, duration_minutes AS d FROM feat WHERE duration_minutes IS NOT NULL "
        "AND duration_minutes <= 1440)",
        "ds AS (SELECT *, row_number() OVER (ORDER BY start_datetime, id) - 1 < floor((SELECT count(*) FROM dd) * 0.8) "
        "AS is_train FROM dd)",
        "dm AS (SELECT quantile_cont(d, 0.5) AS med FROM ds WHERE is_train)"]


def _duration_split(spark, sf):
    d = base.features(spark, sf).filter(F.col("duration_minutes").isNotNull() & (F.col("duration_minutes") <= 1440))
    s = M.chrono_split(d.select("id", "start_datetime", "duration_minutes"), 0.8)
    med = group_quantiles(s.filter("is_train"), [], "duration_minutes", {"med": 0.5})
    return s.crossJoin(F.broadcast(med))


@register("median_baseline", with_base(
    "SELECT round(med, 6) AS train_median, round(avg(abs(d - med)), 6) AS baseline_mae, CAST(count(*) AS BIGINT) AS n "
    "FROM ds, dm WHERE NOT is_train GROUP BY med", extra=_DUR))
def median_baseline(spark, sf):
    t = _duration_split(spark, sf).filter(~F.col("is_train"))
    return t.groupBy("med").agg(F.round(F.avg(F.abs(F.col("duration_minutes") - F.col("med"))), 6).alias("baseline_mae"),
                                F.count(F.lit(1)).alias("n")).select(F.round("med", 6).alias("train_median"),
                                                                     "baseline_mae", "n")


@register("duration_metrics", with_base(
    "SELECT round(avg(abs(med - d)), 6) AS mae, round(sqrt(avg((med - d) * (med - d))), 6) AS rmse, "
    "round(1 - sum((med - d) * (med - d)) / sum((d - (SELECT avg(d) FROM ds WHERE NOT is_train)) * "
    "(d - (SELECT avg(d) FROM ds WHERE NOT is_train))), 6) AS r2, CAST(count(*) AS BIGINT) AS n "
    "FROM ds, dm WHERE NOT is_train", extra=_DUR))
def duration_metrics(spark, sf):
    """MAE / RMSE / R^2 of a prediction column (here: the median baseline) against actuals."""
    t = _duration_split(spark, sf).filter(~F.col("is_train"))
    r = M.regression_metrics(t, "duration_minutes", "med")
    return r.select(*[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")], "n")


_SHIFT = ("CASE WHEN id % 5 = 0 THEN (CASE severity_class WHEN 'Low' THEN 'Medium' WHEN 'Medium' THEN 'High' "
          "ELSE 'Low' END) ELSE severity_class END")


@register("severity_metrics", with_base(
    "SELECT cls, CAST(tp AS BIGINT) AS tp, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, "
    "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
    "round(sum(tp) OVER () / sum(support) OVER (), 6) AS accuracy, round(avg(f1) OVER (), 6) AS macro_f1 FROM ("
    "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 "
    "FROM (SELECT cls, tp, support, predicted, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, "
    "CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM ("
    "SELECT c.cls, coalesce(sum(CASE WHEN a = c.cls AND p = c.cls THEN 1 END), 0) AS tp, "
    "coalesce(sum(CASE WHEN a = c.cls THEN 1 END), 0) AS support, "
    "coalesce(sum(CASE WHEN p = c.cls THEN 1 END), 0) AS predicted "
    f"FROM (SELECT severity_class AS a, {_SHIFT} AS p FROM feat) x, "
    "(SELECT DISTINCT severity_class AS cls FROM feat) c GROUP BY c.cls) t1) t2) t3"))
def severity_metrics(spark, sf):
    """Per-class P/R/F1, accuracy and macro-F1 of a prediction column (fixture: rule shifted for every 5th id)."""
    f = base.features(spark, sf)
    shifted = F.when(F.col("id") % 5 == 0, F.when(F.col("severity_class") == "Low", "Medium")
                     .when(F.col("severity_class") == "Medium", "High").otherwise("Low")) \
        .otherwise(F.col("severity_class"))
    m = M.multiclass_metrics(f.select(F.col("severity_class").alias("a"), shifted.alias("p")), "a", "p")
    return m.select("cls", F.col("tp").cast("bigint"), F.col("support").cast("bigint"),
                    F.col("predicted").cast("bigint"),
                    *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1")])


# --- model fits (invariant-checked) ---------------------------------------------------

def _split(spark, sf):
    d = base._stage(spark, "split", sf, lambda: M.chrono_split(frame(spark, sf), 0.8), cluster=False)
    return d.filter("is_train"), d.filter(~F.col("is_train"))


def _held(spark, sf, name, fit) -> str:
    """Folder of a model fitted once per session and input, saved in the shared folder."""
    def run():
        path = f"{checkpoint_dir(spark).rstrip('/')}/model-{name}-{uuid.uuid4().hex}"
        fit().write().save(path)
        return spark.createDataFrame([(path,)], "path string")
    return base._stage(spark, f"model-{name}", sf, run).first()["path"]


def severity(spark, sf):
    return PipelineModel.load(_held(spark, sf, "severity", lambda: MD.severity_model(_split(spark, sf)[0])))


def duration(spark, sf):
    return PipelineModel.load(_held(spark, sf, "duration", lambda: MD.duration_model(_split(spark, sf)[0])))


def closure(spark, sf):
    """(classifier, calibration)."""
    fitted = []

    def part(i):
        if not fitted:
            fitted.extend(MD.closure_model(_split(spark, sf)[0]))
        return fitted[i]
    return (PipelineModel.load(_held(spark, sf, "closure", lambda: part(0))),
            IsotonicRegressionModel.load(_held(spark, sf, "calibration", lambda: part(1))))


def walk_forward_scores(spark, sf):
    return base._stage(spark, "walk_forward", sf, lambda: MD.walk_forward(frame(spark, sf), 5))


def _fit_all(spark, sf) -> None:
    """The stored models and the backtest, those not fitted yet side by side."""
    frame(spark, sf)
    MD.at_once(spark, [lambda f=f: f(spark, sf) for f in (severity, duration, closure, walk_forward_scores)])


@register("severity_model")
def severity_model(spark, sf):
    pred = severity(spark, sf).transform(_split(spark, sf)[1]).select("severity_label", "prediction")
    return M.multiclass_metrics(pred, "severity_label", "prediction")


@register("severity_cv")
def severity_cv(spark, sf):
    """5-fold accuracy; a row's fold is a hash of its id."""
    d = frame(spark, sf).withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(5)))
    rows = []
    for k in range(5):
        m = MD.severity_model(d.filter(F.col("fold") != k))
        p = m.transform(d.filter(F.col("fold") == k))
        acc = p.agg(F.avg((F.col("prediction") == F.col("severity_label")).cast("double"))).first()[0]
        rows.append((k, float(acc)))
    out = spark.createDataFrame(rows, "fold int, accuracy double")
    return out.agg(F.avg("accuracy").alias("cv_accuracy_mean"), F.stddev_pop("accuracy").alias("cv_accuracy_std"))


@register("duration_model")
def duration_model(spark, sf):
    tr, te = _split(spark, sf)
    p = duration(spark, sf).transform(te.filter("duration_minutes <= 1440")).withColumn("predicted_minutes", F.expm1("prediction"))
    med = group_quantiles(tr.filter("duration_minutes <= 1440"), [], "duration_minutes", {"med": 0.5})
    r = M.regression_metrics(p, "duration_minutes", "predicted_minutes")
    b = M.regression_metrics(p.crossJoin(F.broadcast(med)), "duration_minutes", "med") \
        .select(F.col("mae").alias("baseline_mae"))
    return r.crossJoin(b).withColumn("lift_vs_baseline", F.col("baseline_mae") - F.col("mae"))


@register("sink_backtest")
def sink_backtest(spark, sf):
    """Predicted / actual clearance pairs rounded to 0.1 (write as a table)."""
    p = duration(spark, sf).transform(_split(spark, sf)[1].filter("duration_minutes <= 1440"))
    return p.select("id", (F.rint(F.col("duration_minutes") * 10) / 10).alias("actual_minutes"),
                    (F.rint(F.expm1("prediction") * 10) / 10).alias("predicted_minutes"))


def _closure(spark, sf):
    return MD.score_closure(*closure(spark, sf), _split(spark, sf)[1])


@register("closure_model")
def closure_model(spark, sf):
    p = _closure(spark, sf)
    roc = M.roc_auc(p, "road_closure_binary", "closure_prob").select("roc_auc")
    ap = M.average_precision(p, "road_closure_binary", "closure_prob")
    base_rate = p.agg(F.avg("road_closure_binary").alias("base_rate"))
    cm = M.confusion_at(p, "road_closure_binary", "closure_prob", 0.5).select("precision", "recall")
    best = M.cost_threshold(M.cost_curve(p, "road_closure_binary", "closure_prob")) \
        .select(F.col("threshold").alias("barricade_threshold"))
    return roc.crossJoin(ap).crossJoin(base_rate).crossJoin(cm).crossJoin(best)


@register("closure_calibrate")
def closure_calibrate(spark, sf):
    """Calibration table: mean calibrated probability vs observed rate per raw-score decile."""
    return (_closure(spark, sf).withColumn("bin", F.least(F.floor(F.col("raw_score") * 10), F.lit(9)).cast("int"))
             .groupBy("bin").agg(F.avg("closure_prob").alias("mean_calibrated"),
                                 F.avg("road_closure_binary").alias("observed_rate"), F.count(F.lit(1)).alias("n")))


@register("closure_walk_forward")
def closure_walk_forward(spark, sf):
    return walk_forward_scores(spark, sf).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("roc_auc").alias("roc_auc_mean"),
        F.stddev_pop("roc_auc").alias("roc_auc_std"), F.avg("pr_auc").alias("pr_auc_mean"))


@register("feature_importance")
def feature_importance(spark, sf):
    """Impurity and permutation importance of the severity model's inputs."""
    m = severity(spark, sf)
    loss = MD.permutation_importance(m, _split(spark, sf)[1], MD.CLF_FEATURES, "severity_label")
    return MD.feature_importance(m, MD.CLF_FEATURES).join(loss, "feature", "left")


@register("score_batch")
def score_batch(spark, sf):
    """Score the active incidents with all three stored models."""
    act = frame(spark, sf).filter(F.col("status") == "active")
    s = MD.score_batch(severity(spark, sf), duration(spark, sf), *closure(spark, sf), act)
    return s.select("id", "predicted_severity", "predicted_minutes", "closure_prob")


@register("quality_gate")
def quality_gate(spark, sf):
    _fit_all(spark, sf)
    tr, te = _split(spark, sf)
    sm = severity_model(spark, sf).select("accuracy", "macro_f1").limit(1)
    maj = tr.groupBy("severity_label").count().orderBy(F.desc("count"), "severity_label").limit(1) \
        .select(F.col("severity_label").alias("__maj"))
    base_acc = te.crossJoin(maj).agg(F.avg((F.col("severity_label") == F.col("__maj")).cast("double")).alias("__b"))
    p = _closure(spark, sf)
    roc = M.roc_auc(p, "road_closure_binary", "closure_prob").select("roc_auc")
    ap = M.average_precision(p, "road_closure_binary", "closure_prob")
    br = p.agg(F.avg("road_closure_binary").alias("__br"))
    wf = walk_forward_scores(spark, sf).agg(F.avg("roc_auc").alias("wf_roc_auc"))
    dm = duration_model(spark, sf).select("mae", "baseline_mae")
    road = all(f in cols for f in ("road_class_rank", "lane_count") for cols in (MD.CLF_FEATURES, MD.CLOSURE_FEATURES))
    row = (sm.crossJoin(base_acc).crossJoin(roc).crossJoin(ap).crossJoin(br).crossJoin(wf).crossJoin(dm)
             .select(F.col("roc_auc").alias("closure_roc_auc"),
                     (F.col("average_precision") - F.col("__br")).alias("closure_pr_lift"),
                     "wf_roc_auc", (F.col("accuracy") - F.col("__b")).alias("severity_lift"),
                     F.col("macro_f1").alias("severity_macro_f1"),
                     (F.col("baseline_mae") - F.col("mae")).alias("duration_lift"),
                     F.lit(float(road)).alias("road_features")))
    return MD.quality_gate(row)
