"""Evaluation metrics as aggregations (no driver-side loops over rows).

Every metric reduces the scored table to one row per *distinct score* (a
partial aggregate), then walks those rows in score order with prefix sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def row_index(df: DataFrame, order: list[str], out: str = "row_idx") -> DataFrame:
    """0-based position of every row in ``order`` (a total order), without a global window.

    Range-partitions by the order columns, counts rows per partition, prefix-sums
    the (few) partition counts, and numbers rows within each partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # partition ids depend on sampled range bounds: materialise once so the
    # offsets and the in-partition numbering come from the same placement
    d = cut_lineage(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sizes = d.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offs = sizes.select("__part", F.coalesce(F.sum("__n").over(
        Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    w = Window.partitionBy("__part").orderBy(*order)
    return (d.withColumn("__rn", F.row_number().over(w) - 1).join(F.broadcast(offs), "__part")
             .withColumn(out, (F.col("__off") + F.col("__rn")).cast("long")).drop("__part", "__rn", "__off"))


def chrono_split(df: DataFrame, train_frac: float = 0.8, order: list[str] | None = None) -> DataFrame:
    """Mark the first ``int(n * train_frac)`` rows in time order as train (``is_train``)."""
    order = order or ["start_datetime", "id"]
    d = row_index(df, order)
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    return (d.crossJoin(F.broadcast(n))
             .withColumn("is_train", F.col("row_idx") < F.floor(F.col("__n") * train_frac))
             .drop("__n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = c.agg(F.sum("n_c").alias("__n"), F.count(F.lit(1)).alias("__k"))
    return c.crossJoin(F.broadcast(tot)).select(label, "n_c", (F.col("__n") / (F.col("__k") * F.col("n_c")))
                                                .alias("weight"))


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n_s"),
                                                    F.sum(F.col(label).cast("long")).alias("pos_s"))


def prefix_sums(df: DataFrame, key: Column, cols: list[str]) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` of ``cols`` in ascending ``key`` order (``key`` unique).

    Range partitioning + per-partition totals + small offset table: no task
    ever holds more than one range partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = cut_lineage(df.withColumn("__k", key).repartitionByRange(n, "__k")
                    .withColumn("__part", F.spark_partition_id()))
    sizes = d.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    ow = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("__part", *[F.coalesce(F.sum(f"__t_{c}").over(ow), F.lit(0)).alias(f"__o_{c}") for c in cols])
    w = Window.partitionBy("__part").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(F.broadcast(offs), "__part")
    for c in cols:
        d = d.withColumn(f"cum_{c}", F.col(f"__o_{c}") + F.sum(c).over(w))
    return d.drop("__k", "__part", *[f"__o_{c}" for c in cols])


def _cum(g: DataFrame, desc: bool) -> DataFrame:
    """Inclusive cumulative n / pos over distinct scores (ascending or descending)."""
    d = prefix_sums(g, -F.col("s") if desc else F.col("s"), ["n_s", "pos_s"])
    return d.withColumnRenamed("cum_n_s", "cum_n").withColumnRenamed("cum_pos_s", "cum_pos")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC-AUC by the rank-sum identity with average ranks for tied scores."""
    g = _cum(_by_score(df, label, score), desc=False)
    g = g.withColumn("avg_rank", (F.col("cum_n") - F.col("n_s")) + (F.col("n_s") + 1) / 2.0)
    return g.agg(F.sum(F.col("pos_s") * F.col("avg_rank")).alias("__rs"), F.sum("pos_s").alias("__p"),
                 F.sum("n_s").alias("__n")).select(
        ((F.col("__rs") - F.col("__p") * (F.col("__p") + 1) / 2.0)
         / (F.col("__p") * (F.col("__n") - F.col("__p")))).alias("roc_auc"),
        F.col("__p").alias("n_pos"), (F.col("__n") - F.col("__p")).alias("n_neg"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """AP = sum over distinct thresholds (descending) of (R_n - R_{n-1}) * P_n."""
    g = _cum(_by_score(df, label, score), desc=True)
    tot = g.agg(F.sum("pos_s").alias("__P"))
    return (g.crossJoin(F.broadcast(tot))
             .agg(F.sum(F.when(F.col("__P") > 0, F.col("pos_s") / F.col("__P") * (F.col("cum_pos") / F.col("cum_n"))))
                  .alias("average_precision")))


def confusion_at(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    pred = F.col(score) >= threshold
    y = F.col(label) == 1
    c = df.agg(F.count_if(pred & y).cast("bigint").alias("tp"), F.count_if(pred & ~y).cast("bigint").alias("fp"),
               F.count_if(~pred & y).cast("bigint").alias("fn"), F.count_if(~pred & ~y).cast("bigint").alias("tn"))
    return c.select("*",
                    F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
                     .otherwise(0.0).alias("precision"),
                    F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
                     .otherwise(0.0).alias("recall"))


def cost_curve(df: DataFrame, label: str, score: str, fn_fp_ratio: float = 5.0) -> DataFrame:
    """Thresholds 0.05..0.90 (step 0.05): tp/fp/fn, precision, recall, cost = ratio*FN + FP."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(round(0.05 * i, 2),) for i in range(1, 19)], "threshold double")
    g = _by_score(df, label, score)
    tot = g.agg(F.sum("pos_s").alias("P"))
    j = g.crossJoin(F.broadcast(grid))
    above = F.col("s") >= F.col("threshold")
    c = (j.groupBy("threshold")
          .agg(F.sum(F.when(above, F.col("pos_s")).otherwise(0)).alias("tp"),
               F.sum(F.when(above, F.col("n_s") - F.col("pos_s")).otherwise(0)).alias("fp"))
          .crossJoin(F.broadcast(tot)).withColumn("fn", F.col("P") - F.col("tp")))
    return c.select("threshold", F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
                    F.col("fn").cast("bigint").alias("fn"),
                    F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
                     .alias("precision"),
                    F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
                     .alias("recall"),
                    (fn_fp_ratio * F.col("fn") + F.col("fp")).alias("cost"))


def cost_threshold(curve: DataFrame) -> DataFrame:
    """Lowest cost; the earliest threshold wins a tie."""
    return curve.agg(F.min_by("threshold", F.struct("cost", "threshold")).alias("threshold"),
                     F.min("cost").alias("cost"))


def walk_forward_folds(df: DataFrame, n_splits: int = 5, order: list[str] | None = None) -> DataFrame:
    """Expanding folds: t = n // (k+1); fold i tests rows [n-(k-i)t, n-(k-i-1)t) and trains on all before."""
    spark = df.sparkSession
    n = df.agg(F.count(F.lit(1)).alias("n"))
    folds = spark.range(n_splits).select(F.col("id").cast("int").alias("fold"))
    t = F.floor(F.col("n") / (n_splits + 1))
    return (folds.crossJoin(n)
                 .select("fold", (F.col("n") - (n_splits - F.col("fold")) * t).cast("long").alias("test_start"),
                         (F.col("n") - (n_splits - F.col("fold") - 1) * t).cast("long").alias("test_end"))
                 .withColumn("train_rows", F.col("test_start")))


def regression_metrics(df: DataFrame, actual: str, pred: str) -> DataFrame:
    err = F.col(pred) - F.col(actual)
    mean_a = df.agg(F.avg(actual).alias("__m"))
    j = df.crossJoin(F.broadcast(mean_a))
    return j.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                 (1 - F.sum(err * err) / F.sum(F.pow(F.col(actual) - F.col("__m"), 2))).alias("r2"),
                 F.count(F.lit(1)).alias("n"))


def multiclass_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class precision/recall/F1 + support from the confusion counts; accuracy and macro-F1 on every row."""
    conf = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    classes = conf.select(F.col(label).alias("cls")).union(conf.select(F.col(pred).alias("cls"))).distinct()
    tp = conf.filter(F.col(label) == F.col(pred)).select(F.col(label).alias("cls"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col(label).alias("cls")).agg(F.sum("n").alias("support"))
    prd = conf.groupBy(F.col(pred).alias("cls")).agg(F.sum("n").alias("predicted"))
    per = (classes.join(tp, "cls", "left").join(sup, "cls", "left").join(prd, "cls", "left")
                  .fillna(0, ["tp", "support", "predicted"]))
    per = (per.withColumn("precision", F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0))
              .withColumn("recall", F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0))
              .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                       2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                          .otherwise(0.0)))
    tot = per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
    return per.crossJoin(F.broadcast(tot))
