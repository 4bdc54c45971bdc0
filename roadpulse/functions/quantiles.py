"""Exact quantiles of groups of any size.

Values are counted per (group, value) with map-side combine, range-partitioned by
group and value, and given running counts: per partition from the partition's own
rows, across partitions from one total per (group, partition).  The two
neighbours of a rank are then picked by an aggregate, so no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``keys`` plus one column per name in ``probs``: the linearly interpolated quantile of non-null ``value``.

    Groups without a value are absent; without keys the result has one row.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    counts = (df.filter(F.col(value).isNotNull()).groupBy(group.alias("g"), F.col(value).cast("double").alias("v"))
              .agg(F.count(F.lit(1)).alias("n")))
    d = cut_lineage(counts.repartitionByRange(n, "g", "v").withColumn("part", F.spark_partition_id()))
    totals = d.groupBy("g", "part").agg(F.sum("n").alias("t"))
    w = Window.partitionBy("g").orderBy("part")
    totals = totals.select("g", "part", (F.sum("t").over(w) - F.col("t")).alias("off"),
                           F.sum("t").over(Window.partitionBy("g")).alias("total"))
    inside = Window.partitionBy("part", "g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("run", F.sum("n").over(inside)).join(totals, ["g", "part"])
    upto = F.col("off") + F.col("run")               # ranks [upto - n, upto) carry this value
    picks = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((upto - F.col("n") <= rank) & (rank < upto), F.col("v"))).alias(f"{side}_{name}"))
    q = d.groupBy("g").agg(F.first("total").alias("total"), *picks)
    out = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("total") - 1)
        lo, hi = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        between = (F.ceil(at) - at) * lo + (at - F.floor(at)) * hi
        out.append(F.when(F.floor(at) == F.ceil(at), lo).otherwise(between).alias(name))
    if keys:
        return q.select(*[F.col("g")[k].alias(k) for k in keys], *out)
    one = spark.range(1).select(F.lit(0).alias("g"))
    return one.join(q, "g", "left").select(*out)
