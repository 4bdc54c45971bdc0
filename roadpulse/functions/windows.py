"""Skew-safe backward-looking windows.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to
one task.  Incident keys are heavily skewed (catch-all corridors, one busy
junction can hold a third of all rows), so running counts are computed as
**two-level prefix sums**:

1. ``(key, time bucket)`` partial counts/sums (map-side combined aggregate);
2. an exclusive running total over the buckets of each key (a small table:
   one row per key and bucket);
3. the running total joins its bucket as a row before all others;
4. result = running count within ``(key, bucket)``, so no task holds more than one
   bucket of one key and the rows are shuffled once.

Range counts ("events in [t - 7 days, t)") are a difference of two prefix
counts; the lower bound is evaluated by a probe row placed at ``t - 7 days``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F




def _bucket(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def running_before(df: DataFrame, keys: list[str], ts: str, tiebreak: str,
                   out_count: str, value: str | None = None, out_sum: str | None = None,
                   bucket: str = "hour", counted: DataFrame | None = None) -> DataFrame:
    """Count (and optionally sum ``value``) of rows with the same ``keys`` that
    come strictly before each row in ``(ts, tiebreak)`` order.

    ``counted``: the same rows without columns that are costly to derive; the bucket
    totals are taken from it.
    """
    b = "__bucket"
    unit = {"__n": F.lit(1).cast("long")} | ({"__s": F.coalesce(F.col(value), F.lit(0))} if value else {})
    parts = (counted if counted is not None else df).withColumn(b, _bucket(F.col(ts), bucket)).groupBy(*keys, b).agg(
        *[F.sum(c).alias(n) for n, c in unit.items()])
    wk = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(b) \
        .rowsBetween(Window.unboundedPreceding, -1)
    # a bucket's running total is its first row, so that the rows need no join with the totals
    offs = parts.select(*keys, b, *[F.coalesce(F.sum(n).over(wk), F.lit(0)).alias(n) for n in unit], F.lit(True).alias("__off"))
    d = df.withColumn(b, _bucket(F.col(ts), bucket)).withColumns(unit | {"__off": F.lit(False)})
    win = Window.partitionBy(*keys, b).orderBy(F.desc("__off"), ts, tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    outs = {out_count: F.sum("__n").over(win).cast("int")} | ({out_sum or f"{value}_before": F.sum("__s").over(win)} if value else {})
    d = d.unionByName(offs, allowMissingColumns=True).withColumns(outs)
    return d.filter(~F.col("__off")).drop(b, "__off", *unit)


def count_in_lookback(df: DataFrame, keys: list[str], ts: str, id_col: str, out: str,
                      days: int = 7, bucket: str = "hour", counted: DataFrame | None = None) -> DataFrame:
    """Rows with the same ``keys`` whose ``ts`` lies in ``[t - days, t)``.

    Exact, skew-safe: ``P(t) - P(t - days)`` where ``P(x)`` counts rows with
    ``ts < x``; both terms come from one bucketed prefix pass over reals+probes.
    ``counted``: the same rows without columns that are costly to derive.
    """
    look = F.expr(f"INTERVAL '{int(days)} 00:00:00' DAY TO SECOND")
    base = (counted if counted is not None else df).select(*keys, F.col(ts).alias("__t"), F.col(id_col).alias("__id"))
    reals = base.withColumn("__real", F.lit(1))
    probes = base.withColumn("__t", F.col("__t") - look).withColumn("__real", F.lit(0))
    u = reals.unionByName(probes).withColumn("__b", _bucket(F.col("__t"), bucket)).withColumn("__n", F.col("__real").cast("long"))

    parts = u.groupBy(*keys, "__b").agg(F.sum("__n").alias("__n"))
    wk = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("__b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    # a bucket's running total is its first row (no time), so that the rows need no join with the totals
    offs = parts.select(*keys, "__b", F.coalesce(F.sum("__n").over(wk), F.lit(0)).alias("__n"))
    # reals strictly earlier than this row's time
    win = Window.partitionBy(*keys, "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    tie = Window.partitionBy(*keys, "__b", "__t")
    u = (u.unionByName(offs, allowMissingColumns=True).withColumn("__le", F.sum("__n").over(win))
          .withColumn("__p", F.col("__le") - F.sum("__n").over(tie)).filter(F.col("__real").isNotNull()))
    cnt = (u.groupBy("__id")
             .agg((F.sum(F.when(F.col("__real") == 1, F.col("__p")))
                   - F.sum(F.when(F.col("__real") == 0, F.col("__p")))).cast("int").alias(out)))
    return df.join(cnt.withColumnRenamed("__id", id_col), id_col, "left")


def count_in_lookback_window(df: DataFrame, keys: list[str], ts: str, out: str, days: int = 7) -> DataFrame:
    """The same count with one range-frame window (one sort per key).

    Cheaper when no key is hot; kept as the reference formulation.
    """
    expr =(f"count(1) OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY `{ts}` "
            f"RANGE BETWEEN INTERVAL '{int(days)} 00:00:00.000000' DAY TO SECOND PRECEDING "
            f"AND INTERVAL '0 00:00:00.000001' DAY TO SECOND PRECEDING)")
    return df.withColumn(out, F.expr(expr).cast("int"))


def rank_dense_by(keys: DataFrame, key: str, out: str, partitions: int | None = None) -> DataFrame:
    """0-based rank of each distinct ``key`` without a global window.

    Range-partition by key, count rows per partition (one small row per
    partition), prefix-sum those counts, then number rows within each
    partition: the distributed form of "zip with index after sort".
    """
    spark = keys.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    from ..session import cut_lineage
    # partition ids depend on sampled range bounds: materialise once
    d = cut_lineage(keys.select(key).repartitionByRange(n, key).withColumn("__part", F.spark_partition_id()))
    sizes = d.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offs = sizes.select("__part", F.coalesce(F.sum("__n").over(
        Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    w = Window.partitionBy("__part").orderBy(key)
    return (d.withColumn("__rn", F.row_number().over(w) - 1)
             .join(F.broadcast(offs), "__part")
             .select(key, (F.col("__off") + F.col("__rn")).cast("int").alias(out)))
