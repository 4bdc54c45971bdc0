"""As-of join: for each left row the last right row of its keys at or before its time.

Both sides are put in one order of (keys, time) by a range exchange, so a key with a
third of all rows spans many tasks.  Within a task the last right row is carried
down; a second, small step carries it across tasks: one row per (task, key), ordered by
task.  A left row sees right rows of its own time; of several right rows at one time
the greatest by value counts.  Rows without a key or time match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """All rows and columns of ``left`` plus ``right_time`` and ``values`` of the matched right row (null: none)."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__k{i}" for i in range(len(by))]
    found = F.struct(F.col(right_time).alias("t"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    row = F.struct(*[F.col(c) for c in left.columns])
    r = right.dropna(subset=[*by, right_time])
    ours = left.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), row.alias("row"))
    theirs = r.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(right_time).alias("__t"), F.lit(0).alias("__side"), found.alias("found"))
    every = ours.unionByName(theirs, allowMissingColumns=True)
    # the order of the parts is that of (keys, time): written once, as the parts depend on sampled bounds
    placed = cut_lineage(every.repartitionByRange(n, *keys, "__t", "__side").withColumn("__part", F.spark_partition_id()))
    order = Window.partitionBy("__part", *keys).orderBy("__t", "__side", "found").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn("seen", F.last("found", ignorenulls=True).over(order))
    # what each part knows last of each key it holds; a key lies in neighbouring parts, one row for each
    ends = placed.groupBy("__part", *keys).agg(F.max("found").alias("end"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__part", *[F.col(k).alias(f"{k}c") for k in keys], F.last("end", ignorenulls=True).over(before).alias("carry"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}c")) for k in keys]
    out = inside.filter("__side = 1").withColumnRenamed("__part", "__p").join(carried.filter("carry is not null"), [
        F.col("__p") == F.col("__part"), *same], "left")
    whole = F.coalesce("seen", "carry")
    for k in (*keys, "__t"):
        whole = F.when(F.col(k).isNotNull(), whole)
    out = out.withColumn("match", whole)
    return out.select("row.*", F.col("match.t").alias(right_time), *[F.col(f"match.v{i}").alias(v) for i, v in enumerate(values)])
