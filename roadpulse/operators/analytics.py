"""Analytics roll-ups over the feature table (one aggregate pass each).

All of these are partial/final hash aggregates: map-side combine bounds the
shuffle to (#groups x #partitions) rows regardless of input size, and a hot
group only grows one accumulator.  Medians and quartiles are exact and
distributed (``functions.quantiles``): no task holds a group.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.asof import asof_join
from ..functions.quantiles import group_quantiles

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def r6(c: Column) -> Column:
    """Round a double to 6 places (engine-independent last digits)."""
    return F.round(c, 6)


def _with_median(row: DataFrame, df: DataFrame, value: str, out: str) -> DataFrame:
    """A one-row summary plus the exact median of ``value``."""
    med = group_quantiles(df, [], value, {"q": 0.5}).select(r6(F.col("q")).alias(out))
    return row.crossJoin(F.broadcast(med))


def kpi_home(df: DataFrame) -> DataFrame:
    sev = F.col("severity_class")
    row = df.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("corridor").alias("corridors"),
        F.count_distinct(F.when(F.col("junction") != "unknown", F.col("junction"))).alias("junctions"),
        F.count_if(sev == "High").cast("bigint").alias("high_events"),
        r6(100 * F.avg((sev == "High").cast("double"))).alias("high_pct"),
    )
    return _with_median(row, df, "duration_minutes", "median_duration")


def severity_breakdown(df: DataFrame) -> DataFrame:
    order = {"High": 0, "Medium": 1, "Low": 2}
    return (df.groupBy("severity_class").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("sort_key", vocab.lookup(order, F.col("severity_class"), 3).cast("int")))


def top_values(df: DataFrame, col: str, exclude: str, k: int) -> DataFrame:
    """Top-k values of ``col`` by count, ties by value (TakeOrderedAndProject)."""
    return (df.filter(F.col(col) != exclude).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.asc(col)).limit(k))


def top_corridors(df: DataFrame, k: int = 5) -> DataFrame:
    return top_values(df, "corridor", "Non-corridor", k)


def top_junctions(df: DataFrame, k: int = 10) -> DataFrame:
    return top_values(df, "junction", "unknown", k)


def analytics_filter(df: DataFrame, zones: list[str] | None = None, causes: list[str] | None = None,
                     date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Parameterised page filter (inclusive date range on the start date)."""
    cond = F.lit(True)
    if zones is not None:
        cond = cond & F.col("zone").isin(zones)
    if causes is not None:
        cond = cond & F.col("event_cause").isin(causes)
    d = F.to_date("start_datetime")
    if date_from:
        cond = cond & (d >= F.lit(_dt.date.fromisoformat(date_from)))
    if date_to:
        cond = cond & (d <= F.lit(_dt.date.fromisoformat(date_to)))
    return df.filter(cond)


def kpi_filtered(df: DataFrame) -> DataFrame:
    row = df.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("severity_class") == "High").cast("bigint").alias("high_events"),
        F.count("duration_minutes").alias("with_duration"),
        F.count_distinct("corridor").alias("corridors"),
    )
    return _with_median(row, df, "duration_minutes", "median_duration")


def cause_label(c: Column) -> Column:
    return F.coalesce(vocab.map_lit(vocab.CAUSE_DISPLAY)[c], c)


def cause_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(cause_label(F.col("event_cause")).alias("cause_label")).agg(F.count(F.lit(1)).alias("n"))


def hourly_load(df: DataFrame) -> DataFrame:
    return (df.groupBy("hour_of_day").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("load", F.when(F.col("hour_of_day").isin(vocab.PEAK_HOURS), "High-incident")
                          .otherwise("Off-peak")))


def dow_distribution(df: DataFrame) -> DataFrame:
    names = {i: n for i, n in enumerate(DAY_NAMES)}
    return (df.groupBy("day_of_week").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("day", vocab.map_lit(names)[F.col("day_of_week")])
              .withColumn("weekend", F.when(F.col("day_of_week") >= 5, "Weekend").otherwise("Weekday")))


def corridor_weekly(df: DataFrame, k: int = 6) -> DataFrame:
    """Mean 7-day score per Monday week for the top-k corridors (broadcast semi join: k rows)."""
    top = top_values(df, "corridor", "Non-corridor", k).select("corridor")
    sel = df.join(F.broadcast(top), "corridor", "left_semi")
    week = F.date_trunc("week", F.col("start_datetime")).cast("timestamp_ntz")
    return (sel.groupBy(week.alias("week"), "corridor")
               .agg(r6(F.avg("corridor_7d_score")).alias("avg_7d_score")))


def resolution_by_cause(df: DataFrame) -> DataFrame:
    d = df.filter(F.col("duration_minutes").isNotNull()).withColumn("cause_label", cause_label(F.col("event_cause")))
    med = group_quantiles(d, ["cause_label"], "duration_minutes", {"q": 0.5})
    return (d.groupBy("cause_label").agg(r6(F.avg("duration_minutes")).alias("mean_minutes"), F.count(F.lit(1)).alias("n"))
             .join(med, "cause_label").select("cause_label", "mean_minutes", r6(F.col("q")).alias("median_minutes"), "n"))


def semantic_distribution(df: DataFrame) -> DataFrame:
    """Counts of mined types other than ``other``, with the matched share."""
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    sem = (df.filter(F.col("event_semantic_type") != "other")
             .groupBy("event_semantic_type").agg(F.count(F.lit(1)).alias("n")))
    matched = sem.agg(F.sum("n").alias("__matched"))
    return (sem.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(matched))
               .select(F.initcap(F.replace(F.col("event_semantic_type"), F.lit("_"), F.lit(" "))).alias("label"),
                       "n", r6(100 * F.col("__matched") / F.col("__total")).alias("matched_pct")))


def deterministic_mode(df: DataFrame, keys: list[str], value: str, out: str | None = None) -> DataFrame:
    """Most frequent ``value`` per key; ties -> the smallest value (pandas ``mode().iloc[0]``).

    Two aggregates (key,value counts then per-key max_by) -- no per-key list.
    """
    out = out or f"mode_{value}"
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    # max over (count, -rank of value): smallest value wins a tie
    return counts.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct(-F.col("__n"), F.col(value))).alias(out))


def clearance_stats(df: DataFrame, min_n: int = 5, max_minutes: float = 1440.0) -> DataFrame:
    """Per cause (n >= min_n) plus an ``_overall`` row: median/p25/p75 (linear) and n."""
    d = df.filter((F.col("duration_minutes") > 0) & (F.col("duration_minutes") <= max_minutes))
    d = d.select("duration_minutes", F.explode(F.array("event_cause", F.lit("_overall"))).alias("cause"))
    q = group_quantiles(d, ["cause"], "duration_minutes", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    n = d.groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
    return (n.filter((F.col("cause") == "_overall") | (F.col("n") >= min_n)).join(q, "cause", "left")
             .select("cause", r6(F.col("q50")).alias("median"), r6(F.col("q25")).alias("p25"),
                     r6(F.col("q75")).alias("p75"), "n"))


def corridor_history_medians(df: DataFrame, features: list[str] | None = None,
                             rate_features: tuple[str, ...] = ("cluster_closure_rate", "lane_count")) -> DataFrame:
    """Per-corridor and global medians of history features (one distributed quantile pass).

    Counts -> integer half-even, rates -> 4 places half-even.  The global row
    has ``corridor = NULL`` and ``is_global = true``.
    """
    feats = [f for f in (features or ["corridor_7d_score", "junction_repeat_count", "cluster_prior_events",
                                       "cluster_closure_rate", "road_class_rank", "lane_count"]) if f in df.columns]
    scope = F.array(F.struct(F.lit(False).alias("is_global"), F.coalesce("corridor", F.lit("")).alias("at")),
                    F.struct(F.lit(True).alias("is_global"), F.lit("").alias("at")))
    value = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in feats])
    long = df.select(F.explode(scope).alias("s"), value.alias("a")).select("s.*", F.inline("a"))
    med = group_quantiles(long, ["is_global", "at", "f"], "v", {"m": 0.5})
    pick = [F.max(F.when(F.col("f") == f, F.bround("m", 4) if f in rate_features else F.bround("m", 0))) for f in feats]
    pick = [(p if f in rate_features else p.cast("bigint")).alias(f) for f, p in zip(feats, pick)]
    return med.groupBy("is_global", "at").agg(*pick).select(
        F.when(~F.col("is_global"), F.col("at")).alias("corridor"), "is_global", *feats)


def history_lookup(queries: DataFrame, medians: DataFrame) -> DataFrame:
    """Corridor medians for each query row, else the global medians (the one global row is broadcast)."""
    feats = [c for c in medians.columns if c not in ("corridor", "is_global")]
    per = medians.filter(~F.col("is_global")).select(F.col("corridor").alias("__c"), *[F.col(f).alias(f"__p_{f}") for f in feats])
    glob = medians.filter(F.col("is_global")).select(*[F.col(f).alias(f"__g_{f}") for f in feats])
    j = queries.join(per, queries["corridor"] == per["__c"], "left").crossJoin(F.broadcast(glob))
    known = F.col("__c").isNotNull()
    return j.select(*queries.columns,
                    *[F.when(known, F.col(f"__p_{f}")).otherwise(F.col(f"__g_{f}")).alias(f) for f in feats])


def corridor_list(df: DataFrame) -> DataFrame:
    return df.select("corridor").distinct().orderBy("corridor")


def corridor_days(events: DataFrame) -> DataFrame:
    """(corridor, at, events, median_7d) for each ``day`` with events of a corridor; known from the day's end ``at`` on."""
    n = events.groupBy("corridor", "day").agg(F.count(F.lit(1)).alias("events"))
    median = group_quantiles(events, ["corridor", "day"], "corridor_7d_score", {"median_7d": 0.5})
    return (n.join(median, ["corridor", "day"], "left")
             .select("corridor", (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("at"), "events", "median_7d"))


def history_asof(events: DataFrame, days: DataFrame) -> DataFrame:
    """``events`` with the corridor's latest day that had ended by their time (null: none had)."""
    return asof_join(events, days, ["corridor"], "start_datetime", "at", ["events", "median_7d"])
