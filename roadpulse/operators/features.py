"""Feature engineering: scalar encoders and leakage-free history windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.windows import count_in_lookback, running_before

# Columns of the model-ready projection, in order (projected when present).
MODEL_COLUMNS = [
    "id", "event_type", "status", "authenticated", "latitude", "longitude",
    "corridor", "junction", "zone", "police_station",
    "event_cause", "priority", "requires_road_closure", "veh_type", "start_datetime",
    "road_class", "road_class_rank", "lane_count", "road_dist_m",
    "cause_severity_weight", "road_closure_binary", "veh_type_encoded",
    "event_semantic_type", "event_semantic_encoded",
    "hour_of_day", "day_of_week", "month", "is_peak_hour", "is_weekend",
    "junction_repeat_count", "corridor_7d_score",
    "cluster_label", "cluster_prior_events", "cluster_closure_rate",
    "severity_class", "duration_minutes",
]


def duration_minutes(df: DataFrame, max_minutes: int = vocab.MAX_DURATION_MINUTES) -> Column:
    ends = [c for c in ("resolved_datetime", "closed_datetime", "end_datetime") if c in df.columns]
    res = "coalesce(" + ", ".join(ends) + ")"
    d = F.expr(f"timestampdiff(MICROSECOND, start_datetime, {res})") / F.lit(60000000.0)
    return F.when((d > 0) & (d <= max_minutes), d)


def feat_duration(df: DataFrame, max_minutes: int = vocab.MAX_DURATION_MINUTES) -> DataFrame:
    return df.withColumn("duration_minutes", duration_minutes(df, max_minutes))


def severity_class(priority: Column, closure: Column, cause: Column,
                   high_at: int = vocab.SEVERITY_HIGH_AT, medium_at: int = vocab.SEVERITY_MEDIUM_AT) -> Column:
    total = (F.coalesce(vocab.map_lit(vocab.PRIORITY_SCORE)[priority], F.lit(0))
             + F.coalesce(closure.cast("int"), F.lit(0)) * 2
             + F.coalesce(vocab.map_lit(vocab.CAUSE_SEVERITY_SCORE)[cause], F.lit(0)))
    return F.when(total >= high_at, "High").when(total >= medium_at, "Medium").otherwise("Low")


def feat_severity(df: DataFrame) -> DataFrame:
    return df.withColumn("severity_class", severity_class(
        F.col("priority"), F.col("requires_road_closure"), F.col("event_cause")))


def peak_flag(hour: Column, peak_hours: list[int] | None = None) -> Column:
    return hour.isin(list(peak_hours or vocab.PEAK_HOURS)).cast("int")


def feat_temporal(df: DataFrame, peak_hours: list[int] | None = None) -> DataFrame:
    s = F.col("start_datetime")
    return (df.withColumn("hour_of_day", F.hour(s))
              .withColumn("day_of_week", F.weekday(s))          # 0 = Monday
              .withColumn("month", F.month(s))
              .withColumn("is_peak_hour", peak_flag(F.hour(s), peak_hours))
              .withColumn("is_weekend", (F.weekday(s) >= 5).cast("int")))


def feat_junction_repeat(df: DataFrame, bucket: str = "hour", counted: DataFrame | None = None) -> DataFrame:
    """Earlier events at the same junction; the catch-all ``unknown`` is 0.

    ``unknown`` rows skip the window entirely (they are the hottest key), the
    rest use the skew-safe two-level running count ordered by ``(start, id)``.
    """
    unknown = F.lower(F.col("junction")) == "unknown"
    known = df.filter(~unknown)
    rest = df.filter(unknown).withColumn("junction_repeat_count", F.lit(0))
    source = None if counted is None else counted.filter(~unknown)
    before = running_before(known, ["junction"], "start_datetime", "id", "junction_repeat_count", bucket=bucket, counted=source)
    return before.unionByName(rest)


def feat_corridor_7d(df: DataFrame, days: int = 7, bucket: str = "hour", counted: DataFrame | None = None) -> DataFrame:
    """Events on the same corridor with start in ``[t - 7 days, t)``."""
    return count_in_lookback(df, ["corridor"], "start_datetime", "id", "corridor_7d_score",
                             days=days, bucket=bucket, counted=counted)


def feat_cause_weight(df: DataFrame) -> DataFrame:
    return df.withColumn("cause_severity_weight",
                         vocab.lookup(vocab.CAUSE_WEIGHT, F.col("event_cause"), 1).cast("int"))


def feat_closure_binary(df: DataFrame) -> DataFrame:
    return df.withColumn("road_closure_binary",
                         F.coalesce(F.col("requires_road_closure").cast("int"), F.lit(0)))


def feat_veh_encoded(df: DataFrame) -> DataFrame:
    order = {v: i for i, v in enumerate(vocab.VEH_TYPE_ORDER)}
    return df.withColumn("veh_type_encoded",
                         vocab.lookup(order, F.col("veh_type"), len(order) - 1).cast("int"))


def semantic_type(cleaned: Column, text: Column) -> Column:
    """First matching pattern wins; blank / missing / unmatched -> ``other``.

    ``cleaned`` is the text with placeholders stripped; pass it as a column
    reference so the strip runs once per row, not once per pattern.
    """
    expr = F.lit("other")
    for name, pat in reversed(vocab.SEMANTIC_PATTERNS):
        expr = F.when(cleaned.rlike("(?i)" + pat), F.lit(name)).otherwise(expr)
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, F.lit("other")).otherwise(expr)


def strip_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + vocab.ANON_PLACEHOLDER, " ")


def text_semantic_type(df: DataFrame, col: str = "description") -> DataFrame:
    src = F.col(col) if col in df.columns else F.lit(None).cast("string")
    return (df.withColumn("__sem_txt", strip_placeholders(src))
              .withColumn("event_semantic_type", semantic_type(F.col("__sem_txt"), src))
              .drop("__sem_txt"))


def text_semantic_encode(df: DataFrame) -> DataFrame:
    order = {t: i for i, t in enumerate(vocab.SEMANTIC_TYPE_ORDER)}
    return df.withColumn("event_semantic_encoded",
                         vocab.lookup(order, F.col("event_semantic_type"), 0).cast("int"))


def feat_cluster_history(df: DataFrame, label: str = "cluster_label", bucket: str = "hour") -> DataFrame:
    """Leakage-free cluster statistics over strictly earlier events.

    ``cluster_prior_events``: earlier events in the same cluster (noise = 0);
    ``cluster_closure_rate``: their closure rate, or the global earlier closure
    rate when there are none or the row is noise.  Both the per-cluster and the
    global running totals are two-level prefix sums (no unpartitioned window
    over the fact table).
    """
    rows = df.withColumn("__clos", F.coalesce(F.col("road_closure_binary"), F.lit(0)))
    d = running_before(rows, [label], "start_datetime", "id", "__c_n", value="__clos", out_sum="__c_s", bucket=bucket)
    d = running_before(d, [], "start_datetime", "id", "__g_n", value="__clos", out_sum="__g_s", bucket=bucket, counted=rows)
    g_rate = F.when(F.col("__g_n") > 0, F.col("__g_s") / F.col("__g_n")).otherwise(F.lit(0.0))
    noise = F.col(label) == -1
    rate = F.when(noise | (F.col("__c_n") == 0), g_rate).otherwise(F.col("__c_s") / F.col("__c_n"))
    return (d.withColumn("cluster_closure_rate", rate.cast("double"))
             .withColumn("cluster_prior_events", F.when(noise, 0).otherwise(F.col("__c_n")).cast("int"))
             .drop("__clos", "__c_n", "__c_s", "__g_n", "__g_s"))


def feat_core(clean: DataFrame, peak_hours: list[int] | None = None) -> DataFrame:
    """Scalar + window features that need no spatial join; the counts are taken from the clean rows."""
    return (clean.transform(feat_duration)
                 .transform(feat_severity)
                 .transform(lambda d: feat_temporal(d, peak_hours))
                 .transform(lambda d: feat_junction_repeat(d, counted=clean))
                 .transform(lambda d: feat_corridor_7d(d, counted=clean))
                 .transform(feat_cause_weight)
                 .transform(feat_closure_binary)
                 .transform(feat_veh_encoded)
                 .transform(text_semantic_type)
                 .transform(text_semantic_encode))


def feat_model(clean: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``feat_core``: what needs one row only comes first, so that texts and other columns are not shuffled."""
    rows = (clean.transform(feat_duration).transform(feat_severity).transform(feat_temporal).transform(feat_cause_weight)
                 .transform(feat_closure_binary).transform(feat_veh_encoded).transform(text_semantic_type).transform(text_semantic_encode))
    counts = ["junction_repeat_count", "corridor_7d_score"]
    rows = rows.select(*dict.fromkeys([*[c for c in columns if c not in counts], "id", "start_datetime", "junction", "corridor"]))
    return (rows.transform(lambda d: feat_junction_repeat(d, counted=clean))
                .transform(lambda d: feat_corridor_7d(d, counted=clean)).select(*columns))


def project_model_ready(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in MODEL_COLUMNS if c in df.columns])


def peak_hours_derive(df: DataFrame) -> DataFrame:
    """Hours whose incident count exceeds the mean hourly count (<= 24 rows)."""
    per_hour = df.groupBy(F.hour("start_datetime").alias("hour_of_day")).agg(F.count(F.lit(1)).alias("n"))
    return (per_hour.withColumn("mean_n", F.avg("n").over(Window.partitionBy()))
                    .filter(F.col("n") > F.col("mean_n"))
                    .select("hour_of_day", "n"))
