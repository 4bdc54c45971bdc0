"""Cleaning: projections, null handling, vocabularies, data-quality checks.

Every step is a ``DataFrame -> DataFrame`` of Column expressions (no UDFs), so
the whole chain fuses into one whole-stage-codegen projection after the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab

DATETIME_COLUMNS = ["start_datetime", "end_datetime", "resolved_datetime",
                    "closed_datetime", "modified_datetime", "created_date"]


def _has(df: DataFrame, c: str) -> bool:
    return c in df.columns


def null_tokens(df: DataFrame, tokens: list[str] = vocab.NULL_TOKENS) -> DataFrame:
    """Raw-feed missing tokens (``NULL``, ``N/A``, empty ...) become NULL in every string column."""
    toks = [t for t in tokens]
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(F.when(F.col(f.name).isin(toks), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def clean_zero_coords(df: DataFrame) -> DataFrame:
    """End coordinates of exactly 0 are a 'point event' sentinel, not a place."""
    for c in ("endlatitude", "endlongitude"):
        if _has(df, c):
            df = df.withColumn(c, F.nullif(F.col(c), F.lit(0.0)))
    return df


def parse_naive_timestamp(c: Column) -> Column:
    """Parse a tagged or untagged datetime string; keep the wall clock, bad -> NULL.

    ``2024-01-01 08:00:00+00`` -> ``2024-01-01 08:00:00`` (timestamp_ntz).
    Already-typed timestamps pass through.
    """
    s = F.regexp_replace(F.trim(c.cast("string")), r"([+-]\d{2}(:?\d{2})?|Z)$", "")
    s = F.regexp_replace(s, "T", " ")
    return F.try_to_timestamp(s).cast("timestamp_ntz")


def clean_datetimes(df: DataFrame) -> DataFrame:
    for c in DATETIME_COLUMNS:
        if _has(df, c):
            dt = df.schema[c].dataType
            if isinstance(dt, T.TimestampNTZType):
                continue
            if isinstance(dt, T.TimestampType):
                # a zoned instant -> its UTC wall clock
                df = df.withColumn(c, F.to_utc_timestamp(F.col(c), "UTC").cast("timestamp_ntz"))
            else:
                df = df.withColumn(c, parse_naive_timestamp(F.col(c)))
    return df


def closure_flag(c: Column) -> Column:
    s = F.upper(F.trim(c.cast("string")))
    return F.when(s == "TRUE", F.lit(True)).when(s == "FALSE", F.lit(False)).otherwise(F.lit(None).cast("boolean"))


def clean_closure_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("requires_road_closure", closure_flag(F.col("requires_road_closure")))


def canonical_cause(c: Column) -> Column:
    """Unknown and missing tokens map to ``other``."""
    return F.coalesce(vocab.map_lit(vocab.CAUSE_MAP)[F.lower(F.trim(c))], F.lit("other"))


def clean_cause(df: DataFrame) -> DataFrame:
    return df.withColumn("event_cause", canonical_cause(F.col("event_cause")))


def clean_drop_missing_start(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["start_datetime"])


def clean_priority(df: DataFrame) -> DataFrame:
    p = F.col("priority")
    return df.withColumn("priority", F.when(p.isin(vocab.VALID_PRIORITIES), p).otherwise(F.lit("Low")))


def _fill_trim(df: DataFrame, c: str, default: str, lower: bool = False) -> DataFrame:
    v = F.trim(F.coalesce(F.col(c), F.lit(default)))
    return df.withColumn(c, F.lower(v) if lower else v)


def clean_corridor(df: DataFrame) -> DataFrame:
    return _fill_trim(df, "corridor", "Non-corridor")


def clean_zone(df: DataFrame) -> DataFrame:
    return _fill_trim(df, "zone", "Unknown")


def clean_veh_type(df: DataFrame) -> DataFrame:
    return _fill_trim(df, "veh_type", "unknown", lower=True)


def clean_junction(df: DataFrame) -> DataFrame:
    return _fill_trim(df, "junction", "unknown")


def clean_pipeline(raw: DataFrame) -> DataFrame:
    """The ordered cleaning chain (one fused projection + one filter)."""
    return (raw.transform(null_tokens)
               .transform(clean_zero_coords)
               .transform(clean_datetimes)
               .transform(clean_closure_flag)
               .transform(clean_cause)
               .transform(clean_drop_missing_start)
               .transform(clean_priority)
               .transform(clean_corridor)
               .transform(clean_zone)
               .transform(clean_veh_type)
               .transform(clean_junction))


class MissingColumnsError(ValueError):
    pass


def dq_validate(df: DataFrame, raise_on_critical: bool = True) -> DataFrame:
    """Data-quality issues as a table ``(issue, column_name, n)``, one row per non-zero issue.

    Missing required columns are critical: raised at plan time, or reported as
    one ``missing_required_column`` row per column.
    """
    spark = df.sparkSession
    missing = [c for c in vocab.REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        if raise_on_critical:
            raise MissingColumnsError(f"missing required columns: {missing}")
        return spark.createDataFrame([("missing_required_column", c, 1) for c in missing],
                                     "issue string, column_name string, n bigint")
    lat = F.col("latitude").cast("double")
    lon = F.col("longitude").cast("double")

    def cnt(cond: Column) -> Column:
        return F.count_if(cond).cast("bigint")

    (lat_lo, lat_hi), (lon_lo, lon_hi) = vocab.BBOX_LAT, vocab.BBOX_LON
    start = F.col("start_datetime")
    start_ok = start if isinstance(df.schema["start_datetime"].dataType, (T.TimestampNTZType, T.TimestampType)) \
        else parse_naive_timestamp(start)
    counts = df.agg(
        cnt((lat < lat_lo) | (lat > lat_hi)).alias("latitude"),
        cnt((lon < lon_lo) | (lon > lon_hi)).alias("longitude"),
        cnt(start_ok.isNull()).alias("start_datetime"),
        cnt(F.col("event_cause").isNull()).alias("event_cause"),
        cnt(F.col("status").isNull()).alias("status"),
        cnt(F.col("id").isNull()).alias("id"),
    )
    stacked = counts.selectExpr(
        "stack(6, 'out_of_range', 'latitude', latitude, 'out_of_range', 'longitude', longitude, "
        "'unparseable', 'start_datetime', start_datetime, 'null', 'event_cause', event_cause, "
        "'null', 'status', status, 'null', 'id', id) AS (issue, column_name, n)")
    return stacked.filter(F.col("n") > 0)


def validate_live_event(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split live events into (valid, quarantine) by the input contract.

    Valid rows get blank cause/zone/vehicle replaced by ``unknown``.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    ok = ((F.col("hour_of_day").between(0, 23))
          & (F.col("day_of_week").between(0, 6))
          & (lat.isNull() | lat.between(*vocab.BBOX_LAT))
          & (lon.isNull() | lon.between(*vocab.BBOX_LON))
          & (F.coalesce(F.col("corridor_7d_score"), F.lit(0)) >= 0)
          & (F.coalesce(F.col("junction_repeat_count"), F.lit(0)) >= 0)
          & (F.coalesce(F.length("description"), F.lit(0)) <= 2000))
    ok = F.coalesce(ok, F.lit(False))
    valid = df.filter(ok)
    for c in ("event_cause", "zone", "veh_type"):
        if c in df.columns:
            valid = valid.withColumn(c, F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", "unknown")
                                     .otherwise(F.col(c)))
    return valid, df.filter(~ok)
