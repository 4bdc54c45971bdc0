"""Sources and sinks: raw CSV feed, road-network JSON, Parquet/text sinks.

Readers always take an explicit schema (no inference pass over the data);
writers are plain DataFrameWriter calls, partitioned where consumers prune.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab

RAW_COLUMNS = ["id", "event_type", "status", "authenticated", "latitude", "longitude", "endlatitude", "endlongitude",
               "address", "corridor", "junction", "zone", "police_station", "event_cause", "priority",
               "requires_road_closure", "veh_type", "description", "start_datetime", "end_datetime",
               "resolved_datetime", "closed_datetime", "modified_datetime", "created_date"]
_NUMERIC = {"id": T.LongType(), "latitude": T.DoubleType(), "longitude": T.DoubleType(),
            "endlatitude": T.DoubleType(), "endlongitude": T.DoubleType()}

_CSV_OPTS = {"header": "true", "multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false", "nullValue": "", "emptyValue": ""}


def raw_schema(columns: list[str] | None = None) -> T.StructType:
    cols = columns or RAW_COLUMNS
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def read_incident_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Raw incident CSV: every column read as text (schema given, no inference), missing tokens -> NULL,
    numeric columns via ``try_cast``; quoted multi-line fields are supported."""
    df = spark.read.options(**_CSV_OPTS).schema(raw_schema(columns)).csv(path)
    out = []
    for c in df.columns:
        v = F.when(F.col(c).isin(vocab.NULL_TOKENS), F.lit(None)).otherwise(F.col(c))
        out.append((v.try_cast(_NUMERIC[c]) if c in _NUMERIC else v).alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    opts = dict(_CSV_OPTS, timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    df.write.mode("overwrite").options(**opts).csv(path)


ROAD_WAY_SCHEMA = T.StructType([
    T.StructField("way_id", T.LongType()), T.StructField("h", T.StringType()), T.StructField("l", T.StringType()),
    T.StructField("g", T.ArrayType(T.ArrayType(T.DoubleType())))])

ELEMENT_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("tags", T.StructType([T.StructField("highway", T.StringType()), T.StructField("lanes", T.StringType())])),
    T.StructField("geometry", T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()),
                                                        T.StructField("lon", T.DoubleType())])))])


def read_road_ways(spark: SparkSession, path: str) -> DataFrame:
    """Slim road network as JSON lines (one way per line, so the scan splits); gzip is read transparently."""
    return spark.read.schema(ROAD_WAY_SCHEMA).json(path)


def write_road_ways(ways: DataFrame, path: str) -> None:
    ways.write.mode("overwrite").option("compression", "gzip").json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_text_lines(df: DataFrame, col: str, path: str) -> None:
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)
