"""Driver tables -> engine tables.

The test harness ships generic tables (``events``, ``orders`` ...).  The rules
below map them onto the incident schema by integer arithmetic only, so Spark
and the DuckDB oracle produce identical rows.  The same SQL text is rendered
for both dialects: Spark runs it through ``spark.sql`` with DataFrame
arguments (no global views), DuckDB runs it as a CTE.

Rules for ``zone``/``veh_type``/``address``/``description`` follow FIXTURES.md
section 2.1; the phrase list is the fixture's own test text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import vocab
from ..session import prepare

_DIALECT = {
    "spark": {"K": "get_json_object(props, '$.k')", "S": "STRING",
              "ADD_US": "timestampadd(MICROSECOND, {n}, {t})"},
    "duckdb": {"K": "json_extract_string(props, '$.k')", "S": "VARCHAR",
               "ADD_US": "({t} + to_microseconds({n}))"},
}

# Zones by key 0..14 (the 15 named zones, in the order of the station table),
# key 15 -> a zone with no station entry (tests the fallback), NULL -> missing.
_ZONE_NAMES = [z for z in vocab.ZONE_STATIONS if z != vocab.FALLBACK_ZONE] + ["Mystery Zone"]

# Raw vehicle strings by event_id % 10 (8 -> NULL, 9 -> padded upper-case lcv).
_VEH_RAW = vocab.VEH_TYPE_ORDER[:7] + ["Unknown"] + [None, " LCV "]

# Description phrases by (event_id + k) % 16 (English, Kannada, placeholders,
# blank and NULL) -- each exercises one text rule.
_DESCRIPTIONS = [
    "Cricket match at [LOCATION] stadium",
    "VIP convoy passing [LOCATION]",
    "ಪ್ರತಿಭಟನೆ near [LOCATION]",
    "Festival procession on [PERSON] road",
    "BWSSB pipe work at [LOCATION]",
    "Tree fall blocking left lane",
    "ನೀರು ನಿಂತಿದೆ [LOCATION]",
    "Accident between car and bike",
    "Lorry breakdown near [LOCATION]",
    "Big pothole on service road",
    "Slow moving traffic, congestion",
    "   ",
    None,
    "Police assistance requested [EMAIL]",
    "ಮರ ಬಿದ್ದಿದೆ",
    "Minister visit at [LOCATION]",
]


def _sql_str(v) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


def _case(expr: str, values: list, cast: str | None = None) -> str:
    arms = " ".join(f"WHEN {i} THEN {_sql_str(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


def incident_raw_sql(dialect: str, events: str) -> str:
    """SELECT producing ``incident_raw`` from the ``events`` table reference."""
    d = _DIALECT[dialect]
    K, S = d["K"], d["S"]

    def add_us(t: str, n: str) -> str:
        return d["ADD_US"].format(t=t, n=n)

    return f"""
SELECT id, start_datetime, status, event_cause, priority, requires_road_closure,
  latitude, longitude,
  CASE WHEN id % 5 = 0 THEN CAST(0 AS DOUBLE) WHEN id % 5 = 1 THEN CAST(NULL AS DOUBLE)
       ELSE latitude + CAST(0.0005 AS DOUBLE) END AS endlatitude,
  CASE WHEN id % 5 = 0 THEN CAST(0 AS DOUBLE) WHEN id % 5 = 1 THEN CAST(NULL AS DOUBLE)
       ELSE longitude + CAST(0.0005 AS DOUBLE) END AS endlongitude,
  corridor, junction, zone, veh_type, address, description, event_type,
  CASE WHEN close_kind = 'end' THEN {add_us('start_datetime', 'close_delta_us')} END AS end_datetime,
  CASE WHEN close_kind = 'resolved' THEN {add_us('start_datetime', 'close_delta_us')} END AS resolved_datetime,
  CASE WHEN close_kind = 'closed' THEN {add_us('start_datetime', 'close_delta_us')} END AS closed_datetime
FROM (
 SELECT CAST(event_id AS BIGINT) AS id, ts AS start_datetime,
  CASE WHEN event_id % 13 = 0 THEN 'active' WHEN event_id % 13 < 4 THEN 'resolved' ELSE 'closed' END AS status,
  CASE WHEN hb<600 THEN 'vehicle_breakdown' WHEN hb<680 THEN 'others' WHEN hb<740 THEN 'construction'
       WHEN hb<780 THEN 'pot_holes' WHEN hb<820 THEN ' Water_Logging ' WHEN hb<855 THEN 'accident'
       WHEN hb<890 THEN 'tree_fall' WHEN hb<910 THEN 'road_conditions' WHEN hb<930 THEN 'congestion'
       WHEN hb<945 THEN 'public_event' WHEN hb<960 THEN 'procession' WHEN hb<970 THEN 'vip_movement'
       WHEN hb<978 THEN 'protest' WHEN hb<984 THEN 'flood' WHEN hb<992 THEN 'debris' ELSE 'NULL' END AS event_cause,
  CASE WHEN hb >= 930 AND hb < 978 THEN 'planned' ELSE 'unplanned' END AS event_type,
  CASE WHEN k%10 < 3 THEN 'High' WHEN k%10 = 3 THEN 'Medium' WHEN k%10 < 9 THEN 'Low' ELSE 'P1' END AS priority,
  CASE WHEN cb < 5 OR (hb BETWEEN 680 AND 739 AND cb < 30) THEN 'TRUE' WHEN cb = 99 THEN 'NULL' ELSE 'FALSE' END
    AS requires_road_closure,
  CASE WHEN event_id % 50 = 7 THEN CAST(12.75 AS DOUBLE) + ((event_id*911) % 4300)*CAST(0.0001 AS DOUBLE)
       ELSE CAST(12.8 AS DOUBLE) + ((s*7) % 41)*CAST(0.01 AS DOUBLE)
            + ((event_id*17) % 21 - 10)*CAST(0.0001 AS DOUBLE) END AS latitude,
  CASE WHEN event_id % 50 = 7 THEN CAST(77.35 AS DOUBLE) + ((event_id*577) % 4700)*CAST(0.0001 AS DOUBLE)
       ELSE CAST(77.4 AS DOUBLE) + ((s*11) % 43)*CAST(0.01 AS DOUBLE)
            + ((event_id*29) % 21 - 10)*CAST(0.0001 AS DOUBLE) END AS longitude,
  CASE WHEN s % 11 = 0 THEN NULL ELSE concat('Corridor ', CAST(s % 11 AS {S})) END AS corridor,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('Junction ', CAST(s AS {S})) END AS junction,
  {_case('s % 17', _ZONE_NAMES)} AS zone,
  {_case('event_id % 10', _VEH_RAW)} AS veh_type,
  CASE WHEN event_id % 4 = 0 THEN NULL
       ELSE concat('Site ', CAST(s AS {S}), ', Main Road. Pin-560001, City') END AS address,
  {_case('(event_id + k) % 16', _DESCRIPTIONS)} AS description,
  CASE WHEN event_id % 9 = 0 THEN 'resolved' WHEN event_id % 9 < 4 THEN 'closed'
       WHEN event_id % 9 = 4 THEN 'end' ELSE NULL END AS close_kind,
  CASE WHEN event_id % 40 = 3 THEN CAST(-600000 AS BIGINT)
       WHEN event_id % 45 = 4 THEN CAST(1200000000000 AS BIGINT)
       ELSE CAST(round(value*100) AS BIGINT)*600000 END AS close_delta_us
 FROM (
  SELECT event_id, ts, user_id AS s, value, k,
         (event_id*7919 + k*31) % 1000 AS hb, (event_id*13 + k*7) % 100 AS cb
  FROM (SELECT event_id, ts, user_id, value, CAST({K} AS INT) AS k FROM {events}) b
 ) h
) r
"""


def road_points_sql(orders: str = "orders", lineitem: str = "lineitem") -> str:
    """Street segments through the sites (one SQL text for Spark and DuckDB): one row per way point.

    An order is a way and its line numbers are the way's points, 0.001 degree
    apart.  Even orders run east along the lines of latitude of the site grid, odd
    ones north along its lines of longitude, so the network grows with the tables.
    """
    return f"""
SELECT CAST(w AS BIGINT) AS way_id, CAST(q AS BIGINT) AS seq,
 CAST(CASE WHEN w % 2 = 0 THEN 1280000 + (c*7 % 41)*1000 ELSE 1280000 + (w*131 % 394)*100 + q*100 END AS BIGINT) AS lat_e5,
 CAST(CASE WHEN w % 2 = 0 THEN 7740000 + (w*577 % 414)*100 + q*100 ELSE 7740000 + (c*11 % 43)*1000 END AS BIGINT) AS lon_e5,
 CASE w % 7 WHEN 0 THEN 'trunk' WHEN 1 THEN 'tertiary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'primary'
            WHEN 4 THEN 'tertiary' WHEN 5 THEN 'motorway_link' ELSE 'secondary' END AS highway,
 CASE w % 5 WHEN 0 THEN '2;3' WHEN 1 THEN '4' WHEN 2 THEN NULL WHEN 3 THEN 'two' ELSE '2,2' END AS lanes_raw
FROM (SELECT DISTINCT o_orderkey AS w, o_custkey AS c, l_linenumber AS q
      FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey) p
"""


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def incident_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``incident_raw`` derived from the driver's ``events`` table."""
    prepare(spark)
    events = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value", "props"])
    return spark.sql(incident_raw_sql("spark", "{events}"), events=events)


def road_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Way points derived from the driver's ``orders`` and ``lineitem`` tables."""
    return spark.sql(road_points_sql("{orders}", "{lineitem}"),
                     orders=read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]),
                     lineitem=read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"]))


def closure_score_sql(events: str) -> str:
    """Stand-in probability per incident (FIXTURES 2.3 'score column')."""
    return (f"SELECT CAST(event_id AS BIGINT) AS id, "
            f"CAST(((event_id*37 + CAST({{K}} AS INT)*11) % 1000) AS DOUBLE) / 1000.0 AS closure_prob FROM {events}")


def closure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events", ["event_id", "props"])
    sql = closure_score_sql("{events}").replace("{K}", _DIALECT["spark"]["K"])
    return spark.sql(sql, events=events)


def given_labels_sql(events: str) -> str:
    """Fixture cluster labels: the site key (user) per event; every 50th+7 event is noise."""
    return (f"SELECT CAST(event_id AS BIGINT) AS id, CAST(CASE WHEN event_id % 50 = 7 THEN -1 ELSE user_id END "
            f"AS INT) AS cluster_label FROM {events}")


def given_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events", ["event_id", "user_id"])
    return spark.sql(given_labels_sql("{events}"), events=events)
