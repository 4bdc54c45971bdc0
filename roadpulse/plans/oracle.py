"""DuckDB formulations used as the correctness oracle.

Each registered query's oracle is ``WITH <base CTEs> <final SELECT>``; the base
CTEs re-derive the incident tables straight from the driver's views with
plain SQL (no shared code path with the Spark operators except the fixture
adapter, which is a data specification).
"""

from __future__ import annotations

from .. import vocab
from ..sources.fixtures import incident_raw_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(vals) -> str:
    return "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in vals) + ")"


def case_map(expr: str, d: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {q(k) if isinstance(k, str) else k} THEN {q(v) if isinstance(v, str) else v}"
                    for k, v in d.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def _nt(c: str) -> str:
    return f"(CASE WHEN {c} IN {in_list(vocab.NULL_TOKENS)} THEN NULL ELSE {c} END)"


RAW = f"raw AS ({incident_raw_sql('duckdb', 'events')})"

CLEAN = f"""clean AS (
SELECT id, start_datetime, end_datetime, resolved_datetime, closed_datetime,
  {_nt('status')} AS status, {_nt('event_type')} AS event_type,
  latitude, longitude, nullif(endlatitude, 0) AS endlatitude, nullif(endlongitude, 0) AS endlongitude,
  CASE upper(trim({_nt('requires_road_closure')})) WHEN 'TRUE' THEN true WHEN 'FALSE' THEN false END
    AS requires_road_closure,
  coalesce({case_map(f"lower(trim({_nt('event_cause')}))", vocab.CAUSE_MAP)}, 'other') AS event_cause,
  CASE WHEN {_nt('priority')} IN {in_list(vocab.VALID_PRIORITIES)} THEN priority ELSE 'Low' END AS priority,
  trim(coalesce({_nt('corridor')}, 'Non-corridor')) AS corridor,
  trim(coalesce({_nt('zone')}, 'Unknown')) AS zone,
  lower(trim(coalesce({_nt('veh_type')}, 'unknown'))) AS veh_type,
  trim(coalesce({_nt('junction')}, 'unknown')) AS junction,
  {_nt('address')} AS address, {_nt('description')} AS description
FROM raw WHERE start_datetime IS NOT NULL)"""


def _semantic_sql(col: str) -> str:
    cleaned = f"regexp_replace({col}, {q('(?i)' + vocab.ANON_PLACEHOLDER)}, ' ', 'g')"
    arms = " ".join(f"WHEN regexp_matches({cleaned}, {q('(?i)' + p)}) THEN {q(n)}"
                    for n, p in vocab.SEMANTIC_PATTERNS)
    return f"CASE WHEN {col} IS NULL OR trim({col}) = '' THEN 'other' {arms} ELSE 'other' END"


def severity_sql(priority: str, closure: str, cause: str) -> str:
    total = (f"(coalesce({case_map(priority, vocab.PRIORITY_SCORE)}, 0)"
             f" + coalesce(CAST({closure} AS INTEGER), 0) * 2"
             f" + coalesce({case_map(cause, vocab.CAUSE_SEVERITY_SCORE)}, 0))")
    return (f"CASE WHEN {total} >= {vocab.SEVERITY_HIGH_AT} THEN 'High' "
            f"WHEN {total} >= {vocab.SEVERITY_MEDIUM_AT} THEN 'Medium' ELSE 'Low' END")


_VEH = {v: i for i, v in enumerate(vocab.VEH_TYPE_ORDER)}
_SEM = {t: i for i, t in enumerate(vocab.SEMANTIC_TYPE_ORDER)}

FEAT = f"""feat0 AS (
SELECT *, date_diff('microsecond', start_datetime,
                    coalesce(resolved_datetime, closed_datetime, end_datetime)) / 60000000.0 AS __d
FROM clean),
feat AS (
SELECT * EXCLUDE (__d, __sem),
  CAST({case_map('__sem', _SEM, '0')} AS INTEGER) AS event_semantic_encoded
FROM (
SELECT * ,
  CASE WHEN __d > 0 AND __d <= {vocab.MAX_DURATION_MINUTES} THEN __d END AS duration_minutes,
  {severity_sql('priority', 'requires_road_closure', 'event_cause')} AS severity_class,
  CAST(hour(start_datetime) AS INTEGER) AS hour_of_day,
  CAST(isodow(start_datetime) - 1 AS INTEGER) AS day_of_week,
  CAST(month(start_datetime) AS INTEGER) AS month,
  CAST(hour(start_datetime) IN {in_list(vocab.PEAK_HOURS)} AS INTEGER) AS is_peak_hour,
  CAST(isodow(start_datetime) - 1 >= 5 AS INTEGER) AS is_weekend,
  CASE WHEN lower(junction) = 'unknown' THEN 0
       ELSE CAST(row_number() OVER (PARTITION BY junction ORDER BY start_datetime, id) - 1 AS INTEGER)
  END AS junction_repeat_count,
  CAST(count(*) OVER (PARTITION BY corridor ORDER BY start_datetime
       RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS INTEGER)
    AS corridor_7d_score,
  CAST(coalesce({case_map('event_cause', vocab.CAUSE_WEIGHT)}, 1) AS INTEGER) AS cause_severity_weight,
  CAST(coalesce(CAST(requires_road_closure AS INTEGER), 0) AS INTEGER) AS road_closure_binary,
  CAST(coalesce({case_map('veh_type', _VEH)}, {len(_VEH) - 1}) AS INTEGER) AS veh_type_encoded,
  {_semantic_sql('description')} AS event_semantic_type,
  {_semantic_sql('description')} AS __sem
FROM feat0) x)"""


def with_base(final_sql: str, upto: str = "feat", extra: list[str] | None = None) -> str:
    ctes = [RAW, CLEAN]
    if upto in ("feat",):
        ctes.append(FEAT)
    if extra:
        ctes.extend(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + final_sql


CLEAR = ("cs AS (SELECT cause, round(q[2], 6) AS median, round(q[1], 6) AS p25, round(q[3], 6) AS p75, n FROM ("
         "SELECT CASE WHEN GROUPING(event_cause) = 1 THEN '_overall' ELSE event_cause END AS cause, "
         "quantile_cont(duration_minutes, [0.25, 0.5, 0.75]) AS q, CAST(count(*) AS BIGINT) AS n, "
         "GROUPING(event_cause) AS g FROM feat WHERE duration_minutes > 0 AND duration_minutes <= 1440 "
         "GROUP BY GROUPING SETS ((event_cause), ())) t WHERE g = 1 OR n >= 5)")

SCORE = ("score AS (SELECT CAST(event_id AS BIGINT) AS id, "
         "CAST(((event_id*37 + CAST(json_extract_string(props, '$.k') AS INT)*11) % 1000) AS DOUBLE) / 1000.0 "
         "AS closure_prob FROM events)")


def pct0_sql(p: str) -> str:
    return f"CAST(CAST(round_even({p} * 100, 0) AS BIGINT) AS VARCHAR)"


def recommend_sql(src: str, prob: str | None, threshold: float = vocab.CLOSURE_PROB_BARRICADE_THRESHOLD,
                  with_clearance: bool = True) -> str:
    """SELECT adding the recommendation columns to every row of ``src``."""
    first = {z: s[0] for z, s in vocab.ZONE_STATIONS.items()}
    fb_station = vocab.ZONE_STATIONS[vocab.FALLBACK_ZONE][0]
    p = prob or "CAST(NULL AS DOUBLE)"
    r0 = (f"SELECT *, CASE WHEN severity_class IN {in_list(list(vocab.BASE_PERSONNEL))} THEN severity_class "
          f"ELSE 'Low' END AS __sev, CASE WHEN coalesce(event_cause, '') = '' THEN 'other' ELSE event_cause END "
          f"AS __cause, coalesce(road_closure_binary = 1, false) AS __clos, "
          f"coalesce(hour_of_day IN {in_list(vocab.PEAK_HOURS)}, false) AS __peak, "
          f"coalesce({p} >= {threshold}, false) AS __likely, {p} AS __prob FROM {src}")
    hr = in_list(vocab.HIGH_RISK_CAUSES)
    cols = (f"CAST({case_map('__sev', vocab.BASE_PERSONNEL)} "
            f"+ CASE WHEN __peak AND __sev IN ('Medium', 'High') THEN {vocab.PEAK_HOUR_BONUS} ELSE 0 END "
            f"+ CASE WHEN __clos OR __likely THEN {vocab.ROAD_CLOSURE_BONUS} ELSE 0 END "
            f"+ CASE WHEN __cause IN {hr} THEN {vocab.HIGH_RISK_CAUSE_BONUS} ELSE 0 END AS INTEGER) AS personnel_count, "
            f"(__clos OR __likely OR __cause IN {in_list(vocab.BARRICADE_CAUSES)}) AS barricade_required, "
            f"(__sev = '{vocab.DIVERSION_MIN_SEVERITY}' OR __likely) AS diversion_recommended, "
            f"coalesce({case_map('zone', first)}, {q(fb_station)}) AS dispatch_from, "
            f"{case_map('__sev', vocab.PRIORITY_FLAGS)} AS priority_flag, "
            f"concat_ws('; ', __sev || ' severity event', CASE WHEN __peak THEN 'high-incident window' END, "
            f"CASE WHEN __clos THEN 'operator flagged road closure' "
            f"WHEN __likely THEN 'model: closure likely (' || {pct0_sql('__prob')} || '%)' END, "
            f"CASE WHEN __cause IN {hr} THEN 'high-risk cause (' || __cause || ')' END) AS rationale, "
            f"__prob AS closure_probability")
    if not with_clearance:
        return f"SELECT * EXCLUDE (__sev, __cause, __clos, __peak, __likely, __prob), {cols} FROM ({r0}) r0"
    fb = vocab.CLEARANCE_FALLBACK
    return (f"SELECT r0.* EXCLUDE (__sev, __cause, __clos, __peak, __likely, __prob), {cols}, "
            f"CAST(round_even(CASE WHEN c.cause IS NOT NULL THEN c.median ELSE coalesce(ov.median, {fb['median']}) END, 0) AS INTEGER) AS estimated_clearance_minutes, "
            f"CAST(round_even(CASE WHEN c.cause IS NOT NULL THEN c.p25 ELSE coalesce(ov.p25, {fb['p25']}) END, 0) AS INTEGER) AS clearance_low, "
            f"CAST(round_even(CASE WHEN c.cause IS NOT NULL THEN c.p75 ELSE coalesce(ov.p75, {fb['p75']}) END, 0) AS INTEGER) AS clearance_high, "
            f"'typical close-time for ' || __cause || ' (median of ' || coalesce(CAST(CASE WHEN c.cause IS NOT NULL "
            f"THEN c.n ELSE ov.n END AS VARCHAR), '?') || ' past events)' AS clearance_note "
            f"FROM ({r0}) r0 LEFT JOIN (SELECT * FROM cs WHERE cause <> '_overall') c ON c.cause = r0.__cause "
            f"LEFT JOIN (SELECT * FROM cs WHERE cause = '_overall') ov ON true")
