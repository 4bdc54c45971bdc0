"""Registered queries: decisioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import analytics as A
from ..operators import decide as D
from ..sources import fixtures
from . import base
from .catalog import register
from .oracle import CLEAR, SCORE, case_map, in_list, pct0_sql, q, recommend_sql, with_base

REC_COLS = ["personnel_count", "barricade_required", "diversion_recommended", "dispatch_from", "priority_flag",
            "rationale", "estimated_clearance_minutes", "clearance_low", "clearance_high", "clearance_note"]


def scored(spark, sf):
    """Features with the stand-in closure probability attached (id join)."""
    return base.features(spark, sf).join(fixtures.closure_score(spark, sf), "id", "left")


def recommended(spark, sf, prob=True):
    feats = scored(spark, sf) if prob else base.features(spark, sf)
    stats = A.clearance_stats(base.features(spark, sf))
    return D.recommend(feats, stats, prob_col="closure_prob" if prob else None)


_REC_SQL = recommend_sql("(SELECT f.*, s.closure_prob FROM feat f LEFT JOIN score s USING (id))", "closure_prob")


@register("recommend", with_base(f"SELECT id, {', '.join(REC_COLS)} FROM ({_REC_SQL}) r", extra=[CLEAR, SCORE]))
def recommend(spark, sf):
    return recommended(spark, sf).select("id", *REC_COLS)


@register("clearance_lookup", with_base(
    "SELECT f.event_cause, CASE WHEN c.cause IS NOT NULL THEN c.median ELSE coalesce(ov.median, 57.0) END "
    "AS clear_median, CASE WHEN c.cause IS NOT NULL THEN c.n ELSE ov.n END AS clear_n, CAST(count(*) AS BIGINT) AS events "
    "FROM feat f LEFT JOIN (SELECT * FROM cs WHERE cause <> '_overall') c ON c.cause = f.event_cause "
    "LEFT JOIN (SELECT * FROM cs WHERE cause = '_overall') ov ON true GROUP BY 1, 2, 3", extra=[CLEAR]))
def clearance_lookup(spark, sf):
    f = base.features(spark, sf)
    j = D.clearance_lookup(f, A.clearance_stats(f))
    return j.groupBy("event_cause", "clear_median", "clear_n").agg(F.count(F.lit(1)).alias("events"))


def _arr(vals):
    return "[" + ", ".join(q(v) for v in vals) + "]"


_ST_ARR = ("CASE zone " + " ".join(f"WHEN {q(z)} THEN {_arr(v)}" for z, v in vocab.ZONE_STATIONS.items())
           + f" ELSE {_arr(vocab.ZONE_STATIONS[vocab.FALLBACK_ZONE])} END")


@register("station_lookup", with_base(
    "SELECT zone, CAST(i - 1 AS INTEGER) AS station_rank, st[i] AS station, CAST(count(*) AS BIGINT) AS events "
    f"FROM (SELECT zone, {_ST_ARR} AS st FROM feat) z, LATERAL (SELECT generate_subscripts(st, 1) AS i) g "
    "GROUP BY ALL"))
def station_lookup(spark, sf):
    """Every station that can serve each zone (posexplode of a map literal), with demand counts."""
    d = D.station_lookup(base.features(spark, sf).select("zone"), explode_all=True)
    return d.groupBy("zone", "station_rank", "station").agg(F.count(F.lit(1)).alias("events"))


_SEV_SAFE = f"CASE WHEN severity_class IN {in_list(list(vocab.BASE_PERSONNEL))} THEN severity_class ELSE 'Low' END"


@register("recommend_breakdown", with_base(
    "SELECT id, factor, CAST(points AS INTEGER) AS points FROM ("
    "SELECT *, base + peak + closure + high_risk AS total FROM ("
    f"SELECT id, {case_map(_SEV_SAFE, vocab.BASE_PERSONNEL)} AS base, "
    f"CASE WHEN hour_of_day IN {in_list(vocab.PEAK_HOURS)} AND severity_class IN ('Medium', 'High') "
    "THEN 1 ELSE 0 END AS peak, CASE WHEN road_closure_binary = 1 THEN 1 ELSE 0 END AS closure, "
    f"CASE WHEN event_cause IN {in_list(vocab.HIGH_RISK_CAUSES)} THEN 1 ELSE 0 END AS high_risk FROM feat) b0) b "
    "UNPIVOT (points FOR factor IN (base, peak, closure, high_risk, total))"))
def recommend_breakdown(spark, sf):
    return D.recommend_breakdown(base.features(spark, sf)).withColumn("points", F.col("points").cast("int"))


def impact_sql(src: str, prob: str = "closure_prob") -> str:
    w = vocab.IMPACT_WEIGHTS
    wsum = sum(w.values())
    cf = (f"least(greatest(CASE WHEN road_closure_binary = 1 THEN 1.0 ELSE coalesce(CAST({prob} AS DOUBLE), "
          f"CAST(NULL AS DOUBLE), 0.0) END, 0.0), 1.0)")
    corr = f"least(greatest(coalesce(CAST(corridor_7d_score AS DOUBLE), 0.0), 0.0) / {float(vocab.CORRIDOR_SOFT_CAP)}, 1.0)"
    rf = str(vocab.ROAD_NEUTRAL)
    wf = "CAST(CASE WHEN coalesce(is_peak_hour = 1, false) THEN 1.0 ELSE 0.4 END AS DOUBLE)"
    def d(x):
        return f"CAST({x!r} AS DOUBLE)"
    return (f"SELECT *, CAST(round_even(100 * ({d(w['closure'])} * __cf + {d(w['corridor'])} * __corr "
            f"+ {d(w['road'])} * __rf + {d(w['window'])} * __wf) / {d(wsum)}, 0) AS INTEGER) AS impact_score FROM ("
            f"SELECT *, {cf} AS __cf, {corr} AS __corr, CAST({rf} AS DOUBLE) AS __rf, {wf} AS __wf FROM {src}) i0")


def band_sql(s: str) -> str:
    return f"CASE WHEN {s} < 25 THEN 'Low' WHEN {s} < 50 THEN 'Moderate' WHEN {s} < 75 THEN 'High' ELSE 'Severe' END"


_IMPACT_SRC = "(SELECT f.*, s.closure_prob FROM feat f LEFT JOIN score s USING (id))"


@register("impact_score", with_base(
    f"SELECT id, impact_score, {band_sql('impact_score')} AS impact_label, floor(__cf * 100.0 + 0.5) / 100.0 AS f_closure, "
    "floor(__corr * 100.0 + 0.5) / 100.0 AS f_corridor, floor(__rf * 100.0 + 0.5) / 100.0 AS f_road, __wf AS f_window, false AS road_measured "
    f"FROM ({impact_sql(_IMPACT_SRC)}) t", extra=[SCORE]))
def impact_score(spark, sf):
    d = D.impact_score(scored(spark, sf), prob_col="closure_prob", cluster_rate_col=None, rank_col=None, lanes_col=None)
    return d.select("id", "impact_score", "impact_label", "f_closure", "f_corridor", "f_road", "f_window",
                    "road_measured")


def _alert_sql(src: str) -> str:
    icon = case_map("severity_class", {"High": "🔺", "Medium": "🟠", "Low": "🟩"})
    title = ("list_reduce(list_transform(string_split(replace(event_cause, '_', ' '), ' '), "
             "lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b)")
    return (f"SELECT id, concat_ws(chr(10), '🚨 <b>Incident alert</b> — ' || coalesce({icon}, '⚠️') || ' <b>' || "
            f"severity_class || '</b>', '<b>Cause:</b> ' || {title}, '<b>Zone:</b> ' || zone, "
            f"CASE WHEN closure_probability IS NOT NULL THEN '<b>Road-closure likelihood:</b> ' || "
            f"{pct0_sql('closure_probability')} || '%' END, "
            f"'<b>Deploy:</b> ' || CAST(personnel_count AS VARCHAR) || ' officers from ' || dispatch_from, "
            f"CASE WHEN barricade_required THEN '<b>⛔ Barricade recommended</b>' END, "
            f"CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN "
            f"'📍 <a href=\"https://maps.google.com/?q=' || CAST(latitude AS VARCHAR) || ',' || "
            f"CAST(longitude AS VARCHAR) || '\">map</a>' END) AS alert_text FROM {src} WHERE barricade_required")


@register("alert_message", with_base(_alert_sql(f"({_REC_SQL})"), extra=[CLEAR, SCORE]))
def alert_message(spark, sf):
    r = recommended(spark, sf).filter(F.col("barricade_required"))
    return D.alert_message(r, prob_col="closure_probability").select("id", "alert_text")


def _liveops(spark, sf):
    act = scored(spark, sf).filter(F.col("status") == "active")
    stats = A.clearance_stats(base.features(spark, sf))
    r = D.recommend(act, stats, prob_col="closure_prob")
    return D.impact_score(r, prob_col="closure_prob", cluster_rate_col=None, rank_col=None, lanes_col=None)


_LIVE_SQL = impact_sql(
    f"({recommend_sql('(SELECT f.*, s.closure_prob FROM feat f LEFT JOIN score s USING (id) WHERE f.status = ' + q('active') + ')', 'closure_prob')})")


@register("liveops_enrich", with_base(
    f"SELECT id, severity_class, event_cause, zone, personnel_count, barricade_required, dispatch_from, "
    f"closure_probability, impact_score, {band_sql('impact_score')} AS impact_label FROM ({_LIVE_SQL}) t",
    extra=[CLEAR, SCORE]))
def liveops_enrich(spark, sf):
    return _liveops(spark, sf).select("id", "severity_class", "event_cause", "zone", "personnel_count",
                                      "barricade_required", "dispatch_from", "closure_probability",
                                      "impact_score", "impact_label")


@register("liveops_kpis", with_base(
    "SELECT CAST(count(*) AS BIGINT) AS active_incidents, "
    "CAST(count(*) FILTER (WHERE severity_class = 'High') AS BIGINT) AS high_severity, "
    "CAST(count(*) FILTER (WHERE barricade_required) AS BIGINT) AS barricades, "
    f"CAST(sum(personnel_count) AS BIGINT) AS officers_needed FROM ({_LIVE_SQL}) t", extra=[CLEAR, SCORE]))
def liveops_kpis(spark, sf):
    return D.liveops_kpis(_liveops(spark, sf))


@register("liveops_alerts", with_base(
    f"SELECT id, impact_score, closure_probability, barricade_required FROM ({_LIVE_SQL}) t "
    "WHERE barricade_required OR impact_score >= 50 "
    "ORDER BY impact_score DESC, closure_probability DESC NULLS LAST, id LIMIT 40", extra=[CLEAR, SCORE]))
def liveops_alerts(spark, sf):
    return D.liveops_alerts(_liveops(spark, sf)).select("id", "impact_score", "closure_probability",
                                                       "barricade_required")


@register("closure_multiple", with_base(
    "SELECT f.id, round(s.closure_prob / (SELECT avg(road_closure_binary) FROM feat), 6) AS closure_multiple "
    "FROM feat f LEFT JOIN score s USING (id)", extra=[SCORE]))
def closure_multiple(spark, sf):
    d = scored(spark, sf)
    rate = base.features(spark, sf).agg(F.avg("road_closure_binary").alias("__base"))
    return (d.crossJoin(F.broadcast(rate))
             .select("id", A.r6(F.col("closure_prob") / F.col("__base")).alias("closure_multiple")))


@register("flagship_deployment", with_base(
    "SELECT severity_class, CAST(count(*) AS BIGINT) AS events, CAST(sum(personnel_count) AS BIGINT) AS officers, "
    "CAST(count(*) FILTER (WHERE barricade_required) AS BIGINT) AS barricades, "
    "CAST(count(*) FILTER (WHERE diversion_recommended) AS BIGINT) AS diversions, "
    "round(avg(estimated_clearance_minutes), 6) AS mean_clearance "
    f"FROM ({_REC_SQL}) r GROUP BY 1", extra=[CLEAR, SCORE]))
def flagship_deployment(spark, sf):
    """Flagship: clean -> features -> rules -> per-severity deployment totals."""
    r = recommended(spark, sf)
    return r.groupBy("severity_class").agg(
        F.count(F.lit(1)).alias("events"), F.sum("personnel_count").cast("bigint").alias("officers"),
        F.count_if("barricade_required").cast("bigint").alias("barricades"),
        F.count_if("diversion_recommended").cast("bigint").alias("diversions"),
        A.r6(F.avg("estimated_clearance_minutes")).alias("mean_clearance"))
