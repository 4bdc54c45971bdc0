"""Deployment rules, impact score, alerts: pure Column expressions.

Rules are literals folded into the plan; the clearance table is one row per
cause of a closed vocabulary (<= 15 rows), so its broadcast is size-bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab

_WSUM = sum(vocab.IMPACT_WEIGHTS.values())


def station_for(zone: Column) -> Column:
    """First (nearest) station of the zone; unknown zones use the fallback list."""
    first = {z: s[0] for z, s in vocab.ZONE_STATIONS.items()}
    return F.coalesce(vocab.map_lit(first)[zone], F.lit(vocab.ZONE_STATIONS[vocab.FALLBACK_ZONE][0]))


def stations_for(zone: Column) -> Column:
    m = F.create_map(*[x for z, s in vocab.ZONE_STATIONS.items()
                       for x in (F.lit(z), F.array(*[F.lit(v) for v in s]))])
    fb = F.array(*[F.lit(v) for v in vocab.ZONE_STATIONS[vocab.FALLBACK_ZONE]])
    return F.coalesce(m[zone], fb)


def station_lookup(df: DataFrame, explode_all: bool = False) -> DataFrame:
    if explode_all:
        return df.select("*", F.posexplode(stations_for(F.col("zone"))).alias("station_rank", "station"))
    return df.withColumn("dispatch_from", station_for(F.col("zone")))


def clearance_lookup(df: DataFrame, stats: DataFrame, cause_col: str = "event_cause") -> DataFrame:
    """Attach median/p25/p75/n of the row's cause, else of ``_overall``, else fixed fallback.

    ``stats`` = ``clearance_stats`` output (<= #causes + 1 rows, broadcast).
    """
    per = stats.filter(F.col("cause") != "_overall").select(
        F.col("cause").alias("__clc"), F.col("median").alias("__m"), F.col("p25").alias("__lo"),
        F.col("p75").alias("__hi"), F.col("n").alias("__n"))
    ov = stats.filter(F.col("cause") == "_overall").select(
        F.col("median").alias("__om"), F.col("p25").alias("__olo"), F.col("p75").alias("__ohi"),
        F.col("n").alias("__on"))
    j = (df.join(F.broadcast(per), F.col(cause_col) == F.col("__clc"), "left")
           .join(F.broadcast(ov), how="left"))
    hit = F.col("__clc").isNotNull()
    fb = vocab.CLEARANCE_FALLBACK
    return (j.withColumn("clear_median", F.when(hit, F.col("__m")).otherwise(F.coalesce("__om", F.lit(fb["median"]))))
             .withColumn("clear_p25", F.when(hit, F.col("__lo")).otherwise(F.coalesce("__olo", F.lit(fb["p25"]))))
             .withColumn("clear_p75", F.when(hit, F.col("__hi")).otherwise(F.coalesce("__ohi", F.lit(fb["p75"]))))
             .withColumn("clear_n", F.when(hit, F.col("__n")).otherwise(F.col("__on")))
             .drop("__clc", "__m", "__lo", "__hi", "__n", "__om", "__olo", "__ohi", "__on"))


def round_binary(c: Column, n: int) -> Column:
    """Round the double value itself (not its decimal text) to ``n`` places.

    ``floor(x * 10^n + 0.5) / 10^n`` is the same double arithmetic in every
    engine, so results agree bit for bit.
    """
    k = float(10 ** n)
    return F.floor(c * k + 0.5) / k


def pct0(p: Column) -> Column:
    """``f"{p*100:.0f}"`` (half-even) as text."""
    return F.bround(p * 100, 0).cast("bigint").cast("string")


def recommend(df: DataFrame, stats: DataFrame | None = None, prob_col: str | None = None,
              threshold: float = vocab.CLOSURE_PROB_BARRICADE_THRESHOLD,
              closure_col: str = "road_closure_binary") -> DataFrame:
    """Deployment recommendation for every row (batch form of the per-event rules).

    Needs ``severity_class, event_cause, hour_of_day, zone`` and the closure
    flag; ``prob_col`` (calibrated P(closure)) is optional.
    """
    base = vocab.BASE_PERSONNEL
    sev = F.when(F.col("severity_class").isin(list(base)), F.col("severity_class")).otherwise(F.lit("Low"))
    cause = F.when(F.coalesce(F.col("event_cause"), F.lit("")) == "", F.lit("other")).otherwise(F.col("event_cause"))
    closure = F.coalesce(F.col(closure_col).cast("boolean"), F.lit(False))
    peak = F.coalesce(F.col("hour_of_day").isin(vocab.PEAK_HOURS), F.lit(False))
    prob = F.col(prob_col).cast("double") if prob_col else F.lit(None).cast("double")
    likely = F.coalesce(prob >= threshold, F.lit(False))
    high_risk = cause.isin(vocab.HIGH_RISK_CAUSES)
    d = (df.withColumn("__sev", sev).withColumn("__cause", cause).withColumn("__clos", closure)
           .withColumn("__peak", peak).withColumn("__likely", likely).withColumn("__prob", prob))
    sev, cause, closure, peak, likely, prob = (F.col(c) for c in
                                              ("__sev", "__cause", "__clos", "__peak", "__likely", "__prob"))
    high_risk = cause.isin(vocab.HIGH_RISK_CAUSES)
    personnel = (vocab.map_lit(base)[sev]
                 + F.when(peak & sev.isin("Medium", "High"), vocab.PEAK_HOUR_BONUS).otherwise(0)
                 + F.when(closure | likely, vocab.ROAD_CLOSURE_BONUS).otherwise(0)
                 + F.when(high_risk, vocab.HIGH_RISK_CAUSE_BONUS).otherwise(0))
    rationale = F.concat_ws("; ",
                            F.concat(sev, F.lit(" severity event")),
                            F.when(peak, F.lit("high-incident window")),
                            F.when(closure, F.lit("operator flagged road closure"))
                             .when(likely, F.concat(F.lit("model: closure likely ("), pct0(prob), F.lit("%)"))),
                            F.when(high_risk, F.concat(F.lit("high-risk cause ("), cause, F.lit(")"))))
    d = (d.withColumn("personnel_count", personnel.cast("int"))
          .withColumn("barricade_required", closure | likely | cause.isin(vocab.BARRICADE_CAUSES))
          .withColumn("diversion_recommended", (sev == vocab.DIVERSION_MIN_SEVERITY) | likely)
          .withColumn("dispatch_from", station_for(F.col("zone")))
          .withColumn("priority_flag", vocab.map_lit(vocab.PRIORITY_FLAGS)[sev])
          .withColumn("rationale", rationale)
          .withColumn("closure_probability", prob))
    if stats is not None:
        d = clearance_lookup(d.withColumn("__ckey", cause), stats, "__ckey").drop("__ckey")
        d = (d.withColumn("estimated_clearance_minutes", F.bround("clear_median", 0).cast("int"))
              .withColumn("clearance_low", F.bround("clear_p25", 0).cast("int"))
              .withColumn("clearance_high", F.bround("clear_p75", 0).cast("int"))
              .withColumn("clearance_note", F.concat(F.lit("typical close-time for "), cause,
                                                     F.lit(" (median of "),
                                                     F.coalesce(F.col("clear_n").cast("string"), F.lit("?")),
                                                     F.lit(" past events)")))
              .drop("clear_median", "clear_p25", "clear_p75", "clear_n"))
    return d.drop("__sev", "__cause", "__clos", "__peak", "__likely", "__prob")


def recommend_breakdown(df: DataFrame) -> DataFrame:
    """Per-factor personnel points in long form: (id, factor, points) + a total row."""
    base = vocab.BASE_PERSONNEL
    sev = F.when(F.col("severity_class").isin(list(base)), F.col("severity_class")).otherwise(F.lit("Low"))
    peak = F.coalesce(F.col("hour_of_day").isin(vocab.PEAK_HOURS), F.lit(False))
    closure = F.coalesce(F.col("road_closure_binary").cast("boolean"), F.lit(False))
    d = df.select("id",
                  vocab.map_lit(base)[sev].alias("base"),
                  F.when(peak & sev.isin("Medium", "High"), vocab.PEAK_HOUR_BONUS).otherwise(0).alias("peak"),
                  F.when(closure, vocab.ROAD_CLOSURE_BONUS).otherwise(0).alias("closure"),
                  F.when(F.col("event_cause").isin(vocab.HIGH_RISK_CAUSES), vocab.HIGH_RISK_CAUSE_BONUS)
                   .otherwise(0).alias("high_risk"))
    d = d.withColumn("total", F.col("base") + F.col("peak") + F.col("closure") + F.col("high_risk"))
    return d.unpivot("id", ["base", "peak", "closure", "high_risk", "total"], "factor", "points")


def road_factor(rank: Column, lanes: Column) -> tuple[Column, Column]:
    """(factor, measured): 0.6*rank/6 + 0.4*min(lanes,6)/6; neutral 0.5 when both unknown."""
    measured = rank.isNotNull() | lanes.isNotNull()
    r = F.least(F.greatest(F.coalesce(rank.cast("int"), F.lit(0)), F.lit(0)), F.lit(6)) / 6.0
    ln = F.least(F.greatest(F.coalesce(lanes.cast("double"), F.lit(0.0)), F.lit(0.0)),
                 F.lit(float(vocab.LANES_SOFT_CAP))) / float(vocab.LANES_SOFT_CAP)
    return F.when(measured, 0.6 * r + 0.4 * ln).otherwise(F.lit(vocab.ROAD_NEUTRAL)), measured


def impact_band(score: Column) -> Column:
    return (F.when(score < 25, "Low").when(score < 50, "Moderate").when(score < 75, "High")
             .otherwise("Severe"))


def impact_score(df: DataFrame, closure_col: str = "road_closure_binary", corridor_col: str = "corridor_7d_score",
                 peak_col: str = "is_peak_hour", prob_col: str | None = None,
                 cluster_rate_col: str | None = "cluster_closure_rate",
                 rank_col: str | None = "road_class_rank", lanes_col: str | None = "lane_count") -> DataFrame:
    """0-100 disruption score + band + factor breakdown for every row."""
    def opt(c):
        return F.col(c) if c and c in df.columns else F.lit(None)
    w = vocab.IMPACT_WEIGHTS
    closure = F.coalesce(F.col(closure_col).cast("boolean"), F.lit(False))
    cf = F.when(closure, F.lit(1.0)).otherwise(
        F.coalesce(opt(prob_col).cast("double"), opt(cluster_rate_col).cast("double"), F.lit(0.0)))
    cf = F.least(F.greatest(cf, F.lit(0.0)), F.lit(1.0))
    corr = F.least(F.greatest(F.coalesce(F.col(corridor_col).cast("double"), F.lit(0.0)), F.lit(0.0))
                   / float(vocab.CORRIDOR_SOFT_CAP), F.lit(1.0))
    rf, measured = road_factor(opt(rank_col), opt(lanes_col))
    wf = F.when(F.coalesce(F.col(peak_col).cast("boolean"), F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.4))
    d = (df.withColumn("__cf", cf).withColumn("__corr", corr).withColumn("__rf", rf).withColumn("__wf", wf))
    raw = (w["closure"] * F.col("__cf") + w["corridor"] * F.col("__corr") + w["road"] * F.col("__rf")
           + w["window"] * F.col("__wf"))
    d = d.withColumn("impact_score", F.bround(100 * raw / _WSUM, 0).cast("int"))
    return (d.withColumn("impact_label", impact_band(F.col("impact_score")))
             .withColumn("f_closure", round_binary(F.col("__cf"), 2))
             .withColumn("f_corridor", round_binary(F.col("__corr"), 2))
             .withColumn("f_road", round_binary(F.col("__rf"), 2)).withColumn("f_window", F.col("__wf"))
             .withColumn("road_measured", measured)
             .drop("__cf", "__corr", "__rf", "__wf"))


def alert_message(df: DataFrame, severity: str = "severity_class", cause: str = "event_cause",
                  prob_col: str | None = None, personnel: str | None = "personnel_count",
                  station: str | None = "dispatch_from", barricade: str | None = "barricade_required",
                  diversion: str | None = None, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Formatted alert text per row; absent parts are omitted (concat_ws skips NULLs)."""
    icon = vocab.map_lit({"High": "🔺", "Medium": "🟠", "Low": "🟩"})
    sev = F.coalesce(F.col(severity), F.lit("—"))
    title = F.initcap(F.replace(F.coalesce(F.col(cause).cast("string"), F.lit("incident")), F.lit("_"), F.lit(" ")))

    def opt(c):
        return F.col(c) if c and c in df.columns else F.lit(None)
    lines = [
        F.concat(F.lit("🚨 <b>Incident alert</b> — "), F.coalesce(icon[sev], F.lit("⚠️")), F.lit(" <b>"), sev,
                 F.lit("</b>")),
        F.concat(F.lit("<b>Cause:</b> "), title),
        F.concat(F.lit("<b>Zone:</b> "), F.coalesce(F.col("zone"), F.lit("—"))),
        F.when(opt(prob_col).isNotNull(),
               F.concat(F.lit("<b>Road-closure likelihood:</b> "), pct0(opt(prob_col).cast("double")), F.lit("%"))),
        F.when(opt(personnel).isNotNull(),
               F.concat(F.lit("<b>Deploy:</b> "), opt(personnel).cast("string"), F.lit(" officers"),
                        F.when(F.coalesce(opt(station).cast("string"), F.lit("")) != "",
                               F.concat(F.lit(" from "), opt(station).cast("string"))).otherwise(F.lit("")))),
        F.when(F.coalesce(opt(barricade).cast("boolean"), F.lit(False)), F.lit("<b>⛔ Barricade recommended</b>")),
        F.when(F.coalesce(opt(diversion).cast("string"), F.lit("")) != "",
               F.concat(F.lit("<b>Diversion:</b> "), opt(diversion).cast("string"))),
        F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(),
               F.concat(F.lit('📍 <a href="https://maps.google.com/?q='), F.col(lat).cast("string"), F.lit(","),
                        F.col(lon).cast("string"), F.lit('">map</a>'))),
    ]
    return df.withColumn("alert_text", F.concat_ws("\n", *lines))


def closure_multiple(df: DataFrame, prob_col: str, base_rate: Column) -> DataFrame:
    return df.withColumn("closure_multiple", F.col(prob_col) / base_rate)


def liveops_kpis(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count(F.lit(1)).alias("active_incidents"),
        F.count_if(F.col("severity_class") == "High").cast("bigint").alias("high_severity"),
        F.count_if(F.col("barricade_required")).cast("bigint").alias("barricades"),
        F.sum("personnel_count").cast("bigint").alias("officers_needed"))


def liveops_alerts(enriched: DataFrame, prob_col: str = "closure_probability", k: int = 40) -> DataFrame:
    """Barricade or impact >= 50, by impact then closure probability (top-k); else the top by impact."""
    flagged = enriched.filter(F.col("barricade_required") | (F.col("impact_score") >= 50))
    order = [F.desc("impact_score"), F.desc_nulls_last(prob_col), F.asc("id")]
    return flagged.orderBy(*order).limit(k)
