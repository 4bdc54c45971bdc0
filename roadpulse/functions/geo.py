"""Geodesy as Column expressions (JVM-side, codegen'd; no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                 radius_km: float = vocab.EARTH_RADIUS_KM) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi = F.radians(lat2 - lat1)
    dl = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * radius_km * F.asin(F.sqrt(a))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius_km: float = vocab.EARTH_RADIUS_KM) -> str:
    """The same formula as SQL text (DuckDB oracle)."""
    return (f"(2 * {radius_km} * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))")


def project_m(lat: Column, lon: Column, lat0: Column) -> tuple[Column, Column]:
    """Equirectangular metres about ``lat0`` (exact enough for nearest-road)."""
    r = vocab.EARTH_RADIUS_M
    return F.radians(lat) * r, F.radians(lon) * r * F.cos(F.radians(lat0))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing 0-360 from point 1 to point 2."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dl = F.radians(lon2 - lon1)
    x = F.sin(dl) * F.cos(p2)
    y = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360.0, F.lit(360.0))


def angle_gap(a: Column, b: Column) -> Column:
    """Smallest separation of two bearings, 0-180."""
    d = F.abs(a - b) % 360.0
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


def circle_ring(lat: Column, lon: Column, radius_km: float = vocab.CLUSTER_BUFFER_KM, n: int = 28) -> Column:
    """``n`` vertices evenly spaced over [0, 2pi] (first = last angle) plus the closing vertex."""
    dlat = F.lit(radius_km / vocab.KM_PER_DEG_LAT)
    dlon = F.lit(radius_km) / (vocab.KM_PER_DEG_LON_EQ * F.cos(F.radians(lat)) + 1e-9)
    step = 2 * math.pi / (n - 1)
    ang = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                      lambda i: F.when(i == n - 1, F.lit(2 * math.pi)).otherwise(i.cast("double") * step))
    ring = F.transform(ang, lambda t: F.array(lon + dlon * F.cos(t), lat + dlat * F.sin(t)))
    return F.concat(ring, F.array(ring[0]))
