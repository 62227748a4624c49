"""Geodesy on Columns: degrees in, metres or degrees out. Everything stays in generated JVM code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0
KM_TO_NM = 0.539956803


def _rad(c: Column) -> Column:
    return F.radians(c)


def let(step: Callable[[Column], Column], **values: Column) -> Column:
    """``step`` of a struct of ``values``, each computed once: a lambda's variable is not replaced by what it stands for.

    For long chains of formulas, whose expressions would otherwise repeat their inputs many times over.
    """
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), step)[0]


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_M) -> Column:
    a = F.pow(F.sin((_rad(lat2) - _rad(lat1)) / 2), F.lit(2)) + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * F.pow(F.sin((_rad(lon2) - _rad(lon1)) / 2), F.lit(2))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = _rad(lon2) - _rad(lon1)
    y = F.sin(d) * F.cos(_rad(lat2))
    x = F.cos(_rad(lat1)) * F.sin(_rad(lat2)) - F.sin(_rad(lat1)) * F.cos(_rad(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def wrap_lon(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, tau: Column, eps: float = 1e-12) -> tuple[Column, Column]:
    """Latitude and longitude at the share ``tau`` (clipped to 0..1) of the way; coinciding ends give the start."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), tau))
    xyz = lambda la, lo: (F.cos(_rad(la)) * F.cos(_rad(lo)), F.cos(_rad(la)) * F.sin(_rad(lo)), F.sin(_rad(la)))
    a, b = xyz(lat1, lon1), xyz(lat2, lon2)
    dot = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), a[0] * b[0] + a[1] * b[1] + a[2] * b[2]))
    w = F.acos(dot)
    ka, kb = F.sin((1 - t) * w) / F.sin(w), F.sin(t * w) / F.sin(w)
    x, y, z = (ka * p + kb * q for p, q in zip(a, b))
    lat, lon = F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))
    return F.when(w <= eps, lat1).otherwise(lat), F.when(w <= eps, lon1).otherwise(lon)


def great_circle_point(lat1: Column, lon1: Column, lat2: Column, lon2: Column, tau: Column, eps: float = 1e-12) -> Column:
    """``great_circle`` as one struct (lat, lon), step by step: for use within longer chains."""

    def angle(p):
        xyz = lambda la, lo: (F.cos(_rad(la)) * F.cos(_rad(lo)), F.cos(_rad(la)) * F.sin(_rad(lo)), F.sin(_rad(la)))
        a, b = xyz(p["lat1"], p["lon1"]), xyz(p["lat2"], p["lon2"])
        w = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), a[0] * b[0] + a[1] * b[1] + a[2] * b[2])))
        return F.struct(p.alias("p"), F.array(*a).alias("a"), F.array(*b).alias("b"), w.alias("w"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p["tau"])).alias("t"))

    def mixed(s):
        ka, kb = F.sin((1 - s["t"]) * s["w"]) / F.sin(s["w"]), F.sin(s["t"] * s["w"]) / F.sin(s["w"])
        return F.struct(s["p"].alias("p"), s["w"].alias("w"), F.zip_with(s["a"], s["b"], lambda x, y: ka * x + kb * y).alias("v"))

    def place(s):
        x, y, z = (s["v"][i] for i in range(3))
        still = s["w"] <= eps
        return F.struct(F.when(still, s["p"]["lat1"]).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))).alias("lat"), F.when(still, s["p"]["lon1"]).otherwise(F.degrees(F.atan2(y, x))).alias("lon"))

    first = let(angle, lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2, tau=tau)
    return let(lambda s: place(s["s"]), s=let(lambda s: mixed(s["s"]), s=first))


def destination(lat: Column, lon: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    d, b = metres / RADIUS_M, _rad(bearing)
    la = F.asin(F.sin(_rad(lat)) * F.cos(d) + F.cos(_rad(lat)) * F.sin(d) * F.cos(b))
    lo = _rad(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(_rad(lat)), F.cos(d) - F.sin(_rad(lat)) * F.sin(la))
    return F.degrees(la), wrap_lon(F.degrees(lo))


def along_cross_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Signed distances along and across the great circle from the first to the second point."""

    def polar(p: Column) -> Column:
        d = haversine_m(p["lat1"], p["lon1"], p["lat"], p["lon"]) / RADIUS_M
        turn = _rad(bearing_deg(p["lat1"], p["lon1"], p["lat"], p["lon"])) - _rad(bearing_deg(p["lat1"], p["lon1"], p["lat2"], p["lon2"]))
        return F.struct(d.alias("d"), turn.alias("turn"))

    at = let(polar, lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2, lat=lat, lon=lon)
    d, turn = at["d"], at["turn"]
    return F.atan2(F.sin(d) * F.cos(turn), F.cos(d)) * RADIUS_M, F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(d) * F.sin(turn)))) * RADIUS_M


def speed_kt(metres: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, metres / 1000 * KM_TO_NM / (seconds / 3600))
