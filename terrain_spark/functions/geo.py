"""Geography as column expressions: distances, windows, seasons, grids, projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def bbox_diagonal_km(west: Column, south: Column, east: Column, north: Column) -> Column:
    return haversine_km(west, south, east, north)


def season(lat: Column, year: int = 2023) -> Column:
    """The months that show vegetation at a latitude, as ``start/end``."""
    end = f"last_day(make_date({year}, 2, 1))"
    return F.when(lat > 23.5, f"{year}-05-01/{year}-09-30").when(lat < -23.5, F.concat(F.lit(f"{year - 1}-12-01/"), F.expr(end).cast("string"))).otherwise(f"{year}-01-01/{year}-12-31")


def snapped(v: Column, step: int) -> Column:
    return (F.floor(v / step) * step).cast("int")


def tiles_between(low: Column, high: Column, step: int) -> Column:
    """Origins of the grid cells that [low, high) touches."""
    first = snapped(low, step)
    return F.filter(F.sequence(first, F.greatest(first, F.ceil(high).cast("int")), F.lit(step)), lambda x: x < high)


def window_start(size: Column, window: int) -> Column:
    return F.greatest(F.lit(0), F.floor((size - window) / 2).cast("int"))


def window_size(size: Column, window: int) -> Column:
    return F.least(size, F.lit(window)).cast("int")


def scaled(pixel: Column, original: Column, fetched: Column) -> Column:
    return pixel * fetched / original


def laea(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Spherical Lambert azimuthal equal-area coordinates in metres."""
    p, p0, d = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    k = F.sqrt(F.lit(2.0) / (1 + F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(d)))
    r = F.lit(EARTH_KM * 1000) * k
    return r * F.cos(p) * F.sin(d), r * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(d))


def laea_degrees(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Longitude and latitude of equal-area coordinates: the inverse of ``laea``."""
    p0, radius = F.radians(lat0), EARTH_KM * 1000
    rho = F.sqrt(x * x + y * y)
    c = 2 * F.asin(F.least(rho / (2 * radius), F.lit(1.0)))
    lat = F.when(rho > 0, F.asin(F.cos(c) * F.sin(p0) + y * F.sin(c) * F.cos(p0) / rho)).otherwise(p0)
    lon = F.when(rho > 0, F.atan2(x * F.sin(c), rho * F.cos(p0) * F.cos(c) - y * F.sin(p0) * F.sin(c))).otherwise(0.0)
    return lon0 + F.degrees(lon), F.degrees(lat)


#: Radius of the sphere that web maps are projected from, in metres.
MERCATOR_RADIUS = 6378137.0


def mercator_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of spherical Mercator coordinates in metres."""
    return F.degrees(x / MERCATOR_RADIUS), F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - F.lit(math.pi / 2))


# Where elevation tiles lie, and their name by the south-west corner.
DEM_BASE = "https://copernicus-dem-30m.s3.amazonaws.com"
DEM_NAME = "Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM"


def dem_url(lat: Column, lon: Column) -> Column:
    """The address of the 1° elevation tile with this south-west corner."""
    name = F.format_string(DEM_NAME, F.when(lat >= 0, "N").otherwise("S"), F.abs(lat), F.when(lon >= 0, "E").otherwise("W"), F.abs(lon))
    return F.concat(F.lit(DEM_BASE + "/"), name, F.lit("/"), name, F.lit(".tif"))
