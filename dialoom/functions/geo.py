"""Places: distance, coordinates written in text, providers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, NEAR_M = 6371000.0, 500.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def text_coordinate(text: Column) -> Column:
    """struct(lat, lon) of "lat,lon", else null."""
    parts = F.split(F.trim(text), ",")
    lat, lon = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when((F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def number_matches(ref: Column, cand: Column) -> Column:
    return F.abs(ref - cand) <= F.greatest(F.lit(1e-6), 0.02 * F.abs(ref))


def text_matches(ref: Column, cand: Column) -> Column:
    return F.lower(F.trim(ref)) == F.lower(F.trim(cand))


def provider(name: Column) -> Column:
    starts = lambda *p: name.rlike("^(" + "|".join(p) + ")")
    return F.when(starts("tomtom-"), "tomtom").when(starts("here_"), "here").when(starts("osrm_", "nominatim_", "open_meteo_"), "keyless").otherwise("other")
