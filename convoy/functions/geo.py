"""Distances between points given in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convoy.functions.numeric import clamp
from convoy.settings import EARTH_RADIUS_MILES


# Size and margin of the fleet map in pixels, and the area it shows.
MAP_WIDTH, MAP_HEIGHT, MAP_MARGIN = 960, 600, 10
MAP_SOUTH, MAP_NORTH = 24.5, 49.5
MAP_WEST, MAP_EAST = -125.0, -66.5


def map_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Pixel position on the fleet map; places outside its area stay at the margin."""
    x = (lon - MAP_WEST) / (MAP_EAST - MAP_WEST) * MAP_WIDTH
    y = (MAP_NORTH - lat) / (MAP_NORTH - MAP_SOUTH) * MAP_HEIGHT
    return (
        clamp(x, float(MAP_MARGIN), float(MAP_WIDTH - MAP_MARGIN)),
        clamp(y, float(MAP_MARGIN), float(MAP_HEIGHT - MAP_MARGIN)),
    )


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = (
        F.sin(half_lat) * F.sin(half_lat)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    )
    return EARTH_RADIUS_MILES * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def degree_distance_sq(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared plane distance in degrees; ranks points as its root does."""
    return (lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)
