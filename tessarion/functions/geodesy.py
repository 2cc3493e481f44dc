"""Spherical geometry, as column expressions and as driver-side scalars (suffix ``_at``)."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth, taken as a sphere, in kilometres (fixed value).
EARTH_RADIUS_KM = 6371.0088


class RadiusError(ValueError):
    """A radius that is no length: ``kind`` is non_finite or negative."""

    def __init__(self, kind: str, km: float) -> None:
        super().__init__(f"a radius must be a finite length of at least zero: {km} km ({kind})")
        self.kind = kind


@dataclass(frozen=True)
class RadiusKm:
    km: float

    def __post_init__(self) -> None:
        if not math.isfinite(self.km):
            raise RadiusError("non_finite", self.km)
        if self.km < 0:
            raise RadiusError("negative", self.km)

    def widened_by(self, slack: float) -> RadiusKm:
        """Never narrower, and the greatest double where the sum is none."""
        wide = self.km + slack
        return RadiusKm(max(self.km, wide) if math.isfinite(wide) else sys.float_info.max)


def wrap_lon(lon: Column) -> Column:
    """Longitude reduced to [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def wrap_lon_at(lon: float) -> float:
    reduced = math.fmod(lon + 180.0, 360.0)
    return (reduced + 360.0 if reduced < 0 else reduced) - 180.0


def central_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine angle in radians, its argument clamped to [0, 1]."""
    up, along = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = F.least(F.lit(1.0), F.greatest(F.lit(0.0), up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * along * along))
    return 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def central_angle_at(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    up, along = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    h = min(1.0, max(0.0, up * up + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * along * along))
    return 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return EARTH_RADIUS_KM * central_angle(lat1, lon1, lat2, lon2)


def great_circle_km_at(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    return EARTH_RADIUS_KM * central_angle_at(lat1, lon1, lat2, lon2)


def angle_of_km(km: Column) -> Column:
    """The angle of a ground distance, at most half a turn."""
    return F.least(km / EARTH_RADIUS_KM, F.lit(math.pi))


def zone_area_km2(north: Column, south: Column, lon_span: Column) -> Column:
    """Area between two latitudes over a span of longitude."""
    return EARTH_RADIUS_KM**2 * F.radians(lon_span) * (F.sin(F.radians(north)) - F.sin(F.radians(south)))


def zone_area_km2_at(north: float, south: float, lon_span: float) -> float:
    return EARTH_RADIUS_KM**2 * math.radians(lon_span) * (math.sin(math.radians(north)) - math.sin(math.radians(south)))


def destination(lat: Column, lon: Column, bearing: Column, angle: Column) -> tuple[Column, Column]:
    """(lat, lon) reached along a bearing (degrees) over an angle (radians)."""
    phi, theta = F.radians(lat), F.radians(bearing)
    up = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(phi) * F.cos(angle) + F.cos(phi) * F.sin(angle) * F.cos(theta)))
    east = F.atan2(F.sin(theta) * F.sin(angle) * F.cos(phi), F.cos(angle) - F.sin(phi) * up)
    return F.degrees(F.asin(up)), wrap_lon(lon + F.degrees(east))
