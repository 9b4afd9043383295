"""Places as longitudes and latitudes, and as 52-bit interleaved hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radius in metres, latitude bound, bits of each coordinate, digits of hash text, metres of each unit.
EARTH_RADIUS = 6372797.560856
LAT_BOUND = 85.05112878
STEP = 26
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}


def _fixed(value: Column, bound: float) -> Column:
    cell = F.floor((value + bound) / (2 * bound) * float(1 << STEP)).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(cell, F.lit((1 << STEP) - 1).cast("long")))


def _spread(bits: Column) -> Column:
    """Bit i to bit 2 i, by five rounds of masks."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
    return bits


def _gather(bits: Column) -> Column:
    """Bit 2 i to bit i."""
    bits = bits.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift)).bitwiseAND(F.lit(mask))
    return bits


def encode(lon: Column, lat: Column, lat_bound: float = LAT_BOUND) -> Column:
    return _spread(_fixed(lat, lat_bound)).bitwiseOR(F.shiftleft(_spread(_fixed(lon, 180.0)), 1))


def decode(score: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the middle of the cell."""

    def middle(bits: Column, bound: float) -> Column:
        return (bits + 0.5) / float(1 << STEP) * (2 * bound) - bound

    return middle(_gather(F.shiftrightunsigned(score, 1)), 180.0), middle(_gather(score), LAT_BOUND)


def with_hash_text(places: DataFrame) -> DataFrame:
    """Adds score, the longitude and latitude of its cell's middle, and the hash text: ten base-32 characters of that middle on the usual grid, then a 0.

    Each step is a column of its own, as each uses the one before many times.
    """
    lon, lat = decode(F.col("score"))
    steps = places.withColumn("score", encode(F.col("lon"), F.col("lat"))).withColumns({"cell_lon": lon, "cell_lat": lat})
    steps = steps.withColumn("grid", encode(F.col("cell_lon"), F.col("cell_lat"), lat_bound=90.0))
    letters = [F.substring(F.lit(BASE32), F.shiftrightunsigned("grid", 52 - 5 * (i + 1)).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(10)]
    return steps.withColumn("hash", F.concat(*letters, F.lit("0"))).drop("grid")


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the great circle."""
    v, u = F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    h = u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v
    return 2.0 * EARTH_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def box_distance(width: float, height: float, lon: Column, lat: Column, center_lon: float, center_lat: float) -> Column:
    """Metres from the centre of a box, -1 outside it; the width is measured at the place's latitude."""
    away_lat = EARTH_RADIUS * F.abs(F.radians(lat) - F.radians(F.lit(center_lat)))
    away_lon = distance(lon, lat, F.lit(center_lon), lat)
    return F.when((away_lat > height / 2) | (away_lon > width / 2), F.lit(-1.0)).otherwise(distance(F.lit(center_lon), F.lit(center_lat), lon, lat))


def unit_distance(metres: Column, unit: str) -> Column:
    return F.format_string("%.4f", metres / UNITS[unit])


def valid(lon: Column, lat: Column) -> Column:
    return lon.between(-180, 180) & lat.between(-LAT_BOUND, LAT_BOUND)


def within_radius(places: DataFrame, lon: float, lat: float, radius: float, unit: str = "m", count: int | None = None, descending: bool = False) -> DataFrame:
    """(member, metres) of places (member, lon, lat) no farther than the radius, nearest first unless descending.

    Latitudes beyond the radius are left out by a plain range first, which the file scan can use.
    """
    metres = radius * UNITS[unit]
    reach = metres / EARTH_RADIUS * 57.29577951308232 + 1e-9
    near = places.where(F.col("lat").between(lat - reach, lat + reach)).select("member", distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")).alias("metres")).where(F.col("metres") <= metres)
    near = near.orderBy(F.col("metres").desc() if descending else "metres", "member")
    return near if count is None else near.limit(count)


def within_box(places: DataFrame, lon: float, lat: float, width: float, height: float, unit: str = "m") -> DataFrame:
    metres = box_distance(width * UNITS[unit], height * UNITS[unit], F.col("lon"), F.col("lat"), lon, lat)
    return places.select("member", metres.alias("metres")).where("metres >= 0").orderBy("metres", "member")


def added(held: DataFrame, new: DataFrame, mode: str | None = None) -> DataFrame:
    """(member, lon, lat, changed) after adding places: mode NX only adds, XX only moves; changed marks rows that were added or moved."""
    mine = new.select("member", F.struct("lon", "lat").alias("to"))
    both = held.select("member", F.struct("lon", "lat").alias("at")).join(mine, "member", "full")
    take = F.col("to").isNotNull() & (F.col("at").isNull() if mode == "NX" else F.col("at").isNotNull() if mode == "XX" else F.lit(True))
    placed = both.select("member", F.when(take, F.col("to")).otherwise(F.col("at")).alias("p"), (take & ~F.col("to").eqNullSafe(F.col("at"))).alias("changed"))
    return placed.where("p is not null").select("member", "p.lon", "p.lat", "changed")
