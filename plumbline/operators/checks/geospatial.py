"""Checks on coordinates."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import functions as F

from plumbline.functions.numeric import haversine_km, in_polygon
from plumbline.plans.registry import check

# Fixed values: (min_lat, max_lat, min_lon, max_lon) around each country.
COUNTRY_BOXES = {
    "US": (18.9, 71.4, -179.2, -66.9), "KR": (33.1, 38.7, 124.6, 131.9), "JP": (24.0, 45.6, 122.9, 153.99),
    "CN": (18.1, 53.6, 73.5, 134.8), "DE": (47.2, 55.1, 5.8, 15.1), "FR": (41.3, 51.1, -5.2, 9.6),
    "GB": (49.8, 60.9, -8.7, 1.8), "CA": (41.6, 83.2, -141.1, -52.6), "AU": (-43.7, -10.0, 112.9, 153.7),
    "BR": (-33.8, 5.3, -74.0, -34.7), "IN": (6.7, 35.6, 68.1, 97.5),
}
# Standard offset from UTC in hours of every zone that the system's zone tables know, by rule: the lesser of the offsets in
# January and July.
ZONE_HOURS = {z: min(datetime(2024, m, 15, tzinfo=ZoneInfo(z)).utcoffset().total_seconds() for m in (1, 7)) / 3600 for z in sorted(available_timezones())}


def point(lat_column, lon_column):
    lat, lon = F.col(lat_column), F.col(lon_column)
    return lat, lon, lat.isNotNull() & lon.isNotNull()


def in_box(lat, lon, min_lat, max_lat, min_lon, max_lon):
    """Box test; west beyond east means the box spans the antimeridian."""
    across = lon.between(min_lon, max_lon) if min_lon <= max_lon else (lon >= min_lon) | (lon <= max_lon)
    return lat.between(min_lat, max_lat) & across


@check("geospatial")
def Latitude(t, column, min_lat=-90.0, max_lat=90.0):
    """Latitudes are within bounds."""
    t.rows(column, ~F.col(column).between(min_lat, max_lat), F.col(column).isNotNull())


@check("geospatial")
def Longitude(t, column, min_lon=-180.0, max_lon=180.0):
    """Longitudes are within bounds."""
    t.rows(column, ~F.col(column).between(min_lon, max_lon), F.col(column).isNotNull())


@check("geospatial")
def Coordinate(t, lat_column, lon_column):
    """Latitude and longitude are both within bounds."""
    lat, lon, both = point(lat_column, lon_column)
    t.rows(f"{lat_column},{lon_column}", ~in_box(lat, lon, -90.0, 90.0, -180.0, 180.0), both)


@check("geospatial")
def CoordinateNotNullIsland(t, lat_column, lon_column, tolerance=0.001):
    """Coordinates are not (0, 0)."""
    lat, lon, both = point(lat_column, lon_column)
    t.rows(f"{lat_column},{lon_column}", (F.abs(lat) <= tolerance) & (F.abs(lon) <= tolerance), both)


@check("geospatial")
def GeoDistance(t, lat_column_a, lon_column_a, lat_column_b, lon_column_b, max_distance_km):
    """Two points of a row are at most so far apart."""
    km = haversine_km(F.col(lat_column_a), F.col(lon_column_a), F.col(lat_column_b), F.col(lon_column_b))
    t.rows(f"{lat_column_a},{lon_column_a}", km > float(max_distance_km), km.isNotNull())


@check("geospatial")
def GeoDistanceFromPoint(t, lat_column, lon_column, reference_lat, reference_lon, max_distance_km):
    """Points are at most so far from a fixed point."""
    km = haversine_km(F.col(lat_column), F.col(lon_column), float(reference_lat), float(reference_lon))
    t.rows(f"{lat_column},{lon_column}", km > float(max_distance_km), km.isNotNull())


@check("geospatial")
def GeoBoundingBox(t, lat_column, lon_column, min_lat, max_lat, min_lon, max_lon):
    """Points lie in a box (which may span the antimeridian)."""
    lat, lon, both = point(lat_column, lon_column)
    t.rows(f"{lat_column},{lon_column}", ~in_box(lat, lon, min_lat, max_lat, min_lon, max_lon), both)


@check("geospatial")
def GeoCountry(t, lat_column, lon_column, country_code, use_approximate=True, box=None):
    """Points lie in the bounding box of a country; ``box`` (least and greatest latitude, least and greatest longitude)
    gives that of a country that is not known."""
    if not use_approximate:
        raise ValueError("only bounding boxes are known; give GeoPolygon an exact border")
    box = box or COUNTRY_BOXES.get(country_code.upper())
    if box is None:
        raise ValueError(f"no bounding box of {country_code!r} is known; give one as box")
    lat, lon, both = point(lat_column, lon_column)
    t.rows(f"{lat_column},{lon_column}", ~in_box(lat, lon, *box), both)


def ring_of(polygon):
    """(lat, lon) pairs of a GeoJSON-like outer ring of [lon, lat] pairs."""
    ring = polygon
    while isinstance(ring[0][0], (list, tuple)):
        ring = ring[0]
    ring = [(float(lat), float(lon)) for lon, lat in ring]
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


@check("geospatial")
def GeoPolygon(t, lat_column, lon_column, polygon):
    """Points lie in a polygon."""
    lat, lon, both = point(lat_column, lon_column)
    t.rows(f"{lat_column},{lon_column}", ~in_polygon(lat, lon, ring_of(polygon)), both)


@check("geospatial", "low")
def GeoCluster(t, lat_column, lon_column, max_cluster_radius_km=None, min_points_per_cluster=1):
    """Grid cells hold enough points, none far from the cell's centroid.

    Points are counted per distinct coordinate before cells are formed, so a
    hot place is one row. The cell side is twice the radius in degrees of
    latitude (1 degree without a radius).
    """
    side = 2.0 * float(max_cluster_radius_km) / 111.195 if max_cluster_radius_km else 1.0

    def build():
        places = (t.df.select(F.col(lat_column).alias("lat"), F.col(lon_column).alias("lon")).dropna()
                  .groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))
                  .withColumn("cy", F.floor(F.col("lat") / side)).withColumn("cx", F.floor(F.col("lon") / side)))
        cells = places.groupBy("cy", "cx").agg(
            F.sum("n").alias("points"), (F.sum(F.col("lat") * F.col("n")) / F.sum("n")).alias("clat"),
            (F.sum(F.col("lon") * F.col("n")) / F.sum("n")).alias("clon"))
        if not max_cluster_radius_km:
            return cells.withColumn("radius", F.lit(0.0))
        far = haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
        return places.join(cells, ["cy", "cx"]).groupBy("cy", "cx").agg(
            F.first("points").alias("points"), F.max(far).alias("radius"))

    g = t.frame(f"cells:{lat_column}:{lon_column}:{side}:{bool(max_cluster_radius_km)}", build)
    bad = F.col("points") < min_points_per_cluster
    if max_cluster_radius_km:
        bad = bad | (F.col("radius") > float(max_cluster_radius_km))
    t.verdict(f"{lat_column},{lon_column}", t.stat(F.count_if(bad), g), t.stat(F.count(F.lit(1)), g), frame=g)


@check("geospatial")
def GeoSpeed(t, lat_column, lon_column, timestamp_column, max_speed_kmh=200, entity_column=None):
    """Speed between consecutive points of an entity is at most the limit."""
    ts = F.unix_micros(F.col(timestamp_column).cast("timestamp"))
    entity = F.col(entity_column) if entity_column else F.lit(0)
    order = ([entity_column] if entity_column else []) + [timestamp_column, lat_column, lon_column]
    lat, lon, both = point(lat_column, lon_column)
    p = t.pairs(order, {"e": entity, "ts": ts, "lat": lat, "lon": lon}, both & F.col(timestamp_column).isNotNull())

    def same(cur, prev):
        return cur("e") == prev("e")

    def too_fast(cur, prev):
        km = haversine_km(prev("lat"), prev("lon"), cur("lat"), cur("lon"))
        hours = (cur("ts") - prev("ts")) / F.lit(3600e6)
        return same(cur, prev) & F.when(hours > 0, km / hours > float(max_speed_kmh)).otherwise(km > 0)

    bad = t.stat(("sum", too_fast), p, f"fast_{max_speed_kmh}".replace(".", "_"))
    t.verdict(f"{lat_column},{lon_column}", bad, t.stat(("sum", same), p, "steps"), frame=p)


@check("geospatial", "low")
def GeoAltitude(t, column, min_altitude=-500, max_altitude=10000):
    """Altitudes are within bounds."""
    t.rows(column, ~F.col(column).between(min_altitude, max_altitude), F.col(column).isNotNull())


@check("geospatial", "low")
def GeoTimezone(t, lat_column, lon_column, timezone_column, tolerance_hours=1.0):
    """The zone's standard offset fits the longitude (15 degrees an hour)."""
    lat, lon, both = point(lat_column, lon_column)
    zone = F.col(timezone_column)
    table = F.create_map(*[x for k, v in ZONE_HOURS.items() for x in (F.lit(k), F.lit(float(v)))])
    written = F.try_to_number(F.regexp_extract(zone, r"^(?:UTC|GMT)([+-][0-9]{1,2})$", 1), F.lit("S99")).cast("double")
    offset = F.coalesce(F.try_element_at(table, zone), written)
    off = F.abs(F.round(lon / 15.0) - offset) > float(tolerance_hours)
    t.rows(timezone_column, F.coalesce(off, F.lit(True)), both & zone.isNotNull())
