"""Great-circle distance and bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Earth radii in miles for trips and for routes, and miles per degree.
TRIP_EARTH_RADIUS = 3959.0
ROUTE_EARTH_RADIUS = 3958.7613
MILES_PER_DEGREE = 69.0

# The WGS 84 ellipsoid, equatorial radius in metres and flattening, and metres per mile.
EQUATOR_RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
METRES_PER_MILE = 1609.344
GEODESIC_ROUNDS = 8


def haversine_miles(
    lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = TRIP_EARTH_RADIUS
) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_dlon), 2
    )
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def latitude_delta(radius_miles: float) -> Column:
    return F.lit(radius_miles / MILES_PER_DEGREE)


def longitude_delta(latitude: Column, radius_miles: float) -> Column:
    return F.lit(radius_miles) / (F.lit(MILES_PER_DEGREE) * F.cos(F.radians(latitude)))


def grid_cell(degrees: Column, cell_degrees: float) -> Column:
    return F.floor(degrees / F.lit(cell_degrees))


def cells_covering(low: Column, high: Column, cell_degrees: float, domain: float) -> Column:
    """Array of the grid cells from ``low`` to ``high``, inside ±``domain`` degrees."""
    first = grid_cell(F.greatest(low, F.lit(-domain)), cell_degrees)
    last = grid_cell(F.least(high, F.lit(domain)), cell_degrees)
    return F.when(first <= last, F.sequence(first, last))


def with_ellipsoid_miles(
    df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, name: str, rounds: int = GEODESIC_ROUNDS
) -> DataFrame:
    """Add the miles of the shortest line on the ellipsoid, and ``<name>_settled``: whether the iteration came to rest.

    The inverse problem by iterating the difference of longitude on the auxiliary sphere. Each round is a projection, since
    as one expression the rounds would multiply. Nearly opposite points may not settle; they get the length on the sphere of
    the ellipsoid's mean radius.
    """
    f, a = FLATTENING, EQUATOR_RADIUS
    b = a * (1 - f)
    one, two = (F.atan((1 - f) * F.tan(F.radians(F.col(c)))) for c in (lat1, lat2))
    start = df.select("*", one.alias("_u"), two.alias("_v"), F.radians(F.col(lon2) - F.col(lon1)).alias("_l"))
    start = start.select(
        "*", F.sin("_u").alias("_su"), F.cos("_u").alias("_cu"), F.sin("_v").alias("_sv"), F.cos("_v").alias("_cv"),
        F.col("_l").alias("_x"), F.col("_l").alias("_before"),
    )

    def arc(rows: DataFrame) -> DataFrame:
        """The arc between the points on the sphere, its azimuth at the equator and its middle."""
        across = F.hypot(F.col("_cv") * F.sin("_x"), F.col("_cu") * F.col("_sv") - F.col("_su") * F.col("_cv") * F.cos("_x"))
        along = F.col("_su") * F.col("_sv") + F.col("_cu") * F.col("_cv") * F.cos("_x")
        rows = rows.withColumns({"_sin": across, "_cos": along})
        azimuth = F.when(F.col("_sin") > 0, F.col("_cu") * F.col("_cv") * F.sin("_x") / F.col("_sin")).otherwise(0.0)
        rows = rows.withColumns({"_arc": F.atan2("_sin", "_cos"), "_az": azimuth})
        rows = rows.withColumn("_q", 1 - F.col("_az") * F.col("_az"))
        middle = F.when(F.col("_q") > 1e-15, F.col("_cos") - 2 * F.col("_su") * F.col("_sv") / F.col("_q")).otherwise(0.0)
        return rows.withColumn("_mid", middle)

    rows = start
    for _ in range(rounds):
        rows = arc(rows).withColumn("_c", f / 16 * F.col("_q") * (4 + f * (4 - 3 * F.col("_q"))))
        swing = F.col("_mid") + F.col("_c") * F.col("_cos") * (2 * F.col("_mid") * F.col("_mid") - 1)
        turn = F.col("_arc") + F.col("_c") * F.col("_sin") * swing
        rows = rows.withColumns({"_before": F.col("_x"), "_next": F.col("_l") + (1 - F.col("_c")) * f * F.col("_az") * turn})
        rows = rows.drop("_x").withColumnRenamed("_next", "_x")
    rows = arc(rows).withColumn("_w", F.col("_q") * ((a * a - b * b) / (b * b)))
    w, mid = F.col("_w"), F.col("_mid")
    rows = rows.withColumns({
        "_big": 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))),
        "_small": w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))),
    })
    k = F.col("_small")
    inner = F.col("_cos") * (2 * mid * mid - 1) - k / 6 * mid * (4 * F.col("_sin") * F.col("_sin") - 3) * (4 * mid * mid - 3)
    metres = b * F.col("_big") * (F.col("_arc") - k * F.col("_sin") * (mid + k / 4 * inner))
    settled = F.abs(F.col("_x") - F.col("_before")) < 1e-12
    sphere = haversine_miles(F.col(lat1), F.col(lon1), F.col(lat2), F.col(lon2), (2 * a + b) / 3 / METRES_PER_MILE)
    return rows.select(
        *df.columns, F.when(settled, metres / METRES_PER_MILE).otherwise(sphere).alias(name), settled.alias(f"{name}_settled")
    )
