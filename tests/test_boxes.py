"""Sums and newest points in boxes against brute force, and the number of rows that the cells give."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from roadrisk.operators import boxes, context

BOX = "box long, south double, north double, west double, east double"
POINT = "lat double, lon double, kind string, n long"


def some_boxes(rng, n):
    rows = []
    for k in range(n):
        lat, lon = rng.uniform(-90, 90), rng.uniform(-180, 180)
        high, wide = (10 ** rng.uniform(-6, 2) for _ in range(2))
        rows.append((k, lat, lat + high, lon, lon + wide))
    exact = [(n, 0.0, 0.5, 0.0, 0.5), (n + 1, 10.25, 10.25, -3.5, -3.5), (n + 2, -90.0, 90.0, -180.0, 180.0), (n + 3, 89.0, 95.0, 170.0, 190.0), (n + 4, 0.1, 0.0, 0.0, 1.0), (n + 5, None, 1.0, 0.0, 1.0)]
    return rows + exact


def some_points(rng, areas, n):
    rows = [(0.0, 0.0, "a", 1), (0.5, 0.5, "a", 2), (0.25, 0.5, "b", 4), (10.25, -3.5, "b", 8), (90.0, 180.0, "a", 16), (91.0, 180.0, "a", 32), (None, 1.0, "a", 64), (float("nan"), 0.2, "a", 128)]
    for _ in range(n):
        _, south, north, west, east = rng.choice(areas[:-2])
        lat, lon = rng.uniform(south, north), rng.uniform(west, east)
        rows.append((rng.choice([lat, south, north]), rng.choice([lon, west, east]), rng.choice("ab"), rng.randint(1, 9)))
    return rows


@pytest.mark.parametrize("side", [2, 8, 32])
def test_sums_equal_brute_force_at_all_sizes(spark, side):
    rng = random.Random(side)
    areas = some_boxes(rng, 40)
    points = some_points(rng, areas, 1500)
    got = defaultdict(int)
    for r in boxes.sums(spark.createDataFrame(areas, BOX), spark.createDataFrame(points, POINT), "lat", "lon", ["n"], ["kind"], side).collect():
        got[r["box"], r["kind"]] += r["n"]
    want = defaultdict(int)
    for box, south, north, west, east in areas[:-1]:
        for lat, lon, kind, n in points:
            if lat is not None and -90 <= lat <= 90 and -180 <= lon <= 180 and south <= lat <= north and west <= lon <= east:
                want[box, kind] += n
    assert dict(got) == dict(want)


@pytest.mark.parametrize("rows", [1, 5, 5000])
def test_newest_equal_brute_force(spark, rows):
    rng = random.Random(rows)
    areas = some_boxes(rng, 15)
    points = [(*p[:2], k, rng.randint(0, 50)) for k, p in enumerate(some_points(rng, areas, 800))]
    found = boxes.newest(
        spark.createDataFrame(areas, BOX), spark.createDataFrame(points, "lat double, lon double, id long, day long"), "lat", "lon",
        [F.col("day").desc(), F.col("id").desc()], rows,
    ).collect()
    got = defaultdict(list)
    for r in found:
        got[r["box"]].append((r["day"], r["id"]))
    for box, south, north, west, east in areas[:-1]:
        inside = [(day, k) for lat, lon, k, day in points if lat is not None and -90 <= lat <= 90 and -180 <= lon <= 180 and south <= lat <= north and west <= lon <= east]
        assert len(set(got[box])) == len(got[box])
        assert sorted(got[box], reverse=True)[:rows] == sorted(inside, reverse=True)[:rows]


def test_cells_of_any_box_are_few(spark):
    """The number of cells depends on the side alone: hardly more than the border and its neighbours, from a metre to the globe."""
    rng = random.Random(9)
    areas = spark.createDataFrame(some_boxes(rng, 200), BOX)
    for side in (2, 8, 32):
        counts = boxes.cells(areas, side).groupBy("box").count().collect()
        assert max(r["count"] for r in counts) <= 4 * (side + 1) + 12 * side


def test_a_full_box_gives_rows_for_its_border_only(spark):
    """10,000 incidents in one box: rows in proportion to the border cells, not to the incidents."""
    rng = random.Random(4)
    rows = [(k, "theft", "minor", 40.0 + rng.uniform(-0.07, 0.07), -74.0 + rng.uniform(-0.09, 0.09)) for k in range(10_000)]
    incidents = spark.createDataFrame(rows, "incident_id long, incident_type string, severity string, latitude double, longitude double")
    incidents = incidents.withColumn("date", F.lit("2001-07-20 00:00:00").cast("timestamp_ntz"))
    places = [(40.0, -74.0), (40.0, -74.001), (40.001, -74.0)]
    lookups = spark.createDataFrame(places, "latitude double, longitude double")
    area = context.boxes(lookups, 5.0)
    borders = boxes.cells(area).filter(F.col("_step") == boxes.BORDER).count()
    points = incidents.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.lit(1).alias("n"))
    met = boxes.sums(area, points, "lat", "lon", ["n"]).count()
    whole = boxes.cells(area).count() - borders
    assert met <= whole + 10 * borders
    assert met < 0.3 * len(places) * 10_000
    for r in context.crime_risk(lookups, incidents, "2001-08-01").collect():
        wide = 5 / 69 / math.cos(math.radians(r["latitude"]))
        assert r["incidents"] == sum(abs(lat - r["latitude"]) <= 5 / 69 and abs(lon - r["longitude"]) <= wide for *_, lat, lon in rows)


def test_a_segment_across_the_globe_takes_few_cells(spark):
    route = spark.createDataFrame([(1, 0, -50.0, -100.0), (1, 1, 50.0, 0.0), (2, 0, 10.0, 10.0), (2, 1, 10.001, 10.001)], "route_id long, seq long, latitude double, longitude double")
    segments = context.route_segments(route)
    counts = {r["route_id"]: r["count"] for r in boxes.cells(segments, context._segment_side()).groupBy("route_id").count().collect()}
    assert counts[1] <= 4 * 33 + 12 * 32 and counts[2] <= 16
    rng = random.Random(2)
    rows = [("minor", "rain", rng.uniform(-60, 60), rng.uniform(-110, 20)) for _ in range(3000)] + [("fatal", None, 10.0005, 10.0005)] * 7
    accidents = spark.createDataFrame(rows, "severity string, weather_conditions string, latitude double, longitude double")
    accidents = accidents.withColumn("date", F.lit("2001-07-20 00:00:00").cast("timestamp_ntz"))
    got = {r["route_id"]: r for r in context.route_accidents(route, accidents, "2001-08-01").collect()}
    assert got[1]["accidents"] == sum(-50 <= lat <= 50 and -100 <= lon <= 0 for _, _, lat, lon in rows)
    assert (got[2]["accidents"], got[2]["fatal"]) == (7, 7)
    kinds = context.accident_rows_on_routes(segments, accidents, "2001-08-01").filter("route_id = 2").collect()
    assert [(r["severity"], r["weather_conditions"], r["accidents"]) for r in kinds] == [("fatal", None, 7)]


def test_small_boxes_are_sent_once(spark):
    """Counts of short segments equal a walk through all pairs, on cell borders too; each segment is one row of the join."""
    rng = random.Random(6)
    grid = [k * 2.0**-7 for k in range(-40, 41)]

    def place():
        return (rng.choice(grid), rng.choice(grid)) if rng.random() < 0.5 else (rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3))

    steps = (0.0, 2.0**-7, 2.0**-5, 0.02, 1e-5, 0.5, 0.3, 0.1)
    rows = []
    for k in range(120):
        south, west = place()
        rows.append((k % 100, south, south + rng.choice(steps), west, west + rng.choice(steps)))  # some names twice
    rows += [(200, 89.99, 95.0, 179.99, 181.0), (201, None, None, 0.0, 0.1), (202, 0.0, 0.1, None, None), (None, -0.1, 0.1, -0.1, 0.1)]
    areas = spark.createDataFrame(rows, "box long, south double, north double, west double, east double")
    points = [(*place(), rng.choice(["x", "y", None]), rng.randrange(1, 4)) for _ in range(400)] + [(90.0, 180.0, "x", 1), (91.0, 180.0, "x", 1), (None, 0.0, "x", 1)]
    table = spark.createDataFrame(points, "accident_lat double, accident_lon double, kind string, n long")
    want = defaultdict(int)
    for box, south, north, west, east in rows:
        for lat, lon, kind, n in points:
            if None not in (south, north, west, east, lat) and lat <= 90 and south <= lat <= north and west <= lon <= east:
                want[box, kind] += n
    for found in (context._segment_sums(areas, table, ["n"], ["kind"]), boxes.sums(areas, table, "accident_lat", "accident_lon", ["n"], ["kind"])):
        got = {(r["box"], r["kind"]): r["n"] for r in found.groupBy("box", "kind").agg(F.sum("n").alias("n")).collect()}
        assert got == dict(want)
    short = areas.filter(~context._is_long())
    plan = boxes.small_sums(short, table, "accident_lat", "accident_lon", ["n"], ["kind"])._jdf.queryExecution()
    assert "BroadcastHashJoin" not in plan.sparkPlan().toString()
    assert plan.optimizedPlan().toString().count("Generate") == 3  # of the points: level, row, column
