"""Near points against brute force, and points in regions."""

import math
import random

from pyspark.sql import functions as F

from webobs.operators import near


def km(a, b):
    p, q, w = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(w / 2) ** 2)))


def brute(rows, most):
    ok = [(i, y, x) for i, y, x in rows if y is not None and x is not None and y == y and x == x and abs(y) <= 90 and abs(x) <= 180 and (y, x) != (0, 0)]
    return {(min(a[0], b[0]), max(a[0], b[0])) for k, a in enumerate(ok) for b in ok[k + 1 :] if km(a[1:], b[1:]) <= most}


def points(seed=1):
    r, rows = random.Random(seed), []
    centres = [(89.99, 10), (-89.98, 170), (0.0, 179.99), (12.0, -180.0), (45.0, 45.0), (-33.3, 180.0), (60.0, -0.01)]
    for y, x in centres:
        for _ in range(40):
            yy = max(-90.0, min(90.0, y + r.uniform(-0.06, 0.06)))
            xx = x + r.uniform(-0.1, 0.1) * (1 if abs(y) < 80 else 200)
            rows.append((yy, (xx + 180) % 360 - 180))
    rows += [(90.0, 0.0), (90.0, 120.0), (-90.0, 5.0), (0.0, 0.0), (0.0, 0.0), (91.0, 0.0), (10.0, 200.0), (None, 5.0), (5.0, None), (float("nan"), 1.0)]
    rows += [(45.0, 45.0)] * 30 + [(1.0, 1.0)]
    return [(i, y, x) for i, (y, x) in enumerate(rows)]


def test_near_pairs_equal_brute_force(spark):
    rows = points()
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double").withColumn("lat", F.lit("clash")).withColumn("tile", F.lit(1))
    for block in (20_000, 7):  # 7: hot tiles are split into blocks
        assert {tuple(r) for r in near.near_pairs(df, "id", km=5.0, block=block).collect()} == brute(rows, 5.0)


def test_near_pairs_at_other_distances(spark):
    rows = points(2)
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    assert {tuple(r) for r in near.near_pairs(df, "id", km=300.0).collect()} == brute(rows, 300.0)
    assert near.near_pairs(df.limit(0), "id").count() == 0


def test_pairs_within_blocks(spark):
    df = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 100), (3, 200), (3, 201)], "g long, id long")
    got = sorted(tuple(r) for r in near.pairs_within(df, "g", "id", block=4).collect())
    assert got == sorted([(a, b) for a in range(25) for b in range(a + 1, 25)] + [(200, 201)])


def test_regions(spark):
    square = [(0.5, 0.5), (0.5, 3.5), (3.5, 3.5), (3.5, 0.5)]
    notch = [(10.0, 10.0), (10.0, 14.0), (14.0, 14.0), (11.0, 12.0), (14.0, 10.0)]
    regs = spark.createDataFrame([(1, [(float(a), float(b)) for a, b in square]), (2, notch), (3, [(0.0, 0.0), (1.0, 1.0)])], "region long, ring array<struct<lat:double,lon:double>>")
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 4.0, 2.0), (3, 10.5, 12.0), (4, 13.0, 12.0), (5, 13.0, 13.5), (6, None, 1.0)], "id long, latitude double, longitude double")
    got = {tuple(r) for r in near.locate_in_regions(pts, "id", regs, "region", "ring").collect()}
    assert got == {(1, 1), (3, 2), (5, 2)}
    small = near.locate_in_regions(pts, "id", regs, "region", "ring", block=2)
    assert {tuple(r) for r in small.collect()} == got
    assert near.locate_in_regions(pts.limit(0), "id", regs, "region", "ring").count() == 0


def test_regions_across_180_degrees(spark):
    ring = lambda y, x, r: [(y + r, x), (y, x + r), (y - r, x), (y, x - r)]
    regs = spark.createDataFrame([(1, ring(0.5, 179.0, 4.0)), (2, ring(-10.5, -178.0, 4.0)), (3, ring(0.5, 10.0, 4.0))], "region long, ring array<struct<lat:double,lon:double>>")
    pts = spark.createDataFrame([(1, 0.5, 178.0), (2, 0.5, -179.0), (3, 0.5, -176.0), (4, -10.4, 179.0), (5, -10.4, -179.5), (6, 0.4, 11.0), (7, 0.4, 180.0), (8, 0.4, -180.0)], "id long, latitude double, longitude double")
    got = sorted(tuple(r) for r in near.locate_in_regions(pts, "id", regs, "region", "ring").collect())
    assert got == [(1, 1), (2, 1), (4, 2), (5, 2), (6, 3), (7, 1), (8, 1)]


def test_pairs_of_two_hot_places_and_polar_disks(spark):
    r = random.Random(3)
    hot = [(i, 10.0, 20.0) for i in range(130)] + [(200 + i, 10.02, 20.0) for i in range(90)]
    pole = [(400 + i, r.uniform(89.9, 90), r.uniform(-180, 180)) for i in range(40)] + [(500 + i, r.uniform(89.7, 89.96), r.uniform(-180, 180)) for i in range(40)]
    df = spark.createDataFrame(hot + pole, "id long, latitude double, longitude double")
    want = sorted(brute(hot + pole, 5.0))
    assert sorted(tuple(x) for x in near.near_pairs(df, "id").collect()) == want
    member = df.filter("id < 400").select((F.col("latitude") > 10.01).cast("long").alias("g"), "id")
    links = spark.createDataFrame([(0, 1)], "a long, b long")
    got = sorted(tuple(x) for x in near.pairs_across(links, member, "g", "id", block=20).collect())
    assert got == sorted((a[0], b[0]) for a in hot[:130] for b in hot[130:])
