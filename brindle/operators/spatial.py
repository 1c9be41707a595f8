"""Spatial operators: great circles, geohashes, boxes, radius joins by grid cells, hulls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectorized import vectorized

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    dy, dx = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dy / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dx / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    dx = F.radians(lon2 - lon1)
    y = F.sin(dx) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dx)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def destination(lat: Column, lon: Column, bearing_deg: Column, km: Column) -> Column:
    """struct<lat, lon> reached."""
    d, b, y = km / EARTH_KM, F.radians(bearing_deg), F.radians(lat)
    lat2 = F.asin(F.sin(y) * F.cos(d) + F.cos(y) * F.sin(d) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(y), F.cos(d) - F.sin(y) * F.sin(lat2))
    return F.struct(F.degrees(lat2).alias("lat"), (F.pmod(F.degrees(lon2) + 540, F.lit(360.0)) - 180).alias("lon"))


# fixed values: the digits of geohash
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, precision: int = 9) -> Column:
    """Bits of longitude and latitude in turn, five to a digit; whole expression in Spark."""
    bits = precision * 5
    nx, ny = (bits + 1) // 2, bits // 2
    cell = lambda v, low, span, n: F.least(F.greatest(F.floor((v - low) / span * float(1 << n)), F.lit(0)), F.lit((1 << n) - 1)).cast("long")
    x, y = cell(lon, -180.0, 360.0, nx), cell(lat, -90.0, 180.0, ny)
    digits = []
    for d in range(precision):
        value = F.lit(0).cast("long")
        for i in range(5):
            at = d * 5 + i
            source, left = (x, nx - 1 - at // 2) if at % 2 == 0 else (y, ny - 1 - at // 2)
            value = value * 2 + F.shiftright(source, left).bitwiseAND(F.lit(1).cast("long"))
        digits.append(F.substring(F.lit(BASE32), value.cast("int") + 1, F.lit(1)))
    return F.concat(*digits)


@vectorized("struct<lat: double, lon: double, lat_error: double, lon_error: double>")
def geohash_decode(code: pd.Series) -> pd.DataFrame:
    rows = []
    for c in code:
        if c is None:
            rows.append((None,) * 4)
            continue
        box = [[-180.0, 180.0], [-90.0, 90.0]]
        even = 0
        for ch in c.lower():
            v = BASE32.index(ch)
            for i in range(4, -1, -1):
                lo, hi = box[even]
                box[even][1 - (v >> i & 1)] = (lo + hi) / 2
                even = 1 - even
        (x0, x1), (y0, y1) = box
        rows.append(((y0 + y1) / 2, (x0 + x1) / 2, (y1 - y0) / 2, (x1 - x0) / 2))
    return pd.DataFrame(rows, columns=["lat", "lon", "lat_error", "lon_error"])


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))


def in_box(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def nearest(df: DataFrame, x: str, y: str, px: float, py: float, k: int, *tie: str) -> DataFrame:
    return df.withColumn("distance", distance(F.col(x), F.col(y), F.lit(px), F.lit(py))).orderBy("distance", *tie).limit(k)


def radius_join(a: DataFrame, b: DataFrame, ax: str, ay: str, bx: str, by: str, radius: float) -> DataFrame:
    """Pairs within a radius: b stands in its grid cell, a in the nine around its own, and the cells are joined."""
    cell = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    left = a.withColumn("_i", F.explode(F.transform(steps, lambda d: cell(ax) + d))).withColumn("_j", F.explode(F.transform(steps, lambda d: cell(ay) + d)))
    right = b.withColumns({"_i": cell(bx), "_j": cell(by)})
    near = distance(F.col(ax), F.col(ay), F.col(bx), F.col(by))
    return left.join(right, ["_i", "_j"]).withColumn("distance", near).where(F.col("distance") <= radius).drop("_i", "_j")


def box_join(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of rectangles (id, x0, y0, x1, y1) that meet: a_id, b_id; each pair is made in the first cell that both are in."""
    spread = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "x0", "y0", "x1", "y1")]).withColumn("_i", F.explode(F.sequence(F.floor(F.col(f"{p}_x0") / cell), F.floor(F.col(f"{p}_x1") / cell)))).withColumn("_j", F.explode(F.sequence(F.floor(F.col(f"{p}_y0") / cell), F.floor(F.col(f"{p}_y1") / cell))))
    both = spread(a, "a").join(spread(b, "b"), ["_i", "_j"])
    meet = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    first = (F.col("_i") == F.floor(F.greatest("a_x0", "b_x0") / cell)) & (F.col("_j") == F.floor(F.greatest("a_y0", "b_y0") / cell))
    return both.where(meet & first).select("a_id", "b_id")


def box_links(df: DataFrame, cell: float) -> DataFrame:
    """id, class_id (the smallest id of an equal rectangle) and links (how many other rows' rectangles meet its own) of each row (id, x0, y0, x1, y1).

    Only unlike rectangles are paired, one of each; copies count by their number.
    """
    edges = ("x0", "y0", "x1", "y1")
    one = df.groupBy(*edges).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    size = one.select(F.col("id").alias("b_id"), "n")
    met = box_join(one, one, cell).where("a_id <> b_id").join(size, "b_id").groupBy(F.col("a_id").alias("id")).agg(F.sum("n").alias("_met"))
    own = F.when((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")), F.col("n") - 1).otherwise(0)
    classes = one.join(met, "id", "left").select(*[F.col(c).alias(f"_{c}") for c in edges], F.col("id").alias("class_id"), (F.coalesce("_met", F.lit(0)) + own).alias("links"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in edges]
    return df.join(classes, same).select("id", "class_id", "links")


def bounding_box(x: str, y: str) -> list[Column]:
    return [F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1")]


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def convex_hull(df: DataFrame, x: str, y: str) -> DataFrame:
    """Corners (x, y): each task keeps the hull of its rows, and the hull of those few corners is the whole's."""

    def run(batches):
        kept: list[tuple[float, float]] = []
        for b in batches:
            kept = _hull(kept + list(zip(b["x"].tolist(), b["y"].tolist())))
        yield pd.DataFrame(kept, columns=["x", "y"])

    part = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().mapInPandas(run, "x double, y double")
    return part.repartition(1).mapInPandas(run, "x double, y double")


def polygon_area(corners: Column) -> Column:
    """Of an array of struct<x, y>, by the shoelace rule."""
    n = F.size(corners)
    terms = F.transform(corners, lambda p, i: p["x"] * F.get(corners, F.pmod(i + 1, n))["y"] - p["y"] * F.get(corners, F.pmod(i + 1, n))["x"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def closest_pair(df: DataFrame, id: str, x: str, y: str) -> DataFrame:
    """a, b and distance of the nearest two points. A bound comes from neighbours along x in parallel ranges; the pairs within it from a grid join."""
    from .order import global_index

    points = df.select(F.col(id).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    at = global_index(points, "x", "y", "id", name="_i")
    after = at.select((F.col("_i") - 1).alias("_i"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    bound = at.join(after, "_i").agg(F.min(distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")))).first()[0]
    if bound is None:
        return df.sparkSession.createDataFrame([], f"a {dict(points.dtypes)['id']}, b {dict(points.dtypes)['id']}, distance double")
    side = lambda n: points.select(F.col("id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    near = radius_join(side("a"), side("b"), "ax", "ay", "bx", "by", max(bound, 1e-9)).where("a < b")
    return near.select("a", "b", "distance").orderBy("distance", "a", "b").limit(1)
