"""Geometry as a column: ``struct<type, points, lines, polys>``, positions are ``[lon, lat]``.

Any geometry is kept as its parts. A polygon is a list of rings, the outer one first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelens.functions import vocabulary as V
from tablelens.functions.values import let, round_half_up

POSITION = "array<double>"
PARTS = (
    f"struct<type:string,points:array<{POSITION}>,lines:array<array<{POSITION}>>,polys:array<array<array<{POSITION}>>>>"
)
SIMPLE_TYPES = ["Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"]
COLLECTION_DEPTH = 4


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_list(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


NO_POINTS = f"array<{POSITION}>"
NO_LINES = f"array<array<{POSITION}>>"
NO_POLYS = f"array<array<array<{POSITION}>>>"


def make_parts(kind: Column, points: Column | None = None, lines: Column | None = None, polys: Column | None = None) -> Column:
    return F.struct(
        kind.alias("type"),
        (points if points is not None else empty_list(NO_POINTS)).alias("points"),
        (lines if lines is not None else empty_list(NO_LINES)).alias("lines"),
        (polys if polys is not None else empty_list(NO_POLYS)).alias("polys"),
    )


def point(lon: Column | str, lat: Column | str) -> Column:
    return make_parts(F.lit("Point"), points=F.array(F.array(_c(lon).cast("double"), _c(lat).cast("double"))))


# ------------------------------------------------------------------ GeoJSON in and out


def _good_position(p: Column) -> Column:
    return (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull()


def _flat(p: Column) -> Column:
    """Longitude and latitude only; a height is not kept."""
    return F.slice(p, 1, 2)


def _positions(text: Column) -> Column:
    raw = F.from_json(text, NO_POINTS)
    return F.when(F.forall(raw, _good_position), F.transform(raw, _flat))


def _rings(text: Column) -> Column:
    raw = F.from_json(text, NO_LINES)
    return F.when(F.forall(raw, lambda r: F.forall(r, _good_position)), F.transform(raw, lambda r: F.transform(r, _flat)))


def _polygons(text: Column) -> Column:
    raw = F.from_json(text, NO_POLYS)
    good = F.forall(raw, lambda g: F.forall(g, lambda r: F.forall(r, _good_position)))
    return F.when(good, F.transform(raw, lambda g: F.transform(g, lambda r: F.transform(r, _flat))))


def _simple(kind: Column, coords: Column) -> Column:
    """Parts of one geometry without members; null when its coordinates are malformed."""
    no = lambda t: F.lit(None).cast(t)
    one = let(F.from_json(coords, POSITION), lambda p: F.when(_good_position(p), F.array(_flat(p))))
    line = let(_positions(coords), lambda q: F.when(q.isNotNull(), F.array(q)))
    ring = let(_rings(coords), lambda q: F.when(F.size(q) > 0, F.array(q)))
    read = F.struct(
        F.when(kind == "Point", one).when(kind == "MultiPoint", _positions(coords)).otherwise(no(NO_POINTS)).alias("points"),
        F.when(kind == "LineString", line).when(kind == "MultiLineString", _rings(coords)).otherwise(no(NO_LINES)).alias("lines"),
        F.when(kind == "Polygon", ring).when(kind == "MultiPolygon", _polygons(coords)).otherwise(no(NO_POLYS)).alias("polys"),
    )
    return let(
        read,
        lambda g: F.when(
            g["points"].isNotNull() | g["lines"].isNotNull() | g["polys"].isNotNull(),
            make_parts(
                kind,
                F.coalesce(g["points"], empty_list(NO_POINTS)),
                F.coalesce(g["lines"], empty_list(NO_LINES)),
                F.coalesce(g["polys"], empty_list(NO_POLYS)),
            ),
        ),
    )


def _members(text: Column) -> Column:
    """All geometries of a collection, nested ones included; null when nested too deeply."""
    is_group = lambda x: F.coalesce(F.get_json_object(x, "$.type") == "GeometryCollection", F.lit(False))
    inner = lambda x: F.coalesce(F.from_json(F.get_json_object(x, "$.geometries"), "array<string>"), F.array(F.lit("{}")))

    def open_up(nodes: Column, depth: int) -> Column:
        leaves = F.filter(nodes, lambda x: ~is_group(x))
        if not depth:
            return F.when(F.size(leaves) == F.size(nodes), leaves)
        return let(
            F.flatten(F.transform(F.filter(nodes, is_group), inner)),
            lambda below: F.when(F.size(below) == 0, leaves).otherwise(F.concat(leaves, open_up(below, depth - 1))),
        )

    return open_up(inner(text), COLLECTION_DEPTH)


def _collection(text: Column) -> Column:
    read = lambda leaves: F.transform(leaves, lambda x: _simple(F.get_json_object(x, "$.type"), F.get_json_object(x, "$.coordinates")))
    return let(
        read(_members(text)),
        lambda ms: F.when(
            ~F.exists(ms, lambda m: m.isNull()),
            make_parts(
                F.lit("GeometryCollection"),
                F.flatten(F.transform(ms, lambda m: m["points"])),
                F.flatten(F.transform(ms, lambda m: m["lines"])),
                F.flatten(F.transform(ms, lambda m: m["polys"])),
            ),
        ),
    )


def from_geojson(text: Column | str) -> Column:
    """Parts of a GeoJSON geometry; null when the structure is not valid."""
    g = _c(text)
    kind = F.get_json_object(g, "$.type")
    return F.when(kind == "GeometryCollection", _collection(g)).when(
        kind.isin(SIMPLE_TYPES), _simple(kind, F.get_json_object(g, "$.coordinates"))
    )


def to_geojson(parts: Column | str) -> Column:
    """GeoJSON text of the parts; mixed parts become a collection."""
    p = _c(parts)
    pts, lines, polys = p["points"], p["lines"], p["polys"]
    one = lambda kind, coords: F.to_json(F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")))
    kinds = (F.size(pts) > 0).cast("int") + (F.size(lines) > 0).cast("int") + (F.size(polys) > 0).cast("int")
    text = lambda kind, coords: F.concat(F.lit('{"type":"%s","coordinates":' % kind), F.to_json(coords), F.lit("}"))
    members = F.concat(
        F.transform(pts, lambda x: text("Point", x)),
        F.transform(lines, lambda x: text("LineString", x)),
        F.transform(polys, lambda x: text("Polygon", x)),
    )
    group = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.concat_ws(",", members), F.lit("]}"))
    simple = (
        F.when((F.size(polys) == 1) & (p["type"] != "MultiPolygon"), one("Polygon", polys[0]))
        .when(F.size(polys) > 0, one("MultiPolygon", polys))
        .when((F.size(lines) == 1) & (p["type"] != "MultiLineString"), one("LineString", lines[0]))
        .when(F.size(lines) > 0, one("MultiLineString", lines))
        .when((F.size(pts) == 1) & (p["type"] != "MultiPoint"), one("Point", pts[0]))
        .otherwise(one("MultiPoint", pts))
    )
    return F.when(p.isNotNull(), F.when((kinds > 1) | (p["type"] == "GeometryCollection"), group).otherwise(simple))


# ------------------------------------------------------------------ KML coordinates


def kml_positions(text: Column | str) -> Column:
    """``lon,lat[,alt]`` tuples to positions; one malformed tuple spoils the list."""
    s = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    tuples = F.transform(F.split(s, " "), lambda t: F.transform(F.slice(F.split(t, ","), 1, 2), lambda x: x.try_cast("double")))
    return F.when((F.length(s) > 0) & F.forall(tuples, _good_position), tuples)


def kml_positions_lenient(text: Column | str) -> Column:
    """The same, leaving out tuples that are malformed or out of range."""
    s = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    tuples = F.transform(F.split(s, " "), lambda t: F.transform(F.slice(F.split(t, ","), 1, 2), lambda x: x.try_cast("double")))
    good = lambda p: _good_position(p) & (F.abs(p[0]) <= 180) & (F.abs(p[1]) <= 90)
    return F.filter(tuples, lambda p: F.coalesce(good(p), F.lit(False)))


# ------------------------------------------------------------------ measures


def all_positions(parts: Column | str) -> Column:
    p = _c(parts)
    return F.concat(p["points"], F.flatten(p["lines"]), F.flatten(F.flatten(p["polys"])))


def bbox(parts: Column | str) -> Column:
    """``struct<min_lon, min_lat, max_lon, max_lat>``; null without positions."""

    def box(axes: Column) -> Column:
        return F.struct(
            F.array_min(axes["x"]).alias("min_lon"),
            F.array_min(axes["y"]).alias("min_lat"),
            F.array_max(axes["x"]).alias("max_lon"),
            F.array_max(axes["y"]).alias("max_lat"),
        )

    axes = lambda pos: F.struct(F.transform(pos, lambda q: q[0]).alias("x"), F.transform(pos, lambda q: q[1]).alias("y"))
    return let(all_positions(parts), lambda pos: F.when(F.size(pos) > 0, let(axes(pos), box)))


def _segments(ring: Column) -> Column:
    """Consecutive position pairs as ``struct<a, b>``."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + f(x))


def _mean(positions: Column, axis: int) -> Column:
    return _total(positions, lambda q: q[axis]) / F.greatest(F.lit(1), F.size(positions))


def ring_moments(ring: Column) -> Column:
    """``struct<area, x, y>``: area and centroid of a ring; a flat ring has area 0."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, s: Column) -> Column:
        return let(
            s["a"][0] * s["b"][1] - s["b"][0] * s["a"][1],
            lambda k: F.struct(
                (acc["a"] + k).alias("a"),
                (acc["x"] + (s["a"][0] + s["b"][0]) * k).alias("x"),
                (acc["y"] + (s["a"][1] + s["b"][1]) * k).alias("y"),
            ),
        )

    flat = F.struct(F.lit(0.0).alias("area"), _mean(ring, 0).alias("x"), _mean(ring, 1).alias("y"))
    whole = lambda t: F.struct(
        F.abs(t["a"] / 2).alias("area"), F.try_divide(t["x"], 3 * t["a"]).alias("x"), F.try_divide(t["y"], 3 * t["a"]).alias("y")
    )
    return let(F.aggregate(_segments(ring), zero, step), lambda t: F.when(t["a"] == 0, flat).otherwise(whole(t)))


def _polygon_moments(polys: Column) -> Column:
    """``struct<area, x, y>`` summed over rings, holes taken off; x and y are weighted by area."""
    signed = F.flatten(
        F.transform(
            polys,
            lambda rings: F.transform(
                rings, lambda r, i: F.struct(F.when(i == 0, 1.0).otherwise(-1.0).alias("sign"), ring_moments(r).alias("m"))
            ),
        )
    )
    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(
        signed,
        zero,
        lambda acc, r: let(
            r["sign"] * r["m"]["area"],
            lambda w: F.struct((acc["area"] + w).alias("area"), (acc["x"] + w * r["m"]["x"]).alias("x"), (acc["y"] + w * r["m"]["y"]).alias("y")),
        ),
    )


def area(parts: Column | str) -> Column:
    return _polygon_moments(_c(parts)["polys"])["area"]


def centroid(parts: Column | str) -> Column:
    """Reference point ``[lon, lat]``: by area, else by length, else the mean of the points."""
    p = _c(parts)
    mean_of = lambda pos: F.when(F.size(pos) > 0, F.array(_mean(pos, 0), _mean(pos, 1)))
    by_area = let(
        _polygon_moments(p["polys"]),
        lambda t: F.when(t["area"] > 0, F.array(F.try_divide(t["x"], t["area"]), F.try_divide(t["y"], t["area"]))).otherwise(
            let(F.flatten(F.flatten(p["polys"])), mean_of)
        ),
    )
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    along = F.aggregate(
        F.flatten(F.transform(p["lines"], _segments)),
        zero,
        lambda acc, s: let(
            F.hypot(s["b"][0] - s["a"][0], s["b"][1] - s["a"][1]),
            lambda d: F.struct(
                (acc["d"] + d).alias("d"),
                (acc["x"] + d * (s["a"][0] + s["b"][0]) / 2).alias("x"),
                (acc["y"] + d * (s["a"][1] + s["b"][1]) / 2).alias("y"),
            ),
        ),
    )
    first = let(F.get(F.flatten(p["lines"]), F.lit(0)), lambda q: F.when(q.isNotNull(), F.array(q[0], q[1])))
    by_length = let(along, lambda t: F.when(t["d"] > 0, F.array(F.try_divide(t["x"], t["d"]), F.try_divide(t["y"], t["d"]))).otherwise(first))
    return F.when(F.size(p["polys"]) > 0, by_area).when(F.size(p["lines"]) > 0, by_length).otherwise(mean_of(p["points"]))


def _edges(ring: Column) -> Column:
    """Edges of a closed ring as ``struct<x0, y0, x1, y1>``."""
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edge = lambda a, b: F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"))
    return F.zip_with(ring, shifted, edge)


def polygon_edges(parts: Column | str) -> Column:
    """Edges per polygon and ring, prepared once for many point tests."""
    return F.transform(_c(parts)["polys"], lambda rings: F.transform(rings, _edges))


def _encloses(edges: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test: an odd number of edges lies to the right of the point."""
    crossed = lambda e: ((e["y0"] > lat) != (e["y1"] > lat)) & (
        lon < F.try_divide((e["x1"] - e["x0"]) * (lat - e["y0"]), e["y1"] - e["y0"]) + e["x0"]
    )
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != F.coalesce(crossed(e), F.lit(False)))


def edges_contain(edges: Column | str, lon: Column, lat: Column) -> Column:
    """The point is inside some outer ring and in none of that polygon's holes."""
    return F.exists(
        _c(edges),
        lambda rings: F.coalesce(
            _encloses(F.get(rings, F.lit(0)), lon, lat)
            & ((F.size(rings) == 1) | ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda h: _encloses(h, lon, lat))),
            F.lit(False),
        ),
    )


def ring_contains(ring: Column, lon: Column, lat: Column) -> Column:
    return _encloses(_edges(ring), lon, lat)


def contains(parts: Column | str, lon: Column, lat: Column) -> Column:
    return edges_contain(polygon_edges(parts), lon, lat)


PROBLEMS = ("not_numeric", "projected", "out_of_range", "point_at_zero", "short_ring", "open_ring")


def validate(parts: Column | str) -> Column:
    """Codes of the problems of a geometry; nothing is corrected."""
    p = _c(parts)
    pos = all_positions(p)
    bad = lambda q: q[0].isNull() | q[1].isNull() | F.isnan(q[0]) | F.isnan(q[1]) | (F.abs(q[0]) == float("inf")) | (F.abs(q[1]) == float("inf"))
    far = lambda q: ~bad(q) & ((F.abs(q[0]) > 1000) | (F.abs(q[1]) > 1000))
    out = lambda q: ~bad(q) & ~far(q) & ((F.abs(q[0]) > 180) | (F.abs(q[1]) > 90))
    rings = F.flatten(p["polys"])
    short = lambda r: F.size(r) < 4
    first, last = (lambda r: F.get(r, F.lit(0))), (lambda r: F.get(r, F.size(r) - 1))
    unclosed = lambda r: ~short(r) & ((first(r)[0] != last(r)[0]) | (first(r)[1] != last(r)[1]))
    checks = [
        F.exists(pos, bad),
        F.exists(pos, far),
        F.exists(pos, out),
        F.exists(p["points"], lambda q: (q[0] == 0) & (q[1] == 0)),
        F.exists(rings, short),
        F.exists(rings, unclosed),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in zip(checks, PROBLEMS)]))


def survey_point(parts: Column | str) -> Column:
    """Map point of a survey record: the middle vertex of a line, the vertex mean of a polygon."""
    p = _c(parts)
    line = F.get(p["lines"], F.lit(0))
    ring = F.get(F.get(p["polys"], F.lit(0)), F.lit(0))
    n = F.size(ring)
    head, tail = F.get(ring, F.lit(0)), F.get(ring, n - 1)
    closed = (n > 1) & (head[0] == tail[0]) & (head[1] == tail[1])
    open_ring = F.when(closed, F.slice(ring, 1, n - 1)).otherwise(ring)
    return (
        F.when(F.size(p["points"]) > 0, F.get(p["points"], F.lit(0)))
        .when(F.size(line) > 0, F.get(line, F.floor(F.size(line) / 2).cast("int")))
        .when(n > 0, F.array(_mean(open_ring, 0), _mean(open_ring, 1)))
    )


def metres_apart(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Local flat distance; a missing coordinate counts as no distance."""
    dy = (lat_a - lat_b) * V.METRES_PER_DEGREE
    dx = (lon_a - lon_b) * V.METRES_PER_DEGREE * F.cos(F.radians(lat_a))
    return F.coalesce(F.hypot(dx, dy), F.lit(0.0))


def rounded(parts: Column | str, digits: int = 5) -> Column:
    p = _c(parts)
    pos = lambda q: F.transform(q, lambda x: round_half_up(x, digits))
    line = lambda r: F.transform(r, pos)
    return F.when(
        p.isNotNull(),
        make_parts(
            p["type"],
            F.transform(p["points"], pos),
            F.transform(p["lines"], line),
            F.transform(p["polys"], lambda g: F.transform(g, line)),
        ),
    )


def in_plausible_area(lon: Column, lat: Column, box: dict[str, float] = V.PLAUSIBLE_BOX) -> Column:
    return lon.between(box["min_lon"], box["max_lon"]) & lat.between(box["min_lat"], box["max_lat"])
