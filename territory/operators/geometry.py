"""Planar geometry on arrays of points, in Catalyst expressions: no library, no Python on the rows.

Points are struct<x,y>; a line is an array of points, a ring a closed or open array of points. Rings are even-odd: a point
on a left or lower edge is inside, on a right or upper one outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


#: Most vertices of a ring that is written into a plan as literals; larger ones go with a function (``overlay``).
SMALL_RING = 64
#: How far apart places may be that count as one, by the size of the ring's coordinates.
TOL = 1e-11


def is_small_ring(outline) -> bool:
    """Is the outline one ring of few coordinate pairs?"""
    return len(outline) <= SMALL_RING and not isinstance(outline[0], list)


def ring_edges(ring: Ring) -> Column:
    """A literal ring as array<struct<cx,cy,dx,dy>>."""
    pts = ring if ring[0] != ring[-1] else ring[:-1]
    return F.array(*(F.struct(F.lit(float(a)).alias("cx"), F.lit(float(b)).alias("cy"), F.lit(float(c)).alias("dx"), F.lit(float(d)).alias("dy")) for (a, b), (c, d) in zip(pts, pts[1:] + pts[:1], strict=True)))


def edges_of(points: Column) -> Column:
    """The edges of a ring of points, the last point joined to the first."""
    n = F.size(points)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(points[i]["x"].alias("cx"), points[i]["y"].alias("cy"), points[(i + 1) % n]["x"].alias("dx"), points[(i + 1) % n]["y"].alias("dy")))


def crosses(e: Column, x: Column, y: Column) -> Column:
    """Does the ray from a point to the right cross an edge?"""
    return ((e["cy"] > y) != (e["dy"] > y)) & (x < (e["dx"] - e["cx"]) * (y - e["cy"]) / F.nullif(e["dy"] - e["cy"], F.lit(0.0)) + e["cx"])


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd test of a point against edges."""
    return F.size(F.filter(edges, lambda e: crosses(e, x, y))) % 2 == 1


def bbox_of(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def bbox_intersects(b: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    return (b["xmax"] >= xmin) & (b["xmin"] <= xmax) & (b["ymax"] >= ymin) & (b["ymin"] <= ymax)


def ring_bbox(ring: Ring) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return min(xs), min(ys), max(xs), max(ys)


def extent(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def clip_points(df: DataFrame, x: str, y: str, ring: Ring) -> DataFrame:
    """The points inside a ring; the box goes first and can be pushed to the scan."""
    a, b, c, d = ring_bbox(ring)
    return df.where(F.col(x).between(a, c) & F.col(y).between(b, d)).where(inside(F.col(x), F.col(y), ring_edges(ring)))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def tolerance(ring: Ring) -> float:
    """How far apart places may be that count as one."""
    return TOL * max(max(abs(float(x)), abs(float(y))) for x, y in ring)


def _turned(s: Column, e: Column) -> tuple[Column, Column]:
    """Of an edge's ends, the cross products with a segment's direction."""
    start = (e["cx"] - s["ax"]) * s["uy"] - (e["cy"] - s["ay"]) * s["ux"]
    return start, start + (e["dx"] - e["cx"]) * s["uy"] - (e["dy"] - e["cy"]) * s["ux"]


def _place(s: Column, x: Column, y: Column) -> Column:
    """Where a point stands along a segment."""
    return ((x - s["ax"]) * s["ux"] + (y - s["ay"]) * s["uy"]) / F.nullif(s["len"] * s["len"], F.lit(0.0))


def _along(s: Column, edges: Column, tol: float) -> Column:
    """The edges that lie on the segment's line and cover some of it, with the places from t0 to t1 that they cover."""

    def one(e: Column) -> Column:
        start, end = _turned(s, e)
        return (F.abs(start) <= tol * s["len"]) & (F.abs(end) <= tol * s["len"]) & (s["len"] > 0)

    def span(e: Column) -> Column:
        p, q = _place(s, e["cx"], e["cy"]), _place(s, e["dx"], e["dy"])
        return F.struct(*(e[k].alias(k) for k in ("cx", "cy", "dx", "dy")), F.least(p, q).alias("t0"), F.greatest(p, q).alias("t1"))

    return F.filter(F.transform(F.filter(edges, one), span), lambda e: (F.least(e["t1"], F.lit(1.0)) - F.greatest(e["t0"], F.lit(0.0))) * s["len"] > tol)


def _cuts(s: Column, edges: Column, along: Column, tol: float) -> Column:
    """Sorted parameters in [0, 1] at which a segment (ax, ay, ux, uy, len: start, direction and length) meets the edges and at
    which those along it begin and end, with both ends."""

    def cross(e: Column) -> Column:
        ex, ey, gx, gy = e["dx"] - e["cx"], e["dy"] - e["cy"], e["cx"] - s["ax"], e["cy"] - s["ay"]
        terms = F.struct(F.nullif(s["ux"] * ey - s["uy"] * ex, F.lit(0.0)).alias("dn"), (gx * ey - gy * ex).alias("t"), (gx * s["uy"] - gy * s["ux"]).alias("u"), (tol / F.nullif(F.hypot(ex, ey), F.lit(0.0))).alias("slack"))
        t = lambda q: q["t"] / q["dn"]
        lies = lambda q: (F.abs(q["u"]) <= tol * s["len"]) & (F.abs(q["u"] - q["dn"]) <= tol * s["len"])
        return _bind(terms, lambda q: F.when((t(q) > 0) & (t(q) < 1) & (q["u"] / q["dn"]).between(-q["slack"], 1 + q["slack"]) & ~lies(q), t(q)))

    met = F.array_compact(F.concat(F.transform(edges, cross), F.transform(along, lambda e: e["t0"]), F.transform(along, lambda e: e["t1"])))
    inner = F.array_sort(F.filter(met, lambda t: (t * s["len"] > tol) & ((1 - t) * s["len"] > tol)))
    apart = _bind(inner, lambda ts: F.filter(ts, lambda t, i: (i == 0) | ((t - F.get(ts, i - 1)) * s["len"] > tol)))
    return F.concat(F.array(F.lit(0.0)), apart, F.array(F.lit(1.0)))


def _kept(s: Column, x: Column, y: Column, edges: Column, own: Column, side: str) -> Column:
    """Does a stretch stay whose middle is x, y and on which the edges ``own`` lie? Off them: if it is inside. On them: if the
    inside is on its ``side``, which is "left", "open" (the half-open rule of points) or "none"."""
    if side == "none":
        return (F.size(own) == 0) & inside(x, y, edges)
    swapped = lambda es: F.transform(es, lambda e: F.struct(e["cy"].alias("cx"), e["cx"].alias("cy"), e["dy"].alias("dx"), e["dx"].alias("dy")))
    flat = F.abs(s["uy"]) <= F.abs(s["ux"])
    # a ray across the stretch, its own edges left out: inside above a flat stretch, on the right of a steep one
    beyond = F.when(flat, inside(y, x, swapped(edges)) != inside(y, x, swapped(own))).otherwise(inside(x, y, edges) != inside(x, y, own))
    other = beyond != (F.size(own) % 2 == 1)
    left = F.when(flat, s["ux"] > 0).otherwise(s["uy"] < 0)
    wants_left = F.lit(True) if side == "left" else (s["uy"] < 0) | ((s["uy"] == 0) & (s["ux"] > 0))
    return F.when(F.size(own) == 0, inside(x, y, edges)).when(left == wants_left, beyond).otherwise(other)


def _pieces(points: Column, edges: Column, tol: float, side: str, closed: bool = False) -> Column:
    """array<struct<t1,t2,sx,sy,ex,ey>>: the stretches of a line, or of a ring, inside the edges; t counts segments. What lies
    on the edges stays by ``side`` (``_kept``)."""
    n = F.size(points)
    last = n - 1 if closed else n - 2

    def segment(i: Column) -> Column:
        a, b = points[i], points[(i + 1) % n]
        ux, uy = b["x"] - a["x"], b["y"] - a["y"]
        whole = F.struct(a["x"].alias("ax"), a["y"].alias("ay"), ux.alias("ux"), uy.alias("uy"), F.hypot(ux, uy).alias("len"))

        def stretches(s: Column, along: Column) -> Column:
            def one(ts: Column, k: Column) -> Column:
                mid = (ts[k] + ts[k + 1]) / 2
                own = F.filter(along, lambda e: mid.between(e["t0"], e["t1"]))
                m = F.struct((s["ax"] + mid * s["ux"]).alias("x"), (s["ay"] + mid * s["uy"]).alias("y"), own.alias("own"))
                x, y = lambda t: s["ax"] + t * s["ux"], lambda t: s["ay"] + t * s["uy"]
                piece = F.struct((i + ts[k]).alias("t1"), (i + ts[k + 1]).alias("t2"), x(ts[k]).alias("sx"), y(ts[k]).alias("sy"), x(ts[k + 1]).alias("ex"), y(ts[k + 1]).alias("ey"))
                return F.when(_bind(m, lambda q: _kept(s, q["x"], q["y"], edges, q["own"], side)), piece)

            return _bind(_cuts(s, edges, along, tol), lambda ts: F.array_compact(F.transform(F.sequence(F.lit(0), F.size(ts) - 2), lambda k: one(ts, k))))

        return _bind(whole, lambda s: _bind(_along(s, edges, tol), lambda along: stretches(s, along)))

    none = "array<struct<t1:double,t2:double,sx:double,sy:double,ex:double,ey:double>>"
    return F.when(n >= 2, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), segment))).otherwise(F.array().cast(none))


def clip_lines(df: DataFrame, points: str, ring: Ring) -> DataFrame:
    """Lines cut to a ring: ``pieces`` (stretches inside, in order), ``parts`` (runs of stretches that touch, as points),
    ``length``. Lines with nothing inside go; along an edge they are half-open, as points are. Row by row: nothing is shuffled."""
    a, b, c, d = ring_bbox(ring)
    near = df.where(bbox_intersects(bbox_of(F.col(points)), a, b, c, d))
    empty = F.array().cast("array<struct<pts:array<struct<x:double,y:double>>,t2:double>>")

    def grow(parts: Column, p: Column) -> Column:
        s, e = F.struct(p["sx"].alias("x"), p["sy"].alias("y")), F.struct(p["ex"].alias("x"), p["ey"].alias("y"))
        n = F.size(parts)
        last = parts[n - 1]
        joined = F.concat(F.slice(parts, 1, n - 1), F.array(F.struct(F.concat(last["pts"], F.array(e)).alias("pts"), p["t2"].alias("t2"))))
        new = F.concat(parts, F.array(F.struct(F.array(s, e).alias("pts"), p["t2"].alias("t2"))))
        return F.when(n == 0, new).when(last["t2"] == p["t1"], joined).otherwise(new)

    def told(pieces: Column) -> Column:
        parts = F.transform(F.aggregate(pieces, empty, grow), lambda x: x["pts"])
        length = F.aggregate(pieces, F.lit(0.0), lambda s, p: s + F.hypot(p["ex"] - p["sx"], p["ey"] - p["sy"]))
        return F.struct(pieces.alias("pieces"), F.size(parts).alias("n_parts"), length.alias("length"), parts.alias("parts"))

    return _once(near, _pieces(F.col(points), ring_edges(ring), tolerance(ring), "open"), told)


def _once(df: DataFrame, pieces: Column, told) -> DataFrame:
    """Rows with the fields of ``told(pieces)``, the pieces being computed once a row; rows without pieces go."""
    some = F.filter(F.array(pieces), lambda p: F.size(p) > 0)
    return df.select("*", F.explode(F.transform(some, told)).alias("__c")).select(*(F.col(c) for c in df.columns), "__c.*")


def clip_polygons(df: DataFrame, points: str, ring: Ring) -> DataFrame:
    """Rings (counter-clockwise) cut to a ring: the kept edges of both outlines, and the area they enclose.

    Both outlines keep their direction, so the area needs no assembly. Of edges that both share those of the ring column stay
    where both insides are on one side, and none where they only touch.
    """
    a, b, c, d = ring_bbox(ring)
    pts = ring if ring[0] != ring[-1] else ring[:-1]
    over = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts))
    near = df.where(bbox_intersects(bbox_of(F.col(points)), a, b, c, d))
    tol = tolerance(ring)
    edges = F.concat(_pieces(F.col(points), ring_edges(ring), tol, "left", True), _pieces(over, edges_of(F.col(points)), tol, "none", True))
    area = lambda x: F.aggregate(x, F.lit(0.0), lambda s, e: s + e["sx"] * e["ey"] - e["ex"] * e["sy"]) / 2
    return _once(near, edges, lambda x: F.struct(x.alias("edges"), area(x).alias("area")))


def endpoints(df: DataFrame, parts: str) -> DataFrame:
    """(x, y): the distinct first and last points of all parts; parts without points have none."""
    p = df.select(F.explode(parts).alias("p")).where(F.size("p") > 0)
    return p.select(F.explode(F.array(F.element_at("p", 1), F.element_at("p", -1))).alias("e")).select((F.col("e.x") + 0.0).alias("x"), (F.col("e.y") + 0.0).alias("y")).distinct()


def cells(xmin: Column, ymin: Column, xmax: Column, ymax: Column, size: float) -> Column:
    """All grid cells (struct<i,j>) that a box touches."""
    lo = lambda c: F.floor(c / size)
    return F.flatten(F.transform(F.sequence(lo(xmin), lo(xmax)), lambda i: F.transform(F.sequence(lo(ymin), lo(ymax)), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def _sides(points: Column) -> Column:
    """The edges of a ring that a ray to the right can cross: not level, with all coordinates."""
    return F.filter(edges_of(points), lambda e: (e["cy"] != e["dy"]) & e["cx"].isNotNull() & e["dx"].isNotNull())


def _met_cells(points: Column, size: float) -> Column:
    """array<struct<i,j,odd,edges>>: the grid cells a ring may hold points of. For points of the cell, ``edges`` are those whose
    crossing is open, and ``odd`` tells whether an odd number of the others is crossed by every point's ray. Cells go by the
    quotient that puts points into them, which grows with the coordinate, so the parity is that of all edges to the last bit."""
    lo = lambda c: F.floor(c / size)

    def spanned(e: Column) -> Column:
        slack = F.when(e["cx"] == e["dx"], 0).otherwise(1)  # where a slanted edge is crossed is rounded
        x0, x1, y0, y1 = F.least(e["cx"], e["dx"]), F.greatest(e["cx"], e["dx"]), F.least(e["cy"], e["dy"]), F.greatest(e["cy"], e["dy"])
        return F.struct(e.alias("e"), (lo(x0) - slack).alias("i0"), (lo(x1) + slack).alias("i1"), lo(y0).alias("j0"), lo(y1).alias("j1"), F.isnan(e["cx"] + e["cy"] + e["dx"] + e["dy"]).alias("wild"))

    def told(c: Column, every: Column) -> Column:
        i, j = c["i"], c["j"]
        always = lambda s: ~s["wild"] & (i < s["i0"]) & (s["j0"] < j) & (j < s["j1"])
        may = lambda s: s["wild"] | (j.between(s["j0"], s["j1"]) & (i <= s["i1"]))
        open_ = F.transform(F.filter(every, lambda s: may(s) & ~always(s)), lambda s: s["e"])
        return F.struct(i.alias("i"), j.alias("j"), (F.size(F.filter(every, always)) % 2 == 1).alias("odd"), open_.alias("edges"))

    b = bbox_of(points)
    touched = cells(b["xmin"], b["ymin"], b["xmax"], b["ymax"], size)
    met = _bind(F.transform(_sides(points), spanned), lambda every: F.transform(touched, lambda c: told(c, every)))
    return F.filter(met, lambda c: c["odd"] | (F.size(c["edges"]) > 0))


#: Points of a grid cell that are joined as one group, and polygons as one part; more are dealt to several.
CROWD, PART = 20000, 1000


def grid_join(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, size: float) -> DataFrame:
    """Points with the polygons they are in, by an equi-join on grid cells and the exact test; ``ring`` is a column of points.

    A point is in one cell, so no pair comes twice. The test takes only the edges whose crossing is open in the cell: none in
    cells that a polygon covers, and up to two, as nearly everywhere else, in plain columns. Points of a crowded cell are dealt
    to groups of about ``CROWD``, its polygons to parts of about ``PART``, and each group meets each part, so that no task has a
    whole crowd and a point never meets more than a part at once. A part is in order of where its edges cut the cell, so that
    one point after the other is in the same runs of polygons, which files keep in far fewer bytes.
    """
    px, py = F.col(x), F.col(y)
    b = bbox_of(F.col(ring))
    put = points.where(~F.isnan(px) & ~F.isnan(py)).withColumn("__i", F.floor(px / size)).withColumn("__j", F.floor(py / size))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(b[lo] / size), F.floor(b[hi] / size)))
    touched = polygons.select(ring, span("xmin", "xmax").alias("__i")).select("__i", span("ymin", "ymax"), F.lit(0), F.lit(1))
    both = put.select("__i", "__j", F.lit(1).alias("__n"), F.lit(0).alias("__m")).unionAll(touched)
    crowds = both.groupBy("__i", "__j").agg(*(F.greatest(F.ceil(F.sum(c) / k), F.lit(1)).alias(c) for c, k in (("__n", CROWD), ("__m", PART)))).where("__n > 1 OR __m > 1")  # a row a crowd
    n, m = F.coalesce("__n", F.lit(1)), F.coalesce("__m", F.lit(1))

    def dealt(cut: DataFrame, rows: DataFrame, own: tuple[str, Column], others: tuple[str, Column]) -> DataFrame:
        """Rows of cells, each in one share of its own kind, beside all shares of the other."""
        of = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind)), own[1])
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), others[1] - 1))
        return cut.join(F.broadcast(crowds), ["__i", "__j"], "left").withColumn(own[0], of).withColumn(others[0], every).drop("__n", "__m")

    def met(some: DataFrame, *tests: Column) -> DataFrame:
        cut = some.select("*", F.explode(_met_cells(F.col(ring), size)).alias("__c")).select("*", F.col("__c.i").alias("__i"), F.col("__c.j").alias("__j"))
        return dealt(cut, polygons, ("__h", m), ("__g", n)).select("*", *tests).drop("__c")

    edges, odd = F.col("__c.edges"), F.col("__c.odd").alias("__odd")
    put = dealt(put, points, ("__g", n), ("__h", m))
    few = met(polygons, F.size(edges).alias("__k"), odd, F.get(edges, 0).alias("__a"), F.get(edges, 1).alias("__b")).where("__k <= 2")
    many = met(polygons.where(F.size(_sides(F.col(ring))) > 2), F.size(edges).alias("__k"), odd, edges.alias("__e")).where("__k > 2")
    crossed = lambda e: F.coalesce(crosses(F.col(e), px, py), F.lit(False))
    keys, own = ["__i", "__j", "__g", "__h"], ["__i", "__j", "__g", "__h", "__k", "__odd"]
    near = lambda c, k: F.least(F.greatest(F.col(c), F.col(k) * size), (F.col(k) + 1) * size)
    cuts = [near(f"{e}.{c}", k) for e in ("__a", "__b") for c, k in (("cx", "__i"), ("cy", "__j"), ("dy", "__j"))]
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("__k", "__odd", *cuts))
    few = few.withColumn("__r", order).where("__r > 0")  # numbered for the order alone, in which the join then takes them
    few, many = few.hint("merge"), many.hint("merge")  # what cells unfold to is not in Spark's estimates: never broadcast
    plain = put.join(few, keys).where((F.col("__odd") != crossed("__a")) != crossed("__b")).drop(*own, "__a", "__b", "__r")
    return plain.unionAll(put.join(many, keys).where(F.col("__odd") != inside(px, py, F.col("__e"))).drop(*own, "__e"))
