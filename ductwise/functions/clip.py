"""Where a segment meets rings and lies inside them: columns over arrays, for concave rings, holes and several parts alike.

A polygon is an array of closed rings (each an array of structs x, y); a place is inside if an odd number of rings hold it, so
holes and separate parts need no order. The border counts as inside. Parameters run from 0 at a segment's start to 1 at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwise.functions import geometry as geo

#: Parameters closer than this are one place.
SAME = 1e-12
Ends = tuple[Column, Column, Column, Column]


def common_part(s: Ends, e: Ends) -> tuple[Column, Column, Column]:
    """(low, high, along): the parameters on s between which it lies on e, one place unless both lie on one line; null if they have no point in common."""
    ax, ay, bx, by = (c.cast("double") for c in s)
    cx, cy, ex, ey = (c.cast("double") for c in e)
    dx, dy, ux, uy, px, py = bx - ax, by - ay, ex - cx, ey - cy, cx - ax, cy - ay
    length2, cross = dx * dx + dy * dy, dx * uy - dy * ux
    parallel = F.abs(cross) < SAME * F.sqrt(length2 * (ux * ux + uy * uy)) + 1e-18
    one_line = parallel & (length2 > 0) & (F.abs(px * dy - py * dx) <= 1e-9 * F.sqrt(length2) + SAME)
    t0, t1 = (px * dx + py * dy) / F.nullif(length2, F.lit(0.0)), ((ex - ax) * dx + (ey - ay) * dy) / F.nullif(length2, F.lit(0.0))
    low, high = F.greatest(F.lit(0.0), F.least(t0, t1)), F.least(F.lit(1.0), F.greatest(t0, t1))
    over = F.nullif(cross, F.lit(0.0))
    t, u = (px * uy - py * ux) / over, (px * dy - py * dx) / over
    meets = ~parallel & t.between(-SAME, 1 + SAME) & u.between(-SAME, 1 + SAME)
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.when(one_line & (low <= high), low).when(meets, held), F.when(one_line & (low <= high), high).when(meets, held), one_line


def edges(rings: Column) -> Column:
    """All edges of all rings as structs ax, ay, bx, by."""
    edge = lambda r, i: F.struct(*[F.get(r, i - d)[c].cast("double").alias(f"{p}{c}") for p, d in (("a", 1), ("b", 0)) for c in "xy"])
    one = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda i: edge(r, i))
    return F.filter(F.flatten(F.transform(rings, one)), lambda e: e.bx.isNotNull())


def kept(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns as a generated row, so each is worked out once: a plain column is written out again at every place that names it, also inside lambdas that run many times."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd test against all edges."""
    crossed = F.filter(edges, lambda e: ((e.ay > y) != (e.by > y)) & (x < (e.bx - e.ax) * (y - e.ay) / F.nullif(e.by - e.ay, F.lit(0.0)) + e.ax))
    return F.size(crossed) % 2 == 1


def in_rings(rings: Column, x: Column, y: Column) -> Column:
    """Whether an odd number of the rings hold a place."""
    return F.size(F.filter(rings, lambda r: geo.ring_contains(r, x, y))) % 2 == 1


def with_hits(df: DataFrame, segment: tuple[str, str, str, str], rings: str, out: str = "hits") -> DataFrame:
    """Adds `out`: structs (t, ex, ey) in order of t, where the segment meets an edge of the rings and which way that edge runs; an edge along the segment gives its two ends."""
    s = tuple(F.col(c) for c in segment)

    def met(e: Column) -> Column:
        low, high, along = common_part(s, (e.ax, e.ay, e.bx, e.by))
        one = lambda t: F.struct(t.alias("t"), (e.bx - e.ax).alias("ex"), (e.by - e.ay).alias("ey"))
        return F.when(low.isNull(), F.array().cast("array<struct<t:double,ex:double,ey:double>>")).when(along, F.array(one(low), one(high))).otherwise(F.array(one(low)))

    return df.withColumn(out, F.array_sort(F.flatten(F.transform(edges(F.col(rings)), met))))


def with_inside(df: DataFrame, segment: tuple[str, str, str, str], rings: str, out: str = "inside") -> DataFrame:
    """Adds `out`: structs (low, high), the stretches of the segment inside the rings, border included, in order. Touching stretches are one; a segment without length has none."""
    ax, ay, bx, by = (F.col(c).cast("double") for c in segment)
    kind = "array<struct<low:double,high:double>>"

    def part(e: Column) -> Column:
        low, high, along = common_part((ax, ay, bx, by), (e.ax, e.ay, e.bx, e.by))
        return F.struct(low.alias("low"), high.alias("high"), along.alias("along"))

    rows = kept(df, _e=edges(F.col(rings)))
    rows = kept(kept(rows, _q=F.transform("_e", part)), _p=F.filter("_q", lambda p: p.low.isNotNull()))
    ends = F.flatten(F.transform("_p", lambda p: F.array(p.low, p.high)))
    rows = kept(rows, _t=F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), ends))))
    steps = F.zip_with(F.slice("_t", F.lit(1), F.size("_t") - 1), F.slice("_t", F.lit(2), F.size("_t") - 1), lambda a, b: F.struct(a.alias("low"), b.alias("high")))

    def held(s: Column) -> Column:
        mid = (s.low + s.high) / 2
        on_border = F.exists("_p", lambda p: p.along & (p.low <= mid) & (mid <= p.high))
        return (s.high - s.low >= SAME) & (on_border | _inside(F.col("_e"), ax + (bx - ax) * mid, ay + (by - ay) * mid))

    def joined(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        goes_on = (F.size(done) > 0) & (F.abs(F.try_element_at(done, F.lit(-1)).high - s.low) < SAME)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last.low.alias("low"), s.high.alias("high"))))
        return F.when(goes_on, longer).otherwise(F.concat(done, F.array(s)))

    rows = kept(rows, _s=F.when((ax == bx) & (ay == by), F.array().cast(kind)).otherwise(F.filter(steps, held)))
    return kept(rows, **{out: F.aggregate("_s", F.array().cast(kind), joined)}).drop("_e", "_q", "_p", "_t", "_s")


def length_inside(inside: Column) -> Column:
    """The part of the segment, from 0 to 1, that its stretches add up to."""
    return F.aggregate(inside, F.lit(0.0), lambda a, s: a + s.high - s.low)


def segment_distance(s: Ends, e: Ends) -> Column:
    """The least distance of two segments; 0 if they have a point in common."""
    corners = [geo.point_segment_distance(s[0], s[1], *e), geo.point_segment_distance(s[2], s[3], *e), geo.point_segment_distance(e[0], e[1], *s), geo.point_segment_distance(e[2], e[3], *s)]
    return F.when(geo.segments_meet(s, e), 0.0).otherwise(F.least(*corners))
