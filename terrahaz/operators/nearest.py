"""Nearest-site and within-radius search as equi-joins.

Comparing every point with every site is what makes these operators explode,
so sites are summarised as nested boxes: buckets of power-of-two size holding
the tight bounds of the sites inside and one of them as representative.

*Nearest*: the points are gathered into nested tiles, and tiles and boxes are
descended together: pairs of the outermost ones, a few hundred at most on the
globe, are opened in turns, the tile, then the box.  A pair is dropped when the
box's nearest corner is farther from the tile than some representative can be;
bounds found for a tile hold for the tiles inside.  So the true nearest site
always survives, the answer is exact at any distance, and no tile meets boxes
that its enclosing tile has done with.  The points then meet only the boxes left
for their tile, drop those too far for them, and open the rest.

*Radius*: a point looks up the few buckets its circle touches.  Boxes wholly
inside the circle contribute their pre-summed totals, boxes wholly outside
nothing, and only boxes cut by the rim are opened site by site.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds are widened by this relative amount so float error never loses a box.
_SLACK = 1e-9


@dataclass(frozen=True)
class Layout:
    """How coordinates are cut into boxes.

    ``world`` covers every coordinate; ``sizes`` are the box sizes inside it,
    outermost first; tiles have the same sizes down to ``tile``.
    """

    world: float
    sizes: tuple[float, ...]
    tile: float
    metric: str

    @property
    def tiles(self) -> list[float]:
        return [s for s in self.sizes if s >= self.tile]

    def bucket(self, value: str, size: float) -> str:
        """SQL text; shifted so that all bucket numbers are >= 0 and the world's is 0."""
        return f"floor(({value} + {self.world / 2!r}D) / {size!r}D)"


# at most 45 x 23 boxes of 8 degrees, and 64 boxes of one degree in each
DEGREES = Layout(1024.0, (8.0, 1.0), 1.0, "l1")
# about 100 cubes of 4096 km touch the globe
KILOMETRES = Layout(32768.0, (4096.0, 256.0, 32.0, 8.0, 2.0), 8.0, "l2")


def _combine(parts: list[str], metric: str) -> str:
    return " + ".join(parts) if metric == "l1" else f"sqrt({' + '.join(f'{p} * {p}' for p in parts)})"


def _closest(axes: list[str], metric: str, low: str = "q_", high: str = "q_") -> str:
    """Least distance from the query to a site of the box."""
    return _combine([f"greatest(0E0, lo_{a} - {high}{a}, {low}{a} - hi_{a})" for a in axes], metric)


def _farthest(axes: list[str], metric: str) -> str:
    """Greatest distance from the point to a site of the box."""
    return _combine([f"greatest(hi_{a} - q_{a}, q_{a} - lo_{a})" for a in axes], metric)


def _assured(axes: list[str], metric: str, low: str = "q_", high: str = "q_") -> str:
    """The box's representative is at most this far from any part of the query."""
    return _combine([f"greatest(rep_{a} - {low}{a}, {high}{a} - rep_{a})" for a in axes], metric)


@dataclass(frozen=True)
class _Descent:
    """Steps of one search.  Expressions are SQL text, which plans much faster than columns built one by one."""

    group: list[str]
    axes: list[str]
    layout: Layout

    def named(self, *prefixes: str) -> list[str]:
        return [f"{p}_{a}" for a in self.axes for p in prefixes]

    def renamed(self, old: str, new: str) -> list[str]:
        return [f"{old}_{a} AS {new}_{a}" for a in self.axes]

    def buckets(self, prefix: str, key: str, size: float) -> list[str]:
        return [f"{self.layout.bucket(f'{prefix}{a}', size)} AS {key}_{a}" for a in self.axes]

    def boxes(self, sites: DataFrame) -> list[DataFrame]:
        """One table per size, outermost first: group, bucket ``b_``, enclosing bucket ``up_``,
        bounds, and as representative the site nearest the middle.

        Plain number aggregates, combined before the shuffle; the same order decides
        for every axis, so a representative's coordinates belong to one site.
        """
        tables = []
        for coarser, size in zip((self.layout.world, *self.layout.sizes), self.layout.sizes):
            off = " + ".join(f"abs({a} - ((b_{a} + 0.5E0) * {size!r}D - {self.layout.world / 2!r}D))" for a in self.axes)
            shift = int(coarser / size).bit_length() - 1
            keyed = sites.selectExpr(*self.group, *self.axes, *self.buckets("", "b", size))
            boxes = keyed.groupBy(*self.group, *self.named("b")).agg(*[F.expr(e) for a in self.axes for e in (
                f"min({a}) AS lo_{a}", f"max({a}) AS hi_{a}", f"min_by({a}, {off}) AS rep_{a}")])
            tables.append(boxes.selectExpr("*", *[f"shiftright(b_{a}, {shift}) AS up_{a}" for a in self.axes]))
        return tables

    def tiles(self, points: DataFrame) -> list[DataFrame]:
        """One table per tile size, outermost first: group, bucket ``t_``, enclosing bucket ``p_``, the points' bounds."""
        tables = []
        for coarser, size in zip((self.layout.world, *self.layout.tiles), self.layout.tiles):
            shift = int(coarser / size).bit_length() - 1
            keyed = points.selectExpr(*self.group, *self.named("q"), *self.buckets("q_", "t", size))
            tiles = keyed.groupBy(*self.group, *self.named("t")).agg(*[F.expr(e) for a in self.axes for e in (
                f"min(q_{a}) AS q_lo_{a}", f"max(q_{a}) AS q_hi_{a}")])
            tables.append(tiles.selectExpr("*", *[f"shiftright(t_{a}, {shift}) AS p_{a}" for a in self.axes]))
        return tables

    def pruned(self, pairs: DataFrame, here: list[str], low: str, high: str, keep: list[str]) -> DataFrame:
        """Pairs that can hold the nearest site; ``_best`` is lowered to what the pairs with equal ``here`` assure.

        What the enclosing tile assures drops most pairs before any sort.  ``here``
        contains the keys of the join that made the pairs: no shuffle of its own.
        """
        near, sure = _closest(self.axes, self.layout.metric, low, high), _assured(self.axes, self.layout.metric, low, high)
        slack = f"* {1 + _SLACK!r}D + {_SLACK!r}D"
        low_of = f"least(_best, min({sure}) OVER (PARTITION BY {', '.join([*self.group, *here])})) AS _low"
        return (pairs.selectExpr("*", f"{near} AS _near").where(f"_near <= _best {slack}").selectExpr("*", low_of)
                .where(f"_near <= _low {slack}").selectExpr(*keep, "_low AS _best"))


def nearest_candidates(points: DataFrame, sites: DataFrame, group: list[str], axes: list[str],
                       layout: Layout) -> DataFrame:
    """Pairs (point, site) that can be nearest; the nearest is always among them.

    ``points``: group, ``q_<axis>`` and anything else, distinct positions.
    ``sites``: group, the axes and any payload, distinct.  Points of a group
    without sites drop out.
    """
    d = _Descent(group, axes, layout)
    tile, box, above, up = d.named("t"), d.named("b"), d.named("p"), d.named("up")
    parts, span = d.named("lo", "hi", "rep"), d.named("q_lo", "q_hi")
    boxes, tiles = d.boxes(sites), d.tiles(points)
    pair = [*group, *tile, *box, *span, *parts]
    # all outermost tiles and boxes lie in one world, bucket 0
    outermost = tiles[0].selectExpr(*group, *tile, *span, *d.renamed("p", "up"), "double('infinity') AS _best")
    front = d.pruned(outermost.join(boxes[0], [*group, *up]), [*up, *tile], "q_lo_", "q_hi_", pair)
    for finer, inner in zip(tiles[1:], boxes[1:]):
        opened = front.selectExpr(*group, *box, *parts, "_best", *d.renamed("t", "p"))
        front = d.pruned(opened.join(finer, [*group, *above]), [*above, *tile], "q_lo_", "q_hi_", pair)
        opened = front.selectExpr(*group, *tile, *span, "_best", *d.renamed("b", "up"))
        front = d.pruned(opened.join(inner, [*group, *up]), [*up, *tile], "q_lo_", "q_hi_", pair)
    held, own = [f"`{c}`" for c in points.columns], d.named("q")
    tiled = points.selectExpr("*", *d.buckets("q_", "t", layout.tile))
    front = d.pruned(tiled.join(front.selectExpr(*group, *tile, *box, *parts, "_best"), [*group, *tile]), [*own, *tile], "q_", "q_", [*held, *box])
    for inner in boxes[len(tiles):]:
        opened = front.selectExpr(*held, "_best", *d.renamed("b", "up"))
        front = d.pruned(opened.join(inner, [*group, *up]), [*own, *up], "q_", "q_", [*held, *box])
    located = sites.selectExpr("*", *d.buckets("", "b", layout.sizes[-1]))
    return front.selectExpr(*held, *box).join(located, [*group, *box]).drop(*box)


def nearest_sites(points: DataFrame, sites: DataFrame, pairs: dict[str, str], group: list[str] | None = None,
                  prefer: str = "smaller") -> DataFrame:
    """Nearest site by summed absolute coordinate difference, per group.

    ``pairs`` maps point columns to site columns.  Both inputs must hold
    distinct coordinates.  Equal distances go to the smaller coordinates (or
    the larger ones).  Returns the point columns, group, site columns and
    ``distance``.
    """
    group = list(group or [])
    key, found_at = list(pairs), list(pairs.values())
    axes = [f"a{i}" for i in range(len(pairs))]
    found = nearest_candidates(
        points.select(*group, *key, *[F.col(p).alias(f"q_{a}") for a, p in zip(axes, key)]),
        sites.select(*group, *found_at, *[F.col(s).alias(a) for a, s in zip(axes, found_at)]),
        group, axes, DEGREES)
    gap = reduce(Column.__add__, [F.abs(F.col(s) - F.col(p)) for p, s in pairs.items()])
    sign = -1.0 if prefer == "larger" else 1.0
    best = found.groupBy(*key, *group).agg(F.min(F.struct(
        gap.alias("gap"), *[(F.col(s) * sign).alias(s) for s in found_at])).alias("_best"))
    return best.select(*key, *group, *[(F.col(f"_best.{s}") * sign).alias(s) for s in found_at],
                       F.col("_best.gap").alias("distance"))


def nearest_cell(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Cell for each point.  ``points``: point_id, lat, lng; ``cells``: lat, lng.

    Points sharing a position are looked up once.
    """
    spots = points.select(F.col("lat").alias("at_lat"), F.col("lng").alias("at_lng"))
    match = nearest_sites(
        spots.distinct(), cells.select(F.col("lat").alias("cell_lat"), F.col("lng").alias("cell_lng")).distinct(),
        {"at_lat": "cell_lat", "at_lng": "cell_lng"})
    return points.join(match, (F.col("lat") == F.col("at_lat")) & (F.col("lng") == F.col("at_lng"))).select(
        "point_id", "cell_lat", "cell_lng")


def radius_pieces(points: DataFrame, sites: DataFrame, group: list[str], axes: list[str],
                  reach: float, totals: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Boxes of sites within ``reach`` of each point, in two parts.

    First part: whole boxes, one row per (point, box) with the pre-aggregated
    ``totals`` and the columns ``near_km``/``far_km`` (straight-line bounds).
    Second part: the sites keyed by their box, for opening boxes the caller
    cannot decide.  Join the two on group and ``b_<axis>``.
    """
    cube = 2.0 ** int(reach).bit_length()
    leaf = cube / 16
    layout = KILOMETRES
    keyed = sites.withColumns({f"b_{a}": F.expr(layout.bucket(a, leaf)) for a in axes})
    bkeys = [f"b_{a}" for a in axes]
    bounds = [F.expr(f"{f}({a}) AS {side}_{a}") for a in axes for f, side in (("min", "lo"), ("max", "hi"))]
    boxes = keyed.groupBy(*group, *bkeys).agg(*bounds, *totals)
    boxes = boxes.withColumns({f"c_{a}": F.expr(f"shiftright(b_{a}, 4)") for a in axes})
    asking = points
    for a in axes:
        low, high = layout.bucket(f"q_{a} - {reach!r}D", cube), layout.bucket(f"q_{a} + {reach!r}D", cube)
        asking = asking.withColumn(f"c_{a}", F.expr(f"explode(sequence({low}, {high}))"))
    met = asking.join(boxes, [*group, *[f"c_{a}" for a in axes]]).withColumns(
        {"near_km": F.expr(_closest(axes, "l2")), "far_km": F.expr(_farthest(axes, "l2"))})
    scratch = [c for a in axes for c in (f"c_{a}", f"lo_{a}", f"hi_{a}")]
    return met.where(F.col("near_km") <= reach * (1 + _SLACK)).drop(*scratch), keyed
