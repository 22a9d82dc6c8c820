"""Spatial joins of boxes and polygons as equi-joins on grid cells.

A range predicate alone makes Spark compare all rows with all rows. Here every box is dealt to the cells it covers,
rows meet by cell, the exact predicate decides, and a pair is reported in one of the cells it shares only, so that no
shuffle is needed to drop repeats. Dense cells are split by adaptive skew joins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascape.functions import polygons as P
from deltascape.functions.geometry import Box
from deltascape.plans.storage import join_groups, materialise

from .components import least_roots

CORNERS = ("x0", "y0", "x1", "y1")
#: Boxes of a cell that meet in one task at most are twice as many; a cell of more is dealt into parts, and all pairs of parts meet.
PART_BOXES = 20_000
#: In cells of at most this many boxes all pairs are compared at once.
FEW_BOXES = 64
RINGS = "array<array<struct<x:double,y:double>>>"


def as_rings(value) -> P.Rings:
    """Rings of a row's geometry column (array of rings of points), or of its JSON."""
    value = json.loads(value) if isinstance(value, str) else value
    return [np.array([(p["x"], p["y"]) if isinstance(p, dict) else (p[0], p[1]) for p in ring], float) for ring in value]


def _by_rows(f, nested: bool = True):
    """A vectorised function of columns from a function of a row's values; made when called, as workers import this too.

    Geometry goes to the workers as JSON: deeply nested arrays with nulls do not survive the way as Arrow.
    """

    def one(a: pd.Series) -> pd.Series:
        return pd.Series([f(x) for x in a], dtype=float)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    plain = lambda c: F.to_json(F.col(c) if isinstance(c, str) else c) if nested else c
    return lambda *columns: F.pandas_udf(one if len(columns) == 1 else two, "double")(*map(plain, columns))


def _boxes(row) -> list[tuple[float, float, float, float]]:
    return [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in row if b is not None] if row is not None else []


def _shapes(row: str | None) -> list[P.Rings]:
    return [as_rings(s) for s in json.loads(row) if s is not None] if row is not None else []


ring_distance = _by_rows(lambda a, b: P.distance(as_rings(a), as_rings(b)))
ring_overlap = _by_rows(lambda a, b: P.overlap_area(as_rings(a), [as_rings(b)]))
ring_area = _by_rows(lambda a: P.area(as_rings(a)))
#: Area that an array of boxes (structs x0, y0, x1, y1), or of polygons, covers; and of a polygon within several.
union_box_area = _by_rows(lambda row: covered(_boxes(row)), nested=False)
union_ring_area = _by_rows(lambda row: P.union_area(_shapes(row)))
overlap_of_many = _by_rows(lambda a, parts: P.overlap_area(as_rings(a), _shapes(parts)))


def covered(boxes: list[tuple[float, float, float, float]] | np.ndarray) -> float:
    """Area of the union of boxes: a sweep over x, with the covered length in y kept between events."""
    a = np.asarray(boxes, float).reshape(-1, 4)
    a = a[(a[:, 2] > a[:, 0]) & (a[:, 3] > a[:, 1])]
    if len(a) < 2:
        return float(((a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1])).sum())
    xs, ys = np.unique(a[:, [0, 2]]), np.unique(a[:, [1, 3]])
    rows = np.searchsorted(ys, a[:, 1]), np.searchsorted(ys, a[:, 3])
    steps = np.zeros(len(ys), np.int64)
    starts, ends = np.searchsorted(xs, a[:, 0]), np.searchsorted(xs, a[:, 2])
    total, high = 0.0, np.diff(ys)
    by_start, by_end = np.argsort(starts, kind="stable"), np.argsort(ends, kind="stable")
    i = j = 0
    for k in range(len(xs) - 1):
        while i < len(a) and starts[by_start[i]] == k:
            steps[rows[0][by_start[i]]] += 1
            steps[rows[1][by_start[i]]] -= 1
            i += 1
        while j < len(a) and ends[by_end[j]] == k:
            steps[rows[0][by_end[j]]] -= 1
            steps[rows[1][by_end[j]]] += 1
            j += 1
        total += (xs[k + 1] - xs[k]) * float(high[np.cumsum(steps)[:-1] > 0].sum())
    return total


@dataclass(frozen=True)
class Grid:
    """Cells of a given side. Choose two to four times a typical box."""

    side: float

    def cell(self, v: Column) -> Column:
        return F.floor(v / F.lit(float(self.side))).cast("long")

    def deal(self, df: DataFrame, box: Box, d: float = 0.0) -> DataFrame:
        """df once per cell (columns _cx, _cy) that its box, widened by d, covers."""
        across = F.sequence(self.cell(box.x0 - d), self.cell(box.x1 + d))
        upward = F.sequence(self.cell(box.y0 - d), self.cell(box.y1 + d))
        return df.withColumn("_cx", F.explode(across)).withColumn("_cy", F.explode(upward))


def near_pairs(left: DataFrame, right: DataFrame, d: float, side: float, condition: Column | None = None, exact: Column | None = None, shuffled: bool = False) -> DataFrame:
    """Pairs whose shapes lie within d of one another.

    left has columns l_x0 to l_y1, right r_x0 to r_y1; condition may name columns of both. Boxes are compared by
    their distance; exact, if given, is the distance of other shapes inside them, and is checked on pairs of near boxes.
    shuffled: no side is broadcast, however small Spark takes it for; it goes by the size of compressed files.
    """
    grid, a, b = Grid(side), Box.of("l_"), Box.of("r_")
    goals = grid.deal(right, b)
    pairs = grid.deal(left, a, d).join(goals.hint("merge") if shuffled else goals, ["_cx", "_cy"])
    # the first cell that both cover reports the pair
    first = (F.col("_cx") == grid.cell(F.greatest(a.x0 - d, b.x0))) & (F.col("_cy") == grid.cell(F.greatest(a.y0 - d, b.y0)))
    pairs = pairs.filter(first & a.within(b, d))
    if condition is not None:
        pairs = pairs.filter(condition)
    if exact is not None:
        pairs = pairs.withColumn("distance", exact).filter(F.col("distance") <= d)
    else:
        pairs = pairs.withColumn("distance", a.distance(b))
    return pairs.drop("_cx", "_cy")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def self_pairs(shapes: DataFrame, d: float, side: float, key: str = "idx", different: str | None = None) -> DataFrame:
    """Pairs l_<key> < r_<key> of shapes (key and box columns) within d, with unlike values of a column if one is named."""
    condition = F.col(f"l_{key}") < F.col(f"r_{key}")
    if different:
        condition &= F.col(f"l_{different}") != F.col(f"r_{different}")
    rings = "rings" in shapes.columns
    exact = ring_distance("l_rings", "r_rings") if rings else None
    return near_pairs(prefixed(shapes, "l_"), prefixed(shapes, "r_"), d, side, condition, exact)


def box_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The rows of a partition sorted by keys in tables of whole groups, each with the places where groups begin, and its length."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        ids = frame[keys].to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        if held and (held[-1][keys].iloc[-1].to_numpy() != ids[0]).any():
            cuts = np.concatenate(([0], cuts))
        if not len(cuts):
            held.append(frame)
            continue
        held.append(frame.iloc[: cuts[-1]])
        yield _cut(held, keys)
        held = [frame.iloc[cuts[-1] :]]
    if held:
        yield _cut(held, keys)


def _cut(held: list[pd.DataFrame], keys: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    table = pd.concat(held, ignore_index=True)
    ids = table[keys].to_numpy()
    return table, np.concatenate(([0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1, [len(table)]))


def _near(a: np.ndarray, b: np.ndarray, d: float) -> np.ndarray:
    """Whether boxes a lie within d of boxes b, as Box.within tells it."""
    dx = np.maximum(0, np.maximum(b[..., 0] - a[..., 2], a[..., 0] - b[..., 2]))
    dy = np.maximum(0, np.maximum(b[..., 1] - a[..., 3], a[..., 1] - b[..., 3]))
    return dx * dx + dy * dy <= d * d


def cell_roots(frames: Iterator[pd.DataFrame], keys: list[str], d: float) -> Iterator[pd.DataFrame]:
    """node and root of each row of a partition sorted by keys and node: the least node that steps within d reach in its group."""
    for table, cuts in box_groups(frames, keys):
        boxes, sizes = table[list(CORNERS)].to_numpy(float), np.diff(cuts)
        after = np.repeat(np.where(sizes <= FEW_BOXES, cuts[1:], 0), sizes) - np.arange(len(table)) - 1
        after = np.maximum(after, 0)
        a = np.repeat(np.arange(len(table)), after)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
        near = _near(boxes[a], boxes[b], d)
        root = least_roots(len(table), a[near], b[near])
        for start, end in zip(cuts[:-1][sizes > FEW_BOXES], cuts[1:][sizes > FEW_BOXES], strict=True):
            left = np.arange(start, end)
            while len(left):
                first, stack, left = left[0], [left[0]], left[1:]
                while stack and len(left):
                    near = _near(boxes[stack.pop()], boxes[left], d)
                    root[left[near]] = first
                    stack += left[near].tolist()
                    left = left[~near]
        node = table["node"].to_numpy()
        yield pd.DataFrame({"node": node, "root": node[root]})


def cell_cover(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Per key and cell of a partition sorted by them: the area that their boxes cover."""
    for table, cuts in box_groups(frames, [key, "_cx", "_cy"]):
        boxes = table[list(CORNERS)].to_numpy(float)
        yield pd.DataFrame({key: table[key].to_numpy()[cuts[:-1]], "cover": [covered(boxes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})


def near_roots(boxes: DataFrame, d: float, side: float, key: str = "idx") -> DataFrame:
    """node and roots: of each box (a whole number key and corners) the sorted least keys that steps within d reach in each cell it covers.

    Boxes of one component are joined by the roots that they share, and the component's least key is among these, so
    dense cells give as many rows as boxes and not as many as pairs.
    """
    cell = ["_cx", "_cy", "_i", "_j"]
    dealt = Grid(side).deal(boxes.select(F.col(key).alias("node"), *[F.col(c).cast("double").alias(c) for c in CORNERS]), Box.of(), d)
    counts = dealt.groupBy(F.struct("_cx", "_cy").alias("_cell")).agg(F.count("*").alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / PART_BOXES))
    total, most = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if most > PART_BOXES:
        dealt = join_groups(dealt.withColumn("_cell", F.struct("_cx", "_cy")), materialise(counts, "cells"), "_cell", "_n", total)
        own, other = F.pmod(F.xxhash64("node"), F.col("_parts")), F.col("_other")
        dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).withColumn("_i", F.least(own, other)).withColumn("_j", F.greatest(own, other))
    else:
        dealt = dealt.withColumn("_i", F.lit(0).cast("long")).withColumn("_j", F.lit(0).cast("long"))
    met = dealt.select(*cell, "node", *CORNERS).repartition(*cell).sortWithinPartitions(*cell, "node")
    return met.mapInPandas(lambda frames: cell_roots(frames, cell, d), "node long, root long").groupBy("node").agg(F.array_sort(F.collect_set("root")).alias("roots"))


def union_areas(shapes: DataFrame, key: str, side: float) -> DataFrame:
    """key (a whole number) and area: what all shapes of a key cover, added up by cells, so that a key may have any number of shapes."""
    grid = Grid(side)
    low = {c: F.col(f"_c{c[0]}") * F.lit(float(side)) for c in CORNERS}
    dealt = grid.deal(shapes, Box.of())
    if "rings" in shapes.columns:
        ring = [("x0", 0, "y0", 0), ("x0", 1, "y0", 0), ("x0", 1, "y0", 1), ("x0", 0, "y0", 1), ("x0", 0, "y0", 0)]
        square = F.array(F.array(*[F.struct((low[x] + i * side).alias("x"), (low[y] + j * side).alias("y")) for x, i, y, j in ring]))
        parts = dealt.groupBy(key, "_cx", "_cy").agg(F.collect_list("rings").alias("parts")).select(key, overlap_of_many(square, "parts").alias("cover"))
    else:
        clip = [F.greatest(F.col(c).cast("double"), low[c]).alias(c) for c in CORNERS[:2]] + [F.least(F.col(c).cast("double"), low[c] + side).alias(c) for c in CORNERS[2:]]
        met = dealt.select(key, "_cx", "_cy", *clip).repartition(key, "_cx", "_cy").sortWithinPartitions(key, "_cx", "_cy")
        parts = met.mapInPandas(lambda frames: cell_cover(frames, key), f"{key} long, cover double")
    return parts.groupBy(key).agg(F.sum("cover").alias("area"))


def nearest(left: DataFrame, right: DataFrame, within: float, side: float, left_key: str, right_key: str, grouped: bool = False) -> DataFrame:
    """For each row of left the nearest row of right within a radius, ties to the smaller key; others have nulls.

    grouped: many rows of right share a key; their least distance is found first, without sorting the pairs. The joins
    are shuffled then.
    """
    exact = ring_distance("l_rings", "r_rings") if "rings" in left.columns and "rings" in right.columns else None
    pairs = near_pairs(prefixed(left, "l_"), prefixed(right, "r_"), within, side, exact=exact, shuffled=grouped)
    if grouped:
        pairs = pairs.groupBy(f"l_{left_key}", f"r_{right_key}").agg(F.min("distance").alias("distance"))
    best = pairs.groupBy(F.col(f"l_{left_key}").alias(left_key)).agg(F.min(F.struct("distance", F.col(f"r_{right_key}").alias("key"))).alias("b"))
    best = best.select(left_key, F.col("b.key").alias(f"nearest_{right_key}"), F.col("b.distance").alias("nearest_distance"))
    return left.join(best.hint("merge") if grouped else best, left_key, "left")


def nearest_any(left: DataFrame, right: DataFrame, start: float, left_key: str) -> DataFrame:
    """Distance of each row of left to the nearest row of right, however far: rings of doubling radius, each for the rows
    that the smaller ones left alone. Columns <left_key> and nearest_distance; no rows if right is empty."""
    reach = left.select(*CORNERS).unionByName(right.select(*CORNERS)).agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    if reach[0] is None or right.isEmpty():
        return left.select(left_key).withColumn("nearest_distance", F.lit(None).cast("double"))
    most = float(np.hypot(reach[2] - reach[0], reach[3] - reach[1])) + 1
    goals = right.withColumn("_key", F.lit(0))
    found, rest, radius = None, materialise(left, "far"), float(start)
    while True:
        near = nearest(rest, goals, radius, max(2 * radius, start), left_key, "_key").select(left_key, "nearest_distance").filter("nearest_distance IS NOT NULL")
        near = materialise(near, "near")
        found = near if found is None else found.unionByName(near)
        if radius > most or rest.count() == near.count():
            return found
        rest = materialise(rest.join(near.select(left_key), left_key, "left_anti"), "far")
        radius *= 8


def semi(left: DataFrame, right: DataFrame, d: float, side: float, key: str) -> DataFrame:
    """Rows of left with a row of right within d."""
    exact = ring_distance("l_rings", "r_rings") if "rings" in left.columns and "rings" in right.columns else None
    hit = near_pairs(prefixed(left, "l_"), prefixed(right.select(*CORNERS, *(c for c in ("rings",) if c in right.columns)), "r_"), d, side, exact=exact)
    return left.join(hit.select(F.col(f"l_{key}").alias(key)).distinct(), key, "left_semi")


def anti(left: DataFrame, right: DataFrame, d: float, side: float, key: str) -> DataFrame:
    """Rows of left with no row of right within d."""
    return left.join(semi(left, right, d, side, key).select(key), key, "left_anti")


def box_cells(df: DataFrame, box: Box) -> DataFrame:
    """df once per unit cell (cx, cy) of its box; corners are whole numbers."""
    across, upward = F.sequence(box.x0.cast("long"), box.x1.cast("long") - 1), F.sequence(box.y0.cast("long"), box.y1.cast("long") - 1)
    return df.withColumn("cx", F.explode(across)).withColumn("cy", F.explode(upward))

