"""Rasters as rows of tiles: cutting, halo exchange, kernels per tile, global statistics, components across tiles.

A tile row is scene, tile_row, tile_col, row0, col0, h, w, bands and data: float32 pixels, band first, NaN where invalid.
A task holds one tile and its surroundings, at any size of a scene.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltascape.functions import kernels as K

from .components import connected_components

TILE = 256
KEY = ["scene", "tile_row", "tile_col"]
SCHEMA = "scene string, tile_row int, tile_col int, row0 int, col0 int, h int, w int, bands int, data binary"
COLUMNS = ["scene", "tile_row", "tile_col", "row0", "col0", "h", "w", "bands", "data"]


def tile_rows(scene: str, pixels: np.ndarray, tile: int = TILE) -> list[tuple]:
    """Rows of an array (band, row, column)."""
    n, height, width = pixels.shape
    out = []
    for r in range(0, height, tile):
        for c in range(0, width, tile):
            part = np.ascontiguousarray(pixels[:, r : r + tile, c : c + tile], np.float32)
            out.append((scene, r // tile, c // tile, r, c, part.shape[1], part.shape[2], n, part.tobytes()))
    return out


def array_of(row) -> np.ndarray:
    return np.frombuffer(row.data, np.float32).reshape(row.bands, row.h, row.w)


def with_halo(tiles: DataFrame, halo: int, kernel: Callable[[np.ndarray, object], np.ndarray], tile: int = TILE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each tile as kernel makes it from the tile with `halo` pixels around it (fewer at the image's edge).

    kernel(array, row) gets the padded array (band, row, column) and returns one of the same rows and columns; the halo
    is cut off again. A tile goes to as many neighbours as the halo reaches, in strips, never whole where a strip will do.
    """
    reach = -(-halo // tile)

    def strips(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                a = array_of(row)
                for dr in range(-reach, reach + 1):
                    for dc in range(-reach, reach + 1):
                        # what of this tile lies within the halo of the tile dr, dc away
                        r0, r1 = _overlap(row.tile_row, dr, halo, tile, row.h)
                        c0, c1 = _overlap(row.tile_col, dc, halo, tile, row.w)
                        if r0 < r1 and c0 < c1 and row.tile_row + dr >= 0 and row.tile_col + dc >= 0:
                            part = np.ascontiguousarray(a[:, r0:r1, c0:c1])
                            out.append((row.scene, row.tile_row + dr, row.tile_col + dc, row.row0 + r0, row.col0 + c0, r1 - r0, c1 - c0, row.bands, part.tobytes(), dr == 0 and dc == 0, *(getattr(row, c) for c in carry)))
            yield pd.DataFrame(out, columns=[*COLUMNS, "own", *carry])

    extra = "".join(f", {c} {tiles.schema[c].dataType.simpleString()}" for c in carry)
    parts = tiles.select(*COLUMNS, *carry).mapInPandas(strips, SCHEMA + ", own boolean" + extra)

    def assemble(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["own"]]
        if not len(own):
            return pd.DataFrame(columns=COLUMNS)
        me = next(own.itertuples(index=False))
        top, left = frame["row0"].min(), frame["col0"].min()
        bottom, right = (frame["row0"] + frame["h"]).max(), (frame["col0"] + frame["w"]).max()
        canvas = np.full((me.bands, bottom - top, right - left), np.nan, np.float32)
        for row in frame.itertuples(index=False):
            canvas[:, row.row0 - top : row.row0 - top + row.h, row.col0 - left : row.col0 - left + row.w] = array_of(row)
        made = np.asarray(kernel(canvas, me), np.float32)
        made = np.ascontiguousarray(made[:, me.row0 - top : me.row0 - top + me.h, me.col0 - left : me.col0 - left + me.w])
        return pd.DataFrame([(me.scene, me.tile_row, me.tile_col, me.row0, me.col0, me.h, me.w, len(made), made.tobytes())], columns=COLUMNS)

    return parts.groupBy(*KEY).applyInPandas(assemble, SCHEMA)


def _overlap(index: int, step: int, halo: int, tile: int, size: int) -> tuple[int, int]:
    """The part of a tile's pixels, along one axis, within the halo of the tile `step` away."""
    start = index * tile
    low, high = (index + step) * tile - halo, (index + step + 1) * tile + halo
    return max(0, low - start), min(size, high - start)


def each_tile(tiles: DataFrame, kernel: Callable[[np.ndarray, object], np.ndarray]) -> DataFrame:
    """Each tile as kernel makes it from the tile alone."""

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                made = np.ascontiguousarray(kernel(array_of(row), row), np.float32)
                out.append((row.scene, row.tile_row, row.tile_col, row.row0, row.col0, row.h, row.w, len(made), made.tobytes()))
            yield pd.DataFrame(out, columns=COLUMNS)

    return tiles.select(*COLUMNS).mapInPandas(run, SCHEMA)


def stacked(one: DataFrame, other: DataFrame) -> DataFrame:
    """Tiles with the bands of both, where both have the tile: pixels join by tile, not one by one."""
    joined = one.select(*COLUMNS).join(other.select(*KEY, F.col("data").alias("_data"), F.col("bands").alias("_bands")), KEY)
    return joined.withColumn("data", F.concat("data", "_data")).withColumn("bands", F.col("bands") + F.col("_bands")).select(*COLUMNS)


def histogram(tiles: DataFrame, digits: int = 4) -> DataFrame:
    """scene, band, v, n: how often each rounded valid value stands. Counted within tiles first."""

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                for band, a in enumerate(array_of(row)):
                    values, counts = np.unique(np.round(a[np.isfinite(a)].astype(float), digits), return_counts=True)
                    out += [(row.scene, band, float(v), int(n)) for v, n in zip(values, counts, strict=True)]
            yield pd.DataFrame(out, columns=["scene", "band", "v", "n"])

    return tiles.mapInPandas(run, "scene string, band int, v double, n long").groupBy("scene", "band", "v").agg(F.sum("n").alias("n"))


def percentile_limits(tiles: DataFrame, shares: list[float], digits: int = 4) -> dict[tuple[str, int], list[float]]:
    """By scene and band the percentiles (linear between ranks) of valid pixels, exact for values rounded to `digits`."""
    upto = Window.partitionBy("scene", "band").orderBy("v")
    every = Window.partitionBy("scene", "band")
    ranked = histogram(tiles, digits).withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(every))
    aggs = []
    for k, s in enumerate(shares):
        place = F.lit(float(s)) * (F.col("total") - 1)
        low, high = (F.min(F.when(F.col("upto") > edge, F.col("v"))) for edge in (F.floor(place), F.ceil(place)))
        aggs.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"p{k}"))
    return {(r["scene"], r["band"]): [r[f"p{k}"] for k in range(len(shares))] for r in ranked.groupBy("scene", "band").agg(*aggs).collect()}


def label_tiles(masks: DataFrame, tile: int = TILE) -> DataFrame:
    """Pixels of the 8-connected regions of masks (first band over 0), across tiles: scene, tile_row, tile_col, region and
    the arrays rows and cols, one row per region and tile.

    Regions are labelled in their tile; those that meet over a tile's border are joined by a table of border pairs.
    """

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                labels, n = K.label(array_of(row)[0] > 0)
                for k in range(1, n + 1):
                    r, c = np.nonzero(labels == k)
                    out.append((row.scene, row.tile_row, row.tile_col, k, (r + row.row0).tolist(), (c + row.col0).tolist()))
            yield pd.DataFrame(out, columns=["scene", "tile_row", "tile_col", "own", "rows", "cols"])

    parts = masks.select(*COLUMNS).mapInPandas(run, "scene string, tile_row int, tile_col int, own int, rows array<int>, cols array<int>")
    # a number for each part that rises with its place; scenes are told apart by a hash
    part = F.xxhash64("scene", "tile_row", "tile_col", "own")
    parts = parts.withColumn("part", part)
    pixels = parts.select("scene", "part", F.explode(F.arrays_zip("rows", "cols")).alias("p")).select("scene", "part", F.col("p.rows").alias("row"), F.col("p.cols").alias("col"))
    at_edge = (F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1)
    edge = pixels.filter(at_edge)
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    ahead = edge.select("scene", F.col("part").alias("u"), "row", "col", F.explode(moves).alias("m")).select("scene", "u", (F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col"))
    pairs = ahead.join(edge.withColumnRenamed("part", "v"), ["scene", "row", "col"]).filter("u <> v").select("u", "v").distinct()
    joined = connected_components(pairs, 500_000).select(F.col("node").alias("part"), F.col("root"))
    return parts.join(joined, "part", "left").select("scene", "tile_row", "tile_col", F.coalesce("root", "part").alias("region"), "rows", "cols")
