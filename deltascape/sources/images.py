"""Images as tiles: GeoTIFF files, reprojection on read, image pairs, and tiles written back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascape.functions import kernels as K
from deltascape.operators import tiles as T

from . import geotiff


def read_tiles(spark: SparkSession, path: str, scene: str, bands: int = 3) -> DataFrame:
    """Tiles of a GeoTIFF: the first bands as float32, NaN where invalid. Fewer bands than asked for is an error."""

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                image = geotiff.read(bytes(content))
                if len(image.bands) < bands:
                    raise ValueError(f"the image has {len(image.bands)} bands; {bands} are needed")
                a = image.bands[:bands].astype(np.float32)
                a[:, ~image.valid] = np.nan
                yield pd.DataFrame(T.tile_rows(scene, a), columns=T.COLUMNS)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, T.SCHEMA)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """One row: affine, EPSG code, height and width of a GeoTIFF."""

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                i = geotiff.read(bytes(content))
                yield pd.DataFrame([(list(map(float, i.affine)), i.epsg, *i.bands.shape[1:], i.projected)], columns=["affine", "epsg", "height", "width", "projected"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "affine array<double>, epsg int, height int, width int, projected boolean")


def read_onto(spark: SparkSession, path: str, scene: str, affine: tuple, height: int, width: int, bands: int = 3, epsg: int | None = None) -> DataFrame:
    """Tiles of a GeoTIFF on another grid: bilinear pixels, nearest validity. epsg is the grid's reference system; an
    image of another one is reprojected between 4326 and 3857, and an error otherwise."""

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                i = geotiff.read(bytes(content))
                yield pd.DataFrame(T.tile_rows(scene, resample(i, affine, height, width, bands, epsg)), columns=T.COLUMNS)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, T.SCHEMA)


#: Radius of the sphere of EPSG:3857 in metres, a fixed value.
RADIUS_M = 6378137.0


def reprojected(x: np.ndarray, y: np.ndarray, source: int | None, target: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of one reference system in another."""
    if source == target or source is None and target is None:
        return x, y
    if (source, target) == (3857, 4326):
        return np.degrees(x / RADIUS_M), np.degrees(2 * np.arctan(np.exp(y / RADIUS_M)) - np.pi / 2)
    if (source, target) == (4326, 3857):
        return np.radians(x) * RADIUS_M, np.log(np.tan(np.pi / 4 + np.radians(y) / 2)) * RADIUS_M
    raise ValueError(f"no reprojection from EPSG {source} to EPSG {target}")


def resample(image: geotiff.Raster, affine: tuple, height: int, width: int, bands: int, epsg: int | None = None) -> np.ndarray:
    """Bands of an image at the pixel centres of a grid; NaN outside it and where it is invalid. Without epsg the grid is
    in the image's own reference system."""
    a, b, c, d, e, f = affine
    column, row = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    x, y = a * column + b * row + c, d * column + e * row + f
    if epsg is not None:
        x, y = reprojected(x, y, epsg, image.epsg)
    a, b, c, d, e, f = image.affine
    det = a * e - b * d
    u, v = (e * (x - c) - b * (y - f)) / det - 0.5, (a * (y - f) - d * (x - c)) / det - 0.5
    h, w = image.bands.shape[1:]
    near_r, near_c = np.rint(v).astype(int), np.rint(u).astype(int)
    inside = (near_r >= 0) & (near_r < h) & (near_c >= 0) & (near_c < w)
    ok = inside & image.valid[np.clip(near_r, 0, h - 1), np.clip(near_c, 0, w - 1)]
    r, k = np.clip(v, 0, h - 1), np.clip(u, 0, w - 1)
    r0, k0 = np.minimum(np.floor(r).astype(int), max(h - 2, 0)), np.minimum(np.floor(k).astype(int), max(w - 2, 0))
    r1, k1 = np.minimum(r0 + 1, h - 1), np.minimum(k0 + 1, w - 1)
    fr, fk = r - r0, k - k0
    src = image.bands[:bands].astype(float)
    out = (src[:, r0, k0] * (1 - fk) + src[:, r0, k1] * fk) * (1 - fr) + (src[:, r1, k0] * (1 - fk) + src[:, r1, k1] * fk) * fr
    out[:, ~ok] = np.nan
    return out.astype(np.float32)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles as Parquet, a folder per scene."""
    tiles.write.mode("overwrite").partitionBy("scene").parquet(path)


def encoded(tiles: DataFrame, affine: tuple, epsg: int | None, nodata: float = -9999.0, kind: str = "float32") -> DataFrame:
    """Each tile as the bytes of a GeoTIFF of its own: scene, tile_row, tile_col, content."""

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                a, b, c, d, e, f = affine
                at = (a, b, c + a * row.col0 + b * row.row0, d, e, f + d * row.col0 + e * row.row0)
                data = np.nan_to_num(T.array_of(row), nan=nodata).astype(kind)
                out.append((row.scene, row.tile_row, row.tile_col, geotiff.write(geotiff.Raster(data, at, epsg, nodata))))
            yield pd.DataFrame(out, columns=["scene", "tile_row", "tile_col", "content"])

    return tiles.mapInPandas(run, "scene string, tile_row int, tile_col int, content binary")


def image_pairs(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """Rows stem, before, after, label of the files of folders A, B and label that share a stem, all or those listed (stem)."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem")
    part = lambda sub, name: spark.read.format("binaryFile").load(f"{folder}/{sub}").select(stem, F.col("content").alias(name))
    both = part("A", "before").join(part("B", "after"), "stem").join(part("label", "label"), "stem")
    return both if names is None else both.join(names.select("stem"), "stem", "left_semi")


def probability_tiles(tiles: DataFrame, make_session, window: int = 256, stride: int = 192) -> DataFrame:
    """Probability of the first class by a model: make_session() is called once a worker and gives an object with run().

    A tile is inferred with a halo of a window, so that overlaps average across tiles as within them.
    """
    held: dict = {}

    def run(a, row):
        if "session" not in held:
            held["session"] = make_session()
        valid = np.isfinite(a).all(axis=0)
        return K.infer(held["session"], np.moveaxis(np.nan_to_num(a[:3]), 0, -1), valid, window, stride)[None]

    return T.with_halo(tiles, window, run)
