"""Change detection between two dates of imagery, as one plan over tiles."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascape.functions import kernels as K
from deltascape.functions import polygons as P
from deltascape.operators import tiles as T
from deltascape.operators.pixels import classify

from .config import Settings
from .storage import materialise

RINGS = "array<array<struct<x:double,y:double>>>"
REGION = f"scene string, region long, classification_forced string, raw_area double, area_m2 double, rectangularity double, mean_change_score double, mean_height_change_m double, rings {RINGS}"


@dataclass(frozen=True)
class Grid:
    """The grid of the later image: affine (a, b, c, d, e, f) and whether it is projected."""

    affine: tuple[float, float, float, float, float, float]
    projected: bool = True

    @property
    def pixel_m(self) -> float:
        a, b, _, d, e, _ = self.affine
        return math.sqrt(abs(a * e - b * d)) if self.projected and a * e - b * d else 1.0

    def to_map(self, ring: np.ndarray) -> np.ndarray:
        a, b, c, d, e, f = self.affine
        return np.stack([a * ring[:, 0] + b * ring[:, 1] + c, d * ring[:, 0] + e * ring[:, 1] + f], axis=1)


def stretched(tiles: DataFrame) -> DataFrame:
    """8-bit tiles, each band between its 2nd and 98th percentile over the whole scene."""
    limits = T.percentile_limits(tiles, [0.02, 0.98], 3)

    def run(a, row):
        valid = np.isfinite(a).all(axis=0)
        out = np.moveaxis(K.stretch(a, valid, [limits.get((row.scene, b), (0.0, 1.0)) for b in range(len(a))]), -1, 0).astype(np.float32)
        out[:, ~valid] = np.nan
        return out

    return T.each_tile(tiles, run)


def reduced(tiles: DataFrame, scene_size: tuple[int, int], k: int) -> np.ndarray:
    """A scene reduced k times by block means, for the driver: at most the registration's image size."""
    small = T.each_tile(tiles, lambda a, row: a[:, : row.h // k * k, : row.w // k * k].reshape(len(a), row.h // k, k, row.w // k, k).mean(axis=(2, 4)) if row.h >= k and row.w >= k else np.zeros((len(a), 0, 0)))
    rows = small.select("row0", "col0", "h", "w", "bands", "data").toPandas()
    out = np.full((3, scene_size[0] // k, scene_size[1] // k), np.nan, np.float32)
    for r in rows.itertuples():
        h, w = r.h // k, r.w // k
        if h and w:
            a = np.frombuffer(r.data, np.float32).reshape(r.bands, h, w)
            y, x = r.row0 // k, r.col0 // k
            part = a[:3, : out.shape[1] - y, : out.shape[2] - x]
            out[:, y : y + part.shape[1], x : x + part.shape[2]] = part
    return out


#: The side of an image that the driver registers is at most this, or the number of tiles on a side.
REDUCED = 1200


def reduction(side: int) -> int:
    """The least factor that divides a tile and takes a side of so many pixels to REDUCED; a whole tile for wider scenes."""
    return next((k for k in range(1, T.TILE + 1) if T.TILE % k == 0 and side <= REDUCED * k), T.TILE)


def registration(before: DataFrame, after: DataFrame, config: Settings) -> K.Shift:
    """The shift of one scene, found on images small enough for the driver."""
    size = after.agg(F.max(F.col("row0") + F.col("h")), F.max(F.col("col0") + F.col("w"))).first()
    if not config.registration.enabled:
        return K.Shift(False, reason="disabled")
    k = reduction(max(size[0], size[1]))
    b, a = reduced(before, (size[0], size[1]), k), reduced(after, (size[0], size[1]), k)
    valid = np.isfinite(a).all(axis=0) & np.isfinite(b).all(axis=0)
    s = K.register(np.moveaxis(np.nan_to_num(b), 0, -1), np.moveaxis(np.nan_to_num(a), 0, -1), valid, config.registration.most_px / k)
    return K.Shift(s.applied, s.dx * k, s.dy * k, s.reason)


def shifted(tiles: DataFrame, shift: K.Shift) -> DataFrame:
    """Tiles laid on the other date."""
    if not shift.applied or not (shift.dx or shift.dy):
        return tiles
    halo = math.ceil(max(abs(shift.dx), abs(shift.dy))) + 2

    def run(a, row):
        ok = K.moved(np.isfinite(a).all(axis=0).astype(float), shift.dx, shift.dy) > 0.999
        out = np.stack([K.moved(np.nan_to_num(x), shift.dx, shift.dy) for x in a])
        out[:, ~ok] = np.nan
        return out

    return T.with_halo(tiles, halo, run)


def score_tiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change score per pixel; NaN where either date is invalid."""

    def run(a, row):
        valid = np.isfinite(a).all(axis=0)
        b, c = (np.moveaxis(np.nan_to_num(x), 0, -1) for x in (a[:3], a[3:6]))
        out = K.change_score(b, c)
        out[~valid] = np.nan
        return out[None]

    return T.with_halo(T.stacked(before, after), 4, run)


def shadow_tiles(tiles: DataFrame, pixel_m: float, config: Settings) -> DataFrame:
    """1 in shadow, 0 beside: the darkest of the scene that are dark beside their surroundings. The wide context comes
    with its whole kernel; it is never cut."""
    grey = T.each_tile(tiles, lambda a, row: np.where(np.isfinite(a).all(axis=0), K.grey(np.moveaxis(np.nan_to_num(a[:3]), 0, -1)), np.nan)[None])
    limits = T.percentile_limits(grey, [0.0, config.shadow.percentile / 100, 1.0], 4)
    sigma = max(1.0, config.shadow.context_m / pixel_m)
    size = K.odd_size(config.shadow.dilation_m, pixel_m)
    halo = len(K.gaussian_kernel(sigma)) // 2

    def dark(a, row):
        low, cut, high = limits.get((row.scene, 0), (0.0, 0.0, 0.0))
        g = a[0]
        if high - low < 5:
            return np.zeros_like(a)
        filled = np.nan_to_num(g)
        return (np.isfinite(g) & (g <= cut + 1e-4) & (filled <= K.blur(filled, sigma) * config.shadow.brightness)).astype(np.float32)[None]

    found = T.with_halo(grey, halo, dark)
    return T.with_halo(found, size // 2, lambda a, row: K.dilate(a[0] > 0, K.ellipse(size))[None]) if size > 1 else found


def mask_tiles(score: DataFrame, threshold: float, pixel_m: float, config: Settings) -> DataFrame:
    """1 where the score reaches the threshold, opened and closed."""
    size = K.odd_size(config.shape.opening_m, pixel_m) if config.shape.opening_m > 0 else 1
    over = lambda a: np.nan_to_num(a[0], nan=-1.0) >= threshold
    if size <= 1:
        return T.each_tile(score, lambda a, row: over(a)[None])
    return T.with_halo(score, 4 * (size // 2), lambda a, row: K.opened_closed(over(a), size)[None])


def region_rows(regions: DataFrame, layers: DataFrame, grid: Grid, config: Settings, forced: str | None) -> DataFrame:
    """A row per 4-connected outline of the regions: raw area and statistics, and the outline in map coordinates.

    layers has the score and, if known, the height difference of each tile.
    """
    data = regions.join(layers.select(*T.KEY, "row0", "col0", "h", "w", "bands", "data"), T.KEY)

    def sampled(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                a = T.array_of(row)
                r, c = np.asarray(row.rows), np.asarray(row.cols)
                v = a[:, r - row.row0, c - row.col0]
                out.append((row.scene, row.region, row.rows, row.cols, v[0].tolist(), v[1].tolist() if len(v) > 1 else []))
            yield pd.DataFrame(out, columns=["scene", "region", "rows", "cols", "score", "height"])

    parts = data.mapInPandas(sampled, "scene string, region long, rows array<int>, cols array<int>, score array<float>, height array<float>")

    def outline(frame: pd.DataFrame) -> pd.DataFrame:
        r, c, s = (np.concatenate([np.asarray(x, float) for x in frame[k]]) for k in ("rows", "cols", "score"))
        h = np.concatenate([np.asarray(x, float) for x in frame["height"]])
        r, c = r.astype(int), c.astype(int)
        top, left = r.min(), c.min()
        mask = np.zeros((r.max() - top + 1, c.max() - left + 1), bool)
        mask[r - top, c - left] = True
        score, height = np.full(mask.shape, np.nan), np.full(mask.shape, np.nan)
        score[r - top, c - left] = s
        if len(h):
            height[r - top, c - left] = h
        labels, _ = K.label(mask, eight=False)
        out = []
        for shape in P.polygonise(mask):
            inside = _own(labels, shape)
            world = [grid.to_map(ring + [left, top]) for ring in shape]
            raw = P.area(world)
            if raw < config.shape.min_area_m2:
                continue
            final = P.regularise([world], grid.pixel_m, grid.projected)[0] if config.shape.regularise else world
            scores, heights = score[inside], height[inside]
            heights = heights[np.isfinite(heights)]
            out.append((
                frame["scene"].iloc[0], int(frame["region"].iloc[0]), forced, raw, P.area(final), round(P.rectangularity(final), 3), round(float(np.nanmean(scores)), 4),
                float(heights.mean()) if heights.size else None, [[{"x": float(x), "y": float(y)} for x, y in np.vstack([ring, ring[:1]])] for ring in final],
            ))
        return pd.DataFrame(out, columns=["scene", "region", "classification_forced", "raw_area", "area_m2", "rectangularity", "mean_change_score", "mean_height_change_m", "rings"])

    return parts.groupBy("scene", "region").applyInPandas(outline, REGION)


def _own(labels: np.ndarray, shape: P.Rings) -> np.ndarray:
    """The pixels of a shape that polygonise made: those of the label at its first corner."""
    ring = shape[0]
    k = int(np.lexsort((ring[:, 0], ring[:, 1]))[0])
    x, y = ring[k].astype(int)
    return labels == labels[y, x]


def only_scene(limits: dict) -> list[float]:
    """The limits of the one scene that a plan is given; several are an error, as each has its own."""
    if len(limits) != 1:
        raise ValueError(f"a plan takes one scene, not {len(limits)}: {sorted(map(str, limits))[:5]}")
    return next(iter(limits.values()))


def detect(before: DataFrame, after: DataFrame, grid: Grid, config: Settings | None = None, before_dsm: DataFrame | None = None, after_dsm: DataFrame | None = None, before_date: str = "unknown", after_date: str = "unknown") -> dict[str, DataFrame]:
    """Candidates of change of one scene, given as tiles on the grid of the later date.

    Returns frames candidates, uncertain (deferred for shadow), likely_buildings, score, mask and report. Both height
    models or neither are given.
    """
    config = config or Settings()
    if (before_dsm is None) != (after_dsm is None):
        raise ValueError("give both height models or neither")
    shift = registration(before, after, config)
    b8, a8 = materialise(stretched(before), "before"), materialise(stretched(after), "after")
    score = materialise(score_tiles(shifted(b8, shift), a8), "score")
    limits = T.percentile_limits(score, [config.threshold.percentile / 100], 4)
    if not limits:
        raise ValueError("the two dates share no valid pixels")
    threshold = config.threshold.fixed if config.threshold.fixed is not None else only_scene(limits)[0]
    mask = materialise(mask_tiles(score, threshold, grid.pixel_m, config), "mask")
    layers = score
    if before_dsm is not None:
        delta = T.each_tile(T.stacked(before_dsm, after_dsm), lambda a, row: (a[1] - a[0])[None])
        layers = T.stacked(score, delta)
    labelled = materialise(T.label_tiles(mask), "regions")
    if config.shadow.enabled:
        dark = T.each_tile(T.stacked(shadow_tiles(before, grid.pixel_m, config), shadow_tiles(after, grid.pixel_m, config)), lambda a, row: (a.max(axis=0) > 0)[None])
        own = labelled.join(dark.select(*T.KEY, "row0", "col0", "h", "w", "bands", "data"), T.KEY)

        def counted(frames):
            for frame in frames:
                out = []
                for row in frame.itertuples(index=False):
                    v = T.array_of(row)[0][np.asarray(row.rows) - row.row0, np.asarray(row.cols) - row.col0]
                    out.append((row.region, len(v), int((v > 0).sum())))
                yield pd.DataFrame(out, columns=["region", "n", "dark"])

        share = own.mapInPandas(counted, "region long, n long, dark long").groupBy("region").agg((F.sum("dark") / F.sum("n")).alias("share"))
        labelled = labelled.join(share, "region")
        sure, unsure = labelled.filter(F.col("share") < config.shadow.overlap), labelled.filter(F.col("share") >= config.shadow.overlap)
    else:
        sure, unsure = labelled, labelled.filter(F.lit(False))
    dates = {"before_capture_date": before_date, "after_capture_date": after_date}

    def finished(rows: DataFrame, forced: str | None) -> DataFrame:
        made = region_rows(rows, layers, grid, config, forced)
        kind = classify(F.col("mean_height_change_m"), F.col("rectangularity"), config.shape.min_rise_m, config.shape.rectangularity, forced)
        made = made.withColumn("classification", kind).withColumn("area_m2", F.round("area_m2", 2)).withColumn("mean_height_change_m", F.round("mean_height_change_m", 3))
        return materialise(made.select("scene", "region", "classification", "area_m2", "rectangularity", "mean_change_score", "mean_height_change_m", *[F.lit(v).alias(k) for k, v in dates.items()], "rings"), "candidates")

    candidates, uncertain = finished(sure, None), finished(unsure, "uncertain_shadow")
    likely = F.col("classification") == "likely_new_building"
    if before_dsm is None:
        likely |= F.col("classification") == "likely_building_change"
    counts = candidates.agg(F.count("*").alias("candidate_count"), F.count_if(likely).alias("likely_building_count")).join(F.broadcast(uncertain.agg(F.count("*").alias("uncertain_count"))))  # one row each
    report = counts.select(
        "*", F.lit(float(threshold)).alias("threshold"), F.lit(shift.applied).alias("registered"), F.lit(float(shift.dx)).alias("dx_px"), F.lit(float(shift.dy)).alias("dy_px"), F.lit(shift.reason).alias("registration_note")
    )
    return {"candidates": candidates, "uncertain": uncertain, "likely_buildings": candidates.filter(likely), "score": score, "mask": mask, "report": report}


def expand(seeds: DataFrame, score: DataFrame, grid: Grid, percentile: float, reach_m: float) -> DataFrame:
    """Tiles of seeds (1 in the first band) grown through high scores; a seed reaches reach_m at most, so the surroundings
    of each tile that can matter are within a halo of twice the reach."""
    limits = T.percentile_limits(score, [percentile / 100], 4)
    cut = only_scene(limits)[0]
    reach = max(1, round(reach_m / grid.pixel_m))
    element = K.ellipse(2 * reach + 1)

    def run(a, row):
        seed, growable = np.nan_to_num(a[0]) > 0, np.nan_to_num(a[1], nan=-1.0) >= cut
        labels, n = K.label(seed)
        out = np.zeros(seed.shape, bool)
        for k in range(1, n + 1):
            own = labels == k
            regions, _ = K.label(growable & K.dilate(own, element))
            out |= np.isin(regions, np.setdiff1d(np.unique(regions[own]), [0]))
        return out[None]

    return T.with_halo(T.stacked(seeds, score), 4 * reach, run)
