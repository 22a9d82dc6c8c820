"""Plans that prepare or use human review, and those that combine detectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascape.functions import kernels as K
from deltascape.functions import polygons as P
from deltascape.operators import change as C
from deltascape.operators import evaluation as E
from deltascape.operators import tiles as T
from deltascape.operators.pixels import classify, shadow_risk
from deltascape.operators.spatial import as_rings

from .config import Settings
from .detection import Grid, detect, expand, only_scene, region_rows, shadow_tiles
from .storage import in_order, materialise


def box_tiles(shapes: DataFrame, grid: Grid, tile: int = T.TILE) -> DataFrame:
    """shapes (idx, rings in map metres) once per tile that their box meets: tile_row, tile_col, and the rings as JSON."""
    a, b, c, d, e, f = grid.affine
    if b or d:
        raise ValueError("the grid must be north-up")
    flat = F.flatten("rings")
    side = lambda axis, pick: pick(F.transform(flat, lambda p: p[axis]))
    columns = [(side("x", p) - c) / a for p in (F.array_min, F.array_max)]
    rows = [(side("y", p) - f) / e for p in (F.array_max, F.array_min)]
    span = lambda low, high: F.sequence(F.greatest(F.lit(0), F.floor(F.least(low, high) / tile)).cast("int"), F.greatest(F.lit(0), F.floor(F.greatest(low, high) / tile)).cast("int"))
    return shapes.select("idx", F.to_json("rings").alias("shape"), F.explode(span(*columns)).alias("tile_col"), *[r.alias(f"r{k}") for k, r in enumerate(rows)]).select(
        "idx", "shape", "tile_col", F.explode(span(F.col("r0"), F.col("r1"))).alias("tile_row")
    )


def zonal(shapes: DataFrame, layers: DataFrame, grid: Grid) -> DataFrame:
    """Per shape and band: pixels whose centres lie inside, how many are valid, their sum and largest value.

    Shapes meet tiles by tile number; a tile sums its own pixels, and the sums are added up.
    """
    a, _, c, _, e, f = grid.affine
    met = box_tiles(shapes, grid).join(layers.select("tile_row", "tile_col", "row0", "col0", "h", "w", "bands", "data"), ["tile_row", "tile_col"])

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                x, y = np.meshgrid(c + a * (row.col0 + np.arange(row.w) + 0.5), f + e * (row.row0 + np.arange(row.h) + 0.5))
                inside = P.contains(as_rings(row.shape), x, y)
                for band, v in enumerate(T.array_of(row)):
                    v = v[inside]
                    v = v[np.isfinite(v)]
                    out.append((row.idx, band, int(inside.sum()), len(v), float(v.sum()), float(v.max()) if len(v) else None))
            yield pd.DataFrame(out, columns=["idx", "band", "pixels", "n", "total", "largest"])

    sums = met.mapInPandas(run, "idx long, band int, pixels long, n long, total double, largest double").groupBy("idx", "band")
    return sums.agg(F.sum("pixels").alias("pixels"), F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"), F.max("largest").alias("largest"))


def annotate_shadow(before: DataFrame, after: DataFrame, candidates: DataFrame, grid: Grid, config: Settings | None = None) -> DataFrame:
    """candidates (idx, rings in the grid's metres) with the shadowed share of their valid pixels at each date and at
    either, and the risk; candidates without valid pixels have nulls and the risk no_valid_pixels, those without a proper
    outline nulls and invalid_geometry."""
    config = config or Settings()
    valid = lambda t, name: T.each_tile(t, lambda a, row: np.isfinite(a).all(axis=0)[None])
    layers = T.stacked(T.stacked(shadow_tiles(before, grid.pixel_m, config), shadow_tiles(after, grid.pixel_m, config)), T.stacked(valid(before, "b"), valid(after, "a")))

    def shares(a, row):
        b, c = a[0] > 0, a[1] > 0
        vb, va = a[2] > 0, a[3] > 0
        any_ = vb | va
        return np.stack([np.where(vb, b, np.nan), np.where(va, c, np.nan), np.where(any_, b | c, np.nan)])

    sound = F.coalesce((F.size("rings") > 0) & F.forall("rings", lambda ring: (F.size(ring) >= 4) & F.forall(ring, finite)), F.lit(False))
    by_band = zonal(candidates.filter(sound).select("idx", "rings"), T.each_tile(layers, shares), grid)
    wide = by_band.groupBy("idx").agg(*[F.round(F.max(F.when(F.col("band") == k, F.col("mean"))), 4).alias(n) for k, n in enumerate(("before_shadow_fraction", "after_shadow_fraction", "combined_shadow_fraction"))])
    out = candidates.join(wide, "idx", "left")
    return out.withColumn("shadow_risk", F.when(~sound, "invalid_geometry").otherwise(F.coalesce(shadow_risk(F.col("combined_shadow_fraction")), F.lit("no_valid_pixels"))))


def finite(p: Column) -> Column:
    """Whether a point's coordinates are finite numbers."""
    return F.coalesce((F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")), F.lit(False))


def burnt(shapes: DataFrame, tiles: DataFrame, grid: Grid) -> DataFrame:
    """Tiles of one band, 1 at pixels whose centres lie in a shape (idx, rings) and 0 beside. A tile takes each of its
    pixels once, however many shapes cover it."""
    a, _, c, _, e, f = grid.affine
    met = box_tiles(shapes, grid).join(tiles.select(*T.KEY, "row0", "col0", "h", "w"), ["tile_row", "tile_col"])

    def inside(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                x, y = np.meshgrid(c + a * (row.col0 + np.arange(row.w) + 0.5), f + e * (row.row0 + np.arange(row.h) + 0.5))
                out.append((row.scene, row.tile_row, row.tile_col, np.flatnonzero(P.contains(as_rings(row.shape), x, y)).tolist()))
            yield pd.DataFrame(out, columns=[*T.KEY, "at"])

    marks = met.mapInPandas(inside, "scene string, tile_row int, tile_col int, at array<int>").select(*T.KEY, F.explode("at").alias("at")).groupBy(*T.KEY).agg(F.collect_set("at").alias("at"))

    def drawn(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                band = np.zeros(row.h * row.w, np.float32)
                if row.at is not None:
                    band[np.asarray(row.at, int)] = 1
                out.append((row.scene, row.tile_row, row.tile_col, row.row0, row.col0, row.h, row.w, 1, band.tobytes()))
            yield pd.DataFrame(out, columns=T.COLUMNS)

    return tiles.select(*T.KEY, "row0", "col0", "h", "w").join(marks, T.KEY, "left").mapInPandas(drawn, T.SCHEMA)


def expand_confirmed(seeds: DataFrame, score: DataFrame, grid: Grid, percentile: float = 96.5, reach_m: float = 6.0, closing_m: float = 1.0, min_area: float = 20.0) -> dict[str, DataFrame]:
    """Candidates that grow out of confirmed ones (idx, rings in the grid's coordinates) through high scores nearby, with
    the report of the run; regions without a seed never appear."""
    size = K.odd_size(closing_m, grid.pixel_m) if closing_m > 0 else 1
    grown = expand(burnt(seeds, score, grid), score, grid, percentile, reach_m)
    if size > 1:
        element = K.ellipse(size)
        grown = T.with_halo(grown, size, lambda a, row: K.erode(K.dilate(np.nan_to_num(a[0]) > 0, element), element)[None])
    mask = materialise(T.each_tile(grown, lambda a, row: (np.nan_to_num(a[0]) > 0)[None]), "expanded")
    config = Settings().with_values({"shape.min_area_m2": min_area, "shape.opening_m": closing_m})
    rows = region_rows(T.label_tiles(mask), score, grid, config, None)
    kind = classify(F.col("mean_height_change_m"), F.col("rectangularity"), config.shape.min_rise_m, config.shape.rectangularity)
    found = materialise(rows.withColumn("classification", kind).withColumn("area_m2", F.round("area_m2", 2)).drop("classification_forced", "raw_area"), "candidates")
    cut = only_scene(T.percentile_limits(score, [percentile / 100], 4))[0]
    counts = found.agg(F.count("*").alias("candidate_count")).join(F.broadcast(seeds.agg(F.count("*").alias("seed_candidate_count"))))  # one row each
    report = counts.select("*", *[F.lit(float(v)).alias(k) for k, v in (("grow_threshold", cut), ("grow_percentile", percentile), ("max_distance_m", reach_m), ("closing_m", closing_m))])
    return {"candidates": found, "likely_buildings": found.filter(F.col("classification") == "likely_building_change"), "mask": mask, "report": report}


def footprints_of(probability: DataFrame, grid: Grid, threshold: float, min_area: float = 20.0, simplify_m: float = 0.25, regularise: bool = True) -> DataFrame:
    """Footprints of a probability raster: idx, rings and box in map metres, area and mean probability, largest first."""
    mask = T.each_tile(probability, lambda a, row: (np.nan_to_num(a[0], nan=-1.0) >= threshold)[None])
    config = Settings().with_values({"shape.min_area_m2": min_area, "shape.regularise": regularise, "registration.enabled": False})
    rows = region_rows(T.label_tiles(mask), probability, grid, config, None).filter(F.col("area_m2") >= min_area)
    flat = F.flatten("rings")
    edge = lambda pick, axis: pick(F.transform(flat, lambda p: p[axis]))
    made = materialise(rows.select(
        F.round("area_m2", 1).alias("area_m2"), F.col("mean_change_score").alias("mean_probability"), "region", "rings",
        edge(F.array_min, "x").alias("x0"), edge(F.array_min, "y").alias("y0"), edge(F.array_max, "x").alias("x1"), edge(F.array_max, "y").alias("y1"),
    ), "footprints")
    return in_order(made, "idx", F.desc("area_m2"), F.col("x0"), F.col("y0")).withColumn("id", F.col("idx")).withColumn("ordinal", F.col("idx")).drop("region")


def compare_objects(before: DataFrame, after: DataFrame, grid: Grid, threshold: float = 0.5, **options) -> dict[str, DataFrame]:
    """Footprints of two dates' probability rasters, and their comparison."""
    b, a = footprints_of(before, grid, threshold), footprints_of(after, grid, threshold)
    return {"before": b, "after": a, "changes": C.compare_footprints(b, a, **options)}


def enhanced(channels: dict[str, DataFrame], merge_distance: float = 3.0) -> dict[str, DataFrame]:
    """Candidates of several channels (each with id, classification, model and shape) fused; what a channel lacks is null.

    A channel that raises when it is built is for the caller to leave out; one without rows counts as present.
    """
    parts = []
    for name, rows in channels.items():
        parts.append(rows.select(F.lit(name).alias("source"), F.col("id").cast("string").alias("id"), "classification", F.lit(None).cast("string").alias("model") if "model" not in rows.columns else F.col("model"), "x0", "y0", "x1", "y1", "rings"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    names = {n: k for k, n in enumerate(channels)}
    rank = F.element_at(F.create_map(*[x for n, k in names.items() for x in (F.lit(n), F.lit(k))]), F.col("source"))
    numbered = materialise(in_order(every, "idx", rank, F.col("id")), "channels")
    fused = C.fuse_candidates(numbered, merge_distance)
    counts = numbered.groupBy("source").agg(F.count("*").alias("candidates"))
    return {"fused": fused, "channel_counts": counts, "by_sources": fused.groupBy("source_count").agg(F.count("*").alias("n"))}


def review_sample(candidates: DataFrame, target: int = 25, least: int = 3, seed: int = 20260811) -> dict[str, DataFrame]:
    """A stratified sample of candidates (id, tier, area_m2) in review order, its plan, and a label template."""
    rows = candidates.withColumn("stratum", E.stratum(F.col("tier"), F.col("area_m2")))
    if rows.isEmpty():
        raise ValueError("there are no candidates to sample")
    plan = E.strata_plan(rows, target, least)
    sample = E.review_order(E.stratified_sample(rows, plan, "id", seed), "area_m2", "id")
    template = sample.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string"), F.lit("unlabelled"))))))).toDF("labels")
    return {"sample": sample, "plan": plan, "template": template}


def resolution_ladder(tiles: DataFrame, factors: list[int]) -> dict[int, DataFrame]:
    """The same scene at coarser grids, by block means; a factor divides the tile size."""
    out = {}
    for k in factors:
        if T.TILE % k:
            raise ValueError("factors must divide the tile size")
        out[k] = T.each_tile(tiles, lambda a, row, k=k: np.kron(np.stack([x[: row.h // k * k, : row.w // k * k].reshape(row.h // k, k, row.w // k, k).mean(axis=(1, 3)) for x in a]), np.ones((1, k, k))) if row.h % k == 0 and row.w % k == 0 else a)
    return out


def detect_files(spark: SparkSession, before: str, after: str, config: Settings | None = None, before_dsm: str | None = None, after_dsm: str | None = None, **dates) -> dict[str, DataFrame]:
    """Detection between two GeoTIFF files: the later one gives the grid, the others are laid on it."""
    from deltascape.sources import images

    g = images.read_grid(spark, after).first()
    if g.epsg is None:
        raise ValueError("the later image has no reference system")
    affine = tuple(g.affine)
    lay = lambda path, scene, bands: images.read_onto(spark, path, scene, affine, g.height, g.width, bands, g.epsg)
    heights = [lay(p, "scene", 1) if p else None for p in (before_dsm, after_dsm)]
    return detect(lay(before, "scene", 3), images.read_tiles(spark, after, "scene"), Grid(affine, g.projected), config, *heights, **dates)


def in_system(rings: str, epsg: int | None) -> Column:
    """Rings in map metres as coordinates of a reference system, 3857 or 4326."""
    from deltascape.sources.images import RADIUS_M

    if epsg == 3857:
        return F.col(rings)
    if epsg != 4326:
        raise ValueError(f"no reprojection from EPSG 3857 to EPSG {epsg}")
    point = lambda p: F.struct(F.degrees(p["x"] / RADIUS_M).alias("x"), F.degrees(2 * F.atan(F.exp(p["y"] / RADIUS_M)) - math.pi / 2).alias("y"))
    return F.transform(rings, lambda ring: F.transform(ring, point))


def annotate_shadow_files(spark: SparkSession, before: str, after: str, candidates: str, config: Settings | None = None) -> DataFrame:
    """Features of a file with their shadow risk by two GeoTIFF files, of which the later gives the grid."""
    from deltascape.sources import geojson, images

    g = images.read_grid(spark, after).first()
    affine = tuple(g.affine)
    rows = geojson.read_features(spark, candidates, broken=True).withColumn("outline", F.col("rings"))
    early = images.read_onto(spark, before, "scene", affine, g.height, g.width, 3, g.epsg)
    got = annotate_shadow(early, images.read_tiles(spark, after, "scene"), rows.withColumn("rings", in_system("rings", g.epsg)), Grid(affine, g.projected), config)
    return got.withColumn("rings", F.col("outline")).drop("outline")


def expand_files(spark: SparkSession, candidates: str, score: str, **options: float) -> dict[str, DataFrame]:
    """expand_confirmed for features of a file and the score of a GeoTIFF file, whose grid must be in map metres."""
    from deltascape.sources import geojson, images

    g = images.read_grid(spark, score).first()
    if g.epsg != 3857:
        raise ValueError("the score must be in EPSG 3857")
    seeds = geojson.read_features(spark, candidates)
    if seeds.isEmpty():
        raise ValueError("there are no seeds")
    return expand_confirmed(seeds.select("idx", "rings"), materialise(images.read_tiles(spark, score, "scene", 1), "score"), Grid(tuple(g.affine), g.projected), **options)


def ground_scale(latitude: float) -> float:
    """Ground metres in a map metre at a latitude."""
    return math.cos(math.radians(latitude))


__all__ = [
    "annotate_shadow", "annotate_shadow_files", "compare_objects", "detect_files", "enhanced", "expand_confirmed", "expand_files", "footprints_of", "ground_scale", "resolution_ladder", "review_sample", "zonal",
]
