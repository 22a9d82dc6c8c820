"""Raster operators on pixel rows (scene, row, col, values): the relational form, for checks and for global statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components


def pixels(df: DataFrame, scene: str, values: str, width: int) -> DataFrame:
    """One row per element of an array column laid out in rows of a given width."""
    return df.select(scene, F.posexplode(values).alias("pos", "v")).select(scene, F.floor(F.col("pos") / width).cast("int").alias("row"), (F.col("pos") % width).cast("int").alias("col"), F.col("v").cast("double").alias("v"))


def pixel_pair(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pixels at one place: scene, row, col, b and a."""
    return before.withColumnRenamed("v", "b").join(after.withColumnRenamed("v", "a"), ["scene", "row", "col"])


def percentiles(df: DataFrame, value: str, shares: list[float], by: str | None = None) -> DataFrame:
    """Percentiles with linear interpolation, one column each (p<share in tenths of a percent>)."""
    aggs = [F.percentile(value, F.lit(s)).alias(f"p{round(1000 * s)}") for s in shares]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def exact_percentiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """The same from a histogram of distinct values: what one task holds is the number of values, not of pixels.

    Quantise the value first (scores to 1e-4) to bound that number.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(value))
    ranked = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy()))
    out = []
    for s in shares:
        place = F.lit(float(s)) * (F.col("total") - 1)
        at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
        low, high = at(F.floor(place)), at(F.ceil(place))
        weight = F.max(place - F.floor(place))
        out.append((low + (high - low) * weight).alias(f"p{round(1000 * s)}"))
    return ranked.agg(*out)


def normalise(df: DataFrame, value: str, low: Column, high: Column) -> Column:
    """Robust stretch to 0..255, cut off below the integer."""
    scaled = (F.col(value) - low) * 255.0 / F.greatest(high - low, F.lit(1.0))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled)))


def change_score(colour: Column, edge: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.8 * colour + 0.2 * edge))


def pixel_components(mask: DataFrame, eight: bool = True, one_task_edges: int = 500_000) -> DataFrame:
    """scene, row, col and label (its least pixel) of the connected regions of mask (scene, row, col, pid: a number that
    rises with row and col and is unique over all scenes)."""
    steps = [(0, 1), (1, 0)] + ([(1, -1), (1, 1)] if eight else [])
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps])
    shifted = mask.select("scene", F.col("pid").alias("u"), F.explode(moves).alias("m"), "row", "col").select("scene", "u", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col"))
    joined = connected_components(shifted.join(mask.select("scene", "row", "col", F.col("pid").alias("v")), ["scene", "row", "col"]).select("u", "v"), one_task_edges)
    return mask.join(joined.withColumnRenamed("node", "pid"), "pid", "left").select("scene", "row", "col", "pid", F.coalesce("root", "pid").alias("label"))


def shadow_split(labelled: DataFrame, least: float) -> DataFrame:
    """Per label: pixels, shadowed share and whether it is uncertain."""
    share = F.avg(F.col("shadow").cast("double"))
    return labelled.groupBy("label").agg(F.count("*").alias("pixels"), F.round(share, 4).alias("shadow_fraction"), (share >= least).alias("uncertain"))


def grow(labelled: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pixels of the growable regions (label per pixel) that touch a seed: a region without one never appears."""
    touched = labelled.join(seeds.select("scene", "row", "col"), ["scene", "row", "col"], "left_semi").select("label").distinct()
    return labelled.join(touched, "label", "left_semi")


def zonal(px: DataFrame, boxes: DataFrame, side: int = 64) -> DataFrame:
    """Mean, largest and number of the pixels whose centres lie in each box (id, scene, x0, y0, x1, y1 in pixels)."""
    cells = boxes.withColumn("_r", F.explode(F.sequence(F.floor(F.col("y0") / side), F.floor(F.col("y1") / side)))).withColumn("_c", F.explode(F.sequence(F.floor(F.col("x0") / side), F.floor(F.col("x1") / side))))
    inside = (F.col("col") + 0.5).between(F.col("x0"), F.col("x1")) & (F.col("row") + 0.5).between(F.col("y0"), F.col("y1"))
    at = px.withColumn("_r", F.floor(F.col("row") / side)).withColumn("_c", F.floor(F.col("col") / side))
    hit = at.join(cells, ["scene", "_r", "_c"]).filter(inside)
    return hit.groupBy("id").agg(F.avg("v").alias("mean"), F.max("v").alias("largest"), F.count("*").alias("n"))


def downsample(px: DataFrame, k: int) -> DataFrame:
    """Mean of each k by k block."""
    return px.groupBy("scene", F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col")).agg(F.avg("v").alias("v"))


def box_blur(px: DataFrame, radius: int) -> DataFrame:
    """Separable mean over a square, cut at the edge: along rows, then along columns, as window frames."""
    along = Window.partitionBy("scene", "row").orderBy("col").rowsBetween(-radius, radius)
    across = Window.partitionBy("scene", "col").orderBy("row").rowsBetween(-radius, radius)
    return px.withColumn("v", F.avg("v").over(along)).withColumn("v", F.avg("v").over(across))


def overlap_mean(windows: DataFrame) -> DataFrame:
    """Mean over the windows (scene, r0, c0, width, values) that cover each place."""
    px = windows.select("scene", "r0", "c0", "width", F.posexplode("values").alias("pos", "v"))
    place = px.select("scene", (F.col("r0") + F.floor(F.col("pos") / F.col("width"))).alias("row"), (F.col("c0") + F.col("pos") % F.col("width")).alias("col"), "v")
    return place.groupBy("scene", "row", "col").agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def channel_stats(df: DataFrame, image: str, channel: str, value: str) -> DataFrame:
    """Mean and deviation of each channel, averaged over images."""
    each = df.groupBy(image, channel).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return each.groupBy(channel).agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))


def centroids(labelled: DataFrame, least: int) -> DataFrame:
    """Mean row and column of the labels with enough pixels."""
    return labelled.groupBy("label").agg(F.count("*").alias("pixels"), F.avg("row").alias("row"), F.avg("col").alias("col")).filter(F.col("pixels") >= least)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def classify(height: Column, rectangularity: Column, rise: float, least_rect: float, forced: str | None = None) -> Column:
    """Class of a candidate: the forced one, by height where it is known, else by shape."""
    if forced is not None:
        return F.lit(forced)
    by_height = F.when(height >= rise, "likely_new_building").when(height <= -rise, "likely_demolition").otherwise("construction_change_candidate")
    return F.when(height.isNotNull(), by_height).when(rectangularity >= least_rect, "likely_building_change").otherwise("construction_change_candidate")


def shadow_risk(fraction: Column) -> Column:
    """high from 0.5, medium from 0.15, else low; a fraction outside 0..1 is an error."""
    bad = (fraction < 0) | (fraction > 1)
    return F.when(bad, F.raise_error(F.lit("shadow fraction must be between 0 and 1"))).when(fraction >= 0.5, "high").when(fraction >= 0.15, "medium").when(fraction.isNotNull(), "low")
