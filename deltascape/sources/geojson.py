"""GeoJSON and label files as DataFrames, and back. Files are read and written by Spark, from and to any store."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascape.functions import text as T
from deltascape.functions.geometry import EARTH
from deltascape.plans.storage import materialise

RINGS = "array<array<struct<x:double,y:double>>>"
#: Properties that are read as columns of their own; the whole object stays in column properties.
KNOWN = "candidate_id string, classification string, area_m2 double, requested_detector string, model string, candidate_source string, source_count int, candidate_sources array<string>, relevant boolean"


class CollectionError(ValueError):
    """A file that is no usable feature collection."""


def project(lon: float, lat: float) -> tuple[float, float]:
    """Map metres of a position, rounded as stored geometry is."""
    return round(EARTH * math.radians(lon), 6), round(EARTH * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)), 6)


def unproject(x: float, y: float, digits: int = 8) -> tuple[float, float]:
    return round(math.degrees(x / EARTH), digits), round(math.degrees(2 * math.atan(math.exp(y / EARTH)) - math.pi / 2), digits)


def metric_rings(geometry: str | None) -> list | None:
    """Rings in map metres of a GeoJSON Polygon or MultiPolygon; null for anything else."""
    try:
        g = json.loads(geometry or "null")
        polygons = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}[g["type"]](g["coordinates"])
        return [[dict(zip("xy", project(*p[:2]), strict=True)) for p in ring] for polygon in polygons for ring in polygon]
    except (KeyError, TypeError, ValueError):
        return None


def read_features(spark: SparkSession, path: str, source: str | None = None, broken: bool = False) -> DataFrame:
    """One row per feature that is an object with a polygon: idx (its place from 1), id, classification, model, source,
    rings and box in map metres, known properties, and the raw properties.

    A file that is no FeatureCollection raises; features that are none are left out, as are
    other geometries, unless broken ones are asked for: these have null rings.
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "type string, features array<string>, metadata string").alias("c"), "value").select("c.*", "value")
    ok = (F.col("type") == "FeatureCollection") & F.col("features").isNotNull()
    if whole.filter(~F.coalesce(ok, F.lit(False))).count() or whole.isEmpty():
        raise CollectionError(f"{path} is no GeoJSON FeatureCollection")
    rows = whole.select(F.posexplode("features").alias("place", "f"), F.get_json_object("metadata", "$.requested_detector").alias("made_by"))
    rows = rows.withColumn("geometry", F.get_json_object("f", "$.geometry")).withColumn("properties", F.coalesce(F.get_json_object("f", "$.properties"), F.lit("{}")))
    rows = rows.filter(F.get_json_object("f", "$.type") == "Feature").withColumn("rings", _rings_udf()("geometry")).filter(F.col("rings").isNotNull() | F.lit(broken))
    rows = rows.withColumn("p", F.from_json("properties", KNOWN)).withColumn("idx", (F.col("place") + 1).cast("long"))
    flat = F.flatten("rings")
    edge = lambda pick, axis: pick(F.transform(flat, lambda p: p[axis]))
    return rows.select(
        "idx", F.coalesce(F.col("p.candidate_id"), F.col("idx").cast("string")).alias("id"), F.coalesce(F.col("p.classification"), F.lit("construction_change_candidate")).alias("classification"),
        T.falsy_coalesce(F.col("p.requested_detector"), F.col("p.model"), F.col("p.candidate_source")).alias("model"), F.lit(source).alias("source"), "p.area_m2", "p.source_count", F.col("p.candidate_sources").alias("sources"), "p.relevant",
        edge(F.array_min, "x").alias("x0"), edge(F.array_min, "y").alias("y0"), edge(F.array_max, "x").alias("x1"), edge(F.array_max, "y").alias("y1"), "rings", "properties", "made_by",
    )


def _rings_udf():
    def rings(geometries: pd.Series) -> pd.Series:
        return geometries.map(metric_rings)

    return F.pandas_udf(rings, RINGS)


def read_sources(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """Candidates of several files given as name=path, idx running through all of them in the order given."""
    seen: set[str] = set()
    out: DataFrame | None = None
    at = 0
    for value in inputs:
        name, sign, path = value.partition("=")
        name, path = name.strip(), path.strip()
        if not sign or not name or not path:
            raise CollectionError(f"expected name=path, got {value!r}")
        if name in seen:
            raise CollectionError(f"source {name!r} is given twice")
        seen.add(name)
        rows = materialise(read_features(spark, path, name), "features")
        n = rows.agg(F.max("idx")).first()[0] or 0
        rows = rows.withColumn("idx", F.col("idx") + at)
        at += n
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise CollectionError("no sources are given")
    return out


def geometry_json(rings: list, digits: int = 8) -> str:
    """GeoJSON of rings in map metres: holes go to the outer ring that holds them."""
    import numpy as np

    from deltascape.functions import polygons as P

    arrays = [np.array([(p["x"], p["y"]) for p in ring]) for ring in rings]
    depth = [sum(bool(P.contains([o], a[:1, 0], a[:1, 1])[0]) for k, o in enumerate(arrays) if k != i) for i, a in enumerate(arrays)]
    outer = [i for i, d in enumerate(depth) if d % 2 == 0]
    polygons = {i: [i] for i in outer}
    for i, d in enumerate(depth):
        if d % 2:
            home = min((o for o in outer if P.contains([arrays[o]], arrays[i][:1, 0], arrays[i][:1, 1])[0]), key=lambda o: abs(P.ring_area(arrays[o])))
            polygons[home].append(i)
    close = lambda a: [list(unproject(x, y, digits)) for x, y in (a if (a[0] == a[-1]).all() else np.vstack([a, a[:1]]))]
    made = [[close(arrays[i]) for i in members] for members in polygons.values()]
    return json.dumps({"type": "Polygon", "coordinates": made[0]} if len(made) == 1 else {"type": "MultiPolygon", "coordinates": made})


def feature_text(df: DataFrame, properties: list[str]) -> Column:
    """A row as a GeoJSON feature, as text."""

    def geometries(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: "null" if r is None else geometry_json(json.loads(r)))

    body = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.pandas_udf(geometries, "string")(F.to_json("rings")), F.lit(',"properties":'), body, F.lit("}"))


def write_features(df: DataFrame, path: str, properties: list[str], order: list[Column]) -> None:
    """A FeatureCollection: one text file in a folder, features in order. For results that a reviewer opens."""
    lines = df.select(F.row_number().over(_window(order)).alias("n"), feature_text(df, properties).alias("f"))
    whole = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "f"))), lambda s: s["f"]), ",\n").alias("f"))
    whole.select(F.concat(F.lit('{"type":"FeatureCollection","features":[\n'), F.coalesce("f", F.lit("")), F.lit("\n]}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _window(order: list[Column]):
    from pyspark.sql import Window

    return Window.orderBy(*order)


def write_report(df: DataFrame, path: str) -> None:
    """One-row frames as one JSON object."""
    df.coalesce(1).write.mode("overwrite").json(path)


LABELS = "labels array<struct<review_candidate_id:int,reference_candidate_id:int,assessment:string,outline_quality:string,issues:array<string>,buildings:struct<detected:int,total:int>>>"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a JSON file with a list `labels`: ids, assessment, outline_quality, issues, detected, total."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", LABELS)["labels"].alias("labels"))
    if whole.filter(F.col("labels").isNull()).count():
        raise CollectionError(f"{path} has no list of labels")
    return whole.select(F.explode("labels").alias("l")).select(
        "l.review_candidate_id", "l.reference_candidate_id", "l.assessment", "l.outline_quality", F.coalesce("l.issues", F.array().cast("array<string>")).alias("issues"), "l.buildings.detected", "l.buildings.total"
    )


def world_file(text: Column) -> Column:
    """The affine (a, b, c, d, e, f) of a world file's six lines, which stand in the order a, d, b, e, c, f."""
    v = F.transform(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), lambda s: s.cast("double"))
    return F.struct(v[0].alias("a"), v[2].alias("b"), v[4].alias("c"), v[1].alias("d"), v[3].alias("e"), v[5].alias("f"))


def review_page(candidates: DataFrame, properties: list[str]) -> DataFrame:
    """One row: an HTML page of the candidates, largest first, every property escaped; a note if there are none."""
    cells = [F.concat(F.lit("<td>"), T.html_escape(F.coalesce(F.col(p).cast("string"), F.lit(""))), F.lit("</td>")) for p in properties]
    rows = candidates.select(F.col("area_m2"), F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("r"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("area_m2", "r")), asc=False), lambda s: s["r"]), "\n")
    head = "<tr>" + "".join(f"<th>{p}</th>" for p in properties) + "</tr>"
    return rows.agg(F.when(F.count("*") == 0, F.lit("<!DOCTYPE html><p>No candidates to review.</p>")).otherwise(F.concat(F.lit(f"<!DOCTYPE html><table>{head}\n"), body, F.lit("\n</table>"))).alias("html"))
