import json

import numpy as np
import pytest

from deltascape.__main__ import main
from deltascape.operators import tiles as T
from deltascape.plans import review as R
from deltascape.plans.detection import Grid
from deltascape.sources import geotiff

from .test_rasters import tiles
from .test_sources import collection, feature, polygon, saved

GRID = Grid((1.0, 0.0, 0.0, 0.0, -1.0, 100.0))


def result(path):
    return [json.loads(line) for p in sorted(path.glob("part*")) for line in p.read_text().splitlines()]


def test_vector_commands(spark, tmp_path):
    a, b = polygon(145.4, -36.34, 145.4001, -36.3399), polygon(145.41, -36.34, 145.4101, -36.3399)
    before, after = saved(tmp_path / "before.json", collection(feature(a))), saved(tmp_path / "after.json", collection(feature(a), feature(b)))
    assert main(["compare", before, after, "--out", str(tmp_path / "c")]) == 0
    made = json.loads(next((tmp_path / "c/changes").glob("part*")).read_text())
    assert [f["properties"]["classification"] for f in made["features"]] == ["new_building_footprint_candidate"]
    assert {r["classification"]: r["n"] for r in result(tmp_path / "c/report")} == {"new_building_footprint_candidate": 1, "building_extension_footprint_candidate": 0}
    assert main(["fuse", f"one={before}", f"two={after}", "--out", str(tmp_path / "f")]) == 0
    assert sorted(r["source_count"] for r in result(tmp_path / "f/fused")) == [1, 2]
    assert main(["sites", after, before, "--out", str(tmp_path / "s")]) == 0
    assert sorted(r["review_priority"] for r in result(tmp_path / "s/sites")) == ["low", "medium"]
    labels = saved(tmp_path / "labels.json", {"labels": [{"reference_candidate_id": 1, "assessment": "real_change"}, {"reference_candidate_id": 2, "assessment": "no"}]})
    assert main(["evaluate", after, labels, before, "--out", str(tmp_path / "e")]) == 0
    assert result(tmp_path / "e/report")[0]["reference_recall"] == 1.0
    assert main(["evaluate", before, labels, before, "--out", str(tmp_path / "e2")]) == 1
    assert main(["summarise", labels, "--out", str(tmp_path / "u")]) == 0
    assert main(["page", after, "--out", str(tmp_path / "p")]) == 0
    assert main(["fuse", "nothing", "--out", str(tmp_path / "x")]) == 1


def test_detect_command(spark, tmp_path):
    before = np.full((3, 80, 90), 80, np.uint8)
    after = before.copy()
    after[:, 30:60, 35:70] = 200
    for name, bands in (("b", before), ("a", after)):
        (tmp_path / f"{name}.tif").write_bytes(geotiff.write(geotiff.Raster(bands, (1.0, 0.0, 0.0, 0.0, -1.0, 80.0), 3857)))
    assert main(["detect", str(tmp_path / "b.tif"), str(tmp_path / "a.tif"), "--preset", "high-recall", "--out", str(tmp_path / "o")]) == 0
    report = result(tmp_path / "o/report")[0]
    assert report["candidate_count"] >= 1
    found = json.loads(next((tmp_path / "o/candidates").glob("part*")).read_text())
    assert found["features"] and found["features"][0]["properties"]["classification"] in ("likely_building_change", "construction_change_candidate")


def test_shadow_annotation(spark):
    image = np.full((3, 100, 100), 180.0)
    image[:, :5], image[:, 5:10] = 0, 255
    dark = image.copy()
    dark[:, 40:60, 40:60] = 50
    ring = lambda x0, y0, x1, y1: [[{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]
    rows = [(1, ring(42.0, 42.0, 58.0, 58.0)), (2, ring(80.0, 10.0, 90.0, 20.0)), (3, ring(900.0, 10.0, 910.0, 20.0))]
    shapes = spark.createDataFrame(rows, "idx long, rings array<array<struct<x:double,y:double>>>")
    shapes = shapes.union(spark.createDataFrame([(4, None), (5, []), (6, [[{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 2.0}]])], shapes.schema))
    got = {r.idx: r for r in R.annotate_shadow(tiles(spark, dark), tiles(spark, image), shapes, GRID).collect()}
    assert got[1].shadow_risk == "high" and got[1].before_shadow_fraction > 0.5 > got[1].after_shadow_fraction
    assert got[2].shadow_risk == "low" and got[3].shadow_risk == "no_valid_pixels"
    assert {(got[k].shadow_risk, got[k].combined_shadow_fraction) for k in (4, 5, 6)} == {("invalid_geometry", None)}


def image(path, bands):
    path.write_bytes(geotiff.write(geotiff.Raster(bands, (1.0, 0.0, 0.0, 0.0, -1.0, 100.0), 3857)))
    return str(path)


def metres(x0, y0, x1, y1):
    from deltascape.sources.geojson import unproject

    return {"type": "Polygon", "coordinates": [[unproject(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]}


def test_shadow_and_expand_commands(spark, tmp_path):
    bright = np.full((3, 100, 100), 180, np.uint8)
    bright[:, :5], bright[:, 5:10] = 0, 255
    dark = bright.copy()
    dark[:, 40:60, 40:60] = 50
    features = saved(tmp_path / "c.json", collection(feature(metres(42, 42, 58, 58)), feature(metres(80, 10, 90, 20)), feature({"type": "Point", "coordinates": [0, 0]})))
    assert main(["shadow", image(tmp_path / "b.tif", dark), image(tmp_path / "a.tif", bright), features, "--out", str(tmp_path / "s")]) == 0
    assert {r["shadow_risk"]: r["n"] for r in result(tmp_path / "s/report")} == {"high": 1, "medium": 0, "low": 1, "no_valid_pixels": 0, "invalid_geometry": 1}
    made = json.loads(next((tmp_path / "s/annotated").glob("part*")).read_text())["features"]
    assert [f["properties"]["shadow_risk"] for f in made] == ["high", "low", "invalid_geometry"] and made[2]["geometry"] is None

    score = np.zeros((1, 100, 100), np.float32)
    score[0, 30:50, 30:50], score[0, 80:95, 80:95] = 0.9, 0.9  # only the first holds a seed
    path = image(tmp_path / "score.tif", score)
    assert main(["expand", saved(tmp_path / "seed.json", collection(feature(metres(36, 54, 42, 62)))), path, "--percentile", "94", "--reach", "30", "--out", str(tmp_path / "x")]) == 0
    report = result(tmp_path / "x/report")[0]
    assert report["candidate_count"] == 1 and report["seed_candidate_count"] == 1 and report["grow_threshold"] == pytest.approx(0.9, abs=1e-3)
    grown = json.loads(next((tmp_path / "x/candidates").glob("part*")).read_text())["features"]
    assert grown[0]["properties"]["area_m2"] == pytest.approx(400, rel=0.1)
    assert main(["expand", saved(tmp_path / "none.json", collection()), path, "--out", str(tmp_path / "y")]) == 1


def test_sample_and_enhanced_commands(spark, tmp_path):
    at = [polygon(145.4 + k / 1000, -36.34, 145.4001 + k / 1000, -36.3399) for k in range(8)]
    made = [{**feature(g), "properties": {"candidate_id": k, "area_m2": 30.0 + 20 * k, "change_support": {"tier": "ab"[k % 2]}}} for k, g in enumerate(at)]
    path = saved(tmp_path / "c.json", collection(*made))
    assert main(["sample", path, "--target", "4", "--least", "1", "--out", str(tmp_path / "s")]) == 0
    drawn = json.loads(next((tmp_path / "s/sample").glob("part*")).read_text())["features"]
    assert len(drawn) == sum(r["sampled"] for r in result(tmp_path / "s/plan"))
    assert {f["properties"]["review_stratum"] for f in drawn} == {r["stratum"] for r in result(tmp_path / "s/plan")}
    labels = saved(tmp_path / "l.json", {"labels": {str(k): "correct" if k < 4 else "wrong" for k in range(8)}})
    assert main(["sample", path, "--labels", labels, "--out", str(tmp_path / "p")]) == 0
    assert result(tmp_path / "p/report")[0]["labelled"] == 8 and result(tmp_path / "p/report")[0]["weighted_precision"] == 0.5
    assert main(["enhanced", f"one={path}", f"two={path}", f"gone={tmp_path}/nothing.json", "--out", str(tmp_path / "e")]) == 0
    assert {r["channel"]: "error" in r for r in result(tmp_path / "e/channels")} == {"one": False, "two": False, "gone": True}
    assert {r["source_count"]: r["n"] for r in result(tmp_path / "e/by_sources")} == {2: 8}
    assert main(["enhanced", f"gone={tmp_path}/nothing.json", "--out", str(tmp_path / "z")]) == 1


def test_objects_and_channels(spark):
    before, after = np.zeros((1, 100, 100)), np.zeros((1, 100, 100))
    before[0, 10:20, 10:20] = after[0, 10:20, 10:20] = 0.9
    after[0, 50:70, 50:80] = 0.8
    got = R.compare_objects(tiles(spark, before), tiles(spark, after), GRID)
    changes = got["changes"].collect()
    assert got["before"].count() == 1 and got["after"].count() == 2 and len(changes) == 1 and changes[0].area_m2 == pytest.approx(600, rel=0.1)
    channel = got["after"].selectExpr("*", "'x' AS classification")
    made = R.enhanced({"one": channel, "two": channel.limit(1)})
    assert {r.source_count: r.n for r in made["by_sources"].collect()} == {2: 1, 1: 1}


def test_sample_and_ladder(spark):
    rows = spark.createDataFrame([(i, ("a", "b")[i % 2], float(i)) for i in range(200)], "id long, tier string, area_m2 double")
    got = R.review_sample(rows)
    n = got["sample"].count()
    assert n == sum(r.sampled for r in got["plan"].collect()) and set(json.loads(got["template"].first().labels).values()) == {"unlabelled"}
    with pytest.raises(ValueError):
        R.review_sample(rows.limit(0))
    image = np.arange(256 * 256.0).reshape(1, 256, 256)
    coarse = R.resolution_ladder(tiles(spark, image), [2])[2].first()
    assert T.array_of(coarse)[0, 0, 0] == pytest.approx(image[0, :2, :2].mean())
