import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltascape.operators.spatial import ring_area
from deltascape.sources import geojson as J
from deltascape.sources import geotiff, images
from deltascape.sources import services as V
from deltascape.streaming.arrivals import windowed_counts


def polygon(w, s, e, n):
    return {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}


def collection(*features, **metadata):
    return {"type": "FeatureCollection", "features": list(features), "metadata": metadata}


def feature(geometry, **properties):
    return {"type": "Feature", "geometry": geometry, "properties": properties}


def saved(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_features(spark, tmp_path):
    hole = {"type": "MultiPolygon", "coordinates": [polygon(1, 1, 2, 2)["coordinates"] + [[[1.4, 1.4], [1.6, 1.4], [1.6, 1.6], [1.4, 1.6], [1.4, 1.4]]], polygon(3, 1, 4, 2)["coordinates"]]}
    path = saved(tmp_path / "a.geojson", collection(feature(polygon(145.4, -36.34, 145.4001, -36.3399), candidate_id=7, classification="x", model=""), {"type": "Other"}, feature(None), feature({"type": "Point", "coordinates": [1, 2]}), feature(hole, candidate_source="s")))
    got = J.read_features(spark, path, "one").orderBy("idx").collect()
    assert [(r.idx, r.id, r.classification, r.model, r.source) for r in got] == [(1, "7", "x", None, "one"), (5, "5", "construction_change_candidate", "s", "one")]
    assert (got[0].x0, got[0].y0) == J.project(145.4, -36.34) and len(got[1].rings) == 3
    J.write_features(J.read_features(spark, path, "one"), str(tmp_path / "out"), ["id", "classification"], [F.col("idx")])
    back = json.loads(next((tmp_path / "out").glob("part*")).read_text())
    assert [f["properties"] for f in back["features"]] == [{"id": "7", "classification": "x"}, {"id": "5", "classification": "construction_change_candidate"}]
    assert back["features"][0]["geometry"]["coordinates"][0][0] == pytest.approx([145.4, -36.34], abs=1e-7) and len(back["features"][1]["geometry"]["coordinates"]) == 2
    again = J.read_features(spark, saved(tmp_path / "b.geojson", back), "one")
    areas = lambda df: [r.a for r in df.orderBy("idx").select(ring_area("rings").alias("a")).collect()]
    assert areas(again) == pytest.approx(areas(J.read_features(spark, path, "one")), rel=1e-6)
    with pytest.raises(J.CollectionError):
        J.read_features(spark, saved(tmp_path / "c.geojson", {"type": "Feature"}))


def test_named_sources(spark, tmp_path):
    a, b = (saved(tmp_path / f"{n}.geojson", collection(*[feature(polygon(i, 0, i + 1, 1)) for i in range(k)])) for n, k in (("a", 2), ("b", 3)))
    got = J.read_sources(spark, [f"one={a}", f" two = {b}"]).orderBy("idx").collect()
    assert [(r.idx, r.source) for r in got] == [(1, "one"), (2, "one"), (3, "two"), (4, "two"), (5, "two")]
    for bad in ([f"one={a}", f"one={b}"], ["nothing"], []):
        with pytest.raises(J.CollectionError):
            J.read_sources(spark, bad)


def test_labels_world_file_and_page(spark, tmp_path):
    path = saved(tmp_path / "l.json", {"labels": [{"review_candidate_id": 1, "assessment": "real", "issues": ["pool"], "buildings": {"detected": 1, "total": 2}}, {"review_candidate_id": 2}]})
    got = J.read_labels(spark, path).collect()
    assert [(r.review_candidate_id, r.assessment, r.issues, r.total) for r in got] == [(1, "real", ["pool"], 2), (2, None, [], None)]
    w = spark.createDataFrame([("0.1\n0\n0\n-0.1\n500\n900\n",)], "t string").select(J.world_file(F.col("t")).alias("w")).first().w
    assert tuple(w) == (0.1, 0.0, 500.0, 0.0, -0.1, 900.0)
    rows = spark.createDataFrame([("a<b", 5.0), ("c", 9.0)], "id string, area_m2 double")
    page = J.review_page(rows, ["id", "area_m2"]).first().html
    assert "a&lt;b" in page and page.index(">c<") < page.index("a&lt;b")
    assert "No candidates" in J.review_page(rows.limit(0), ["id"]).first().html


def test_images(spark, tmp_path):
    bands = np.arange(3 * 300 * 280, dtype=np.float32).reshape(3, 300, 280)
    bands[:, 0, 0] = -9999
    (tmp_path / "i.tif").write_bytes(geotiff.write(geotiff.Raster(bands, (2.0, 0.0, 10.0, 0.0, -2.0, 50.0), 3857, -9999.0)))
    got = images.read_tiles(spark, str(tmp_path / "i.tif"), "s").collect()
    assert len(got) == 4 and np.isnan(np.frombuffer(got[0].data, np.float32)).sum() == 3
    g = images.read_grid(spark, str(tmp_path / "i.tif")).first()
    assert (list(g.affine), g.epsg, g.height, g.width) == ([2.0, 0.0, 10.0, 0.0, -2.0, 50.0], 3857, 300, 280)
    same = images.resample(geotiff.Raster(bands, (2.0, 0.0, 10.0, 0.0, -2.0, 50.0), 3857, -9999.0), (2.0, 0.0, 10.0, 0.0, -2.0, 50.0), 300, 280, 3)
    assert np.allclose(same[:, 1:, 1:], bands[:, 1:, 1:]) and np.isnan(same[0, 0, 0])
    half = images.read_onto(spark, str(tmp_path / "i.tif"), "s", (4.0, 0.0, 10.0, 0.0, -4.0, 50.0), 150, 140)
    assert half.count() == 1
    tiles = images.read_tiles(spark, str(tmp_path / "i.tif"), "s")
    images.write_tiles(tiles, str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 4
    back = geotiff.read(bytes(images.encoded(tiles, (2.0, 0.0, 10.0, 0.0, -2.0, 50.0), 3857).filter("tile_row = 1 AND tile_col = 1").first().content))
    assert (back.bands == bands[:, 256:, 256:]).all() and back.affine[2] == 10 + 2 * 256
    (tmp_path / "one.tif").write_bytes(geotiff.write(geotiff.Raster(bands[:1], epsg=3857)))
    with pytest.raises(Exception, match="bands"):
        images.read_tiles(spark, str(tmp_path / "one.tif"), "s").collect()


def test_image_pairs(spark, tmp_path):
    for sub in ("A", "B", "label"):
        (tmp_path / sub).mkdir()
        for stem in ("x", "y"):
            (tmp_path / sub / f"{stem}.png").write_bytes(sub.encode())
    assert sorted(r.stem for r in images.image_pairs(spark, str(tmp_path)).collect()) == ["x", "y"]
    names = spark.createDataFrame([("y",)], "stem string")
    assert [(r.stem, bytes(r.before)) for r in images.image_pairs(spark, str(tmp_path), names).collect()] == [("y", b"A")]


class Reply:
    def __init__(self, status, body=None, headers=None, content=b""):
        self.status_code, self.body, self.headers, self.content = status, body, headers or {}, content

    def json(self):
        return self.body


class Fake:
    """A session that gives prepared replies and keeps what it was asked."""

    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def get(self, url, **options):
        self.asked.append(("get", url, options))
        return self.replies.pop(0)

    def post(self, url, **options):
        self.asked.append(("post", url, options))
        return self.replies.pop(0)


def test_reprojection_on_read():
    """A grid in metres over an image in degrees finds the same places; unknown pairs are an error."""
    h, w, step = 40, 50, 1e-4
    rows, columns = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
    degrees = geotiff.Raster(np.stack([columns, rows]).astype(np.float32), (step, 0.0, 145.0, 0.0, -step, -37.0), 4326, None)
    x, y = images.reprojected(np.array([145.0 + 10.5 * step, 145.0 + 20.5 * step]), np.array([-37.0 - 10.5 * step, -37.0 - 20.5 * step]), 4326, 3857)
    metres = (float(x[1] - x[0]), 0.0, float(x[0]) - float(x[1] - x[0]) / 2, 0.0, float(y[1] - y[0]), float(y[0]) - float(y[1] - y[0]) / 2)
    got = images.resample(degrees, metres, 2, 2, 2, 3857)
    assert np.allclose(got[0], [[10, 20], [10, 20]], atol=1e-2) and np.allclose(got[1], [[10, 10], [20, 20]], atol=1e-2)
    back = images.reprojected(x, y, 3857, 4326)
    assert np.allclose(back[0], [145.0 + 10.5 * step, 145.0 + 20.5 * step]) and np.allclose(back[1], [-37.0 - 10.5 * step, -37.0 - 20.5 * step])
    with pytest.raises(ValueError):
        images.resample(degrees, metres, 2, 2, 2, 28355)


def test_wide_scenes_are_reduced():
    from deltascape.plans import detection as D

    assert [D.reduction(n) for n in (100, 1200, 1201, 5000, 307_200, 310_000, 10**7)] == [1, 1, 2, 8, 256, 256, 256]
    assert D.only_scene({("s", 0): [0.5]}) == [0.5]
    with pytest.raises(ValueError):
        D.only_scene({("s", 0): [0.5], ("t", 0): [0.6]})


def test_surveys():
    good = {"surveys": [{"id": "s", "captureDate": "2024-01-02T00:00:00Z", "pixelSize": 0.075, "resources": {"tiles": [{"type": "Vert", "scale": 20}, {"type": "Vert", "scale": 21}, {"type": "North", "scale": 22}]}}]}
    client = V.SurveyClient("root", "key", Fake(Reply(200, good)))
    assert client.tile_coverage(1, 2) == [{"id": "s", "capture_date": "2024-01-02", "pixel_sizes": {"Vert": 0.075}, "tile_zoom": 21}]
    with pytest.raises(V.ServiceError):
        V.SurveyClient("root", "key", Fake(Reply(200, good))).tile_coverage(1, 2, "South")
    with pytest.raises(V.ServiceError, match="token"):
        V.SurveyClient("root", "key", Fake(Reply(200, {}))).coverage(1, 2, 50, ["Vert", "Vert"])
    for call in (lambda c: c.coverage(1, 2, 500, ["Vert"]), lambda c: c.coverage(1, 2, 5, []), lambda c: c.download("s", "Vert", "t", 1, 2, 5, 9000)):
        with pytest.raises(ValueError):
            call(V.SurveyClient("root", "key", Fake()))
    waits = []
    busy = V.SurveyClient("root", "key", Fake(Reply(429), Reply(503), Reply(200, content=b"jpg")), sleep=waits.append)
    assert busy.tile("s", "Vert", 20, 1, 2) == b"jpg" and waits == [1.0, 2.0]
    with pytest.raises(V.ServiceError):
        V.SurveyClient("root", "key", Fake(*[Reply(429)] * 4), sleep=waits.append).tile("s", "Vert", 20, 1, 2)


class Pages:
    """A footprint service by offset, as executors ask it in any order."""

    def __init__(self, *records, total=None):
        self.records, self.total = records, len(records) if total is None else total

    def get(self, url, params, timeout):
        return Reply(200, {"total_count": self.total, "results": list(self.records[params["offset"] : params["offset"] + params["limit"]])})


def test_footprint_pages(spark):
    record = {"geo_shape": {"geometry": polygon(0, 0, 1, 1)}}
    records = [record, {"geo_shape": {"type": "Point"}}, {"geo_shape": polygon(0, 0, 2, 2)}, {}, record]
    where = V.bbox_clause(144.951, -37.811, 144.953, -37.809)
    assert where == "in_bbox(geo_point_2d, -37.811, 144.951, -37.809, 144.953)"
    got = V.footprint_snapshot(spark, lambda: Pages(*records), "url", where, 2023, 2).orderBy("candidate_id").collect()
    assert [(r.candidate_id, r.snapshot_year, json.loads(r.geometry)) for r in got] == [(1, 2023, polygon(0, 0, 1, 1)), (2, 2023, polygon(0, 0, 2, 2)), (3, 2023, polygon(0, 0, 1, 1))]
    assert V.footprint_snapshot(spark, lambda: Pages(), "url", where, 2023).count() == 0
    assert [list(p) for p in V.footprint_pages(Pages(*records), "url", where, 2)] == [records[:2], records[2:4], records[4:]]
    with pytest.raises(V.ServiceError):
        list(V.footprint_pages(Pages(total=2), "url", where))
    with pytest.raises(Exception, match="empty before the declared total"):
        V.footprint_snapshot(spark, lambda: Pages(*records, total=20), "url", where, 2023, 5).collect()
    with pytest.raises(ValueError):
        V.bbox_clause(2, 0, 1, 1)


def test_jobs(spark):
    result = collection(feature(polygon(0, 0, 1, 1), vlm_type="pool", relevant=True), feature(polygon(0, 0, 1, 1), label="shed", relevant="yes"), "junk")
    session = Fake(Reply(200, {"access_token": "t"}), Reply(202, {"job_id": "j"}), Reply(200, {"status": "running"}), Reply(200, {"status": "done", "result": result}))
    waits = []
    client = V.JobClient("root", "u", "secret", session, sleep=waits.append, monotonic=lambda: 0.0)
    assert client.submit("analyze", {}) == "j"
    got = V.normalised_result(spark, client.wait("analyze", "j"), "remote", "d", "m")
    assert [(r.classification, r.relevant, r.candidate_source) for r in got.collect()] == [("pool", True, "remote"), ("shed", False, "remote")] and waits == [5.0]
    assert got.filter("relevant = true").count() == 1 and "secret" not in str(got.collect())
    for status in ({"status": "error"}, {"status": "done"}, {"status": "odd"}):
        with pytest.raises(V.ServiceError):
            V.JobClient("root", "u", "p", Fake(Reply(200, {"access_token": "t"}), Reply(200, status))).wait("analyze", "j")
    with pytest.raises(V.ServiceError):
        V.JobClient("root", "u", "p", Fake(Reply(200, {"access_token": "t"}), Reply(200, {"job_id": "j"}))).submit("analyze", {})


def chat(text):
    return {"choices": [{"message": {"content": text}}]}


def test_reviewer(monkeypatch):
    monkeypatch.setenv("REVIEW_KEY", "k")
    make = lambda *r: V.ChatReviewer("url", "m", "REVIEW_KEY", Fake(*r), "poll", sleep=lambda s: None, monotonic=lambda: 0.0)
    assert make(Reply(200, chat("ok"))).classify(b"a", b"b", "p") == "ok"
    slow = make(Reply(202, headers={"X-Request-Id": "r"}), Reply(202), Reply(200, chat("late")))
    assert slow.classify(b"a", b"b", "p") == "late" and len(slow.session.asked) == 3
    refused = make(Reply(422), Reply(200, chat("never")))
    with pytest.raises(V.ServiceError):
        refused.classify(b"a", b"b", "p")
    assert len(refused.session.asked) == 1
    assert make(Reply(503), Reply(200, chat("again"))).classify(b"a", b"b", "p") == "again"
    with pytest.raises(V.ServiceError):
        make(Reply(202), Reply(202), Reply(202)).classify(b"a", b"b", "p")
    monkeypatch.delenv("REVIEW_KEY")
    with pytest.raises(V.ServiceError, match="REVIEW_KEY"):
        make().classify(b"a", b"b", "p")


def test_review_and_budget(spark):
    class Reviewer:
        def classify(self, before, after, prompt):
            if before == b"bad":
                raise RuntimeError
            return '{"label": "pool"}'

    rows = [(1, 5.0, b"x", b"y"), (2, 50.0, b"bad", b"y"), (3, 70.0, None, b"y"), (4, 90.0, b"x", b"y")]
    df = spark.createDataFrame(rows, "id long, area_m2 double, before binary, after binary")
    got = {r.id: r.reply for r in V.review(df, Reviewer, "p", 10.0).collect()}
    assert got == {2: None, 3: None, 4: '{"label": "pool"}'}
    assert [r.id for r in V.review(df, Reviewer, "p", 10.0, 1).collect()] == [4]
    image = np.zeros((400, 400, 3), np.uint8)
    assert len(V.encode_within(image, lambda a, q: b"x" * (a.shape[0] * q), 8000)) <= 8000
    assert V.encode_within(image, lambda a, q: b"x" * 10**6) is None


def test_fetch_tiles(spark):
    places = spark.createDataFrame([("s", "Vert", 20, 1, 2)], "survey_id string, kind string, zoom int, x long, y long")
    got = V.fetch_tiles(places, lambda: V.SurveyClient("root", "k", type("S", (), {"get": lambda self, url, **o: type("R", (), {"status_code": 200, "content": url.encode()})()})())).first()
    assert bytes(got.content) == b"root/tiles/v3/surveys/s/Vert/20/1/2.jpg"
    with pytest.raises(ValueError):
        V.fetch_tiles(places, lambda: None, 0)


def test_arrivals_as_table_and_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10", "a", 1.0), (1, "2024-01-01 00:00:10", "a", 1.0), (2, "2024-01-01 00:01:00", "a", 3.0), (3, "2024-01-01 00:07:00", "b", 5.0)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").selectExpr("event_id", "cast(t as timestamp) AS ts", "event_type", "value")
    want = [("a", 2, 2.0), ("b", 1, 5.0)]
    assert sorted((r.event_type, r.n, r.mean_value) for r in windowed_counts(df).collect()) == want
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("arrivals").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.event_type, r.n, r.mean_value) for r in spark.table("arrivals").collect()) == want
