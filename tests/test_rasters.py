import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deltascape.functions import kernels as K
from deltascape.operators import tiles as T
from deltascape.plans.config import Settings
from deltascape.plans.detection import Grid, detect, expand
from deltascape.sources import geotiff

GRID = Grid((1, 0, 0, 0, -1, 100))
PLAIN = Settings().with_values({"threshold.fixed": 0.05, "shape.opening_m": 0, "shape.min_area_m2": 20, "registration.enabled": False})


def tiles(spark, a, tile=T.TILE):
    return spark.createDataFrame(T.tile_rows("s", np.asarray(a, float), tile), T.SCHEMA)


def whole(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[:, r.row0 : r.row0 + r.h, r.col0 : r.col0 + r.w] = np.frombuffer(r.data, np.float32).reshape(r.bands, r.h, r.w)
    return out


@pytest.mark.parametrize("kind", [np.uint8, np.int16, np.float32, np.float64])
@pytest.mark.parametrize("compression", ["lzw", "deflate", "none"])
def test_tiff_round_trip(kind, compression):
    bands = (np.random.default_rng(0).random((3, 90, 130)) * 200).astype(kind)
    bands[:, 20:60] = 7
    made = geotiff.Raster(bands, (0.5, 0.0, 100.0, 0.0, -0.5, 200.0), 3857, -9999.0)
    got = geotiff.read(geotiff.write(made, compression))
    assert (got.bands == bands).all() and got.bands.dtype == kind and (got.affine, got.epsg, got.nodata) == (made.affine, 3857, -9999.0)
    assert got.pixel_m == 0.5
    with pytest.raises(ValueError):
        geotiff.read(b"no tiff at all")


@given(st.binary(max_size=6000))
def test_lzw(data):
    assert geotiff.lzw_decode(geotiff.lzw_encode(data)) == data


def flood(mask, eight):
    """Labels by search, one region after the other."""
    out, n = np.zeros(mask.shape, int), 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        out[start], stack = n, [start]
        while stack:
            r, c = stack.pop()
            for a, b in steps:
                p = (r + a, c + b)
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                    out[p] = n
                    stack.append(p)
    return out, n


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.floats(0, 1), st.integers(0, 9), st.booleans())
def test_labels_equal_a_search(h, w, share, seed, eight):
    mask = np.random.default_rng(seed).random((h, w)) < share
    got, n = K.label(mask, eight)
    want, m = flood(mask, eight)
    assert n == m and (got == want).all()


def test_morphology_by_definition():
    rng = np.random.default_rng(1)
    mask, e = rng.random((30, 40)) > 0.6, K.ellipse(5)
    padded = np.pad(mask, 2)
    want = np.array([[(padded[r : r + 5, c : c + 5] & e).any() for c in range(40)] for r in range(30)])
    assert (K.dilate(mask, e) == want).all()
    assert (K.erode(mask, e) == ~K.dilate(~np.pad(mask, 2, constant_values=True), e)[2:-2, 2:-2]).all()
    assert K.ellipse(3).tolist() == [[False, True, False], [True, True, True], [False, True, False]]


def test_lab_and_blur():
    assert K.lab(np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0]]], float)).tolist() == [[[255, 128, 128], [0, 128, 128], [136, 208, 195]]]
    flat = np.full((20, 30), 7.0)
    assert np.allclose(K.blur5(flat), 7) and np.allclose(K.blur(flat, 12.0), 7)
    a = np.random.default_rng(0).random((40, 300))
    k = K.gaussian_kernel(9.0)
    assert np.allclose(K.blur(a, 9.0), K.convolve(K.convolve(a, k, 0), k, 1))


def test_registration():
    rng = np.random.default_rng(0)
    img = K.blur5(np.kron(rng.random((16, 16)), np.ones((8, 8)))[..., None] * np.array([200, 180, 160]))
    ok = np.ones(img.shape[:2], bool)
    s = K.register(K.moved(img, 2.3, -1.6), img, ok)
    assert s.applied and s.dx == pytest.approx(-2.3, abs=0.1) and s.dy == pytest.approx(1.6, abs=0.1)
    assert K.register(K.moved(img, 15, 0), img, ok).reason == "shift_exceeds_limit"
    assert K.register(img, img, ok, enabled=False).reason == "disabled"
    assert K.register(img[:20], img[:20], ok[:20]).reason == "insufficient_valid_pixels"


@pytest.mark.parametrize("tile", [64, 256])
@pytest.mark.parametrize("halo", [3, 20, 70])
def test_halo_makes_tiles_equal_the_whole(spark, tile, halo):
    rng = np.random.default_rng(2)
    a = rng.random((1, 150, 210)) > 0.5
    e = K.ellipse(2 * (halo // 2) + 1)
    got = whole(T.with_halo(tiles(spark, a, tile), halo, lambda x, row: K.dilate(np.nan_to_num(x[0]) > 0, e)[None], tile), a.shape)
    assert (got[0] == K.dilate(a[0], e)).all()


def test_components_across_tiles(spark):
    mask = np.random.default_rng(3).random((150, 170)) > 0.6
    got = T.label_tiles(tiles(spark, mask[None], 32), 32).collect()
    labels = np.zeros(mask.shape, np.int64)
    for r in got:
        labels[r.rows, r.cols] = r.region
    want, n = K.label(mask)
    assert len({r.region for r in got}) == n
    assert len({*zip(labels[mask].tolist(), want[mask].tolist())}) == n


def test_detects_a_new_building(spark):
    before = np.full((3, 100, 100), 80.0)
    after = before.copy()
    after[:, 30:60, 35:70] = 200
    low, high = np.zeros((1, 100, 100)), np.zeros((1, 100, 100))
    high[:, 30:60, 35:70] = 4
    got = detect(tiles(spark, before), tiles(spark, after), GRID, PLAIN, tiles(spark, low), tiles(spark, high), before_date="2021-02-01")
    rows = got["candidates"].collect()
    assert [r.classification for r in rows] == ["likely_new_building"] and got["likely_buildings"].count() == 1
    assert rows[0].area_m2 == pytest.approx(30 * 35, rel=0.35) and rows[0].before_capture_date == "2021-02-01" and rows[0].after_capture_date == "unknown"
    report = got["report"].first()
    assert (report.candidate_count, report.threshold, report.registration_note) == (1, 0.05, "disabled")
    with pytest.raises(ValueError):
        detect(tiles(spark, before), tiles(spark, after), GRID, PLAIN, tiles(spark, low))


def test_defers_shadow(spark):
    before = np.full((3, 100, 100), 180.0)
    before[:, :5], before[:, 5:10] = 0, 255
    after = before.copy()
    before[:, 35:55, 35:55] = 50
    got = detect(tiles(spark, before), tiles(spark, after), GRID, PLAIN)
    assert got["candidates"].count() == 0
    assert {r.classification for r in got["uncertain"].collect()} == {"uncertain_shadow"}


def growth_scene():
    seeds, score = np.zeros((50, 50), bool), np.zeros((50, 50))
    seeds[20:25, 20:25] = True
    score[19:28, 19:30], score[2:10, 2:10], score[20:25, 20:25] = 0.7, 0.95, 1.0
    return seeds, score


def test_growth_stays_with_its_seed(spark):
    seeds, score = growth_scene()
    grown, cut = K.grow(seeds, score, np.ones((50, 50), bool), 1.0, 80, 6.0)
    assert grown.sum() > seeds.sum() and not grown[:12, :12].any() and grown[26, 26]
    got = whole(expand(tiles(spark, seeds[None]), tiles(spark, score[None]), GRID, 80, 6.0), (1, 50, 50))
    assert (got[0].astype(bool) == grown).all()
    with pytest.raises(ValueError):
        K.grow(seeds, score, np.ones((50, 50), bool), 1.0, 100, 6.0)


class FakeModel:
    """Logits that favour the first class everywhere."""

    def run(self, names, feed):
        h, w = feed["input"].shape[2:]
        out = np.zeros((1, 3, h, w))
        out[:, 0] = 4
        return [out]


def test_inference_with_a_fake_model(spark):
    from deltascape.sources.images import probability_tiles

    rgb = np.full((40, 50, 3), 255.0)
    p = K.infer(FakeModel(), rgb, np.ones((40, 50), bool))
    assert p.shape == (40, 50) and p.min() > 0.9
    x = K.model_input(np.array([[[255.0] * 3, [0.0] * 3]]))
    assert x[0, 0].tolist() == [pytest.approx((1 - 0.485) / 0.229, rel=1e-5), pytest.approx(-0.485 / 0.229, rel=1e-5)]
    got = whole(probability_tiles(tiles(spark, np.moveaxis(rgb, -1, 0)), FakeModel), (1, 40, 50))
    assert got.min() > 0.9
    d = K.feature_change(lambda batch: [b.transpose(1, 2, 0)[::14, ::14] for b in batch], rgb, np.zeros((40, 50, 3)), 56, 42)
    assert d.shape == (40, 50) and d.max() <= 1


def test_resolution_and_stretch():
    assert K.windows(600, 256, 192) == [0, 192, 344] and K.windows(256, 256, 192) == [0]
    a = np.stack([np.arange(100.0).reshape(10, 10)] * 3)
    s = K.stretch(a, np.ones((10, 10), bool))
    assert s.min() == 0 and s.max() == 255 and s.dtype == np.uint8
    assert (K.stretch(np.full((3, 4, 4), 9.0), np.ones((4, 4), bool)) == 0).all()
