import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deltascape.functions import geometry as G
from deltascape.functions import polygons as P
from deltascape.operators.spatial import covered

boxes = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(1, 8), st.integers(1, 8)), min_size=1, max_size=6)


def grid(items):
    g = np.zeros((24, 24), bool)
    for x, y, w, h in items:
        g[y : y + h, x : x + w] = True
    return g


@settings(max_examples=60, deadline=None)
@given(boxes)
def test_unions_equal_cells(items):
    shapes = [P.box_rings(x, y, x + w, y + h) for x, y, w, h in items]
    n = int(grid(items).sum())
    assert P.union_area(shapes) == pytest.approx(n)
    assert P.area(P.dissolve(shapes)) == pytest.approx(n)
    assert covered([(x, y, x + w, y + h) for x, y, w, h in items]) == n
    assert sum(P.area(s) for s in P.polygonise(grid(items))) == pytest.approx(n)


def test_overlays_of_odd_shapes():
    ell = [np.array([[0, 0], [10, 0], [10, 4], [4, 4], [4, 10], [0, 10]], float)]
    ring = [*P.box_rings(0, 0, 10, 10), *P.box_rings(2, 2, 8, 8)]
    bow = [np.array([[0, 0], [4, 4], [4, 0], [0, 4]], float)]
    assert P.area(ell) == pytest.approx(64) and P.area(ring) == pytest.approx(64) and P.area(bow) == pytest.approx(8)
    # the ring's hole takes from the ell what of the ell lies in 2..8: an ell of 6 by 2 and 2 by 4
    assert P.overlap_area(ell, [ring]) == pytest.approx(64 - 20)
    assert P.overlap_area(ring, [P.box_rings(3, 3, 7, 7)]) == 0
    assert P.union_area([ring, P.box_rings(2, 2, 8, 8)]) == pytest.approx(100)
    assert P.area(P.repair(bow)) == pytest.approx(8)
    tri = [np.array([[0, 0], [8, 0], [0, 6]], float)]
    assert P.overlap_area(tri, [P.box_rings(0, 0, 4, 3)]) == pytest.approx(12)
    assert P.rectangularity(tri) == pytest.approx(0.5) and P.rectangularity(P.box_rings(1, 2, 5, 9)) == 1.0


def test_distances():
    a = P.box_rings(0, 0, 10, 10)
    assert P.distance(a, P.box_rings(13, 14, 20, 20)) == pytest.approx(5)
    assert P.distance(a, P.box_rings(10, 0, 12, 5)) == 0
    assert P.distance(a, P.box_rings(4, 4, 5, 5)) == 0
    assert P.distance(a, [np.array([[12, 5], [20, 0], [20, 10]], float)]) == pytest.approx(2)


def test_polygonise_keeps_diagonal_regions_apart_and_holes():
    m = np.zeros((8, 8), bool)
    m[1:6, 1:6] = True
    m[3, 3] = False
    m[6, 6] = True
    shapes = P.polygonise(m)
    assert sorted(P.area(s) for s in shapes) == [1, 24] and sorted(len(s) for s in shapes) == [1, 2]


def staircase(n=60, step=0.1):
    top = [p for i in range(n) for p in ([step * i, (i % 2) * step], [step * (i + 1), (i % 2) * step])]
    return np.array([*top, [n * step, 10.0], [0.0, 10.0]])


def test_regularised_outlines():
    raw = staircase()
    turn = np.array([[math.cos(0.3), -math.sin(0.3)], [math.sin(0.3), math.cos(0.3)]])
    for shape in ([raw], [raw @ turn.T]):
        made = P.regularise([shape, None, shape], 0.075)
        assert made[1] is None and len(made[0][0]) < len(shape[0]) / 5
        assert P.area(made[0]) == pytest.approx(P.area(shape), rel=0.1)
        assert np.hypot(*(made[0][0].mean(axis=0) - P.open_ring(P.simplify_ring(shape[0], 0.2)).mean(axis=0))) < 1
        assert P.rectangularity(made[0]) > 0.99
    assert P.regularise([[raw]], 0.075, projected=False)[0][0] is raw
    with pytest.raises(ValueError):
        P.regularise([[raw]], 0)


def test_simplify_keeps_the_shape():
    ring = P.open_ring(np.array([[0, 0], [5, 0.01], [10, 0], [10, 10], [0, 10]], float))
    assert len(P.simplify_ring(ring, 0.1)) == 4
    assert len(P.simplify([ring], 0.001)[0]) == 5


def test_mercator_round_trip_and_tiles(spark):
    df = spark.createDataFrame([(145.4, -36.3), (0.0, 0.0), (179.9, 84.9), (-179.9, -84.9)], "lon double, lat double")
    got = df.select("*", G.mercator_x(F.col("lon")).alias("x"), G.mercator_y(F.col("lat")).alias("y")).select("*", G.longitude(F.col("x")).alias("lon2"), G.latitude(F.col("y")).alias("lat2")).collect()
    for r in got:
        assert (r.lon2, r.lat2) == (pytest.approx(r.lon), pytest.approx(r.lat))
    t = df.select(*[v.alias(k) for k, v in G.tile_range(F.col("lon"), F.col("lat"), 50.0, 0).items()]).collect()
    assert all((r.x_start, r.x_end, r.y_start, r.y_end) == (0, 0, 0, 0) for r in t)


def test_kernels_and_windows(spark):
    df = spark.createDataFrame([(0.6, 0.075), (0.2, 0.075), (0.0, 1.0), (2.5, 1.0)], "m double, px double")
    assert [r.k for r in df.select(G.odd_kernel(F.col("m"), F.col("px")).alias("k")).collect()] == [9, 3, 1, 3]
    w = spark.createDataFrame([(256,), (600,), (10,)], "n int").select(G.window_starts(F.col("n"), 256, 192).alias("w")).collect()
    assert [r.w for r in w] == [[0], [0, 192, 344], [0]]
