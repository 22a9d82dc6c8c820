import random

import pytest
from pyspark.sql import functions as F

from deltascape.operators import change as C
from deltascape.operators import spatial as S
from deltascape.operators.components import connected_components
from deltascape.sources.geojson import project

BOX = "x0 double, y0 double, x1 double, y1 double"


def lonlat_box(w, s, e, n):
    return (*project(w, s), *project(e, n))


def rings(x0, y0, x1, y1):
    return [[{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]


def frame(spark, rows, schema, polygons):
    """Rows that end in a box; with polygons also as rings."""
    if polygons:
        return spark.createDataFrame([(*r, rings(*r[-4:])) for r in rows], f"{schema}, {BOX}, rings {S.RINGS}")
    return spark.createDataFrame(rows, f"{schema}, {BOX}")


both = pytest.mark.parametrize("polygons", [False, True])


@both
def test_compare(spark, polygons):
    a, b = lonlat_box(145.4000, -36.3400, 145.4001, -36.3399), lonlat_box(145.4010, -36.3400, 145.4011, -36.3399)
    before = frame(spark, [(1, 1, *a), (2, 2, *b)], "id long, ordinal long", polygons)
    after = frame(spark, [(11, 1, *a), (12, 2, *lonlat_box(145.4010, -36.3400, 145.4012, -36.3399)), (13, 3, *lonlat_box(145.4030, -36.3400, 145.4031, -36.3399))], "id long, ordinal long", polygons)
    got = C.compare_footprints(before, after, extension_outside=0.2).orderBy("candidate_id").collect()
    assert [(r.id, r.classification, r.matched_before_footprint_ids) for r in got] == [(12, C.EXTENSION, [2]), (13, C.NEW, [])]
    assert got[0].before_overlap_fraction == pytest.approx(0.5, abs=0.01) and got[0].best_before_footprint_iou == pytest.approx(0.5, abs=0.01)
    assert got[1].nearest_before_footprint_distance_m == pytest.approx(b[0] and lonlat_box(145.4030, 0, 145.4031, 1)[0] - b[2], abs=0.1)
    with pytest.raises(ValueError):
        C.compare_footprints(before, after, min_area=0)


def test_compare_with_nothing_before(spark):
    none = frame(spark, [], "id long, ordinal long", False)
    after = frame(spark, [(1, 1, 0.0, 0.0, 10.0, 10.0), (2, 2, 0.0, 0.0, 1.0, 1.0)], "id long, ordinal long", False)
    got = C.compare_footprints(none, after).collect()
    assert [(r.id, r.classification, r.nearest_before_footprint_distance_m) for r in got] == [(1, C.NEW, None)]


@both
def test_fuse(spark, polygons):
    rows = [
        (1, "pixel", "1", "likely_new_building", None, *lonlat_box(145.4000, -36.3400, 145.4005, -36.3395)), (2, "pixel", "2", "likely_new_building", None, *lonlat_box(145.4100, -36.3400, 145.4105, -36.3395)),
        (3, "segformer", "8", "change", "m1", *lonlat_box(145.4001, -36.3401, 145.4006, -36.3396)),
    ]
    got = C.fuse_candidates(frame(spark, rows, "idx long, source string, id string, classification string, model string", polygons)).orderBy("candidate_id").collect()
    assert [(r.source_count, r.agreement, r.source_candidate_ids) for r in got] == [(2, "multi_source_agreement", ["pixel:1", "segformer:8"]), (1, "single_source_candidate", ["pixel:2"])]
    assert got[0].classification == "likely_new_building" and got[0].source_models == ["m1"]
    assert got[0].area_m2 < 2 * got[1].area_m2


def test_same_source_joins_only_through_another(spark):
    rows = [(1, "a", "1", "x", None, 0.0, 0.0, 1.0, 1.0), (2, "a", "2", "x", None, 1.5, 0.0, 2.5, 1.0), (3, "b", "1", "y", None, 2.0, 3.0, 3.0, 4.0), (4, "a", "3", "x", None, 50.0, 0.0, 51.0, 1.0), (5, "a", "4", "x", None, 51.0, 0.0, 52.0, 1.0)]
    got = C.fuse_candidates(frame(spark, rows, "idx long, source string, id string, classification string, model string", False), merge_distance=3.0).orderBy("cluster").collect()
    assert [r.source_candidate_ids for r in got] == [["a:1", "a:2", "b:1"], ["a:3"], ["a:4"]]


@both
def test_sites(spark, polygons):
    changes = [(1, "1", "c", ["dfine", "segformer"], 2, *lonlat_box(145.4, -36.34, 145.4005, -36.3395)), (2, "2", "c", ["pixel"], 1, *lonlat_box(145.41, -36.34, 145.4105, -36.3395))]
    prints = [(1, "10", "f", *lonlat_box(145.40051, -36.34, 145.4007, -36.3395)), (2, "11", "f", *lonlat_box(145.45, -36.34, 145.4505, -36.3395))]
    got = C.build_sites(frame(spark, changes, "idx long, id string, classification string, sources array<string>, source_count int", polygons), frame(spark, prints, "idx long, id string, classification string", polygons), 3.0, 25.0).orderBy("candidate_id").collect()
    assert len(got) == 3
    by = {(tuple(r.change_candidate_ids), tuple(r.footprint_candidate_ids)): r for r in got}
    assert by[("1",), ("10",)].review_priority == "medium" and by[("2",), ()].review_priority == "low"
    assert by[(), ("11",)].classification == "footprint_only_site_candidate" and by[(), ("11",)].review_priority == "medium"


@both
def test_corroborate(spark, polygons):
    one = lonlat_box(145.4, -36.33, 145.401, -36.329)
    prints = frame(spark, [(1, *one), (2, *lonlat_box(145.5, -36.33, 145.501, -36.329)), (3, *lonlat_box(145.6, -36.33, 145.601, -36.329))], "idx long", polygons)
    edge = lonlat_box(145.5, -36.33, 145.501, -36.329)
    evidence = frame(spark, [("pixel", *one), ("dino", *one), ("pixel", edge[2] + 1.0, edge[1], edge[2] + 5.0, edge[3])], "source string", polygons)
    got = {r.idx: r for r in C.corroborate(prints, evidence).collect()}
    assert [got[i].tier for i in (1, 2, 3)] == ["corroborated", "weakly_corroborated", "footprint_only"]
    assert got[1].support_fraction == pytest.approx(1) and got[1].per_source["dino"].overlap_fraction == pytest.approx(1)
    assert got[2].per_source["pixel"].distance_m == pytest.approx(1.0, abs=0.01)
    every = {r.idx: r for r in C.corroborate(prints, evidence, all_sources=True).collect()}
    assert [every[i].tier for i in (1, 2, 3)] == [got[i].tier for i in (1, 2, 3)] and every[3].supporting_sources == []
    assert set(every[3].per_source) == {"pixel", "dino"} and every[3].per_source["pixel"].distance_m == pytest.approx(lonlat_box(145.6, 0, 146, 1)[0] - edge[2] - 5, abs=0.1)
    with pytest.raises(ValueError):
        C.corroborate(prints, evidence, min_sources=0)


@both
def test_reference_recall(spark, polygons):
    ref = frame(spark, [(1, True, 0.0, 0.0, 10.0, 10.0), (2, True, 100.0, 0.0, 110.0, 10.0), (3, False, 200.0, 0.0, 210.0, 10.0)], "id long, real boolean", polygons)
    pred = frame(spark, [(11, 1, 2.0, 2.0, 4.0, 4.0), (12, 2, 202.0, 2.0, 204.0, 4.0), (13, 3, 900.0, 0.0, 910.0, 10.0), (13, 4, 901.0, 0.0, 910.0, 10.0)], "id long, ordinal long", polygons)
    matches = C.reference_matches(ref, pred, 2.0)
    outcomes = C.prediction_outcomes(matches, pred)
    assert sorted((r.id, r.hit, r.hit_rejected) for r in outcomes.collect()) == [(11, True, False), (12, False, True), (13, False, False)]
    r = C.reference_recall(matches, outcomes).first()
    assert (r.reference_recall, r.hit, r.rejected, r.unmatched, r.prediction_candidate_count) == (0.5, 1, 1, 2, 3)
    none = C.reference_recall(matches.limit(0), outcomes.limit(0)).first()
    assert none.reference_recall is None and none.human_confirmed_reference_count == 0


def test_survey_pair(spark):
    rows = [("p", "s3", "2025-08-01"), ("p", "s1", "2021-02-01"), ("p", "s2", "2023-03-01"), ("q", "s1", "2021-02-01")]
    df = spark.createDataFrame(rows, "place string, id string, d string").select("place", "id", F.to_date("d").alias("date"))
    got = {r.place: r for r in C.survey_pair(df, "place", F.lit("2021-12-31").cast("date"), F.lit("2024-01-01").cast("date")).collect()}
    assert (got["p"].before_id, got["p"].after_id, got["p"].ok) == ("s1", "s3", True) and not got["q"].ok
    assert {r.place: r.ok for r in C.survey_pair(df, "place", F.lit("2021-12-31").cast("date")).collect()} == {"p": True, "q": False}


@pytest.mark.parametrize("seed", range(3))
def test_near_pairs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), x := rng.uniform(-200, 200), y := rng.uniform(-200, 200), x + rng.uniform(0.1, 60), y + rng.uniform(0.1, 60)) for i in range(80)]
    df = spark.createDataFrame(rows, f"idx long, source string, {BOX}")

    def gap(p, q):
        dx, dy = max(0, q[2] - p[4], p[2] - q[4]), max(0, q[3] - p[5], p[3] - q[5])
        return (dx * dx + dy * dy) ** 0.5

    for d in (0.0, 5.0, 40.0):
        got = sorted((r.l_idx, r.r_idx) for r in S.self_pairs(df, d, 16.0, different="source").collect())
        assert got == sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] != q[1] and gap(p, q) <= d)
    far = spark.createDataFrame([(0, "z", 1e5, 1e5, 1e5 + 1, 1e5 + 1)], f"idx long, source string, {BOX}")
    got = {r.idx: r.nearest_distance for r in S.nearest_any(df, far, 8.0, "idx").collect()}
    assert len(got) == 80 and all(got[p[0]] == pytest.approx(gap(p, (0, "z", 1e5, 1e5, 1e5 + 1, 1e5 + 1))) for p in rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000), (5000, 5000)] + [(2000, k) for k in range(2001, 2400)]
    table = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in connected_components(table).collect()}
    assert got == {r.node: r.root for r in connected_components(table, 10_000).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and got[5000] == 5000 and all(got[k] == 2000 for k in range(2000, 2400))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_plans_have_no_nested_loops(spark):
    df = spark.range(100000).selectExpr("id AS idx", "cast(id as string) AS source", "id * 3.0 AS x0", "id * 2.0 AS y0", "id * 3.0 + 2 AS x1", "id * 2.0 + 2 AS y1")
    plan = S.self_pairs(df, 2.0, 64.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dense_boxes_meet_by_cells_without_a_table_of_pairs(spark, monkeypatch):
    rng = random.Random(5)
    boxes = [(i, *(lambda x, y: (x, y, x + rng.randint(0, 9), y + rng.randint(0, 9)))(float(rng.randint(-400, 400)), float(rng.randint(-60, 60)))) for i in rng.sample(range(10_000), 700)]
    boxes += [(20_000 + i, 5.0, 5.0, 6.0, 6.0) for i in range(150)]
    shapes = spark.createDataFrame(boxes, f"idx long, {BOX}")
    near = lambda a, b, d: max(0, b[1] - a[3], a[1] - b[3]) ** 2 + max(0, b[2] - a[4], a[2] - b[4]) ** 2 <= d * d
    for d, few, part in ((5.0, 64, 20_000), (9.0, 4, 40), (0.0, 0, 25)):
        monkeypatch.setattr(S, "FEW_BOXES", few)
        monkeypatch.setattr(S, "PART_BOXES", part)
        lowest = {a[0]: a[0] for a in boxes}
        pairs = [(a[0], b[0]) for i, a in enumerate(boxes) for b in boxes[:i] if near(a, b, d)]
        moved = True
        while moved:
            moved = False
            for u, v in pairs:
                low = min(lowest[u], lowest[v])
                moved |= lowest[u] != low or lowest[v] != low
                lowest[u] = lowest[v] = low
        assert {r.idx: r.cluster for r in C.cluster(shapes, d, 32.0).collect()} == lowest
        assert S.near_roots(shapes, d, 32.0).count() == len(boxes)


@both
def test_large_sites_come_from_pieces(spark, polygons, monkeypatch):
    rng = random.Random(7)
    changes = []
    for i in range(60):  # a crowd over several cells, and some on their own
        x, y = (rng.randint(0, 150), rng.randint(0, 100)) if i < 45 else (1000.0 * i, 0.0)
        changes.append((7 * i, str(i), "ab"[i % 2], [["p", "q", "r"][i % 3]], 1 + i % 3, float(x), float(y), x + 30.0, y + 20.0))
    prints = [(i, f"f{i}", "f", 10.0 * i, 5.0, 10.0 * i + 8, 15.0) for i in range(20)] + [(99, "f99", "f", -900.0, 0.0, -890.0, 10.0)]
    args = (frame(spark, changes, "idx long, id string, classification string, sources array<string>, source_count int", polygons), frame(spark, prints, "idx long, id string, classification string", polygons), 10.0, 25.0)
    whole = C.build_sites(*args).orderBy("candidate_id").collect()
    monkeypatch.setattr(C, "SITE_MEMBERS", 6)
    wide = []
    monkeypatch.setattr(C, "merged_area", lambda df, f=C.merged_area: wide.append(df.agg({"members": "max"}).first()[0]) or f(df))
    got = C.build_sites(*args).select(whole[0].__fields__).orderBy("candidate_id").collect()
    assert got == whole and max(len(r.change_candidate_ids) for r in got) >= 40
    assert wide == [1]  # no row but those of small sites is gathered at once
