"""One query per operator, over whole tables, and the SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascape.functions import geometry as G
from deltascape.functions import text as T
from deltascape.functions.geometry import Box
from deltascape.operators import change as C
from deltascape.operators import evaluation as E
from deltascape.operators import pixels as X
from deltascape.operators import spatial as S
from deltascape.operators.components import connected_components

from . import views as V
from .storage import in_order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query, and the SQL that its result equals."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


#: Box distance in the oracle's dialect, of rows a and b.
DIST = "sqrt(power(greatest(0, b.x0 - a.x1, a.x0 - b.x1), 2) + power(greatest(0, b.y0 - a.y1, a.y0 - b.y1), 2))"
OVER = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
AREA = "((a.x1 - a.x0) * (a.y1 - a.y0))"
SIDE = 64.0
W = f"WITH {V.WITH} "
WR = f"WITH RECURSIVE {V.WITH}, "
EDGES = f"e AS (SELECT a.idx AS u, b.idx AS v FROM cand a JOIN cand b ON a.idx < b.idx AND a.source <> b.source AND {DIST} <= 2)"
REACH = "s AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), r AS (SELECT idx AS node, idx AS seen FROM cand UNION SELECT r.node, s.v FROM r JOIN s ON s.u = r.seen), cl AS (SELECT node AS idx, min(seen) AS cluster FROM r GROUP BY node)"


# joins


@query("jon01_footprint_pairs", f"{W} SELECT a.id AS after_id, b.id AS before_id, round({DIST}, 3) AS distance, round({OVER}, 3)::DOUBLE AS overlap, round(({OVER}) / ({AREA} + (b.x1 - b.x0) * (b.y1 - b.y0) - {OVER})::DOUBLE, 4) AS iou FROM fp_after a JOIN fp_before b ON {DIST} <= 6")
def jon01(spark, d):
    p = C.footprint_pairs(V.fp_before(spark, d), V.fp_after(spark, d), 6.0, SIDE)
    return p.select(F.col("l_id").alias("after_id"), F.col("r_id").alias("before_id"), F.round("distance", 3).alias("distance"), F.round("overlap", 3).alias("overlap"), F.round("iou", 4).alias("iou"))


@query("jon02_cross_source_edges", f"{W}, {EDGES} SELECT u, v FROM e")
def jon02(spark, d):
    return S.self_pairs(V.cand(spark, d), 2.0, SIDE, "idx", "source").select(F.col("l_idx").alias("u"), F.col("r_idx").alias("v"))


@query("jon03_proximity_edges", f"{W} SELECT a.idx AS u, b.idx AS v, round({DIST}, 3) AS distance FROM cand a JOIN cand b ON a.idx < b.idx AND {DIST} <= 10")
def jon03(spark, d):
    return S.self_pairs(V.cand(spark, d), 10.0, SIDE).select(F.col("l_idx").alias("u"), F.col("r_idx").alias("v"), F.round("distance", 3).alias("distance"))


@query("jon04_nearest_cluster", f"{W}, p AS (SELECT b.id, a.idx, {DIST} AS d FROM fp_after b JOIN cand a ON {DIST} <= 25), n AS (SELECT id, idx, d, row_number() OVER (PARTITION BY id ORDER BY d, idx) AS k FROM p) SELECT f.id, coalesce(n.idx, -1) AS nearest_idx, coalesce(round(n.d, 3), -1) AS distance FROM fp_after f LEFT JOIN n ON n.id = f.id AND k = 1")
def jon04(spark, d):
    return S.nearest(V.fp_after(spark, d), V.cand(spark, d), 25.0, SIDE, "id", "idx").select("id", F.coalesce("nearest_idx", F.lit(-1)).alias("nearest_idx"), F.coalesce(F.round("nearest_distance", 3), F.lit(-1.0)).alias("distance"))


@query("jon05_source_cover", f"{W}, a AS (SELECT * FROM fp_after), g AS (SELECT DISTINCT a.id, b.source, x, y FROM a JOIN cand b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1, unnest(range(greatest(a.x0, b.x0), least(a.x1, b.x1))) t(x), unnest(range(greatest(a.y0, b.y0), least(a.y1, b.y1))) s(y)) SELECT id, source, count(*)::DOUBLE AS cover FROM g GROUP BY id, source")
def jon05(spark, d):
    got = C.corroborate(V.fp_after(spark, d).withColumnRenamed("id", "idx"), V.cand(spark, d))
    flat = got.select(F.col("idx").alias("id"), "area", F.explode("per_source").alias("source", "s"))
    return flat.select("id", "source", F.round(F.col("s.overlap_fraction") * F.col("area"), 0).alias("cover")).filter("cover > 0")


@query("jon06_reference_hits_semi", f"{W} SELECT id FROM fp_before b WHERE EXISTS (SELECT 1 FROM cand a WHERE {DIST} <= 8)")
def jon06(spark, d):
    return C.hits(V.fp_before(spark, d), V.cand(spark, d).drop("id"), 8.0).select("id")


@query("jon07_rejected_hits_semi", f"{W} SELECT a.idx FROM cand a WHERE EXISTS (SELECT 1 FROM fp_before b WHERE b.id % 10 = 3 AND {DIST} <= 8)")
def jon07(spark, d):
    return S.semi(V.cand(spark, d), V.fp_before(spark, d).filter("id % 10 = 3"), 8.0, SIDE, "idx").select("idx")


@query("jon08_unmatched_anti", f"{W} SELECT a.id FROM cand a WHERE NOT EXISTS (SELECT 1 FROM fp_before b WHERE {DIST} <= 8)")
def jon08(spark, d):
    return C.unmatched(V.fp_before(spark, d), V.cand(spark, d)).select("id")


@query("jon09_missing_labels", "SELECT e.user_id FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN customer c ON c.c_custkey = e.user_id WHERE c.c_custkey IS NULL")
def jon09(spark, d):
    """References without a row they refer to; a report raises if there are any."""
    return V.table(spark, d, "events").select("user_id").distinct().join(V.table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left_anti")


@query("jon10_new_objects_anti", f"{W} SELECT a.id FROM fp_after a WHERE NOT EXISTS (SELECT 1 FROM fp_before b WHERE {DIST} = 0)")
def jon10(spark, d):
    return C.new_objects(V.fp_before(spark, d), V.fp_after(spark, d)).select("id")


@query("jon11_demolished_anti", f"{W} SELECT a.id FROM fp_before a WHERE NOT EXISTS (SELECT 1 FROM fp_after b WHERE {DIST} = 0)")
def jon11(spark, d):
    return C.demolished_objects(V.fp_before(spark, d), V.fp_after(spark, d)).select("id")


ASOF = "WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS dt FROM orders), b AS (SELECT o_custkey, o_orderkey, dt, row_number() OVER (PARTITION BY o_custkey ORDER BY dt DESC, o_orderkey DESC) AS k FROM s WHERE dt <= DATE '1996-06-30'), a AS (SELECT o_custkey, o_orderkey, dt, row_number() OVER (PARTITION BY o_custkey ORDER BY dt, o_orderkey) AS k FROM s WHERE dt >= DATE '1998-01-01') "


def surveys(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_custkey"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"))


@query("jon12_asof_before", ASOF + "SELECT o_custkey, o_orderkey AS before_id, dt::VARCHAR AS before_date FROM b WHERE k = 1")
def jon12_before(spark, d):
    got = C.survey_pair(surveys(spark, d), "o_custkey", F.lit("1996-06-30").cast("date"), F.lit("1998-01-01").cast("date"))
    return got.filter("before_id IS NOT NULL").select("o_custkey", "before_id", F.col("before_date").cast("string").alias("before_date"))


@query("jon12_asof_after", ASOF + "SELECT c.o_custkey, coalesce(a.o_orderkey, -1) AS after_id, coalesce(b.dt < a.dt AND b.o_orderkey <> a.o_orderkey, FALSE) AS ok FROM (SELECT DISTINCT o_custkey FROM s) c LEFT JOIN a ON a.o_custkey = c.o_custkey AND a.k = 1 LEFT JOIN b ON b.o_custkey = c.o_custkey AND b.k = 1")
def jon12_after(spark, d):
    got = C.survey_pair(surveys(spark, d), "o_custkey", F.lit("1996-06-30").cast("date"), F.lit("1998-01-01").cast("date"))
    return got.select("o_custkey", F.coalesce("after_id", F.lit(-1)).alias("after_id"), "ok")


@query("jon13_pixel_pair", f"WITH {V.PX_SQL} SELECT b.scene, round(sum(abs(a.v - b.v)), 3) AS change FROM px b JOIN px a ON a.scene = b.scene + 1 AND a.row = b.row AND a.col = b.col GROUP BY b.scene")
def jon13(spark, d):
    px = V.px(spark, d)
    pair = X.pixel_pair(px, px.withColumn("scene", F.col("scene") - 1))
    return pair.groupBy("scene").agg(F.round(F.sum(F.abs(F.col("a") - F.col("b"))), 3).alias("change"))


@query("jon14_point_in_box", f"{W} SELECT b.id, count(*) AS points FROM fp_before b JOIN cand a ON a.x0 BETWEEN b.x0 AND b.x1 AND a.y0 BETWEEN b.y0 AND b.y1 GROUP BY b.id")
def jon14(spark, d):
    points = V.cand(spark, d).select("idx", "x0", "y0", F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    near = S.near_pairs(S.prefixed(V.fp_before(spark, d), "l_"), S.prefixed(points, "r_"), 0.0, SIDE)
    return near.groupBy(F.col("l_id").alias("id")).agg(F.count("*").alias("points"))


@query("jon15_label_lookup", "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'correct' ELSE 'wrong' END AS verdict FROM documents d JOIN labels l ON CAST(d.doc_id AS VARCHAR) = CAST(l.doc_id AS VARCHAR)")
def jon15(spark, d):
    labels = V.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("quality") == 1, "correct").otherwise("wrong").alias("verdict"))
    return V.table(spark, d, "documents").select("doc_id").join(labels, F.col("doc_id").cast("string") == F.col("key")).select("doc_id", "verdict")


@query("jon16_positional_zip", "SELECT vec_id, sum(CASE WHEN a < b THEN 1 ELSE 0 END)::BIGINT AS rising FROM (SELECT vec_id, embedding[i] AS a, embedding[i + 1] AS b FROM embeddings, range(1, 64) t(i)) GROUP BY vec_id")
def jon16(spark, d):
    e = V.table(spark, d, "embeddings")
    zipped = F.arrays_zip(F.slice("embedding", 1, 63).alias("a"), F.slice("embedding", 2, 63).alias("b"))
    return e.select("vec_id", F.size(F.filter(zipped, lambda z: z["a"] < z["b"])).cast("long").alias("rising"))


@query("jon16_positional_join", f"{W} SELECT a.id AS after_id, b.id AS before_id, a.ordinal FROM fp_after a JOIN fp_before b ON b.ordinal = a.ordinal")
def jon16_join(spark, d):
    after, before = (f(spark, d).select(F.col("id").alias(name), "ordinal") for f, name in ((V.fp_after, "after_id"), (V.fp_before, "before_id")))
    return after.join(before, "ordinal").select("after_id", "before_id", "ordinal")


# components and pipelines


@query("grf01_components", f"{WR} {EDGES}, {REACH} SELECT idx, cluster FROM cl")
def grf01(spark, d):
    return C.cluster(V.cand(spark, d), 2.0, SIDE, "source")


@query("grf01_components_rounds", ORACLES["grf01_components"])
def grf01_rounds(spark, d):
    """The same by the distributed rounds alone, which larger tables take."""
    return C.cluster(V.cand(spark, d), 2.0, SIDE, "source", 0)


@query("vec01_compare_footprints", f"""{W}, p AS (SELECT a.id, b.id AS bid, b.ordinal, {DIST} AS d, {OVER} AS o, ({OVER}) / ({AREA} + (b.x1 - b.x0) * (b.y1 - b.y0) - {OVER})::DOUBLE AS iou FROM fp_after a CROSS JOIN fp_before b),
st AS (SELECT id, min(d) AS near, max(iou) AS best FROM p GROUP BY id),
m AS (SELECT id, list(bid ORDER BY ordinal) AS ids FROM p WHERE d <= 6 OR iou >= 0.1 GROUP BY id),
g AS (SELECT DISTINCT a.id, x, y FROM fp_after a JOIN fp_before b ON {OVER} > 0, unnest(range(greatest(a.x0, b.x0), least(a.x1, b.x1))) t(x), unnest(range(greatest(a.y0, b.y0), least(a.y1, b.y1))) s(y)),
c AS (SELECT id, count(*) AS inside FROM g GROUP BY id),
q AS (SELECT a.id, a.ordinal, {AREA} AS area, {AREA} - coalesce(c.inside, 0) AS outside, m.ids, st.near, st.best FROM fp_after a JOIN st ON st.id = a.id LEFT JOIN m ON m.id = a.id LEFT JOIN c ON c.id = a.id WHERE {AREA} >= 20),
k AS (SELECT *, CASE WHEN ids IS NULL THEN 'new_building_footprint_candidate' WHEN outside / area::DOUBLE >= 0.25 THEN 'building_extension_footprint_candidate' END AS classification FROM q)
SELECT id, classification, round(area::DOUBLE, 1) AS area_m2, round(outside::DOUBLE, 1) AS outside_before_area_m2, CASE WHEN ids IS NULL THEN 0.0::DOUBLE ELSE round(1 - outside / area::DOUBLE, 3) END AS before_overlap_fraction, round(near, 1) AS nearest_before_footprint_distance_m, round(best, 3) AS best_before_footprint_iou, array_to_string(coalesce(ids, []), ',') AS matched_before_footprint_ids, (row_number() OVER (ORDER BY area DESC, ordinal)) AS candidate_id FROM k WHERE classification IS NOT NULL""")
def vec01(spark, d):
    out = C.compare_footprints(V.fp_before(spark, d), V.fp_after(spark, d))
    return out.withColumn("matched_before_footprint_ids", F.concat_ws(",", F.col("matched_before_footprint_ids").cast("array<string>")))


FUSE = f"""{WR} {EDGES}, {REACH}, m AS (SELECT c.*, cl.cluster FROM cand c JOIN cl ON cl.idx = c.idx),
n AS (SELECT cluster, classification, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT cluster, classification, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, CASE WHEN regexp_matches(lower(classification), 'building|extension|pool|driveway|pav') THEN 1 ELSE 0 END DESC, classification DESC) AS k FROM n),
g AS (SELECT cluster, count(*) AS area FROM (SELECT DISTINCT cluster, x, y FROM m, unnest(range(x0, x1)) t(x), unnest(range(y0, y1)) s(y)) GROUP BY cluster),
a AS (SELECT m.cluster, any_value(g.area)::DOUBLE AS area_m2, count(DISTINCT source) AS source_count, count(*) AS raw_candidate_count, string_agg(DISTINCT source, ',' ORDER BY source) AS candidate_sources, coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS source_models, string_agg(source || ':' || id, ',' ORDER BY m.idx) AS source_candidate_ids, string_agg(DISTINCT m.classification, ',' ORDER BY m.classification) AS source_classifications FROM m JOIN g ON g.cluster = m.cluster GROUP BY m.cluster)"""


@query("vec02_fuse_candidates", f"{FUSE} SELECT (row_number() OVER (ORDER BY source_count DESC, area_m2 DESC, a.cluster)) AS candidate_id, a.cluster, f.classification, area_m2, source_count::INTEGER AS source_count, raw_candidate_count, candidate_sources, source_models, source_candidate_ids, source_classifications, CASE WHEN source_count > 1 THEN 'multi_source_agreement' ELSE 'single_source_candidate' END AS agreement FROM a JOIN f ON f.cluster = a.cluster AND f.k = 1")
def vec02(spark, d):
    out = C.fuse_candidates(V.cand(spark, d))
    for c in ("candidate_sources", "source_models", "source_candidate_ids", "source_classifications"):
        out = out.withColumn(c, F.array_join(c, ","))
    return out.select("candidate_id", "cluster", "classification", "area_m2", "source_count", "raw_candidate_count", "candidate_sources", "source_models", "source_candidate_ids", "source_classifications", "agreement")


@query("vec03_build_sites", f"""{WR} e AS (SELECT a.idx AS u, b.idx AS v FROM cand a JOIN cand b ON a.idx < b.idx AND {DIST} <= 10), {REACH},
m AS (SELECT c.*, cl.cluster FROM cand c JOIN cl ON cl.idx = c.idx),
p AS (SELECT b.id, a.cluster, {DIST} AS d FROM fp_after b JOIN m a ON {DIST} <= 25),
w AS (SELECT id, cluster, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS k FROM p),
t AS (SELECT 0 AS k, cluster AS i, 'c' AS role, id, source, kind, x0, y0, x1, y1 FROM m UNION ALL SELECT CASE WHEN w.cluster IS NULL THEN 1 ELSE 0 END, coalesce(w.cluster, f.id), 'f', f.id, NULL, NULL, x0, y0, x1, y1 FROM fp_after f LEFT JOIN w ON w.id = f.id AND w.k = 1),
g AS (SELECT k, i, count(*) AS area FROM (SELECT DISTINCT k, i, x, y FROM t, unnest(range(x0, x1)) t1(x), unnest(range(y0, y1)) t2(y)) GROUP BY k, i),
z AS (SELECT t.k, t.i, any_value(g.area)::DOUBLE AS site_area_m2, count(*) FILTER (role = 'c') AS change_evidence_count, count(*) FILTER (role = 'f') AS footprint_evidence_count, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (role = 'c'), '') AS change_candidate_ids, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (role = 'f'), '') AS footprint_candidate_ids, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS change_sources, coalesce(max(CASE WHEN role = 'c' THEN kind + 1 END), 0) AS n FROM t JOIN g ON g.k = t.k AND g.i = t.i GROUP BY t.k, t.i),
q AS (SELECT *, CASE WHEN n >= 3 AND footprint_evidence_count > 0 THEN 'high' WHEN n >= 2 OR footprint_evidence_count > 0 THEN 'medium' ELSE 'low' END AS review_priority FROM z)
SELECT (row_number() OVER (ORDER BY CASE review_priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, site_area_m2 DESC, k, i)) AS candidate_id, CASE WHEN change_evidence_count > 0 THEN 'construction_site_candidate' ELSE 'footprint_only_site_candidate' END AS classification, site_area_m2, review_priority, change_evidence_count, footprint_evidence_count, change_candidate_ids, footprint_candidate_ids, change_sources FROM q""")
def vec03(spark, d):
    changes = V.cand(spark, d).withColumn("sources", F.array("source")).withColumn("source_count", (F.col("kind") + 1).cast("int"))
    prints = V.fp_after(spark, d).withColumn("idx", F.col("id")).withColumn("classification", F.lit("footprint_candidate"))
    out = C.build_sites(changes, prints)
    for c in ("change_candidate_ids", "footprint_candidate_ids"):
        out = out.withColumn(c, F.concat_ws(",", F.col(c).cast("array<string>")))
    return out.withColumn("change_sources", F.array_join("change_sources", ",")).select("candidate_id", "classification", "site_area_m2", "review_priority", "change_evidence_count", "footprint_evidence_count", "change_candidate_ids", "footprint_candidate_ids", "change_sources")


@query("vec04_corroborate", f"""{W}, p AS (SELECT a.id, b.source, b.idx, {DIST} AS d FROM fp_after a JOIN cand b ON {DIST} <= 2),
n AS (SELECT id, string_agg(DISTINCT source, ',' ORDER BY source) AS supporting_sources, count(DISTINCT source)::INTEGER AS source_count FROM p GROUP BY id),
g AS (SELECT DISTINCT a.id, x, y FROM fp_after a JOIN cand b ON {OVER} > 0, unnest(range(greatest(a.x0, b.x0), least(a.x1, b.x1))) t(x), unnest(range(greatest(a.y0, b.y0), least(a.y1, b.y1))) s(y)),
c AS (SELECT id, count(*) AS inside FROM g GROUP BY id),
q AS (SELECT a.id, coalesce(supporting_sources, '') AS supporting_sources, coalesce(source_count, 0) AS source_count, coalesce(inside, 0) / {AREA}::DOUBLE AS share FROM fp_after a LEFT JOIN n ON n.id = a.id LEFT JOIN c ON c.id = a.id)
SELECT id, supporting_sources, source_count, round(share, 4) AS support_fraction, CASE WHEN source_count >= 2 AND share >= 0.1 THEN 'corroborated' WHEN source_count > 0 THEN 'weakly_corroborated' ELSE 'footprint_only' END AS tier FROM q""")
def vec04(spark, d):
    got = C.corroborate(V.fp_after(spark, d).withColumnRenamed("id", "idx"), V.cand(spark, d))
    return got.select(F.col("idx").alias("id"), F.array_join("supporting_sources", ",").alias("supporting_sources"), "source_count", "support_fraction", "tier")


@query("vec05_reference_recall", f"""{W}, ref AS (SELECT *, id % 10 <> 3 AS real FROM fp_before WHERE id % 2 = 0 OR id % 10 = 3), p AS (SELECT b.id, b.real, a.id AS pid FROM ref b JOIN cand a ON {DIST} <= 8)
SELECT (SELECT count(*) FROM ref WHERE real) AS human_confirmed_reference_count, (SELECT count(DISTINCT id) FROM p WHERE real) AS detected_reference_count, round((SELECT count(DISTINCT id) FROM p WHERE real)::DOUBLE / (SELECT count(*) FROM ref WHERE real), 4) AS reference_recall, (SELECT count(*) FROM cand) AS prediction_candidate_count, (SELECT count(DISTINCT pid) FROM p WHERE real)::INTEGER AS hit, (SELECT count(DISTINCT pid) FROM p WHERE NOT real)::INTEGER AS rejected, (SELECT (SELECT count(*) FROM cand) - count(DISTINCT pid) FROM p WHERE real)::INTEGER AS unmatched""")
def vec05(spark, d):
    ref = V.fp_before(spark, d).filter("id % 2 = 0 OR id % 10 = 3").withColumn("real", F.col("id") % 10 != 3)
    pred = V.cand(spark, d).select("id", F.col("idx").alias("ordinal"), *S.CORNERS)
    matches = C.reference_matches(ref, pred)
    got = C.reference_recall(matches, C.prediction_outcomes(matches, pred))
    return got.select("human_confirmed_reference_count", "detected_reference_count", "reference_recall", "prediction_candidate_count", *[F.col(c).cast("int").alias(c) for c in ("hit", "rejected", "unmatched")])


# geometry


@query("vec10_box_area", f"{W} SELECT id, (({AREA}))::DOUBLE AS area FROM fp_after a")
def vec10(spark, d):
    ring = F.array(*[F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    return V.fp_after(spark, d).select("id", G.shoelace(ring).alias("area"))


@query("vec11_distance", f"{W} SELECT a.id, round({DIST}, 3) AS distance FROM fp_after a JOIN fp_before b ON b.id = a.id")
def vec11(spark, d):
    both = S.prefixed(V.fp_after(spark, d), "l_").join(S.prefixed(V.fp_before(spark, d), "r_"), F.col("l_id") == F.col("r_id"))
    return both.select(F.col("l_id").alias("id"), F.round(Box.of("l_").distance(Box.of("r_")), 3).alias("distance"))


@query("vec12_iou", f"{W} SELECT a.id, round(({OVER}) / ({AREA} + (b.x1 - b.x0) * (b.y1 - b.y0) - {OVER})::DOUBLE, 4) AS iou, round({OVER} / {AREA}::DOUBLE, 4) AS overlap_fraction FROM fp_after a JOIN fp_before b ON b.id = a.id")
def vec12(spark, d):
    both = S.prefixed(V.fp_after(spark, d), "l_").join(S.prefixed(V.fp_before(spark, d), "r_"), F.col("l_id") == F.col("r_id"))
    a, b = Box.of("l_"), Box.of("r_")
    return both.select(F.col("l_id").alias("id"), F.round(a.iou(b), 4).alias("iou"), F.round(a.overlap(b) / a.area(), 4).alias("overlap_fraction"))


LONLAT = "SELECT event_id AS id, 145.0::DOUBLE + (event_id % 1000) / 10000.0::DOUBLE AS lon, -36.0::DOUBLE - (event_id % 777) / 10000.0::DOUBLE AS lat FROM events"


def lonlat(spark, d):
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.lit(145.0) + (F.col("event_id") % 1000) / F.lit(10000.0)).alias("lon"), (F.lit(-36.0) - (F.col("event_id") % 777) / F.lit(10000.0)).alias("lat"))


@query("vec14_lonlat_to_mercator", f"SELECT id, round(6378137.0 * radians(lon), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM ({LONLAT})")
def vec14(spark, d):
    return lonlat(spark, d).select("id", F.round(G.mercator_x(F.col("lon")), 3).alias("x"), F.round(G.mercator_y(F.col("lat")), 3).alias("y"))


@query("vec14_mercator_to_lonlat", f"SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({LONLAT})")
def vec14_back(spark, d):
    m = lonlat(spark, d).select("id", G.mercator_x(F.col("lon")).alias("x"), G.mercator_y(F.col("lat")).alias("y"))
    return m.select("id", F.round(G.longitude(F.col("x")), 6).alias("lon"), F.round(G.latitude(F.col("y")), 6).alias("lat"))


@query("vec15_crop_window", f'{W} SELECT id, greatest(0, floor(x0 / 4.0) - 70)::BIGINT AS "left", greatest(0, floor((6100 - y1) / 4.0) - 70)::BIGINT AS top, least(1500, floor(x1 / 4.0) + 71)::BIGINT AS "right", least(1500, floor((6100 - y0) / 4.0) + 71)::BIGINT AS bottom FROM fp_after')
def vec15(spark, d):
    c = F.col
    w = G.crop_window(c("x0"), c("y0"), c("x1"), c("y1"), F.lit(0.0), F.lit(6100.0), F.lit(4.0), F.lit(1500), F.lit(1500))
    return V.fp_after(spark, d).select("id", *[v.alias(k) for k, v in w.items()])


@query("vec16_rasterise_cells", f"{W} SELECT cx, cy, count(*) AS n FROM (SELECT id, unnest(range(x0, x1)) AS cx, y0, y1 FROM fp_before), unnest(range(y0, y1)) t(cy) GROUP BY cx, cy")
def vec16(spark, d):
    return S.box_cells(V.fp_before(spark, d), Box.of()).groupBy("cx", "cy").agg(F.count("*").alias("n"))


@query("src11_tile_range", f"SELECT id, greatest(0, floor((x - r + h) / s))::BIGINT AS x_start, least(n - 1, floor((x + r + h) / s))::BIGINT AS x_end, greatest(0, floor((h - y - r) / s))::BIGINT AS y_start, least(n - 1, floor((h - y + r) / s))::BIGINT AS y_end FROM (SELECT id, 6378137.0 * radians(lon) AS x, 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y, 100 / greatest(cos(radians(lat)), 0.1) AS r, pi() * 6378137.0 AS h, 2 * pi() * 6378137.0 / 262144 AS s, 262144 AS n FROM ({LONLAT}))")
def src11(spark, d):
    t = G.tile_range(F.col("lon"), F.col("lat"), 100.0, 18)
    return lonlat(spark, d).select("id", *[t[k].alias(k) for k in ("x_start", "x_end", "y_start", "y_end")])


@query("src13_tile_grid", f"SELECT id, (x_end - x_start + 1) * (y_end - y_start + 1) AS tiles FROM ({ORACLES['src11_tile_range']})")
def src13(spark, d):
    t = G.tile_range(F.col("lon"), F.col("lat"), 100.0, 18)
    tiles = lonlat(spark, d).select("id", F.explode(F.sequence(t["x_start"], t["x_end"])).alias("x"), t["y_start"].alias("a"), t["y_end"].alias("b")).select("id", "x", F.explode(F.sequence("a", "b")).alias("y"))
    return tiles.groupBy("id").agg(F.count("*").alias("tiles"))


@query("set05_overlap_area", f"{W} SELECT a.id, (max({OVER}))::DOUBLE AS overlap, ({AREA} - max({OVER}))::DOUBLE AS difference FROM fp_after a JOIN fp_before b ON {OVER} > 0 GROUP BY a.id, a.x0, a.y0, a.x1, a.y1")
def set05(spark, d):
    p = S.near_pairs(S.prefixed(V.fp_after(spark, d), "l_"), S.prefixed(V.fp_before(spark, d), "r_"), 0.0, SIDE).withColumn("o", Box.of("l_").overlap(Box.of("r_"))).filter("o > 0")
    return p.groupBy(F.col("l_id").alias("id")).agg(F.max("o").cast("double").alias("overlap"), (F.first(Box.of("l_").area()) - F.max("o")).cast("double").alias("difference"))


# aggregates


@query("agg01_label_summary", "SELECT count(*) AS labelled_site_count, sum(t)::BIGINT AS known_building_total, sum(CASE WHEN t IS NOT NULL THEN least(g, t) END)::BIGINT AS detected_building_total, round(sum(CASE WHEN t IS NOT NULL THEN least(g, t) END) / sum(t)::DOUBLE, 4) AS building_recall_on_known_sites, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (user_id % 5 = 0) AS unlabelled, 2 * count(*) FILTER (user_id % 3 = 0) AS issues FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN event_id % 6 END AS t, user_id % 4 AS g FROM events)")
def agg01(spark, d):
    e = V.table(spark, d, "events")
    total = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 6)
    labels = e.select(
        F.col("event_type").alias("assessment"), F.when(F.col("user_id") % 5 != 0, F.lit("good")).alias("outline_quality"), F.when(F.col("user_id") % 3 == 0, F.array(F.lit("shadow"), F.lit("pool"))).otherwise(F.array().cast("array<string>")).alias("issues"),
        F.least(F.col("user_id") % 4, total).alias("detected"), total.alias("total"),
    )
    got = E.label_summary(labels)
    issues = F.aggregate(F.map_values("issue_counts"), F.lit(0).cast("long"), lambda s, v: s + v)
    return got.select("labelled_site_count", "known_building_total", "detected_building_total", "building_recall_on_known_sites", F.col("assessment_counts")["click"].alias("clicks"), F.col("outline_quality_counts")["unlabelled"].alias("unlabelled"), issues.alias("issues"))


@query("agg02_percentiles", f"WITH {V.PX_SQL} SELECT scene, round(quantile_cont(v, 0.02), 4) AS p20, round(quantile_cont(v, 0.98), 4) AS p980 FROM px GROUP BY scene")
def agg02(spark, d):
    got = X.percentiles(V.px(spark, d), "v", [0.02, 0.98], "scene")
    return got.select("scene", F.round("p20", 4).alias("p20"), F.round("p980", 4).alias("p980"))


@query("agg02_histogram_percentiles", "SELECT round(quantile_cont(v, 0.08), 4) AS p80, round(quantile_cont(v, 0.985), 4) AS p985 FROM (SELECT round(value, 1) AS v FROM events)")
def agg02_histogram(spark, d):
    got = X.exact_percentiles(V.table(spark, d, "events").select(F.round("value", 1).alias("v")), "v", [0.08, 0.985])
    return got.select(F.round("p80", 4).alias("p80"), F.round("p985", 4).alias("p985"))


BOXES8 = "SELECT vec_id AS id, vec_id AS scene, vec_id % 4 AS x0, (vec_id // 4) % 4 AS y0, vec_id % 4 + 3 AS x1, (vec_id // 4) % 4 + 4 AS y1 FROM embeddings"


@query("agg03_zonal_stats", f"WITH {V.PX_SQL} SELECT b.id, round(avg(v), 4) AS mean, round(max(v), 4) AS largest, count(*) AS n FROM ({BOXES8}) b JOIN px p ON p.scene = b.scene AND p.col + 0.5 BETWEEN b.x0 AND b.x1 AND p.row + 0.5 BETWEEN b.y0 AND b.y1 GROUP BY b.id")
def agg03(spark, d):
    boxes = V.table(spark, d, "embeddings").selectExpr("vec_id AS id", "vec_id AS scene", "vec_id % 4 AS x0", "(vec_id div 4) % 4 AS y0", "vec_id % 4 + 3 AS x1", "(vec_id div 4) % 4 + 4 AS y1")
    return X.zonal(V.px(spark, d), boxes).select("id", F.round("mean", 4).alias("mean"), F.round("largest", 4).alias("largest"), "n")


@query("agg04_dissolve_area", f"{W} SELECT source, count(*)::DOUBLE AS area FROM (SELECT DISTINCT source, x, y FROM cand, unnest(range(x0, x1)) t(x), unnest(range(y0, y1)) s(y)) GROUP BY source")
def agg04(spark, d):
    """Union area by source: whole cells are shared out first, so that no task holds a source."""
    cells = V.cand(spark, d)
    tile = cells.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / 512), F.floor((F.col("x1") - 1) / 512)))).withColumn("ty", F.explode(F.sequence(F.floor(F.col("y0") / 512), F.floor((F.col("y1") - 1) / 512))))
    clip = F.struct(*[e.cast("double").alias(n) for n, e in (("x0", F.greatest("x0", F.col("tx") * 512)), ("y0", F.greatest("y0", F.col("ty") * 512)), ("x1", F.least("x1", (F.col("tx") + 1) * 512)), ("y1", F.least("y1", (F.col("ty") + 1) * 512)))])
    by_tile = tile.groupBy("source", "tx", "ty").agg(S.union_box_area(F.collect_list(clip)).alias("a"))
    return by_tile.groupBy("source").agg(F.sum("a").alias("area"))


@query("agg05_source_sets", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources, count(DISTINCT event_type) AS source_count, count(*) AS n FROM events GROUP BY user_id")
def agg05(spark, d):
    e = V.table(spark, d, "events")
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("sources"), F.count_distinct("event_type").alias("source_count"), F.count("*").alias("n"))


@query("agg06_preferred_class", f"{W}, n AS (SELECT kind, classification, count(*) AS n FROM cand GROUP BY ALL) SELECT kind, arg_max(classification, {{'n': n, 'p': CASE WHEN regexp_matches(lower(classification), 'building|extension|pool|driveway|pav') THEN 1 ELSE 0 END, 'c': classification}}) AS preferred FROM n GROUP BY kind")
def agg06(spark, d):
    counted = V.cand(spark, d).groupBy("kind", "classification").agg(F.count("*").alias("n"))
    return C.preferred_class(counted, "kind")


@query("agg07_zero_filled_counts", "SELECT c AS event_type, (SELECT count(*) FROM events WHERE event_type = c) AS n FROM (VALUES ('click'), ('error'), ('view'), ('never')) t(c)")
def agg07(spark, d):
    return E.zero_filled_counts(V.table(spark, d, "events"), "event_type", ("click", "error", "view", "never"))


@query("agg08_source_count_histogram", f"{FUSE} SELECT source_count::INTEGER AS source_count, count(*) AS n FROM a GROUP BY source_count")
def agg08(spark, d):
    return C.fuse_candidates(V.cand(spark, d)).groupBy("source_count").agg(F.count("*").alias("n"))


STRATA = "SELECT doc_id AS id, n_chars AS area, lang || '|' || CASE WHEN n_chars >= 0 AND n_chars < 60 THEN 'small' WHEN n_chars >= 60 AND n_chars < 150 THEN 'medium' ELSE 'large' END AS stratum FROM documents"
PLAN = f"WITH d AS ({STRATA}), c AS (SELECT stratum, count(*) AS population FROM d GROUP BY stratum), p AS (SELECT stratum, population, least(population, greatest(3, round_even(25 * (population / sum(population) OVER ())::DOUBLE, 0)::BIGINT)) AS sampled FROM c)"


def strata(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("area"), E.stratum(F.col("lang"), F.col("n_chars")).alias("stratum"))


@query("agg09_strata", f"{PLAN} SELECT stratum, population, sampled, round(population / sampled::DOUBLE, 3) AS weight FROM p")
def agg09(spark, d):
    return E.strata_plan(strata(spark, d), 25, 3)


@query("agg10_weighted_precision", f"{PLAN}, s AS (SELECT d.stratum, count(*) AS n, count(*) FILTER (l.quality = 1) AS ok FROM d JOIN labels l ON l.doc_id = d.id GROUP BY d.stratum) SELECT sum(n)::BIGINT AS labelled, sum(population)::BIGINT AS population_covered, round(sum(ok / n::DOUBLE * population) / sum(population), 4) AS weighted_precision FROM s JOIN p ON p.stratum = s.stratum")
def agg10(spark, d):
    rows = strata(spark, d)
    labels = V.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 1, "correct").otherwise("unlabelled").alias("verdict"))
    return E.weighted_precision(rows, labels, E.strata_plan(rows, 25, 3))


@query("agg11_recall", "SELECT count(*) AS n, round(avg(quality), 4) AS recall FROM labels")
def agg11(spark, d):
    return V.table(spark, d, "labels").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 4).alias("recall"))


@query("agg12_confusion", "WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels) SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 4) AS precision, round(tp / (tp + fn)::DOUBLE, 4) AS recall, round(tp / (tp + fp + fn)::DOUBLE, 4) AS iou, round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE), 4) AS f1 FROM c")
def agg12(spark, d):
    got = E.confusion(V.table(spark, d, "labels"), F.col("quality"), F.col("toxic"))
    return got.select("tp", "fp", "fn", "tn", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "iou", "f1")])


@query("agg13_channel_stats", f"WITH {V.PX_SQL} SELECT col, round(avg(m), 4) AS mean, round(avg(s), 4) AS std FROM (SELECT scene, col, avg(v) AS m, stddev_pop(v) AS s FROM px GROUP BY scene, col) GROUP BY col")
def agg13(spark, d):
    return X.channel_stats(V.px(spark, d), "scene", "col", "v").select(F.col("col").cast("long").alias("col"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("agg14_verdict_counts", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, label")
def agg14(spark, d):
    return V.table(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


@query("agg15_tier_stats", "SELECT lang, count(*) AS n, median(n_chars)::DOUBLE AS median_area, count(*) FILTER (n_chars >= 60) AS over_60, count(*) FILTER (n_chars >= 100) AS over_100 FROM documents GROUP BY lang")
def agg15(spark, d):
    return E.tier_stats(V.table(spark, d, "documents"), "lang", "n_chars")


SWEEP = "SELECT t AS threshold, count(*) AS n, round(sum(w * h), 2)::DOUBLE AS area, median(w * h)::DOUBLE AS median_area FROM cand, (VALUES (1.0), (5.0), (10.0), (20.0)) x(t) WHERE score >= t GROUP BY t"


@query("agg16_threshold_sweep", f"{W}, s AS ({SWEEP}) SELECT threshold::DOUBLE AS threshold, n, area, median_area, round(100 * area / 1e6, 2)::DOUBLE AS coverage_pct FROM s")
def agg16(spark, d):
    rows = V.cand(spark, d).withColumn("area", (F.col("w") * F.col("h")).cast("double"))
    return E.threshold_sweep(rows, "score", "area", [1.0, 5.0, 10.0, 20.0], 1e6).drop("added_n", "added_area")


@query("win04_marginal_delta", f"{W}, s AS ({SWEEP}) SELECT threshold::DOUBLE AS threshold, coalesce(n - lag(n) OVER (ORDER BY threshold DESC), 0) AS added_n, coalesce(round(area - lag(area) OVER (ORDER BY threshold DESC), 2), 0)::DOUBLE AS added_area FROM s")
def win04(spark, d):
    rows = V.cand(spark, d).withColumn("area", (F.col("w") * F.col("h")).cast("double"))
    got = E.threshold_sweep(rows, "score", "area", [1.0, 5.0, 10.0, 20.0], 1e6)
    return got.select("threshold", F.coalesce("added_n", F.lit(0)).alias("added_n"), F.coalesce("added_area", F.lit(0.0)).alias("added_area"))


@query("agg17_coverage_buckets", "WITH e AS (SELECT (event_id % 101) / 100.0::DOUBLE AS c, value AS l FROM events), k AS (SELECT quantile_cont(l, 0.25) AS cut FROM e), m AS (SELECT median(c) FILTER (l <= cut) AS dark_median, median(c) FILTER (l > cut) AS light_median FROM e, k) SELECT CASE WHEN c < 0.01 THEN 'missed' WHEN c < 0.25 THEN '0.01-0.25' WHEN c < 0.5 THEN '0.25-0.5' WHEN c < 0.75 THEN '0.5-0.75' ELSE '0.75-1' END AS bucket, count(*) AS n, round(any_value(dark_median), 4) AS dark_median, round(any_value(light_median), 4) AS light_median FROM e, m GROUP BY 1")
def agg17(spark, d):
    rows = V.table(spark, d, "events").select(((F.col("event_id") % 101) / F.lit(100.0)).alias("c"), F.col("value").alias("l"))
    got = E.coverage_report(rows, "c", "l")
    return got.select("bucket", "n", F.round("dark_median", 4).alias("dark_median"), F.round("light_median", 4).alias("light_median"))


@query("agg18_centroids", f"WITH {V.PX_SQL} SELECT scene AS label, count(*) AS pixels, round(avg(row), 4) AS row, round(avg(col), 4) AS col FROM px WHERE v > 0 GROUP BY scene HAVING count(*) >= 30")
def agg18(spark, d):
    got = X.centroids(V.px(spark, d).filter("v > 0").withColumnRenamed("scene", "label"), 30)
    return got.select("label", "pixels", F.round("row", 4).alias("row"), F.round("col", 4).alias("col"))


@query("agg19_overlap_mean", f"WITH {V.PX_SQL}, s AS (SELECT scene // 4 AS scene, (scene % 4) // 2 * 4 + row AS row, (scene % 2) * 4 + col AS col, v FROM px) SELECT scene, row, col, round(avg(v), 4) AS v, count(*) AS n FROM s GROUP BY scene, row, col")
def agg19(spark, d):
    e = V.table(spark, d, "embeddings")
    w = e.selectExpr("vec_id div 4 AS scene", "(vec_id % 4) div 2 * 4 AS r0", "(vec_id % 2) * 4 AS c0", "8 AS width", "embedding AS values")
    return X.overlap_mean(w).select("scene", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("v", 4).alias("v"), "n")


# windows, sorts, sets


@query("win01_renumber", f"{W} SELECT id, (row_number() OVER (ORDER BY w * h DESC, idx)) AS candidate_id FROM cand")
def win01(spark, d):
    return in_order(V.cand(spark, d), "candidate_id", F.desc(F.col("w") * F.col("h")), F.col("idx")).select("id", "candidate_id")


@query("win02_review_order", "SELECT doc_id, (row_number() OVER (ORDER BY n_chars DESC, doc_id)) AS review_order FROM documents")
def win02(spark, d):
    return E.review_order(V.table(spark, d, "documents"), "n_chars", "doc_id").select("doc_id", "review_order")


@query("win03_stratified_sample", f"{PLAN}, r AS (SELECT d.*, row_number() OVER (PARTITION BY stratum ORDER BY md5(id || ':20260811'), id) AS k FROM d) SELECT r.id, r.stratum FROM r JOIN p ON p.stratum = r.stratum AND r.k <= p.sampled")
def win03(spark, d):
    rows = strata(spark, d)
    return E.stratified_sample(rows, E.strata_plan(rows, 25, 3), "id", 20260811).select("id", "stratum")


@query("win05_nearest_rank", f"{W}, p AS (SELECT b.id, a.idx, {DIST} AS d FROM fp_after b JOIN cand a ON {DIST} <= 25) SELECT id, idx, (row_number() OVER (PARTITION BY id ORDER BY d, idx))::INTEGER AS rank FROM p")
def win05(spark, d):
    p = S.near_pairs(S.prefixed(V.fp_after(spark, d), "l_"), S.prefixed(V.cand(spark, d), "r_"), 25.0, SIDE)
    return C.ranked_windows(p, "l_id", F.col("distance"), F.col("r_idx")).select(F.col("l_id").alias("id"), F.col("r_idx").alias("idx"), "rank")


@query("win06_box_blur", f"WITH {V.PX_SQL}, h AS (SELECT scene, row, col, avg(v) OVER (PARTITION BY scene, row ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM px) SELECT scene, row, col, round(avg(v) OVER (PARTITION BY scene, col ORDER BY row ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS v FROM h")
def win06(spark, d):
    got = X.box_blur(V.px(spark, d), 1)
    return got.select("scene", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("v", 4).alias("v"))


@query("srt02_enum_sort", "SELECT p, (row_number() OVER (ORDER BY CASE p WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, value DESC, event_id)) AS place, event_id FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS p FROM events)")
def srt02(spark, d):
    k = F.col("event_id") % 3
    rows = V.table(spark, d, "events").withColumn("p", F.when(k == 0, "low").when(k == 1, "high").otherwise("medium"))
    return in_order(rows, "place", C.priority_rank(F.col("p")), F.desc("value"), F.col("event_id")).select("p", "place", "event_id")


@query("srt03_topk_area", f"{W} SELECT id, w * h AS area FROM cand WHERE w * h >= 50 ORDER BY area DESC, id LIMIT 50")
def srt03(spark, d):
    """The 50 largest: a report, so a limit."""
    return V.cand(spark, d).select("id", (F.col("w") * F.col("h")).alias("area")).filter("area >= 50").orderBy(F.desc("area"), "id").limit(50)


@query("srt05_darkest", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 6")
def srt05(spark, d):
    """The six darkest: a report, so a limit."""
    return V.table(spark, d, "events").select("event_id", "value").orderBy("value", "event_id").limit(6)


@query("set01_union_sources", f"{W} SELECT source, count(*) AS n FROM (SELECT id, 'before' AS source FROM fp_before UNION ALL SELECT id, 'after' FROM fp_after UNION ALL SELECT id, source FROM cand) GROUP BY source")
def set01(spark, d):
    parts = [V.fp_before(spark, d).withColumn("source", F.lit("before")), V.fp_after(spark, d).withColumn("source", F.lit("after")), V.cand(spark, d)]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return both.groupBy("source").agg(F.count("*").alias("n"))


@query("set02_except_ids", f"{W} SELECT id FROM fp_after EXCEPT SELECT id FROM fp_before")
def set02(spark, d):
    return V.fp_after(spark, d).select("id").subtract(V.fp_before(spark, d).select("id"))


@query("set03_intersect_ids", f"{W} SELECT id FROM fp_after INTERSECT SELECT id FROM fp_before")
def set03(spark, d):
    return V.fp_after(spark, d).select("id").intersect(V.fp_before(spark, d).select("id"))


@query("set04_mask_algebra", f"WITH {V.PX_SQL} SELECT scene, count(*) FILTER (v > 0 AND col < 4) AS both, count(*) FILTER (v > 0 OR col < 4) AS either, count(*) FILTER (NOT v > 0) AS neither FROM px GROUP BY scene")
def set04(spark, d):
    a, b = F.col("v") > 0, F.col("col") < 4
    return V.px(spark, d).groupBy("scene").agg(F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either"), F.count_if(~a).alias("neither"))


# filters and cases


@query("flt01_min_area", f"{W} SELECT id FROM cand WHERE w * h >= 120")
def flt01(spark, d):
    return V.cand(spark, d).filter(Box.of().area() >= 120).select("id")


@query("flt02_threshold_mask", f"WITH {V.PX_SQL}, t AS (SELECT quantile_cont(v, 0.985) AS t FROM px) SELECT scene, count(*) AS n FROM px, t WHERE v >= t GROUP BY scene")
def flt02(spark, d):
    px = V.px(spark, d)
    cut = X.percentiles(px, "v", [0.985])
    return px.join(F.broadcast(cut)).filter("v >= p985").groupBy("scene").agg(F.count("*").alias("n"))  # one row


@query("flt03_bbox", f"{W} SELECT id FROM cand WHERE x0 BETWEEN 1000 AND 6000 AND y0 BETWEEN 2000 AND 9000")
def flt03(spark, d):
    return V.cand(spark, d).filter(Box(F.lit(1000), F.lit(2000), F.lit(6000), F.lit(9000)).contains(F.col("x0"), F.col("y0"))).select("id")


@query("flt04_survey_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def flt04(spark, d):
    return surveys(spark, d).filter(F.col("date").between("1996-01-01", "1996-12-31")).select(F.col("id").alias("o_orderkey"))


@query("flt05_confident", "SELECT event_id FROM events WHERE value > 0.5")
def flt05(spark, d):
    return V.table(spark, d, "events").filter("value > 0.5").select("event_id")


@query("flt06_blob_size", f"WITH {V.PX_SQL} SELECT scene, count(*) AS pixels FROM px WHERE v > 0.1 GROUP BY scene HAVING count(*) >= 20")
def flt06(spark, d):
    return V.px(spark, d).filter("v > 0.1").groupBy("scene").agg(F.count("*").alias("pixels")).filter("pixels >= 20")


@query("flt07_new_buildings", f"{W} SELECT a.id FROM fp_after a LEFT JOIN fp_before b ON b.id = a.id WHERE {AREA} >= 60 AND coalesce({OVER}, 0) / {AREA}::DOUBLE <= 0.25")
def flt07(spark, d):
    both = S.prefixed(V.fp_after(spark, d), "l_").join(S.prefixed(V.fp_before(spark, d), "r_"), F.col("l_id") == F.col("r_id"), "left")
    a, b = Box.of("l_"), Box.of("r_")
    return both.filter((a.area() >= 60) & (F.coalesce(a.overlap(b), F.lit(0)) / a.area() <= 0.25)).select(F.col("l_id").alias("id"))


@query("flt08_allowed_types", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def flt08(spark, d):
    return V.table(spark, d, "events").filter(F.col("event_type").isin("click", "view")).select("event_id")


HEIGHT = "CASE WHEN event_id % 5 <> 0 THEN (event_id % 9) - 4.0 END"


@query("prj01_classify", f"SELECT event_id, CASE WHEN h IS NOT NULL THEN CASE WHEN h >= 1.5 THEN 'likely_new_building' WHEN h <= -1.5 THEN 'likely_demolition' ELSE 'construction_change_candidate' END WHEN r >= 0.35 THEN 'likely_building_change' ELSE 'construction_change_candidate' END AS classification FROM (SELECT event_id, {HEIGHT} AS h, (event_id % 10) / 10.0 AS r FROM events)")
def prj01(spark, d):
    h = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 9) - F.lit(4.0))
    return V.table(spark, d, "events").select("event_id", X.classify(h, (F.col("event_id") % 10) / F.lit(10.0), 1.5, 0.35).alias("classification"))


@query("prj02_likely_buildings", f"SELECT event_id FROM (SELECT event_id, {HEIGHT} AS h FROM events) WHERE h >= 1.5")
def prj02(spark, d):
    return prj01(spark, d).filter("classification = 'likely_new_building'").select("event_id")


@query("prj03_tier", "SELECT event_id, CASE WHEN event_id % 4 >= 2 AND value >= 10 THEN 'corroborated' WHEN event_id % 4 > 0 THEN 'weakly_corroborated' ELSE 'footprint_only' END AS tier FROM events")
def prj03(spark, d):
    return V.table(spark, d, "events").select("event_id", C.support_tier(F.col("event_id") % 4, F.col("value"), 2, 10.0).alias("tier"))


@query("prj04_priority", "SELECT event_id, CASE WHEN event_id % 5 >= 3 AND user_id % 2 = 0 THEN 'high' WHEN event_id % 5 >= 2 OR user_id % 2 = 0 THEN 'medium' ELSE 'low' END AS priority FROM events")
def prj04(spark, d):
    return V.table(spark, d, "events").select("event_id", C.priority(F.col("event_id") % 5, F.col("user_id") % 2 == 0).alias("priority"))


@query("prj05_shadow_risk", "SELECT event_id, CASE WHEN f >= 0.5 THEN 'high' WHEN f >= 0.15 THEN 'medium' ELSE 'low' END AS shadow_risk FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS f FROM events)")
def prj05(spark, d):
    return V.table(spark, d, "events").select("event_id", X.shadow_risk((F.col("event_id") % 101) / F.lit(100.0)).alias("shadow_risk"))


@query("prj06_stratum", STRATA)
def prj06(spark, d):
    return strata(spark, d)


@query("prj07_change_class", "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND f >= 0.25 THEN 'building_extension_footprint_candidate' WHEN event_id % 3 = 0 THEN 'new_building_footprint_candidate' END AS classification FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS f FROM events) WHERE event_id % 3 = 0 OR f >= 0.25")
def prj07(spark, d):
    c = C.change_class((F.col("event_id") % 101) / F.lit(100.0), F.col("event_id") % 3 != 0, 0.25)
    return V.table(spark, d, "events").select("event_id", c.alias("classification")).filter("classification IS NOT NULL")


@query("prj08_agreement", "SELECT user_id, CASE WHEN count(DISTINCT event_type) > 1 THEN 'multi_source_agreement' ELSE 'single_source_candidate' END AS agreement FROM events GROUP BY user_id")
def prj08(spark, d):
    return V.table(spark, d, "events").groupBy("user_id").agg(C.agreement(F.count_distinct("event_type")).alias("agreement"))


# rasters


@query("ras01_normalise", f"WITH {V.PX_SQL}, s AS (SELECT scene, quantile_cont(v * 100, 0.02) AS lo, quantile_cont(v * 100, 0.98) AS hi FROM px GROUP BY scene) SELECT p.scene, sum(floor(greatest(0, least(255, round((p.v * 100 - lo) * 255.0 / greatest(hi - lo, 1), 6)))))::BIGINT AS total FROM px p JOIN s ON s.scene = p.scene GROUP BY p.scene")
def ras01(spark, d):
    px = V.px(spark, d).withColumn("v", F.col("v") * 100)
    s = X.percentiles(px, "v", [0.02, 0.98], "scene")
    scaled = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round((F.col("v") - F.col("p20")) * 255.0 / F.greatest(F.col("p980") - F.col("p20"), F.lit(1.0)), 6))))
    return px.join(s, "scene").groupBy("scene").agg(F.sum(scaled).cast("long").alias("total"))


@query("ras03_pixel_size", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN round(sqrt(abs(-(n_nationkey + 1) * (n_nationkey + 2) / 100.0::DOUBLE)), 6) ELSE 1.0::DOUBLE END AS px FROM nation")
def ras03(spark, d):
    n = F.col("n_nationkey")
    size = G.pixel_size((n + 1) / F.lit(10.0), F.lit(0.0), F.lit(0.0), -(n + 2) / F.lit(10.0), n % 2 == 0)
    return V.table(spark, d, "nation").select(n.alias("id"), F.round(size, 6).alias("px"))


@query("ras04_odd_kernel", "SELECT n_nationkey AS id, k + (k + 1) % 2 AS kernel FROM (SELECT n_nationkey, greatest(1, round_even(n_nationkey / 2.0, 0)::INTEGER) AS k FROM nation)")
def ras04(spark, d):
    return V.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), G.odd_kernel(F.col("n_nationkey"), F.lit(2.0)).alias("kernel"))


@query("ras08_score", f"WITH {V.PX_SQL} SELECT b.scene, round(sum(greatest(0, least(1, 0.8 * abs(a.v - b.v) + 0.2 * abs(a.v)))), 3) AS score FROM px b JOIN px a ON a.scene = b.scene + 1 AND a.row = b.row AND a.col = b.col GROUP BY b.scene")
def ras08(spark, d):
    px = V.px(spark, d)
    pair = X.pixel_pair(px, px.withColumn("scene", F.col("scene") - 1))
    return pair.groupBy("scene").agg(F.round(F.sum(X.change_score(F.abs(F.col("a") - F.col("b")), F.abs("a"))), 3).alias("score"))


MASK = "m AS (SELECT scene, row, col, scene * 64 + row * 8 + col AS pid FROM px WHERE v > 0.05)"
FLOOD = f"{MASK}, e AS (SELECT a.pid AS u, b.pid AS v FROM m a JOIN m b ON a.scene = b.scene AND a.pid <> b.pid AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1), r AS (SELECT pid AS node, pid AS seen FROM m UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen), l AS (SELECT node AS pid, min(seen) AS label FROM r GROUP BY node)"


def mask(spark, d):
    return V.px(spark, d).filter("v > 0.05").withColumn("pid", F.col("scene") * 64 + F.col("row") * 8 + F.col("col"))


@query("ras11_pixel_components", f"WITH RECURSIVE {V.PX_SQL}, {FLOOD} SELECT pid, label FROM l")
def ras11(spark, d):
    return X.pixel_components(mask(spark, d)).select("pid", "label")


@query("ras11_pixel_components_rounds", ORACLES["ras11_pixel_components"])
def ras11_rounds(spark, d):
    """The same by the distributed rounds alone."""
    return X.pixel_components(mask(spark, d), one_task_edges=0).select("pid", "label")


@query("ras12_shadow_split", f"WITH RECURSIVE {V.PX_SQL}, {FLOOD} SELECT label, count(*) AS pixels, round(avg(CASE WHEN pid % 3 = 0 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS shadow_fraction, avg(CASE WHEN pid % 3 = 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AS uncertain FROM l GROUP BY label")
def ras12(spark, d):
    labelled = X.pixel_components(mask(spark, d)).withColumn("shadow", F.col("pid") % 3 == 0)
    return X.shadow_split(labelled, 0.5)


@query("ras13_region_grow", f"WITH RECURSIVE {V.PX_SQL}, {FLOOD} SELECT pid FROM l WHERE label IN (SELECT label FROM l JOIN px p ON l.pid = p.scene * 64 + p.row * 8 + p.col WHERE p.v > 0.25)")
def ras13(spark, d):
    labelled = X.pixel_components(mask(spark, d))
    return X.grow(labelled, V.px(spark, d).filter("v > 0.25")).select("pid")


@query("ras14_height_delta", f"WITH {V.PX_SQL} SELECT b.scene, round(avg(a.v - b.v), 4) AS mean_delta FROM px b JOIN px a ON a.scene = b.scene + 1 AND a.row = b.row AND a.col = b.col WHERE b.v > -0.2 AND a.v > -0.2 GROUP BY b.scene")
def ras14(spark, d):
    px = V.px(spark, d).filter("v > -0.2")
    return X.pixel_pair(px, px.withColumn("scene", F.col("scene") - 1)).groupBy("scene").agg(F.round(F.avg(F.col("a") - F.col("b")), 4).alias("mean_delta"))


@query("ras15_window_starts", "SELECT p_partkey AS id, array_to_string(list_distinct(list_sort(list_concat(range(0, greatest(0, n - 256) + 1, 192), [greatest(0, n - 256)]))), ',') AS n_starts FROM (SELECT p_partkey, 200 + p_partkey * 7 % 1500 AS n FROM part)".replace("array_to_string(list_distinct(list_sort(", "len(list_distinct((").replace(")), ',') AS", "))) AS"))
def ras15(spark, d):
    n = F.lit(200) + F.col("p_partkey") * 7 % 1500
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(G.window_starts(n, 256, 192)).cast("long").alias("n_starts"))


@query("ras16_softmax", "SELECT vec_id, round(exp(embedding[1]) / (exp(embedding[1]) + exp(embedding[2]) + exp(embedding[3])), 4)::DOUBLE AS p FROM embeddings")
def ras16(spark, d):
    logits = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))
    return V.table(spark, d, "embeddings").select("vec_id", F.round(T.softmax(logits)[0], 4).alias("p"))


COSINE = "SELECT a.vec_id, greatest(0, least(1, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def vector_pairs(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query("ras17_cosine", f"SELECT vec_id, round(d, 4) AS distance FROM ({COSINE})")
def ras17(spark, d):
    return vector_pairs(spark, d).select("vec_id", F.round(T.cosine_distance(F.col("a"), F.col("b")), 4).alias("distance"))


@query("ras19_absdiff", f"WITH {V.PX_SQL} SELECT b.scene, round(max(abs(a.v - b.v)), 4) AS largest FROM px b JOIN px a ON a.scene = b.scene + 1 AND a.row = b.row AND a.col = b.col GROUP BY b.scene")
def ras19(spark, d):
    px = V.px(spark, d)
    return X.pixel_pair(px, px.withColumn("scene", F.col("scene") - 1)).groupBy("scene").agg(F.round(F.max(F.abs(F.col("a") - F.col("b"))), 4).alias("largest"))


@query("ras20_similarity_mask", f"SELECT vec_id FROM ({COSINE}) WHERE 1 - d < 0.1")
def ras20(spark, d):
    return vector_pairs(spark, d).filter(1 - T.cosine_distance(F.col("a"), F.col("b")) < 0.1).select("vec_id")


@query("ras21_focus", f"SELECT vec_id, round(tanh(d), 4) AS focus FROM ({COSINE})")
def ras21(spark, d):
    return vector_pairs(spark, d).select("vec_id", F.round(F.tanh(T.cosine_distance(F.col("a"), F.col("b"))), 4).alias("focus"))


@query("ras22_image_tiles", "SELECT i.id, y, x FROM (VALUES (0, 512, 256), (1, 1024, 192)) i(id, n, stride), unnest(range(0, n - 255, stride)) a(y), unnest(range(0, n - 255, stride)) b(x)")
def ras22(spark, d):
    images = spark.createDataFrame([(0, 512, 256), (1, 1024, 192)], "id int, n int, stride int")
    starts = lambda s: F.when(F.col("stride") == s, G.window_starts(F.col("n"), 256, s))
    tiles = images.withColumn("s", F.coalesce(starts(256), starts(192)))
    return tiles.select("id", F.explode("s").alias("y"), "s").select("id", "y", F.explode("s").alias("x"))


@query("ras24_downsample", f"WITH {V.PX_SQL} SELECT scene, row // 2 AS row, col // 2 AS col, round(avg(v), 4) AS v FROM px GROUP BY scene, row // 2, col // 2")
def ras24(spark, d):
    return X.downsample(V.px(spark, d), 2).select("scene", "row", "col", F.round("v", 4).alias("v"))


@query("ras25_mean_luma", "SELECT vec_id, round(avg(l), 4) AS luma FROM (SELECT vec_id, 0.299 * embedding[i] + 0.587 * embedding[i + 1] + 0.114 * embedding[i + 2] AS l, embedding[i] AS r FROM embeddings, range(1, 63, 3) t(i)) WHERE r > 0 GROUP BY vec_id")
def ras25(spark, d):
    px = V.table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.lit(61), F.lit(3))).alias("i"))
    at = lambda k: F.element_at("embedding", F.col("i") + k)
    return px.filter(at(0) > 0).groupBy("vec_id").agg(F.round(F.avg(X.luma(at(0), at(1), at(2))), 4).alias("luma"))


# scalars, scans and sinks

REPLY = "CASE event_id % 6 WHEN 0 THEN '{\"label\": \"new_building\", \"confidence\": 0.9, \"reason\": \"roof\"}' WHEN 1 THEN 'Sure: {\"label\": \"vegetation\", \"confidence\": 7.5}' WHEN 2 THEN '{\"label\": \"castle\", \"confidence\": 1}' WHEN 3 THEN 'no idea' WHEN 4 THEN '{\"label\": \"hardscape\", \"confidence\": \"high\", \"reason\": \"path\"}' ELSE props END"


@query("sca01_parse_verdict", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'new_building' WHEN 1 THEN 'vegetation' WHEN 4 THEN 'hardscape' ELSE 'unclear' END AS label, CASE event_id % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, event_id % 6 IN (0, 1, 4) AS valid FROM events")
def sca01(spark, d):
    v = T.parse_verdict(F.expr(REPLY))
    return V.table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", "v.label", "v.confidence", "v.valid")


@query("sca04_keyword_flag", f"{W} SELECT id, regexp_matches(lower(classification), 'building|extension|pool|driveway|pav') AS flag, replace(classification, '_', ' ') AS shown, lpad(id::VARCHAR, 6, '0') AS padded FROM cand")
def sca04(spark, d):
    return V.cand(spark, d).select("id", T.construction_flag(F.col("classification")).alias("flag"), F.replace("classification", F.lit("_"), F.lit(" ")).alias("shown"), F.lpad(F.col("id").cast("string"), 6, "0").alias("padded"))


@query("sca05_html_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM pages")
def sca05(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.md5(T.html_escape(F.col("html")).cast("binary")).alias("digest"))


@query("sca06_iso_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderdate::DATE <= DATE '1996-12-31' AS early FROM orders")
def sca06(spark, d):
    day = T.parse_date(F.col("o_orderdate").cast("string"))
    return V.table(spark, d, "orders").select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("iso"), (day <= F.lit("1996-12-31").cast("date")).alias("early"))


@query("sca07_array_functions", "SELECT vec_id, round(list_max(embedding)::DOUBLE, 4) AS largest, list_contains([1, 3, 5], label) AS odd FROM embeddings")
def sca07(spark, d):
    return V.table(spark, d, "embeddings").select("vec_id", F.round(F.array_max("embedding").cast("double"), 4).alias("largest"), F.array_contains(F.array(F.lit(1), F.lit(3), F.lit(5)), F.col("label")).alias("odd"))


@query("sca08_map_lookup", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN value + 1 END, -1.0::DOUBLE) AS px FROM events")
def sca08(spark, d):
    e = F.col("event_id")
    m = F.map_from_entries(F.array_compact(F.array(F.when(e % 2 == 0, F.struct(F.lit("pixelSizes").alias("k"), F.col("value").alias("v"))), F.when(e % 3 == 0, F.struct(F.lit("pixelSize").alias("k"), (F.col("value") + 1).alias("v"))))))
    return V.table(spark, d, "events").select(e, F.coalesce(F.try_element_at(m, F.lit("pixelSizes")), F.try_element_at(m, F.lit("pixelSize")), F.lit(-1.0)).alias("px"))


@query("sca09_falsy_coalesce", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type END, ''), nullif(CASE WHEN event_id % 2 = 0 THEN '' ELSE 'b' END, ''), 'default') AS v FROM events")
def sca09(spark, d):
    e = F.col("event_id")
    first = F.when(e % 3 == 0, "").when(e % 3 == 1, F.col("event_type"))
    return V.table(spark, d, "events").select(e, T.falsy_coalesce(first, F.when(e % 2 == 0, "").otherwise("b"), F.lit("default")).alias("v"))


@query("src05_feature_normalise", f"{W} SELECT idx, coalesce(nullif(model, ''), 'unknown') AS model, coalesce(CASE WHEN idx % 9 <> 0 THEN classification END, 'construction_change_candidate') AS classification FROM cand")
def src05(spark, d):
    return V.cand(spark, d).select("idx", T.falsy_coalesce(F.col("model"), F.lit("unknown")).alias("model"), F.coalesce(F.when(F.col("idx") % 9 != 0, F.col("classification")), F.lit("construction_change_candidate")).alias("classification"))


@query("src08_survey_zoom", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 20 + event_id % 3 ELSE 18 END AS zoom FROM events")
def src08(spark, d):
    from deltascape.sources.surveys import tile_zoom

    e = F.col("event_id")
    doc = F.concat(F.lit('{"tiles": [{"type": "Vert", "scale": 18}, {"type": "'), F.when(e % 2 == 0, "Vert").otherwise("North"), F.lit('", "scale": '), (20 + e % 3).cast("string"), F.lit("}]}"))
    return V.table(spark, d, "events").select("event_id", tile_zoom(doc, "Vert").cast("long").alias("zoom"))


@query("src16_remote_normalise", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN event_type END, ''), nullif(CASE WHEN event_id % 3 = 0 THEN 'clip' ELSE '' END, ''), 'remote_change_candidate') AS classification, 'remote' AS candidate_source FROM events")
def src16(spark, d):
    e = F.col("event_id")
    c = T.falsy_coalesce(F.when(e % 2 == 0, F.col("event_type")), F.when(e % 3 == 0, "clip").otherwise(""), F.lit("remote_change_candidate"))
    return V.table(spark, d, "events").select(e, c.alias("classification"), F.lit("remote").alias("candidate_source"))


@query("snk03_report_counts", f"{FUSE} SELECT agreement, count(*) AS n, round(sum(area_m2), 1) AS area FROM (SELECT area_m2, CASE WHEN source_count > 1 THEN 'multi_source_agreement' ELSE 'single_source_candidate' END AS agreement FROM a) GROUP BY agreement")
def snk03(spark, d):
    return C.fuse_candidates(V.cand(spark, d)).groupBy("agreement").agg(F.count("*").alias("n"), F.round(F.sum("area_m2"), 1).alias("area"))


@query("snk06_relevant_only", "SELECT event_id FROM events WHERE (CASE WHEN event_id % 3 = 0 THEN TRUE WHEN event_id % 3 = 1 THEN FALSE END) = TRUE")
def snk06(spark, d):
    e = F.col("event_id")
    return V.table(spark, d, "events").withColumn("relevant", F.when(e % 3 == 0, True).when(e % 3 == 1, False)).filter(F.col("relevant") == True).select("event_id")  # noqa: E712


@query("snk09_outcome_colours", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'white' WHEN quality = 1 THEN 'red' WHEN toxic = 1 THEN 'green' ELSE 'black' END AS colour FROM labels")
def snk09(spark, d):
    p, a = F.col("quality") == 1, F.col("toxic") == 1
    return V.table(spark, d, "labels").select("doc_id", F.when(p & a, "white").when(p, "red").when(a, "green").otherwise("black").alias("colour"))
