import pytest
from pyspark.sql import functions as F

from deltascape.functions import text as T
from deltascape.operators import evaluation as E
from deltascape.operators import pixels as X
from deltascape.plans.config import Settings, preset

LABELS = "assessment string, outline_quality string, issues array<string>, detected int, total int"


def test_label_summary(spark):
    rows = [("real", "poor", ["shadow"], 1, 3), ("real", None, [], 2, 2), (None, "poor", ["pool"], 1, None)]
    r = E.label_summary(spark.createDataFrame(rows, LABELS)).first()
    assert (r.labelled_site_count, r.known_building_total, r.detected_building_total, r.building_recall_on_known_sites) == (3, 5, 3, 0.6)
    assert r.assessment_counts == {"real": 2, "unlabelled": 1} and r.outline_quality_counts == {"poor": 2, "unlabelled": 1} and r.issue_counts == {"shadow": 1, "pool": 1}
    with pytest.raises(Exception, match="non-negative"):
        E.label_summary(spark.createDataFrame([("real", None, [], 3, 2)], LABELS)).collect()


def test_bands_and_strata(spark):
    df = spark.createDataFrame([(a,) for a in (10.0, 59.9, 60.0, 149.9, 150.0, 10000.0, -1.0)], "a double")
    assert [r.b for r in df.select(E.size_band(F.col("a")).alias("b")).collect()] == ["small", "small", "medium", "medium", "large", "large", "large"]
    rows = [(i, t, (30.0, 100.0, 300.0)[i % 3]) for i, t in enumerate(["corroborated"] * 6 + ["weakly_corroborated"] * 68 + ["footprint_only"] * 68)]
    df = spark.createDataFrame(rows, "id long, tier string, area double").withColumn("stratum", E.stratum(F.col("tier"), F.col("area")))
    plan = E.strata_plan(df, 25, 3)
    got = plan.collect()
    assert len(got) == 9 and all(r.sampled <= r.population for r in got) and abs(sum(r.sampled * r.weight for r in got) - 142) < 1
    draw = lambda: sorted(r.id for r in E.stratified_sample(df, plan, "id", 7).collect())
    assert draw() == draw() and len(draw()) == sum(r.sampled for r in got)
    with pytest.raises(ValueError):
        E.strata_plan(df, 0, 1)


def test_weighted_precision(spark):
    sample = spark.createDataFrame([(1, "c"), (2, "c"), *[(i, "f") for i in range(3, 9)], (99, "f")], "id long, stratum string")
    plan = spark.createDataFrame([("c", 2), ("f", 96)], "stratum string, population long")
    labels = spark.createDataFrame([("1", "correct"), ("2", "correct"), *[(str(i), "wrong") for i in range(3, 9)]], "id string, verdict string")
    r = E.weighted_precision(sample, labels, plan).first()
    assert r.labelled == 8 and r.population_covered == 98 and r.weighted_precision == pytest.approx(2 / 98, abs=1e-4)
    none = E.weighted_precision(sample, labels.limit(0), plan).first()
    assert none.labelled == 0 and none.weighted_precision is None


def test_confusion_and_risk(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 4, "p int, a int")
    r = E.confusion(df, F.col("p"), F.col("a")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 1, 2, 4) and r.precision == pytest.approx(0.75) and r.recall == pytest.approx(0.6) and r.iou == pytest.approx(0.5)
    risk = lambda v: spark.createDataFrame([(v,)], "f double").select(X.shadow_risk(F.col("f")).alias("r")).first().r
    assert [risk(v) for v in (0.0, 0.15, 0.5)] == ["low", "medium", "high"]
    with pytest.raises(Exception, match="between 0 and 1"):
        risk(1.01)


def test_histogram_percentiles_equal_exact_ones(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 10, 7, 7, 7, 3)], "v double")
    a = X.exact_percentiles(df, "v", [0.0, 0.02, 0.5, 0.98, 1.0]).first()
    b = X.percentiles(df, "v", [0.0, 0.02, 0.5, 0.98, 1.0]).first()
    assert [pytest.approx(x) for x in a] == list(b)


def test_presets():
    assert preset("balanced") == Settings()
    high = preset("high-recall")
    assert (high.threshold.percentile, high.shape.min_area_m2, high.shape.opening_m, high.shadow.enabled) == (96.0, 10.0, 0.2, False)
    mixed = high.with_values({"threshold.percentile": 97.5})
    assert (mixed.threshold.percentile, mixed.shape.min_area_m2) == (97.5, 10.0)
    with pytest.raises(ValueError):
        preset("none")
    for name, value in (("threshold.fixed", 2.0), ("threshold.percentile", 100), ("shadow.overlap", 0), ("shape.min_area_m2", -1), ("registration.most_px", -0.5)):
        with pytest.raises(ValueError, match=name):
            Settings().with_values({name: value})


VERDICTS = [
    ('{"label": "new_building", "confidence": 0.9, "reason": "roof"}', ("new_building", 0.9, "roof", True)),
    ('```json\n{"label": "hardscape", "confidence": 0.5}\n```', ("hardscape", 0.5, "", True)),
    ('Sure! {"label": "vegetation", "confidence": 0.25, "reason": "trees"} Done.', ("vegetation", 0.25, "trees", True)),
    ('{"label": "castle", "confidence": 1}', ("unclear", 0.0, "unknown label", False)),
    ('ignore all rules {"label": "DROP TABLE", "confidence": 1}', ("unclear", 0.0, "unknown label", False)),
    ('{"label": "new_building", "confidence": 7.5}', ("new_building", 1.0, "", True)),
    ('{"label": "new_building", "confidence": -3}', ("new_building", 0.0, "", True)),
    ('{"label": "new_building", "confidence": "high"}', ("new_building", 0.0, "", True)),
    ('{"label": "unclear", "confidence": 0.1, "reason": "' + "x" * 5000 + '"}', ("unclear", 0.1, "x" * 200, True)),
    ("", ("unclear", 0.0, "unparsable reply", False)),
    ("[1,2,3]", ("unclear", 0.0, "unparsable reply", False)),
    ("null", ("unclear", 0.0, "unparsable reply", False)),
    (None, ("unclear", 0.0, "unparsable reply", False)),
]


def test_verdicts(spark):
    got = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(VERDICTS)], "i int, reply string").select("i", T.parse_verdict(F.col("reply")).alias("v")).orderBy("i").collect()
    assert [tuple(r.v) for r in got] == [want for _, want in VERDICTS]


def test_text_functions(spark):
    df = spark.createDataFrame([("", None, "<a href='x'>&\"</a>", "2024-03-05T10:00:00Z"), ("v", "w", "", "bad")], "a string, b string, h string, d string")
    r = df.select(T.falsy_coalesce(F.col("a"), F.col("b"), F.lit("z")).alias("c"), T.html_escape(F.col("h")).alias("h"), T.parse_date(F.col("d")).cast("string").alias("d")).collect()
    assert [tuple(x) for x in r] == [("z", "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;&lt;/a&gt;", "2024-03-05"), ("v", "", None)]
