import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from deltascape.llm.source_mix import mix_sources, mixed_documents, quality_weight, slice_of, source_targets, uniform, word_count

from .helpers import documents, simple

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Water filling, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def rows(n=400):
    out = [(i, "word " * (1 + i * 7 % 40), "hot" if i % 3 else f"s{i % 5}") for i in range(n)]
    return [*out, (None, "null id here", "s1"), (n, None, "s2"), (n + 1, "", None), (n + 2, "one two", None), (5, "repeated id", "hot"), (5, "repeated id", "hot"), (n + 3, "junk$$$ ### " * 3000, "long")]


@pytest.mark.parametrize("slice_rows", [8, 8192])
def test_targets_and_totals(spark, slice_rows):
    data = rows()
    got = mix_sources(documents(spark, data), slice_rows=slice_rows).collect()
    assert len(got) == len(data)
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert taken[s] == int(t + 1e-9)


def test_slices_do_not_change_the_draw_and_reruns_agree(spark):
    docs = documents(spark, rows())
    draw = lambda n: sorted(((r.doc_id, r.size, r.taken) for r in mix_sources(docs, slice_rows=n).collect()), key=str)
    assert draw(8) == draw(8192) == draw(8)


@pytest.mark.parametrize("weight", ["0.1", "0.5", "1.0", "0.1 + 0.9 * rand(2)", "if(id % 2 = 0, 0.1, 1.0)"])
def test_slices_are_bounded_whatever_the_weights(spark, weight):
    n, most = 60000, 200
    rows = spark.range(n).withColumn("key", -F.ln(uniform(F.col("id"))) / F.expr(weight)).withColumn("slice", slice_of(F.col("key"), F.lit(n), most))
    sizes = [r["count"] for r in rows.groupBy("slice").count().collect()]
    assert sum(sizes) == n and max(sizes) < 1.5 * most
    assert rows.selectExpr("corr(key, slice) > 0 AS up").first().up


def test_epochs_precede_the_sample(spark):
    got = mix_sources(documents(spark, rows())).collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s and r.size]
        if own:
            epochs = min(2, int(own[0].target // own[0].source_size))
            assert all(epochs * r.size <= r.taken for r in own)
            assert sum(epochs * r.size < r.taken < (epochs + 1) * r.size for r in own) <= 1


def test_quality_scales_the_draw(spark):
    data = [(i, "plain words here and there" if i % 2 else "$$$ ### %%% &&& ***", "a") for i in range(2000)] + [(5000 + i, "filler " * 40, "b") for i in range(200)]
    got = mix_sources(documents(spark, data), weights=(1.0, 8.0), share=0.35).filter("source = 'a'").collect()
    good = sum(r.taken for r in got if r.doc_id % 2)
    assert good > 4 * sum(r.taken for r in got if not r.doc_id % 2)


def test_mixed_documents(spark):
    docs = documents(spark, rows())
    made = mixed_documents(docs)
    assert made.columns == docs.columns
    taken = {s: n for s, n in ((r.source, r.n) for r in mix_sources(docs).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect())}
    words = defaultdict(int)
    for r in made.collect():
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert {s: n for s, n in taken.items() if n} == dict(words)


def test_empty_and_wordless(spark):
    assert mix_sources(simple(spark, [])).count() == 0
    assert [r.taken for r in mix_sources(simple(spark, [None, "", "  "])).collect()] == [0, 0, 0]
    assert mixed_documents(simple(spark, [None, ""])).count() == 0


def test_weight_and_count(spark):
    text = F.col("text")
    r = simple(spark, ["Two words. ok", "### $$$"]).select(word_count(text).alias("n"), quality_weight(text, word_count(text)).alias("w")).collect()
    assert [(x.n, round(x.w, 3)) for x in r] == [(3, 1.0), (2, 0.1)]


def test_water_level(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = targets({"a": 10, "b": 1000, "c": 5, None: 50})
    assert got == {k: pytest.approx(v) for k, v in want.items()}
