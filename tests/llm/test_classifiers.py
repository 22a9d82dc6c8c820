import math
import random
import zlib
from collections import Counter

import pandas as pd
import pytest

from deltascape.llm.quality import classify, feature_counts, features
from deltascape.llm.toxicity import toxicity

from .helpers import documents

WORDS = [a + b for a in "ba be bi bo bu da de di do du ka ke ki ko ku".split() for b in "lan ter mos rin vel".split()]


def corpus(spark, mark):
    """Documents of made words, half of them marked; labels for all, wrong ones for rows that must not be learnt from."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 80))]
        bad = i % 2
        rows.append((i, mark(words, rng) if bad else " ".join(words), f"s{i % 3}"))
        held = zlib.crc32(str(i).encode()) % 3 == 1
        labels.append((i, int(bad) ^ held, int(bad) ^ held, "x"))
    rows += [(None, "null id", None), (900, None, "a"), (901, "", "a"), (902, "word " * 30000, "a"), (0, rows[0][1], "a")]
    labels += [(None, 1, 1, "x"), (903, None, None, "x"), (0, labels[0][1], labels[0][2], "x")]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def accuracy(out, low=0.9):
    got = [r for r in out.select("doc_id", "_score", "_predicted").collect()]
    assert all(0 <= r._score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 100
    right = sum(r._predicted == r.doc_id % 2 for r in held) / len(held)
    assert right >= low, right
    return got


def test_quality_learns_marks(spark):
    docs, labels = corpus(spark, lambda words, rng: " ".join(w + "###" for w in words))
    got = accuracy(classify(docs, labels))
    assert len(got) == 605


def test_quality_learns_repetition(spark):
    docs, labels = corpus(spark, lambda words, rng: " ".join(w for w in words[:4] for _ in range(12)))
    accuracy(classify(docs, labels))


def test_toxicity_learns_words(spark):
    docs, labels = corpus(spark, lambda words, rng: " ".join(w if rng.random() > 0.1 else rng.choice(["zornig", "scumbag", "nastyva" + rng.choice("aeiou") + rng.choice("bcdfgh")]) for w in [*words, "zornig"]))
    got = accuracy(toxicity(docs, labels))
    assert len(got) == 605


def test_toxicity_tells_by_histories(spark):
    """The same words in both classes, and as often: only what stands before them differs."""

    def mark(words, rng):
        return " ".join(x for w in words for x in (rng.choice(["balan", "beter"]), w))

    docs, labels = corpus(spark, mark)
    ordered = lambda bad: [f"{a} {b}" for a, b in (("zorn", "kumquat"), ("blau", "pomelo"))] if bad else ["zorn pomelo", "blau kumquat"]
    rows = [(i, f"{t} {' '.join(ordered(i % 2))}", s) for i, t, s in docs.filter("doc_id < 600").select("doc_id", "text", "source").toPandas().drop_duplicates("doc_id").itertuples(index=False)]
    docs = documents(spark, [(i, " ".join(sorted(set(t.split()) & set(WORDS))) + " " + " ".join(t.split()[-4:]), s) for i, t, s in rows])
    accuracy(toxicity(docs, labels))


def brute_force_ratio(rows, texts, bound):
    """Mean log ratios by the formulas, over dictionaries: rows of (text, label) to learn from, texts to score."""
    found = {c: (Counter(), Counter()) for c in (0, 1)}
    for text, label in rows:
        words = text.split()
        found[label][0].update(set(words))
        found[label][1].update(set(zip(["", *words], words)))  # noqa: B905
    n = [sum(label == c for _, label in rows) for c in (0, 1)]
    pairs = set(found[0][1]) | set(found[1][1])
    shared = {w: k / len(pairs) for w, k in Counter(w for _, w in pairs).items()}

    def cut(counts):
        ones, twos = (sum(v == k for v in counts.values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.75

    def tells(k0, k1):
        parts = [k * math.log(k * sum(n) / ((k0 + k1) * n[c])) for c, k in enumerate((k0, k1)) if k]
        return 2 * sum(parts) > bound

    def of_word(c, w):
        counts = found[c][0]
        if not tells(found[0][0][w], found[1][0][w]):
            return shared[w]
        return (max(counts[w] - cut(counts), 0) + cut(counts) * len(counts) * shared[w]) / sum(counts.values())

    def of_pair(c, v, w):
        counts = found[c][1]
        behind = [k for (h, _), k in counts.items() if h == v]
        return (max(counts[v, w] - cut(counts), 0) + cut(counts) * len(behind) * of_word(c, w)) / sum(behind) if behind else of_word(c, w)

    out = []
    for text in texts:
        words, total = text.split(), 0.0
        for v, w in zip(["", *words], words):  # noqa: B905
            if (v, w) in pairs and tells(found[0][1][v, w], found[1][1][v, w]):
                total += math.log(of_pair(1, v, w) / of_pair(0, v, w))
            elif w in shared:
                total += math.log(of_word(1, w) / of_word(0, w))
        out.append(total / max(len(words), 1))
    return out


def test_toxicity_model_equals_brute_force(spark):
    from deltascape.llm import toxicity as T

    rng = random.Random(8)
    rows = []
    for i in range(120):
        words = [rng.choice(WORDS[:12]) for _ in range(rng.randint(3, 12))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["zorn", "scum"])
            words += ["kalan", "vile"]
        rows.append((" ".join(words), int(i % 3 == 0), i % 2))
    texts = [t for t, *_ in rows[:30]] + ["kalan vile zorn unseen vile", ""]
    model = T.build_models(T.counted(spark.createDataFrame(rows, "text string, label int, fold int")))
    assert model.items.filter("item like '% %'").count() > 0
    asked = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for m, folds in T.FOLDS.items():
        got = [r.ratio for r in model.weigh(asked, m, "ratio").orderBy("i").collect()]
        assert got == pytest.approx(brute_force_ratio([(t, y) for t, y, f in rows if f in folds], texts, T.BEYOND_CHANCE), abs=1e-9)


def test_toxicity_passes_counts_on_in_parts(monkeypatch):
    from deltascape.llm import toxicity as T

    frame = pd.DataFrame({"text": ["a b c", "a b", "c"], "label": [0, 1, 0], "fold": [0, 1, 0]})
    whole = pd.concat(T.count_items(iter([frame]))).groupby("item").sum()
    monkeypatch.setattr(T, "HELD_ITEMS", 2)
    parts = list(T.count_items(iter([frame])))
    assert len(parts) > 2
    assert pd.concat(parts).groupby("item").sum().equals(whole)


def test_toxicity_counts_survive_packing(spark, monkeypatch):
    """Counts through compressed blocks equal those by plain sums: many blocks, many parts, no rows, texts without words."""
    from deltascape.llm import toxicity as T

    rng = random.Random(3)
    rows = [(" ".join(rng.choice([*WORDS[:20], "Straße", "naïve", "語"]) for _ in range(rng.randint(0, 9))), rng.randint(0, 1), rng.randint(0, 1)) for _ in range(300)] + [(None, 0, 1), ("12 34", 1, 0)]
    schema = "text string, label int, fold int"
    plain = pd.concat(T.count_items(iter([pd.DataFrame(rows, columns=["text", "label", "fold"])]))).groupby("item").sum()
    expected = {w: tuple(int(v) for v in r) for w, r in zip(plain.index, plain.to_numpy(), strict=True)}
    monkeypatch.setattr(T, "BLOCK_CHARS", 500)
    for held in (T.HELD_ITEMS, 40):
        monkeypatch.setattr(T, "HELD_ITEMS", held)
        batches = [pd.DataFrame(rows[k::3], columns=["text", "label", "fold"]) for k in range(3)]
        packed = pd.concat(T.packed_counts(7)(iter(batches))).sort_values("block", kind="stable")
        assert packed["block"].nunique() == 7
        cut = len(packed) // 2  # blocks go across batches
        got = pd.concat(T.summed_counts(iter([packed[:cut], packed[cut:]])))
        assert {r[0]: tuple(r[1:]) for r in got[["item", *T.COUNTS]].itertuples(index=False)} == expected and got["item"].is_unique
    got = T.counted(spark.createDataFrame(rows, schema).repartition(4)).collect()
    assert len(got) == len(expected) and {r[0]: tuple(r)[1:] for r in got} == expected
    assert T.counted(spark.createDataFrame([], schema)).isEmpty()


def test_marks_miss_no_key(spark, monkeypatch):
    from deltascape.llm import toxicity as T

    rows = spark.range(5000).selectExpr("if(id = 7, null, id) AS doc_id", "'t' AS text")
    of = spark.range(0, 9000, 30).selectExpr("id AS doc_id")
    for marks, most in ((1 << 20, 200), (1 << 8, 5000)):
        monkeypatch.setattr(T, "MARKS", marks)
        got = {r.doc_id for r in T.maybe_among(rows, of, "doc_id").select("doc_id").collect()}
        assert set(range(0, 5000, 30)) <= got and len(got) <= most


def test_names_that_clash(spark):
    docs, labels = corpus(spark, lambda words, rng: " ".join([*words, "zorn", "scum"]))
    docs = docs.limit(50).withColumnRenamed("kept", "_score").withColumnRenamed("size", "ratio")
    for f in (classify, toxicity):
        out = f(docs, labels)
        assert out.columns == [*docs.columns, "_score_", "_predicted"]
        assert {r._score for r in out.select("_score").collect()} == {"x"}


def test_toxicity_keeps_rare_telling_words_of_a_large_corpus(spark, monkeypatch):
    """With a model far smaller than the corpus: each shard is shipped, and no telling word is lost."""
    from deltascape.llm import toxicity as T

    docs, labels = corpus(spark, lambda words, rng: " ".join([*words, rng.choice(["zorn", "scum", "nast", "vile", "crud", "muck"])]))
    score = lambda: {(r.doc_id, r.text): r._score for r in toxicity(docs, labels).select("doc_id", "text", "_score").collect()}
    whole = score()
    monkeypatch.setattr(T, "MODEL_ITEMS", 3)
    assert score() == pytest.approx(whole, abs=1e-9)
    accuracy(toxicity(docs, labels))


def passage():
    """Three words whose hash is less than those of all texts around it, so that all have it as their least."""
    from deltascape.llm.near_dedup import shingle_set

    rng = random.Random(9)
    return min((" ".join(rng.choice(WORDS) for _ in range(3)) for _ in range(20000)), key=lambda t: shingle_set(t, 3)[0])


def test_toxicity_learns_from_all_texts_that_share_a_passage(spark):
    shared = passage()
    docs, labels = corpus(spark, lambda words, rng: " ".join([shared, *words, rng.choice(["zorn", "scum", "nast"])]))
    accuracy(toxicity(docs, labels))


def test_toxicity_drops_confirmed_copies_only():
    from deltascape.llm.toxicity import drop_copies, least_shingles

    shared = passage().split()
    one, two = ([f"{x}{i}" for i in range(60)] for x in "ab")
    texts = [(1, [*shared, *one], 1), (2, [*shared, *one, "end"], 1), (3, [*shared, *one], 0), (4, [*shared, *two], 1), (5, [*shared, *one], 1), (6, [*shared, *two], 1)]
    frame = pd.DataFrame([(i, " ".join(t), n) for i, t, n in texts], columns=["doc_id", "text", "label"])
    met = pd.concat(least_shingles(iter([frame[:4], frame[4:]]))).assign(part=0)
    assert met["h"].nunique() == 1
    met = met.sort_values(["h", "label", "part", "doc_id"])
    got = pd.concat(drop_copies(iter([met[:2], met[2:]])))
    assert sorted(got["doc_id"]) == [1, 3, 4]


@pytest.mark.parametrize("f", [classify, toxicity])
def test_nothing_to_learn_from(spark, f):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, [(1, "a b", "s"), (2, None, "s"), (None, "", None)])
    assert len({r._score for r in f(docs, none).collect()}) == 1
    assert f(documents(spark, []), none).count() == 0
    one = spark.createDataFrame([(3, 1, 1), (2, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert f(docs, one).count() == 3


def test_features_add_up_over_parts(monkeypatch):
    from deltascape.llm import quality

    text = "ab cd  ef " * 50
    whole = feature_counts(text)
    monkeypatch.setattr(quality, "PART", 64)
    parts = list(features(text))
    assert len(parts) > 5
    words = quality._words(pd.Series([ord(c) for c in "ab"]).to_numpy("uint32"), pd.Series([False, False]).to_numpy())
    assert (words >> 48) in whole[0]


def test_quality_learns_from_as_many_rows_as_it_says():
    from deltascape.llm import quality

    assert quality.SAMPLE_ROWS >= 4000  # halved once, along with a repair of memory that did not need it
