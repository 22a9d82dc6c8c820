import random
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from deltascape.llm.packing import token_ids, vocabulary_path

from .helpers import documents
from .test_near_dedup import brute
from .test_source_mix import WORD, targets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data set of a few hundred documents: marked junk, copies, near copies, odd rows, clashing extra columns."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randint(30, 90))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "###" for w in words) if bad else " ".join(words), f"s{i % 4}" if i % 3 else "hot"))
        labels.append((i, int(not bad), 0))
    for k, base in enumerate(rows[1:40:6]):
        for n in range(5):
            w = base[1].split(" ")
            if n > 1:
                w[rng.randrange(len(w))] = word()
            rows.append((1000 + 10 * k + n, ("\n" if n == 1 else " ").join(w), base[2]))
    rows += [(None, None, None), (2000, "", "a"), (2001, " \n", None), (None, " ".join(word() for _ in range(30)), None), (rows[5][0], rows[5][1], rows[5][2])]
    path = tmp_path_factory.mktemp("data")
    documents(spark, rows).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), rows


def stages(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, path), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_stages_equal_brute_force(spark, folder):
    path, rows = folder
    raw, good, exact, near, mixed, packed = stages(spark, path)
    columns = raw.columns
    assert good.columns == exact.columns == near.columns == mixed.columns == columns
    assert {r["_key"] for r in mixed.collect()} == {"x"} and {r["size"] for r in near.collect()} == {"x"}
    # junk goes, clean documents stay
    kept = {r.doc_id for r in good.collect()}
    assert not any(r[0] is not None and r[0] < 240 and r[0] % 4 == 0 and r[0] in kept for r in rows)
    assert {i for i, _, _ in rows if i is not None and 0 < i < 240 and i % 4} <= kept
    # one row of each text
    text_of = lambda df: Counter("".join(WORD.findall(r.text or "")) for r in df.collect())
    assert text_of(exact) == Counter(set(text_of(good)))
    # one row of each group of near copies
    left = [(r.doc_id, r.text, r.source) for r in exact.collect()]
    assert Counter(r.doc_id for r in near.collect()) == Counter({c for _, _, c in brute(left, 5, 80)})
    # sources get their words
    sizes, got = defaultdict(int), defaultdict(int)
    for r in near.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for r in mixed.collect():
        got[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert dict(got) == {s: int(t + 1e-9) for s, t in targets(sizes).items() if int(t + 1e-9)}
    # every token of the mix lies in one piece
    want = sum(len(token_ids(r.text, vocabulary_path())) for r in mixed.collect())
    assert sum(r.length for r in packed.collect()) == want
    whole = pipeline.run(spark, path)
    key = lambda r: (r.doc_id is None, r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, packed.collect()))


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder[0]}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert all(df.count() == 0 for df in stages(spark, str(tmp_path)))


def test_stages_are_those_named():
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "source mix", "packing"]
    assert zlib.crc32(b"0") % 3 in (0, 1, 2)
