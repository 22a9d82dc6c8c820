import random
import re
from itertools import combinations

import numpy as np
import pytest

from deltascape.llm import near_dedup as N

from .helpers import documents, simple

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    lowest = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(s), lowest[find(i)]) for i, ((d, _, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, groups=12, copies=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, at = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 30, 120, 200]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = word()
            rows.append((at, (" " if g % 2 else "\n").join(w).upper() if g % 3 else " ".join(w), "a"))
            at += 1
    passage = " ".join(word() for _ in range(40))
    rows += [(at + i, passage + " " + " ".join(word() for _ in range(60)), "b") for i in range(20)]
    rows += [(1000, None, "a"), (1001, "", "a"), (1002, " \t", "a"), (1003, "one", "a"), (1004, "ONE", "a"), (1005, "one two", "a"), (None, "one two", None), (1006, rows[0][1], "a"), (1006, rows[0][1], "a"), (1007, "w " * 3000, "a"), (1008, "long " * 3000 + "end", "a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, size, percent):
    rows = corpus(size)
    got = N.near_duplicates(documents(spark, rows), size, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_groups_in_parts(spark, monkeypatch):
    """With parts of a few documents, so that buckets and groups are dealt and stragglers ask."""
    monkeypatch.setattr(N, "PART_DOCS", 4)
    monkeypatch.setattr(N, "ANCHORS", 1)
    rows = corpus(7, groups=6, copies=40)
    got = N.near_duplicates(documents(spark, rows), 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 85)


def test_chains_are_followed(spark, monkeypatch):
    """Each links with the next only, so the ends are far apart."""
    monkeypatch.setattr(N, "PART_DOCS", 3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 150]), "a") for i in range(24)]
    got = N.near_duplicates(documents(spark, rows), 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 85)


def test_empty(spark):
    assert N.near_duplicates(simple(spark, [])).count() == 0
    assert N.near_duplicates(simple(spark, [None, ""])).count() == 2


def test_drop_keeps_one_of_each_group(spark):
    rows = corpus(11)
    docs = documents(spark, rows)
    got = N.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    want = {c for d, _, c in brute(rows, 5, 80) if c is not None}
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted(want)


def test_drop_keeps_different_texts_of_null_and_repeated_ids(spark):
    texts = [" ".join(f"{a}{i}" for i in range(40)) for a in "abcdef"]
    rows = [(None, texts[0], "a"), (None, texts[1], "a"), (None, texts[2], "a"), (None, texts[2] + " end", "a"), (7, texts[3], "a"), (7, texts[4], "a"), (7, texts[4], "a"), (8, texts[4] + " end", "a"), (7, "", "a"), (None, texts[5], "a"), (9, texts[5], "a")]
    got = [(r.doc_id, r.text) for r in N.drop_near_duplicates(documents(spark, rows)).collect()]
    assert len(got) == 7
    assert {(None, texts[0]), (None, texts[1]), (7, texts[3]), (7, texts[4]), (7, ""), (9, texts[5])} < set(got)
    assert {(None, texts[2]), (None, texts[2] + " end")} & set(got)


def test_hashing_is_that_of_words():
    assert (N.word_hashes("Ab  cd\n") == N.word_hashes("aB\tCD")).all()
    assert len(np.unique(N.word_hashes("a b ab ba é É"))) == 6
    long = "x" * 70000
    assert N.word_hashes(f"a {long} b")[0] == N.word_hashes("a")[0]


def test_prune_bounds():
    assert all(a <= b for a, b in zip(N.least_matches(85), N.least_matches(95)))
    rng = np.random.default_rng(0)
    hits = rng.random((4000, N.HASHES)) < 0.85
    sig = np.zeros(N.HASHES, np.uint32)
    assert len(N.survivors(sig, np.where(hits, 0, 1).astype(np.uint32), 85)) >= 3998


def test_dropping_solves_small_edge_tables_without_rounds(spark, monkeypatch):
    from deltascape.operators import components

    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[:100], f"end{i}"]) for i in range(6)] + [" ".join([*words[100:], f"end{i}"]) for i in range(5)] + ["alone " * 3, None, " ".join(words[:50])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(N, "PART_DOCS", 4)  # groups are dealt, so that stragglers are sought too
    rounds = []
    monkeypatch.setattr(components, "_stars", lambda pairs, total, f=components._stars: rounds.append(1) or f(pairs, total))
    got = sorted(r.doc_id for r in N.drop_near_duplicates(docs).collect())
    assert got == [0, 6, 11, 12, 13] and not rounds
    monkeypatch.setattr(N, "ONE_TASK_EDGES", 0)
    assert sorted(r.doc_id for r in N.drop_near_duplicates(docs).collect()) == got and rounds
