import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from deltascape.llm.exact_dedup import cut_points, drop_duplicates, exact_dedup

from .helpers import documents, simple

LONG = "word " * 60000
ROWS = [
    (5, "a b c", "s"), (3, "abc", "s"), (4, "ab\tc\n", "s"), (9, None, "s"), (8, "", "s"), (7, " \n", "s"), (None, "abc", "s"), (1, LONG, None), (2, LONG + "x", None), (6, LONG.replace(" ", "  "), None),
    (10, "é ü", "s"), (11, "éü", "s"), (12, "abc", "s"), (12, "abc", "s"),
]


def brute(rows):
    groups = {}
    for n, (i, t, _) in enumerate(rows):
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i or 0, n))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 2])
def test_equals_brute_force(spark, bits):
    """Also with identifiers so short that nearly all chunks share one, which verification must tell apart."""
    got = exact_dedup(documents(spark, ROWS), id_bits=bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_table(spark):
    assert exact_dedup(simple(spark, [])).count() == 0


def test_drop_duplicates_keeps_columns_and_one_of_each(spark):
    docs = documents(spark, ROWS)
    got = drop_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 4, 6, 7, 10]


@given(st.binary(max_size=5000), st.integers(0, 200))
def test_chunks_cover_and_repeat(data, k):
    cuts = cut_points(data, mean=64, longest=512)
    assert cuts == sorted(set(cuts)) and (not data or cuts[-1] == len(data))
    assert all(b - a <= 512 for a, b in zip([0, *cuts], cuts))
    shifted = cut_points(b"x" * k + data, mean=64, longest=512)
    assert shifted == [] or shifted[-1] == len(data) + k
