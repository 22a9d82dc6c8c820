import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deltascape.llm.packing import END_ID, hilbert_index, pack, token_ids, vocabulary_path

from .helpers import documents, simple

ROWS = [(i, t, "a") for i, t in enumerate(["short text", None, "", "long words " * 3000, "été, à côté — naïve", "don't we'll   spaces\n\n\ttabs  ", "数据 分析 🚀🚀", "x" * 5000, "<|endoftext|> inside"])] + [(0, "short text", "a"), (None, "null id", "b")]


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, END_ID]


@pytest.mark.parametrize("text", [t for _, t, _ in ROWS])
def test_ids_are_the_tokenizer_library_s(text):
    assert token_ids(text, vocabulary_path()).tolist() == reference_ids(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_of_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert token_ids(text, vocabulary_path()).tolist() == reference_ids(text)


@pytest.mark.parametrize(("width", "range_tokens"), [(1024, 4_000_000), (16, 500)])
def test_pieces_round_trip(spark, width, range_tokens):
    got = pack(documents(spark, ROWS), width=width, range_tokens=range_tokens).collect()
    ids = {}
    for i, t, _ in ROWS:
        ids.setdefault(i, reference_ids(t))
    covered = {}
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    for i, spans in covered.items():
        times = sum(x == i for x, _, _ in ROWS)
        assert sorted(spans) == sorted(list(range(len(ids[i]))) * times)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= width
    ranges = len({s >> 40 for s in by_sequence})
    assert len(by_sequence) * width - sum(r.length for r in got) < ranges * width


def test_empty(spark):
    assert pack(simple(spark, [])).count() == 0


def test_hilbert_neighbours():
    """The curve visits every cell once, and each step goes to a neighbour."""
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = hilbert_index(grid, 3)
    assert sorted(order.tolist()) == list(range(512))
    walk = grid[np.argsort(order)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_share_sequences(spark):
    texts = [("der die das und " if k % 2 else "the of and to ") * 20 + f"{k}" for k in range(200)]
    got = pack(simple(spark, texts), width=256).collect()
    mixed = 0
    for s in {r.sequence_id for r in got}:
        kinds = {r.doc_id % 2 for r in got if r.sequence_id == s}
        mixed += len(kinds) > 1
    assert mixed <= 3


def test_ranges_are_even_in_ids(spark):
    """Equal documents, long ones and a crowded part of the curve: no range has more than two shares and one document."""
    from deltascape.llm import packing

    rows = [(7 << 16 | i % 65536, 50) for i in range(3000)] + [((900_000 + i * i) << 16 | i, 400) for i in range(400)] + [((2_000_000_000 + i) << 16, 10) for i in range(2000)]
    frame = spark.createDataFrame(rows, "place long, doc_tokens long")
    total, share = sum(n for _, n in rows), 5000
    starts = packing.range_starts(frame, total, share)
    assert starts[0] == 0 and (np.diff(starts) > 0).all()
    sums = np.zeros(len(starts), int)
    for place, n in rows:
        sums[np.searchsorted(starts, place, "right") - 1] += n
    assert sums.sum() == total and sums.max() <= 2 * share + 400 and len(starts) <= total // share + 1
    few = packing.range_starts(frame, total, share, most=8)
    assert 4 <= len(few) <= 8


def test_very_long_text(spark):
    got = pack(simple(spark, ["many words of one long text " * 60000, "short"])).collect()
    assert sum(r.length for r in got if r.doc_id == 0) == len(reference_ids("many words of one long text " * 60000))
