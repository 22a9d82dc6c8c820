import math
import random

import numpy as np
import pytest

from deltascape.llm.topk_search import Block, top_k

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k):
    ints = [(i, [math.floor(float(np.float32(x)) * 1024) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ints if i % 100 == 0}):
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for o, own in ints if o == q for i, v in ints if i != q)[:k]  # noqa: B905
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_equals_brute_force(spark, block):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], "x") for i in range(450)]
    rows += [(1000 + i, rows[3][1], "x") for i in range(30)]  # ties
    rows += [(2000, None, "x"), (None, [1.0] * 6, "x"), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (2200, [float("nan")] + [1.0] * 5, "x"), (2300, [float("inf")] + [1.0] * 5, "x"), (5, rows[5][1], "x")]
    rows += [(3000, [0.0] * 6, "x"), (7, [9.0] * 6, "x"), (7, [8.0] * 6, "x"), (100, [5.0] * 6, "x"), (100, [6.0] * 6, "x")]  # rows that repeat an id
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA), 10, block_rows=block, batch_queries=2).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, 10)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0], "x"), (1, [1.0, 1.0], "x")]
    assert [tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA)).collect()] == [(0, 1, 1, 3 * 1024 * 1024)]
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stops_early_where_the_bound_allows():
    rng = np.random.default_rng(0)
    vectors = np.rint(np.exp(rng.normal(0, 2, (5000, 3))) * 100).astype(np.int64)
    block = Block(np.arange(5000), vectors, 10)
    best, scored = block.search(-1, np.array([5, 3, 1]), 10)
    order = np.lexsort((np.arange(5000), -(vectors @ [5, 3, 1])))[:10]
    assert [i for _, i in best] == order.tolist()
    assert scored < 2500
