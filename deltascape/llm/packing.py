"""Packing along a space-filling curve.

Documents are tokenised, their hashed token vectors are projected to a few dimensions, and the points are ordered by
their Hilbert index: a range sort by that key lays similar documents side by side. Each range is then one stream of
token ids, cut every 1024, so that only the last sequence of a range has padding.

Ranges are cut where the ids before them, counted by cell of the curve, reach even shares; a cell with more than a share
is counted by smaller cells, and at last by a hash of its rows, so that equal documents are dealt out too. There are
RANGES at most: in a larger corpus each is longer, which a stream does not mind.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, select_present, splitmix

SEQUENCE = 1024
#: Projected dimensions and bits of each: the Hilbert index has their product.
DIMS, BITS = 4, 8
#: Ids in a range of the curve at least, but for the last; a range has less than one sequence of padding.
RANGE_TOKENS = 4_000_000
#: Ranges at most. What is counted by cell on the driver has FIRST_CELLS rows, and in each later round 256 for each range.
RANGES, FIRST_CELLS = 4096, 1 << 16
#: Bits of a row's hash behind the curve index, by which a cell of equal documents is dealt; the place is both.
HASH_BITS = 16
PLACE_BITS = DIMS * BITS + HASH_BITS
END_ID = 0
#: The pattern by which the tokeniser splits text before merging, a fixed value of the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path() -> str:
    """Where the byte-level vocabulary of 50k ranks lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE at path; it gives the ids of the same vocabulary in the other library's format."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a whole text (null: none) and the closing id 0."""
    ids = encoder(path).encode(text or "", allowed_special="all")
    ids.append(END_ID)
    return np.array(ids, np.uint16)


@lru_cache(maxsize=1)
def directions(size: int = 65536) -> np.ndarray:
    """Fixed pseudo-random directions of the token ids, near normal."""
    seeds = np.arange(size * DIMS, dtype=np.uint64).reshape(size, DIMS)
    parts = [splitmix(seeds * np.uint64(8) + np.uint64(k + 1)).astype(np.float64) / 2.0**64 for k in range(4)]
    return ((sum(parts) - 2.0) * np.sqrt(3.0)).astype(np.float32)


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dims), each coordinate below 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def tokenised(frames: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    """Of every document: its ids as little-endian 16-bit numbers, their count and the curve index."""
    table = directions()
    for frame in frames:
        ids = [token_ids(t, path) for t in frame["text"]]
        means = np.array([table[x].mean(axis=0) for x in ids]).reshape(-1, DIMS)
        cells = np.minimum((2**BITS / (1.0 + np.exp(-12.0 * means))).astype(np.int64), 2**BITS - 1)
        yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": [x.tobytes() for x in ids], "doc_tokens": [len(x) for x in ids], "curve": hilbert_index(cells)})


def cut(frames: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Pieces of the documents of a partition's ranges: the stream of a range's ids, cut at each multiple of width."""
    now, at = -1, 0
    for frame in frames:
        rows = []
        for doc_id, raw, total, own in zip(frame["doc_id"], frame["ids"], frame["doc_tokens"], frame["range"], strict=True):
            if own != now:
                now, at = own, 0
            ids, start = np.frombuffer(raw, "<u2").astype("<u4"), 0
            while start < total:
                length = min(total - start, width - at % width)
                rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), total, (own << 40) + at // width, at % width))
                start += length
                at += length
        yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def range_starts(rows: DataFrame, total: int, range_tokens: int, most: int = RANGES) -> np.ndarray:
    """The places at which ranges start, in order; the first is 0. rows has a place and doc_tokens."""
    share = max(range_tokens, -(-total // most))
    if total <= share:
        return np.zeros(1, np.int64)
    shift = PLACE_BITS - int(np.log2(FIRST_CELLS))
    cells: list[tuple[int, int]] = []
    within = rows
    while True:
        found = [(r[0] << shift, r[1]) for r in within.groupBy(F.shiftright("place", shift).alias("cell")).agg(F.sum("doc_tokens")).collect()]
        heavy = [a for a, n in found if n > share] if shift else []
        cells += [(a, n) for a, n in found if not shift or n <= share]
        if not heavy:
            break
        wide = rows.sparkSession.createDataFrame([(a >> shift,) for a in heavy], "heavy long")  # less than one for each range
        within = rows.join(F.broadcast(wide), F.shiftright("place", shift) == F.col("heavy"), "left_semi")
        shift = max(0, shift - 8)
    cells.sort()
    places, before = np.array([a for a, _ in cells], np.int64), np.cumsum([0, *(n for _, n in cells[:-1])])
    number = before // share
    starts = places[np.concatenate(([True], number[1:] != number[:-1]))]
    starts[0] = 0
    return starts


def pack(docs: DataFrame, width: int = SEQUENCE, vocabulary: str | None = None, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """Pieces of all documents (doc_id and text are read): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the closing id alone. Rows that repeat an id are documents of their own. The string of
    the end token in a text gives that token's id, as the tokeniser's defaults have it. An empty table gives no rows.
    """
    path = vocabulary or vocabulary_path()
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = select_present(docs, "doc_id", "text").mapInPandas(lambda frames: tokenised(frames, path), f"doc_id {key}, ids binary, doc_tokens long, curve long")
    place = F.shiftleft("curve", HASH_BITS).bitwiseOR(F.xxhash64("row_uid").bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    rows = materialise(rows.withColumn("row_uid", F.monotonically_increasing_id()).withColumn("place", place).drop("curve"), "tokens")
    total = rows.agg(F.sum("doc_tokens")).first()[0] or 0
    starts = range_starts(rows, total, range_tokens)
    shipped = docs.sparkSession.sparkContext.broadcast(starts)  # RANGES numbers at most
    number = F.pandas_udf(lambda places: pd.Series(np.searchsorted(shipped.value, places.to_numpy(), "right") - 1), "long")
    laid = rows.withColumn("range", number("place")).repartitionById(len(starts), F.col("range").cast("int")).sortWithinPartitions("range", "place", "doc_id", "row_uid")
    schema = f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return laid.select("doc_id", "ids", "doc_tokens", "range").mapInPandas(lambda frames: cut(frames, width), schema)
