"""Exact deduplication by content-defined chunk recipes.

Each normalised text is cut where a rolling gear hash of the last 16 bytes hits a target, so equal passages are cut
alike wherever they stand. Chunks get 64-bit identifiers, which are verified against their SHA-256 over the whole
corpus; a document is then its ordered list of verified identifiers, and texts are equal when the lists are. Only
identifiers are shuffled: a long document is read once and never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, join_groups, materialise, numbered, row_key, select_present, splitmix

#: Mean chunk length in bytes (a power of two) and the longest chunk.
MEAN_CHUNK, MAX_CHUNK = 2048, 65536
WHITE = b" \t\n\v\f\r"
GEAR = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def cut_points(data: bytes, mean: int = MEAN_CHUNK, longest: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of data: where the hash of the 16 bytes before is a target, and each `longest` bytes."""
    n = len(data)
    if not n:
        return []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        if n > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    h *= np.uint32(0x9E3779B1)
    ends = np.flatnonzero(h < np.uint32(2**32 // mean)) + 1
    cuts, last = [], 0
    for end in [*ends.tolist(), n]:
        while end - last > longest:
            last += longest
            cuts.append(last)
        if end > last:
            cuts.append(end)
            last = end
    return cuts


def fingerprints(frames: Iterator[pd.DataFrame], id_bits: int = 64) -> Iterator[pd.DataFrame]:
    """Of every text: code points, hash of the normalised text, and its chunks' identifiers and digests in order."""
    drop = 64 - id_bits
    for frame in frames:
        points, whole, ids, digests = [], [], [], []
        for text in frame["text"]:
            text = text or ""
            points.append(len(text))
            data = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
            whole.append(hashlib.sha256(data).hexdigest())
            start, own, full = 0, [], []
            for end in cut_points(data):
                chunk = data[start:end]
                own.append((xxhash.xxh3_64_intdigest(chunk) >> drop) - (1 << (id_bits - 1)))
                full.append(hashlib.sha256(chunk).digest())
                start = end
            ids.append(own)
            digests.append(full)
        yield pd.DataFrame({"doc_id": frame["doc_id"], "row_uid": frame["row_uid"], "n_points": points, "text_sha256": whole, "chunk_ids": ids, "chunk_digests": digests})


def verified_recipes(prints: DataFrame) -> DataFrame:
    """prints with column recipe, in which one identifier stands for one chunk content only.

    An identifier that two contents share is found by comparing digests over the whole corpus; its contents are then
    told apart by their rank. Without such, the identifiers serve as they are.
    """
    chunks = prints.select(F.explode(F.arrays_zip("chunk_ids", "chunk_digests")).alias("c")).select("c.chunk_ids", "c.chunk_digests")
    shared = chunks.groupBy("chunk_ids").agg(F.min("chunk_digests").alias("a"), F.max("chunk_digests").alias("b")).filter("a <> b").select("chunk_ids")
    if shared.isEmpty():
        return prints.withColumn("recipe", F.transform("chunk_ids", lambda c: F.struct(c.alias("id"), F.lit(0).alias("rank")))).drop("chunk_ids", "chunk_digests")
    ranked = chunks.distinct().join(shared, "chunk_ids").withColumn("rank", F.row_number().over(Window.partitionBy("chunk_ids").orderBy("chunk_digests")))
    placed = prints.select("row_uid", F.posexplode(F.arrays_zip("chunk_ids", "chunk_digests")).alias("pos", "c")).select("row_uid", "pos", "c.*")
    lists = (
        placed.join(ranked, ["chunk_ids", "chunk_digests"], "left")
        .groupBy("row_uid")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.col("chunk_ids").alias("id"), F.coalesce("rank", F.lit(0)).alias("rank")))).alias("l"))
        .select("row_uid", F.transform("l", lambda c: F.struct(c["id"].alias("id"), c["rank"].alias("rank"))).alias("recipe"))
    )
    empty = F.array().cast("array<struct<id:bigint,rank:int>>")
    return prints.drop("chunk_ids", "chunk_digests").join(lists, "row_uid", "left").withColumn("recipe", F.coalesce("recipe", empty))


def exact_dedup(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """One row per row of docs (columns doc_id and text are read): doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Texts are equal when identical without white space. Of equal texts the one with the most code points stays, then
    the smallest doc_id (null ids last), then, of rows that repeat an id, one of them. A null text is an empty one, and
    empty texts are one group. An empty table gives no rows. Extra columns play no part.
    """
    rows = select_present(docs, "doc_id", "text").withColumn("row_uid", F.monotonically_increasing_id())
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row_uid long, n_points long, text_sha256 string, chunk_ids array<bigint>, chunk_digests array<binary>"
    prints = materialise(rows.mapInPandas(lambda frames: fingerprints(frames, id_bits), schema), "recipes")
    recipes = verified_recipes(prints)
    order = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row_uid").alias("uid"))
    groups = recipes.groupBy("recipe").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    groups = materialise(groups.select("recipe", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size"), "groups")
    out = join_groups(recipes, groups, "recipe", "group_size", prints.count())
    return out.select("doc_id", "keep_id", "group_size", (F.col("row_uid") == F.col("keep_uid")).alias("kept"), "text_sha256", "n_points", "row_uid")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row keeps; the columns stay as they are.

    The rows that stay are found again by id, text hash and length, in one shuffle of docs; of rows equal in all
    three one stays.
    """
    key, nth = fresh(docs, "key", "nth")
    kept = exact_dedup(docs).filter("kept").select(row_key(F.col("doc_id"), F.col("text_sha256"), F.col("n_points")).alias(key))
    text = F.coalesce(docs["text"], F.lit(""))
    sha = F.sha2(F.regexp_replace(text, rf"[{SPACE}]+", "").cast("binary"), 256)
    rows = docs.withColumn(key, row_key(docs["doc_id"], sha, F.char_length(text).cast("long")))
    return numbered(rows, key, nth).filter(F.col(nth) == 1).join(kept, key, "left_semi").select(*docs.columns)
