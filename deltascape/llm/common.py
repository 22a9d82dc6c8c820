"""What the operators of this package share: tables, checkpoints, hashing, skew-proof joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltascape.plans.storage import discard, join_groups, materialise, release, shared_dir

__all__ = ["discard", "join_groups", "materialise", "release", "shared_dir"]

#: The characters that the contracts count as white space, as a Java regex class.
SPACE = r"\x20\x09-\x0D"

#: Bytes of a batch that a Python worker gets at once; a longer text is a batch of its own.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark alone (any store). Texts may be long, so batches are bounded by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select_present(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with any name cannot clash with those an operator makes."""
    return df.select(*[df[f"`{n}`"] for n in names])


def is_training(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def held_out(doc_id: Column) -> Column:
    """The complement of is_training; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def row_key(*parts: Column) -> Column:
    """One string for some columns' values, null told from text, by which rows are found again."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to be none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, key: str, nth: str) -> DataFrame:
    """df with a column nth that tells apart rows of one key. They are alike, so any order will do."""
    return df.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))


def stream_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of a partition sorted by keys, across batch borders; memory holds a group and a batch."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        changed = np.zeros(len(frame), bool)
        for k in keys:
            v = frame[k].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
        if held:
            last, first = held[-1].iloc[-1], frame.iloc[0]
            changed[0] = any(last[k] != first[k] for k in keys)
        else:
            changed[0] = True
        cuts = np.flatnonzero(changed)
        if not len(cuts):
            held.append(frame)
            continue
        if held:
            if cuts[0] > 0:
                held.append(frame.iloc[: cuts[0]])
            whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            yield tuple(whole[k].iloc[0] for k in keys), whole
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = frame.iloc[a:b]
            yield tuple(part[k].iloc[0] for k in keys), part
        held = [frame.iloc[cuts[-1] :]]
    if held:
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        yield tuple(whole[k].iloc[0] for k in keys), whole


def splitmix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit finaliser over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
