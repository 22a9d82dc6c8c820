"""Mixing sources to target weights, by Efraimidis-Spirakis sampling. DataFrame operations only.

A source's target is its share of the mix by weight, filled like water: no source is read more than `max_epochs`
times, and what a full source leaves over goes to the others by weight. Complete epochs of a source come first. The
rest is a weighted sample without replacement: every document gets an exponential key, scaled by its quality weight,
and documents are taken by rising key until the token budget is spent; the last one is cut at the budget. The running
sums behind that are two-level, over slices of the key range that are bounded whatever the weights, so that no task
holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, materialise, numbered, row_key, select_present

#: Documents in a slice of a source's key range that are expected at most.
SLICE_ROWS = 8192
#: The largest share of exponentials, of any scales, in one doubling of their value: the maximum of ln 2 x exp(-x).
DOUBLING = 0.255
#: Weights of the sources by their place in code point order, repeating.
PLACE_WEIGHTS = (5.0, 2.0, 1.0)
MIX_SHARE, MAX_EPOCHS = 1.5, 2
WORD = rf"[^{SPACE}]+"
#: A word of letters, perhaps with a mark behind it.
PLAIN_WORD = rf"(?<![^{SPACE}])\p{{L}}[\p{{L}}'’-]*+[.,;:!?]?(?![^{SPACE}])"


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """From 0.1 to 1: mostly the share of plain words among a text's words."""
    return F.lit(0.1) + F.lit(0.9) * F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD)), F.lit(0)) / F.greatest(size, F.lit(1))


def uniform(doc_id: Column) -> Column:
    """A fixed number in (0, 1) for an id, the same on every run; null ids share one."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = PLACE_WEIGHTS, share: float = MIX_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (one row each: source, source_size) with column target.

    The water level is closed-form: sources in the order in which they fill up, the level that would serve those
    after each, and the first (so the highest) level that leaves the next one unfilled. One row per source meets in one task.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy("fill_level", F.col("source").cast("binary").asc_nulls_last())
    every = Window.partitionBy()
    rows = (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(max_epochs))
        .withColumn("fill_level", F.col("cap") / F.col("weight"))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    )
    level = (F.col("budget") - F.col("full_before")) / F.col("weight_left")
    rows = rows.withColumn("level", F.when(level <= F.col("fill_level"), level)).withColumn("level", F.max("level").over(every))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def slice_of(key: Column, n_docs: Column, slice_rows: int) -> Column:
    """The slice of a key: so many equal steps to each doubling that, whatever weights scale the keys of a source's
    n_docs documents, no step is expected to hold more than slice_rows."""
    steps = F.greatest(F.lit(1), F.ceil(n_docs * F.lit(DOUBLING) / slice_rows))
    return F.floor(F.log2(key) * steps)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = PLACE_WEIGHTS, share: float = MIX_SHARE, max_epochs: int = MAX_EPOCHS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text and source are read): doc_id, source, size, source_size, target, taken.

    taken counts words with repeats: complete epochs of the source, then the sample's share; a source's sum is its
    target rounded down. Null texts have size 0 and are taken 0 times; a null source is a source, the last. Rows that
    repeat an id share a key and rank by size; those of one id, text length and quality are in one slice, however many. Ids rank by the hash of their text form; ties of hashes by id. Extra
    columns play no part; an empty table gives no rows.
    """
    text = F.col("text")
    rows = select_present(docs, "doc_id", "text", "source").withColumn("size", word_count(text))
    weight = quality_weight(text, F.col("size"))
    rows = materialise(rows.select("doc_id", "source", "size", (-F.ln(uniform(F.col("doc_id"))) / weight).alias("key")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = materialise(source_targets(sizes.select("source", "source_size"), weights, share, max_epochs), "targets")
    plan = sizes.select("source", "n_docs").join(targets, sizes["source"].eqNullSafe(targets["source"])).select(
        targets["source"], "source_size", "target", "n_docs",
        F.least(F.lit(max_epochs), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).cast("long").alias("epochs"),
    )
    plan = materialise(plan.withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size")), "plan").withColumnRenamed("source", "_source")
    placed = rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).withColumn("slice", slice_of(F.col("key"), F.col("n_docs"), slice_rows))
    known = F.coalesce(F.col("source").isNull(), F.lit(False)).alias("none"), F.coalesce("source", F.lit("")).alias("name")
    placed = placed.withColumn("name", known[1]).withColumn("none", known[0])
    before = Window.partitionBy("none", "name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("none", "name", "slice").agg(F.sum("size").alias("s")).select("none", "name", "slice", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("none", "name", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["none", "name", "slice"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("own")))
    return summed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as it is taken whole, and the last one of a
    source's sample up to the budget's last word. Documents that are not taken go. Column n_chars, where there is one,
    follows a cut text.
    """
    key, nth, size, words, taken = fresh(docs, "key", "nth", "size", "words", "taken")
    counts = mix_sources(docs, **options).filter("taken > 0").select(row_key(F.col("doc_id"), F.col("source"), F.col("size")).alias(key), F.col("taken").alias(taken))
    rows = docs.withColumn(size, word_count(docs["text"]))
    rows = rows.withColumn(key, row_key(docs["doc_id"], docs["source"], F.col(size)))
    both = numbered(rows, key, nth).join(numbered(counts, key, nth), [key, nth])
    whole, rest = F.floor(F.col(taken) / F.col(size)).cast("int"), F.col(taken) % F.col(size)
    lengths = F.concat(F.array_repeat(F.col(size), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    each = both.withColumn(words, F.explode(lengths))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[{SPACE}]*{WORD}"), F.lit(0)), F.lit(1), F.col(words).cast("int")), "")
    part = F.col(words) < F.col(size)
    out = each.withColumn("text", F.when(part, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(part, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
