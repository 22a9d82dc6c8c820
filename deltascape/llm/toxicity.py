"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary text, are estimated from all labelled training rows, copies aside.
A count is the number of distinct texts with a word, or with a word behind its history, so what one text repeats counts
once. In a class, the chance of a word behind a history is the discounted count of the pair over that of the history;
the discounted mass goes to the word's own discounted count in the class; and what is discounted there goes to
continuation counts that both classes share: the share of all distinct pairs that end in the word. So rare expressions
are smoothed alike in both classes. A word, or pair, whose counts do not differ between the classes beyond chance takes
the estimate of the level behind from both.

A text's score compares its two log-likelihoods, normalised by its length: the mean log ratio of its words, each behind
the word before it. A logistic curve over that mean, fitted on rows that the scoring models have not seen, gives 0 to 1.

All words and pairs are weighed, however rare in a large corpus, by Spark; those that tell make the model. It ships to
the workers in shards by word, of a bounded number of items, and texts pass once for each shard; mostly there is one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, is_training, materialise, release, select_present, stream_groups
from .near_dedup import ANCHORS, PART_DOCS, PART_SHINGLES, linked, shingle_set

#: The telling words and pairs that a shard of the model holds, about.
MODEL_ITEMS = 1 << 18
#: The least G-squared statistic of a difference between classes that counts as more than chance (p below 0.0002).
BEYOND_CHANCE = 14.0
THRESHOLD = 0.7
#: The mean log ratio from which the curve's scale is logarithmic rather than straight.
NEAR_ZERO = 0.01
WORD = re.compile(r"[^\W\d_]+")
#: Words of a shingle, and the similarity in percent of their full sets, by which near copies are known.
SHINGLE, NEAR = 3, 85
#: Folds of the training rows that each model learns from: one for each fold left out, and the final one.
FOLDS = {"a": (0,), "b": (1,), "ab": (0, 1)}
#: Counted items that a worker holds before it passes them on.
HELD_ITEMS = 300_000
#: Characters of text for each block of items in the shuffle; a word and its pair take four at least, so a block has half
#: as many items at most, whatever the size of the corpus.
BLOCK_CHARS = 1 << 19
COUNTS = [f"n{c}{f}" for c in (0, 1) for f in (0, 1)]
#: Buckets by hash in which the words and histories that matter are marked.
BUCKETS = 1 << 17
#: Bits of the map of labelled ids.
MARKS = 1 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def pairs_of(words: list[str]) -> list[str]:
    """Each word behind the one before it; the first one's history is empty."""
    return [f"{v} {w}" for v, w in zip(["", *words], words)]  # noqa: B905


def count_items(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts that hold each word and each pair, by class and fold; the empty item counts the texts themselves."""

    def passed(found: dict[str, Counter]) -> pd.DataFrame:
        items = sorted(set().union(*found.values()))
        return pd.DataFrame({"item": items} | {k: [v.get(w, 0) for w in items] for k, v in found.items()})

    found: dict[str, Counter] = {n: Counter() for n in COUNTS}
    for frame in frames:
        for text, label, fold in zip(frame["text"], frame["label"], frame["fold"], strict=True):
            words = words_of(text)
            own = found[f"n{label}{fold}"]
            own.update(set(words))
            own.update(set(pairs_of(words)))
            own[""] += 1
            if sum(map(len, found.values())) > HELD_ITEMS:
                yield passed(found)
                found = {n: Counter() for n in COUNTS}
    if any(found.values()):
        yield passed(found)


def packed_counts(blocks: int):
    """Counts of items as rows block, n and packed: the items of a block by hash, sorted, with their counts, compressed.

    Sorted neighbours share most of their letters, so that a block takes a fraction of what its items take as rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for frame in count_items(frames):
            names = [w.encode() for w in frame["item"]]
            block = np.fromiter((xxhash.xxh3_64_intdigest(w) % blocks for w in names), np.int64, len(names))
            counts = frame[COUNTS].to_numpy(np.uint32)
            order = np.argsort(block, kind="stable")
            out = []
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                body = counts[part].T.tobytes() + b"\n".join([names[i] for i in part])
                out.append((int(block[part[0]]), len(part), press.compress(body)))
            yield pd.DataFrame(out, columns=["block", "n", "packed"])

    return run


def summed_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The counts by item of a partition of packed rows sorted by block; memory holds one block's."""
    press = zstandard.ZstdDecompressor()
    for _, frame in stream_groups(frames, ["block"]):
        names: list[str] = []
        counts = []
        for n, packed in zip(frame["n"], frame["packed"], strict=True):
            body = press.decompress(bytes(packed))
            counts.append(np.frombuffer(body, np.uint32, n * len(COUNTS)).reshape(len(COUNTS), n))
            names += body[n * len(COUNTS) * 4 :].decode().split("\n")
        at, items = pd.factorize(np.array(names, object), sort=True)
        each = np.concatenate(counts, axis=1)
        sums = {k: np.bincount(at, c, len(items)).astype(np.int64) for k, c in zip(COUNTS, each, strict=True)}
        yield pd.DataFrame({"item": items} | sums)


def counted(rows: DataFrame) -> DataFrame:
    """item and its counts, over all rows (text, label and fold); one row an item."""
    blocks = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS
    packed = rows.mapInPandas(packed_counts(blocks), "block long, n long, packed binary")
    dealt = packed.repartition("block").sortWithinPartitions("block")
    return dealt.mapInPandas(summed_counts, "item string, " + ", ".join(f"{n} long" for n in COUNTS))


def least_shingles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows with the least hash of each text's shingles, on which near copies mostly agree; of equal texts of a
    batch and label that of the least id."""
    for frame in frames:
        frame = frame.assign(text=frame["text"].fillna("")).sort_values("doc_id").drop_duplicates(["text", "label"])
        sets = [shingle_set(t, SHINGLE) for t in frame["text"]]
        yield frame[["doc_id", "text", "label"]].assign(h=np.array([s[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64))


def drop_copies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a partition sorted by h, label and part, without those whose full shingle set equals one before in the
    part, or is NEAR to one of its first few. All others stay."""
    key, first, anchors, seen = None, "", [], set()

    def new(text: str) -> bool:
        own = shingle_set(text, SHINGLE)
        digest = xxhash.xxh3_128_digest(own.tobytes())
        if digest in seen:
            return False
        seen.add(digest)
        if not len(own):
            return True
        if any(linked(own, [a], NEAR)[0] for a in anchors if 100 * min(len(a), len(own)) >= NEAR * max(len(a), len(own))):
            return False
        if not anchors or len(anchors) < ANCHORS and sum(map(len, anchors)) + len(own) <= PART_SHINGLES:
            anchors.append(own)
        return True

    for frame in frames:
        keep = np.zeros(len(frame), bool)
        for i, (*now, text) in enumerate(zip(frame["h"], frame["label"], frame["part"], frame["text"], strict=True)):
            if now != key:
                key, first, anchors, seen = now, text, [], set()
                keep[i] = True
                continue
            if not seen:  # most have no other beside them, and need no set
                new(first)
            keep[i] = new(text)
        yield frame.loc[keep, ["doc_id", "text", "label"]]


class BackoffModel:
    """Log ratios of the words, and of the pairs, that tell the classes apart; a pair backs off to its word, else to 0."""

    def __init__(self, words: dict[str, float], pairs: dict[str, float]):
        self.words, self.pairs = words, pairs
        self.ends = {p.rpartition(" ")[2] for p in pairs}
        self.known = self.ends | words.keys()

    def evidence(self, texts: pd.Series) -> pd.DataFrame:
        """Per text the log-likelihood ratio, toxic over ordinary, and the number of words."""
        out = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            words = words_of(text)
            total = 0.0
            if not self.known.isdisjoint(words):
                for at, w in enumerate(words):
                    if w in self.known:
                        r = self.pairs.get(f"{words[at - 1] if at else ''} {w}") if w in self.ends else None
                        total += self.words.get(w, 0.0) if r is None else r
            out[i] = total, len(words)
        return pd.DataFrame(out, columns=["total", "words"])


class ShardedModel:
    """The telling items of each model: a table (item and a ratio, or null, for each), and how many shards it takes.

    A word and the pairs that end in it are in one shard, so that a text's evidence is the sum of what the shards give.
    """

    def __init__(self, items: DataFrame):
        self.items = items
        self.shards = max(1, -(-items.count() // MODEL_ITEMS))

    def shard(self, m: str, n: int) -> BackoffModel:
        end = F.substring_index("item", " ", -1)
        own = self.items.filter(F.col(m).isNotNull() & (F.pmod(F.xxhash64(end), F.lit(self.shards)) == n)).select("item", m).toPandas()
        paired = own["item"].str.contains(" ").astype(bool)
        return BackoffModel(*[dict(zip(part["item"], part[m].tolist(), strict=True)) for part in (own[~paired], own[paired])])

    def weigh(self, df: DataFrame, m: str, name: str) -> DataFrame:
        """df, which has a text, with the mean log ratio of its words in column name; 0 without words."""
        ratio, part = fresh(df, name, "part")
        held = None
        for n in range(self.shards):
            own = evidence_udf(df.sparkSession, self.shard(m, n))("text")
            if n == 0:
                df = df.withColumn(ratio, own)
                continue
            # a worker holds one shard at a time
            last, held = held, materialise(df, "evidence")
            if last is not None:
                discard(last)
            df = held.withColumn(part, own)
            df = df.withColumn(ratio, F.struct((F.col(f"{ratio}.total") + F.col(f"{part}.total")).alias("total"), F.col(f"{ratio}.words").alias("words"))).drop(part)
        return df.withColumn(ratio, F.col(f"{ratio}.total") / F.greatest(F.col(f"{ratio}.words"), F.lit(1.0)))


def discount(n1: float, n2: float) -> float:
    """The usual estimate n1 / (n1 + 2 n2)."""
    return float(n1 / (n1 + 2 * n2)) if n1 and n2 else 0.75


def beyond_chance(m: str, texts: dict[int, float]) -> Column:
    """Whether an item's counts m0 and m1 differ between the classes' texts by the likelihood-ratio statistic."""
    if not texts[0] or not texts[1]:
        return F.lit(False)
    both, whole = F.greatest(F.col(f"{m}0") + F.col(f"{m}1"), F.lit(1)), texts[0] + texts[1]

    def part(c: int) -> Column:
        n = F.col(f"{m}{c}").cast("double")
        return F.when(n > 0, n * F.log(n / (both * F.lit(texts[c] / whole)))).otherwise(0.0)

    return F.lit(2.0) * (part(0) + part(1)) > BEYOND_CHANCE


def in_buckets(rows: DataFrame, key: str, of: DataFrame, name: str) -> DataFrame:
    """rows whose key falls in a bucket that one of the names falls in: all that match, and few others, without a
    shuffle of rows; the buckets that are sent out are BUCKETS at most."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    return rows.join(F.broadcast(of.select(at(name).alias("bucket_")).distinct()), at(key) == F.col("bucket_"), "left_semi")


def build_models(counts: DataFrame) -> ShardedModel:
    """The models from the counts by item (columns n<class><fold>), as columns of Spark: every telling word and pair."""
    add = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    named = [add([f"n{c}{f}" for f in folds]).alias(f"{m}{c}") for m, folds in FOLDS.items() for c in (0, 1)]
    items = counts.select("item", *named)
    whole = items.filter("item = ''").first()
    texts = {m: {c: float(whole[f"{m}{c}"]) if whole else 0.0 for c in (0, 1)} for m in FOLDS}
    words = items.filter("item <> ''").filter(~F.contains("item", F.lit(" ")))
    pairs = items.filter(F.contains("item", F.lit(" "))).withColumn("history", F.substring_index("item", " ", 1)).withColumn("word", F.substring_index("item", " ", -1))
    known = {m: F.col(f"{m}0") + F.col(f"{m}1") > 0 for m in FOLDS}
    each = [(m, c) for m in FOLDS for c in (0, 1)]
    sums: list[Column] = [F.count_if(known[m]).alias(f"types_{m}") for m in FOLDS]
    for m, c in each:
        n = F.col(f"{m}{c}")
        sums += [F.sum(n).alias(f"N_{m}{c}"), F.count_if(n == 1).alias(f"one_{m}{c}"), F.count_if(n == 2).alias(f"two_{m}{c}"), F.count_if(n > 0).alias(f"types_{m}{c}")]
    of_words, of_pairs = (x.agg(*sums).first().asDict() for x in (words, pairs))
    cut = {(kind, m, c): discount(of[f"one_{m}{c}"], of[f"two_{m}{c}"]) for kind, of in (("word", of_words), ("pair", of_pairs)) for m, c in each}

    # what tells, by column arithmetic alone; all that follows concerns these words, and the ends and histories of these pairs
    def telling(rows: DataFrame) -> DataFrame:
        for m in FOLDS:
            rows = rows.withColumn(f"tells_{m}", beyond_chance(m, texts[m]))
        return rows

    some = " OR ".join(f"tells_{m}" for m in FOLDS)
    told = materialise(telling(pairs).filter(some), "pairs")
    steps = [told]
    wanted = materialise(telling(words).filter(some).select("item").union(told.select("word")).distinct(), "wanted")
    steps.append(wanted)

    # words: the shared continuation share behind the class's discounted count
    ends = in_buckets(pairs, "word", wanted, "item").groupBy(F.col("word").alias("item")).agg(*[F.count_if(known[m]).alias(f"ends_{m}") for m in FOLDS])
    chances = telling(in_buckets(words, "item", wanted, "item")).join(ends, "item").join(wanted, "item", "left_semi")
    for m in FOLDS:
        shared = F.greatest(F.col(f"ends_{m}"), F.lit(1)) / F.lit(float(max(of_pairs[f"types_{m}"], 1)))
        for c in (0, 1):
            total, d = float(of_words[f"N_{m}{c}"] or 0), cut["word", m, c]
            p = F.greatest(F.col(f"{m}{c}") - F.lit(d), F.lit(0.0)) / total + shared * (d * of_words[f"types_{m}{c}"] / total) if total else shared
            chances = chances.withColumn(f"p_{m}{c}", F.when(F.col(f"tells_{m}"), p).otherwise(shared))
    chances = materialise(chances.select("item", *[f"tells_{m}" for m in FOLDS], *[f"p_{m}{c}" for m, c in each]), "chances")
    steps.append(chances)
    own_words = chances.select("item", *[F.when(F.col(f"tells_{m}"), F.log(F.col(f"p_{m}1") / F.col(f"p_{m}0"))).alias(m) for m in FOLDS])

    # pairs: the class's discounted share behind their history, and the word's chance behind that
    histories = in_buckets(pairs, "history", told, "history").groupBy("history")
    histories = histories.agg(*[f(F.col(f"{m}{c}")).alias(f"{k}_{m}{c}") for m, c in each for k, f in (("sum", F.sum), ("kinds", lambda n: F.count_if(n > 0)))])
    # both joins have a row per key on one side, and the few pairs that tell on the other
    told = told.join(histories, "history").join(chances.select(F.col("item").alias("word"), *[f"p_{m}{c}" for m, c in each]), "word")

    def behind(m: str, c: int) -> Column:
        of, d = F.col(f"sum_{m}{c}"), F.lit(cut["pair", m, c])
        own = (F.greatest(F.col(f"{m}{c}") - d, F.lit(0.0)) + d * F.col(f"kinds_{m}{c}") * F.col(f"p_{m}{c}")) / of
        return F.when(of > 0, own).otherwise(F.col(f"p_{m}{c}"))

    own_pairs = told.select("item", *[F.when(F.col(f"tells_{m}"), F.log(behind(m, 1) / behind(m, 0))).alias(m) for m in FOLDS])
    items = materialise(own_words.unionByName(own_pairs).filter(F.coalesce(*FOLDS).isNotNull()), "telling")
    for done in steps:
        discard(done)
    return ShardedModel(items)


def scaled(ratio: Column) -> Column:
    """The mean log ratio on the curve's scale: straight near 0, logarithmic beyond; its order is the ratio's."""
    return F.asinh(ratio / NEAR_ZERO)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve through weighted points, by Newton steps with a slight pull of the slope to 0."""
    ones = float((weight * y).sum())
    if not len(y) or not 0 < ones < weight.sum():
        return 0.0, 0.0 if not len(y) else float(6 * y[0] - 3)
    a, out = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    pull = np.array([0.01, 1e-9])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ out, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (weight * (p - y)) + pull * out)
        out -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(out[0]), float(out[1])


def maybe_among(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """rows whose key may be one of those of the other table: all that are, and of others one in some, by a bitmap of
    MARKS bits that is sent out whole, whatever the size of either."""
    at = F.pmod(F.xxhash64(key), F.lit(MARKS))
    words = of.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).collect()
    bits = [0] * (MARKS // 64)
    for r in words:
        bits[r["word"]] = r["bits"]
    one = rows.sparkSession.createDataFrame([(bits,)], "marks_ array<bigint>")  # a single row
    word = F.element_at("marks_", F.shiftright(at, 6).cast("int") + 1)
    return rows.join(F.broadcast(one), word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))) != 0, "left_semi")


def evidence_udf(spark: SparkSession, model: BackoffModel):
    shipped = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shipped.value.evidence(texts)

    return F.pandas_udf(weigh, "total double, words double")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[ShardedModel, tuple[float, float]]:
    """The model, and slope and offset of the curve, from all labelled training rows.

    Both folds of the training rows score one another for the curve, whose points come as a histogram.
    """
    own = select_present(labels, "doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & is_training(F.col("doc_id")))
    own = own.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    texts = select_present(docs, "doc_id", "text").filter(is_training(F.col("doc_id")))
    # of copies and near copies with one label one counts, or few; what only shares the least hash counts in full
    key = docs.schema["doc_id"].dataType.simpleString()
    texts = maybe_among(texts, own, "doc_id")  # so that the join moves few texts without a label
    hashed = materialise(texts.join(own.hint("merge"), "doc_id").mapInPandas(least_shingles, f"doc_id {key}, text string, label int, h long"), "hashed")
    release(docs.sparkSession)
    # hashes of many rows, a thousand at most, are dealt into parts, equal texts into one
    most = max(PART_DOCS, hashed.count() // 1000)
    hot = hashed.groupBy("h", "label").agg(F.ceil(F.count("*") / most).alias("parts")).filter("parts > 1")
    dealt = hashed.join(F.broadcast(hot), ["h", "label"], "left").withColumn("t", F.xxhash64("text")).withColumn("part", F.pmod("t", F.coalesce("parts", F.lit(1))))
    met = dealt.repartition("h", "label", "part").sortWithinPartitions("h", "label", "part", "doc_id", "t").select("doc_id", "text", "label", "h", "part")
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).cast("int")
    rows = materialise(met.mapInPandas(drop_copies, f"doc_id {key}, text string, label int").select("text", "label", fold.alias("fold")), "labelled")
    discard(hashed)
    release(docs.sparkSession)
    counts = materialise(counted(rows), "items", compression="zstd")
    release(docs.sparkSession)
    model = build_models(counts)
    points = []
    for f, unseen in ((0, "b"), (1, "a")):
        seen = model.weigh(rows.filter(F.col("fold") == f).select("label", "text"), unseen, "ratio")
        points.append(seen.groupBy("label", F.round(scaled(F.col("ratio")), 3).alias("x")).count().toPandas())
    points = pd.concat(points).sort_values(["x", "label"])
    curve = logistic(points["x"].to_numpy(float), points["label"].to_numpy(float), points["count"].to_numpy(float))
    discard(rows)
    discard(counts)
    return model, curve


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, names: tuple[str, str] = ("_score", "_predicted")) -> DataFrame:
    """docs' columns and, of every row, the score (0 to 1) and the prediction, in columns of the given names; where docs
    has such columns, underscores are added (see fresh).

    Only text is an input of a score. Empty and null texts, and texts without letters, have a ratio of 0. Without
    training rows of both classes all texts get the same score. Rows that repeat an id each have a score;
    of training texts of one label whose shingle sets are equal or nearly so one is learnt from, or few, and all others
    are; an id that the label table repeats has its largest label. An empty table gives no rows.
    """
    model, (slope, offset) = train(docs, labels, label)
    score, predicted, ratio = fresh(docs, *names, "ratio")
    out = model.weigh(docs, "ab", ratio)
    discard(model.items)
    logit = F.lit(slope) * scaled(F.col(ratio)) + F.lit(offset)
    out = out.withColumn(score, 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), logit)))))
    return out.drop(ratio).withColumn(predicted, (F.col(score) >= threshold).cast("int"))
