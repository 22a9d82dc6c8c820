"""MinHash near-dedup with sequential Bayesian verification.

Texts with one shingle set fold into a representative. Bands of its signature put representatives into buckets; within
a bucket signatures are compared batch by batch, and a pair is given up as soon as the posterior chance that its
similarity reaches the threshold falls under the chosen miss probability. What survives joins representatives into
candidate groups, by spanning trees and never by all pairs. Each group's texts then meet once, and links are confirmed
on full shingle sets.

Large buckets and groups: a bucket of more than PART_DOCS is one candidate group without comparison. A group of more
is dealt into parts that share some anchors. Documents that the parts leave outside the group's main component are
then held against all its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascape.operators.components import connected_components

from .common import discard, fresh, join_groups, materialise, numbered, release, row_key, select_present, splitmix, stream_groups

#: Signature length, rows of a band, hashes compared at a time. A pair at similarity 0.85 misses all bands with
#: probability (1 - 0.85**4)**16, below 1e-5.
HASHES, BAND_ROWS, BATCH = 64, 4, 16
#: A pair is given up when its chance to reach the threshold is below this.
MISS = 1e-7
#: Documents, and shingles, that meet in one group at most (a single document may have more); anchors of a dealt group.
PART_DOCS, PART_SHINGLES, ANCHORS = 2000, 2_000_000, 32
#: Where documents are dropped, edge tables of at most this many rows are solved in one task: the rounds of larger ones
#: are some twenty plans, which take memory of the driver however small the table.
ONE_TASK_EDGES = 500_000
_U64 = np.uint64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    seeds = splitmix(np.arange(1, 257 + 2 * HASHES, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(1 << 16, _U64(0xD6E8FEB86659FD93)), dtype=_U64)
    xor = seeds[256 : 256 + HASHES].astype(np.uint32)[:, None]
    odd = seeds[256 + HASHES : 256 + 2 * HASHES].astype(np.uint32)[:, None] | np.uint32(1)
    return seeds[:256], powers, xor, odd


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased, split at ASCII white space."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    byte, powers, *_ = _tables()
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, _U64)
    lengths = ends - starts
    if lengths.max() > len(powers):
        return np.array([xxhash.xxh3_64_intdigest(w) if len(w) > len(powers) else _short(w) for w in data.split()], _U64)
    at = np.flatnonzero(~space)
    place = at - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        terms = byte[raw[at]] * powers[place]
        return splitmix(np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lengths)[:-1]))))


def _short(word: bytes) -> int:
    byte, powers, *_ = _tables()
    with np.errstate(over="ignore"):
        return int(splitmix(np.array([(byte[np.frombuffer(word, np.uint8)] * powers[: len(word)]).sum()], _U64))[0])


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than size are one shingle, none are none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(size, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, _U64(n))
        for j in range(n):
            h = (h * _U64(0x9E3779B97F4A7C15)) ^ w[j : j + len(h)]
            h = h * _U64(0xBF58476D1CE4E5B9) + _U64(j)
        return np.unique(splitmix(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of HASHES mixings of the shingles."""
    *_, xor, odd = _tables()
    x = (shingles >> _U64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 4096):
        y = (x[a : a + 4096] ^ xor) * odd
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(out, y.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(-1, BAND_ROWS).astype(_U64)
    with np.errstate(over="ignore"):
        h = np.arange(1, len(parts) + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)
        for j in range(BAND_ROWS):
            h = splitmix(h ^ (parts[:, j] + _U64(j)))
    return h.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(percent: int) -> tuple[int, ...]:
    """After each batch, the fewest equal hashes with which a pair stays.

    With a uniform prior, the chance that similarity s is at least t after m of n equal hashes is the chance of at most
    m successes among n + 1 draws of chance t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total > MISS:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survivors(sig: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Indices of others that sequential verification keeps as candidates for sig."""
    alive, matches = np.arange(len(others)), np.zeros(len(others), np.int32)
    for k, least in enumerate(least_matches(percent)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (others[alive, part] == sig[part]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def fingerprints(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        n, keys, sigs, bands = [], [], [], []
        for text in frame["text"]:
            s = shingle_set(text, size)
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            sig = signature(s)
            sigs.append(sig.tobytes())
            bands.append(band_keys(sig))
        yield pd.DataFrame({"row_uid": frame["row_uid"], "doc_id": frame["doc_id"], "text": frame["text"], "n_shingles": n, "set_key": keys, "sig": sigs, "bands": bands})


def bucket_trees(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Per bucket of a partition sorted by band: edges that join what survivors join."""
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for frame in _with_end(frames):
        if frame is not None:
            now = (frame["band"].to_numpy(np.int64), frame["node"].to_numpy(np.int64), np.frombuffer(b"".join(frame["sig"]), np.uint32).reshape(-1, HASHES))
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
        if held is None or not len(held[0]):
            continue
        band, node, sig = held
        cuts = np.concatenate(([0], np.flatnonzero(band[1:] != band[:-1]) + 1, [len(band)]))
        if frame is not None:  # the last bucket may go on
            held = tuple(x[cuts[-2] :].copy() for x in held)
            cuts = cuts[:-1]
        sizes, out = np.diff(cuts), []
        two = cuts[:-1][sizes == 2]
        if len(two):
            alive, matches = two, np.zeros(len(two), np.int32)
            for k, least in enumerate(least_matches(percent)):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (sig[alive, part] == sig[alive + 1, part]).sum(axis=1)
                alive, matches = alive[matches >= least], matches[matches >= least]
            out.append(np.stack([node[alive], node[alive + 1]], axis=1))
        for a, b in zip(cuts[:-1][sizes > 2], cuts[1:][sizes > 2], strict=True):
            left = np.arange(a, b)
            while len(left) > 1:
                root, stack, left = left[0], [left[0]], left[1:]
                while stack and len(left):
                    found = survivors(sig[stack.pop()], sig[left], percent)
                    if len(found):
                        out.append(np.stack([np.full(len(found), node[root]), node[left[found]]], axis=1))
                        stack += left[found].tolist()
                        left = np.delete(left, found)
        if out:
            pairs = np.concatenate(out)
            yield pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def _with_end(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from frames
    yield None


def linked(own: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether own and each of sets reach the similarity, on full sets."""
    lengths = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    common = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return 100 * common >= percent * (len(own) + lengths - common)


class Group:
    """Documents that meet: their sets and signatures."""

    def __init__(self, frame: pd.DataFrame, size: int):
        self.node = frame["node"].to_numpy(np.int64)
        self.sets = [shingle_set(t, size) for t in frame["text"]]
        self.n = np.array([len(s) for s in self.sets])
        self.sig = np.frombuffer(b"".join(frame["sig"]), np.uint32).reshape(-1, HASHES)

    def links(self, one: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of others that link with document one: by size, by signature, then by full sets."""
        n = self.n[others]
        others = others[100 * np.minimum(n, self.n[one]) >= percent * np.maximum(n, self.n[one])]
        if len(others):
            others = others[survivors(self.sig[one], self.sig[others], percent)]
        if len(others):
            others = others[linked(self.sets[one], [self.sets[i] for i in others], percent)]
        return others


def group_trees(frames: Iterator[pd.DataFrame], size: int, percent: int) -> Iterator[pd.DataFrame]:
    """Per group and part: edges that join the documents that confirmed links join."""
    for _, frame in stream_groups(frames, ["root", "part"]):
        g, out = Group(frame, size), []
        left = np.arange(len(g.node))
        while len(left) > 1:
            stack, root, left = [left[0]], left[0], left[1:]
            while stack and len(left):
                found = g.links(stack.pop(), left, percent)
                if len(found):
                    out += [(g.node[root], g.node[i]) for i in found]
                    stack += found.tolist()
                    left = left[~np.isin(left, found)]
        yield pd.DataFrame(out, columns=["u", "v"])


def straggler_links(frames: Iterator[pd.DataFrame], size: int, percent: int) -> Iterator[pd.DataFrame]:
    """Per cell: links of its stragglers with members of other components, one for each pair of components."""
    for _, frame in stream_groups(frames, ["root", "part", "chunk"]):
        g, out, done = Group(frame, size), [], set()
        label, asks = frame["label"].to_numpy(np.int64), frame["asks"].to_numpy(bool)
        for one in np.flatnonzero(asks):
            for i in g.links(one, np.flatnonzero(label != label[one]), percent):
                pair = (min(label[one], label[i]), max(label[one], label[i]))
                if pair not in done:
                    done.add(pair)
                    out.append((g.node[one], g.node[i]))
        yield pd.DataFrame(out, columns=["u", "v"])


EDGES = "u long, v long"


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id and text are read): doc_id, n_shingles, component_id, kept, text_hash.

    Documents link when 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id reachable. Null and empty texts, and texts of white space, have no shingles and link with nothing. Rows that
    repeat an id count by their texts, and each is kept if its id is the component's; null ids are never the smallest
    where there is another. Extra columns play no part; an empty table gives no rows.
    """
    return _in_components(docs, shingle_words, percent).drop("component")


def _in_components(docs: DataFrame, shingle_words: int, percent: int, one_task_edges: int = 0) -> DataFrame:
    """The rows of near_duplicates with component, a number of each component, also of those with a null or repeated id.
    one_task_edges as in connected_components."""
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = select_present(docs, "doc_id", "text").withColumn("row_uid", F.monotonically_increasing_id())
    prints = materialise(
        rows.mapInPandas(
            lambda frames: fingerprints(frames, shingle_words), f"row_uid long, doc_id {key}, text string, n_shingles long, set_key binary, sig binary, bands array<bigint>"
        ),
        "prints",
    )
    full = prints.filter("n_shingles > 0")
    own = F.struct("row_uid", "n_shingles", "sig", "bands")
    reps = full.groupBy("set_key").agg(F.min(own).alias("r"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    reps = materialise(reps.select("set_key", "doc_id", "copies", F.col("r.row_uid").alias("node"), "r.n_shingles", "r.sig", "r.bands"), "reps")

    # buckets with more than one representative
    placed = reps.select("node", F.explode("bands").alias("band"))
    buckets = materialise(placed.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("first")).filter("members > 1"), "buckets")
    total = reps.count() * (HASHES // BAND_ROWS)
    members = materialise(join_groups(placed, buckets, "band", "members", total), "members")
    large = members.filter(F.col("members") > PART_DOCS).select(F.col("first").alias("u"), F.col("node").alias("v"))
    small = members.filter(F.col("members") <= PART_DOCS).select("band", "node").join(reps.select("node", "sig"), "node")
    trees = small.repartition("band").sortWithinPartitions("band", "node").select("band", "node", "sig").mapInPandas(lambda frames: bucket_trees(frames, percent), EDGES)
    candidates = materialise(connected_components(trees.unionByName(large), one_task_edges), "candidates")

    # each group's texts meet once, in parts where they are many
    sizes = candidates.join(reps.select("node", "n_shingles"), "node").groupBy("root").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    sizes = sizes.withColumn("parts", F.greatest(F.ceil(F.col("docs") / PART_DOCS), F.ceil(F.col("shingles") / PART_SHINGLES)))
    grouped = join_groups(candidates, materialise(sizes, "sizes"), "root", "docs", max(candidates.count(), 1))
    hashed = F.xxhash64("node")
    grouped = grouped.withColumn("own_part", F.pmod(hashed, F.col("parts"))).withColumn("anchor", (F.col("parts") > 1) & (F.pmod(F.shiftright(hashed, 17), F.ceil(F.col("docs") / ANCHORS)) == 0))
    texts = grouped.join(full.select(F.col("row_uid").alias("node"), "text", "sig"), "node")
    dealt = texts.withColumn("part", F.explode(F.when(F.col("anchor"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("own_part"))))
    met = dealt.repartition("root", "part").sortWithinPartitions("root", "part", "node").select("root", "part", "node", "text", "sig")
    links = materialise(met.mapInPandas(lambda frames: group_trees(frames, shingle_words, percent), EDGES), "links")
    big = materialise(grouped.filter("parts > 1"), "big")
    if not big.isEmpty():
        links = links.unionByName(_straggling(big, links, full, shingle_words, percent, one_task_edges))
    components = materialise(connected_components(links, one_task_edges), "components")

    # back to the rows
    known = reps.select("set_key", "doc_id", "copies", "node").join(components, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = components.join(reps.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("sets"))
    alone = known.join(components.select("node"), "node", "left_anti").select("set_key", "copies", F.col("root").alias("component"), F.col("doc_id").alias("component_id"))
    joint = known.join(components.select("node"), "node", "left_semi").select("set_key", "copies", "root")
    joint = join_groups(joint, materialise(lowest, "lowest"), "root", "sets", max(components.count(), 1)).select("set_key", "copies", F.col("root").alias("component"), F.col("least_id").alias("component_id"))
    by_set = materialise(alone.unionByName(joint), "by_set")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    out = join_groups(full.select("doc_id", "n_shingles", "set_key", text_hash.alias("text_hash")), by_set, "set_key", "copies", max(prints.count(), 1)).drop("set_key", "copies")
    out = out.unionByName(prints.filter("n_shingles = 0").select("doc_id", "n_shingles", text_hash.alias("text_hash"), F.col("row_uid").alias("component"), F.col("doc_id").alias("component_id")))
    for old in (buckets, members, candidates):
        discard(old)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", "text_hash", "component")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest doc_id; the columns stay as they are.
    Groups whose ids are null, or repeat, have one row each.

    The rows that stay are found again by id and text hash, in one shuffle of docs; of rows equal in both one stays.
    """
    key, nth = fresh(docs, "key", "nth")
    own = _in_components(docs, shingle_words, percent, ONE_TASK_EDGES).filter("kept").groupBy("component").agg(F.min("component_id").alias("component_id"), F.min("text_hash").alias("text_hash"))
    stay = own.select(row_key(F.col("component_id"), F.col("text_hash")).alias(key))
    release(docs.sparkSession)
    rows = docs.withColumn(key, row_key(docs["doc_id"], F.xxhash64(F.coalesce(docs["text"], F.lit("")))))
    return numbered(rows, key, nth).filter(F.col(nth) == 1).join(stay, key, "left_semi").select(*docs.columns)


def _straggling(big: DataFrame, links: DataFrame, full: DataFrame, size: int, percent: int, one_task_edges: int = 0) -> DataFrame:
    """Links of dealt groups that their parts could not see: documents outside a group's main component meet all parts."""
    found = connected_components(links, one_task_edges)
    labelled = materialise(big.join(found.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    counts = labelled.groupBy("root", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = materialise(main.filter("all > most").withColumn("chunks", F.ceil((F.col("all") - F.col("most")) / PART_DOCS)), "main")
    open_docs = join_groups(labelled, main, "root", "all", max(labelled.count(), 1))
    outside = F.col("label") != F.col("main")
    texts = open_docs.join(full.select(F.col("row_uid").alias("node"), "text", "sig"), "node")
    spread = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # a straggler asks in all parts, in its chunk; every document answers in its own part, in all chunks
    asking = texts.filter(outside).withColumn("chunk", F.pmod(F.shiftright(F.xxhash64("node"), 9), F.col("chunks"))).withColumn("part", F.explode(spread(F.col("parts")))).withColumn("asks", F.lit(True))
    answering = texts.withColumn("part", F.col("own_part")).withColumn("chunk", F.explode(spread(F.col("chunks")))).withColumn("asks", F.lit(False))
    names = ["root", "part", "chunk", "node", "label", "asks", "text", "sig"]
    cells = asking.select(names).unionByName(answering.select(names)).repartition("root", "part", "chunk").sortWithinPartitions("root", "part", "chunk", "node")
    return cells.mapInPandas(lambda frames: straggler_links(frames, size, percent), EDGES)
