"""Personal data by patterns and by information-theoretic sanitisation.

Protected entities are what the patterns find and, beside these, secrets: runs that mix letters and digits and whose
information content, by the corpus's own chances of one character behind another, is far beyond its words.

Corpus co-occurrence then tells how strongly each term, a word or two words in a row, reveals that an entity stands
near: a term's disclosure of a kind is its pointwise mutual information with the kind, as a share of the kind's own
information content (1: the term is never seen without it). The threshold of a kind is the least disclosure at which
the terms that would reach it by chance, were the kind's windows drawn at random over the corpus, are a small share of
those that do. Terms over the threshold are generalised to the kind, over a higher one removed. Counts are over the
whole corpus; a term must go with several distinct entities to count.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialise, select_present

KINDS = ("email", "ip", "card", "phone")
SECRET, TERM = "secret", "term"
#: A run that may be a secret, the changes between letters and digits that it has at least, and its bits.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CHANGES, SECRET_BITS = 4, 96.0
MIXED = re.compile(r"[A-Za-z](?=[+/_=-]*[0-9])|[0-9](?=[+/_=-]*[A-Za-z])")
#: Words on each side of an entity that count as near, and the code points in which they are sought.
NEAR_WORDS, NEAR_CHARS = 5, 600
#: Distinct entities of a kind that a term must be near.
SUPPORT = 3
#: The disclosures that may be a kind's threshold, and the share of terms over it that chance may explain. Under the
#: least a term gives little away: of a kind near one word in 2000, it is itself near one in 20 times at most.
THRESHOLDS, BY_CHANCE = tuple(k / 20 for k in range(12, 20)), 0.01
#: Terms of a higher disclosure are removed, not generalised.
REMOVE = 0.9
#: Buckets by hash of the two-word terms whose totals are counted; terms of a pass over the texts.
BUCKETS, PASS_TERMS = 1 << 18, 1 << 18
WORD = re.compile(r"[^\W\d_]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match of these can only start where a run of digits starts; saying so keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a domain with a dot; each @ is tried once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def entities(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) of a text, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m.group())) <= 15]
    return out


def char_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often one byte of ASCII, or another (as 128), stands behind another in a partition's texts."""
    total = np.zeros(129 * 129, np.int64)
    for frame in frames:
        raw = np.frombuffer(" ".join(t or "" for t in frame["text"]).encode("utf-8", "surrogatepass"), np.uint8)
        for a in range(0, len(raw), 1 << 20):
            part = np.minimum(raw[a : a + (1 << 20) + 1], 128).astype(np.int32)
            if len(part) > 1:
                total += np.bincount(part[:-1] * 129 + part[1:], minlength=129 * 129)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"pair": at, "n": total[at]})


def char_bits(texts: DataFrame) -> np.ndarray:
    """Bits of each character behind each, by the corpus; 129 x 129 at any size."""
    found = texts.mapInPandas(char_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(129 * 129)
    counts[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    counts = counts.reshape(129, 129) + 0.5
    return -np.log2(counts / counts.sum(axis=1, keepdims=True))


def secrets(text: str, bits: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of the runs that mix letters and digits and hold SECRET_BITS at least."""
    out = []
    if DIGITS.search(text):
        for m in RUN.finditer(text):
            if len(MIXED.findall(m.group())) >= CHANGES:
                raw = np.frombuffer(b" " + m.group().encode(), np.uint8)
                if bits[raw[:-1], raw[1:]].sum() >= SECRET_BITS:
                    out.append((SECRET, m.start(), m.end()))
    return out


def protected(text: str, bits: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the spans of secrets that touch none of them."""
    base = entities(text)
    own = [s for s in secrets(text, bits) if not any(a < s[2] and s[1] < b for _, a, b in base)]
    return base, own


def without(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with a mark for each character of the spans, so that what is in one entity is no term near another."""
    out, last = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if b > last:
            out += [text[last : max(a, last)], "#" * (b - max(a, last))]
            last = b
    return "".join([*out, text[last:]])


def near_terms(text: str, start: int, end: int) -> list[str]:
    """The words next to a span, lower-cased, and the pairs of words in a row among them; a word that the sought part
    cuts is left out."""
    low, high = max(0, start - NEAR_CHARS), min(len(text), end + NEAR_CHARS)
    before = [m.group().lower() for m in WORD.finditer(text, low, start) if m.start() > low or low == 0][-NEAR_WORDS:]
    after = [m.group().lower() for m in WORD.finditer(text, end, high) if m.end() < high or high == len(text)][:NEAR_WORDS]
    return [t for side in (before, after) for t in (*side, *map(" ".join, zip(side, side[1:])))]  # noqa: B905


def near_rows(frames: Iterator[pd.DataFrame], bits: np.ndarray) -> Iterator[pd.DataFrame]:
    """Of each entity and each term near it: kind, term, a hash of the entity, and how often."""
    for frame in frames:
        found: Counter = Counter()
        for text in frame["text"]:
            text = text or ""
            spans = sum(protected(text, bits), [])
            bare = without(text, spans)
            for kind, a, b in spans:
                value = xxhash.xxh3_64_intdigest(text[a:b].encode("utf-8", "surrogatepass")) - (1 << 63)
                found.update((kind, w, value) for w in near_terms(bare, a, b))
        yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["kind", "term", "entity", "n"])


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def term_rows(frames: Iterator[pd.DataFrame], pairs_in: np.ndarray, heads_in: np.ndarray) -> Iterator[pd.DataFrame]:
    """How often each word stands in a batch's texts, and each two words in a row whose bucket, and that of the first,
    is sought; the empty term has the count of all words."""
    for frame in frames:
        words: Counter = Counter()
        pairs: Counter = Counter()
        for text in frame["text"]:
            own = WORD.findall((text or "").lower())
            words.update(own)
            if heads_in.any():
                new = set(own)
                first = {w for w in new if heads_in[bucket(w)]}
                if first:
                    pairs.update(f"{v} {w}" for v, w in zip(own, own[1:]) if v in first)  # noqa: B905
        total = sum(words.values())
        found = [*words.items(), *((p, n) for p, n in pairs.items() if pairs_in[bucket(p)])]
        yield pd.DataFrame([("", total), *found], columns=["term", "n"])


def sought(terms: DataFrame) -> np.ndarray:
    """Which of the BUCKETS hold one of the terms; none is missed. They come as bits, 64 to a row."""
    at = F.crc32(F.col("term").cast("binary")) % BUCKETS
    bit = F.expr("shiftleft(1L, cast(at % 64 AS int))")
    rows = terms.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("row")).agg(F.bit_or(bit).alias("bits")).collect()
    out = np.zeros(BUCKETS // 64, np.int64)
    for r in rows:
        out[r["row"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def chance_bound(total: Column, share: Column, p: Column) -> Column:
    """At most this is the chance that, of total draws of chance p each, so large a share hits (Chernoff's bound)."""
    gap = share * F.log(share / p) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0)
    return F.when(share > p, F.exp(-total * gap)).otherwise(1.0)


def revealing_terms(texts: DataFrame, bits: np.ndarray) -> tuple[DataFrame | None, dict[str, float]]:
    """A table of the terms over the threshold of a kind (term, kind, shown), and the threshold of each kind.

    A kind without a threshold at which chance explains few enough has no terms, nor has one that no term is near.
    """
    near = texts.mapInPandas(lambda frames: near_rows(frames, bits), "kind string, term string, entity long, n long")
    near = materialise(near.groupBy("kind", "term", "entity").agg(F.sum("n").alias("n")), "near")
    is_word = ~F.contains("term", F.lit(" "))
    slots = {r["kind"]: r["slots"] for r in near.filter(is_word).groupBy("kind").agg(F.sum("n").alias("slots")).collect()}
    by_term = materialise(near.groupBy("kind", "term").agg(F.count("*").alias("support"), F.sum("n").alias("n")).filter(F.col("support") >= SUPPORT), "by-term")
    discard(near)
    if by_term.isEmpty():
        discard(by_term)
        return None, {}
    in_a_row = by_term.filter(~is_word)
    pairs_in, heads_in = sought(in_a_row), sought(in_a_row.withColumn("term", F.substring_index("term", " ", 1)))
    counts = texts.mapInPandas(lambda frames: term_rows(frames, pairs_in, heads_in), "term string, n long")
    counts = materialise(counts.groupBy("term").agg(F.sum("n").alias("total")), "terms")
    words = counts.filter("term = ''").first()["total"]
    # a kind that is near every word has nothing to disclose
    own = {k: n / max(words, 1) for k, n in slots.items() if 0 < n < max(words, 1)}
    p_kind = F.create_map(*[F.lit(x) for k, p in own.items() for x in (k, p)])[F.col("kind")] if own else F.lit(None).cast("double")
    given = by_term.join(counts, "term").withColumn("p", p_kind).filter("p IS NOT NULL")
    p_given = F.least(F.lit(1.0), F.col("n") / F.greatest(F.col("total"), F.lit(1)))
    shown = materialise(given.select("term", "kind", (F.log(p_given / F.col("p")) / -F.log("p")).alias("shown")), "shown")
    # how many reach each threshold, and how many would by chance: all terms of the corpus, by their totals
    reach = shown.groupBy("kind").agg(*[F.count_if(F.col("shown") >= t).alias(str(k)) for k, t in enumerate(THRESHOLDS)]).collect()
    # totals in steps of an eighth of a power of two: some hundreds of rows at most
    size = F.floor(F.pow(F.lit(2.0), F.floor(F.log2(F.col("total").cast("double")) * 8) / 8)).cast("double")
    totals = counts.filter((F.col("term") != "") & (F.col("total") >= SUPPORT)).groupBy(size.alias("total")).agg(F.count("*").alias("terms"))
    by_chance = totals.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("p")) for k, p in own.items()])).alias("o")).select("total", "terms", "o.*") if own else None
    thresholds: dict[str, float] = {}
    if by_chance is not None:
        need = lambda t: F.greatest(F.pow("p", F.lit(1.0 - t)), F.lit(float(SUPPORT)) / F.col("total"))
        expected = by_chance.groupBy("kind").agg(*[F.sum(F.col("terms") * F.when(need(t) <= 1, chance_bound(F.col("total"), F.least(need(t), F.lit(1.0)), F.col("p"))).otherwise(0.0)).alias(str(k)) for k, t in enumerate(THRESHOLDS)])
        false = {r["kind"]: r for r in expected.collect()}
        for row in reach:
            fine = [t for k, t in enumerate(THRESHOLDS) if row["kind"] in false and false[row["kind"]][str(k)] <= BY_CHANCE * row[str(k)]]
            if fine:
                thresholds[row["kind"]] = fine[0]
    discard(by_term)
    discard(counts)
    if not thresholds:
        discard(shown)
        return None, {}
    least = F.create_map(*[F.lit(x) for k, t in thresholds.items() for x in (k, t)])[F.col("kind")]
    # the kind it discloses most, the first by name of several
    most = shown.filter(F.col("shown") >= least).groupBy("term").agg(F.min(F.struct((-F.col("shown")).alias("less"), "kind")).alias("m"))
    most = materialise(most.select("term", "m.kind", (-F.col("m.less")).alias("shown")), "most")
    # two words in a row add nothing where one of them is a term itself
    words, pairs = most.filter(is_word), most.filter(~is_word)
    for at in (1, -1):
        pairs = pairs.withColumn("word", F.substring_index("term", " ", at)).join(words.select(F.col("term").alias("word")), "word", "left_anti").drop("word")
    most = materialise(words.unionByName(pairs), "revealing")
    discard(shown)
    return most, thresholds


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class Terms:
    """Revealing terms of one pass: kind and disclosure by term, and the words that begin one."""

    def __init__(self, rows: list[tuple[str, str, float]]):
        self.found = {t: (k, v) for t, k, v in rows}
        self.first = {t.partition(" ")[0] for t in self.found}

    def hits(self, text: str) -> list[tuple[int, int, str, float]]:
        """start, end, kind and disclosure of each term in the text; of a word and a pair that begin together the pair."""
        if not self.found or self.first.isdisjoint(WORD.findall(text.lower())):
            return []
        out, last = [], None
        for m in WORD.finditer(text):
            w = m.group().lower()
            if last is not None:
                both = self.found.get(f"{last[0]} {w}")
                if both is not None:
                    out.append((last[1], m.end(), *both))
            own = self.found.get(w) if w in self.first else None
            if own is not None:
                out.append((m.start(), m.end(), *own))
            last = (w, m.start()) if w in self.first else None
        return out


def apart(hits: list[tuple[int, int, str, float]], spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str, float]]:
    """Hits that touch no span, and, from the left, the longest first, no hit before."""
    ordered = sorted((a, b) for _, a, b in spans)
    out, at, reach = [], 0, 0
    for hit in sorted(set(hits), key=lambda h: (h[0], -h[1])):
        while at < len(ordered) and ordered[at][0] < hit[1]:
            reach = max(reach, ordered[at][1])
            at += 1
        if reach <= hit[0]:
            out.append(hit)
            reach = hit[1]
    return out


def sanitised(text: str, spans: list[tuple[str, int, int]], hits: list[tuple[int, int, str, float]]) -> str:
    """text with entities and weaker terms replaced by their kind, and stronger terms removed."""
    out, last = [], 0
    for a, b, kind, shown in sorted([*((a, b, k, 0.0) for k, a, b in spans), *hits], key=lambda h: (h[0], -h[1])):
        if a < last:
            last = max(last, b)
            continue
        out += [text[last:a], "" if shown >= REMOVE else f"<{kind}>"]
        last = b
    return "".join([*out, text[last:]])


HITS = "array<struct<start: int, end: int, kind: string, shown: double>>"


def sanitise(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of docs (doc_id and text are read): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    n_added (the spans of the method) and, unless left out, the sanitised text.

    A null text is an empty one, without spans. Terms that never stand near an entity, or near fewer than SUPPORT
    distinct ones, stay; that number is the same for a corpus of any size. Rows that repeat an id each have a result
    and count in the corpus; extra columns play no part; an empty table gives no rows.
    """
    rows = select_present(docs, "doc_id", "text")
    context = docs.sparkSession.sparkContext
    texts = select_present(docs, "text")
    bits = char_bits(texts)
    terms, _ = revealing_terms(texts, bits)
    passes = 1 if terms is None else max(1, -(-terms.count() // PASS_TERMS))
    held = fresh(rows, "hits")[0]

    def of_pass(n: int):
        own = [] if terms is None else terms.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == n).toPandas()[["term", "kind", "shown"]].itertuples(index=False, name=None)
        return context.broadcast(Terms(list(own)))

    for n in range(passes - 1):  # a worker holds the terms of one pass at a time
        shipped = of_pass(n)
        udf = F.pandas_udf(lambda texts, s=shipped: texts.map(lambda t: s.value.hits(t or "")), HITS)
        found = udf("text") if n == 0 else F.concat(held, udf("text"))
        rows = materialise(rows.withColumn(held, found), "hits")
    last = of_pass(passes - 1)
    if terms is not None:
        discard(terms)
    shipped_bits = context.broadcast(bits)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            before = frame[held] if held in frame else [()] * len(frame)
            for doc_id, text, hits in zip(frame["doc_id"], frame["text"], before, strict=True):
                text = text or ""
                base, own = protected(text, shipped_bits.value)
                hits = apart([*((h["start"], h["end"], h["kind"], h["shown"]) for h in hits), *last.value.hits(text)], base + own)
                added = own + [(TERM, a, b) for a, b, *_ in hits]
                n = Counter(k for k, *_ in base)
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((doc_id, *(n[k] for k in KINDS), digest, joined(base + added), len(added), *([sanitised(text, base + own, hits)] if with_text else [])))
            yield pd.DataFrame(out, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", *["text"] * with_text])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(find, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long" + ", text string" * with_text)
