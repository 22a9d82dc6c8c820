"""Text, JSON, date and null functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that a reviewer may give, fixed values.
REVIEW_LABELS = ("new_building", "building_extension", "solar_panels", "hardscape", "vegetation", "no_visible_change", "unclear")
REASON_LENGTH = 200
CONSTRUCTION = "building|extension|pool|driveway|pav"


def falsy_coalesce(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def construction_flag(c: Column) -> Column:
    return F.lower(c).rlike(CONSTRUCTION)


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def parse_date(c: Column) -> Column:
    """The date in the first ten characters; null if there is none."""
    return F.try_to_date(F.left(c, F.lit(10)), "yyyy-MM-dd")


def parse_verdict(reply: Column, labels: tuple[str, ...] = REVIEW_LABELS) -> Column:
    """A reviewer's reply as struct label, confidence, reason, valid; nothing in the reply is trusted.

    The JSON object runs from the first to the last brace. An unknown label is unclear; confidence is clamped to 0..1,
    0 if it is no number; the reason is cut.
    """
    found = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1)
    known = F.from_json(found, "label string, confidence string, reason string")
    label = F.get_json_object(found, "$.label")
    usable = known.isNotNull() & label.isin(*labels)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_cast(known["confidence"], "double") if hasattr(F, "try_cast") else known["confidence"].try_cast("double"), F.lit(0.0))))
    return F.struct(
        F.when(usable, label).otherwise("unclear").alias("label"), F.when(usable, F.round(confidence, 3)).otherwise(0.0).alias("confidence"),
        F.when(usable, F.coalesce(F.left(known["reason"], F.lit(REASON_LENGTH)), F.lit(""))).when(known.isNull() | (found == ""), "unparsable reply").otherwise("unknown label").alias("reason"),
        F.coalesce(usable, F.lit(False)).alias("valid"),
    )


def data_uri(jpeg: Column) -> Column:
    return F.concat(F.lit("data:image/jpeg;base64,"), F.base64(jpeg))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of numbers, shifted by the largest so that none overflows."""
    shifted = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    return F.transform(shifted, lambda v: v / F.aggregate(shifted, F.lit(0.0), lambda s, t: s + t))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays, in 0..1; norms count as 1e-8 at least."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(1e-8))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dot(a, b) / (norm(a) * norm(b))))
