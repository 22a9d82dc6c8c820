"""Operators on dated footprints and change candidates: compare, fuse, group into sites, corroborate.

Shapes are boxes (columns x0, y0, x1, y1, in map metres); where a column rings is present it holds the polygons and the
boxes are their bounds. Rows keep their input order in a column ordinal or idx, which settles every tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascape.functions.geometry import Box
from deltascape.plans.storage import in_order, join_groups, materialise

from .components import connected_components
from .spatial import CORNERS, anti, near_pairs, near_roots, nearest, nearest_any, overlap_of_many, prefixed, ring_area, ring_distance, ring_overlap, self_pairs, semi, union_areas, union_box_area, union_ring_area

#: Words that mark a classification as construction, fixed values.
CONSTRUCTION_WORDS = ("building", "extension", "pool", "driveway", "pav")
#: Proximity graphs of at most this many edges are solved in one task.
ONE_TASK_EDGES = 500_000
#: Members that are gathered into one row at once; a site of more is put together from pieces.
SITE_MEMBERS = 10_000
NEW, EXTENSION = "new_building_footprint_candidate", "building_extension_footprint_candidate"


def shape_area(df: DataFrame) -> Column:
    return ring_area("rings") if "rings" in df.columns else Box.of().area().cast("double")


def footprint_pairs(before: DataFrame, after: DataFrame, match_distance: float, side: float) -> DataFrame:
    """Before and after footprints within the distance: l_ columns of after, r_ of before, distance, overlap and iou."""
    rings = "rings" in before.columns and "rings" in after.columns
    exact = ring_distance("l_rings", "r_rings") if rings else None
    pairs = near_pairs(prefixed(after, "l_"), prefixed(before, "r_"), match_distance, side, exact=exact)
    a, b = Box.of("l_"), Box.of("r_")
    if rings:
        pairs = pairs.withColumn("overlap", ring_overlap("l_rings", "r_rings"))
        union = ring_area("l_rings") + ring_area("r_rings") - F.col("overlap")
    else:
        pairs = pairs.withColumn("overlap", a.overlap(b).cast("double"))
        union = a.area() + b.area() - F.col("overlap")
    return pairs.withColumn("iou", F.when(union > 0, F.col("overlap") / union).otherwise(0.0))


def change_class(outside_fraction: Column, matched: Column, extension_outside: float) -> Column:
    """The class of a footprint; null for a stable one."""
    return F.when(~matched, NEW).when(outside_fraction >= extension_outside, EXTENSION)


def compare_footprints(before: DataFrame, after: DataFrame, match_distance: float = 6.0, match_iou: float = 0.10, extension_outside: float = 0.25, min_area: float = 20.0, side: float = 64.0) -> DataFrame:
    """New and extended footprints of after (id, ordinal and shape) against before, largest first.

    A footprint matches one before it by distance or by intersection over union; outside is its area beyond all it
    matches. The nearest distance is over all of before, matched or not, and null if before is empty.
    """
    if match_distance < 0 or not 0 <= match_iou <= 1 or not 0 <= extension_outside <= 1 or min_area <= 0:
        raise ValueError("comparison parameters are outside their ranges")
    after = after.withColumn("area", shape_area(after)).filter(F.col("area") >= min_area)
    pairs = footprint_pairs(before, after, match_distance, side)  # overlapping shapes are at distance 0, so iou matches are among these
    a, b = Box.of("l_"), Box.of("r_")
    part = F.struct(F.greatest(a.x0, b.x0).cast("double").alias("x0"), F.greatest(a.y0, b.y0).cast("double").alias("y0"), F.least(a.x1, b.x1).cast("double").alias("x1"), F.least(a.y1, b.y1).cast("double").alias("y1"))
    rings = "rings" in before.columns and "rings" in after.columns
    one = F.col("r_rings") if rings else part
    matched = pairs.groupBy("l_id").agg(
        F.min("distance").alias("near"), F.max("iou").alias("best_iou"), F.array_sort(F.collect_list(F.struct(F.col("r_ordinal"), F.col("r_id")))).alias("ids"),
        F.collect_list(F.when(F.col("overlap") > 0, one)).alias("parts"),
    )
    rows = after.join(matched, after["id"] == matched["l_id"], "left")
    if rings:
        inside = overlap_of_many("rings", "parts")
    else:
        inside = union_box_area("parts")
    rows = rows.withColumn("inside", F.when(F.size(F.coalesce("parts", F.array())) > 0, inside).otherwise(0.0)).withColumn("outside", F.greatest(F.lit(0.0), F.col("area") - F.col("inside")))
    rows = rows.withColumn("classification", change_class(F.col("outside") / F.col("area"), F.col("l_id").isNotNull(), extension_outside)).filter(F.col("classification").isNotNull())
    far = rows.filter(F.col("near").isNull()).select("id", *CORNERS, *(["rings"] if rings else []))
    rows = rows.join(nearest_any(far, before, 4 * max(match_distance, side), "id").withColumnRenamed("nearest_distance", "far"), "id", "left")
    out = rows.select(
        "id", "ordinal", "classification", F.round("area", 1).alias("area_m2"), F.round("outside", 1).alias("outside_before_area_m2"),
        F.when(F.col("l_id").isNull(), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("outside") / F.col("area"))), 3)).alias("before_overlap_fraction"),
        F.round(F.coalesce("near", "far"), 1).alias("nearest_before_footprint_distance_m"), F.round(F.coalesce("best_iou", F.lit(0.0)), 3).alias("best_before_footprint_iou"),
        F.coalesce(F.transform("ids", lambda s: s["r_id"]), F.array().cast("array<bigint>")).alias("matched_before_footprint_ids"), *[c for c in ("rings",) if rings],
    )
    return in_order(out, "candidate_id", F.desc("area_m2"), F.col("ordinal")).drop("ordinal")


def preferred_class(counted: DataFrame, key: str) -> DataFrame:
    """key and preferred: of each key's classes (columns classification and n) the most frequent, then one with a
    construction word, then the last by text."""
    marked = F.lower("classification").rlike("|".join(CONSTRUCTION_WORDS)).cast("int")
    return counted.groupBy(key).agg(F.max_by("classification", F.struct("n", marked.alias("p"), "classification")).alias("preferred"))


def cluster(shapes: DataFrame, d: float, side: float, different: str | None = None, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """idx and cluster (its smallest idx) of shapes joined by proximity, perhaps between unlike values of a column only.

    Boxes that any nearness joins meet by cells, without a table of all pairs; their joins are shuffled, as Spark takes
    compressed files of millions of boxes for small enough to broadcast.
    """
    if different is None and "rings" not in shapes.columns:
        by_cells = materialise(near_roots(shapes, d, side), "roots").withColumn("least", F.col("roots")[0])
        joined = connected_components(by_cells.filter(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.col("least").alias("v")).filter("u <> v"), one_task_edges)
        found = by_cells.join(joined.withColumnRenamed("node", "least").hint("merge"), "least", "left").select(F.col("node").alias("idx"), F.coalesce("root", "least").alias("cluster"))
        return shapes.select("idx").join(found.hint("merge"), "idx", "left").select("idx", F.coalesce("cluster", "idx").alias("cluster"))
    pairs = self_pairs(shapes, d, side, "idx", different).select(F.col("l_idx").alias("u"), F.col("r_idx").alias("v"))
    joined = connected_components(pairs.select("u", "v"), one_task_edges)
    return shapes.select("idx").join(joined.select(F.col("node").alias("idx"), "root"), "idx", "left").select("idx", F.coalesce("root", "idx").alias("cluster"))


def merged_area(df: DataFrame) -> Column:
    """Area of the union of a group's shapes, as an aggregate."""
    if "rings" in df.columns:
        return union_ring_area(F.collect_list("rings"))
    return union_box_area(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in CORNERS])))


def fuse_candidates(candidates: DataFrame, merge_distance: float = 2.0, side: float = 64.0) -> DataFrame:
    """One row per cluster of candidates (idx, source, id, classification, model, shape) of unlike sources near one
    another; candidates of one source alone stay. Most sources first, then the largest."""
    if merge_distance < 0:
        raise ValueError("merge_distance cannot be negative")
    rows = candidates.join(cluster(candidates, merge_distance, side, "source"), "idx")
    counted = rows.groupBy("cluster", "classification").agg(F.count("*").alias("n"))
    sorted_set = lambda c: F.array_sort(F.collect_set(c))
    members = F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(":", "source", F.col("id").cast("string")).alias("ref"))))
    merged = rows.groupBy("cluster").agg(
        F.round(merged_area(rows), 1).alias("area_m2"), sorted_set("source").alias("candidate_sources"), F.count("*").alias("raw_candidate_count"), sorted_set("model").alias("source_models"),
        F.transform(members, lambda s: s["ref"]).alias("source_candidate_ids"), sorted_set("classification").alias("source_classifications"),
    )
    merged = merged.withColumn("source_count", F.size("candidate_sources")).withColumn("agreement", agreement(F.col("source_count")))
    merged = merged.join(preferred_class(counted, "cluster").withColumnRenamed("preferred", "classification"), "cluster")
    return in_order(merged, "candidate_id", F.desc("source_count"), F.desc("area_m2"), F.col("cluster"))


def agreement(source_count: Column) -> Column:
    return F.when(source_count > 1, "multi_source_agreement").otherwise("single_source_candidate")


def priority(agreeing: Column, has_footprints: Column) -> Column:
    """Review priority of a site."""
    return F.when((agreeing >= 3) & has_footprints, "high").when((agreeing >= 2) | has_footprints, "medium").otherwise("low")


def priority_rank(p: Column) -> Column:
    return F.when(p == "high", 0).when(p == "medium", 1).otherwise(2)


def _of(role: str, c: Column) -> Column:
    return F.when(F.col("role") == role, c)


def _gathered(evidence: DataFrame) -> DataFrame:
    """One row per site of its evidence."""
    ids = lambda role: F.transform(F.array_sort(F.collect_list(_of(role, F.struct("idx", "id")))), lambda s: s["id"])
    return evidence.groupBy("site").agg(
        F.round(merged_area(evidence), 1).alias("site_area_m2"), F.count_if(F.col("role") == "change").alias("change_evidence_count"), F.count_if(F.col("role") == "footprint").alias("footprint_evidence_count"),
        ids("change").alias("change_candidate_ids"), ids("footprint").alias("footprint_candidate_ids"),
        F.array_sort(F.collect_set(_of("change", F.col("classification")))).alias("change_classifications"), F.array_sort(F.collect_set(_of("footprint", F.col("classification")))).alias("footprint_classifications"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col("sources"))))).alias("change_sources"), F.coalesce(F.max(_of("change", F.coalesce("source_count", F.lit(1)))), F.lit(0)).alias("agreeing"),
    )


def _pieced(evidence: DataFrame, side: float) -> DataFrame:
    """The rows of _gathered for sites of any size (members, and the least and greatest idx, low and high): lists from
    sorted pieces of the range of idx, areas from cells."""
    # all large sites are clusters of changes, so their number alone names them
    width = F.ceil(F.col("members") / SITE_MEMBERS) / (F.col("high") - F.col("low") + 1)
    pieces = evidence.groupBy("site", "role", F.floor((F.col("idx") - F.col("low")) * width).alias("piece")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "id"))), lambda s: s["id"]).alias("ids"), F.count("*").alias("n"), F.collect_set("classification").alias("classes"),
        F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"), F.max(F.coalesce("source_count", F.lit(1))).alias("agreeing"),
    )
    count = lambda role: F.coalesce(F.sum(_of(role, F.col("n"))), F.lit(0))
    ids = lambda role: F.flatten(F.transform(F.array_sort(F.collect_list(_of(role, F.struct("piece", "ids")))), lambda s: s["ids"]))
    classes = lambda role: F.array_sort(F.array_distinct(F.flatten(F.collect_list(_of(role, F.col("classes"))))))
    shape = [*CORNERS, *(["rings"] if "rings" in evidence.columns else [])]
    areas = union_areas(evidence.select(F.col("site.i").alias("i"), *shape), "i", side).select(F.struct(F.lit(0).alias("k"), "i").alias("site"), F.lit("area").alias("role"), "area")
    return pieces.unionByName(areas, allowMissingColumns=True).groupBy("site").agg(
        F.round(F.coalesce(F.max("area"), F.lit(0.0)), 1).alias("site_area_m2"), count("change").alias("change_evidence_count"), count("footprint").alias("footprint_evidence_count"),
        ids("change").alias("change_candidate_ids"), ids("footprint").alias("footprint_candidate_ids"), classes("change").alias("change_classifications"), classes("footprint").alias("footprint_classifications"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("change_sources"), F.coalesce(F.max(_of("change", F.col("agreeing"))), F.lit(0)).alias("agreeing"),
    )


def build_sites(changes: DataFrame, footprints: DataFrame, merge_distance: float = 10.0, radius: float = 25.0, side: float = 64.0) -> DataFrame:
    """Sites for review: clusters of changes (idx, id, classification, sources, source_count, shape), each with the
    footprints (idx, id, classification, shape) whose nearest cluster it is; far footprints are sites of their own."""
    if merge_distance < 0 or radius < 0:
        raise ValueError("distances cannot be negative")
    shape = [*CORNERS, *(["rings"] if "rings" in changes.columns else [])]
    grouped = materialise(changes.join(cluster(changes, merge_distance, side).hint("merge"), "idx"), "grouped")
    # a cluster is as near as its nearest member, and ties go to the lower cluster
    at = nearest(footprints.select("idx", *shape), grouped.select(F.col("cluster").alias("cluster"), *shape), radius, max(side, 2 * radius), "idx", "cluster", True)
    attached = footprints.join(at.select("idx", F.col("nearest_cluster").alias("cluster")).hint("merge"), "idx")
    alone = F.col("cluster").isNull()
    key = F.when(alone, F.struct(F.lit(1).alias("k"), F.col("idx").alias("i"))).otherwise(F.struct(F.lit(0).alias("k"), F.col("cluster").alias("i"))).alias("site")
    evidence = grouped.select(F.struct(F.lit(0).alias("k"), F.col("cluster").alias("i")).alias("site"), F.lit("change").alias("role"), "idx", "id", "classification", "sources", "source_count", *shape)
    evidence = materialise(evidence.unionByName(attached.select(key, F.lit("footprint").alias("role"), "idx", "id", "classification", *shape), allowMissingColumns=True), "evidence")
    sizes = materialise(evidence.groupBy("site").agg(F.count("*").alias("members"), F.min("idx").alias("low"), F.max("idx").alias("high")), "sizes")
    total, most = sizes.agg(F.sum("members"), F.coalesce(F.max("members"), F.lit(0))).first()
    if most <= SITE_MEMBERS:
        sites = _gathered(evidence)
    else:
        sized = join_groups(evidence, sizes, "site", "members", total)
        sites = _gathered(sized.filter(F.col("members") <= SITE_MEMBERS)).unionByName(_pieced(sized.filter(F.col("members") > SITE_MEMBERS), side))
    sites = sites.withColumn("review_priority", priority(F.col("agreeing"), F.col("footprint_evidence_count") > 0)).withColumn(
        "classification", F.when(F.col("change_evidence_count") > 0, "construction_site_candidate").otherwise("footprint_only_site_candidate")
    )
    return in_order(sites, "candidate_id", priority_rank(F.col("review_priority")), F.desc("site_area_m2"), F.col("site")).drop("site", "agreeing")


def support_tier(sources: Column, support: Column, min_sources: int, strong: float) -> Column:
    return F.when((sources >= min_sources) & (support >= strong), "corroborated").when(sources > 0, "weakly_corroborated").otherwise("footprint_only")


def corroborate(footprints: DataFrame, evidence: DataFrame, support_distance: float = 2.0, strong_support: float = 0.10, min_sources: int = 2, side: float = 64.0, all_sources: bool = False) -> DataFrame:
    """footprints (idx, shape) with their support by change evidence (source, shape): tier, sources, the covered share, and
    by source the covered share and distance. Footprints of no area stay out; none other is dropped.

    The map by source holds those within the support distance; with all_sources also the distance of every other
    source (their names, a handful, come to the driver).
    """
    if support_distance < 0 or not 0 <= strong_support <= 1 or min_sources < 1:
        raise ValueError("support parameters are outside their ranges")
    rings = "rings" in footprints.columns and "rings" in evidence.columns
    shapes = footprints.withColumn("area", shape_area(footprints)).filter("area > 0")
    exact = ring_distance("l_rings", "r_rings") if rings else None
    pairs = near_pairs(prefixed(shapes, "l_"), prefixed(evidence, "r_"), support_distance, side, exact=exact)
    a, b = Box.of("l_"), Box.of("r_")
    part = F.struct(F.greatest(a.x0, b.x0).cast("double").alias("x0"), F.greatest(a.y0, b.y0).cast("double").alias("y0"), F.least(a.x1, b.x1).cast("double").alias("x1"), F.least(a.y1, b.y1).cast("double").alias("y1"))
    one = F.col("r_rings") if rings else F.when(a.overlap(b) > 0, part)
    covered = lambda parts: overlap_of_many(F.first("l_rings"), parts) if rings else union_box_area(parts)
    by_source = pairs.groupBy("l_idx", "r_source").agg(covered(F.collect_list(one)).alias("cover"), F.min("distance").alias("distance"), F.first("l_area").alias("area"))
    detail = F.map_from_entries(F.array_sort(F.collect_list(F.struct("r_source", F.struct(F.round(F.col("cover") / F.col("area"), 4).alias("overlap_fraction"), F.round("distance", 2).alias("distance_m"))))))
    by_source = by_source.withColumn("near", F.lit(True))
    for name in [r["source"] for r in evidence.select("source").distinct().collect()] if all_sources else []:
        own = evidence.filter(F.col("source") == name)
        rest = shapes.join(by_source.filter((F.col("r_source") == name) & F.col("near")).select(F.col("l_idx").alias("idx")), "idx", "left_anti")
        far = nearest_any(rest, own, 8 * side, "idx").join(rest.select("idx", "area"), "idx")
        by_source = by_source.unionByName(far.select(F.col("idx").alias("l_idx"), F.lit(name).alias("r_source"), F.lit(0.0).alias("cover"), F.col("nearest_distance").alias("distance"), "area", F.lit(False).alias("near")))
    by_source = by_source.groupBy("l_idx").agg(F.array_sort(F.collect_list(F.when(F.col("near"), F.col("r_source")))).alias("supporting_sources"), detail.alias("per_source"))
    total = pairs.groupBy("l_idx").agg(covered(F.collect_list(one)).alias("cover_all"))
    rows = shapes.join(by_source.join(total, "l_idx", "left").withColumnRenamed("l_idx", "idx"), "idx", "left")
    rows = rows.withColumn("supporting_sources", F.coalesce("supporting_sources", F.array().cast("array<string>"))).withColumn("source_count", F.size("supporting_sources"))
    share = F.coalesce(F.col("cover_all"), F.lit(0.0)) / F.col("area")
    return rows.withColumn("tier", support_tier(F.col("source_count"), share, min_sources, strong_support)).withColumn("support_fraction", F.round(share, 4)).drop("cover_all")


def reference_matches(reference: DataFrame, predictions: DataFrame, match_distance: float = 8.0, side: float = 64.0) -> DataFrame:
    """reference (id, real, shape) each with the sorted ids of the predictions (id, shape) near it, and detected.

    Of predictions that repeat an id the last by ordinal counts.
    """
    if match_distance < 0:
        raise ValueError("match_distance cannot be negative")
    last = predictions.groupBy("id").agg(F.max_by(F.struct(*[c for c in predictions.columns if c != "id"]), "ordinal").alias("p")).select("id", "p.*")
    exact = ring_distance("l_rings", "r_rings") if "rings" in reference.columns and "rings" in predictions.columns else None
    pairs = near_pairs(prefixed(reference, "l_"), prefixed(last, "r_"), match_distance, side, exact=exact)
    matched = pairs.groupBy(F.col("l_id").alias("id")).agg(F.array_sort(F.collect_set("r_id")).alias("matched_prediction_ids"))
    out = reference.join(matched, "id", "left").withColumn("matched_prediction_ids", F.coalesce("matched_prediction_ids", F.array().cast("array<bigint>")))
    return out.withColumn("detected", F.size("matched_prediction_ids") > 0)


def prediction_outcomes(matches: DataFrame, predictions: DataFrame) -> DataFrame:
    """id of each prediction, whether it hits a real reference, whether it hits a rejected one; one that hits no real
    one needs review."""
    pairs = matches.select("real", F.explode("matched_prediction_ids").alias("id"))
    by_id = pairs.groupBy("id").agg(F.bool_or("real").alias("hit"), F.bool_or(~F.col("real")).alias("hit_rejected"))
    no = F.lit(False)
    return predictions.select("id").distinct().join(by_id, "id", "left").select("id", F.coalesce("hit", no).alias("hit"), F.coalesce("hit_rejected", no).alias("hit_rejected"))


def reference_recall(matches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: confirmed and detected references, recall, predictions, and how many hit, hit rejected ones, need review."""
    sums = matches.agg(F.count_if("real").alias("human_confirmed_reference_count"), F.count_if(F.col("real") & F.col("detected")).alias("detected_reference_count"))
    every = outcomes.agg(F.count("*").alias("prediction_candidate_count"), F.count_if("hit").alias("hit"), F.count_if("hit_rejected").alias("rejected"), F.count_if(~F.col("hit")).alias("unmatched"))
    out = sums.join(F.broadcast(every))  # one row each
    return out.withColumn("reference_recall", F.round(F.try_divide("detected_reference_count", "human_confirmed_reference_count"), 4))


def new_objects(old: DataFrame, new: DataFrame, side: float = 64.0) -> DataFrame:
    """Rows of new (id, shape) that touch none of old."""
    return anti(new, old, 0.0, side, "id")


def demolished_objects(old: DataFrame, new: DataFrame, side: float = 64.0) -> DataFrame:
    """Rows of old that touch none of new."""
    return anti(old, new, 0.0, side, "id")


def hits(reference: DataFrame, predictions: DataFrame, match_distance: float = 8.0, side: float = 64.0) -> DataFrame:
    """Reference rows with a prediction near."""
    return semi(reference, predictions, match_distance, side, "id")


def unmatched(reference: DataFrame, predictions: DataFrame, match_distance: float = 8.0, side: float = 64.0) -> DataFrame:
    """Predictions with no reference near."""
    return anti(predictions, reference, match_distance, side, "id")


def survey_pair(surveys: DataFrame, group: str, before: Column, after: Column | None = None) -> DataFrame:
    """Per group the survey (id, date) latest at or before a date, and the earliest at or after another, or the last one.

    Ties of dates go to the larger id. ok tells a valid pair: two surveys, the second later than the first.
    """
    order = F.struct("date", "id")
    late = F.lit(True) if after is None else F.col("date") >= after
    pick = F.max if after is None else F.min
    found = surveys.groupBy(group).agg(F.max(F.when(F.col("date") <= before, order)).alias("b"), pick(F.when(late, order)).alias("a"))
    return found.select(
        group, F.col("b.id").alias("before_id"), F.col("b.date").alias("before_date"), F.col("a.id").alias("after_id"), F.col("a.date").alias("after_date"),
        F.coalesce((F.col("b.date") < F.col("a.date")) & (F.col("b.id") != F.col("a.id")), F.lit(False)).alias("ok"),
    )


def ranked_windows(df: DataFrame, partition: str, *order: Column) -> DataFrame:
    """Row numbers within a partition."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
