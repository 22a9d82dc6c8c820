"""Evaluation: label summaries, strata and samples, weighted precision, confusion, sweeps and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascape.plans.storage import in_order

#: Size bands (lower bound of each) and the classes of a report, fixed values.
BANDS = (("small", 0.0), ("medium", 60.0), ("large", 150.0))
FLOAT32_EPS = 1.1920929e-07


def size_band(area: Column) -> Column:
    """small below 60, medium below 150, else large; a negative area falls through to large."""
    return F.when((area >= 0) & (area < 60), "small").when((area >= 60) & (area < 150), "medium").otherwise("large")


def stratum(tier: Column, area: Column) -> Column:
    return F.concat_ws("|", F.coalesce(tier, F.lit("unknown")), size_band(area))


def label_summary(labels: DataFrame) -> DataFrame:
    """One row from labels (assessment, outline_quality, issues, detected, total): counts, recall where the total is
    known, and counts by value as sorted maps."""
    bad = F.col("total").isNotNull() & (F.col("detected").isNull() | (F.col("detected") < 0) | (F.col("total") < 0) | (F.col("detected") > F.col("total")))
    checked = labels.withColumn("total", F.when(bad, F.raise_error(F.lit("known building counts must be non-negative, with detected <= total"))).otherwise(F.col("total")))
    known = F.col("total").isNotNull()
    sums = checked.agg(
        F.count("*").alias("labelled_site_count"), F.coalesce(F.sum("total"), F.lit(0)).alias("known_building_total"), F.coalesce(F.sum(F.when(known, F.col("detected"))), F.lit(0)).alias("detected_building_total")
    )
    sums = sums.withColumn("building_recall_on_known_sites", F.when(F.col("known_building_total") > 0, F.round(F.col("detected_building_total") / F.col("known_building_total"), 4)))
    for name, source in (("assessment_counts", "assessment"), ("outline_quality_counts", "outline_quality")):
        sums = sums.join(F.broadcast(counted_map(checked.select(F.coalesce(source, F.lit("unlabelled")).alias("v")), name)))  # one row
    return sums.join(F.broadcast(counted_map(checked.select(F.explode("issues").alias("v")), "issue_counts")))


def counted_map(values: DataFrame, name: str) -> DataFrame:
    """One row: how often each value of column v stands, as a map sorted by value."""
    counts = values.groupBy("v").agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias(name))


def zero_filled_counts(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """column and n for each listed value, 0 where there is none."""
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return F.broadcast(every).join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def strata_plan(df: DataFrame, target: int, least: int) -> DataFrame:
    """By stratum: population, sampled = min(population, max(least, target * share, ties to even)), weight."""
    if target < 1 or least < 1:
        raise ValueError("target and least must be positive")
    counts = df.groupBy("stratum").agg(F.count("*").alias("population"))
    share = F.col("population") / F.sum("population").over(Window.partitionBy())  # one row a stratum
    wanted = F.least(F.col("population"), F.greatest(F.lit(least), F.bround(target * share).cast("long")))
    return counts.withColumn("sampled", wanted).withColumn("weight", F.round(F.col("population") / F.col("sampled"), 3))


def stratified_sample(df: DataFrame, plan: DataFrame, key: str, seed: int) -> DataFrame:
    """The planned number of rows of each stratum, first by a hash of key and seed, so the same on every run.

    The plan's largest number goes into the plan as a literal, so that each task passes on that many rows of a stratum at
    most, before the shuffle.
    """
    most = plan.agg(F.max("sampled")).first()[0] or 0
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    ranked = df.withColumn("draw", F.row_number().over(Window.partitionBy("stratum").orderBy(order, key)))
    return ranked.filter(F.col("draw") <= F.lit(most)).join(F.broadcast(plan.select("stratum", "sampled")), "stratum").filter("draw <= sampled").drop("draw", "sampled")


def review_order(df: DataFrame, area: str, key: str) -> DataFrame:
    return in_order(df, "review_order", F.desc(area), F.col(key))


def weighted_precision(sample: DataFrame, labels: DataFrame, plan: DataFrame) -> DataFrame:
    """One row from sample (id, stratum), labels (id as text, verdict) and plan: rates by stratum recombined by
    population. Only "correct" is correct; rows without a label count nowhere."""
    labelled = sample.join(labels.withColumnRenamed("id", "label_id"), F.col("id").cast("string") == F.col("label_id"))
    rates = labelled.groupBy("stratum").agg(F.count("*").alias("labelled"), F.count_if(F.col("verdict") == "correct").alias("correct"))
    rates = rates.join(plan.select("stratum", "population"), "stratum", "left")
    covered = F.sum("population")
    return rates.agg(
        F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(covered, F.lit(0)).alias("population_covered"),
        F.round(F.sum(F.when(F.col("population").isNotNull(), F.col("correct") / F.col("labelled") * F.col("population"))) / covered, 4).alias("weighted_precision"),
    )


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: the four counts, precision, recall, f1 and iou."""
    p, a, e = predicted.cast("boolean"), actual.cast("boolean"), F.lit(FLOAT32_EPS)
    c = df.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = c.withColumn("precision", tp / (tp + fp + e)).withColumn("recall", tp / (tp + fn + e)).withColumn("iou", tp / (tp + fp + fn + e))
    return c.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + e))


def tier_stats(df: DataFrame, tier: str, area: str) -> DataFrame:
    return df.groupBy(tier).agg(F.count("*").alias("n"), F.median(area).alias("median_area"), F.count_if(F.col(area) >= 60).alias("over_60"), F.count_if(F.col(area) >= 100).alias("over_100"))


def threshold_sweep(df: DataFrame, score: str, area: str, thresholds: list[float], scene_area: float) -> DataFrame:
    """By threshold: rows at or over it, their area, median and coverage, and the steps from the threshold before.

    Every row is dealt to the thresholds it passes, so one pass and one aggregation serve all.
    """
    passed = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col(score))
    by = df.select(F.explode(passed).alias("threshold"), area).groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.sum(area), 2).alias("area"), F.median(area).alias("median_area"))
    every = df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    rows = F.broadcast(every).join(by, "threshold", "left").fillna({"n": 0, "area": 0.0, "median_area": 0.0}).withColumn("coverage_pct", F.round(100 * F.col("area") / scene_area, 2))
    order = Window.orderBy(F.desc("threshold"))
    return rows.withColumn("added_n", F.col("n") - F.lag("n").over(order)).withColumn("added_area", F.round(F.col("area") - F.lag("area").over(order), 2))


def coverage_bucket(c: Column) -> Column:
    return F.when(c < 0.01, "missed").when(c < 0.25, "0.01-0.25").when(c < 0.5, "0.25-0.5").when(c < 0.75, "0.5-0.75").otherwise("0.75-1")


def coverage_report(df: DataFrame, coverage: str, luma: str, dark_percentile: float = 0.25) -> DataFrame:
    """By bucket of coverage: rows, and the medians of coverage over the dark and the light rows of all."""
    cut = df.agg(F.percentile(luma, F.lit(dark_percentile)).alias("cut"))
    marked = df.join(F.broadcast(cut)).withColumn("dark", F.col(luma) <= F.col("cut"))  # one row
    sums = marked.agg(F.median(F.when(F.col("dark"), F.col(coverage))).alias("dark_median"), F.median(F.when(~F.col("dark"), F.col(coverage))).alias("light_median"))
    buckets = marked.groupBy(coverage_bucket(F.col(coverage)).alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(F.broadcast(sums))
