"""Commands: python -m deltascape COMMAND ... Every command reads files, runs one plan and writes a folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascape.operators import change as C
from deltascape.operators import evaluation as E
from deltascape.plans import review as R
from deltascape.plans.config import PRESETS, preset
from deltascape.plans.storage import materialise
from deltascape.sources import geojson as J


def _saved(df: DataFrame, path: str, order: list) -> None:
    properties = [c for c in df.columns if c not in ("rings", "x0", "y0", "x1", "y1", "properties")]
    J.write_features(df, path, properties, order)


def detect(spark: SparkSession, a: argparse.Namespace) -> None:
    config = preset(a.preset).with_values({name: value for name, value in vars(a).items() if "." in name})
    got = R.detect_files(spark, a.before, a.after, config, a.before_dsm, a.after_dsm, before_date=a.before_date, after_date=a.after_date)
    for name in ("candidates", "uncertain", "likely_buildings"):
        _saved(got[name], f"{a.out}/{name}", [F.desc("area_m2"), F.col("region")])
    J.write_report(got["report"], f"{a.out}/report")


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    read = lambda p: J.read_features(spark, p).withColumn("ordinal", F.col("idx")).withColumn("id", F.col("idx"))
    got = C.compare_footprints(read(a.before), read(a.after), a.distance, a.iou, a.outside, a.min_area)
    _saved(got, f"{a.out}/changes", [F.col("candidate_id")])
    classes = (C.NEW, C.EXTENSION)
    J.write_report(E.zero_filled_counts(got, "classification", classes), f"{a.out}/report")


def fuse(spark: SparkSession, a: argparse.Namespace) -> None:
    got = C.fuse_candidates(J.read_sources(spark, a.sources), a.distance)
    got.write.mode("overwrite").json(f"{a.out}/fused")
    J.write_report(got.groupBy("source_count").agg(F.count("*").alias("n")), f"{a.out}/report")


def sites(spark: SparkSession, a: argparse.Namespace) -> None:
    got = C.build_sites(J.read_features(spark, a.changes).withColumn("sources", F.coalesce("sources", F.array().cast("array<string>"))), J.read_features(spark, a.footprints), a.distance, a.radius)
    got.write.mode("overwrite").json(f"{a.out}/sites")
    J.write_report(E.zero_filled_counts(got, "review_priority", ("high", "medium", "low")), f"{a.out}/report")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    labels = J.read_labels(spark, a.labels).select(F.col("reference_candidate_id").cast("string").alias("id"), (F.col("assessment") == a.real).alias("real"))
    reference = J.read_features(spark, a.reference)
    missing = labels.join(reference, "id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("labels refer to references that do not exist")
    predictions = J.read_features(spark, a.predictions).withColumn("ordinal", F.col("idx"))
    matches = C.reference_matches(reference.join(labels, "id"), predictions, a.distance)
    outcomes = C.prediction_outcomes(matches, predictions)
    J.write_report(C.reference_recall(matches, outcomes), f"{a.out}/report")
    outcomes.write.mode("overwrite").json(f"{a.out}/predictions")


def summarise(spark: SparkSession, a: argparse.Namespace) -> None:
    J.write_report(E.label_summary(J.read_labels(spark, a.labels)), f"{a.out}/summary")


def page(spark: SparkSession, a: argparse.Namespace) -> None:
    J.review_page(J.read_features(spark, a.candidates), ["id", "classification", "area_m2"]).coalesce(1).write.mode("overwrite").text(f"{a.out}/page")


def shadow(spark: SparkSession, a: argparse.Namespace) -> None:
    got = materialise(R.annotate_shadow_files(spark, a.before, a.after, a.candidates), "annotated")
    _saved(got, f"{a.out}/annotated", [F.col("idx")])
    J.write_report(E.zero_filled_counts(got, "shadow_risk", ("high", "medium", "low", "no_valid_pixels", "invalid_geometry")), f"{a.out}/report")


def expand(spark: SparkSession, a: argparse.Namespace) -> None:
    got = R.expand_files(spark, a.candidates, a.score, percentile=a.percentile, reach_m=a.reach, closing_m=a.closing, min_area=a.min_area)
    for name in ("candidates", "likely_buildings"):
        _saved(got[name], f"{a.out}/{name}", [F.desc("area_m2"), F.col("region")])
    J.write_report(got["report"], f"{a.out}/report")


def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    own = lambda name: F.get_json_object("properties", f"$.{name}")
    rows = J.read_features(spark, a.candidates).withColumn("tier", own("change_support.tier")).withColumn("area_m2", F.coalesce("area_m2", F.lit(0.0)))
    if a.labels:  # the labels of a sample drawn before: id to verdict
        verdicts = spark.read.text(a.labels, wholetext=True).select(F.explode(F.from_json(F.coalesce(F.get_json_object("value", "$.labels"), F.col("value")), "map<string,string>")).alias("id", "verdict"))
        drawn = rows.withColumn("stratum", F.coalesce(own("review_stratum"), E.stratum(F.col("tier"), F.col("area_m2"))))
        J.write_report(E.weighted_precision(drawn, verdicts, E.strata_plan(drawn, int(a.target), int(a.least))), f"{a.out}/report")
        return
    got = R.review_sample(rows, int(a.target), int(a.least), int(a.seed))
    _saved(got["sample"].withColumnRenamed("stratum", "review_stratum"), f"{a.out}/sample", [F.col("review_order")])
    J.write_report(got["plan"], f"{a.out}/plan")
    J.write_report(got["template"], f"{a.out}/template")


def enhanced(spark: SparkSession, a: argparse.Namespace) -> None:
    channels: dict[str, DataFrame] = {}
    states = []
    for value in a.channels:
        name, sign, path = value.partition("=")
        if not (name and sign and path) or name in channels:
            raise ValueError(f"channels are name=path, each name once; not {value!r}")
        try:  # a channel that fails is reported, and the others go on
            channels[name] = materialise(J.read_features(spark, path), "channel")
            states.append((name, None))
        except Exception as error:  # noqa: BLE001
            states.append((name, str(error).splitlines()[0]))
    J.write_report(spark.createDataFrame(states, "channel string, error string"), f"{a.out}/channels")
    if not channels:
        raise ValueError("all channels failed")
    got = R.enhanced(channels, a.distance)
    got["fused"].write.mode("overwrite").json(f"{a.out}/fused")
    for name in ("channel_counts", "by_sources"):
        J.write_report(got[name], f"{a.out}/{name}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("deltascape")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *paths: str, **numbers: float) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for path in paths:
            p.add_argument(path)
        for key, value in numbers.items():
            p.add_argument(f"--{key.replace('_', '-')}", type=float, default=value)
        p.add_argument("--out", required=True)
        p.set_defaults(run=run)
        return p

    p = add("detect", detect, "before", "after")
    p.add_argument("--preset", choices=sorted(PRESETS), default="balanced")
    for name in ("before-dsm", "after-dsm"):
        p.add_argument(f"--{name}")
    for name in ("before-date", "after-date"):
        p.add_argument(f"--{name}", default="unknown")
    for name, setting in (("percentile", "threshold.percentile"), ("min-area", "shape.min_area_m2")):
        p.add_argument(f"--{name}", type=float, dest=setting, default=argparse.SUPPRESS)
    add("compare", compare, "before", "after", distance=6.0, iou=0.1, outside=0.25, min_area=20.0)
    add("fuse", fuse, distance=2.0).add_argument("sources", nargs="+", help="name=path")
    add("sites", sites, "changes", "footprints", distance=10.0, radius=25.0)
    add("evaluate", evaluate, "reference", "labels", "predictions", distance=8.0).add_argument("--real", default="real_change")
    add("summarise", summarise, "labels")
    add("page", page, "candidates")
    add("shadow", shadow, "before", "after", "candidates")
    add("expand", expand, "candidates", "score", percentile=96.5, reach=6.0, closing=1.0, min_area=20.0)
    add("sample", sample, "candidates", target=25, least=3, seed=20260811).add_argument("--labels")
    add("enhanced", enhanced, distance=3.0).add_argument("channels", nargs="+", help="name=path")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("deltascape").getOrCreate()
    try:
        a.run(spark, a)
    except (ValueError, RuntimeError) as error:
        print(f"ERROR: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
