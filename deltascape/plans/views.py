"""Geometry and pixels made from the driver's tables. The texts hold in Spark SQL and in the oracle's dialect alike;
all of it is integer arithmetic, so both engines agree to the bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAND = {
    "idx": "event_id", "id": "event_id", "source": "event_type", "classification": "CASE WHEN event_id % 7 = 0 THEN 'new_building' WHEN event_id % 5 = 0 THEN 'paving' ELSE event_type END",
    "model": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('m', CAST(event_id % 3 AS STRING)) END",
    "x0": "(event_id * event_id * 31 + event_id * 7919) % 12007", "y0": "(event_id * event_id * 17 + event_id * 104729 + 77) % 12011",
    "w": "5 + event_id % 20", "h": "5 + (event_id * 3) % 20", "score": "value", "kind": "event_id % 3",
}
PART = {
    "id": "p_partkey", "ordinal": "p_partkey", "k": "p_partkey % 4", "x0": "(p_partkey * p_partkey * 31 + p_partkey * 7919) % 6007",
    "y0": "(p_partkey * p_partkey * 17 + p_partkey * 104729 + 77) % 6011", "w": "8 + p_partkey % 12", "h": "8 + (p_partkey * 5) % 12",
}


def sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CAND_SQL = f"SELECT *, x0 + w AS x1, y0 + h AS y1 FROM ({sql(CAND, 'events')})"
PART_SQL = sql(PART, "part")
BEFORE_SQL = f"SELECT id, ordinal, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM ({PART_SQL}) WHERE k <> 3"
AFTER_SQL = (
    f"SELECT id, ordinal, x0 + CASE WHEN k = 2 THEN 40 ELSE 0 END AS x0, y0, x0 + w + CASE WHEN k = 2 THEN 40 WHEN k = 1 THEN 10 ELSE 0 END AS x1, y0 + h AS y1 FROM ({PART_SQL})"
)
WITH = f"cand AS ({CAND_SQL}), fp_before AS ({BEFORE_SQL}), fp_after AS ({AFTER_SQL})"
#: Pixels of the 8 by 8 tiles in embeddings.
PX_SQL = "px AS (SELECT vec_id AS scene, (i - 1) // 8 AS row, (i - 1) % 8 AS col, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i))"


def _boxes(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of five sources: boxes from events."""
    return _boxes(table(spark, sf_dir, "events"), CAND).withColumn("x1", F.col("x0") + F.col("w")).withColumn("y1", F.col("y0") + F.col("h"))


def fp_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(table(spark, sf_dir, "part"), PART).filter("k <> 3").selectExpr("id", "ordinal", "x0", "y0", "x0 + w AS x1", "y0 + h AS y1")


def fp_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints of a later date: some widened, some moved, some new."""
    moved = "CASE WHEN k = 2 THEN 40 ELSE 0 END"
    return _boxes(table(spark, sf_dir, "part"), PART).selectExpr("id", "ordinal", f"x0 + {moved} AS x0", "y0", f"x0 + w + {moved} + CASE WHEN k = 1 THEN 10 ELSE 0 END AS x1", "y0 + h AS y1")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltascape.operators.pixels import pixels

    return pixels(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "scene"), "scene", "embedding", 8)
