"""Tables between the steps of a plan: in the shared folder, so that lost executors lose nothing; and skew-proof joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A group with at least one in this many of all rows is hot; so there are at most this many hot groups.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir, or, with a local master only, one of this
    machine where it is unset (tests). Elsewhere a folder must be named: executors do not see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="deltascape-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str = "part", compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path, compression=compression)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised frame that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Asks the driver for a collection of garbage, upon which Spark deletes the shuffle files of finished steps."""
    spark._jvm.System.gc()


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows inner join groups on key, where groups has one row per key and column size counts its rows.

    Groups with total / HOT_SHARE rows or more number HOT_SHARE at most: these are broadcast, so that a key
    with a third of the rows stays where its rows are. The others meet in a shuffle, where no key is large.
    """
    floor = max(2, -(-total // HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col(size) >= floor).withColumn("_hot", F.lit(True)))
    cold = groups.filter(F.col(size) < floor)
    seen = rows.join(hot, key, "left")
    names = [c for c in groups.columns if c != key]
    found = seen.filter(F.col("_hot").isNotNull()).drop("_hot")
    rest = seen.filter(F.col("_hot").isNull()).drop("_hot", *names)
    return found.unionByName(rest.join(cold, key))


def in_order(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a column that numbers its rows from 1 in a total order.

    The rows are range-sorted into a table; a row's number is its place in its partition behind the counts of the
    partitions before. No task holds more than a partition, but for one row per partition.
    """
    sorted_rows = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialise(sorted_rows.withColumn("_part", F.shiftright("_at", 33)), "ordered")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))  # a row per partition
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_at", "_before")
