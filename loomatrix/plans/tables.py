"""Tables written between steps, and numbering without a single-task window."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder in spark.checkpoint.dir, which the driver and all executors see.

    It goes when the driver's JVM ends, also after the session was stopped. Where the
    setting is missing, local mode takes a temporary folder of this machine; a cluster
    is refused.
    """
    context = spark.sparkContext
    found = getattr(context, "_loomatrix_folder", None)
    if found is None:
        top = context.getConf().get("spark.checkpoint.dir")
        if not top:
            if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="loomatrix-")
        found = context._loomatrix_folder = f"{top.rstrip('/')}/loomatrix-{uuid.uuid4().hex}"
        where = context._jvm.org.apache.hadoop.fs.Path(found)
        files = where.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
    return found


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing stands at yet."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back.

    This cuts the lineage: a lost executor costs no recomputation of what stands in the
    table. The table goes with the shared folder.
    """
    path = new_path(df.sparkSession, "step")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a partition that tables are dealt into, about.
DEALT_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by the hash of keys, in as many partitions as its number of rows asks for (`rows`, or a
    bound): a larger table makes more tasks, not larger ones."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // DEALT_ROWS)), *keys)


def bucket_width(n: int) -> int:
    """Buckets of about the root of n keys: as many buckets as keys in one."""
    return max(1, math.isqrt(max(1, n)))


def running_sum(df: DataFrame, key: str, value: Column, n: int, into: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of value over all smaller keys (0 <= key < n, unique in its group), as `into`.

    Sums of buckets of neighbouring keys are added up first, then keys within a bucket,
    so that no window holds more than about the root of n rows.
    """
    bucket = F.expr(f"`{key}` div {bucket_width(n)}")
    df = df.withColumn("__b", bucket).withColumn("__v", value)
    before = lambda *part: Window.partitionBy(*part) if part else Window.partitionBy()
    sums = df.groupBy(*groups, "__b").agg(F.sum("__v").alias("__t"))
    ahead = before(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__o", F.coalesce(F.sum("__t").over(ahead), F.lit(0))).drop("__t")
    within = before(*groups, "__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("__w", F.coalesce(F.sum("__v").over(within), F.lit(0))).join(sums, [*groups, "__b"])
    return out.withColumn(into, F.col("__o") + F.col("__w")).drop("__b", "__v", "__o", "__w")


def ranked(df: DataFrame, groups: list[str], order: list, coarse: Column, into: str) -> DataFrame:
    """Adds each row's rank (from 0) in its group by order, as `into`.

    coarse must not fall as the order rises; rows are ranked among those of one coarse
    value, and the counts of smaller coarse values in the group are added. So a group
    with a large share of all rows is spread over tasks.
    """
    df = df.withColumn("__c", coarse)
    counts = df.groupBy(*groups, "__c").agg(F.count("*").alias("__t"))
    window = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__o", F.coalesce(F.sum("__t").over(window), F.lit(0))).drop("__t")
    fine = Window.partitionBy(*groups, "__c").orderBy(*order)
    out = df.withColumn("__r", F.row_number().over(fine) - 1).join(counts, [*groups, "__c"])
    return out.withColumn(into, (F.col("__o") + F.col("__r")).cast("long")).drop("__c", "__o", "__r")
