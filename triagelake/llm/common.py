"""What the corpus operators share: the shared folder, materialised tables and skew-safe joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in this many; so at most this many keys are hot.
HOT_ONE_IN = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            folder = found.get()
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="triagelake-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/triagelake/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there and a lost executor costs nothing.

    Its path is noted in `scratch`, for drop_tables once nothing reads it any more.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, scratch: list[str]) -> None:
    """Removes tables that materialise wrote, and empties the list."""
    for path in scratch:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
    scratch.clear()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, in whatever case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def hot_only(groups: DataFrame, total: int) -> DataFrame:
    """The groups with more than total / HOT_ONE_IN rows (column n); there are fewer than HOT_ONE_IN of them."""
    return groups.filter(F.col("n") * HOT_ONE_IN > F.lit(total))


def attach_by_key(rows: DataFrame, groups: DataFrame, key: str, values: list[str], total: int, spread: Column) -> DataFrame:
    """Left-joins columns of `groups` (one row a key, n rows of `rows` have it) to `rows`, without a hot partition.

    Hot keys come by broadcast: by their definition there are fewer than HOT_ONE_IN of them. The rest is a shuffle
    join in which no key has more than total / HOT_ONE_IN rows; rows that are served already go there under keys of
    their own, dealt by `spread`, so that they don't meet in one partition. Null keys get nulls.
    """
    hot = hot_only(groups, total).select(F.col(key).alias("__hk"), F.struct(*values).alias("__hot"))
    cold = groups.filter(F.col("n") * HOT_ONE_IN <= F.lit(total)).select(F.concat(F.lit("k"), F.col(key)).alias("__ck"), F.struct(*values).alias("__cold"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left")
    own = F.concat(F.lit("x"), F.coalesce(F.xxhash64(spread), F.lit(0)).cast("string"))
    out = out.withColumn("__ck", F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), own).otherwise(F.concat(F.lit("k"), F.col(key))))
    out = out.join(cold, "__ck", "left").withColumn("__v", F.coalesce("__hot", "__cold"))
    return out.select(*rows.columns, *(F.col(f"__v.{v}").alias(v) for v in values))
