"""Plans of loops and of tables that several branches read, kept short; and the spread of small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The frame written once and read back, without its history and with its real size.

    The table goes to spark.checkpoint.dir, which driver and executors share; in local mode alone, a temporary folder
    stands in where that is unset.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("websift.cut.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="websift-cut-")
        spark.conf.set("websift.cut.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose value is computed once a row.

    A plain column's expression is copied into every filter, join key and projection that reads it, and filters move it
    below exchanges and groupings, to many more rows. The only element of an array, exploded, stays where it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


#: Bytes of files that a task reads by itself.
SPLIT = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cores where the input is too small to give each of them a split of its own.

    A file can't be read by more tasks than it has row groups, so that a small one keeps all but one core idle through
    the parse of its texts. Larger inputs stay as they are: no row of theirs is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT else df
