"""What the operators share: table access, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: White space that separates words, in every word-based contract here: space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Workers turn about so many bytes of text into Python or numpy objects at a time (one row at least), whatever a batch holds.
BLOCK = 1 << 20
#: A written table's files hold about so many bytes: the smaller until every core has two files, the larger from there on.
SMALL_FILE, FILE = 256 << 10, 8 << 20
#: A filter of ids has about so many bits an id, and so many (32 MB) in all at most.
ID_BITS, FILTER_BITS = 32, 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where that is unset, one of our own in local mode only."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("websift.shared.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="websift-shared-")
        spark.conf.set("websift.shared.dir", conf)
    return conf.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def plan_bytes(df: DataFrame) -> int:
    """The planner's size of a frame: for a written table the bytes of its files, at most its columns' part of them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized(df: DataFrame, *sources: DataFrame) -> DataFrame:
    """df in as many partitions as its sources' bytes ask for, where a shuffle has left it in more.

    A shuffle's number of partitions is a setting and not a size; written as they are, small tables would become many
    tiny files, each of which costs several calls of the file system. Larger tables keep their partitions.
    """
    size = sum(map(plan_bytes, sources))
    busy = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(min((1 << 31) - 1, max(1, -(-size // FILE), min(busy, -(-size // SMALL_FILE)))))


def materialize(df: DataFrame, name: str, *sources: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, and gives the planner real sizes.

    With the written tables that df was made from, the number of files follows their size.
    """
    path = fresh_path(df.sparkSession, name)
    (sized(df, *sources) if sources else df).write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked(df: DataFrame, id_col: str, ids: DataFrame, mark: str, most: int = FILTER_BITS) -> DataFrame:
    """df with a boolean column: true where the row's id is one of `ids`, a written table of one column, false for nearly all others.

    The ids become a map of hashed bits, 4 bytes an id, which is broadcast, so that wide rows are told apart where they
    are read and only the marked ones need meet the ids themselves. About one of 32 other ids is marked too; more of
    them where the ids are so many that the map stops at `most` bits. Null ids are marked as any other value is.
    """
    bits = min(most, ID_BITS * max(1, ids.count()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    own = ids.select(place(F.col(ids.columns[0]).cast(df.schema[id_col].dataType)).alias("_place"))
    maps = own.groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_map"))
    at = F.bitmap_bit_position(place(id_col))
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("_bucket", F.bitmap_bucket_number(place(id_col))).join(F.broadcast(maps), "_bucket", "left")
    return met.select(*df.columns, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(mark))


def drop_table(*tables: DataFrame) -> None:
    """Delete the files behind materialized tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def finished(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """df as a written table, after which the tables it was made from are deleted; for results of a few numbers a row."""
    out = materialize(df, name, *used)
    drop_table(*used)
    return out


def slices(batch: pa.RecordBatch, *columns: int, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch whose given text or binary columns hold about `size` bytes together, one row at least."""
    total = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        total += np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), np.int64)
    ends = np.cumsum(total)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column) -> "F.Column":
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def widened(schema: StructType, **columns: str | DataType) -> StructType:
    """A copy of a schema with columns added (StructType.add would change the frame's own)."""
    out = StructType(list(schema.fields))
    for name, kind in columns.items():
        out.add(name, kind)
    return out


def without(df: DataFrame, *added: str) -> DataFrame:
    """df less the columns that an operator is about to add: a column of such a name is replaced, as withColumn does."""
    names = {a.lower() for a in added}
    clash = [c for c in df.columns if c.lower() in names]
    return df.drop(*clash) if clash else df
