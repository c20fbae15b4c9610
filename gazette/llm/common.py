"""What the operators of this subpackage share: tables in the shared folder, text patterns, small expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that all contracts name, for Java's and Python's regular expressions alike.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot from this share of all rows on, and from so many rows.
HOT, LEAST_HOT = 1 / 1_000, 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; where it is unset, one of our own in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gazette-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/gazette/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again: lineage ends there, and a lost executor costs no recomputation of what is before."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file in any store that Spark writes to; `data` is small and on the driver."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def text_groups(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of `column` (strings, binaries or lists) that hold about `most` bytes (of lists: elements), one row at least."""
    sized = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    upto = np.cumsum(sized.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, end - at
        at = end


def hot_keys(keys: DataFrame) -> DataFrame:
    """The keys (key: long) that make HOT of all values of keys' columns (long) or more; at most 4 / 3 / HOT rows, whatever the input.

    Of a batch, keys above a quarter of that share are counted on, less a quarter each. What a key of the share loses so is
    at most a quarter, and no more keys can keep three quarters than the bound says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows * batch.num_columns
            found, n = np.unique(np.concatenate([c.to_numpy(zero_copy_only=False) for c in batch.columns]), return_counts=True)
            over = n - int(rows * HOT / 4)
            much = over > 1
            columns = [[None, *found[much].tolist()], [0, *over[much].tolist()], [rows, *[0] * int(much.sum())]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "n", "rows"])

    counts = keys.mapInArrow(run, "key long, n long, rows long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    counts = materialize(counts, "hot-keys")
    rows = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return counts.filter(F.col("key").isNotNull() & (F.col("n") >= max(LEAST_HOT, 0.75 * HOT * rows))).select("key")


def forget(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    own = "/" + shared_dir(spark).partition(":")[2].lstrip("/") + "/gazette/" if ":" in shared_dir(spark) else shared_dir(spark) + "/gazette/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if own in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body's expressions and lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), "")


def prefix(df: DataFrame) -> str:
    """A prefix that none of df's columns has, in any case; columns of an operator's own are named with it."""
    k = 0
    while any(c.lower().startswith(f"__g{k}_") for c in df.columns):
        k += 1
    return f"__g{k}_"


def quoted(columns) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
