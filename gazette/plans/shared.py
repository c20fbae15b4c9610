"""Tables written between the rounds of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; where it is unset, one of our own in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gazette-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again, so that no later round recomputes it, even after a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/gazette/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that written() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    own = "/" + shared_dir(spark).rpartition(":")[2].strip("/") + "/gazette/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if own in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_path(path: str) -> str:
    """A path as open() takes it; only folders that every machine has mounted have one."""
    scheme, colon, rest = path.partition(":")
    if not colon:
        return path
    if scheme != "file":
        raise ValueError(f"{path} cannot be opened as a file")
    return "/" + rest.lstrip("/")
