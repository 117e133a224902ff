"""Shared-storage helpers: every cut of lineage goes through these."""

from __future__ import annotations

import atexit
import gc
import math
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a private one only where that is unset and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _OWN_DIR:
        _OWN_DIR["dir"] = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, _OWN_DIR["dir"], ignore_errors=True)
    return "file://" + _OWN_DIR["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a finished intermediate through Hadoop's file system (works on any store)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Table:
    """A frame written to the shared folder; ``df`` reads it back, ``drop()`` removes the files."""

    def __init__(self, spark: SparkSession, df: DataFrame, name: str):
        self.spark, self.path = spark, fresh_path(spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove_path(self.spark, self.path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no live plan refers to, before the next large stage writes its own."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with underscores added until no column is called so (case apart)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name
