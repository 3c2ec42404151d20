"""Tables that iterative operators write between rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a local one only where none is set and all tasks run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quiltgraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: no lineage, and no loss with an executor."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`cut`, and aggregates over the same rows from the same job."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(k) for k, c in measures.items()]))
    return out, seen.get


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`cut` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {re.sub(r"/[^/]*$", "", f) for f in df.inputFiles()}:
            if "/round-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
