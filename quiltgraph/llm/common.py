"""Helpers shared by the training-data operators.

Rows of a table are never assumed to have unique ids: operators compute a row's result in the row's own
task, or key on its content, so repeated rows and null ids keep one result each.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of op4, op7, op9 and op3: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Words of op5 and op8: ASCII digits, ASCII letters and everything above ASCII.
_WORD_CHARS = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: bytes.translate table: A-Z to lower case, separators to a space.
WORD_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_CHARS else 0x20 for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of op5 and op8, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder that the session names (set here only where unset, as in tests)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="quiltgraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and outlives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {re.sub(r"/[^/]*$", "", f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished stages now instead of at the next driver GC.

    Python releases its handles on JVM objects in a thread of its own, so there is a pause before the JVM collects.
    """
    import gc
    import time

    for _ in range(2):
        gc.collect()
        time.sleep(0.4)
        spark._jvm.System.gc()
    time.sleep(0.4)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)
