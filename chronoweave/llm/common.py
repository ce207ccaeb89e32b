"""Shared helpers: shared-folder tables, fold predicates, Arrow batch settings."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text handed to Python at once. Texts average a few kB and may reach
#: some MB, so a batch stays within tens of MB.
TEXT_BATCH_ROWS = 512

#: The batch size that each session had before it was first set here.
_own_batch: dict[int, int] = {}

#: ASCII white space that separates words: space and 0x09-0x0D.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Set the session's Arrow batch size to ``rows``, or to the user's own where that is smaller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = _own_batch.setdefault(id(spark), int(spark.conf.get(key)))
    spark.conf.set(key, str(rows if own <= 0 else min(own, rows)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where none is set and all
    tasks run in the driver's process (as in local tests) a temporary folder is
    made and set.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="chronoweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


def table(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: whatever reads the result survives the loss of any
    executor. Returns the new DataFrame and its path (for :func:`drop_table`);
    what is not dropped before goes when the driver ends.
    """
    path = f"{shared_dir(spark)}/chronoweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table made by :func:`table` that no live plan reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def own_batches(spark: SparkSession) -> None:
    """Give the session the batch size back that it had before :func:`small_batches`."""
    if id(spark) in _own_batch:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_own_batch.pop(id(spark))))


def q(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(keep: Sequence[str], own: Sequence[str]) -> tuple[list[Column], list[str], list[Column]]:
    """Columns to take through a Python stage beside its ``own`` results: (them under inner names, these names, them renamed back).

    One that is named like a result comes back as ``kept_`` and its name.
    """
    inner = [f"__k{i}" for i in range(len(keep))]
    into = [q(c).alias(i) for c, i in zip(keep, inner, strict=True)]
    return into, inner, [F.col(i).alias(f"kept_{c}" if c in own else c) for c, i in zip(keep, inner, strict=True)]


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see that finished jobs' shuffle files have no reader any more."""
    gc.collect()
    spark._jvm.System.gc()


def packed(x: np.ndarray) -> bytes:
    """The array's bytes, compressed."""
    return pa.Codec("zstd").compress(x.tobytes(), asbytes=True) if x.nbytes else b""


def unpacked(b: bytes, n: int, kind: type) -> np.ndarray:
    """The ``n`` numbers of type ``kind`` that :func:`packed` wrote."""
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.Codec("zstd").decompress(b, size, asbytes=True), kind) if n else np.zeros(0, kind)
