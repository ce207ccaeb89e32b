"""Files through Spark's file systems: what executors can read, the driver sees by the same path."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from ..errors import ConfigError

#: Bytes up to which files whose file system keeps no checksum are read to be hashed.
READ_TO_HASH = 16 << 20


@dataclass(frozen=True)
class File:
    path: str
    size: int
    modified: int


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _at(path: str | Path) -> tuple[Any, Any]:
    """(the path's file system, the path) on the JVM's side."""
    spark = _spark()
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(path: str | Path) -> str:
    """The path with its scheme; one without any is on the session's default file system, relative ones below its working folder."""
    fs, p = _at(path if "://" in str(path) or str(path).startswith("file:") else Path(path).resolve())
    return fs.makeQualified(p).toString()


def exists(path: str | Path) -> bool:
    fs, p = _at(path)
    return fs.exists(p)


def data_files(path: str | Path) -> list[File]:
    """A file, or all files of a folder but hidden ones and markers, by path; none where there is nothing."""
    fs, p = _at(path)
    if not fs.exists(p):
        return []
    out, found = [], fs.listFiles(p, True)
    while found.hasNext():
        s = found.next()
        if not s.getPath().getName().startswith(("_", ".")):
            out.append(File(s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out, key=lambda f: f.path)


def read_bytes(path: str) -> bytes:
    fs, p = _at(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    fs, p = _at(path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def delete(path: str | Path) -> None:
    fs, p = _at(path)
    fs.delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share; deleted when the driver ends.

    The folder is ``spark.checkpoint.dir``; only where none is set and all tasks
    run in the driver's process it is a temporary one.
    """
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ConfigError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share.")
    base = base or tempfile.mkdtemp(prefix="chronoweave-")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, p = _at(folder)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{folder}/{name}"


def _file_hash(f: File, read: bool) -> str:
    """Of the content: the file system's own checksum if it keeps one, else a hash of the bytes, else of size and time."""
    fs, p = _at(f.path)
    own = fs.getFileChecksum(p)
    if own is not None:
        return f"{own.getAlgorithmName()}:{bytes(own.getBytes()).hex()}:{f.size}"
    if not read:
        return f"size and time:{f.size}:{f.modified}"
    if f.path.startswith("file:"):
        h = hashlib.sha256()
        with open(f.path.removeprefix("file://").removeprefix("file:"), "rb") as x:
            while block := x.read(1 << 20):
                h.update(block)
        return h.hexdigest()
    return hashlib.sha256(read_bytes(f.path)).hexdigest()


def content_hash(path: str | Path | None) -> str | None:
    """One hash of a file, or of a folder's data files whatever their names; None where there is none.

    Nothing beyond ``READ_TO_HASH`` bytes is read for it on the driver.
    """
    files = data_files(path) if path is not None else []
    if not files:
        return None
    read = sum(f.size for f in files) <= READ_TO_HASH
    each = [_file_hash(f, read) for f in files]
    return each[0] if len(each) == 1 else hashlib.sha256("".join(sorted(each)).encode()).hexdigest()


def file_size(path: str | Path | None) -> int | None:
    files = data_files(path) if path is not None else []
    return sum(f.size for f in files) if files else None
