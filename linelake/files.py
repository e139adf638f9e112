"""Small files and listings through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    path: str
    size: int
    mtime: int


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def read_json(spark: SparkSession, path: str) -> dict | None:
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write under another name, then rename: readers see the old document or the new one."""
    fs, p = _at(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{p.getParent()}/.{p.getName()}-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(p), how)


def read_bytes(spark: SparkSession, path: str, start: int, length: int) -> bytes:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        stream.seek(start)
        return bytes(stream.readNBytes(length))
    finally:
        stream.close()


def listing(spark: SparkSession, path: str, recursive: bool = False, suffixes: tuple[str, ...] = (".jsonl", ".jsonl.gz")) -> list[Entry]:
    """Data files of a folder, or the file itself; names that begin with ``_`` or ``.`` are no data."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    found, folders = [], [p]
    while folders:
        for s in fs.listStatus(folders.pop()):
            name = s.getPath().getName()
            if s.isDirectory():
                if recursive and not name.startswith(("_", ".")):
                    folders.append(s.getPath())
            elif s.getPath().equals(p) or not name.startswith(("_", ".")) and name.endswith(suffixes):
                found.append(Entry(s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found, key=lambda e: e.path)


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: ``spark.checkpoint.dir``. Where it is unset, one of our own in local mode; on a cluster that is an error."""
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if base:
        return base
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='linelake-')}"
    return _OWN[context.applicationId]


def block_path(base: str, name: str, suffix: str = ".jsonl") -> str:
    """Where a named part of a dataset stands."""
    return f"{base.rstrip('/')}/{name}{suffix if suffix.startswith('.') else '.' + suffix}"
