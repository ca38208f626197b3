"""Files that driver and executors share: they live under ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, what: str) -> str:
    """URI of a new folder under the session's shared folder. Where none is set, a folder of our own, if all workers
    are on this machine; on a cluster that is an error."""
    base = spark.sparkContext.getConf().get(KEY) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{KEY} must name a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="wavespark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{_uri(base).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _uri(path: str) -> str:
    path = re.sub(r"^file:/+", "file:///", path)
    return path if "://" in path else "file://" + os.path.abspath(path)


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(_uri(uri))


def write_bytes(uri: str, *parts) -> int:
    """Write a file whole, then give it its name: a second attempt at a task never sees half a file."""
    store, path = resolve(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as out:
        for x in parts:
            out.write(x)
        size = out.tell()
    store.move(part, path)
    return size


def read_bytes(uri: str) -> bytes:
    store, path = resolve(uri)
    with store.open_input_file(path) as f:
        return f.read()


def write_array(uri: str, a: np.ndarray) -> None:
    import io

    a = np.ascontiguousarray(a)
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(a))
    write_bytes(uri, head.getvalue(), a.data.cast("B") if a.size else b"")


def map_array(uri: str) -> np.ndarray:
    """Memory-map a NPY file of the shared folder. From a store that can't be mapped it is fetched into a
    nameless temporary file first."""
    store, path = resolve(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    fd, own = tempfile.mkstemp()
    try:
        with os.fdopen(fd, "wb") as out, store.open_input_stream(path, compression=None) as f:
            while block := f.read(1 << 22):
                out.write(block)
        return np.load(own, mmap_mode="r")
    finally:
        os.unlink(own)


def table(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    at = shared_dir(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
