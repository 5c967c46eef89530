"""Tables and array files in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from tidemark.storage import fresh, remove, shuffles_removed, written


__all__ = ["bounded_batches", "fresh", "mapped", "publish", "release", "remove", "shuffles_removed", "written"]

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to a Python worker at once.
BATCH = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on whole texts reach Python workers in batches of bounded bytes, for the whole session; a lower bound stays."""
    named = spark.conf.get(_BATCH, None)
    if not named or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(named) <= BATCH:
        spark.conf.set(_BATCH, str(BATCH))


def release() -> None:
    """Gives a worker's free memory back, as idle workers live on beside the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def publish(folder_uri: str, name: str, *arrays: np.ndarray) -> None:
    """Writes arrays one after another as a file of the shared folder; a retried task replaces it with the same bytes."""
    system, path = _open(folder_uri)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a))
    system.move(part, f"{path}/{name}")


def mapped(folder_uri: str, name: str) -> np.ndarray:
    """A published file's bytes, memory-mapped. One that isn't on a mounted disk is first copied to an unlinked local file."""
    system, path = _open(folder_uri)
    if system.type_name == "local":
        size = os.path.getsize(f"{path}/{name}")
        return np.asarray(np.memmap(f"{path}/{name}", np.uint8, "r")) if size else np.zeros(0, np.uint8)
    with tempfile.TemporaryFile() as local:
        with system.open_input_stream(f"{path}/{name}") as source:
            while chunk := source.read(1 << 22):
                local.write(chunk)
        local.flush()
        return np.asarray(np.memmap(local, np.uint8, "r")) if local.tell() else np.zeros(0, np.uint8)
