"""Files in folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from . import packed


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a folder of our own only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="epiframe-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _located(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri("file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


def open_out(uri: str):
    """A binary output stream, which packs a file whose name says so; parent folders are made."""
    system, path = _located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    out = system.open_output_stream(path, compression=None)
    return packed.PackedOut(out) if path.endswith(packed.SUFFIX) else out


def open_in(uri: str):
    """A binary input stream."""
    system, path = _located(uri)
    return system.open_input_stream(path, compression=None)


def open_at(uri: str):
    """A binary input that can be read from any place; of a packed file, the plain one."""
    system, path = _located(uri)
    file = system.open_input_file(path)
    return packed.PackedIn(file, uri) if path.endswith(packed.SUFFIX) else file


def make_folder(uri: str) -> None:
    """A folder, if it is not there already."""
    system, path = _located(uri)
    system.create_dir(path, recursive=True)


def remove(uri: str) -> None:
    """Delete a folder and what it holds."""
    system, path = _located(uri)
    system.delete_dir(path)
