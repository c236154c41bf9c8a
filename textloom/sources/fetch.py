"""Files from a list of addresses, fetched by many tasks into a folder that all machines share.

A file that is there already is left alone. One that isn't comes under a name of its own first and is renamed when it is whole, so a task that is lost or run twice
leaves no half of a file. Addresses are those that Python's urllib opens (http, https, file).
"""

from __future__ import annotations

import io
import re
import time
import urllib.request
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ATTEMPTS = 5
FETCHED = "name string, bytes long, skipped boolean, error string"


def opened(uri: str):
    """The file system of a folder, and its path there."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def fetch(files: DataFrame, folder: str, *, attempts: int = ATTEMPTS, wait: float = 1.0, tasks: int = 8) -> DataFrame:
    """A row for each of ``files`` (url, name): name, bytes, skipped (it was there) and error (null if the file is there now). After the k-th failure a task waits
    ``wait`` times 2 to the power of k seconds. Lazy: files come when the result is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(url, name, folder, attempts, wait) for url, name in zip(b["url"], b["name"], strict=True)], columns=["name", "bytes", "skipped", "error"])

    return files.select("url", "name").repartition(tasks).mapInPandas(run, FETCHED)


def one(url: str, name: str, folder: str, attempts: int, wait: float) -> tuple:
    from pyarrow.fs import FileType

    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    there = fs.get_file_info(f"{path}/{name}")
    if there.type == FileType.File:
        return name, there.size, True, None
    part, error = f"{path}/.{name}.{uuid.uuid4().hex}.part", ""
    for k in range(attempts):
        if k:
            time.sleep(wait * 2 ** (k - 1))
        try:
            with urllib.request.urlopen(url, timeout=60) as source, fs.open_output_stream(part, compression=None) as target:  # noqa: S310  addresses are the caller's
                while block := source.read(1 << 20):
                    target.write(block)
            fs.move(part, f"{path}/{name}")
            return name, fs.get_file_info(f"{path}/{name}").size, False, None
        except OSError as e:
            error = str(e)
    if fs.get_file_info(part).type == FileType.File:
        fs.delete_file(part)
    return name, None, False, error


def unpack(spark: SparkSession, archive: str, folder: str) -> list[str]:
    """The files of a zip archive, written below the folder: their names. For bundles that one machine can hold; names that lead out of the folder are an error."""
    own = spark.read.format("binaryFile").load(archive).select("content").first().content
    fs, path = opened(folder)
    names = []
    with zipfile.ZipFile(io.BytesIO(bytes(own))) as z:
        for entry in z.infolist():
            if entry.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", entry.filename):
                raise ValueError(f"not below the folder: {entry.filename}")
            if entry.is_dir():
                continue
            fs.create_dir(f"{path}/{entry.filename}".rpartition("/")[0], recursive=True)
            with z.open(entry) as source, fs.open_output_stream(f"{path}/{entry.filename}", compression=None) as target:
                while block := source.read(1 << 20):
                    target.write(block)
            names.append(entry.filename)
    return names
