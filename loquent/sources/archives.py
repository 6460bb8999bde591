"""Chats in ZIP archives: their entries as rows, and archives made of rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: The largest entry and the largest sum of entries of one archive, in bytes.
ENTRY_BYTES, ARCHIVE_BYTES = 256 << 20, 1 << 30


def safe_name(name: str) -> bool:
    """Whether an entry stays inside the folder that it is unpacked to."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ":" not in parts[0] and ".." not in parts


def unpacked(archive: bytes) -> Iterator[tuple[str, bytes | None, str]]:
    """Name, content and state of each entry; entries that are too large or lead elsewhere are told but not read."""
    try:
        held = zipfile.ZipFile(io.BytesIO(archive))
    except zipfile.BadZipFile:
        yield "", None, "unreadable"
        return
    total = 0
    for entry in held.infolist():
        if entry.is_dir():
            continue
        if not safe_name(entry.filename):
            yield entry.filename, None, "unsafe"
        elif entry.file_size > ENTRY_BYTES or total + entry.file_size > ARCHIVE_BYTES:
            yield entry.filename, None, "too large"
        else:
            total += entry.file_size
            try:
                yield entry.filename, held.read(entry), "ok"
            except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError):
                yield entry.filename, None, "unreadable"


def entries(archives: DataFrame) -> DataFrame:
    """archive, file, content and state of each entry of ``archives`` (archive, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["archive"], part["content"]):
                for file, data, state in unpacked(bytes(content)):
                    yield pd.DataFrame([(name, file, data, state)], columns=["archive", "file", "content", "state"])

    return archives.select("archive", "content").mapInPandas(run, "archive string, file string, content binary, state string")


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return entries(files.select(F.col("path").alias("archive"), "content"))


@F.pandas_udf(BinaryType())
def zipped(names: pd.Series, contents: pd.Series) -> pd.Series:
    """An archive with one entry of that name."""

    def pack(name: str, content: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as held:
            held.writestr(name, content)
        return out.getvalue()

    return pd.Series([pack(n, c) for n, c in zip(names, contents)])
