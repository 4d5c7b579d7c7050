"""What the first bytes of files tell: their header line, their encoding, and their digest where it is asked for.

Paths are dealt to the tasks, and each task opens its files itself: a header costs one small read, whatever the size of the file,
and no row ever holds a file's contents.
"""

from __future__ import annotations

import codecs
import hashlib
import io
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes looked at to tell the encoding, and the encoding names.
ENCODING_BYTES = 65_536
MARKED, PLAIN, OTHER = "utf-8-sig", "utf-8", "latin-1"

# Tasks carry these helpers with them; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _opened(path: str) -> pyarrow.NativeFile:
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, name = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def encoding_of(head: bytes, whole: bool) -> str:
    """With a byte order mark, valid UTF-8 (a character cut off at the end of the window does not count against it), or Latin-1."""
    if head.startswith(codecs.BOM_UTF8):
        return MARKED
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, final=whole)
    except UnicodeDecodeError:
        return OTHER
    return PLAIN


def first_record(stream: io.BufferedIOBase) -> bytes:
    """Bytes up to the first line end outside quotes, however many they are, that end included."""
    record = stream.readline()
    while record.count(b'"') % 2 and (more := stream.readline()):
        record += more
    return record


def _facts(path: str, digest: bool) -> tuple:
    with _opened(path) as file:
        size = file.size()
        head = file.read(min(ENCODING_BYTES, size))
        encoding = encoding_of(head, size <= ENCODING_BYTES)
        file.seek(0)
        header = first_record(io.BufferedReader(file)) if size else b""
    ended = sha256 = None
    if digest:
        with _opened(path) as file:
            sha256 = hashlib.file_digest(file, "sha256").hexdigest()
            file.seek(max(size - 1, 0))
            ended = file.read(1) == b"\n"
    return path, encoding, header.rstrip(b"\r\n").decode(encoding, errors="replace"), header.endswith(b"\r\n"), size, sha256, ended


def file_heads(paths: DataFrame, digest: bool = False) -> DataFrame:
    """(path, encoding, header, returns, size, sha256, ended) for a table of paths; the last two only with ``digest``, which reads whole files.

    ``returns`` tells whether the header ends with a carriage return and a line feed, ``ended`` whether the last byte is a line feed.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_facts(path, digest) for path in batch["path"]], columns=["path", "encoding", "header", "returns", "size", "sha256", "ended"])

    spread = paths.select("path").repartition(F.col("path"))
    return spread.mapInPandas(read, "path string, encoding string, header string, returns boolean, size long, sha256 string, ended boolean")
