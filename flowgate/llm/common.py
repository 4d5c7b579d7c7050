"""What several operators of this folder share: whole texts in Arrow batches, row identity, fresh column names."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts are handed on in slices of about this many bytes, however long one batch is.
SLICE_BYTES = 8 << 20

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}


_KEPT: list = []


def kept(key: tuple, make: Callable):
    """``make()``, kept in this worker until another table is asked for: a worker that goes on with another stage holds one table at most."""
    if not _KEPT or _KEPT[0] != key:
        _KEPT.clear()
        _KEPT.extend([key, make()])
    return _KEPT[1]


def release() -> None:
    """Gives back what earlier stages left in this worker: its table, and memory that Arrow holds for later."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` already has a column of that name (case does not count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: str | Column) -> Column:
    """64 bits of a text; with the row's own id it names a row's content. Equal rows share it, by design."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about SLICE_BYTES of that column (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def with_fields(df: DataFrame, column: str, compute: Callable[[list], Sequence], fields: Sequence[tuple[str, str]]) -> DataFrame:
    """All rows and columns of ``df`` with the fields that ``compute`` makes of the whole texts of one column.

    ``compute`` gets a list of texts (None where null) and returns one sequence per field. Fields must not clash.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.DataType.fromDDL(t)) for n, t in fields])
    types = [ARROW[t] for _, t in fields]
    names = [*df.columns, *(n for n, _ in fields)]

    def rows(batches):
        for batch in slices(batches, column):
            made = compute(batch.column(column).to_pylist())
            arrays = [pa.array(values, type=kind) for values, kind in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return df.mapInArrow(rows, schema)


def from_texts(df: DataFrame, column: str, make: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Any number of rows from each slice; ``make`` gets a record batch and returns one sequence per column of ``schema``."""
    fields = T.DataType.fromDDL(schema).fields
    types = [(f.name, ARROW[_ddl(f.dataType)]) for f in fields]

    def rows(batches):
        for batch in slices(batches, column):
            made = make(batch)
            yield pa.RecordBatch.from_arrays([pa.array(made[n], type=t) for n, t in types], names=[n for n, _ in types])

    return df.mapInArrow(rows, T.StructType(fields))


def _ddl(kind: T.DataType) -> str:
    return kind.simpleString().replace("bigint", "long")
