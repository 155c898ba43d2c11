"""Adds one struct column, made from a text column in Python, beside whatever columns rows have."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .words import tidy


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores before it while df has such a column in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_struct(df: DataFrame, text_col: str, name: str, fields: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """df plus a struct column `name`. make() runs once in each task and returns a function of a list of texts, which gives a tuple of the values of `fields` (DDL) for each."""
    struct = T.StructType.fromDDL(fields)
    kind, names = to_arrow_type(struct), struct.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            found = work(b.column(text_col).to_pylist())
            column = pa.array([dict(zip(names, x, strict=True)) for x in found], type=kind)
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, name])
        tidy()

    wanted = df.withColumn(text_col, F.col(text_col).cast("string"))
    return wanted.mapInArrow(run, T.StructType([*wanted.schema.fields, T.StructField(name, struct)]))
