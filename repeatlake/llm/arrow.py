"""Small helpers for operators that run Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]]) -> DataFrame:
    """``mapInArrow`` where ``make()`` runs once a task and returns what turns a batch into column dictionaries."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    kinds = [arrow_type(f.dataType) for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for out in each(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=k) for n, k in zip(names, kinds)], names=names)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch, null as empty, decoded one at a time."""
    for value in batch.column(batch.schema.get_field_index(column)):
        yield value.as_py() or ""


def plain_text(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty) of ``df``, whatever else it has."""
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
