"""Fitted models applied to feature tables: any object with ``predict`` over columns that it names.

A scorer declares its input columns and what it gives. It is pickled once and
broadcast, whatever the number of rows; tasks unpickle it once and hand it Arrow
batches as one matrix. Inputs are checked against the table's columns before
anything runs. Rows with a null input get a null score, so that a model never
sees one.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: An object over it is no model to be broadcast: it should be a table that is joined.
MOST_BYTES = 256 << 20
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


@dataclass
class Scorer:
    """A fitted object, the columns that its ``predict`` takes as a matrix in this order, and the Spark type of what it gives."""

    model: Any
    inputs: list[str]
    gives: str = "double"
    kind: T.DataType = field(init=False)

    def __post_init__(self):
        self.kind = T._parse_datatype_string(self.gives)
        if not callable(getattr(self.model, "predict", None)):
            raise TypeError("a scorer needs an object with predict(matrix)")


class Linear:
    """``weights . x + bias``, the simplest fitted object."""

    def __init__(self, weights, bias: float = 0.0):
        self.weights, self.bias = np.asarray(weights, float), float(bias)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


class Registry:
    """Scorers by name."""

    def __init__(self):
        self._all: dict[str, Scorer] = {}

    def add(self, name: str, scorer: Scorer) -> None:
        if name in self._all:
            raise ValueError(f"there is a scorer {name}")
        self._all[name] = scorer

    def score(self, rows: DataFrame, name: str, column: str = "score") -> DataFrame:
        return score(rows, self._all[name], column)


def score(rows: DataFrame, scorer: Scorer, column: str = "score") -> DataFrame:
    """``rows`` with the scorer's prediction as ``column``, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_type

    types = {f.name: f.dataType for f in rows.schema.fields}
    missing = [c for c in scorer.inputs if c not in types]
    odd = [c for c in scorer.inputs if c in types and not isinstance(types[c], _NUMBERS)]
    if missing or odd:
        raise ValueError(f"the table lacks {missing}, and these are no numbers: {odd}")
    if column in types:
        raise ValueError(f"the table has a column {column}")
    content = cloudpickle.dumps(scorer.model)  # which takes classes of a notebook or script along
    if len(content) > MOST_BYTES:
        raise ValueError(f"a model of {len(content)} bytes is too large to be broadcast")
    shipped, names, inputs, kind = rows.sparkSession.sparkContext.broadcast(content), rows.columns, scorer.inputs, to_arrow_type(scorer.kind)
    schema = T.StructType([*rows.schema.fields, T.StructField(column, scorer.kind)])

    def run(batches):
        model = pickle.loads(shipped.value)
        for batch in batches:
            columns = [batch.column(names.index(c)) for c in inputs]
            null = np.zeros(batch.num_rows, bool)
            for c in columns:
                null |= np.asarray(c.is_null())
            x = np.column_stack([np.asarray(c.cast(pa.float64()).fill_null(0.0)) for c in columns]) if columns else np.zeros((batch.num_rows, 0))
            out = np.zeros(batch.num_rows, object)
            out[null] = None
            if not null.all():
                out[~null] = np.asarray(model.predict(x[~null])).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.tolist(), kind)], names=[*names, column])

    return rows.mapInArrow(run, schema)
