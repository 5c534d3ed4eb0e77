"""Model slots: a user-supplied vectorised function inside a Spark plan.

A slot has a factory that builds the model, called once per Python worker, and a function on
pandas series. Only the slot's inputs travel to Python; all other columns stay in the JVM. A row
whose inputs are null is passed over, so a condition in the plan decides which rows a model sees. A call gets a
bounded piece of a batch, so that values and results of one piece alone are in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sonaria.functions.pieces import pieces

# What to do with rows a model failed on.
RECORD, KEEP_INPUT, DROP, RAISE = "record", "keep_input", "drop", "raise"

_MODELS: dict[str, Callable] = {}


@dataclass(frozen=True)
class Slot:
    """``factory()`` returns a function of pandas series giving one value per row."""

    name: str
    output_type: str
    factory: Callable[[], Callable[..., pd.Series]]


def _model(slot: Slot) -> Callable:
    if slot.name not in _MODELS:
        _MODELS[slot.name] = slot.factory()
    return _MODELS[slot.name]


def _apply(model: Callable, inputs: list[pd.Series]) -> tuple[list, list]:
    """Values and errors; a failing batch is repeated row by row to find the bad rows."""
    count = len(inputs[0])
    values: list = [None] * count
    errors: list = [None] * count
    present = np.flatnonzero(np.logical_and.reduce([s.notna().to_numpy() for s in inputs]))
    rows = [s.iloc[present] for s in inputs]
    if len(present):
        try:
            for at, value in zip(present, model(*rows), strict=True):
                values[at] = value
        except Exception:
            for n, at in enumerate(present):
                try:
                    values[at] = next(iter(model(*[s.iloc[[n]] for s in rows])))
                except Exception as error:
                    values[at], errors[at] = None, repr(error)
    return values, errors


def call(slot: Slot, *inputs: Column) -> Column:
    """struct<value, error> of the slot over the input columns."""
    slot_ref = slot
    schema = StructType.fromDDL(f"value {slot.output_type}, error string")
    value_type = to_arrow_type(schema["value"].dataType)

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(slot_ref)
        for batch in pieces(batches):
            series = [batch.field(i).to_pandas() for i in range(batch.type.num_fields)]
            values, errors = _apply(model, series)
            yield pa.StructArray.from_arrays(
                [pa.array(values, value_type, from_pandas=True), pa.array(errors, pa.string())],
                names=["value", "error"],
            )

    names = [f"a{i}" for i in range(len(inputs))]
    return run(F.struct(*[c.alias(n) for c, n in zip(inputs, names)]))


def apply(
    df: DataFrame,
    slot: Slot,
    inputs: list[Column],
    output: str,
    on_error: str = RECORD,
    keep: Column | None = None,
) -> DataFrame:
    """Adds ``output`` and, when recording, ``error``.

    record: null value and the error text; keep_input: the value of ``keep`` instead; drop: the
    row goes; raise: the query fails with the error.
    """
    ran = df.withColumn("_slot", call(slot, *inputs))
    value, error = F.col("_slot.value"), F.col("_slot.error")
    if on_error == RECORD:
        return ran.withColumn(output, value).withColumn("error", error).drop("_slot")
    if on_error == KEEP_INPUT:
        return ran.withColumn(output, F.when(error.isNull(), F.coalesce(value, keep)).otherwise(keep)).drop("_slot")
    if on_error == DROP:
        return ran.where(error.isNull()).withColumn(output, F.col("_slot.value")).drop("_slot")
    if on_error == RAISE:
        checked = F.when(error.isNull(), value).otherwise(F.raise_error(error))
        return ran.withColumn(output, checked).drop("_slot")
    raise ValueError(f"unknown error policy {on_error}")
