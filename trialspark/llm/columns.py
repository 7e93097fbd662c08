"""Columns computed from the ``text`` of a table, whatever its other columns are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from trialspark.llm.arrays import SLICE_BYTES, slices


def from_text(
    docs: DataFrame,
    added: str,
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
    part_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``docs`` with the columns of the schema text ``added``, which replace columns of their names.

    ``compute`` gets batches with the one column ``text``, of about ``part_bytes`` bytes
    each, and returns the new columns. The other columns go through by position, so odd
    or repeated names do no harm.
    """
    new = StructType.fromDDL(added)
    return _through(docs.drop(*new.names), new.fields, compute, part_bytes)


def with_text(docs: DataFrame, compute: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``docs`` with its ``text`` computed anew, all other columns as they are."""
    return _through(docs, [], lambda part: [compute(part)], SLICE_BYTES, replace=True)


def _through(docs: DataFrame, new: list[StructField], compute, part_bytes: int, replace: bool = False):
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    added = [field.name for field in new]
    out_names = [*names, *(f"new{i}" for i in range(len(new)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, names[at], part_bytes):
                text = pa.RecordBatch.from_arrays([part.column(at)], ["text"])
                made, columns = compute(text), list(part.columns)
                if replace:
                    columns[at] = made.pop()
                yield pa.RecordBatch.from_arrays([*columns, *made], out_names)

    kept = [StructField(name, field.dataType, True) for name, field in zip(names, docs.schema)]
    fresh = [StructField(name, field.dataType, True) for name, field in zip(out_names[len(names) :], new)]
    return plain.mapInArrow(run, StructType([*kept, *fresh])).toDF(*docs.columns, *added)
