"""Append columns to a table batch by batch, in the tasks that read it: no shuffle, all other columns pass through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ..storage import bound_batches, give_back, ship


def append(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], list], setup: Callable[[], object] | None = None, keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep), then those of ``schema`` with the arrays that ``make`` returns for a batch.

    A column of df whose name, whatever its case, is one of the new names gives way to the new one.  ``setup`` runs
    once a task; its result is then the second argument of ``make``.  Batches are bounded in rows and bytes.
    """
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    new = T.StructType.fromDDL(schema)
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema if f.name.lower() not in names and (keep is None or f.name in keep)]
    at = [df.schema.names.index(f.name) for f in kept]
    out = T.StructType([*kept, *new])
    kinds = [_arrow(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = (setup(),) if setup else ()
        for b in batches:
            made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(make(b, *extra), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in at] + made, out.names)
        give_back()

    return df.mapInArrow(run, out)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
