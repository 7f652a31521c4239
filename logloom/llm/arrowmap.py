"""Arrow batches in, the same rows with further columns out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import ship

#: From a batch to one array for each new column.
BatchFn = Callable[[pa.RecordBatch], Sequence[pa.Array]]


#: A text column by its name, or a field of a struct column by its name and the field's number.
Place = str | tuple[str, int]


def column_of(batch: pa.RecordBatch, place: Place) -> pa.Array:
    if isinstance(place, str):
        return batch.column(batch.schema.get_field_index(place))
    return batch.column(batch.schema.get_field_index(place[0])).field(place[1])


def packed(docs: DataFrame, text: str = "text") -> tuple[DataFrame, Place]:
    """Whole rows as the one column __row, whatever their columns' names, and where the text is in it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")), ("__row", docs.columns.index(text))


def extended(docs: DataFrame, fields: Sequence[T.StructField], make: Callable[[], BatchFn], drop: Sequence[str] = ()) -> DataFrame:
    """Adds columns that ``make()``'s function computes from each Arrow batch.

    make runs once in each task.  Columns of docs that bear a new column's name
    (case aside, as Spark resolves names) are replaced; ``drop`` lists columns
    that the function reads but the result leaves out.  Rows keep their order
    and number.
    """
    ship(docs.sparkSession)
    new = {f.name.lower() for f in fields}
    needed = {c.lower() for c in drop}
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in new or c.lower() in needed])
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in needed]
    schema = T.StructType([docs.schema[i] for i in kept] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                made = list(fn(batch))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + made, names=schema.names)

    return docs.mapInArrow(run, schema)
