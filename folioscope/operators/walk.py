"""Ordered walks: a step for each row of a group in order, with a state that is carried from row to row.

Rows are dealt out by key and sorted; a walk goes over Arrow batches and holds one group's state, never its rows. So a group may have any number of rows, and a task any number of groups. A built-in fold over a collected array would hold the whole group, and copy what it appends at each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _plain(column: pa.Array) -> list:
    """A column's values. Numpy takes texts and numbers out as a whole, and to_pylist() one by one."""
    kind = column.type
    whole = pa.types.is_string(kind) or pa.types.is_large_string(kind) or (column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_boolean(kind)))
    return column.to_numpy(zero_copy_only=False).tolist() if whole else column.to_pylist()


def walked(df: DataFrame, by: Sequence[str], order: Sequence[str], make: Callable[[], Callable[[dict], dict | None]], fields: Sequence[T.StructField]) -> DataFrame:
    """A row for each of df's rows for which a step returns values: by, order and the fields. make() returns the step of a new group; a step gets a row's columns by name."""
    schema = T.StructType([*(df.schema[c] for c in (*by, *order)), *fields])
    out_schema, width, kept = to_arrow_schema(schema), len(by), len(by) + len(order)
    rest = [c for c in df.columns if c not in (*by, *order)]
    names, made_names = [*by, *order, *rest], [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for batch in batches:
            # columns are taken apart and put together as wholes: a dict of each row and of each result costs more than most steps
            at_rows: list[int] = []
            out: list[list] = [[] for _ in made_names]
            for i, row in enumerate(zip(*map(_plain, batch.columns))):
                if step is None or row[:width] != at:
                    at, step = row[:width], make()
                if (made := step(dict(zip(names, row)))) is not None:
                    at_rows.append(i)
                    for values, name in zip(out, made_names):
                        values.append(made[name])
            own = [c.cast(f.type) for c, f in zip(batch.select(range(kept)).take(pa.array(at_rows, pa.int64())).columns, out_schema)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, out_schema.field(n).type) for v, n in zip(out, made_names))], schema=out_schema)

    return df.select(*names).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
