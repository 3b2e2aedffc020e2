"""Calls from the workers: Arrow batches, a bounded pool of threads for each task, slices so that few answers are held at once."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

AHEAD = 4


def in_threads(df: DataFrame, call: Callable, args: list[str], schema: str, threads: int) -> DataFrame:
    """``df``'s columns and those of ``schema``, in which ``call(*args)`` gives a tuple for each row; ``threads`` calls run at once in a task.

    The calls are opaque to the optimizer, so a row is sent once for each time that the plan runs; order is kept.
    """
    more = T._parse_datatype_string(schema)
    fields = [(f.name, f.type) for f in to_arrow_schema(more)]
    at = [df.columns.index(a) for a in args]

    def plain(value, kind):
        return list(value.items()) if pa.types.is_map(kind) and value is not None else value

    def run(batches):
        with ThreadPoolExecutor(max(1, threads)) as pool:
            for batch in batches:
                for k in range(0, batch.num_rows, AHEAD * max(1, threads)):
                    part = batch.slice(k, AHEAD * max(1, threads))
                    rows = zip(*(part.column(i).to_pylist() for i in at))
                    got = list(pool.map(lambda row: call(*row), rows))
                    new = [pa.array([plain(g[j], t) for g in got], t) for j, (_, t) in enumerate(fields)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *(n for n, _ in fields)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *more.fields]))
