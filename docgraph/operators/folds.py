"""Folds over sorted rows: each key's rows pass in order through a task, and only the state of the fold stays in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_rows(df: DataFrame, key: str | list[str], order: list[str | Column], reads: list[str], gives: str, start: Callable[[], object], step: Callable[..., tuple]) -> DataFrame:
    """``df`` with columns ``gives`` (a DDL list): for each key, ``step(state, *row)`` of the columns ``reads`` gives their values, row by row in ``order``.

    ``start()`` makes the state of a new key; ``step`` changes it in place. A key of any number of rows takes the memory of its state alone.
    """
    keys = [key] if isinstance(key, str) else key
    names = [part.split()[0] for part in gives.split(",")]
    like = df.sparkSession.createDataFrame([], gives).schema
    kinds = [pa_type(f.dataType.simpleString()) for f in like.fields]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], gives])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            made = []
            columns = [batch.column(c).to_pylist() for c in reads]
            owners = zip(*[batch.column(k).to_pylist() for k in keys])
            for own, *row in zip(owners, *columns):
                if own != last:
                    last, state = own, start()
                made.append(step(state, *row))
            new = [pa.array(values, kind) for values, kind in zip(zip(*made) if made else [[]] * len(names), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def pa_type(name: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[name]
