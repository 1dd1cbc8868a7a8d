"""Ordered folds: state machines over the sorted rows of each key, in bounded memory for keys of any length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Rows of a key meet in one partition in order and stream through ``step(state, row) -> (state, output row)``,
    from ``start(row)`` of the key's first row. One key's rows are worked on one after the other, as their order asks."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, fresh = None, None, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if fresh or row[key] != current:
                    current, state, fresh = row[key], start(row), False
                state, made = step(state, row)
                out.append(made)
            if out:
                yield pa.record_batch({n: pa.array([o[n] for o in out], kinds[n]) for n in names})

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
    kinds = {part.split()[0]: kinds[part.split()[1]] for part in schema.split(", ")}
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
