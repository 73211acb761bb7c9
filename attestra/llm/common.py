"""What the corpus operators share: Arrow column helpers; tables in the shared folder and components come from the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from attestra.operators.graphs import connected_components, materialize, shared_folder

__all__ = ["byte_choices", "byte_values", "connected_components", "map_rows", "materialize", "run_bounds", "shared_folder"]


def byte_values(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType, rows: int = 512) -> DataFrame:
    """mapInArrow over the named columns, `rows` rows at a time so that a batch of very long texts stays small. `make` builds the function once a task."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                work = work or make()
                yield work(batch.slice(at, rows))

    return df.select(*columns).mapInArrow(over, schema)


def run_bounds(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def byte_choices(n: int, k: int) -> list[tuple[int, ...]]:
    return list(combinations(range(n), k))
