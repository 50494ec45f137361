"""Row functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def flat_map(df: DataFrame, make: Callable[[], Callable[[list[dict]], Iterable[tuple]]], schema: str) -> DataFrame:
    """df through a function of one batch of rows (dicts) that yields output tuples.

    ``make`` runs once a task, so that tables and automata are built there and not pickled. Batches are
    handled in slices, which bounds the memory for very long texts.
    """
    kind: StructType = _parse_datatype_string(schema)  # type: ignore[assignment]
    arrow = to_arrow_schema(kind)
    names = arrow.names
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                function = function or make()
                columns: list[list] = [[] for _ in range(width)]
                for row in function(batch.slice(start, 2000).to_pylist()):
                    for values, value in zip(columns, row):
                        values.append(value)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], names=names)

    return df.mapInArrow(run, kind)
