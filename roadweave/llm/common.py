"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def arrow_rows(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], dict[str, pa.Array | list]]) -> DataFrame:
    """Map Arrow batches to Arrow batches; `make` returns the columns of `schema` by name."""
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out, prefers_large_types=False)
        for batch in batches:
            if batch.num_rows:
                columns = make(batch)
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for f in target for c in [columns[f.name]]],
                    schema=target,
                )

    return df.mapInArrow(run, out)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text, empty for null; the bytes are not decoded."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and \\t \\n \\v \\f \\r, unchanged."""
    return text.split()
