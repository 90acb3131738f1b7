"""Sequential work per key without a Python call per group: rows are partitioned and sorted by key, and a task walks
through its runs of equal keys batch by batch. Only the run at a batch's end is held over."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Columns = dict[str, np.ndarray]


def _values(c: pa.ChunkedArray) -> np.ndarray:
    return c.to_numpy() if not pa.types.is_timestamp(c.type) else c.cast(pa.int64()).to_numpy()


def map_runs(df: DataFrame, key: str, order: list[str], work: Callable[[Columns], Columns], schema: str) -> DataFrame:
    """``work`` on the columns of each key's rows, in order; NULL numbers are NaN, times are integers of their unit."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        batches = iter(batches)
        done = False
        while not done:
            got = next(batches, None)
            done = got is None
            parts = [t for t in (held, pa.Table.from_batches([got]) if got is not None else None) if t is not None and t.num_rows]
            if not parts:
                continue
            t = pa.concat_tables(parts).combine_chunks()
            codes = t[key].combine_chunks().dictionary_encode(null_encoding="encode")
            codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
            ends = np.concatenate([starts[1:], [t.num_rows]])
            held = None
            if not done:
                held = t.slice(int(starts[-1]))
                starts, ends = starts[:-1], ends[:-1]
            columns = {c: _values(t[c]) for c in t.column_names}
            out = [work({c: v[a:b] for c, v in columns.items()}) for a, b in zip(starts, ends, strict=True)]
            if out:
                yield from pa.table({f.name: pa.array(np.concatenate([o[f.name] for o in out]), from_pandas=True).cast(f.type) for f in arrow}, schema=arrow).to_batches()

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)
