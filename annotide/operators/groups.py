"""Numpy kernels for small groups: many groups in one Arrow batch, none split."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def by_group(
    df: DataFrame, keys: list[str], kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str | T.StructType, order: list[str] | None = None
) -> DataFrame:
    """``kernel`` over the rows of each group, as arrays by column, sorted by keys and ``order``.

    Groups meet by one shuffle on the keys.  A task streams its sorted
    batches and cuts them where a key changes, so it holds one batch and one
    group, and a group costs a function call instead of a frame.  Keys are
    whole numbers.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    shape = to_arrow_schema(out)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def result(columns: dict[str, np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            made = [kernel({n: c[a:b] for n, c in columns.items()}) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[f.name] for m in made]), f.type) for f in shape], schema=shape)

        def joined() -> dict[str, np.ndarray]:
            return held[0] if len(held) == 1 else {n: np.concatenate([h[n] for h in held]) for n in names}

        def edges(columns: dict[str, np.ndarray]) -> np.ndarray:
            size = len(columns[names[0]])
            change = np.zeros(max(0, size - 1), bool)
            for k in keys:
                change |= columns[k][1:] != columns[k][:-1]
            return np.concatenate([[0], np.flatnonzero(change) + 1, [size]])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({n: c.to_numpy(zero_copy_only=False) for n, c in zip(names, batch.columns, strict=True)})
            columns = joined()
            cuts = edges(columns)
            yield from result(columns, cuts[:-1])
            held[:] = [{n: c[cuts[-2] :] for n, c in columns.items()}]
        if held:
            columns = joined()
            yield from result(columns, edges(columns))

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, out)
