"""Greedy folds over the rows of a group, for what no join or window can say.

Rows are dealt by key once and sorted, and each task runs through its groups one after another in plain Python, so many
small groups cost little. A group (a song or a page) has to fit in memory, unless its fold takes the rows in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_groups(df: DataFrame, keys: list[str], columns: list[str], schema: str, fold: Callable[[Iterable[dict]], Iterable[tuple]], batch: int = 20_000, order: list | None = None, dealt: bool = False) -> DataFrame:
    """keys and schema: what `fold` makes of each group's rows: a list in no particular order or, with `order` (names or
    columns), an iterator in that order, of which no more than a batch is in memory. dealt: df is what a fold over these keys
    gave, so a group's rows are in one task already and are sorted there, without a shuffle."""
    d = df.select(*dict.fromkeys([*keys, *columns]))
    ordered, names = order is not None, d.columns
    full = StructType([d.schema[k] for k in keys] + StructType.fromDDL(schema).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(full)
        rows = (dict(zip(names, r)) for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(target)], schema=target)

        for key, group in groupby(rows, lambda r: tuple(r[k] for k in keys)):
            for r in fold(group if ordered else list(group)):
                out.append((*key, *r))
                if len(out) >= batch:
                    yield made()
                    out = []
        if out:
            yield made()

    return (d if dealt else d.repartition(*keys)).sortWithinPartitions(*keys, *order or ()).mapInArrow(run, full)
