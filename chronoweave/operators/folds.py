"""Folds over ordered rows that keep little: rows stream past in order, so that a key of any length needs the fold's own memory alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame


class Fold:
    """What a key's rows go through: `row` for each in order and `end` behind the last; both give rows to keep."""

    def row(self, r: dict) -> Iterable[tuple]:
        raise NotImplementedError

    def end(self) -> Iterable[tuple]:
        return ()


def folded(rows: DataFrame, keys: list[str], order: list, fold: Callable[[], Fold], schema: str) -> DataFrame:
    """Rows of `schema`: keys are spread over tasks and sorted there, on disk where they don't fit, and each goes through a fold of its own."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).fieldNames()

    def run(batches):
        key, now = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                here = tuple(r[k] for k in keys)
                if now is None or here != key:
                    out.extend(now.end() if now else ())
                    key, now = here, fold()
                out.extend(now.row(r))
            if out:
                yield batch(out)
        if now and (out := list(now.end())):
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], types)

    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(StructType.fromDDL(schema))
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
