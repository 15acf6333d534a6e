"""One ordered fold for each group, the single place where Python touches the series."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``step`` of each group's rows in ``order``; the keys are put in front of what it returns.

    One exchange on the keys. A group must fit in a task: it is one game or one segment.
    """
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = step(pdf.sort_values(order, kind="stable"))
        for i, (k, v) in enumerate(zip(keys, key, strict=True)):
            out.insert(i, k, v)
        return out

    return df.groupBy(*keys).applyInPandas(run, f"{types}, {schema}")


def walk(df: DataFrame, keys: list[str], order: list[str], step: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``step`` of each group's rows in ``order``, as plain tuples without the keys; the keys are put in front.

    For very many small groups: one exchange on the keys, then groups are walked through as the rows come by.
    """
    rest = [c for c in df.columns if c not in keys]
    out = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + schema
    arrow = to_arrow_schema(StructType.fromDDL(out))
    n = len(keys)

    def run(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = (k + r for k, group in itertools.groupby(rows, lambda r: r[:n]) for r in step([g[n:] for g in group]))
        while some := list(itertools.islice(found, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*some, strict=True), arrow.types, strict=True)], schema=arrow)

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
