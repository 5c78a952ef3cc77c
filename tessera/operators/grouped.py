"""Apply a sequential kernel to each group of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def apply_to_groups(rows: DataFrame, key: str, schema: str, kernel: Callable[..., Iterable[tuple]], order: list[str]) -> DataFrame:
    """``kernel`` gets a group as a pandas frame sorted by ``order`` and gives result tuples; the key is put before them.

    A group is held by one task: keys must bound their groups (a track, a package, a component).
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(pdf):
        import pandas as pd

        key_value = pdf[key].iloc[0]
        out = [(key_value, *r) for r in kernel(pdf.sort_values(order, kind="stable").reset_index(drop=True))]
        return pd.DataFrame(out, columns=[key, *names])

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def apply_to_lists(rows: DataFrame, key: str, schema: str, kernel: Callable[..., Iterable[tuple]], columns: list[str]) -> DataFrame:
    """As ``apply_to_groups`` for kernels on many small groups: ``kernel`` gets a list for each of ``columns``, sorted by them.

    A group is one row with an array; a task's groups come in Arrow batches, without a pandas frame for each of them.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    kind = dict(rows.dtypes)[key]
    whole = f"{key} {kind}, {schema}"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, lists = batch.column(0).to_pylist(), batch.column(1)
            ends = lists.offsets.to_pylist()
            flat = [values.to_pylist() for values in lists.values.flatten()]
            out = [(k, *r) for k, a, b in zip(keys, ends[:-1], ends[1:], strict=True) for r in kernel(*(x[a:b] for x in flat))]
            values = list(zip(*out, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], [key, *names])

    fields = to_arrow_schema(rows.sparkSession.createDataFrame([], whole).schema)
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("own"))
    return held.mapInArrow(run, whole)
