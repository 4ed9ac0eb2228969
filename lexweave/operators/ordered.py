"""Sequential folds per key without collecting a key: rows stream past in order, only the state is held."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from lexweave.session import materialize


def fold(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict | None]], schema: str) -> DataFrame:
    """One output row (or none) per input row, from ``step(state, row)``.

    Rows of a key are brought into one partition in order; a hot key is a long stream but never
    an array, so memory does not depend on its size.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)

    def run(batches):
        out_schema = to_arrow_schema(kind)
        current, state, fresh = None, None, True
        for b in batches:
            rows = []
            for row in b.to_pylist():
                if fresh or row[key] != current:
                    current, state, fresh = row[key], start(), False
                state, out = step(state, row)
                if out is not None:
                    rows.append(out)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out_schema)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def running(df: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over all rows before a row in ``order``, which is unique.

    Rows are cut into ranges of the order and written; sums go over each range and over one row per range, so no task
    sees more than its range, whatever the keys are (numbers with gaps, hashes, names).
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.partitionBy(F.lit(1)).orderBy("_range")) - F.col("_sum")).alias("_before"))
    inner = F.sum(amount).over(Window.partitionBy("_range").orderBy(*order)) - amount
    return placed.withColumn(name, inner).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
