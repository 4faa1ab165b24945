"""Places and running totals inside groups, without a window per group.

A window keeps all rows of a group in one task.  Here rows are dealt by ranges of (group, order), so that a
group that holds a third of all rows lies in many tasks.  Each task numbers its own rows; what a group has
before a task's first row is then added from one summary row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuslens.session import materialize

_PART, _RUN = "_part", "_run"


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    if pa.types.is_null(column.type) or len(column) < 2:
        return np.zeros(max(0, len(column) - 1), bool)
    before, after = column.slice(0, len(column) - 1), column.slice(1)
    differ = pc.fill_null(pc.not_equal(before, after), False)
    null_differs = pc.xor(pc.is_null(before), pc.is_null(after))
    return pc.or_(differ, null_differs).to_numpy(zero_copy_only=False)


def _accumulated(values: np.ndarray, starts: np.ndarray, run: np.ndarray, carried: int, exclusive_or: bool) -> np.ndarray:
    """Running totals within runs of equal groups; the first run continues from ``carried``.  Integers wrap around."""
    values = values.astype(np.int64).view(np.uint64)
    total = np.bitwise_xor.accumulate(values) if exclusive_or else np.cumsum(values, dtype=np.uint64)
    before = total[starts] ^ values[starts] if exclusive_or else total[starts] - values[starts]
    start = np.array([carried], np.int64).view(np.uint64)
    before[:1] = before[:1] ^ start if exclusive_or else before[:1] - start
    return (total ^ before[run] if exclusive_or else total - before[run]).view(np.int64)


def running(
    rows: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, str] | None = None, xors: dict[str, str] | None = None,
    position: str = "position",
) -> DataFrame:
    """``rows`` with their place (from 1) in their group and running totals, this row included, as a written table.

    ``sums`` and ``xors`` name new columns and the integer columns they add up, null counting as 0; sums
    wrap around.  ``group`` names columns (none: all rows are one group), in which nulls are equal.
    ``order`` should leave no ties between rows that differ: ties are placed in any order.
    """
    spark = rows.sparkSession
    totals = {**dict.fromkeys(sums or {}, False), **dict.fromkeys(xors or {}, True)}
    sources = {**(sums or {}), **(xors or {})}
    names = rows.columns
    added = [T.StructField(n, T.LongType()) for n in [position, *totals]]
    schema = T.StructType([*rows.schema.fields, *added, T.StructField(_PART, T.IntegerType()), T.StructField(_RUN, T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run_number, last, carried = TaskContext.get().partitionId(), 0, None, dict.fromkeys([position, *totals], 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(names.index(g)) for g in group]
            changed = np.zeros(n, bool)
            for key in keys:
                changed[1:] |= _changes(key)
            first = [key[0].as_py() for key in keys]
            if last is not None and first != last:
                run_number += 1
                carried = dict.fromkeys(carried, 0)
            changed[0] = True
            starts, of_run = np.flatnonzero(changed), np.cumsum(changed) - 1
            columns = []
            for name in carried:
                values = np.ones(n, np.int64) if name == position else pc.fill_null(batch.column(names.index(sources[name])).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                columns.append(_accumulated(values, starts, of_run, carried[name], totals.get(name, False)))
            last = [key[n - 1].as_py() for key in keys]
            carried = {name: int(c[-1]) for name, c in zip(carried, columns, strict=True)}
            runs = of_run + run_number
            run_number = int(runs[-1])
            own = [c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, columns), pa.array(np.full(n, part, np.int32)), pa.array(runs.astype(np.int64))], schema=arrow)

    keys = [*group, *order]
    placed = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema), "running")

    # One row per task: the group it starts with, and where it stands at its end.
    at = [F.col(_RUN), F.col(position)]
    ends = placed.groupBy(_PART).agg(
        F.min(F.struct(*at, F.struct(F.lit(0).alias("none"), *group).alias("group"))).alias("first"),
        F.max(F.struct(*at, F.struct(F.lit(0).alias("none"), *group).alias("group"), *totals)).alias("last"),
    )
    offsets, open_group, open_totals = [], None, {}
    for row in sorted(ends.collect(), key=lambda r: r[_PART]):
        base = open_totals if open_group is not None and row["first"]["group"] == open_group else dict.fromkeys([position, *totals], 0)
        if any(base.values()):
            offsets.append((row[_PART], *base.values()))
        own = {name: row["last"][name] for name in base}
        if row["last"][_RUN] == 0:
            own = {name: _wrapped(own[name] ^ base[name] if totals.get(name) else own[name] + base[name]) for name in base}
        open_group, open_totals = row["last"]["group"], own
    if not offsets:
        return placed.drop(_PART, _RUN)
    held = [f"_before_{i}" for i in range(len(added))]
    before = spark.createDataFrame(offsets, T.StructType([T.StructField(_PART, T.IntegerType()), *[T.StructField(h, T.LongType()) for h in held]]))
    continued = placed.join(F.broadcast(before), _PART, "left")  # a row per task at most
    columns = []
    for field, h in zip(added, held, strict=True):
        base = F.when(F.col(_RUN) == 0, F.coalesce(h, F.lit(0))).otherwise(F.lit(0))
        whole = F.col(field.name).bitwiseXOR(base) if totals.get(field.name) else _wrapping_sum(F.col(field.name), base)
        columns.append(whole.alias(field.name))
    return continued.select(*names, *columns)


def _wrapped(value: int) -> int:
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


def _wrapping_sum(a: Column, b: Column) -> Column:
    """Sum of two longs that wraps around, also where Spark checks for overflow."""
    plain = F.try_add(a, b)
    high = F.lit(-(1 << 63))
    shifted = F.when(a >= 0, (a + high) + (b + high)).otherwise((a - high) + (b - high))
    return F.coalesce(plain, shifted)
