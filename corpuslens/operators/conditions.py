"""Conditions given as SQL text, checked before they run."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checked(rows: DataFrame, conditions: Iterable[tuple[str, str]]) -> dict[str, Column]:
    """Name -> condition over a row of ``rows``, false where the text gives null.

    A text must be a boolean expression of the row's columns: no aggregate, window, subquery or function that may
    give another value the next time.  ValueError names the condition that is not.
    """
    conditions = list(conditions)
    named = [n for n, _ in conditions]
    if len(set(named)) < len(named):
        raise ValueError(f"conditions of the same name: {sorted({n for n in named if named.count(n) > 1})}")
    # An empty table of the same columns: its plan is small however long the rows' own is.
    empty = rows.sparkSession.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]))
    if _problem(empty, [text for _, text in conditions]):
        for name, text in conditions:
            problem = _problem(empty, [text])
            if problem:
                raise ValueError(f"condition {name!r} ({text}): {problem}")
    return {name: F.coalesce(F.expr(f"({text})"), F.lit(False)) for name, text in conditions}


def _problem(empty: DataFrame, texts: list[str]) -> str | None:
    """What is wrong with conditions as filters of a table; filters take no aggregates and no windows."""
    try:
        plan = reduce(lambda df, text: df.where(F.expr(f"({text})")), texts, empty)._jdf.queryExecution().analyzed()
    except PySparkException as problem:
        return str(problem).strip().split("\n")[0] or type(problem).__name__
    if not plan.deterministic():
        return "its value may change"
    return None if plan.subqueriesAll().isEmpty() else "it holds a subquery"
