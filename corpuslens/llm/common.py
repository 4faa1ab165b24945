"""What several operators share: column selection, per-text Arrow maps, folds and written tables."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuslens.session import materialize, shared_directory

ROWS_AT_ONCE = 256  # rows whose texts are Python strings at the same time

__all__ = ["add_columns", "documents_of", "held_out", "materialize", "once_per_process", "read_table", "smallest_hashes", "text_or_empty", "written"]


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def once_per_process(key: tuple, make: Callable):
    """An object that all tasks of a Python worker share; functions sent by value have no other place for it."""
    held = _worker_objects()
    if key not in held["objects"]:
        held["objects"][key] = make()
    held["asked"].add(key)
    return held["objects"][key]


def _worker_objects() -> dict:
    """The objects of this process; what the stage that it worked for before did not ask for is let go at a new stage."""
    held = sys.modules.setdefault("corpuslens_worker_objects", ModuleType("corpuslens_worker_objects")).__dict__
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if "objects" not in held:
        held.update(objects={}, asked=set(), stage=stage)
    if held["stage"] != stage:
        held.update(objects={k: v for k, v in held["objects"].items() if k in held["asked"]}, asked=set(), stage=stage)
        pa.default_memory_pool().release_unused()
    return held


def written(df: DataFrame, label: str) -> DataFrame:
    """As ``materialize``, packed tighter: for tables that hold texts or many hashes."""
    target = f"{shared_directory(df.sparkSession)}/corpuslens/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def smallest_hashes(rows: DataFrame, draw: Column, limit: int, *ties: str) -> DataFrame:
    """The ``limit`` rows with the smallest draws (64-bit hashes), as a written table.

    Rows far above the expected bound are dropped before the sort, so that what tasks send on does not
    grow with their number.
    """
    n = rows.count()
    if n > 4 * limit:
        rows = rows.where(draw < -(1 << 63) + (1 << 64) * 2 * limit // n)
    return written(rows.orderBy(draw, *ties).limit(limit), "sample")


def text_or_empty(docs: DataFrame) -> Column:
    """The text of a document; a null text is an empty one."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def documents_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that no other column of the input can clash with a result."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))


def held_out(doc_id: Column) -> Column:
    """Fold 0 of five by the checksum of the id; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def add_columns(
    rows: DataFrame, fields: str, start: Callable[[], Callable[[list[str]], list[list]]], keep: list[str] | None = None,
    text: str = "text", keep_rows: bool = False,
) -> DataFrame:
    """Columns computed from the text of each row, in Arrow batches, without a shuffle.

    ``start`` runs once per task and returns a function from a list of texts to one list per field.
    ``keep`` names the columns of the input that are passed through (default: all of them).  With
    ``keep_rows`` the function also returns, first, whether each row stays.
    """
    added = T._parse_datatype_string(fields)
    kept = [f for f in rows.schema.fields if (keep is None or f.name in keep) and f.name not in added.fieldNames()]
    schema = T.StructType([*kept, *added.fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _worker_objects()
        compute = start()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                values = compute([x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()])
                stays = None
                if keep_rows:
                    stays, *values = values
                columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
                columns = [c.cast(arrow.field(i).type) for i, c in enumerate(columns)]
                columns += [pa.array(v, arrow.field(len(names) + i).type) for i, v in enumerate(values)]
                out = pa.RecordBatch.from_arrays(columns, schema=arrow)
                yield out.filter(pa.array(stays, pa.bool_())) if keep_rows else out

    return rows.mapInArrow(run, schema)
