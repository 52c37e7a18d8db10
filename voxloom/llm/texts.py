"""Small helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxloom.plans.durable import shared_dir
from voxloom.plans.ship import ship

#: Words are maximal runs of anything but these ASCII blanks; ``bytes.split()`` cuts at just these.
BLANKS = " \t\n\v\f\r"


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words as UTF-8; ``lower`` maps A-Z only. None gives none."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def blocks(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end at blanks."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + size)
        end = cut.start() if cut else len(data)
        yield data[at:end] if at or end < len(data) else data
        at = end


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, or one like it, that isn't among ``taken`` in whatever case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


class Cache(dict):
    """What ``make(key)`` gave, for the keys met lately: between ``limit`` and twice as many are held."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_letters() -> dict[int, str]:
    """Latin-1 code point of a byte -> its letter in byte-level vocabularies.

    Visible bytes stand for themselves; the others follow, in order, from code point 256.
    """
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


def small_batches(spark) -> None:
    """For applications over long texts: batches of Spark's default length hold much off its heap.

    Operators leave the session's settings alone; the queries and the pipeline call this.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", SLICE)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and it takes less disk than a checkpoint."""
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def map_rows(df: DataFrame, fn, schema: str, raw: Iterable[str] = ()) -> DataFrame:
    """``fn(columns as Python lists, in order) -> list of output columns`` for each Arrow batch.

    Columns named in ``raw`` stay Arrow arrays: they are passed on, or taken from, without becoming objects.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    arrow, raw = to_arrow_schema(T.StructType.fromDDL(schema)), {*raw}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn() if getattr(fn, "per_task", False) else fn
        for batch in batches:
            for part in _slices(batch):
                cols = step(*[c if n in raw else c.to_pylist() for n, c in zip(part.schema.names, part.columns, strict=True)])
                if cols is not None:
                    yield pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def _column(c, kind: pa.DataType) -> pa.Array:
    if isinstance(c, pa.Array):
        return c if c.type == kind else c.cast(kind)
    return pa.array(c, type=kind)


def map_stream(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(iterator over slices, as Python lists)`` yields output columns, arrays or lists, as often as it likes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = ([c.to_pylist() for c in part.columns] for batch in batches for part in _slices(batch))
        for cols in fn(slices):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


_HELD: dict = {}


def held(name, make):
    """What ``make()`` gave under ``name`` in this worker process, for all its tasks.

    Workers outlive their stage, so they hold one such thing at a time: the tables of one stage are dropped when
    another opens its own.
    """
    if name not in _HELD:
        release()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """Drop what this worker process holds for earlier stages, and hand its memory back to the system."""
    if not _HELD:
        return
    _HELD.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # a C library that has no such call keeps the memory for itself
        ctypes.CDLL(None).malloc_trim(0)


def per_task(factory):
    """Mark ``factory`` as one that makes the batch function once in each task."""
    factory.per_task = True
    return factory


#: Rows that are turned into Python objects at once, so that a batch of long texts stays small.
SLICE = 512


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)

