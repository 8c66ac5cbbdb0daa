"""Tables kept in the cluster's shared folder, and small helpers of all operators."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trolley.session import delete_path, shared_path

#: Folders this process has written under the shared folder, until ``release``.
_FOLDERS: list[tuple[SparkSession, str]] = []


def settle(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet under the session's checkpoint folder and read back.

    Cuts lineage: a lost executor later costs a re-read of these files, never
    a second run of what made them. ``release`` removes the files.
    """
    spark = df.sparkSession
    folder = shared_path(spark, f"llm-{name}")
    _FOLDERS.append((spark, folder))
    df.write.option("compression", codec).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def release() -> None:
    """Delete every table ``settle`` has written; frames built on them end with it."""
    while _FOLDERS:
        spark, folder = _FOLDERS.pop()
        delete_path(spark, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this process keeps between tasks, by the function that gives it up: whether the present task has used it.
_KEPT: dict[Callable[[], object], bool] = {}


def keep(forget: Callable[[], object]) -> None:
    """The present task uses what ``forget`` gives up; the first one that ends without doing so gives it up (``relax``)."""
    _KEPT[forget] = True


def relax() -> None:
    """Give back memory that Arrow and the C library keep unused: a Python worker goes on to other tasks and stages."""
    idle = [forget for forget, used in _KEPT.items() if not used]
    _KEPT.update(dict.fromkeys(_KEPT, False))
    for forget in idle:
        del _KEPT[forget]
        forget()
    if idle:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows, so that texts of a few are Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
    relax()


def relaxed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` over a task's batches, and ``relax`` when its own values are gone."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        relax()

    return task


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, compared without case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name
