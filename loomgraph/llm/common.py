"""Shared helpers of the training-data operators: input reading, materialised cuts, word classes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.storage import cut, shared_dir

__all__ = ["SPACE", "cut", "forget_others", "fresh", "give_back", "giving_back", "read", "remember", "shared_dir", "slices_of", "text_or_empty", "width"]

#: White space of the word contracts: a word is a run of other characters.
SPACE = r"[\x20\x09-\x0D]+"
#: Texts of a batch that are decoded at once.
SLICE = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, through Spark's own reader so that any store it knows works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_remembered: dict[str, Callable[[], None]] = {}


def remember(owner: str, forget: Callable[[], None]) -> None:
    """Register what a Python worker keeps from task to task for the operator ``owner``."""
    _remembered[owner] = forget


def forget_others(owner: str) -> None:
    """Free what other operators keep in this worker: an executor's workers serve one operator after the other."""
    for other, forget in _remembered.items():
        if other != owner:
            forget()


def give_back() -> None:
    """Return to the system what the allocators of this worker hold unused: workers wait for tasks beside others that run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """``run`` over batches (of mapInArrow), after which the worker gives back its memory."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of SLICE rows, so that few texts are decoded at once."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever its case: helpers beside a caller's own columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def width(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
