"""Bounded pieces of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows turned into Python strings at once.
ROWS = 128
#: Rows of an Arrow batch with whole texts: the JVM's and the worker's copy of a batch grow with it.
BATCH_ROWS = 1000


def in_parts(texts: pa.Array | list[str | None], chars: int = 500_000) -> Iterator[list[str | None]]:
    """The texts in runs of about `chars` characters; a longer text is a run of its own, whole.

    An Arrow column is turned into strings as the runs go on, not at once.
    """
    part: list[str | None] = []
    held = 0
    for start in range(0, len(texts), ROWS):
        piece = texts[start : start + ROWS]
        for text in piece.to_pylist() if isinstance(piece, pa.Array) else piece:
            part.append(text)
            held += len(text or "")
            if held >= chars:
                yield part
                part, held = [], 0
    if part:
        yield part


def give_back() -> None:
    """Return freed memory to the system at the end of a task: an idle worker shares its executor's limit with the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows at most for what is executed inside; the session's own setting holds again after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = int(before)
    spark.conf.set(key, str(BATCH_ROWS if rows <= 0 else min(rows, BATCH_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(key, before)
