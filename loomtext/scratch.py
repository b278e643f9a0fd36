"""Shared scratch tables: lineage is cut with Parquet in the folder named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Where each scratch table lies, while somebody holds it.
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Tables written since each passing() that is open; each thread has its own, so queries side by side delete none of each other's.
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


def _file_system(spark: SparkSession, path: str) -> tuple[object, object]:
    """The Hadoop file system of `path`, and `path` as it names it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's setting, else the context's.

    Only where neither is set and all runs in one process on one machine, as in tests, a local folder is made; a cluster's
    executors wouldn't see it, so there it is an error.
    """
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{_KEY} must name a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set(_KEY, folder)
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, deleted when the driver ends."""
    folder = f"{scratch_dir(spark)}/loomtext-{spark.sparkContext.applicationId}"
    fs, at = _file_system(spark, folder)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return folder


def _noted(table: DataFrame, path: str) -> DataFrame:
    _PLACES[table] = path
    if open_ := _OPEN.get():
        open_[-1].append(table)
    return table


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Scratch tables written inside are deleted at the end, but for those put into the list that this gives."""
    kept: list[DataFrame] = []
    made: list[DataFrame] = []
    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield kept
    finally:
        _OPEN.reset(token)
        stay = {id(t) for t in kept}
        discard(*[t for t in made if id(t) not in stay])
        if outer := _OPEN.get():
            outer[-1].extend(t for t in made if id(t) in stay)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: a lost executor rereads files, it recomputes nothing.

    Tables are deleted by discard(), by clear(), or with the application.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return _noted(spark.read.schema(df.schema).parquet(path), path)


def materialise_by(df: DataFrame, key: str, n: int, label: str) -> DataFrame:
    """As materialise(), in `n` buckets of `key`: what groups or joins by it afterwards needs no shuffle."""
    spark = df.sparkSession
    name = f"loomtext_{uuid.uuid4().hex}"
    path = f"{_own_folder(spark)}/{name}/{label}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  resolved now: the name isn't needed any more, the files stay
    spark.sql(f"drop table {name}")
    return _noted(table, path)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again; others are left alone."""
    for table in tables:
        if path := _PLACES.pop(table, None):
            fs, at = _file_system(table.sparkSession, path)
            fs.delete(at.getParent(), True)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that weren't read yet are lost."""
    fs, at = _file_system(spark, _own_folder(spark))
    fs.delete(at, True)
