"""Shared scratch tables: cut lineage by writing Parquet where all nodes see it."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections import Counter
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by the cluster; a temporary one only for a local session."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="panelloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/panelloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's staged tables once nothing reads them any more."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession):
    """Shuffle files of a query that runs within go as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)


def stage(df: DataFrame, name: str = "stage", free: bool = False) -> DataFrame:
    """Write once, read many: for a frame that several passes consume.

    Later passes get a columnar scan (pruning, pushdown, size statistics) and a
    lost executor costs one re-read, not the whole lineage. With `free`, the shuffle
    files of the writing go with its end.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_end(df.sparkSession) if free else nullcontext():
        df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


LIFETIME = 3_600.0  # seconds after which a kept table is built anew
_READERS: Counter = Counter()


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename within a file system: readers find the whole table or none."""
    store, here = _store(spark, source)
    there = spark._jvm.org.apache.hadoop.fs.Path(target)
    store.mkdirs(there.getParent())
    if not store.rename(here, there):
        raise OSError(f"{source} can't be moved to {target}")


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    store, place = _store(spark, path)
    store.delete(place, True)


def manifest(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files below the paths, at any depth, with their lengths and times; hidden ones don't count."""
    found = []
    for path in paths:
        store, place = _store(spark, path)
        files = store.listFiles(place, True)
        while files.hasNext():
            at = files.next()
            if not at.getPath().getName().startswith(("_", ".")):
                found.append(f"{at.getPath()} {at.getLen()} {at.getModificationTime()}")
    return sorted(found)


def version(spark: SparkSession, paths: list[str]) -> str:
    """Name of the input's state, from its manifest."""
    return hashlib.md5("\n".join(manifest(spark, paths)).encode()).hexdigest()


def _entries(spark: SparkSession, name: str) -> list[tuple[float, str, str]]:
    """(time, state, path) of the published tables of a name, the newest last."""
    root = f"{scratch_root(spark)}/kept/{name}"
    store, place = _store(spark, root)
    names = [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []
    split = [n.rsplit("-", 1) for n in names if not n.startswith(".")]
    return sorted((int(at) / 1e6, state, f"{root}/{state}-{at}") for state, at in split)


def reused(spark: SparkSession, name: str, paths: list[str], build, lifetime: float = LIFETIME) -> DataFrame:
    """What `build` gives, written once for each state of the input files; built anew after `lifetime` seconds.

    A table is written aside and published by a rename, so a reader never meets half of
    one. The frame counts as a reader until `done` is called with it; tables that a newer
    one has replaced go once they have no reader, all of them with `clear_scratch`.
    """
    state = version(spark, paths)
    fresh = [path for at, of, path in _entries(spark, name) if of == state and time.time() - at < lifetime]
    if fresh:
        path = fresh[-1]
    else:
        aside = f"{scratch_root(spark)}/kept/{name}/.{uuid.uuid4().hex}"
        build().write.parquet(aside)
        path = f"{scratch_root(spark)}/kept/{name}/{state}-{int(time.time() * 1e6)}"
        move(spark, aside, path)
    _READERS[path] += 1
    release(spark, name)
    out = spark.read.parquet(path)
    out._kept_table = path
    return out


def done(df: DataFrame) -> None:
    """Say that a frame from `reused`, and all that was made from it, is read no more."""
    path = df.__dict__.pop("_kept_table", None)
    if path:
        _READERS[path] -= 1
        release(df.sparkSession, path.split("/")[-2])


def release(spark: SparkSession, name: str) -> None:
    """Delete the tables of a name that are not the newest and have no reader."""
    for _, _, path in _entries(spark, name)[:-1]:
        if _READERS[path] <= 0:
            remove(spark, path)
            del _READERS[path]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for iterative plans."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
