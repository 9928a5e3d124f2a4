"""Session helpers: the shared work folder, written intermediate tables and their removal, table loading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
#: Tables written so far that nobody has removed, oldest first.
_WRITTEN: list[str] = []


class NoSharedFolder(RuntimeError):
    """A cluster session names no folder that all executors reach."""


def work_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches, from ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is ``local`` (tests, a single machine) a temporary folder is made,
    set as the checkpoint folder and removed when Python ends. On a cluster its absence is an error: executors
    would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get().rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all executors of {master} reach")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="spanloom-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    spark.sparkContext.setCheckpointDir(_OWN_DIR[0])
    return _OWN_DIR[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A folder for a table of this session, removed with the scope it is made in."""
    path = f"{work_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def stage(df: DataFrame, name: str = "stage", replaces: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing the plan. The table stays until its
    ``scope`` ends (or the folder is cleared), because lazy results may still read it. ``replaces`` is a staged table that only
    ``df`` still needed: it is removed, which keeps iterations at one round's tables. ``by`` partitions the folder by a column.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    if replaces is not None:
        discard(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stage`` wrote and that nothing reads any more; other DataFrames are left alone."""
    for t in tables:
        path = getattr(t, "_staged_at", None)
        if path:
            _remove(t.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at its end. Lazy results must be written or collected before."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before]:
            _remove(spark, path)


def together(*jobs: Callable[[], object]) -> list:
    """The results of independent jobs that run side by side, so that short ones do not wait for one another."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
