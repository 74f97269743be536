"""Shared scratch space for checkpoints and intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_OWNER: ContextVar[ExitStack | None] = ContextVar("scratch owner", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is pinned or memoized inside goes when the block ends, by a failure too.

    Results that read it have to be used or written inside. Scopes nest: each removes what was made in it. Outside of any
    scope, pinned tables stay until the folder's owner removes them.
    """
    with ExitStack() as owned:
        token = _OWNER.set(owned)
        try:
            yield
        finally:
            _OWNER.reset(token)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def memoized(df: DataFrame) -> DataFrame:
    """Keep a frame for repeated interactive queries, spilling to disk, until the scope ends or it is unpersisted."""
    held = df.persist()
    if owner := _OWNER.get():
        owner.callback(held.unpersist, True)
    return held


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without the setting uses a folder of its warehouse. A cluster
    session must name one, because executors cannot see the driver's disk.
    """
    root = spark.conf.get(_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_KEY} to a folder every executor can reach")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch root; the scope removes it, if there is one."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if owner := _OWNER.get():
        owner.callback(_remove, spark, path)
    return path


def pinned(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to scratch as Parquet and read it back.

    Work that needs several jobs over one intermediate (model fitting) reads
    the written table, so a lost executor costs a re-read, not a recompute.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
