"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: What stash() has written inside scratch(), the innermost last.
_SCRATCH: list[list[DataFrame]] = []
#: The number of buckets by project in which the tables lie that plans are made from just now, the innermost last.
_LYING: list[int] = []
#: While a table is written: shuffle files go at once, rows that lie together by some of a join's keys aren't dealt out again, and what is small next to the other side of a join is looked up, not sorted.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.join.preferSortMergeJoin": "false"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of this machine, but only if Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="planweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/planweave-{name}-{uuid.uuid4().hex}"


@contextmanager
def lying(buckets: int) -> Iterator[None]:
    """Inside, tables lie in so many buckets by project: nothing is dealt out by project again, and what stash() is told to write so lies so too."""
    _LYING.append(buckets)
    try:
        yield
    finally:
        _LYING.pop()


def in_lying() -> bool:
    return bool(_LYING)


def dealt(df: DataFrame, key: str = "pk") -> DataFrame:
    """df dealt out by key, but inside lying() as it is: where it doesn't lie by project, what needs that has Spark deal it out."""
    return df if _LYING else df.repartition(key)


def table_of(path: str) -> str:
    """The name by which a session knows the buckets at path."""
    return path.rpartition("/")[2].replace("-", "_")


def in_buckets(spark: SparkSession, path: str) -> DataFrame:
    """What put() has written to path in buckets."""
    return spark.table(table_of(path))


def put(df: DataFrame, path: str, mode: str = "error", by: list[str] | None = None, buckets: tuple | None = None) -> None:
    """Writes df as Parquet, in folders by the columns `by` or in buckets (number, key and more columns to sort by); the shuffle files that this took go at once."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        conf.set(k, v)
    try:
        to = df.write.option("compression", "zstd").mode(mode)
        if buckets:
            n, key, *more = buckets
            there = df.sparkSession.catalog.tableExists(table_of(path))
            (to if there else to.option("path", path)).format("parquet").bucketBy(n, key).sortBy(key, *more).saveAsTable(table_of(path))
        else:
            to.partitionBy(*by or ()).parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def stash(df: DataFrame, name: str, keep: bool = False, lean: bool = True, key: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage and size estimates start anew, and a lost executor loses nothing. keep: scratch() leaves it; lean: as put() writes; key: a column of projects that is never null inside lying(), where its buckets are kept."""
    path = new_path(df.sparkSession, name)
    if key and _LYING:
        put(df, path, buckets=(_LYING[-1], key))
        out = in_buckets(df.sparkSession, path).where(f"{key} is not null")
    else:
        put(df, path) if lean else df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """What is stashed inside is deleted at the end; what is made from it has to be written before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for df in _SCRATCH.pop():
            discard(df)


def ready(df: DataFrame) -> DataFrame:
    """df, marked as no more than a look at written rows, which is better done again than written."""
    df.is_ready = True
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """df, if stash() made it or it is marked as ready(), else stash(df): for what several plans are made from."""
    return df if hasattr(df, "stashed_at") or hasattr(df, "is_ready") else stash(df, name)


def discard(df: DataFrame) -> None:
    """Deletes what stash() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark.sql(f"DROP TABLE IF EXISTS {table_of(df.stashed_at)}")
