"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave import storage
from planweave.storage import discard, new_path, shared_dir

__all__ = ["ARROW_BATCH_BYTES", "bound_arrow_batches", "byte_groups", "discard", "free_name", "new_path", "repeated", "shared_dir", "stash"]

#: Bytes of text that one Arrow batch may hold on its way to a Python worker.
ARROW_BATCH_BYTES = 8 << 20


def stash(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, under the session's own settings."""
    return storage.stash(df, name, lean=False)


def bound_arrow_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes, so that a run of long texts doesn't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores, such that no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


#: Rows that one step of repeated() makes of a row at a time.
COPIES = 4096


def repeated(df: DataFrame, count: str, into: str) -> DataFrame:
    """Every row of df `count` times, numbered from 0 in `into`; rows with a count of 0 go.

    A row with very many copies is cut into pieces first, which are dealt to all
    tasks, so no array or task grows with the copies of one row.
    """
    small = df.where(F.col(count) <= COPIES).withColumn(into, F.explode(F.sequence(F.lit(1), F.col(count)))).where(F.col(count) > 0)
    small = small.withColumn(into, (F.col(into) - 1).cast("long"))
    piece = free_name(df, "piece")
    large = df.where(F.col(count) > COPIES).withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / COPIES))))
    large = large.repartition(F.col(piece), F.xxhash64(*df.columns))
    steps = F.sequence(F.col(piece) * COPIES, F.least((F.col(piece) + 1) * COPIES, F.col(count)) - 1)
    return small.unionByName(large.withColumn(into, F.explode(steps)).drop(piece))


def byte_groups(texts: list[bytes], limit: int = 4 << 20) -> Iterator[list[int]]:
    """Indices of consecutive texts of about limit bytes in all; a longer text stands alone."""
    group: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        if group and held + len(text) > limit:
            yield group
            group, held = [], 0
        group.append(i)
        held += len(text)
    if group:
        yield group
