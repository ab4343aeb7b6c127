"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(key: str = "doc_id"):
    """crc32 of the key as text, modulo FOLDS; 0 is held out. A null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled_keys(labels: DataFrame, label: str, per_class: int, key: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """Up to per_class keys of each label outside the held-out fold, by hash, and how many there are of each.

    A key that is labelled several times has its highest label; null labels and keys are left out.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key) != 0)).groupBy(F.col(key).alias("l_key")).agg(F.max(label).cast("int").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [known.where(F.col("label") == v).orderBy(F.xxhash64("l_key"), "l_key").limit(per_class) for v in (0, 1)]
    return picked[0].unionByName(picked[1]), counts


def texts_of(docs: DataFrame, keys: DataFrame, key: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """keys (l_key and more) with the text, and more columns, of one row of docs each; keys must have a bounded number of rows.

    Of rows with one key but different texts the one with the least hash is taken, so reruns agree.
    """
    body = F.struct(F.col(text_col).cast("binary").alias("text"), *more)
    met = docs.select(F.col(key).alias("l_key"), body.alias("body")).join(F.broadcast(keys), "l_key")
    first = met.groupBy("l_key").agg(F.min_by("body", F.xxhash64("body")).alias("body"), *[F.first(c).alias(c) for c in keys.columns if c != "l_key"])
    return first.select("l_key", *[c for c in keys.columns if c != "l_key"], "body.*")
