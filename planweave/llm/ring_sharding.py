"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Every shard owns some of them, its
virtual nodes. A key hashes to a cell and walks clockwise to the first virtual
node whose shard still has room; a full shard lets it walk on. Cells are served
in ring order and keys within a cell by hash, so the result is that of
inserting the keys one by one, but only the counts of cells are needed to know
where each stretch of a cell's keys goes. A cell that holds more than its share,
as that of a key with very many rows, is cut into parts by text, as many as its
share of all rows asks for: so the plan has at most two rows for each of the ring's
cells and one for each shard, whatever the size of the table.

Room is a number of rows. With slack 0, rooms differ by one at most and add up
to the number of rows, so every shard ends exactly full: law `rows`.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planweave.llm.common import repeated, stash

CELLS = 1 << 14
VIRTUAL_NODES = 100
#: Different rows of a cell up to which it stays whole in any table.
LEAST_PART = 1024
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def ring(shards: int, cells: int = CELLS, nodes: int = VIRTUAL_NODES) -> dict[int, int]:
    """Cell -> shard, for cells that hold a virtual node; the smallest shard wins a shared cell.

    Each shard's first node takes the next free cell, so that every shard can be reached.
    """
    if shards > cells:
        raise ValueError(f"a ring of {cells} cells has no place for {shards} shards")
    place = lambda shard, k: int.from_bytes(hashlib.md5(f"{shard}/{k}".encode()).digest()[:8], "big") % cells
    owner: dict[int, int] = {}
    for shard in range(shards):
        cell = place(shard, 0)
        while cell in owner:
            cell = (cell + 1) % cells
        owner[cell] = shard
    for shard in range(shards):
        for k in range(1, nodes):
            owner.setdefault(place(shard, k), shard)
    return owner


def rooms(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """What each shard may hold: its even share, times 1 + slack."""
    if slack:
        return [max(1, -(-int(rows * (1 + slack)) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def serve(counts: Sequence[tuple[int, int, int]], shards: int, room: list[int], cells: int = CELLS) -> list[tuple]:
    """Serves (cell, part, rows) in that order: (cell, part, first rank, end rank, shard, first slot).

    Time is the number of counts plus that of virtual nodes passed: a node whose
    shard is full is skipped for good by linking to the next one.
    """
    owner = ring(shards, cells)
    at = sorted(owner)
    if not at:
        return []
    index_after = {}  # cell -> index of the first node at or after it
    i = 0
    for cell in range(cells):
        while i < len(at) and at[i] < cell:
            i += 1
        index_after[cell] = i % len(at)
    link = list(range(len(at)))

    def open_node(i: int) -> int:
        seen = []
        while True:
            while link[i] != i:
                seen.append(i)
                i = link[i]
            if left[owner[at[i]]] > 0:
                break
            link[i] = (i + 1) % len(at)
        for k in seen:
            link[k] = i
        return i

    left, used, plan = list(room), [0] * shards, []
    for cell, part, rows in sorted(counts):
        rank = 0
        while rank < rows:
            shard = owner[at[open_node(index_after[cell])]]
            n = min(rows - rank, left[shard])
            plan.append((cell, part, rank, rank + n, shard, used[shard]))
            left[shard] -= n
            used[shard] += n
            rank += n
    return plan


def _plan_frame(spark: SparkSession, plan: list[tuple]) -> DataFrame:
    """The plan as rows; at most 2 * CELLS + shards of them."""
    kind = "array<struct<cell:int,part:int,first:bigint,end:bigint,shard:int,slot:bigint>>"
    names = ("cell", "part", "first", "end", "shard", "slot")
    text = json.dumps([dict(zip(names, x, strict=True)) for x in plan])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def shard_rows(docs: DataFrame, key: str = "doc_id", text_col: str = "text", shards: int = 40, slack: float = 0.0) -> DataFrame:
    """Puts every row into a shard: key, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 16 and text_crc32 the unsigned CRC-32 of
    them; a null text counts as no bytes. slot numbers a shard's rows from 0 without gaps.
    A null key is a key of its own. Rows that repeat get slots side by side as
    far as one shard has room. A very long text is a row like any other. An empty
    table gives an empty result. Columns of
    docs other than key and text are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    cell = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(CELLS)).cast("int")
    counted = stash(rows.groupBy("key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")).withColumn("cell", cell), "ring")
    held = [tuple(r) for r in counted.groupBy("cell").agg(F.sum("copies"), F.count(F.lit(1))).collect()]  # a row for each cell at most
    total, kinds = sum(n for _, n, _ in held), sum(k for *_, k in held)
    # By what a task has to order, the different rows; a cell of up to twice the even share stays whole.
    wide = {c: k * CELLS // kinds for c, _, k in held if k * CELLS >= 2 * kinds and k > LEAST_PART}
    parts = F.lit(1)
    if wide:
        known = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"cell": c, "parts": p} for c, p in wide.items()])), "array<struct<cell:int,parts:int>>")))
        counted = counted.join(F.broadcast(known), "cell", "left")
        parts = F.coalesce("parts", F.lit(1))
    counted = counted.withColumn("part", F.pmod(F.xxhash64("text_crc32", "size"), parts).cast("int")).drop("parts")
    counts = [tuple(r) for r in counted.groupBy("cell", "part").agg(F.sum("copies")).collect()] if wide else [(c, 0, n) for c, n, _ in held]
    plan = serve(counts, shards, rooms(total, shards, slack))
    order = Window.partitionBy("cell", "part").orderBy(F.xxhash64("key", "text_crc32"), "key", "size", "text_crc32")
    ranked = counted.withColumn("to_rank", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("from_rank", F.col("to_rank") - F.col("copies"))
    return _placed(ranked, _plan_frame(spark, plan))


def _placed(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """Ranks to shards: a stretch of copies may meet several rows of the plan."""
    met = ranked.join(F.broadcast(plan), ["cell", "part"]).where("from_rank < end and to_rank > first")
    low, high = F.greatest("from_rank", "first"), F.least("to_rank", "end")
    met = met.select("key", "size", "text_crc32", "shard", (F.col("slot") + low - F.col("first")).alias("from_slot"), (high - low).alias("copies"))
    return repeated(met, "copies", "copy").select("key", "size", "text_crc32", "shard", (F.col("from_slot") + F.col("copy")).alias("slot"))
