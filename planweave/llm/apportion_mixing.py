"""Mixing sources to target weights by Sainte-Lague apportionment.

Text is dealt in blocks of equal numbers of words. Sources get integer numbers of
blocks by highest quotients target / (2k - 1); each source's blocks are dealt to
its shards in the same way, in proportion to what the shards hold. A shard is a
seeded share of a source's documents of bounded size, laid end to end in seeded
order; its quota is taken as whole rounds through the shard and then as
consecutive blocks from a seeded start, around the end.

Where there are more sources, or more shards of a source, than one task should
order, they are dealt to by groups first, by the same rule. Rows that are equal in
source, key and size are laid out as one run. The driver gets sums only: of the
sizes, and of the blocks' recipe.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import free_name, repeated, stash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
#: Words of a shard, about, and of a block at most; a block is a thousandth of the least target where that is less.
SHARD_WORDS = 1 << 18
BLOCK_WORDS = 1024
#: Members among which one task deals out seats.
GROUP = 4096
#: Rows of sources and of shards, of some 100 bytes each, that are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 50_000
SEED = 20


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST_REPEATS) -> list[float]:
    """What each source should give: by weight, but most times its size at most, the excess going to the others by weight."""
    unit = 0.0
    while True:
        unit, now = _level(share * sum(sizes), most, [(n, w) for n, w in zip(sizes, weights, strict=True)], unit), unit
        if unit == now:
            return [min(float(most * n), w * unit) for n, w in zip(sizes, weights, strict=True)]


def _level(whole: float, most: float, members: list[tuple[int, float]], unit: float) -> float:
    """The words for a weight of 1, when those that would be over their most at `unit` have their most."""
    full = [(n, w) for n, w in members if w * unit > most * n]
    weight = sum(w for _, w in members) - sum(w for _, w in full)
    return (whole - most * sum(n for n, _ in full)) / weight if weight > 0 else unit


def sainte_lague(weights: Sequence[float], seats: int) -> list[int]:
    """Seats by the highest quotients weight / (2k - 1); a tie goes to the first."""
    total = sum(weights)
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    # Rounded shares below the final divisor never take a seat too many; the rest is dealt one by one.
    unit = max(0.0, seats - len(weights)) / total
    out = [max(0, int(w * unit + 0.5) - 1) for w in weights]
    heap = [(-w / (2 * n + 1), i) for i, (w, n) in enumerate(zip(weights, out, strict=True)) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def _words(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def deal(members: DataFrame, keys: list[str], member: str) -> DataFrame:
    """members (keys, member, words, seats of their group) with `quota`, by highest quotients within each group of keys.

    A member surely gets its rounded share less `spare`, and never more than that
    plus `spare`; the seats between are dealt by quotient. They are at most a few
    times as many as members, whatever the number of seats.
    """
    of = Window.partitionBy(*keys)
    held = members.withColumns({"all": F.sum("words").over(of), "n": F.count(F.lit(1)).over(of)})
    fair = F.when(F.col("all") > 0, F.col("seats") * (F.col("words") / F.col("all"))).otherwise(F.lit(0.0))
    held = held.withColumn("fair", fair).withColumn("spare", F.ceil(F.lit(2) + F.col("n") * F.when(F.col("all") > 0, F.col("words") / F.col("all")).otherwise(0.0)))
    held = held.withColumn("sure", F.when(F.col("words") > 0, F.greatest(F.lit(0), F.round("fair").cast("long") - F.col("spare"))).otherwise(F.lit(0)))
    held = held.withColumn("rest", F.col("seats") - F.sum("sure").over(of))
    chances = F.when(F.col("words") > 0, F.sequence(F.col("sure") + 1, F.round("fair").cast("long") + F.col("spare")))
    seats = held.select(*keys, member, "words", "rest", F.explode(chances).alias("k"))
    order = of.orderBy((F.col("words") / (2 * F.col("k") - 1)).desc(), member, "k")
    dealt = seats.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("rest")).groupBy(*keys, member).agg(F.count(F.lit(1)).alias("more"))
    out = held.join(dealt, [*keys, member], "left")
    return out.select(*members.columns, (F.col("sure") + F.coalesce("more", F.lit(0))).cast("long").alias("quota"))


def deal_by_groups(members: DataFrame, keys: list[str], member: str) -> DataFrame:
    """deal() for any number of members, numbered from 0: to groups of GROUP members first, then within them."""
    grouped = members.withColumn("group", F.floor(F.col(member) / GROUP))
    groups = grouped.groupBy(*keys, "group").agg(F.sum("words").alias("words"), F.first("seats").alias("seats"))
    quota = deal(groups, keys, "group").select(*keys, "group", F.col("quota").alias("seats"))
    return deal(grouped.drop("seats").join(quota, [*keys, "group"]), [*keys, "group"], member).drop("group")


def _by_rank(sources: DataFrame) -> DataFrame:
    """sources with `sid`, their place by code point, null last, from 0; none of them passes through the driver."""
    ordered = stash(sources.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("at", 33).alias("part")
    sizes = sorted((r.part, r.n) for r in ordered.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each task
    before, first = 0, []
    for p, n in sizes:
        first.append((p, before))
        before += n
    if len(first) <= 1:
        return ordered.withColumn("sid", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")
    offsets = sources.sparkSession.createDataFrame(first, "part long, before long")
    met = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
    return met.withColumn("sid", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")


def _recipe(rows: DataFrame, weights: Sequence[float], share: float) -> tuple[DataFrame, int, bool]:
    """Sources with sid, source_size, target, quota of blocks and number of shards; the words of a block; whether sources and shards are few."""
    sources = _by_rank(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    table = F.array(*[F.lit(float(w)) for w in weights])
    sources = stash(sources.withColumn("weight", F.get(table, (F.col("sid") % len(weights)).cast("int"))), "mix-sources")
    unit, whole = 0.0, None
    most = F.col("source_size") * MOST_REPEATS
    while True:
        full = F.col("weight") * unit > most
        got = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, most)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.lit(1)).alias("n"),
            F.sum(F.ceil(F.greatest("source_size", F.lit(1)) / SHARD_WORDS)).alias("shards"),
        ).first()
        whole = share * (got.all or 0)
        new = (whole - (got.full or 0)) / got.weight if got.weight else unit
        if new == unit:
            break
        unit = new
    sources = sources.withColumn("target", F.least(most.cast("double"), F.col("weight") * unit))
    least, total = sources.where("target > 0").agg(F.min("target"), F.sum("target")).first()
    block = int(min(BLOCK_WORDS, max(1, (least or 0) // 1000)))
    members = sources.select("sid", F.col("target").alias("words"), F.lit(round((total or 0) / block)).cast("long").alias("seats"))
    quotas = deal_by_groups(members.withColumn("all_sources", F.lit(0)), ["all_sources"], "sid").select("sid", F.col("quota").alias("blocks"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long").alias("shards")
    out = stash(sources.join(quotas, "sid").select("sid", "source", "source_size", "target", "blocks", shards), "mix-recipe")
    return out, block, got.n <= BROADCAST_ROWS and (got.shards or 0) <= BROADCAST_ROWS


def _of_source(df: DataFrame, recipe: DataFrame, source: str, few: bool) -> DataFrame:
    """df with the recipe's columns; `source` is the column of df."""
    known = recipe.withColumnRenamed("source", "recipe_source")
    return df.join(F.broadcast(known) if few else known, F.col(source).eqNullSafe(F.col("recipe_source"))).drop("recipe_source")


def _shard(key: str, size: str, shards: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), key, size), shards)


def _mark(key: str, size: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key, size)


def _runs(rows: DataFrame, weights: Sequence[float], share: float, seed: int) -> tuple[DataFrame, DataFrame, bool]:
    """Runs of equal rows and what the mix takes of each; the recipe; whether sources and shards are few.

    Runs have sid, source, key, size, n (rows), shard, mark (their place in the shard),
    begin (words before them), from_here (whether they lie behind the start of
    the shard's stretch of blocks), rounds (how often all of the shard is taken) and
    part (words of the run that lie in the stretch).
    """
    recipe, block, few = _recipe(rows, weights, share)
    runs = rows.groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("n"))
    runs = _of_source(runs, recipe, "source", few).withColumn("shard", _shard("key", "size", F.col("shards"), seed)).withColumn("mark", _mark("key", "size", seed))
    shards = runs.groupBy("sid", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.first("blocks").alias("seats"))
    # Dealing reads its members several times over.
    quotas = stash(deal_by_groups(stash(shards, "mix-dealt"), ["sid"], "shard").select("sid", "shard", F.col("words").alias("shard_words"), "quota"), "mix-quotas")
    line = Window.partitionBy("sid", "shard").orderBy("mark", "key", "size")
    words = F.col("size") * F.col("n")
    laid = runs.withColumn("begin", F.sum(words).over(line.rowsBetween(Window.unboundedPreceding, 0)) - words)
    laid = laid.join(F.broadcast(quotas) if few else quotas, ["sid", "shard"])
    whole = F.ceil(F.col("shard_words") / F.lit(block))  # blocks of the shard; the last may be short
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "sid", "shard"), F.greatest(whole, F.lit(1)))
    laid = laid.withColumns({"whole": whole, "start": start, "quota": F.least(F.col("quota"), MOST_REPEATS * whole)})
    rounds = F.when(F.col("whole") > 0, F.floor(F.col("quota") / F.greatest("whole", F.lit(1)))).otherwise(F.lit(0).cast("long"))
    laid = laid.withColumn("rounds", rounds).withColumn("stop", F.col("start") + F.col("quota") - F.col("rounds") * F.col("whole"))

    def overlap(first: Column, last: Column) -> Column:
        """Words of the run that lie in blocks [first, last)."""
        return F.greatest(F.lit(0), F.least(F.col("begin") + words, last * block) - F.greatest(F.col("begin"), first * block))

    part = overlap(F.col("start"), F.least("stop", "whole")) + overlap(F.lit(0), F.greatest(F.lit(0), F.col("stop") - F.col("whole")))
    laid = laid.withColumns({"part": part.cast("long"), "from_here": F.col("begin") >= F.col("start") * block})
    return laid.select("sid", "source", "key", "size", "n", "source_size", "target", "shard", "mark", "begin", "from_here", "rounds", "part"), recipe, few


def _slim(docs: DataFrame, key: str, text_col: str, source_col: str) -> DataFrame:
    return stash(docs.select(F.col(key).alias("key"), F.col(source_col).alias("source"), _words(text_col).alias("size")), "mix")


def mix(
    docs: DataFrame, key: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, seed: int = SEED
) -> DataFrame:
    """Per row of docs: key, source, size, source_size, target (its source's) and taken, in words.

    Sources in code point order, null last, get the weights in turn. taken counts
    words with repeats, 0 to 2 times the size; at the ends of a shard's stretch of
    blocks a row is taken in part. Rows without words take none; a
    source without words has the target 0; an empty table gives an empty result.
    A null key is a key; repeated rows lie side by side in their shard, the first
    of them as many times more as the stretch holds. Reruns
    agree, as order and starts come from hashes. A very long text is one row,
    longer than a shard if need be. Other columns of docs are not read, so their
    names cannot clash.
    """
    runs, _, _ = _runs(_slim(docs, key, text_col, source_col), weights, share, seed)
    # The rows of a run: those that the stretch holds whole, at most one in part, and those that it doesn't hold.
    more = F.when(F.col("size") > 0, F.floor(F.col("part") / F.greatest("size", F.lit(1)))).otherwise(F.lit(0).cast("long"))
    runs = runs.withColumn("more", more).withColumn("odd", F.col("part") - F.col("more") * F.col("size"))
    base, own = F.col("rounds") * F.col("size"), F.col("size")
    kinds = F.array(
        F.struct(F.col("more").alias("rows"), (base + own).alias("taken")),
        F.struct((F.col("odd") > 0).cast("long").alias("rows"), (base + F.col("odd")).alias("taken")),
        F.struct((F.col("n") - F.col("more") - (F.col("odd") > 0).cast("long")).alias("rows"), base.alias("taken")),
    )
    told = ["key", "source", "size", "source_size", "target"]
    rows = runs.select(*told, F.explode(kinds).alias("x")).select(*told, "x.rows", "x.taken")
    return repeated(rows.where("rows > 0"), "rows", "copy").select("key", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, key: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The mix as rows of docs: each as often as it is taken, to the nearest whole number.

    Only the rows at the ends of a shard's stretch of blocks are taken in
    part, so rounding moves a source by less than one document a shard or so.
    A row finds out for itself whether it lies in the stretch, from the first and
    the last mark in it; only runs at the ends are looked up, and of repeated rows
    there the first ones by text are taken. Rows without words, and an empty table,
    give no rows. Columns of docs may have any names.
    """
    runs, recipe, few = _runs(_slim(docs, key, text_col, source_col), weights, share, seed)
    runs = stash(runs, "mix-runs")
    words = F.col("size") * F.col("n")
    inside, cut = (F.col("part") == words) & (words > 0), (F.col("part") > 0) & (F.col("part") < words)
    ends = {}
    for name, here in (("a", F.col("from_here")), ("b", ~F.col("from_here"))):
        ends |= {f"{name}_low": F.min(F.when(inside & here, F.col("mark"))), f"{name}_high": F.max(F.when(inside & here, F.col("mark")))}
    shards = runs.groupBy("sid", "shard").agg(F.first("rounds").alias("rounds"), F.collect_set(F.when(cut, F.col("mark"))).alias("cut"), *[c.alias(n) for n, c in ends.items()])
    shards = stash(shards, "mix-shards")  # a stretch has four ends at most, so cut is short
    names = {n: free_name(docs, f"mix_{n}") for n in ("size", "sid", "shards", "shard", "mark", "copies", "copy", "place", "rounds", "more", "n", "cut", *ends)}
    at = lambda n: F.col(names[n])
    source = free_name(docs, "mix_source")
    # No filter on the size: pushed down, it would count the words of every text once more.
    rows = docs.withColumn(names["size"], _words(text_col))
    known = recipe.select(F.col("sid").alias(names["sid"]), F.col("source").alias(source), F.col("shards").alias(names["shards"]))
    rows = rows.join(F.broadcast(known) if few else known, F.col(source_col).eqNullSafe(F.col(source))).drop(source)
    rows = rows.withColumn(names["shard"], _shard(key, names["size"], at("shards"), seed)).withColumn(names["mark"], _mark(key, names["size"], seed)).drop(names["shards"])
    told = shards.select(*[F.col(n).alias(names[n]) for n in ("sid", "shard", "rounds", "cut", *ends)])
    rows = rows.join(F.broadcast(told) if few else told, [names["sid"], names["shard"]])
    between = lambda x: F.coalesce(at("mark").between(at(f"{x}_low"), at(f"{x}_high")), F.lit(False))
    at_end = F.array_contains(at("cut"), at("mark"))
    # The runs at the ends, and what shares their marks.
    marks = runs.where(cut).select("sid", "shard", "mark").distinct()
    few_runs = runs.join(marks, ["sid", "shard", "mark"], "left_semi").withColumn("more", F.round(F.col("part") / F.greatest("size", F.lit(1))).cast("long"))
    few_runs = few_runs.select(F.col("sid").alias(names["sid"]), "key", F.col("size").alias(names["size"]), F.col("n").alias(names["n"]), F.col("more").alias(names["more"]))
    own = free_name(docs, "mix_key")
    few_runs = few_runs.withColumnRenamed("key", own)
    few_runs = stash(few_runs, "mix-ends")
    at_q = few_runs.select(F.col(names["sid"]).alias(free_name(docs, "mix_q_sid")), F.col(names["size"]).alias(free_name(docs, "mix_q_size")), own, names["n"], names["more"])
    met = [at("sid") == F.col(at_q.columns[0]), at("size") == F.col(at_q.columns[1]), F.col(key).eqNullSafe(F.col(own))]
    if few:  # four runs a shard at most: one pass over the texts
        rows = rows.join(F.broadcast(at_q), met, "left")
    else:
        plain = rows.where(~at_end).withColumns({c: F.lit(None).cast(at_q.schema[c].dataType) for c in at_q.columns})
        rows = plain.unionByName(rows.where(at_end).join(at_q, met))
    extra = F.when(at("n") == 1, at("more")).when(at("n").isNull(), (between("a") | between("b")).cast("long"))
    out = rows.withColumn(names["copies"], F.when(at("size") > 0, at("rounds") + extra)).select(*docs.columns, names["copies"])
    if not few_runs.where(at("n") > 1).isEmpty():
        order = Window.partitionBy(names["sid"], names["size"], key).orderBy(text_col)
        several = rows.where(at("n") > 1).withColumn(names["place"], F.row_number().over(order))
        out = out.unionByName(several.withColumn(names["copies"], at("rounds") + (at("place") <= at("more")).cast("long")).select(*docs.columns, names["copies"]))
    out = out.where(at("copies") > 0)
    return out.withColumn(names["copy"], F.explode(F.sequence(F.lit(1).cast("long"), at("copies")))).select(*docs.columns)
