"""SimHash near-duplicates through pivot distance tables.

Fingerprints are looked at once each, with the smallest id that has them. A
pivot table holds, for a fingerprint, its Hamming distances to many reference
fingerprints. Two fingerprints that differ in d bits differ by d at most in
every coordinate, so a pair is discarded by its largest coordinate difference
and only survivors are compared bit by bit.

Two kinds of references serve two ends. Zero and the 64 references of a single
bit tell by the difference of two distances whether a fingerprint sets that bit.
If two fingerprints differ in 2 bits at most, then of 5 groups of these
coordinates at least 3 agree in full: pairs that share the coordinates of 3
groups are all the candidates there can be. The other references are scattered
over the space and discard most of the candidates.

A group of candidates that is too large to be paired is split by further
coordinates: those that its members need not share yet are cut into 5 groups
again, 3 of which must agree. After the third time 5 coordinates at most are left, so
no more than 32 fingerprints are together. Every link is found at the level
where its group is small enough, and nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import bound_arrow_batches, discard, free_name, stash

SHINGLE = 3
SEED = 42
BITS = 64
MAX_BITS = 2
GROUPS = 5
AGREE = GROUPS - MAX_BITS
#: How often the coordinates that are left are cut into groups: of 64 bits, 26, 11 and 5 at most are left.
LEVELS = 3
#: References scattered over the space, from a rule.
SCATTERED = 24
#: Candidates that share a key and are paired; larger groups are split further.
PAIRED = 128
BLOCK = 1 << 15
#: Bits, in words of 64, of the table that tells rows without any copy apart from the rest.
TABLE_WORDS = 1 << 18


# ---- fingerprints ------------------------------------------------------


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text's 3-word shingles, as unsigned 64 bits; 0 without words."""
    words = text.lower().split() if text else []  # bytes.lower() is ASCII only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:], strict=False)]
    digest = xxhash.xxh64_digest
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(shingles), BLOCK):
        raw = b"".join([digest(x, SEED) for x in shingles[k : k + BLOCK]])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in batch.to_pylist()], np.uint64)
        yield pa.array(found.view(np.int64))


def with_fingerprint(docs: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint as a signed long; a null text has no words."""
    bound_arrow_batches(docs.sparkSession)
    return docs.withColumn(into, F.arrow_udf(_fingerprints, "long").asNondeterministic()(F.col(text_col).cast("binary")))


# ---- pivot tables ------------------------------------------------------


def _bit_references() -> np.ndarray:
    return np.array([0] + [1 << k for k in range(BITS)], np.uint64)


def _scattered_references() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"reference {k}".encode()) for k in range(SCATTERED)], np.uint64)


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot table: a row of Hamming distances for each fingerprint."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int16)


CHOICES = list(combinations(range(GROUPS), AGREE))


def free_bits(path: int) -> list[int]:
    """The coordinates that members of a group need not share. path: the choices made so far, digits base 11 of one more than each."""
    digits = []
    while path:
        digits.append(path % 11 - 1)
        path //= 11
    free = list(range(BITS))
    for choice in reversed(digits):
        parts = [x.tolist() for x in np.array_split(np.array(free), GROUPS)]
        free = [b for g in range(GROUPS) if g not in CHOICES[choice] for b in parts[g]]
    return free


def candidate_keys(prints: np.ndarray, path: int = 0) -> np.ndarray:
    """For each fingerprint and each choice of 3 groups of the coordinates that are free: those coordinates, as a number."""
    table = distances(prints, _bit_references())
    bits = ((table[:, :1] - table[:, 1:] + 1) // 2).astype(np.int64)
    parts = np.array_split(np.array(free_bits(path)), GROUPS)
    keys = []
    for chosen in CHOICES:
        key = np.zeros(len(prints), np.int64)
        for g in chosen:
            for b in parts[g].tolist():
                key = key * 2 + bits[:, b]
        keys.append(key)
    return np.stack(keys, axis=1)


def _keyed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for prints, paths in batches:
        own, way = prints.to_numpy(zero_copy_only=False).view(np.uint64), paths.to_numpy(zero_copy_only=False)
        codes, choices = np.zeros((len(own), len(CHOICES)), np.int64), np.zeros((len(own), len(CHOICES)), np.int64)
        for path in np.unique(way).tolist():  # a hundred at most
            of = way == path
            codes[of] = candidate_keys(own[of], path)
            choices[of] = path * 11 + 1 + np.arange(len(CHOICES))
        both = pa.StructArray.from_arrays([pa.array(codes.ravel()), pa.array(choices.ravel())], ["code", "path"])
        yield pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), both)


def linked_pairs(members: list[int]) -> list[tuple[int, int]]:
    """Of fingerprints that share a key, those within 2 bits: first by pivot coordinates, then by their bits."""
    prints = np.array(members, np.int64).view(np.uint64)
    table = distances(prints, _scattered_references())
    a, b = np.triu_indices(len(prints), 1)
    for c in range(SCATTERED):  # one coordinate after the other, on the pairs that are left
        near = np.abs(table[a, c] - table[b, c]) <= MAX_BITS
        a, b = a[near], b[near]
    sure = np.bitwise_count(prints[a] ^ prints[b]) <= MAX_BITS
    return [(members[i], members[j]) for i, j in zip(a[sure].tolist(), b[sure].tolist(), strict=True)]


def _linked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for batch in batches:
        yield pa.array([[{"a": a, "b": b} for a, b in linked_pairs(x)] for x in batch.to_pylist()], kind)


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b): all pairs of distinct fingerprints (column fp) that differ in 2 bits at most."""
    keyed = F.arrow_udf(_keyed, "array<struct<code:long,path:int>>").asNondeterministic()
    pairs = F.arrow_udf(_linked, "array<struct<a:long,b:long>>").asNondeterministic()
    rows = prints.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key"))
    found = None
    for level in range(LEVELS):
        dealt = rows.select("fp", "key", F.explode(keyed("fp", "path")).alias("x"))
        # The key of a group: that of the group before it, the choice and its coordinates; if two should meet in a number, verification parts them.
        dealt = stash(dealt.select("fp", "x.path", F.xxhash64("key", "x.path", "x.code").alias("key")), "simhash-keys")
        counted = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        last = level + 1 == LEVELS
        groups = dealt.join(counted if last else counted.where(F.col("n") <= paired), "key").groupBy("key").agg(F.collect_list("fp").alias("members"))
        own = groups.select(F.explode(pairs("members")).alias("x")).select("x.a", "x.b")
        own = stash(own.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs")
        found = own if found is None else found.unionByName(own)
        if last:
            break
        rows = stash(dealt.join(counted.where(F.col("n") > paired).select("key"), "key", "left_semi").select("fp", "path", "key"), "simhash-large")
        discard(dealt)
        if rows.isEmpty():
            break
    return found.distinct()


# ---- components --------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't the smallest of its component; root is that one.

    Large-star and small-star in turn, on edges from a larger node b to a smaller
    one a: first every b goes over to the smallest neighbour of its a, then all
    smaller neighbours of a b and b itself link to the smallest of them. Neither
    adds edges. Minima are taken by partial aggregation, never over the
    neighbours of a node as a list. Each round is written to the shared folder
    and the one before is deleted. Every round merges each star that is not alone
    with another one, so rounds end by themselves.
    """
    now = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "components")
    while True:
        least = now.groupBy("b").agg(F.min("a").alias("m"))
        large = now.join(least.select(F.col("b").alias("a"), "m"), "a", "left").select(F.coalesce("m", "a").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        new = stash(small.unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "components")
        discard(now)
        now = new
        # Settled when every larger node has one edge, and no smaller node has a smaller one yet.
        twice = now.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b")
        chained = now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi")
        if not twice.unionByName(chained.select(F.col("a").alias("b"))).limit(1).count():
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _identity(key: str, text_col: str) -> list:
    """Two numbers that tell rows apart by key and text; equal rows have equal ones."""
    body = [F.col(key).isNull(), F.col(key), F.col(text_col).isNull(), F.col(text_col)]
    return [F.xxhash64(F.lit(k), *body) for k in (1, 2)]


def _classified(docs: DataFrame, key: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, id1, id2, fp) of docs, and the root of every fingerprint (fp, first, root)."""
    id1, id2 = _identity(key, text_col)
    slim = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"), id1.alias("id1"), id2.alias("id2"))
    rows = stash(with_fingerprint(slim, into="fp").select("key", "id1", "id2", "fp"), "simhash")
    classes = stash(rows.groupBy("fp").agg(F.min("key").alias("first")), "simhash-classes")
    label = components(stash(links(classes.select("fp")), "simhash-links"))
    known = classes.join(label, classes["fp"] == label["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return rows, known


def near_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: key, fp (signed), root (the component's smallest fingerprint) and component_id, the smallest key that is reachable.

    Null texts and those without words have the fingerprint 0, linked like any
    other; a very long text is one fingerprint like any other. Repeated rows are in
    one component. Null keys are ignored when the smallest is taken; a component of
    null keys only has a null id. An empty table gives an empty result. Other
    columns of docs are not read, so their names cannot clash.
    """
    rows, known = _classified(docs, key, text_col)
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = known.join(least, "root").select("fp", "root", "component_id")
    return rows.join(labels, "fp").select("key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: of those with its smallest key the one with the smallest fingerprint, of repeated rows any one.

    A key may come with different texts: rows are told apart by key and text. Of a
    component without keys, a row with its smallest fingerprint stays. A row that
    is alone in its component stays where it is: a table of bits, of fixed size,
    passes it, and only the rest is shuffled and looked up. An empty table gives
    an empty result; columns of docs may have any names.
    """
    rows, known = _classified(docs, key, text_col)
    rows = stash(rows.join(known.select("fp", "root"), "fp"), "simhash-rows")
    order = F.struct(F.col("key").isNull().alias("null"), "key", "fp", "id1", "id2")
    # Written, so that the join with it can split the rows of a large component among tasks.
    chosen = stash(rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("best")).where("n > 1").select("root", "best.id1", "best.id2"), "simhash-chosen")
    several = rows.join(chosen.select("root", F.col("id1").alias("c1"), F.col("id2").alias("c2")), "root")
    several = several.groupBy("id1", "id2").agg(F.max((F.col("id1") == F.col("c1")) & (F.col("id2") == F.col("c2"))).alias("stays"))
    several = stash(several, "simhash-several")
    word = lambda c: F.pmod(F.shiftright(c, 6), F.lit(TABLE_WORDS)).cast("int")
    bit = lambda c: F.expr(f"shiftleft(1L, CAST({c} & 63 AS INT))")
    table = several.groupBy(word(F.col("id1")).alias("word")).agg(F.bit_or(bit("id1")).alias("bits"))  # TABLE_WORDS rows at most
    c1, c2, w, bits = (free_name(docs, x) for x in ("row_id1", "row_id2", "row_word", "row_bits"))
    id1, id2 = _identity(key, text_col)
    marked = docs.withColumns({c1: id1, c2: id2}).withColumn(w, word(F.col(c1)))
    marked = marked.join(F.broadcast(table.select(F.col("word").alias(w), F.col("bits").alias(bits))), w, "left")
    seen = F.coalesce(F.col(bits).bitwiseAND(bit(f"`{c1}`")) != 0, F.lit(False))
    alone = marked.where(~seen).select(*docs.columns)
    # Repeated rows are taken together before they are shuffled; what the table marks for nothing is not found among several, and stays.
    rest = marked.where(seen).drop(w, bits).dropDuplicates([c1, c2])
    rest = rest.join(several.select(F.col("id1").alias(c1), F.col("id2").alias(c2), F.col("stays").alias(bits)), [c1, c2], "left")
    return alone.unionByName(rest.where(F.coalesce(F.col(bits), F.lit(True))).select(*docs.columns))
