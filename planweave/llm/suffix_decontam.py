"""Benchmark decontamination with suffix arrays over the training text.

A task cuts its documents into shards of bounded size. For a shard it sorts the
suffixes (at word boundaries) into a suffix array and looks up every suffix of
the benchmark in it by binary search: the range that is found holds all
verbatim occurrences and their places. Words and suffixes that no benchmark
text contains cannot take part in a match and are left out of the array, which
loses nothing. For a document in which an item occurs, the document's own suffix
array, sorted to its end, gives the longest verbatim match with the item: every
suffix of the item is looked up, and the neighbours of its place share the
longest beginnings with it.

Nothing is shuffled; the benchmark goes to the tasks in blocks of bounded size,
one index per block, and a task holds one of several blocks at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import bound_arrow_batches, byte_groups, free_name

WINDOW = 13
#: Bytes of benchmark text behind one index, and of training text behind one suffix array.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 1 << 20
#: A document is contaminated from one hit word in so many.
HIT_ONE_IN = 20

#: Lower-cases A-Z and turns every other ASCII character that is no word character into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _keys(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The depth ids from each place, as byte strings that sort like the sequences of ids."""
    rows = ids[at[:, None] + np.arange(depth)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * depth}").ravel()


def _mixed(ids: np.ndarray, span: int) -> np.ndarray:
    """A hash of the span ids from each place."""
    n = len(ids) - span + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(span):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += ids[k : k + n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k + 1)
    return h ^ (h >> np.uint64(29))


@dataclass
class BenchmarkIndex:
    """The suffixes of a block of benchmark items that start a window, by length."""

    vocabulary: dict[bytes, int]
    items: list
    #: The items' words.
    sequences: list[np.ndarray]
    #: By window length: sorted keys, and for each key the indices of the items that hold it.
    windows: dict[int, tuple[np.ndarray, list[list[int]]]]
    #: Words that every window has at least, up to 4, and the hashes of all windows' starts.
    span: int
    starts: np.ndarray
    bitmap: np.ndarray = field(repr=False, default=None)

    @classmethod
    def build(cls, items: Iterable[tuple[object, bytes | None]], window: int = WINDOW) -> BenchmarkIndex:
        vocabulary: dict[bytes, int] = {}
        names, sequences = [], []
        for name, text in items:
            if ids := [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]:
                names.append(name)
                sequences.append(ids)
        held: dict[int, dict[tuple, list[int]]] = {}
        for k, ids in enumerate(sequences):
            n = min(window, len(ids))
            for start in range(len(ids) - n + 1):
                owners = held.setdefault(n, {}).setdefault(tuple(ids[start : start + n]), [])
                if not owners or owners[-1] != k:
                    owners.append(k)
        windows = {}
        for n, found in held.items():
            order = sorted(found)
            flat = np.array(order, np.uint32).reshape(len(order), n)
            windows[n] = (np.ascontiguousarray(flat.astype(">u4")).view(f"S{4 * n}").ravel(), [found[x] for x in order])
        span = min([4, *held])
        starts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_mixed(np.array(x[:span]), span) for found in held.values() for x in found)]))
        bitmap = np.zeros(1 << 20, bool)
        bitmap[starts >> np.uint64(44)] = True
        return cls(vocabulary, names, [np.array(x, np.int64) for x in sequences], windows, span, starts, bitmap)

    def encode(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def suffix_array(self, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted suffixes of a shard that may match: their keys to the depth, and their places."""
        h = _mixed(ids, self.span)
        at = np.flatnonzero(self.bitmap[h >> np.uint64(44)])
        near = np.searchsorted(self.starts, h[at])
        at = at[self.starts[np.minimum(near, len(self.starts) - 1)] == h[at]]
        padded = np.concatenate([ids, np.zeros(depth, np.int64)])
        keys = _keys(padded, at, depth)
        order = np.argsort(keys, kind="stable")
        return keys[order], at[order]

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window length: places in the shard where a window occurs, and which window."""
        if not self.windows or len(ids) < self.span:
            return
        depth = max(self.windows)
        keys, places = self.suffix_array(ids, depth)
        if not len(keys):
            return
        for n, (wanted, _) in self.windows.items():
            full = 4 * (depth - n)
            low = np.searchsorted(keys, wanted.astype(f"S{4 * depth}"), "left")
            if full:
                ends = np.array([w.ljust(4 * n, b"\0") + b"\xff" * full for w in wanted.tolist()], f"S{4 * depth}")
                high = np.searchsorted(keys, ends, "right")
            else:
                high = np.searchsorted(keys, wanted, "right")
            count = high - low
            which = np.repeat(np.arange(len(wanted)), count)
            first = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            yield n, places[first + np.arange(len(which))], which


# ---- longest matches ---------------------------------------------------


def sorted_suffixes(ids: np.ndarray) -> np.ndarray:
    """The places of all suffixes in order, by doubling the length that is sorted."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    step, n = 1, len(ids)
    while True:
        behind = np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])
        pair = rank * (n + 2) + behind
        order = np.argsort(pair, kind="stable")
        new = np.cumsum(np.concatenate([[1], (np.diff(pair[order]) != 0).astype(np.int64)]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n or step >= n:
            return order
        step *= 2


class Prefixes:
    """Hashes of all beginnings of a sequence, from which that of any stretch follows."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ids: np.ndarray) -> None:
        values = (ids.astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        self.power = np.ones(len(ids) + 1, np.uint64)
        np.cumprod(np.full(len(ids), self.BASE), out=self.power[1:])
        # sum of value * BASE ** -k would need inverses; sums of value * BASE ** k do as well when both sides are scaled alike
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.power[:-1])])

    def stretch(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.sums[start + size] - self.sums[start]


def common(a: Prefixes, i: np.ndarray, b: Prefixes, j: np.ndarray, na: int, nb: int) -> np.ndarray:
    """For each pair of places, how many ids the suffixes share at their beginning."""
    low, high = np.zeros(len(i), np.int64), np.minimum(na - i, nb - j)
    power = a.power if len(a.power) >= len(b.power) else b.power
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = a.stretch(i, mid) * power[j] == b.stretch(j, mid) * power[i]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


class DocumentSuffixes:
    """The suffix array of a document, for looking up items."""

    def __init__(self, doc: np.ndarray) -> None:
        self.doc, self.order, self.prefixes = doc, sorted_suffixes(doc), Prefixes(doc)

    def longest(self, item: np.ndarray) -> tuple[int, int, int]:
        """(place in the document, place in the item, length) of the longest stretch of words that both have; the first one of them in the item."""
        doc, order, n, m = self.doc, self.order, len(self.doc), len(item)
        own, at = Prefixes(item), np.arange(m)
        low, high = np.zeros(m, np.int64), np.full(m, n)
        ended_doc, ended_item = np.append(doc, -1), np.append(item, -1)
        while (low < high).any():  # all suffixes of the item are looked up side by side
            open_ = low < high
            mid = np.where(open_, (low + high) // 2, 0)
            place = order[mid]
            k = common(own, at, self.prefixes, place, m, n)
            less = ended_doc[place + k] < ended_item[at + k]
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        best = (0, 0, 0)
        for near in (low - 1, low):
            known = (near >= 0) & (near < n)
            place = order[np.clip(near, 0, n - 1)]
            k = np.where(known, common(own, at, self.prefixes, place, m, n), 0)
            i = int(k.argmax())
            size = int(k[i])
            while size and not np.array_equal(doc[place[i] : place[i] + size], item[i : i + size]):
                size -= 1  # hashes that met by chance
            if size > best[2] or (size == best[2] and size and i < best[1]):
                best = (int(place[i]), i, size)
        return best


def search(index: BenchmarkIndex, texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[tuple[int, tuple[int, int, int]]]]]:
    """For each text: its words, the stretches [start, end) of hit words, and the items found, as indices, each with its longest match."""
    for group in byte_groups([x or b"" for x in texts], SHARD_BYTES):
        sizes, parts = [], []
        for i in group:
            words = words_of(texts[i])
            sizes.append(len(words) + 1)  # a gap of one 0 after each text
            parts += [index.encode(words), np.zeros(1, np.int64)]
        ids = np.concatenate(parts)
        size = np.array(sizes)
        start = np.cumsum(size) - size
        delta = np.zeros(len(ids) + 1, np.int32)
        items: dict[int, set[int]] = {}
        for n, places, which in index.matches(ids):
            np.add.at(delta, places, 1)
            np.add.at(delta, places + n, -1)
            owners = index.windows[n][1]
            doc = np.searchsorted(start, places, "right") - 1
            for d, w in np.unique(np.stack([doc, which]), axis=1).T.tolist() if len(doc) else ():
                items.setdefault(d, set()).update(owners[w])
        hit = np.cumsum(delta[:-1]) > 0
        for k, n in enumerate(sizes):
            spans: list[tuple[int, int]] = []
            own = ids[start[k] : start[k] + n - 1]
            if k in items:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[start[k] : start[k] + n - 1].astype(np.int8), [0]])))
                spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
            array = DocumentSuffixes(own) if k in items else None
            yield n - 1, spans, [(i, array.longest(index.sequences[i])) for i in sorted(items.get(k, ()))]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))
_KIND = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", _SPANS), ("matches", _MATCHES)]
)
DIGEST = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>, "
    "matches array<struct<item:string,start:long,item_start:long,length:long>>"
)


def verdict(n_words: int, spans: list[tuple[int, int]], matches: list[dict]) -> dict:
    """What is told of a document, from the stretches and matches of all blocks."""
    whole: list[list[int]] = []
    for a, b in sorted(spans):
        if whole and a <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], b)
        else:
            whole.append([a, b])
    best: dict[str, dict] = {}  # an id may stand for several items
    for m in matches:
        if m["item"] not in best or m["length"] > best[m["item"]]["length"]:
            best[m["item"]] = m
    items, hit = sorted(best), sum(b - a for a, b in whole)
    return {
        "n_words": n_words, "n_hit": hit, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(),
        "contaminated": hit > 0 and HIT_ONE_IN * hit >= n_words, "spans": [{"start": a, "end": b} for a, b in whole], "matches": [best[i] for i in items],
    }


def _searcher(blocks: list):
    def searched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            held: list[tuple[int, list, list]] = [(0, [], []) for _ in texts]
            for shared in blocks:
                index = shared.value
                for k, (n, spans, found) in enumerate(search(index, texts)):
                    matches = [{"item": str(index.items[i]), "start": m[0], "item_start": m[1], "length": m[2]} for i, m in found]
                    held[k] = (n, held[k][1] + spans, held[k][2] + matches)
                if len(blocks) > 1:  # the next block takes its place; its value is read again from the executor's disk
                    del index
                    shared.__dict__.pop("_value", None)
            yield pa.array([verdict(*x) for x in held], _KIND)

    return F.arrow_udf(searched, DIGEST).asNondeterministic()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of about BLOCK_BYTES; only one block is in the driver at a time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, bytes(r.text) if r.text is not None else None) for r in part.collect()]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", into: str = "contamination"
) -> DataFrame:
    """docs with a struct column: n_words, n_hit, n_items, items_sha256, contaminated, the hit spans and the longest match with each item found.

    The benchmark is a stated query set: it is searched in blocks of bounded size,
    as many as it needs, each against all rows. Documents need not fit a shard: a
    very long one is a shard of its own. A null or empty text has no words
    and no hits; so has an item. Repeated rows and items count each for
    themselves (an item by its id, once). An empty benchmark hits nothing. A name
    clash gives the new column a leading underscore.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    blocks = [spark.sparkContext.broadcast(BenchmarkIndex.build(b)) for b in _blocks(benchmark, item_col, item_text_col)]
    return docs.withColumn(free_name(docs, into), _searcher(blocks)(F.col(text_col).cast("binary")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs."""
    name = free_name(docs, "contamination")
    return find_contamination(docs, benchmark, text_col).where(~F.col(f"{name}.contaminated")).select(*[docs[c] for c in docs.columns])
