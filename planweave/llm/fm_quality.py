"""Quality scores by a factorisation machine.

Inputs are hashed words of the text, statistics of its structure in bins, and
metadata in bins (columns that the caller names; none that tells the label). Every input
has a weight and a short vector; every pair of inputs adds the product of their values and
of their vectors' inner product. The sum over all pairs is
half of (sum of x v)^2 less the sum of (x v)^2, so a text is scored in time
linear in its inputs. Training runs in numpy on a bounded sample, scoring in
Arrow functions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import bound_arrow_batches, free_name
from planweave.llm.compression_rules import CONTINUATION, SPACES, SYMBOLS
from planweave.llm.labelled import labelled_keys, texts_of

#: The bound of the sample, in texts of each label.
PER_CLASS = 2500
WORD_BITS = 15
BINS = 16
RANK = 6
EPOCHS = 12
BATCH = 256
RATE = 0.05
DECAY = 1e-4
#: What all hashed words of a text weigh together, against one for each statistic.
WORD_SCALE = 1.0
SEED = 1

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".,;:"
MARKS = b"!?"
STATISTICS = (
    "size", "words", "word length", "distinct words", "repeated pairs", "most frequent word", "upper case", "digits", "non-ASCII", "stops",
    "marks", "symbols", "other ASCII", "line length", "repeated lines", "compression", "longest word",
)


def statistics(text: bytes, words: list[bytes], counts: Counter, packer: zstandard.ZstdCompressor) -> list[float]:
    n, w = max(1, len(text)), max(1, len(words))
    part = lambda chars: (len(text) - len(text.translate(None, chars))) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    kinds = [UPPER, DIGITS, bytes(range(128, 256)), STOPS, MARKS, SYMBOLS]
    shares = [part(x) for x in kinds]
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text.translate(None, SPACES + CONTINUATION)) / w, len(counts) / w, 1 - pairs / max(1, len(words) - 1),
        max(counts.values(), default=0) / w, *shares, 1 - sum(shares) - part(LOWER + SPACES), np.log1p(len(text) / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), len(packer.compress(text)) / n, np.log1p(max(map(len, counts), default=0)),
    ]


class Inputs:
    """Turns texts and metadata into hashed words, their values, and statistics."""

    def __init__(self) -> None:
        self.packer = zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False)

    def of(self, text: bytes | None, meta: Sequence[float | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = text or b""
        words = text.split()
        counts = Counter(words)
        ids = np.fromiter((crc32(x.lower()) for x in counts), np.int64, len(counts)) & ((1 << WORD_BITS) - 1)
        values = np.fromiter(counts.values(), np.float64, len(counts))
        values *= WORD_SCALE / np.sqrt((values**2).sum() or 1.0)
        stats = statistics(text, words, counts, self.packer) + [np.nan if m is None else float(m) for m in meta]
        return ids, values, np.array(stats)


class FactorisationMachine:
    def __init__(self, edges: np.ndarray, seed: int = SEED) -> None:
        """edges: for each statistic, the BINS - 1 bounds between its bins; one more bin is for missing values."""
        self.edges = edges
        size = (1 << WORD_BITS) + len(edges) * (BINS + 1)
        self.w = np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, RANK))
        self.bias = 0.0

    def inputs(self, ids: np.ndarray, values: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All input places of a text with their values."""
        bins = np.where(np.isnan(stats), BINS, (self.edges < stats[:, None]).sum(axis=1))
        place = (1 << WORD_BITS) + np.arange(len(stats)) * (BINS + 1) + bins
        return np.concatenate([ids, place]), np.concatenate([values, np.ones(len(place))])

    def margins(self, place: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of texts laid end to end; every text has inputs."""
        xv = self.v[place] * value[:, None]
        total = np.add.reduceat(xv, starts)
        squares = np.add.reduceat((xv**2).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.w[place] * value, starts) + 0.5 * ((total**2).sum(axis=1) - squares)

    def gradients(self, place: np.ndarray, value: np.ndarray, starts: np.ndarray, row: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The inputs that are met, and the slopes of the weighted logistic loss by their weights and vectors, and by the bias."""
        d = (0.5 * (1 + np.tanh(0.5 * self.margins(place, value, starts))) - label) * weight
        at = d[row] * value
        total = np.add.reduceat(self.v[place] * value[:, None], starts)
        used, back = np.unique(place, return_inverse=True)
        dv = np.stack([np.bincount(back, at * (total[row, f] - self.v[place, f] * value)) for f in range(RANK)], axis=1)
        return used, np.bincount(back, at), dv, float(d.sum())

    def train(self, texts: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray, seed: int = SEED) -> FactorisationMachine:
        """Adaptive gradient steps on the weighted logistic loss."""
        if not len(texts):
            return self
        random = np.random.default_rng(seed)
        mean = float((label * weight).sum() / weight.sum())
        self.bias = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
        g_w, g_v, g_b = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = random.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                part = order[k : k + BATCH]
                place = np.concatenate([texts[i][0] for i in part])
                value = np.concatenate([texts[i][1] for i in part])
                sizes = np.array([len(texts[i][0]) for i in part])
                starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(part)), sizes)
                used, dw, dv, db = self.gradients(place, value, starts, row, label[part], weight[part] / weight[part].sum())
                dw, dv = dw + DECAY * self.w[used], dv + DECAY * self.v[used]
                g_w[used] += dw**2
                g_v[used] += dv**2
                g_b += db**2
                self.w[used] -= RATE * dw / np.sqrt(g_w[used])
                self.v[used] -= RATE * 0.5 * dv / np.sqrt(g_v[used])
                self.bias -= RATE * db / np.sqrt(g_b)
        return self


def _columns(batch: pa.Array | tuple[pa.Array, ...]) -> tuple[pa.Array, ...]:
    """The columns of a batch: Spark hands over a single one without a tuple."""
    return batch if isinstance(batch, tuple) else (batch,)


def _extract(metadata: int):
    kind = pa.struct([("ids", pa.binary()), ("values", pa.binary()), ("stats", pa.binary())])

    def extract(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        inputs = Inputs()
        for batch in batches:
            text, *meta = _columns(batch)
            rows = zip(text.to_pylist(), *[m.to_pylist() for m in meta], strict=True)
            found = [inputs.of(t, m) for t, *m in rows]
            yield pa.array([{"ids": a.astype(np.int32).tobytes(), "values": b.astype(np.float32).tobytes(), "stats": c.tobytes()} for a, b, c in found], kind)

    return F.arrow_udf(extract, "ids binary, values binary, stats binary").asNondeterministic()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = (), per_class: int = PER_CLASS) -> FactorisationMachine:
    """A machine from up to per_class texts of each label, weighted back to the labels' shares; none is of the held-out fold.

    per_class bounds the labelled sample, the only thing that is sampled. Labels of
    a key that comes several times count once, with one of its texts. Without labels the machine is that of its first state.
    """
    keys, counts = labelled_keys(labels, label, per_class, key)
    bound_arrow_batches(docs.sparkSession)
    more = [F.col(m).cast("double").alias(f"m_{i}") for i, m in enumerate(metadata)]
    met = texts_of(docs, keys, key, text_col, *more)
    got = met.select("l_key", "label", _extract(len(more))("text", *[f"m_{i}" for i in range(len(more))]).alias("x")).orderBy("l_key").collect()
    stats = [np.frombuffer(bytes(r.x.stats), np.float64) for r in got]
    width = len(STATISTICS) + len(more)
    if stats:
        table = np.stack(stats)
        cuts = np.arange(1, BINS) / BINS
        edges = np.stack([np.quantile(x[~np.isnan(x)], cuts) if (~np.isnan(x)).any() else np.zeros(BINS - 1) for x in table.T])
    else:
        edges = np.zeros((width, BINS - 1))
    machine = FactorisationMachine(edges)
    y = np.array([r.label for r in got], np.float64)
    weight = np.array([counts[r.label] for r in got], np.float64)
    for v in (0, 1):
        weight[y == v] /= max(1, (y == v).sum())
    texts = [machine.inputs(np.frombuffer(bytes(r.x.ids), np.int32).astype(np.int64), np.frombuffer(bytes(r.x["values"]), np.float32).astype(np.float64), s) for r, s in zip(got, stats, strict=True)]
    return machine.train(texts, y, weight)


def score_texts(docs: DataFrame, machine: FactorisationMachine, text_col: str = "text", metadata: Sequence[str] = (), into: str = "quality") -> DataFrame:
    """docs with a score from 0 to 1, higher for texts that are likelier good; one pass, no shuffle.

    Null texts count as empty: they have statistics but no words. A missing metadata value has a bin of
    its own. Repeated rows get equal scores, and very long texts are read whole. A name clash gives the new column a
    leading underscore.
    """
    bound_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        inputs, own = Inputs(), shared.value
        for batch in batches:
            text, *meta = _columns(batch)
            z = np.zeros(len(text))
            for i, (t, *m) in enumerate(zip(text.to_pylist(), *[x.to_pylist() for x in meta], strict=True)):
                place, value = own.inputs(*inputs.of(t, m))
                z[i] = own.margins(place, value, np.zeros(1, np.int64))[0]
            yield pa.array(0.5 * (1 + np.tanh(0.5 * z)))

    score = F.arrow_udf(scored, "double").asNondeterministic()
    return docs.withColumn(free_name(docs, into), score(F.col(text_col).cast("binary"), *[F.col(m).cast("double") for m in metadata]))
