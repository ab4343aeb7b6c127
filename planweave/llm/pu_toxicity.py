"""Toxicity by non-negative positive-unlabelled learning.

Only some toxic texts are confirmed; the rest of the corpus is unlabelled, not
clean. With the share of toxic texts pi, the risk on clean texts is that on
unlabelled ones less pi times that on confirmed ones taken as clean. A flexible
model can drive this difference below zero, which no true risk is; the
non-negative estimator stops there and steps back.

Features are words and the beginnings of words that a text holds, and once more
those that it holds often. Those that several confirmed texts hold are counted over
all of the training part, and those that confirmed texts hold markedly more or
less often than others make the dictionary. All unlabelled texts train: they are dealt out in portions, each of
which trains a linear model in numpy against all confirmed texts, and the models'
weights are averaged. Scoring runs in Arrow functions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import bound_arrow_batches, byte_groups, free_name, stash
from planweave.llm.labelled import fold, labelled_keys, texts_of

#: Confirmed texts that are learned from, at most, and features of the dictionary, those that are furthest apart.
CONFIRMED = 2500
FEATURES = 20_000
#: Confirmed texts that must hold a feature: fewer are never as far apart as LEAST_APART.
LEAST_TEXTS = 4
#: Squared deviations that a feature must be apart between confirmed and other texts; by chance, one in ten thousand is.
LEAST_APART = 15.0
#: Unlabelled texts of a portion, about, and portions' tasks at most; a task then trains several.
PORTION = 4000
MAX_TASKS = 20_000
#: Features that go to one place to be averaged.
CHUNK = 1024
STEMS = (4, 5)
#: Words whose features a worker keeps, and bytes of text that are counted at once.
KEPT_WORDS = 200_000
COUNTED_BYTES = 1 << 20
#: Words of a text among which a repeated feature must be one to count as frequent.
DENSE = 100
STEPS = 250
RATE = 0.05
DECAY = 2e-4
#: Turns ASCII characters that are no letters into spaces, A-Z into a-z.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of letters, in lower case."""
    if not text:
        return []
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(LETTERS).split()


def word_features(word: bytes) -> list[str]:
    text = word.decode("utf-8", "replace")
    return [text, *(f"{text[:k]}*" for k in STEMS if len(text) >= k)]


def features(text: bytes | None, wanted: Features | None = None) -> set[str]:
    """The features of a text; with a plus once more those that it holds more than once, and in one word of DENSE at least.

    wanted: only what is among these.
    """
    words = words_of(text)
    held: dict[str, int] = {}
    if wanted is None:
        found = [(w, n, word_features(w)) for w, n in Counter(words).items()]
    else:  # a feature begins the word that has it, so most words are told by their first bytes
        heads, roots = wanted.heads, wanted.roots
        found = [(w, n, [f for f in word_features(w) if f in roots]) for w, n in Counter([w for w in words if w[:4] in heads]).items()]
    for _, n, own in found:
        for f in own:
            held[f] = held.get(f, 0) + n
    least = max(2, len(words) / DENSE)
    out = {f"{f}+" for f, n in held.items() if n >= least}
    out.update(held)
    return out if wanted is None else out & wanted.names


class Features:
    """Features that are looked for, and what tells words that have none of them."""

    def __init__(self, names: set[str]) -> None:
        self.names = names
        self.roots = {f.removesuffix("+") for f in names}
        self.heads = {f.removesuffix("*").encode()[:4] for f in self.roots}


def _listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for k in range(0, len(batch), 64):
            yield pa.array([sorted(features(x)) for x in batch.slice(k, 64).to_pylist()], pa.list_(pa.string()))


def _numbered(shared):
    def numbered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = shared.value
        wanted = Features(set(names))
        for batch in batches:
            yield pa.array([np.array(sorted(names[f] for f in features(x, wanted)), np.int32).tobytes() for x in batch.to_pylist()], pa.binary())

    return F.arrow_udf(numbered, "binary").asNondeterministic()


class FrequencyCounter:
    """How many texts hold each of many features, numbered; texts are counted in groups, as arrays."""

    def __init__(self, names: dict[str, int]) -> None:
        self.counts = np.zeros(len(names), np.int64)
        roots = sorted({f.removesuffix("+") for f in names})
        self.roots = {f: i for i, f in enumerate(roots)}
        self.plain = np.array([names.get(f, -1) for f in roots], np.int64)
        self.plus = np.array([names.get(f"{f}+", -1) for f in roots], np.int64)
        self.words: dict[bytes, int] = {}
        self.of_word: list[list[int]] = []

    def add(self, texts: list[bytes | None]) -> None:
        split = [words_of(x) for x in texts]
        sizes = np.array([len(x) for x in split])
        if not sizes.sum():
            return
        if len(self.words) > KEPT_WORDS:
            self.words, self.of_word = {}, []
        place, known = self.words, self.of_word
        flat = list(chain.from_iterable(split))
        for w in set(flat).difference(place):
            own = [self.roots.get(f, -1) for f in word_features(w)]
            place[w] = len(known)
            known.append(own + [-1] * (1 + len(STEMS) - len(own)))
        at = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        distinct, back = np.unique(at, return_inverse=True)
        rows = np.array([known[i] for i in distinct.tolist()], np.int64)[back]
        text = np.repeat(np.arange(len(texts)), sizes)[:, None]
        met = (text * len(self.plain) + rows)[rows >= 0]
        pairs, n = np.unique(met, return_counts=True)
        root, least = pairs % len(self.plain), np.maximum(2, sizes / DENSE)[pairs // len(self.plain)]
        for ids in (self.plain[root], self.plus[root[n >= least]]):
            self.counts += np.bincount(ids[ids >= 0], minlength=len(self.counts))


def _frequencies(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = FrequencyCounter(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for group in byte_groups([x or b"" for x in texts], COUNTED_BYTES):
                counter.add([texts[i] for i in group])
        at = np.flatnonzero(counter.counts)
        for k in range(0, len(at), 1 << 17):
            part = at[k : k + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counter.counts[part])], ["id", "n"])

    return count


class LinearModel:
    """weights by feature; a text's margin is the bias plus the weights of its features."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = {f: w for f, w in weights.items() if abs(w) > 1e-4}, bias
        self.wanted = Features(set(self.weights))

    def margin(self, text: bytes | None) -> float:
        return self.bias + sum(self.weights[f] for f in sorted(features(text, self.wanted)))  # one order: reruns agree to the last bit


def clean_and_slope(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The risk on clean texts, and the slopes by z of what is made smaller: all of the risk, or the negative of a clean risk below 0."""
    n_pos, n_un = positive.sum(), (~positive).sum()
    up = 0.5 * (1 + np.tanh(0.5 * z))  # the sigmoid; also the slope of the loss of taking a text as clean
    clean_loss = np.logaddexp(0, z)
    clean_risk = clean_loss[~positive].sum() / n_un - prior * clean_loss[positive].sum() / n_pos
    if clean_risk >= 0:
        return clean_risk, np.where(positive, prior * (up - 1) / n_pos - prior * up / n_pos, up / n_un)
    return clean_risk, np.where(positive, prior * up / n_pos, -up / n_un)  # back out of what no true risk can be


def train(ids: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with the logistic loss."""
    w, bias = np.zeros(n_features), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if not positive.any() or positive.all():
        return w, bias
    flat = np.concatenate(ids)
    sizes = np.array([len(x) for x in ids])
    row = np.repeat(np.arange(len(ids)), sizes)
    first, second, b_first, b_second = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(row, w[flat], len(ids))
        _, g = clean_and_slope(z, positive, prior)
        grad = np.bincount(flat, g[row], n_features) + DECAY * w
        b_grad = g.sum()
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        b_first += 0.1 * (b_grad - b_first)
        b_second += 0.01 * (b_grad * b_grad - b_second)
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        bias -= RATE * (b_first / (1 - 0.9**step)) / (np.sqrt(b_second / (1 - 0.99**step)) + 1e-6)
    return w, bias


def _portions(shared, n_features: int, prior: float, portion: int):
    """For each chunk of features: sums of the weights of a task's models, each times its texts; the last one has the bias and the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        confirmed = shared.value
        total, held = np.zeros(n_features + 2), []

        def learn() -> None:
            if held:
                ids = [*confirmed, *held]
                w, bias = train(ids, np.arange(len(ids)) < len(confirmed), n_features, prior)
                total.__iadd__(np.concatenate([w, [bias, 1.0]]) * len(held))
                held.clear()

        for batch in batches:
            for x in batch.column("ids").to_pylist():
                held.append(np.frombuffer(x, np.int32))
                if len(held) >= 2 * portion:
                    learn()
        learn()
        if total[-1]:
            for k in range(0, len(total), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([total[k : k + CHUNK].tobytes()], pa.binary())], ["chunk", "body"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the bodies of each chunk; rows come sorted by chunk, and one sum is held."""
    chunk, total = None, None
    for batch in batches:
        for k, body in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist(), strict=True):
            own = np.frombuffer(body, np.float64)
            if k == chunk:
                total = total + own
            else:
                if chunk is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "body"])
                chunk, total = k, own
    if chunk is not None:
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "body"])


def apart(n: np.ndarray, k: np.ndarray, n_all: int, n_pos: int) -> np.ndarray:
    """How far k of n_pos confirmed texts are from what n of n_all lets expect, squared, in variances.

    One is added to what is expected, so that a few confirmed texts alone make no feature.
    """
    share = np.minimum(1.0, n / n_all)
    expected = share * n_pos
    return (k - expected) ** 2 / ((expected + 1) * (1 - share + 1e-9))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text_col: str = "text",
    most_confirmed: int = CONFIRMED, most_features: int = FEATURES, least_apart: float = LEAST_APART, portion: int = PORTION,
) -> LinearModel:
    """A model from confirmed texts and the unlabelled corpus, nothing of it from the held-out fold.

    The prior is the share of confirmed texts among the labelled ones that may be
    seen. most_confirmed bounds the confirmed texts, the only sample there is;
    most_features and least_apart say how much of the vocabulary gets a weight:
    what is left out, as what hardly any confirmed text holds, scores as if the text did not hold it. Rows without key are
    of the corpus. Without confirmed texts no feature has a weight.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    keys, counts = labelled_keys(labels, label, most_confirmed, key)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    confirmed = stash(texts_of(docs, keys.where("label = 1").select("l_key", F.lit(True).alias("positive")), key, text_col), "toxicity-confirmed")
    # The estimator takes unlabelled texts as drawn from the whole corpus, toxic ones with their full share: so confirmed ones are among them.
    others = docs.where(F.col(key).isNull() | (fold(key) != 0)).select(F.col(text_col).cast("binary").alias("text"))
    n_pos = confirmed.count()
    none = LinearModel({}, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    listed = stash(confirmed.select("l_key", F.arrow_udf(_listed, "array<string>").asNondeterministic()("text").alias("features")), "toxicity-listed")
    counted = listed.select(F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= LEAST_TEXTS)
    table = counted.orderBy("f").toArrow()  # as many as the confirmed texts hold at most
    known, k = table["f"].to_pylist(), table["k"].to_numpy()
    n_others = others.count()
    if not known or not n_others:
        return none
    counts = others.mapInArrow(_frequencies(spark.sparkContext.broadcast({f: i for i, f in enumerate(known)})), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(known), np.int64)
    n[counts["id"].to_numpy()] = counts["n"].to_numpy()
    far = apart(n, k, n_others, n_pos)
    chosen = [i for i in np.lexsort((np.arange(len(far)), -far)).tolist() if far[i] >= least_apart][:most_features]
    if not chosen:
        return none
    names = {known[i]: j for j, i in enumerate(chosen)}
    numbered = _numbered(spark.sparkContext.broadcast(names))
    positive = [np.frombuffer(bytes(r.ids), np.int32) for r in confirmed.select("l_key", numbered("text").alias("ids")).orderBy("l_key").collect()]
    ids = stash(others.select(numbered("text").alias("ids")), "toxicity-ids")
    tasks = min(MAX_TASKS, max(1, round(n_others / portion)))
    dealt = ids.repartition(tasks, F.xxhash64(F.lit(1), F.monotonically_increasing_id())).sortWithinPartitions(F.xxhash64("ids"), "ids")
    kind = "chunk int, body binary"
    parts = dealt.mapInArrow(_portions(spark.sparkContext.broadcast(positive), len(names), prior, portion), kind)
    sums = parts.repartition("chunk").sortWithinPartitions("chunk", "body").mapInArrow(_summed, kind).collect()  # the size of one model
    total = np.concatenate([np.frombuffer(bytes(r.body), np.float64) for r in sorted(sums, key=lambda r: r.chunk)])
    mean = total[:-1] / total[-1]
    return LinearModel({f: float(mean[i]) for f, i in names.items()}, float(mean[-1]))


def score_texts(docs: DataFrame, model: LinearModel, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1, higher for texts that are likelier toxic; one pass, no shuffle.

    Null and empty texts have no features and get the score of the bias. Repeated
    rows get equal scores, and very long texts are read whole. A name clash gives the new column a leading underscore.
    """
    bound_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            z = np.array([shared.value.margin(x) for x in batch.to_pylist()], np.float64)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return docs.withColumn(free_name(docs, into), F.arrow_udf(scored, "double").asNondeterministic()(F.col(text_col).cast("binary")))
