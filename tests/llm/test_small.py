"""Pure functions of the corpus operators against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from planweave.llm import apportion_mixing, compression_rules, fm_quality, neural_lm, pu_toxicity, ring_sharding, simhash, suffix_decontam, token_counts, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.text(alphabet=st.sampled_from(list("aAbB \n\t#|é 　\x1c1.")), max_size=80)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_quality_statistics(text):
    got = compression_rules.judge(text.encode(), zstandard.ZstdCompressor(level=3))
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    assert got["n_words"] == len(words)
    assert got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
    assert got["n_dup_lines"] == len(lines) - len(set(lines))
    assert got["n_repeat_words"] == len(covered)
    assert got["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert not (got["kept"] and got["base_failed"])


def test_compression_bands():
    packer = zstandard.ZstdCompressor(level=3)
    r = random.Random(1)
    syllables = [a + b for a in "bcdfghlmnprst" for b in ("a", "e", "i", "o", "u", "en", "ar")]
    prose = " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(2000))
    noise = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=60)) for _ in range(200))
    assert compression_rules.judge(prose.encode(), packer)["kept"]
    assert not compression_rules.judge(noise.encode(), packer)["kept"]
    assert not compression_rules.judge(b"all the same words again " * 400, packer)["kept"]
    half = prose + " " + "on and on and on " * 2000
    verdict = compression_rules.judge(half.encode(), packer)
    assert verdict["odd_chunk_share"] > 0.25 and not verdict["kept"]
    assert sum(map(len, compression_rules.chunks(b"x" * 8500))) == 8500


def test_bands_reject_small_vocabularies():
    """Texts that are neither repetitive in 3-word windows nor ordinary: below all clean texts of their length."""
    r = random.Random(2)
    packer = zstandard.ZstdCompressor(level=3)
    syllables = [a + b for a in "bcdfghlmnprst" for b in ("a", "e", "i", "o", "u", "en", "ar")]
    for n, vocabulary in ((150, 110), (300, 250), (600, 380), (1200, 700)):
        words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(vocabulary)]
        text = " ".join(r.choices(words, k=n)).encode()
        verdict = compression_rules.judge(text, packer)
        assert not verdict["base_failed"] and not verdict["kept"], (n, len(text), verdict)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 63), st.integers(0, 1), st.integers(1, 9)), max_size=40), st.integers(1, 6))
def test_ring_serves_as_one_by_one(counts, shards):
    counts = [(c, p, n) for (c, p), n in {(c, p): n for c, p, n in counts}.items()]
    rows = sum(n for *_, n in counts)
    room = ring_sharding.rooms(rows, shards)
    plan = ring_sharding.serve(counts, shards, room, cells=64)
    owner = ring_sharding.ring(shards, 64)
    left, want = list(room), []
    for cell, part, n in sorted(counts):
        for rank in range(n):
            at = next(c % 64 for c in range(cell, cell + 64) if c % 64 in owner and left[owner[c % 64]] > 0)
            left[owner[at]] -= 1
            want.append((cell, part, rank, owner[at]))
    got = [(cell, part, rank, shard) for cell, part, a, b, shard, _ in plan for rank in range(a, b)]
    assert got == want


def test_rooms_are_even():
    assert sum(ring_sharding.rooms(103, 40)) == 103
    assert {*ring_sharding.rooms(103, 40)} == {2, 3}


@settings(max_examples=200, deadline=None)
@given(texts)
def test_fingerprint(text):
    words = WORDS.findall(lower(text))
    parts = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts] if words else []
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text.encode()) == want


def test_pivot_candidates_lose_no_link():
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(300)]
    near = [x ^ (1 << a) ^ (1 << b) for x in base for a, b in [(r.randrange(64), r.randrange(64))]]
    first = 1 + 3  # a group of the fourth choice
    for path in (0, first):
        # Coordinates that the group shares already are the same for all of it.
        free = simhash.free_bits(path)
        close = [x ^ (1 << a) ^ (1 << b) for x in base for a, b in [r.choices(free, k=2)]]
        keys = simhash.candidate_keys(np.array(base + close, np.uint64), path)
        for i in range(len(base)):
            assert (keys[i] == keys[len(base) + i]).any()
    deepest = [simhash.free_bits((a * 11 + b) * 11 + c) for a in range(1, 11) for b in range(1, 11) for c in range(1, 11)]
    assert max(map(len, deepest)) == 5
    group = [x - (1 << 64) if x >> 63 else x for x in base[:30] + near[:30]]
    want = {(a, b) for i, a in enumerate(group) for b in group[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert set(simhash.linked_pairs(group)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 60))
def test_sainte_lague(weights, seats):
    want = [0] * len(weights)
    for _ in range(seats if sum(weights) else 0):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * want[i] + 1), -i))
        want[k] += 1
    assert apportion_mixing.sainte_lague(weights, seats) == want


def test_mix_targets():
    assert apportion_mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert apportion_mixing.targets([0, 10], [5, 2]) == pytest.approx([0, 15])
    assert apportion_mixing.targets([0, 0], [5, 2]) == [0, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30), max_size=6), st.lists(st.lists(st.sampled_from("abcd"), max_size=20), max_size=5))
def test_suffix_search(docs, items):
    index = suffix_decontam.BenchmarkIndex.build([(i, " ".join(x).encode()) for i, x in enumerate(items)], window=4)
    got = list(suffix_decontam.search(index, [" ".join(x).encode() for x in docs]))
    for words, (n, spans, found) in zip(docs, got, strict=True):
        hit, owners = set(), set()
        for i, x in enumerate(items):
            w = min(4, len(x))
            for a in range(len(x) - w + 1 if w else 0):
                for b in range(len(words) - w + 1):
                    if x[a : a + w] == words[b : b + w]:
                        hit.update(range(b, b + w))
                        owners.add(i)
        assert n == len(words)
        assert {k for a, b in spans for k in range(a, b)} == hit
        assert {index.items[i] for i, _ in found} == owners
        for i, (at, of, size) in found:
            x = items[index.items[i]]
            assert words[at : at + size] == x[of : of + size]
            longest = max(next(k for k in range(99) if b + k >= len(words) or a + k >= len(x) or words[b + k] != x[a + k]) for b in range(len(words)) for a in range(len(x)))
            assert size == longest >= min(4, len(x))


def test_warc_records_are_read_once_however_cut(tmp_path):
    r = random.Random(3)
    payloads = [b"", b"x" * 100_000, bytes(r.randbytes(50_000)), *[bytes(r.randbytes(r.randint(0, 3000))) for _ in range(60)], warc.MAGIC * 50]
    import base64
    import hashlib

    data = b"".join(warc.record(i, f"http://a/{i} b\n", p, base64.b32encode(hashlib.sha1(p).digest()).decode(), None, False) for i, p in enumerate(payloads))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    for step in (777, 10_000, len(data)):
        found = []
        with path.open("rb") as f:
            for a in range(0, len(data), step):
                found += [(x["page_id"], x["payload"]) for x in warc.records_in(f, len(data), a, min(a + step, len(data)))]
        assert found == list(enumerate(payloads))
    path.write_bytes(data[:-5])
    with pytest.raises(ValueError, match="cut off|damaged"), path.open("rb") as f:
        list(warc.records_in(f, len(data) - 5, 0, len(data) - 5))


def test_warc_long_headers_are_read_and_broken_ones_raise(tmp_path):
    r = random.Random(3)
    path = tmp_path / "long.warc.gz"

    def read(data, split):
        path.write_bytes(data)
        with open(path, "rb") as file:
            return [x["page_id"] for a in range(0, len(data), split) for x in warc.records_in(file, len(data), a, min(a + split, len(data)))]

    urls = ["http://a/" + "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=400_000)), "http://b/" + "é" * 60_000, "http://c/" + "x" * 3_000_000]
    parts = [warc.record(i, url, b"page", base64.b32encode(hashlib.sha1(b"page").digest()).decode(), i, False) for i, url in enumerate([*urls, "http://d/"])]
    for split in (50_000, 1 << 22):
        assert read(b"".join(parts), split) == [0, 1, 2, 3]
    headless = zlib.compressobj(6, zlib.DEFLATED, 31)
    broken = headless.compress(b"WARC/1.1\r\nWARC-Type: response\r\n" + b"x" * 200_000) + headless.flush()
    for data in (broken + parts[3], parts[3] + parts[0][:-50_000]):
        with pytest.raises(ValueError):
            read(data, 1 << 22)


def test_token_counts_are_the_librarys():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    r = random.Random(4)
    parts = ["Hello", "don't", "l’été", "é", "ΣΣ", "<|endoftext|>", "<|startoftext|>x", " ", "\n", "\t ", "\x1c", "　", "123", "中文", "\U0001f600", "́", "ẞ", "!?"]
    cases = ["", *["".join(r.choices(parts, k=r.randint(1, 30))) for _ in range(300)], "long words " * 3000]
    counter = token_counts.WordCounter(path)
    want = [len(plain.encode(t, add_special_tokens=False)) for t in cases]
    assert counter.count([t.encode() for t in cases]).tolist() == want
    cut = list(token_counts.pieces(cases[-1].encode(), 1000))
    assert b"".join(cut) == cases[-1].encode() and len(cut) > 5


def _model(words=40):
    r = np.random.default_rng(0)
    return neural_lm.LogBilinear(np.concatenate([np.sort(r.integers(1, 500, words))[::-1], r.integers(0, 9, neural_lm.SHAPES)]))


def test_language_model_is_normalised():
    model = _model()
    n, start = model.symbols, model.symbols
    r = np.random.default_rng(1)
    two, one, word = (r.integers(0, n, 5000) for _ in range(3))
    model.table, _ = model.train(two, one, word, r)
    rt, q, p, a, b = (x.astype(np.float64) for x in model.views(model.table))
    w = neural_lm.WIDTH
    for v, u in ((0, 0), (5, 9), (start, start), (start, 3)):
        logs = model.score(np.full(n, v), np.full(n, u), np.arange(n))
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)
        h = a[:, :w] @ rt[u, :w] + b[:, :w] @ rt[v, :w]
        classes = p[:, :w] @ h + p[:, w]
        for x in range(0, n, 7):  # one word after the other
            own = [y for y in range(n) if model.of[y] == model.of[x]]
            s = {y: q[y, :w] @ h + q[y, w] for y in own}
            want = classes[model.of[x]] - math.log(np.exp(classes).sum()) + s[x] - math.log(sum(map(math.exp, s.values())))
            assert logs[x] == pytest.approx(want, abs=1e-4)
    assert all(0 <= neural_lm.shape(t) < neural_lm.SHAPES for t in (b"", b"a", "é.".encode(), b"x" * 50, b"1,"))


def test_language_model_learns_what_follows():
    """Words that always follow each other become far likelier than their share."""
    model = _model()
    before = model.score(np.array([3]), np.array([4]), np.array([5]))[0]
    r = np.random.default_rng(2)
    text = np.tile(np.arange(12), 3000)
    two, one = neural_lm.contexts(text, model.symbols)
    for _ in range(2):
        model.table, used = model.train(two, one, text, r)
    after = model.score(np.array([3]), np.array([4]), np.array([5]))[0]
    assert after > before + 1 and used[: model.symbols + 1].sum() == 2 * len(text)
    two, one = neural_lm.contexts(np.array([7, 8, 9]), 99)
    assert two.tolist() == [99, 99, 7] and one.tolist() == [99, 7, 8]


def test_language_model_trains_every_position_once(monkeypatch):
    """All positions of all texts, over the rounds, whatever the texts' lengths."""
    import pyarrow as pa

    model = _model()
    r = np.random.default_rng(3)
    texts = [r.integers(0, model.symbols, n) for n in (0, 1, 2, 7, 300, 5)]
    seen = Counter()

    def train(self, two, one, word, random):
        seen.update(zip(two.tolist(), one.tolist(), word.tolist(), strict=True))
        return self.table, np.zeros(len(self.table), np.float32)

    monkeypatch.setattr(neural_lm.LogBilinear, "train", train)
    monkeypatch.setattr(neural_lm.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_arrays([pa.array(range(7, 13)), pa.array([x.astype(np.uint16).tobytes() for x in texts], pa.binary())], ["row", "symbols"])
    shared = type("Shared", (), {"value": model})()
    for turn in range(neural_lm.ROUNDS):
        list(neural_lm._trained(shared, 40, turn, neural_lm.ROUNDS)(iter([batch])))
    want = Counter()
    for x in texts:
        two, one = neural_lm.contexts(x, model.symbols)
        want.update(zip(two.tolist(), one.tolist(), x.tolist(), strict=True))
    assert seen == want


def test_quality_gradient_is_that_of_the_loss():
    r = np.random.default_rng(3)
    m = fm_quality.FactorisationMachine(np.zeros((1, fm_quality.BINS - 1)))
    m.w[:] = r.normal(0, 0.3, len(m.w))
    place, value = r.integers(0, 12, 30), r.random(30)
    starts, row = np.array([0, 8, 19]), np.repeat([0, 1, 2], [8, 11, 11])
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])

    def loss():
        z = m.margins(place, value, starts)
        return float((weight * (np.logaddexp(0, z) - label * z)).sum())

    used, dw, dv, db = m.gradients(place, value, starts, row, label, weight)
    assert used.tolist() == sorted(set(place.tolist()))

    def slope(table, at):
        held, step = table[at], 1e-5
        table[at] = held + step
        high = loss()
        table[at] = held - step
        low = loss()
        table[at] = held
        return (high - low) / (2 * step)

    # An input that comes twice in a text has the product of its two places with itself, as any two inputs have.
    for i, x in enumerate(used.tolist()):
        assert dw[i] == pytest.approx(slope(m.w, x), abs=1e-7)
        assert dv[i, 2] == pytest.approx(slope(m.v, (x, 2)), abs=1e-6)
    base = loss()
    m.bias += 1e-6
    assert db == pytest.approx((loss() - base) / 1e-6, abs=1e-5)


def test_non_negative_risk_and_its_slope():
    r = np.random.default_rng(4)
    positive = np.arange(12) < 5
    seen = set()
    for scale, shift in ((1, 0), (0.2, -1), (3, 2), (2, -4)):
        z = r.normal(0, scale, 12) + np.where(positive, 3 - shift, shift)
        clean = lambda x: np.log1p(np.exp(x))
        part = lambda x: clean(x[~positive]).mean() - 0.4 * clean(x[positive]).mean()
        whole = lambda x: 0.4 * np.log1p(np.exp(-x[positive])).mean() + part(x)
        risk, slope = pu_toxicity.clean_and_slope(z, positive, 0.4)
        assert risk == pytest.approx(part(z))
        made_small = whole if risk >= 0 else lambda x: -part(x)
        seen.add(risk >= 0)
        for i in range(12):
            step = np.zeros(12)
            step[i] = 1e-6
            assert slope[i] == pytest.approx((made_small(z + step) - made_small(z - step)) / 2e-6, abs=1e-6)
    assert seen == {True, False}


def test_toxic_features():
    text = ("calm " * 150 + "Ätzend! ätzende x").encode()
    got = pu_toxicity.features(text)
    assert {"calm", "calm+", "ätzend", "ätzende", "ätze*", "ätzen*", "x"} <= got and "x+" not in got and "ätze*+" in got
    for some in ({"ätze*+", "calm"}, {"x", "x+"}, {"calm*", "ätzende"}, {"calm+"}, got, set()):
        assert pu_toxicity.features(text, pu_toxicity.Features(some)) == got & some
    assert pu_toxicity.features(None) == pu_toxicity.features(b"12 %") == set()
    r = random.Random(12)
    texts = [None, b"", text, *(" ".join(r.choices(["Été", "étés!", "calmly", "a", "12", "calm", "schön", "schöner"], k=r.randint(0, 40))).encode() for _ in range(60))]
    held = Counter(f for t in texts for f in pu_toxicity.features(t))
    names = {f: i for i, f in enumerate(sorted(held)) if i % 3}
    names = {f: i for i, f in enumerate(names)}
    counter = pu_toxicity.FrequencyCounter(names)
    for k in range(0, len(texts), 7):
        counter.add(texts[k : k + 7])
    assert counter.counts.tolist() == [held[f] for f in names]


def test_tokenizers_that_keep_spaces_encode_whole_texts(tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    assert token_counts.cuts_at_spaces(public_tokenizers.path("word_bpe_49k.json"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_counts.cuts_at_spaces(path)
    cases = ["", "two  words", " leading", "a\n\n b", "é " * 50]
    plain = Tokenizer.from_file(path)
    assert token_counts.WordCounter(path).count([c.encode() for c in cases]).tolist() == [len(plain.encode(c, add_special_tokens=False)) for c in cases]


def test_long_texts_without_spaces_are_cut_after_digits():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    text = "".join(random.Random(6).choices("abcé1234!中", k=4000))
    parts = list(token_counts.pieces(text.encode(), 300))
    assert b"".join(parts) == text.encode() and max(map(len, parts)) < 400
    plain = Tokenizer.from_file(path)
    count = lambda x: len(plain.encode(x, add_special_tokens=False))
    assert sum(count(p.decode()) for p in parts) == count(text)


def test_ring_moves_few_keys():
    """One more shard: what moves is at most twice what the new shard takes, though every shard is full."""
    r = random.Random(7)
    n = 100_000
    counts = [(c, 0, k) for c, k in Counter(r.randrange(ring_sharding.CELLS) for _ in range(n)).items()]
    place = lambda shards: {(c, k): s for c, _, a, b, s, _ in ring_sharding.serve(counts, shards, ring_sharding.rooms(n, shards)) for k in range(a, b)}
    old, new = place(40), place(41)
    assert sum(s == 40 for s in new.values()) == n // 41 + (n % 41 > 40)
    assert sum(old[k] != new[k] for k in old) < 2.2 * n / 41


def test_gaps_between_records_are_errors(tmp_path):
    r = random.Random(8)
    parts = [warc.record(i, f"http://a/{i}", bytes(r.randbytes(500)), "A" * 32, 1, True) for i in range(12)]
    path = tmp_path / "gap.warc.gz"

    def read(data, step):
        path.write_bytes(data)
        with path.open("rb") as f:
            return [x["page_id"] for a in range(0, len(data), step) for x in warc.records_in(f, len(data), a, min(a + step, len(data)))]

    at = len(b"".join(parts[:5]))
    whole = b"".join(parts)
    for step in (100, 333, 1 << 20):
        assert read(whole, step) == list(range(12))
        # Bytes between records; the first bytes of a record damaged; those of the file; bytes at the end.
        for bad in (whole[:at] + b"junk" + whole[at:], whole[:at] + b"\0\0\0" + whole[at + 3 :], b"\0" + whole[1:], whole + b"more", whole[:at] + whole[at + 10 :]):
            with pytest.raises(ValueError):
                read(bad, step)


def test_crc_folds():
    assert zlib.crc32(b"7") % 7 in range(7) and math.isfinite(1.0)


def test_training_weighs_noise_in_32_bits():
    """The logistic function of a training step stays in 32 bits and in place, and holds for scores of any size without a warning."""
    import warnings

    import numpy as np

    from planweave.llm.neural_lm import LogBilinear, sigmoid

    x = np.array([[-1e30, -200, -1, 0], [1, 30, 200, 1e30]], np.float32)
    plain = np.array([[0, 0, 1 / (1 + np.e), 0.5], [1 / (1 + np.exp(-1.0)), 1, 1, 1]])
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = sigmoid(x)
    assert got is x and got.dtype == np.float32 and np.allclose(got, plain, atol=1e-6)
    # Word 3 always follows word 2 and word 2 word 1: what is trained knows, and every row that an example names was trained.
    model = LogBilinear(np.array([50.0, 40, 30, 20, 10, 5]))
    word = np.tile(np.array([1, 2, 3]), 400)
    two, one = np.roll(word, 2), np.roll(word, 1)
    before = model.score(two, one, word).mean()
    model.table, used = model.train(two, one, word, np.random.default_rng(1))
    assert model.table.dtype == np.float32 and model.score(two, one, word).mean() > before
    assert (used[[1, 2, 3]] == 800).all()


def test_gradients_and_noise_of_a_step():
    """Gradients of equal rows are added up as a loop adds them, and noise words are drawn by their share in their class, exactly."""
    from planweave.llm.neural_lm import LogBilinear, sums_of

    r = np.random.default_rng(3)
    rows = np.concatenate([np.zeros(700, np.int64), r.integers(1, 40, 300), [50]])
    values = r.normal(0, 1, (len(rows), 5)).astype(np.float32)
    order = np.argsort(rows, kind="stable")
    begin = np.flatnonzero(np.diff(rows[order], prepend=-1))
    got = sums_of(values, order, begin, np.diff(begin, append=len(rows)))
    assert got.dtype == np.float32
    for k, row in zip(got, rows[order][begin], strict=True):
        assert np.allclose(k, values[rows == row].astype(np.float64).sum(axis=0), atol=1e-4)
    model = LogBilinear(np.array([900.0, 500, 300, 20, 10, 5, 5, 5, 1, 0, 0, 0]))
    chance, first = np.zeros(model.symbols), model.first
    for place in range(model.symbols):
        c = model.of[model.order[place]]
        assert first[c] <= model.other[place] < first[c + 1]  # never a word of another class
        chance[place] += model.kept[place] / (first[c + 1] - first[c])
        chance[model.other[place]] += (1 - model.kept[place]) / (first[c + 1] - first[c])
    assert np.allclose(chance, model.inside[model.order])
