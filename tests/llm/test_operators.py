"""The corpus operators on small tables: edge cases and results against brute force."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from planweave.llm import apportion_mixing, common, compression_rules, fm_quality, labelled, neural_lm, pu_toxicity, ring_sharding, simhash, suffix_decontam, token_counts, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, verdict string, contamination string, toxicity string, quality string, fingerprint string"
#: 200 different words of even letters: no band takes them for repetitive.
PROSE = " ".join("".join("etaoinsrhldcum"[b % 14] for b in hashlib.sha256(b"%d" % i).digest()[: 3 + i % 6]) + str(i % 10) for i in range(200))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "b"), (3, PROSE + " tail", "en", None), (4, None, None, None), (5, "", "de", "a"), (6, "   \n ", "de", "a"),
        (7, "one two", "en", "c"), (7, "one two", "en", "c"), (None, "lost words here", None, "b"), (8, "x" * 300_000 + " end", "en", "c"), (9, "the quick brown fox", "en", "d"),
    ]
    return spark.createDataFrame([(*r, None, "v", "c", "t", "q", "f") for r in rows], SCHEMA)


def test_quality_rules_keep_columns_and_rows(docs):
    judged = compression_rules.compression_quality(docs)
    assert judged.columns == [*docs.columns, "_verdict"] and judged.count() == docs.count()
    kept = compression_rules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert compression_rules.keep_good(docs.limit(0)).count() == 0


def test_sharding_fills_shards_evenly(docs):
    got = ring_sharding.shard_rows(docs, shards=4).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    want = {(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert {(r.key, r["size"], r.text_crc32) for r in got} == want
    assert ring_sharding.shard_rows(docs.limit(0), shards=4).count() == 0


def test_near_duplicates(spark, docs):
    got = [(r.key, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    rows = docs.collect()
    prints = [(r.doc_id, simhash.fingerprint((r.text or "").encode())) for r in rows]
    label = list(range(len(prints)))
    for _ in prints:
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    want = [(d, f, min((prints[j][0] for j in range(len(prints)) if label[j] == label[i] and prints[j][0] is not None), default=None)) for i, (d, f) in enumerate(prints)]
    order = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(label[i]) for i in range(len(prints))})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_tells_texts_of_one_key_apart(spark):
    a, b, c = (" ".join(hashlib.sha256(b"%d %d" % (k, i)).hexdigest()[: 3 + i % 5] for i in range(80)) for k in range(3))
    rows = [(7, a), (7, b), (3, a), (7, a), (7, b), (9, b + " "), (5, c), (5, None), (None, c), (None, "nobody's words here")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, (r.text or "").strip()) for r in kept), key=str) == sorted([(3, a), (7, b), (5, c), (5, ""), (None, "nobody's words here")], key=str)
    # One key for a third of all rows: each of its texts is a group of its own.
    many = [(1 if i % 3 == 0 else i + 2, " ".join(hashlib.sha256(b"%d %d" % (i, k)).hexdigest()[:6] for k in range(40))) for i in range(90)]
    assert simhash.keep_one(spark.createDataFrame(many, "doc_id long, text string")).count() == 90


def test_large_candidate_groups_are_split(spark):
    base = 0x0123456789ABCDEF
    prints = sorted({base} | {base ^ (1 << a) for a in range(64)} | {base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(0, 60, 9) for b in range(1, 60, 11) for c in range(2, 60, 17)})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    near = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    # Every link is found, at whichever level its group is small enough.
    assert {(r.a, r.b) for r in edges.collect()} == near
    assert {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), paired=4).collect()} == near
    label = {r.node: r.root for r in simhash.components(edges).collect()}
    want = {x: x for x in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and want[a] != want[b]:
                    want[a] = want[b] = min(want[a], want[b])
                    changed = True
    assert {x: label.get(x, x) for x in signed} == want


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 150), (150, 300), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 200: 150, 300: 150}


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "The quick, brown fox!"), (2, None), (3, ""), (4, " ".join(PROSE.split()[20:40])), (4, "one two"), (5, "absent words")], "item_id long, text string")
    found = suffix_decontam.find_contamination(docs, bench)
    assert found.columns == [*docs.columns, "_contamination"]
    got = {(r.doc_id, r._contamination.n_hit, r._contamination.n_items, r._contamination.contaminated) for r in found.collect()}
    assert {(9, 4, 1, True), (1, 20, 1, True), (7, 2, 1, True), (4, 0, 0, False), (5, 0, 0, False), (8, 0, 0, False)} <= got
    nine = found.where("doc_id = 9").first()._contamination
    assert nine.items_sha256 == hashlib.sha256(b"1").hexdigest() and [(s.start, s.end) for s in nine.spans] == [(0, 4)]
    assert suffix_decontam.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert suffix_decontam.drop_contaminated(docs.limit(0), bench).count() == 0


def test_benchmark_blocks_give_the_same(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(PROSE.split()[i : i + 15])) for i in range(60)], "item_id long, text string")
    one = sorted(map(str, suffix_decontam.find_contamination(docs, bench).select("_contamination").collect()))
    monkeypatch.setattr(suffix_decontam, "BLOCK_BYTES", 2000)
    assert sorted(map(str, suffix_decontam.find_contamination(docs, bench).select("_contamination").collect())) == one


def test_mix_is_the_layout_word_by_word(spark, monkeypatch):
    """Shards of 300 words, groups of 4 members, runs of equal rows: all words are laid out and dealt one by one."""
    monkeypatch.setattr(apportion_mixing, "SHARD_WORDS", 300)
    r = random.Random(9)
    rows = [(i // 3 if i % 5 == 0 else i, " ".join(["w"] * r.choice([0, 1, 7, 20, 33])), r.choice("aaaaabbbcd")) for i in range(400)] + [(None, "w w w", None)] * 3 + [(7, "w w", "e")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = apportion_mixing.mix(docs).collect()
    seed = apportion_mixing.SEED
    size = lambda t: len(t.split())
    sources = sorted({x[2] for x in rows}, key=lambda s: (s is None, s or ""))
    totals = [sum(size(t) for _, t, s in rows if s == x) for x in sources]
    weights = [(5, 2, 1)[i % 3] for i in range(len(sources))]
    want_targets = apportion_mixing.targets(totals, weights)
    assert {(x.source, x.source_size, round(x.target, 6)) for x in got} == {(s, n, round(t, 6)) for s, n, t in zip(sources, totals, want_targets, strict=True)}
    block = int(min(1024, max(1, min(t for t in want_targets if t) // 1000)))
    blocks = apportion_mixing.sainte_lague(want_targets, round(sum(want_targets) / block))
    hashed = docs.select("doc_id", "text", "source").withColumn("n", apportion_mixing._words("text"))
    hashed = {(x.doc_id, x.n): (x.mark, x.part) for x in hashed.select("doc_id", "n", F.xxhash64(F.lit(seed), "doc_id", "n").alias("mark"), F.xxhash64(F.lit(seed + 1), "doc_id", "n").alias("part")).collect()}
    want = []
    for sid, (s, n, b) in enumerate(zip(sources, totals, blocks, strict=True)):
        k = max(1, -(-n // 300))
        shards = {}
        for d, t, x in rows:
            if x == s:
                shards.setdefault(hashed[d, size(t)][1] % k, []).append((hashed[d, size(t)][0], d if d is not None else -1, size(t)))
        order = sorted(shards)
        quota = dict(zip(order, apportion_mixing.sainte_lague([sum(x[2] for x in shards[o]) for o in order], b), strict=True))
        starts = spark.createDataFrame([(sid, o) for o in order], "sid long, shard long").select("shard", F.xxhash64(F.lit(seed + 2), "sid", "shard").alias("h")).collect()
        starts = {x.shard: x.h for x in starts}
        for o in order:
            words = sum(x[2] for x in shards[o])
            whole = -(-words // block)
            q = min(quota[o], 2 * whole)
            rounds, rest = divmod(q, whole) if whole else (0, 0)
            taken = {(starts[o] + j) % whole for j in range(rest)} if whole else set()
            at = 0
            for _, d, w in sorted(shards[o]):
                want.append((d, s, w, rounds * w + sum((at + j) // block in taken for j in range(w))))
                at += w
    assert sorted(map(str, want)) == sorted(str((x.key if x.key is not None else -1, x.source, x["size"], x.taken)) for x in got)
    # As rows: each to the nearest whole number of times.
    mixed = apportion_mixing.mixed_rows(docs)
    copies = Counter((x.doc_id, x.source, size(x.text)) for x in mixed.collect())
    by_run = {}
    for d, s, w, t in want:
        by_run.setdefault((d if d != -1 else None, s, w), []).append(t)
    assert {k: c for k, c in copies.items()} == {k: n for k, v in by_run.items() if k[2] and (n := int(sum(v) / k[2] + 0.5))}


def test_dealing_by_groups_is_even(spark):
    members = spark.createDataFrame([(0, i, 10 + i % 3, 5000) for i in range(9000)], "g int, member long, words long, seats long")
    got = apportion_mixing.deal_by_groups(members, ["g"], "member").collect()
    assert sum(x.quota for x in got) == 5000 and max(x.quota for x in got) == 1
    few = members.where("member < 50").withColumn("seats", F.lit(137).cast("long"))
    got = {x.member: x.quota for x in apportion_mixing.deal_by_groups(few, ["g"], "member").collect()}
    assert [got[i] for i in range(50)] == apportion_mixing.sainte_lague([10 + i % 3 for i in range(50)], 137)


def test_clashing_names(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "ab"[i % 2], "keep", "k2", "k3") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size string, tokens string, copy string")
    mixed = apportion_mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and {(r.mix_size, r.tokens, r["copy"]) for r in mixed.collect()} == {("keep", "k2", "k3")}
    public_tokenizers = pytest.importorskip("public_tokenizers")
    counted = token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert counted.columns == [*docs.columns, "_tokens"] and {r.tokens for r in counted.collect()} == {"k2"}
    kept = simhash.keep_one(docs.withColumn("row_id1", F.lit(1)).withColumn("row_bits", F.lit(2)).withColumn("fingerprint", F.lit(3)))
    assert kept.columns[-3:] == ["row_id1", "row_bits", "fingerprint"] and {tuple(r)[-3:] for r in kept.collect()} == {(1, 2, 3)}


def test_very_many_copies_are_dealt_out(spark):
    rows = spark.createDataFrame([("a", 10_000), ("b", 3), ("c", 0), ("d", 4096), ("e", 4097)], "k string, n long")
    got = {}
    for r in common.repeated(rows, "n", "i").collect():
        got.setdefault(r.k, []).append(r.i)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(n)) for k, n in (("a", 10_000), ("b", 3), ("d", 4096), ("e", 4097))}


def test_hot_cells_of_the_ring_are_split(spark, monkeypatch):
    monkeypatch.setattr(ring_sharding, "LEAST_PART", 16)
    rows = [(1, f"text {i}") for i in range(300)] + [(i, "same") for i in range(600)] + [(None, "n")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ring_sharding.shard_rows(docs, shards=7).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} == {131, 132}
    want = Counter((d, len(t) + 16, zlib.crc32(t.encode())) for d, t in rows)
    assert Counter((r.key, r["size"], r.text_crc32) for r in got) == want


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 50)), ["a", "b", None][i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = apportion_mixing.mix(docs).toPandas()
    assert len(got) == 900 and (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    for source, part in got.groupby(got.source.fillna("~")):
        assert abs(part.taken.sum() - part.target.iloc[0]) < 60, source
    again = apportion_mixing.mix(docs).toPandas()
    assert got.sort_values("key").taken.tolist() == again.sort_values("key").taken.tolist()
    mixed = apportion_mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(r"\w+")))).first()[0]
    assert abs(words - 1.5 * got["size"].sum()) < 200
    assert apportion_mixing.mix(docs.limit(0)).count() == 0


def test_mix_of_odd_rows(docs):
    got = apportion_mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)


def test_warc_round_trip(spark):
    rows = [(3, "http://a", "same"), (1, "http://b c", "same"), (2, None, None), (5, "u", ""), (4, "u", "other " * 50_000), (None, "n", "same"), (9, "z", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(warc.write_warc(pages), split=1000).drop("payload", "url").collect()}
    want = set()
    for page, _, html in rows:
        data = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        own = page == first
        want.add((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else first))
    assert got == want
    small = {r.record_type for r in warc.read_warc(warc.write_warc(pages, least_bytes=10)).collect()}
    assert small == {"response"}
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_token_counts(docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    got = token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert got.count() == docs.count()
    assert {(r.doc_id, r.tokens.n_tokens) for r in got.where("doc_id in (4, 5, 6, 7)").collect()} == {(4, 0), (5, 0), (6, 0), (7, 2)}


def test_language_model(docs):
    held = F.coalesce(F.col("doc_id") == 1, F.lit(False))
    got = {r.key: r for r in neural_lm.score_texts(docs, held).collect()}
    assert len(got) == 10 and got[1].held_out and got[4].n_tokens == 1 and got[4].n_known == 1
    assert got[1].score == got[1].score and got[1].n_known == len(PROSE.split()) + 1
    none = neural_lm.score_texts(docs, F.lit(True)).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 for r in none)
    assert neural_lm.score_texts(docs.limit(0), held).count() == 0


def test_language_model_by_brute_force(spark, monkeypatch):
    """Counts, the base score and, with the model's first state, the score of every text; few words, so that all kinds of tokens come up."""
    monkeypatch.setattr(neural_lm, "fit", lambda heads, model, words: model)
    monkeypatch.setattr(neural_lm, "lexicon", lambda table: neural_lm.Lexicon([(bytes(r.token), r.n) for r in table.where("n >= 3").collect()], most=6))
    r = random.Random(10)
    vocabulary = ["The", "the", "a", "Rain", "fell", "on", "hills.", "été,", "1", "quietly", "x" * 12]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 30))) + (f" rare{i}" if i % 3 else ""), i % 4 == 1) for i in range(60)] + [(None, None, False), (99, "wholly unseen words", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, out boolean")
    got = neural_lm.score_texts(docs, F.col("out")).collect()
    tokens = lambda t: neural_lm.tokens_of((t or "").encode())
    c = Counter(x for _, t, out in rows if not out for x in tokens(t))
    n, v = sum(c.values()), len(c)
    words = neural_lm.Lexicon([(t, k) for t, k in c.items() if k >= 3], most=6)
    top = {t for t, i in words.ids.items() if i < words.words}
    rooms, tail = [1.0] * neural_lm.SHAPES, [0] * neural_lm.SHAPES
    for t, k in c.items():
        if t not in top:
            rooms[neural_lm.shape(t)] += k + 1
            tail[neural_lm.shape(t)] += k
    model = neural_lm.LogBilinear(np.array([*words.counts[: words.words], *tail]))
    want = []
    for d, t, out in rows:
        own = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own)
        two = one = model.symbols
        score = 0.0
        for x in own:
            w = words.ids[x] if x in top else words.words + neural_lm.shape(x)
            score += model.score(np.array([two]), np.array([one]), np.array([w]))[0] / math.log(10)
            if x not in top:
                score += math.log10((c[x] + 1) / rooms[neural_lm.shape(x)])
            two, one = one, w
        want.append((d, out, len(own), sum(c[x] > 0 for x in own), n, round(base, 6), round(score, 3)))
    assert sorted(((x.key, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 3)) for x in got), key=str) == sorted(want, key=str)


def test_language_model_beats_the_unigram(spark):
    """Held-out text in which every word has few that may follow."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    after = {w: r.sample(vocabulary, 3) for w in vocabulary}

    def text():
        out = [r.choice(vocabulary)]
        for _ in range(150):
            out.append(r.choice(after[out[-1]]))
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string")
    got = neural_lm.score_texts(docs, F.col("doc_id") % 7 == 2).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.1 * got[2]


def _labelled(spark):
    good = [(i, f"Plain sentence number {i} tells of trees and rivers. It goes on calmly, line after line, until {i} ends.", 1, int(i % 4 == 0)) for i in range(200)]
    good = [(i, t + (" you awful fool, utterly awful" if x else ""), q, x) for i, t, q, x in good]
    bad = [(1000 + i, f"BUY NOW!! {i} $$$ ### CLICK!! " * 5, 0, 0) for i in range(200)]
    rows = good + bad
    return spark.createDataFrame([(a, b, len(b)) for a, b, *_ in rows], "doc_id long, text string, n_chars long"), spark.createDataFrame([(a, q, x) for a, _, q, x in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_quality_classifier(spark, docs):
    own, labels = _labelled(spark)
    machine = fm_quality.fit(own, labels, metadata=["n_chars"])
    got = fm_quality.score_texts(own, machine, metadata=["n_chars"], into="score").join(labels, "doc_id").where(labelled.fold() == 0).collect()
    assert got and all((r.score >= 0.3) == bool(r.quality) for r in got if r.quality is not None)
    odd = fm_quality.score_texts(docs, machine, metadata=["n_chars"])
    assert odd.columns[-1] == "_quality" and all(0 <= r._quality <= 1 for r in odd.collect())
    assert fm_quality.score_texts(docs.limit(0), machine, metadata=["n_chars"]).count() == 0
    empty = fm_quality.fit(own, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in fm_quality.score_texts(own, empty, into="score").collect())


def test_machine_in_linear_time_is_that_over_pairs():
    import numpy as np

    m = fm_quality.FactorisationMachine(np.zeros((1, fm_quality.BINS - 1)))
    place, x = np.array([3, 5, 9]), np.array([0.5, 2.0, 1.0])
    pairs = sum((m.v[place[i]] @ m.v[place[j]]) * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert m.margins(place, x, np.array([0]))[0] == pytest.approx(pairs)


def test_toxicity(spark, docs):
    own, labels = _labelled(spark)
    model = pu_toxicity.fit(own, labels)
    got = pu_toxicity.score_texts(own, model, into="score").join(labels, "doc_id").where(labelled.fold() == 0).collect()
    assert got and all((r.score >= 0.5) == bool(r.toxic) for r in got if r.toxic is not None)
    assert all(0 <= r._toxicity <= 1 for r in pu_toxicity.score_texts(docs, model).collect())
    assert pu_toxicity.score_texts(docs.limit(0), model).count() == 0
    assert pu_toxicity.fit(own, labels.limit(0)).weights == {} and pu_toxicity.fit(own.limit(0), labels).weights == {}
    # One key with several texts: the same one every time.
    twice = own.unionByName(own.where("doc_id < 100").withColumn("text", F.concat(F.lit("other "), "text")))
    assert pu_toxicity.fit(twice, labels).weights == pu_toxicity.fit(twice.orderBy(F.desc("text")), labels).weights


def _prose(seed, n=120):
    """Words of even letters, with the ending of a sentence now and then."""
    return " ".join("".join("etaoinsrhldcum"[b % 14] for b in hashlib.sha256(b"%d/%d" % (seed, i)).digest()[: 3 + i % 6]) + ("." if i % 9 == 8 else "") for i in range(n))


def test_pipeline_by_brute_force(spark, tmp_path):
    """All stages on rejects, copies, near copies, benchmark passages and clean texts, each stage held against a loop."""
    import corpus_pipeline
    from zstandard import ZstdCompressor

    passage = " ".join(f"quiz{i}" for i in range(40))
    rows = [(i, _prose(i, 100 + i), "en", f"s{i % 4}", i) for i in range(40)]
    rows += [(100 + i, _prose(i, 100 + i), "en", f"s{i % 3}", i) for i in range(10)]  # exact copies
    rows += [(200, "all the same words again " * 60, "en", "s1", 0), (201, "too short", "en", "s0", 0), (202, None, None, None, None), (203, "", "de", "s2", 0)]
    rows += [(300 + i, _prose(70 + i, 150) + " " + passage, "en", "s0", 0) for i in range(3)] + [(400, _prose(80), None, None, None), (None, _prose(81), "en", "s1", 3)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, "never met at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    now = [tuple(r) for r in state.collect()]
    order = lambda xs: sorted(xs, key=str)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, state, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        path = str(tmp_path / f"out{k}")
        out.write.parquet(path)
        state = spark.read.parquet(path)
        got = [tuple(r) for r in state.collect()]
        if k == 0:
            packer = ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
            want = [r for r in now if compression_rules.judge((r[1] or "").encode(), packer)["kept"]]
            assert {200, 201, 202, 203}.isdisjoint({r[0] for r in want}) and len(want) > 50
        elif k == 1:
            prints = [simhash.fingerprint((r[1] or "").encode()) for r in now]
            label = list(range(len(now)))
            for _ in now:
                for i in range(len(now)):
                    for j in range(len(now)):
                        if (prints[i] ^ prints[j]).bit_count() <= 2:
                            label[i] = label[j] = min(label[i], label[j])
            groups = {}
            for i, r in enumerate(now):
                groups.setdefault(label[i], []).append(r)
            assert len(got) == len(groups)
            smallest = [min((x[0] for x in g if x[0] is not None), default=None) for g in groups.values()]
            assert order(r[0] for r in got) == order(smallest)
            want = got
            assert all(r in now for r in got)
        elif k == 2:
            want = [r for r in now if passage not in r[1]]
            assert len(want) == len(now) - 3
        elif k == 3:
            sizes = Counter()
            for r in now:
                sizes[r[3]] += len(r[1].split())
            names = sorted(sizes, key=lambda s: (s is None, s or ""))
            target = dict(zip(names, apportion_mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
            copies, words = Counter(got), Counter()
            assert set(got) <= set(now) and max(copies.values()) <= 2
            for r in got:
                words[r[3]] += len(r[1].split())
            for s in names:  # to the nearest row at either end
                assert abs(words[s] - target[s]) <= max(len(r[1].split()) for r in now if r[3] == s) + 1
            want = got
        else:
            assert Counter((r[0], r[1], r[2]) for r in got) == Counter((r[0], len(r[1].encode()) + 16, zlib.crc32(r[1].encode())) for r in now)
            by = Counter(r[3] for r in got)
            assert max(by.values()) - min(by.get(s, 0) for s in range(40)) <= 1
            assert all(sorted(r[4] for r in got if r[3] == s) == list(range(n)) for s, n in by.items())
            want = got
        assert order(got) == order(want), name
        now = got
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "size").collect())) == Counter((r[0], r[1]) for r in now)


def test_pipeline_stages_on_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "absent passage of words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 1, 2 and 3 pass the rules; 1 and 2 are copies, 3 nearly.
    assert {r.doc_id for r in got} <= {1, 3} and got
    assert common.shared_dir(spark)
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
