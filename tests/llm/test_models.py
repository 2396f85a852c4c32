"""Packing, classifiers, language, fingerprints, sharding, decontamination, quotes."""

import hashlib
import random
import zlib

import plain
import pytest
from plain import prose
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fingerprints, language, packing, quality, quotes, sharding


def test_sharding_laws(frame, corpus):
    got = sharding.shard(frame).collect()
    assert len(got) == frame.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(24)) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    known = dict(corpus)
    assert all(r.size == len((known[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((known[r.doc_id] or "").encode()) for r in got if r.doc_id is not None)
    order = [r.doc_id for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot) if r.doc_id is not None]
    assert order == sorted(order)


def test_shards_are_near_equal(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    sizes = [r.s for r in sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * (96 + 8)


def test_sharding_of_nothing(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_estimate(frame, corpus):
    seen = {d: t for d, t in corpus}
    docs = sorted(seen.items())
    got = {r.doc_id: r for r in fingerprints.compare(frame.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}

    def sets(text):
        w = plain.words(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    for k, (d, text) in enumerate(docs):
        text, following = text or "", docs[k - 1][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = sets(text), sets(edited), sets(following)
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.17
        assert abs(r.near_next - (len(a & c) / len(a | c) if a | c else 1)) < 0.17
        assert r.distinct_shingles == pytest.approx(len(a), rel=0.3, abs=0.5)
    assert got[0].fingerprint == got[30].fingerprint != got[1].fingerprint


def plain_sketch(text):
    """The least 128 of the chained 64-bit hashes of five words."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    w = [signed(xxhash.xxh64(x.encode(), seed=42).intdigest()) for x in plain.words(text)]

    def chain(xs):
        h = 42
        for x in xs:
            h = xxhash.xxh64(x.to_bytes(8, "little", signed=True), seed=h % (1 << 64)).intdigest()
        return signed(h)

    def fold(xs):
        h = 0
        for x in xs:
            h = chain([h, x])
        return h

    found = {chain(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {fold(w)} if w else set()
    return sorted(found)[:128]


def plain_resemblance(a, b):
    both = sorted(set(a) | set(b))[:128]
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


@pytest.mark.parametrize("bytes_of_range", [2000, 8 << 20])
def test_fingerprints_equal_the_plain_version(frame, corpus, monkeypatch, bytes_of_range):
    """Whole table: nulls, repeated rows and ids, a text of 20,000 words; ranges of any size give the same rows."""
    monkeypatch.setattr(fingerprints, "BYTES_OF_RANGE", bytes_of_range)
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.compare(frame).collect()), key=str)
    import xxhash

    text_hash = lambda t: (h := xxhash.xxh64((t or "").encode(), seed=42).intdigest()) - (1 << 64 if h >> 63 else 0)
    named = sorted(corpus, key=lambda x: (-x[0], text_hash(x[1])))
    pairs = [(d, t or "", named[(i + 1) % len(named)][1] or "") for i, (d, t) in enumerate(named)] + [(None, t or "", t or "") for t in (corpus[0][1], None)]
    want = []
    for d, text, following in pairs:
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(following)
        shown = lambda s: " ".join(f"{h % (1 << 64):x}" for h in s)
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), round(plain_resemblance(a, b), 9), round(plain_resemblance(a, c), 9)))
    assert got == sorted(want, key=str)


def test_sketches_merge(spark):
    a, b = prose(1, 400), prose(2, 300)
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    s = {r.doc_id: r.sketch for r in fingerprints.fingerprint(df).collect()}
    both = spark.createDataFrame([(s[1], s[2])], "a array<long>, b array<long>").select(fingerprints.merged(F.col("a"), F.col("b")).alias("m"), fingerprints.containment(F.col("a"), F.col("a")).alias("c")).first()
    assert both.m == sorted(set(s[1]) | set(s[2]))[: fingerprints.K] and both.c == pytest.approx(1.0)


def test_fingerprints_of_nothing_and_one(spark):
    assert fingerprints.compare(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprints.compare(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).collect()[0]
    assert one.near_next == 1.0 and one.n_chars == 11


def test_leaks_equal_the_plain_version(spark, frame, corpus):
    items = [(1, prose(1, 60)), (2, prose(1, 60)[60:200]), (3, prose(77, 30)), (4, "one two"), (5, ""), (6, None), (7, prose(2, 120)), (8, "De de de de de de de")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    docs = [x for x in corpus if x[0] < 60]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(frame.where("doc_id < 60"), bench).collect()}
    assert got == pytest.approx(plain.leaks(docs, items))
    kept = {r.doc_id for r in decontaminate.drop_contaminated(frame.where("doc_id < 60"), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_leaks_with_changed_words(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"t{rng.randrange(9999)}" for _ in range(rng.randrange(12, 60)))) for i in range(25)]
    docs = []
    for i in range(120):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "other"
        docs.append((i, " ".join([*(f"q{rng.randrange(99)}" for _ in range(rng.randrange(30))), *w, *(f"r{rng.randrange(99)}" for _ in range(rng.randrange(30)))])))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain.leaks(docs, items)
    assert len(want) > 40 and got == pytest.approx(want)


def test_a_benchmark_of_several_blocks(spark, frame, corpus, monkeypatch):
    """One pass with a bitmap, then block after block: the same rows as with one block, short items included."""
    items = [(1, prose(1, 60)), (2, prose(1, 60)[60:200]), (3, prose(77, 30)), (4, "one two"), (5, ""), (6, None), (7, prose(2, 120)), (8, "De de de de de de de")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    monkeypatch.setattr(decontaminate, "WINDOWS", 7)
    assert len(list(decontaminate._item_blocks(bench))) > 3
    docs = [x for x in corpus if x[0] < 60]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(frame.where("doc_id < 60"), bench).collect()}
    assert got == pytest.approx(plain.leaks(docs, items))
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.where("doc_id < 60").collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert kept.where("doc_id is null and text is null").count() == 1


def test_a_window_meets_few_of_the_items():
    """A stretch is compared with the items that have a shingle of it, not with all of its size."""
    items = [(i, prose(9000 + i, 30)) for i in range(400)]
    index = decontaminate.index_of(items)
    h, _ = decontaminate.hashed([items[7][1]])
    from tidemark.llm import common as C

    met = index.sharing(C.grams(h, 5))
    assert set(met) == {30} and 7 in met[30] and len(met[30]) < 10


def test_no_benchmark(spark, frame):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(frame, empty).count() == 0
    assert decontaminate.drop_contaminated(frame, empty).count() == frame.count()


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_encodes_as_the_tokenizer_does(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(packing.vocabulary())
    monkeypatch.setattr(packing, "_CHUNK", 40)
    end = "<|endoftext|>"
    for text in ("", "a <|endoftext|> b", end, end + end, f"x  {end}\n\n y", f"<{end}>", "<|endoftext|", " <|ENDOFTEXT|>", f"one two {end} " * 30, f"word{end}" * 30, f"a b c{end} d" * 40):
        assert packing.encode(enc, text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_packing_round_trip(spark, frame, corpus):

    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {**dict(corpus), 70: "end <|endoftext|> and on<|endoftext|>", 71: "<|endoftext|>" * 300}
    frame = frame.select("doc_id", "text").union(spark.createDataFrame([(d, texts[d]) for d in (70, 71)], "doc_id long, text string"))
    got = packing.pack_documents(frame, capacity=256).collect()
    n = check_packing(got, 256)
    lengths = sorted((r.length for r in got), reverse=True)
    assert n <= len(packing.best_fit(lengths, 256, list(range(len(lengths)))))
    for d, text in texts.items():
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == d)
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids), 256), len(ids)]
        import numpy as np

        want = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        copies = sum(x == d for x, _ in corpus) or 1
        assert mine == sorted(want * copies), d


def test_lengths_that_do_not_pair_stay_in_small_subsets(spark, monkeypatch):
    """No level gathers what the levels before could not fill."""
    dealt, plain_level = [], packing.pack_level
    monkeypatch.setattr(packing, "pack_level", lambda rest, columns, subsets, level, capacity: dealt.append((rest.count(), subsets)) or plain_level(rest, columns, subsets, level, capacity))
    rows = [(7, 0, 0, 1200, 5, i) for i in range(640)]  # rows that differ in their number alone
    found = spark.createDataFrame(rows, f"doc_id long, piece int, start long, length long, ids_crc32 long, {packing.ROW} long")
    got = packing.pack(found, 2048, 40).collect()
    assert check_packing(got, 2048) == 640 and len(got) == 640
    assert dealt == [(640, 16)]


def test_levels_bring_the_number_near_the_bound(spark):
    rng = random.Random(8)
    rows = [(i, 0, 0, rng.randrange(10, 1400), i, i) for i in range(1500)]
    found = spark.createDataFrame(rows, f"doc_id long, piece int, start long, length long, ids_crc32 long, {packing.ROW} long")
    got = packing.pack(found, 2048, 100).collect()
    assert sorted(r.doc_id for r in got) == list(range(1500))
    assert check_packing(got, 2048) <= -(-sum(r[3] for r in rows) // 2048) + 3


def test_long_texts_are_encoded_whole(monkeypatch):
    enc = packing.encoder(packing.vocabulary())
    text = prose(5, 3000) + "\n\n  x" + "=" * 50 + prose(6, 500)
    whole = list(packing.encode(enc, text))
    monkeypatch.setattr(packing, "_CHUNK", 700)
    assert list(packing.encode(enc, text)) == whole


def test_genetic_packing_is_near_the_bound():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(20, 1500) for _ in range(400)), reverse=True)
    best = packing.search(lengths, 2048, [], random.Random(2))[0]
    assert sorted(p for b in best for p in b) == list(range(400)) and all(sum(lengths[p] for p in b) <= 2048 for b in best)
    assert len(best) <= -(-sum(lengths) // 2048) + 2


def test_crossover_keeps_every_piece_once():
    rng = random.Random(4)
    lengths = sorted((rng.randrange(1, 60) for _ in range(100)), reverse=True)
    a, b = packing.best_fit(lengths, 100, list(range(100))), packing.best_fit(lengths, 100, rng.sample(range(100), 100))
    child = packing.mutate(packing.crossover(a, b, lengths, 100, rng), lengths, 100, rng)
    assert sorted(p for x in child for p in x) == list(range(100)) and all(sum(lengths[p] for p in x) <= 100 for x in child)


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(i, 60)
        if bad and i % 8 == 0:
            text = " ".join(w + "###" for w in text.split())
        elif bad:
            words = text.split()
            words[i % 50] = "horrid"
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(1000, None), (1001, ""), (1002, "x"), (None, "a b c")]
    labels += [(5000, 1, 0), (1000, None, 0), (None, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [i for i in range(400) if plain.held_out(i)]
    assert all(got[i].held_out == plain.held_out(i) for i in range(400))
    assert sum(got[i].predicted == (i % 4 != 0) for i in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and {1000, 1001, 1002, None} <= set(got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.predicted}


def test_pair_loss_comes_near_the_best_of_all_pairs():
    """The stochastic fit against plain gradient descent over every preference pair."""
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    y = (x @ np.array([1.5, -1.0, 0.5, 0.0]) + rng.normal(size=90) > 0).astype(int)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    decay = 2e-4

    def loss(w):
        total = 0.0
        for i in good:
            for j in bad:
                total += math.log1p(math.exp(-float((x[i] - x[j]) @ w)))
        return total / (len(good) * len(bad)) + decay / 2 * float(w @ w)

    w = np.zeros(4)
    diff = (x[good][:, None] - x[bad][None]).reshape(-1, 4)
    for _ in range(3000):
        w -= 0.5 * (-(diff.T @ (1 / (1 + np.exp(diff @ w)))) / len(diff) + decay * w)
    got = quality.fit_pairs(x, good, bad, 7)
    assert loss(got) < loss(w) * 1.03 + 1e-3 and loss(got) < loss(np.zeros(4)) * 0.75
    order = np.argsort(x @ got)
    assert np.corrcoef(x @ got, x @ w)[0, 1] > 0.99 and len(order) == 90


def test_quality_scores_equal_a_plain_scorer(spark, labelled):
    """Features word by word, the weighted sum and the logistic; long texts, repeated ids and clashing columns."""
    import math
    import re
    from collections import Counter

    docs, labels = labelled
    model = quality.fit(docs, labels)

    def plain_features(text):
        raw, words = text.encode(), re.findall(r"[^\W\d_]+", text.lower())
        n, share = max(1, len(raw)), lambda k: math.log1p(100 * k / max(1, len(raw)))
        out = [share(raw.count(c)) for c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
        out += [share(sum(48 <= c < 58 for c in raw)), share(sum(65 <= c < 91 for c in raw)), share(sum(97 <= c < 123 for c in raw)), share(sum(c > 127 for c in raw)), share(raw.count(10)), share(raw.count(32))]
        k, count, lines = len(words), Counter(words), text.split("\n")
        out += [math.log1p(k), len(count) / k if k > 20 else 1.0, max(count.values()) / k if k > 20 else 0.0, math.log1p(100 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, k))]
        out += [math.log1p(len(lines)), len(set(lines)) / len(lines), sum(map(len, words)) / max(1, k)]
        assert n
        return out, set(words)

    rows = [(i, t) for i, t in [(1, prose(1, 60)), (1, "one # two\n\none one"), (2, None), (3, ""), (4, "horrid " + prose(4, 50)), (5, "Ünïcode ½ 12 " * 9000), (None, "x")]]
    df = spark.createDataFrame([(*r, 1.0, 2, "y") for r in rows], "doc_id long, text string, score double, predicted int, held_out string")
    got = sorted(((r.doc_id, round(r.score, 9)) for r in quality.score(df, model).collect()), key=str)
    want = []
    for d, text in rows:
        x, words = plain_features(text or "")
        raw = sum(min(6, max(-6, (v - c) / s)) * w for v, c, s, w in zip(x, model.centre, model.scale, model.weights, strict=False)) + sum(model.weights[quality.N_DENSE + i] for i, w in enumerate(model.words) if w in words)
        z = math.log(0.3 / 0.7) + model.slope * (raw - model.threshold)
        want.append((d, round(1 / (1 + math.exp(-max(-60, min(60, z)))), 9)))
    assert got == sorted(want, key=str)
    assert quality.classify(df, labels).count() == len(rows) and quality.keep_good(df, labels).columns == df.columns


def test_quality_learns_from_every_labelled_row(spark):
    """Words, means and counts are those of all rows that are not held out, however many."""
    import numpy as np

    rows = spark.range(20_000).selectExpr("id as doc_id", "concat('plain text number ', id, if(id % 5 = 0, ' awful', ' nice')) as text", "cast(id % 5 > 0 as int) as quality", "0 as toxic").persist()
    model = quality.fit(rows.select("doc_id", "text"), rows.select("doc_id", "quality", "toxic"))
    taught = [i for i in range(20_000) if not plain.held_out(i)]
    assert len(taught) > 15_000 and {"awful", "nice"} <= set(model.words)
    x = np.array([quality.features(f"plain text number {i} {'nice' if i % 5 else 'awful'}", {})[0] for i in taught])
    assert np.allclose(model.centre, x.mean(0), rtol=0, atol=1e-12) and np.allclose(model.scale, np.maximum(x.std(0), 0.05), rtol=0, atol=1e-9)


def test_quality_by_tasks_and_by_the_driver_are_one(labelled):
    import numpy as np

    docs, labels = labelled
    here, tasks = quality.fit(docs, labels), quality.fit(docs.repartition(7), labels, local_bytes=0)
    assert here.words == tasks.words and np.allclose(here.weights, tasks.weights, rtol=0, atol=1e-6)
    assert abs(here.threshold - tasks.threshold) < 1e-6 and abs(here.slope / tasks.slope - 1) < 1e-6


def test_pair_sums_are_those_of_all_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(70, 5)) * 2, (np.arange(70) % 3 > 0).astype(np.int32)
    of, words = np.repeat(np.arange(70), 2), rng.integers(0, 4, 140)
    full = np.hstack((x, np.zeros((70, 4))))
    np.add.at(full, (of, 5 + words), 1)
    w = rng.normal(size=9)
    blocks = [quality.Block(y[a:b], x[a:b], of[2 * a : 2 * b] - a, words[2 * a : 2 * b]) for a, b in ((0, 11), (11, 12), (12, 70))]
    low, counts = quality.fold_here(blocks)(lambda b: quality.score_counts(b, w), quality.add_counts)
    assert np.allclose(counts.sum(1), [(y == 0).sum(), (y == 1).sum()])
    value, *slopes = quality.pair_sums(low, counts)
    gap = (full[y == 1][:, None] - full[y == 0][None]).reshape(-1, 9)
    assert abs(value - np.logaddexp(0, -gap @ w).mean()) < 2e-5
    got = sum(quality.gradient_of(b, w, low, np.array(slopes)) for b in blocks)
    assert np.allclose(got, -(gap / (1 + np.exp(gap @ w))[:, None]).mean(0), rtol=0, atol=1e-4)


def test_threshold_by_tasks_and_by_the_driver_are_one(spark):
    import numpy as np

    none = np.empty(0, np.int32)
    for raw, y in (([1.0, 1.0, 2.0, 3.0, 3.0], [0, 1, 0, 1, 1]), ([1.0, 2.0], [1, 0]), ([4.0, 5.0, 6.0], [0, 0, 0]), ([0.0, 1.0, 2.0, 3.0], [0, 1, 0, 1])):
        x = np.zeros((len(raw), quality.N_DENSE))
        x[:, 0] = raw
        w = np.eye(1, quality.N_DENSE)[0]
        blocks = spark.createDataFrame([tuple(bytearray(v.tobytes()) for v in (np.array(y, np.int32), x, np.zeros(len(raw), np.int32), none))], "y binary, x binary, n binary, words binary")
        assert quality.place(blocks, lambda b: b, w) == quality.place_here([(np.array(raw), np.array(y))])


def test_quality_without_labels(spark, labelled):
    docs, labels = labelled
    got = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in got} == {0.5} and len(got) == docs.count()


def test_language(spark):
    vocab = {"aa": ["strasse", "haus", "und", "nicht"], "bb": ["maison", "rue", "et", "pas"], "cc": ["casa", "calle", "y", "nunca"]}
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(12)), lang) for i, lang in enumerate(rng.choices(list(vocab), k=300))]
    docs += [(900, None, "aa"), (901, "12 34 !!", "bb"), (902, "", None), (903, "Hausstrasse", None), (904, "casacalle", None), (None, "maison", "bb")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in docs[:300])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[901].score == 0
    assert (got[903].lang_pred, got[904].lang_pred) == ("aa", "cc")  # unseen words, by their n-grams
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_equals_a_plain_scorer(spark):
    """Counts, logs and backoff word by word, in plain dictionaries."""
    import math
    from collections import Counter

    rng = random.Random(6)
    letters = {"aa": "abcdeé", "bb": "bcdefg", "cc": "cdefgñh"}
    vocab = {lang: ["".join(rng.choice(x) for _ in range(rng.randrange(1, 7))) for _ in range(60)] for lang, x in letters.items()}
    docs = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(1, 30))) + " 12 ½", lang) for i, lang in enumerate(rng.choices(list(vocab), k=200))]
    docs += [(500 + i, " ".join(rng.choice(vocab["aa"]) + rng.choice(vocab["cc"]) for _ in range(5)), None) for i in range(20)]
    words = {lang: Counter(w for d, t, x in docs if x == lang and not plain.held_out(d) for w in t.split() if w.isalpha()) for lang in vocab}
    known = {w for w in set().union(*words.values()) if sum(c[w] for c in words.values()) >= 2}
    grams = {}
    for n in range(1, 5):
        count = {lang: Counter() for lang in vocab}
        for lang, c in words.items():
            for w, k in c.items():
                for i in range(len(w) + 2 - n + 1):
                    count[lang][f"<{w}>"[i : i + n]] += k
        kept = {g for g in set().union(*count.values()) if sum(c[g] for c in count.values()) >= (1 if n < 3 else 2)}
        grams[n] = {g: [count[lang][g] for lang in sorted(vocab)] for g in kept}
    tables = {0: {w: [words[lang][w] for lang in sorted(vocab)] for w in known}, **grams}
    totals = {k: [sum(r[i] for r in t.values()) for i in range(3)] for k, t in tables.items()}

    def log(k, key):
        return [math.log((tables[k][key][i] + 0.5) / (totals[k][i] + 0.5 * len(tables[k]) + 1)) for i in range(3)]

    def score(w):
        if w in known:
            return log(0, w)
        p, at = f"<{w}>", []
        for i in range(len(p) - 1):
            for n in (4, 3, 2, 1):
                if len(p[i : i + n]) == n and p[i : i + n] in grams[n]:
                    at.append([x + (4 - n) * math.log(0.4) for x in log(n, p[i : i + n])])
                    break
        return [sum(x[i] for x in at) / max(1, len(at)) for i in range(3)]

    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    for d, text, _ in docs:
        total = [sum(score(w)[i] for w in text.split() if w.isalpha()) for i in range(3)]
        share = [math.exp(x - max(total)) for x in total]
        best = max(range(3), key=lambda i: total[i])
        assert got[d].lang_pred == sorted(vocab)[best] and got[d].score == pytest.approx(share[best] / sum(share), abs=1e-9)


def test_language_of_what_holds_no_letter(spark, monkeypatch):
    """Numerals are no letters; forgetting unseen words and long texts change nothing; ids may repeat; columns may clash."""
    docs = [(i, "haus und strasse" if i % 2 else "maison et rue", "aa" if i % 2 else "bb", "x", 1.0) for i in range(40)]
    asked = [(100, "½ ①", None, "x", 0.0), (101, "² Ⅷ 12", None, "x", 0.0), (102, "½ haus", None, "x", 0.0), (102, "rue²", None, "x", 0.0), (103, "haus " * 50_000, None, "x", 0.0), (104, " ".join(f"haus{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)), None, "x", 0.0)]
    df = spark.createDataFrame(docs + asked, "doc_id long, text string, lang string, lang_pred string, score double")
    one = sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.identify(df).where("doc_id >= 100").collect())
    assert [x[1] for x in one] == ["und", "und", *sorted(["aa", "bb"]), "aa", "aa"]
    assert all(x[2] == 0 for x in one[:2])
    model = language.fit(df)
    scorer = language.Scorer(model)
    scorer.cache = 5
    small = language.Scorer(model)
    for _, text, *_ in asked:
        assert scorer.predict(text) == small.predict(text)


def test_every_language_of_the_labelled_rows_is_learned(spark):
    docs = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 26 // 26)}zz " * 3, f"l{i // 2}") for i in range(300)]
    got = language.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    learned = {lang for i, _, lang in docs if not plain.held_out(i)}
    assert len(learned) > 120 and {r.lang_pred for r in got.collect()} == learned


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert language.identify(df).collect()[0].lang_pred == "und"


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> hello  there.\nFine\n> How are you?"), (1, 2, "user", "another"), (1, 3, "user", "A wrote:\n> Fine\n>> how are you?\nnice"),
        (1, 4, "user", "> another\nyes"), (1, 5, "u", "> nothing known\nok"), (2, 0, "u", None), (2, 0, "u", None), (None, None, None, "> x"), (3, 7, "u", ">>> deep\n> shallow"), (4, 1, "u", "a > b"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    one = [got[1, t] for t in range(6)]
    assert [r.parent_turn for r in one] == [None, 0, None, 1, 2, None]
    assert [r.position for r in one] == [0, 1, 3, 2, 4, 5] and [r.depth for r in one] == [0, 1, 0, 2, 1, 0]
    assert [r.text for r in one] == ["Hello there.\nHow are you?", "Fine", "another", "nice", "yes", "ok"]
    assert [(r.n_quotes, r.n_linked) for r in one] == [(0, 0), (2, 2), (0, 0), (2, 2), (1, 1), (1, 0)]
    assert got[3, 7].n_quotes == 2 and got[3, 7].text == "" and got[4, 1].text == "a > b" and (None, None) in got
    assert quotes.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_long_thread(spark):
    rows = [(1, i, "u", (f"> text {i - 1}\n" if i else "") + f"text {i}") for i in range(40)]
    got = sorted(quotes.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.turn)
    assert [r.depth for r in got] == list(range(40)) == [r.position for r in got] and {r.root_turn for r in got} == {0}


def plain_conversations(rows):
    """Links, threads and order by loops over whole conversations, on the parsed passages."""
    parsed = [(c, t, role, *quotes.parse(text)) for c, t, role, text in rows]
    out = []
    for conv in {c for c, *_ in parsed}:
        mine = sorted((x for x in parsed if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or ""))
        parent, linked = {}, {}
        for _, turn, _, _, passages in mine:
            if conv is None or turn is None:
                continue
            weight = linked.setdefault(turn, [{}, set()])
            for i, (level, lines) in enumerate(passages):
                for h, size in quotes.units(lines).items():
                    earlier = [t for _, t, _, body, _ in mine if t is not None and t < turn and h in quotes.units(body.split("\n"))]
                    if earlier:
                        weight[1].add((turn, i))
                        if level == 1:
                            weight[0][max(earlier)] = weight[0].get(max(earlier), 0) + size
        for turn, (weight, _) in linked.items():
            if weight:
                parent[turn] = max(weight, key=lambda t: (weight[t], t))
        turns = sorted({t for _, t, *_ in mine}, key=lambda t: (t is not None, t or 0))
        order = []

        def walk(turn, root, depth):
            order.append((turn, root, depth))
            for t in turns:
                if t is not None and t in parent and parent[t] == turn:
                    walk(t, root, depth + 1)

        for t in turns:
            if t not in parent:
                walk(t, t, 0)
        at = 0
        for turn, root, depth in order:
            for _, t, role, body, passages in mine:
                if t == turn:
                    out.append((conv, at, t, body, parent.get(t), root, depth, len(passages)))
                    at += 1
    return out


def test_conversations_equal_the_plain_version(spark):
    """Random quotes of earlier messages, deep and broad threads, unknown quotes, repeated turns, nulls, clashing columns."""
    rng = random.Random(12)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randrange(1, 25)):
            body = "\n".join(prose(rng.randrange(10**6), rng.randrange(1, 5)) for _ in range(rng.randrange(1, 4)))
            text = body
            if said and rng.random() < 0.8:
                some = rng.choice(said[-3:] if conv % 2 else said)
                text = "\n".join(f"> {x.upper()}" for x in some.split("\n")[: rng.randrange(1, 3)]) + "\n" + body
                if rng.random() < 0.2:
                    text = ">> " + rng.choice(said).split("\n")[0] + "\n" + text
            said.append(body)
            rows.append((conv, turn * 3, "u", text))
    rows += [(20, 1, "u", "> nothing known\nok"), (21, None, "u", "lost"), (21, 4, "u", "> lost\nfound"), (None, 3, "u", "> x"), (22, 0, "u", None), (23, 5, "a", "twice"), (23, 5, "b", "twice over"), (23, 9, "u", "> twice\nyes"), (24, 0, "u", "long " * 40_000), (24, 1, "u", "> " + "long " * 40_000 + "\nsure")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, position int, hash int")
    got = sorted(((r.conv_id, r.position, r.turn, r.text, r.parent_turn, r.root_turn, r.depth, r.n_quotes) for r in quotes.format_conversations(df).collect()), key=str)
    want = sorted(plain_conversations(rows), key=str)
    assert len(got) == len(rows) and max(r[6] for r in got) > 3
    # of rows that repeat a turn either may come first
    loose = lambda found: sorted(((c, None if c == 23 and t == 5 else p, t, x, *rest) for c, p, t, x, *rest in found), key=str)
    assert loose(got) == loose(want)


def test_quotes_from_elsewhere(spark):
    rows = [(1, 0, "u", "a line of its own"), (2, 0, "u", "> a line of its own\nwho said so"), (2, 1, "u", "> who said so\nme"), (3, 0, "u", "> nobody did\nno")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_elsewhere, r.n_linked, r.parent_turn) for r in quotes.format_conversations(df, elsewhere=True).collect()}
    assert got == {(1, 0): (0, 0, None), (2, 0): (1, 0, None), (2, 1): (0, 1, 0), (3, 0): (0, 0, None)}
