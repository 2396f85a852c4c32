import random

import plain
import pytest

from tidemark.llm import common as C
from tidemark.llm import ngram_join
from tidemark.llm.components import components


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_all_pairs(frame, corpus):
    docs = [*corpus, (None, corpus[0][1]), (None, None)]
    assert rows(ngram_join.join_components(frame)) == plain.components(docs)


@pytest.mark.parametrize("seed", range(3))
def test_links_near_the_threshold(spark, seed):
    """Families whose members lie on both sides of 0.75, so that chains and missed pivots matter."""
    rng = random.Random(seed)
    docs, base = [], [[f"w{rng.randrange(4000)}" for _ in range(60)] for _ in range(6)]
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(w))
            w[a : a + rng.randrange(1, 3)] = [f"n{rng.randrange(40)}"] * rng.randrange(3)
        docs.append((rng.randrange(10**6) * 1000 + i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(ngram_join.join_components(df)) == plain.components(docs)


def test_links_where_no_central_class_may_link(spark):
    """The most central class of each list that 1 and 2 share is 3, which is too long for either."""
    base, boiler = [f"w{i}" for i in range(54)], [f"b{i}" for i in range(100)]
    docs = [(1, " ".join(base)), (2, " ".join([*base[:-1], "x"])), (3, " ".join(base + boiler))]
    docs += [(10 + d, " ".join([*boiler, *[f"d{d}x{i}" for i in range(200)]])) for d in range(8)]
    got = rows(ngram_join.join_components(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == plain.components(docs) and (2, 50, 1) in got


@pytest.mark.parametrize("cell", [1, 3, 256])
def test_a_shingle_in_every_document(spark, monkeypatch, cell):
    """One list holds everything: families that link, others that share the phrase alone; cells change nothing."""
    monkeypatch.setattr(ngram_join, "CELL", cell)
    rng = random.Random(17)
    hot = [f"h{i}" for i in range(9)]
    base = [[f"b{k}x{rng.randrange(300)}" for _ in range(40)] for k in range(8)]
    docs = []
    for i in range(60):
        w = list(base[i % 8])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(40)] = f"n{rng.randrange(30)}"
        at = rng.randrange(40)
        docs.append((1000 - i, " ".join(w[:at] + hot + w[at:])))
    docs += [(2000 + i, " ".join([*hot, f"t{i % 3}", f"v{i % 5}"])) for i in range(15)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(ngram_join.join_components(df))
    assert got == plain.components(docs) and len({r[2] for r in got}) < len(docs)


def test_keep_one(frame):
    got = sorted(r.doc_id for r in ngram_join.keep_one(frame).collect() if r.doc_id is not None)
    assert got == sorted(set(got)) and 30 not in got and 0 in got and 42 in got and 10 not in got
    assert ngram_join.keep_one(frame).columns == frame.columns


def test_keep_one_loses_no_clean_text(spark):
    """Rows without a doc_id, and rows that repeat one with texts of their own."""
    text = {k: plain.prose(700 + k, 60) for k in range(8)}
    near = text[0] + " tail"
    docs = [(1, text[0]), (7, near), (7, text[1]), (7, text[2]), (7, text[2]), (None, near), (None, text[3]), (None, text[3] + " tail"), (None, text[4]), (None, None), (None, ""), (None, ""), (8, ""), (8, None), (8, "")]
    got = rows(ngram_join.keep_one(spark.createDataFrame(docs, "doc_id long, text string")))
    either = [t for d, t in got if t in (text[3], text[3] + " tail")]
    assert len(either) == 1
    want = [(1, text[0]), (7, text[1]), (7, text[2]), (None, either[0]), (None, text[4]), (None, None), (None, ""), (None, ""), (8, ""), (8, None)]
    assert got == sorted(want, key=str)


def test_keep_one_in_the_frame(frame, corpus):
    got = [(r.doc_id, r.text) for r in ngram_join.keep_one(frame).collect()]
    assert (None, None) in got and (None, corpus[0][1]) not in got and got.count((1, corpus[1][1])) == 1


def test_empty_table(spark):
    assert ngram_join.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: f"file://{tmp_path}/shared" if key == "spark.checkpoint.dir" else default)

        sparkContext = spark.sparkContext

    assert C.shared_dir(Session) == f"file://{tmp_path}/shared"
    assert C.materialise(spark.range(3)).count() == 3
