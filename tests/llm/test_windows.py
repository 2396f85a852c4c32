import plain
import pytest

from tidemark.llm import suffix_array, superkmer
from tidemark.llm import windows as W


def rows(df):
    return sorted(tuple(r) for r in df.where("doc_id is not null").collect())


def test_bytes_equal_the_plain_version(frame, corpus):
    assert rows(suffix_array.dedup(frame)) == plain.byte_dedup(corpus)


@pytest.mark.parametrize("length", [8, 9, 16, 23])
def test_other_lengths(spark, corpus, length):
    small = [x for x in corpus if x[0] < 20]
    df = spark.createDataFrame(small, "doc_id long, text string")
    assert rows(suffix_array.dedup(df, length)) == plain.byte_dedup(small, length)


def test_words_equal_the_plain_version(frame, corpus):
    assert rows(superkmer.dedup(frame)) == plain.word_dedup(corpus)


def test_many_groups_and_buckets_give_the_same(frame, corpus, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.GROUP_BYTES", 3000)
    monkeypatch.setattr(W, "BUCKET_BYTES", 512)
    assert rows(superkmer.dedup(frame)) == plain.word_dedup(corpus)


def test_rows_without_doc_id_stay_whole(frame, corpus):
    got = [r for r in suffix_array.dedup(frame).collect() if r.doc_id is None]
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (len(corpus[0][1].encode()), 0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array.dedup(df).count() == 0 and superkmer.dedup(df).count() == 0


def test_text_keeps_columns_and_rows(frame):
    for module in (suffix_array, superkmer):
        got = module.dedup_text(frame)
        assert got.columns == frame.columns and got.count() == frame.count()
        text = {r.doc_id: r.text for r in got.where("doc_id in (0, 30, 43)").collect()}
        assert text[30] == "" and text[43] is None and len(text[0]) > 100


def test_removal_never_leaves_half_a_character(frame):
    text = {r.doc_id: r.text for r in suffix_array.dedup_text(frame).where("doc_id in (48, 49)").collect()}
    assert "�" not in text[49] and set(text[49]) <= {"é", "à"}


def test_rows_that_share_a_doc_id_are_cut_by_their_own_text(spark):
    docs = [(1, plain.prose(900, 40)), (2, plain.prose(900, 40) + " x"), (2, plain.prose(901, 30)), (2, plain.prose(901, 30)), (2, "y " + plain.prose(900, 40))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(suffix_array.dedup(df)) == plain.byte_dedup(docs) and rows(superkmer.dedup(df)) == plain.word_dedup(docs)


def test_a_string_in_most_documents(spark, monkeypatch):
    """A hot passage: every group sends it once, and nothing else of it travels."""
    hot = plain.prose(77, 30)
    docs = [(i, f"{plain.prose(4000 + i, 12)} {hot} {hot} {plain.prose(5000 + i, 12)}" if i % 3 else plain.prose(6000 + i, 20)) for i in range(300)]
    monkeypatch.setattr("tidemark.llm.common.GROUP_BYTES", 20_000)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(suffix_array.dedup(df)) == plain.byte_dedup(docs) and rows(superkmer.dedup(df)) == plain.word_dedup(docs)


def test_very_long_texts_are_read_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 700)
    docs = [(1, plain.prose(50, 900)), (2, plain.prose(51, 40) + " " + plain.prose(50, 900)[300:4000]), (3, "z" * 5000), (4, "z" * 300), (5, " " * 4000), (6, "a " * 2000), (7, "a " * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(suffix_array.dedup(df)) == plain.byte_dedup(docs) and rows(superkmer.dedup(df)) == plain.word_dedup(docs)


def test_strings_whose_hashes_collide(monkeypatch):
    """The first salt makes all hashes equal; the set is hashed again."""
    import numpy as np

    plain_hashes = W.string_hashes
    monkeypatch.setattr(W, "string_hashes", lambda data, a, b, salt=0: plain_hashes(data, a, b, salt) if salt else np.zeros(len(a), np.uint64))
    data = np.frombuffer(b"abcabdabcab", np.uint8)
    member, class_ = W.distinct(data, np.array([0, 3, 6, 9]), np.array([3, 6, 9, 11]))
    assert len(member) == 3 and class_[0] == class_[2] and len(set(class_.tolist())) == 3


def test_hot_leading_bytes_are_parted_by_the_next():
    import numpy as np

    spec = suffix_array.spec(50)
    words = [b"aaaaaaaa" + x * 8 + b"tail" * 3 for x in (b"b", b"c", b"d")] + [b"b" * 28]
    data = np.frombuffer(b"".join(words), np.uint8)
    at = np.arange(4) * 28
    first, second = W.leading(spec, data, at)
    cuts = W.Cuts(4, first[[0, 0, 3]], np.array([second[1], second[2], second[3]]))
    assert cuts.bucket(spec, data, at, np.zeros(4, np.uint64)).tolist() == [0, 1, 2, 3]
