"""The pipeline on a small corpus: each stage on its own input, and what the whole keeps."""

import plain
import pytest
from plain import prose

import corpus_pipeline
from tidemark.llm import common as C


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    bench = [(1, prose(501, 30)), (2, prose(502, 24))]
    docs = [(i, prose(1000 + i, 80)) for i in range(60)]
    docs += [(100, prose(600, 40) + " " + bench[0][1] + " " + prose(601, 20)), (101, prose(1003, 80)), (102, prose(1004, 80) + " tail"), (103, prose(602, 30) + " " + " ".join(prose(1005, 80).split()[:60]))]
    docs += [(200 + i, " ".join(w + "###" for w in prose(2000 + i, 60).split())) for i in range(30)] + [(300, None), (301, "")]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(i, 0 if 200 <= i < 300 else 1, 0) for i in [*range(60), *range(200, 230)]], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()] if "text" in docs.columns else None
        docs = C.materialise(stage(spark, docs, sf_dir))
        if name != "best-fit packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "n-gram Jaccard join":
            assert set(kept[name]) == {d for d, _, c in plain.components(before) if c == d}
        if name == "suffix-array dedup":
            assert {d: len((t or "").encode()) for d, t in kept[name].items()} == {r[0]: r[1] - r[2] for r in plain.byte_dedup(before)}
    assert all(i in kept["quality classifier"] for i in range(60)) and not any(i in kept["quality classifier"] for i in range(200, 230))
    assert 101 not in kept["n-gram Jaccard join"] and 102 not in kept["n-gram Jaccard join"] and 3 in kept["n-gram Jaccard join"]
    assert len(kept["suffix-array dedup"][103]) < 300 and len(kept["suffix-array dedup"][5]) > 300
    last = kept["benchmark decontamination"]
    assert 100 not in last and all(i in last for i in range(60))
    assert {r.doc_id for r in docs.collect()} == set(last)


def test_run_gives_the_last_stage(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() >= 60


def test_rows_without_or_with_a_shared_doc_id_reach_the_end(spark, tmp_path):
    where, texts = str(tmp_path), [prose(3000 + i, 80) for i in range(5)]
    docs = [(i, prose(1000 + i, 80), 80) for i in range(40)] + [(900, texts[0], 80), (900, texts[1], 80), (None, texts[2], 80), (None, texts[3], 80), (901, texts[4], 80), (901, prose(1003, 80) + " tail", 81)]
    docs += [(200 + i, " ".join(w + "###" for w in prose(2000 + i, 60).split()), 60) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, prose(501, 30))], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(40), *range(200, 220)]], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    found = [(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, where).collect()]
    assert [found.count((d, 0)) for d in (900, None, 901, 3)] == [2, 2, 1, 1]


SCHEMAS = {"documents": "doc_id long, text string, n_chars long, score double", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int"}


@pytest.mark.parametrize("left_out", ["documents", "labels", "benchmark", "all"])
def test_empty_tables_end_to_end(spark, tmp_path, left_out):
    """Without documents nothing comes out; without labels or items every clean document does."""
    texts = [(i, prose(1000 + i, 80), 80, 0.5) for i in range(30)] + [(40, None, None, None), (41, "", 0, None), (None, prose(77, 60), 60, None)]
    rows = {"documents": texts, "benchmark": [(1, prose(501, 30))], "labels": [(i, int(i % 3 > 0), 0) for i in range(30)]}
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([] if left_out in (name, "all") else rows[name], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    if left_out in ("documents", "all"):
        assert got == set()
    elif left_out == "labels":
        assert got == {d for d, *_ in texts}
    else:
        assert got <= {d for d, *_ in texts} and len(got) > 10


def test_stages_take_long_texts_and_repeated_rows(spark, tmp_path):
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    texts = [(1, long, 1, 0.0), (1, long, 1, 0.0), (2, long + " more", 1, 0.0), (3, prose(5, 80), 1, 0.0)] + [(10 + i, prose(50 + i, 60), 1, 0.0) for i in range(20)]
    rows = {"documents": texts, "benchmark": [(1, prose(501, 30)), (2, None), (3, "")], "labels": [(i, 1, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)]}
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = {d: sorted((r.start, r.length) for r in got if r.doc_id == d) for d in {r.doc_id for r in got}}
    assert set(pieces) == {1, 3, *range(10, 30)}
    for parts in pieces.values():
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
