import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest
from plain import prose


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages, repeats inside, short, empty and null texts, repeated rows."""
    shared = prose(1, 60)
    base = prose(2, 120).split()
    docs = [(0, prose(10, 90)), (1, prose(11, 40) + " " + shared + " " + prose(12, 40)), (2, shared), (3, " ".join(base))]
    for i in range(12):  # near copies: a few words differ
        near = list(base)
        rng = random.Random(100 + i)
        for k in rng.sample(range(len(near)), 1 + i % 4):
            near[k] = f"changed{i}x{k}"
        docs.append((10 + i, " ".join(near)))
    docs += [(30 + i, docs[0][1]) for i in range(5)]
    docs += [(40, "de " * 300), (41, "de " * 40), (42, ""), (43, None), (44, "  \t\n "), (45, "one two"), (46, "One  two"), (47, "one two three four"), (48, "é" * 80), (49, "é" * 60 + "à" * 30)]
    docs += [(50, prose(13, 30) + "\n" + shared.upper() + " " + prose(14, 9)), (51, shared.replace(" ", "\x0b ")), (60, prose(20, 20_000)), (61, prose(20, 20_000)[5000:9000])]
    docs += [docs[1], docs[1], (42, "")]
    return docs


@pytest.fixture(scope="session")
def frame(spark, corpus):
    """With further columns of clashing names, and rows without a doc_id."""
    rows = [(d, t, "en", None, 7, d, "x", 1.5, 3) for d, t in corpus] + [(None, corpus[0][1], None, None, None, 1, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, g long, bucket string, score double, node int")
