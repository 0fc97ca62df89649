import numpy as np
import pytest

import corpus_pipeline
from beaconry.llm import simhash


def words(rng, n):
    return ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]


def jaccard(a, b):
    a, b = (set(simhash.shingles(t.encode(), 5)) for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.fixture(params=[1 << 24, 3000])
def class_bytes(request, monkeypatch):
    monkeypatch.setattr(simhash, "CLASS_BYTES", request.param)


def test_copies_of_what_is_not_close_to_the_first(spark, class_bytes, monkeypatch):
    rng = np.random.default_rng(1)
    a = words(rng, 300)
    b = a[:200] + words(rng, 100)  # linked to a, but unlike it
    c = b[:298] + ["other", "end"]  # like b
    texts = [" ".join(x) for x in (a, b, c)]
    monkeypatch.setattr(simhash, "near_links", lambda prints: _all_linked(prints))
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[1]), (4, texts[2]), (5, texts[1]), (6, texts[0]), (2, texts[2]), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(docs).collect()}
    # A copy with a null id goes as well.
    assert got == {(6, 1), (None, 1), (3, 2), (4, 2), (5, 2), (2, 2)}


def _all_linked(prints):
    first = prints.groupBy("number").agg({"print": "min"}).toDF("number", "a")
    return prints.join(first, "number").selectExpr("number", "a", "print as b")


def test_scattered_and_block_edits(spark):
    rng = np.random.default_rng(2)
    rows, owed = [], 0
    for n in range(100):
        text = words(rng, 300)
        if n % 2:
            edited = list(text)
            for at in rng.choice(300, 6, replace=False):
                edited[at] = "other"
        else:
            edited = text[:275] + words(rng, 25)
        rows += [(2 * n, " ".join(text)), (2 * n + 1, " ".join(edited))]
        owed += jaccard(*(t for _, t in rows[-2:])) >= 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline._copies(spark, docs, "").collect()}
    texts = dict(rows)
    assert owed > 70
    for n in range(100):
        alike = jaccard(texts[2 * n], texts[2 * n + 1]) >= 0.8
        assert 2 * n in kept and (alike or 2 * n + 1 in kept)
    assert 200 - len(kept) >= 0.97 * owed
