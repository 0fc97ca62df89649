import random

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from beaconry.llm import mixing

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    table = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    first = {}
    for d, t in zip(table["doc_id"], table["text"]):
        first[t] = min(d, first.get(t, d))
    copies = {d for d, t in zip(table["doc_id"], table["text"]) if first[t] != d and (t or "").split()}
    assert not ids & copies and len(ids) > 0.7 * (len(table["doc_id"]) - len(copies))
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed["doc_id"]) <= ids
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_mix_of_null_and_repeated_ids(spark):
    rows = [(None if i < 20 else 7 if i < 40 else i, "word " * (i + 1), "ab"[i % 2]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    target = {r["source"]: r["target"] for r in mixing.mix(mixing.sized(docs)).select("source", "target").distinct().collect()}
    got = corpus_pipeline._mix(spark, docs, SF)
    assert got.columns == docs.columns
    got = got.toPandas()
    assert got.groupby(["text"]).size().max() <= 3
    for source, taken in got.groupby("source"):
        assert abs(taken["text"].str.split().str.len().sum() - target[source]) <= 121
    assert got["doc_id"].isna().any() and (got["doc_id"] == 7).any()


# Names that stages use for their own columns.
CLASHES = ("score", "predicted", "row", "copy", "copies", "of", "digest", "whole", "id", "tag", "g", "rest", "least", "node")
LONG = "wort " * 40_000
TEXTS = [None, "", " \t", "a", LONG, "same text of some words and more", "same text of some words and more", "other words entirely here"]


def odd_rows(spark, rows):
    names = ", ".join(f"{c} int" for c in CLASHES)
    return spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], f"doc_id long, text string, source string, {names}")


STAGES = dict(corpus_pipeline.STAGES[:-1])
ODD = [(i, t, None if i % 3 else "s") for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], "s"), (5, TEXTS[5], None), (None, None, None)]


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_of_any_name_and_odd_rows(spark, name):
    docs = odd_rows(spark, ODD)
    got = STAGES[name](spark, docs, SF)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(tuple(r[c] for c in CLASHES) == tuple(range(len(CLASHES))) for r in rows)
    texts = {(r["doc_id"], r["text"]) for r in rows}
    if name == "toxicity":
        assert sorted(map(str, rows)) == sorted(map(str, docs.collect()))
    if name == "simhash":
        assert [t for _, t in texts].count(TEXTS[5]) == 1 and (5, TEXTS[5]) in texts
        assert {(0, None), (1, ""), (2, " \t"), (3, "a"), (4, LONG), (7, TEXTS[7]), (None, None)} <= texts
    if name == "passages":
        assert (4, LONG) in texts and (0, "") in texts and len(rows) == len(ODD)
    if name == "mixing":
        assert {t for _, t in texts} <= set(TEXTS) and LONG in {t for _, t in texts}


@pytest.mark.parametrize("name", STAGES)
def test_stages_of_no_rows(spark, name):
    docs = odd_rows(spark, [])
    got = STAGES[name](spark, docs, SF)
    assert got.columns == docs.columns and got.collect() == []


def test_near_copies_go_and_clean_documents_stay(spark):
    """SimHash stage against all pairs of five-word shingles, with the keepers chosen by id."""
    draw = random.Random(4)
    words = lambda n: ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    texts = []
    for _ in range(12):
        base = words(120)
        texts.append(base)
        for edits in (1, 2, 9):
            new = base[:]
            for at in draw.sample(range(120), edits):
                new[at] = words(1)[0]
            texts.append(new)
    draw.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    kept = []
    for i, s in enumerate(sets):
        if all(len(s & sets[k]) < 0.8 * len(s | sets[k]) for k in kept):
            kept.append(i)
    got = {r["doc_id"] for r in STAGES["simhash"](spark, docs, SF).collect()}
    assert len(got ^ set(kept)) <= 1 and len(kept) < len(texts)
