"""Nulls, empty and long texts, repeated rows, clashing names and empty tables."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from beaconry.llm import mixing, ngram_trie, packing, passages, sharding, simhash, suffixes, topk, toxicity, winnowing

SCHEMA = "doc_id long, text string, source string, score double, copies long, g int, shard int, rest string, n long"
LONG = "wort " * 40_000
TEXTS = [None, "", " \t", "a", "x y", LONG, "same text of some words", "same text of some words"]
ROWS = [(i, t, None if i % 3 else "s", None, 1, 2, 3, None, 4) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[6], (None, "null id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tox(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    return toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True)))


OPERATORS = {
    "packing": lambda d: packing.pack(d, *VOCABULARY).select("doc_id", "start").where("start = 0"),
    "passages": passages.near_passages,
    "simhash": simhash.near_classes,
    "copies": simhash.near_copies,
    "mixing": lambda d: mixing.mix(mixing.sized(d)),
    "suffixes": suffixes.without_repeats,
    "toxicity": tox,
    "sharding": lambda d: sharding.shard_documents(d, 3),
    "trie": lambda d: ngram_trie.scored(d, F.col("doc_id") != 1),
    "winnowing": winnowing.edited_fingerprints,
}
ONE_ROW_EACH = set(OPERATORS) - {"passages", "copies"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()
    if name in ONE_ROW_EACH:
        assert len(got) == len(ROWS)
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_topk_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [3.0]), (50, [0.5, 0.5])]
    data = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_scores(data, data.where("vec_id % 50 = 0"), k=5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
    none = data.where("false")
    assert topk.top_scores(none, none).collect() == []


def test_winnowing_of_ids_that_no_double_holds(spark):
    ids = [(1 << 62) + 2 * i + 1 for i in range(300)]
    docs = spark.createDataFrame([(i, f"text number {i} of some words") for i in ids], "doc_id long, text string")
    got = winnowing.edited_fingerprints(docs.repartition(3), rows_each=20).collect()
    assert sorted(r["doc_id"] for r in got) == ids


def test_added_token_as_the_tokenizer_has_it(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y<|endoftext", "no such token"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(docs, *VOCABULARY).collect()}
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
