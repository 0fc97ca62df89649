"""Benchmark passages: the index against plain search, spans and items against brute force, odd rows."""

import random
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from beaconry.llm import decontamination as d
from beaconry.llm.fm_index import FmIndex, suffix_order


def places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_place(seed):
    draw = random.Random(seed)
    words = [b"a", b"b", b"c", b"dd"][: draw.randint(1, 4)]
    texts = [[draw.choice(words) for _ in range(draw.choice([0, 1, 5, 80]))] for _ in range(draw.randint(0, 9))]
    texts += texts[:2]  # copies
    index = FmIndex.loads(FmIndex(texts).dumps())
    asked = [[draw.choice(words + [b"other"]) for _ in range(draw.randint(1, 6))] for _ in range(50)]
    patterns = np.zeros((len(asked), 6), dtype=np.int64)
    for row, phrase in enumerate(asked):
        patterns[row, : len(phrase)] = index.encode(phrase)
    low, high = index.ranges(patterns, np.array([len(p) for p in asked]))
    for phrase, a, b in zip(asked, low, high):
        want = [int(start) + i for start, text in zip(index.begin, texts) for i in places(text, phrase)]
        assert sorted(index.locate(np.arange(a, max(a, b)))) == sorted(want)


def test_suffixes_are_in_order():
    symbols = np.array([3, 2, 3, 2, 3, 2, 3, 0, 3, 2, 3, 2, 1])
    want = sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
    assert suffix_order(symbols).tolist() == want


def plain(text, items, window=10):
    words = d.words_of(text)
    hit, found = [False] * len(words), set()
    for item, content in items:
        asked = d.words_of(content)
        for i in range(max(1, len(asked) - window + 1)) if asked else ():
            phrase = asked[i : i + window]
            for at in places(words, phrase):
                hit[at : at + len(phrase)] = [True] * len(phrase)
                found |= {item} - {None}
    edges = [i for i in range(len(hit) + 1) if (i < len(hit) and hit[i]) != (i > 0 and hit[i - 1])]
    return len(words), list(zip(edges[::2], edges[1::2])), sorted(found)


def random_rows(seed):
    draw = random.Random(seed)
    words = "one Two, three-four\x7ffive été. SIX \t Ünder 7eight ".split(" ")
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(str(i % 7), text(draw.choice([0, 1, 3, 4, 30]))) for i in range(9)] + [(None, text(2)), ("n", None)]
    docs = [text(draw.choice([0, 1, 5, 60, 300])) for _ in range(30)] + [None, "", items[4][1]] * 2
    docs += [f"{text(5)} {content} {text(5)}" for _, content in items if content]
    return list(enumerate(docs)) + [(None, docs[3]), (0, docs[3])], items


@pytest.mark.parametrize("options", [{}, {"block_bytes": 300}])
def test_spans_and_items(spark, options):
    rows, items = random_rows(1)
    # Names that the operator itself uses.
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, id int, index int, shard int, items int")
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id string, text string, phrase string, item string")
    key = F.col("doc_id").cast("string").cast("binary")
    got = [
        (None if r["id"] is None else int(r["id"]), r["n_words"], [tuple(s) for s in r["spans"]], r["items"])
        for r in d.contaminated_spans(docs, asked, key, **options).collect()
    ]
    want = [(i, *plain(t, items)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[2] for w in want)


def test_small_shards_give_the_same(spark):
    rows, items = random_rows(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    asked = d.phrases(spark.createDataFrame(items, "item_id string, text string"))
    key = F.col("doc_id").cast("string").cast("binary")

    def found(size):
        index = d.build(docs, key, shard_bytes=size)
        return index.count(), sorted(map(str, d.search(index, asked).drop("shard", "at").collect()))

    (one, whole), (many, parts) = found(1 << 20), found(500)
    assert (one, whole) == (1, parts) and many > 5


def test_indexes_are_written_in_small_row_groups(spark, monkeypatch):
    monkeypatch.setattr(d, "ROW_GROUP_BYTES", 1 << 14)
    draw = random.Random(5)
    rows = [(i, " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(60))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = d.build(docs, F.col("doc_id").cast("string").cast("binary"), shard_bytes=500)
    written = d.stored(index)
    (path,) = written.inputFiles()
    file = pq.ParquetFile(path.removeprefix("file://"))
    assert file.metadata.num_rows == written.count() > 30 and file.num_row_groups > 5


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("1", "b")], "item_id string, text string")
    key = F.col("doc_id").cast("string").cast("binary")
    assert d.contaminated_spans(docs, items, key).count() == 0
    row = d.contaminated_spans(some, items.limit(0), key).first()
    assert (row["n_words"], row["spans"], row["items"]) == (2, [], [])


def test_passages_are_cut(spark):
    items = spark.createDataFrame([("1", "the quick brown fox")], "item_id string, text string")
    rows = [(1, "See The QUICK, brown fox! run. the quick brown fox", 5), (1, None, 6), (None, "nothing here", 7), (2, "", 8)]
    docs = spark.createDataFrame(rows, "number long, text string, spans int")
    got = {r["spans"]: r["text"] for r in d.without_items(docs, items).collect()}
    assert got == {5: "See ! run. ", 6: None, 7: "nothing here", 8: ""}
    assert d.without_items(docs, items).columns == docs.columns
    # A long text, with the passage at its end.
    long_docs = spark.createDataFrame([(1, "word " * 300_000 + "the quick brown fox", 1)], "number long, text string, spans int")
    assert len(d.without_items(long_docs, items).first()["text"]) == 1_500_000


def test_index_goes_through_its_sequences_once_and_keeps_no_words():
    texts = [[b"word%d" % (i * j % 997) for j in range(400)] for i in range(300)]
    want = FmIndex(texts)
    tracemalloc.start()
    made = FmIndex([bytes(w) for w in t] for t in texts)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert made.dumps() == want.dumps()
    assert peak < 80 * 300 * 400
