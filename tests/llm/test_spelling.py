"""Near words against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from beaconry.llm import spelling as s


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    rows, forms = {}, {}
    for word, n in counts.items():
        found = [w for w in counts if near(word, w)]
        best = min(found, key=lambda w: (-counts[w], w), default=None)
        forms[word] = best if best and counts[best] >= 10 * n else None
        rows[word] = (n, len(found), forms[word], counts[forms[word]] if forms[word] else None)
    for word in rows:
        root = word
        while forms[root]:
            root = forms[root]
        rows[word] = (*rows[word], root)
    return rows


def random_words(seed, size=250):
    draw = random.Random(seed)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(7, 9))): draw.choice([2, 3, 30, 400, 5000]) for _ in range(size)}
    words |= {"aaaaaaa" + "b" * 300: 5, "aaaaaaa" + "b" * 301: 50, "÷×÷×÷×÷": 2, "÷×÷×÷×÷×": 20}
    return words


@pytest.mark.parametrize("block_words", [s.BLOCK_WORDS, 7])
def test_every_near_word(spark, block_words):
    counts = random_words(1)
    words = spark.createDataFrame([(w, n, 1, 2) for w, n in counts.items()], "word string, n long, block int, root int")
    got = s.variants(words, block_words=block_words)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain(counts)


def test_forms_are_followed_to_the_end(spark):
    chain = [("w" * (7 + i), 10**i) for i in range(9)]
    got = {r["word"]: r["root"] for r in s.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {chain[-1][0]}


def test_counts_of_whole_texts(spark):
    rows = [(1, "Painting PAINTING. été"), (2, None), (None, "painting"), (3, ""), (1, "Étéétéété étéétéétÉ " * 20_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, word int")
    got = {r["word"]: r["n"] for r in s.word_counts(docs, damage=0).collect()}
    assert got == {"painting": 3, "Étéétéété": 20_000, "étéétéétÉ": 20_000}
    lost = s.word_counts(docs).collect()
    want = Counter()
    import zlib

    for doc, text in rows:
        for run in "".join(x if x.isalpha() else " " for x in (text or "")).split():
            run = "".join(x.lower() if x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else x for x in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    assert {r["word"]: r["n"] for r in lost} == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.variants(s.word_counts(docs)).count() == 0


def test_edit_check():
    codes = lambda *words: np.array([[ord(x) for x in w] for w in words])
    assert s.one_edit(codes("abc", "abc", "abc"), codes("abd", "abc", "add"), False).tolist() == [True, False, False]
    assert s.one_edit(codes("abc", "abc", "aaa", "abc"), codes("xabc", "abcx", "aaaa", "xxbc"), True).tolist() == [True, True, True, False]
