"""Class-conditional Kneser-Ney against a plain model, and held-out accuracy by language."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from beaconry.llm import toxicity as t
from beaconry.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def discount(n, counts):
    n1, n2, n3, n4 = (max(1, sum(c == x for c in counts)) for x in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    each = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return 0 if n == 0 else min(n, min(max(each[min(n, 3) - 1], 0.1), min(n, 3)))


class Plain:
    """The same model, sequence by sequence, from words in ordinary and toxic text."""

    def __init__(self, ordinary, toxic):
        self.counts = [Counter(), Counter()]
        for c, words in enumerate((ordinary, toxic)):
            for word in words:
                s = b" " + word + b" "
                for end in range(1, len(s)):
                    gram = s[max(0, end - t.ORDER + 1) : end + 1]
                    for k in range(len(gram)):
                        self.counts[c][gram[k:]] += 1
        grams = set(self.counts[0]) | set(self.counts[1])
        self.shared = {}
        for g in grams:
            longer = sum(len(h) == len(g) + 1 and h[1:] == g for h in grams)
            begins = len(g) > 1 and g[:1] == b" "
            self.shared[g] = longer if len(g) < t.ORDER and not begins else self.counts[0][g] + self.counts[1][g]

    def interpolated(self, counts, gram):
        if len(gram) == 1:
            return self.shared.get(gram, 0) / sum(n for g, n in self.shared.items() if len(g) == 1)
        order = [counts.get(g, 0) for g in set(self.counts[0]) | set(self.counts[1]) if len(g) == len(gram)]
        after = {g: counts.get(g, 0) for g in set(self.counts[0]) | set(self.counts[1]) if len(g) == len(gram) and g[:-1] == gram[:-1]}
        total, lower = sum(after.values()), self.interpolated(self.shared, gram[1:])
        if not total:
            return lower
        left = sum(discount(n, order) for n in after.values()) / total
        n = counts.get(gram, 0)
        return (n - discount(n, order)) / total + left * lower


def test_evidence_of_words_against_a_plain_model():
    draw = random.Random(3)
    words = lambda letters, n: ["".join(draw.choice(letters) for _ in range(draw.randint(1, 10))).encode() for _ in range(n)]
    ordinary, toxic = words("abc", 60), words("abd", 40) + [b"badword"] * 5
    plain = Plain(ordinary, toxic)
    tables = [[], [], []]
    for gram in set(plain.counts[0]) | set(plain.counts[1]):
        tables[0].append(len(gram))
        tables[1].append(int.from_bytes(gram, "big"))
        tables[2].append((plain.counts[0][gram], plain.counts[1][gram]))
    model = t.Model.of_counts(
        t.Settings(least_count=1, farthest=1e9), np.array(tables[0]), np.array(tables[1], np.uint64), np.array(tables[2], np.float64).T
    )
    for word in dict.fromkeys(toxic[:10] + ordinary[:10] + [b"badword"]):
        s, want = b" " + word + b" ", 0.0
        for end in range(1, len(s)):
            gram = s[max(0, end - t.ORDER + 1) : end + 1]
            p, q = (plain.interpolated(plain.counts[c], gram) for c in (0, 1))
            want += math.log(q / p)
        assert model.evidence([word])[0] == pytest.approx(want, abs=1e-4)
    assert model.evidence([b"badword"])[0] > 3 > model.evidence([b"never"])[0]
    # Words on their own or beside others.
    assert np.allclose(model.evidence([b"ab", b"badword", b"c"])[1], model.evidence([b"badword"])[0])


def test_held_out_by_language(spark):
    got = QUERIES["op6_toxicity"](spark, SF).toPandas()
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas()
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pandas()
    assert (got["held_out"] == got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    held = got[got["held_out"]].merge(labels, on="doc_id").merge(docs, on="doc_id")
    toxic, ordinary = held[held["toxic"] == 1], held[held["toxic"] == 0]
    assert toxic["predicted"].mean() > 0.9 and ordinary["predicted"].mean() < 0.02
    for lang, rows in toxic.groupby("lang"):
        assert rows["predicted"].mean() >= 0.85, lang
    for lang, rows in ordinary.groupby("lang"):
        assert rows["predicted"].mean() <= 0.06, lang


def test_labels_of_one_class_only(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    scores = {r["score"] for r in t.score(docs, t.fit(docs, labels, F.lit(True))).collect()}
    assert len(scores) == 1 and scores.pop() < 0.1
