"""Toxicity from two Kneser-Ney language models, one of toxic and one of ordinary text.

A text is a sequence of words, and a word is spelt: each letter (byte) is predicted from up to seven
before it in the word. So a model knows words and word stems, whatever the language. Both classes have their own discounted
counts of what follows a context, interpolated with one shared backoff: a Kneser-Ney model of both
classes together, with continuation counts below its highest order. What is rare in both classes is thus about as likely in both.
Discounts come from counts of counts (modified Kneser-Ney).

A word's evidence is log P(word | toxic) - log P(word | ordinary). A text is judged by its mean over all words and by the means
over its most telling words; a logistic curve, fitted on labelled rows that the models have not
seen, turns them into a score.

The models are fitted on a bounded sample of labelled rows, chosen by a hash of the id: at most ``Settings.rows_each`` toxic rows
and twice as many ordinary ones, of at most ``Settings.longest_text`` letters each. Letters are counted in
tasks; the different sequences of a sample are what comes to the driver. Every row is scored, on its whole text.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import text_or_empty
from beaconry.session import materialize

ORDER = 8
_END = 0x20
# Letters and digits; A-Z do not come, as texts are lower-cased.
_LETTERS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else _END for b in range(256))
_BYTE = np.uint64(8)
_MASKS = np.array([0, *((1 << 8 * k) - 1 for k in range(1, ORDER + 1))], dtype=np.uint64)
TOPS = (1, 3, 8)


@dataclass(frozen=True)
class Settings:
    rows_each: int = 1_500  # toxic rows that are learnt from, and half the ordinary ones
    longest_text: int = 20_000  # rows with longer texts are not learnt from
    tune_share: int = 4  # one in so many of them fits the curve instead of the models
    least_count: int = 2  # sequences that both classes together have less often are as good as unseen
    farthest: float = 8.0  # a word's evidence counts up to here
    threshold: float = 0.3


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_LETTERS).split()


def spelt(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, length): for every letter of the words, and the blank after each, the sequence that ends in it, from the blank before the
    word on but at most ``ORDER`` long, packed into one number."""
    symbols = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    n = len(symbols)
    blank = np.maximum.accumulate(np.where(symbols == _END, np.arange(n), 0))
    length = np.minimum(np.arange(n)[1:] - blank[:-1] + 1, ORDER)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(min(ORDER, n)):
        key[k:] |= symbols[: n - k].astype(np.uint64) << np.uint64(8 * k)
    return key[1:] & _MASKS[length], length


def found_in(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``asked`` in sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off a count of 0, 1, 2, 3 or more: modified Kneser-Ney, from counts of counts."""
    n1, n2, n3, n4 = (max(1, int((counts == x).sum())) for x in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    each = np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.1, [1, 2, 3])
    return np.r_[0, each]


def interpolated(counts: np.ndarray, context: np.ndarray, n_contexts: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each sequence's last letter, what each context leaves to the lower order)."""
    off = np.minimum(counts, discounts(counts)[np.minimum(counts, 3).astype(np.int64)])
    total = np.bincount(context, weights=counts, minlength=n_contexts)
    left = np.where(total > 0, np.bincount(context, weights=off, minlength=n_contexts) / np.maximum(total, 1), 1.0)
    own = np.where(total[context] > 0, (counts - off) / np.maximum(total[context], 1), 0.0)
    return own + left[context] * lower, left


@dataclass
class Model:
    """Evidence of sequences (log of the ratio of probabilities), and of contexts that a letter was never seen after."""

    settings: Settings
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    values: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    contexts: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    lefts: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    curve: np.ndarray = field(default_factory=lambda: np.r_[-4.0, np.zeros(len(TOPS) + 2)])

    @classmethod
    def of_counts(cls, settings: Settings, length: np.ndarray, key: np.ndarray, counts: np.ndarray) -> "Model":
        """From all sequences up to ``ORDER``, with their counts in ordinary and toxic text (two rows)."""
        below = np.empty(0, np.uint64), np.empty(0)
        keys, values, contexts, lefts = [], [], [], []
        orders = [np.flatnonzero(length == k) for k in range(1, ORDER + 1)]
        for k, own in enumerate(orders, 1):
            own = own[np.argsort(key[own])]
            grams, both = key[own], counts[:, own]
            # Below the highest order the shared model counts what a sequence follows; at the start of a word nothing precedes.
            shared = both.sum(axis=0)
            if k < ORDER:
                longer = key[orders[k]] & _MASKS[k]
                preceded = np.bincount(found_in(grams, longer)[0], minlength=len(grams)) if len(grams) else shared
                starts = grams >> np.uint64(8 * (k - 1)) == _END
                shared = np.where(starts & (k > 1), shared, preceded)
            if k == 1:
                below = grams, shared / max(1, shared.sum())
                continue
            context, of = np.unique(grams >> _BYTE, return_inverse=True)
            lower = below[1][found_in(below[0], grams & _MASKS[k - 1])[0]] if len(grams) else np.empty(0)
            (p, left_p), (q, left_q) = (interpolated(c, of, len(context), lower) for c in both)
            kept = both.sum(axis=0) >= settings.least_count
            keys.append(grams[kept])
            values.append(np.log(q[kept] / p[kept]))
            contexts.append(context)
            lefts.append(np.log(np.maximum(left_q, 1e-3) / np.maximum(left_p, 1e-3)))
            below = grams, interpolated(shared, of, len(context), lower)[0]
        model = cls(settings)
        for names, parts in ((("keys", "values"), (keys, values)), (("contexts", "lefts"), (contexts, lefts))):
            at, evidence = (np.concatenate(p) for p in parts)
            order = np.argsort(at)
            setattr(model, names[0], at[order])
            setattr(model, names[1], evidence[order].astype(np.float32))
        return model

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        key, _ = spelt(words)
        at, known = found_in(self.keys, key)
        begun, led = found_in(self.contexts, key >> _BYTE)
        letters = np.where(known, self.values[at] if len(self.values) else 0, np.where(led, self.lefts[begun] if len(self.lefts) else 0, 0))
        begin = np.r_[0, np.cumsum([len(w) + 1 for w in words])[:-1]]
        return np.clip(np.add.reduceat(letters, begin), -self.settings.farthest, self.settings.farthest)

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.clip(self.curve[0] + features @ self.curve[1:], -30, 30)
        return 1 / (1 + np.exp(-x))


class Reader:
    """Features of texts; keeps the evidence of words it has seen, of so many at most."""

    def __init__(self, model: Model, limit: int = 300_000):
        self.model, self.limit, self.known = model, limit, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: mean over its words, means over its most telling ones, log of their number."""
        out = np.zeros((len(texts), len(TOPS) + 2))
        for row, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            new = list(set(words).difference(self.known))
            if len(self.known) + len(new) > self.limit:
                self.known, new = {}, list(set(words))
            if new:
                self.known.update(zip(new, self.model.evidence(new).tolist()))
            found = np.fromiter(map(self.known.__getitem__, words), dtype=np.float64, count=len(words))
            most = np.sort(np.partition(found, -TOPS[-1])[-TOPS[-1] :] if len(found) > TOPS[-1] else found)[::-1]
            out[row] = found.mean(), *(most[:n].mean() for n in TOPS), np.log(len(words))
        return out


def learning_rows(labels: DataFrame, learn: Column, settings: Settings, doc_id: str, label: str) -> tuple[DataFrame, dict]:
    """(learn_id, toxic, tune) of the sample, and how many labelled rows each class has.

    A document that is labelled more than once is toxic if any label says so.
    """
    known = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(learn)
    )
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic = min(settings.rows_each, totals.get(1, 0))
    picked = [
        known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((0, 2 * toxic), (1, toxic))
    ]
    sample = picked[0].union(picked[1]).select(
        F.col("doc_id").alias("learn_id"),
        "toxic",
        (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(settings.tune_share)) == 0).alias("tune"),
    )
    return materialize(sample, "sample"), totals


def sequences(texts: DataFrame) -> DataFrame:
    """(length, key, ordinary, toxic): counts of all sequences up to ``ORDER`` in the words of (toxic, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.asarray(batch.column(0))
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            for c in (0, 1):
                mine = [w for label, ws in zip(labels, words) if label == c for w in ws]
                if not mine:
                    continue
                key, length = spelt(mine)
                for k in range(1, ORDER + 1):
                    grams, n = np.unique(key[length >= k] & _MASKS[k], return_counts=True)
                    zero = np.zeros(len(n), np.int64)
                    columns = [np.full(len(n), k, np.int32), grams.view(np.int64), *((n, zero) if c == 0 else (zero, n))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["length", "key", "ordinary", "toxic"])

    found = texts.mapInArrow(count, "length int, key long, ordinary long, toxic long")
    return found.groupBy("length", "key").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Model:
    """The models of labelled rows for which ``learn`` (an expression on doc_id) holds.

    Without labelled rows of both classes the score is the share of toxic labels. Labels of documents that are not in ``docs``,
    null ids and labels other than 0 and 1 are left out; a text that is labelled many times counts once for its class.
    """
    sample, totals = learning_rows(labels, learn, settings, doc_id, label)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    # At most three times rows_each rows of three small columns.
    chosen = texts.where(F.length("text") <= settings.longest_text).join(F.broadcast(sample), F.col("doc_id") == F.col("learn_id"))
    chosen = materialize(chosen.select("toxic", "tune", "text").dropDuplicates(["toxic", "text"]), "learning-texts")
    # Narrow columns: this is what the driver holds.
    small = [F.col("length").cast("tinyint"), "key", F.col("ordinary").cast("int"), F.col("toxic").cast("int")]
    table = sequences(chosen.where("not tune").select("toxic", "text")).select(*small).toArrow()
    length, key, *counts = (np.asarray(table[c].combine_chunks()) for c in ("length", "key", "ordinary", "toxic"))
    del table
    model = Model.of_counts(settings, length, key.view(np.uint64), np.array(counts, dtype=np.float64)) if len(key) else Model(settings)
    _tune(model, chosen.where("tune"), totals)
    return model


def _tune(model: Model, rows: DataFrame, totals: dict) -> None:
    """Fit the curve on the rows kept apart, weighted as the classes come in the labels."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            measured = reader.features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(measured), pa.list_(pa.float64()))], ["toxic", "features"])

    found = rows.select("toxic", "text").mapInArrow(measure, "toxic int, features array<double>").toPandas()
    shared.destroy()
    toxic = found["toxic"].to_numpy(dtype=float)
    prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    model.curve[0] = np.log(prior / (1 - prior))
    if len(set(toxic)) < 2:
        return
    weights = np.where(toxic == 1, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))
    x = np.stack(found["features"].to_list())
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    design = np.c_[np.ones(len(x)), (x - centre) / spread]
    beta, pull = np.zeros(design.shape[1]), np.diag([1e-6] + [0.05] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weights * (toxic - p)) - pull @ beta
        step = np.linalg.solve((design * (weights * p * (1 - p) + 1e-9)[:, None]).T @ design + pull, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.curve = np.r_[beta[0] - (beta[1:] * centre / spread).sum(), beta[1:] / spread]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    A null or empty text has no evidence either way; repeated rows get the same score.
    Columns named score or predicted are replaced, all others stay. No rows give no rows.
    """
    threshold, shared = model.settings.threshold, docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(shared.value)
        for series in texts:
            yield pd.Series(shared.value.score(reader.features(series.tolist())))

    rows = docs.withColumn("score", scores(F.col(f"`{text}`")))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
