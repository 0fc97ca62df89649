"""Bigram language model in an Elias-Fano trie, spread over shards by context.

P(w | v) = max(c(v, w) - D, 0) / c(v) + D * kinds(v) / c(v) * (c(w) + 1) / (N + V + 1):
absolute discounting, what it takes off goes to add-one unigrams. All texts marked for
learning are counted. A shard builds its trie from the counts all groups send, writes the levels
to files of the executor's temp folder, looks up what the groups ask in the mapped files, and
answers with quantised probabilities, rounded down. The files go when the shard has answered.
"""

from __future__ import annotations

from tempfile import TemporaryDirectory

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.llm.elias_fano import Trie, restore
from beaconry.llm.groups import Groups, bounds, rows_of, spread, starts, unpack

DISCOUNT = 0.75
# No words: they hold blanks.
END, BEGIN = b"\n", b"\t"

_REQUEST = "g int, shard int, words binary, counts binary, sizes binary, names binary, pair_counts binary"
_ANSWER = "g int, shard int, counts binary, left binary, codes binary, tokens long, kinds long"
_SCORES = "doc_id long, rest struct<learn: boolean>, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Encoded:
    """Words and bigrams of a group's texts: different words sorted by hash, different bigrams by context and word."""

    def __init__(self, texts: list[bytes], learn: np.ndarray):
        ids: dict[bytes, int] = {END: 0, BEGIN: 1}
        add = ids.setdefault
        runs = [[add(w, len(ids)) for w in text.lower().split()] + [0] for text in texts]
        self.lengths = np.array([len(r) for r in runs], dtype=np.int64)
        tokens = np.fromiter((i for r in runs for i in r), dtype=np.int64, count=int(self.lengths.sum()))
        del runs
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in ids], dtype=np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        self.hashes, self.tokens = hashes[order], rank[tokens]
        before = np.r_[rank[1], self.tokens[:-1]]
        before[starts(self.lengths)] = rank[1]
        weights = np.repeat(learn, self.lengths)
        self.counts = np.bincount(self.tokens, weights=weights, minlength=len(ids)).astype(np.uint32)
        pairs, self.pair_of = np.unique((before << 32) | self.tokens, return_inverse=True)
        self.pair_counts = np.bincount(self.pair_of, weights=weights, minlength=len(pairs)).astype(np.uint32)
        self.before, self.after = pairs >> 32, pairs & 0xFFFFFFFF


def _encode(docs: pa.Table) -> Encoded:
    learn = np.array([r["learn"] for r in docs["rest"].to_pylist()], dtype=bool)
    return Encoded(docs["text"].cast(pa.binary()).to_pylist(), learn)


def _ask(n: int):
    def step(g: int, docs: pa.Table) -> pa.Table:
        e = _encode(docs)
        words = bounds(spread(e.hashes, n), n)
        pairs = np.searchsorted(e.before, words)
        sizes = np.bincount(e.before, minlength=len(e.hashes)).astype(np.uint32)
        names = (e.hashes >> np.uint64(16))[e.after]
        # 48 bits of a word tell the successors of a context apart.
        short = np.empty(len(names), dtype=[("low", "<u4"), ("high", "<u2")])
        short["low"], short["high"] = names & np.uint64(0xFFFFFFFF), names >> np.uint64(32)
        word_cuts, pair_cuts = list(zip(words[:-1], words[1:])), list(zip(pairs[:-1], pairs[1:]))
        return rows_of(
            {
                "g": ([g] * n, pa.int32()),
                "shard": (range(n), pa.int32()),
                "words": ([e.hashes[a:b].tobytes() for a, b in word_cuts], pa.binary()),
                "counts": ([e.counts[a:b].tobytes() for a, b in word_cuts], pa.binary()),
                "sizes": ([sizes[a:b].tobytes() for a, b in word_cuts], pa.binary()),
                "names": ([short[a:b].tobytes() for a, b in pair_cuts], pa.binary()),
                "pair_counts": ([e.pair_counts[a:b].tobytes() for a, b in pair_cuts], pa.binary()),
            }
        )

    return step


def _answer(shard: int, rows: pa.Table) -> pa.Table:
    words, counts = unpack(rows["words"], "<u8"), unpack(rows["counts"], "<u4")
    contexts, at = np.unique(np.concatenate(words), return_inverse=True)
    totals = np.bincount(at, weights=np.concatenate(counts), minlength=len(contexts)).astype(np.int64)
    groups = unpack(rows["names"], [("low", "<u4"), ("high", "<u2")])
    names = [x["low"].astype(np.uint64) | x["high"].astype(np.uint64) << np.uint64(32) for x in groups]
    sizes = unpack(rows["sizes"], "<u4")
    cuts = np.cumsum([0, *map(len, words)])
    owners = [np.repeat(at[a:b], s) for a, b, s in zip(cuts[:-1], cuts[1:], sizes)]
    owner, name = np.concatenate(owners), np.concatenate(names)
    weight = np.concatenate(unpack(rows["pair_counts"], "<u4"))
    seen = weight > 0
    owner, name, weight = owner[seen], name[seen], weight[seen]
    order = np.lexsort((name, owner))
    owner, name, weight = owner[order], name[order], weight[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (name[1:] != name[:-1])]) if len(owner) else np.empty(0, int)
    summed = np.add.reduceat(weight.astype(np.int64), first) if len(first) else np.empty(0)
    built = Trie.of(contexts, owner[first], name[first], summed, DISCOUNT)
    del order, owner, name, weight, first, summed
    with TemporaryDirectory(prefix="trie-") as folder:
        trie = built.mapped(folder)
        del built
        left = [trie.weights(w).tobytes() for w in words]
        codes = [trie.probabilities(contexts[o], x).tobytes() for o, x in zip(owners, names)]
        del trie
    tokens, kinds = int(totals.sum()), int((totals > 0).sum())
    return rows_of(
        {
            "g": (rows["g"].to_pylist(), pa.int32()),
            "shard": ([shard] * len(rows), pa.int32()),
            "counts": ([totals[at[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
            "left": (left, pa.binary()),
            "codes": (codes, pa.binary()),
            "tokens": ([tokens] * len(rows), pa.int64()),
            "kinds": ([kinds] * len(rows), pa.int64()),
        }
    )


def _score(g: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
    e = _encode(docs)
    answers = answers.sort_by("shard")
    # Every shard answers every group, so its totals add up to those of all texts.
    total, kinds = sum(answers["tokens"].to_pylist()), sum(answers["kinds"].to_pylist())
    counts = np.concatenate([*unpack(answers["counts"], "<i8")])
    left = restore(np.concatenate(unpack(answers["left"], "<u2")))
    codes = np.concatenate(unpack(answers["codes"], "<u2"))
    lower = (counts + 1) / (total + kinds + 1)
    logs = np.log10(restore(codes) + left[e.before] * lower[e.after])
    begin = starts(e.lengths)
    known = counts > 0
    sums = [np.add.reduceat(x, begin) if len(begin) else x[:0] for x in (known[e.tokens].astype(np.int64), np.log10(lower)[e.tokens], logs[e.pair_of])]
    return rows_of(
        {
            "doc_id": (docs["doc_id"].to_pylist(), pa.int64()),
            "rest": (docs["rest"].to_pylist(), pa.struct([("learn", pa.bool_())])),
            "n_tokens": (e.lengths, pa.int64()),
            "n_known": (sums[0], pa.int64()),
            "train_tokens": ([total] * len(docs), pa.int64()),
            "base_score": (sums[1], pa.float64()),
            "score": (sums[2], pa.float64()),
        }
    )


def scored(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are a text's words with A-Z lower-cased, then one end. ``learn`` marks the rows that are
    counted; null counts as marked. ``base_score`` is the text's log10 probability by add-one
    unigrams, ``score`` that by the model. A null text is empty: one token. Repeated
    rows are counted and scored each for itself, null ids stay. Other columns are not
    looked at. No rows give no rows.
    """
    marked = docs.withColumn("learn", F.coalesce(learn, F.lit(True)))
    groups = Groups(marked, doc_id, text, ["learn"])
    answers = groups.shards(groups.map(_ask(groups.n), _REQUEST), _answer, _ANSWER)
    return groups.answered(answers, _score, _SCORES).select("doc_id", "rest.learn", "n_tokens", "n_known", "train_tokens", "base_score", "score")
