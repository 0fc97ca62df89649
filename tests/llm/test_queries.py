"""The registered queries over a whole small table, beside plain versions of the same work."""

import hashlib
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import xxhash

from beaconry.llm import topk
from beaconry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pandas().sort_values("doc_id")


@pytest.fixture(scope="module")
def texts(docs):
    return {int(d): t or "" for d, t in zip(docs["doc_id"], docs["text"])}


def run(spark, name):
    return QUERIES[name](spark, SF).toPandas()


def test_op1_pieces_tile_documents_and_sequences(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = run(spark, "op1_packing")
    assert set(got["doc_id"]) == set(texts)
    for doc, pieces in got.sort_values("start").groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[doc], add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for piece in pieces.itertuples():
            assert piece.start == at and piece.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + piece.length].tobytes()) == piece.ids_crc32
            at += piece.length
        assert at == len(ids)
    used = 0
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        assert (pieces["offset"].to_numpy() == np.r_[0, pieces["length"].cumsum()[:-1]]).all()
        assert pieces["length"].sum() <= 2048
        used += 2048
    assert got["length"].sum() > 0.97 * used


def simhash(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_op3_against_all_pairs(spark, texts):
    got = run(spark, "op3_simhash").set_index("doc_id")
    prints = {d: simhash(t) for d, t in texts.items()}
    assert {d: int(f, 16) for d, f in got["fingerprint"].items()} == prints
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert got["component_id"].to_dict() == smallest_reachable(prints, links)


def test_op4_meets_targets(spark, docs):
    got = run(spark, "op4_mixing")
    sizes = {int(d): len((t or "").encode().split()) for d, t in zip(docs["doc_id"], docs["text"])}
    assert got.set_index("doc_id")["size"].to_dict() == sizes
    source = dict(zip(docs["doc_id"], docs["source"]))
    total = defaultdict(int)
    for d, n in sizes.items():
        total[source[d]] += n
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        share = left / sum(weight[s] for s in order if s not in full)
        target = {s: 3 * total[s] if s in full else share * weight[s] for s in order}
        over = {s for s in order if target[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    got["source"] = got["doc_id"].map(source)
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    for s, rows in got.groupby("source"):
        assert rows["target"].iloc[0] == pytest.approx(target[s])
        assert rows["source_size"].iloc[0] == total[s]
        assert abs(rows["taken"].sum() - target[s]) <= rows["size"].max() + 1
    again = run(spark, "op4_mixing")
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_op7_bytes_are_near_equal(spark, texts):
    got = run(spark, "op7_sharding")
    sizes = {d: len(t.encode()) + 1 for d, t in texts.items()}
    assert got.set_index("doc_id")["size"].to_dict() == sizes
    assert got.set_index("doc_id")["text_crc32"].to_dict() == {d: zlib.crc32(t.encode()) for d, t in texts.items()}
    assert set(got["shard"]) <= set(range(8)) and set(got["law"]) == {"bytes"}
    for _, rows in got.groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))
    even = sum(sizes.values()) / 8
    assert (got.groupby("shard")["size"].sum() - even).abs().max() <= max(sizes.values()) + 0.1 * even


def test_op8_against_all_products(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    vectors = {int(i): np.floor(256 * np.array(v, dtype=np.float64)).astype(int) for i, v in zip(rows["vec_id"], rows["embedding"])}
    want = []
    for q in vectors:
        if q % 50 == 0:
            best = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    got = run(spark, "op8_topk")
    assert sorted(got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == sorted(want)


def test_op10_edits_and_likeness(spark, texts):
    got = run(spark, "op10_winnowing").set_index("doc_id")
    order = sorted(texts)
    assert sorted(got.index) == order
    by_text = defaultdict(set)
    for d, after in zip(order, order[1:] + order[:1]):
        n = len(texts[d])
        edited = texts[d][: n - n // 4] + texts[after][: n // 4]
        assert got.at[d, "n_chars"] == n
        assert got.at[d, "edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        by_text[texts[d]].add(got.at[d, "fingerprint"])
        by_text[edited].add(got.at[d, "edited_fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert got["near_edited"].median() > 0.5 and got["near_next"].median() < 0.1


def test_op9_against_plain_counts(spark, texts):
    import math
    from collections import Counter

    got = run(spark, "op9_ngram_trie").set_index("doc_id")
    tokens = {d: t.encode().lower().split() + [None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    count, pair, after = Counter(), Counter(), Counter()
    for d, words in tokens.items():
        if not held[d]:
            count.update(words)
            pair.update(zip(["<"] + words, words))
    for (v, _), n in pair.items():
        after[v] += n
    kinds = Counter(v for v, _ in pair)
    total, different = sum(count.values()), len(count)
    assert set(got["train_tokens"]) == {total}
    for d, words in tokens.items():
        low = [(count[w] + 1) / (total + different + 1) for w in words]
        model = []
        for v, w, p in zip(["<"] + words, words, low):
            n = after[v]
            model.append((max(pair[v, w] - 0.75, 0) + 0.75 * kinds[v] * p) / n if n else p)
        assert bool(got.at[d, "held_out"]) == held[d]
        assert got.at[d, "n_tokens"] == len(words) and got.at[d, "n_known"] == sum(count[w] > 0 for w in words)
        assert got.at[d, "base_score"] == pytest.approx(sum(map(math.log10, low)))
        assert got.at[d, "score"] == pytest.approx(sum(map(math.log10, model)), abs=1e-3 * len(words))
    held_rows = got[got["held_out"]]
    assert held_rows["score"].sum() > held_rows["base_score"].sum()


def plain_removal(texts, length=50):
    """(removed, spans, kept) by a table of the first document of every string."""
    first, out = {}, {}
    for d in sorted(texts):
        data = texts[d].encode()
        strings = [data[i : i + length] for i in range(len(data) - length + 1)]
        covered = np.zeros(len(data) + 1, dtype=bool)
        for i, s in enumerate(strings):
            if first.get(s, d) < d:
                covered[i : i + length] = True
        for s in strings:
            first.setdefault(s, d)
        turns = int((np.diff(np.r_[False, covered].astype(int)) == 1).sum())
        kept = bytes(b for b, c in zip(data, covered) if not c)
        out[d] = (len(data), int(covered.sum()), turns, hashlib.sha256(kept).hexdigest())
    return out


def test_op5_against_all_strings(spark, texts):
    got = run(spark, "op5_suffixes")
    rows = got[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)
    assert {r[0]: tuple(r[1:]) for r in rows} == plain_removal(texts)


def test_small_groups_give_the_same(spark, monkeypatch):
    from beaconry.llm import groups

    def rows(name):
        got = run(spark, name)
        got = got.reindex(sorted(got.columns), axis=1)
        return sorted(map(repr, got.round(6).itertuples(index=False, name=None)))

    names = ("op2_passages", "op5_suffixes", "op9_ngram_trie")
    whole = {name: rows(name) for name in names[1:]}
    found = set(zip(run(spark, names[0])["doc_id"], run(spark, names[0])["class_id"]))
    monkeypatch.setattr(groups, "GROUP_BYTES", 60_000)
    assert {name: rows(name) for name in names[1:]} == whole
    again = run(spark, names[0])
    assert len(found) and len(found ^ set(zip(again["doc_id"], again["class_id"]))) <= 0.1 * len(found)


@pytest.mark.parametrize("seed", range(3))
def test_top_scores_of_ids_with_several_vectors(spark, seed):
    """Against all pairs: an id counts with its best vector, and a result has k different ids."""
    draw = np.random.default_rng(seed)
    rows = [(0, [9, 9, 9])] + [(1, draw.integers(0, 9, 3).tolist()) for _ in range(8)] + [(i, draw.integers(-9, 9, 3).tolist()) for i in range(2, 8)]
    rows += [(int(draw.integers(8, 20)), draw.integers(-4, 5, 3).tolist()) for _ in range(150)]
    data = spark.createDataFrame(rows, "vec_id long, ints array<long>")
    asked = data.where("vec_id % 3 = 0")
    best = {}
    for query, q in rows:
        for i, x in rows:
            if query % 3 == 0 and i != query:
                score = int(np.dot(q, x))
                best.setdefault(query, {})[i] = max(best.get(query, {}).get(i, score), score)
    want = {q: sorted(((-s, i) for i, s in found.items()))[:5] for q, found in best.items()}
    got = topk.top_scores(data, asked, k=5, rows_each=20, queries_each=4).collect()
    assert {q: sorted((-r["score"], r["vec_id"]) for r in got if r["query_id"] == q) for q in want} == want
    assert [r["rank"] for r in sorted(got) if r["query_id"] == 0] == [1, 2, 3, 4, 5]
