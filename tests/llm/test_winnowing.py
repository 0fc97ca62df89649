"""Fingerprints against a plain one, ties, the match guarantee, and edited texts."""

import hashlib
import random

import pytest

from beaconry.llm import winnowing as w

FULL = (1 << 64) - 1


def plain(text, k=w.K, window=w.WINDOW):
    """(hash, position) kept, run by run and window by window."""
    codes = [ord(c) for c in text]
    if not codes:
        return []
    k = min(k, len(codes))
    hashes = []
    for i in range(len(codes) - k + 1):
        h = 0
        for code in codes[i : i + k]:
            h = (h * int(w._BASE) + code + 1) & FULL
        h = (h ^ h >> 32) * int(w._MIX) & FULL
        hashes.append((h ^ h >> 29) >> 32)
    window = min(window, len(hashes))
    kept = []
    for i in range(len(hashes) - window + 1):
        least = min(hashes[i : i + window])
        at = max(j for j in range(i, i + window) if hashes[j] == least)
        if not kept or kept[-1][1] != at:
            kept.append((least, at))
    return kept


def texts(seed):
    draw = random.Random(seed)
    made = ["", "a", "short", "é" * 11, "é" * 12, "a" * 200, "ab" * 150, "x" * 43, "x" * 44]
    made += ["".join(draw.choice("ab cé𝄞") for _ in range(draw.choice([30, 100, 400]))) for _ in range(12)]
    return made


@pytest.mark.parametrize("k, window", [(w.K, w.WINDOW), (3, 4), (1, 1), (5, 9)])
def test_fingerprints_against_every_window(k, window):
    for text in texts(1):
        hashes, positions = w.winnow(text, k, window)
        assert list(zip(hashes.tolist(), positions.tolist())) == plain(text, k, window)


def test_rightmost_of_equal_hashes():
    _, positions = w.winnow("a" * 60, 5, 10)
    # All hashes are equal: each window keeps its last one.
    assert positions.tolist() == list(range(9, 56))


def test_long_shared_passages_share_a_hash():
    draw = random.Random(2)
    for _ in range(200):
        shared = "".join(draw.choice("abc") for _ in range(w.K + w.WINDOW - 1))
        a, b = ("".join(draw.choice("xyz") for _ in range(draw.randint(0, 90))) for _ in range(2))
        assert set(w.winnow(a + shared + b)[0].tolist()) & set(w.winnow(b + shared + a)[0].tolist())


@pytest.mark.parametrize("rows_each", [5000, 4])
def test_edited_texts_and_next_documents(spark, rows_each):
    rows = [(i * 3 - 5, t) for i, t in enumerate(texts(3))] + [(1000, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, bucket int, positions int").repartition(3)
    got = {r["doc_id"]: r for r in w.edited_fingerprints(docs, rows_each=rows_each).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(ordered)

    def hashes(text):
        return {h for h, _ in plain(text)}

    def like(a, b):
        return len(hashes(a) & hashes(b)) / len(hashes(a) | hashes(b)) if hashes(a) | hashes(b) else 1.0

    for n, (i, text) in enumerate(ordered):
        after = ordered[(n + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        row = got[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == "".join(f"{h:08x}" for h, _ in plain(text)) and row["positions"] == [p for _, p in plain(text)]
        assert row["edited_fingerprint"] == "".join(f"{h:08x}" for h, _ in plain(edited))
        assert (row["near_edited"], row["near_next"]) == (like(text, edited), like(text, after))
