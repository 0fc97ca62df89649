import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from beaconry.llm import ngram_trie
from beaconry.llm.elias_fano import Monotone, Trie, quantise, restore


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=300), st.lists(st.integers(0, 2**63), max_size=50))
def test_monotone_round_trip_and_successor(values, asked):
    values = np.sort(np.array(values, dtype=np.uint64))
    coded = Monotone.of(values)
    assert (coded[np.arange(len(values))] == values).all()
    asked = np.array([*asked, *values[:20]], dtype=np.uint64)
    if len(values):
        assert (coded.next_geq(asked) == np.searchsorted(values, asked)).all()
        assert ((coded.find(asked) >= 0) == np.isin(asked, values)).all()


def test_small_steps():
    values = np.sort(np.random.default_rng(1).integers(0, 500, 2000)).astype(np.uint64)
    coded = Monotone.of(values)
    asked = np.arange(510, dtype=np.uint64)
    assert (coded[np.arange(2000)] == values).all()
    assert (coded.next_geq(asked) == np.searchsorted(values, asked)).all()


def test_trie_probabilities():
    contexts = np.array([5, 9, 70], dtype=np.uint64)
    owner, names, counts = np.array([0, 0, 2]), np.array([3, 8, 3], dtype=np.uint64), np.array([1, 3, 2])
    trie = Trie.of(contexts, owner, names, counts, 0.75)
    got = restore(trie.probabilities(np.array([5, 5, 5, 70, 9, 6], dtype=np.uint64), np.array([3, 8, 4, 3, 3, 3], dtype=np.uint64)))
    assert np.allclose(got, [0.25 / 4, 2.25 / 4, 0, 1.25 / 2, 0, 0], rtol=1e-3)
    assert np.allclose(restore(trie.weights(contexts)), [1.5 / 4, 1, 0.75 / 2], rtol=1e-3)


def test_quantised_never_above():
    p = np.random.default_rng(2).random(1000) ** 4
    assert (restore(quantise(p)) <= p * (1 + 1e-9)).all() and np.allclose(restore(quantise(p)), p, rtol=1e-3)


def arrays(level):
    return level.low, level.high, level.zeros_before


def random_trie(rng, contexts=40, names=60):
    """A trie, and the count of every (context, name) in it; some contexts have no successors."""
    contexts, names = (np.unique(rng.integers(1, 2**40, n).astype(np.uint64)) for n in (contexts, names))
    counts = rng.integers(0, 4, (len(contexts), len(names))) * (rng.random((len(contexts), len(names))) < 0.2)
    counts[[0, 7, 8, -1]] = 0
    owner, name = np.nonzero(counts)
    return Trie.of(contexts, owner, names[name], counts[owner, name], 0.75), contexts, names, counts


def asked_for_all(trie, contexts, names):
    return trie.probabilities(np.repeat(contexts, len(names)), np.tile(names, len(contexts))).reshape(len(contexts), -1)


def test_successors_are_searched_between_the_pointers_of_their_context():
    trie, contexts, names, counts = random_trie(np.random.default_rng(3))
    want = np.maximum(counts - 0.75, 0) / np.maximum(counts.sum(axis=1), 1)[:, None]
    assert np.allclose(restore(asked_for_all(trie, contexts, names)), want, rtol=1e-3)
    # Relative to their context: the values grow by a context's own names, not by all names for each context.
    seen = counts[:, counts.any(axis=0)]
    last = [np.flatnonzero(c).max() + 1 for c in seen if c.any()]
    assert int(trie.successors[np.array([trie.successors.n - 1])][0]) == sum(last) - 1


def test_mapped_levels_answer_as_those_in_memory(tmp_path):
    trie, contexts, names, _ = random_trie(np.random.default_rng(4))
    mapped = trie.mapped(str(tmp_path))
    flat = [x for level in (mapped.contexts, mapped.pointers, mapped.names, mapped.successors) for x in arrays(level)]
    assert all(isinstance(x, np.memmap) for x in [*flat, mapped.discounted, mapped.left])
    assert (asked_for_all(mapped, contexts, names) == asked_for_all(trie, contexts, names)).all()
    assert (mapped.weights(contexts) == trie.weights(contexts)).all()


def test_mapped_trie_without_successors(tmp_path):
    none = np.empty(0, np.int64)
    trie = Trie.of(np.array([5], np.uint64), none, none.astype(np.uint64), none, 0.75).mapped(str(tmp_path))
    asked = np.array([5, 6], np.uint64)
    assert (restore(trie.probabilities(asked, asked)) == 0).all() and (restore(trie.weights(asked)) == 1).all()


def test_a_shard_looks_up_in_mapped_files_and_leaves_none(tmp_path, monkeypatch):
    texts = pa.table({"doc_id": [1, 2], "text": ["a b a b c", "b a d"], "rest": [{"learn": True}, {"learn": False}]})
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    seen, find = [], Monotone.find
    monkeypatch.setattr(Monotone, "find", lambda self, values: seen.append(self) or find(self, values))
    answer = ngram_trie._answer(0, ngram_trie._ask(1)(0, texts))
    assert answer.num_rows == 1 and seen and all(isinstance(x, np.memmap) for level in seen for x in arrays(level))
    assert not list(tmp_path.iterdir())
