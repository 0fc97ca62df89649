import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from beaconry.llm import suffixes
from beaconry.llm.suffixes import BlindTrie, sort_suffixes


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=30, max_size=30), min_size=1, max_size=40))
def test_blind_trie_orders(strings):
    strings = [s.encode() for s in strings]
    trie = BlindTrie(strings[0])
    for s in strings[1:]:
        trie.add(s)
    assert list(trie) == sorted(set(strings))


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=60, max_size=400), st.integers(1, 4))
def test_sort_suffixes(text, times):
    data = np.frombuffer((text * times).encode() + bytes(96), dtype=np.uint8)
    at = np.arange(len(text) * times - 49)
    order, new = sort_suffixes(data, at)
    strings = [data[i : i + 50].tobytes() for i in at]
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    assert new.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]


def test_state_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 1000):
        first, count = rng.integers(0, 2**32, n), rng.integers(1, 28, n)
        opens, later = rng.random(n) < 0.5, rng.random(n) < 0.3
        got = suffixes.unpack_state(suffixes.pack_state(first, count, opens, later))
        for a, b in zip(got, (first, count, np.cumsum(opens) - 1, later)):
            assert (a == b).all() and len(a) == n
    ids = rng.integers(-(2**63), 2**63 - 1, 50)
    assert (suffixes.from_planes(suffixes.planes(ids), "<i8") == ids).all()
    assert len(suffixes.from_planes(b"", "<i8")) == 0


def test_parts_are_ranges_of_a_shard():
    keys = np.sort(np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64))
    both = suffixes.spread(keys, 7) * suffixes.PARTS + suffixes._part(keys, 7)
    assert (np.diff(both) >= 0).all()
