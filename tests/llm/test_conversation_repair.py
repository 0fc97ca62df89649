"""Repaired conversations against a plain search over all edits."""

import hashlib
import random
import re

import pytest

from beaconry.llm import conversation_repair as c

NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def repair(rows):
    """(cost, audit, turns) of (role, text, fault) in order: the least of all cheapest, found state by state."""
    best = {0: (0, "", [])}

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                to, role = NEXT[state]
                new = (cost + 3, audit + "I", [*turns, f"{role}:"])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, turns) in with_inserts(best).items():
            more = 3 * (fault == "truncated")
            moves = [(state, 4, "D", turns)]
            if fault not in ("blank", "duplicate"):
                if state in KEPT.get(role[:1], {}):
                    moves.append((KEPT[role[:1]][state], more, "K", [*turns, f"{role}:{text}"]))
                to, given = NEXT[state]
                moves.append((to, 3 + more, "R", [*turns, f"{given}:{text}"]))
            for to, price, letter, after in moves:
                option = (cost + price, audit + letter, after)
                if to not in new or option[:2] < new[to][:2]:
                    new[to] = option
        best = new
    return min((v for k, v in with_inserts(best).items() if k in (0, 3)), key=lambda v: v[:2])


def plain(rows):
    """What op13 returns of a conversation's (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faulty = set(), []
    for _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not visible:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = None if visible[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faulty.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    kinds = [f for _, _, f in faulty]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
    cost, audit, done = repair(faulty)
    digest = hashlib.sha256("\n".join(done).encode()).hexdigest()
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest)


def random_turns(seed):
    draw = random.Random(seed)
    rows = []
    for conv in [None, *range(25)]:
        for _ in range(draw.choice([1, 2, 5, 12])):
            turn = draw.choice([None, 0, 1, 2, 3, 4, 5, 9])
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = draw.choice(["Yes.", "No", "So! ", " \t", "", None, "Ünder?", f"Line {draw.randint(0, 9)}.", "cut\nshort"])
            rows += [(conv, turn, role, text)] * draw.choice([1, 1, 1, 3])
    return rows


def result(spark, rows, **options):
    # Extra columns with names that the operator itself uses.
    turns = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, conv int, at int, edit int")
    edited = c.edits(turns, **options).cache()
    texts = {r["conv"]: (r["audit"], r["repaired_sha256"]) for r in c.digests(c.repaired(edited)).collect()}
    counts = {r[0]: tuple(r)[1:] for r in c.summary(edited).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost").collect()}
    return {conv: (*counts[conv], *texts[conv]) for conv in counts}


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"chunk_bits": 0}), (3, {"chunk_bits": 2})])
def test_edits_are_the_least_of_the_cheapest(spark, seed, options):
    rows = random_turns(seed)
    want = {conv: plain([r[1:] for r in rows if r[0] == conv]) for conv in {r[0] for r in rows}}
    assert result(spark, rows, **options) == want


def test_one_long_conversation_over_many_chunks(spark):
    draw = random.Random(5)
    rows = [(7, t, draw.choice(["user", "user", "assistant"]), draw.choice(["Well.", "cut", f"{t}!", f"{t}?"])) for t in range(3000)]
    rows += [(7, 100_000, "user", "Again and again.")] * 500
    rows += [(8, 0, "user", "x" * 200_000 + ".")]
    got = result(spark, rows, chunk_bits=5)
    assert got == {7: plain([r[1:] for r in rows if r[0] == 7]), 8: plain([rows[-1][1:]])}


def test_runs_by_powers():
    for symbol in range(9):
        costs = c.LAST
        for n in range(1, 40):
            costs = c.apply(c.power(symbol, 0), costs)
            assert c.advance(symbol, n, c.LAST) == costs


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    edited = c.edits(empty)
    assert edited.count() == 0
    assert c.digests(c.repaired(edited)).count() == 0 and c.summary(edited).count() == 0
