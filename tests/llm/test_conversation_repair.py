"""Conversation repair, against all edits of short words and the oracle."""

import hashlib
import itertools
import re

import pytest

from tests.llm.conversations import conversations, odd_conversations
from tests.llm.tables import against_oracle
from tierflow.llm import conversation_repair as c

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def brute(word):
    """The cheapest audit of (class, fault) letters, the least in ASCII, by trying edits in order of their cost."""
    best = None

    def go(i, roles, cost, audit):
        nonlocal best
        if best is not None and cost > best[0] or not re.match(r"(s?(ua)*u?)?\Z|s\Z", roles):
            return
        if i == len(word):
            if GRAMMAR.match(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
        else:
            kind, fault = c.CLASSES[word[i] % 4], c.FAULTS[word[i] // 4]
            more = 3 if fault == "truncated" else 0
            go(i + 1, roles, cost + 4, audit + "D")
            if fault not in ("blank", "duplicate"):
                go(i + 1, roles + kind, cost + more, audit + "K")
                for role in "ua":
                    go(i + 1, roles + role, cost + 3 + more, audit + "R")
        if not audit.endswith("III"):
            for role in "ua":
                go(i, roles + role, cost + 3, audit + "I")

    go(0, "", 0, "")
    return best


@pytest.mark.parametrize("length", range(4))
def test_all_short_words(length):
    automaton = c.Automaton()
    kinds = [k for k in range(16) if length < 3 or k in (0, 1, 2, 3, 5, 13, 14)]
    for word in sorted(itertools.product(kinds, repeat=length), key=lambda w: w[::-1]):
        automaton.enter("".join(c.LETTERS[k] for k in reversed(word)))
        assert automaton.repair() == brute(word), word


def test_longer_words():
    import random

    rng = random.Random(1)
    words = sorted({tuple(rng.choices([0, 1, 2, 1, 2, 3, 5, 10, 13], k=rng.randint(4, 6))) for _ in range(60)}, key=lambda w: w[::-1])
    automaton = c.Automaton()
    for word in words:
        automaton.enter("".join(c.LETTERS[k] for k in reversed(word)))
        assert automaton.repair() == brute(word), word
    # Words share the nodes of their endings, and each is computed once.
    assert automaton.computed == len({w[i:] for w in words for i in range(len(w))})


def test_long_word():
    automaton = c.Automaton()
    automaton.enter("cb" * 100_000)  # reversed: user first
    assert automaton.repair() == (0, "K" * 200_000)


def test_oracle_on_odd_rows(spark, tmp_path):
    tables = {"conversations": conversations(spark, odd_conversations(), clashing=True)}
    assert against_oracle(spark, tmp_path, "op11_suffix_dawg", tables) is None


def test_no_rows(spark, tmp_path):
    assert against_oracle(spark, tmp_path, "op11_suffix_dawg", {"conversations": conversations(spark, [])}) is None


def test_hot_words_and_joins_without_broadcast(spark):
    df = conversations(spark, odd_conversations(3)).persist()
    few = {tuple(r) for r in c.suffix_dawg(df).collect()}
    assert few == {tuple(r) for r in c.suffix_dawg(df, hot_rows=2, small_rows=0).collect()}


def test_repaired_rows(spark):
    rows = odd_conversations(5)
    out = {}
    for r in c.repaired(conversations(spark, rows)).collect():
        out.setdefault(r.conv_id, []).append((r.position, r.edit, r.role, r.text))
    assert out
    for conv, turns in out.items():
        turns.sort()
        assert [t[0] for t in turns] == list(range(len(turns)))
        assert GRAMMAR.match("".join(t[2][:1] for t in turns)), conv
        given = {(r[2] or " ", r[3] or " ") for r in rows if r[0] == conv}
        assert all((role, text) in given for _, edit, role, text in turns if edit == "K")
        assert all(text == "" for _, edit, _, text in turns if edit == "I")


def test_digest_of_what_is_left(spark):
    # 3 * 7 turns, so that some damage is dealt; the digest is that of the undamaged ones where nothing was to repair.
    rows = [(v, t, "user" if t % 2 == 0 else "assistant", f"{v} and {t}.") for v in range(40) for t in range(4)]
    for r in c.suffix_dawg(conversations(spark, rows)).collect():
        if r.audit == "KKKK" and r.cost == 0:
            own = [f"{x[2]}:{x[3]}" for x in rows if x[0] == r.conv_id]
            assert r.repaired_sha256 == hashlib.sha256("\n".join(own).encode()).hexdigest()
