"""The prefix trie, against a plain trie of lists and the oracle."""

import hashlib
import re
import zlib
from collections import defaultdict
from math import fmod

from tests.llm.conversations import conversations, odd_conversations
from tests.llm.tables import against_oracle
from tierflow.llm import prefix_trie as t

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sequences(rows):
    by_id = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            same = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            by_id[conv].append((turn is not None, turn or 0, role, same, text))
    return {conv: [(x[2], x[4]) for x in sorted(turns)] for conv, turns in by_id.items()}


def plain_rebuilt(rows):
    own = sequences(rows)
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = tuple(own.get(conv - int(fmod(conv, 20)), [])[:h] + turns[h:])
    return out


def plain_trie(by_id):
    members = defaultdict(list)
    for conv, turns in by_id.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        words = len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * words
            leaves[node[:d]] += node not in children
    rows = []
    for node, m in members.items():
        ends = ",".join(str(conv) for conv in sorted(m) if len(by_id[conv]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(m), len(node), parent, len(m), children[node], leaves[node], saved[node], digest))
    return sorted(rows, key=str)


def without_the_long(rows):
    return [r for r in rows if r[0] != 300]


def test_against_plain_trie(spark):
    for seed in (0, 1):
        rows = without_the_long(odd_conversations(seed))
        got = sorted((tuple(r) for r in t.prefix_trie(conversations(spark, rows, clashing=True)).collect()), key=str)
        assert got == plain_trie(plain_rebuilt(rows))


def test_trie_as_delivered(spark):
    rows = without_the_long(odd_conversations(2))
    by_id = {conv: tuple(turns) for conv, turns in sequences(rows).items()}
    got = sorted((tuple(r) for r in t.conversation_trie(conversations(spark, rows), hot_rows=3).collect()), key=str)
    assert got == plain_trie(by_id)


def test_long_conversation(spark):
    """A chain of 2,500 nodes; sums over its subtrees follow from the words below."""
    rows = [r for r in odd_conversations() if r[0] == 300]
    rows += [(301, *r[1:]) for r in rows[:1200]]
    out = sorted(t.conversation_trie(conversations(spark, rows)).collect(), key=lambda r: r.depth)
    assert [r.depth for r in out] == list(range(2501))
    assert [r.saved_tokens for r in out] == [2400] + [max(0, 2 * (1200 - d + 1)) for d in range(1, 2501)]
    assert [r.n_convs for r in out] == [2] * 1201 + [1] * 1300
    assert {r.n_leaves for r in out} == {1}


def test_oracle_on_odd_rows(spark, tmp_path):
    tables = {"conversations": conversations(spark, without_the_long(odd_conversations(4)), clashing=True)}
    assert against_oracle(spark, tmp_path, "op13_prefix_trie", tables) is None


def test_no_rows(spark, tmp_path):
    assert against_oracle(spark, tmp_path, "op13_prefix_trie", {"conversations": conversations(spark, [])}) is None
