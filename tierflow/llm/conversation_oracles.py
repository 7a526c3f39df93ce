"""DuckDB SQL for the operators on conversations, written in another way than the operators."""

from __future__ import annotations

from tierflow.llm import conversation_repair as r
from tierflow.llm import prefix_trie as t
from tierflow.llm.oracles import BLANKS, WORD, crc_table


def crc32(text: str) -> str:
    """CRC-32 of a text, unsigned."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = f"xor(a >> 8, ({crc_table()!r}::BIGINT[])[1 + (xor(a, x) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, x: {step}), 4294967295)"


# ---- conversation prefix trie ----------------------------------------------------------------


def prefix_trie() -> str:
    """All nodes as lists of turns, each joined with its ancestors."""
    return rf"""
WITH texts AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (SELECT *, sha256(length(role)::VARCHAR || ':' || role || text) AS same FROM texts),
placed AS (
  SELECT conv_id, same, len(regexp_extract_all(text, '{WORD}')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, same) AS place FROM hashed),
family AS (
  SELECT conv_id, conv_id - conv_id % {t.FAMILY} AS first, {crc32("conv_id::VARCHAR")} % {t.SHARED + 1} AS h
  FROM (SELECT DISTINCT conv_id FROM texts)),
rebuilt AS (
  SELECT family.conv_id, same, words, place FROM family JOIN placed ON placed.conv_id = first WHERE place <= h
  UNION ALL
  SELECT family.conv_id, same, words, place + {t.SHARED} FROM family JOIN placed ON placed.conv_id = family.conv_id WHERE place > h),
sequences AS (
  SELECT family.conv_id, coalesce(list(same ORDER BY place) FILTER (same IS NOT NULL), []) AS turns,
    coalesce(list(words ORDER BY place) FILTER (same IS NOT NULL), []) AS words
  FROM family LEFT JOIN rebuilt ON rebuilt.conv_id = family.conv_id GROUP BY family.conv_id),
members AS (
  SELECT conv_id, d, turns[1:d] AS turns, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(words) AS ends
  FROM (SELECT conv_id, turns, words, unnest(range(0, len(words) + 1)) AS d FROM sequences)),
nodes AS (
  SELECT turns, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends
  FROM members GROUP BY turns, d),
children AS (SELECT turns[1:d - 1] AS turns, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT v.turns[1:u] AS turns, sum((v.n_convs - 1) * v.words) AS saved, count(*) FILTER (children.n IS NULL) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM nodes) AS v LEFT JOIN children ON children.turns = v.turns GROUP BY 1)
SELECT nodes.conv_id, nodes.d AS depth, parent.conv_id AS parent_conv_id, nodes.n_convs, coalesce(children.n, 0) AS n_children,
  below.n_leaves, below.saved::BIGINT AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN below ON below.turns = nodes.turns LEFT JOIN children ON children.turns = nodes.turns
LEFT JOIN nodes AS parent ON parent.d = nodes.d - 1 AND parent.turns = nodes.turns[1:nodes.d - 1]"""


# ---- conversation structure repair -----------------------------------------------------------


def suffix_dawg() -> str:
    """Each conversation by itself, from its end, with whole audits in the state."""
    infinite = 10**15

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def ahead(cost: str, edit: str, state: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': '{edit}' || {state}.a}}"

    def base(state: int) -> str:
        """The cheapest edit of turn `x` in a state, where `s` has the rest's repair by state."""
        here, after = f"s.s{state}", f"s.s{r.NEXT[state]}"
        more = f"CASE WHEN x.fault = 'truncated' THEN {r.TRUNCATED} ELSE 0 END"
        bad = "x.fault IN ('blank', 'duplicate')"
        possible = f"x.kind = '{r.WANTED[state]}'"
        keep = ahead(f"CASE WHEN {bad} OR NOT {possible} THEN {infinite} ELSE {more} END", "K", after)
        options = [ahead(str(r.DELETE), "D", here), keep, ahead(f"CASE WHEN {bad} THEN {infinite} ELSE {r.REROLE} + {more} END", "R", after)]
        if state == 0:
            options.append(ahead(f"CASE WHEN {bad} OR x.kind <> 's' THEN {infinite} ELSE {more} END", "K", "s.s1"))
        return least(*options)

    def put_in(b: str) -> str:
        """With turns inserted before."""
        i = str(r.INSERT)
        two, three = least(f"{b}.b2", ahead(i, "I", f"{b}.b3")), least(f"{b}.b3", ahead(i, "I", f"{b}.b2"))
        rest = f"list_transform([{{'s2': {two}, 's3': {three}}}], lambda q: {{'s0': {least(f'{b}.b0', ahead(i, 'I', 'q.s2'))}, 's1': {least(f'{b}.b1', ahead(i, 'I', 'q.s2'))}, 's2': q.s2, 's3': q.s3}})[1]"
        return rest

    bases = ", ".join(f"'b{n}': {base(n)}" for n in range(4))
    step = f"list_transform([{{{bases}}}], lambda b: {put_in('b')})[1]"
    end = "{'s0': {'c': 0::BIGINT, 'a': ''}, 's1': {'c': %d::BIGINT, 'a': 'II'}, 's2': {'c': %d::BIGINT, 'a': 'I'}, 's3': {'c': 0::BIGINT, 'a': ''}}" % (2 * r.INSERT, r.INSERT)
    return rf"""
WITH original AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS damage FROM conversations),
rows_left AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM original WHERE damage <> 0),
hashed AS (SELECT *, sha256(length(role)::VARCHAR || ':' || role || text) AS same, rtrim(text, {BLANKS}) AS bare FROM rows_left),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, same, copy) AS place FROM hashed),
faulty AS (
  SELECT *, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS kind,
    CASE WHEN bare = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    substr(lag(role) OVER (PARTITION BY conv_id ORDER BY place), 1, 1) AS before
  FROM placed),
solved AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (place > 1 AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list({{'kind': kind, 'fault': fault}} ORDER BY place DESC), lambda s, x: {step}, {end}).s0 AS best
  FROM faulty GROUP BY conv_id),
edits AS (
  SELECT conv_id, k, substr(audit, k::INT, 1) AS edit
  FROM (SELECT conv_id, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS k FROM solved)),
numbered AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS place, count(*) FILTER (edit <> 'D') OVER w AS emitted
  FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
emitted AS (
  SELECT n.conv_id, n.emitted, n.edit, f.role, f.text,
    max(CASE WHEN n.emitted = 1 AND n.edit = 'K' AND f.kind = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS system
  FROM numbered AS n LEFT JOIN faulty AS f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.place = n.place AND n.edit <> 'I'
  WHERE n.edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (emitted - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
    chr(10) ORDER BY emitted) AS whole
  FROM emitted GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o
LEFT JOIN solved ON solved.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM o.conv_id"""
