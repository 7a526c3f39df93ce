"""DuckDB SQL for the operators that SQL can express; parameters are the queries' defaults."""

from __future__ import annotations

from tierflow.llm import entropy_secrets as e
from tierflow.llm import hash_tree as h
from tierflow.llm import line_frequency as q
from tierflow.llm import link_graph as g
from tierflow.llm import splitting_tree as m

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def crc_table() -> list[int]:
    """The table of CRC-32 with the reflected polynomial 0xEDB88320."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- sharding --------------------------------------------------------------------------------


def hash_tree(shards: list[h.Shard], grown: list[h.Shard]) -> str:
    """Every node of both trees draws, on the way or not."""
    names: dict[h.Node, str] = {}

    def named(node: h.Node) -> str:
        return names.setdefault(node, f"d{len(names)}")

    def draw(node: h.Node) -> str:
        digits = f"substr(md5(key || ':{node.label}'), 1, {h.DIGITS})"
        return f"(-ln((('0x' || {digits})::BIGINT + 0.5::DOUBLE) / {float(16**h.DIGITS)!r}::DOUBLE) / {node.weight!r}::DOUBLE)"

    def below(node: h.Node, depth: int = 0) -> str:
        if depth == len(h.LEVELS):
            return str(node.shards[0].number)
        children = node.children(depth)
        lowest = f"least({', '.join(map(named, children))})"
        return "CASE " + " ".join(f"WHEN {named(c)} = {lowest} THEN {below(c, depth + 1)}" for c in children) + " END"

    reached, after = below(h.Node("", tuple(shards))), below(h.Node("", tuple(grown)))
    columns = ", ".join(f"{draw(node)} AS {name}" for node, name in names.items())

    crc = (
        f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)), "
        f"lambda a, x: xor(a >> 8, ({crc_table()!r}::BIGINT[])[1 + (xor(a, x) & 255)]))"
    )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents),
drawn AS (SELECT doc_id, octet_length(encode(t)) + 1 AS size, xor({crc}, 4294967295) AS text_crc32, {columns} FROM texts),
placed AS (SELECT doc_id, size, text_crc32, {reached} AS shard, {after} AS grown_shard FROM drawn),
bucketed AS (
  SELECT *, ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), size::VARCHAR, text_crc32::VARCHAR)), 1, 8))::BIGINT
    % (SELECT greatest(1, ceil(count(*) / {len(shards) * h.SLOT_ROWS}.0))::BIGINT FROM documents) AS bucket
  FROM placed)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM bucketed"""


# ---- quality rules ---------------------------------------------------------------------------


def line_frequency() -> str:
    lower = f"translate(line, '{UPPER}', '{LOWER}')"
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
measured AS (
  SELECT row, doc_id, host, t, regexp_extract_all(t, '{WORD}') AS w,
    list_filter(string_split(t, chr(10)), lambda line: regexp_matches(line, '{WORD}')) AS l FROM texts),
windows AS (
  SELECT row, i, w[i : i + 2] AS win FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM measured)),
again AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, win) > 1),
repeated AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY row),
lines AS (
  SELECT row, doc_id, host, md5(t) AS content, array_to_string(regexp_extract_all({lower}, '{WORD}'), ' ') AS line
  FROM (SELECT row, doc_id, host, t, unnest(l) AS line FROM measured)),
frequent AS (
  SELECT host, line, min(doc_id) AS first FROM lines GROUP BY host, line HAVING count(DISTINCT content) > {q.MAX_DOCUMENTS}),
marked AS (
  SELECT lines.row, len(regexp_extract_all(lines.line, '{WORD}')) AS n,
    frequent.line IS NOT NULL AND lines.doc_id IS DISTINCT FROM frequent.first AS gone
  FROM lines LEFT JOIN frequent ON lines.host IS NOT DISTINCT FROM frequent.host AND lines.line = frequent.line),
left_over AS (
  SELECT row, sum(n)::BIGINT AS line_words, coalesce(sum(n) FILTER (NOT gone), 0)::BIGINT AS n_words_left FROM marked GROUP BY row),
joined AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, {BLANKS}, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{q.SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    coalesce(line_words, 0) AS line_words, coalesce(n_words_left, 0) AS n_words_left
  FROM measured LEFT JOIN repeated USING (row) LEFT JOIN left_over USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_words_left >= {q.MIN_LEFT} * line_words AS kept,
  n_words_left
FROM joined"""


# ---- url filters -----------------------------------------------------------------------------


def link_graph() -> str:
    def rule(value) -> str:
        cases = "".join(
            f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'"
            for r in sorted(g.RULES, key=lambda r: -len(r.text))
        )
        return f"CASE{cases} END"

    def rounds(name: str, source: str, target: str, divided_by: str) -> str:
        steps = [
            f"""{name}_shares AS MATERIALIZED (
  SELECT {source} AS source, {target} AS target, links / sum(links) OVER (PARTITION BY {divided_by}) AS share FROM edges),
{name}_0 AS MATERIALIZED (SELECT host, {name} * {1 - g.DAMPING} AS rank FROM hosts WHERE {name} > 0)"""
        ]
        for n in range(1, g.ROUNDS + 1):
            steps.append(
                f"""{name}_{n} AS MATERIALIZED (SELECT host, sum(rank) AS rank FROM (
  SELECT target AS host, rank * share * {g.DAMPING} AS rank FROM {name}_{n - 1} JOIN {name}_shares ON host = source
  UNION ALL SELECT host, rank FROM {name}_0) GROUP BY host)"""
            )
        return ",\n".join(steps)

    lower = f"'{UPPER}', '{LOWER}'"
    host = f"translate(coalesce(regexp_extract(url, '{g.HOST}', 1), ''), {lower})"
    return f"""
WITH judged AS (
  SELECT page_id, host, path, {rule(lambda r: r.text)} AS rule, {rule(lambda r: r.verdict)} AS verdict
  FROM (SELECT page_id, {host} AS host, coalesce(regexp_extract(url, '{g.PATH}', 1), '') AS path FROM pages)),
hosts AS MATERIALIZED (
  SELECT host, count(*) FILTER (verdict = 'allow') / count(*) AS trust, count(*) FILTER (verdict = 'block') / count(*) AS distrust
  FROM judged WHERE host <> '' GROUP BY host),
links AS (SELECT {host} AS source, unnest(regexp_extract_all(html, {quoted(g.LINK)}, 1)) AS link FROM pages),
edges AS MATERIALIZED (
  SELECT source, target, count(*) AS links FROM (SELECT source, translate(link, {lower}) AS target FROM links)
  WHERE source <> target AND source <> '' GROUP BY source, target),
{rounds("trust", "source", "target", "source")},
{rounds("distrust", "target", "source", "source")},
scores AS (
  SELECT host, round(sum(t), 9) AS t, round(sum(d), 9) AS d, round(sum(d) - sum(o), 9) AS linked FROM (
    SELECT host, rank AS t, 0.0::DOUBLE AS d, 0.0::DOUBLE AS o FROM trust_{g.ROUNDS}
    UNION ALL SELECT host, 0.0, rank, 0.0 FROM distrust_{g.ROUNDS} UNION ALL SELECT host, 0.0, 0.0, distrust * {1 - g.DAMPING} FROM hosts) GROUP BY host),
blocked AS (
  SELECT host AS bad FROM scores
  WHERE d > t AND (d >= {round(g.BLOCKED_SHARE * (1 - g.DAMPING), 9)} OR linked >= {round(g.BLOCKED_SHARE * (1 - g.DAMPING) * g.DAMPING, 9)}))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM judged LEFT JOIN blocked ON rule IS NULL AND host = bad"""


# ---- mixing ----------------------------------------------------------------------------------


def hashed(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, {m.DIGITS}))::BIGINT"


def splitting_mix() -> str:
    return f"""
WITH sized AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    {hashed("'row'", "coalesce(doc_id::VARCHAR, 'null')", "md5(coalesce(text, ''))")} AS k FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM sized GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number, {m.MOST} * source_size AS cap FROM per_source),
weights AS (SELECT *, ({list(m.WEIGHTS)!r})[number % {len(m.WEIGHTS)} + 1] AS weight FROM weighed),
filling AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight,
    sum(source_size) OVER () AS total FROM weights
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, ((total * {m.SHARE})::DOUBLE / 100.0::DOUBLE - capped::DOUBLE) / open_weight::DOUBLE AS level FROM filling),
final AS (
  SELECT level FROM levels WHERE level * weight <= cap::DOUBLE ORDER BY cap::DOUBLE / weight, number LIMIT 1),
sources AS (
  SELECT source, number, source_size, n_rows,
    CASE WHEN cap = 0 THEN 0.0::DOUBLE ELSE least(coalesce((SELECT level FROM final) * weight, cap::DOUBLE), cap::DOUBLE) END AS target
  FROM levels),
dealt AS (
  SELECT row, doc_id, size, k, number, source_size, target, k % greatest(ceil(n_rows / {m.BLOCK_ROWS}.0)::BIGINT, 1) AS block
  FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source),
wanted AS (
  SELECT number, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes,
    CASE WHEN source_size > 0 THEN round(target)::BIGINT % source_size ELSE 0 END AS rest FROM sources),
blocks AS (
  SELECT number, block, words, coalesce(sum(words) OVER (PARTITION BY number ORDER BY place, block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM (SELECT number, block, sum(size) AS words, {hashed("'block'", "number::VARCHAR", "block::VARCHAR")} AS place FROM dealt GROUP BY number, block)),
planned AS (
  SELECT number, block, passes, begin + words <= rest AS whole,
    CASE WHEN begin < rest AND begin + words > rest THEN (rest - begin)::BIGINT END AS room FROM blocks JOIN wanted USING (number)),
open AS (
  SELECT number, block, room, list({{'size': size, 'k': k, 'r': row}} ORDER BY size DESC, k DESC, row DESC) AS members
  FROM dealt JOIN planned USING (number, block) WHERE room IS NOT NULL GROUP BY number, block, room),
filled AS (
  SELECT list_reduce(members, lambda s, x: CASE WHEN x.size <= s.room
      THEN {{'room': s.room - x.size, 'taken': list_append(s.taken, x.r), 'next': s.next, 'size': s.size}}
      ELSE {{'room': s.room, 'taken': s.taken, 'next': x.r, 'size': x.size}} END,
    {{'room': room, 'taken': []::BIGINT[], 'next': NULL::BIGINT, 'size': 0::BIGINT}}) AS s FROM open),
extra AS (
  SELECT unnest(CASE WHEN s.next IS NOT NULL AND 2 * s.room >= s.size THEN list_append(s.taken, s.next) ELSE s.taken END) AS row FROM filled)
SELECT doc_id, size, source_size, target,
  (size * (passes + CASE WHEN whole OR row IN (SELECT row FROM extra) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM dealt JOIN planned USING (number, block)"""


# ---- secrets ---------------------------------------------------------------------------------


def entropy_secrets() -> str:
    """Entropy is computed here for every window by itself."""
    sums = [e.surprise(c) for c in range(e.WINDOW + 1)]

    def found(name: str, pattern: str) -> str:
        p = quoted(pattern)
        return f"""{name}_list AS (
  SELECT row, regexp_extract_all(t, {p}) AS found, regexp_split_to_array(t, {p}) AS pieces FROM texts WHERE regexp_matches(t, {p})),
{name}_each AS (
  SELECT row, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS m, unnest(list_transform(pieces[:len(found)], lambda x: length(x))) AS gap
  FROM {name}_list),
{name}_found AS (
  SELECT row, m, before + gap AS start, before + gap + length(m) AS stop FROM (
    SELECT row, m, gap, coalesce(sum(gap + length(m)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM {name}_each))"""

    parts = [found(name, pattern) for name, pattern, _, _ in e.KINDS] + [found("candidate", e.CANDIDATE)]
    base = " UNION ALL ".join(
        f"SELECT row, start, {rank} AS rank, stop, '{name}' AS kind FROM {name}_found WHERE length(regexp_extract(m, {quoted(pattern)}, {group})) >= {least}"
        for rank, (name, pattern, group, least) in enumerate(e.KINDS)
    )
    limits = f"CASE {' '.join(f'WHEN regexp_matches(m, {quoted(p)}) THEN {e.most_sum(bits)}' for p, bits in e.CLASSES)} END"
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{k[0]}'), 0) AS n_{k[0]}" for k in e.KINDS)
    spans = "coalesce(string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank, stop), '')"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(parts)},
base AS ({base}),
windows AS (
  SELECT row, start, m, w, {limits} AS most, substr(m, w + 1, {e.WINDOW}) AS part
  FROM (SELECT row, start, m, unnest(range(0, length(m) - {e.WINDOW} + 1)) AS w FROM candidate_found WHERE NOT regexp_matches(m, {quoted(e.UUID)}))),
scored AS (
  SELECT row, start, w, most, part, sum(({sums!r})[n + 1]) AS s FROM (
    SELECT row, start, w, most, part, c, count(*) AS n FROM (SELECT row, start, w, most, part, unnest(string_split(part, '')) AS c FROM windows)
    GROUP BY row, start, w, most, part, c) GROUP BY row, start, w, most, part),
high AS (
  SELECT row, start + min(w) AS start, start + max(w) + {e.WINDOW} AS stop
  FROM scored WHERE s <= most AND NOT regexp_matches(part, {quoted(e.SAMPLE)}) GROUP BY row, scored.start),
-- What remains begins with the span or where a base span ends, outside of all of them, up to the next one.
begins AS (
  SELECT row, start, stop, start AS place FROM high UNION
  SELECT high.row, high.start, high.stop, base.stop FROM high JOIN base ON base.row = high.row AND base.stop > high.start AND base.stop < high.stop),
free AS (
  SELECT * FROM begins WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.row = begins.row AND base.start <= begins.place AND begins.place < base.stop)),
rests AS (
  SELECT free.row, place, least(free.stop, coalesce(min(base.start), free.stop)) AS stop
  FROM free LEFT JOIN base ON base.row = free.row AND base.start > free.place GROUP BY free.row, free.start, free.stop, place),
added AS (
  SELECT row, place AS start, {len(e.KINDS)} AS rank, stop, '{e.ENTROPY}' AS kind FROM rests JOIN texts USING (row)
  WHERE stop - place >= {e.REST} AND NOT regexp_matches(substr(t, place + 1, stop - place), {quoted(e.NAMES)})),
of_base AS (SELECT row, {counts}, {spans} AS text FROM base GROUP BY row),
of_all AS (SELECT row, {spans} AS text FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(of_base.text, '')) AS base_sha256, coalesce(of_all.text, '') AS spans
FROM texts LEFT JOIN of_base USING (row) LEFT JOIN of_all USING (row)"""
