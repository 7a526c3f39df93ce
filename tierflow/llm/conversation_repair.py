"""Conversation structure repair over a suffix-shared DAWG.

A conversation becomes a word: one letter per turn, for the class of its role (system, user,
assistant, other; by the initial) and its fault (none, blank, duplicate, truncated; the first that
holds). The repair that a word needs depends on the word alone.

All words together form an automaton that shares their ends: a node is what is left of a word, so
words with a common ending go through the same nodes. Words are sorted by their reversed letters,
which puts those that share an ending next to each other; a stack holds the nodes of the last word
from its end on, and only nodes that the next word does not share are computed. At each node stands
for each state of the grammar the cost to go and the first edit of the best audit suffix, which
leads on to the next node and state, so suffixes are shared as well and take constant room.

The grammar is `(s?(ua)+)?` on the initials of the roles. Edits: Keep costs 0, Rerole to user or
assistant 3, Delete 4 (required for blank and duplicate turns), Insert an empty user or assistant
turn 3; truncated turns that are not deleted add 3. Of the cheapest edits the audit that is least in
ASCII counts; the edits possible at a node and state have different letters, so the first decides.

Spark's part: letters are found by column functions and brought into order by a range partitioning
over conversation and turn, which cuts long conversations over tasks; each piece becomes a string,
and a conversation's pieces meet as such, a byte per turn. Different words pass the automaton once,
however many conversations share them, and answers are joined back with hot words dealt out. Texts
move once, sorted by conversation and turn, as a stream behind their audit: nothing is gathered,
though one digest of one conversation's text is work for one task.

NULL `conv_id` is a conversation of its own, a NULL turn comes first, NULL role or text is one
space. Turns with one number are ordered by role and a hash of role and text, repeated rows stand
next to each other. Texts and conversations may have any length. A table without rows gives none.
Only `conv_id`, `turn`, `role` and `text` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierflow.llm.streams import dealt, record_batch, runs, turn_order
from tierflow.llm.words import BLANKS
from tierflow.operators.skew import HOT_ROWS, SMALL_ROWS, lookup_join
from tierflow.session import materialize

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
CLASSES = "suao"  # system, user, assistant, other
FAULTS = ("none", "blank", "duplicate", "truncated")
LETTERS = "abcdefghijklmnop"  # 4 * fault + class
LEGAL = {"su", "ua", "au"}

# States of the grammar: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
WANTED = "uuau"
NEXT = (2, 2, 3, 2)
ROLE = {"u": "user", "a": "assistant"}

Node = tuple[tuple[int, ...], str]
# Of the empty suffix: the costs by state, and the first edits (a blank where nothing is left to do).
END: Node = ((0, 2 * INSERT, INSERT, 0), " II ")

SUMMARY = "code string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
SUMMARIES = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in SUMMARY.split(", ")])


# ---- automaton -------------------------------------------------------------------------------


def moved(letter: int, edit: str, state: int) -> int:
    """The state after an edit."""
    if edit == "D":
        return state
    return 1 if edit == "K" and CLASSES[letter % 4] == "s" and state == 0 else NEXT[state]


def node(letter: int, child: Node) -> Node:
    """Cost to go and first edit by state, where `letter` comes before what `child` stands for."""
    fault, kind = FAULTS[letter // 4], CLASSES[letter % 4]
    costs, _ = child
    options = []
    for state in range(4):
        best = (costs[state] + DELETE, "D")
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            if kind == WANTED[state] or (kind == "s" and state == 0):
                best = min(best, (costs[moved(letter, "K", state)] + more, "K"))
            best = min(best, (costs[NEXT[state]] + REROLE + more, "R"))
        options.append(best)
    # Inserted turns go before this one; more than a user and an assistant turn in a row never pay.
    after_user = min(options[2], (options[3][0] + INSERT, "I"))
    after_assistant = min(options[3], (options[2][0] + INSERT, "I"))
    first = [min(o, (after_user[0] + INSERT, "I")) for o in options[:2]]
    best = [*first, after_user, after_assistant]
    return tuple(cost for cost, _ in best), "".join(edit for _, edit in best)


class Automaton:
    """The nodes of the last word, from its end on; words come in the order of their reversed letters."""

    def __init__(self) -> None:
        self.word = ""  # reversed
        self.nodes: list[Node] = [END]
        self.computed = 0

    def enter(self, word: str) -> None:
        """Take the next reversed word; what it shares with the last one stays."""
        shared = common_prefix(self.word, word)
        del self.nodes[shared + 1 :]
        for c in word[shared:]:
            self.nodes.append(node(LETTERS.index(c), self.nodes[-1]))
        self.computed += len(word) - shared
        self.word = word

    def repair(self) -> tuple[int, str]:
        """Cost and audit of the word."""
        depth, state, audit = len(self.word), 0, []
        while (edit := self.nodes[depth][1][state]) != " ":
            audit.append(edit)
            if edit == "I":
                state = NEXT[state]
            else:
                depth -= 1
                state = moved(LETTERS.index(self.word[depth]), edit, state)
        return self.nodes[-1][0][0], "".join(audit)


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def counted(code: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns, and adjacent roles out of order."""
    times = [code.count(c) for c in LETTERS]
    roles = code.translate({ord(c): CLASSES[i % 4] for i, c in enumerate(LETTERS)})
    # No legal pair overlaps itself.
    legal = sum(roles.count(pair) for pair in LEGAL)
    return sum(times[4:8]), sum(times[8:12]), sum(times[12:]), max(0, len(code) - 1) - legal


def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reversed words in order become rows of SUMMARY."""
    automaton = Automaton()
    for batch in batches:
        out = []
        for word in batch.column(0).to_pylist():
            automaton.enter(word)
            code = word[::-1]
            out.append((code, *counted(code), *automaton.repair()))
        yield record_batch(out, SUMMARIES)


def repairs(words: DataFrame) -> DataFrame:
    """SUMMARY of each different word of a column `code`."""
    different = words.select(F.reverse("code").alias("word")).distinct()
    return different.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(walk, SUMMARY)


# ---- words of conversations ------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text): `conv` is the id as text, a space for NULL; so are NULL roles and texts."""
    space = F.lit(" ")
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), space).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Turns with the faults that a hash of conversation and turn asks for."""
    fault = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def identified(rows: DataFrame) -> DataFrame:
    """Add `same`, the hash of role and text that also orders turns with one number."""
    whole = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("same", F.unhex(F.sha2(F.encode(whole, "UTF-8"), 256)))


ORDER = ["turn", "role", "same"]


def letters(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, same, letter), without texts. Written once, as its borders are looked up first."""
    bare = F.rtrim("text", F.lit(BLANKS))
    blank, cut = F.length(bare) == 0, F.instr(F.lit(".!?"), F.right(bare, F.lit(1))) == 0
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = identified(rows).select("conv", "turn", "role", "same", blank.alias("blank"), cut.alias("cut"), kind.alias("kind"))
    # Equal turns of a conversation meet by their hash, so a long conversation is spread.
    again = F.row_number().over(Window.partitionBy("conv", "same").orderBy(*turn_order(["turn"]))) > 1
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("cut"), 3).otherwise(0)
    letter = F.substring(F.lit(LETTERS), 4 * fault + F.col("kind") + 1, F.lit(1))
    out = narrow.withColumn("again", again).select("conv", "turn", "role", "same", letter.alias("letter"))
    return materialize(out, "turn-letters")


def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted letters become a string for each conversation and batch; `place` orders these."""
    place = TaskContext.get().partitionId() << 32
    for i, batch in enumerate(batches):
        keys, text = batch.column(0), "".join(batch.column(1).to_pylist())
        spans = runs(keys)
        conv = keys.take(pa.array([begin for begin, _ in spans], pa.int64()))
        codes = pa.array([text[begin:end] for begin, end in spans], pa.string())
        yield pa.record_batch([conv, pa.array([place + i] * len(spans), pa.int64()), codes], ["conv", "place", "code"])


def words(rows: DataFrame, all_conversations: DataFrame) -> DataFrame:
    """(conv, gaps, code): a row for each conversation, also where no turn is left. Written once."""
    order = [F.col("conv"), *turn_order(ORDER)]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "letter")
    pieces = ordered.mapInArrow(joined, "conv string, place long, code string")
    spread = rows.select("conv", "turn").distinct().groupBy("conv")
    gaps = spread.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    parts = (
        pieces.select("conv", F.struct("place", "code").alias("piece"), F.lit(None).cast("long").alias("gaps"))
        .unionByName(gaps, allowMissingColumns=True)
        .unionByName(all_conversations.select("conv").distinct(), allowMissingColumns=True)
    )
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["code"]), "")
    out = parts.groupBy("conv").agg(F.coalesce(F.max("gaps"), F.lit(0)).cast("long").alias("gaps"), whole.alias("code"))
    return materialize(out, "conversation-words")


def judged(rows: DataFrame, all_conversations: DataFrame, hot_rows: int = HOT_ROWS, small_rows: int = SMALL_ROWS) -> DataFrame:
    """(conv, gaps) and SUMMARY for each conversation of `all_conversations`; `rows` are its turns."""
    found = words(letters(rows), all_conversations)
    answers = materialize(repairs(found), "word-repairs")
    return lookup_join(found, answers, ["code"], "inner", hot_rows, small_rows=small_rows)


# ---- repaired texts --------------------------------------------------------------------------


def edited(audit: str, role: str, text: str, at: int, state: int) -> tuple[list[tuple[str, str, str]], int, int]:
    """The turns (edit, role, text) that one turn becomes, inserted ones first, and where the audit goes on."""
    out = []
    while True:
        edit, at = audit[at], at + 1
        if edit == "D":
            return out, at, state
        system = edit == "K" and state == 0 and role[:1] == "s"
        new = ROLE[WANTED[state]]
        state = 1 if system else NEXT[state]
        if edit == "I":
            out.append((edit, new, ""))
            continue
        out.append((edit, role if edit == "K" else new, text))
        return out, at, state


def inserted(audit: str, at: int, state: int) -> list[tuple[str, str, str]]:
    """The turns inserted after the last one."""
    out = []
    for edit in audit[at:]:
        out.append((edit, ROLE[WANTED[state]], ""))
        state = NEXT[state]
    return out


def behind_audit(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The turns of each conversation in order, behind a row with its audit."""
    heads = verdicts.select("conv", "audit", F.lit(False).alias("is_turn"))
    both = heads.unionByName(identified(rows).withColumn("is_turn", F.lit(True)), allowMissingColumns=True)
    return dealt(both, "conv", "is_turn", *turn_order(ORDER)).select("conv", "audit", "role", "text")


def followed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[str, str, str]], bool]]:
    """(conv, repaired turns, whether they are its last), turn by turn, from rows of `behind_audit`."""
    conv, audit, at, state = None, "", 0, 0
    for batch in batches:
        for key, head, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if head is not None:
                if conv is not None:
                    yield conv, inserted(audit, at, state), True
                conv, audit, at, state = key, head, 0, 0
            else:
                out, at, state = edited(audit, role, text, at, state)
                yield conv, out, False
    if conv is not None:
        yield conv, inserted(audit, at, state), True


REPAIRED = pa.schema([("conv", pa.string()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
DIGESTS = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
# Characters, and rows, after which a batch is passed on.
BATCH_CHARS, BATCH_ROWS = 4 << 20, 10_000


def flowing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns themselves."""
    rows, size, position = [], 0, 0
    for conv, turns, ended in followed(batches):
        for edit, role, text in turns:
            rows.append((conv, position, edit, role, text))
            position, size = position + 1, size + len(text)
        position = 0 if ended else position
        if size > BATCH_CHARS or len(rows) > BATCH_ROWS:
            yield record_batch(rows, REPAIRED)
            rows, size = [], 0
    yield record_batch(rows, REPAIRED)


def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each repaired conversation: `role:text`, joined by newlines."""
    rows, digest, first = [], hashlib.sha256(), True
    for conv, turns, ended in followed(batches):
        for _, role, text in turns:
            digest.update(f"{role}:{text}".encode() if first else f"\n{role}:{text}".encode())
            first = False
        if ended:
            rows.append((conv, digest.hexdigest()))
            digest, first = hashlib.sha256(), True
        if len(rows) > BATCH_ROWS:
            yield record_batch(rows, DIGESTS)
            rows = []
    yield record_batch(rows, DIGESTS)


def with_id(df: DataFrame) -> DataFrame:
    """`conv_id` again instead of its text."""
    conv_id = F.when(F.col("conv") != " ", F.col("conv").cast("long")).alias("conv_id")
    return df.select(conv_id, *[c for c in df.columns if c != "conv"])


def repaired(conversations: DataFrame, **options) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns of the cheapest repair, without the deleted ones."""
    rows = turns(conversations)
    verdicts = judged(rows, rows, **options)
    return with_id(behind_audit(rows, verdicts).mapInArrow(flowing, "conv string, position long, edit string, role string, text string"))


def suffix_dawg(conversations: DataFrame, **options) -> DataFrame:
    """Damage the conversations; per conversation: conv_id, gaps, counts of faults, cost, audit and repaired_sha256."""
    original = turns(conversations)
    rows = damaged(original)
    verdicts = materialize(judged(rows, original, **options), "conversation-verdicts")
    hashes = behind_audit(rows, verdicts).mapInArrow(digests, "conv string, repaired_sha256 string")
    return with_id(verdicts.join(hashes, "conv")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
