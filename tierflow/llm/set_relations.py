"""N-gram Jaccard join with set-relation skipping.

Two documents are linked when the sets of their five-word shingles have a Jaccard similarity of
75 percent or more. The join finds all links that components need, exactly:

1. Equal sets are merged; one of them stands for all.
2. Every shingle's number of sets is counted over all documents (merged per block first). A set's
   shingles are put in order, rare ones first, and linked sets must share one of the first quarter.
   Shingles that no other set has link nothing and are not indexed at all.
3. All sets of an index list meet in the group of the list's least set, its leader. Groups are cut
   into parts of bounded size. Within a part, index lists are ordered by set size, and a query skips
   to the positions of sizes that can still match.
4. The leader's answers come first. Sets linked to it are in its component, so their links to each
   other add nothing and are skipped. Each other set is a query; if the query before it was highly
   similar, its answers are derived from that one's counts by the shingles in which they differ.
   Where a group has several parts, the sets that its leader does not reach meet every part.
5. Where links are counted (an option), nothing is skipped for being connected already: every set of a group is a query.
   A pair of sets that meets in several groups counts in that of the least leader they share, so a
   query leaves out the positions that share a lesser one with it, and a part whose sets all share one
   is left out as a whole. Parts of a group meet in pairs. A task gives a sum per set, no pairs.

Components of the links come from alternating stars. Only documents with a shared shingle among
their rare ones are moved after the count; no pairs of a group are written out.

NULL and empty texts have no shingles and are linked with nothing. Repeated rows are equal sets.
A table without rows gives none. Only `doc_id` and `text` are read by `set_relations`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm import blocks as b
from tierflow.llm.components import components
from tierflow.session import materialize

SHINGLE = 5
# Sets of a part of a group, and shingles of the groups that one call handles.
PART_SETS = 4096
CALL_SHINGLES = 2 << 20
# A document's row number: its block and its place there.
PLACE_BITS = 20

DOC_SCHEMA = "rid long, doc_id long, n long, set_id binary"
SET_SCHEMA = "rid long, n long, shingles binary, prefix array<bigint>"
LINK_SCHEMA = "kind int, a long, b long"


def needed(n: int) -> int:
    """Shingles that a set of n shares with any set linked to it, at least."""
    return (3 * n + 3) // 4


def linked(common, n_a, n_b):
    """Whether 100 * common >= 75 * union, in whole numbers."""
    return 7 * common >= 3 * (n_a + n_b)


def shingle_sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of a block's documents in order, and the first of each document."""
    text = b.Text.of(table["text"])
    words = b.Words.of(text)
    hashes = b.word_hashes(text, words, lower=True)
    sizes = np.diff(words.first)
    at = np.flatnonzero(b.within(words.first, len(words), SHINGLE))
    document = words.document()[at]
    values = b.window_hashes(hashes, SHINGLE)[at]
    # A text of fewer words is one shingle, told apart from longer ones by its length.
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        prefix = b.sums(hashes)
        whole = b.span_hashes(prefix, words.first[short], words.first[short + 1]) + b.mixed(sizes[short].astype(b.U))
        document, values = np.append(document, short), np.append(values, b.mixed(whole))
    order = np.lexsort((values, document))
    document, values = document[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (document[1:] != document[:-1])
    return values[new], np.searchsorted(document[new], np.arange(len(sizes) + 1))


def set_rows(block: int, table: pa.Table) -> pa.RecordBatch:
    values, first = shingle_sets(table)
    n = np.diff(first)
    ids = [hashlib.blake2b(values[i:j].tobytes(), digest_size=16).digest() for i, j in zip(first[:-1], first[1:], strict=True)]
    return pa.record_batch(
        {
            "rid": pa.array((block << PLACE_BITS) + np.arange(len(n)), pa.int64()),
            "doc_id": table["doc_id"].cast(pa.int64()).combine_chunks(),
            "n": pa.array(n, pa.int64()),
            "set_id": pa.array(ids, pa.binary()),
        }
    )


def chosen(first: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the documents that stand for their set, and the shingles that are theirs."""
    place = np.sort(np.asarray(answers["place"].drop_null(), np.int64))
    size = np.diff(first)[place]
    at = np.repeat(first[place], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return place, at


def indexed_sets(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Sets that share a shingle of their rare quarter with another set: (rid, n, shingles, prefix).

    `shingles` are those that other sets have as well.
    """
    n_bytes = b.total_bytes(blocks)
    buckets = b.buckets_for(n_bytes / 6, 2 * b.KEYS_PER_BUCKET)
    standing = docs.where("n > 0").groupBy("set_id").agg(F.min("rid").alias("rid"))
    place = F.col("rid").bitwiseAND((1 << PLACE_BITS) - 1)
    places = standing.select(F.shiftright("rid", PLACE_BITS).alias("block"), place.alias("place"))
    places = materialize(places, "standing-sets")

    def count(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        values, first = shingle_sets(table)
        keys = b.Keys.of(b.shortened(values[chosen(first, answers)[1]], n_bytes))
        return pa.Table.from_batches([keys.rows(block, buckets)])

    def index(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        values, first = shingle_sets(table)
        place, at = chosen(first, answers)
        keys = b.Keys.of(b.shortened(values[at], n_bytes))
        mark = keys.marked(answers.filter(pa.compute.is_valid(answers["bucket"])))[keys.occurrence]
        values = values[at]
        edges = np.append(0, np.cumsum(np.diff(first)[place]))
        rids, sizes, shingles, prefixes = [], [], [], []
        for k, p in enumerate(place.tolist()):
            own, common = values[edges[k] : edges[k + 1]], mark[edges[k] : edges[k + 1]]
            n = len(own)
            quarter = n - needed(n) + 1
            # Too few shared shingles for any link: the rare quarter holds none of them.
            shared = common > 1
            if n - int(shared.sum()) >= quarter:
                continue
            rare = np.lexsort((own, common))[:quarter]
            rids.append((block << PLACE_BITS) + p)
            sizes.append(n)
            shingles.append(own[shared].tobytes())
            prefixes.append(own[rare[shared[rare]]].view(np.int64))
        return pa.table(
            {
                "rid": pa.array(rids, pa.int64()),
                "n": pa.array(sizes, pa.int64()),
                "shingles": pa.array(shingles, pa.binary()),
                "prefix": pa.array(prefixes, pa.list_(pa.int64())),
            }
        )

    marks = b.count_keys(b.with_answers(blocks, places, count, b.KEYS_SCHEMA))
    none = F.lit(None)
    answers = marks.withColumn("place", none.cast("long")).unionByName(
        places.select("block", none.cast("int").alias("bucket"), none.cast("binary").alias("marks"), "place")
    )
    return materialize(b.with_answers(blocks, answers, index, SET_SCHEMA), "indexed-sets")


class Group:
    """The sets of a part of a group, ordered by size, with their index lists."""

    def __init__(
        self,
        rids: np.ndarray,
        sizes: np.ndarray,
        sets: list[np.ndarray],
        copies: np.ndarray | None = None,
        lower: list[np.ndarray] | None = None,
    ):
        order = np.lexsort((rids, sizes))
        if copies is not None and lower is not None:
            self.copies, self.lower = copies[order], [lower[i] for i in order.tolist()]
            self.leaders, names = np.unique(np.concatenate(self.lower), return_inverse=True)
            at = np.repeat(np.arange(len(order)), np.fromiter(map(len, self.lower), np.int64, len(order)))
            order_of_leaders = np.argsort(names, kind="stable")
            self.held_by = at[order_of_leaders]
            self.held_from = np.searchsorted(names[order_of_leaders], np.arange(len(self.leaders) + 1))
        self.rids, self.sizes = rids[order], sizes[order]
        sets = [sets[i] for i in order.tolist()]
        self.m = len(sets)
        self.tokens, names = np.unique(np.concatenate(sets), return_inverse=True)
        lengths = np.fromiter(map(len, sets), np.int64, self.m)
        edges = np.append(0, np.cumsum(lengths))
        self.names = [names[edges[i] : edges[i + 1]] for i in range(self.m)]
        # All index lists in one: by shingle, then by position, which is the order of sizes.
        self.lists = np.sort(names * self.m + np.repeat(np.arange(self.m), lengths))
        self.before: tuple | None = None

    def named(self, shingles: np.ndarray) -> np.ndarray:
        """The known ones of some shingles."""
        at = np.searchsorted(self.tokens, shingles)
        at[at == len(self.tokens)] = 0
        return at[self.tokens[at] == shingles]

    def reach(self, size: int) -> tuple[int, int]:
        """Positions of the sets whose size lets them be linked to a set of some size."""
        low = int(np.searchsorted(self.sizes, needed(size), "left"))
        return low, int(np.searchsorted(self.sizes, 4 * size // 3, "right"))

    def met(self) -> bool:
        """Whether all sets share a lesser leader, so that all pairs meet in its group."""
        return bool((np.diff(self.held_from) == self.m).any())

    def counted(self, names: np.ndarray, size: int, lower: np.ndarray) -> np.ndarray:
        """Positions of the sets linked to a query that share no lesser leader with it.

        Leaders that most sets hold are looked at first: sets that are linked share most leaders, so
        few steps leave nothing where another group counts, and lists are short where this one does.
        """
        low, high = self.reach(size)
        known = np.empty(0, np.int64)
        if len(self.leaders) and len(lower):
            at = np.minimum(np.searchsorted(self.leaders, lower), len(self.leaders) - 1)
            known = at[self.leaders[at] == lower]
            known = known[np.argsort(self.held_from[known] - self.held_from[known + 1], kind="stable")]
        apart = np.ones(self.m, bool)
        found, step = None, 4
        while len(known):
            begin, times = self.held_from[known[:step]], self.held_from[known[:step] + 1] - self.held_from[known[:step]]
            at = np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            apart[self.held_by[at]] = False
            known, step = known[step:], 2 * step
            if found is None:
                if not apart[low:high].any():
                    return np.empty(0, np.int64)
                found = self.answers(names, size)
            found = found[apart[found]]
            if not len(found):
                return found
        return self.answers(names, size) if found is None else found

    def histogram(self, names: np.ndarray, low: int, high: int) -> np.ndarray:
        """For the positions from low to high: how many of the shingles each set holds."""
        begin = np.searchsorted(self.lists, names * self.m + low)
        end = np.searchsorted(self.lists, names * self.m + high)
        times = end - begin
        at = np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.bincount(self.lists[at] % self.m - low, minlength=high - low)

    def answers(self, names: np.ndarray, size: int) -> np.ndarray:
        """Positions of the sets linked to a query."""
        low, high = self.reach(size)
        if low >= high:
            return np.empty(0, np.int64)
        counts = None
        if self.before is not None:
            old, old_low, old_high, old_counts = self.before
            if old_low <= low and high <= old_high:
                gone, come = np.setdiff1d(old, names, True), np.setdiff1d(names, old, True)
                if 2 * (len(gone) + len(come)) < len(names):
                    counts = old_counts[low - old_low : high - old_low].copy()
                    counts -= self.histogram(gone, low, high)
                    counts += self.histogram(come, low, high)
        if counts is None:
            counts = self.histogram(names, low, high)
        self.before = names, low, high, counts
        return low + np.flatnonzero(linked(counts, size, self.sizes[low:high]))


def relate(leader: int, rids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray]) -> tuple[list, list[int]]:
    """Links that connect what is linked within a part, and the sets not connected to the leader."""
    group = Group(rids, sizes, sets)
    parent = list(range(group.m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    top = int(np.flatnonzero(group.rids == leader)[0])
    links = []
    for i in [top, *(i for i in range(group.m) if i != top)]:
        if i != top and root(i) == root(top):
            continue
        for j in group.answers(group.names[i], int(group.sizes[i])).tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[x] = y
                links.append((int(group.rids[i]), int(group.rids[j])))
    return links, [int(group.rids[i]) for i in range(group.m) if root(i) != root(top)]


class Labels:
    """Classes of numbered sets, merged by links; gives the links that merge something."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> list[int]:
        """The first of `others` of each class that i is not in yet, which is in i's class from now on."""
        other = others[self.of[others] != self.of[i]]
        labels, first = np.unique(self.of[other], return_index=True)
        if len(labels):
            self.of[np.isin(self.of, labels)] = self.of[i]
        return other[first].tolist()


def count_part(group: Group) -> list[tuple[int, int, int]]:
    """All links within a part: those that connect (kind 0), and each set's number, copies included (2)."""
    out = []
    if group.met():
        return out
    labels = Labels(group.m)
    for i in range(group.m):
        found = group.counted(group.names[i], int(group.sizes[i]), group.lower[i])
        found = found[found != i]
        if len(found):
            out += [(0, int(group.rids[i]), int(group.rids[j])) for j in labels.join(i, found)]
            out.append((2, int(group.rids[i]), int(group.copies[found].sum())))
    return out


def counting_sets(table: pa.Table) -> tuple:
    """What a group that counts is made of."""
    lists = table["lower"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    ends = np.cumsum(np.asarray(lists.value_lengths(), np.int64))
    lower = np.split(np.asarray(lists.flatten(), np.int64), ends[:-1])
    return *sets_of(table), np.asarray(table["copies"], np.int64), lower


def count_parts(table: pa.Table) -> pa.Table:
    """All parts of one call, as `count_part` has them."""
    rids, sizes, sets, copies, lower = counting_sets(table)
    leader, part = np.asarray(table["leader"], np.int64), np.asarray(table["part"], np.int64)
    order = np.lexsort((part, leader))
    new = np.flatnonzero(np.append(True, (np.diff(leader[order]) != 0) | (np.diff(part[order]) != 0)))
    out = []
    for mine in np.split(order, new[1:]):
        at = mine.tolist()
        out += count_part(Group(rids[mine], sizes[mine], [sets[i] for i in at], copies[mine], [lower[i] for i in at]))
    return link_table(out)


def count_across(members: pa.Table, queries: pa.Table) -> pa.Table:
    """All links between two parts of a group, as `count_part` has them."""
    if not members.num_rows or not queries.num_rows:
        return link_table([])
    group = Group(*counting_sets(members))
    labels = Labels(group.m + queries.num_rows)
    numbers = np.zeros(group.m, np.int64)
    out = []
    for k, (rid, size, shingles, copies, lower) in enumerate(zip(*counting_sets(queries), strict=True)):
        found = group.counted(group.named(shingles), int(size), lower)
        if len(found):
            out += [(0, int(rid), int(group.rids[j])) for j in labels.join(group.m + k, found)]
            out.append((2, int(rid), int(group.copies[found].sum())))
            numbers[found] += copies
    return link_table(out + [(2, int(group.rids[j]), int(numbers[j])) for j in np.flatnonzero(numbers).tolist()])


def sets_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    sets = [np.frombuffer(x, b.U) for x in table["shingles"].to_pylist()]
    return np.asarray(table["rid"], np.int64), np.asarray(table["n"], np.int64), sets


def link_table(rows: list[tuple[int, int, int]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.table({"kind": pa.array(columns[0], pa.int32()), "a": pa.array(columns[1], pa.int64()), "b": pa.array(columns[2], pa.int64())})


def relate_parts(table: pa.Table) -> pa.Table:
    """All parts of one call: links (kind 0), and of groups with several parts what the leader does not reach (1)."""
    rids, sizes, sets = sets_of(table)
    leader, part = np.asarray(table["leader"], np.int64), np.asarray(table["part"], np.int64)
    several = np.asarray(table["parts"], np.int64) > 1
    order = np.lexsort((part, leader))
    new = np.flatnonzero(np.append(True, (np.diff(leader[order]) != 0) | (np.diff(part[order]) != 0)))
    out = []
    for mine in np.split(order, new[1:]):
        links, apart = relate(int(leader[mine[0]]), rids[mine], sizes[mine], [sets[i] for i in mine.tolist()])
        out += [(0, x, y) for x, y in links]
        if several[mine[0]]:
            out += [(1, int(leader[mine[0]]), x) for x in apart]
    return link_table(out)


def relate_apart(members: pa.Table, queries: pa.Table) -> pa.Table:
    """Links between some sets that their leader does not reach and one part of the group."""
    if not members.num_rows or not queries.num_rows:
        return link_table([])
    group = Group(*sets_of(members))
    out = []
    for rid, size, shingles in zip(*sets_of(queries), strict=True):
        out += [(0, int(rid), int(group.rids[j])) for j in group.answers(group.named(shingles), int(size)).tolist() if group.rids[j] != rid]
    return link_table(out)


def groups_of(sets: DataFrame, part_sets: int, call_shingles: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups dealt into parts: (leader, rid, n) members, (leader, parts), and places with a leader in every part."""
    postings = sets.select("rid", "n", F.explode("prefix").alias("token"))
    lists = postings.groupBy("token").agg(F.min("rid").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = postings.join(lists.select("token", "leader"), "token").select("leader", "rid", "n").distinct()
    members = materialize(members, "group-members")
    # A part has so many sets and about so many shingles at most, whatever the length of its texts.
    parts = members.groupBy("leader").agg(F.greatest(F.count("*") / part_sets, F.sum("n") / call_shingles).alias("m"))
    parts = parts.select("leader", F.ceil("m").cast("long").alias("parts"))
    placed = members.drop("n").join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    # The leader is in every part of its group.
    lead = parts.where("parts > 1").select("leader", F.col("leader").alias("rid"), "parts", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    placed = placed.unionByName(lead).dropDuplicates(["leader", "rid", "part"])
    return members, parts, placed


def links_of(sets: DataFrame, part_sets: int, call_shingles: int) -> DataFrame:
    """(a, b): links whose components are those of all links."""
    members, parts, placed = groups_of(sets, part_sets, call_shingles)
    members = members.drop("n")
    total = sets.agg(F.coalesce(F.sum(F.octet_length("shingles")), F.lit(0))).first()[0]
    calls = max(1, -(-2 * total // (8 * call_shingles)))
    bodies = sets.select("rid", "n", "shingles")
    full = placed.join(bodies, "rid").withColumn("call", F.pmod(F.xxhash64("leader", "part"), F.lit(calls)))
    found = materialize(full.groupBy("call").applyInArrow(relate_parts, LINK_SCHEMA), "set-links")
    links = found.where("kind = 0").select("a", "b")
    apart = found.where("kind = 1").select(F.col("a").alias("leader"), F.col("b").alias("rid")).distinct()
    if apart.isEmpty():
        return links
    # Large groups: what the leader does not reach meets every part, itself in parts of bounded size.
    n_apart = apart.groupBy("leader").agg(F.count("*").alias("m")).join(parts, "leader")
    # As many rounds as parts bound the queries by the same measure.
    grid = n_apart.select("leader", "parts", F.least(F.col("parts"), F.col("m")).alias("rounds"))
    queries = apart.join(grid, "leader").withColumn("round", F.pmod(F.xxhash64("rid"), F.col("rounds")))
    queries = queries.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).select("leader", "part", "round", "rid")
    against = members.join(grid, "leader").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    against = against.withColumn("round", F.explode(F.expr("sequence(0L, rounds - 1)"))).select("leader", "part", "round", "rid")
    keys = ["leader", "part", "round"]
    names = [*keys, "rid", "n", "shingles"]
    asked = queries.join(bodies, "rid").select(*[F.col(c).alias(c) for c in names])
    pairs = against.join(bodies, "rid").select(*names).groupBy(*keys).cogroup(asked.groupBy(*keys))
    more = pairs.applyInArrow(relate_apart, LINK_SCHEMA)
    return links.unionByName(materialize(more, "set-links").select("a", "b"))


def counted_links(sets: DataFrame, standing: DataFrame, part_sets: int, call_shingles: int) -> DataFrame:
    """Rows of `count_part` for all groups: links (kind 0) whose components are those of all, and numbers (2)."""
    members, parts, placed = groups_of(sets, part_sets, call_shingles)
    # A set stands in as many groups as it has leaders.
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    calls = max(1, -(-2 * total // call_shingles))
    members = members.drop("n")
    leaders = members.groupBy("rid").agg(F.collect_list("leader").alias("leaders"))
    copies = standing.select(F.col("node").alias("rid"), "copies")
    bodies = sets.select("rid", "n", "shingles").join(copies, "rid").join(leaders, "rid")
    lower = F.filter("leaders", lambda x: x < F.col("leader")).alias("lower")
    names = ["rid", "n", "shingles", "copies", lower]
    full = placed.join(bodies, "rid").withColumn("call", F.pmod(F.xxhash64("leader", "part"), F.lit(calls)))
    full = full.select("call", "leader", "part", *names)
    found = materialize(full.groupBy("call").applyInArrow(count_parts, LINK_SCHEMA), "set-links")
    several = parts.where("parts > 1")
    if several.isEmpty():
        return found
    # Each two parts of a large group meet once; the leader has met every part already.
    apart = members.join(several, "leader").where("rid <> leader")
    apart = apart.withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("parts")))
    apart = apart.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).where("mine <> other")
    pair = [F.col("leader"), F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")]
    full = apart.join(bodies, "rid").select(*pair, (F.col("mine") < F.col("other")).alias("first"), *names)
    keys = ["leader", "low", "high"]
    names = [*keys, "rid", "n", "shingles", "copies", "lower"]
    ones = full.where("first").select(*names)
    others = full.where("NOT first").select(*[F.col(c).alias(c) for c in names])
    meet = ones.groupBy(*keys).cogroup(others.groupBy(*keys))
    return found.unionByName(materialize(meet.applyInArrow(count_across, LINK_SCHEMA), "set-links"))


def classes(
    blocks: DataFrame, part_sets: int = PART_SETS, call_shingles: int = CALL_SHINGLES, with_links: bool = False
) -> DataFrame:
    """Per row: rid, doc_id, n_shingles, component_id (the least doc_id of its class), and the class.

    `class` is the row number of the class's root; rows without shingles have none. Least ids do not
    tell classes apart: they may be NULL or repeated. `with_links` adds n_links, the number of other
    rows linked with the row, those with an equal set included.
    """
    docs = materialize(b.each_block(blocks, set_rows, DOC_SCHEMA), "document-sets")
    sets = indexed_sets(blocks, docs)
    standing = docs.where("n > 0").groupBy("set_id")
    standing = standing.agg(F.min("rid").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    if with_links:
        standing = materialize(standing, "standing-copies")
        found = counted_links(sets, standing, part_sets, call_shingles)
        roots = components(found.where("kind = 0").select("a", "b"))
        numbers = found.where("kind = 2").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
        standing = standing.join(numbers, "node", "left")
    else:
        roots = components(links_of(sets, part_sets, call_shingles))
        standing = standing.withColumn("others", F.lit(None).cast("long"))
    named = standing.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "set-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    links = (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links")
    of_set = named.join(least, "root").select("set_id", "component_id", F.col("root").alias("class"), links)
    out = docs.join(of_set, "set_id", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    columns = ["rid", "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "class"]
    n_links = F.when(F.col("n") > 0, F.col("links")).otherwise(0).alias("n_links")
    return out.select(*columns, *([n_links] if with_links else []))


def set_relations(docs: DataFrame, with_links: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles (size of its set) and component_id (least doc_id reachable by links).

    `with_links` adds n_links, the number of other rows that the row is linked with. It asks every set of
    every group, which costs far more than the classes: see the README.
    """
    return classes(b.pack(docs), with_links=with_links).drop("rid", "class")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one of each class: the least doc_id, NULL last. Texts without words all stay.

    Ids only choose who stays: classes without an id, or with one id, are classes of their own.
    """
    columns = [c for c in docs.columns if c != "text"] + ["text"]
    blocks = b.pack(docs, tuple(columns))
    rows = materialize(classes(blocks), "document-classes")
    # Rows without a shingle are alone.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    kept = rows.where("n_shingles > 0").groupBy("class").agg(F.min(order).alias("first")).select("first.rid")
    kept = kept.unionByName(rows.where("n_shingles = 0").select("rid"))
    place = F.col("rid").bitwiseAND((1 << PLACE_BITS) - 1)
    places = kept.select(F.shiftright("rid", PLACE_BITS).alias("block"), place.alias("place"))

    def pick(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        return table.take(pa.array(np.sort(np.asarray(answers["place"], np.int64))))

    schema = docs.select(*columns).schema
    return b.with_answers(blocks, places, pick, schema).select(*docs.columns)
