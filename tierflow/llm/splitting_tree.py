"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: the mix holds `share` percent of all words, dealt to the sources by weight; no source
gives more than `most` times its words, and what it cannot give goes to the others by weight.

Drawing: the documents of a source are dealt into blocks by hash, and the blocks stand in a
permuted order. A source gives whole passes over all its blocks and then the first blocks of that
order, up to its target; in the block where the target falls the longest documents that still fit
are taken. Each block of a pass is one unit, so a source has an exact quota of units.

Output shards: a tree splits the quotas of all sources. A node with a number of units deals as many
of them to its left half as its shards there hold, and how many of each source is one draw from the
multivariate hypergeometric distribution, that of a random hand out of an urn: the counts of a
shuffle of all units, found without shuffling them. The leaves get disjoint ranges of each
source's permuted units, and rows within a shard are ordered by hash. `mixed` returns the mix so
dealt and ordered: shard after shard, each in pieces of bounded size.

Only built-in functions run. Texts are read once into narrow rows; the rest works on those and on
tables of blocks and sources. Everything follows from hashes of the rows, so reruns agree.

NULL text has size 0; NULL `source` is a source of its own, the last. Documents of size 0 are
taken as often as their block. Equal rows are drawn alike, each by itself. A table without rows
gives none. Only `doc_id`, `text` and `source` are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.llm.words import aside, back, words
from tierflow.operators.skew import is_small, sent
from tierflow.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 150
MOST = 2
SHARDS = 16
# Documents of a block, about.
BLOCK_ROWS = 1000
# Text of a piece of a shard, about: what one task orders.
PIECE_BYTES = 32 << 20
DIGITS = 15


def hashed(*parts: Column | str) -> Column:
    """60 bits of the MD5 of some values, as a number."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, DIGITS), 16, 10).cast("long")


def size_of(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def row_hash() -> Column:
    """The hash that places a document."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return hashed("row", doc_id, F.md5(F.coalesce(F.col("text"), F.lit(""))))


def narrow(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size, n_bytes, k): k is the hash that places a row. Written once."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        size_of(F.col("text")).alias("size"),
        F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"),
        row_hash().alias("k"),
    )
    return materialize(rows, "mixing-rows")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """Add `number`, `weight` and `target` to a row per source with `source_size`.

    Sources are few: one row each passes through one task here, never a document.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("number", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(cycle, F.col("number") % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * most)
    # Sources in the order in which they reach their cap when all grow by weight.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("total", F.sum("source_size").over(everything))
    level = (F.col("total") * share / F.lit(100.0) - F.col("capped")) / F.col("open_weight")
    s = s.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    # The first level that its own source can meet is the level of all that are not capped.
    final = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("cap") == 0, F.lit(0.0)).otherwise(
        F.least(F.coalesce(final * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    )
    return s.select("source", "number", "weight", "source_size", "n_rows", target.alias("target"))


def block_plan(rows: DataFrame, sources: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their source's number and block, and the blocks with the units they give.

    Per block: `passes` whole passes, `last` (whether the unfinished pass takes it whole) and `room`
    (words that the pass takes of it where the target falls into it).
    """
    lookup = sources.select(
        F.col("source").alias("of"),
        "number",
        F.greatest(F.ceil(F.col("n_rows") / block_rows), F.lit(1)).cast("long").alias("blocks"),
    )
    if is_small(lookup):
        lookup = F.broadcast(lookup)
    dealt = rows.join(lookup, rows.source.eqNullSafe(lookup.of)).select(
        "row", "doc_id", "size", "k", "number", (F.col("k") % F.col("blocks")).alias("block")
    )
    sizes = dealt.groupBy("number", "block").agg(F.sum("size").alias("words"))
    place = Window.partitionBy("number").orderBy(hashed("block", F.col("number"), F.col("block")), "block")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    quota = F.round("target").cast("long")
    wanted = sources.select(
        "number",
        F.when(F.col("source_size") > 0, F.expr("cast(round(target) AS long) div source_size")).otherwise(0).alias("passes"),
        F.when(F.col("source_size") > 0, quota % F.col("source_size")).otherwise(0).alias("rest"),
    )
    begin = sizes.withColumn("begin", F.coalesce(F.sum("words").over(before), F.lit(0)))
    rest, end = F.col("rest"), F.col("begin") + F.col("words")
    blocks = begin.join(wanted, "number").select(
        "number",
        "block",
        F.col("passes").cast("long").alias("passes"),
        (end <= rest).alias("last"),
        F.when((F.col("begin") < rest) & (end > rest), rest - F.col("begin")).alias("room"),
    )
    return dealt, blocks


def fitting(members: Column, room: Column) -> Column:
    """Rows taken into some room: the longest first, each that still fits, at last one that is nearly in.

    `members` holds (size, k, row) of one block, the longest first.
    """
    none = F.array().cast("array<bigint>")
    start = F.struct(room.cast("long").alias("room"), none.alias("rows"), F.lit(None).cast("long").alias("next"), F.lit(0).cast("long").alias("size"))

    def step(s: Column, x: Column) -> Column:
        fits = x["size"] <= s["room"]
        return F.struct(
            F.when(fits, s["room"] - x["size"]).otherwise(s["room"]).alias("room"),
            F.when(fits, F.concat(s["rows"], F.array(x["row"]))).otherwise(s["rows"]).alias("rows"),
            # The shortest that does not fit.
            F.when(fits, s["next"]).otherwise(x["row"]).alias("next"),
            F.when(fits, s["size"]).otherwise(x["size"]).alias("size"),
        )

    def done(s: Column) -> Column:
        near = s["next"].isNotNull() & (2 * s["room"] >= s["size"])
        return F.when(near, F.concat(s["rows"], F.array(s["next"]))).otherwise(s["rows"])

    return F.aggregate(members, start, step, done)


def drawn(urn: Column, hits: Column, draws: Column, seed: Column) -> Column:
    """How many of `draws` balls drawn from an urn are among its `hits`: a hypergeometric draw.

    The law is the same with draws and hits exchanged, so the shorter of both is simulated.
    """
    steps, marked = F.least(hits, draws), F.greatest(hits, draws)
    start = F.struct(urn.alias("urn"), marked.alias("left"), F.lit(0).cast("long").alias("got"))

    def step(s: Column, i: Column) -> Column:
        hit = F.pmod(F.xxhash64(seed, i), s["urn"]) < s["left"]
        one = F.when(hit, F.lit(1)).otherwise(F.lit(0)).cast("long")
        return F.struct((s["urn"] - 1).alias("urn"), (s["left"] - one).alias("left"), (s["got"] + one).alias("got"))

    turns = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(turns, start, step, lambda s: s["got"])


def split(quotas: Column, draws: Column, seed: Column) -> Column:
    """A multivariate hypergeometric draw: how many of each source come among `draws` of all units."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q)
    start = F.struct(
        total.alias("urn"), draws.alias("draws"), F.lit(0).cast("long").alias("i"), F.array().cast("array<bigint>").alias("out")
    )

    def step(s: Column, q: Column) -> Column:
        def state(x: Column) -> Column:
            return F.struct(
                (s["urn"] - q).alias("urn"),
                (s["draws"] - x).alias("draws"),
                (s["i"] + 1).alias("i"),
                F.concat(s["out"], F.array(x)).alias("out"),
            )

        return F.transform(F.array(drawn(s["urn"], q, s["draws"], F.xxhash64(seed, s["i"]))), state)[0]

    return F.aggregate(quotas, start, step, lambda s: s["out"])


def splitting_tree(units: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(number, shard, first, last): the range of each source's units that a shard gets, the last exclusive.

    `units` holds (number, units): the exact quota of each source.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("number", "units"))), lambda x: x["units"].cast("long"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("number", "units"))), lambda x: x["number"])
    nodes = units.agg(names.alias("numbers"), ordered.alias("quotas"))
    nodes = nodes.withColumn("total", F.aggregate("quotas", F.lit(0).cast("long"), lambda s, q: s + q))
    nodes = nodes.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(shards).cast("long"))
    for _ in range(max(0, shards - 1).bit_length()):
        middle = F.expr("(low + high) div 2")
        share = F.expr("(((low + high) div 2) * total) div {0} - (low * total) div {0}".format(shards))
        nodes = nodes.withColumn("left", split(F.col("quotas"), share, F.xxhash64(F.lit(seed), "low", "high")))
        left = F.struct(F.col("low"), middle.alias("high"), F.col("left").alias("quotas"))
        rest = F.zip_with("quotas", "left", lambda q, x: q - x)
        right = F.struct(middle.alias("low"), F.col("high"), rest.alias("quotas"))
        halves = F.when(F.col("high") - F.col("low") > 1, F.array(left, right)).otherwise(
            F.array(F.struct(F.col("low"), F.col("high"), F.col("quotas")))
        )
        nodes = nodes.select("numbers", "total", F.explode(halves).alias("n")).select("numbers", "total", "n.low", "n.high", "n.quotas")
    leaves = nodes.select(F.col("low").cast("int").alias("shard"), F.explode(F.arrays_zip("numbers", "quotas")).alias("q"))
    leaves = leaves.select("shard", F.col("q.numbers").alias("number"), F.col("q.quotas").alias("quota"))
    upto = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.sum("quota").over(upto)
    return leaves.select("number", "shard", (last - F.col("quota")).alias("first"), last.alias("last"))


def unit_shards(blocks: DataFrame, shards: int) -> DataFrame:
    """(number, block, pass, shard): each unit that is given, in the shard that the tree deals it to. Written once."""
    extra = F.when(F.col("last") | F.col("room").isNotNull(), 1).otherwise(0)
    passes = F.explode(F.expr("sequence(0L, passes + CASE WHEN last OR room IS NOT NULL THEN 0L ELSE -1L END)"))
    given = blocks.where(F.col("passes") + extra > 0).select("number", "block", passes.alias("pass"))
    quotas = given.groupBy("number").agg(F.count("*").alias("units"))
    ranges = splitting_tree(quotas, shards).where("last > first")
    places = ranges.select("number", "shard", F.explode(F.expr("sequence(first, last - 1)")).alias("position"))
    permuted = Window.partitionBy("number").orderBy(hashed("unit", F.col("number"), F.col("pass"), F.col("block")), "pass", "block")
    units = given.withColumn("position", (F.row_number().over(permuted) - 1).cast("long"))
    units = units.join(places, ["number", "position"]).select("number", "block", "pass", "shard")
    return materialize(units, "mixing-units")


def place_of(k: Column, turn: Column) -> Column:
    """What orders the rows of a shard."""
    return hashed("place", k, turn)


def draws(
    rows: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: int = SHARE,
    most: int = MOST,
    shards: int = SHARDS,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The mix: (row, pass, shard, place) for each time a row is taken, and the sources with targets.

    `place` orders the rows of a shard.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = materialize(targets(sizes, weights, share, most), "mixing-sources")
    dealt, blocks = block_plan(rows, sources, block_rows)
    blocks = materialize(blocks, "mixing-blocks")
    units = unit_shards(blocks, shards)
    # In the block where a target falls, only the rows that fit.
    open_blocks = blocks.where("room IS NOT NULL").select("number", "block", "room", "passes")
    member = F.struct("size", "k", "row")
    found = dealt.join(F.broadcast(open_blocks) if is_small(open_blocks) else open_blocks, ["number", "block"])
    found = found.groupBy("number", "block", "passes").agg(F.sort_array(F.collect_list(member), asc=False).alias("m"), F.first("room").alias("room"))
    taken = found.select("number", "block", F.col("passes").alias("pass"), F.explode(fitting(F.col("m"), F.col("room"))).alias("row"))
    partial = open_blocks.select("number", "block", F.col("passes").alias("pass"))
    whole = units.join(F.broadcast(partial) if is_small(partial) else partial, ["number", "block", "pass"], "left_anti")
    all_draws = dealt.select("row", "number", "block", "k").join(whole, ["number", "block"]).select("row", "k", "pass", "shard")
    cut = taken.join(units, ["number", "block", "pass"]).select("row", "pass", "shard")
    cut = cut.join(rows.select("row", "k"), "row").select("row", "k", "pass", "shard")
    place = place_of(F.col("k"), F.col("pass"))
    return all_draws.unionByName(cut).select("row", "pass", "shard", place.alias("place")), sources


def splitting_mix(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, size, source_size, target (both of its source) and taken (words in the mix)."""
    rows = narrow(docs)
    taken, sources = draws(rows, **options)
    times = taken.groupBy("row").agg(F.count("*").alias("times"))
    lookup = sources.select(F.col("source").alias("of"), "source_size", "target")
    if is_small(lookup):
        lookup = F.broadcast(lookup)
    out = rows.join(lookup, rows.source.eqNullSafe(lookup.of)).join(times, "row", "left")
    return out.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"),
    )


def given_blocks(blocks: DataFrame, shards: int) -> DataFrame:
    """A row per block that is given: its whole units as (pass, shard), and pass, shard and room where the target falls."""
    partial = blocks.where("room IS NOT NULL").select("number", "block", F.col("passes").alias("pass"), "room")
    units = unit_shards(blocks, shards).join(sent(partial), ["number", "block", "pass"], "left")
    is_open = F.col("room").isNotNull()
    given = units.groupBy("number", "block").agg(
        F.collect_list(F.when(~is_open, F.struct("pass", "shard"))).alias("whole"),
        F.max(F.when(is_open, F.col("pass"))).alias("pass"),
        F.max(F.when(is_open, F.col("shard"))).alias("shard"),
        F.max("room").alias("room"),
    )
    return materialize(given, "mixing-given")


def in_order(rows: DataFrame, shards: int, pieces: int) -> DataFrame:
    """Rows by `shard` and `place`: shard i in the partitions from i * pieces on, each with a range of places."""
    piece = F.shiftright(F.shiftright("place", 30) * F.lit(pieces).cast("long"), 30)
    return rows.repartitionById(shards * pieces, (F.col("shard") * pieces + piece).cast("int")).sortWithinPartitions("shard", "place")


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: int = SHARE,
    most: int = MOST,
    shards: int = SHARDS,
    block_rows: int = BLOCK_ROWS,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """The mix itself: the columns of `docs`, a row for each time that a document is taken, in its output shards.

    The tree deals the units of blocks to the shards, and a document goes where each unit of its block
    goes. So the partitions hold the shards one after another, disjoint, each shuffled by the hash of
    its rows; written, they are its files in that order. The texts move once, into their shard: blocks
    are few and sent to the documents (beyond 100,000 of them both are shuffled by block). Only the
    documents of the blocks where the targets fall are written down to be chosen from. Names of
    `docs` may be any.
    """
    rows = narrow(docs)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = materialize(targets(sizes, weights, share, most), "mixing-sources")
    _, blocks = block_plan(rows, sources, block_rows)
    given = sent(given_blocks(materialize(blocks, "mixing-blocks"), shards))
    n_blocks = F.greatest(F.ceil(F.col("n_rows") / block_rows), F.lit(1)).cast("long").alias("blocks")
    lookup = sent(sources.select("source", "number", n_blocks))
    document = docs.select(
        *aside(docs),
        size_of(F.col("text")).alias("size"),
        F.col("source").cast("string").alias("of"),
        row_hash().alias("k"),
    )
    placed = document.join(lookup, F.col("of").eqNullSafe(lookup.source)).withColumn("block", F.col("k") % F.col("blocks"))
    placed = placed.join(given, ["number", "block"])
    carried = [f"_c{i}" for i in range(len(docs.columns))]
    whole = placed.select(*carried, "k", F.explode("whole").alias("unit")).select(*carried, "k", "unit.pass", "unit.shard")
    chosen = placed.where("room IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    chosen = materialize(chosen.select(*carried, "row", "number", "size", "k", "pass", "shard", "room"), "mixing-open-blocks")
    member = F.struct("size", "k", "row")
    found = chosen.groupBy("number").agg(F.sort_array(F.collect_list(member), asc=False).alias("m"), F.first("room").alias("room"))
    taken = found.select(F.explode(fitting(F.col("m"), F.col("room"))).alias("row"))
    chosen = chosen.join(taken, "row", "left_semi").select(*carried, "k", "pass", "shard")
    taken_rows = whole.unionByName(chosen).select(*carried, "shard", place_of(F.col("k"), F.col("pass")).alias("place"))
    n_bytes = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    pieces = max(1, -(-n_bytes * share // (100 * shards * piece_bytes)))
    out = in_order(taken_rows, shards, pieces)
    return out.select(*back(out, docs.columns))
