"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree; DataFrame functions only.

A hash deals each source's documents into ``BLOCKS`` blocks.  A source's target is met by
whole passes over its blocks, then by blocks in a permuted order, and the block at the edge
is cut: into cells by a second hash, then document by document, and the last document by
words.  So a source takes its target to the word, and no document more than the ceiling.

The numbers of block copies, one quota a source, are split among output shards by a tree:
each node halves its places and draws every source's share of the left half from the exact
hypergeometric distribution, one source after the other.  A shard then takes the next
blocks of each source's permuted list, disjoint from all others, and orders its rows by a hash.

Tables of sources, blocks and shards do not grow with the documents.  Documents are never
shuffled; those of the one cut cell of a source are ranked in a window of 1 / 2**20 of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintlake.functions.text import let_sql

from .decontamination import small
from .frames import text_hash, written

WEIGHTS = (5, 2, 1)
CEILING = 3
BLOCKS = 1024
DEPTH = 6  # levels of the tree: 64 shards
SEED = 20240131
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its parts."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, share: float = 1.0) -> DataFrame:
    """(source, source_size, sid, weight, target) from (source, source_size): one row a source.

    Sources by code point, null last, weigh 5, 2, 1, repeating, and share ``share`` of all
    words.  No target exceeds CEILING times its source: in the order of ceiling by weight, a
    source is full if its part of what those before it leave reaches its ceiling.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("sid", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int")))
    ranked = ranked.withColumn("room", CEILING * F.col("source_size"))
    by_room = Window.orderBy(F.col("room") / F.col("weight"), "sid")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    rate = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("room").over(before), F.lit(0))) / F.sum("weight").over(after)
    filled = ranked.withColumn("rate", rate).withColumn("full", F.col("room") <= F.col("rate") * F.col("weight"))
    # The first source that is not full stands where all full ones have been taken off.
    level = F.min_by(F.when(~F.col("full"), F.col("rate")), F.when(~F.col("full"), F.struct(F.col("room") / F.col("weight"), "sid"))).over(everything)
    target = F.when(F.col("full"), F.col("room").cast("double")).otherwise(level * F.col("weight"))
    return filled.select("source", "source_size", "sid", "weight", target.alias("target"))


def draw_sql(population: str, marked: str, draws: str, unit: str) -> str:
    """SQL text: how many of ``draws`` from ``population`` are ``marked``: the inverse distribution at ``unit``.

    Weights run from 12 standard deviations below the mean to 12 above; what lies beyond is
    less than a double can tell from 0.  One expression, in which every step is named and computed
    once: as columns of a DataFrame the steps would be copied into each other's lambdas.
    """
    up, down = "((p.k - x) * (p.m - x))", "((x + 1) * (p.n - p.k - p.m + x + 1))"
    onward = f"IF({up} > 0 AND {down} > 0, s.log + ln({up} / {down}), double('-infinity'))"  # the weight of x + 1 from that of x, as logarithms
    weight = "exp(s.log - top)"
    top = (
        "aggregate(steps, named_struct('log', 0D, 'out', double('-infinity')), "
        f"(s, x) -> named_struct('log', {onward}, 'out', greatest(s.out, s.log)), s -> s.out)"
    )
    goal = (
        "aggregate(steps, named_struct('log', 0D, 'out', 0D), "
        f"(s, x) -> named_struct('log', {onward}, 'out', s.out + {weight}), s -> s.out) * u"
    )
    found = (
        "aggregate(steps, named_struct('log', 0D, 'out', 0D, 'at', steps[0]), "
        f"(s, x) -> named_struct('log', {onward}, 'out', s.out + {weight}, 'at', IF(s.out <= goal, x, s.at)), s -> s.at)"
    )
    mean = "IF(p.n > 0, p.m * p.k / p.n, 0D)"
    spread = "sqrt(greatest(mean * IF(p.n > 1, (1 - p.k / p.n) * (p.n - p.m) / (p.n - 1), 0D), 0D))"
    low = "bigint(greatest(0D, p.m - (p.n - p.k), double(floor(mean - 12 * spread - 12))))"
    high = "bigint(least(p.k, p.m, double(ceil(mean + 12 * spread + 12))))"
    given = f"named_struct('n', double({population}), 'k', double({marked}), 'm', double({draws}))"
    out = found
    for name, value in [("goal", goal), ("top", top), ("steps", f"sequence({low}, greatest({low}, {high}))"), ("spread", spread), ("mean", mean), ("u", unit), ("p", given)]:
        out = let_sql(value, name, out)
    return out


def hypergeometric(rows: DataFrame, out: str) -> DataFrame:
    """Adds a draw from (population, marked, draws, unit); see :func:`draw_sql`."""
    return rows.withColumn(out, F.expr(draw_sql("population", "marked", "draws", "unit")))


def shard_quotas(quotas: DataFrame, depth: int) -> DataFrame:
    """(shard, sid, quota) from (sid, quota): block copies of each source for each of 2**depth shards.

    A node gives half its copies to its left child.  How many of each source is drawn by
    halving the list of sources again and again: a half's share of the draws is
    hypergeometric, given what the list as a whole has to give.
    """
    named = quotas.select(F.struct("sid", F.col("quota").cast("long").alias("quota")).alias("x"))
    nodes = named.agg(F.array_sort(F.collect_list("x")).alias("q"))  # one entry a source
    nodes = written(nodes.select(F.lit(0).cast("long").alias("node"), "q"), "nodes")
    n_sources = nodes.select(F.size("q")).first()[0]
    if not n_sources:
        return quotas.select(F.lit(0).cast("long").alias("shard"), "sid", F.col("quota").cast("long").alias("quota"))
    sums = "aggregate(q, array(0L), (s, x) -> array_append(s, element_at(s, -1) + x.quota))"
    for level in range(depth):
        whole = F.expr(let_sql(sums, "s", "named_struct('upto', s, 'lo', 0, 'hi', size(q), 'draws', element_at(s, -1) div 2)"))
        groups = nodes.select("node", "q", whole.alias("g")).select("node", "q", "g.*")
        # A source's share of the draws, half of the list by half.
        unit = f"pmod(xxhash64({SEED}, {level}, node, lo, hi), {1 << 53}L) / {float(1 << 53)!r}D"
        x = draw_sql("upto[hi] - upto[lo]", "upto[mid] - upto[lo]", "draws", unit)
        part = "named_struct('lo', {}, 'hi', {}, 'draws', {})"
        two = let_sql(x, "x", f"array({part.format('lo', 'mid', 'x')}, {part.format('mid', 'hi', 'draws - x')})")
        halves = F.expr(f"IF(hi - lo > 1, {let_sql('int((lo + hi) div 2)', 'mid', two)}, array({part.format('lo', 'hi', 'draws')}))")
        for _ in range(max(n_sources - 1, 0).bit_length()):
            groups = groups.select("node", "q", "upto", F.inline(halves))
        left = groups.select("node", F.element_at("q", F.col("hi")).alias("x"), "draws")
        both = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("draws").alias("quota")),
            F.struct((2 * F.col("node") + 1).alias("node"), (F.col("x.quota") - F.col("draws")).alias("quota")),
        )
        split = left.select(F.col("x.sid").alias("sid"), F.explode(both).alias("c"))
        nodes = written(split.groupBy("c.node").agg(F.array_sort(F.collect_list(F.struct("sid", "c.quota"))).alias("q")), "nodes")
    return nodes.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("shard", "x.sid", "x.quota")


def _edge(groups: DataFrame, parts: list[str], want: str, order: Column) -> DataFrame:
    """Adds ``taken``: words of each group, taken in a permuted order within ``parts`` until ``want`` is reached."""
    line = Window.partitionBy(*parts).orderBy(order, *[c for c in groups.columns if c in ("block", "cell", "_id", "_h")])
    before = F.sum("words").over(line) - F.col("words")
    return groups.withColumn("taken", F.greatest(F.lit(0), F.least("words", F.col(want) - before)).cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds what a document's place depends on: its key, block and cell."""
    docs = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_h": text_hash(), "size": size_of()})
    spot = F.xxhash64(F.lit(SEED), "_id", "_h")
    return docs.withColumns({"block": F.pmod(spot, F.lit(BLOCKS)).cast("int"), "cell": F.pmod(F.shiftright(spot, 20), F.lit(BLOCKS)).cast("int")})


def assign(rows: DataFrame, slim: DataFrame, share: float = 1.0, depth: int = DEPTH) -> DataFrame:
    """Adds source_size, target, taken and places (pass, shard, words, order) to ``rows``.

    ``rows`` has source, _id, _h, size, block and cell; ``slim`` is the same rows, written.
    """
    sources = written(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), share), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    extra = F.round(F.col("target") - passes * F.col("source_size")).cast("long")
    # An extra of all but a word of the source rounds to one more pass; the ceiling still holds.
    sources = sources.withColumn("passes", passes).withColumn("extra", F.when(passes >= CEILING, 0).otherwise(extra))
    sides = small(sources.select("source", "source_size", "sid", "target", "passes", "extra"), F.coalesce(F.length("source"), F.lit(0)) + 64)

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    sized = slim.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = sized.join(sides, same(sized, sides)).select("sid", "block", "words", "passes", "extra")
    blocks = written(_edge(blocks, ["sid"], "extra", _unit(F.col("sid"), F.col("block"))), "blocks")
    cut = blocks.filter("taken > 0 AND taken < words").select("sid", "block", F.col("taken").alias("want"))
    at_cut = slim.join(sides, slim["source"].eqNullSafe(sides["source"])).select("sid", "block", "cell", "_id", "_h", "size")
    at_cut = written(at_cut.join(small(cut, F.lit(32)), ["sid", "block"]), "cut-blocks")
    cells = _edge(at_cut.groupBy("sid", "block", "cell", "want").agg(F.sum("size").alias("words")), ["sid"], "want", _unit(F.col("sid"), F.col("cell")))
    cells = written(cells.select("sid", "block", "cell", "words", "taken"), "cells")
    last = cells.filter("taken > 0 AND taken < words").select("sid", "block", "cell", F.col("taken").alias("want"))
    docs = at_cut.drop("want").join(small(last, F.lit(40)), ["sid", "block", "cell"])
    docs = docs.groupBy("sid", "_id", "_h", "want").agg(F.sum("size").alias("words"), F.count("*").alias("copies"))
    docs = _edge(docs, ["sid"], "want", _unit(F.col("_id"), F.col("_h"))).select("_id", "_h", F.floor(F.col("taken") / F.col("copies")).alias("doc_taken"))
    docs = written(docs, "cut-cell")

    # One entry for each copy of a block; the permuted list of a source is dealt out to the shards.
    copies = blocks.select("sid", "block", F.explode(F.sequence(F.lit(1), F.col("passes") + 1)).alias("pass"), "passes", "taken")
    copies = copies.filter("pass <= passes OR taken > 0")
    slots = copies.withColumn("slot", F.row_number().over(Window.partitionBy("sid").orderBy(_unit(F.col("sid"), F.col("block"), F.col("pass")), "block", "pass")))
    quotas = shard_quotas(copies.groupBy("sid").agg(F.count("*").alias("quota")), depth)
    upto = F.sum("quota").over(Window.partitionBy("sid").orderBy("shard"))
    quotas = quotas.withColumn("upto", upto).filter("quota > 0")
    dealt = quotas.withColumn("slot", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))))
    placed = slots.join(dealt.select("sid", F.col("slot").cast("int").alias("slot"), "shard"), ["sid", "slot"])
    shards = placed.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("shards"))
    blocks = written(blocks.select("sid", "block", "words", "taken").join(shards, ["sid", "block"], "left"), "placed")
    block_size = 48 + 16 * F.coalesce(F.size("shards"), F.lit(0))

    out = rows.join(sides, rows["source"].eqNullSafe(sides["source"]), "left").drop(sides["source"])
    out = out.join(small(blocks.select("sid", "block", F.col("words").alias("block_words"), F.col("taken").alias("block_taken"), "shards"), block_size), ["sid", "block"], "left")
    out = out.join(small(cells.select("sid", "block", "cell", F.col("words").alias("cell_words"), F.col("taken").alias("cell_taken")), F.lit(48)), ["sid", "block", "cell"], "left")
    out = out.join(small(docs, F.lit(32)), ["_id", "_h"], "left")
    whole = lambda taken, words: F.col(taken) >= F.col(words)
    more = (
        F.when(F.coalesce(F.col("block_taken"), F.lit(0)) == 0, 0)
        .when(whole("block_taken", "block_words"), F.col("size"))
        .when(F.coalesce(F.col("cell_taken"), F.lit(0)) == 0, 0)
        .when(whole("cell_taken", "cell_words"), F.col("size"))
        .otherwise(F.coalesce("doc_taken", F.lit(0)))
        .cast("long")
    )
    out = out.withColumn("_more", more)
    words = lambda s: F.when(s["pass"] <= F.col("passes"), F.col("size")).otherwise(F.col("_more"))
    each = F.transform(
        F.coalesce("shards", F.array().cast("array<struct<pass:int,shard:bigint>>")),
        lambda s: F.struct(
            s["pass"].alias("pass"), s["shard"].alias("shard"), words(s).alias("words"),
            F.xxhash64(F.lit(SEED), s["shard"], s["pass"], F.col("_id"), F.col("_h")).alias("order"),
        ),
    )
    out = out.withColumn("places", F.filter(each, lambda p: p["words"] > 0))
    return out.withColumn("taken", F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + p["words"]))


def mix(docs: DataFrame, share: float = 1.0, depth: int = DEPTH) -> DataFrame:
    """(doc_id, size, source_size, target, taken, places) per row of ``docs`` (doc_id, source, text).

    size: words of the text, null 0.  taken: words the mix takes, repeats counted, at most
    CEILING times size; a source's sum is its target, but for a word, and for what equal rows
    at the cut share unevenly.  places: one entry a copy, with its pass, shard, words and
    order in the shard.  A null source is a source; sources without words take none.  Equal
    rows share their fate; reruns agree.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")).drop("text")
    slim = written(rows, "sizes")
    return assign(slim, slim, share, depth).select("doc_id", "size", "source_size", "target", "taken", "places")


def mix_rows(docs: DataFrame, share: float = 1.0, depth: int = DEPTH) -> DataFrame:
    """``docs`` as mixed: each row with taken > 0, and size, source_size, target, taken and places.

    Columns of those names in ``docs`` are replaced.
    """
    rows = keyed(docs.select(F.struct("*").alias("row"), "doc_id", "source", "text"))
    slim = written(rows.select("source", "_id", "_h", "size", "block", "cell"), "sizes")
    out = assign(rows.drop("text", "doc_id"), slim, share, depth).filter("taken > 0")
    own = ["size", "source_size", "target", "taken", "places"]
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in own], *own)


def shard_rows(mixed: DataFrame) -> DataFrame:
    """One row a copy of a document, dealt to its shard and ordered at random in it; ``mixed`` is from mix_rows."""
    each = mixed.withColumn("place", F.explode("places")).drop("places")
    return each.repartition("place.shard").sortWithinPartitions("place.shard", "place.order")
