"""Mixing sources to target weights with whole documents.

Every source is cut into blocks by a hash of its rows. A source's target words become an exact quota
of block draws: full passes over all its blocks, then blocks in a drawn order up to the target, one
last block chosen to come nearest. A tree splits the quotas among output shards: at each node the
draws of all sources are halved, and how many of each source go left follows the multivariate
hypergeometric law, as if all draws had been shuffled and cut. A leaf thus owns exact numbers per
source, and takes them as the next disjoint stretch of the source's permuted draws.

Everything is DataFrame work. Tables of the plan hold at most ``sources * blocks * passes`` rows
whatever the size of the data; texts move once, to their shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import WORD
from ledgerspark.session import lookup_side, settle

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
PASSES = 2
BLOCKS = 1024
LEVELS = 4
SEED = 20_240


def words(text: str = "text") -> Column:
    """Number of words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column | int | str) -> Column:
    """A number in (0, 1) drawn from a hash of the parts: the same on every run."""
    drawn = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.shiftrightunsigned(drawn, 11).cast("double") + 0.5) / float(1 << 53)


def _block(source: Column, doc_id: str, text: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(source, F.col(doc_id), F.col(text), F.lit(SEED)), F.lit(blocks)).cast("int")


def targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: words to take of each source.

    Sources in order of code points, NULL last, weigh ``weights`` in turn. ``share`` of all words is
    dealt by weight; no target exceeds ``passes`` times its source, and what is cut off is dealt
    again among the others. One row per source passes one task, never a row per document.
    """
    # Order by bytes of UTF-8 is order by code points.
    ranked = sizes.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * passes
    everything = Window.partitionBy()
    # In order of cap per weight, a source is capped if the level that the rest would get is above it.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    open_ = F.col("level") <= F.col("cap") / F.col("weight")
    return (
        ranked.withColumns({"weight": weight, "cap": cap})
        .withColumn("all", F.sum("source_size").over(everything).cast("double") * share)
        .withColumn("level", level)
        .withColumn("final", F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("final").isNull(), F.col("cap")).otherwise(
                F.least(F.col("cap"), F.col("final.level") * F.col("weight"))
            ),
        )
        .select("source", "source_size", "target")
    )


def _log_factorial(n: Column) -> Column:
    """Natural logarithm of n!: a product for small n, Stirling's series with two terms beyond."""
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    small = F.log(F.factorial(F.least(F.greatest(n, F.lit(0)), F.lit(20)).cast("int")).cast("double"))
    return F.when(n <= 20, small).otherwise(series)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` draws out of ``total`` fall on the ``marked`` ones, at quantile ``u``.

    The probability is summed outward from twelve standard deviations below the mean; what lies
    beyond is under 1e-30.
    """
    t, k, n = total.cast("double"), marked.cast("double"), drawn.cast("double")
    mean = n * k / F.greatest(t, F.lit(1.0))
    spread = F.sqrt(mean * (1 - k / F.greatest(t, F.lit(1.0))) * (t - n) / F.greatest(t - 1, F.lit(1.0)))
    low = F.greatest(F.lit(0.0), n + k - t, F.floor(mean - 12 * spread - 12).cast("double")).cast("long")
    high = F.least(n, k, F.ceil(mean + 12 * spread + 12).cast("double")).cast("long")
    choose = lambda a, b: _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)

    def weight(x: Column) -> Column:
        return F.exp(choose(marked, x) + choose(total - marked, drawn - x) - choose(total, drawn))

    def step(state: Column, x: Column) -> Column:
        done = state["p"] >= u
        return F.struct(
            F.when(done, state["p"]).otherwise(state["p"] + weight(x)).alias("p"),
            F.when(done, state["x"]).otherwise(x).alias("x"),
        )

    found = F.aggregate(F.sequence(low, high), F.struct(F.lit(0.0).alias("p"), low.alias("x")), step)
    return found["x"]


def split_tree(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``quotas(source, n)`` dealt out to ``2 ** levels`` shards: ``(shard, source, n, first)``.

    Rows of one level's node are its sources in order; the draws that go left are drawn source by
    source, each conditional on those before, which makes the whole vector multivariate
    hypergeometric. ``first`` counts the draws of that source in the shards before.
    """
    named = quotas.select(F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"), "source", "n")
    vector = F.array_sort(F.collect_list(F.struct("none", "key", "source", "n")))
    nodes = named.agg(vector.alias("have")).select(F.lit(1).cast("long").alias("node"), "have")
    count = lambda have: F.aggregate(have, F.lit(0).cast("long"), lambda s, x: s + x["n"])

    def halved(state: Column, x: Column) -> Column:
        u = uniform(F.lit(SEED), state["node"], x["none"], x["key"])
        left = hypergeometric(state["total"], x["n"], state["open"], u)
        return F.struct(
            state["node"].alias("node"),
            (state["total"] - x["n"]).alias("total"),
            (state["open"] - left).alias("open"),
            F.concat(state["left"], F.array(left)).alias("left"),
        )

    for _ in range(levels):
        begin = F.struct(
            F.col("node").alias("node"),
            count(F.col("have")).alias("total"),
            F.floor(count(F.col("have")) / 2).cast("long").alias("open"),
            F.array().cast("array<bigint>").alias("left"),
        )
        lefts = nodes.withColumn("left", F.aggregate("have", begin, halved)["left"])
        with_n = lambda x, n: F.struct(x["none"].alias("none"), x["key"].alias("key"), x["source"].alias("source"), n.alias("n"))
        sides = F.array(
            F.struct(
                (F.col("node") * 2).alias("node"), F.zip_with("have", "left", lambda x, n: with_n(x, n)).alias("have")
            ),
            F.struct(
                (F.col("node") * 2 + 1).alias("node"),
                F.zip_with("have", "left", lambda x, n: with_n(x, x["n"] - n)).alias("have"),
            ),
        )
        # Written, or each level would draw all levels above again.
        nodes = settle(lefts.select(F.explode(sides).alias("side")).select("side.node", "side.have"))
    shard = (F.col("node") - (1 << levels)).cast("int")
    leaves = nodes.select(shard.alias("shard"), F.explode("have").alias("x")).select("shard", "x.source", "x.n")
    ahead = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")))


def _draws(blocks: DataFrame, goals: DataFrame) -> DataFrame:
    """Block draws of each source: ``(source, block, pass, place)``, ``place`` in permuted order."""
    goal = goals.select(F.col("source").alias("of"), "source_size", "target")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    with_goal = blocks.join(goal, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "block", "words", full.alias("full"), (F.col("target") - full * F.col("source_size")).alias("rest")
    )
    order = uniform(F.lit(SEED + 1), F.col("full"), F.coalesce("source", F.lit("")), F.col("block"))
    by_draw = Window.partitionBy("source").orderBy("order", "block")
    run = by_draw.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("source")
    fits = F.col("sum") <= F.col("rest")
    left = F.col("rest") - F.coalesce(F.max(F.when(fits, F.col("sum"))).over(whole), F.lit(0))
    # The last block: of those not taken, the one that brings the sum nearest, unless none does.
    gain = F.when(~fits & (F.abs(F.col("words") - F.col("left")) < F.col("left")), F.abs(F.col("words") - F.col("left")))
    chosen = F.min(F.struct(F.col("gain").isNull().alias("none"), "gain", "order", "block")).over(whole)
    last = F.col("gain").isNotNull() & (F.col("block") == F.col("chosen.block"))
    partial = (
        with_goal.withColumn("order", order)
        .withColumn("sum", F.sum("words").over(run))
        .withColumn("left", left)
        .withColumn("gain", gain)
        .withColumn("chosen", chosen)
        .withColumn("times", F.col("full") + (fits & (F.col("rest") > 0) | last).cast("int"))
    )
    drawn = partial.where(F.col("times") > 0).select(
        "source", "block", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("pass")
    )
    shuffled = Window.partitionBy("source").orderBy(
        uniform(F.lit(SEED + 2), F.coalesce("source", F.lit("")), F.col("block"), F.col("pass")), "block", "pass"
    )
    return drawn.withColumn("place", F.row_number().over(shuffled).cast("long") - 1)


def assign(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
    blocks: int = BLOCKS,
    levels: int = LEVELS,
) -> DataFrame:
    """All columns of ``docs`` and one struct ``_mix``: size, source_size, target, shards.

    ``shards`` lists the shard of each time the document is taken, at most ``passes`` times; it is
    empty for a document that the mix leaves out. NULL texts have size 0, NULL is a source of its
    own, equal rows are taken equally often, and an empty table gives no rows. Columns of ``docs``
    may have any names but ``_mix`` and those that begin with ``_mix_``.
    """
    own = docs.select(
        F.col(source).cast("string").alias("source"),
        _block(F.col(source), doc_id, text, blocks).alias("block"),
        words(text).alias("words"),
    )
    parts = settle(own.groupBy("source", "block").agg(F.sum("words").alias("words")))
    goals = settle(
        targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, passes)
    )
    draws = settle(_draws(parts, goals))
    leaves = split_tree(draws.groupBy("source").agg(F.count(F.lit(1)).alias("n")), levels)
    places = leaves.where(F.col("n") > 0).select(
        "shard",
        F.col("source").alias("of"),
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"),
    )
    dealt = (
        draws.join(places, F.col("source").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")))
        .groupBy("source", "block")
        .agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    )
    blocks_taken = dealt.select(F.col("source").alias("_mix_source"), F.col("block").alias("_mix_block"), "shards")
    goal = goals.select(F.col("source").alias("_mix_of"), "source_size", "target")
    with_shards = parts.select("source", "block").join(
        blocks_taken,
        F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("block") == F.col("_mix_block")),
        "left",
    )
    table = lookup_side(
        with_shards.join(goal, F.col("source").eqNullSafe(F.col("_mix_of"))).select(
            F.col("source").alias("_mix_source"),
            F.col("block").alias("_mix_block"),
            F.col("source_size").alias("_mix_source_size"),
            F.col("target").alias("_mix_target"),
            F.coalesce("shards", F.array().cast("array<int>")).alias("_mix_shards"),
        )
    )
    marked = docs.withColumns(
        {
            "_mix_own": F.col(source).cast("string"),
            "_mix_own_block": _block(F.col(source), doc_id, text, blocks),
            "_mix_size": words(text),
        }
    )
    return marked.join(
        table,
        F.col("_mix_own").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_own_block") == F.col("_mix_block")),
    ).select(
        *[docs[c] for c in docs.columns],
        F.struct(
            F.col("_mix_size").alias("size"),
            F.col("_mix_source_size").alias("source_size"),
            F.col("_mix_target").alias("target"),
            F.col("_mix_shards").alias("shards"),
        ).alias("_mix"),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed rows, columns as in ``docs``: dealt to their shards and shuffled inside each.

    A document appears as often as the mix takes it. See ``assign`` for options and special cases.
    """
    order = F.xxhash64(F.col(doc_id), F.col(text), F.col("_mix_shard"), F.lit(SEED + 3))
    taken = assign(docs, doc_id, text, source, **options).withColumn("_mix_shard", F.explode("_mix.shards"))
    return (
        taken.withColumn("_mix_order", order)
        .repartition("_mix_shard", F.pmod(F.col("_mix_order"), F.lit(64)))
        .sortWithinPartitions("_mix_shard", "_mix_order")
        .select(*[F.col(c) for c in docs.columns])
    )
