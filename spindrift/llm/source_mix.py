"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame operations only).

1. Every source's documents fall into blocks by a hash of their id; blocks are the unit that is drawn.
2. A source's target is passed through its blocks in a permuted order, whole passes first; the block where
   the target ends is cut at a document, and that document at a word. These draws are its quota.
3. The quotas of all sources are split down a binary tree over output shards: each node hands its left child
   a multivariate hypergeometric draw (source after source, each a univariate draw by inversion from the mode),
   so every shard gets its composition without any shard seeing the whole list.
4. A source's permuted draws go to shards in runs as long as the shards' counts; within a shard rows get a
   hash as their place, which shuffles them locally.

All that is gathered per block is bounded: the number of blocks never exceeds `most_blocks` plus one per
source, whatever the corpus holds, because block size grows with it. Tables of sources and blocks are broadcast only
while they have few rows, which are counted; beyond that the joins shuffle. A node of the tree holds one number a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import ascii_words, fresh, staged

SEED = 17


FEW_ROWS = 200_000


def _few(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def _uniform(*cols) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(SEED), *cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> + weight, target. One row per source; null sorts last and takes part.

    Weights go round the sources by code point. Water filling in one pass: with sources in the order in
    which they reach `most` times their size, the first that the level at its turn doesn't fill fixes the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(total_share))
    # weights from here on are all weights less those before: a frame that only grows is summed once, not for each row anew
    rest = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest
    everything = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    below = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    return (
        sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", level)
        .withColumn("level", F.coalesce(F.first(below, ignorenulls=True).over(everything), F.lit(float("inf"))))
        .withColumn("target", F.when(F.col("cap") > 0, F.least("cap", F.col("level") * F.col("weight"))).otherwise(0.0))
        .select("source", "source_size", "weight", "target")
    )


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once: keeps expressions, and so plans, from growing with each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """Draw of how many of `draws` taken from `total` things are among the `good` ones (longs); u in [0, 1).

    Inversion from the mode outwards: weights follow from the ratio of neighbouring terms, so only about
    ten standard deviations are walked and no factorial is taken.
    """

    def bounds(a):
        return F.struct(
            a["g"].alias("g"), a["t"].alias("t"), a["d"].alias("d"), a["u"].alias("u"),
            F.greatest(F.lit(0).cast("long"), a["d"] - (a["t"] - a["g"])).alias("low"), F.least(a["g"], a["d"]).alias("high"),
            F.floor((a["d"] + 1).cast("double") * (a["g"] + 1) / (a["t"] + 2)).cast("long").alias("peak"),
            (F.sqrt(a["d"].cast("double") * a["g"] / F.greatest(a["t"], F.lit(1)) + 1) * 10 + 10).cast("long").alias("far"),
        )

    def draw(b):
        return _let(F.greatest(b["low"], F.least(b["high"], b["peak"])), lambda mode: _let(_walks(b, mode), lambda w: F.when((b["high"] <= b["low"]) | (w["stop"] < 1), mode).otherwise(
            F.coalesce(_walk(b, mode, 1, w["stop"], F.lit(1.0))["k"], _walk(b, mode, -1, w["stop"], w["above"] + 1)["k"], mode)
        )))

    return _let(F.struct(good.alias("g"), total.alias("t"), draws.alias("d"), u.alias("u")), lambda a: _let(bounds(a), draw))


def _walk(b: Column, mode: Column, sign: int, stop: Column, base: Column) -> Column:
    """Steps from the mode up (1) or down (-1): the sum of weights, and the first value at which it passes `stop`."""
    steps = F.least(b["high"] - mode if sign > 0 else mode - b["low"], b["far"])

    def ratio(k):
        if sign > 0:  # weight(k) / weight(k - 1)
            return (b["g"] - k + 1).cast("double") * (b["d"] - k + 1) / (k.cast("double") * (b["t"] - b["g"] - b["d"] + k))
        return (k + 1).cast("double") * (b["t"] - b["g"] - b["d"] + k + 1) / ((b["g"] - k).cast("double") * (b["d"] - k))

    return F.aggregate(
        F.sequence(F.lit(0).cast("long"), steps),
        F.struct(F.lit(1.0).alias("w"), base.alias("sum"), F.lit(None).cast("long").alias("k")),
        lambda s, i: F.when(i == 0, s).otherwise(_let(s["w"] * ratio(mode + sign * i), lambda w: F.struct(
            w.alias("w"), (s["sum"] + w).alias("sum"), F.coalesce(s["k"], F.when(s["sum"] + w > stop, mode + sign * i)).alias("k")
        ))),
    )


def _walks(b: Column, mode: Column) -> Column:
    never = F.lit(float("inf"))
    above, below = (_walk(b, mode, sign, never, F.lit(0.0))["sum"] for sign in (1, -1))
    return _let(F.struct(above.alias("above"), below.alias("below")), lambda w: F.struct(
        w["above"].alias("above"), (b["u"] * (w["above"] + w["below"] + 1)).alias("stop")
    ))


def split_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """One row (quotas array<struct<s, n>>, sources with draws) -> shard, quotas: a composition for each of `shards` outputs.

    Each level halves a node's range of shards; rows double and are dealt out anew once there are enough. A node holds only the
    sources that it has draws of, so what a level holds is bounded by the number of draws, and a node near the shards is short.
    """
    nodes = quotas.select(F.lit(0).alias("first"), F.lit(shards).alias("n"), F.filter("quotas", lambda q: q["n"] > 0).alias("quotas"))
    for level in range(math.ceil(math.log2(max(shards, 1)))):
        held = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        nodes = nodes.withColumn("half", F.floor(F.col("n") / 2).cast("int")).withColumn("held", held)
        nodes = nodes.withColumn("room", F.floor(F.col("held") * F.col("half").cast("double") / F.col("n")).cast("long"))
        given = F.aggregate(
            "quotas",
            F.struct(F.col("held").alias("total"), F.col("room").alias("draws"), F.array().cast("array<long>").alias("out")),
            lambda s, x: _give(s, x["n"], _uniform(F.col("first"), F.col("n"), x["s"])),
        )["out"]
        nodes = nodes.withColumn("left", F.when(F.col("half") > 0, given))
        some = lambda count: F.filter(F.zip_with("quotas", "left", lambda q, x: F.struct(q["s"].alias("s"), count(q["n"], x).alias("n"))), lambda q: q["n"] > 0)
        both = F.when(
            F.col("half") > 0,
            F.array(
                F.struct("first", F.col("half").alias("n"), some(lambda n, x: x).alias("quotas")),
                F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("n") - F.col("half")).alias("n"), some(lambda n, x: n - x).alias("quotas")),
            ),
        ).otherwise(F.array(F.struct("first", "n", "quotas")))
        nodes = nodes.select(F.explode(both).alias("node")).select("node.*")
        if level % 6 == 5:
            nodes = nodes.repartition("first")
    return nodes.select(F.col("first").alias("shard"), "quotas")


def _give(state: Column, quota: Column, u: Column) -> Column:
    """The next source's share of a node's left child, and what is left to draw from."""
    return _let(hypergeometric(quota, state["total"], state["draws"], u), lambda x: F.struct(
        (state["total"] - quota).alias("total"), (state["draws"] - x).alias("draws"), F.concat(state["out"], F.array(x)).alias("out")
    ))


def plan(docs: DataFrame, weights=(5, 2, 1), total_share=1.5, most=2.0, block_words=50_000, most_blocks=100_000) -> dict[str, DataFrame]:
    """Tables of the mix: `sizes` (doc_id, source, size, block, place), `sources`, `draws` (source, block, pass, part, shard).

    A draw with `part` null takes its block whole; else it takes the block's first `part` words in the order of `place`.
    Null texts have no words, null sources are a source of their own, the last; rows without an id are placed by their
    text; rows that repeat have one place and count each. Texts count whole; an empty table gives empty tables; other
    columns of docs are ignored, whatever their names.
    """
    own = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(SEED), "text")).otherwise(F.xxhash64(F.lit(SEED), "doc_id"))
    sized = staged(docs.select("doc_id", "source", ascii_words(F.col("text")).alias("size"), own.alias("place")), "mix-sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sums, weights, total_share, most).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    per_block = F.greatest(F.lit(float(block_words)), F.col("all") / float(most_blocks))
    sources = staged(
        sources.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_block)).cast("long"))
        .withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .drop("all"),
        "mix-sources",
    )
    small = sources.select(F.col("source").alias("its"), "s", "n_blocks")
    small = F.broadcast(small) if sources.count() <= FEW_ROWS else small
    blocked = sized.join(small, F.col("source").eqNullSafe(F.col("its"))).withColumn(
        "block", F.pmod("place", "n_blocks")
    ).drop("its", "n_blocks")
    blocks = staged(blocked.groupBy("s", "block").agg(F.sum("size").alias("words")), "mix-blocks")

    order = Window.partitionBy("s").orderBy("key", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        blocks.join(sources.select("s", "source_size", "target"), "s")
        .withColumn("words_wanted", F.round("target").cast("long"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("words_wanted") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("words_wanted") - F.col("passes") * F.col("source_size"))
        .withColumn("key", F.xxhash64(F.lit(SEED), "s", "block", F.lit("order")))
        .withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    )
    whole = ranked.filter("passes > 0").select(
        "s", "block", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass"), F.lit(None).cast("long").alias("part")
    )
    last = ranked.filter("before < rest").select(
        "s", "block", (F.col("passes") + 1).alias("pass"),
        F.when(F.col("before") + F.col("words") > F.col("rest"), F.col("rest") - F.col("before")).alias("part"),
    )
    draws = whole.unionByName(last).withColumn("key", F.xxhash64(F.lit(SEED), "s", "block", "pass"))
    return {"sizes": blocked, "sources": sources, "draws": draws}


def shard_draws(plan_: dict[str, DataFrame], shards: int) -> DataFrame:
    """draws + shard: the splitting tree's counts are laid along each source's permuted draws."""
    draws = staged(plan_["draws"].withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy("pass", "key", "block"))), "mix-draws")
    counts = draws.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    quotas = counts.agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("quotas"))
    shares = split_tree(quotas, shards).select("shard", F.explode("quotas").alias("q")).select("shard", F.col("q.s").alias("s0"), F.col("q.n").alias("n"))
    run = Window.partitionBy("s0").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    places = shares.withColumn("end", F.sum("n").over(run)).select(
        F.col("s0").alias("s"), "shard", F.explode(F.sequence(F.col("end") - F.col("n") + 1, F.col("end"))).alias("i")
    )
    return staged(draws.join(places, ["s", "i"]).drop("i"), "mix-shards")


def _cut(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of cut blocks with `words`, what the cut leaves of each; one block a source is cut, so its window is one block long."""
    order = Window.partitionBy("s", "block", *keys).orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    return rows.withColumn("before", before).withColumn(
        "words", F.least(F.col("size"), F.greatest(F.lit(0), F.col("part") - F.col("before"))).cast("long")
    ).drop("before")


def default_shards(plan_: dict[str, DataFrame], draws_per_shard: int = 32) -> int:
    return max(1, math.ceil(plan_["draws"].count() / draws_per_shard))


MIX_COLUMNS = ("mix_pass", "mix_words", "mix_shard", "mix_place")


def mix(docs: DataFrame, shards: int | None = None, **settings) -> DataFrame:
    """The mix itself: all columns of docs, and mix_pass, mix_words (its first words that count), mix_shard, mix_place.

    A row stands once for each time it is drawn. Documents without words are never drawn (there is nothing
    to take). Rows that repeat with one doc_id are drawn as one, as are rows without an id. Null sources form a source
    of their own, empty tables give an empty mix. Own columns with the names of those four are replaced.
    """
    docs = docs.drop(*MIX_COLUMNS)
    made = plan(docs, **settings)
    draws = shard_draws(made, shards or default_shards(made))
    drawn = made["sizes"].join(_few(draws), ["s", "block"])
    words = drawn.filter("part IS NULL").withColumn("words", F.col("size")).unionByName(_cut(drawn.filter("part IS NOT NULL"), "pass"))
    name = fresh(docs, "mix_doc_id")
    rows = words.filter("words > 0").select(
        F.col("doc_id").alias(name), F.col("pass").alias("mix_pass"), F.col("words").alias("mix_words"),
        F.col("shard").alias("mix_shard"), F.xxhash64(F.lit(SEED), "place", "pass").alias("mix_place"),
    ).dropDuplicates([name, "mix_pass"])
    return docs.join(rows, F.col("doc_id").eqNullSafe(F.col(name))).drop(name)


def taken(plan_: dict[str, DataFrame], draws: DataFrame) -> DataFrame:
    """The rows of sizes with `shares` (shard, pass, words: what each output shard takes of the row) and `taken`, their sum.

    draws: of shard_draws(); a draw counts in the shard that the splitting tree gave it to. Only cut blocks are shuffled. Rows
    without words (null and empty texts) take part with no shares and 0 taken, as do rows of blocks that are not drawn;
    rows that repeat and rows without an id count each; an empty table gives no rows. There are no other columns than those of sizes.
    """
    per_block = draws.groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "part"))).alias("drawn"), F.max("part").alias("part"))
    rows = plan_["sizes"].join(_few(staged(per_block, "mix-drawn")), ["s", "block"], "left")
    even = rows.filter("part IS NULL").withColumn("words", F.lit(0).cast("long"))
    both = even.unionByName(_cut(rows.filter("part IS NOT NULL")))
    words = lambda d: F.when(d["part"].isNull(), F.col("size")).otherwise(F.col("words"))
    shares = F.transform("drawn", lambda d: F.struct(d["shard"].alias("shard"), d["pass"].alias("pass"), words(d).alias("words")))
    own = both.withColumn("shares", F.filter(F.coalesce(shares, F.array().cast("array<struct<shard:int,pass:int,words:bigint>>")), lambda x: x["words"] > 0))
    return own.withColumn("taken", F.aggregate("shares", F.lit(0).cast("long"), lambda n, x: n + x["words"])).drop("drawn", "part", "words")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shares; one row per row of documents."""
    made = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    draws = shard_draws(made, default_shards(made))
    return taken(made, draws).join(_few(made["sources"].select("s", "source_size", "target")), "s").select(
        "doc_id", "source", "size", "source_size", "target", "taken", "shares"
    )
