"""Mixing sources to target weights: fixed-length blocks drawn by pseudorandom index permutations.

Documents of a source are packed end to end and cut into blocks of a fixed number of words (fewer in small sources, so that
each has many blocks). For every output shard the counts of the sources are drawn (a multinomial draw, given that the totals
meet the targets); the slots they make are mapped through a pseudorandom permutation of their source's block indices, and
blocks and slots meet in a join on the index. Only sizes and indices are shuffled, never text.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: Words in a block, blocks in an output shard, most often that a source's words may be repeated.
BLOCK, SHARD, MOST = 64, 1024, 3.0
#: Least blocks of a source that has as many words.
LEAST_BLOCKS = 64
#: Documents packed in one stretch, and slots expanded from one row.
STRETCH, RUN = 500, 4_096
#: Rounds of the permutation and most steps of a cycle walk.
ROUNDS, STEPS = 4, 64


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The image of x under a pseudorandom permutation of 0..n-1 that key selects.

    A Feistel network over the smallest grid p x q of at least n cells (p = ceil(sqrt(n)), q = ceil(n / p)) permutes the
    cells; images of n or more are mapped again until they fall below n. Fewer than p cells lie outside, so that a walk ends
    within p steps, and each step leaves with probability 1 - 1/p: STEPS steps are exact up to n = 4096, and beyond that fall
    short with a probability under 64 ** -64.
    """
    p = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    q = F.ceil(n / p).cast("long")

    def left(r: int, c: Column) -> Column:
        return F.struct(F.pmod(c["a"] + F.pmod(F.xxhash64(F.lit(2 * r), c["b"], *key), p), p).alias("a"), c["b"].alias("b"))

    def right(r: int, c: Column) -> Column:
        return F.struct(c["a"].alias("a"), F.pmod(c["b"] + F.pmod(F.xxhash64(F.lit(2 * r + 1), c["a"], *key), q), q).alias("b"))

    def once(cell: Column) -> Column:
        pair = F.struct(F.floor(cell / q).cast("long").alias("a"), F.pmod(cell, q).alias("b"))
        for r in range(ROUNDS):
            pair = _let(_let(pair, partial(left, r)), partial(right, r))
        return _let(pair, lambda c: c["a"] * q + c["b"])

    return F.reduce(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(False).alias("done"), x.alias("x")), lambda s, _: F.when(s["done"], s).otherwise(_let(once(s["x"]), lambda y: F.struct((y < n).alias("done"), y.alias("x")))))["x"]


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target for a table (source, source_size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the total of all sizes; a target stops at
    MOST times its source's size, and the excess is reshared by weight among the rest until none is above. That is
    target = min(MOST * size, level * weight) for the level at which the targets add up to the total: with the sources in
    order of the level at which they stop, the level follows from running sums. The table has a row for each source only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * F.lit(MOST)
    t = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("stop", cap / F.col("weight"))
    everything = Window.partitionBy()
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum(cap).over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
        F.row_number().over(by_stop).alias("place"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    t = t.withColumn("level", F.min(F.when(level <= F.col("stop"), F.struct("place", level.alias("level")))).over(everything)["level"])
    return t.select("source", "source_size", "weight", F.least(cap, F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def block_words(source_size: Column) -> Column:
    """Words in a block of a source: small sources are cut finer, as whole blocks would miss their targets."""
    return F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(source_size / LEAST_BLOCKS))).cast("long")


def document_sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source and size (words of the whole text; 0 for null) of every row."""
    return documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def packed(sized: DataFrame, rows: int) -> DataFrame:
    """Add begin (first word of the document in its source's packing), block_words (of its source) and key (unique per row).

    Documents of a source are ordered by stretch (a hash of doc_id and size), then doc_id and size. Running sums are taken
    within a stretch of about STRETCH documents and over the few sums of stretches, so that a source with a third of all rows
    is packed by many tasks.
    """
    stretches = max(1, rows // STRETCH)
    s = sized.withColumn("stretch", F.pmod(F.xxhash64("doc_id", "size"), F.lit(stretches)))
    sums = s.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("group", F.floor(F.sqrt(F.lit(float(stretches)))).cast("long")).withColumn("group", F.floor(F.col("stretch") / F.col("group")))
    within = Window.partitionBy("source", "group").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("source", "group").agg(F.sum("words").alias("words"))
    over = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col("source").alias("s2"), F.col("group").alias("g2"), F.coalesce(F.sum("words").over(over), F.lit(0)).alias("before_group"), block_words(F.sum("words").over(Window.partitionBy("source"))).alias("block_words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(within), F.lit(0)))
    sums = sums.join(groups, F.col("source").eqNullSafe(F.col("s2")) & (F.col("group") == F.col("g2"))).select(F.col("source").alias("s3"), F.col("stretch").alias("t3"), (F.col("before") + F.col("before_group")).alias("offset"), "block_words")
    w = Window.partitionBy("source", "stretch").orderBy("doc_id", "size")
    so_far = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.select("*", so_far.alias("so_far"), F.row_number().over(w).alias("place"))
    joined = s.join(sums, F.col("source").eqNullSafe(F.col("s3")) & (F.col("stretch") == F.col("t3")))
    return joined.select("doc_id", "source", "size", (F.col("offset") + F.col("so_far")).alias("begin"), "block_words", F.struct("stretch", "place").alias("key"))


def source_slots(targets: DataFrame) -> DataFrame:
    """source, blocks, slots, first (slots of the sources before it) and all_slots of every source that the mix takes from.

    A source gets its target over the mean words of its blocks as slots (rounded, but no more than MOST times its blocks).
    """
    t = targets.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words(F.col("source_size"))).cast("long"))
    t = t.withColumn("slots", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.floor(F.col("blocks") * F.lit(MOST)).cast("long"))).where("slots > 0")
    ordered = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return t.select("source", "blocks", "slots", F.coalesce(F.sum("slots").over(ordered), F.lit(0)).alias("first"), F.sum("slots").over(Window.partitionBy()).alias("all_slots"))


def _expanded(rows: DataFrame, begin: Column, end: Column, *keep: str) -> DataFrame:
    """Rows with k from begin to end - 1, by way of runs of RUN, which many tasks expand."""
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((end - begin - 1) / RUN))))
    # a fixed number of partitions: these rows are few and small until they are expanded, and would be coalesced to one task
    runs = runs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keep, "run")
    low = begin + F.col("run") * RUN
    return runs.withColumn("k", F.explode(F.sequence(low, F.least(low + RUN, end) - 1)))


def draw_counts(slots: DataFrame, seed: int = 42) -> DataFrame:
    """shard, source and drawn: how many slots of each output shard (SHARD slots, the last fewer) fall to each source.

    The multinomial draw given that the totals of all sources are their slots: the slots of all sources, end to end, are
    mapped to output positions by a permutation, and counted by shard.
    """
    each = _expanded(slots, F.lit(0).cast("long"), F.col("slots"), "source")
    at = permuted(F.col("first") + F.col("k"), F.col("all_slots"), F.lit(seed))
    return each.select("source", F.floor(at / SHARD).alias("shard")).groupBy("shard", "source").agg(F.count("*").alias("drawn"))


def draw_slots(targets: DataFrame, seed: int = 42) -> DataFrame:
    """One row per output slot: shard, slot, source and block (index in the source's packing).

    The drawn counts of the shards cut each source's slots into stretches, one for a shard; slot k of a source takes the block
    that the source's permutation number k / blocks has at k % blocks, so that no block is used anew before all others are.
    Within a shard the slots of the sources stand in a pseudorandom order as well.
    """
    slots = materialize(source_slots(targets), "source-slots")
    counts = materialize(draw_counts(slots, seed), "shard-counts")
    # running counts over the shards of a source, in groups of shards, so that no window holds more than about their square root
    shards = (slots.agg(F.max("all_slots")).first()[0] or 0) / SHARD
    counts = counts.withColumn("group", F.floor(F.col("shard") / max(1, math.ceil(math.sqrt(shards)))))
    groups = counts.groupBy("source", "group").agg(F.sum("drawn").alias("n"))
    before = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col("source").alias("s2"), F.col("group").alias("g2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    in_shard = Window.partitionBy("shard").orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("here", F.coalesce(F.sum("drawn").over(within), F.lit(0))).withColumn("lead", F.coalesce(F.sum("drawn").over(in_shard), F.lit(0)))
    placed = placed.withColumn("full", F.sum("drawn").over(Window.partitionBy("shard")))
    placed = placed.join(groups, F.col("source").eqNullSafe(F.col("s2")) & (F.col("group") == F.col("g2")))
    placed = placed.select("shard", "source", "drawn", "lead", "full", (F.col("base") + F.col("here")).alias("begin"))
    sizes = slots.select(F.col("source").alias("s3"), "blocks")
    placed = placed.join(sizes, F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
    each = _expanded(placed, F.col("begin"), F.col("begin") + F.col("drawn"), "source", "shard")
    turn, index = F.floor(F.col("k") / F.col("blocks")).cast("long"), F.pmod("k", "blocks")
    slot = permuted(F.col("lead") + F.col("k") - F.col("begin"), F.col("full"), F.lit(seed), F.col("shard"))
    return each.select("shard", slot.alias("slot"), "source", permuted(index, F.col("blocks"), F.lit(seed), F.col("source"), turn).alias("block"))


def block_spans(docs: DataFrame) -> DataFrame:
    """source, block, doc_id, key, size, first and words: which words of which document lie in which block."""
    begin, end, length = F.col("begin"), F.col("begin") + F.col("size"), F.col("block_words")
    spans = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(begin / length), F.floor((end - 1) / length))))
    first = F.greatest(begin, F.col("block") * length)
    return spans.select("source", "block", "doc_id", "key", "size", (first - begin).alias("first"), (F.least(end, (F.col("block") + 1) * length) - first).alias("words"))


def _prepared(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packed documents and targets; the sizes are written once, as the texts are counted for them."""
    sized = materialize(document_sizes(documents), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    return packed(sized, sized.count()), targets


def mix_blocks(documents: DataFrame, seed: int = 42) -> DataFrame:
    """The mix itself: shard, slot, source, doc_id, first, words, in which each slot lists the pieces of its block."""
    docs, targets = _prepared(documents)
    slots, spans = draw_slots(targets, seed).alias("s"), block_spans(docs).alias("b")
    return slots.join(spans.hint("merge"), F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.block") == F.col("b.block"))).select("shard", "slot", F.col("s.source").alias("source"), "doc_id", "first", "words")


def mix_sources(documents: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) for every row of documents.

    A null text or one without words has size 0 and gives nothing. A null source is a source of its own, last in order. Rows
    that repeat a doc_id are documents of their own. An empty table gives an empty result. A block is used at most MOST times,
    so no document gives more than MOST times its size. Other columns are ignored.
    """
    docs, targets = _prepared(documents)
    docs = materialize(docs, "packed", True)
    uses = draw_slots(targets, seed).groupBy("source", "block").agg(F.count("*").alias("uses"))
    spans = block_spans(docs).alias("b")
    # the expanded side is far larger than it is estimated to be: never broadcast
    met = spans.join(uses.hint("merge").alias("u"), F.col("b.source").eqNullSafe(F.col("u.source")) & (F.col("b.block") == F.col("u.block")))
    taken = met.groupBy(F.col("b.source").alias("source2"), F.col("b.doc_id").alias("doc_id2"), F.col("key").alias("key2")).agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    same = F.col("source").eqNullSafe(F.col("source2")) & F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("key") == F.col("key2"))
    out = docs.join(taken, same, "left")
    t = targets.select(F.col("source").alias("source3"), "source_size", "target")
    return out.join(t, F.col("source").eqNullSafe(F.col("source3")), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {"op7_mixing": op7_mixing}
ORACLES: dict[str, str] = {}
