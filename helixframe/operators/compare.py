"""Comparison of call sets across samples, conditions and tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["chr", "start_pos", "end_pos"]
#: Ratios from which an event counts as not depleted, and as enriched.
NOT_DEPLETED, ENRICHED = 1.0, 5.0


def event_key(chrom: Column, start: Column, end: Column, sep: str = "_") -> Column:
    """chr_start_end (or chr:start-end with sep ':'), with the chr prefix added where it is missing."""
    name = F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))
    return F.concat(name, F.lit(sep), start.cast("string"), F.lit("-" if sep == ":" else sep), end.cast("string"))


def sample_matrix(calls: DataFrame, sample: str, samples: list[str]) -> DataFrame:
    """Events by samples: the support of each, 0 where a sample has no such event."""
    return calls.groupBy(*KEY).pivot(sample, samples).agg(F.max("support")).na.fill(0, samples)


def cpm_normalise(calls: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Support per million reads of the sample, at most 0.5."""
    key = event_key(F.col("chr"), F.col("start_pos"), F.col("end_pos"))
    return calls.join(sizes, by).select(*by, key.alias("event"), F.round(F.least(F.col("support") * 1e6 / F.col("reads"), F.lit(0.5)), 6).alias("cpm"))


def pre_post_join(calls: DataFrame, how: str = "left") -> DataFrame:
    """tool, event, pre and post support; 0 where a side is missing."""
    keys = ["tool", *KEY]
    pre = calls.where("cond = 'pre'").select(*keys, F.col("support").alias("pre"))
    post = calls.where("cond = 'post'").select(*keys, F.col("support").alias("post"))
    return pre.join(post, keys, how).na.fill(0, ["pre", "post"])


def enrichment_ratio(joined: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add ratio = post * pre_reads / (pre * post_reads), -1 without pre, and label: Y enriched, X not depleted, - below."""
    reads = sizes.groupBy("tool").agg(F.max(F.when(F.col("cond") == "pre", F.col("reads"))).alias("pre_reads"), F.max(F.when(F.col("cond") == "post", F.col("reads"))).alias("post_reads"))
    raw = F.when(F.col("pre") == 0, F.lit(-1.0)).otherwise(F.col("post") * F.col("pre_reads") / (F.col("pre") * F.col("post_reads")))
    out = joined.join(F.broadcast(reads), "tool").withColumn("ratio", F.round(raw, 6)).drop("pre_reads", "post_reads")
    return out.withColumn("label", F.when(F.col("ratio") >= ENRICHED, "Y").when(F.col("ratio") >= NOT_DEPLETED, "X").otherwise("-"))


def ranked_events(ratios: DataFrame) -> DataFrame:
    """Add rank within the tool: most pre support first, then least post support, then the event."""
    w = Window.partitionBy("tool").orderBy(F.desc("pre"), "post", *KEY)
    return ratios.withColumn("rank", F.row_number().over(w))


def top_x_events(ratios: DataFrame, x: int = 100) -> DataFrame:
    """The x best events of each tool with flags not_depleted and enriched."""
    return ranked_events(ratios).where(F.col("rank") <= x).select("tool", *KEY, "pre", "post", "rank", (F.col("ratio") >= NOT_DEPLETED).alias("not_depleted"), (F.col("ratio") >= ENRICHED).alias("enriched"))


def event_table(ratios: DataFrame, tools: list[str], top: int | None = None) -> DataFrame:
    """Events by tools: the ratio of each, null where a tool has no such event."""
    rows = ranked_events(ratios).where(F.col("rank") <= top) if top else ratios
    return rows.groupBy(*KEY).pivot("tool", tools).agg(F.max("ratio"))


def tool_overlap_matrix(ratios: DataFrame, top: int = 100) -> DataFrame:
    """For each pair of tools the number of events that the best of both share. The side is top rows a tool at most."""
    best = ranked_events(ratios).where(F.col("rank") <= top).select("tool", *KEY)
    other = best.select(F.col("tool").alias("other"), *KEY)
    return best.join(other, KEY).groupBy("tool", "other").agg(F.count("*").alias("shared"))


def depletion_summary(ratios: DataFrame, post_events: DataFrame) -> DataFrame:
    """Per tool: events before and after, not depleted ones and their share, and flags among the best 10 and 100 of support 2."""
    ok, rich = F.col("ratio") >= NOT_DEPLETED, F.col("ratio") >= ENRICHED
    strong = F.col("pre") >= 2

    def n(cond: Column) -> Column:
        return F.sum(cond.cast("long"))

    # counts need no order, and of the ranked events only the best 100 of each task leave it
    pre = ratios.groupBy("tool").agg(F.count("*").alias("n_pre"), n(ok).alias("not_depleted"))
    best = ranked_events(ratios).where(F.col("rank") <= 100)
    flags = best.groupBy("tool").agg(*[n((F.col("rank") <= k) & strong & c).alias(f"top{k}_{name}") for k in (10, 100) for name, c in (("not_depleted", ok), ("enriched", rich))])
    post = post_events.groupBy("tool").agg(F.count("*").alias("n_post"))
    return pre.join(flags, "tool").join(post, "tool").withColumn("percent", F.round(100.0 * F.col("not_depleted") / F.col("n_pre"), 6))


def confidence_score(summary: DataFrame) -> DataFrame:
    """Size of a tool's mark, and log2 of its number of events."""
    return summary.select("tool", F.round(F.pow(F.lit(1.3), F.col("top100_not_depleted") * F.col("top100_enriched") / 100.0), 6).alias("size"), F.round(F.log2("n_pre"), 6).alias("log_events"))


def event_union(calls: DataFrame) -> DataFrame:
    return calls.select(*KEY).distinct()


def event_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).intersect(b.select(*KEY))


def read_set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Events of both reports with the reads lost and gained, comma-joined in order; '-' where there are none."""
    both = a.select(*KEY, F.col("reads").alias("ra")).join(b.select(*KEY, F.col("reads").alias("rb")), KEY)

    def listed(x: Column) -> Column:
        return F.coalesce(F.nullif(F.array_join(F.array_sort(x).cast("array<string>"), ","), F.lit("")), F.lit("-"))

    return both.select(*KEY, listed(F.array_except("ra", "rb")).alias("lost"), listed(F.array_except("rb", "ra")).alias("gained"))


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer difference of two reports: NC same support, ++ more, -- less, DI only in the first, NA only in the second."""
    x, y = a.select(*KEY, F.col("support").alias("before")), b.select(*KEY, F.col("support").alias("after"))
    tag = F.when(F.col("before").isNull(), "NA").when(F.col("after").isNull(), "DI").when(F.col("after") > F.col("before"), "++").when(F.col("after") < F.col("before"), "--").otherwise("NC")
    return x.join(y, KEY, "full_outer").withColumn("tag", tag).na.fill(0, ["before", "after"])


def precision_recall(counts: DataFrame) -> DataFrame:
    """From tp, detected and total: fp, recall and precision."""
    return counts.select("*", (F.col("detected") - F.col("tp")).alias("fp"), F.round(F.col("tp") / F.col("total"), 6).alias("recall"), F.round(F.col("tp") / F.col("detected"), 6).alias("precision"))


def pr_shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distance between a tool's (recall, precision) on two datasets."""
    j = a.select("tool", F.col("recall").alias("r1"), F.col("precision").alias("p1")).join(b.select("tool", F.col("recall").alias("r2"), F.col("precision").alias("p2")), "tool")
    return j.select("tool", F.round(F.sqrt(F.pow(F.col("r1") - F.col("r2"), 2) + F.pow(F.col("p1") - F.col("p2"), 2)), 6).alias("shift"))


def mapping_accuracy(runs: DataFrame, by: str) -> DataFrame:
    """Mean and sample deviation of correct, incorrect and unmapped percentages over runs.

    runs: correct, concordant, discordant, total. Incorrect ones are the concordant and discordant that are not correct.
    """
    pct = {"correct": F.col("correct"), "incorrect": F.col("concordant") + F.col("discordant") - F.col("correct"), "unmapped": F.col("total") - F.col("concordant") - F.col("discordant")}
    shares = runs.select(by, *[(100.0 * c / F.col("total")).alias(k) for k, c in pct.items()])
    return shares.groupBy(by).agg(*[F.round(f(k), 6).alias(f"{k}_{name}") for k in pct for name, f in (("mean", F.avg), ("std", F.stddev_samp))])


def resource_summary(runs: DataFrame) -> DataFrame:
    """Per tool total minutes and hours (of seconds) and peak GB (of KB), in long form: tool, metric, value."""
    wide = runs.groupBy("tool").agg(F.round(F.sum("seconds") / 60.0, 6).alias("minutes"), F.round(F.sum("seconds") / 3600.0, 6).alias("hours"), F.round(F.max("kb") / 1048576.0, 6).alias("gb"))
    return wide.unpivot("tool", ["minutes", "hours", "gb"], "metric", "value")
