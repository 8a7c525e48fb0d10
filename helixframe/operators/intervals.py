"""Closed intervals on chromosomes: joins, disjoint covers, masks and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the bins of interval joins; about the length of a common interval.
BIN = 512
#: Length of the stretches within which breakpoints are put in order.
STRETCH = 1 << 18


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def point_join(points: DataFrame, intervals: DataFrame, pos: str = "pos", how: str = "inner", width: int = BIN) -> DataFrame:
    """Points (chr, pos, ...) with the intervals (chr, start_pos, end_pos, ...) that hold them.

    Intervals are repeated for each bin they touch and points looked up in theirs: an equi-join on (chr, bin), which Spark
    splits when a bin is crowded, with the bounds as a residual condition. No pair comes up twice.
    """
    left = points.withColumn("bin", F.floor(F.col(pos) / width))
    right = intervals.withColumn("bin", F.explode(_bins(F.col("start_pos"), F.col("end_pos"), width)))
    right = right.withColumnsRenamed({"chr": "i_chr", "bin": "i_bin"})
    on = (F.col("chr") == F.col("i_chr")) & (F.col("bin") == F.col("i_bin")) & (F.col(pos) >= F.col("start_pos")) & (F.col(pos) <= F.col("end_pos"))
    return left.join(right, on, how).drop("bin", "i_bin", "i_chr")


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", width: int = BIN) -> DataFrame:
    """Intervals a (chr, a_start, a_end) with the intervals b (chr, b_start, b_end) they overlap; each pair in its first common bin."""
    left = a.withColumn("bin", F.explode(_bins(F.col("a_start"), F.col("a_end"), width)))
    right = b.withColumn("i_bin", F.explode(_bins(F.col("b_start"), F.col("b_end"), width))).withColumnRenamed("chr", "i_chr")
    first = F.floor(F.greatest("a_start", "b_start") / width)
    on = (F.col("chr") == F.col("i_chr")) & (F.col("bin") == F.col("i_bin")) & (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")) & (F.col("bin") == first)
    return left.join(right, on, how).drop("bin", "i_bin", "i_chr")


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common length of two closed intervals, 0 if none."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2) + 1, F.lit(0))


def disjoint_pieces(intervals: DataFrame) -> DataFrame:
    """chr, start_pos, end_pos of the maximal pieces between breakpoints; pieces that nothing covers are still among them.

    Breakpoints are put in order within stretches of a chromosome; the last one of a stretch is followed by the first of the next that has any.
    """
    edges = intervals.select("chr", F.explode(F.array("start_pos", F.col("end_pos") + 1)).alias("p")).distinct().withColumn("stretch", F.floor(F.col("p") / STRETCH))
    firsts = edges.groupBy("chr", "stretch").agg(F.min("p").alias("first"))
    firsts = firsts.select("chr", "stretch", F.lead("first").over(Window.partitionBy("chr").orderBy("stretch")).alias("follows"))
    w = Window.partitionBy("chr", "stretch").orderBy("p")
    after = F.coalesce(F.lead("p").over(w), "follows")
    return edges.join(firsts, ["chr", "stretch"]).select("chr", F.col("p").alias("start_pos"), (after - 1).alias("end_pos")).where("end_pos IS NOT NULL")


def flatten_intervals(intervals: DataFrame, label: str) -> DataFrame:
    """Disjoint cover: chr, seg_ind (from 0 along the chromosome), start_pos, end_pos and labels, the covering intervals'."""
    pieces = disjoint_pieces(intervals).select("chr", F.col("start_pos").alias("pos"), F.col("end_pos").alias("seg_end"))
    covered = point_join(pieces, intervals.select("chr", "start_pos", "end_pos", label))
    segs = covered.groupBy("chr", F.col("pos").alias("start_pos"), F.col("seg_end").alias("end_pos")).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    w = Window.partitionBy("chr").orderBy("start_pos")
    return segs.select("chr", (F.row_number().over(w) - 1).alias("seg_ind"), "start_pos", "end_pos", "labels")


def segment_summary(intervals: DataFrame, extra: str | None = None) -> DataFrame:
    """chr, start_pos, end_pos, max_end and min_end (of the covering intervals), and the maximum of a further column."""
    pieces = disjoint_pieces(intervals).select("chr", F.col("start_pos").alias("pos"), F.col("end_pos").alias("seg_end"))
    covered = point_join(pieces, intervals)
    most = [F.max(extra).alias(f"max_{extra}")] if extra else []
    return covered.groupBy("chr", F.col("pos").alias("start_pos"), F.col("seg_end").alias("end_pos_")).agg(F.max("end_pos").alias("max_end"), F.min("end_pos").alias("min_end"), *most).withColumnRenamed("end_pos_", "end_pos")


def merge_islands(intervals: DataFrame) -> DataFrame:
    """Union of intervals: touching or overlapping ones become one."""
    w = Window.partitionBy("chr").orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = intervals.select("chr", "start_pos", "end_pos").distinct()
    marked = spans.select("*", F.when(F.col("start_pos") <= reach + 1, 0).otherwise(1).alias("fresh"))
    islands = marked.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy("chr", "island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("island")


def border_mask(exons: DataFrame, reach: int) -> DataFrame:
    """Positions within reach of an exon border: [start - reach, start) and (end - reach, end], merged; clamped at 0."""
    before = exons.select("chr", F.greatest(F.col("start_pos") - reach, F.lit(0)).alias("start_pos"), (F.col("start_pos") - 1).alias("end_pos"))
    inside = exons.select("chr", F.greatest(F.col("end_pos") - reach + 1, F.lit(0)).alias("start_pos"), F.col("end_pos"))
    return merge_islands(before.unionByName(inside).where("end_pos >= start_pos").distinct())


def intron_mask(genes: DataFrame, exons: DataFrame) -> DataFrame:
    """What the genes cover and no exon does."""
    g, e = merge_islands(genes), merge_islands(exons)
    both = g.withColumn("exon", F.lit(0)).unionByName(e.withColumn("exon", F.lit(1)))
    pieces = disjoint_pieces(both).select("chr", F.col("start_pos").alias("pos"), F.col("end_pos").alias("seg_end"))
    covered = point_join(pieces, both).groupBy("chr", "pos", "seg_end").agg(F.max("exon").alias("exon"))
    return merge_islands(covered.where("exon = 0").select("chr", F.col("pos").alias("start_pos"), F.col("seg_end").alias("end_pos")))


def gap_neighbours(points: DataFrame, segments: DataFrame, width: int = BIN) -> DataFrame:
    """For each point the start of the last segment that begins at or before it, that segment's end, and the next one's start.

    Segments are listed by the bin they begin in, and every bin that points need is given the last segment of the bins before
    it; points meet their bin in an equi-join. Only segments and bins are put in order, never the points.
    """
    w = Window.partitionBy("chr").orderBy("start_pos")
    segs = segments.select("chr", F.struct("start_pos", "end_pos", F.lead("start_pos").over(w).alias("next")).alias("seg"))
    own = segs.groupBy("chr", F.floor(F.col("seg.start_pos") / width).alias("bin")).agg(F.array_sort(F.collect_list("seg")).alias("own"))
    asked = points.withColumn("gap_bin", F.floor(F.col("pos") / width))
    bins = asked.select("chr", F.col("gap_bin").alias("bin")).distinct().join(own, ["chr", "bin"], "full")
    of_chr = Window.partitionBy("chr")
    before = of_chr.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("chr").alias("gap_chr"), "bin", "own", F.last(F.element_at("own", -1), ignorenulls=True).over(before).alias("carried"), F.min(F.get("own", F.lit(0))["start_pos"]).over(of_chr).alias("first_start"))
    met = asked.join(bins, (F.col("chr") == F.col("gap_chr")) & (F.col("gap_bin") == F.col("bin")))
    here = F.filter("own", lambda s: s["start_pos"] <= F.col("pos"))
    seen = met.withColumn("gap_seg", F.coalesce(F.try_element_at(here, F.lit(-1)), F.col("carried")))
    seg = F.col("gap_seg")
    return seen.select(*points.columns, seg["start_pos"].alias("seg_start"), seg["end_pos"].alias("seg_end"), F.when(seg.isNull(), F.col("first_start")).otherwise(seg["next"]).alias("next_start"))
