"""Gene models: normalisation, merged features, transcript tables and annotation of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import disjoint_pieces, overlap_join, point_join
from .spans import ordered_segments, stretches


def parse_attributes(attributes: Column) -> Column:
    """GTF attributes as a map."""
    pairs = F.regexp_extract_all(attributes, F.lit('([A-Za-z_]+)[ ]+"?([^";]*)"?'), 0)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([A-Za-z_]+)", 1), F.regexp_extract(p, '[ ]+"?([^";]*)', 1))))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Gene, transcript and exon rows of GTF lines (column value); comments and other rows are dropped, missing attributes are '-'."""
    c = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & F.get(c, 2).isin("gene", "transcript", "exon"))
    attrs = rows.select(F.get(c, 0).alias("chr"), F.get(c, 1).alias("source"), F.get(c, 2).alias("type"), F.get(c, 3).cast("long").alias("start_pos"), F.get(c, 4).cast("long").alias("end_pos"), F.get(c, 6).alias("strand"), parse_attributes(F.get(c, 8)).alias("a"))
    get = lambda k: F.coalesce(F.try_element_at("a", F.lit(k)), F.lit("-"))
    return attrs.select("chr", "source", "type", "start_pos", "end_pos", "strand", get("gene_id").alias("gene_id"), get("transcript_id").alias("trans_id"), F.try_element_at("a", F.lit("exon_number")).try_cast("int").alias("exon_num"), get("gene_name").alias("gene_name"))


def normalise_gtf(exons: DataFrame) -> DataFrame:
    """Gene and transcript rows synthesised from exons, with an order: genes, their transcripts, exons (of '-' in reverse)."""
    gene = exons.groupBy("chr", "strand", "gene_id").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    trans = exons.groupBy("chr", "strand", "gene_id", "trans_id").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    gene = gene.select("chr", F.lit("gene").alias("type"), "strand", "gene_id", F.lit(None).cast("long").alias("trans_id"), "start_pos", "end_pos", F.lit(0).alias("ord"))
    trans = trans.select("chr", F.lit("transcript").alias("type"), "strand", "gene_id", "trans_id", "start_pos", "end_pos", F.lit(0).alias("ord"))
    ordered = exons.select("chr", F.lit("exon").alias("type"), "strand", "gene_id", "trans_id", "start_pos", "end_pos", F.when(F.col("strand") == "-", -F.col("exon_num")).otherwise(F.col("exon_num")).alias("ord"))
    return gene.unionByName(trans).unionByName(ordered)


def exon_neighbours(exons: DataFrame) -> DataFrame:
    """Add next_exon_beg and prev_end along the transcript in row order: on '-' the next exon is the row before; 0 at the ends."""
    w = Window.partitionBy("chr", "trans_id").orderBy("exon_num", "start_pos", "end_pos")
    plus = F.col("strand") == "+"
    after, before = F.lead("start_pos").over(w), F.lag("start_pos").over(w)
    end_after, end_before = F.lead("end_pos").over(w), F.lag("end_pos").over(w)
    return exons.withColumns({"next_exon_beg": F.coalesce(F.when(plus, after).otherwise(before), F.lit(0)), "prev_end": F.coalesce(F.when(plus, end_before).otherwise(end_after), F.lit(0))})


def merge_exons(exons: DataFrame) -> DataFrame:
    """Identical exons (span, gene, next exon) once, with their transcripts and transcript-exon labels in order."""
    label = F.concat(F.col("trans_id").cast("string"), F.lit("-"), F.col("exon_num").cast("string"))
    return exons.groupBy("chr", "start_pos", "end_pos", "gene_id", "next_exon_beg").agg(F.array_sort(F.collect_list("trans_id")).alias("trans_ids"), F.array_sort(F.collect_list(label)).alias("labels"))


def merge_genes(genes: DataFrame) -> DataFrame:
    """Genes of identical span once, ids joined in order."""
    return genes.groupBy("chr", "start_pos", "end_pos").agg(F.array_join(F.array_sort(F.collect_list("gene_id")).cast("array<string>"), ",").alias("gene_ids"))


def transcript_segments(exons: DataFrame) -> DataFrame:
    """chr, trans_id, seg_start, seg_end, state for every segment of a transcript's exons.

    State 1: the segment begins with the exon; else 3: it ends with it; else 2. Rows are dealt by transcript, as what reads them asks for.
    """
    pieces = disjoint_pieces(exons).select("chr", F.col("start_pos").alias("seg_start"), F.col("end_pos").alias("seg_end"))
    covered = point_join(pieces, exons.select("chr", "trans_id", "start_pos", "end_pos"), "seg_start")
    state = F.when(F.col("seg_start") == F.col("start_pos"), 1).when(F.col("seg_end") == F.col("end_pos"), 3).otherwise(2)
    covered = covered.select("chr", "trans_id", "seg_start", "seg_end", state.alias("state")).repartition("chr", "trans_id")
    return covered.groupBy("chr", "trans_id", "seg_start", "seg_end").agg(F.min("state").alias("state"))


def annotate_circ(circ: DataFrame, exons: DataFrame) -> DataFrame:
    """trans(gene)[first exon-last exon] of the transcripts with an exon at the start and one at the end of an event, or NA."""
    starts = exons.select("chr", "start_pos", "trans_id", "gene_id", F.col("exon_num").alias("beg_exon"))
    ends = exons.select("chr", "end_pos", F.col("trans_id").alias("t2"), F.col("exon_num").alias("end_exon"))
    hits = circ.join(starts, ["chr", "start_pos"]).join(ends, ["chr", "end_pos"]).where("trans_id = t2")
    text = F.format_string("%d(%d)[%d-%d]", "trans_id", "gene_id", "beg_exon", "end_exon")
    found = hits.groupBy("chr", "start_pos", "end_pos").agg(F.array_join(F.array_sort(F.collect_set(text)), ",").alias("annotation"))
    return circ.join(found, ["chr", "start_pos", "end_pos"], "left").withColumn("annotation", F.coalesce("annotation", F.lit("NA")))


def same_gene(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """pair ids (column id) whose two positions (pos1, pos2 on chr) some gene holds both."""
    held = point_join(pairs.withColumnRenamed("pos1", "pos"), genes)
    return held.where((F.col("pos2") >= F.col("start_pos")) & (F.col("pos2") <= F.col("end_pos"))).select("id").distinct()


def breakpoint_snap(splits: DataFrame, exons: DataFrame, tolerance: int = 5) -> DataFrame:
    """Exon ends near the left part's end with exon starts near the right part's, in one transcript and at the same offset.

    splits: id, chr, left_end, right_start. Offsets are listed and met in an equi-join; the smallest offset wins, then the
    smaller one, then the transcript.
    """
    moved = splits.withColumn("diff", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))))
    near = moved.select("id", "chr", "diff", (F.col("left_end") + F.col("diff")).alias("l"), (F.col("right_start") + F.col("diff")).alias("r"))
    ends = exons.select("chr", F.col("end_pos").alias("l"), "trans_id")
    starts = exons.select("chr", F.col("start_pos").alias("r"), "trans_id")
    hits = near.join(ends, ["chr", "l"]).join(starts, ["chr", "r", "trans_id"])
    best = F.min(F.struct(F.abs("diff").alias("a"), "diff", "trans_id", "l", "r")).alias("b")
    return hits.groupBy("id").agg(best).select("id", "b.trans_id", "b.diff", F.col("b.l").alias("left_end"), F.col("b.r").alias("right_start"))


def segment_exon_class(parts: DataFrame, exons: DataFrame, slack: int = 2) -> DataFrame:
    """Class of the split parts of reads (id, chr, a_start, a_end) against exons, per part.

    intron: no exon overlaps; boundary_ok: the ends meet one exon's within slack; middle_exon: inside an exon; retention: else.
    """
    e = exons.select("chr", F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end")).distinct()
    hits = overlap_join(parts, e)
    exact = (F.abs(F.col("a_start") - F.col("b_start")) <= slack) | (F.abs(F.col("a_end") - F.col("b_end")) <= slack)
    inside = (F.col("a_start") >= F.col("b_start")) & (F.col("a_end") <= F.col("b_end"))
    per = hits.groupBy("id").agg(F.bool_or(exact & inside).alias("ok"), F.bool_or(inside).alias("inside"))
    kind = F.when(F.col("ok").isNull(), "intron").when(F.col("ok"), "boundary_ok").when(F.col("inside"), "middle_exon").otherwise("retention")
    return parts.join(per, "id", "left").select("id", kind.alias("class"))


def insert_size(mates: DataFrame, trans_seg: DataFrame) -> DataFrame:
    """Template length along transcripts that hold both mates' segments: id, tlen (smallest; -1 if none).

    mates: id, chr, end1 (end of the left mate), start2 (start of the right mate). Segments between the two are summed where a mate
    meets the ordered list of a transcript's segments. With columns len1 and len2 the mates themselves count too, but for the two bases that the sum has already.
    """
    lists = ordered_segments(trans_seg)
    both = point_join(mates.select("id", "chr", F.col("end1").alias("pos"), "start2"), stretches(lists)).select("id", "chr", F.col("pos").alias("end1"), "start2", "trans_id").join(lists, ["chr", "trans_id"])
    # segments of a transcript don't overlap: the last of these holds start2, if any does
    path = F.filter("segs", lambda s: (s["end_pos"] >= F.col("end1")) & (s["start_pos"] <= F.col("start2")))
    walk = both.select("id", "end1", "start2", path.alias("path")).where((F.size("path") > 0) & (F.try_element_at("path", F.lit(-1))["end_pos"] >= F.col("start2")))
    piece = lambda so_far, s: so_far + F.least(s["end_pos"], "start2") - F.greatest(s["start_pos"], "end1") + 1
    sizes = walk.groupBy("id").agg(F.min(F.aggregate("path", F.lit(0).cast("long"), lambda so_far, s: piece(so_far, s).cast("long"))).alias("tlen"))
    whole = F.col("tlen") + F.col("len1") + F.col("len2") - 2 if "len1" in mates.columns else F.col("tlen")
    return mates.join(sizes, "id", "left").select("id", F.coalesce(whole, F.lit(-1)).alias("tlen"))
