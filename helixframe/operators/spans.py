"""Mates and seeds against the gene model: how far a seed may reach, junctions along transcripts, and what pairs of mates have in common.

Every operator meets its rows with exons or segments in bin joins and aggregates per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..params import DEFAULT, Params
from .intervals import gap_neighbours, merge_islands, point_join


def place_facts(places: DataFrame, exons: DataFrame, k: int) -> DataFrame:
    """What the gene model says of a seed of k bases at each place (chr, pos; distinct): chr, pos, in_exon, max_end, min_end, max_next, next_start, exons.

    exons lists those that hold pos (start_pos, end_pos, gene_id, next_exon_beg). in_exon tells whether there is any; max_end,
    min_end and max_next are of those that hold the whole seed. Outside exons max_end is the base before next_start, the
    next exon's; it is null where none follows.
    """
    held = point_join(places, exons.select("chr", "start_pos", "end_pos", "gene_id", "next_exon_beg").distinct())
    whole = F.col("end_pos") >= F.col("pos") + k - 1
    per = held.groupBy("chr", "pos").agg(
        F.max(F.when(whole, F.col("end_pos"))).alias("most"),
        F.min(F.when(whole, F.col("end_pos"))).alias("min_end"),
        F.max(F.when(whole, F.col("next_exon_beg"))).alias("max_next"),
        F.collect_list(F.struct("start_pos", "end_pos", "gene_id", "next_exon_beg")).alias("exons"),
    )
    out = gap_neighbours(places, merge_islands(exons)).select("chr", "pos", "next_start").join(per, ["chr", "pos"], "left")
    max_end = F.when(F.col("exons").isNull(), F.col("next_start") - 1).otherwise(F.coalesce("most", F.lit(0)))
    return out.select("chr", "pos", F.col("exons").isNotNull().alias("in_exon"), max_end.alias("max_end"), "min_end", "max_next", "next_start", "exons")


def seed_bound(pos: Column, rlen: Column, k: int | Column, p: Params = DEFAULT) -> Column:
    """The furthest start that the seed after one of k bases at pos may have, from the columns of place_facts; rlen bases of the read follow it.

    In an intron the bound is rlen and the edits further on, or where the seed would touch the next exon; in exons it is their
    end, or the furthest next exon where one of them ends before the read does; on a border it is 0.
    """
    end = pos + k - 1
    reach = pos + rlen + p.max_edit
    intron = F.when(F.col("next_start").isNull(), reach).when(F.col("next_start") - 1 < end, 0).otherwise(F.least(reach, F.col("next_start") - k))
    exonic = F.when(F.col("min_end").isNull(), 0).when((F.col("min_end") < rlen + end) & (F.col("max_next") != 0), F.col("max_next") + k - 1).otherwise(F.col("max_end") - k + 1)
    return F.when(F.col("in_exon"), exonic).otherwise(intron).cast("long")


def seed_upper_bound(seeds: DataFrame, exons: DataFrame, k: int = DEFAULT.kmer, p: Params = DEFAULT) -> DataFrame:
    """id and bound (seed_bound) of seeds of k bases: id, chr, pos, rlen (bases of the read after them).

    exons have next_exon_beg as from exon_neighbours. What the gene model says of a place is found once for all seeds there.
    """
    facts = place_facts(seeds.select("chr", "pos").distinct(), exons, k)
    return seeds.join(facts, ["chr", "pos"]).select("id", seed_bound(F.col("pos"), F.col("rlen"), k, p).alias("bound"))


def junction_distance(pairs: DataFrame, exons: DataFrame, k: int = DEFAULT.kmer, max_edit: int = DEFAULT.max_edit) -> DataFrame:
    """id and dist of the pairs of seeds (id, chr, s1, s2, read_dist) that a junction can lie between.

    dist is what of an exon of the first seed follows it and what of the next exon precedes the second one, if it is within
    max_edit of the distance in the read (of several exons the first by start, end, gene and furthest next exon); failing that, the
    distance in the genome where the second seed lies wholly in the intron after an exon that ends within the read's distance.
    """
    e1 = F.col("s1") + k - 1
    held = point_join(pairs.where(F.col("s2") > e1), exons.select("chr", "start_pos", "end_pos", "gene_id", "next_exon_beg"), "s1")
    after, ahead = F.col("end_pos") - e1, F.col("s2") - F.col("next_exon_beg")
    across = F.when((after >= 0) & (ahead >= 0) & (F.abs(after + ahead - F.col("read_dist")) <= max_edit), F.struct("start_pos", "end_pos", "gene_id", (-F.col("next_exon_beg")).alias("next"), (after + ahead).alias("dist")))
    inside = F.when((after >= 0) & (after < F.col("read_dist")) & (ahead + k < 0), F.col("s2") - e1 - 1)
    per = held.groupBy("id").agg(F.min(across).alias("across"), F.min(inside).alias("inside"))
    return per.select("id", F.coalesce("across.dist", "inside").alias("dist")).where("dist IS NOT NULL")


def trim_side_introns(mates: DataFrame, exons: DataFrame) -> DataFrame:
    """Mates (id, chr, spos, epos, qspos, qepos, matched_len, rlen) with ends in introns moved to the nearest exon inside.

    An end moves where that takes fewer bases than are matched, the left one first. clip_left and clip_right are the bases that
    an end on the matched side of the read loses.
    """
    islands = merge_islands(exons)
    cols = mates.columns
    at = gap_neighbours(mates.withColumn("pos", F.col("spos")), islands)
    diff = F.when(F.col("seg_end").isNull() | (F.col("seg_end") < F.col("spos")), F.col("next_start") - F.col("spos"))
    d = F.when((diff > 0) & (diff < F.col("matched_len")), diff).otherwise(0)
    left = at.withColumn("d", d).select(*[c for c in cols if c not in ("spos", "qspos", "matched_len")], (F.col("spos") + F.col("d")).alias("spos"), (F.col("qspos") + F.col("d")).alias("qspos"), (F.col("matched_len") - F.col("d")).alias("matched_len"), F.col("d").alias("d_left"))
    left = left.withColumn("clip_left", F.when(F.col("qspos") - 1 < F.col("rlen") - F.col("qepos"), F.col("d_left")).otherwise(0)).drop("d_left")
    at = gap_neighbours(left.withColumn("pos", F.col("epos")), islands)
    diff = F.when(F.col("seg_end") < F.col("epos"), F.col("epos") - F.col("seg_end"))
    d = F.when((diff > 0) & (diff < F.col("matched_len")), diff).otherwise(0)
    out = at.withColumn("d", d).withColumns({"epos": F.col("epos") - F.col("d"), "qepos": F.col("qepos") - F.col("d"), "matched_len": F.col("matched_len") - F.col("d")})
    out = out.withColumn("clip_right", F.when(F.col("qspos") - 1 > F.col("rlen") - F.col("qepos"), F.col("d")).otherwise(0))
    return out.select(*cols, "clip_left", "clip_right")


def _segments(trans_seg: DataFrame) -> DataFrame:
    return trans_seg.select("chr", "trans_id", F.col("seg_start").alias("start_pos"), F.col("seg_end").alias("end_pos"))


def ordered_segments(trans_seg: DataFrame) -> DataFrame:
    return _segments(trans_seg).groupBy("chr", "trans_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("segs"))


def stretches(lists: DataFrame) -> DataFrame:
    """What the ordered segments (segs) of each transcript cover, neighbouring ones as one: chr, trans_id, start_pos, end_pos."""
    starts = F.filter("segs", lambda s, i: F.coalesce(s["start_pos"] > F.get("segs", i - 1)["end_pos"] + 1, F.lit(True)))
    ends = F.filter("segs", lambda s, i: F.coalesce(F.get("segs", i + 1)["start_pos"] > s["end_pos"] + 1, F.lit(True)))
    merged = F.explode(F.zip_with(starts, ends, lambda x, y: F.struct(x["start_pos"].alias("start_pos"), y["end_pos"].alias("end_pos")))).alias("s")
    return lists.select("chr", "trans_id", merged).select("chr", "trans_id", "s.start_pos", "s.end_pos")


def junction_list(mates: DataFrame, trans_seg: DataFrame, slack: int = 3) -> DataFrame:
    """id, trans_id, ord (from 1), junc_start, junc_end, covered: the junctions of each mate (id, chr, spos, epos, matched_len).

    They are those between the segments of the first transcript that holds both ends of the mate, in different segments, and
    whose bases between them are within slack of matched_len. covered counts the mate's bases before a junction. Mates meet the ordered
    list of a transcript's segments once, so that what lies between their ends is neither shuffled nor sorted.
    """
    lists = ordered_segments(trans_seg)
    held = point_join(mates, stretches(lists), "spos").select("id", "chr", "spos", "epos", "matched_len", "trans_id").join(lists, ["chr", "trans_id"])
    # segments of a transcript don't overlap: the first of these holds spos, the last one epos, if any does
    path = F.filter("segs", lambda s: (s["end_pos"] >= F.col("spos")) & (s["start_pos"] <= F.col("epos")))
    held = held.select("id", "spos", "epos", "matched_len", "trans_id", path.alias("path")).where((F.size("path") > 1) & (F.try_element_at("path", F.lit(-1))["end_pos"] >= F.col("epos")))

    def step(so_far: Column, s: Column) -> Column:
        covered = F.coalesce(F.get(so_far, F.size(so_far) - 1)["covered"], F.lit(0).cast("long")) + F.least(s["end_pos"], "epos") - F.greatest(s["start_pos"], "spos") + 1
        return F.array_append(so_far, F.struct(s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), covered.cast("long").alias("covered")))

    kind = "array<struct<start_pos: bigint, end_pos: bigint, covered: bigint>>"
    held = held.select("id", "trans_id", "matched_len", F.aggregate("path", F.array().cast(kind), step).alias("path"))
    held = held.where(F.abs(F.element_at("path", -1)["covered"] - F.col("matched_len")) <= slack)
    junctions = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda x, y: F.struct(x["end_pos"].alias("junc_start"), y["start_pos"].alias("junc_end"), x["covered"].alias("covered")))
    best = held.groupBy("id").agg(F.min("trans_id").alias("trans_id"), F.min_by(junctions, "trans_id").alias("junctions"))
    return best.select("id", "trans_id", F.posexplode("junctions").alias("i", "x")).select("id", "trans_id", (F.col("i") + 1).alias("ord"), "x.junc_start", "x.junc_end", "x.covered")


def transcript_walk(anchors: DataFrame, trans_seg: DataFrame, right: bool = True) -> DataFrame:
    """id, trans_id, ord (from 1), pos and len: the exon pieces that need bases after (before, if not right) a position cover.

    anchors: id, chr, pos (the first base of the path), need, bound (no piece goes beyond it). There is a path along each
    transcript with a segment at pos; it may end short where the transcript or the bound does. Anchors meet the ordered list of a
    transcript's segments and walk along it, so that the pieces of paths are neither shuffled nor sorted.
    """
    lists = ordered_segments(trans_seg)
    at = point_join(anchors, stretches(lists)).select("id", "chr", "pos", "need", "bound", "trans_id")
    pos, bound, need = F.col("pos"), F.col("bound"), F.col("need").cast("long")
    if right:
        ahead = F.filter("segs", lambda s: (s["end_pos"] >= pos) & (s["start_pos"] <= bound))
        cut = lambda s: (F.greatest(s["start_pos"], pos), F.least(s["end_pos"], bound))
    else:
        ahead = F.reverse(F.filter("segs", lambda s: (s["start_pos"] <= pos) & (s["end_pos"] >= bound)))
        cut = lambda s: (F.greatest(s["start_pos"], bound), F.least(s["end_pos"], pos))

    def step(path: Column, s: Column) -> Column:
        a, b = cut(s)
        length = F.least(b - a + 1, need - path["so_far"])
        piece = F.struct((a if right else b - length + 1).cast("long").alias("pos"), length.cast("long").alias("len"))
        return F.when(path["so_far"] < need, F.struct((path["so_far"] + b - a + 1).cast("long").alias("so_far"), F.array_append(path["pieces"], piece).alias("pieces"))).otherwise(path)

    start = F.struct(F.lit(0).cast("long").alias("so_far"), F.array().cast("array<struct<pos: long, len: long>>").alias("pieces"))
    walk = at.join(lists, ["chr", "trans_id"]).select("id", "trans_id", F.posexplode(F.aggregate(ahead, start, step, lambda path: path["pieces"])).alias("i", "piece"))
    return walk.select("id", "trans_id", (F.col("i") + 1).alias("ord"), "piece.pos", "piece.len")


def left_mate_order(pairs: DataFrame, read_length: Column) -> DataFrame:
    """id and a_left: whether the first of two chains (a, b: arrays of qpos, rpos, len in order) is that of the left mate.

    Chains apart go by their starts. Of overlapping ones the fragments that overlap first (or, if none do, lie nearest) tell:
    the one further on in its read at their common base is left; where that base is beyond a read, the starts decide.
    """
    end = lambda f: f["rpos"] + f["len"] - 1
    met = F.flatten(
        F.transform(
            "a",
            lambda x: F.transform(
                "b",
                lambda y: F.struct(
                    F.greatest(y["rpos"] - end(x), x["rpos"] - end(y), F.lit(0)).alias("gap"),
                    F.greatest(x["rpos"], y["rpos"]).alias("common"),
                    (x["qpos"] + F.greatest(x["rpos"], y["rpos"]) - x["rpos"]).alias("qa"),
                    (y["qpos"] + F.greatest(x["rpos"], y["rpos"]) - y["rpos"]).alias("qb"),
                ),
            ),
        )
    )
    j = pairs.withColumn("best", F.array_min(met))
    a_start, b_start = F.get("a", F.lit(0))["rpos"], F.get("b", F.lit(0))["rpos"]
    apart = (b_start > end(F.element_at("a", -1))) | (a_start > end(F.element_at("b", -1)))
    inside = (F.col("best.qa") < read_length) & (F.col("best.qb") < read_length)
    return j.select("id", F.when(~apart & inside, F.col("best.qa") >= F.col("best.qb")).otherwise(a_start < b_start).alias("a_left"))


def pair_facts(pairs: DataFrame, exons: DataFrame, genes: DataFrame) -> DataFrame:
    """pairs (id, chr, spos1, epos1, spos2, epos2) with what the gene model says of their four ends.

    e_s1, e_e1, e_s2, e_e2: whether an exon is there. same_exon: an exon holds both starts. one_gene: exons at both starts are of
    one gene, or the gene of an exon at one start spans the other mate where that has none. one_gap: both starts lie in one
    intron, and from_gap is how far behind its beginning the first one is.
    """
    e = exons.select("chr", "gene_id", "start_pos", "end_pos").distinct()
    spans = genes.select("chr", "gene_id", F.col("start_pos").alias("g_start"), F.col("end_pos").alias("g_end"))
    out = pairs
    for end in ("s1", "e1", "s2", "e2"):
        held = point_join(pairs.select("id", "chr", F.col(f"{end[0]}pos{end[1]}").alias("pos")), e)
        if end[0] == "s":
            other = pairs.select("id", *[F.col(f"{x}pos{3 - int(end[1])}").alias(f"o_{x}") for x in "se"])
            held = held.join(spans, ["chr", "gene_id"]).join(other, "id")
            per = held.groupBy("id").agg(
                F.collect_set(F.struct("gene_id", "start_pos", "end_pos")).alias(f"x_{end}"),
                F.max((F.col("g_start") <= F.col("o_s")) & (F.col("o_e") <= F.col("g_end"))).alias(f"spans_{end}"),
            )
        else:
            per = held.groupBy("id").agg(F.lit(True).alias(f"x_{end}"))
        out = out.join(per, "id", "left")
    islands = merge_islands(exons)
    for k in (1, 2):
        at = gap_neighbours(pairs.select("id", "chr", F.col(f"spos{k}").alias("pos")), islands)
        out = out.join(at.select("id", F.col("seg_end").alias(f"gap{k}"), F.col("next_start").alias(f"next{k}")), "id", "left")
    ids = lambda c: F.transform(c, lambda x: x["gene_id"])
    both = F.col("x_s1").isNotNull() & F.col("x_s2").isNotNull()
    spanned = F.coalesce("spans_s1", F.lit(False)) | F.coalesce("spans_s2", F.lit(False))
    gap = F.col("x_s1").isNull() & F.col("x_s2").isNull() & (F.col("gap1") == F.col("gap2")) & F.col("next1").isNotNull() & F.col("next2").isNotNull()
    return out.select(
        *pairs.columns,
        *[F.col(f"x_{x}").isNotNull().alias(f"e_{x}") for x in ("s1", "e1", "s2", "e2")],
        F.coalesce(F.arrays_overlap("x_s1", "x_s2"), F.lit(False)).alias("same_exon"),
        F.when(both, F.arrays_overlap(ids("x_s1"), ids("x_s2"))).otherwise(spanned).alias("one_gene"),
        F.coalesce(gap, F.lit(False)).alias("one_gap"),
        F.when(F.coalesce(gap, F.lit(False)), F.col("spos1") - F.col("gap1")).alias("from_gap"),
    )


def explain_concordant(facts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """id and type (null if none) of pairs in forward order, from pair_facts with len1, len2 (matched), kind (of the candidate) and tlen.

    tlen is the template length along transcripts, -1 if none (insert_size, between end 1 and start 2). Of what the starts and
    what the inner ends say, the better category counts: where an exon is missing the pair is one between genes within the
    discordant limit; with exons it is concordant, or in genes where the candidate has no common transcript, within the limit of
    templates, and else discordant.
    """
    near = F.when(F.col("kind") == 0, P.CONCRD).otherwise(P.CONGEN)
    apart = F.col("spos2") - F.col("epos1") - 1 + F.col("len1") + F.col("len2")
    between = F.when(apart <= p.discordant_tlen, P.CONGNM)
    genomic = F.col("spos2") + F.col("len2") - F.col("spos1")
    starts = F.when(~F.col("e_s1") | ~F.col("e_s2"), between).when(F.col("same_exon"), F.when(genomic <= p.max_tlen, near).otherwise(P.DISCRD))
    inner = F.when(~F.col("e_e1") | ~F.col("e_s2"), between).when(F.col("tlen").between(0, p.max_tlen), near).otherwise(P.DISCRD)
    return facts.select("id", F.when(F.col("spos1") <= F.col("spos2"), F.least(starts, inner)).cast("int").alias("type"))


def detect_chimeric(facts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """id, inverted, bsj and two_bsj of pairs, from pair_facts with left1, right1, left2, right2 (sides mapped to the read's end).

    Mates are linked by a gene, or by an intron that the first one begins within the lariat limit of. inverted: mates of one
    gene, the first before the second. bsj: the sides turned away from each other are mapped. two_bsj: the open sides of two
    partial mates face away, or they share the end that both have mapped.
    """
    c = F.col
    linked = c("one_gene") | (c("one_gap") & (F.coalesce("from_gap", F.lit(0)) <= p.lariat))
    inverted = c("e_s1") & c("e_s2") & c("one_gene") & (c("spos1") < c("spos2"))
    bsj = c("right1") & c("left2") & linked
    facing = ~(c("right1") & c("right2") & (c("spos1") != c("spos2"))) & ~(c("left1") & c("left2") & (c("epos1") != c("epos2"))) & ~(c("left1") & c("right2"))
    return facts.select("id", inverted.alias("inverted"), bsj.alias("bsj"), ((c("spos1") <= c("spos2")) & facing & linked).alias("two_bsj"))
