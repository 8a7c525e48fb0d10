"""Alignments: CIGAR jobs, SAM fields, read classes and agreement with other aligners and with simulated truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import params as P
from .intervals import overlap_join
from .tables import stored

#: Positions that differ by this much or less agree, and calls that match a true event.
NEAR = 10
#: Positions of a log that are counted together.
STRETCH = 100_000


def cigar_operations(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR string; empty for '*'."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHPX=])"), 0), lambda x: F.struct(F.regexp_extract(x, "^[0-9]+", 0).cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))


def cigar_blocks(sam: DataFrame, merge_gap: int | None = None) -> DataFrame:
    """Reference blocks of alignments: qname, flag, rname, block_start, block_end.

    M, = and X make a block, D and N move on, the rest stands still. Blocks less than merge_gap apart become one.
    """
    ops = sam.select("qname", "flag", "rname", "pos", F.posexplode(cigar_operations(F.col("cigar"))).alias("i", "o"))
    moves = F.when(F.col("o.op").isin("M", "=", "X", "D", "N"), F.col("o.n")).otherwise(0)
    w = Window.partitionBy("qname", "flag", "rname", "pos").orderBy("i")
    before = F.coalesce(F.sum(moves).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = ops.withColumn("block_start", F.col("pos") + before).where(F.col("o.op").isin("M", "=", "X")).withColumn("block_end", F.col("block_start") + F.col("o.n") - 1)
    if merge_gap is not None:
        fresh = F.when(F.col("block_start") - F.lag("block_end").over(w) - 1 < merge_gap, 0).otherwise(1)
        blocks = blocks.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        blocks = blocks.groupBy("qname", "flag", "rname", "pos", "island").agg(F.min("block_start").alias("block_start"), F.max("block_end").alias("block_end"))
    return blocks.select("qname", "flag", "rname", "block_start", "block_end")


def cigar_total(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of the operations in ops."""
    return F.aggregate(F.filter(cigar_operations(cigar), lambda x: x["op"].isin(*ops)), F.lit(0).cast("long"), lambda s, x: s + x["n"])


def cigar_totals(sam: DataFrame) -> DataFrame:
    """Soft-clipped, inserted or deleted, and skipped bases of each alignment, by qname and flag, with nm (0 where missing)."""
    total = lambda ops: cigar_total(F.col("cigar"), ops)
    return sam.select("qname", "flag", F.coalesce("nm", F.lit(0)).alias("nm"), total("S").alias("softclip"), total("ID").alias("indel"), total("N").alias("intron"))


def error_clip_histogram(sam: DataFrame) -> DataFrame:
    """Pairs by (indel, mismatch, softclip) summed over both mates, with totals per indel (the others null)."""
    pairs = cigar_totals(sam).groupBy("qname").agg(F.sum("indel").alias("indel"), F.sum("nm").alias("mismatch"), F.sum("softclip").alias("softclip"))
    return pairs.groupingSets([["indel", "mismatch", "softclip"], ["indel"]], "indel", "mismatch", "softclip").agg(F.count("*").alias("pairs"))


def sam_pair_class(sam: DataFrame) -> DataFrame:
    """Class of each read over its rows: 4 both unmapped, 3 one unmapped, 2 a CIGAR with N, 1 otherwise; the last row that says more than 1 wins.

    sam needs line, the order of rows.
    """
    both, one = F.col("flag").bitwiseAND(F.lit(12)) == 12, F.col("flag").bitwiseAND(F.lit(12)) != 0
    kind = F.when(both, 4).when(one, 3).when(F.contains("cigar", F.lit("N")), 2)
    rows = sam.select("qname", "line", kind.alias("kind"))
    return rows.groupBy("qname").agg(F.coalesce(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("line"))), F.lit(1)).alias("class"))


def mapping_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reads (qname, pos1, pos2) of two aligners: both, one or none of the mates within NEAR, in the better mate order."""
    j = a.join(b.select("qname", F.col("pos1").alias("o1"), F.col("pos2").alias("o2")), "qname")
    near = lambda x, y: (F.abs(F.col(x) - F.col(y)) <= NEAR).cast("int")
    n = F.greatest(near("pos1", "o1") + near("pos2", "o2"), near("pos1", "o2") + near("pos2", "o1"))
    return j.select("qname", F.when(n == 2, "both").when(n == 1, "one").otherwise("none").alias("agreement"))


def _alignments(mapped: DataFrame, name: str) -> DataFrame:
    """rid and, under the set's name, its alignments in order: the two mates' starts and ends, the mate of smaller start first."""
    swap = F.col("s2") < F.col("s1")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    one = F.struct("ord", pick("s1", "s2").alias("s1"), pick("e1", "e2").alias("e1"), pick("s2", "s1").alias("s2"), pick("e2", "e1").alias("e2"))
    return mapped.groupBy("rid").agg(F.array_sort(F.collect_list(one)).alias(name))


def three_way_overlap(p: DataFrame, r: DataFrame, g: DataFrame, near: int = NEAR) -> DataFrame:
    """rid, pr, pg, rg and missing: how many of the four coordinates of a read two sets have within less than near of each other.

    p, r, g: rid, ord, s1, e1, s2, e2 (starts and ends of both mates). Where the first set of a pair has several alignments of a read,
    the best of them against the other's first one counts; else the best of the other's against it. Reads that a set lacks have
    no scores, and missing names those sets, from which the counts of skipped reads follow.
    """
    j = _alignments(p, "p").join(_alignments(r, "r"), "rid", "full_outer").join(_alignments(g, "g"), "rid", "full_outer")
    alike = lambda x, y: sum((F.abs(x[c] - y[c]) < near).cast("int") for c in ("s1", "e1", "s2", "e2"))
    best = lambda x, y: F.array_max(F.transform(x, lambda a: alike(a, F.get(y, F.lit(0)))))
    score = lambda x, y: F.when(F.size(x) > 1, best(F.col(x), F.col(y))).otherwise(best(F.col(y), F.col(x)))
    whole = F.col("p").isNotNull() & F.col("r").isNotNull() & F.col("g").isNotNull()
    missing = F.concat_ws(",", *[F.when(F.col(n).isNull(), F.lit(n)) for n in "prg"])
    return j.select("rid", *[F.when(whole, score(x, y)).alias(x + y) for x, y in ("pr", "pg", "rg")], missing.alias("missing"))


def sam_flags(first: Column, mapped: Column, mate_mapped: Column, reverse: Column, mate_reverse: Column, kind: Column) -> Column:
    """SAM flag bits of one mate of a pair of category kind."""
    bits = [(1, F.lit(True)), (2, kind == P.CONCRD), (4, ~mapped), (8, ~mate_mapped), (16, reverse), (32, mate_reverse), (64, first), (128, ~first)]
    out = F.lit(0)
    for bit, cond in bits:
        out = out + F.when(cond, bit).otherwise(0)
    return out


def is_mapped(kind: Column) -> Column:
    return (kind <= P.CHIORF) | kind.isin(P.CONGEN, P.CONGNM)


def sam_mate_fields(pairs: DataFrame) -> DataFrame:
    """rnext, tlen and the sequence as written, for the first mates of pairs (chr1, pos1, rev1, chr2, pos2, seq, insert)."""
    left = F.col("pos1") <= F.col("pos2")
    return pairs.select("id", F.when(F.col("chr1") == F.col("chr2"), "=").otherwise(F.col("chr2")).alias("rnext"), F.when(left, F.col("insert")).otherwise(-F.col("insert")).alias("tlen"), F.when(F.col("rev1"), F.reverse("seq")).otherwise(F.col("seq")).alias("seq"))


def sam_header(contigs: DataFrame) -> DataFrame:
    """@HD and one @SQ line per chromosome, with an order column."""
    hd = contigs.sparkSession.range(1).select(F.lit(0).alias("ord"), F.lit("").alias("chr"), F.lit("@HD\tVN:1.4\tSO:unsorted").alias("line"))
    return hd.unionByName(contigs.select(F.lit(1).alias("ord"), "chr", F.concat(F.lit("@SQ\tSN:"), "chr", F.lit("\tLN:"), F.col("len").cast("string")).alias("line")))


def gene_class(blocks: DataFrame, genes: DataFrame, exons: DataFrame) -> DataFrame:
    """Per read the best of: 3 inside an exon, 2 across an exon's border, 1 in a gene only, 0 intergenic; and the gene (largest id).

    blocks: qname, chr, a_start, a_end.
    """
    e = overlap_join(blocks, exons.select("chr", "gene_id", F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end")).distinct())
    inside = (F.col("a_start") >= F.col("b_start")) & (F.col("a_end") <= F.col("b_end"))
    g = overlap_join(blocks, genes.select("chr", "gene_id", F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end")))
    flags = e.select("qname", "gene_id", F.when(inside, 3).otherwise(2).alias("class")).unionByName(g.select("qname", "gene_id", F.lit(1).alias("class")))
    best = flags.groupBy("qname").agg(F.max(F.struct("class", "gene_id")).alias("b"))
    return blocks.select("qname").distinct().join(best, "qname", "left").select("qname", F.coalesce("b.class", F.lit(0)).alias("class"), F.col("b.gene_id").alias("gene_id"))


def isoform_class(blocks: DataFrame, exons: DataFrame) -> DataFrame:
    """How the chain of a read's blocks (qname, chr, block from 0, a_start, a_end) fits the exons of a transcript: qname, iso_class, trans_id, iso_gene.

    3: the only block lies in an exon. 2: the only block meets an exon, or the last of several blocks meets one that begins
    behind the block before it. 1: some other block meets an exon. 0: none does. The best transcript counts, of equals the one
    of the smallest gene, then the smallest one.
    """
    w = Window.partitionBy("qname", "chr")
    told = blocks.withColumns({"n": F.count("*").over(w), "before": F.lag("a_end").over(w.orderBy("block"))})
    e = exons.select("chr", "gene_id", "trans_id", F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))
    met = overlap_join(told, e)
    inside = (F.col("n") == 1) & (F.col("a_start") >= F.col("b_start")) & (F.col("a_end") <= F.col("b_end"))
    last = (F.col("block") == F.col("n") - 1) & (F.col("before").isNull() | (F.col("b_start") > F.col("before")))
    fit = F.when(inside, 3).when(last, 2).otherwise(1)
    best = met.groupBy("qname", "gene_id", "trans_id").agg(F.max(fit).alias("fit")).groupBy("qname").agg(F.min(F.struct((-F.col("fit")).alias("f"), "gene_id", "trans_id")).alias("b"))
    return blocks.select("qname").distinct().join(best, "qname", "left").select("qname", F.coalesce(-F.col("b.f"), F.lit(0)).alias("iso_class"), F.col("b.trans_id").alias("trans_id"), F.col("b.gene_id").alias("iso_gene"))


def tag_classes(sam: DataFrame) -> DataFrame:
    """class and value, the SAM line with its tags, of rows with line, xc, xd, xv, xy and class."""
    tags = [F.concat(F.lit("XC:i:"), F.col("xc").cast("string")), F.concat(F.lit("XD:i:"), F.col("xd").cast("string")), F.concat(F.lit("XV:i:"), F.col("xv").cast("string")), F.concat(F.lit("XY:Z:"), F.col("xy"))]
    return sam.select("class", F.concat_ws("\t", F.regexp_replace("line", r"\s+$", ""), *tags).alias("value"))


def write_classes(tagged: DataFrame, path: str) -> None:
    """One dataset of lines for each class (column class), each task appending to those it has rows of."""
    tagged.select("class", "value").write.partitionBy("class").text(path)


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """class, the fields of the lines that every line has, and their tags by name."""
    lines = spark.read.text(path).select("class", F.split("value", "\t").alias("f"))
    tag = lambda x: F.split(x, ":", 3)
    tags = F.map_from_entries(F.transform(F.filter("f", lambda x: x.rlike("^X[A-Z]:[iZ]:")), lambda x: F.struct(tag(x)[0].alias("k"), tag(x)[2].alias("v"))))
    return lines.select("class", F.get("f", F.lit(0)).alias("qname"), F.get("f", F.lit(1)).cast("int").alias("flag"), tags.alias("tags"))


def truth_candidates(calls: DataFrame, truth: DataFrame, near: int = NEAR) -> DataFrame:
    """Calls with the true events of the chromosome whose both ends lie within near.

    Truth is filed by the start's bin, and a call looks into its own bin and both next to it.
    """
    width = 2 * near + 1
    c = calls.withColumn("bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("start_pos") / width) + d)))
    t = truth.select(F.col("chr").alias("t_chr"), F.col("start_pos").alias("t_start"), F.col("end_pos").alias("t_end"), "label", F.floor(F.col("start_pos") / width).alias("t_bin"))
    on = (F.col("chr") == F.col("t_chr")) & (F.col("bin") == F.col("t_bin")) & (F.abs(F.col("start_pos") - F.col("t_start")) <= near) & (F.abs(F.col("end_pos") - F.col("t_end")) <= near)
    return c.join(t, on).drop("bin", "t_bin", "t_chr")


def truth_match(calls: DataFrame, truth: DataFrame, near: int = NEAR) -> DataFrame:
    """One-to-one greedy match in the order of calls (start, end): each takes the first unused true event within near, or is a false positive.

    All events prefer earlier calls, so that the match is the only stable one, and proposals find it in rounds: every call
    proposes to the first event that it has left, and an event holds the earliest call that proposed and turns down all later ones. A
    round is a few aggregations over the pairs that are left, and chromosomes or dense stretches are never put in order. There are at
    most as many rounds as calls that compete in a chain.
    """
    pairs = truth_candidates(calls.select("chr", "start_pos", "end_pos").distinct(), truth, near)
    pairs = stored(pairs.select("chr", F.struct("start_pos", "end_pos").alias("call"), F.struct(F.col("t_start").alias("start_pos"), F.col("t_end").alias("end_pos")).alias("event")).distinct())
    n = pairs.count()
    while True:
        asked = pairs.groupBy("chr", "call").agg(F.min("event").alias("event"))
        held = asked.groupBy("chr", "event").agg(F.min("call").alias("holder"))
        pairs = stored(pairs.join(held, ["chr", "event"], "left").where("holder IS NULL OR call <= holder").drop("holder"))
        left = pairs.count()
        if left == n:
            break
        n = left
    matched = pairs.groupBy("chr", "call").agg(F.min("event").alias("event")).select("chr", "call.*", F.col("event.start_pos").alias("t_start"), F.col("event.end_pos").alias("t_end"))
    keys = ["chr", "start_pos", "end_pos"]
    return calls.select(*keys).distinct().join(matched, keys, "left").withColumn("verdict", F.when(F.col("t_start").isNull(), "FP").otherwise("TP"))


def read_event_verdict(reads: DataFrame, reported: DataFrame, truth: DataFrame) -> DataFrame:
    """What became of each true read (rname, event): not_found, correct, incorrect_existing_event or incorrect_nonexisting_event."""
    got = reads.join(reported.select("rname", F.col("event").alias("found")), "rname", "left")
    known = truth.select(F.col("event").alias("found")).distinct().withColumn("exists", F.lit(True))
    verdict = F.when(F.col("found").isNull(), "not_found").when(F.col("found") == F.col("event"), "correct").when(F.col("exists"), "incorrect_existing_event").otherwise("incorrect_nonexisting_event")
    return got.join(known, "found", "left").select("rname", verdict.alias("verdict"))


def running_counts(rows: DataFrame, key: str, order: str, flags: dict[str, Column], size: int = STRETCH) -> DataFrame:
    """rows with running counts of flags along order within key: those at or before each row.

    Rows are counted for each stretch of size positions first; the few counts, summed over the stretches before it, are added to
    counts within a stretch, so that a long key goes to many tasks.
    """
    cut = rows.withColumns({"stretch": F.floor(F.col(order) / size), **{f: c.cast("long") for f, c in flags.items()}})
    per = cut.groupBy(key, "stretch").agg(*[F.sum(f).alias(f) for f in flags])
    so_far = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(key, "stretch", *[F.coalesce(F.sum(f).over(so_far), F.lit(0)).alias(f"{f}_before") for f in flags])
    within = Window.partitionBy(key, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = cut.join(per, [key, "stretch"])
    return counted.select(*rows.columns, *[(F.sum(f).over(within) + F.col(f"{f}_before")).alias(f) for f in flags])


def parse_sim_log(lines: DataFrame, size: int = STRETCH) -> DataFrame:
    """Simulator log (columns log, line, value) to events: event, gene_id, trans_id, spliced_len, declared, reads, split_reads.

    ``> n rid`` begins a read, ``** mate s1 s2`` adds a split mate to it, ``summary: gid tid event len support`` closes the event.
    Which event a line is of is how many events close before it; the reads that begin up to it tell the read (running_counts).
    """
    c = F.split("value", " ")
    kind = F.when(F.col("value").startswith("> "), "read").when(F.col("value").startswith("** "), "split").when(F.col("value").startswith("summary: "), "event")
    rows = lines.select("log", "line", "value", kind.alias("kind")).where("kind IS NOT NULL")
    numbered = running_counts(rows, "log", "line", {"e": F.col("kind") == "event", "r": F.col("kind") == "read"}, size)
    numbered = numbered.withColumn("e", F.col("e") - (F.col("kind") == "event").cast("long"))
    per_read = numbered.where("kind <> 'event'").groupBy("log", "e", "r").agg(F.sum((F.col("kind") == "split").cast("long")).alias("splits"))
    per_event = per_read.groupBy("log", "e").agg(F.count("*").alias("reads"), F.sum((F.col("splits") > 0).cast("long")).alias("split_reads"))
    closed = numbered.where("kind = 'event'").select("log", "e", c[3].alias("event"), c[1].alias("gene_id"), c[2].alias("trans_id"), c[4].cast("long").alias("spliced_len"), c[5].cast("long").alias("declared"))
    return closed.join(per_event, ["log", "e"], "left").na.fill(0, ["reads", "split_reads"]).drop("e")


def event_support(events: DataFrame) -> DataFrame:
    """event, declared, split_reads and whether they are the same, of the events of a log."""
    return events.select("event", "declared", "split_reads", (F.col("declared") == F.col("split_reads")).alias("matches"))


def parse_ciri_table(rows: DataFrame) -> DataFrame:
    """event, split_reads (half the brackets of the first list), pair_reads (&& marked) and reads (distinct, of both lists)."""
    a, b = F.col("split_list"), F.col("pair_list")
    names = lambda x: F.filter(F.split(F.regexp_replace(x, r"\([^)]*\)|&&", ""), ","), lambda y: y != "")
    return rows.select("event", F.floor((F.length(a) - F.length(F.replace(a, F.lit("("), F.lit("")))) / 2).alias("split_reads"), F.regexp_count(b, F.lit("&&")).alias("pair_reads"), F.array_join(F.array_sort(F.array_union(names(a), names(b))), ",").alias("reads"))
