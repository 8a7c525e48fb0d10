"""Read-level columns and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..params import DEFAULT
from .intervals import point_join
from .tables import stored

#: Width of the bins in which positions on contigs meet the chromosomes there.
CONTIG_BIN = 4_096


def revcomp(seq: Column) -> Column:
    """Reverse complement in upper case; N stays."""
    return F.translate(F.reverse(F.upper(seq)), "ACGTN", "TGCAN")


def subsequence(seq: Column, start: Column, length: Column) -> Column:
    """1-based substring; null where it leaves the sequence."""
    return F.when((start >= 1) & (length >= 0) & (start + length - 1 <= F.length(seq)), F.substr(seq, start.cast("int"), length.cast("int")))


def splice_signals(seq: Column, q: Column, ref: Column, start: Column, end: Column) -> dict[str, Column]:
    """Two read bases on either side of the cut before base q, and the reference's at start and up to end; empty near the ends."""
    get = lambda s, at: F.coalesce(subsequence(s, at, F.lit(2)), F.lit(""))
    return {"end_signal": get(seq, q - 2), "start_signal": get(seq, q), "ref_start": get(ref, start), "ref_end": get(ref, end - 1)}


def mate_status(left_ok: Column, right_ok: Column, errors: Column, clips: Column) -> Column:
    return F.when(left_ok & right_ok & (errors <= DEFAULT.max_edit) & (clips <= DEFAULT.max_clip), P.CONCRD).when(left_ok | right_ok, P.CANDID).otherwise(P.ORPHAN)


def scan_skip(level: Column, kind: Column, gm: Column, ed: Column, full: Column) -> Column:
    """Whether a read needs no further look at a scan level."""
    ok = kind == P.CONCRD
    return ((level == 0) & ok) | ((level == 1) & ok & gm & (ed == 0) & full)


def unmapped_class(chains1: Column, chains2: Column, capped1: Column, capped2: Column) -> Column:
    """Class of a pair without chains on both mates; null where both have chains."""
    none = (chains1 == 0) & (chains2 == 0)
    return F.when(none & (capped1 > 0) & (capped2 > 0), P.MANYHIT).when(none, P.NOMATCH).when((chains1 == 0) | (chains2 == 0), P.OEANCH)


def final_mate_class(saved: Column, kind1: Column, kind2: Column, genic1: Column, genic2: Column) -> Column:
    """Category of a pair that nothing explains, kept only if it is smaller than what was saved."""
    both, one = (kind1 == P.CONCRD) & (kind2 == P.CONCRD), (kind1 == P.CONCRD) | (kind2 == P.CONCRD)
    orphan = (kind1 == P.ORPHAN) | (kind2 == P.ORPHAN)
    kind = F.when(orphan & one, P.OEANCH).when(orphan, P.ORPHAN).when(both & genic1 & genic2, P.CHIFUS).when(both, P.OEA2).otherwise(P.CANDID)
    return F.least(saved, kind)


def remaining_query(mates: DataFrame, window: int = DEFAULT.window) -> DataFrame:
    """The longer unmapped side of each partial mate (qspos, qepos, qlen), as rem_start, rem_end; shorter than window: dropped."""
    before, after = F.col("qspos") - 1, F.col("qlen") - F.col("qepos")
    head = before >= after
    out = mates.withColumns({"rem_start": F.when(head, F.lit(1)).otherwise(F.col("qepos") + 1), "rem_end": F.when(head, before).otherwise(F.col("qlen"))})
    return out.where(F.col("rem_end") - F.col("rem_start") + 1 >= window)


def softclip_sides(qspos: Column, qepos: Column, qlen: Column, partial: Column) -> dict[str, Column]:
    """Clipped bases at either end; of a partial mate only the shorter side counts."""
    left, right = qspos - 1, qlen - qepos
    return {"left": F.when(partial & (left > right), 0).otherwise(left), "right": F.when(partial & (left <= right), 0).otherwise(right)}


def middle_error_estimate(frags: Column, band: int = DEFAULT.band) -> Column:
    """Over the gaps between neighbouring fragments: 1 without a diagonal shift, the shift if within band, else nothing."""
    n = F.size(frags)

    def cost(i: Column) -> Column:
        a, b = F.element_at(frags, i), F.element_at(frags, i + 1)
        shift = F.abs((b["rpos"] - a["rpos"]) - (b["qpos"] - a["qpos"]))
        gap = b["qpos"] - a["qpos"] - a["len"]
        return F.when(gap <= 0, 0).when(shift == 0, 1).when(shift <= band, shift).otherwise(0)

    return F.when(n < 2, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0).cast("long"), lambda s, i: s + F.when(i < n, cost(F.least(i, F.greatest(n - 1, F.lit(1))))).otherwise(0)))


def full_length_concordant(frags: Column, read_length: Column) -> Column:
    """Two fragments or more that reach over the whole read."""
    first, last = F.try_element_at(frags, F.lit(1)), F.try_element_at(frags, F.lit(-1))
    return (F.size(frags) >= 2) & (last["qpos"] + last["len"] - first["qpos"] >= read_length)


def split_edit_gate(kind: Column, edits: list[Column], most: int = DEFAULT.max_edit) -> Column:
    return F.when(sum(edits) > most, P.UD).otherwise(kind)


def contig_to_chr(positions: DataFrame, contig_map: DataFrame) -> DataFrame:
    """Positions (contig_id, pos) on contigs as positions on chromosomes. The map has a row per chromosome; a position meets those in
    its bin of the contig, so that a contig of many chromosomes is no hot key."""
    spans = contig_map.select(F.col("contig_id").alias("chr"), F.col("chr").alias("name"), "start_pos", "end_pos").where("end_pos >= start_pos")
    held = point_join(positions.withColumnRenamed("contig_id", "chr"), spans, width=CONTIG_BIN)
    return held.select("id", F.col("name").alias("chr"), (F.col("pos") - F.col("start_pos") + 1).alias("chr_pos"))


def chr_to_contig(positions: DataFrame, contig_map: DataFrame) -> DataFrame:
    """Positions (chr, chr_pos) as positions on contigs; unknown chromosomes drop out."""
    return positions.join(contig_map, "chr").select("id", "contig_id", (F.col("chr_pos") + F.col("start_pos") - 1).alias("pos"))


def _reached(following: DataFrame) -> DataFrame:
    """The places (at, from 0) that following (at, to beyond at) leads to from place 0, with their number n (from 1).

    Steps are doubled: those of 2^k places lead from what was reached in k rounds to as much again.
    """
    spark = following.sparkSession
    found = spark.range(1).select(F.col("id").alias("at"), F.lit(1).cast("long").alias("n"))
    steps, size = following, 1
    while True:
        more = stored(found.join(steps, "at").select(F.col("to").alias("at"), (F.col("n") + size).alias("n")))
        if more.isEmpty():
            return found
        found = stored(found.unionByName(more))
        steps = stored(steps.join(steps.select(F.col("at").alias("to"), F.col("to").alias("then")), "to").select("at", F.col("then").alias("to")))
        size *= 2


def pack_contigs(chromosomes: DataFrame, size: int = DEFAULT.contig_size, spacer: int = DEFAULT.spacer) -> DataFrame:
    """Next-fit packing of chromosomes (ord, chr, len) into contigs: contig_id, chr, start_pos, end_pos. No length is null.

    With running sums of lengths it is known, for every chromosome, which one would begin the next contig if it began one itself;
    the contigs that there are follow from the first one by doubling these steps. Sums are taken within ranges of the order first,
    so that no task holds all chromosomes.
    """
    # written first, as the ranges are drawn from what is then dealt
    dealt = stored(chromosomes.select("ord", "chr", F.col("len").cast("long").alias("len"))).repartitionByRange("ord", "chr").sortWithinPartitions("ord", "chr")
    dealt = stored(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    per = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("len") + spacer).alias("bases"), F.min("row").alias("least"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    per = per.select("part", "least", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "bases")])
    so_far = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("len") + spacer).over(so_far) + F.col("bases_before")
    rows = dealt.join(F.broadcast(per), "part").select("chr", "len", (F.col("row") - F.col("least") + F.col("n_before")).alias("at"), end.alias("end"))
    rows = stored(rows)
    one = F.lit("").alias("chr")
    begins = F.col("end") - F.col("len") - spacer
    # the chromosome over the first base that a contig from here on has no room for
    full = rows.where("len > 0").select(one, "at", (begins + size + spacer).alias("pos"))
    spans = rows.select(one, F.col("at").alias("to"), begins.alias("start_pos"), (F.col("end") - 1).alias("end_pos")).where("end_pos >= start_pos")
    past = point_join(full, spans, width=max(1, size // 64)).select("at", F.greatest("to", F.col("at") + 1).alias("to"))
    # an empty chromosome that begins a contig stays alone in it
    past = past.unionByName(rows.where("len = 0").select("at", (F.col("at") + 1).alias("to")))
    last = rows.agg(F.max("at").alias("last"))
    following = stored(past.join(F.broadcast(last), F.col("to") <= F.col("last")).select("at", "to"))
    first = stored(_reached(following).join(following, "at", "left").join(rows.select("at", begins.alias("origin")), "at").join(F.broadcast(last)))
    contigs = first.select(one, F.col("n").cast("int").alias("contig_id"), F.col("at").alias("start_pos"), F.coalesce(F.col("to") - 1, F.col("last")).alias("end_pos"), "origin")
    packed = point_join(rows.select(one, F.col("chr").alias("name"), "at", "len", begins.alias("begins")), contigs, "at")
    begin = F.col("begins") - F.col("origin")
    return packed.select("contig_id", F.col("name").alias("chr"), (begin + 1).alias("start_pos"), (begin + F.col("len")).alias("end_pos"))


def parse_carried(headers: DataFrame, tokens: int = 23) -> DataFrame:
    """State of an earlier round in read headers (column value): 23 tokens are a mapping, anything else a read without match."""
    c = F.split("value", " ")
    full = F.size(c) == tokens
    return headers.select(c[0].alias("rname"), F.when(full, F.get(c, 1).cast("long")).alias("genome_spos"), F.when(full, F.get(c, 2).cast("int")).otherwise(P.NOMATCH).alias("type"), F.when(full, F.get(c, 3)).alias("chr1"), F.when(full, F.get(c, 4).cast("long")).alias("spos1"))


def carried_state(mapped: DataFrame, last: bool, paired: bool = True) -> DataFrame:
    """Reads that go on to the next round, or in the last one to the calling of back-splices."""
    if paired:
        return mapped.where(~F.col("skip") & (F.col("type").isin(P.CHIBSJ, P.CHI2BSJ) if last else F.lit(True)))
    return mapped.where(F.lit(not last) & (F.col("type") != P.CONCRD))


def chain_keep_prefix(chains: DataFrame) -> DataFrame:
    """Chains (id, ord, missing) before the first one with more missing k-mers than the chain before it."""
    w = Window.partitionBy("id").orderBy("ord")
    worse = F.coalesce((F.col("missing") > F.lag("missing").over(w)).cast("int"), F.lit(0))
    marked = chains.withColumn("worse", worse)
    return marked.withColumn("stop", F.max("worse").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("stop = 0").drop("worse", "stop")
