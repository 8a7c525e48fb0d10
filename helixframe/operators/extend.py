"""Chains drawn out to whole reads along transcripts, and the classes of mates and pairs that follow from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..params import DEFAULT, Params
from .annotation import insert_size
from .intervals import point_join
from .pairs import mate_pair_candidates
from .pairwise import clip_aligned, edit_distance
from .reads import final_mate_class, mate_status, unmapped_class
from .report import best_mapping
from .seeds import PIECE, pieces
from .spans import detect_chimeric, explain_concordant, junction_list, left_mate_order, pair_facts, transcript_walk
from .tables import stored

#: A bound that no position reaches.
FAR = 1 << 40


def cut_genome(genome: DataFrame) -> DataFrame:
    """Pieces of a genome (chr, at, seq), written once, that all operators here take in its place."""
    return stored(pieces(genome.select("chr", F.upper("seq").alias("seq")), 0, "chr"))


def bases(spans: DataFrame, genome: DataFrame, *keys: str) -> DataFrame:
    """spans (keys, which are unique, chr, pos, len) with the column bases, short or empty where a chromosome ends.

    The genome is cut into pieces, if it is not yet (cut_genome), that spans meet in a join on chromosome and offset, so that no
    task holds a chromosome.
    """
    cut = genome if "at" in genome.columns else pieces(genome.select("chr", F.upper("seq").alias("seq")), 0, "chr")
    first, last = F.greatest(F.col("pos"), F.lit(1)), F.col("pos") + F.col("len") - 1
    asked = spans.select(*keys, "chr", first.alias("a"), last.alias("b")).where("b >= a")
    asked = asked.withColumn("at", F.explode(F.sequence(F.floor((F.col("a") - 1) / PIECE) * PIECE, F.floor((F.col("b") - 1) / PIECE) * PIECE, F.lit(PIECE).cast("long"))))
    start = F.greatest(F.col("a") - F.col("at"), F.lit(1))
    part = F.substr("seq", start.cast("int"), (F.least(F.col("b") - F.col("at"), F.lit(PIECE)) - start + 1).cast("int"))
    parts = asked.join(cut, ["chr", "at"]).select(*keys, F.struct("at", part.alias("part")).alias("x"))
    whole = parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("bases"))
    return spans.join(whole, list(keys), "left").withColumn("bases", F.coalesce("bases", F.lit("")))


def _clip_aligned(p: Params):
    @F.pandas_udf("clip int, indel int, ed int, whole boolean")
    def run(q: pd.Series, ref: pd.Series, edits: pd.Series, stops: pd.Series) -> pd.DataFrame:
        found = clip_aligned(q.tolist(), ref.tolist(), edits.to_numpy(), [np.asarray(s) for s in stops], p.max_clip, p.band)
        none = found[:, 2] < 0
        columns = {name: pd.arrays.IntegerArray(found[:, i].astype(np.int32), none) for i, name in enumerate(("clip", "indel", "ed"))}
        return pd.DataFrame({**columns, "whole": found[:, 3] == 1})

    return run


def extend_alignment(anchors: DataFrame, trans_seg: DataFrame, genome: DataFrame, right: bool = True, p: Params = DEFAULT) -> DataFrame:
    """The best alignment of what a read has beyond its last matched base (before the first one, if not right).

    anchors: id, chr, pos (that base), seq (the bases left over, in the order of the genome), edits (allowed), bound (no path
    goes beyond it), tids (transcripts to follow; all, if empty). Paths run along every transcript with a segment at pos, and
    straight on, as where an intron is kept. The end of the read may be clipped. A transcript counts before none; the best has the
    least clip and twice the edits, then the fewest edits, the nearest end, and the first transcript. Where nothing reaches the end of
    the read within the limits, what reaches the end of an exon counts: the most bases less twice the edits. Such an anchor is
    ok only if what is left of the read may be clipped.

    Per anchor: id, ok, pos (last base reached), ed, clip, covered (bases of the read), trans_id (null if straight on). Without
    bases left over an anchor is ok as it is; where no exon's end is within the limits either, ok is false and pos stays.
    """
    sign = 1 if right else -1
    n = F.length("seq")
    todo = anchors.where(n > 0)
    need = (n + p.band + 1).cast("long")
    walk = transcript_walk(todo.select("id", "chr", "pos", need.alias("need"), "bound"), trans_seg, right).join(todo.select("id", "chr", "tids"), "id")
    walk = walk.where((F.size("tids") == 0) | F.array_contains("tids", F.col("trans_id"))).select("id", F.col("trans_id").cast("string").alias("path"), "ord", "chr", "pos", "len")
    room = (F.col("bound") - F.col("pos")) * sign + 1
    length = F.greatest(F.least(need, room), F.lit(1).cast("long"))
    straight = todo.select("id", F.lit("").alias("path"), F.lit(1).alias("ord"), "chr", (F.col("pos") if right else F.col("pos") - length + 1).alias("pos"), length.alias("len"))
    turn = (lambda x: x) if right else F.reverse
    found = bases(walk.unionByName(straight), genome, "id", "path", "ord").withColumn("bases", turn(F.col("bases")))
    paths = found.groupBy("id", "path").agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "len", "bases"))).alias("steps"))
    # transcripts that go the same way are aligned once
    paths = paths.groupBy("id", "steps").agg(F.min(F.struct((F.col("path") == "").alias("bare"), "path")).alias("by"))
    ref = F.substring(F.array_join(F.transform("steps", lambda x: x["bases"]), ""), 2, 1 << 30)
    # ends of exons before the end of the read: where the next step isn't the next base, or none follows
    ends = F.transform("steps", lambda x: x["pos"] + x["len"] - 1 if right else x["pos"])
    begins = F.transform("steps", lambda x: x["pos"] if right else x["pos"] + x["len"] - 1)
    far = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.aggregate(F.slice("steps", 1, k), F.lit(-1).cast("long"), lambda t, x: t + x["len"]).cast("int"))
    is_end = F.zip_with(F.slice(begins, 2, F.size("steps")), ends, lambda x, y: F.coalesce(x != y + sign, F.lit(True)))
    stops = F.filter(far, lambda x, k: F.get("is_end", k) & (x > 0) & (x < n + p.band))
    todo_seq = todo.select("id", turn(F.col("seq")).alias("seq"), "edits")
    tried = paths.join(todo_seq, "id").withColumn("is_end", is_end).withColumn("stops", F.when(F.col("by.bare"), F.array().cast("array<int>")).otherwise(stops))
    tried = tried.withColumn("al", _clip_aligned(p)(F.col("seq"), ref, F.col("edits"), F.col("stops"))).where("al.ed IS NOT NULL")

    def step(t: Column, x: Column) -> Column:
        take = F.least(t["rest"], x["len"])
        end = x["pos"] + take - 1 if right else x["pos"] + x["len"] - take
        return F.struct((t["rest"] - take).alias("rest"), F.when(take > 0, end).otherwise(t["at"]).alias("at"))

    reach = (n - F.col("al.clip") + F.col("al.indel") + 1).cast("long")
    at = F.aggregate("steps", F.struct(reach.alias("rest"), F.lit(0).cast("long").alias("at")), step)["at"]
    key = F.struct((~F.col("al.whole")).alias("short"), F.col("by.bare").alias("bare"), (F.col("al.ed") * 2 + F.col("al.clip")).alias("cost"), F.col("al.ed").alias("ed"), (at * sign).alias("near"), F.col("by.path").alias("path"), F.col("al.clip").alias("clip"))
    best = tried.groupBy("id").agg(F.min(key).alias("b"))
    hit = F.col("b").isNotNull()
    ok = (hit & (~F.col("b.short") | (F.col("b.clip") <= p.max_clip))) | (n == 0)
    out = anchors.join(best, "id", "left")
    return out.select(
        "id",
        ok.alias("ok"),
        F.coalesce(F.col("b.near") * sign, F.col("pos")).alias("pos"),
        F.coalesce("b.ed", F.lit(0)).alias("ed"),
        F.when(ok, F.coalesce("b.clip", F.lit(0))).otherwise(0).alias("clip"),
        F.when(hit, n - F.col("b.clip")).otherwise(0).alias("covered"),
        F.when(hit & ~F.col("b.bare"), F.col("b.path")).alias("trans_id"),
    )


def middle_edit(chains: DataFrame, genome: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """id and middle_ed of chains (id, chr, seq, frags): the edits between fragments whose distances in read and genome are alike
    within the band. Between others lies a junction, which costs nothing here."""
    two = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("frags") - 1), lambda i: F.struct(F.element_at("frags", i).alias("a"), F.element_at("frags", i + 1).alias("b"))))
    gaps = chains.where(F.size("frags") > 1).select("id", "chr", "seq", two.alias("k", "g"))
    qpos, rpos = F.col("g.a.qpos") + F.col("g.a.len"), F.col("g.a.rpos") + F.col("g.a.len")
    gaps = gaps.select("id", "k", "chr", rpos.alias("pos"), (F.col("g.b.rpos") - rpos).alias("len"), F.substr("seq", (qpos + 1).cast("int"), (F.col("g.b.qpos") - qpos).cast("int")).alias("between"), (F.col("g.b.qpos") - qpos).alias("n"))
    gaps = gaps.where((F.col("n") > 0) & (F.abs(F.col("len") - F.col("n")) <= p.band))
    cost = bases(gaps, genome, "id", "k").groupBy("id").agg(F.sum(edit_distance(F.col("between"), F.col("bases"))).cast("int").alias("middle_ed"))
    return chains.select("id").join(cost, "id", "left").select("id", F.coalesce("middle_ed", F.lit(0)).alias("middle_ed"))


def _side(chains: DataFrame, trans_seg: DataFrame, genome: DataFrame, right: bool, p: Params) -> DataFrame:
    """chains with one side drawn out: left_ok, left_ed, clip_left, left_rest (bases lost) and spos, or their like on the right.

    spent counts the edits of a chain so far.
    """
    first, last = F.element_at("frags", 1), F.element_at("frags", -1)
    tail = last["qpos"] + last["len"]
    pos = last["rpos"] + last["len"] - 1 if right else first["rpos"]
    rest = F.substr("seq", (tail + 1).cast("int"), F.length("seq")) if right else F.left("seq", first["qpos"].cast("int"))
    anchors = chains.select("id", "chr", pos.cast("long").alias("pos"), rest.alias("seq"), (F.lit(p.max_edit) - F.col("spent")).alias("edits"), F.col("upper" if right else "lower").alias("bound"), "tids")
    got = extend_alignment(anchors, trans_seg, genome, right, p)
    name = "right" if right else "left"
    n = (F.length("seq") - tail if right else first["qpos"]).cast("int")
    out = chains.join(got.withColumnsRenamed({"ok": f"{name}_ok", "pos": "epos" if right else "spos", "ed": f"{name}_ed", "clip": f"clip_{name}"}).drop("trans_id"), "id")
    return stored(out.withColumns({f"rest_{name}": F.greatest(n - F.col("covered"), F.lit(0)), "spent": F.col("spent") + F.col(f"{name}_ed")}).drop("covered"))


def _begin(chains: DataFrame, genome: DataFrame, p: Params) -> DataFrame:
    has = set(chains.columns)
    more = {"lower": F.lit(1).cast("long"), "upper": F.lit(FAR).cast("long"), "tids": F.array().cast("array<long>")}
    out = chains.withColumns({c: x for c, x in more.items() if c not in has}).join(middle_edit(chains, genome, p), "id")
    return stored(out.withColumn("spent", F.col("middle_ed")))


def _mates(sides: DataFrame, p: Params) -> DataFrame:
    """What is known of mates once both sides are drawn out; type as mate_status has it, ORPHAN if the middle has too many edits."""
    clips = F.greatest("clip_left", "clip_right")
    kind = F.when(F.col("middle_ed") > p.max_edit, P.ORPHAN).otherwise(mate_status(F.col("left_ok"), F.col("right_ok"), F.col("spent"), clips))
    n = F.length("seq")
    return sides.select(
        "id", "chr", "spos", "epos", (F.col("rest_left") + 1).alias("qspos"), (n - F.col("rest_right")).alias("qepos"),
        (n - F.col("rest_left") - F.col("rest_right")).alias("mlen"), "middle_ed", "left_ed", "right_ed", "clip_left", "clip_right", "left_ok", "right_ok", kind.cast("int").alias("type"),
    )


def extend_mate(chains: DataFrame, trans_seg: DataFrame, genome: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Chains (id, chr, seq on their strand, frags of qpos, rpos, len) drawn out to both ends: spos, epos, qspos and qepos (from 1),
    mlen, edits and clips of each side, whether each side reaches the end of the read, and type."""
    left = _side(_begin(chains, genome, p), trans_seg, genome, False, p)
    return _mates(_side(left, trans_seg, genome, True, p), p)


def extend_pair(left: DataFrame, right: DataFrame, trans_seg: DataFrame, genome: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Pairs of chains (both frames as of extend_mate, a pair under one id) drawn out: the columns of extend_mate with 1 and 2.

    The right mate does not reach before the left one begins, and the left one not beyond where the right one ends.
    """
    a = _side(_begin(left, genome, p), trans_seg, genome, False, p)
    b = stored(_begin(right, genome, p).drop("lower").join(a.select("id", F.col("spos").alias("lower")), "id"))
    b = _side(_side(b, trans_seg, genome, False, p), trans_seg, genome, True, p)
    a = _side(stored(a.drop("upper").join(b.select("id", F.col("epos").alias("upper")), "id")), trans_seg, genome, True, p)
    name = lambda f, k: f.select("id", *[F.col(c).alias(f"{c}{k}") for c in f.columns if c != "id" and not (c == "chr" and k == 2)])
    return name(_mates(a, p), 1).join(name(_mates(b, p), 2), "id").withColumnRenamed("chr1", "chr")


def classify_single(reads: DataFrame, mates: DataFrame) -> DataFrame:
    """rname and type of single reads: the best type of their mates (rname, type), ORPHAN for reads without any."""
    best = mates.groupBy("rname").agg(F.min("type").alias("type"))
    return reads.select("rname").distinct().join(best, "rname", "left").select("rname", F.coalesce("type", F.lit(P.ORPHAN)).alias("type"))


def split_realign(splits: DataFrame, trans_seg: DataFrame, genome: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Reads aligned again on both sides of a back-splice: id, ok, ed, spos and epos (as far as the read reaches).

    splits: id, chr, seq, cut (bases of the read up to the back-splice), spos and epos (of the circle), tids. The part before the
    cut ends at epos, the other one begins at spos; the bases at the ends count as they are, neither part leaves the circle, and
    ok are those with no more than the limit of edits in all.
    """
    n = F.length("seq")
    inside = splits.where((F.col("cut") > 0) & (F.col("cut") < n))
    ends = inside.select("id", F.lit(1).alias("k"), "chr", F.col("epos").alias("pos"), F.lit(1).alias("len")).unionByName(inside.select("id", F.lit(2).alias("k"), "chr", F.col("spos").alias("pos"), F.lit(1).alias("len")))
    at = bases(ends, genome, "id", "k").groupBy("id").agg(*[F.max(F.when(F.col("k") == k, F.col("bases"))).alias(f"base{k}") for k in (1, 2)])
    cut = F.col("cut").cast("int")
    j = inside.join(at, "id").withColumns({"off1": (F.upper(F.substr("seq", cut, F.lit(1))) != F.col("base1")).cast("int"), "off2": (F.upper(F.substr("seq", cut + 1, F.lit(1))) != F.col("base2")).cast("int")})
    j = stored(j)
    parts = {
        False: j.select("id", "chr", F.col("epos").alias("pos"), F.left("seq", cut - 1).alias("seq"), (F.lit(p.max_edit) - F.col("off1")).alias("edits"), F.col("spos").alias("bound"), "tids"),
        True: j.select("id", "chr", F.col("spos").alias("pos"), F.substr("seq", cut + 2, n).alias("seq"), (F.lit(p.max_edit) - F.col("off2")).alias("edits"), F.col("epos").alias("bound"), "tids"),
    }
    a, b = (extend_alignment(parts[r], trans_seg, genome, r, p).select("id", F.col("ok").alias(f"ok{k}"), F.col("pos").alias(f"pos{k}"), F.col("ed").alias(f"ed{k}")) for k, r in ((1, False), (2, True)))
    done = j.select("id", "off1", "off2").join(a, "id").join(b, "id").withColumn("ed", F.col("off1") + F.col("off2") + F.col("ed1") + F.col("ed2"))
    ok = F.col("ok1") & F.col("ok2") & (F.col("ed") <= p.max_edit)
    return splits.select("id").join(done, "id", "left").select("id", F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, F.col("ed")).alias("ed"), F.when(ok, F.col("pos1")).alias("spos"), F.when(ok, F.col("pos2")).alias("epos"))


def rescue_overlap(mates: DataFrame, trans_seg: DataFrame, genome: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Whole mates that lie over a breakpoint of the circle that the other mate shows, cut there and aligned again within it.

    mates: id, chr, seq, m_start, m_end, matched_len (of the whole mate), qspos (from 1), spos, epos (of the circle), tids. A mate
    over the circle's start is cut where a junction of it ends there, or else as far from its start as the breakpoint is; one
    over the circle's end where a junction begins there, or else as far from its end. id, side (start or end) and cut of the
    first way that fits, with what split_realign gives; mates that none fits are left out.
    """
    over = {
        "start": (F.col("spos") <= F.col("m_end")) & (F.col("spos") > F.col("m_start")),
        "end": (F.col("epos") >= F.col("m_start")) & (F.col("epos") < F.col("m_end")),
    }
    at = junction_list(mates.where(over["start"] | over["end"]).select("id", "chr", F.col("m_start").alias("spos"), F.col("m_end").alias("epos"), "matched_len"), trans_seg)
    j = mates.join(at.select("id", "junc_start", "junc_end", "covered"), "id", "left").groupBy(*mates.columns).agg(
        F.max(F.when(F.col("junc_end") == F.col("spos"), F.col("covered"))).alias("c_start"), F.max(F.when(F.col("junc_start") == F.col("epos"), F.col("covered"))).alias("c_end")
    )
    plain = {"start": F.col("spos") - F.col("m_start"), "end": F.col("matched_len") - (F.col("m_end") - F.col("epos"))}
    tries = [j.where(over[s]).withColumns({"side": F.lit(s), "cut": F.coalesce(f"c_{s}", plain[s]) + F.col("qspos") - 1}) for s in ("start", "end")]
    both = stored(tries[0].unionByName(tries[1]).withColumn("mate_id", F.col("id")).withColumn("id", F.struct("mate_id", "side")))
    got = split_realign(both.select("id", "chr", "seq", "cut", "spos", "epos", "tids"), trans_seg, genome, p).where("ok")
    rows = both.select("id", "cut").join(got, "id").select(F.col("id.mate_id").alias("id"), F.struct((F.col("id.side") == "end").alias("later"), F.col("id.side").alias("side"), "cut", "ed", "spos", "epos").alias("w"))
    return rows.groupBy("id").agg(F.min("w").alias("w")).select("id", "w.side", "w.cut", "w.ed", "w.spos", "w.epos")


def chain_facts(chains: DataFrame, exons: DataFrame, genes: DataFrame) -> DataFrame:
    """chains (id, chr, frags) with pos, end_pos (one beyond the last base), trans_ids and gene_id, of the exons and the gene at either end."""
    first, last = F.element_at("frags", 1), F.element_at("frags", -1)
    out = chains.withColumns({"pos": first["rpos"], "end_pos": last["rpos"] + last["len"]})
    ends = out.select("id", "chr", F.explode(F.array("pos", F.col("end_pos") - 1)).alias("at"))
    trans = point_join(ends, exons.select("chr", "trans_id", "start_pos", "end_pos"), "at").groupBy("id").agg(F.collect_set("trans_id").alias("trans_ids"))
    gene = point_join(ends, genes.select("chr", "gene_id", "start_pos", "end_pos"), "at").groupBy("id").agg(F.min("gene_id").alias("gene_id"))
    return out.join(trans, "id", "left").join(gene, "id", "left")


def _best_pairs(pairs: DataFrame, trans_seg: DataFrame, exons: DataFrame, genes: DataFrame, p: Params) -> DataFrame:
    """The extended pairs (rname, attempt, forward_left, kind, columns of extend_pair) with the category that each is evidence of."""
    facts = pair_facts(pairs.withColumns({"len1": F.col("mlen1"), "len2": F.col("mlen2")}), exons, genes)
    facts = facts.withColumnsRenamed({"left_ok1": "left1", "right_ok1": "right1", "left_ok2": "left2", "right_ok2": "right2"})
    sizes = insert_size(pairs.select("id", "chr", F.col("epos1").alias("end1"), F.col("spos2").alias("start2"), F.col("mlen1").alias("len1"), F.col("mlen2").alias("len2")), trans_seg)
    facts = stored(facts.join(sizes, "id"))
    told = facts.join(explain_concordant(facts, p).withColumnRenamed("type", "explained"), "id").join(detect_chimeric(facts, p), "id")
    whole1, whole2 = F.col("type1") == P.CONCRD, F.col("type2") == P.CONCRD
    part1, part2 = F.col("type1") == P.CANDID, F.col("type2") == P.CANDID
    kind = (
        F.when(whole1 & whole2 & F.col("forward_left"), F.col("explained"))
        .when(whole1 & whole2, F.when(F.col("inverted"), P.CHIORF))
        .when((whole1 & part2) | (part1 & whole2), F.when(F.col("bsj"), P.CHIBSJ))
        .when(part1 & part2, F.when(F.col("two_bsj"), P.CHI2BSJ))
    )
    ed = sum(F.col(f"{c}{k}") for c in ("middle_ed", "left_ed", "right_ed") for k in (1, 2))
    return told.withColumns({"type": kind.cast("int"), "gm": F.col("e_s1") & F.col("e_e1") & F.col("e_s2") & F.col("e_e2"), "ed": ed, "mlen": F.col("mlen1") + F.col("mlen2"), "ord": F.col("id")})


def classify_pair(reads: DataFrame, chains: DataFrame, exons: DataFrame, trans_seg: DataFrame, genes: DataFrame, genome: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The category of each pair of reads, with the mapping that shows it.

    reads: rname. chains: rname, mate, dir, chr, chain_no, frags, seq (on dir), score. An attempt takes the forward chains of one
    mate with the backward chains of the other. All candidate pairs are drawn out and explained; the best mapping of a read is
    its category, unless what its mates are by themselves (final_mate_class) is a smaller one. Reads without chains on a mate
    have the category of that.

    Columns: rname, type, and (null without a mapping) chr, and with 1 for the left and 2 for the right mate mate, dir, ed, spos,
    epos, qspos, qepos and mtype.
    """
    name = F.struct("rname", "mate", "dir", "chr", "chain_no")
    chains = stored(chain_facts(chains.withColumn("id", name), exons, genes))
    keep = ("id", "mate", "dir", "frags", "seq")
    cand = mate_pair_candidates(chains, p.discordant_tlen, keep=keep)
    fwd = F.col("dir1") == 1
    pick = lambda c, f: F.when(f, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    cand = cand.select("rname", "chr", "kind", *[pick(c, fwd).alias(f"f_{c}") for c in keep], *[pick(c, ~fwd).alias(f"b_{c}") for c in keep])
    cand = cand.withColumn("id", F.struct(F.col("f_id").alias("f"), F.col("b_id").alias("b")))
    order = left_mate_order(cand.select("id", F.col("f_frags").alias("a"), F.col("b_frags").alias("b"), F.length("f_seq").alias("n")), F.col("n"))
    cand = stored(cand.join(order.withColumnRenamed("a_left", "forward_left"), "id"))
    side = lambda left: cand.select("id", "chr", *[F.when(F.col("forward_left") == F.lit(left), F.col(f"f_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in ("frags", "seq")])
    grown = extend_pair(side(True), side(False), trans_seg, genome, p)
    pairs = stored(grown.join(cand.select("id", "rname", F.col("f_mate").alias("attempt"), "forward_left", "kind", "f_id", "b_id"), "id"))
    best = best_mapping(_best_pairs(pairs, trans_seg, exons, genes, p).where("type IS NOT NULL").withColumnRenamed("from_gap", "gap"))

    # mates by themselves: the sides of pairs, and chains that no pair has
    paired = pairs.select(F.explode(F.array("f_id", "b_id")).alias("id")).distinct()
    alone = extend_mate(chains.join(paired, "id", "left_anti").select("id", "chr", "frags", "seq"), trans_seg, genome, p)
    of = lambda c, left: F.when(F.col("forward_left") == F.lit(left), F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    rows = [pairs.select(F.col(f"{x}_id").alias("id"), "chr", of("spos", left).alias("spos"), of("epos", left).alias("epos"), of("type", left).alias("type")) for x, left in (("f", True), ("b", False))]
    mates = stored(rows[0].unionByName(rows[1]).unionByName(alone.select("id", "chr", "spos", "epos", "type")).withColumn("key", F.xxhash64("id", "spos", "epos")))
    genic = point_join(mates.select("key", "chr", F.explode(F.array("spos", "epos")).alias("pos")), exons.select("chr", "start_pos", "end_pos").distinct()).select("key").distinct().withColumn("genic", F.lit(True))
    per = mates.join(genic, "key", "left").groupBy("id.rname", F.when(F.col("id.dir") == 1, F.col("id.mate")).otherwise(3 - F.col("id.mate")).alias("attempt")).agg(
        *[F.coalesce(F.min(F.when(F.col("id.dir") == d, F.col("type"))), F.lit(P.ORPHAN)).alias(f"k{i}") for i, d in ((1, 1), (2, -1))],
        *[F.coalesce(F.max(F.when(F.col("id.dir") == d, F.col("genic"))), F.lit(False)).alias(f"g{i}") for i, d in ((1, 1), (2, -1))],
    )
    by_mates = per.withColumn("c", final_mate_class(F.lit(P.ORPHAN), F.col("k1"), F.col("k2"), F.col("g1"), F.col("g2"))).groupBy("rname").agg(F.min("c").alias("by_mates"))
    counts = chains.groupBy("rname").agg(*[F.count_if(F.col("mate") == k).alias(f"n{k}") for k in (1, 2)])
    none = unmapped_class(F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0)), F.lit(0), F.lit(0))
    left_mate = F.when(F.col("forward_left"), F.col("attempt")).otherwise(3 - F.col("attempt"))
    ed = lambda k: sum(F.col(f"{c}{k}") for c in ("middle_ed", "left_ed", "right_ed"))
    dirs = [F.when(F.col("forward_left") == F.lit(x), 1).otherwise(-1).alias(f"dir{k}") for k, x in ((1, True), (2, False))]
    shown = best.select("rname", F.col("type").alias("shown"), "chr", left_mate.alias("mate1"), (3 - left_mate).alias("mate2"), *dirs, ed(1).alias("ed1"), ed(2).alias("ed2"), *[F.col(f"{c}{k}") for c in ("spos", "epos", "qspos", "qepos") for k in (1, 2)], *[F.col(f"type{k}").alias(f"mtype{k}") for k in (1, 2)])
    out = reads.select("rname").distinct().join(counts, "rname", "left").join(shown, "rname", "left").join(by_mates, "rname", "left")
    # what the mates are by themselves counts only where no pair is a concordant, discordant or chimeric one
    told = F.when(F.col("shown") <= P.CHI2BSJ, F.col("shown")).otherwise(F.least("shown", "by_mates"))
    return out.select("rname", F.coalesce(none, told).cast("int").alias("type"), *[c for c in shown.columns if c not in ("rname", "shown")])
