"""Queries on reads drawn out along transcripts.

Single anchors lie before every junction of the genes that all contigs carry along their whole length (plans/chains). Mates and circles
are planted in the genes of customers (plans/circ), with changed, dropped and added bases.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation, extend
from ..operators.tables import stored
from .chains import EXONS_SQL, spliced_exons
from .circ import GENOME_SQL, STARTS, customer_genes
from .registry import query

C = F.col
LEFT = "SELECT id * 10000 + j AS id, chr, seq AS ref, e, e - 9 AS pos, CAST((id + j) % 5 AS INT) AS edits, concat(substr(seq, CAST(e - 8 AS INT), 9), substr(seq, CAST(e + 201 AS INT), 4), CASE (id + j) % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE substr(seq, CAST(e + 205 AS INT), 1) END, substr(seq, CAST(e + 206 AS INT), 24), CASE WHEN id % 2 = 0 THEN 'ACGTA' ELSE '' END) AS q FROM spots"


@query("extend_alignment", f"""WITH {EXONS_SQL}, spots AS (SELECT c.chr, c.id, c.seq, j, end_pos AS e FROM xe JOIN c ON c.chr = xe.chr WHERE end_pos + 400 <= n), l AS ({LEFT}),
w AS (SELECT id, e, pos, edits, q, 0 AS bare, concat(substr(ref, CAST(e - 8 AS INTEGER), 9), substr(ref, CAST(e + 201 AS INTEGER), 200)) AS r FROM l UNION ALL SELECT id, e, pos, edits, q, 1, substr(ref, CAST(e - 8 AS INTEGER), 80) FROM l),
t AS (SELECT *, length(q) - c AS n, length(q) - c + d AS j FROM w, (SELECT unnest(range(0, 8)) AS c), (SELECT unnest(range(-3, 4)) AS d)),
d AS (SELECT *, CASE WHEN n = 0 THEN j ELSE levenshtein(substr(q, 1, CAST(n AS INTEGER)), substr(r, 1, CAST(j AS INTEGER))) END AS ed FROM t WHERE j >= 0 AND n >= 0),
p AS (SELECT * FROM d WHERE ed <= edits QUALIFY row_number() OVER (PARTITION BY id, bare ORDER BY c + 2 * ed, ed, abs(d), j) = 1),
m AS (SELECT *, CASE WHEN bare = 1 OR j <= 9 THEN pos + j ELSE e + 191 + j END AS reached FROM p),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY bare, c + 2 * ed, ed, reached) = 1),
x AS (SELECT id, e, length(q) AS n, i, levenshtein(substr(q, 1, CAST(i AS INTEGER)), substr(r, 1, 9)) AS ed, edits FROM w, (SELECT unnest(range(6, 13)) AS i) WHERE bare = 0 AND i <= length(q)),
s AS (SELECT * FROM x WHERE ed <= edits QUALIFY row_number() OVER (PARTITION BY id ORDER BY 2 * ed - i, ed, abs(i - 9), i DESC) = 1)
SELECT l.id, b.id IS NOT NULL OR coalesce(s.n - s.i <= 7, false) AS ok, CAST(coalesce(reached, CASE WHEN s.id IS NOT NULL THEN s.e END, l.pos) AS BIGINT) AS pos, CAST(coalesce(b.ed, s.ed, 0) AS INTEGER) AS ed,
       CAST(coalesce(c, CASE WHEN s.n - s.i <= 7 THEN s.n - s.i END, 0) AS INTEGER) AS clip, CAST(coalesce(b.n, s.i, 0) AS INTEGER) AS covered, CASE WHEN b.bare = 0 OR (b.id IS NULL AND s.id IS NOT NULL) THEN CAST(l.id // 10000 * 2 AS VARCHAR) END AS trans_id
FROM l LEFT JOIN b USING (id) LEFT JOIN s USING (id)""")
def _(v):
    exons = spliced_exons(v).where("trans_id % 2 = 0")
    spots = exons.select("chr", C("gene_id").alias("id"), (C("exon_num") - 1).cast("long").alias("j"), C("end_pos").alias("e")).join(v("v_contigs"), "chr").where(C("e") + 400 <= F.length("seq"))
    stored(spots).createOrReplaceTempView("spots")
    anchors = spots.sparkSession.sql(LEFT).select("id", "chr", "pos", C("q").alias("seq"), "edits", F.lit(extend.FAR).cast("long").alias("bound"), F.array().cast("array<long>").alias("tids"))
    return extend.extend_alignment(stored(anchors), stored(annotation.transcript_segments(exons)), v("v_contigs"))


# two mates of a gene, 150 bases apart on its spliced exons (s), with up to three bases changed, dropped or added; their seed of 20 bases
# (at q) lies in one exon
_CHANGED = "translate({x}, 'ACGT', 'CATG')"
READS = f"""SELECT id, chr, m, s, q, concat(substr(t, s + 1, 9), CASE WHEN (id + m) % 2 = 0 THEN x1 ELSE {_CHANGED.replace('{x}', 'x1')} END, substr(t, s + 11, 15), CASE WHEN (id + m) % 3 = 0 THEN x2 ELSE {_CHANGED.replace('{x}', 'x2')} END,
substr(t, s + 27, 59), CASE (id + 2 * m) % 4 WHEN 0 THEN x3 WHEN 1 THEN '' WHEN 2 THEN concat(x3, 'A') ELSE {_CHANGED.replace('{x}', 'x3')} END, substr(t, s + 87, 14)) AS seq
FROM (SELECT id, chr, m, s, t, 40 + CASE WHEN (s + 40) % 200 > 180 THEN 200 - (s + 40) % 200 ELSE 0 END AS q, substr(t, s + 10, 1) AS x1, substr(t, s + 26, 1) AS x2, substr(t, s + 86, 1) AS x3 FROM spl) y"""
SPLICED_SQL = f"{GENOME_SQL}, spl AS (SELECT id, chr, m, CAST((id * 7) % 400 + (m - 1) * 150 AS INTEGER) AS s, seq, concat({', '.join(f'substr(seq, {x}, 200)' for x in STARTS)}) AS t FROM g, (SELECT unnest([1, 2]) AS m))"
# of each mate and side what is left of the read, from the seed on, and the bases along the exons and straight on
SIDES_SQL = f"""{SPLICED_SQL}, rd AS ({READS}), rr AS (SELECT rd.*, spl.t, spl.seq AS ref, (rd.s + q) // 200 * 400 + 101 + (rd.s + q) % 200 AS spot FROM rd JOIN spl ON spl.id = rd.id AND spl.m = rd.m),
w AS (
  SELECT id, m, 'r' AS side, substr(seq, q + 21) AS q, substr(t, s + q + 21, 90) AS r, 0 AS bare FROM rr
  UNION ALL SELECT id, m, 'r', substr(seq, q + 21), substr(ref, CAST(spot + 20 AS INTEGER), 90), 1 FROM rr
  UNION ALL SELECT id, m, 'l', reverse(substr(seq, 1, q)), reverse(substr(t, greatest(s + q - 69, 1), s + q - greatest(s + q - 69, 1) + 1)), 0 FROM rr
  UNION ALL SELECT id, m, 'l', reverse(substr(seq, 1, q)), reverse(substr(ref, CAST(spot - 70 AS INTEGER), 70)), 1 FROM rr),
a AS (SELECT *, length(q) - c AS n, length(q) - c + d AS j FROM w, (SELECT unnest(range(0, 8)) AS c), (SELECT unnest(range(-3, 4)) AS d)),
e AS (SELECT *, levenshtein(substr(q, 1, CAST(n AS INTEGER)), substr(r, 1, CAST(j AS INTEGER))) AS ed FROM a WHERE j > 0 AND n > 0 AND j <= length(r)),
b AS (SELECT * FROM e WHERE ed <= 4 QUALIFY row_number() OVER (PARTITION BY id, m, side ORDER BY bare, c + 2 * ed, ed, abs(d)) = 1),
k AS (SELECT b.id, b.m, sum(ed) AS ed, sum(c) AS clip, any_value(length(rd.seq)) AS n FROM b JOIN rd ON rd.id = b.id AND rd.m = b.m GROUP BY b.id, b.m)"""


def _mates(v):
    """The planted mates as chains of their one seed, with genome pieces and segments."""
    genome, exons, _ = customer_genes(v)
    rows = genome.withColumn("m", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("t", F.concat(*[F.substring("seq", x, 200) for x in STARTS]))
    rows.withColumn("s", (C("id") * 7 % 400 + (C("m") - 1) * 150).cast("int")).createOrReplaceTempView("spl")
    reads = genome.sparkSession.sql(READS)
    frag = F.struct(C("q").cast("long").alias("qpos"), (F.floor((C("s") + C("q")) / 200) * 400 + 101 + (C("s") + C("q")) % 200).alias("rpos"), F.lit(20).alias("len"))
    return stored(reads.select("id", "chr", "m", F.array(frag).alias("frags"), "seq")), extend.cut_genome(genome), stored(annotation.transcript_segments(exons))


@query("extend_pair", f"""WITH {SIDES_SQL}
SELECT x.id, CAST(x.ed AS INTEGER) AS ed1, CAST(y.ed AS INTEGER) AS ed2, CAST(x.n - x.clip AS INTEGER) AS mlen1, CAST(y.n - y.clip AS INTEGER) AS mlen2, CASE WHEN x.ed <= 4 THEN 0 END AS type1, CASE WHEN y.ed <= 4 THEN 0 END AS type2
FROM k x JOIN k y ON x.id = y.id AND x.m = 1 AND y.m = 2""")
def _(v):
    mates, pieces, segs = _mates(v)
    side = lambda m: mates.where(C("m") == m).select("id", "chr", "frags", "seq")
    out = extend.extend_pair(side(1), side(2), segs, pieces)
    ed = lambda k: sum(C(f"{c}{k}") for c in ("middle_ed", "left_ed", "right_ed")).cast("int").alias(f"ed{k}")
    return out.select("id", ed(1), ed(2), C("mlen1").cast("int").alias("mlen1"), C("mlen2").cast("int").alias("mlen2"), "type1", "type2")


# a single read of each gene: whole, or with 40 bases of another gene at its end, or at both ends
@query("classify_single", f"WITH {GENOME_SQL} SELECT chr AS rname, CAST(CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE 11 END AS INTEGER) AS type FROM g")
def _(v):
    mates, pieces, segs = _mates(v)
    one, other = mates.where("m = 1"), F.translate(F.reverse(F.substring("seq", 1, 40)), "ACGT", "GTCA")
    q = F.get("frags", F.lit(0))["qpos"].cast("int")
    cut = F.when(C("id") % 3 == 0, C("seq")).when(C("id") % 3 == 1, F.concat(F.left("seq", q + 20), other)).otherwise(F.concat(F.left(other, q), F.substr("seq", q + 1, F.lit(20)), other))
    seeds = F.when(C("id") % 3 == 2, F.array(F.struct(F.least(q, F.lit(40)).cast("long").alias("qpos"), F.get("frags", F.lit(0))["rpos"].alias("rpos"), F.lit(20).alias("len")))).otherwise(C("frags"))
    reads = stored(one.select(C("chr").alias("id"), "chr", seeds.alias("frags"), cut.alias("seq")))
    return extend.classify_single(reads.select(C("id").alias("rname")), extend.extend_mate(reads, segs, pieces).select(C("id").alias("rname"), "type"))


def _circles(v):
    """A read over the back-splice of the second to fourth exon of each gene, cut after 25 to 75 bases, with up to six bases changed."""
    genome, exons, _ = customer_genes(v)
    cut = (25 + C("id") % 51).cast("int")
    n, late = C("id") % 7, cut < 50
    exon = lambda k: F.substring("seq", STARTS[k], 200)
    read = F.concat(F.right(exon(3), cut), F.left(exon(1), F.lit(100) - cut))

    def base(x, i):
        steps = F.when(late, 82 - i).otherwise(i - 17)
        return F.when((steps >= 0) & (steps % 4 == 0) & (steps < 4 * n), F.translate(x, "ACGT", "CATG")).otherwise(x)

    rows = genome.select("id", "chr", F.array_join(F.transform(F.split(read, ""), base), "").alias("seq"), cut.alias("cut"), F.lit(STARTS[1]).cast("long").alias("spos"), F.lit(STARTS[3] + 199).cast("long").alias("epos"), F.array("id").alias("tids"))
    return stored(rows), extend.cut_genome(genome), stored(annotation.transcript_segments(exons))


# a read of 100 bases over the circle and how many are changed on the side before or after the cut; of each side the alignment with the least
# clip and twice the edits, then the fewest edits. Alignments that cannot be better than the planted one are left out.
REALIGNED = f"""{GENOME_SQL}, ci AS (SELECT id, seq, CAST(25 + id % 51 AS INTEGER) AS cut, id % 7 AS n FROM g),
pl AS (SELECT *, concat(substr(seq, {STARTS[3] + 200} - cut, cut), substr(seq, {STARTS[1]}, 100 - cut)) AS plain FROM ci),
rd AS (SELECT id, seq, cut, n, array_to_string(list_transform(range(100), lambda i: CASE WHEN CASE WHEN cut < 50 THEN 82 - i ELSE i - 17 END BETWEEN 0 AND 4 * n - 1 AND (CASE WHEN cut < 50 THEN 82 - i ELSE i - 17 END) % 4 = 0
  THEN translate(substr(plain, CAST(i + 1 AS INTEGER), 1), 'ACGT', 'CATG') ELSE substr(plain, CAST(i + 1 AS INTEGER), 1) END), '') AS read FROM pl),
sd AS (
  SELECT id, 1 AS k, CASE WHEN cut < 50 THEN 0 ELSE n END AS n, CASE WHEN substr(read, cut, 1) <> substr(seq, {STARTS[3] + 199}, 1) THEN 1 ELSE 0 END AS off, reverse(substr(read, 1, cut - 1)) AS q, reverse(substr(seq, {STARTS[3] + 197} - cut, cut + 2)) AS r FROM rd
  UNION ALL SELECT id, 2, CASE WHEN cut < 50 THEN n ELSE 0 END, CASE WHEN substr(read, cut + 1, 1) <> substr(seq, {STARTS[1]}, 1) THEN 1 ELSE 0 END, substr(read, cut + 2), substr(seq, {STARTS[1] + 1}, 102 - cut) FROM rd),
al AS (SELECT id, k, off, c, levenshtein(substr(q, 1, CAST(length(q) - c AS INTEGER)), substr(r, 1, CAST(length(q) - c + d AS INTEGER))) AS ed
  FROM sd, (SELECT unnest(range(0, 8)) AS c), (SELECT unnest(range(-3, 4)) AS d) WHERE c + 2 * abs(d) <= CASE WHEN n > 4 THEN 15 ELSE 2 * n END),
be AS (SELECT * FROM al WHERE ed <= 4 - off QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY c + 2 * ed, ed) = 1),
re AS (SELECT id, CASE WHEN count(*) = 2 AND sum(ed + off) <= 4 THEN sum(ed + off) END AS ed FROM be GROUP BY id)"""


@query("split_realign", f"WITH {REALIGNED} SELECT ci.id, ed IS NOT NULL AS ok, CAST(ed AS INTEGER) AS ed FROM ci LEFT JOIN re USING (id)")
def _(v):
    rows, pieces, segs = _circles(v)
    return extend.split_realign(rows, segs, pieces).select("id", "ok", C("ed").cast("int").alias("ed"))


# the same reads as whole mates that were mapped on over the circle's start or its end
@query("rescue_overlap", f"WITH {REALIGNED} SELECT id, CASE WHEN id % 2 = 0 THEN 'start' ELSE 'end' END AS side, 25 + id % 51 AS cut, CAST(ed AS INTEGER) AS ed FROM re WHERE ed IS NOT NULL")
def _(v):
    rows, pieces, segs = _circles(v)
    cut, start = C("cut").cast("long"), C("id") % 2 == 0
    first = F.when(start, STARTS[0] + 200 - cut).otherwise(STARTS[3] + 200 - cut)
    last = F.when(start, STARTS[1] + 99 - cut).otherwise(STARTS[4] + 99 - cut)
    mates = rows.select("id", "chr", "seq", first.alias("m_start"), last.alias("m_end"), F.lit(100).cast("long").alias("matched_len"), F.lit(1).alias("qspos"), "spos", "epos", "tids")
    return extend.rescue_overlap(stored(mates), segs, pieces).select("id", "side", C("cut").cast("long").alias("cut"), C("ed").cast("int").alias("ed"))
