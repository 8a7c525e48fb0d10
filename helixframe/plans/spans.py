"""Queries on seeds, mates and pairs against the gene model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation, spans
from .intervals import ISLANDS, NEIGHBOURS, PIECES
from .registry import query

C = F.col
ISLE = ISLANDS.replace("{o}", "isle").replace("{t}", "SELECT chr, start_pos, end_pos FROM v_exons")
SEGS = f"{PIECES.replace('{t}', 'v_exons')}, ts AS (SELECT DISTINCT p.chr, trans_id, s, e FROM pieces p JOIN v_exons t ON p.chr = t.chr AND p.s BETWEEN t.start_pos AND t.end_pos)"


def _rows(v, sql: str):
    """Rows derived from the events, in SQL that both engines share."""
    frame = v("v_bsj")
    frame.createOrReplaceTempView("v_bsj")
    return frame.sparkSession.sql(sql)


SEEDS = "SELECT rname AS id, chr, spos + rname % 37 AS pos, CAST(20 AS BIGINT) AS mlen, rname % 90 AS rlen FROM v_bsj"


@query("seed_upper_bound", f"""WITH {NEIGHBOURS}, {ISLE}, s AS ({SEEDS}),
h AS (SELECT s.id, max(end_pos) FILTER (end_pos >= pos + mlen - 1) AS max_end, min(end_pos) FILTER (end_pos >= pos + mlen - 1) AS min_end, max(next_exon_beg) FILTER (end_pos >= pos + mlen - 1) AS max_next
      FROM s JOIN nb e ON e.chr = s.chr AND pos BETWEEN start_pos AND end_pos GROUP BY s.id),
n AS (SELECT s.id, isle.start_pos AS nx FROM s ASOF LEFT JOIN isle ON s.chr = isle.chr AND s.pos < isle.start_pos)
SELECT s.id, CAST(CASE WHEN h.id IS NULL THEN CASE WHEN nx IS NULL THEN pos + rlen + 4 WHEN nx - 1 < pos + mlen - 1 THEN 0 ELSE least(pos + rlen + 4, nx - mlen) END
  WHEN max_end IS NULL THEN 0 WHEN min_end < rlen + pos + mlen - 1 AND max_next <> 0 THEN max_next + mlen - 1 ELSE max_end - mlen + 1 END AS BIGINT) AS bound
FROM s LEFT JOIN h USING (id) LEFT JOIN n USING (id)""")
def _(v):
    return spans.seed_upper_bound(_rows(v, SEEDS), annotation.exon_neighbours(v("v_exons")))


LINKS = "SELECT rname AS id, chr, spos + rname % 29 AS s1, spos + rname % 29 + 15 + rname % 90 AS s2, rname % 45 AS read_dist FROM v_bsj"


@query("junction_distance", f"""WITH {NEIGHBOURS}, p AS ({LINKS}),
h AS (SELECT p.*, start_pos, end_pos, gene_id, next_exon_beg, end_pos - (s1 + 19) AS a, s2 - next_exon_beg AS b FROM p JOIN nb e ON e.chr = p.chr AND s1 BETWEEN start_pos AND end_pos WHERE s2 > s1 + 19),
x AS (SELECT id, first(a + b ORDER BY start_pos, end_pos, gene_id, next_exon_beg DESC) FILTER (a >= 0 AND b >= 0 AND abs(a + b - read_dist) <= 4) AS across,
  min(s2 - s1 - 20) FILTER (a >= 0 AND a < read_dist AND b + 20 < 0) AS inside FROM h GROUP BY id)
SELECT id, coalesce(across, inside) AS dist FROM x WHERE coalesce(across, inside) IS NOT NULL""")
def _(v):
    return spans.junction_distance(_rows(v, LINKS), annotation.exon_neighbours(v("v_exons")))


TRIMS = "SELECT rname AS id, chr, spos + rname % 31 AS spos, spos + rname % 31 + 40 + rname % 53 AS epos, 1 + rname % 3 AS qspos, 41 + rname % 53 + rname % 3 AS qepos, 41 + rname % 53 AS matched_len, CAST(100 AS BIGINT) AS rlen FROM v_bsj"


@query("trim_side_introns", f"""WITH {ISLE}, m AS ({TRIMS}),
l AS (SELECT m.*, p.end_pos AS before_end, n.start_pos AS nx FROM m ASOF LEFT JOIN isle p ON m.chr = p.chr AND m.spos >= p.start_pos ASOF LEFT JOIN isle n ON m.chr = n.chr AND m.spos < n.start_pos),
a AS (SELECT *, CASE WHEN (before_end IS NULL OR before_end < spos) AND nx - spos BETWEEN 1 AND matched_len - 1 THEN nx - spos ELSE 0 END AS d FROM l),
b AS (SELECT id, chr, spos + d AS spos, epos, qspos + d AS qspos, qepos, matched_len - d AS matched_len, rlen, CASE WHEN qspos + d - 1 < rlen - qepos THEN d ELSE 0 END AS clip_left FROM a),
r AS (SELECT b.*, p.end_pos AS before_end FROM b ASOF LEFT JOIN isle p ON b.chr = p.chr AND b.epos >= p.start_pos),
c AS (SELECT *, CASE WHEN before_end < epos AND epos - before_end < matched_len THEN epos - before_end ELSE 0 END AS d FROM r)
SELECT id, chr, spos, epos - d AS epos, qspos, qepos - d AS qepos, matched_len - d AS matched_len, rlen, clip_left, CASE WHEN qspos - 1 > rlen - (qepos - d) THEN d ELSE 0 END AS clip_right FROM c""")
def _(v):
    return spans.trim_side_introns(_rows(v, TRIMS), v("v_exons"))


MATES = "SELECT trans_id AS id, chr, min(start_pos) + trans_id % 9 AS spos, min(start_pos) + trans_id % 9 + 60 + trans_id % 70 AS epos, CAST(35 + trans_id % 40 AS BIGINT) AS matched_len FROM v_exons GROUP BY trans_id, chr"


def _mates(v):
    e = v("v_exons")
    e.createOrReplaceTempView("v_exons")
    return e.sparkSession.sql(MATES), annotation.transcript_segments(e)


@query("junction_list", f"""WITH {SEGS}, m AS ({MATES}),
x AS (SELECT m.*, f.trans_id, f.s AS fs, l.s AS ls FROM m JOIN ts f ON f.chr = m.chr AND m.spos BETWEEN f.s AND f.e JOIN ts l ON l.chr = m.chr AND l.trans_id = f.trans_id AND m.epos BETWEEN l.s AND l.e WHERE f.s < l.s),
w AS (SELECT x.id, x.trans_id, matched_len, ts.s, ts.e, least(ts.e, epos) - greatest(ts.s, spos) + 1 AS piece FROM x JOIN ts ON ts.chr = x.chr AND ts.trans_id = x.trans_id AND ts.s BETWEEN fs AND ls),
y AS (SELECT *, sum(piece) OVER (PARTITION BY id, trans_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS covered, sum(piece) OVER (PARTITION BY id, trans_id) AS total, lead(s) OVER (PARTITION BY id, trans_id ORDER BY s) AS nx, row_number() OVER (PARTITION BY id, trans_id ORDER BY s) AS ord FROM w)
SELECT id, trans_id, CAST(ord AS INTEGER) AS ord, e AS junc_start, nx AS junc_end, CAST(covered AS BIGINT) AS covered FROM y WHERE abs(total - matched_len) <= 3 AND nx IS NOT NULL
QUALIFY trans_id = min(trans_id) OVER (PARTITION BY id)""")
def _(v):
    return spans.junction_list(*_mates(v))


WALK = "SELECT id, chr, spos AS pos, 30 + id % 60 AS need, spos + 200 AS bound FROM ({m})"


@query("transcript_walk", f"""WITH {SEGS}, a AS ({WALK.replace('{m}', MATES)}),
h AS (SELECT DISTINCT a.*, trans_id FROM a JOIN ts ON ts.chr = a.chr AND pos BETWEEN s AND e),
w AS (SELECT id, h.trans_id, need, greatest(s, pos) AS p, least(e, bound) - greatest(s, pos) + 1 AS n FROM h JOIN ts ON ts.chr = h.chr AND ts.trans_id = h.trans_id AND e >= pos AND s <= bound),
y AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY id, trans_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far, row_number() OVER (PARTITION BY id, trans_id ORDER BY p) AS ord FROM w)
SELECT id, trans_id, CAST(ord AS INTEGER) AS ord, p AS pos, CAST(least(n, need - so_far) AS BIGINT) AS len FROM y WHERE so_far < need""")
def _(v):
    mates, segs = _mates(v)
    mates.createOrReplaceTempView("span_mates")
    return spans.transcript_walk(mates.sparkSession.sql(WALK.replace("{m}", "SELECT * FROM span_mates")), segs)


FRAGS = "SELECT l_orderkey AS id, l_linenumber % 2 AS side, CAST(l_linenumber * 25 + l_partkey % 20 AS BIGINT) AS rpos, CAST(l_linenumber * 11 + l_suppkey % 9 AS BIGINT) AS qpos, 10 + l_partkey % 15 AS len FROM lineitem"


@query("left_mate_order", f"""WITH f AS (SELECT DISTINCT * FROM ({FRAGS})), a AS (SELECT * FROM f WHERE side = 1), b AS (SELECT * FROM f WHERE side = 0),
s AS (SELECT id, arg_min(rpos, (rpos, qpos, len)) AS a0, arg_max(rpos + len - 1, (rpos, qpos, len)) AS a1 FROM a GROUP BY id), t AS (SELECT id, arg_min(rpos, (rpos, qpos, len)) AS b0, arg_max(rpos + len - 1, (rpos, qpos, len)) AS b1 FROM b GROUP BY id),
m AS (SELECT a.id, greatest(b.rpos - (a.rpos + a.len - 1), a.rpos - (b.rpos + b.len - 1), 0) AS gap, greatest(a.rpos, b.rpos) AS common, a.qpos + greatest(a.rpos, b.rpos) - a.rpos AS qa, b.qpos + greatest(a.rpos, b.rpos) - b.rpos AS qb FROM a JOIN b USING (id)),
k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap, common, qa, qb) = 1)
SELECT id, CASE WHEN NOT (b0 > a1 OR a0 > b1) AND qa < 60 AND qb < 60 THEN qa >= qb ELSE a0 < b0 END AS a_left FROM s JOIN t USING (id) JOIN k USING (id)""")
def _(v):
    v("lineitem").createOrReplaceTempView("lineitem")
    rows = v("lineitem").sparkSession.sql(FRAGS)
    side = lambda k: F.array_sort(F.collect_set(F.when(C("side") == k, F.struct("rpos", "qpos", "len"))))
    return spans.left_mate_order(rows.groupBy("id").agg(side(1).alias("a"), side(0).alias("b")).where("size(a) > 0 AND size(b) > 0"), F.lit(60))


PAIRS = """SELECT rname AS id, chr, spos + rname % 41 AS spos1, spos + rname % 41 + 19 AS epos1, spos + (rname % 5) * 55 + rname % 23 AS spos2, spos + (rname % 5) * 55 + rname % 23 + 19 AS epos2,
 CAST(20 AS BIGINT) AS len1, CAST(20 AS BIGINT) AS len2, rname % 3 AS kind, rname % 2 = 0 AS left1, rname % 5 < 3 AS right1, rname % 7 < 4 AS left2, rname % 11 < 5 AS right2 FROM v_bsj"""
FACTS = f"""p AS ({PAIRS}), {ISLE}, ex AS (SELECT DISTINCT chr, gene_id, start_pos, end_pos FROM v_exons),
x1 AS (SELECT id, gene_id, start_pos, end_pos FROM p JOIN ex USING (chr) WHERE spos1 BETWEEN start_pos AND end_pos), x2 AS (SELECT id, gene_id, start_pos, end_pos FROM p JOIN ex USING (chr) WHERE spos2 BETWEEN start_pos AND end_pos),
y1 AS (SELECT DISTINCT id FROM p JOIN ex USING (chr) WHERE epos1 BETWEEN start_pos AND end_pos), y2 AS (SELECT DISTINCT id FROM p JOIN ex USING (chr) WHERE epos2 BETWEEN start_pos AND end_pos),
g1 AS (SELECT DISTINCT p.id FROM p JOIN x1 USING (id) JOIN v_genes g ON g.chr = p.chr AND g.gene_id = x1.gene_id WHERE g.start_pos <= spos2 AND epos2 <= g.end_pos),
g2 AS (SELECT DISTINCT p.id FROM p JOIN x2 USING (id) JOIN v_genes g ON g.chr = p.chr AND g.gene_id = x2.gene_id WHERE g.start_pos <= spos1 AND epos1 <= g.end_pos),
q1 AS (SELECT p.id, b.end_pos AS gap1, n.start_pos AS nx1 FROM p ASOF LEFT JOIN isle b ON p.chr = b.chr AND p.spos1 >= b.start_pos ASOF LEFT JOIN isle n ON p.chr = n.chr AND p.spos1 < n.start_pos),
q2 AS (SELECT p.id, b.end_pos AS gap2, n.start_pos AS nx2 FROM p ASOF LEFT JOIN isle b ON p.chr = b.chr AND p.spos2 >= b.start_pos ASOF LEFT JOIN isle n ON p.chr = n.chr AND p.spos2 < n.start_pos),
k AS (SELECT p.*, p.id IN (SELECT id FROM x1) AS e_s1, p.id IN (SELECT id FROM y1) AS e_e1, p.id IN (SELECT id FROM x2) AS e_s2, p.id IN (SELECT id FROM y2) AS e_e2,
  p.id IN (SELECT id FROM x1 JOIN x2 USING (id, gene_id, start_pos, end_pos)) AS same_exon, p.id IN (SELECT id FROM x1 JOIN x2 USING (id, gene_id)) AS shared,
  p.id IN (SELECT id FROM g1) OR p.id IN (SELECT id FROM g2) AS spanned, gap1, gap2, nx1, nx2 FROM p JOIN q1 USING (id) JOIN q2 USING (id)),
f AS (SELECT *, CASE WHEN e_s1 AND e_s2 THEN shared ELSE spanned END AS one_gene, coalesce(NOT e_s1 AND NOT e_s2 AND gap1 = gap2 AND nx1 IS NOT NULL AND nx2 IS NOT NULL, false) AS one_gap FROM k)"""


def _facts(v):
    return spans.pair_facts(_rows(v, PAIRS), v("v_exons"), v("v_genes"))


@query("pair_facts", f"WITH {FACTS} SELECT id, e_s1, e_e1, e_s2, e_e2, same_exon, one_gene, one_gap, CASE WHEN one_gap THEN spos1 - gap1 END AS from_gap FROM f")
def _(v):
    return _facts(v).select("id", "e_s1", "e_e1", "e_s2", "e_e2", "same_exon", "one_gene", "one_gap", "from_gap")


TLEN = """z0 AS (SELECT DISTINCT p.id, p.chr, epos1, spos2, l.trans_id FROM p JOIN ts l ON l.chr = p.chr AND epos1 BETWEEN l.s AND l.e JOIN ts r ON r.chr = p.chr AND r.trans_id = l.trans_id AND spos2 BETWEEN r.s AND r.e),
z AS (SELECT id, min(t) AS tlen FROM (SELECT id, z0.trans_id, sum(least(e, spos2) - greatest(s, epos1) + 1) AS t FROM z0 JOIN ts ON ts.chr = z0.chr AND ts.trans_id = z0.trans_id AND e >= epos1 AND s <= spos2 GROUP BY ALL) GROUP BY id)"""


@query("explain_concordant", f"""WITH {FACTS}, {SEGS}, {TLEN}, y AS (SELECT f.*, coalesce(tlen + len1 + len2 - 2, -1) AS tlen, CASE WHEN kind = 0 THEN 0 ELSE 5 END AS near, spos2 - epos1 - 1 + len1 + len2 AS apart FROM f LEFT JOIN z USING (id)),
u AS (SELECT *, CASE WHEN NOT e_s1 OR NOT e_s2 THEN CASE WHEN apart <= 20000 THEN 7 END WHEN same_exon THEN CASE WHEN spos2 + len2 - spos1 <= 500 THEN near ELSE 1 END END AS starts,
  CASE WHEN NOT e_e1 OR NOT e_s2 THEN CASE WHEN apart <= 20000 THEN 7 END WHEN tlen BETWEEN 0 AND 500 THEN near ELSE 1 END AS inn FROM y)
SELECT id, CAST(CASE WHEN spos1 <= spos2 THEN least(starts, inn) END AS INTEGER) AS type FROM u""")
def _(v):
    facts = _facts(v)
    sizes = annotation.insert_size(facts.select("id", "chr", C("epos1").alias("end1"), C("spos2").alias("start2"), "len1", "len2"), annotation.transcript_segments(v("v_exons")))
    return spans.explain_concordant(facts.join(sizes, "id"))


LINKED = "(one_gene OR (one_gap AND spos1 - gap1 <= 1000))"


def _chimeric(name, sql):
    @query(name, f"WITH {FACTS} SELECT id, {sql} AS found FROM f")
    def _(v, column={"detect_inverted": "inverted", "detect_bsj": "bsj", "detect_2bsj": "two_bsj"}[name]):
        return spans.detect_chimeric(_facts(v)).select("id", C(column).alias("found"))


_chimeric("detect_inverted", "e_s1 AND e_s2 AND one_gene AND spos1 < spos2")
_chimeric("detect_bsj", f"right1 AND left2 AND {LINKED}")
_chimeric("detect_2bsj", f"spos1 <= spos2 AND NOT (right1 AND right2 AND spos1 <> spos2) AND NOT (left1 AND left2 AND epos1 <> epos2) AND NOT (left1 AND right2) AND {LINKED}")
