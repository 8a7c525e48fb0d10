"""Queries on gene models and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import annotation, intervals
from .registry import query

PIECES = """
edges AS (SELECT DISTINCT chr, p FROM (SELECT chr, start_pos AS p FROM {t} UNION ALL SELECT chr, end_pos + 1 FROM {t})),
pieces AS (SELECT * FROM (SELECT chr, p AS s, lead(p) OVER (PARTITION BY chr ORDER BY p) - 1 AS e FROM edges) WHERE e IS NOT NULL)"""
ISLANDS = """
{o}_m AS (SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY chr ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS f FROM (SELECT DISTINCT chr, start_pos, end_pos FROM ({t}))),
{o}_i AS (SELECT *, sum(f) OVER (PARTITION BY chr ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS i FROM {o}_m),
{o} AS (SELECT chr, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM {o}_i GROUP BY chr, i)"""
NEIGHBOURS = """
nb AS (SELECT *, coalesce(CASE WHEN strand = '+' THEN lead(start_pos) OVER w ELSE lag(start_pos) OVER w END, 0) AS next_exon_beg,
  coalesce(CASE WHEN strand = '+' THEN lag(end_pos) OVER w ELSE lead(end_pos) OVER w END, 0) AS prev_end FROM v_exons WINDOW w AS (PARTITION BY chr, trans_id ORDER BY exon_num, start_pos, end_pos))"""


@query("merge_exons", f"""WITH {NEIGHBOURS} SELECT chr, start_pos, end_pos, gene_id, next_exon_beg, array_to_string(list_sort(list(trans_id)), ',') AS trans_ids,
  array_to_string(list_sort(list(concat(trans_id, '-', exon_num))), ',') AS labels FROM nb GROUP BY ALL""")
def _(v):
    merged = annotation.merge_exons(annotation.exon_neighbours(v("v_exons")))
    return merged.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("trans_ids", "labels")})


@query("exon_neighbours", f"WITH {NEIGHBOURS} SELECT * FROM nb")
def _(v):
    return annotation.exon_neighbours(v("v_exons"))


@query("merge_genes", "SELECT chr, start_pos, end_pos, array_to_string(list_sort(list(gene_id)), ',') AS gene_ids FROM v_genes GROUP BY chr, start_pos, end_pos")
def _(v):
    return annotation.merge_genes(v("v_genes"))


@query("flatten_intervals", f"""WITH {PIECES.replace('{t}', 'v_genes')}, c AS (SELECT p.chr, s, e, list_sort(list(DISTINCT gene_id)) AS g FROM pieces p JOIN v_genes t ON p.chr = t.chr AND p.s BETWEEN t.start_pos AND t.end_pos GROUP BY ALL)
SELECT chr, CAST(row_number() OVER (PARTITION BY chr ORDER BY s) - 1 AS INTEGER) AS seg_ind, s AS start_pos, e AS end_pos, array_to_string(g, ',') AS labels FROM c""")
def _(v):
    return intervals.flatten_intervals(v("v_genes"), "gene_id").withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


@query("segment_summary", f"""WITH {NEIGHBOURS}, {PIECES.replace('{t}', 'nb')}
SELECT p.chr, s AS start_pos, e AS end_pos, max(end_pos) AS max_end, min(end_pos) AS min_end, max(next_exon_beg) AS max_next_exon_beg
FROM pieces p JOIN nb t ON p.chr = t.chr AND p.s BETWEEN t.start_pos AND t.end_pos GROUP BY p.chr, s, e""")
def _(v):
    return intervals.segment_summary(annotation.exon_neighbours(v("v_exons")).select("chr", "start_pos", "end_pos", "next_exon_beg"), "next_exon_beg")


@query("transcript_segments", f"""WITH {PIECES.replace('{t}', 'v_exons')}
SELECT p.chr, trans_id, s AS seg_start, e AS seg_end, CAST(min(CASE WHEN s = start_pos THEN 1 WHEN e = end_pos THEN 3 ELSE 2 END) AS INTEGER) AS state
FROM pieces p JOIN v_exons t ON p.chr = t.chr AND p.s BETWEEN t.start_pos AND t.end_pos GROUP BY p.chr, trans_id, s, e""")
def _(v):
    return annotation.transcript_segments(v("v_exons"))


@query("border_mask", f"""WITH {ISLANDS.replace('{o}', 'b').replace('{t}', "SELECT DISTINCT * FROM (SELECT chr, greatest(start_pos - 20, 0) AS start_pos, start_pos - 1 AS end_pos FROM v_exons UNION ALL SELECT chr, greatest(end_pos - 19, 0), end_pos FROM v_exons)")} SELECT * FROM b""")
def _(v):
    return intervals.border_mask(v("v_exons"), 20)


@query("intron_mask", f"""WITH {ISLANDS.replace('{o}', 'g').replace('{t}', 'SELECT chr, start_pos, end_pos FROM v_genes')}, {ISLANDS.replace('{o}', 'x').replace('{t}', 'SELECT chr, start_pos, end_pos FROM v_exons')},
u AS (SELECT *, 0 AS exon FROM g UNION ALL SELECT *, 1 FROM x), {PIECES.replace('{t}', 'u')},
c AS (SELECT p.chr, s AS start_pos, e AS end_pos, max(exon) AS exon FROM pieces p JOIN u ON p.chr = u.chr AND p.s BETWEEN u.start_pos AND u.end_pos GROUP BY ALL),
{ISLANDS.replace('{o}', 'r').replace('{t}', 'SELECT chr, start_pos, end_pos FROM c WHERE exon = 0')} SELECT * FROM r""")
def _(v):
    return intervals.intron_mask(v("v_genes").select("chr", "start_pos", "end_pos"), v("v_exons").select("chr", "start_pos", "end_pos"))


@query("point_in_gene", "SELECT rname, p.chr, pos, array_to_string(list_sort(list(gene_id)), ',') AS genes FROM v_points p JOIN v_genes g ON p.chr = g.chr AND pos BETWEEN start_pos AND end_pos GROUP BY rname, p.chr, pos")
def _(v):
    held = intervals.point_join(v("v_points"), v("v_genes"))
    return held.groupBy("rname", "chr", "pos").agg(F.array_join(F.array_sort(F.collect_list("gene_id")).cast("array<string>"), ",").alias("genes"))


@query("point_in_segment", f"""WITH {PIECES.replace('{t}', 'v_exons')}, segs AS (SELECT DISTINCT p.chr, s, e FROM pieces p JOIN v_exons t ON p.chr = t.chr AND p.s BETWEEN t.start_pos AND t.end_pos)
SELECT rname, v.chr, pos, s AS start_pos, e AS end_pos FROM v_points v LEFT JOIN segs ON v.chr = segs.chr AND pos BETWEEN s AND e""")
def _(v):
    segs = intervals.segment_summary(v("v_exons").select("chr", "start_pos", "end_pos")).select("chr", "start_pos", "end_pos")
    return intervals.point_join(v("v_points"), segs, how="left")


@query("gap_neighbours", f"""WITH {ISLANDS.replace('{o}', 'm').replace('{t}', 'SELECT chr, start_pos, end_pos FROM v_exons')}, n AS (SELECT *, lead(start_pos) OVER (PARTITION BY chr ORDER BY start_pos) AS nx, min(start_pos) OVER (PARTITION BY chr) AS fs FROM m)
SELECT p.rname, p.chr, p.pos, n.start_pos AS seg_start, n.end_pos AS seg_end, CASE WHEN n.start_pos IS NULL THEN (SELECT min(start_pos) FROM m WHERE m.chr = p.chr) ELSE n.nx END AS next_start
FROM v_points p ASOF LEFT JOIN n ON p.chr = n.chr AND p.pos >= n.start_pos""")
def _(v):
    return intervals.gap_neighbours(v("v_points"), intervals.merge_islands(v("v_exons")))


@query("gtf_normalise", """
SELECT chr, 'gene' AS type, strand, gene_id, CAST(NULL AS BIGINT) AS trans_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos, 0 AS ord FROM v_exons GROUP BY chr, strand, gene_id
UNION ALL SELECT chr, 'transcript', strand, gene_id, trans_id, min(start_pos), max(end_pos), 0 FROM v_exons GROUP BY chr, strand, gene_id, trans_id
UNION ALL SELECT chr, 'exon', strand, gene_id, trans_id, start_pos, end_pos, CASE WHEN strand = '-' THEN -exon_num ELSE exon_num END FROM v_exons""")
def _(v):
    return annotation.normalise_gtf(v("v_exons"))


@query("src_gtf", "SELECT chr, 'demo' AS source, 'exon' AS type, start_pos, end_pos, strand, CAST(gene_id AS VARCHAR) AS gene_id, CAST(trans_id AS VARCHAR) AS trans_id, exon_num, '-' AS gene_name FROM v_exons")
def _(v):
    line = """concat_ws(char(9), chr, 'demo', 'exon', start_pos, end_pos, '.', strand, '.', concat('gene_id "', gene_id, '"; transcript_id "', trans_id, '"; exon_number "', exon_num, '";'))"""
    return annotation.parse_gtf(v("v_exons").select(F.expr(line).alias("value")))


@query("annotate_circ", """
WITH c AS (SELECT DISTINCT a.chr, a.start_pos, b.end_pos FROM v_exons a JOIN v_exons b ON a.trans_id = b.trans_id AND a.exon_num = 1 AND b.exon_num = 3 UNION SELECT DISTINCT chr, spos, epos FROM v_bsj)
SELECT c.chr, c.start_pos, c.end_pos, coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN s.trans_id = e.trans_id THEN concat(s.trans_id, '(', s.gene_id, ')[', s.exon_num, '-', e.exon_num, ']') END) FILTER (s.trans_id = e.trans_id)), ','), 'NA') AS annotation
FROM c LEFT JOIN v_exons s ON c.chr = s.chr AND c.start_pos = s.start_pos LEFT JOIN v_exons e ON c.chr = e.chr AND c.end_pos = e.end_pos AND s.trans_id = e.trans_id GROUP BY c.chr, c.start_pos, c.end_pos""")
def _(v):
    e = v("v_exons")
    spans = e.where("exon_num = 1").select("chr", "start_pos", "trans_id").join(e.where("exon_num = 3").select("end_pos", "trans_id"), "trans_id").select("chr", "start_pos", "end_pos")
    calls = v("v_bsj").select("chr", F.col("spos").alias("start_pos"), F.col("epos").alias("end_pos"))
    return annotation.annotate_circ(spans.unionByName(calls).distinct(), e)


@query("same_gene", "SELECT DISTINCT rname AS id FROM v_bsj b JOIN v_genes g ON b.chr = g.chr AND spos BETWEEN start_pos AND end_pos AND epos BETWEEN start_pos AND end_pos")
def _(v):
    return annotation.same_gene(v("v_bsj").select(F.col("rname").alias("id"), "chr", F.col("spos").alias("pos1"), F.col("epos").alias("pos2")), v("v_genes"))


@query("breakpoint_snap", """
WITH s AS (SELECT trans_id AS id, chr, max(end_pos) + trans_id % 7 AS l, min(start_pos) + trans_id % 7 AS r FROM v_exons GROUP BY trans_id, chr),
h AS (SELECT id, d, t.trans_id, s.l + d AS l, s.r + d AS r FROM s, range(-5, 6) x(d), v_exons t, v_exons u WHERE t.chr = s.chr AND t.end_pos = s.l + d AND u.chr = s.chr AND u.trans_id = t.trans_id AND u.start_pos = s.r + d)
SELECT id, trans_id, CAST(d AS INTEGER) AS diff, l AS left_end, r AS right_start FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(d), d, trans_id) AS k FROM h) WHERE k = 1""")
def _(v):
    e = v("v_exons")
    jitter = F.first("trans_id") % 7
    splits = e.groupBy(F.col("trans_id").alias("id"), "chr").agg((F.max("end_pos") + jitter).alias("left_end"), (F.min("start_pos") + jitter).alias("right_start"))
    return annotation.breakpoint_snap(splits, e)


@query("segment_exon_class", """
WITH p AS (SELECT rname AS id, chr, pos AS s, pos + 15 AS e FROM v_points),
h AS (SELECT id, bool_or((abs(s - start_pos) <= 2 OR abs(e - end_pos) <= 2) AND s >= start_pos AND e <= end_pos) AS ok, bool_or(s >= start_pos AND e <= end_pos) AS inside FROM p JOIN (SELECT DISTINCT chr, start_pos, end_pos FROM v_exons) x ON p.chr = x.chr AND s <= end_pos AND start_pos <= e GROUP BY id)
SELECT p.id, CASE WHEN ok IS NULL THEN 'intron' WHEN ok THEN 'boundary_ok' WHEN inside THEN 'middle_exon' ELSE 'retention' END AS class FROM p LEFT JOIN h USING (id)""")
def _(v):
    return annotation.segment_exon_class(v("v_points").select(F.col("rname").alias("id"), "chr", F.col("pos").alias("a_start"), (F.col("pos") + 15).alias("a_end")), v("v_exons"))


@query("mate_insert_size", f"""WITH {PIECES.replace('{t}', 'v_exons')},
ts AS (SELECT DISTINCT p.chr, trans_id, s, e FROM pieces p JOIN v_exons t ON p.chr = t.chr AND p.s BETWEEN t.start_pos AND t.end_pos),
m AS (SELECT trans_id AS id, chr, min(start_pos) + 5 AS a, min(start_pos) + 130 AS b FROM v_exons GROUP BY trans_id, chr),
x AS (SELECT DISTINCT m.id, m.chr, a, b, l.trans_id FROM m JOIN ts l ON l.chr = m.chr AND a BETWEEN l.s AND l.e JOIN ts r ON r.chr = m.chr AND r.trans_id = l.trans_id AND b BETWEEN r.s AND r.e),
z AS (SELECT id, x.trans_id, sum(least(e, b) - greatest(s, a) + 1) AS tlen FROM x JOIN ts ON ts.chr = x.chr AND ts.trans_id = x.trans_id AND e >= a AND s <= b GROUP BY ALL)
SELECT m.id, CAST(coalesce(min(tlen), -1) AS BIGINT) AS tlen FROM m LEFT JOIN z USING (id) GROUP BY m.id""")
def _(v):
    e = v("v_exons")
    mates = e.groupBy(F.col("trans_id").alias("id"), "chr").agg((F.min("start_pos") + 5).alias("end1"), (F.min("start_pos") + 130).alias("start2"))
    return annotation.insert_size(mates, annotation.transcript_segments(e))


@query("missing_run_count", """
WITH s AS (SELECT trans_id, exon_num, start_pos - lag(end_pos) OVER (PARTITION BY trans_id ORDER BY exon_num, start_pos, end_pos) AS gap FROM v_exons)
SELECT trans_id, CAST(sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) AS BIGINT) AS introns FROM s GROUP BY trans_id""")
def _(v):
    w = Window.partitionBy("trans_id").orderBy("exon_num", "start_pos", "end_pos")
    gaps = v("v_exons").select("trans_id", (F.col("start_pos") - F.lag("end_pos").over(w)).alias("gap"))
    return gaps.groupBy("trans_id").agg(F.sum(F.when(F.col("gap") > 1, 1).otherwise(0)).alias("introns"))


@query("interval_overlap_len", "SELECT l.rname, l.chr, greatest(least(l.epos, g.end_pos) - greatest(l.spos, g.start_pos) + 1, 0) AS len FROM v_bsj l JOIN v_genes g ON l.chr = g.chr AND g.gene_id = l.spos // 120")
def _(v):
    calls = v("v_bsj").withColumn("gene_id", F.floor(F.col("spos") / 120))
    return calls.join(v("v_genes"), ["chr", "gene_id"]).select("rname", "chr", intervals.overlap_length(*map(F.col, ("spos", "epos", "start_pos", "end_pos"))).alias("len"))
