"""Queries on reads, alignments and simulated truth."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import params as P
from ..operators import alignments as A
from ..operators import reads as R
from ..operators.tables import scratch, stored
from .registry import query

C = F.col
OPS = "SELECT qname, flag, rname, pos, i, CAST(regexp_extract(o, '^[0-9]+') AS BIGINT) AS n, right(o, 1) AS op FROM (SELECT *, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHPX=]')) AS o, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHPX=]'), 1) AS i FROM v_sam)"
TOTALS = "ct AS (SELECT qname, flag, nm, " + ", ".join(f"CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[{o}]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS {n}" for o, n in (("S", "softclip"), ("ID", "indel"), ("N", "intron"))) + " FROM v_sam)"


@query("revcomp", "SELECT chr, translate(reverse(seq), 'ACGTN', 'TGCAN') AS rc FROM v_contigs")
def _(v):
    return v("v_contigs").select("chr", R.revcomp(C("seq")).alias("rc"))


@query("reverse_qual", "SELECT chr, reverse(seq) AS qual FROM v_contigs")
def _(v):
    return v("v_contigs").select("chr", F.reverse("seq").alias("qual"))


@query("subsequence", "SELECT chr, CASE WHEN 190 + length(chr) * 10 + 19 <= length(seq) THEN substr(seq, 190 + length(chr) * 10, 20) END AS part FROM v_contigs")
def _(v):
    return v("v_contigs").select("chr", R.subsequence(C("seq"), 190 + F.length("chr") * 10, F.lit(20)).alias("part"))


@query("splice_signals", """
SELECT chr, CASE WHEN 40 <= length(seq) THEN substr(seq, 39, 2) ELSE '' END AS end_signal, CASE WHEN 42 <= length(seq) THEN substr(seq, 41, 2) ELSE '' END AS start_signal,
  CASE WHEN 101 <= length(seq) THEN substr(seq, 100, 2) ELSE '' END AS ref_start, CASE WHEN 300 <= length(seq) THEN substr(seq, 299, 2) ELSE '' END AS ref_end FROM v_contigs""")
def _(v):
    return v("v_contigs").select("chr", *[c.alias(k) for k, c in R.splice_signals(C("seq"), F.lit(41), C("seq"), F.lit(100), F.lit(300)).items()])


@query("cigar_blocks", f"WITH ops AS ({OPS}), p AS (SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M','=','X','D','N') THEN n ELSE 0 END) OVER (PARTITION BY qname, flag, rname, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ops) SELECT qname, flag, rname, CAST(s AS BIGINT) AS block_start, CAST(s + n - 1 AS BIGINT) AS block_end FROM p WHERE op IN ('M','=','X')")
def _(v):
    return A.cigar_blocks(v("v_sam"))


@query("cigar_totals", f"WITH {TOTALS} SELECT * FROM ct")
def _(v):
    return A.cigar_totals(v("v_sam"))


@query("error_clip_histogram", f"""WITH {TOTALS}, p AS (SELECT qname, CAST(sum(indel) AS BIGINT) AS indel, CAST(sum(nm) AS BIGINT) AS mismatch, CAST(sum(softclip) AS BIGINT) AS softclip FROM ct GROUP BY qname)
SELECT indel, mismatch, softclip, count(*) AS pairs FROM p GROUP BY GROUPING SETS ((indel, mismatch, softclip), (indel))""")
def _(v):
    return A.error_clip_histogram(v("v_sam"))


@query("sam_pair_class", """
WITH k AS (SELECT qname, flag + l AS line, CASE WHEN f & 12 = 12 THEN 4 WHEN f & 12 <> 0 THEN 3 WHEN contains(cigar, 'N') AND nm < 4 THEN 2 END AS k FROM (SELECT *, pos AS l, CASE WHEN pos % 70 = 0 THEN 12 WHEN pos % 50 = 0 THEN 4 ELSE 0 END AS f FROM v_sam))
SELECT qname, coalesce(arg_max(k, line) FILTER (k IS NOT NULL), 1) AS class FROM k GROUP BY qname""")
def _(v):
    sam = v("v_sam").select("qname", F.when(C("pos") % 70 == 0, 12).when(C("pos") % 50 == 0, 4).otherwise(0).alias("flag"), (C("pos") + C("flag")).alias("line"), F.when(C("nm") < 4, C("cigar")).otherwise("*").alias("cigar"))
    return A.sam_pair_class(sam)


PAIRS = "SELECT qname, max(CASE WHEN flag = 99 THEN pos END) AS pos1, max(CASE WHEN flag = 147 THEN pos END) AS pos2 FROM v_sam GROUP BY qname"


def _pairs(v):
    one = lambda f: F.max(F.when(C("flag") == f, C("pos")))
    return v("v_sam").groupBy("qname").agg(one(99).alias("pos1"), one(147).alias("pos2")).dropna()


@query("mapping_agreement", f"""WITH a AS (SELECT * FROM ({PAIRS}) WHERE pos1 IS NOT NULL AND pos2 IS NOT NULL), j AS (SELECT qname, pos1, pos2, pos2 + pos1 % 25 AS o1, pos1 + pos2 % 15 AS o2 FROM a),
n AS (SELECT qname, greatest(CASE WHEN abs(pos1 - o1) <= 10 THEN 1 ELSE 0 END + CASE WHEN abs(pos2 - o2) <= 10 THEN 1 ELSE 0 END, CASE WHEN abs(pos1 - o2) <= 10 THEN 1 ELSE 0 END + CASE WHEN abs(pos2 - o1) <= 10 THEN 1 ELSE 0 END) AS n FROM j)
SELECT qname, CASE n WHEN 2 THEN 'both' WHEN 1 THEN 'one' ELSE 'none' END AS agreement FROM n""")
def _(v):
    a = _pairs(v)
    return A.mapping_agreement(a, a.select("qname", (C("pos2") + C("pos1") % 25).alias("pos1"), (C("pos1") + C("pos2") % 15).alias("pos2")))


MATES = "SELECT qname AS rid, pos1 AS a, pos2 AS b FROM (" + PAIRS + ") WHERE pos1 IS NOT NULL AND pos2 IS NOT NULL"
# the aligners: every read twice in the first one, some twice in the second, and some reads missing in each
SETS = {
    "p": ["SELECT rid, 1 AS ord, a AS s1, a + 70 AS e1, b AS s2, b + 70 AS e2 FROM m WHERE a % 7 <> 0", "SELECT rid, 2, b + a % 15, b + 70 + a % 11, a, a + 75 FROM m WHERE a % 7 <> 0"],
    "r": ["SELECT rid, 1 AS ord, a + b % 15 AS s1, a + 70 AS e1, b + a % 12 AS s2, b + 70 + b % 25 AS e2 FROM m WHERE b % 9 <> 0", "SELECT rid, 2, a + 5, a + 90, b - 5, b + 50 FROM m WHERE b % 9 <> 0 AND a % 2 = 0"],
    "g": ["SELECT rid, 1 AS ord, a + a % 13 AS s1, a + 70 - b % 14 AS e1, b AS s2, b + 80 - a % 16 AS e2 FROM m WHERE (a + b) % 8 <> 0"],
}
_SCORE = "(CASE WHEN abs({x}.s1 - {y}.s1) < 10 THEN 1 ELSE 0 END + CASE WHEN abs({x}.e1 - {y}.e1) < 10 THEN 1 ELSE 0 END + CASE WHEN abs({x}.s2 - {y}.s2) < 10 THEN 1 ELSE 0 END + CASE WHEN abs({x}.e2 - {y}.e2) < 10 THEN 1 ELSE 0 END)"


def _three_sql() -> str:
    ctes = [f"m AS ({MATES})"]
    for n, parts in SETS.items():
        ctes.append(f"{n}0 AS ({' UNION ALL '.join(parts)}), {n} AS (SELECT rid, ord, least(s1, s2) AS s1, CASE WHEN s2 < s1 THEN e2 ELSE e1 END AS e1, greatest(s1, s2) AS s2, CASE WHEN s2 < s1 THEN e1 ELSE e2 END AS e2, count(*) OVER (PARTITION BY rid) AS n FROM {n}0)")
    for x, y in ("pr", "pg", "rg"):
        ctes.append(f"{x}{y} AS (SELECT {x}.rid, max({_SCORE.replace('{x}', x).replace('{y}', y)}) AS score FROM {x} JOIN {y} USING (rid) WHERE CASE WHEN {x}.n > 1 THEN {y}.ord = 1 ELSE {x}.ord = 1 END GROUP BY {x}.rid)")
    has = {n: f"(SELECT DISTINCT rid, true AS y FROM {n})" for n in SETS}
    return f"""WITH {', '.join(ctes)}
SELECT rid, CASE WHEN q.y AND s.y AND t.y THEN pr.score END AS pr, CASE WHEN q.y AND s.y AND t.y THEN pg.score END AS pg, CASE WHEN q.y AND s.y AND t.y THEN rg.score END AS rg,
       concat_ws(',', CASE WHEN q.y IS NULL THEN 'p' END, CASE WHEN s.y IS NULL THEN 'r' END, CASE WHEN t.y IS NULL THEN 'g' END) AS missing
FROM {has['p']} q FULL JOIN {has['r']} s USING (rid) FULL JOIN {has['g']} t USING (rid) LEFT JOIN pr USING (rid) LEFT JOIN pg USING (rid) LEFT JOIN rg USING (rid)"""


@query("three_way_overlap", _three_sql())
def _(v):
    v("v_sam").createOrReplaceTempView("v_sam")
    spark = v("v_sam").sparkSession
    sets = [spark.sql(f"WITH m AS ({MATES}) {' UNION ALL '.join(parts)}") for parts in SETS.values()]
    return A.three_way_overlap(*sets)


@query("best_class_per_read", "SELECT rname, min(type) AS type FROM v_map_cand GROUP BY rname")
def _(v):
    return v("v_map_cand").groupBy("rname").agg(F.min("type").alias("type"))


@query("tlen_histogram", "SELECT gm, tlen, count(*) AS n FROM v_map_cand GROUP BY gm, tlen")
def _(v):
    return v("v_map_cand").groupBy("gm", "tlen").agg(F.count("*").alias("n"))


@query("class_totals", """WITH b AS (SELECT rname, min(type) AS type FROM v_map_cand WHERE mlen > 175 GROUP BY rname), t AS (SELECT DISTINCT rname, rname % 14 AS truth FROM v_map_cand)
SELECT truth, CAST(count(*) AS BIGINT) AS total, CAST(count(type) AS BIGINT) AS reported, CAST(sum(CASE WHEN type = truth THEN 1 ELSE 0 END) AS BIGINT) AS agreeing, count(*) - count(type) AS not_reported FROM t LEFT JOIN b USING (rname) GROUP BY truth""")
def _(v):
    best = v("v_map_cand").where("mlen > 175").groupBy("rname").agg(F.min("type").alias("type"))
    truth = v("v_map_cand").select("rname", (C("rname") % 14).alias("truth")).distinct()
    j = truth.join(best, "rname", "left")
    return j.groupBy("truth").agg(F.count("*").alias("total"), F.count("type").alias("reported"), F.sum(F.when(C("type") == C("truth"), 1).otherwise(0)).alias("agreeing"), (F.count("*") - F.count("type")).alias("not_reported"))


@query("class_confusion", """WITH b AS (SELECT rname, min(type) AS type, bool_or(gm) AS gm, min(ed) AS ed FROM v_map_cand GROUP BY rname),
k AS (SELECT type AS predicted, CASE WHEN gm THEN 'cont' ELSE 'junc' END AS continuity, CASE WHEN ed = 0 THEN 'two' WHEN ed = 1 THEN 'one' ELSE 'none' END AS agreement, rname % 5 AS gene_class, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT p.x AS predicted, c AS continuity, a AS agreement, e.x AS gene_class FROM range(0, 14) p(x), (VALUES ('cont'), ('junc')) c(c), (VALUES ('none'), ('one'), ('two')) a(a), range(0, 5) e(x))
SELECT CAST(g.predicted AS INTEGER) AS predicted, g.continuity, g.agreement, g.gene_class, coalesce(n, 0) AS n FROM g LEFT JOIN k USING (predicted, continuity, agreement, gene_class)""")
def _(v):
    best = v("v_map_cand").groupBy("rname").agg(F.min("type").alias("predicted"), F.bool_or("gm").alias("gm"), F.min("ed").alias("ed"))
    keys = ["predicted", "continuity", "agreement", "gene_class"]
    seen = best.select("predicted", F.when(C("gm"), "cont").otherwise("junc").alias("continuity"), F.when(C("ed") == 0, "two").when(C("ed") == 1, "one").otherwise("none").alias("agreement"), (C("rname") % 5).alias("gene_class")).groupBy(*keys).agg(F.count("*").alias("n"))
    axes = {"predicted": F.sequence(F.lit(0), F.lit(13)), "continuity": F.array(F.lit("cont"), F.lit("junc")), "agreement": F.array(F.lit("none"), F.lit("one"), F.lit("two")), "gene_class": F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))}
    grid = best.sparkSession.range(1)
    for k, values in axes.items():
        grid = grid.withColumn(k, F.explode(values))
    return grid.drop("id").join(seen, keys, "left").na.fill(0, ["n"])


@query("sam_flags", """SELECT rname, ord, 1 + CASE WHEN type = 0 THEN 2 ELSE 0 END + CASE WHEN m THEN 0 ELSE 12 END + CASE WHEN gm THEN 16 ELSE 32 END + CASE WHEN ord % 2 = 1 THEN 64 ELSE 128 END AS flag FROM (SELECT *, type <= 2 OR type IN (5, 7) AS m FROM v_map_cand)""")
def _(v):
    m = A.is_mapped(C("type"))
    return v("v_map_cand").select("rname", "ord", A.sam_flags(C("ord") % 2 == 1, m, m, C("gm"), ~C("gm"), C("type")).alias("flag"))


@query("sam_mate_fields", "SELECT rname AS id, CASE WHEN rname % 3 = 0 THEN '=' ELSE 'chrX' END AS rnext, CASE WHEN spos <= epos - 250 THEN 100 ELSE -100 END AS tlen, CASE WHEN type = 20 THEN reverse(start_signal) ELSE start_signal END AS seq FROM v_bsj")
def _(v):
    rows = v("v_bsj").select(C("rname").alias("id"), C("chr").alias("chr1"), F.when(C("rname") % 3 == 0, C("chr")).otherwise("chrX").alias("chr2"), C("spos").alias("pos1"), (C("epos") - 250).alias("pos2"), (C("type") == 20).alias("rev1"), C("start_signal").alias("seq"), F.lit(100).alias("insert"))
    return A.sam_mate_fields(rows)


@query("sam_header", "SELECT 0 AS ord, '' AS chr, concat('@HD', chr(9), 'VN:1.4', chr(9), 'SO:unsorted') AS line UNION ALL SELECT 1, chr, concat('@SQ', chr(9), 'SN:', chr, chr(9), 'LN:', length(seq)) FROM v_contigs")
def _(v):
    return A.sam_header(v("v_contigs").select("chr", F.length("seq").alias("len")))


@query("sam_class_split", """SELECT qname, flag, CASE nm % 5 WHEN 0 THEN 'con' WHEN 1 THEN 'dis' WHEN 2 THEN 'rf' WHEN 3 THEN 'split' ELSE 'remain' END AS class,
CASE WHEN cigar LIKE '%N%' THEN '2' ELSE '1' END AS xc, CAST(pos % 5 AS VARCHAR) AS xd, CAST(pos % 3 AS VARCHAR) AS xv, concat(pos % 4, flag % 4) AS xy FROM v_sam""")
def _(v):
    names = F.array(*map(F.lit, ("con", "dis", "rf", "split", "remain")))
    line = F.concat_ws("\t", "qname", C("flag").cast("string"), "rname", C("pos").cast("string"), F.lit("60"), "cigar", F.lit("=\t0\t0\t*\t*"), F.concat(F.lit("NM:i:"), C("nm").cast("string")))
    digits = F.concat((C("pos") % 4).cast("string"), (C("flag") % 4).cast("string"))
    sam = v("v_sam").select(line.alias("line"), F.when(C("cigar").contains("N"), 2).otherwise(1).alias("xc"), (C("pos") % 5).alias("xd"), (C("pos") % 3).alias("xv"), digits.alias("xy"), names[C("nm") % 5].alias("class"))
    path = scratch(sam.sparkSession)
    A.write_classes(A.tag_classes(sam), path)
    return A.read_classes(sam.sparkSession, path).select("qname", "flag", "class", *[C("tags")[t].alias(t.lower()) for t in ("XC", "XD", "XV", "XY")])


BLOCKS = "SELECT concat('p', rname) AS qname, chr, 0 AS block, pos AS a_start, pos + 15 AS a_end FROM v_points UNION ALL SELECT concat('p', rname), chr, 1, pos + 60, pos + 70 + rname % 9 FROM v_points WHERE rname % 3 = 0 UNION ALL SELECT concat('p', rname), chr, 2, pos + 120, pos + 124 FROM v_points WHERE rname % 6 = 0"


@query("sam_gene_class", f"""WITH bl AS ({BLOCKS}), b AS (SELECT qname, chr, a_start AS s, a_end AS e FROM bl),
f AS (SELECT qname, gene_id, CASE WHEN s >= start_pos AND e <= end_pos THEN 3 ELSE 2 END AS k FROM b JOIN v_exons x ON b.chr = x.chr AND s <= end_pos AND start_pos <= e UNION ALL SELECT qname, gene_id, 1 FROM b JOIN v_genes g ON b.chr = g.chr AND s <= end_pos AND start_pos <= e),
c AS (SELECT b.qname, coalesce(max(k), 0) AS class, max(k * 1000000 + gene_id) % 1000000 AS gene_id FROM b LEFT JOIN f USING (qname) GROUP BY b.qname),
n AS (SELECT *, count(*) OVER (PARTITION BY qname) AS n, lag(a_end) OVER (PARTITION BY qname ORDER BY block) AS before FROM bl),
x AS (SELECT qname, gene_id, trans_id, max(CASE WHEN n = 1 AND a_start >= start_pos AND a_end <= end_pos THEN 3 WHEN block = n - 1 AND (before IS NULL OR start_pos > before) THEN 2 ELSE 1 END) AS fit
      FROM n JOIN v_exons e ON e.chr = n.chr AND a_start <= end_pos AND start_pos <= a_end GROUP BY ALL),
i AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY qname ORDER BY fit DESC, gene_id, trans_id) = 1)
SELECT c.qname, class, c.gene_id, CAST(coalesce(fit, 0) AS INTEGER) AS iso_class, i.trans_id, i.gene_id AS iso_gene FROM c LEFT JOIN i USING (qname)""")
def _(v):
    v("v_points").createOrReplaceTempView("v_points")
    blocks = stored(v("v_points").sparkSession.sql(BLOCKS))
    return A.gene_class(blocks, v("v_genes"), v("v_exons")).join(A.isoform_class(blocks, v("v_exons")), "qname")


@query("chimeric_flag", "SELECT s.qname, s.flag, CASE WHEN b.q IS NOT NULL THEN 7 WHEN s.nm % 2 = 0 THEN 5 ELSE 6 END AS class FROM v_sam s LEFT JOIN (SELECT DISTINCT concat('r.', rname) AS q FROM v_bsj WHERE type = 20) b ON s.qname = b.q")
def _(v):
    ids = v("v_bsj").where("type = 20").select(F.concat(F.lit("r."), C("rname").cast("string")).alias("qname")).distinct().withColumn("bsj", F.lit(True))
    return v("v_sam").join(ids, "qname", "left").select("qname", "flag", F.when(C("bsj"), 7).when(C("nm") % 2 == 0, 5).otherwise(6).alias("class"))


@query("read_subset", "SELECT * FROM v_bsj WHERE rname IN (SELECT rname FROM v_points WHERE pos % 3 = 0)")
def _(v):
    return v("v_bsj").join(v("v_points").where("pos % 3 = 0").select("rname"), "rname", "left_semi")


@query("split_mate_role", "SELECT rname, ord FROM (SELECT rname, ord, count(*) OVER (PARTITION BY rname, ord % 2) AS n FROM v_map_cand WHERE ord <= 3) WHERE n = 1")
def _(v):
    rows = v("v_map_cand").where("ord <= 3").withColumn("n", F.count("*").over(Window.partitionBy("rname", C("ord") % 2)))
    return rows.where("n = 1").select("rname", "ord")


@query("read_id", "SELECT qname, CAST(regexp_extract(qname, '[.:/]([0-9]+)', 1) AS BIGINT) AS rid FROM v_sam")
def _(v):
    return v("v_sam").select("qname", F.regexp_extract("qname", "[.:/]([0-9]+)", 1).cast("long").alias("rid"))


TRUTH = "calls AS (SELECT chr, spos AS start_pos, epos AS end_pos, count(*) AS support FROM v_bsj GROUP BY ALL)"


@query("truth_match_candidates", f"WITH {TRUTH} SELECT c.chr, c.start_pos, c.end_pos, support, t.start_pos AS t_start, t.end_pos AS t_end, label FROM calls c JOIN v_truth t ON c.chr = t.chr AND abs(c.start_pos - t.start_pos) <= 10 AND abs(c.end_pos - t.end_pos) <= 10")
def _(v):
    return A.truth_candidates(_events(v), v("v_truth"))


def _events(v):
    return v("v_bsj").groupBy("chr", C("spos").alias("start_pos"), C("epos").alias("end_pos")).agg(F.count("*").alias("support"))


@query("truth_match", f"""WITH RECURSIVE {TRUTH},
k AS (SELECT c.chr, c.start_pos, c.end_pos, list(concat(t.chr, ':', t.start_pos, ':', t.end_pos) ORDER BY t.start_pos, t.end_pos) AS found, list({{'s': t.start_pos, 'e': t.end_pos}} ORDER BY t.start_pos, t.end_pos) AS spots
      FROM calls c JOIN v_truth t ON c.chr = t.chr AND abs(c.start_pos - t.start_pos) <= 10 AND abs(c.end_pos - t.end_pos) <= 10 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (ORDER BY chr, start_pos, end_pos) AS i FROM k),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS pick
      UNION ALL SELECT n.i, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, p FROM (SELECT n.i, g.used, list_filter(n.found, lambda x: NOT list_contains(g.used, x))[1] AS p FROM g JOIN n ON n.i = g.i + 1) n),
m AS (SELECT n.*, spots[list_position(found, pick)] AS t FROM n JOIN g USING (i) WHERE pick IS NOT NULL)
SELECT c.chr, c.start_pos, c.end_pos, m.t.s AS t_start, m.t.e AS t_end, CASE WHEN m.i IS NULL THEN 'FP' ELSE 'TP' END AS verdict FROM calls c LEFT JOIN m USING (chr, start_pos, end_pos)""")
def _(v):
    return A.truth_match(_events(v), v("v_truth"))


@query("truth_lookup", f"WITH {TRUTH}, t AS (SELECT DISTINCT concat('chr', chr, ':', start_pos, '-', end_pos) AS k FROM v_truth) SELECT c.chr, c.start_pos, c.end_pos, CASE WHEN k IS NULL THEN 'not found' ELSE 'found' END AS status FROM calls c LEFT JOIN t ON k = concat('chr', c.chr, ':', c.start_pos, '-', c.end_pos)")
def _(v):
    from ..operators.compare import event_key

    keys = ["chr", "start_pos", "end_pos"]
    truth = v("v_truth").select(event_key(F.regexp_replace("chr", "^chr", ""), C("start_pos"), C("end_pos"), ":").alias("event")).distinct().withColumn("status", F.lit("found"))
    calls = _events(v).select(*keys, event_key(C("chr"), C("start_pos"), C("end_pos"), ":").alias("event"))
    return calls.join(truth, "event", "left").select(*keys, F.coalesce("status", F.lit("not found")).alias("status"))


@query("read_event_verdict", """WITH r AS (SELECT rname, concat(chr, ':', spos) AS event, CASE WHEN rname % 5 = 0 THEN NULL WHEN rname % 5 = 1 THEN concat(chr, ':', spos + 120) WHEN rname % 5 = 2 THEN 'nowhere' ELSE concat(chr, ':', spos) END AS found FROM v_bsj), t AS (SELECT DISTINCT event AS f FROM r)
SELECT rname, CASE WHEN found IS NULL THEN 'not_found' WHEN found = event THEN 'correct' WHEN f IS NOT NULL THEN 'incorrect_existing_event' ELSE 'incorrect_nonexisting_event' END AS verdict FROM r LEFT JOIN t ON found = f""")
def _(v):
    name = lambda shift: F.concat("chr", F.lit(":"), (C("spos") + shift).cast("string"))
    reads = v("v_bsj").select("rname", name(0).alias("event"))
    reported = v("v_bsj").where("rname % 5 <> 0").select("rname", F.when(C("rname") % 5 == 1, name(120)).when(C("rname") % 5 == 2, "nowhere").otherwise(name(0)).alias("event"))
    return A.read_event_verdict(reads, reported, reads)


@query("event_membership", """WITH e AS (SELECT DISTINCT chr, spos, epos FROM v_bsj WHERE type = 20), c AS (SELECT rname, chr, type, [spos, spos + 20, epos - 20, epos, pos, pos + 50] AS x, start_signal AS tid FROM v_bsj JOIN v_points USING (rname, chr))
SELECT e.chr, e.spos, e.epos, tid, count(*) AS reads FROM e JOIN c ON e.chr = c.chr AND type = 20 AND list_contains(x, e.spos) AND list_contains(x, e.epos) GROUP BY ALL""")
def _(v):
    events = v("v_bsj").where("type = 20").select("chr", "spos", "epos").distinct()
    coords = F.array("spos", C("spos") + 20, C("epos") - 20, "epos", "pos", C("pos") + 50)
    rows = v("v_bsj").where("type = 20").join(v("v_points"), ["rname", "chr"]).select("rname", "chr", C("start_signal").alias("tid"), coords.alias("x"))
    # an event is met by its start among a row's coordinates, an equi-join; its end is the residual
    met = rows.withColumn("spos", F.explode(F.array_distinct("x"))).join(events, ["chr", "spos"]).where(F.array_contains("x", C("epos")))
    return met.groupBy("chr", "spos", "epos", "tid").agg(F.count("*").alias("reads"))


@query("event_transcripts", """WITH k AS (SELECT chr, spos, epos, start_signal AS tid, count(*) AS n, sum(CASE WHEN type = 20 THEN 1 ELSE 0 END) AS s FROM v_bsj GROUP BY ALL)
SELECT chr, spos, epos, CAST(sum(n) AS BIGINT) AS reads, CAST(sum(s) AS BIGINT) AS split_reads, count(*) AS transcripts, string_agg(concat(tid, ':', n), ',' ORDER BY n DESC, tid) AS by_count FROM k GROUP BY chr, spos, epos""")
def _(v):
    per = v("v_bsj").groupBy("chr", "spos", "epos", C("start_signal").alias("tid")).agg(F.count("*").alias("n"), F.sum((C("type") == 20).cast("long")).alias("s"))
    listed = F.array_sort(F.collect_list(F.struct((-C("n")).alias("m"), "tid", "n")))
    out = per.groupBy("chr", "spos", "epos").agg(F.sum("n").alias("reads"), F.sum("s").alias("split_reads"), F.count("*").alias("transcripts"), listed.alias("l"))
    return out.withColumn("by_count", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["tid"], x["n"].cast("string"))), ",")).drop("l")


# lines of an event: ten for each read, of up to a billion, and its summary after them
EVENT_LINES = 10_000_000_000
LOG = f"""SELECT chr AS log, spos * {EVENT_LINES} + rname * 10 AS line, concat('> n ', rname) AS value FROM v_bsj UNION ALL
SELECT chr, spos * {EVENT_LINES} + rname * 10 + 1, concat('** 1 ', rname % 50, ' ', 50) FROM v_bsj WHERE type = 20 UNION ALL
SELECT chr, spos * {EVENT_LINES} + {EVENT_LINES - 1}, concat('summary: g', spos, ' t', spos, ' ', chr, ':', spos, ' 300 ', count(*)) FROM v_bsj GROUP BY chr, spos"""
EVENTS = "SELECT chr AS log, concat(chr, ':', spos) AS event, concat('g', spos) AS gene_id, concat('t', spos) AS trans_id, CAST(300 AS BIGINT) AS spliced_len, count(*) AS declared, count(*) AS reads, CAST(sum(CASE WHEN type = 20 THEN 1 ELSE 0 END) AS BIGINT) AS split_reads FROM v_bsj GROUP BY chr, spos"


def _log(v):
    v("v_bsj").createOrReplaceTempView("v_bsj")
    return A.parse_sim_log(v("v_bsj").sparkSession.sql(LOG), EVENT_LINES)


@query("src_sim_log", EVENTS)
def _(v):
    return _log(v)


@query("event_support", f"SELECT event, declared, split_reads, declared = split_reads AS matches FROM ({EVENTS})")
def _(v):
    return A.event_support(_log(v))


@query("src_ciri_table", """WITH e AS (SELECT chr, spos, list_sort(list(DISTINCT concat('r', rname)) FILTER (type = 20)) AS a, list_sort(list(DISTINCT concat('r', rname)) FILTER (type <> 20)) AS b FROM v_bsj GROUP BY chr, spos)
SELECT concat(chr, ':', spos) AS event, CAST(coalesce(len(a), 0) // 2 AS BIGINT) AS split_reads, CAST(coalesce(len(b), 0) AS INTEGER) AS pair_reads, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ','), '') AS reads FROM e""")
def _(v):
    name = F.concat(F.lit("r"), C("rname").cast("string"))
    pack = lambda cond, suffix: F.array_join(F.transform(F.array_sort(F.collect_set(F.when(cond, name))), lambda x: F.concat(x, F.lit(suffix))), ",")
    rows = v("v_bsj").groupBy(F.concat("chr", F.lit(":"), C("spos").cast("string")).alias("event")).agg(pack(C("type") == 20, "(5)").alias("split_list"), pack(C("type") != 20, "&&").alias("pair_list"))
    return A.parse_ciri_table(rows)


@query("src_fastq_carried", "SELECT concat('r', rname) AS rname, CASE WHEN rname % 2 = 0 THEN spos END AS genome_spos, CASE WHEN rname % 2 = 0 THEN type ELSE 13 END AS type, CASE WHEN rname % 2 = 0 THEN chr END AS chr1, CASE WHEN rname % 2 = 0 THEN epos END AS spos1 FROM v_bsj")
def _(v):
    full = F.concat_ws(" ", F.concat(F.lit("r"), C("rname").cast("string")), C("spos").cast("string"), C("type").cast("string"), "chr", C("epos").cast("string"), *[F.lit("0")] * 18)
    return R.parse_carried(v("v_bsj").select(F.when(C("rname") % 2 == 0, full).otherwise(F.concat(F.lit("r"), C("rname").cast("string"), F.lit(" comment"))).alias("value")))


@query("sink_carried_state", "SELECT rname, ord, type FROM v_map_cand WHERE NOT (type = 0 AND gm) AND type IN (3, 4)")
def _(v):
    rows = v("v_map_cand").withColumn("skip", (C("type") == P.CONCRD) & C("gm"))
    return R.carried_state(rows, last=True).select("rname", "ord", "type")


@query("scan_skip", "SELECT rname, ord, (ord % 3 = 0 AND type = 0) OR (ord % 3 = 1 AND type = 0 AND gm AND ed = 0 AND mlen >= 190) AS skip FROM v_map_cand")
def _(v):
    return v("v_map_cand").select("rname", "ord", R.scan_skip(C("ord") % 3, C("type"), C("gm"), C("ed"), C("mlen") >= 190).alias("skip"))


@query("mate_status", "SELECT rname, ord, CASE WHEN gm AND ord > 2 AND ed <= 4 AND tlen % 20 <= 7 THEN 0 WHEN gm OR ord > 2 THEN 9 ELSE 11 END AS status FROM v_map_cand")
def _(v):
    return v("v_map_cand").select("rname", "ord", R.mate_status(C("gm"), C("ord") > 2, C("ed"), C("tlen") % 20).alias("status"))


@query("final_mate_class", """WITH k AS (SELECT *, CASE ed % 3 WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE 11 END AS k1, CASE tlen % 3 WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE 11 END AS k2 FROM v_map_cand)
SELECT rname, ord, least(type, CASE WHEN (k1 = 11 AND k2 = 0) OR (k1 = 0 AND k2 = 11) THEN 10 WHEN k1 = 11 OR k2 = 11 THEN 11 WHEN k1 = 0 AND k2 = 0 AND gm AND mlen > 180 THEN 6 WHEN k1 = 0 AND k2 = 0 THEN 8 ELSE 9 END) AS type FROM k""")
def _(v):
    kinds = F.array(F.lit(P.CONCRD), F.lit(P.CANDID), F.lit(P.ORPHAN))
    return v("v_map_cand").select("rname", "ord", R.final_mate_class(C("type"), kinds[C("ed") % 3], kinds[C("tlen") % 3], C("gm"), C("mlen") > 180).alias("type"))


@query("read_unmapped_class", "SELECT rname, ord, CASE WHEN ed % 3 = 0 AND tlen % 2 = 0 AND type > 3 AND mlen > 180 THEN 12 WHEN ed % 3 = 0 AND tlen % 2 = 0 THEN 13 WHEN ed % 3 = 0 OR tlen % 2 = 0 THEN 10 END AS class FROM v_map_cand")
def _(v):
    return v("v_map_cand").select("rname", "ord", R.unmapped_class(C("ed") % 3, C("tlen") % 2, (C("type") > 3).cast("int"), (C("mlen") > 180).cast("int")).alias("class"))


MATE = "m AS (SELECT rname, ord, 1 + tlen % 30 AS qspos, mlen - ed * 5 AS qepos, 200 AS qlen FROM v_map_cand)"


def _mates(v):
    return v("v_map_cand").select("rname", "ord", (1 + C("tlen") % 30).alias("qspos"), (C("mlen") - C("ed") * 5).alias("qepos"), F.lit(200).alias("qlen"))


@query("remaining_query", f"WITH {MATE}, r AS (SELECT *, CASE WHEN qspos - 1 >= qlen - qepos THEN 1 ELSE qepos + 1 END AS rem_start, CASE WHEN qspos - 1 >= qlen - qepos THEN qspos - 1 ELSE qlen END AS rem_end FROM m) SELECT * FROM r WHERE rem_end - rem_start + 1 >= 8")
def _(v):
    return R.remaining_query(_mates(v))


@query("partial_mate", "SELECT rname, ord, CASE WHEN mlen < tlen THEN 1 ELSE 2 END AS partial FROM v_map_cand")
def _(v):
    return v("v_map_cand").select("rname", "ord", F.when(C("mlen") < C("tlen"), 1).otherwise(2).alias("partial"))


@query("softclip_sides", f"WITH {MATE}, c AS (SELECT rname, ord, qspos - 1 AS l, qlen - qepos AS r, ord % 2 = 0 AS p FROM m) SELECT rname, ord, CASE WHEN p AND l > r THEN 0 ELSE l END AS \"left\", CASE WHEN p AND l <= r THEN 0 ELSE r END AS \"right\" FROM c")
def _(v):
    return _mates(v).select("rname", "ord", *[c.alias(k) for k, c in R.softclip_sides(C("qspos"), C("qepos"), C("qlen"), C("ord") % 2 == 0).items()])


FRAGS = "f AS (SELECT rname, list({'r': pos, 'q': ord * 30 + ed % 3, 'l': 20} ORDER BY ord) AS f FROM (SELECT *, ord * 30 + tlen % 4 AS pos FROM (SELECT * FROM v_map_cand QUALIFY row_number() OVER (PARTITION BY rname, ord ORDER BY type, ed, tlen, mlen, gm) = 1)) GROUP BY rname)"


def _frags(v):
    w = Window.partitionBy("rname", "ord").orderBy("type", "ed", "tlen", "mlen", "gm")
    rows = v("v_map_cand").withColumn("k", F.row_number().over(w)).where("k = 1")
    frag = F.struct("ord", (C("ord") * 30 + C("tlen") % 4).cast("long").alias("rpos"), (C("ord") * 30 + C("ed") % 3).cast("long").alias("qpos"), F.lit(20).alias("len"))
    return rows.groupBy("rname").agg(F.array_sort(F.collect_list(frag)).alias("frags"))


@query("middle_error_estimate", f"WITH {FRAGS}, g AS (SELECT rname, f, unnest(range(1, len(f))) AS i FROM f WHERE len(f) > 1), e AS (SELECT rname, abs((f[i+1].r - f[i].r) - (f[i+1].q - f[i].q)) AS s FROM g) SELECT f.rname, CAST(coalesce(sum(CASE WHEN s = 0 THEN 1 WHEN s <= 3 THEN s ELSE 0 END), 0) AS BIGINT) AS errors FROM f LEFT JOIN e USING (rname) GROUP BY f.rname")
def _(v):
    return _frags(v).select("rname", R.middle_error_estimate(C("frags")).alias("errors"))


@query("full_length_concordant", f"WITH {FRAGS} SELECT rname, len(f) >= 2 AND f[len(f)].q + 20 - f[1].q >= 110 AS concordant FROM f")
def _(v):
    return _frags(v).select("rname", R.full_length_concordant(C("frags"), F.lit(110)).alias("concordant"))


# parts of reads by position: of one split mate (a, b) beside a whole one (m), and of two split mates (l, r; x, y)
PARTS = """SELECT rname AS id, CASE WHEN rname % 2 = 0 THEN 1 ELSE -1 END AS d, spos + (rname % 3) * 100 AS a_s, spos + (rname % 3) * 100 + 50 AS a_e, spos + 100 - rname % 5 AS b_s, spos + 145 AS b_e,
spos + 20 * (rname % 13) AS m_s, spos + 20 * (rname % 13) + 99 AS m_e, rname % 6 AS cl, rname % 8 AS cr, 1 + 40 * (rname % 2) AS lq, 1 + 40 * ((rname + spos) % 2) AS rq, 1 + 60 * ((rname + epos) % 2) AS xq, 1 + 30 * (rname % 3) AS yq,
spos + 30 * (rname % 4) AS x_s, spos + 90 + 70 * (rname % 3) AS y_e FROM v_bsj"""


@query("split_order_class", f"""WITH p AS ({PARTS}),
t AS (SELECT *, CASE WHEN b_s > m_s AND b_s - m_s <= 7 - cl THEN b_s ELSE m_s END AS f_s, CASE WHEN m_e > a_e AND m_e - a_e <= 7 - cr THEN a_e ELSE m_e END AS f_e FROM p)
SELECT id, CAST(CASE WHEN a_e < b_s THEN CASE WHEN d = 1 AND f_s <= a_s THEN 0 WHEN d = 1 AND f_e >= b_e THEN 1 WHEN d = -1 AND f_e >= b_e THEN 0 WHEN d = -1 AND f_s <= a_s THEN 1 ELSE 30 END
  WHEN b_s <= a_s AND a_e >= b_e AND f_s >= b_s AND f_e <= a_e THEN 20 ELSE 30 END AS INTEGER) AS type,
  CASE WHEN lq < rq AND xq < yq THEN CASE WHEN d = 1 AND b_s <= x_s THEN 'FR' WHEN d = 1 AND a_e >= y_e THEN 'RF' WHEN d = -1 AND y_e - 40 <= a_s THEN 'FR' WHEN d = -1 AND x_s + 50 >= b_e THEN 'RF' ELSE 'UD' END
  WHEN lq < rq THEN 'two' WHEN xq < yq THEN 'one' WHEN a_s = x_s AND b_e = y_e THEN 'both' ELSE 'UD' END AS pair FROM t""")
def _(v):
    from ..operators.splits import pair_order, part, split_order, trimmed

    v("v_bsj").createOrReplaceTempView("v_bsj")
    rows = v("v_bsj").sparkSession.sql(PARTS)
    zero = F.lit(0)
    make = lambda s, e, q=zero, sl=zero, sr=zero: part(spos=s, epos=e, qspos=q, qepos=zero, sl=sl, sr=sr, mlen=zero, ed=zero, med=zero, dir=C("d"))
    rows = rows.withColumns({"full": make(C("m_s"), C("m_e"), sl=C("cl"), sr=C("cr")), "a": make(C("a_s"), C("a_e"), C("lq")), "b": make(C("b_s"), C("b_e"), C("rq")), "x": make(C("x_s"), C("x_s") + 50, C("xq")), "y": make(C("y_e") - 40, C("y_e"), C("yq"))})
    rows = rows.withColumn("full", trimmed(C("full"), C("b"), C("a")))
    return rows.select("id", split_order(C("full"), C("a"), C("b")).alias("type"), pair_order(C("a"), C("b"), C("x"), C("y")).alias("pair"))


@query("split_edit_gate", "SELECT rname, CASE WHEN rname % 3 + spos % 2 + epos % 4 > 4 THEN 30 ELSE type END AS type FROM v_bsj")
def _(v):
    return v("v_bsj").select("rname", R.split_edit_gate(C("type"), [C("rname") % 3, C("spos") % 2, C("epos") % 4]).alias("type"))


LENGTHS = "SELECT row_number() OVER (ORDER BY chr) AS ord, chr, length(seq) AS len FROM v_contigs"
PACKED = f"""WITH RECURSIVE l AS (SELECT CAST(ord AS INTEGER) AS ord, chr, CAST(len AS BIGINT) AS len FROM ({LENGTHS})),
p AS (SELECT ord, chr, 1 AS contig, CAST(0 AS BIGINT) AS b, len FROM l WHERE ord = 1 UNION ALL
  SELECT l.ord, l.chr, CASE WHEN p.b + p.len = 0 OR l.len + 50 + p.b + p.len > 100000 THEN p.contig + 1 ELSE p.contig END, CASE WHEN p.b + p.len = 0 OR l.len + 50 + p.b + p.len > 100000 THEN 0 ELSE p.b + p.len + 50 END, l.len FROM p JOIN l ON l.ord = p.ord + 1),
packed AS (SELECT contig AS contig_id, chr, b + 1 AS start_pos, b + len AS end_pos FROM p)"""


def _packed(v):
    lengths = v("v_contigs").select("chr", F.length("seq").cast("long").alias("len"))
    return R.pack_contigs(lengths.withColumn("ord", C("chr")), size=100_000)


@query("pack_contigs", f"{PACKED} SELECT * FROM packed")
def _(v):
    return _packed(v)


@query("chr_to_contig", f"{PACKED} SELECT rname AS id, contig_id, spos % 100 + start_pos - 1 AS pos FROM v_bsj b JOIN packed p ON p.chr = concat('c', b.rname % 500)")
def _(v):
    return R.chr_to_contig(v("v_bsj").select(C("rname").alias("id"), F.concat(F.lit("c"), (C("rname") % 500).cast("string")).alias("chr"), (C("spos") % 100).alias("chr_pos")), _packed(v))


@query("contig_to_chr", f"{PACKED} SELECT rname AS id, p.chr, spos - start_pos + 1 AS chr_pos FROM v_bsj b JOIN packed p ON contig_id = 1 + b.rname % 5 AND spos BETWEEN start_pos AND end_pos")
def _(v):
    return R.contig_to_chr(v("v_bsj").select(C("rname").alias("id"), (1 + C("rname") % 5).alias("contig_id"), C("spos").alias("pos")), _packed(v))


@query("global_pos", "SELECT rname, CAST(substr(chr, 4) AS BIGINT) * 1100000000 + spos AS genome_spos FROM v_bsj")
def _(v):
    return v("v_bsj").select("rname", (F.substring("chr", 4, 9).cast("long") * P.DEFAULT.contig_size + C("spos")).alias("genome_spos"))


@query("sort_by_genome_pos", "SELECT rname, CAST(substr(chr, 4) AS BIGINT) * 1100000000 + spos AS genome_spos FROM v_bsj WHERE type >= 20")
def _(v):
    rows = v("v_bsj").where("type >= 20").select("rname", (F.substring("chr", 4, 9).cast("long") * P.DEFAULT.contig_size + C("spos")).alias("genome_spos"))
    return rows.orderBy("genome_spos", "rname")


@query("round_union", "SELECT rname, type FROM v_bsj WHERE type = 20 UNION ALL SELECT rname, type FROM v_bsj WHERE type > 20")
def _(v):
    rows = v("v_bsj").select("rname", "type")
    return rows.where("type = 20").unionByName(rows.where("type > 20"))


@query("chain_keep_prefix", """WITH u AS (SELECT rname AS id, ord, ed AS missing FROM (SELECT *, row_number() OVER (PARTITION BY rname, ord ORDER BY type, ed, tlen, mlen, gm) AS k FROM v_map_cand) WHERE k = 1),
w AS (SELECT *, CASE WHEN missing > lag(missing) OVER (PARTITION BY id ORDER BY ord) THEN 1 ELSE 0 END AS f FROM u), s AS (SELECT *, max(f) OVER (PARTITION BY id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS stop FROM w) SELECT id, ord, missing FROM s WHERE stop = 0""")
def _(v):
    w = Window.partitionBy("rname", "ord").orderBy("type", "ed", "tlen", "mlen", "gm")
    rows = v("v_map_cand").withColumn("k", F.row_number().over(w)).where("k = 1")
    return R.chain_keep_prefix(rows.select(C("rname").alias("id"), "ord", C("ed").alias("missing")))


@query("top_chains", "SELECT rname, ord, mlen FROM (SELECT *, row_number() OVER (PARTITION BY rname ORDER BY mlen DESC, ord, tlen, ed, type, gm) AS k FROM v_map_cand) WHERE k <= 3")
def _(v):
    w = Window.partitionBy("rname").orderBy(F.desc("mlen"), "ord", "tlen", "ed", "type", "gm")
    return v("v_map_cand").withColumn("k", F.row_number().over(w)).where("k <= 3").select("rname", "ord", "mlen")
