"""Queries on file sources and mate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pairs, report
from ..operators.alignments import sam_header
from ..operators.tables import scratch, stored
from ..sources import files
from .calls import REPORT_SQL
from .registry import query

C = F.col


def _written(lines: DataFrame) -> str:
    path = scratch(lines.sparkSession)
    lines.write.text(path)
    return path


@query("src_fasta", "SELECT chr, seq, CAST(length(seq) AS BIGINT) AS len FROM v_contigs")
def _(v):
    rows = v("v_contigs")
    wrapped = F.regexp_replace("seq", "(.{70})", "$1\n")
    return files.read_fasta(rows.sparkSession, _written(rows.select(F.concat(F.lit(">"), "chr", F.lit(" x\n"), wrapped).alias("value"))))


FASTQ = "SELECT chr AS rname, seq, reverse(seq) AS qual FROM v_contigs WHERE length(seq) >= 10"


def _fastq(v, mate):
    """Reads as FASTQ in several files; the files of both mates are dealt alike."""
    rows = v("v_contigs").where(F.length("seq") >= 10)
    seq, qual = ("seq", F.reverse("seq")) if mate == 1 else (F.reverse("seq"), C("seq"))
    record = F.concat(F.lit("@"), "chr", F.lit(f"/{mate} c\n"), seq, F.lit("\n+\n"), qual)
    return files.read_fastq(rows.sparkSession, _written(rows.repartition(6, "chr").sortWithinPartitions("chr").select(record.alias("value"))))


@query("src_fastq", FASTQ + " ")
def _(v):
    return _fastq(v, 1).where("ok").select("rname", "seq", "qual")


@query("src_fastq_pair", "SELECT chr AS rname, seq AS seq1, reverse(seq) AS seq2, true AS same_name FROM v_contigs WHERE length(seq) >= 10")
def _(v):
    return files.pair_fastq(_fastq(v, 1), _fastq(v, 2)).drop("pair", "rec")


def _pam(v):
    names = {c.split()[0]: c.split()[1] for c in files.PAM.split(", ")}
    have = {"rname": F.concat(F.lit("r"), C("rname").cast("string")), "chr1": C("chr"), "chr2": C("chr"), "spos1": C("spos"), "epos1": C("spos") + 99, "spos2": C("epos"), "epos2": C("epos") + 99, "type": (C("rname") % 14).cast("int"), "dir1": F.lit("+"), "dir2": F.lit("-")}
    return v("v_bsj").select(*[have.get(n, F.lit(0)).cast(k).alias(n) for n, k in names.items()])


@query("src_pam", "SELECT concat('r', rname) AS rname, CASE WHEN rname % 14 IN (0, 1, 2, 3, 4, 5, 7) THEN chr END AS chr1, CASE WHEN rname % 14 IN (0, 1, 2, 3, 4, 5, 7) THEN spos END AS spos1, CAST(rname % 14 AS INTEGER) AS type FROM v_bsj")
def _(v):
    rows, path = _pam(v), scratch(v("v_bsj").sparkSession)
    files.write_pam(rows, path)
    return files.read_pam(rows.sparkSession, path).select("rname", "chr1", "spos1", "type")


@query("sink_pam", "SELECT CAST(rname % 14 AS INTEGER) AS type, count(*) AS n, count(*) FILTER (rname % 14 IN (0, 1, 2, 3, 4, 5, 7)) AS placed FROM v_bsj GROUP BY ALL")
def _(v):
    rows, path = _pam(v), scratch(v("v_bsj").sparkSession)
    files.write_pam(rows, path)
    return files.read_pam(rows.sparkSession, path).groupBy("type").agg(F.count("*").alias("n"), F.count("spos2").alias("placed"))


def _sam(v):
    rows = v("v_sam").select("qname", F.when(C("nm") == 4, 256).otherwise(C("flag")).alias("flag"), "rname", "pos", F.lit(60).alias("mapq"), "cigar", F.lit("=").alias("rnext"), C("pos").alias("pnext"), F.lit(0).cast("long").alias("tlen"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"), F.create_map(F.lit("NM"), C("nm").cast("string")).alias("tags"))
    path = scratch(rows.sparkSession)
    files.write_sam(rows, sam_header(v("v_contigs").select("chr", F.length("seq").alias("len"))), path)
    return files.read_sam(rows.sparkSession, path)


@query("src_sam", "SELECT qname, flag, rname, pos, cigar, nm FROM v_sam WHERE nm <> 4")
def _(v):
    return _sam(v).select("qname", "flag", "rname", "pos", "cigar", C("tags")["NM"].cast("int").alias("nm"))


@query("sink_sam", "SELECT rname, count(*) AS rows FROM v_sam WHERE nm <> 4 GROUP BY rname")
def _(v):
    return _sam(v).groupBy("rname").agg(F.count("*").alias("rows"))


@query("src_circ_report", f"""WITH {REPORT_SQL.strip()[5:]},
n AS (SELECT 'new' AS layout, * FROM rp UNION ALL SELECT 'old', chr, start_pos, end_pos, support, type, NULL, NULL, NULL, reads FROM rp)
SELECT * FROM n""")
def _(v):
    rows = report.bsj_report(v("v_bsj"))
    new, old = scratch(rows.sparkSession), scratch(rows.sparkSession)
    files.write_report(rows, new)
    rows.select("chr", "start_pos", "end_pos", "support", "type", "reads").write.csv(old, sep="\t")
    back = [files.read_report(rows.sparkSession, path).withColumn("layout", F.lit(name)) for name, path in (("new", new), ("old", old))]
    return back[0].unionByName(back[1]).withColumn("reads", F.array_join("reads", ","))


@query("sink_circ_report", "SELECT chr, count(*) AS events, CAST(sum(n) AS BIGINT) AS support FROM (SELECT chr, spos, epos, count(*) AS n, min(type) AS t FROM v_bsj GROUP BY ALL) WHERE t = 20 GROUP BY chr")
def _(v):
    rows = report.bsj_report(v("v_bsj"))
    path = scratch(rows.sparkSession)
    files.write_report(rows, path)
    return files.read_report(rows.sparkSession, path).groupBy("chr").agg(F.count("*").alias("events"), F.sum("support").alias("support"))


@query("sink_candidates", "SELECT CAST(rname AS VARCHAR) AS rname, chr, CASE WHEN type = 20 THEN CAST(epos AS VARCHAR) END AS second, CAST(type AS VARCHAR) AS type FROM v_bsj")
def _(v):
    rows = v("v_bsj").select("rname", "chr", F.when(C("type") == 20, C("epos")).alias("second"), "type")
    path = scratch(rows.sparkSession)
    files.write_candidates(rows, path)
    return rows.sparkSession.read.csv(path, sep="\t", nullValue="*", schema="rname string, chr string, second string, type string")


@query("transcript_intersection", "WITH t AS (SELECT gene_id, list(DISTINCT trans_id) FILTER (exon_num <= 2) AS a, list(DISTINCT trans_id) FILTER (exon_num >= 2) AS b FROM v_exons GROUP BY gene_id) SELECT gene_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS common FROM t WHERE a IS NOT NULL AND b IS NOT NULL")
def _(v):
    sets = v("v_exons").groupBy("gene_id").agg(F.collect_set(F.when(C("exon_num") <= 2, C("trans_id"))).alias("a"), F.collect_set(F.when(C("exon_num") >= 2, C("trans_id"))).alias("b"))
    return sets.where("size(a) > 0 AND size(b) > 0").select("gene_id", F.array_join(F.array_sort(pairs.transcript_intersection(C("a"), C("b"))).cast("array<string>"), ",").alias("common"))


@query("same_transcript", """WITH t AS (SELECT gene_id, list_sort(list(DISTINCT trans_id) FILTER (exon_num = 1)) AS a, list_sort(list(DISTINCT trans_id) FILTER (exon_num = 6)) AS b, list_sort(list(DISTINCT trans_id) FILTER (exon_num = 3)) AS c FROM v_exons GROUP BY gene_id)
SELECT gene_id, coalesce(list_min(list_intersect(coalesce(a, []), coalesce(b, []))), list_min(list_intersect(coalesce(a, []), coalesce(c, [])))) AS trans_id FROM t""")
def _(v):
    at = lambda k: F.array_sort(F.collect_set(F.when(C("exon_num") == k, C("trans_id"))))
    sets = v("v_exons").groupBy("gene_id").agg(at(1).alias("a"), at(6).alias("b"), at(3).alias("c"))
    return sets.select("gene_id", pairs.same_transcript([(C("a"), C("b")), (C("a"), C("c"))]).alias("trans_id"))


CHAINS = "SELECT DISTINCT l_orderkey % 4000 AS rname, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS mate, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END AS dir, concat('chr', CAST(l_suppkey % 3 AS STRING)) AS chr, l_partkey * 40 AS pos, l_partkey * 40 + 20 + l_suppkey % 60 AS end_pos, l_quantity AS score, l_partkey % 50 AS gene_id, l_suppkey % 7 AS trans_id FROM lineitem"
PAIRED = f"""c AS ({CHAINS}), j AS (SELECT a.rname, a.chr, a.pos AS pos1, b.pos AS pos2, a.dir AS dir1, CASE WHEN a.pos < b.pos THEN b.end_pos - a.pos ELSE a.end_pos - b.pos END AS tlen, a.trans_id = b.trans_id AS t, a.gene_id = b.gene_id AS g, a.score + b.score AS score
FROM c a JOIN c b ON a.rname = b.rname AND a.chr = b.chr AND a.mate = 1 AND b.mate = 2 AND a.dir <> b.dir)"""


def _chains(v):
    v("lineitem").createOrReplaceTempView("lineitem")
    return v("lineitem").sparkSession.sql(CHAINS).withColumn("trans_ids", F.array("trans_id"))


@query("mate_pair_candidates", f"WITH {PAIRED} SELECT rname, chr, pos1, pos2, tlen, CASE WHEN t THEN 0 WHEN g THEN 1 ELSE 2 END AS kind, score FROM j WHERE t OR g OR tlen <= 20000")
def _(v):
    return pairs.mate_pair_candidates(_chains(v))


@query("mate_pair_candidates_gated", f"WITH {PAIRED}, s AS (SELECT *, (rname % 5 + 3) AS saved FROM j) SELECT rname, chr, pos1, pos2, tlen, CASE WHEN t THEN 0 WHEN g AND saved >= 5 THEN 1 ELSE 2 END AS kind, score FROM s WHERE t OR (g AND saved >= 5) OR (tlen <= 20000 AND saved >= 7)")
def _(v):
    chains = _chains(v)
    saved = chains.select("rname", (C("rname") % 5 + 3).cast("int").alias("type")).distinct()
    return pairs.mate_pair_candidates(chains, saved=saved)


@query("unpaired_chains", f"WITH {PAIRED}, k AS (SELECT * FROM j WHERE t OR g OR tlen <= 20000) SELECT rname, mate, dir, chr, pos FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.rname = c.rname AND k.chr = c.chr AND ((c.mate = 1 AND k.pos1 = c.pos AND k.dir1 = c.dir) OR (c.mate = 2 AND k.pos2 = c.pos AND k.dir1 = -c.dir)))")
def _(v):
    return pairs.unpaired_chains(stored(_chains(v))).select("rname", "mate", "dir", "chr", "pos")
