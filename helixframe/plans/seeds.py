"""Queries on k-mers, chains and pairwise alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairwise, seeds
from .registry import query

C = F.col
INDEX = "ix AS (SELECT substr(seq, CAST(i AS INTEGER), {k}) AS kmer, chr, CAST(i AS BIGINT) AS rpos FROM (SELECT chr, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM v_contigs WHERE length(seq) >= {k}))"
READS = "rk AS (SELECT rname, dir, i AS qpos, substr(seq, CAST(i + 1 AS INTEGER), {k}) AS kmer FROM (SELECT rname, dir, seq, unnest(range(0, length(seq) - {k} + 1, {k})) AS i FROM (SELECT rname, 1 AS dir, seq FROM v_reads UNION ALL SELECT rname, -1, translate(reverse(seq), 'ACGT', 'TGCA') FROM v_reads) WHERE length(seq) >= {k}))"


def _sql(text: str, k: int) -> str:
    return text.replace("{k}", str(k))


@query("kmer_index", f"WITH {_sql(INDEX, 20)} SELECT * FROM ix")
def _(v):
    return seeds.kmer_index(v("v_contigs"), 20).select(seeds.kmer_of(C("code"), 20).alias("kmer"), "chr", "rpos")


@query("kmer_counts", f"WITH {_sql(INDEX, 8)} SELECT kmer, count(*) AS n FROM ix GROUP BY kmer")
def _(v):
    return seeds.kmer_counts(v("v_contigs"), 8).select(seeds.kmer_of(C("code"), 8).alias("kmer"), "n")


@query("sort_seed_lists", f"WITH {_sql(INDEX, 20)}, {_sql(READS, 20)} SELECT kmer, string_agg(concat(chr, ':', rpos), ',' ORDER BY chr, rpos) AS places FROM ix WHERE kmer IN (SELECT kmer FROM rk) GROUP BY kmer")
def _(v):
    wanted = seeds.read_kmers(v("v_reads"), 20).select("code").distinct()
    lists = seeds.sort_seed_lists(seeds.index_of(v("v_contigs"), 20, wanted))
    return lists.select(seeds.kmer_of(C("code"), 20).alias("kmer"), F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["chr"], p["rpos"].cast("string"))), ",").alias("places"))


@query("kmer_seed_join", f"WITH {_sql(INDEX, 20)}, {_sql(READS, 20)} SELECT rname, dir, CAST(qpos AS INTEGER) AS qpos, chr, rpos FROM rk JOIN ix USING (kmer)")
def _(v):
    return seeds.kmer_seed_join(v("v_reads"), v("v_contigs"), 20)


@query("seed_cap", f"WITH {_sql(INDEX, 8)}, {_sql(READS, 8)}, n AS (SELECT kmer FROM ix GROUP BY kmer HAVING count(*) <= 20) SELECT rname, dir, CAST(qpos AS INTEGER) AS qpos, chr, rpos FROM rk JOIN ix USING (kmer) WHERE kmer IN (SELECT kmer FROM n)")
def _(v):
    return seeds.kmer_seed_join(v("v_reads"), v("v_contigs"), 8, limit=20)


@query("seed_rate", f"WITH {_sql(INDEX, 8)}, {_sql(READS, 8)}, n AS (SELECT kmer, count(*) AS n FROM ix GROUP BY kmer) SELECT rname, CAST(sum(CASE WHEN n <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS valid, CAST(sum(CASE WHEN n <= 20 THEN 0 ELSE 1 END) AS BIGINT) AS invalid FROM rk LEFT JOIN n USING (kmer) GROUP BY rname")
def _(v):
    return seeds.seed_rate(seeds.read_kmers(v("v_reads"), 8), seeds.kmer_counts(v("v_contigs"), 8), 20)


@query("seed_bins", f"WITH {_sql(INDEX, 8)}, {_sql(READS, 8)}, b AS (SELECT rname, chr, rpos // 500 AS bin, count(*) AS hits FROM rk JOIN ix USING (kmer) GROUP BY ALL) SELECT rname, chr, bin, hits FROM b QUALIFY row_number() OVER (PARTITION BY rname, chr ORDER BY hits DESC, bin) = 1")
def _(v):
    return seeds.best_seed_bins(v("v_reads"), v("v_contigs"), 8, 500)


@query("composition_window", """WITH w AS (SELECT chr, i AS pos, substr(seq, CAST(i AS INTEGER), 500) AS s FROM (SELECT chr, seq, unnest(range(1, length(seq) - 498)) AS i FROM v_contigs WHERE length(seq) >= 500))
SELECT chr, CAST(pos AS INTEGER) AS pos, 500 - length(replace(s, 'A', '')) AS a, 500 - length(replace(s, 'C', '')) AS c, 500 - length(replace(s, 'G', '')) AS g, 500 - length(replace(s, 'T', '')) AS t FROM w""")
def _(v):
    return seeds.composition_window(v("v_contigs"), 500)


HITS = f"{_sql(INDEX, 20)}, {_sql(READS, 20)}, h AS (SELECT rname, dir, CAST(qpos AS INTEGER) AS qpos, chr, rpos FROM rk JOIN ix USING (kmer))"


def regional(v):
    """Whole reads against every contig that one of their seeds hits, as leftovers are searched in the gene of their anchor."""
    reads, contigs = v("v_reads"), v("v_contigs")
    anchors = seeds.kmer_seed_join(reads, contigs, 20).select("rname", C("chr").alias("gene_id")).distinct()
    queries = anchors.join(reads, "rname").select(F.concat_ws("/", C("rname").cast("string"), "gene_id").alias("id"), "gene_id", "seq")
    return queries, contigs.select(C("chr").alias("gene_id"), F.lit(1001).cast("long").alias("start_pos"), "seq")


@query("regional_kmer_join", f"""WITH {HITS}, g AS (SELECT chr AS gene_id, seq FROM v_contigs WHERE chr IN (SELECT chr FROM h)),
q AS (SELECT concat(r.rname, '/', a.chr) AS id, a.chr AS gene_id, r.seq AS s FROM (SELECT DISTINCT rname, chr FROM h) a JOIN v_reads r ON r.rname = a.rname),
k AS (SELECT id, gene_id, i AS qpos, substr(s, CAST(i + 1 AS INTEGER), 8) AS kmer FROM (SELECT *, unnest(range(0, length(s) - 7, 3)) AS i FROM q WHERE length(s) >= 8)),
x8 AS (SELECT gene_id, i AS rpos, substr(seq, CAST(i AS INTEGER), 8) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - 6)) AS i FROM g WHERE length(seq) >= 8)),
n AS (SELECT gene_id, kmer FROM x8 GROUP BY ALL HAVING count(*) <= 500)
SELECT id, gene_id, CAST(qpos AS INTEGER) AS qpos, rpos + 1000 AS rpos FROM k JOIN n USING (gene_id, kmer) JOIN x8 USING (gene_id, kmer)""")
def _(v):
    return seeds.regional_kmer_join(*regional(v))


DNA = "translate(upper({c}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ', 'ACGTACGTACGTACGTACGTACGTACN')"


def _pairs(v):
    dna = lambda c: F.translate(F.upper(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ ", "ACGTACGTACGTACGTACGTACGTACN")
    return v("v_pairs").select("pair_id", dna("q").alias("q"), dna("r").alias("r"))


D = f"d AS (SELECT pair_id, {DNA.replace('{c}', 'q')} AS q, {DNA.replace('{c}', 'r')} AS r FROM v_pairs), e AS (SELECT pair_id, regexp_replace(q, '[^ACGT]', 'x', 'g') AS q, regexp_replace(r, '[^ACGT]', 'y', 'g') AS r FROM d)"


@query("pairwise_edit", f"WITH {D} SELECT pair_id, CAST(levenshtein(q, r) AS INTEGER) AS ed, CASE WHEN levenshtein(q, r) <= 12 THEN CAST(levenshtein(q, r) AS INTEGER) END AS banded FROM e")
def _(v):
    return _pairs(v).select("pair_id", pairwise.edit_distance(C("q"), C("r")).alias("ed"), pairwise.edit_distance(C("q"), C("r"), 12).alias("banded"))


@query("pairwise_hamming", f"""WITH {D}, n AS (SELECT pair_id, q, r, least(length(q), length(r)) AS n FROM e),
x AS (SELECT pair_id, n, n - i + 1 AS k, CASE WHEN substr(q, CAST(i AS INTEGER), 1) <> substr(r, CAST(i AS INTEGER), 1) THEN 1 ELSE 0 END AS off FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM n)),
s AS (SELECT *, sum(off) OVER (PARTITION BY pair_id ORDER BY k) AS side FROM x),
c AS (SELECT pair_id, coalesce(max(k) FILTER (k <= 7 AND off = 1 AND 2 * side >= k), 0) AS clip, sum(off) AS total, max(off) FILTER (k = 8) AS next_off FROM s GROUP BY pair_id)
SELECT c.pair_id, CAST(total AS INTEGER) AS mismatches, CAST(clip AS INTEGER) AS clip, CASE WHEN clip = 7 AND next_off = 1 THEN NULL ELSE CAST(total - coalesce(side, 0) AS INTEGER) END AS clipped
FROM c LEFT JOIN s ON s.pair_id = c.pair_id AND s.k = clip""")
def _(v):
    n = F.least(F.length("q"), F.length("r"))
    clipped = pairwise.clip_hamming(C("q"), C("r"))
    return _pairs(v).select("pair_id", pairwise.hamming(F.left("q", n), F.left("r", n)).alias("mismatches"), clipped["clip"].alias("clip"), clipped["mismatches"].alias("clipped"))


@query("pairwise_clip_align", f"""WITH {D}, t AS (SELECT pair_id, c, d, length(q) - c AS n, length(q) - c + d AS j, q, r FROM e, (SELECT unnest(range(0, 8)) AS c), (SELECT unnest(range(-3, 4)) AS d)),
x AS (SELECT pair_id, c, d, CASE WHEN n = 0 THEN j WHEN j = 0 THEN n ELSE levenshtein(substr(q, 1, CAST(n AS INTEGER)), substr(r, 1, CAST(j AS INTEGER))) END AS ed FROM t WHERE n >= 0 AND j BETWEEN 0 AND length(r)),
b AS (SELECT * FROM x WHERE ed <= 4 QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY c + 2 * ed, ed, abs(d), d) = 1)
SELECT e.pair_id, CAST(c AS INTEGER) AS clip, CAST(d AS INTEGER) AS indel, CAST(ed AS INTEGER) AS ed FROM e LEFT JOIN b USING (pair_id)""")
def _(v):
    return pairwise.pairwise_clip_align(_pairs(v))


@query("pairwise_xdrop")
def _(v):
    return pairwise.pairwise_xdrop(_pairs(v))


@query("middle_edit", f"WITH {D} SELECT pair_id, CAST(levenshtein(substr(q, 3, 10), substr(r, 3, 10)) + levenshtein(substr(q, 15, 8), substr(r, 15, 8)) AS INTEGER) AS ed FROM e")
def _(v):
    q, r = C("q"), C("r")
    gaps = [(3, 10), (15, 8)]
    return _pairs(v).select("pair_id", sum(pairwise.edit_distance(F.substring(q, a, n), F.substring(r, a, n)) for a, n in gaps).alias("ed"))
