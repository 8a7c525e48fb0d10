"""Views over the driver's tables that stand for reads, gene models and calls, in SQL that Spark and DuckDB share.

``{G}`` is the flag that makes DuckDB's regexp_replace replace every match; Spark always does.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark"]

_LETTERS = "translate(upper(regexp_replace(text,'[^A-Za-z]',''{G})),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','ACGTACGTACGTACGTACGTACGTAC')"

VIEWS = {
    "v_exons": """
SELECT concat('chr', CAST(c.c_nationkey % 5 AS string)) AS chr, c.c_custkey AS gene_id, o.o_orderkey AS trans_id,
       l.l_linenumber AS exon_num, CASE WHEN c.c_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
       CAST(c.c_custkey*120 + l.l_linenumber*60 + (l.l_partkey % 4)*5 AS bigint) AS start_pos,
       CAST(c.c_custkey*120 + l.l_linenumber*60 + (l.l_partkey % 4)*5 + 19 + (CAST(l.l_quantity AS bigint) % 3)*10 AS bigint) AS end_pos
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""",
    "v_genes": "SELECT chr, gene_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM v_exons GROUP BY chr, gene_id",
    "v_contigs": f"SELECT concat('c', CAST(doc_id AS string)) AS chr, {_LETTERS} AS seq FROM documents",
    "v_reads": f"SELECT item_id AS rname, {_LETTERS} AS seq FROM benchmark",
    "v_bsj": """
SELECT event_id AS rname, event_type AS sample, concat('chr', CAST(user_id % 5 AS string)) AS chr,
       CAST(user_id*120 + 60 AS bigint) AS spos, CAST(user_id*120 + 200 + (event_id % 3)*60 AS bigint) AS epos,
       CAST(CASE WHEN user_id % 4 = 3 THEN 21 + event_id % 2 ELSE 20 + (event_id % 7) % 3 END AS int) AS type,
       substr('ACGTAGCTAGGT', CAST(user_id % 10 AS int)+1, 2) AS start_signal,
       substr('CTAGACGTACTG', CAST((user_id + event_id % 4) % 10 AS int)+1, 2) AS end_signal,
       substr('ACGTAGCTAGGT', CAST(user_id % 10 AS int)+1, 2) AS start_bp_ref,
       substr('CTAGACGTACTG', CAST(user_id % 10 AS int)+1, 2) AS end_bp_ref
FROM events""",
    "v_calls": """
SELECT sample AS tool, CASE WHEN rname % 2 = 0 THEN 'pre' ELSE 'post' END AS cond, chr, spos AS start_pos, epos AS end_pos, count(*) AS support
FROM v_bsj GROUP BY sample, CASE WHEN rname % 2 = 0 THEN 'pre' ELSE 'post' END, chr, spos, epos""",
    "v_sizes": "SELECT sample AS tool, CASE WHEN rname % 2 = 0 THEN 'pre' ELSE 'post' END AS cond, count(*) AS reads FROM v_bsj GROUP BY sample, CASE WHEN rname % 2 = 0 THEN 'pre' ELSE 'post' END",
    "v_truth": "SELECT DISTINCT chr, spos + (spos % 13) AS start_pos, epos - (epos % 7) AS end_pos, concat('chr',chr) AS label FROM v_bsj WHERE type = 20",
    "v_map_cand": """
SELECT l_orderkey AS rname, l_linenumber AS ord, CAST(l_suppkey % 14 AS int) AS type, l_returnflag = 'A' AS gm,
       CAST(CAST(l_quantity AS bigint) % 9 AS int) AS ed, CAST(l_partkey % 600 AS int) AS tlen, CAST(200 - l_partkey % 30 AS int) AS mlen
FROM lineitem""",
    "v_sam": """
SELECT concat('r.', CAST(l_orderkey AS string)) AS qname, CAST(CASE WHEN l_linenumber % 2 = 1 THEN 99 ELSE 147 END AS int) AS flag,
       concat('chr', CAST(l_suppkey % 5 AS string)) AS rname, l_partkey*10 AS pos,
       concat(CAST(l_linenumber AS string),'S',CAST(20 + l_partkey % 30 AS string),'M',CAST(100 + l_suppkey % 50 AS string),'N',CAST(10 + l_orderkey % 40 AS string),'M',
              CASE WHEN l_returnflag = 'R' THEN '2I5M1D4M' ELSE '' END) AS cigar,
       CAST(CAST(l_tax*100 AS bigint) % 5 AS int) AS nm
FROM lineitem WHERE l_linenumber <= 2""",
    "v_pairs": "SELECT a.p_partkey AS pair_id, a.p_name AS q, b.p_name AS r FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
    "v_points": "SELECT rname, chr, spos + (rname % 97) AS pos FROM v_bsj",
}

#: From so many lines on they are dealt in shares of SHARE instead of in the session's number of partitions; of MOST, where that makes over
#: 200 partitions, up to which Spark writes a shuffle without sorting what a task reads.
LARGE, SHARE, MOST = 4_000_000, 250_000, 2_000_000

_NEEDS = {name: [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", sql)] for name, sql in VIEWS.items()}


def _large_exons(spark: SparkSession, sf_dir: str, lines: int) -> DataFrame:
    """v_exons of so many lines, where orders meet customers before they meet lines.

    Each join is dealt in shares, so that the sorts of a task don't grow with the tables. The rows stay dealt by trans_id.
    """
    parts = max(min(-(-lines // SHARE), 200), -(-lines // MOST))
    for table, key in (("lineitem", "l_orderkey"), ("orders", None), ("customer", "c_custkey")):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        (rows.repartition(parts, key) if key else rows).createOrReplaceTempView(table)
    columns = VIEWS["v_exons"].partition("FROM lineitem")[0]
    return spark.sql(f"{columns} FROM lineitem l JOIN (orders o JOIN customer c ON o.o_custkey = c.c_custkey) ON l.l_orderkey = o.o_orderkey")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a fixture view as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "v_exons" and (lines := spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()) >= LARGE:
        return _large_exons(spark, sf_dir, lines)
    for need in _NEEDS[name]:
        view(spark, sf_dir, need).createOrReplaceTempView(need)
    for table in TABLES:
        if re.search(rf"\b{table}\b", VIEWS[name]):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(VIEWS[name].replace("{G}", ""))


def duckdb_sql(body: str) -> str:
    """A DuckDB statement: body, after the fixture views that it names. A body may begin with WITH."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS[name]:
            need(x)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", body):
            need(name)
    ctes = [f"{name} AS ({VIEWS[name].replace('{G}', chr(44) + chr(39) + 'g' + chr(39))})" for name in wanted]
    body = body.strip()
    recursive = "RECURSIVE " if re.match(r"WITH RECURSIVE\b", body) else ""
    if re.match(r"WITH\b", body):
        ctes.append(re.sub(r"^WITH (RECURSIVE )?", "", body))
        return f"WITH {recursive}" + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
