"""Queries over small tables with large keys or ties against their DuckDB statements."""

import random

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from helixframe.catalog import oracle_sql, queries


def both(spark, path, name, **tables):
    """The sorted rows of a query and of its statement over tables, lists of dicts with one schema each."""
    with duckdb.connect() as db:
        for table, (schema, rows) in tables.items():
            spark.createDataFrame([Row(**r) for r in rows], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{table}.parquet")
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
        got = queries()[name](spark, str(path))
        want = db.execute(oracle_sql()[name])
        names = [c[0] for c in want.description]
        order = lambda rows: sorted(rows, key=repr)
        return order(tuple(r[c] for c in names) for r in got.collect()), order(want.fetchall())


LINES = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_returnflag string, l_tax double"
EVENTS = "event_id long, user_id long, event_type string"


def line(**changed):
    return {"l_orderkey": 1, "l_linenumber": 1, "l_suppkey": 5, "l_partkey": 1, "l_quantity": 3.0, "l_returnflag": "A", "l_tax": 0.02} | changed


def test_best_mapping_of_equal_order(spark, tmp_path):
    """Of mappings that differ in their template length only, the shorter one, in whatever order they come."""
    rows = [line(l_orderkey=k, l_partkey=p + 30 * (x if k % 2 else 5 - x)) for k in range(40) for p in (4,) for x in range(6)]
    got, want = both(spark, tmp_path, "best_mapping", lineitem=(LINES, rows))
    assert got == want
    assert {r[5] for r in got} == {4}


@pytest.mark.parametrize("name", ["src_sim_log", "event_support"])
def test_logs_of_many_reads(spark, tmp_path, name):
    """Reads with large numbers come before the summary of their event."""
    rows = [{"event_id": e * x, "user_id": e % 4 + x // 1000, "event_type": "a"} for e in range(1, 40) for x in (1, 2_500, 3_000_001)]
    got, want = both(spark, tmp_path, name, events=(EVENTS, rows))
    assert got == want and len(got) > 4


@pytest.mark.parametrize("seed", range(3))
def test_contigs_are_packed_one_by_one(spark, seed):
    """Against a loop, with empty chromosomes and some that are longer than a contig; no list of all of them is made."""
    from helixframe.operators import reads

    draw = random.Random(seed)
    lengths = [draw.choice((0, 1, 7, 30, draw.randrange(60), 100, 101, 250)) for _ in range(400 * seed + 1)]
    contig, cur, want = 0, 0, []
    for i, n in enumerate(lengths):
        fresh = cur == 0 or n + 5 + cur > 100
        contig, begin = contig + fresh, 0 if fresh else cur + 5
        cur = begin + n
        want.append((contig, f"c{i}", begin + 1, cur))
    rows = spark.createDataFrame([(i, f"c{i}", n) for i, n in enumerate(lengths)], "ord int, chr string, len long")
    packed = reads.pack_contigs(rows, 100, 5)
    assert sorted(map(tuple, packed.collect())) == sorted(want)
    assert "collect_list" not in packed._jdf.queryExecution().optimizedPlan().toString()
    spots = [(k, 1 + k % want[-1][0], k % 260) for k in range(1_000)]
    back = reads.contig_to_chr(spark.createDataFrame(spots, "id long, contig_id int, pos long"), packed)
    assert sorted(map(tuple, back.collect())) == sorted((k, c, pos - s + 1) for k, at, pos in spots for i, c, s, e in want if i == at and s <= pos <= e)


def test_reads_from_nowhere_have_no_seed(spark):
    """No 20 bases of them are known throughout, so that none is in a gene by chance."""
    from helixframe.plans.circ import _nowhere

    rows = spark.range(200).selectExpr("concat('g', id) AS chr", "id % 3 AS k").select(_nowhere("n").alias("seq")).collect()
    assert all(len(r.seq) == 100 and all("N" in r.seq[i : i + 20] for i in range(81)) for r in rows)
    assert len({r.seq for r in rows}) == 200


def test_sam_headers_are_written_by_many_tasks(spark, tmp_path):
    """The tasks that read the sequences write their lines; read in the order of the files, the first line comes first."""
    from helixframe.operators.alignments import sam_header
    from helixframe.sources import files

    lengths = spark.range(0, 400, 1, 8).selectExpr("concat('c', id) AS chr", "CAST(id AS int) AS len")
    rows = spark.sql("SELECT 'r' AS qname, 0 AS flag, 'c1' AS rname, 5L AS pos, 60 AS mapq, '4M' AS cigar, '=' AS rnext, 5L AS pnext, 0L AS tlen, 'ACGT' AS seq, 'IIII' AS qual, map('NM', '1') AS tags")
    files.write_sam(rows, sam_header(lengths), str(tmp_path))
    parts = sorted((tmp_path / "part=0").glob("part-*"))
    lines = [x for p in parts for x in p.read_text().splitlines()]
    assert lines[0].startswith("@HD") and sorted(lines[1:]) == sorted(f"@SQ\tSN:c{i}\tLN:{i}" for i in range(400))
    assert max(len(p.read_text().splitlines()) for p in parts) <= 60
    assert files.read_sam(spark, str(tmp_path)).count() == 1


@pytest.mark.parametrize("name", ["split_realign", "rescue_overlap"])
def test_changed_bases_that_an_indel_explains_for_less(spark, tmp_path, name):
    """Genes in which changed bases cost fewer edits, found among 280,000, and some in which they cost what was changed."""
    better = {128_313: 2, 151_660: 4, 180_857: 4}
    rows = [{"c_custkey": k} for k in [*better, *range(1, 60)]]
    got, want = both(spark, tmp_path, name, customer=("c_custkey long", rows))
    assert got == want
    assert {r[0]: r[-1] for r in got if r[0] in better} == better


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_lines_of_large_gene_models_are_dealt_in_shares(spark, tmp_path, monkeypatch, broadcast):
    """However few partitions the session has; with keys that are null, unknown or there twice, the rows are those of the statement."""
    from helixframe.plans import fixtures

    for name, value in (("LARGE", 3_000), ("SHARE", 100), ("MOST", 2_000)):
        monkeypatch.setattr(fixtures, name, value, raising=False)
    keys = [None, 0, *range(500), 700, 7]
    lines = [line(l_orderkey=k, l_linenumber=x, l_partkey=k or 0, l_quantity=float(x)) for k in keys for x in range(1, 8)]
    orders = [{"o_orderkey": k, "o_custkey": None if k == 4 else (k or 0) % 97 + i} for i, k in enumerate([*range(600), 9])]
    people = [{"c_custkey": k, "c_nationkey": i % 25} for i, k in enumerate([*range(650), 3, None])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        tables = {"lineitem": (LINES, lines), "orders": ("o_orderkey long, o_custkey long", orders), "customer": ("c_custkey long, c_nationkey int", people)}
        got, want = both(spark, tmp_path, "exon_neighbours", **tables)
        assert got == want and len(got) > 3_000
        dealt = queries()["exon_neighbours"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in dealt) <= 300 and sum(r["count"] for r in dealt) == len(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_changed_bases_that_make_a_seed_by_chance(spark, tmp_path):
    """Of a gene with a short repeat, in which a changed base made a seed four bases off, the call is that of the statement."""
    rows = [{"c_custkey": k} for k in (33_842, *range(1, 12))]
    got, want = both(spark, tmp_path, "circ_single_split", customer=("c_custkey long", rows))
    assert got == want
