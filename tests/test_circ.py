import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import circ
from helixframe.sources import files

FLIP = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def planted():
    r = random.Random(11)
    genome = "".join(r.choices("ACGT", k=5000))
    exons = [(500, 699), (1500, 1699), (3500, 3699)]
    reads = []
    circle = "".join(genome[s - 1 : e] for s, e in exons)
    around = circle[-100:] + circle[:100]
    for i in range(10):  # the first mate crosses the junction, the second lies inside the circle
        at = 25 + 5 * i
        first = list(around[at : at + 100])
        for k in range(0 if i < 8 else i - 7):
            x = 5 + 40 * k
            first[x] = "ACGT"[("ACGT".index(first[x]) + 1) % 4]
        second = genome[1520:1620][::-1].translate(FLIP)
        reads += [(f"c{i}", 1, "".join(first)), (f"c{i}", 2, second)]
    for i in range(10):
        a = 500 + 10 * i
        reads += [(f"l{i}", 1, genome[a : a + 100]), (f"l{i}", 2, genome[a + 50 : a + 150][::-1].translate(FLIP))]
    for i in range(4):
        reads += [(f"u{i}", m, "".join(r.choices("ACGT", k=100))) for m in (1, 2)]
    return genome, exons, reads


def test_planted_circle_is_reported(spark, planted):
    genome, exons, reads = planted
    g = spark.createDataFrame([("chr1", genome)], "chr string, seq string")
    e = spark.createDataFrame([("chr1", 1, 1, i + 1, s, t, "+") for i, (s, t) in enumerate(exons)], "chr string, gene_id long, trans_id long, exon_num int, start_pos long, end_pos long, strand string")
    got = circ.call_circles(spark.createDataFrame(reads, "rname string, mate int, seq string"), g, e).collect()
    assert [(x.chr, x.start_pos, x.end_pos, x.support, x.type, x["pass"]) for x in got] == [("chr1", 500, 3699, 10, "STC", "Pass")]
    assert got[0].reads == ",".join(f"c{i}" for i in range(10))


def test_files_come_back_as_written(spark, tmp_path, planted):
    genome, _, reads = planted
    (tmp_path / "g.fa").write_text(">chr1 rest of it\n" + "\n".join(genome[i : i + 70] for i in range(0, 5000, 70)) + "\n>chr2\nACGT tail\nNN\n")
    got = {r.chr: (r.seq, r.len) for r in files.read_fasta(spark, str(tmp_path / "g.fa")).collect()}
    assert got == {"chr1": (genome, 5000), "chr2": ("ACGTNN", 6)}
    for m in (1, 2):
        (tmp_path / f"r{m}.fq").write_text("".join(f"@{n}/{k} comment\n{s}\n+\n{'I' * len(s)}\n" for n, k, s in reads if k == m))
    pairs = files.pair_fastq(files.read_fastq(spark, str(tmp_path / "r1.fq")), files.read_fastq(spark, str(tmp_path / "r2.fq"))).orderBy("rec").collect()
    assert [(p.rname, p.seq1, p.seq2, p.same_name) for p in pairs] == [(a[0], a[2], b[2], True) for a, b in zip(reads[::2], reads[1::2])]


def test_sam_and_pam_round_trip(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1.4\nr1\t99\tchr1\t5\t60\t10M\t=\t50\t55\tACGT\tIIII\tNM:i:1\nr2\t256\tchr1\t5\t60\t10M\t=\t50\t55\tACGT\tIIII\n")
    sam = files.read_sam(spark, str(tmp_path / "x.sam")).collect()
    assert [(s.qname, s.flag, s.pos, s.tags) for s in sam] == [("r1", 99, 5, {"NM": "1"})]
    names = [c.split()[0] for c in files.PAM.split(", ")]
    row = ["r1", "chr1", 1, 2, 3, 4, 5, "+", 0, "chr1", 6, 7, 8, 9, 10, "-", 0, 100, 0, 1, 0]
    frame = spark.createDataFrame([tuple(row), tuple(["r2", *row[1:20], 13])], files.PAM)
    files.write_pam(frame, str(tmp_path / "pam"))
    back = {r.rname: r for r in files.read_pam(spark, str(tmp_path / "pam")).collect()}
    assert list(back["r1"]) == row and back["r2"].spos1 is None and back["r2"].type == 13 and len(names) == 21
