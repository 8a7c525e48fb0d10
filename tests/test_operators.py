import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.operators import alignments, intervals, pairwise, reads, report, seeds
from helixframe.sources import files


@pytest.mark.parametrize(("signals", "want"), [(["CT", "CT", "CA"], "CT"), (["C", "CT"], ""), (["ct", "Ct"], "CT"), (["NN"], "AA"), (["AG", "TC"], "AC")])
def test_signal_consensus(spark, signals, want):
    rows = spark.createDataFrame([("c", s) for s in signals], "k string, s string")
    assert report.signal_consensus(rows, ["k"], "s").first().consensus == want


def test_consensus_of_nothing(spark):
    assert report.signal_consensus(spark.createDataFrame([], "k string, s string"), ["k"], "s").count() == 0


def test_flatten_covers_what_the_intervals_cover(spark):
    r = random.Random(3)
    rows = [(f"chr{i % 2}", s, s + r.randint(0, 900), i) for i in range(40) for s in [r.randint(1, 5000)]]
    got = intervals.flatten_intervals(spark.createDataFrame(rows, "chr string, start_pos long, end_pos long, label int"), "label").collect()
    want = {}
    for c, s, e, i in rows:
        for p in range(s, e + 1):
            want.setdefault((c, p), set()).add(i)
    seen = {(g.chr, p): set(g.labels) for g in got for p in range(g.start_pos, g.end_pos + 1)}
    assert seen == want


def test_islands_and_neighbours(spark):
    segs = spark.createDataFrame([("c", 10, 20), ("c", 15, 30), ("c", 31, 40), ("c", 60, 70), ("c", 60, 70)], "chr string, start_pos long, end_pos long")
    islands = intervals.merge_islands(segs)
    assert sorted((r.start_pos, r.end_pos) for r in islands.collect()) == [(10, 40), (60, 70)]
    points = spark.createDataFrame([(1, "c", 5), (2, "c", 10), (3, "c", 50), (4, "c", 99), (5, "d", 1)], "rname int, chr string, pos long")
    got = {r.rname: (r.seg_start, r.next_start) for r in intervals.gap_neighbours(points, islands).collect()}
    assert got == {1: (None, 10), 2: (10, 60), 3: (10, 60), 4: (60, None), 5: (None, None)}


def test_cigars(spark):
    sam = spark.createDataFrame([("a", 0, "c", 100, "10M1I40M1D1M", 0), ("b", 0, "c", 1, "5S20M100N30M", 0), ("d", 0, "c", 1, "*", 0)], "qname string, flag int, rname string, pos long, cigar string, nm int")
    got = sorted((r.qname, r.block_start, r.block_end) for r in alignments.cigar_blocks(sam).collect())
    assert got == [("a", 100, 109), ("a", 110, 149), ("a", 151, 151), ("b", 1, 20), ("b", 121, 150)]
    merged = sorted((r.qname, r.block_start, r.block_end) for r in alignments.cigar_blocks(sam, 2).collect())
    assert merged == [("a", 100, 151), ("b", 1, 20), ("b", 121, 150)]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y or x not in "ACGT"))
    return row[-1]


def test_edit_distance_equals_brute_force(spark):
    r = random.Random(1)
    pairs = [(i, "".join(r.choices("ACGTN", k=r.randint(0, 12))), "".join(r.choices("ACGTN", k=r.randint(0, 12)))) for i in range(60)]
    frame = spark.createDataFrame(pairs, "pair_id long, q string, r string")
    got = {x.pair_id: (x.d, x.b) for x in frame.select("pair_id", pairwise.edit_distance(F.col("q"), F.col("r")).alias("d"), pairwise.edit_distance(F.col("q"), F.col("r"), 4).alias("b")).collect()}
    for i, q, t in pairs:
        d = edit(q, t)
        assert got[i] == (d, d if d <= 4 else None)
    cells = pairwise.banded_edits([q for _, q, _ in pairs], [t for _, _, t in pairs], 4)
    for i, q, t in pairs:
        for n in range(len(q) + 1):
            for m in range(max(0, n - 4), min(len(t), n + 4) + 1):
                d = edit(q[:n], t[:m])
                assert cells[n, i, m - n + 4] == d or d > 4 and cells[n, i, m - n + 4] > 4


def test_clip_and_xdrop():
    assert pairwise.clip_align("ACGTACGTAC", "ACGTACGTACGG") == (0, 0, 0)
    assert pairwise.clip_align("ACGTACGTTTTTTT", "ACGTACGAAAAAAA") is not None
    assert pairwise.xdrop("ACGTACGT", "ACGTACGT") == (8, 8, 8)
    assert pairwise.xdrop("ACGTACGTAAAA", "ACGTACGTCCCC") == (8, 8, 8)


def test_kmers_cross_the_borders_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(seeds, "PIECE", 7)
    seq = "ACGTTGCANACGTAGGATCCATG"
    got = {(r.kmer, r.rpos) for r in seeds.kmer_index(spark.createDataFrame([("c", seq), ("d", "AC")], "chr string, seq string"), 4).select(seeds.kmer_of(F.col("code"), 4).alias("kmer"), "rpos").collect()}
    assert got == {(seq[i : i + 4], i + 1) for i in range(len(seq) - 3) if "N" not in seq[i : i + 4]}
    rows = {r.pos: (r.a, r.c, r.g, r.t) for r in seeds.composition_window(spark.createDataFrame([("c", seq)], "chr string, seq string"), 5).collect()}
    assert rows == {i + 1: tuple(seq[i : i + 5].count(b) for b in "ACGT") for i in range(len(seq) - 4)}


def test_truth_match_uses_an_event_once(spark):
    calls = spark.createDataFrame([("c", 100, 200), ("c", 104, 204), ("c", 900, 950)], "chr string, start_pos long, end_pos long")
    truth = spark.createDataFrame([("c", 101, 201, "x")], "chr string, start_pos long, end_pos long, label string")
    got = {r.start_pos: r.verdict for r in alignments.truth_match(calls, truth).collect()}
    assert got == {100: "TP", 104: "FP", 900: "FP"}


def test_reverse_complement_twice_is_the_same(spark):
    row = spark.range(1).select(reads.revcomp(F.lit("acgtnAC")).alias("x"), reads.revcomp(reads.revcomp(F.lit("ACGTN"))).alias("y")).first()
    assert (row.x, row.y) == ("GTNACGT", "ACGTN")


@pytest.mark.parametrize("step", [1, 3])
def test_codes_of_long_sequences_are_those_of_all_kmers(spark, monkeypatch, step):
    monkeypatch.setattr(seeds, "PIECE", 7)
    r = random.Random(step)
    rows = [(i, "".join(r.choice("ACGTACGTN") for _ in range(r.randint(0, 60)))) for i in range(20)]
    got = sorted((x.chr, x.pos, x.kmer) for x in seeds.kmer_codes(spark.createDataFrame(rows, "chr int, seq string"), 5, "chr", step=step).select("chr", "pos", seeds.kmer_of(F.col("code"), 5).alias("kmer")).collect())
    assert got == [(i, p, s[p : p + 5]) for i, s in rows for p in range(0, len(s) - 4, step) if "N" not in s[p : p + 5]]


def test_fastq_files_are_split(spark, tmp_path):
    names = {m: [f"r{k}" for k in range(300)] for m in "12"}
    for m in "12":
        for part in range(3):
            text = "".join(f"@{n}/{m} x\n{'ACGT' * (k % 5 + 1)}\n+\n{'IIII' * (k % 5 + 1)}\n" for k, n in enumerate(names[m]) if k // 100 == part)
            (tmp_path / m).mkdir(exist_ok=True)
            (tmp_path / m / f"lane{part}.fastq").write_text(text + "\n" * part)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        one, two = (files.read_fastq(spark, str(tmp_path / m)) for m in "12")
        assert sorted(x.rname for x in one.where("ok").collect()) == sorted(names["1"])
        pairs = files.pair_fastq(one, two).collect()
        assert len(pairs) == 300 and all(p.same_name and len(p.seq1) == len(p.seq2) for p in pairs)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_codes_are_made_from_slices_of_bounded_bases():
    import pyarrow as pa

    texts = ["ACGT" * 1_024] * 2_000 + [None, "", "A" * (2 * seeds.AT_ONCE), "", "ACG"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["at", "seq"])
    slices = list(seeds._shares(batch))
    assert [x for s in slices for x in s.column("at").to_pylist()] == list(range(len(texts)))
    assert all(len(s) == 1 or sum(len(x or "") for x in s.column("seq").to_pylist()) <= seeds.AT_ONCE for s in slices)
    assert len(slices) < 30


def test_pieces_go_on_over_stretches(spark, monkeypatch):
    """The pieces do not depend on the stretches, also over empty ones, and no task orders a whole chromosome."""
    monkeypatch.setattr(intervals, "STRETCH", 10)
    rows = [("a", 1, 5), ("a", 4, 30), ("a", 95, 99), ("b", 7, 7), ("c", 0, 9), ("c", 10, 19)]
    got = intervals.disjoint_pieces(spark.createDataFrame(rows, "chr string, start_pos long, end_pos long"))
    want = []
    for c in "abc":
        edges = sorted({x for k, s, e in rows if k == c for x in (s, e + 1)})
        want += [(c, s, e - 1) for s, e in zip(edges, edges[1:])]
    assert sorted(map(tuple, got.collect())) == want
    assert "stretch" in str(got._jdf.queryExecution().optimizedPlan())


@pytest.mark.parametrize("limit", [None, 1, 3])
def test_only_what_is_asked_for_is_shuffled(spark, monkeypatch, limit):
    """With more codes than are broadcast, a filter holds back nearly all others before the join, and the postings are the same."""
    draw = random.Random(4)
    genome = ["".join(draw.choices("ACGT", k=3_000)) for _ in range(6)]
    genome += [genome[0][:500] + "N" + genome[1][100:300], genome[0][:60] * 3]
    frame = spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(genome)], "chr string, seq string")
    reads = spark.createDataFrame([(i, genome[i % 8][7 * i : 7 * i + 100]) for i in range(24)], "rname long, seq string")
    monkeypatch.setattr(seeds, "BROADCAST_BYTES", 0)
    asked = seeds.read_kmers(reads, 20).select("code").distinct()
    passing = seeds.kmer_index(frame, 20, seeds.code_filter(asked, asked.count()))
    places = defaultdict(list)
    for i, s in enumerate(genome):
        for at in range(len(s) - 19):
            places[s[at : at + 20]].append((f"c{i}", at + 1))
    known = {s for r in reads.collect() for q in (r.seq, r.seq[::-1].translate(str.maketrans("ACGT", "TGCA"))) for s in (q[i : i + 20] for i in range(0, len(q) - 19, 20))}
    wanted = sum(len(places[s]) for s in known)
    assert wanted <= passing.count() < wanted + 0.2 * sum(map(len, places.values()))
    got = sorted((r.kmer, r.chr, r.rpos) for r in seeds.index_of(frame, 20, asked, limit).select(seeds.kmer_of(F.col("code"), 20).alias("kmer"), "chr", "rpos").collect())
    assert got == sorted((s, *p) for s in known if limit is None or len(places[s]) <= limit for p in places[s]) and got


@pytest.mark.parametrize("held", [4_096, 0])
def test_best_bins_without_a_list_of_hits(spark, monkeypatch, held):
    """Against a loop, over several pieces a sequence, with ties and repeated k-mers; a read's best bin of a piece is all that is shuffled."""
    draw = random.Random(9)
    genome = {f"c{i}": "".join(draw.choices("ACGTN" if i % 2 else "AC", k=draw.choice((0, 3, 90, 257)))) for i in range(12)}
    reads = {i: "".join(draw.choices("ACGT" if i % 3 else "AC", k=draw.choice((2, 30, 41)))) for i in range(15)}
    monkeypatch.setattr(seeds, "PIECE", 47)
    monkeypatch.setattr(seeds, "READS_AT_ONCE", held)
    want = {}
    for r, s in reads.items():
        kmers = [q[i : i + 4] for q in (s, s[::-1].translate(str.maketrans("ACGT", "TGCA"))) for i in range(0, len(q) - 3, 4)]
        for c, g in genome.items():
            bins = defaultdict(int)
            for at in range(len(g) - 3):
                bins[(at + 1) // 20] += kmers.count(g[at : at + 4])
            best = max(((n, -b) for b, n in bins.items()), default=(0, 0))
            if best[0]:
                want[r, c] = (-best[1], best[0])
    frames = spark.createDataFrame(list(reads.items()), "rname long, seq string"), spark.createDataFrame(list(genome.items()), "chr string, seq string")
    got = seeds.best_seed_bins(*frames, 4, 20)
    assert {(x.rname, x.chr): (x.bin, x.hits) for x in got.collect()} == want and len(want) > 40
    assert ("Join" not in got._jdf.queryExecution().optimizedPlan().toString()) == bool(held)


def test_only_kmers_that_a_gene_is_asked_for_leave_their_task(spark, monkeypatch):
    """Hits in genes against brute force, with codes of equal remainders, a gene that nothing asks for and too many hits; of a gene's k-mers few are written."""
    r = random.Random(5)
    draw = lambda n: "".join(r.choices("ACGT", k=n))
    genes = {g: draw(9_000) for g in range(4)} | {4: "ACGTTGCA" * 400, 5: "ACGN" * 9}
    asked = [(i, g, genes[g][p : p + 30]) for i in range(12) for g, p in [(i % 3, r.randrange(8_000))]] + [(90, 4, "ACGTTGCAACG"), (91, 0, "NNNNNNNNNN"), (92, 1, draw(25)), (93, 5, "ACGACGTT"), (94, 77, draw(20))]
    written = []
    monkeypatch.setattr(seeds, "stored", lambda frame: written.append(frame.localCheckpoint()) or written[-1])
    frames = spark.createDataFrame(asked, "id long, gene_id long, seq string"), spark.createDataFrame([(g, 100 * g, s) for g, s in genes.items()], "gene_id long, start_pos long, seq string")
    got = sorted(map(tuple, seeds.regional_kmer_join(*frames, 8, 3, limit=300).collect()))
    want = []
    for i, g, q in asked:
        for at in range(0, len(q) - 7, 3):
            kmer, text = q[at : at + 8], genes.get(g, "")
            found = [p for p in range(len(text) - 7) if text[p : p + 8] == kmer] if set(kmer) <= set("ACGT") else []
            want += [(i, g, at, p + 100 * g) for p in found] if len(found) <= 300 else []
    assert got == sorted(want) and {x[1] for x in got} == {0, 1, 2}
    index = next(f for f in written if "rpos" in f.columns)
    assert index.where("gene_id = 3").count() == 0 and index.where("gene_id < 3").count() < 1_000
