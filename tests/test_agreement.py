import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import alignments as A
from helixframe.operators import splits
from helixframe.params import Params


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_matches(spark, seed):
    r = random.Random(seed)
    spot = lambda: (f"c{r.randrange(2)}", 100 + r.randrange(60), 300 + r.randrange(60))
    calls, truth = sorted({spot() for _ in range(60)}), sorted({spot() for _ in range(50)})
    used, want = set(), {}
    for c in calls:
        fits = [t for t in truth if t[0] == c[0] and abs(t[1] - c[1]) <= 10 and abs(t[2] - c[2]) <= 10 and t not in used]
        want[c] = fits[0][1:] if fits else (None, None)
        used.update(fits[:1])
    got = A.truth_match(spark.createDataFrame(calls, "chr string, start_pos long, end_pos long"), spark.createDataFrame([(*t, "x") for t in truth], "chr string, start_pos long, end_pos long, label string"))
    rows = got.collect()
    assert {(g.chr, g.start_pos, g.end_pos): (g.t_start, g.t_end) for g in rows} == want
    assert all(g.verdict == ("FP" if g.t_start is None else "TP") for g in rows)
    assert any(v[0] is None for v in want.values()) and sum(v[0] is not None for v in want.values()) > 10


@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_logs_are_counted_in_stretches(spark, size):
    r = random.Random(size)
    lines, want, at = [], [], 0
    for log in ("a", "b"):
        for e in range(20):
            reads = split = 0
            for _ in range(r.randrange(0, 5)):
                lines.append((log, at, f"> n {at}"))
                at += r.choice([1, 1, 2, 9])
                reads += 1
                marks = r.randrange(0, 3)
                split += marks > 0
                for _ in range(marks):
                    lines.append((log, at, "** 1 2 3"))
                    at += 1
            lines += [(log, at, f"summary: g{e} t{e} {log}{e} 300 {split}"), (log, at + 1, "else")]
            at += 2
            want.append((log, f"{log}{e}", f"g{e}", f"t{e}", 300, split, reads, split))
    r.shuffle(lines)
    events = A.parse_sim_log(spark.createDataFrame(lines, "log string, line long, value string"), size)
    got = sorted(tuple(g) for g in events.select("log", "event", "gene_id", "trans_id", "spliced_len", "declared", "reads", "split_reads").collect())
    assert got == sorted(want)
    assert all(g.matches for g in A.event_support(events).collect())


def test_classes_are_written_apart_and_come_back(spark, tmp_path):
    rows = [(f"r{k}", ["con", "dis", "remain"][k % 3]) for k in range(9)]
    sam = spark.createDataFrame([(f"{n}\t{k}\tchr1\t7\t60\t5M\t=\t0\t0\tAC\tII\tNM:i:0\n", 1, k, 0, "00", c) for k, (n, c) in enumerate(rows)], "line string, xc int, xd int, xv int, xy string, class string")
    path = str(tmp_path / "classes")
    A.write_classes(A.tag_classes(sam), path)
    assert {p.name for p in (tmp_path / "classes").iterdir() if p.is_dir()} == {"class=con", "class=dis", "class=remain"}
    got = sorted((g.qname, g["class"], g.flag, g.tags) for g in A.read_classes(spark, path).collect())
    assert got == [(n, c, k, {"XC": "1", "XD": str(k), "XV": "0", "XY": "00"}) for k, (n, c) in enumerate(rows)]


def test_isoforms(spark):
    exons = spark.createDataFrame([("c", 1, 10, 100, 200), ("c", 1, 10, 300, 400), ("c", 1, 11, 100, 400), ("c", 2, 20, 150, 260)], "chr string, gene_id long, trans_id long, start_pos long, end_pos long")
    reads = {"in": [(110, 150)], "cross": [(190, 230)], "both": [(180, 200), (300, 330)], "first": [(120, 160), (500, 520)], "none": [(900, 950)], "held": [(210, 220), (240, 250)]}
    blocks = spark.createDataFrame([(n, "c", k, a, b) for n, x in reads.items() for k, (a, b) in enumerate(x)], "qname string, chr string, block int, a_start long, a_end long")
    got = {g.qname: (g.iso_class, g.iso_gene, g.trans_id) for g in A.isoform_class(blocks, exons).collect()}
    assert got == {"in": (3, 1, 10), "cross": (3, 1, 11), "both": (2, 1, 10), "first": (1, 1, 10), "none": (0, None, None), "held": (1, 1, 11)}


def test_reads_missing_in_a_set(spark):
    schema = "rid long, ord int, s1 long, e1 long, s2 long, e2 long"
    p = spark.createDataFrame([(1, 1, 100, 200, 300, 400), (2, 1, 100, 200, 300, 400), (3, 1, 500, 600, 100, 200), (3, 2, 105, 205, 900, 950)], schema)
    r = spark.createDataFrame([(1, 1, 109, 210, 309, 410), (3, 1, 100, 200, 500, 600)], schema)
    g = spark.createDataFrame([(1, 1, 100, 200, 300, 400), (4, 1, 1, 2, 3, 4), (3, 1, 105, 205, 900, 955)], schema)
    got = {x.rid: (x.pr, x.pg, x.rg, x.missing) for x in A.three_way_overlap(p, r, g).collect()}
    assert got == {1: (2, 4, 2, ""), 2: (None, None, None, "r,g"), 3: (4, 4, 2, ""), 4: (None, None, None, "p,r")}
    assert A.three_way_overlap(p.limit(0), r.limit(0), g.limit(0)).count() == 0


def test_attempts_settle_in_order(spark):
    call = "struct<spos: bigint, epos: bigint, start_signal: string, end_signal: string, start_bp_ref: string, end_bp_ref: string>"
    tries = {1: [30, 22, 21, 22], 2: [22, 20, 0], 3: [21, 1, 20], 4: [30, 30], 5: [22, 21, 20, 21], 6: [21, 21]}
    rows = spark.createDataFrame([(i, k, t) for i, x in tries.items() for k, t in enumerate(x)], "id long, order int, type int").withColumn("call", F.struct(F.col("order").cast("long").alias("spos"), *[F.lit(None).cast("long" if c == "epos" else "string").alias(c) for c in splits.CALL[1:]]).cast(call))
    got = {g.id: (g.type, g.call.spos) for g in splits.settled(rows).collect()}
    assert got == {1: (21, 2), 2: (20, 1), 3: (1, 1), 5: (20, 2), 6: (21, 0)}


def test_whole_mates_are_cut_to_the_circle_within_the_clip_limit(spark):
    p = Params()
    rows = [(100, 199, 0, 0), (96, 199, 0, 0), (96, 199, 4, 0), (100, 206, 0, 0), (100, 208, 0, 0), (96, 205, 3, 1)]
    frame = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "id int, s long, e long, l long, r long")
    zero = F.lit(0)
    make = lambda s, e, left=zero, right=zero: splits.part(spos=s, epos=e, qspos=F.lit(1) + left, qepos=F.lit(100), sl=left, sr=right, mlen=F.lit(100), ed=zero, med=zero, dir=F.lit(1))
    out = frame.select("id", splits.trimmed(make(F.col("s"), F.col("e"), F.col("l"), F.col("r")), make(F.lit(100), F.lit(150)), make(F.lit(160), F.lit(200)), p).alias("x")).select("id", "x.*").orderBy("id").collect()
    assert [(g.spos, g.epos, g.sl, g.sr, g.mlen) for g in out] == [(100, 199, 0, 0, 100), (100, 199, 4, 0, 96), (96, 199, 4, 0, 100), (100, 200, 0, 6, 94), (100, 208, 0, 0, 100), (100, 200, 7, 6, 91)]


def test_pairs_of_mates_are_met_by_what_they_share(spark):
    from helixframe.operators import pairs
    from helixframe.operators.tables import stored

    r = random.Random(5)
    schema = "rname int, mate int, dir int, chr string, pos long, end_pos long, score double, gene_id int, trans_ids array<int>"
    some = lambda: None if r.random() < 0.1 else [r.choice([None, *range(12)]) for _ in range(r.randint(0, 3))]
    rows = [(r.randint(1, 8), r.randint(1, 2), r.choice([-1, 1]), r.choice(["a", "b"]), p := r.randint(1, 400) * 20, p + r.randint(1, 90), float(k), r.choice([None, *range(20)]), some()) for k in range(300)]
    rows += [(9, 1, 1, "a", 50, 60, 1.0, 1, [1]), (9, 2, -1, "a", 50, 70, 1.0, 2, [2]), (10, 1, 1, "a", 50, 500, 1.0, 1, [1]), (10, 2, -1, "a", 50, 70, 1.0, 2, [2]), (11, 1, 1, "a", 5, 9, 1.0, 3, [4, 5]), (11, 2, -1, "a", 9000, 9009, 1.0, 3, [5, 4])]
    frame = stored(spark.createDataFrame(rows, schema))
    saved = {k: 4 + k % 5 for k in range(1, 6)}
    for gate in (None, saved):
        want, used = [], set()
        for a in rows:
            for b in rows:
                if a[1] == 1 and b[1] == 2 and a[0] == b[0] and a[3] == b[3] and a[2] != b[2]:
                    tlen, s = (b[5] - a[4] if a[4] < b[4] else a[5] - b[4]), None if gate is None else gate.get(a[0])
                    own = {x for x in a[8] or [] if x is not None} & {x for x in b[8] or [] if x is not None}
                    kind = 0 if own else 1 if a[7] is not None and a[7] == b[7] and (s is None or s >= pairs.P.CONGEN) else 2 if tlen <= 100 and (s is None or s >= pairs.P.CONGNM) else None
                    if kind is not None:
                        want.append((a[0], a[3], a[4], b[4], tlen, kind, a[6] + b[6]))
                        used |= {(a[0], a[3], x[1], x[2], x[4]) for x in (a, b)}
        frames = None if gate is None else spark.createDataFrame(list(gate.items()), "rname int, type int")
        found = pairs.mate_pair_candidates(frame, 100, saved=frames)
        assert sorted(tuple(x) for x in found.collect()) == sorted(want) and {x[5] for x in want} == {0, 1, 2}
        if gate is None:
            left = pairs.unpaired_chains(frame, 100)
            assert sorted(x.score for x in left.collect()) == sorted(x[6] for x in rows if (x[0], x[3], x[1], x[2], x[4]) not in used)


@pytest.mark.parametrize("right", [True, False])
def test_walks_shuffle_no_pieces(spark, right):
    """Against a loop over segments, to either side; nothing is shuffled or sorted after anchors and transcripts have met."""
    from helixframe.operators import spans

    r = random.Random(8)
    segs = [(f"chr{t % 2}", t, s, s + w) for t in range(30) for s, w in ((10 * k + 3, r.choice((4, 9))) for k in sorted(r.sample(range(40), 14)))]
    anchors = [(i, f"chr{i % 2}", p := r.randrange(420), r.choice((0, 1, 12, 60)), p + (1 if right else -1) * r.randrange(200)) for i in range(150)]
    want = []
    for i, c, pos, need, bound in anchors:
        for t in {t for d, t, s, e in segs if d == c and s <= pos <= e}:
            so_far, low, high = 0, min(pos, bound), max(pos, bound)
            pieces = sorted((max(s, low), min(e, high)) for _, u, s, e in segs if u == t and e >= low and s <= high)
            for k, (a, b) in enumerate(pieces if right else pieces[::-1], 1):
                if so_far < need:
                    n = min(b - a + 1, need - so_far)
                    want.append((i, t, k, a if right else b - n + 1, n))
                so_far += b - a + 1
    frames = spark.createDataFrame(anchors, "id long, chr string, pos long, need long, bound long"), spark.createDataFrame(segs, "chr string, trans_id long, seg_start long, seg_end long")
    found = spans.transcript_walk(*frames, right)
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 300
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
