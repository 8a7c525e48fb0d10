import random

import pytest
from pyspark.sql import functions as F

from helixframe import params as P
from helixframe.operators import annotation, circ, extend, tables

FLIP = str.maketrans("ACGT", "TGCA")
EXONS = [(500, 699), (1500, 1699), (3500, 3699)]


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(11)
    genome = "".join(r.choices("ACGT", k=5000))
    exons = spark.createDataFrame([("chr1", 1, 1, i + 1, s, e) for i, (s, e) in enumerate(EXONS)], "chr string, gene_id long, trans_id long, exon_num int, start_pos long, end_pos long")
    genes = spark.createDataFrame([("chr1", 1, 500, 3699)], "chr string, gene_id long, start_pos long, end_pos long")
    return genome, spark.createDataFrame([("chr1", genome)], "chr string, seq string"), exons, genes, tables.stored(annotation.transcript_segments(exons))


def prefix_edits(q, r):
    d = list(range(len(r) + 1))
    for i, x in enumerate(q, 1):
        now = [i]
        for j, y in enumerate(r, 1):
            now.append(min(d[j] + 1, now[j - 1] + 1, d[j - 1] + (x != y)))
        d = now
    return d


def brute(genome, pos, seq, edits, right, bound):
    """The least clip and twice the edits over all clips and ends, along the exons or else straight on; failing that the most bases less
    twice the edits that reach an exon's end, as (None, that)."""
    sign = 1 if right else -1
    inside = [b for s, e in EXONS for b in range(s, e + 1)]
    ways = [("", [pos + sign * (i + 1) for i in range(len(seq) + 3)])]
    if pos in inside:
        at = inside.index(pos)
        ways.append(("1", (inside[at + 1 :] if right else inside[:at][::-1])[: len(seq) + 3]))
    best, short = None, None
    for name, path in ways:
        path = [b for b in path if 1 <= b <= len(genome) and (b <= bound if right else b >= bound)]
        q, ref = seq if right else seq[::-1], "".join(genome[b - 1] for b in path)
        for clip in range(min(7, len(q)) + 1):
            for j, ed in enumerate(prefix_edits(q[: len(q) - clip], ref)):
                if ed <= edits and abs(j - len(q) + clip) <= 3:
                    key = (name == "", clip + 2 * ed, ed, abs(j - len(q) + clip), sign * (path[j - 1] if j else pos))
                    best = min(best, key) if best else key
        for j, b in enumerate(path, 1):
            if name and (j == len(path) < len(seq) + 3 or b in {e if right else s for s, e in EXONS}):
                for i in range(max(1, j - 3), min(len(q), j + 3) + 1):
                    ed = prefix_edits(q[:i], ref[:j])[j]
                    if ed <= edits:
                        short = max(short, i - 2 * ed) if short is not None else i - 2 * ed
    return (best[1], best[2]) if best else (None, short) if short is not None else None


@pytest.mark.parametrize("right", [True, False])
def test_extension_is_the_best_of_all_paths(spark, world, right):
    genome, frame, _, _, segs = world
    r = random.Random(3)
    inside = [b for s, e in EXONS for b in range(s, e + 1)]
    rows = []
    for i in range(60):
        pos = r.choice(inside[60:-60]) if i % 5 else r.randrange(800, 1300)
        n, sign = r.randrange(0, 45), 1 if right else -1
        if i % 3 and pos in inside:
            at = inside.index(pos)
            path = [inside[at + sign * (k + 1)] for k in range(n)]
        else:
            path = [pos + sign * (k + 1) for k in range(n)]
        seq = [genome[b - 1] for b in path]
        if i % 4 == 1:  # over an exon's end, and elsewhere then
            e = r.choice(EXONS)
            pos, n = (e[1] - r.randrange(3, 25), r.randrange(30, 45)) if right else (e[0] + r.randrange(3, 25), r.randrange(30, 45))
            stretch = range(pos + 1, e[1] + 1) if right else range(pos - 1, e[0] - 1, -1)
            seq = [genome[b - 1] for b in stretch] + r.choices("ACGT", k=n)
        for _ in range(r.randrange(0, 6)):
            if seq:
                x = r.randrange(len(seq))
                seq[x : x + 1] = r.choice(["", "A", "C", "GT"])
        rows.append((i, "chr1", pos, "".join(seq if right else seq[::-1]), r.randrange(0, 5), (pos + 20 if right else pos - 20) if i % 7 == 0 else (extend.FAR if right else 1)))
    anchors = spark.createDataFrame(rows, "id long, chr string, pos long, seq string, edits int, bound long").withColumn("tids", F.array().cast("array<long>"))
    got = {g.id: g for g in extend.extend_alignment(anchors, segs, frame, right).collect()}
    assert len(got) == len(rows)
    short = 0
    for i, _, pos, seq, edits, bound in rows:
        want = brute(genome, pos, seq, edits, right, bound) if seq else (0, 0)
        g = got[i]
        clipped = want is not None and want[0] is None and g.covered >= len(seq) - 7
        assert g.ok == bool(want and (want[0] is not None or clipped)), (i, g)
        if want and want[0] is None:
            assert g.covered - 2 * g.ed == want[1] and g.clip == (len(seq) - g.covered if clipped else 0), (i, g, want)
            assert g.pos in {e[1] if right else e[0] for e in EXONS} | {bound}
            short += 1
        elif want:
            assert (g.clip + 2 * g.ed, g.ed) == want and g.covered == len(seq) - g.clip, (i, g, want)
        else:
            assert (g.pos, g.ed, g.clip, g.covered, g.trans_id) == (pos, 0, 0, 0, None)
        if g.trans_id is None and g.ok and g.ed == 0 and seq:
            assert abs(g.pos - pos) == g.covered
    assert short > 5


def test_bases_meet_pieces(spark):
    r = random.Random(5)
    seq = "".join(r.choices("ACGT", k=10_000))
    rows = [(i, "c", p, n) for i, (p, n) in enumerate([(1, 1), (4090, 20), (4096, 1), (4097, 5), (1, 10_000), (9_999, 50), (-3, 10), (20_000, 4), (5, 0)])]
    got = {g.id: g.bases for g in extend.bases(spark.createDataFrame(rows, "id long, chr string, pos long, len long"), spark.createDataFrame([("c", seq)], "chr string, seq string"), "id").collect()}
    assert got == {i: seq[max(p - 1, 0) : max(p - 1 + n, 0)] for i, _, p, n in rows}


def chains_of(spark, rows, frame, exons):
    mates = spark.createDataFrame(rows, "rname string, mate int, seq string")
    return mates, tables.stored(circ.read_chains(mates, frame, annotation.exon_neighbours(exons.withColumn("strand", F.lit("+")))))


def test_pairs_get_their_category(spark, world):
    genome, frame, exons, genes, segs = world
    r = random.Random(7)
    spliced = "".join(genome[s - 1 : e] for s, e in EXONS)
    flip = lambda s: s[::-1].translate(FLIP)
    around = spliced[-100:] + spliced[:100]
    rows = []
    for i in range(4):
        rows += [(f"lin{i}", 1, spliced[150 + i : 250 + i]), (f"lin{i}", 2, flip(spliced[220 + i : 320 + i]))]
        rows += [(f"rev{i}", 1, flip(spliced[220 + i : 320 + i])), (f"rev{i}", 2, spliced[150 + i : 250 + i])]
        rows += [(f"bsj{i}", 1, around[40 + i : 140 + i]), (f"bsj{i}", 2, flip(genome[1519:1619]))]
        rows += [(f"out{i}", 1, flip(genome[1509:1609])), (f"out{i}", 2, genome[3509:3609])]
        rows += [(f"no{i}", m, "".join(r.choices("ACGT", k=100))) for m in (1, 2)]
        rows += [(f"one{i}", 1, genome[1519:1619]), (f"one{i}", 2, "".join(r.choices("ACGT", k=100)))]
    mates, chains = chains_of(spark, rows, frame, exons)
    got = {g.rname: g for g in extend.classify_pair(mates, chains, exons, segs, genes, frame).collect()}
    kinds = {"lin": P.CONCRD, "rev": P.CONCRD, "bsj": P.CHIBSJ, "out": P.CHIORF, "no": P.NOMATCH, "one": P.OEANCH}
    assert {n: g.type for n, g in got.items()} == {n: kinds[n[:-1]] for n in got} and len(got) == 24
    for i in range(4):
        inside = [b for s, e in EXONS for b in range(s, e + 1)]
        assert (got[f"lin{i}"].spos1, got[f"lin{i}"].epos1, got[f"lin{i}"].spos2, got[f"lin{i}"].epos2) == tuple(inside[x] for x in (150 + i, 249 + i, 220 + i, 319 + i))
        assert (got[f"lin{i}"].mate1, got[f"rev{i}"].mate1) == (1, 2)


def test_single_reads(spark, world):
    genome, frame, exons, _, segs = world
    spliced = "".join(genome[s - 1 : e] for s, e in EXONS)
    rows = [("whole", 1, spliced[150:250]), ("part", 1, spliced[150:200] + "ACGT" * 12), ("none", 1, "ACGT" * 25)]
    mates, chains = chains_of(spark, rows, frame, exons)
    grown = extend.extend_mate(chains.withColumn("id", F.struct("rname", "dir", "chr", "chain_no")), segs, frame)
    got = extend.classify_single(mates, grown.select("id.rname", "type"))
    assert {g.rname: g.type for g in got.collect()} == {"whole": P.CONCRD, "part": P.CANDID, "none": P.ORPHAN}


def test_realigned_splits_and_rescued_mates(spark, world):
    genome, frame, _, _, segs = world
    spliced = "".join(genome[s - 1 : e] for s, e in EXONS)
    around = spliced[-100:] + spliced[:100]
    wrong = list(around[50:150])
    for x in (3, 20, 60, 80, 90):
        wrong[x] = "ACGT"[("ACGT".index(wrong[x]) + 1) % 4]
    rows = [(1, "chr1", around[50:150], 50, 500, 3699), (2, "chr1", "".join(wrong), 50, 500, 3699), (3, "chr1", around[50:150], 0, 500, 3699), (4, "chr1", around[30:130], 70, 500, 3699)]
    splits = spark.createDataFrame(rows, "id long, chr string, seq string, cut int, spos long, epos long").withColumn("tids", F.array().cast("array<long>"))
    got = {g.id: tuple(g)[1:] for g in extend.split_realign(splits, segs, frame).collect()}
    assert got == {1: (True, 0, 3650, 549), 2: (False, None, None, None), 3: (False, None, None, None), 4: (True, 0, 3630, 529)}
    # a mate that was mapped straight over the start of exon 2, while the circle is exons 2 and 3
    circle = "".join(genome[s - 1 : e] for s, e in EXONS[1:])
    read = circle[-30:] + circle[:70]
    rows = [(1, "chr1", read, 670, 1569, 100, 1, 1500, 3699), (2, "chr1", read, 1600, 1699, 100, 1, 1500, 3699), (3, "chr1", spliced[170:270], 670, 1569, 100, 1, 1500, 3699)]
    mates = spark.createDataFrame(rows, "id long, chr string, seq string, m_start long, m_end long, matched_len long, qspos int, spos long, epos long").withColumn("tids", F.array().cast("array<long>"))
    assert [tuple(g) for g in extend.rescue_overlap(mates, segs, frame).collect()] == [(1, "start", 30, 0, 3670, 1569)]


def test_junctions_come_from_the_list_of_a_transcript(spark):
    """Against a loop, with ends outside of exons, in one segment, turned round, and lengths that don't fit; what lies between is not put in order by mate."""
    import random

    from helixframe.operators.spans import junction_list

    r = random.Random(3)
    segs = {t: [(a, a + r.choice((4, 9, 19))) for a in range(100 + t, 1_500, 20 + 10 * t)] for t in range(4)}
    mates = []
    for i in range(300):
        s, e = sorted((r.randrange(90, 1_500), r.randrange(90, 1_500))) if i % 2 else (lambda a: (a, a + r.randrange(-5, 60)))(r.randrange(90, 1_400))
        way = [x for x in segs[i % 4] if x[1] >= s and x[0] <= e]
        mates.append((i, "c", s, e, sum(min(b, e) - max(a, s) + 1 for a, b in way) + r.randrange(-4, 5)))
    want = []
    for i, _, s, e, n in mates:
        for t, own in segs.items():
            first, last = [x for x in own if x[0] <= s <= x[1]], [x for x in own if x[0] <= e <= x[1]]
            if not first or not last or first[0][0] >= last[0][0]:
                continue
            way = [x for x in own if first[0][0] <= x[0] <= last[0][0]]
            pieces = [min(b, e) - max(a, s) + 1 for a, b in way]
            if abs(sum(pieces) - n) <= 3:
                want += [(i, t, k + 1, way[k][1], way[k + 1][0], sum(pieces[: k + 1])) for k in range(len(way) - 1)]
                break
    got = junction_list(spark.createDataFrame(mates, "id long, chr string, spos long, epos long, matched_len long"), spark.createDataFrame([("c", t, a, b, 1) for t, own in segs.items() for a, b in own], "chr string, trans_id long, seg_start long, seg_end long, state int"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_template_lengths_come_from_the_list_of_a_transcript(spark):
    """Against a loop, with mates that overlap, and ends outside of exons; mates meet the segments once, and then a list of them."""
    import random

    from helixframe.operators.annotation import insert_size

    r = random.Random(4)
    segs = {t: [(a, a + r.choice((4, 9, 19))) for a in range(100 + t, 1_500, 20 + 10 * t)] for t in range(4)}
    mates = [(i, "c", a, a + r.randrange(-15, 300), 10, 12) for i in range(300) for a in [r.randrange(90, 1_400)]]
    want = []
    for i, _, a, b, n, m in mates:
        sums = []
        for own in segs.values():
            if any(s <= a <= e for s, e in own) and any(s <= b <= e for s, e in own):
                way = [min(e, b) - max(s, a) + 1 for s, e in own if e >= a and s <= b]
                sums += [sum(way)] if way else []
        want.append((i, min(sums) + n + m - 2 if sums else -1))
    got = insert_size(spark.createDataFrame(mates, "id long, chr string, end1 long, start2 long, len1 long, len2 long"), spark.createDataFrame([("c", t, a, b, 1) for t, own in segs.items() for a, b in own], "chr string, trans_id long, seg_start long, seg_end long, state int"))
    assert sorted(map(tuple, got.collect())) == want and len({x for _, x in want}) > 50
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3
