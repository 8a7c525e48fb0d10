import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.operators import chains, spans, tables
from helixframe.params import Params

K, P = 20, Params()
HITS = "rname long, dir int, chr string, qpos int, rpos long, qlen int"
EXONS = "chr string, gene_id long, start_pos long, end_pos long, next_exon_beg long"


def bound_of(exons, chr_, r, rest):
    """(furthest start of the next seed, last base that a link over the genome may reach or None)."""
    over = [e for e in exons if e[0] == chr_ and e[2] <= r <= e[3]]
    end = r + K - 1
    if not over:
        later = [e[2] for e in exons if e[0] == chr_ and e[2] > r]
        if not later:
            return r + rest + 4, None
        return (0 if min(later) - 1 < end else min(r + rest + 4, min(later) - K)), min(later) - 1
    whole = [e for e in over if e[3] >= end]
    if not whole:
        return 0, 0
    longest, shortest, furthest = max(e[3] for e in whole), min(e[3] for e in whole), max(e[4] for e in whole)
    return (furthest + K - 1 if shortest < rest + end and furthest else longest - K + 1), longest


def link(exons, a, b):
    """(kind, gain) of the link from hit a to hit b, or None."""
    (_, _, chr_, q1, r1, qlen), (q2, r2) = a, b[3:5]
    if b[2] != chr_ or q2 <= q1 or r2 <= r1:
        return None
    limit, last = bound_of(exons, chr_, r1, qlen - q1 - K)
    if r2 > limit:
        return None
    apart, genomic, e1 = q2 - q1 - K, r2 - r1 - K, r1 + K - 1
    if abs(genomic - apart) <= 4 and (last is None or r2 + K - 1 <= last):
        return 0, 2e4 * K - 0.1 * abs(genomic - apart)
    if r2 <= e1:
        return None
    inside = False
    for _, _, start, end, after in sorted((e for e in exons if e[0] == chr_ and e[2] <= r1 <= e[3] and e[4] > e[3]), key=lambda e: (e[2], e[3], e[1], -e[4])):
        if end >= e1 and r2 >= after and abs(end - e1 + r2 - after - apart) <= 4:
            return 1, 2e4 * K - 0.1 * abs(end - e1 + r2 - after - apart)
        inside |= 0 <= end - e1 < apart and r2 + K < after
    return (2, 2e4 * K - 0.1 * abs(genomic - apart)) if inside else None


def best_chains(exons, hits, best):
    """Chains of one key's hits by going through all paths."""
    hits = sorted(set(hits), key=lambda h: (h[3], h[2], h[4]))
    paths = {}

    def longest(i):
        if i not in paths:
            options = [(float(K), [i])]
            for j in range(len(hits)):
                if found := link(exons, hits[i], hits[j]):
                    rest = longest(j)
                    options.append((rest[0] + found[1], [i, *rest[1]]))
            top = max(o[0] for o in options)
            paths[i] = min((o for o in options if o[0] == top), key=lambda o: o[1])
        return paths[i]

    heads = [(longest(i)[0], longest(i)[1]) for i in range(len(hits))]
    if any(len(p) > 1 for _, p in heads):
        heads = [x for x in heads if len(x[1]) > 1]
    heads.sort(key=lambda x: (-x[0], -hits[x[1][0]][3], hits[x[1][0]][2], hits[x[1][0]][4]))
    out, used = [], set()
    for score, path in heads:
        spot = hits[path[0]][2], hits[path[0]][4]
        if len(out) == best or (score < heads[0][0] and spot in used):
            continue
        used |= {(hits[i][2], hits[i][4]) for i in path[1:]}
        out.append((round(score, 6), hits[path[0]][2], [(hits[i][3], hits[i][4]) for i in path]))
    return out


def world(seed):
    r = random.Random(seed)
    exons = []
    for g in range(12):
        at = r.randint(50, 2500)
        spans_ = []
        for _ in range(r.randint(1, 5)):
            end = at + r.randint(15, 120)
            spans_.append((at, end))
            at = end + r.choice([1, 30, 150, 700])
        for t in range(2):
            kept = [s for i, s in enumerate(spans_) if t == 0 or i % 2 == 0 or r.random() < 0.5]
            exons += [(f"chr{g % 2}", g, s, e, nxt[0] if nxt else 0) for (s, e), nxt in zip(kept, [*kept[1:], None])]
    exons = sorted(set(exons))
    hits = []
    for read in range(160):
        for d in (1, -1):
            e = r.choice(exons)
            place = e[2] + r.randint(-40, 60)
            for q in range(0, 100, r.choice([20, 20, 10])):
                for _ in range(r.randint(0, 3)):
                    jump = r.choice([0, 0, 0, 1, -2, 4, 5, 40])
                    later = e[4] - e[3] - 1 if e[4] and place + q + K - 1 > e[3] and r.random() < 0.8 else 0
                    hits.append((read, d, e[0], q, max(1, place + q + jump + later), 100))
                if r.random() < 0.1:
                    hits.append((read, d, "chr1" if e[0] == "chr0" else "chr0", q, r.randint(1, 3000), 100))
    return exons, hits


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_chains_are_brute_force(spark, seed):
    exons, hits = world(seed)
    frame = spark.createDataFrame(hits, HITS)
    model = spark.createDataFrame([(*e[:2], *e[2:]) for e in exons], EXONS)
    got = {(x.rname, x.dir, x.chr, x.q1, x.r1, x.q2, x.r2): (x.kind, round(x.score, 6)) for x in chains.chain_links(frame.distinct(), model, K).collect()}
    by_key = defaultdict(set)
    for h in hits:
        by_key[h[:2]].add(h)
    want = {}
    for key, rows in by_key.items():
        for a in rows:
            for b in rows:
                if found := link(exons, a, b):
                    want[(*key, a[2], a[3], a[4], b[3], b[4])] = (found[0], round(found[1], 6))
    assert got == want
    assert {k for k, _ in want.values()} == {0, 1, 2}
    for best in (30, 3):
        found = defaultdict(list)
        for x in chains.chain_seeds(frame, model, K, best=best).orderBy("chain_no").collect():
            assert x.chain_no == len(found[(x.rname, x.dir)])
            found[(x.rname, x.dir)].append((round(x.score, 6), x.chr, [(f.qpos, f.rpos) for f in x.frags]))
        assert found == {key: best_chains(exons, list(rows), best) for key, rows in by_key.items()}


def test_a_read_over_an_intron_is_one_chain(spark):
    hits = [(1, 1, "c", q, r, 100) for q, r in ((0, 100), (20, 120), (60, 660), (80, 680))]
    frame = spark.createDataFrame(hits, HITS)
    exons = spark.createDataFrame([("c", 1, 50, 159, 660), ("c", 1, 660, 800, 0)], EXONS)
    got = chains.chain_seeds(frame, exons, K).collect()
    assert [[(f.qpos, f.rpos) for f in g.frags] for g in got] == [[(0, 100), (20, 120), (60, 660), (80, 680)]]
    # without the junction in the gene model the halves stay apart
    halves = chains.chain_seeds(frame, exons.limit(0), K).orderBy("chain_no").collect()
    assert [[f.rpos for f in g.frags] for g in halves] == [[660, 680], [100, 120]]


def test_chains_of_nothing_and_of_single_seeds(spark):
    exons = spark.createDataFrame([], EXONS)
    assert chains.chain_seeds(spark.createDataFrame([], HITS), exons, K).count() == 0
    hits = [(1, 1, "c", 0, 10, 50), (1, 1, "c", 20, 900, 50), (1, 1, "b", 20, 5000, 50), (1, 1, "c", 20, 900, 50)]
    got = chains.chain_seeds(spark.createDataFrame(hits, HITS), exons, K).orderBy("chain_no").collect()
    assert [(g.chr, g.score, [tuple(f) for f in g.frags]) for g in got] == [("b", 20.0, [(20, 5000, 20)]), ("c", 20.0, [(20, 900, 20)]), ("c", 20.0, [(0, 10, 20)])]


def test_chains_that_follow_a_diagonal_skip_used_seeds(spark):
    hits = [(1, 1, "c", q, 100 + q, 60) for q in (0, 20, 40)] + [(1, 1, "c", 0, 5000, 60)]
    got = chains.chain_seeds(spark.createDataFrame(hits, HITS), spark.createDataFrame([], EXONS), K).collect()
    assert [[f.rpos for f in g.frags] for g in got] == [[100, 120, 140]]


def test_best_of_several_lists(spark):
    rows = [(1, d, "c", n, s, [(0, 1, 20)] * size) for d, n, s, size in ((1, 0, 9.0, 2), (1, 1, 5.0, 2), (-1, 0, 9.0, 2), (-1, 1, 8.0, 1))] + [(2, 1, "c", 0, 20.0, [(0, 1, 20)])]
    frame = spark.createDataFrame(rows, "rname long, dir int, chr string, chain_no int, score double, frags array<struct<qpos: long, rpos: long, len: int>>")
    got = sorted((x.rname, x.rank, x.dir, x.chain_no) for x in chains.kbest_chains(frame, ["rname"], 2).collect())
    assert got == [(1, 1, -1, 0), (1, 2, 1, 0), (2, 1, 1, 0)]


def test_groups_come_whole(spark):
    """Groups that go over several batches, and many in one, arrive once and whole."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")

    def sizes(t: pa.Table) -> pa.Table:
        counted = t.group_by(["a", "b"]).aggregate([("x", "count")])
        return counted.rename_columns(["a", "b", "n"])

    try:
        rows = [(g % 40 if g else None, str(g % 3), x) for g in range(60) for x in range(1 + g * g % 23)]
        frame = spark.createDataFrame(rows, "a int, b string, x int")
        got = sorted((tuple(r) for r in tables.in_groups(frame, ["a", "b"], sizes, "a int, b string, n long").collect()), key=repr)
        want = sorted((tuple(r) for r in frame.groupBy("a", "b").agg(F.count("x").alias("n")).collect()), key=repr)
        assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_bounds_of_seeds(spark):
    exons, hits = world(5)
    rows = [(i, h[2], h[4], 100 - h[3] - K) for i, h in enumerate(hits)]
    got = spans.seed_upper_bound(spark.createDataFrame(rows, "id long, chr string, pos long, rlen long"), spark.createDataFrame(exons, EXONS), K)
    assert {x.id: x.bound for x in got.collect()} == {i: bound_of(exons, c, r, rest)[0] for i, c, r, rest in rows}


def test_links_are_not_aggregated(spark):
    exons, hits = world(3)
    rows = spark.createDataFrame(hits + hits, HITS)
    got = chains.chain_links(rows, spark.createDataFrame(exons, EXONS), K)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == got.select("rname", "dir", "chr", "q1", "r1", "q2", "r2").distinct().count() > 0
