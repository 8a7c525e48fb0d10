"""N-gram Jaccard join with skipping.

Sets of word shingles are joined through an inverted index of their prefixes (the rarest shingles that any partner must
share one of). A list is cut into blocks of one set size, each in order of position: a set jumps to the blocks that its size can
reach, and in each to the stretch of positions from which enough shingles can still be shared; the rest of the list is skipped.
Equal sets are one set. Every set has its most similar partner among the candidates; the answers of the partners are computed
first, and those of the other sets are derived from them where the shingles that the two sets don't share can't change the
answer; only what that leaves open is verified. Lists much longer than a shingle may be common belong to groups of many similar
sets; these are verified block against block, in rounds that each ship a bounded number of sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components
from .word_arrays import array_of_lists, shingle_sets, slabs

#: Longest list whose pairs are listed (in a larger table longest_list), sets in a block of a larger group, and most ids that are broadcast.
SHORT, GROUP, BROADCAST_IDS = 64, 2_048, 2_000_000
#: Pairs of places in lists that are looked at together, and fewest sets that the cells of a round of large groups ship.
AT_ONCE, SHIPPED = 1 << 22, 500_000
#: A shingle in more than this share of the documents is put last in the order of shingles.
COMMON = 1 / 16_000
#: Documents whose shingles are counted together when common ones are looked for, and fewest of them that must hold one.
COUNTED, FEWEST = 8_000, 2


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Fewest shingles a set of n shares with any partner."""
    return -(-percent * n // 100)


def _most(documents: int) -> float:
    """A shingle in more documents than this is common."""
    return max(documents * COMMON, SHORT / 4)


def longest_list(documents: int) -> int:
    """Longest list whose pairs are listed. What may stand in many documents without being common makes no groups, which would grow
    together; counts of stretches miss some of a shingle's documents, therefore twice that."""
    return max(SHORT, int(2 * _most(documents)))


def _common_shingles(documents: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Shingles in more than COMMON of the documents, as far as a stretch of COUNTED documents shows it, and the number of documents.

    Only the order of shingles depends on these: any order gives the same links. At most (mean set size) / COMMON of them can
    exist, so that they fit a closure whatever the size of the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(pool), return_counts=True)
            top = times >= FEWEST
            pool.clear()
            return pa.RecordBatch.from_arrays([pa.array(values[top].view(np.int64)), pa.array(times[top])], names=["s", "n"])

        for b in batches:
            for _, _, data, offsets in slabs(b.column(0)):
                pool.extend(shingle_sets(data, offsets, size))
                if len(pool) >= COUNTED:
                    yield flush()
        if pool:
            yield flush()

    counted = documents.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    n = documents.count()
    return np.sort(counted.where(F.col("n") > _most(n)).select("s").toArrow()["s"].to_numpy().view(np.uint64)), n


def _ordered(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set in the global order: common shingles last."""
    if not len(common) or not len(s):
        return s
    common_here = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate([s[~common_here], s[common_here]])


def _sums(sets: list[np.ndarray]) -> list[pa.Array]:
    """n, f1 and f2 of sets: their sizes and 128-bit sums."""
    n = np.array([len(s) for s in sets], np.int64)
    f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    f2 = np.array([(s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    return [pa.array(n), pa.array(f1), pa.array(f2)]


def shingled(documents: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id, n (set size), f1, f2 (128-bit sum of the set) and prefix (first shingles in order) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slabs(batch.column(1)):
                sets = shingle_sets(data, offsets, size)
                sums = _sums(sets)
                n = sums[0].to_numpy()
                keep = n - least_overlap(n, percent) + 1
                prefix = array_of_lists([_ordered(s, common)[:k] if len(s) else s for s, k in zip(sets, keep)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *sums, prefix], names=["doc_id", "n", "f1", "f2", "prefix"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, prefix array<long>")


def _pairs_of_lists(token: np.ndarray, doc: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within equal tokens (rows sorted by token, n, pos) that size and position allow, the smaller set first."""
    rows = np.arange(len(token))
    first = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (n[1:] != n[:-1]))[: len(token)])
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(token))))
    wide = int(pos.max(initial=0)) + 2
    place = block * wide + pos  # ascends: blocks in order, and positions within each
    reach = 100 * n // percent
    left, right = [], []
    live = rows
    for skip in range(len(first)):
        target = block[live] + skip
        live, target = live[target < len(first)], target[target < len(first)]
        head = first[target]
        ok = (token[head] == token[live]) & (n[head] <= reach[live])  # sizes ascend: beyond one out of reach all are
        live, target, head = live[ok], target[ok], head[ok]
        if not len(live):
            break
        # of a pair at positions p and q at most min(p, q) + min(n - p, m - q) shingles are shared: q is in an interval around p
        need = -(-percent * (n[live] + n[head]) // (100 + percent))
        low = np.maximum(pos[live] + need - n[live], 0)
        high = np.minimum(pos[live] + n[head] - need, wide - 2)
        begin = np.searchsorted(place, target * wide + np.minimum(low, wide - 1))
        end = np.searchsorted(place, target * wide + np.maximum(high, -1), "right")
        begin = np.maximum(begin, live + 1) if skip == 0 else begin
        count = np.maximum(end - begin, 0)
        left.append(np.repeat(live, count))
        right.append(np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    i, j = np.concatenate(left or [np.empty(0, int)]), np.concatenate(right or [np.empty(0, int)])
    return doc[i], doc[j]


def _shares(token: np.ndarray) -> Iterator[slice]:
    """Rows, sorted by token, in stretches of whole lists that have some AT_ONCE pairs of rows, or of one list."""
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
    ends = np.append(first[1:], len(token))
    share = np.cumsum((ends - first) ** 2) // AT_ONCE
    cuts = np.flatnonzero(np.append(True, share[1:] != share[:-1])[: len(share)])
    for a, b in zip(cuts, np.append(cuts[1:], len(first))):
        yield slice(first[a], ends[b - 1])


def candidates(sets: DataFrame, percent: int, longest: int) -> DataFrame:
    """kind 0: pairs (a, b) from lists up to longest; kind 1: members (a: document, b: shingle) of longer lists.

    sets: doc_id, n, prefix. The lists arrive sorted, and a list is never held beyond longest + 1 rows and a batch.
    """
    postings = sets.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "n", "doc_id", "pos")
    postings = postings.repartition("token").sortWithinPartitions("token", "n", "pos", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        open_long = None  # the token of a long list that goes on

        def emit(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        def work(rows: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, open_long
            token = rows[0]
            if not len(token):
                return
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            length = np.diff(np.append(first, len(token)))
            is_long = (length > longest) | (token[first] == open_long if open_long is not None else False)
            tail_open = not last and not is_long[-1]
            open_long = token[-1] if not last and is_long[-1] else None
            in_long = np.repeat(is_long, length)
            if in_long.any():
                yield emit(1, rows[2][in_long], token[in_long])
            short = np.repeat(~is_long & (length > 1), length)
            if tail_open:
                short[first[-1] :] = False
            columns = [rows[k][short] for k in (0, 2, 1, 3)]
            for share in _shares(columns[0]):
                a, b = _pairs_of_lists(*[c[share] for c in columns], percent)
                if len(a):
                    yield emit(0, np.minimum(a, b), np.maximum(a, b))
            held = [r[first[-1] :] if tail_open else r[:0] for r in rows]

        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns)]
            yield from work(rows, False)
        yield from work(held, True)

    return postings.mapInArrow(run, "kind int, a long, b long")


def full_sets(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """doc_id (here and in what follows the number of a distinct set) and tokens of the sets wanted.

    wanted: doc_id, n, f1, f2 and rep, a document that has the set; a rep may have other texts as well. Up to BROADCAST_IDS
    reps (counted) are broadcast.
    """
    reps = wanted.select("rep").distinct()
    few = wanted.count() <= BROADCAST_IDS
    rows = documents.select(F.col("doc_id").cast("long").alias("rep"), "text").join(F.broadcast(reps) if few else reps, "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slabs(batch.column(1)):
                sets = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *_sums(sets), array_of_lists(sets, pa.int64())], names=[*keys, "tokens"])

    keys = ["rep", "n", "f1", "f2"]
    return rows.mapInArrow(run, "rep long, n long, f1 long, f2 long, tokens array<long>").dropDuplicates(keys).join(wanted, keys).select("doc_id", "tokens")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, o (shingles shared), na and nb (set sizes) of pairs (a, b)."""
    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
    both = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(1), batch.column(3)
            xo, yo = xs.offsets.to_numpy(), ys.offsets.to_numpy()
            x, y = xs.values.to_numpy(), ys.values.to_numpy()
            shared = np.zeros(len(batch), np.int64)
            for r in range(len(batch)):
                merged = np.sort(np.concatenate([x[xo[r] : xo[r + 1]], y[yo[r] : yo[r + 1]]]))
                shared[r] = (merged[1:] == merged[:-1]).sum()
            columns = [batch.column(0), batch.column(2), pa.array(shared), *(pa.array(np.diff(z).astype(np.int64)) for z in (xo, yo))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "o", "na", "nb"])

    return both.select("a", "x", "b", "y").mapInArrow(run, "a long, b long, o long, na long, nb long")


def reaching(found: DataFrame, percent: int) -> DataFrame:
    """u, v of the pairs (as from overlaps) that reach the threshold."""
    return found.where(F.col("o") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def derived(open_pairs: DataFrame, nearest: DataFrame, known: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """open_pairs (b, c) with link: true or false where the answers of b's nearest set tell, null where they don't.

    nearest: b, r, o (shared), nr, nb. known: the answers of nearest sets, r, c, o. What r shares with c, b shares as well save for
    the shingles of r that b lacks, and b may share no more than that and the shingles that r lacks.
    """
    j = open_pairs.join(nearest.select("b", "r", F.col("o").alias("rb"), F.col("nr"), F.col("nb")), "b", "left").join(known.select("r", "c", F.col("o").alias("rc")), ["r", "c"], "left")
    j = j.join(sizes.select(F.col("doc_id").alias("c"), F.col("n").alias("nc")), "c")
    least, most = F.col("rc") - (F.col("nr") - F.col("rb")), F.least(F.col("rc") + F.col("nb") - F.col("rb"), "nb", "nc")
    need = percent * (F.col("nb") + F.col("nc"))
    return j.select("b", "c", F.when(least * (100 + percent) >= need, True).when(most * (100 + percent) < need, False).alias("link"))


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one block with all of another, by products of their shared columns."""
    tx, ty = np.unique(np.concatenate(x)), np.unique(np.concatenate(y))
    shared = np.intersect1d(tx, ty, assume_unique=True)
    out = np.zeros((len(x), len(y)), np.float32)

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.searchsorted(shared, flat)
        hit = shared[np.minimum(col, max(len(shared) - 1, 0))] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(col[hit], kind="stable")
        return row[hit][order], col[hit][order]

    (rx, cx), (ry, cy) = placed(x), placed(y)
    for c in range(0, len(shared), 4_096):
        dense = []
        for rows, cols, n in ((rx, cx, len(x)), (ry, cy, len(y))):
            a, b = np.searchsorted(cols, (c, c + 4_096))
            m = np.zeros((n, min(4_096, len(shared) - c)), np.float32)
            m[rows[a:b], cols[a:b] - c] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which links join parts not joined by the links before them."""
    root: dict[int, int] = {}

    def find(z: int) -> int:
        while root.setdefault(z, z) != z:
            root[z] = root[root[z]]
            z = root[z]
        return z

    keep = np.zeros(len(u), bool)
    for i, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[ra], keep[i] = rb, True
    return keep


def _links(a: pa.Table, b: pa.Table | None, percent: int) -> pa.Table:
    """Links (u, v) between the sets of two blocks, or inside one, as far as they join parts not joined before."""
    x = [np.asarray(t.values) for t in a["tokens"].combine_chunks()]
    y = x if b is None else [np.asarray(t.values) for t in b["tokens"].combine_chunks()]
    shared = _overlaps(x, y)
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    i, j = np.nonzero(shared * (100 + percent) >= percent * (nx[:, None] + ny[None, :]))
    u, v = a["doc_id"].to_numpy()[i], (a if b is None else b)["doc_id"].to_numpy()[j]
    keep = _forest(u, v)
    return pa.table({"u": pa.array(u[keep], pa.int64()), "v": pa.array(v[keep], pa.int64())})


def group_links(members: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links inside groups: members (doc_id, component).

    A group of up to GROUP sets is one block. A larger one is cut into blocks of similar set size, and a block meets those its
    sizes allow. A set goes to as many cells as its block meets others, so that cells are worked on in rounds that ship as many sets as
    the large groups have, or SHIPPED; what a round has shipped is given up with it.
    """
    counts = members.groupBy("component").agg(F.count("*").alias("members"))
    placed = members.join(counts, "component").join(sizes, "doc_id")
    small = placed.where(F.col("members") <= GROUP).select("component", "doc_id").join(sets, "doc_id")
    inside = small.groupBy("component").applyInArrow(lambda t: _links(t, None, percent), "u long, v long")
    # blocks by a hash within steps of set size, as a rank over a group would put the group into one task
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(100 / percent))).cast("int")
    placed = placed.where(F.col("members") > GROUP).withColumn("step", step)
    per_step = placed.groupBy("component", "step").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
    placed = placed.join(per_step, ["component", "step"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    mine = per_step.select("component", F.col("step").alias("s1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b1"))
    other = per_step.select("component", F.col("step").alias("s2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b2"))
    all_cells = materialize(mine.join(other, "component").where("(s2 = s1 AND b2 >= b1) OR s2 = s1 + 1"), "cells")
    n_cells = all_cells.count()
    if not n_cells:
        return inside
    loaded = materialize(placed.select("doc_id", "component", "step", "block").join(sets, "doc_id"), "sets-of-groups", True)
    rounds = -(-n_cells * 2 * GROUP // max(SHIPPED, loaded.count()))
    keys = ["component", "s1", "b1", "s2", "b2"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            return _links(a, b, percent)
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})

    links = [inside]
    for r in range(rounds):
        cells = all_cells.where(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == r)
        left = cells.join(loaded.withColumnsRenamed({"step": "s1", "block": "b1"}), ["component", "s1", "b1"])
        right = cells.join(loaded.withColumnsRenamed({"step": "s2", "block": "b2"}), ["component", "s2", "b2"])
        left = left.select(*[F.col(k).alias(f"l_{k}") for k in keys], F.col("doc_id").alias("doc_id"), F.col("tokens").alias("tokens"))
        right = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("doc_id").alias("doc_id"), F.col("tokens").alias("tokens"))
        between = left.groupBy(*[f"l_{k}" for k in keys]).cogroup(right.groupBy(*[f"r_{k}" for k in keys])).applyInArrow(run, "u long, v long")
        links.append(materialize(between, "links-between", True))
    return reduce(DataFrame.unionByName, links)


def jaccard_classes(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: documents link at a Jaccard similarity of percent / 100.

    component_id is the smallest doc_id that links lead to, itself included. Words are separated by white space and lower-cased
    (A-Z); a text of fewer words than size is one shingle; a null text, or one without words, has no shingle and no link.
    Rows that repeat a doc_id, with one text or several, are one document for its links; each row has the size of its own set, and
    one without words keeps its doc_id. An empty table gives an empty result. Other columns are
    ignored; doc_id must be a number, and rows without one come back with a null component_id.
    """
    common, n_documents = _common_shingles(documents, size)
    docs = materialize(shingled(documents, size, percent, common), "shingled", True)
    filled = docs.where("n > 0 AND doc_id IS NOT NULL")
    alike = filled.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"))
    # the sets are numbered once, when they are written
    alike = materialize(alike.withColumn("set_id", F.monotonically_increasing_id()), "distinct-sets", True)
    reps = alike.select(F.col("set_id").alias("doc_id"), "n", "prefix")
    found = materialize(candidates(reps, percent, longest_list(n_documents)), "candidates", True)
    pairs = materialize(found.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("shared")), "pairs", True)
    crowded = found.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("token"))
    hubs = crowded.groupBy("token").agg(F.min("doc_id").alias("hub"))
    groups = components(crowded.join(hubs, "token").select(F.col("doc_id").alias("u"), F.col("hub").alias("v")))
    groups = materialize(groups.select(F.col("node").alias("doc_id"), "component"), "groups")
    sizes = alike.select(F.col("set_id").alias("doc_id"), "n")
    # a pair is kept only if what it shares of the prefixes leaves the threshold in reach; members of one group meet there
    n_a, n_b = sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    g_a, g_b = groups.select(F.col("doc_id").alias("a"), F.col("component").alias("ga")), groups.select(F.col("doc_id").alias("b"), F.col("component").alias("gb"))
    pairs = pairs.join(n_a, "a").join(n_b, "b").join(g_a, "a", "left").join(g_b, "b", "left")
    rest = F.greatest(F.floor(F.col("na") * percent / 100), F.floor(F.col("nb") * percent / 100))
    can = (F.col("shared") + rest) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    pairs = materialize(pairs.where(can & ~F.coalesce(F.col("ga") == F.col("gb"), F.lit(False))).select("a", "b", "shared"), "pairs", True)
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(groups.select("doc_id")).distinct()
    wanted = materialize(ids.join(alike.select(F.col("set_id").alias("doc_id"), "n", "f1", "f2", "rep"), "doc_id"), "ids")
    sets = materialize(full_sets(documents, wanted, size), "sets", True)
    # each set with the partner it shares most with; what these links and the groups join is settled
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    near = materialize(overlaps(best, sets), "nearest-answers")
    links = materialize(reaching(near, percent).unionByName(group_links(groups, sets, sizes, percent)), "links", True)
    so_far = components(links)
    c_a, c_b = so_far.select(F.col("node").alias("a"), F.col("component").alias("ca")), so_far.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    open_pairs = pairs.join(best.withColumn("done", F.lit(True)), ["a", "b"], "left_anti").join(c_a, "a", "left").join(c_b, "b", "left")
    open_pairs = materialize(open_pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "open-pairs")
    # the answers of sets that are the nearest of some other one, and from them those of these others
    heads = best.select("a").distinct()
    head_pairs = open_pairs.join(heads, "a", "left_semi").unionByName(open_pairs.join(heads.toDF("b"), "b", "left_semi").select("a", "b")).distinct()
    answers = materialize(overlaps(head_pairs, sets), "head-answers")
    known = answers.select(F.col("a").alias("r"), F.col("b").alias("c"), "o").unionByName(answers.select(F.col("b").alias("r"), F.col("a").alias("c"), "o"))
    nearest = near.select("b", F.col("a").alias("r"), "o", F.col("na").alias("nr"), "nb")
    rest = open_pairs.join(head_pairs, ["a", "b"], "left_anti")
    told = materialize(derived(rest.select("b", F.col("a").alias("c")), nearest, known, sizes, percent), "derived-answers")
    left = overlaps(told.where("link IS NULL").select(F.col("c").alias("a"), "b"), sets)
    links = links.unionByName(reaching(answers, percent)).unionByName(told.where("link").select(F.col("b").alias("u"), F.col("c").alias("v"))).unionByName(reaching(left, percent))
    # the texts of one document are one node
    repeated = filled.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    texts = filled.select("doc_id", "n", "f1", "f2").join(repeated, "doc_id", "left_semi").distinct().join(alike.select("n", "f1", "f2", "set_id"), ["n", "f1", "f2"])
    texts = materialize(texts.select("doc_id", "set_id"), "texts-of-ids")
    links = links.unionByName(texts.join(texts.groupBy("doc_id").agg(F.min("set_id").alias("v")), "doc_id").select(F.col("set_id").alias("u"), "v"))
    classes = components(links)
    of_set = alike.join(classes.select(F.col("node").alias("set_id"), "component"), "set_id", "left").select("n", "f1", "f2", "rep", F.coalesce("component", "set_id").alias("component"))
    least = of_set.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = of_set.join(least, "component").select("n", "f1", "f2", "component_id")
    return docs.select("doc_id", "n", "f1", "f2").join(of_set, ["n", "f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The pipeline's stage: of each class of similar documents only the one with the smallest doc_id stays.

    Null texts, texts without words and null doc_ids are in no class and stay; rows that repeat a doc_id stay or go together; an
    empty table gives an empty result.
    """
    gone = jaccard_classes(documents, size, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85)


QUERIES = {"op6_ngram_join": op6_ngram_join}
ORACLES = {
    "op6_ngram_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i:i+3], 'string_agg', ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
r(node, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(seen) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY ALL
"""
}
