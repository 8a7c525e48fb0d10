import hashlib
import random
from collections import Counter

import pytest

from helixframe.llm import line_dedup, ngram_join, suffix_dedup

DOCS = "doc_id long, text string, n int"


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b, most):
    bound = min(len(a) // 5, len(b) // 5, most)
    return bound > 0 and abs(len(a) - len(b)) <= bound and word_edits(a, b) <= bound


def brute_lines(docs, most=3):
    seen, out = {}, {}
    for d, text in docs:
        kept = []
        for line in (text or "").split("\n"):
            x = line.strip(" \t\r")
            w = x.split(" ")
            if not x:
                kept.append(line)
            elif x not in seen:
                seen[x] = any(near(w, o.split(" "), most) for o in seen)
                if not seen[x]:
                    kept.append(line)
        out[d] = "\n".join(kept) if text is not None else None
    return out


@pytest.fixture(scope="module")
def lined(prose):
    r = random.Random(5)
    lines = [prose(r.randint(1, 12), i) for i in range(60)]
    docs = []
    for d in range(80):
        mine = []
        for _ in range(r.randint(0, 6)):
            w = r.choice(lines).split(" ")
            k = r.randrange(len(w))
            w = r.choice([w, w[:k] + w[k + 1 :], w[:k] + ["zz"] + w[k:], w[:k] + ["yy"] + w[k + 1 :]])
            mine.append(r.choice(["", "  ", "\t"]) + " ".join(w))
        docs.append((d, "\n".join(mine)))
    return [*docs, (80, None), (81, ""), (82, "a a a a a a\na a a a a a a\n\n"), (83, " ".join(prose(2000, 3).split()) + "\n" + prose(2000, 3) + " x")]


@pytest.mark.parametrize(("edits", "crowded", "hot"), [(3, 16, 1e-3), (1, 2, 1e-3), (3, 1, 1e-9)])
def test_line_dedup_equals_brute_force(spark, lined, monkeypatch, edits, crowded, hot):
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    monkeypatch.setattr(line_dedup, "HOT", hot)
    frame = spark.createDataFrame([(d, t, 0, "x") for d, t in lined], "doc_id long, text string, n_removed int, gone string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame, edits).collect()}
    assert got == brute_lines(lined, edits)


@pytest.mark.parametrize("crowded", [16, 1])
def test_line_dedup_bound_grows_with_the_line(spark, prose, monkeypatch, crowded):
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    r = random.Random(11)
    lines = []
    for g in range(25):
        base = prose(r.choice([5, 9, 10, 14, 15, 32, 106]), 900 + g).split(" ") if g else ["a", "b"] * 12
        for _ in range(20 if g < 3 else 6):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [w[k], f"n{r.randrange(50)}"], [f"n{r.randrange(50)}"]])
            lines.append(w)
    r.shuffle(lines)
    want = [any(w == o or near(w, o, 3) for o in lines[:i]) for i, w in enumerate(lines)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    got = {x.doc_id: x.n_removed == 1 for x in line_dedup.dedup_lines(frame).collect()}
    assert [got[i] for i in range(len(lines))] == want
    assert 20 < sum(want) < len(lines) - 20


def test_very_long_lines_and_repeated_rows(spark, prose):
    long = prose(100_000, 3)
    rows = [(1, long), (2, "x " + long + " y"), (2, "x " + long + " y"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f g"), (None, None)]
    got = sorted((x.doc_id or 9, x.n_lines, x.n_removed, x.text) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).fillna("-", ["text"]).collect())
    assert got == [(1, 1, 0, long), (2, 1, 1, ""), (2, 1, 1, ""), (3, 1, 0, "a b c d e f"), (3, 1, 0, "a b c d e f"), (9, 0, 0, "-"), (9, 1, 1, "")]


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def shingles(text, size):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_classes(docs, size, percent):
    sets = {d: shingles(t, size) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.fixture(scope="module")
def similar(prose):
    r = random.Random(7)
    docs, d = [], 0
    for g in range(12):
        base = prose(r.choice([3, 8, 40, 120]), 100 + g).split()
        for _ in range(r.choice([1, 3, 40])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = f"w{r.randrange(99)}"
            docs.append((d, " ".join(w) if r.random() > 0.1 else " ".join(w).upper()))
            d += 1
    passage = prose(60, 77)
    docs += [(d + i, prose(30, 500 + i) + " " + passage) for i in range(50)]
    return [*docs, (900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two")]


@pytest.mark.parametrize(("size", "percent", "short", "group"), [(4, 85, 32, 2048), (5, 80, 4, 16), (4, 85, 2, 8)])
def test_classes_equal_brute_force(spark, similar, monkeypatch, size, percent, short, group):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0 if short == 2 else 2_000_000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(spark.createDataFrame([(d, t, 1) for d, t in similar], DOCS), size, percent).collect()}
    assert got == brute_classes(similar, size, percent)


def test_lists_that_grow_with_the_table_make_no_groups(spark):
    """At three million documents a shingle of 180 is not common yet; its list gives pairs, as no group could be told apart from the next one."""
    rows = [(d, 100 + d // 20, [7, 1_000 + d]) for d in range(180)]
    found = ngram_join.candidates(spark.createDataFrame(rows, "doc_id long, n long, prefix array<long>"), 85, ngram_join.longest_list(3_000_000))
    got = sorted((r.a, r.b) for r in found.where("kind = 0").collect())
    assert got == [(a, b) for a in range(180) for b in range(a + 1, 180)] and found.where("kind = 1").count() == 0


def test_large_groups_are_worked_on_in_rounds(spark, similar, monkeypatch):
    """The classes of brute force; no round ships more sets than it may, but for chance."""
    for name, value in (("SHORT", 2), ("GROUP", 8), ("SHIPPED", 40), ("AT_ONCE", 9)):
        monkeypatch.setattr(ngram_join, name, value, raising=False)
    written, write = [], ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda frame, name, *more: written.append(name) or write(frame, name, *more))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(spark.createDataFrame([(d, t, 1) for d, t in similar], DOCS), 4, 85).collect()}
    assert got == brute_classes(similar, 4, 85) and written.count("links-between") > 2


def test_pairs_of_lists_are_those_that_size_and_position_allow():
    import numpy as np

    r = random.Random(9)
    rows = sorted({(r.randrange(6), n, r.randrange(max(1, n // 5)), d) for d in range(300) for n in [r.choice([5, 20, 21, 22, 24, 40])]})
    token, n, pos, doc = (np.array(c, np.int64) for c in zip(*rows))
    a, b = ngram_join._pairs_of_lists(token, doc, n, pos, 80)
    want = []
    for i, (t, m, p, d) in enumerate(rows):
        for u, k, q, e in rows[i + 1 :]:
            if t == u and (min(p, q) + min(m - p, k - q)) * 180 >= 80 * (m + k) and k <= 100 * m // 80:
                want.append((d, e))
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(want) and len(want) > 100


def test_answers_are_derived_from_the_nearest_set(spark):
    sets = {0: set(range(100)), 1: set(range(99)), 2: set(range(4, 100)), 3: set(range(40, 140)), 4: set(range(12, 100))}
    size = {k: len(v) for k, v in sets.items()}
    share = lambda a, b: len(sets[a] & sets[b])
    nearest = spark.createDataFrame([(1, 0, share(0, 1), size[0], size[1])], "b long, r long, o long, nr long, nb long")
    known = spark.createDataFrame([(0, c, share(0, c)) for c in (2, 3, 4)], "r long, c long, o long")
    sizes = spark.createDataFrame([(k, n) for k, n in size.items()], "doc_id long, n long")
    asked = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 4)], "b long, c long")
    got = {(x.b, x.c): x.link for x in ngram_join.derived(asked, nearest, known, sizes, 88).collect()}
    for (b, c), link in got.items():
        assert link is None or link == (100 * share(b, c) >= 88 * len(sets[b] | sets[c]))
    assert got == {(1, 2): True, (1, 3): False, (1, 4): None, (2, 4): None}


def test_classes_of_odd_rows(spark, prose):
    long = prose(40_000, 12)
    rows = [(1, long), (2, long + " x"), (2, long + " x"), (None, long), (3, "one two"), (3, None), (4, "ONE two")]
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n, m = len(shingles(long, 5)), len(shingles(long + " x", 5))
    assert got == {(1, n, 1), (2, m, 1), (None, n, None), (3, 1, 3), (3, 0, 3), (4, 1, 3)}


def test_classes_of_nothing(spark):
    assert ngram_join.jaccard_classes(spark.createDataFrame([], DOCS)).count() == 0


def brute_repeats(docs, length=200):
    data = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())))
    return out


@pytest.mark.parametrize(("crowded", "hot"), [(5_000, 1e-3), (0, 1e-3), (3, 1.0)])
def test_repeats_equal_brute_force(spark, prose, monkeypatch, crowded, hot):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    passage, twin = prose(70, 1), prose(300, 2)
    docs = [(i, prose(40, 10 + i) + passage + prose(30, 90 + i)) for i in range(12)]
    docs += [(20, twin), (21, twin), (22, twin[: len(twin) // 2] + "X" + twin[len(twin) // 2 :]), (23, "ab" * 400), (24, "y" * 700 + prose(5, 4)), (25, None), (26, ""), (27, "z" * 200), (28, "z" * 199), (29, "é" * 150 + passage[:199])]
    docs += [(30 + i, prose(9, 700 + i) + passage[:190] + prose(9, 800 + i % 3)) for i in range(9)]
    long = prose(30_000, 71)
    docs += [(50, long), (51, "x" + long[:90_000] + "y"), (52, prose(50, 72)), (52, prose(50, 72)), (52, prose(50, 73))]
    got = sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.remove_repeats(spark.createDataFrame([(d, t, 2) for d, t in docs], DOCS)).collect())
    assert got == sorted(brute_repeats(docs))


def test_no_documents_have_no_repeats(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_anchors_that_occur_once_are_not_written(spark, prose, monkeypatch):
    written = []

    def materialize(frame, name, release=False):
        rows = frame.collect()
        written.append((name, len(rows)))
        return spark.createDataFrame(rows, frame.schema)

    monkeypatch.setattr(suffix_dedup, "materialize", materialize)
    letters = random.Random(3)
    docs = [(k, "".join(letters.choice("abcdefgh ") for _ in range(1_500)), 2) for k in range(4)]
    assert [x.n_removed for x in suffix_dedup.remove_repeats(spark.createDataFrame(docs, DOCS)).collect()] == [0] * 4
    assert written and not any(n for _, n in written)
