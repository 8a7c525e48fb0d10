import hashlib
import math
import random
import re

import numpy as np
import pytest

from helixframe.llm import pii, topk

REGEX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 60)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "STEP", 16)
    g = np.random.default_rng(1)
    vectors = {i: (g.normal(size=8) * (1 + i % 5)).astype(np.float32).tolist() for i in range(300)}
    for i in range(100, 200):
        vectors[i] = vectors[100]  # a third of all vectors are one
    bad = {900: None, 901: [1.0, None], 902: [float("nan")] * 8, 903: [math.inf] * 8}
    frame = spark.createDataFrame([(k, v, 1) for k, v in {**vectors, **bad}.items()], "vec_id long, embedding array<float>, v int")
    q = topk.quantised(frame)
    got = {}
    for r in topk.exact_topk(q, q.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = {k: np.floor(256 * np.array(v, float)).astype(np.int64) for k, v in vectors.items()}
    for k in range(0, 300, 50):
        best = sorted((-int(ints[k] @ x), i) for i, x in ints.items() if i != k)[:5]
        assert sorted(got[k]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert set(got) == set(range(0, 300, 50))


def test_topk_of_few_and_of_none(spark):
    frame = spark.createDataFrame([(0, [1.0]), (50, [2.0, 3.0])], "vec_id long, embedding array<float>")
    q = topk.quantised(frame)
    assert topk.exact_topk(q, q, 5).count() == 2
    none = topk.quantised(frame.where("vec_id < 0"))
    assert topk.exact_topk(none, none, 5).count() == 0


def test_topk_keeps_repeated_rows_and_ranks_every_query_row(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(topk, "CELL", 20)
    monkeypatch.setattr(topk, "BLOCK", 2)
    g = np.random.default_rng(2)
    rows = [(i % 60 if i < 100 else 50, (g.normal(size=6) * (1 + i % 3)).tolist()) for i in range(110)]
    rows += rows[:30] + [(None, [1.0] * 6)]
    frame = spark.createDataFrame([(k, v) for k, v in rows], "vec_id long, embedding array<double>")
    topk.quantised(frame).write.parquet(str(tmp_path / "v"))
    q = spark.read.parquet(str(tmp_path / "v"))
    ints = [(k, np.floor(256 * np.array(v)).astype(np.int64)) for k, v in rows if k is not None]
    want = []
    for i, (k, v) in enumerate(ints):
        if k % 50 == 0:
            best = sorted((-int(v @ x), c) for j, (c, x) in enumerate(ints) if j != i)[:5]
            want += [(k, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(map(tuple, topk.exact_topk(q, q.where("vec_id % 50 = 0"), 5).collect())) == sorted(want)


def test_topk_of_too_large_components(spark):
    q = topk.quantised(spark.createDataFrame([(0, [1e8]), (50, [1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="too large"):
        topk.exact_topk(q, q, 5)


def brute(text):
    def valid(kind, v):
        digits = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "phone":
            return 8 <= len(digits) <= 15
        if kind == "card":
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
        return True

    return [f"{k}:{m.start()}:{m.end()}" for k in REGEX for m in re.finditer(REGEX[k], text) if valid(k, m.group())]


TEXTS = ["a@b.c.d x", "a.b@c..d", "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "4111 1111-1111 1111", "4111 1111 1111 1111 1", "+1 (234) 555-6677 and +12", "x@y@z.w", "999.1.1.1 0255.001.1.0", "é@b.co +1((((", "",
         "1" * 30000, "1 " * 3000, "a@" + "b." * 3000 + "c", "\U0001f600 .a@b@c.d-e.f", "\x01a@b.c 4111\x011111 1111 1111", None]


def test_seed_spans_equal_brute_force(spark, tmp_path):
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, seeds int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.op4_pii(spark, str(tmp_path)).collect()}
    for i, text in enumerate(TEXTS):
        want = brute(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s.startswith(k) for s in want) for k in REGEX)


def test_contexts_find_what_the_seed_patterns_miss(spark, prose):
    rows = [(i, f"{prose(20, i)} telephone +1 555 01{i:02d}99 today {prose(20, -i)}") for i in range(30)]
    rows += [(100, f"{prose(20, 999)} telephone 5550188 today {prose(9, 1)}"), (101, f"{prose(20, 998)} item 5550188x {prose(9, 2)}"), (102, None)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    start = rows[30][1].index("5550188")
    assert [tuple(s) for s in got[100].found] == [(3, start, start + 7)]
    assert got[101].found == [] and got[102].found == [] and len(got[5].seeds) == 1


def test_bootstrapping_has_precision_and_recall(spark, prose):
    """Identifiers that no seed pattern matches, in the contexts of seeds, among numbers and addresses in other contexts."""
    r = random.Random(8)
    rows, planted, other = [], set(), set()
    around = {0: ("write to", "for details"), 2: ("charged card number", "expires soon"), 3: ("call me at", "after work")}
    seed = {0: lambda i: f"user{i}@mail.example.org", 3: lambda i: f"+49 30 {100000 + i}"}
    hidden = {0: lambda i: f"user{i} [at] mail [dot] example [dot] org", 3: lambda i: f"(030) {200000 + i}"}
    for i in range(240):
        text = prose(15, i)
        if i % 4 < 2:
            kind = (0, 3)[i % 2]
            left, right = around[kind]
            text += f" {left} {seed[kind](i)} {right}"
        elif i % 4 == 2:
            kind = (0, 3)[i // 4 % 2]
            left, right = around[kind]
            value = hidden[kind](i)
            text += f" {left} {value} {right}"
            at = text.index(value)
            planted.add((i, kind, at, at + len(value)))
        else:
            other.add(i)
            text += r.choice([f" chapter {1000 + i} of", f" in the year {1000 + i} and", f" part no {10000 + i} was"])
        rows.append((i, text + " " + prose(15, -i)))
    found = {(x.doc_id, *f) for x in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() for f in x.found}
    right = found & planted
    assert len(right) >= 0.95 * len(planted) and len(right) >= 0.95 * len(found)
    assert not {f[0] for f in found} & other


def test_scores_equal_brute_force(spark):
    r = random.Random(4)
    edges = {(f"p{r.randrange(9)}", node) for node in range(60) for _ in range(r.randint(1, 4))}
    kinds = {node: r.choice([0, 0, 3]) for node in range(40)}
    confidence = {}
    nodes = {p: [n for q, n in edges if q == p] for p, _ in edges}
    base = {(p, k): sum(kinds.get(n) == k for n in nodes[p]) for p in nodes for k in (0, 3)}
    base = {key: n for key, n in base.items() if n >= pii.SUPPORT}
    confidence = {(p, k): n / (len(nodes[p]) + pii.DOUBT) for (p, k), n in base.items()}
    for _ in range(pii.ROUNDS):
        doubts = {}
        for p, n in edges:
            for k in (0, 3):
                if n not in kinds and (p, k) in base:
                    doubts[n, k] = doubts.get((n, k), 1.0) * (1 - confidence[p, k])
        confidence = {(p, k): (m + sum(1 - doubts[n, k] for n in nodes[p] if (n, k) in doubts)) / (len(nodes[p]) + pii.DOUBT) for (p, k), m in base.items()}
    best = {n: min((doubts[n, k], k) for m, k in doubts if m == n) for n, _ in doubts}
    want = {(n, k) for n, (doubt, k) in best.items() if 1 - doubt >= pii.LEAST_SCORE}
    rows = [(n, kinds.get(n), [p for p, m in edges if m == n]) for n in range(60)]
    got = {(x.node, x.kind) for x in pii.bootstrap(spark.createDataFrame(rows, "node long, kind int, patterns array<string>")).collect()}
    assert got == want and 0 < len(want) < 20


def test_repeated_rows_and_long_texts_have_equal_results(spark, prose):
    text = prose(60_000, 5) + " a.b@c.de " + prose(60_000, 6)
    rows = [(1, text), (1, text), (None, "x@y.zz"), (None, "x@y.zz"), (2, "")]
    got = [(x.doc_id, [tuple(s) for s in x.seeds]) for x in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    at = text.index("a.b@")
    assert sorted(got, key=str) == sorted([(1, [(0, at, at + 8)])] * 2 + [(None, [(0, 0, 6)])] * 2 + [(2, [])], key=str)


def test_no_documents_hold_no_personal_data(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
