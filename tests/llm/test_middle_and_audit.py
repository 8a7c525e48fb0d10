import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import fill_in_middle as fim
from helixframe.llm import filter_audit as audit

SPACES = " \t\n\x0b\x0c\r"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def odd_texts(seed, n):
    r = random.Random(seed)
    out = ["", None, " ", "a", " a", "a ", "<P>", "x <S> y", "a<M", "<", "é", " é ß　x ", "<S", "P><S>"[:3]]
    for _ in range(n):
        out.append("".join(r.choice(["ab", "é", "€x", "𝄞", "<", "<S", "P>", *SPACES, "word", "long" * r.randint(1, 90)]) for _ in range(r.randint(1, 400))))
    return out


def expected(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = "".join(tokens[:i]), "".join(tokens[i:j]), "".join(tokens[j:])
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_is_brute_force(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(odd_texts(1, 250))] + [(None, "a null id", "x", 1), (7, "another text of one id", "x", 1), (900, "word " * 200_000, "x", 1)]
    rows += [rows[40], rows[40]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    made = fim.fill_in_middle(frame)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted([tuple(g)[:6] for g in got], key=repr) == sorted([expected(r[0], r[1]) for r in rows], key=repr)
    assert sorted(g.back for g in got) == sorted(r[1] or "" for r in rows)
    assert {g.form for g in got} == {"plain", "psm", "spm"}


def test_index_is_exact_and_error_bounded():
    r = np.random.default_rng(3)
    parts = [np.append(0, np.cumsum(r.integers(1, top, n))) for n, top in ((0, 2), (1, 9), (5, 3), (4000, 12), (300, 5000), (20_000, 2), (900, 100_000))]
    offsets = np.concatenate(parts)
    begin = np.append(0, np.cumsum([len(p) for p in parts]))
    for error in (0, 5, 127):
        index = fim.RankIndex(offsets, begin, error)
        at = np.arange(len(offsets))
        assert (index.exact(at) == offsets).all()
        assert np.abs(index.predict(at) - offsets).max() <= error
        assert set(begin[:-1]) <= set(index.first.tolist())  # no segment crosses texts
    assert len(fim.RankIndex(parts[5], np.array([0, len(parts[5])])).first) == 1


def test_fill_in_middle_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(frame).count() == 0
    assert fim.fill_in_middle(frame).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def simulated(docs, labels):
    """Every order applied to every part, document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failing = []
    for i, text, source in docs:
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs):
            fails.add("E")
        failing.append((i, source or "", fails))
    out = {}
    for part in {s for _, s, _ in failing}:
        shapley = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in permutations("ABCDE"):
            left = [(i, f) for i, s, f in failing if s == part]
            gone = []
            for step, own in enumerate(order, 1):
                removed = [(i, f) for i, f in left if own in f]
                redundant = sum(own in f for _, f in gone)
                left = [(i, f) for i, f in left if own not in f]
                gone += removed
                shapley[own] += len(removed)
                unique = sum(f == {own} for _, s, f in failing if s == part)
                rows.append((own, ("".join(order), step), (len(left), len(removed), redundant, unique, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed))))
        for own, key, values in rows:
            out[(part, *key)] = (*values, shapley[own])
    return out


def audit_rows():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    texts = ["", None, "short", "A B C", " ".join(word() for _ in range(260)), " ".join(["same", "words"] * 130), " ".join(word() for _ in range(250)) + " #", "#" + " Up" * 300]
    docs = [(k, r.choice(texts), r.choice(["s1", "s2", "", None, "rare"] if k % 9 == 0 else ["s1"])) for k in range(120)]
    docs += [(None, texts[4], "s1"), (None, None, "s1"), (3, texts[5], "s2"), docs[10], docs[10], (None, texts[4], "s1")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit_is_simulated(spark):
    docs, labels = audit_rows()
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, good int, part string")
    known = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = {(g.part, g.filter_order, g.step): (g.kept, g.removed, g.redundant, g.unique_fails, g.good_lost, g.toxic_lost, g.shapley) for g in audit.audit_filters(frame, known).collect()}
    assert got == simulated(docs, labels)


def test_shapley_values_add_up(spark):
    docs, labels = audit_rows()
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for g in audit.with_shapley(audit.coalition_games(audit.failing_sets(frame, known))).collect():
        assert sum(g.shapley) == 120 * g.n[31] and g.n[0] == 0


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_audit_of_little(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = audit.audit_filters(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600 * len(rows)
    assert all(g.removed == (g.filter_order[g.step - 1] == "A") for g in got)
