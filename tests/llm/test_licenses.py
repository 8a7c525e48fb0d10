import random
import re

import pytest

from helixframe.llm import language_id, line_dedup, ngram_join
from helixframe.llm import license_scan as ls

FILLER = "lorem ipsum dolor sit amet consectetur elit sed do tempor".split()


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scanned(text, templates):
    """Every diagonal of every template tried, without grams in between."""
    w = words_of(text)
    base, labels, places, score = set(), set(), [], 0.0
    for t in templates:
        its = words_of(t.text)
        m = len(its)
        k = min(4, m)
        slack = min(m // 8, 8)
        least = m if t.base or m < 8 else -(-80 * m // 100)
        hits = sorted({p - at for at in range(m - k + 1) for p in range(len(w) - k + 1) if w[p : p + k] == its[at : at + k]})
        runs = []
        for d in hits:
            if runs and d - runs[-1][-1] <= slack:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            held = [i for i in range(m) if any(0 <= d + i < len(w) and w[d + i] == its[i] for d in run)]
            score = max(score, len(held) / m)
            if len(held) >= least:
                labels.add(t.label)
                if t.base:
                    base.add(t.label)
                    places.append(run[0] + held[0])
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def license_rows(seed):
    r = random.Random(seed)
    prose = lambda n: " ".join(r.choices(FILLER, k=n))
    texts = [None, "", " ", "MIT", "cc by", "CC-BY cc by, cc by", "the gnu general public license", "éapache license", "apache licensé", "MIT\nLicense" * 3]
    for _ in range(120):
        parts = []
        for _ in range(r.randint(1, 5)):
            t = words_of(r.choice(ls.TEMPLATES).text)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                if len(t) > 1:
                    at = r.randrange(len(t))
                    change = r.random()
                    t = t[:at] + ([] if change < 0.3 else [r.choice(FILLER)] if change < 0.6 else [t[at], r.choice(FILLER)]) + t[at + 1 :]
            parts += [prose(r.randint(0, 90)), r.choice([" ", ", ", "\n"]).join(t)]
        texts.append(" ".join(parts) + prose(r.randint(0, 3)))
    texts.append(" ".join(["Licensed under CC BY-NC 4.0."] * 3000) + prose(50_000))
    rows = [(k, t, k % 5, "x") for k, t in enumerate(texts)]
    return rows + [(None, texts[20], 1, "x"), (3, texts[21], 1, "x"), rows[25], rows[25]]


def test_scan_is_brute_force(spark):
    rows = license_rows(1)
    got = ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, n_words int, labels string"))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = [(r[0], *scanned(r[1], ls.TEMPLATES)) for r in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_spans_lie_on_their_templates(spark):
    mit = next(t for t in ls.TEMPLATES if t.text.startswith("Permission is hereby granted, free"))
    text = "some words before " + mit.text.replace("any person", "any natural person") + " and after"
    scan = ls.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), ls.TEMPLATES)
    spans = [s for s in ls.license_spans(scan, ls.TEMPLATES).collect() if s.verified]
    assert [(s.label, s.first, s.last, s.held, s.size) for s in spans] == [("mit", 3, 3 + len(mit.words), len(mit.words), len(mit.words))]


def test_templates_beyond_the_broadcast(spark, monkeypatch):
    rows = license_rows(2)[:60]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    want = sorted(map(repr, ls.scan_licenses(frame).collect()))
    monkeypatch.setattr(ls, "BROADCAST", 0)
    assert sorted(map(repr, ls.scan_licenses(frame).collect())) == want


def test_scan_of_nothing(spark):
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# repeated ids and clashing names in the operators of near duplicates, line dedup and language


def changed(text, at):
    w = text.split()
    w[at] = "changed"
    return " ".join(w)


def test_texts_of_one_id_link(spark, prose):
    a, b = prose(200, 1), prose(260, 2)
    rows = [(1, a), (1, b), (2, changed(a, 50)), (3, changed(b, 60))]
    got = sorted((g.doc_id, g.n_shingles, g.component_id) for g in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 196, 1), (1, 256, 1), (2, 196, 1), (3, 256, 1)]
    # an id that is not the smallest of either of its sets ties them together as well
    rows = [(5, a), (5, b), (2, changed(a, 50)), (9, changed(b, 60)), (7, ""), (5, None), (None, a)]
    got = {(g.doc_id, g.component_id) for g in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 2), (2, 2), (9, 2), (7, 7), (5, 5), (None, None)}


def classes_by_hand(rows, size, percent):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            same = rows[i][0] == rows[j][0] and x and y
            if same or x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_classes_with_repeated_ids_are_brute_force(spark, prose):
    r = random.Random(4)
    base = [prose(r.randint(3, 120), k) for k in range(12)]
    rows = []
    for _ in range(300):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(FILLER)
        rows.append((r.randrange(150), " ".join(w)))
    rows += [(400 + k, t) for k, t in enumerate(["", None, "a", "a b", "A  b"])]
    got = sorted(tuple(g) for g in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == classes_by_hand(rows, 5, 80)


@pytest.mark.parametrize("stage", ["language", "lines"])
def test_stages_keep_the_columns_of_documents(spark, stage):
    text = "the same line of words stands here twice\nthe same line of words stands here twice"
    rows = [(1, text, "en", 7, "a", True, 99, 5, "own", 1000), (2, text + "\nand one more line than that one has", "en", 8, "b", False, 98, 6, "mine", 2000)]
    schema = "doc_id long, text string, lang string, score int, lang_pred string, rejected boolean, n_removed int, n_lines int, line_dedup_gone string, n_chars long"
    frame = spark.createDataFrame(rows, schema)
    if stage == "language":
        out = language_id.keep_identified(frame, {"en": b" the same line of words stands here twice ", "de": b" eine ganz andere zeile "})
        assert sorted(map(tuple, out.collect())) == rows
    else:
        out = line_dedup.keep_deduped(frame)
        got = {g.doc_id: g for g in out.collect()}
        assert got[1].text == text.split("\n")[0] and got[1].n_chars == len(got[1].text)
        assert got[2].text == "and one more line than that one has"
        for k, row in enumerate(rows, 1):
            assert tuple(got[k])[2:9] == row[2:9]
    assert out.schema.simpleString() == frame.schema.simpleString()
    assert out.columns == frame.columns
