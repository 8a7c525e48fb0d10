"""Benchmark decontamination by latent semantic retrieval.

Passages (overlapping windows of words) become TF-IDF vectors over the key words of the benchmark; a distributed randomised
SVD of the passages of all documents gives the latent space, in which the cosine to a benchmark item proposes candidates. A
longest common subsequence of words confirms a candidate; for paraphrases, which keep less of the item, its answer (the last
sentence) must be there as well.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, table
from .word_arrays import slabs, string_bytes, words

#: Words from one passage to the next (a passage has twice as many), dimensions of the latent space, least cosine.
STRIDE, RANK, LEAST_COSINE = 16, 64, 0.3
#: A word in more than this share of the passages is no key word, save that every part of an item has at least KEYS key words.
COMMON, KEYS = 0.002, 4
#: Least share of the key word weight of an item's part in a passage that goes on to the subsequence check (a passage may hold a part).
LEAST_WEIGHT = 0.15
#: Least share of an item's words in common order: as a copy, and as a paraphrase whose answer is there to ANSWER.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: Benchmark words of documents worked on at once in a task.
CHUNK = 200_000
#: Words of a part of a long item, and of the longest item that is not cut: a passage holds too little of a longer one to be like it.
PART, WHOLE = 48, 64
#: Parts of items searched at once; a larger benchmark is searched in parts, so that what tasks are sent stays bounded.
ITEMS = 8_000
#: Cosines of passages and parts worked out at once.
CELLS = 4_000_000


class Benchmark:
    """Items as word ids: the vocabulary (sorted word hashes), of each item the ids in order and where its answer begins, and of
    each part of an item its ids and the item's place. Parts propose candidates by themselves; whole items are checked."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = [r for r in rows if r[1]]
        hashed = []
        for _, text in rows:
            parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text) if p.strip()]
            answer = parts[-1] if len(parts) > 1 else ""
            hashed.append((_word_hashes(text), len(_word_hashes(answer))))
        keep = [i for i, (h, _) in enumerate(hashed) if len(h)]
        self.items = [rows[i][0] for i in keep]
        self.vocabulary = np.unique(np.concatenate([hashed[i][0] for i in keep])) if keep else np.empty(0, np.uint64)
        self.ids = [np.searchsorted(self.vocabulary, hashed[i][0]) for i in keep]
        self.answers = [hashed[i][1] for i in keep]
        cut = [np.array_split(ids, 1 if len(ids) <= WHOLE else math.ceil(len(ids) / PART)) for ids in self.ids]
        self.parts = [part for parts in cut for part in parts]
        self.item_of = np.repeat(np.arange(len(cut)), [len(parts) for parts in cut])


def _word_hashes(text: str) -> np.ndarray:
    return words(*string_bytes(pa.array([text], pa.string())), plain=True)[0]


def benchmark_words(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, gaps and ids: the benchmark words of every document in order, each with its distance from the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slabs(batch.column(1)):
                hashes, bounds = words(data, offsets, plain=True)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                place = np.flatnonzero(vocabulary[at] == hashes)
                cuts = np.searchsorted(place, bounds)
                gaps = np.diff(place, prepend=0).astype(np.int32)
                starts = cuts[:-1][cuts[1:] > cuts[:-1]]
                gaps[starts] = (place - bounds[np.searchsorted(bounds, place, "right") - 1])[starts]
                lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (gaps, at[place])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], names=["doc_id", "gaps", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, gaps array<int>, ids array<int>").where(F.size("ids") > 0)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of up to CHUNK words, or one row with more."""
    for batch in batches:
        ends = batch.column("gaps").offsets.to_numpy()
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def _flat(gaps: pa.ListArray, ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word position and word id of all words of a batch."""
    offsets = gaps.offsets.to_numpy().astype(np.int64)
    g = gaps.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
    w = ids.values.to_numpy()[ids.offsets[0].as_py() : ids.offsets[len(ids)].as_py()].astype(np.int64)
    length = np.diff(offsets)
    total = np.cumsum(g)
    before = np.append(0, total)[offsets[:-1] - offsets[0]]
    return np.repeat(np.arange(len(length)), length), total - np.repeat(before, length), w


def _blocks(row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A number for each stretch of STRIDE words; neighbouring stretches of a row have neighbouring numbers, rows a gap."""
    last = np.zeros(row[-1] + 1 if len(row) else 0, np.int64)
    np.maximum.at(last, row, pos // STRIDE)
    return np.append(0, np.cumsum(last + 2))[row] + pos // STRIDE + 1


def passage_frequencies(stored: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many stretches of STRIDE words of all documents each word of the vocabulary is, and how many stretches are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, stretches = np.zeros(size, np.int64), 0
        for batch in _chunks(batches):
            row, pos, ids = _flat(batch.column(0), batch.column(1))
            block = _blocks(row, pos)
            counts += np.bincount(np.unique(block * size + ids) % size, minlength=size)
            stretches += len(np.unique(block))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(size), -1)), pa.array(np.append(counts, stretches))], names=["id", "n"])

    rows = stored.select("gaps", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    found = {r["id"]: r["n"] for r in rows}
    return np.array([found.get(i, 0) for i in range(size)], float), found.get(-1, 0)


def key_weights(benchmark: Benchmark, df: np.ndarray, passages: int, exact: bool = False) -> np.ndarray:
    """The inverse document frequency of key words (exact: of all words), 0 for other words."""
    idf = np.log((1 + passages) / (1 + df)) + 1e-3
    key = (df <= COMMON * passages) | exact
    for ids in benchmark.parts:
        distinct = np.unique(ids)
        key[distinct[np.argsort(df[distinct], kind="stable")[:KEYS]]] = True
    return np.where(key, idf, 0.0)


def _passages(batch: pa.RecordBatch, weights: np.ndarray, fewest: int) -> tuple:
    """Row, position and id of key words, their stretches, and the first stretches of passages with fewest key words or more."""
    row, pos, ids = _flat(batch.column("gaps"), batch.column("ids"))
    key = weights[ids] > 0
    block = _blocks(row, pos)[key]
    n = np.bincount(block, minlength=int(block.max(initial=0)) + 2)
    first = np.flatnonzero(n[:-1] + n[1:] >= fewest)
    return row[key], pos[key], ids[key], block, first


def _projected(block: np.ndarray, vectors: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the vectors of the two stretches of each passage."""
    sums = np.zeros((len(vectors) + 1, vectors.shape[1]), np.float64)
    np.cumsum(vectors, axis=0, out=sums[1:])
    return sums[np.searchsorted(block, first + 1, "right")] - sums[np.searchsorted(block, first)]


def latent_basis(stored: DataFrame, weights: np.ndarray, seed: int = 7) -> np.ndarray:
    """An orthonormal basis (words x RANK) of the range of A'A O, A being the TF-IDF passages and O random (one power step)."""
    size = len(weights)
    rank = min(RANK, size)
    probe = np.random.default_rng(seed).standard_normal((size, rank)) * weights[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, rank))
        for batch in _chunks(batches):
            _, _, ids, block, first = _passages(batch, weights, 1)
            if not len(first):
                continue
            y = np.zeros((int(first[-1]) + 3, rank))
            y[first] = _projected(block, probe[ids], first)
            both = y[block] + y[block - 1]  # the passages a word is in begin at its stretch and at the one before
            order = np.argsort(ids, kind="stable")
            cuts = np.flatnonzero(np.diff(ids[order], prepend=-1))
            total[ids[order][cuts]] += np.add.reduceat(both[order], cuts, axis=0)
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["id", "row"])

    rows = stored.select("gaps", "ids").mapInArrow(run, "id long, row array<double>").select("id", F.posexplode("row").alias("j", "x"))
    # the words of a benchmark's part times RANK numbers, as Arrow columns
    found = rows.groupBy("id", "j").agg(F.sum("x").alias("x")).toArrow()
    z = np.zeros((size, rank))
    z[found["id"].to_numpy(), found["j"].to_numpy()] = found["x"].to_numpy()
    return np.linalg.qr(z * weights[:, None])[0]


def _common_subsequence(masks: dict[int, int], n: int, seen: list[int]) -> int:
    """Length of the longest common subsequence of an item (masks: the places of each word) and a list of words."""
    v = (1 << n) - 1
    full = v
    for w in seen:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _masks(ids: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(ids.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _search(stored: DataFrame, benchmark: Benchmark, weights: np.ndarray, basis: np.ndarray, exact: bool = False) -> DataFrame:
    size = len(weights)
    least_cosine, least_weight = (-2.0, 0.0) if exact else (LEAST_COSINE, LEAST_WEIGHT)
    loads = (basis * weights[:, None]).astype(np.float32)
    latent = np.stack([loads[ids].sum(0) for ids in benchmark.parts])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-30)
    # the words of each part as sorted numbers, part * size + word
    has = np.concatenate([np.unique(ids) + k * size for k, ids in enumerate(benchmark.parts)])
    mass = np.bincount(has // size, weights[has % size], len(benchmark.parts))
    # a part in the middle of a long item lies in up to four stretches, so that a passage may hold no more than half of it
    held = np.where(np.bincount(benchmark.item_of)[benchmark.item_of] > 1, 0.5, 1.0)
    fewest = max(1, math.floor(PARAPHRASE * min(h * int((weights[np.unique(ids)] > 0).sum()) for h, ids in zip(held, benchmark.parts))))
    fewest = 1 if exact else fewest
    lengths = np.array([len(i) for i in benchmark.ids])
    at_once = max(64, CELLS // len(benchmark.parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [_masks(i) for i in benchmark.ids]
        answer_masks = [_masks(i[len(i) - n :]) for i, n in zip(benchmark.ids, benchmark.answers)]
        for batch in _chunks(batches):
            hits: dict[tuple[int, int], float] = {}
            row, pos, ids = _flat(batch.column("gaps"), batch.column("ids"))
            bounds = np.searchsorted(row, np.arange(len(batch) + 1))
            key_row, key_pos, key_ids, block, first = _passages(batch, weights, fewest)
            for a in range(0, len(first), at_once):
                some = first[a : a + at_once]
                lo, hi = np.searchsorted(block, some), np.searchsorted(block, some + 1, "right")
                p = _projected(block[lo[0] : hi[-1]], loads[key_ids[lo[0] : hi[-1]]], some).astype(np.float32)
                p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-30)
                w, part_no = np.nonzero(p @ latent.T >= least_cosine)
                n = hi[w] - lo[w]
                at = np.repeat(lo[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pair = np.repeat(np.arange(len(w)), n)
                wanted = part_no[pair] * size + key_ids[at]
                held_here = has[np.minimum(np.searchsorted(has, wanted), len(has) - 1)] == wanted
                shared = np.bincount(pair, np.where(held_here, weights[key_ids[at]], 0.0), len(w))
                ok = shared >= least_weight * mass[part_no]
                for k, i in zip(w[ok].tolist(), benchmark.item_of[part_no[ok]].tolist()):
                    r = int(key_row[lo[k]])
                    if hits.get((r, i), 0.0) >= COPY:
                        continue
                    begin = int(key_pos[lo[k]]) // STRIDE * STRIDE
                    mine = pos[bounds[r] : bounds[r + 1]]
                    x, y = np.searchsorted(mine, (begin - lengths[i], begin + 2 * STRIDE + lengths[i])) + bounds[r]
                    seen = ids[x:y].tolist()
                    part = _common_subsequence(masks[i], int(lengths[i]), seen) / lengths[i]
                    answer = benchmark.answers[i]
                    if part < COPY and (part < PARAPHRASE or not answer or _common_subsequence(answer_masks[i], answer, seen) < ANSWER * answer):
                        continue
                    hits[r, i] = max(part, hits.get((r, i), 0.0))
            rows = pa.array([r for r, _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), pa.array([benchmark.items[i] for _, i in hits], pa.int64()), pa.array(list(hits.values()), pa.float64())],
                names=["doc_id", "item_id", "part"],
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"doc_id {kind}, item_id long, part double")


def contaminated(documents: DataFrame, benchmark: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, item_id and part (share of the item's words found in order) for each benchmark item that a document holds.

    exact: every passage with a word of an item is a candidate, whatever its cosine and weight; slow, but nothing is missed.

    documents: doc_id, text; benchmark: item_id, text. Words are what white space and ASCII punctuation leave, in lower case (up to Latin-1). Null or empty
    texts hold nothing, and items without a word are not looked for. Rows that repeat a doc_id (or a null one) are reported
    once, with the largest part. Texts may be of any length: they are searched passage by passage. Empty tables give an empty
    result. Other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    cuts = items.select(F.sum(F.ceil((F.regexp_count("text", F.lit(WORD)) + 1) / PART)).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(cuts / ITEMS))
    out = None
    for k in range(parts):
        bench = Benchmark([(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()])
        if bench.items:
            stored = materialize(benchmark_words(documents, bench.vocabulary), "benchmark-words")
            weights = key_weights(bench, *passage_frequencies(stored, len(bench.vocabulary)), exact)
            found = _search(stored, bench, weights, latent_basis(stored, weights), exact)
            out = found if out is None else out.unionByName(found)
    if out is None:
        kind = documents.schema["doc_id"].dataType.simpleString()
        return documents.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, part double")
    return out.groupBy("doc_id", "item_id").agg(F.max("part").alias("part"))


def keep_uncontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that hold a benchmark item go.

    Of rows that repeat a doc_id all go if one holds an item; null texts stay; an empty benchmark or table changes nothing.
    """
    gone = contaminated(documents, benchmark).select("doc_id").distinct()
    return documents.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left_anti").select(*documents.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_ids (ascending) and part (the largest) of every document that holds a benchmark item."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("part").alias("part"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {}
