"""Suffix-array dedup of byte strings, one suffix bucket at a time.

A suffix is filed under its anchor: the gram of smallest hash among those that its first LENGTH bytes hold, so that equal
strings of LENGTH bytes share a bucket, aligned at the anchor. Anchors that occur once are dropped unread. Of the others, equal
contexts are counted first; where the contexts of a bucket differ, its suffixes are sorted by their first bytes, and ties are
resolved by ranks that were computed beforehand for a cover sample (every PERIOD-th position from the anchor, which covers all
pairs of a bucket as its suffixes are aligned). A crowded bucket is split by further bytes, those that all suffixes at like
distances from the anchor have, and the parts are sorted; what is crowded even then is split by all LENGTH bytes, so that the
parts are the equal strings. A task holds a block of buckets, never the text of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .word_arrays import _BYTE, _Powers, mixed, slabs

#: Bytes of a repeat, of a gram, and from one position of the cover sample to the next.
LENGTH, GRAM, PERIOD = 200, 48, 32
#: Bytes of contexts sorted at once; contexts of one bucket, or part of one, above which it is split.
BLOCK, CROWDED = 3_000_000, 5_000
#: A gram of more than this share of all anchors is joined without a shuffle.
HOT = 1 / 1_000


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, anchor, first and last window start, gram hash and context hash of every anchor of a slab of texts.

    Windows with the same anchor are consecutive; their context reaches from the first window's start to the last one's end.
    """
    n = len(data)
    none = tuple(np.empty(0, np.int64) for _ in range(6))
    if n < LENGTH:
        return none
    up, down = _Powers.of(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_least(order, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    valid = starts + LENGTH <= offsets[1:][text]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    if not len(first):
        return none
    ends = valid.copy()
    ends[:-1] &= np.append(fresh[1:] | ~valid[1:], True)[: len(ends) - 1]
    last = np.flatnonzero(ends)
    a = anchor[first]
    context = mixed((sums[last + LENGTH] - sums[first]) * down[first] + mixed(((last - first) * 1024 + (a - first)).astype(np.uint64)))
    base = offsets[text[first]]
    return text[first], a - base, first - base, last - base, grams[a].view(np.int64), context.view(np.int64)


def anchors(documents: DataFrame) -> DataFrame:
    """h (gram), c (context), d (doc_id), t (hash of the text), a, lo, hi (byte positions) of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, data, offsets in slabs(batch.column(2)):
                text, a, lo, hi, h, c = anchors_of(data, offsets)
                row = pa.array(text + x)
                columns = [pa.array(h), pa.array(c), batch.column(0).take(row), batch.column(1).take(row), *(pa.array(z.astype(np.int64)) for z in (a, lo, hi))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "c", "d", "t", "a", "lo", "hi"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.where(F.octet_length("text") >= LENGTH).select("doc_id", F.xxhash64("text").alias("t"), "text")
    return docs.mapInArrow(run, f"h long, c long, d {kind}, t long, a long, lo long, hi long")


def contexts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, d, t, a, lo, n, crowded and x (bytes) of the anchors wanted (h, d, t, a, lo, hi, n, crowded), n being its copies."""
    per_text = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("h", "a", "lo", "hi", "n", "crowded")).alias("w"))
    docs = documents.select("doc_id", F.xxhash64("text").alias("t2"), F.encode("text", "UTF-8").alias("bytes"))
    joined = per_text.join(docs, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("t2")))
    each = joined.select("d", "t", "bytes", F.explode("w").alias("w"))
    return each.select("w.h", "d", "t", "w.a", "w.lo", "w.n", "w.crowded", F.substring("bytes", F.col("w.lo") + 1, F.col("w.hi") - F.col("w.lo") + LENGTH).alias("x")).dropDuplicates(["h", "d", "t", "a"])


def _aligned(contexts: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts in one array, each with its anchor at a multiple of PERIOD, and where each begins."""
    begin = np.zeros(len(contexts), np.int64)
    at = 0
    for k, x in enumerate(contexts):
        at += (-at - int(before[k])) % PERIOD
        begin[k] = at
        at += len(x)
    data = np.zeros(at + 2 * LENGTH + 8, np.uint8)
    for k, x in enumerate(contexts):
        data[begin[k] : begin[k] + len(x)] = np.frombuffer(x, np.uint8)
    return data, begin


def repeated_suffixes(contexts: list[bytes], before: np.ndarray, copies: np.ndarray) -> list[tuple[int, int, int]]:
    """(context, first, last) of the runs of suffixes whose first LENGTH bytes some other suffix of the block has as well.

    before: bytes from the start of each context to its anchor. copies: how often each context occurs. Suffixes are sorted by
    a key of their first PERIOD bytes, the rank and the distance of the next sample position and their last PERIOD bytes, and neighbours in that
    order are compared by all of these, so that the result doesn't depend on the key.
    """
    data, begin = _aligned(contexts, before)
    n_windows = np.array([len(x) - LENGTH + 1 for x in contexts])
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view(">u8").ravel()
    # ranks of the sample: the bytes between a suffix's first sample position and its last PERIOD bytes
    middle = LENGTH - PERIOD
    spots = np.arange(0, len(data) - LENGTH, PERIOD)
    strings = np.lib.stride_tricks.as_strided(data, (len(spots), middle), (PERIOD, 1)).copy().view(f"V{middle}").ravel()
    rank = np.unique(strings, return_inverse=True)[1].ravel().astype(np.uint64)
    owner = np.repeat(np.arange(len(contexts)), n_windows)
    at = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + begin[owner]
    columns = [eight[at + k].astype(np.uint64) for k in range(0, PERIOD, 8)] + [rank[-(-at // PERIOD)], (-at % PERIOD).astype(np.uint64)] + [eight[at + LENGTH - PERIOD + k].astype(np.uint64) for k in range(0, PERIOD, 8)]
    key = np.zeros(len(at), np.uint64)
    for c in columns:
        key = mixed(key + c)
    order = np.argsort(key, kind="stable")
    same = np.ones(max(len(order) - 1, 0), bool)
    for c in columns:
        same &= c[order[1:]] == c[order[:-1]]
    hit = copies[owner] > 1
    both = np.flatnonzero(same)
    hit[order[both]] = True
    hit[order[both + 1]] = True
    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0) != 0) if len(hit) else np.empty(0, int)
    out = []
    firsts = np.cumsum(n_windows) - n_windows
    for x, y in zip(edge[::2], edge[1::2]):
        while x < y:  # a run of hits may go over from one context to the next
            o = owner[x]
            z = min(y, firsts[o] + n_windows[o])
            out.append((int(o), int(x - firsts[o]), int(z - 1 - firsts[o])))
            x = z
    return out


def split_buckets(found: DataFrame) -> DataFrame:
    """The contexts of crowded buckets in parts: rows as from contexts, h being the part.

    Suffixes that begin up to PERIOD bytes apart, counted from the anchor, have LENGTH - PERIOD + 1 bytes in common; their hash
    tells the parts of a bucket apart. Equal suffixes begin at the same distance from their anchor and so share a part.
    """
    x = found.where("crowded").withColumn("hi", F.col("lo") + F.octet_length("x") - LENGTH)
    step = F.explode(F.sequence(F.floor((F.col("a") - F.col("hi")) / PERIOD), F.floor((F.col("a") - F.col("lo")) / PERIOD)))
    x = x.withColumn("step", step).withColumn("near", F.col("a") - F.col("step") * PERIOD)
    x = x.withColumn("lo2", F.greatest("lo", F.col("near") - (PERIOD - 1))).withColumn("hi2", F.least("hi", "near"))
    bytes_of = lambda start, n: F.substring("x", (start - F.col("lo") + 1).cast("int"), n)
    part = F.xxhash64("h", "step", bytes_of(F.col("near"), F.lit(LENGTH - PERIOD + 1)))
    parts = x.select(part.alias("h"), "d", "t", "a", F.col("lo2").alias("lo"), "n", bytes_of(F.col("lo2"), (F.col("hi2") - F.col("lo2") + LENGTH).cast("int")).alias("x"))
    sizes = parts.groupBy("h").agg(F.count("*").alias("m"))
    return parts.join(sizes, "h").where("m > 1 OR n > 1").select("h", "d", "t", "a", "lo", "n", (F.col("m") > CROWDED).alias("crowded"), "x")


def sorted_buckets(found: DataFrame) -> DataFrame:
    """d, t, start, end of the repeats that the sorting of the buckets of found (as from contexts) shows."""
    kind = found.schema["d"].dataType.simpleString()
    rows = found.where("NOT crowded").select("h", "d", "t", "a", "lo", "n", "x").repartition("h").sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table) -> pa.RecordBatch:
            n = t["n"].to_numpy()
            lo = t["lo"].to_numpy()
            runs = repeated_suffixes(t["x"].to_pylist(), t["a"].to_numpy() - lo, n)
            owner = np.array([r[0] for r in runs], np.int64)
            take = pa.array(owner)
            start, end = np.array([r[1] for r in runs], np.int64), np.array([r[2] for r in runs], np.int64) + LENGTH
            columns = [t["d"].combine_chunks().take(take), t["t"].combine_chunks().take(take), pa.array(lo[owner] + start), pa.array(lo[owner] + end)]
            return pa.RecordBatch.from_arrays(columns, names=["d", "t", "start", "end"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += sum(len(x) for x in batch.column(6).to_pylist())
            if size >= BLOCK:
                t = pa.Table.from_batches(held)
                h = t["h"].to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
                if cut:
                    yield from _cut(t.slice(0, cut), work)
                    held = t.slice(cut).to_batches()
                    size = sum(len(x) for x in t["x"].slice(cut).to_pylist())
        if held:
            yield from _cut(pa.Table.from_batches(held), work)

    return rows.mapInArrow(run, f"d {kind}, t long, start long, end long")


def _cut(t: pa.Table, work) -> Iterator[pa.RecordBatch]:
    """work over t in parts of about BLOCK bytes that end with a bucket."""
    h = t["h"].to_numpy()
    size = np.cumsum([len(x) for x in t["x"].to_pylist()])
    a = 0
    while a < len(h):
        b = int(np.searchsorted(size, (size[a - 1] if a else 0) + BLOCK)) + 1
        b = len(h) if b >= len(h) else int(np.searchsorted(h, h[b - 1], "right"))
        yield work(t.slice(a, b - a))
        a = b


def counted_buckets(found: DataFrame) -> DataFrame:
    """The same for parts of buckets that are crowded still: the first LENGTH bytes of their suffixes are counted by a 128-bit hash, pre-aggregated."""
    kind = found.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in enumerate(batch.column(4).to_pylist()):
                data = np.frombuffer(x, np.uint8)
                up, down = _Powers.of(len(data) + 1)
                keys = []
                for salt in (0, 0x5BD1E995):
                    sums = np.zeros(len(data) + 1, np.uint64)
                    np.cumsum(mixed(_BYTE + np.uint64(salt))[data] * up[:-1], out=sums[1:])
                    keys.append(mixed((sums[LENGTH:] - sums[:-LENGTH]) * down[: len(data) - LENGTH + 1]).view(np.int64))
                m = len(keys[0])
                row = pa.array(np.full(m, k))
                columns = [pa.array(keys[0]), pa.array(keys[1]), batch.column(0).take(row), batch.column(1).take(row), pa.array(np.arange(m) + batch.column(2)[k].as_py()), batch.column(3).take(row)]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "d", "t", "p", "n"])

    rows = found.where("crowded").select("d", "t", "lo", "n", "x").mapInArrow(run, f"k1 long, k2 long, d {kind}, t long, p long, n long")
    often = rows.groupBy("k1", "k2").agg(F.sum("n").alias("all")).where("all > 1").drop("all")
    return rows.join(often, ["k1", "k2"], "left_semi").select("d", "t", F.col("p").alias("start"), (F.col("p") + LENGTH).alias("end"))


def repeats(documents: DataFrame) -> DataFrame:
    """d, t, start, end: byte ranges of each text (doc_id and hash) covered by strings of LENGTH bytes that occur elsewhere."""
    # anchors are made anew where they are read: most occur once, and all of them take more disk than making them again takes time
    found = anchors(documents)
    # within one text the same context may stand at several places, so rows are counted, not texts
    buckets = materialize(found.groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("m > 1"), "buckets", True)
    # windows of random order have two anchors for each of their length
    total = (documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * 2 // (LENGTH - GRAM + 2)
    # grams of more than HOT of all anchors, of which there are fewer than 1 / HOT, are broadcast, so that no task gets one whole
    hot = F.col("m") > max(1, total * HOT)
    often = F.broadcast(buckets.where(hot))
    kept = found.join(often, "h").unionByName(found.join(often, "h", "left_anti").join(buckets.where(~hot), "h"))
    kept = materialize(kept.select(*found.columns, (F.col("c1") != F.col("c2")).alias("differ")), "anchors-repeated", True)
    place = F.struct("d", "t", "a", "lo", "hi")
    groups = materialize(kept.where("differ").groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("w")), "contexts-counted", True)
    crowd = groups.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > CROWDED).select("h", F.lit(True).alias("crowded"))
    wanted = groups.join(crowd, "h", "left").select("h", "w.d", "w.t", "w.a", "w.lo", "w.hi", "n", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    x = materialize(contexts(documents, wanted), "contexts", True)
    parts = materialize(split_buckets(x), "bucket-parts")
    differ, again = kept.where("differ"), groups.where("n > 1")
    hot_context = F.col("n") > max(1, total * HOT)
    often = F.broadcast(again.where(hot_context).select("h", "c"))
    rest = differ.join(often, ["h", "c"], "left_anti").join(again.where(~hot_context).select("h", "c"), ["h", "c"], "left_semi")
    whole = kept.where("NOT differ").unionByName(differ.join(often, ["h", "c"], "left_semi").select(*kept.columns)).unionByName(rest.select(*kept.columns))
    whole = whole.select("d", "t", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))
    return whole.unionByName(sorted_buckets(x.where("NOT crowded").unionByName(parts.where("NOT crowded")))).unionByName(counted_buckets(parts))


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for r in sorted(ranges, key=lambda r: r["start"]):
        if out and r["start"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], r["end"])
        else:
            out.append((r["start"], r["end"]))
    return out


def remove_repeats(documents: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans and kept (the bytes left) if keep_text, for every row.

    Every byte covered by a string of LENGTH bytes that also starts anywhere else in the documents, the same one included,
    goes; all copies go. A null text counts as empty. Rows equal in doc_id and text hold each other's strings like any others.
    An empty table gives an empty result. Other columns are ignored.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gone = repeats(docs).groupBy("d", "t").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    rows = docs.withColumn("t2", F.xxhash64("text"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t2") == F.col("t")), "left").select("doc_id", "text", "ranges")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start: long, end: long>>, kept binary" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, ranges in zip(batch.column(1), batch.column(2)):
                data = text.as_buffer().to_pybytes()
                spans = _merged(ranges.as_py() or [])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                for column, value in zip(out, (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], kept)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()][: 4 + 2 * keep_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 5 + 2 * keep_text])

    return joined.mapInArrow(run, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLES: dict[str, str] = {}
