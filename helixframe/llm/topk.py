"""Exact top-k inner products by norm order and rotated partial sums.

Candidates are dealt into bands of descending length and cells of bounded size. A first pass over one cell of the longest
vectors gives each query a lower bound of its k-th score; then a query meets only the bands that can reach it (Cauchy-Schwarz
on whole lengths). Inside a cell, vectors are taken by descending length, their first SVD-rotated coordinates are multiplied,
and those whose partial sum plus the product of the residual lengths stays below the bound are dropped before the exact
integer product. Which bands a block of queries can reach is known before any vector is sent to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Candidates in a cell, queries in a block, bands of length, candidates multiplied at once.
CELL, BLOCK, BANDS, STEP = 8_192, 1_024, 32, 1_024


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """row (an id of the row, as vec_id may repeat), vec_id, v (floor(scale * x) of every component), norm.

    Vectors null or with null or non-finite components are left out. The table must be written before it is used, so that the
    ids of rows stay the same.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of int64, with zeros after the end of shorter vectors."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of all vectors (d x d), strongest first, from the d x d products that partitions add up."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = _matrix(pa.chunked_array([b.column(0)]), d).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = vectors.select("v").mapInArrow(products, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    gram = np.zeros((d, d))
    for r in rows.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        gram[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh(gram)[1][:, ::-1]


def best_in_cell(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, query_rows: np.ndarray, q: np.ndarray, floor: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, vec_id, score) of the k best of a cell for each query, as far as they reach the query's floor."""
    nx, nq = np.sqrt((x.astype(float) ** 2).sum(1)), np.sqrt((q.astype(float) ** 2).sum(1))
    order = np.argsort(-nx, kind="stable")
    own, ids, x, nx = rows[order], ids[order], x[order], nx[order]
    exact_type = float if nx.max(initial=0) * nq.max(initial=0) < 2**52 else np.int64  # doubles hold such sums exactly
    head = max(1, x.shape[1] // 4)
    xr, qr = x @ turn, q @ turn
    rest_x, rest_q = np.sqrt((xr[:, head:] ** 2).sum(1)), np.sqrt((qr[:, head:] ** 2).sum(1))
    floor = floor.copy()
    found = [np.empty(0, np.int64)] * 3
    for a in range(0, len(ids), STEP):
        slack = 1e-9 * (1.0 + nq * nx[a])
        live = np.flatnonzero(nq * nx[a] + slack >= floor)
        if not len(live):
            break
        part = slice(a, a + STEP)
        bound = qr[live, :head] @ xr[part, :head].T + np.outer(rest_q[live], rest_x[part]) + slack[live, None]
        keep = (bound >= floor[live, None]) & (query_rows[live, None] != own[None, part])
        if keep.sum() * 8 > keep.size:
            scores = (q[live].astype(exact_type) @ x[part].astype(exact_type).T).astype(np.int64)
            if keep.shape[1] > k:
                least = np.partition(np.where(keep, scores, np.iinfo(np.int64).min), -k, axis=1)[:, -k]
                keep &= scores >= np.maximum(least, np.where(np.isfinite(floor[live]), floor[live], least))[:, None]
            rows, cols = np.nonzero(keep)
            values = scores[rows, cols]
        else:
            rows, cols = np.nonzero(keep)
            values = np.concatenate([np.einsum("ij,ij->i", q[live[rows[b : b + 65_536]]], x[a + cols[b : b + 65_536]]) for b in range(0, len(rows), 65_536)] or [np.empty(0, np.int64)])
        at, vec, score = (np.concatenate(z) for z in zip(found, (live[rows], ids[a + cols], values)))
        order = np.lexsort((vec, -score, at))
        at, vec, score = at[order], vec[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        top = place < k
        found = [at[top], vec[top], score[top]]
        full = place == k - 1
        floor[at[full]] = np.maximum(floor[at[full]], score[full])
    return found[0], found[1], found[2]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row the k rows of vectors of highest inner product, save itself.

    vectors and queries are tables (row, vec_id, v, norm) as from quantised(), queries being some rows of vectors. Ties go to
    the smaller vec_id. Rows that repeat, or share a vec_id, are candidates like any others, and each query row has a ranking of
    its own. Fewer rows come back where there are fewer candidates. Shorter vectors count as padded with zeros. Empty tables
    give an empty result. Vectors so long that a score might not fit a long are an error. A task never meets more than about
    CELL candidates and BLOCK queries.
    """
    schema = "query_row long, query_id long, vec_id long, score long"
    n, d, longest = vectors.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    n_queries = queries.count()
    if not n or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if longest >= 2.0**31:
        raise ValueError("components are too large: a score might not fit a long")
    d = max(d, 1)
    turn = rotation(vectors, d)
    bands = min(BANDS, math.ceil(n / CELL))
    edges = sorted(set(vectors.approxQuantile("norm", [i / bands for i in range(1, bands)], 0.005))) if bands > 1 else []
    band = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: F.col("norm") < e)) if edges else F.lit(0)
    # one row for each of the BANDS bands, the longest vectors first
    stats = vectors.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy("band").collect()
    spots = F.array(*[F.struct(F.lit(r["band"]).alias("band"), F.lit(math.ceil(r["n"] / CELL)).alias("cells"), F.lit(r["longest"]).alias("longest")) for r in stats])
    top = stats[0]["band"]
    in_band = F.filter(spots, lambda s: s["band"] == F.col("band"))[0]
    placed = vectors.withColumn("band", band).withColumn("cell", F.pmod(F.xxhash64("row"), in_band["cells"]).cast("int"))
    blocks = math.ceil(n_queries / BLOCK)
    asked = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        at, ids, scores = [np.empty(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            floor = right["q_floor"].to_numpy().astype(float)
            at, ids, scores = best_in_cell(left["row"].to_numpy(), left["vec_id"].to_numpy(), _matrix(left["v"], d), right["q_row"].to_numpy(), _matrix(right["q_v"], d), floor, turn, k)
        columns = [right["q_row"].to_numpy()[at], right["q_id"].to_numpy()[at], ids, scores]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_row", "query_id", "vec_id", "score"), columns)})

    def meet(candidates: DataFrame, asked: DataFrame) -> DataFrame:
        """Every query (with s, a band that can reach its floor) with the candidates of the cells of that band."""
        reached = asked.select("block", F.col("s.band").alias("band")).distinct()
        left = candidates.join(reached, "band").select("row", "vec_id", "v", "band", "cell", "block")
        right = asked.select("row", "vec_id", "v", "floor", "block", "s.band", F.explode(F.sequence(F.lit(0), F.col("s.cells") - 1)).alias("cell")).toDF("q_row", "q_id", "q_v", "q_floor", "q_block", "q_band", "q_cell")
        return left.groupBy("band", "cell", "block").cogroup(right.groupBy("q_band", "q_cell", "q_block")).applyInArrow(kernel, schema)

    began = (F.col("band") == top) & (F.col("cell") == 0)
    one_cell = F.struct(F.lit(top).alias("band"), F.lit(1).alias("cells"))
    first = materialize(meet(placed.where(began), asked.select("*", F.lit(-math.inf).alias("floor"), one_cell.alias("s"))), "topk-first")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("place", F.row_number().over(w)).where(F.col("place") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("floor"))
    can = F.filter(spots, lambda s: s["longest"] * F.col("norm") * (1 + 1e-9) + 1 >= F.col("floor"))
    asked = asked.join(floors, "row", "left").fillna(-math.inf, ["floor"]).select("*", F.explode(can).alias("s"))
    found = first.unionByName(meet(placed.where(~began), asked))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return exact_topk(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.own <> c.own),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op3_topk_search": op3_topk_search}
ORACLES = {"op3_topk_search": ORACLE}
