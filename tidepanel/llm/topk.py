"""Exact inner-product top-k search with a three-phase uniform threshold.

A score is the sum over `LISTS` segments of the dimensions, so each segment is a
list of partial scores. The partition of the rows only decides where they are.

1. Every partition takes the k best of each local list, resolves them, and
   reports for each query its k-th best total and the least value of each list.
   The largest k-th total is a safe cutoff: at least k rows reach it.
2. The cutoff is broadcast. Shifted by the lists' least values, scores are sums
   of non-negative parts, so a row that reaches the cutoff has a part of at
   least the cutoff's share, cutoff / LISTS, in some list. Only such entries are
   collected, and one is dropped if its known parts with the share for the
   unknown ones stay below the cutoff.
3. What remains is resolved exactly; every partition keeps its k best rows and a
   window over those ranks them.

Queries go through in blocks of bounded size, each broadcast to one pass over
the rows. Partial scores are integer products summed in float64 while that is
exact, and in Python integers beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LISTS = 2
BLOCK_BYTES = 16 << 20
ROWS = 1024
LEAST = -(1 << 63)
#: Partial scores count as this much at most where bounds are compared; rows with wider ones are always resolved.
WIDE = 1 << 59


def scaled(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) of each component as long.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return (vectors.select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite)
            .select(F.col("vec_id").cast("long"), whole.alias("v")))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch, by dimension, in chunks."""
    ids, lists = batch["vec_id"].to_numpy(), batch["v"]
    starts = lists.offsets.to_numpy()[:-1].astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.values.to_numpy()
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        for at in range(0, len(rows), ROWS):
            part = rows[at:at + ROWS]
            yield ids[part], values[starts[part][:, None] + np.arange(d)]


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors: int64 below 2^53, Python integers beyond."""
    reach = [int(np.abs(m.astype(object)).max()) if m.size and (m == LEAST).any() else int(np.abs(m).max(initial=0)) for m in (queries, rows)]
    if queries.shape[1] * reach[0] * reach[1] < 1 << 53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries.astype(object) @ rows.astype(object).T


def segments(queries: np.ndarray, rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The lists' partial scores within +-`WIDE`, the exact scores, and where a partial score is wider than that."""
    cut = [round(i * queries.shape[1] / LISTS) for i in range(LISTS + 1)]
    exact = [products(queries[:, a:b], rows[:, a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    total = sum(exact)
    if all(p.dtype != object for p in exact):
        return exact, total, np.zeros(total.shape, bool)
    if total.size and (total.max() > -(LEAST + 1) or total.min() < LEAST):
        raise OverflowError("an inner product is outside the range of a long")
    near = [np.clip(p, -WIDE, WIDE) for p in exact]
    wide = np.logical_or.reduce([n != p for n, p in zip(near, exact, strict=True)]).astype(bool)
    return [n.astype(np.int64) for n in near], total.astype(np.int64), wide


class Best:
    """The k best (score, smaller id first) rows of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query = np.empty(0, np.int64)
        self.row = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        query, row, score = (np.concatenate(x) for x in ((self.query, query), (self.row, row), (self.score, score)))
        order = np.lexsort((row, ~score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.row, self.score = query[keep], row[order][keep], score[order][keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every query, ties to the smaller vec_id.

    Both inputs have (vec_id, v) as `scaled` gives it. A row is no candidate for
    a query of its own vec_id, and vectors meet only in equal dimensions. A
    vec_id that repeats among the queries asks once, with its smallest vector;
    repeated candidate rows each take part. A query with fewer than k candidates
    returns all. Scores are exact over the whole range of a long; one outside it
    is an error.
    """
    spark = vectors.sparkSession
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    each = max(1, BLOCK_BYTES // (8 * max(size.d or 1, 1)))
    blocks = max(1, math.ceil(size.n / (0.8 * each)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = []
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).orderBy("vec_id").select("vec_id", "v").limit(2 * each + 1).collect()
        if len(rows) > 2 * each:
            raise ValueError("a block of queries is larger than its bound")
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for d in {len(r.v) for r in rows}:
            own = [(i, r) for i, r in enumerate(rows) if len(r.v) == d]
            held[d] = (np.array([i for i, _ in own]), np.array([r.vec_id for _, r in own]), np.array([r.v for _, r in own], np.int64).reshape(len(own), d))
        sent = spark.sparkContext.broadcast(held)
        cutoffs = _cutoffs(vectors, sent, k)
        bounds = {r.query: (r.cutoff, *r.least) for r in cutoffs.collect()}
        found.append(_sufficient(vectors, sent, spark.sparkContext.broadcast(bounds), k))
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _cutoffs(vectors: DataFrame, sent, k: int) -> DataFrame:
    """Phase 1: per query (by its index) the safe cutoff and the least value of each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        count = sum(len(h[0]) for h in held.values())
        best, least = Best(count, k), np.full((count, LISTS), np.iinfo(np.int64).max)
        for batch in batches:
            for ids, rows in matrices(batch):
                if rows.shape[1] not in held:
                    continue
                at, own, asking = held[rows.shape[1]]
                parts, total, _ = segments(asking, rows)
                mine = own[:, None] == ids[None, :]
                for j, part in enumerate(parts):
                    least[at, j] = np.minimum(least[at, j], part.min(axis=1))
                    top = np.argpartition(np.where(mine, LEAST >> 1, part), -min(k, len(ids)), axis=1)[:, -min(k, len(ids)):]
                    q, c = np.repeat(np.arange(len(at)), top.shape[1]), top.ravel()
                    fresh = ~mine[q, c]
                    q, c = q[fresh], c[fresh]
                    if j:  # a row counts once, though several lists name it
                        seen = np.isin(q * len(ids) + c, taken)
                        q, c = q[~seen], c[~seen]
                    taken = q * len(ids) + c if not j else np.concatenate((taken, q * len(ids) + c))
                    best.add(at[q], ids[c], total[q, c])
        counts = np.bincount(best.query, minlength=count)
        last = np.cumsum(counts) - 1
        cutoff = np.where(counts == k, best.score[np.maximum(last, 0)] if len(best.score) else LEAST, LEAST)
        seen = np.flatnonzero(least[:, 0] < np.iinfo(np.int64).max) if count else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(cutoff[seen]), *(pa.array(least[seen, j]) for j in range(LISTS))],
                                         ["query", "cutoff", *(f"least{j}" for j in range(LISTS))])

    lists = ", ".join(f"least{j} long" for j in range(LISTS))
    local = vectors.mapInArrow(run, f"query long, cutoff long, {lists}")
    return local.groupBy("query").agg(F.max("cutoff").alias("cutoff"), F.array(*(F.min(f"least{j}") for j in range(LISTS))).alias("least"))


def _sufficient(vectors: DataFrame, sent, bounds, k: int) -> DataFrame:
    """Phases 2 and 3: per partition and query the k best rows that reach the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = sent.value, bounds.value
        best = Best(0, k)
        names: dict[int, int] = {}
        for at, own, _ in held.values():
            names |= dict(zip(at.tolist(), own.tolist(), strict=True))
        for batch in batches:
            for ids, rows in matrices(batch):
                if rows.shape[1] not in held:
                    continue
                at, own, asking = held[rows.shape[1]]
                limit = np.array([known[i] for i in at.tolist()], np.int64)
                cutoff, least = limit[:, 0], limit[:, 1:]
                # Beyond 4 * WIDE a gap asks for more than any partial score that is not wide.
                gap = np.clip(cutoff.astype(object) - least.sum(axis=1), 0, 4 * WIDE).astype(np.int64)[:, None]
                near, total, wide = segments(asking, rows)
                parts = [p - least[:, j:j + 1] for j, p in enumerate(near)]
                sends = [LISTS * p >= gap for p in parts]
                reach = sum(np.where(s, LISTS * p, gap) for s, p in zip(sends, parts, strict=True))
                enough = (np.logical_or.reduce(sends) & (reach >= LISTS * gap) | wide) & (own[:, None] != ids[None, :])
                q, c = np.nonzero(enough)
                score = total[q, c]
                pick = score >= cutoff[q]
                best.add(at[q[pick]], ids[c[pick]], score[pick])
        query = np.array([names[i] for i in best.query.tolist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(best.row), pa.array(best.score)], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")
