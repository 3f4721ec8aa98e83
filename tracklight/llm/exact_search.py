"""Exact top-k search by inner product with MaxScore, shard by shard.

Vectors are quantised to integers. The terms of a query are its non-zero components; the posting list of a term
holds the rows of a shard whose component is not 0. The largest contribution of a term to a score in the shard, 0
at least, is its score bound. For every query, the terms are put in the order of their bounds, and the longest
run of small ones whose bounds add up to less than the k-th best score known so far is non-essential: rows that
stand in its postings only cannot be results. The postings of the other, essential terms are traversed; of the
rows found there, those stay whose partial score and the bounds of the terms left reach the threshold, while the
non-essential terms are probed one after the other, largest bound first. The threshold rises from shard to shard
within a task, and the split is made anew for every query and shard. Scores are whole numbers, so the result is
exact; the tasks' results are merged per query.

Rows stay where they are: each block of queries, of ``block_cells`` components at most, is sent to all tasks, which
read the rows once per block; the results of a task are k rows per query.

Ties go to the smaller id. Defined results: null ids, null vectors and those with null or non-finite components
take no part; vectors of different lengths are filled up with zeros; a row with the query's id is never its
result; an id with several vectors asks with each, and counts once, with its best score; with fewer than k
candidates there are fewer results. Components beyond the range of a long are cut to it. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklight.llm import word_arrays as wa
from tracklight.llm.common import materialize


@dataclass(frozen=True)
class SearchConfig:
    k: int = 5
    shard_rows: int = 4096
    block_cells: int = 1 << 21  # components of the queries that are sent at a time
    probe: int = 4  # non-essential terms per round of probing
    dense: float = 0.5  # a posting list with more than this share of a shard's rows is traversed as a column


RESULT = "query_id long, vec_id long, score long"
WHOLE = 2**52  # whole numbers are exact as floats below this


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as an array of longs; null if the vector takes no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


@dataclass
class Shard:
    """Posting lists over the rows of a shard: term -> (rows, values), and the values as columns."""

    ids: np.ndarray
    columns: np.ndarray  # terms x rows
    config: SearchConfig

    def __post_init__(self):
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)
        filled = np.count_nonzero(self.columns, axis=1)
        self.full = filled > self.config.dense * self.columns.shape[1]
        self.postings = {t: np.flatnonzero(self.columns[t]) for t in np.flatnonzero(~self.full).tolist()}


@dataclass
class Best:
    """The best results of one query so far: ids and scores, best first."""

    k: int
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.empty(0))

    @property
    def threshold(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -float("inf")

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores]) if len(self.scores) else scores
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)  # of an id with several vectors the best
        order = order[np.sort(first)][: self.k]
        self.ids, self.scores = ids[order], scores[order]


def max_score(q_id: int, q: np.ndarray, shard: Shard, best: Best, counts: dict | None = None) -> None:
    """Add the rows of a shard to the best results of a query. ``counts`` gets how many postings there were, and how many were read."""
    terms = np.flatnonzero(q)
    weight = q[terms]
    bounds = np.maximum(np.where(weight > 0, weight * shard.high[terms], weight * shard.low[terms]), 0)
    order = np.argsort(bounds, kind="stable")
    sums = np.cumsum(bounds[order])
    n_minor = int(np.searchsorted(sums, best.threshold)) if best.threshold > 0 else 0
    minor, essential = terms[order[:n_minor]][::-1], terms[order[n_minor:]]
    rows = shard.columns.shape[1]
    partial = np.zeros(rows, dtype=shard.columns.dtype)
    dense = essential[shard.full[essential]]
    if len(dense):
        partial += q[dense] @ shard.columns[dense]
    touched = np.full(rows, bool(len(dense)) or best.threshold <= 0)  # without a positive threshold no row may be left out
    for t in essential[~shard.full[essential]].tolist():
        partial[shard.postings[t]] += q[t] * shard.columns[t, shard.postings[t]]
        touched[shard.postings[t]] = True
    left = sums[n_minor - 1] if n_minor else 0
    found = np.flatnonzero(touched & (shard.ids != q_id) & (partial + left >= best.threshold))
    scores = partial[found]
    read = len(essential) * rows
    for i in range(0, n_minor, shard.config.probe):
        part = minor[i : i + shard.config.probe]
        read += len(part) * len(found)
        scores = scores + q[part] @ shard.columns[np.ix_(part, found)]
        left = sums[n_minor - 1 - i - len(part)] if i + len(part) < n_minor else 0
        stay = scores + left >= best.threshold
        found, scores = found[stay], scores[stay]
    if counts is not None:
        counts["all"] = counts.get("all", 0) + len(terms) * rows
        counts["read"] = counts.get("read", 0) + read
    if len(found) > best.k and len(np.unique(shard.ids[found])) == len(found):  # all that ties with the k-th stay
        least = np.partition(scores, len(scores) - best.k)[len(scores) - best.k]
        found, scores = found[scores >= least], scores[scores >= least]
    if len(found):
        best.add(shard.ids[found], scores)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """One row per vector, filled up with zeros, or cut, to ``width``."""
    flat, lengths = vectors.flatten().to_numpy(), vectors.value_lengths().to_numpy()
    out = np.zeros((len(vectors), width), dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(vectors)), lengths)
    at = np.arange(len(flat)) - np.repeat(starts, lengths)
    inside = at < width
    out[row[inside], at[inside]] = flat[inside]
    return out


def search_block(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, config: SearchConfig) -> DataFrame:
    """(query_id, vec_id, score): the best rows of every task for each query of a block."""
    sent = rows.sparkSession.sparkContext.broadcast((q_ids, q))  # block_cells components at most
    most = int(np.abs(q.astype(object)).sum(axis=1).max(initial=0)) if len(q) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        best = [Best(config.k) for _ in range(len(ids))]
        for batch in batches:
            for at in range(0, batch.num_rows, config.shard_rows):
                piece = batch.slice(at, config.shard_rows)
                x = _matrix(piece.column("v"), q.shape[1])
                small = most * int(max(-int(x.min(initial=0)), int(x.max(initial=0)))) < WHOLE
                kind = np.float64 if small else object  # Python's whole numbers, if slow, for huge components
                shard = Shard(piece.column("vec_id").to_numpy(), np.ascontiguousarray(x.T).astype(kind), config)
                weights = q.astype(kind)
                for i in range(len(ids)):
                    max_score(int(ids[i]), weights[i], shard, best[i])
        flat = [(int(ids[i]), int(v), int(s)) for i, b in enumerate(best) for v, s in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in flat], pa.int64()) for k in range(3)], names=["query_id", "vec_id", "score"])
        wa.give_back()

    return rows.mapInArrow(run, RESULT)


def search(vectors: DataFrame, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score). Both tables have vec_id and a quantised vector ``v``."""
    usable = F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    rows = materialize(vectors.where(usable).select("vec_id", "v"), "search-rows")
    width = queries.where(usable).agg(F.max(F.size("v"))).first()[0] or 1
    asks = queries.where(usable).select("vec_id", "v")
    blocks = max(1, -(-asks.count() * width // config.block_cells))
    asks = materialize(asks.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "search-queries")
    found = None
    for block in range(blocks):
        own = asks.where(F.col("block") == block).select("vec_id", "v").toArrow().combine_chunks()
        v = own.column("v").combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.int64()))
        part = materialize(search_block(rows, own.column("vec_id").to_numpy(), _matrix(v, width), config), "search-found")
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = merged.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= config.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
