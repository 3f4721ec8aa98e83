"""Ordered pairs of actors that met the same assets within a lag, told pair by pair without a row per meeting.

Actors are dealt into blocks by their hash, as many as the rows ask for, and every two blocks meet in one task: all
meetings of a pair are in one place, and only pairs with enough of them leave it. A task holds the rows of two blocks
and the meetings of as many sources as have ``MOST_MEETINGS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000  # rows of a block, on average
LEAST_BLOCKS = 8  # so that few rows are spread as well
MOST_MEETINGS = 1 << 20  # beyond those of one source
PAIRS = "source string, target string, observations long, ordering_consistency double, median_lag_seconds double, shared_assets array<string>"


def _ranks(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes in the order of the names' bytes, and the names."""
    names = pc.unique(column)
    names = names.take(pc.array_sort_indices(names))
    return pc.index_in(column, names).to_numpy(), names


def meetings(table: pa.Table, lag: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(source, target, asset, microseconds between) of all meetings in order of time, equal times by name, in chunks that hold all of a source's.

    ``table`` has is_source, the codes actor and asset, and t.
    """
    side, actor, asset, t = (table[c].to_numpy() for c in ("is_source", "actor", "asset", "t"))
    side = side.astype(bool)
    a, s, u = asset[side], t[side], t[~side]
    moments = np.unique(np.concatenate([s, s + lag, u]))
    keyed = lambda of, at: of.astype(np.int64) * len(moments) + np.searchsorted(moments, at)
    targets = keyed(asset[~side], u)
    order = np.argsort(targets, kind="stable")
    targets, target, u = targets[order], actor[~side][order], u[order]
    mine = np.argsort(actor[side], kind="stable")
    source, a, s = actor[side][mine], a[mine], s[mine]
    low, high = np.searchsorted(targets, keyed(a, s), "left"), np.searchsorted(targets, keyed(a, s + lag), "right")
    upto = np.cumsum(high - low)
    ends = np.append(np.flatnonzero(np.diff(source)) + 1, len(source))  # where a source's rows end
    begin = 0
    while begin < len(source):
        done = upto[begin - 1] if begin else 0
        fitting = ends[(ends > begin) & (upto[ends - 1] - done <= most)]
        end = int(fitting[-1]) if len(fitting) else int(ends[np.searchsorted(ends, begin, "right")])
        n = high[begin:end] - low[begin:end]
        row = np.repeat(np.arange(begin, end), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[row]
        ordered = (u[at] > s[row]) | (source[row] < target[at])
        row, at = row[ordered], at[ordered]
        yield source[row], target[at], a[row], u[at] - s[row]
        begin = end


def summed(source: np.ndarray, target: np.ndarray, asset: np.ndarray, late: np.ndarray, least: int, shown: int, actors: pa.Array, assets: pa.Array) -> pa.RecordBatch:
    """A row (``PAIRS``) of each pair with ``least`` meetings."""
    pair = source.astype(np.int64) * len(actors) + target
    _, of, counts = np.unique(pair, return_inverse=True, return_counts=True)
    kept = counts[of] >= least
    pair, asset, late = pair[kept], asset[kept], late[kept]
    order = np.lexsort((asset, pair))
    pair, asset, late = pair[order], asset[order], late[order]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.diff(np.append(starts, len(pair)))
    later = np.add.reduceat(late > 0, starts, dtype=np.int64) if len(starts) else n
    lags = (late / 1e6)[np.lexsort((late, pair))]
    low, high = lags[starts + (n - 1) // 2], lags[starts + n // 2]
    first = np.arange(len(pair)) - np.repeat(starts, n) < shown
    offsets = np.concatenate([[0], np.cumsum(np.minimum(n, shown))]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            actors.take(pa.array(pair[starts] // len(actors))), actors.take(pa.array(pair[starts] % len(actors))), pa.array(n, pa.int64()), pa.array(later / n, pa.float64()),
            pa.array(np.where(low == high, low, low * 0.5 + high * 0.5), pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), assets.take(pa.array(asset[first]))),
        ],
        names=["source", "target", "observations", "ordering_consistency", "median_lag_seconds", "shared_assets"],
    )


def lagged_pairs(first: DataFrame, lag: int, least: int, shown: int) -> DataFrame:
    """``PAIRS`` of the actors of ``first`` (actor, asset_id, t in microseconds; a stored table with one row per actor and
    asset) that have met ``least`` assets within ``lag`` of each other. Of a pair's assets the first ``shown`` are told."""
    blocks, most = max(LEAST_BLOCKS, -(-first.count() // BLOCK_ROWS)), MOST_MEETINGS
    own, every = F.pmod(F.xxhash64("actor"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = first.select("actor", "asset_id", "t", own.cast("int").alias("_own"), every.alias("_other"))
    sources = rows.select(F.col("_own").alias("_s"), F.col("_other").alias("_u"), F.lit(True).alias("is_source"), "actor", "asset_id", "t")
    targets = rows.select(F.col("_other").alias("_s"), F.col("_own").alias("_u"), F.lit(False).alias("is_source"), "actor", "asset_id", "t")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        (actor, actors), (asset, assets) = _ranks(table["actor"]), _ranks(table["asset_id"])
        coded = pa.table({"is_source": table["is_source"], "actor": actor, "asset": asset, "t": table["t"]})
        for chunk in meetings(coded, lag, most):
            yield summed(*chunk, least, shown, actors, assets)

    dealt = sources.unionByName(targets).repartition(blocks * blocks, "_s", "_u")
    return dealt.groupBy("_s", "_u").applyInArrow(met, PAIRS)
