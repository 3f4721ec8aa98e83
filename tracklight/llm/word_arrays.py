"""Arrow and numpy views of the words of many texts, for code that runs inside Spark tasks.

Every distinct word of a slice of texts is handled once: texts become arrays of word numbers.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


@dataclass
class Words:
    """``codes`` numbers the words of all texts of a slice, text after text; text i has those in [starts[i], starts[i + 1])."""

    vocab: pa.Array
    codes: np.ndarray
    starts: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)


def slices(batch: pa.RecordBatch, texts: list[str], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``most`` bytes of these texts each; a longer row is a piece of its own."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(t)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
    done, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(done, i - done)
            done, total = i, 0
        total += n
    if done < batch.num_rows:
        yield batch.slice(done)


def give_back() -> None:
    """Return the memory that a task has freed to the machine; workers are used again by later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call, it keeps the memory
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    """The texts, null as empty."""
    return pc.fill_null(batch.column(text).cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(texts)
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = full.to_numpy(zero_copy_only=False)
    if not kept.all():  # space at an end of a text gives an empty word
        starts = np.concatenate([[0], np.cumsum(kept)])[starts]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy().astype(np.int64), starts)


def segment_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over [starts[i], starts[i + 1]); an empty range gives 0."""
    return _segments(np.add, values, starts, 0)


def segment_max(values: np.ndarray, starts: np.ndarray, empty: float) -> np.ndarray:
    return _segments(np.maximum, values, starts, empty)


def _segments(ufunc, values, starts, empty):
    out = np.full((len(starts) - 1, *values.shape[1:]), empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, starts[:-1][full], axis=0)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
