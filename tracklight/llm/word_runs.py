"""Periodic runs of words, found in a grammar of each text.

A run is a stretch of words with smallest period q, at least ``min_exponent`` periods and ``min_words`` words long, that
no neighbouring word extends. Texts become word numbers, and Re-Pair replaces pairs of symbols that stand several
times in a text by new symbols: in every round all pairs that are more frequent than the pairs which overlap them
(ties by hash) are replaced at once, in stretches of one symbol every second one, until no pair is left twice. What
remains of a text is joined by a balanced tree.

A run crosses the boundary between the two parts of exactly one lowest node of a text's derivation that holds it
whole. So every symbol is looked at once, at one of its places, for the runs that cross its boundary; a run of four
periods or more has two of them on one side, which a comparison of hashes finds for all periods of all symbols as
arrays, and what is found is compared word by word. The runs of a symbol are then moved to all places that derive it,
and pieces of one run, cut by symbols that hold only a part of it, are merged with it. Work and memory of a text are
n log n words; tasks take texts a slice at a time.

Defined results: a null or empty text has no words and no runs; runs are ordered by start, then period. The first q
words of a run stay in the collapsed text, the others go, unless no run holds them after its first period; kept words
are joined by one blank. Texts are taken whole, of any length. Repeated rows get the same result each; other columns,
of whatever name, are carried along, but for a column named runs, which the result's replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracklight.llm import word_arrays as wa


@dataclass(frozen=True)
class RunConfig:
    min_words: int = 6
    min_exponent: int = 4  # at least 4: one side of a boundary then holds two periods
    chunk: int = 1 << 20  # (symbol, period) pairs that are compared at a time

    def __post_init__(self):
        if self.min_exponent < 4 or self.min_words < 6:
            raise ValueError("runs have at least four periods and six words")


@dataclass
class Grammar:
    """Symbols below ``terminals`` are words; ``left`` and ``right`` are the rules of the others. ``first`` is a place of each."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    size: np.ndarray  # of all symbols, in words
    rounds: np.ndarray  # the number of rules before each round
    symbols: np.ndarray  # what is left of the texts
    places: np.ndarray  # where those symbols start


def repair(words: np.ndarray, starts: np.ndarray) -> Grammar:
    """Re-Pair of all texts of a slice, each by itself: ``words`` of text i are those in [starts[i], starts[i + 1])."""
    n = len(words)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    kinds, symbol = np.unique(text * (int(words.max(initial=0)) + 1) + words, return_inverse=True)  # symbols are a text's own
    symbol = symbol.astype(np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[starts[1:][np.diff(starts) > 0] - 1] = n  # n: nothing follows
    before[starts[:-1][np.diff(starts) > 0]] = n
    after, before = np.append(after, n), np.append(before, n)
    alive, rank = np.ones(n + 1, dtype=bool), np.zeros(n + 1, dtype=np.int64)
    lefts, rights, firsts, rounds, made = [], [], [], [0], len(kinds)
    at = np.flatnonzero(after[:n] < n)
    while len(at):
        keys = symbol[at] << 32 | symbol[after[at]]
        pairs, pair, count = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.empty(len(pairs), dtype=np.int64)
        order[np.lexsort((wa.mix64(pairs), count))] = np.arange(1, len(pairs) + 1)
        often = count[pair] > 1
        at, pair = at[often], pair[often]
        if not len(at):
            break
        rank[at] = order[pair]
        mine, previous, following = rank[at], before[at], after[at]
        same = rank[previous] == mine  # only in a stretch of one symbol
        head = np.where(same, 0, at)  # positions are in order, so the last head is the stretch's
        ordinal = np.arange(len(at))
        odd = (ordinal - np.maximum.accumulate(np.where(head == at, ordinal, 0))) % 2 == 1
        taken = ~odd & (rank[previous] <= mine) & (rank[following] <= mine)
        rank[at] = 0
        here, kind = at[taken], pair[taken]
        used, one, which = np.unique(kind, return_index=True, return_inverse=True)
        lefts.append(symbol[here[one]])
        rights.append(symbol[after[here[one]]])
        firsts.append(here[one])
        rounds.append(rounds[-1] + len(used))
        gone = after[here]
        symbol[here] = made + which
        made += len(used)
        alive[gone] = False
        after[here] = after[gone]
        before[after[here]] = here
        before[n] = after[n] = n
        near = before[here]
        at = np.unique(np.concatenate([at, here, near[near < n]]))
        at = at[alive[at] & (after[at] < n)]
    whole = np.flatnonzero(alive[:n])
    left, right, first = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (lefts, rights, firsts))
    size = np.ones(made, dtype=np.int64)
    for a, b in zip(rounds[:-1], rounds[1:], strict=True):
        size[len(kinds) + a : len(kinds) + b] = size[left[a:b]] + size[right[a:b]]
    return Grammar(len(kinds), left, right, first, size, np.array(rounds), symbol[whole], whole)


def tree(grammar: Grammar, starts: np.ndarray) -> np.ndarray:
    """(begin, boundary, end) of the nodes of balanced trees over what is left of the texts."""
    begin, end = grammar.places, grammar.places + grammar.size[grammar.symbols]
    text = np.searchsorted(starts, begin, side="right")
    out = [np.empty((0, 3), dtype=np.int64)]
    while len(begin):
        fresh = np.concatenate([[True], text[1:] != text[:-1]])
        ordinal = np.arange(len(begin))
        even = (ordinal - np.maximum.accumulate(np.where(fresh, ordinal, 0))) % 2 == 0
        joined = np.flatnonzero(even & np.append(text[1:] == text[:-1], False))
        if not len(joined):
            break
        out.append(np.stack([begin[joined], begin[joined + 1], end[joined + 1]], axis=1))
        end[joined] = end[joined + 1]
        begin, end, text = begin[even], end[even], text[even]
    return np.concatenate(out)


class Hashes:
    """Hashes of all stretches of a sequence."""

    def __init__(self, words: np.ndarray):
        base = np.uint64(0x9E3779B97F4A7C15 | 1)
        values = wa.mix64(words.astype(np.uint64) + np.uint64(1))
        n = len(words)
        self.power = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, base))])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(values * self.power[:n])])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at a and at b (a <= b) are the same."""
        return (self.sums[a + length] - self.sums[a]) * self.power[b - a] == self.sums[b + length] - self.sums[b]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The most words, up to ``most``, that stretches from a and b have in common, onwards or (``back``) before them."""
        low, high = np.zeros_like(most), most.copy()
        for _ in range(int(most.max(initial=0)).bit_length()):
            middle = (low + high + 1) // 2
            same = self.equal(a - middle, b - middle, middle) if back else self.equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def crossing(words: np.ndarray, hashes: Hashes, nodes: np.ndarray, config: RunConfig) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs inside each node (begin, boundary, end) that cross its boundary."""
    found = [(np.empty(0, np.int64),) * 4]
    longest = (nodes[:, 2] - nodes[:, 0]) // config.min_exponent
    nodes_at = np.flatnonzero((longest > 0) & (nodes[:, 2] - nodes[:, 0] >= config.min_words))
    totals = np.cumsum(longest[nodes_at])
    cuts = np.searchsorted(totals, np.arange(config.chunk, totals[-1] + config.chunk, config.chunk)).tolist() if len(totals) else []
    begin = 0  # parts of about a chunk; a larger node is a part of its own, compared a chunk of periods at a time
    for cut in cuts:
        part, begin = nodes_at[begin : cut + 1], cut + 1
        if len(part):
            found += _crossing(words, hashes, nodes, part, longest[part], config)
    node, start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, start, node))
    node, start, end, period = node[order], start[order], end[order], period[order]
    first = np.ones(len(node), dtype=bool)
    first[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # the least period of a stretch
    return node[first], start[first], end[first], period[first]


def _crossing(words, hashes, nodes, part, longest, config):
    for low in range(1, int(longest.max()) + 1, config.chunk):  # periods of a very large node come in pieces
        counts = np.clip(longest - low + 1, 0, config.chunk)
        of = np.repeat(part, counts)
        q = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + low
        begin, boundary, end = nodes[of, 0], nodes[of, 1], nodes[of, 2]
        for back in (False, True):
            a = boundary - 2 - q if back else boundary  # two words at a are the same as those q later
            inside = (a >= begin) if back else (a + q + 2 <= end)
            at = np.flatnonzero(inside)
            at = at[(words[a[at]] == words[a[at] + q[at]]) & (words[a[at] + 1] == words[a[at] + 1 + q[at]])]
            length = np.maximum(q[at], 2)
            a = boundary[at] - length - q[at] if back else boundary[at]
            full = (a >= begin[at]) if back else (a + length + q[at] <= end[at])
            at, a, length = at[full], a[full], length[full]
            good = hashes.equal(a, a + q[at], length)
            at, a = at[good], a[good]
            if len(at):
                ahead = hashes.common(a, a + q[at], end[at] - a - q[at], False)
                behind = hashes.common(a, a + q[at], a - begin[at], True)
                s, e = a - behind, a + ahead + q[at]
                long = (e - s >= np.maximum(config.min_words, config.min_exponent * q[at])) & (s < boundary[at]) & (boundary[at] < e)
                yield of[at][long], s[long], e[long], q[at][long]


def everywhere(grammar: Grammar, rule: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> list[tuple]:
    """The runs of the rules (by rule, with starts relative to the symbol's) at all places that derive them."""
    t, n = grammar.terminals, len(grammar.left)
    has = np.zeros(t + n, dtype=bool)
    has[t + rule] = True
    for a, b in zip(grammar.rounds[:-1], grammar.rounds[1:], strict=True):
        has[t + a : t + b] |= has[grammar.left[a:b]] | has[grammar.right[a:b]]
    bounds = np.searchsorted(rule, np.arange(n + 1))
    out = []
    symbol, place = grammar.symbols, grammar.places
    while len(symbol):
        kept = has[symbol]
        symbol, place = symbol[kept] - t, place[kept]
        counts = bounds[symbol + 1] - bounds[symbol]
        which = np.repeat(bounds[symbol] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        at = np.repeat(place, counts)
        out.append((at + start[which], at + end[which], period[which]))
        left, right = grammar.left[symbol], grammar.right[symbol]
        symbol, place = np.concatenate([left, right]), np.concatenate([place, place + grammar.size[left]])
    return out


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of one period that share a period's words or more are one; the result is by start, then period."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        group = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]]))
        most = np.int64(end.max()) + 1
        reach = np.maximum.accumulate(end + group * most) - group * most
        fresh = np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])])
        first = np.flatnonzero(fresh)
        start, period, end = start[first], period[first], reach[np.append(first[1:], len(reach)) - 1]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find(words: np.ndarray, starts: np.ndarray, config: RunConfig = RunConfig()) -> tuple[np.ndarray, ...]:
    """(start, end, period) of the runs of all texts of a slice, in places of the slice."""
    grammar = repair(words, starts)
    hashes = Hashes(words)
    t = grammar.terminals
    named = np.stack([grammar.first, grammar.first + grammar.size[grammar.left], grammar.first + grammar.size[t:]], axis=1)
    rule, s, e, q = crossing(words, hashes, named, config)
    pieces = everywhere(grammar, rule, s - named[rule, 0], e - named[rule, 0], q)
    _, s, e, q = crossing(words, hashes, tree(grammar, starts), config)
    start, end, period = merged(*[np.concatenate(x) for x in zip(*pieces, (s, e, q), strict=True)])
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
        if not np.array_equal(words[s : e - q], words[s + q : e]):
            raise ArithmeticError("two stretches of words have one hash")  # 64 bits: not to be expected
    return start, end, period


def dropped(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words a run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:n]) > 0


def _runs_of(texts: pa.Array, config: RunConfig) -> tuple[pa.Array, pa.Array]:
    words = wa.split_words(texts)
    start, end, period = find(words.codes, words.starts, config)
    gone = dropped(len(words.codes), start, end, period)
    bounds = np.searchsorted(start, words.starts)
    flat = pa.StructArray.from_arrays([pa.array(start - words.starts[np.searchsorted(words.starts, start, side="right") - 1]), pa.array(end - start), pa.array(period)], fields=list(RUN_ARROW))
    runs = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)
    loses = wa.segment_sum(gone.astype(np.int64), words.starts) > 0
    collapsed = []
    for k, value in enumerate(texts):
        own = value.as_buffer().to_pybytes().split()
        if loses[k]:
            a = int(words.starts[k])
            own = [w for w, out in zip(own, gone[a : a + len(own)].tolist(), strict=True) if not out]
        collapsed.append(b" ".join(own))
    return runs, pa.array(collapsed, pa.large_binary()).cast(pa.large_string())


RUN_ARROW = pa.struct([pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("period", pa.int64())])
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def collapse_runs(documents: DataFrame, text: str = "text", config: RunConfig = RunConfig()) -> DataFrame:
    """``documents`` with the text collapsed, and ``runs``: array of (start, length, period), in words of the text as it was."""
    carried = documents.drop("runs")
    schema = carried.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in wa.slices(batch, [text]):
                runs, collapsed = _runs_of(wa.texts_of(piece, text), config)
                columns = [collapsed.cast(f.type) if f.name == text else piece.column(i) for i, f in enumerate(piece.schema)]
                yield pa.RecordBatch.from_arrays([*columns, runs], names=[*piece.schema.names, "runs"])
        wa.give_back()

    return carried.mapInArrow(run, T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields], T.StructField("runs", RUNS)]))
