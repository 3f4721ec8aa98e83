"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Text is cut into segments that no merge can cross: a run of blanks (as U+2581) with what follows it, and
characters that stand in no longer piece. Distinct segments are encoded together: their symbols lie in flat
arrays, and each round finds the least pair rank of every segment, merges the leftmost pairs of that rank in all
segments at once, and compacts the arrays, until no pair is left in the vocabulary. Where a merge would make a
pair of the same or a lesser rank, its segment merges only its first pair in that round, which is what a queue of
pairs would do next; so the result equals sequential merging. Characters outside the vocabulary become byte pieces.

Defined results: a null text is empty; an empty text is only the end id. Every distinct segment is encoded once
per task at most while it stays in a cache of ``MAX_CACHE_BYTES``, which ends with the task. Texts are whole;
memory grows with the longest text. Other columns, of whatever name, are carried along; those named like a column
of the result are replaced by it. A segment is a word with the blanks before it, so text without any blank is one
segment, whose time grows faster than its length (README).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracklight.llm import word_arrays as wa

BLANK = "▁"
NONE = np.int64(1) << 40  # the rank of a pair that is no piece
MAX_CACHE_BYTES = 24 << 20
MAX_SEGMENTS = 10_000


class PieceModel:
    """The vocabulary of a BPE model without normalization: ranks of pairs, byte pieces, surfaces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        self.byte_ids = np.full(256, self.unk, dtype=np.int64)
        self.byte_of: dict[int, int] = {}
        plain: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain[piece] = i
        if sp.encode(" a  b") != sp.encode(" a  b ")[:-1] or any(BLANK in p.lstrip(BLANK) for p in plain):
            raise ValueError("this encoder covers models that keep white space and do not normalize")
        # symbols: pieces by id, then characters outside the vocabulary that some piece holds
        self.symbol = dict(plain)
        for piece in plain:
            for c in piece:
                self.symbol.setdefault(c, len(self.pieces) + len(self.symbol))
        self.inner = {c for piece in plain if len(piece) > 1 for c in piece}
        scores = sorted({-sp.get_score(i) for i in plain.values()})
        rank = {s: k for k, s in enumerate(scores)}
        left, right, merged, ranks = [], [], [], []
        for piece, i in plain.items():
            for cut in range(1, len(piece)):
                a, b = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
                    ranks.append(rank[-sp.get_score(i)])
        self.width = 1 << 22
        keys = np.array(left, dtype=np.int64) * self.width + np.array(right, dtype=np.int64)
        self._index(keys, np.array(merged, dtype=np.int64), np.array(ranks, dtype=np.int64))
        alone = "".join(sorted(c for c in {"\n", "\t"} if c not in self.inner))
        self.cut = re.compile(f"[{alone}]|{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}]+" if alone else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.names = {v: k for k, v in self.symbol.items()}
        self.id_text = [str(i) for i in range(n)]
        self.surface = [self.decode_ids([i]) for i in range(n)]
        self.forget()

    def forget(self) -> None:
        """Drop the segments that are known so far."""
        self.cache: dict[str, tuple] = {}
        self.cached = 0  # bytes, about

    def _index(self, keys: np.ndarray, merged: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing: a slot per key, found by probing."""
        size = 1 << int(np.ceil(np.log2(max(4, 4 * len(keys)))))
        self.mask, self.slots = np.uint64(size - 1), np.full(size, -1, dtype=np.int64)
        self.keys, self.merged, self.ranks = keys, merged, ranks
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.slots[at[left]] < 0
            self.slots[at[left[free]]] = left[free]
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (wa.mix64(keys.view(np.uint64)) & self.mask).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; NONE where it is no piece."""
        keys = left * self.width + right
        rank, merged = np.full(len(keys), NONE), np.zeros(len(keys), dtype=np.int64)
        at, left_over = self._slot(keys), np.arange(len(keys))
        for _ in range(self.probes):
            found = self.slots[at[left_over]]
            hit = (found >= 0) & (self.keys[found] == keys[left_over])
            rank[left_over[hit]], merged[left_over[hit]] = self.ranks[found[hit]], self.merged[found[hit]]
            left_over = left_over[~hit & (found >= 0)]
            if not len(left_over):
                break
            at[left_over] = (at[left_over] + 1) & int(self.mask)
        return rank, merged

    def _symbols(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32)
        kinds, at = np.unique(points, return_inverse=True)
        base = len(self.pieces) + len(self.symbol) + 1
        known = np.array([self.symbol[c] if (c := chr(k)) in self.symbol else base + k for k in kinds.tolist()], dtype=np.int64)
        return known[at], np.repeat(np.arange(len(segments)), [len(s) for s in segments])

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all segments, where those of each segment start and end)."""
        symbols, owner = self._symbols(segments)
        done_symbols, done_owner = [], []
        while len(symbols):
            rank, merged = self.lookup(symbols[:-1], symbols[1:])
            rank = np.append(np.where(owner[:-1] == owner[1:], rank, NONE), NONE)
            merged = np.append(merged, 0)
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, heads)
            lengths = np.diff(np.append(heads, len(symbols)))
            live = np.repeat(least < NONE, lengths)
            if not live.all():  # segments without a pair are finished
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, rank, merged = symbols[live], owner[live], rank[live], merged[live]
                if not len(symbols):
                    break
                lengths, least = lengths[least < NONE], least[least < NONE]
            hit = rank == np.repeat(least, lengths)
            # leftmost, without overlap: of a run of hits every other one, from its start
            places = np.flatnonzero(hit)
            new_run = np.diff(places, prepend=-9) != 1
            start = places[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
            places = places[(places - start) % 2 == 0]
            places = places[self._safe(symbols, owner, rank, merged, places)]
            symbols = symbols.copy()
            symbols[places] = merged[places]
            stay = np.ones(len(symbols), dtype=bool)
            stay[places + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        symbols, owner = np.concatenate(done_symbols or [symbols]), np.concatenate(done_owner or [owner])
        order = np.argsort(owner, kind="stable")
        symbols, owner = symbols[order], owner[order]
        return symbols, np.searchsorted(owner, np.arange(len(segments) + 1))

    def _safe(self, symbols, owner, rank, merged, places) -> np.ndarray:
        """Which of the chosen pairs can be merged now: all of a segment, or its first where new pairs would come before the rest."""
        single = np.diff(owner[places], prepend=-1) != 0
        if single.all():
            return single
        new, r, last = merged[places], rank[places], len(symbols) - 1
        before, after = np.maximum(places - 1, 0), np.minimum(places + 2, last)
        bad = np.zeros(len(places), dtype=bool)
        neighbour = np.append(new[1:], 0)  # the next pair, when it is merged too and adjoins
        for left, right, ok in (
            (symbols[before], new, (places > 0) & (owner[before] == owner[places])),
            (new, symbols[after], (places + 2 <= last) & (owner[after] == owner[places])),
            (new, neighbour, np.append(places[1:] == places[:-1] + 2, False)),
        ):
            bad |= ok & (self.lookup(left, right)[0] <= r)
        stop = np.unique(owner[places][bad])
        return single | ~np.isin(owner[places], stop)

    def encode_new(self, segments: list[str]) -> None:
        """Put (ids as text, number of ids, surface) of each segment into the cache."""
        base, n = len(self.pieces) + len(self.symbol) + 1, len(self.pieces)
        text, surface, cache = self.id_text, self.surface, self.cache
        for i in range(0, len(segments), MAX_SEGMENTS):
            part = segments[i : i + MAX_SEGMENTS]
            symbols, bounds = self.encode_segments(part)
            plain = np.maximum.reduceat(symbols, bounds[:-1]) < n if len(symbols) else []
            flat, bounds = symbols.tolist(), bounds.tolist()
            for k, segment in enumerate(part):
                ids = flat[bounds[k] : bounds[k + 1]]
                if plain[k]:
                    cache[segment] = (" ".join([text[s] for s in ids]), len(ids), "".join([surface[s] for s in ids]))
                else:  # some characters are spelled in bytes
                    ids = [i for s in ids for i in ((s,) if s < n else self.byte_ids[list((chr(s - base) if s >= base else self.names[s]).encode())].tolist())]
                    cache[segment] = (" ".join(map(str, ids)), len(ids), self.decode_ids(ids))
                self.cached += 300 + 2 * len(segment) + 6 * len(ids)  # a dict's slot, a tuple, three strings

    def decode_ids(self, ids: list[int]) -> str:
        """The surface of ids without the dummy prefix: pieces with blanks restored, runs of byte pieces as UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(" ⁇ " if i == self.unk else "" if i == self.eos else self.pieces[i].replace(BLANK, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def segments(self, text: str) -> list[str]:
        """The text with its blanks marked and a blank put before it, cut where no merge can cross."""
        return self.cut.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """(decimal ids joined by blanks, number of ids, decoded text) of each text; ids end with the end id."""
        cut = [self.segments(t) for t in texts]
        if self.cached > MAX_CACHE_BYTES:
            self.forget()
        new = list({s for c in cut for s in c if s not in self.cache})
        self.encode_new(new)
        cache, end = self.cache, str(self.eos)
        for c in cut:
            found = [cache[s] for s in c]
            ids = " ".join([f[0] for f in found] + [end])
            yield ids, sum(f[1] for f in found) + 1, "".join([f[2] for f in found])[1:]


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


FULL = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode(documents: DataFrame, path: str, text: str = "text", digests: bool = False) -> DataFrame:
    """``documents`` without its text, with n_tokens, ids and decoded; or their digests instead of ids and decoded.

    ``path`` is where each executor finds the model file. Other columns are carried along unread.
    """
    added = DIGEST if digests else FULL
    names = {f.name for f in added}
    fields = [f for f in documents.schema.fields if f.name == text or f.name not in names]
    carried = documents.select(*[f.name for f in fields])
    others = [f for f in fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for piece in wa.slices(batch, [text], 1 << 20):
                ids, counts, decoded = [], [], []
                for joined, n, back in sp.encode_texts(pc.fill_null(piece.column(text), "").to_pylist()):
                    counts.append(n)
                    ids.append(sha(joined) if digests else joined)
                    decoded.append(sha(back) if digests else back)
                if not digests:
                    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.fromstring(" ".join(ids), dtype=np.int32, sep=" ")))
                columns = [piece.column(f.name) for f in others]
                columns += [pa.array(counts, pa.int64()), pa.array(ids, pa.string()) if digests else ids, pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in others], *[f.name for f in added]])
        sp.forget()
        wa.give_back()

    return carried.mapInArrow(run, T.StructType([*others, *added]))
