"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of trained vectors for its own hash and for the hashes of its first 4, 5 and 6
letters, as far as those stand in several texts of the sample. Filters of widths 1, 2 and 3 slide over the words of a text; each filter's largest response enters a
logistic output. It learns from all labelled texts, at their natural share, so that scores are probabilities. Few
texts are learned from on the driver. Of more, tasks count the words; then in every round each task goes over its texts
from the same network, and the mean of what the tasks found is the next round's. A threshold for each language is chosen
on the part of the texts that neither training nor the choice of the epoch or round saw; languages without enough
of it get the default. A text's part is chosen by its hash, so copies of a text are in the same part.

A score depends on the text alone. Defined results: null and empty texts get the score of no words; without any
labelled text of a class the score is the other class's share. Repeated rows get the same result each; other
columns, of whatever name, are carried along and never read, but for one named score, which is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklight.llm import samples
from tracklight.llm import word_arrays as wa
from tracklight.llm.common import broadcast_if_small, materialize

TRAINING, STOPPING, CALIBRATION = 0, 1, 2  # parts of the labelled texts
BATCH = 64  # texts per step
LONGEST_AT_ONCE = 64  # bytes; longer words are hashed one by one
CRC_TABLE = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], dtype=np.uint32)
PUNCTUATION = ".,;:!?\"'()[]{}<>*%$#&|…«»„“”¿¡-_"


@dataclass(frozen=True)
class ToxicityConfig:
    buckets: int = 1 << 18
    size: int = 8
    widths: tuple = (1, 2, 3)
    filters: int = 6
    prefixes: tuple = (4, 5, 6)
    max_rows: int = 6000  # of more labelled texts, or
    max_bytes: int = 1 << 28  # of more bytes, tasks learn
    epochs: int = 10
    rounds: int = 4  # that tasks learn in, at least
    rows_per_task: int = 16_000  # that a task goes over in a round, at least
    least_steps: int = 800  # few texts are gone over more often
    rate: float = 0.01
    threshold: float = 0.3
    least_texts: int = 3  # labelled texts that a word or prefix must stand in to have a vector,
    least_share: float = 0.002  # and share of them
    least_for_language: int = 20
    doubt: float = 2.0  # standard errors that a word's odds must exceed to count from the start
    seed: int = 11


@dataclass
class ToxicityModel:
    config: ToxicityConfig
    embedding: np.ndarray
    filters: list  # one (width, size, filters) array per width
    filter_bias: list
    out: np.ndarray
    bias: float
    known: np.ndarray  # rows of the embedding table that have a vector
    thresholds: dict = field(default_factory=dict)


def word_ids(vocab: list | pa.Array, config: ToxicityConfig) -> np.ndarray:
    """Rows of the embedding table for each distinct word: of the word itself and of its prefixes."""
    words = (vocab if isinstance(vocab, pa.Array) else pa.array(vocab, pa.large_string())).cast(pa.large_string())
    ascii_only, short = (c.to_numpy(zero_copy_only=False) for c in (pc.string_is_ascii(words), pc.less_equal(pc.binary_length(words), LONGEST_AT_ONCE)))
    out = np.empty((len(words), 1 + len(config.prefixes)), dtype=np.int64)
    plain = words.filter(pa.array(ascii_only & short))
    out[ascii_only & short] = _ids_at_once(pc.ascii_trim(pc.ascii_lower(plain), characters="".join(c for c in PUNCTUATION if c.isascii())), config)
    stripped = lambda which: [w.lower().strip(PUNCTUATION) for w in words.filter(pa.array(which)).to_pylist()]
    out[~ascii_only & short] = _ids_at_once(pa.array(stripped(~ascii_only & short), pa.large_string()), config)
    mask, crc = config.buckets - 1, zlib.crc32
    for i, w in zip(np.flatnonzero(~short).tolist(), stripped(~short), strict=True):
        out[i] = (crc(w.encode()) & mask, *(crc(b"%d" % n + w[:n].encode()) & mask if len(w) >= n else 0 for n in config.prefixes))
    return out


def _ids_at_once(words: pa.Array, config: ToxicityConfig) -> np.ndarray:
    """``word_ids`` of short words in lower case and without punctuation around: the CRC32 of all words, byte by byte."""
    if not len(words):
        return np.empty((0, 1 + len(config.prefixes)), dtype=np.int64)
    _, starts, data = words.buffers()
    starts = np.frombuffer(starts, np.int64)[words.offset : words.offset + len(words) + 1]
    data, lengths, letters = np.frombuffer(data or b"", np.uint8), np.diff(starts), pc.utf8_length(words).to_numpy(zero_copy_only=False)

    def crc(first: bytes, rows: np.ndarray, upto: np.ndarray) -> np.ndarray:
        state = np.full(len(lengths), zlib.crc32(first) ^ 0xFFFFFFFF, dtype=np.uint32)
        for k in range(int(upto[rows].max(initial=0))):
            rows = rows[upto[rows] > k]
            before = state[rows]
            state[rows] = CRC_TABLE[(before ^ data[starts[rows] + k]) & 0xFF] ^ (before >> 8)
        return ((state ^ 0xFFFFFFFF) & (config.buckets - 1)).astype(np.int64)

    ids = [crc(b"", np.arange(len(lengths)), lengths)]
    for n in config.prefixes:
        upto = pc.binary_length(pc.utf8_slice_codeunits(words, 0, n)).to_numpy(zero_copy_only=False)
        ids.append(np.where(letters >= n, crc(b"%d" % n, np.flatnonzero(letters >= n), upto), 0))
    return np.stack(ids, axis=1)


def _responses(model: ToxicityModel, vectors: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list]:
    """(texts x all filters: the largest response, 0 at least; the place of each, -1 where it is 0)."""
    best, places = [], []
    ends = np.repeat(starts[1:], np.diff(starts))
    for w, filters, bias in zip(model.config.widths, model.filters, model.filter_bias, strict=True):
        total = (vectors @ filters[0])[codes] + bias
        for k in range(1, w):
            shifted = (vectors @ filters[k])[codes[k:]]
            inside = (np.arange(len(codes) - k) + k) < ends[: len(codes) - k]
            total[: len(codes) - k] += shifted * inside[:, None]
        top = wa.segment_max(total, starts, 0.0)
        places.append(total)
        best.append(np.maximum(top, 0))
    return np.concatenate(best, axis=1), places


def score_words(model: ToxicityModel, words: wa.Words) -> np.ndarray:
    ids = word_ids(words.vocab, model.config)
    vectors = model.embedding[np.where(model.known[ids], ids, 0)].sum(axis=1)
    pooled, _ = _responses(model, vectors, words.codes, words.starts)
    return 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -40, 40)))


def _initial(config: ToxicityConfig) -> ToxicityModel:
    rng = np.random.default_rng(config.seed)
    table = rng.normal(0, 0.1, (config.buckets, config.size)).astype(np.float32)
    table[0] = 0  # stands for all without a vector
    filters = [rng.normal(0, 1 / np.sqrt(w * config.size), (w, config.size, config.filters)).astype(np.float32) for w in config.widths]
    return ToxicityModel(config, table, filters, [np.zeros(config.filters, np.float32) for _ in config.widths], rng.normal(0, 0.3, config.filters * len(config.widths)).astype(np.float32), 0.0, np.zeros(config.buckets, dtype=bool))


class _Adam:
    """Steps for some rows of an array; moments of the other rows stay."""

    def __init__(self, like: np.ndarray, rate: float):
        self.m, self.v, self.n, self.rate = np.zeros_like(like), np.zeros_like(like), 0, rate

    def step(self, p: np.ndarray, g: np.ndarray, rows=slice(None)) -> None:
        self.n += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * g
        self.v[rows] = 0.999 * self.v[rows] + 0.001 * g * g
        p[rows] -= self.rate * (self.m[rows] / (1 - 0.9**self.n)) / (np.sqrt(self.v[rows] / (1 - 0.999**self.n)) + 1e-7)


def _train_batch(model: ToxicityModel, ids: np.ndarray, codes: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, adam: dict) -> None:
    own, codes = np.unique(codes, return_inverse=True)
    ids = ids[own]
    vectors = model.embedding[ids].sum(axis=1)
    pooled, totals = _responses(model, vectors, codes, starts)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -40, 40)))
    error = (p - y) * weight / weight.sum()
    back = error[:, None] * model.out * (pooled > 0)
    grad_vectors = np.zeros_like(vectors)
    size = model.config.filters
    full = np.flatnonzero(np.diff(starts) > 0)
    for i, (w, total) in enumerate(zip(model.config.widths, totals, strict=True)):
        grad_f, grad_b = np.zeros_like(model.filters[i]), back[:, i * size : (i + 1) * size].sum(axis=0)
        top = pooled[:, i * size : (i + 1) * size]
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for f in range(size):
            if not len(full):
                break
            hit = np.flatnonzero(total[:, f] == top[text, f])
            t, first = np.unique(text[hit], return_index=True)
            at, g = hit[first], back[t, i * size + f]
            at, t, g = at[g != 0], t[g != 0], g[g != 0]
            for k in range(w):
                ok = at + k < starts[t + 1]
                words = codes[at[ok] + k]
                grad_f[k, :, f] += g[ok] @ vectors[words]
                np.add.at(grad_vectors, words, g[ok, None] * model.filters[i][k, :, f])
        adam["f", i].step(model.filters[i], grad_f + 1e-4 * model.filters[i])
        adam["b", i].step(model.filter_bias[i], grad_b)
    touched = np.flatnonzero(np.abs(grad_vectors).sum(axis=1) > 0)
    if len(touched):
        rows, at = np.unique(ids[touched].ravel(), return_inverse=True)
        grad = np.zeros((len(rows), model.config.size), np.float32)
        np.add.at(grad, at.ravel(), np.repeat(grad_vectors[touched], ids.shape[1], axis=0))
        adam["e"].step(model.embedding, grad[rows > 0], rows[rows > 0])
    adam["o"].step(model.out, (error @ pooled + 1e-4 * model.out).astype(np.float32))
    bias = np.array([model.bias])
    adam["c"].step(bias, np.array([error.sum()]))
    model.bias = float(bias[0])


def _texts_with(words: wa.Words, ids: np.ndarray, y: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """(class, row of the embedding table): in how many texts of the class a word or prefix of that row stands."""
    with_it = np.zeros((2, config.buckets), dtype=np.int64)
    for i in range(len(y)):
        with_it[int(y[i]), np.unique(ids[words.codes[words.starts[i] : words.starts[i + 1]]])] += 1
    return with_it


def _start_from_counts(model: ToxicityModel, with_it: np.ndarray, clean: int, toxic: int) -> None:
    """Tell by ``_texts_with`` of all texts which words and prefixes are known. Let the first coordinate of a vector, and the first filter of width 1, start from what can be counted: by how much
    the odds of a toxic text exceed the others' where the word or prefix stands in it, less ``doubt`` standard errors.

    With few texts this is most of what can be learned; training goes on from there.
    """
    config = model.config
    model.known = with_it.sum(axis=0) >= max(config.least_texts, config.least_share * (clean + toxic))
    total = np.array([clean, toxic])[:, None] + 1
    odds = np.log((with_it[1] + 0.5) / total[1]) - np.log((with_it[0] + 0.5) / total[0])
    error = np.sqrt(1 / (with_it[1] + 0.5) + 1 / (with_it[0] + 0.5))
    model.embedding[:, 0] = np.where(model.known, np.maximum(odds - config.doubt * error, 0), 0)
    model.embedding[0] = 0
    first = model.config.widths.index(1)
    model.filters[first][0, :, 0] = 0
    model.filters[first][0, 0, 0], model.filter_bias[first][0], model.out[first * config.filters] = 1, -0.5, 1
    model.bias = float(np.log(toxic / clean))


def _optimizer(model: ToxicityModel) -> dict:
    rate = model.config.rate
    adam = {("f", i): _Adam(f, rate) for i, f in enumerate(model.filters)} | {("b", i): _Adam(b, rate) for i, b in enumerate(model.filter_bias)}
    return adam | {"e": _Adam(model.embedding, rate), "o": _Adam(model.out, rate), "c": _Adam(np.zeros(1), rate)}


def _one_class(model: ToxicityModel, clean: int, toxic: int) -> ToxicityModel:
    model.out[:], model.bias = 0, 6.0 if toxic else -6.0 if clean else 0.0
    return model


def _rows_of(words: wa.Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts) of some of the texts."""
    lengths = words.lengths[rows]
    at = np.repeat(words.starts[:-1][rows] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    return words.codes[at], np.concatenate([[0], np.cumsum(lengths)])


def _losses(model: ToxicityModel, ids: np.ndarray, codes: np.ndarray, starts: np.ndarray, y: np.ndarray) -> np.ndarray:
    own, codes = np.unique(codes, return_inverse=True)
    pooled, _ = _responses(model, model.embedding[ids[own]].sum(axis=1), codes, starts)
    z = pooled @ model.out + model.bias
    return np.logaddexp(0, np.where(y > 0, -z, z))


def train(texts: list, labels: list, weights: list, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Minibatch Adam; of the epochs, the one with the least loss on the part for stopping is kept.

    Texts of the part for calibration are not looked at, not even by the counts that decide which words are known.
    """
    parts = parts_of(texts)
    seen = np.flatnonzero(parts != CALIBRATION).tolist()
    texts, labels, weights, parts = [texts[i] for i in seen], [labels[i] for i in seen], [weights[i] for i in seen], parts[seen]
    model = _initial(config)
    y, weight = np.array(labels, dtype=np.float32), np.array(weights, dtype=np.float32)
    toxic = int(y.sum())
    if toxic in (0, len(y)):
        return _one_class(model, len(y) - toxic, toxic)
    words = wa.split_words(pa.array(texts, pa.large_string()))
    ids = word_ids(words.vocab, config)
    _start_from_counts(model, _texts_with(words, ids, y, config), len(y) - toxic, toxic)
    ids = np.where(model.known[ids], ids, 0)
    share = float((y * weight).sum() / weight.sum())
    model.bias = float(np.log(share / (1 - share)))
    adam, held = _optimizer(model), parts == STOPPING
    rng, best = np.random.default_rng(config.seed), (np.inf, None)
    batches = max(1, -(-int((~held).sum()) // BATCH))
    for _ in range(max(config.epochs, -(-config.least_steps // batches))):
        rows = rng.permutation(np.flatnonzero(~held))
        for i in range(0, len(rows), BATCH):
            at = rows[i : i + BATCH]
            _train_batch(model, ids, *_rows_of(words, at), y[at], weight[at], adam)
        check = np.flatnonzero(held) if held.any() else rows
        pieces = [check[i : i + 256] for i in range(0, len(check), 256)]
        loss = float(np.concatenate([weight[at] * _losses(model, ids, *_rows_of(words, at), y[at]) for at in pieces]).sum())
        if loss < best[0]:
            best = (loss, (model.embedding.copy(), [f.copy() for f in model.filters], [b.copy() for b in model.filter_bias], model.out.copy(), model.bias))
    model.embedding, model.filters, model.filter_bias, model.out, model.bias = best[1]
    return model


def parts_of(texts: list) -> np.ndarray:
    """The part of each text: of 12, two are for stopping and one for calibration, if there are enough texts; the rest trains."""
    if len(texts) < 60:
        return np.full(len(texts), TRAINING)
    place = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % 12 for t in texts])
    return np.where(place < 2, STOPPING, np.where(place == 2, CALIBRATION, TRAINING))


def calibrate(model: ToxicityModel, texts: list, labels: list, languages: list) -> dict:
    """Language -> the threshold with the best F1 on the given texts, which training must not have seen."""
    scores = np.concatenate([np.empty(0), *(score_words(model, wa.split_words(pa.array(texts[i : i + 200], pa.large_string()))) for i in range(0, len(texts), 200))])
    labels, out = np.array(labels), {}
    for language in sorted({v for v in languages if v is not None}):
        own = np.array([v == language for v in languages])
        s, t = scores[own], labels[own]
        if own.sum() < model.config.least_for_language or t.min() == t.max():
            continue
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum(t[order])
        f1 = 2 * hits / (np.arange(1, len(s) + 1) + t.sum())
        best = int(f1.argmax())
        below = s[order][best + 1] if best + 1 < len(s) else 0.0
        out[language] = float((s[order][best] + below) / 2)
    return out


def labelled_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text, lang, toxic and _h (a hash of the id) of every labelled document that is not held out, written once.

    Of documents that share an id one text is taken; an id with both labels counts with each.
    """
    known = labels.where(~samples.held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    known = broadcast_if_small(materialize(known, "labels"), 1_000_000)
    taken = F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang")).alias("_t")
    found = documents.select("doc_id", "text", "lang").join(known, "doc_id").groupBy("doc_id", "toxic").agg(taken)
    return materialize(found.select("_t.*", "toxic", F.xxhash64("doc_id").alias("_h")), "labelled")


def _pieces(batches: Iterator[pa.RecordBatch], config: ToxicityConfig) -> Iterator[tuple]:
    """(words, rows of the embedding table by word, labels) of a task's labelled texts, some megabytes at a time."""
    for batch in batches:
        for piece in wa.slices(batch, ["text"]):
            words = wa.split_words(wa.texts_of(piece, "text"))
            yield words, word_ids(words.vocab, config), piece.column("toxic").to_numpy(zero_copy_only=False).astype(np.float32)


def _table_of(model: ToxicityModel) -> np.ndarray:
    """All numbers of the network in rows of ``size``: the known words' vectors, then all others."""
    rest = np.concatenate([*(f.ravel() for f in model.filters), *model.filter_bias, model.out, [model.bias]])
    size = model.config.size
    return np.concatenate([model.embedding[model.known], np.pad(rest, (0, -len(rest) % size)).reshape(-1, size)]).astype(float)


def _from_table(model: ToxicityModel, table: np.ndarray) -> ToxicityModel:
    embedding, n = model.embedding.copy(), int(model.known.sum())
    embedding[model.known] = table[:n]
    rest, at = table[n:].ravel(), 0
    parts = []
    for like in (*model.filters, *model.filter_bias, model.out):
        parts.append(rest[at : at + like.size].reshape(like.shape).astype(np.float32))
        at += like.size
    w = len(model.filters)
    return ToxicityModel(model.config, embedding, parts[:w], parts[w : 2 * w], parts[-1], float(rest[at]), model.known)


def count_words(rows: DataFrame, config: ToxicityConfig) -> np.ndarray:
    """``_texts_with`` of all ``rows`` (text, toxic): tasks count, their counts are added by row of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, config.buckets), dtype=np.int64)
        for words, ids, y in _pieces(batches, config):
            total += _texts_with(words, ids, y, config)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[0][at]), pa.array(total[1][at])], names=["at", "clean", "toxic"])
        wa.give_back()

    found = rows.select("text", "toxic").mapInArrow(run, "at long, clean long, toxic long").groupBy("at").agg(F.sum("clean"), F.sum("toxic")).toArrow()
    at, *counts = (c.to_numpy() for c in found.columns)
    with_it = np.zeros((2, config.buckets), dtype=np.int64)
    with_it[:, at] = counts
    return with_it


def train_round(rows: DataFrame, model: ToxicityModel, seed: int) -> ToxicityModel:
    """The mean, by texts, of what every task makes of ``model`` when it goes over its own ``rows`` once."""
    names = [f"v{i}" for i in range(model.config.size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, rng = _from_table(model, _table_of(model)), 0, np.random.default_rng(seed)
        adam = _optimizer(own)
        for words, ids, y in _pieces(batches, own.config):
            ids, order = np.where(own.known[ids], ids, 0), rng.permutation(len(y))
            for i in range(0, len(order), BATCH):
                at = order[i : i + BATCH]
                _train_batch(own, ids, *_rows_of(words, at), y[at], np.ones(len(at), np.float32), adam)
            n += len(y)
        if n:
            table = _table_of(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table))), pa.array(np.full(len(table), float(n))), *(pa.array(v * n) for v in table.T)], names=["at", "n", *names])
        wa.give_back()

    found = rows.select("text", "toxic").mapInArrow(run, "at long, n double, " + ", ".join(f"{v} double" for v in names))
    mean = found.groupBy("at").agg(*[(F.sum(v) / F.sum("n")).alias(v) for v in names]).toArrow()
    table = np.empty((mean.num_rows, len(names)))
    table[mean.column("at").to_numpy()] = np.stack([mean.column(v).to_numpy() for v in names], axis=1)
    return _from_table(model, table)


def loss_of(rows: DataFrame, model: ToxicityModel) -> float:
    """Logistic loss over all ``rows`` (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for words, ids, y in _pieces(batches, model.config):
            ids, every = np.where(model.known[ids], ids, 0), np.arange(len(y))
            for i in range(0, len(y), 256):
                total += float(_losses(model, ids, *_rows_of(words, every[i : i + 256]), y[i : i + 256]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["loss"])
        wa.give_back()

    return rows.select("text", "toxic").mapInArrow(run, "loss double").agg(F.sum("loss")).first()[0]


def train_by_rounds(rows: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """``train`` by tasks, over all of ``rows`` (text, toxic); of the rounds, the one with the least loss on the part for stopping is kept."""
    part = _part(F.col("text"))
    training, stopping, model = rows.where(part == TRAINING), rows.where(part == STOPPING), _initial(config)
    counts = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy(part.alias("part"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # six rows at most
    n = {p: [counts.get((p, c), 0) for c in (0, 1)] for p in (TRAINING, STOPPING)}
    clean, toxic = (n[TRAINING][c] + n[STOPPING][c] for c in (0, 1))
    if not clean or not toxic:
        return _one_class(model, clean, toxic)
    _start_from_counts(model, count_words(rows.where(part != CALIBRATION), config), clean, toxic)
    own = sum(n[TRAINING])
    if not own:
        return model
    tasks = max(1, own // config.rows_per_task)
    best = (np.inf, model)
    for k in range(max(config.rounds, -(-config.least_steps * BATCH * tasks // own))):
        model = train_round(training.coalesce(tasks), model, config.seed + k)
        loss = loss_of(stopping if sum(n[STOPPING]) else training, model)
        if loss < best[0]:
            best = (loss, model)
    return best[1]


def _part(text: Column) -> Column:
    """``parts_of`` for a column of at least 60 texts."""
    place = F.crc32(text.cast("binary")) % 12
    return F.when(place < 2, STOPPING).when(place == 2, CALIBRATION).otherwise(TRAINING)


def thresholds_of(scored: DataFrame, config: ToxicityConfig) -> dict:
    """``calibrate`` for a table (lang, toxic, score) of any size: equal scores of a language are counted together first."""
    scores = scored.where("lang IS NOT NULL").groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
    falling = W.partitionBy("lang").orderBy(F.desc("score"))
    upto, whole = falling.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("lang")
    f1 = 2 * F.sum("toxic").over(upto) / (F.sum("n").over(upto) + F.sum("toxic").over(whole))
    at = (F.col("score") + F.lead("score", 1, 0.0).over(falling)) / 2
    rows = scores.select("lang", "score", f1.alias("f1"), at.alias("at"), F.sum("n").over(whole).alias("texts"), F.sum("toxic").over(whole).alias("found"))
    enough = rows.where((F.col("texts") >= config.least_for_language) & (F.col("found") > 0) & (F.col("found") < F.col("texts")))
    return dict(enough.groupBy("lang").agg(F.max(F.struct("f1", "score", "at"))["at"].alias("at")).collect())


def fit(documents: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Learn from all labelled documents that are not held out; more than ``max_rows`` or ``max_bytes`` of them stay in tasks."""
    known = labelled_texts(documents, labels)
    n, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n > config.max_rows or size > config.max_bytes:
        model = train_by_rounds(known, config)
        model.thresholds = thresholds_of(score(known.where(_part(F.col("text")) == CALIBRATION), model).select("lang", "toxic", "score"), config)
        return model
    rows = sorted(known.collect(), key=lambda r: (r["_h"], r["text"]))
    texts, y = [r["text"] for r in rows], [r["toxic"] for r in rows]
    model = train(texts, y, [1.0] * len(rows), config)
    held = np.flatnonzero(parts_of(texts) == CALIBRATION).tolist()
    model.thresholds = calibrate(model, [texts[i] for i in held], [y[i] for i in held], [rows[i]["lang"] for i in held])
    return model


def score(documents: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``documents`` with score; all other columns are carried along unread."""
    fields = [f for f in documents.schema.fields if f.name != "score"]
    carried = documents.select(*[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in wa.slices(batch, [text]):
                got = score_words(model, wa.split_words(wa.texts_of(piece, text)))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(got, pa.float64())], names=[*piece.schema.names, "score"])
        wa.give_back()

    return carried.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def flag(scored: DataFrame, model: ToxicityModel, lang: str = "lang") -> DataFrame:
    """Adds flagged: whether the score reaches the threshold of the document's language."""
    limit = F.lit(model.config.threshold)
    for language, threshold in model.thresholds.items():
        limit = F.when(F.col(lang) == language, threshold).otherwise(limit)
    return scored.withColumn("flagged", F.col("score") >= limit)
