"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; for each bit a linear classifier over hashed letter n-grams (of 1 to 3
letters, word boundaries included) predicts the language's bit. Loss-weighted decoding gives a text the language
whose codeword has the least total logistic loss over the bits; the softmax of the negated losses is its score,
and a text whose nearest codeword gets less than ``ambiguous_below`` of that softmax, as others are nearly as
near, is flagged ambiguous.

Fitting uses at most ``rows_per_language`` texts of a language and ``max_rows`` in all, shared alike by the languages, but
one of each language at least. Texts are counted into ``buckets`` numbers where they are, and the driver gets those
only, however long the texts are. Of up to 50 languages 300 codes are tried, of more 20. Prediction covers whole texts of
every document.

Defined results: a null text, and one without a letter, is ``und`` with score 0 and ambiguous; with one known
language every text with letters gets it; with none, all are ``und``. Repeated rows get the same result each;
other columns, of whatever name, are carried along and never read, but for columns named lang_pred, score or
ambiguous, which the result's replace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklight.llm import samples
from tracklight.llm import word_arrays as wa

UND = "und"
WORDS_AT_ONCE = 6_000  # distinct words of a slice, whose n-grams are in memory together


@dataclass(frozen=True)
class LanguageIdConfig:
    buckets: int = 1 << 13
    orders: tuple = (1, 2, 3)
    rows_per_language: int = 800
    max_rows: int = 4000
    steps: int = 80
    l2: float = 1e-6
    #: n-grams that pull a text's margins half-way to 0: short texts are decided with less certainty
    doubt: float = 30.0
    largest_margin: float = 2.0
    ambiguous_below: float = 0.5


@dataclass
class LanguageModel:
    languages: list
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    config: LanguageIdConfig


def word_grams(vocab: list, config: LanguageIdConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all n-grams, number of the word each is of, whether a word has letters), for distinct words.

    Characters other than letters count as word boundaries; n-grams that hold no letter are left out.
    """
    points = np.frombuffer((" " + " ".join(w.lower().replace(" ", "_") for w in vocab) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    word = np.cumsum(points == 32) - 1  # the blank before a word is the word's
    kinds, at = np.unique(points, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()], dtype=bool)[at]
    points = np.where(letter, points, 32).astype(np.uint64)
    owners, buckets = [], []
    for n in config.orders:
        if len(points) < n:
            continue
        window = np.lib.stride_tricks.sliding_window_view
        hashed = np.full(len(points) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            hashed = wa.mix64(hashed * np.uint64(0x9E3779B97F4A7C15) + points[k : len(points) - n + 1 + k])
        full = window(letter, n).any(axis=1)
        if n > 2:
            full &= window(letter, n)[:, 1:-1].all(axis=1)  # no boundary inside
        owner = word[: len(points) - n + 1]
        owners.append(owner[full])
        buckets.append((hashed[full] % np.uint64(config.buckets)).astype(np.int64))
    has = np.bincount(word[letter], minlength=len(vocab) + 1) > 0
    return np.concatenate(buckets or [np.empty(0, np.int64)]), np.concatenate(owners or [np.empty(0, np.int64)]), has[: len(vocab)]


def codewords(n_languages: int, seed: int = 7) -> np.ndarray:
    """A code matrix with far-apart rows: the best of 300 random ones, by least and then mean row distance."""
    bits = max(15, int(np.ceil(10 * np.log2(max(2, n_languages)))))
    rng, best, best_key = np.random.default_rng(seed), None, (-1, -1.0)
    for _ in range(300 if n_languages <= 50 else 20):
        code = rng.choice([-1.0, 1.0], size=(n_languages, bits))
        distance = (bits - code @ code.T) / 2
        apart = distance[~np.eye(n_languages, dtype=bool)]
        key = (apart.min(), apart.mean()) if len(apart) else (0, 0.0)
        if key > best_key:
            best, best_key = code, key
    return best


def text_features(texts: list, config: LanguageIdConfig) -> np.ndarray:
    """Relative frequencies of the n-gram buckets, one row per text."""
    out = np.zeros((len(texts), config.buckets), dtype=np.float32)
    for i in range(0, len(texts), 200):
        words = wa.split_words(pa.array(texts[i : i + 200], pa.large_string()))
        grams, owner, _ = word_grams(words.vocab.to_pylist(), config)
        order = np.argsort(owner, kind="stable")
        grams, ends = grams[order], np.searchsorted(owner[order], np.arange(len(words.vocab) + 1))
        for k in range(len(words.starts) - 1):
            own, times = np.unique(words.codes[words.starts[k] : words.starts[k + 1]], return_counts=True)
            lengths = (ends[own + 1] - ends[own]).astype(np.int64)
            if lengths.sum():
                at = np.repeat(ends[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                row = np.bincount(grams[at], weights=np.repeat(times, lengths), minlength=config.buckets)
                out[i + k] = row / row.sum()
    return out


def train(texts: list, languages: list, config: LanguageIdConfig = LanguageIdConfig()) -> LanguageModel:
    return train_features(text_features(texts, config), languages, config)


def train_features(x: np.ndarray, languages: list, config: LanguageIdConfig = LanguageIdConfig()) -> LanguageModel:
    """Fit one logistic classifier per bit by Adam on all texts at once. ``x``, which is changed, has their features."""
    names = sorted(set(languages))
    code = codewords(len(names)) if names else np.zeros((0, 1))
    weights, bias = np.zeros((config.buckets, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    if len(names) > 1:
        spread = np.concatenate([x[:, i : i + 256].std(axis=0) for i in range(0, config.buckets, 256)]) + 1e-4  # in parts, as a whole copy is large
        x /= spread
        which = np.array([names.index(v) for v in languages])
        y = code[which].astype(np.float32)
        share = (1.0 / np.bincount(which, minlength=len(names))[which] / len(names)).astype(np.float32)[:, None]  # languages count alike
        m = [np.zeros_like(weights), np.zeros_like(bias)]
        v = [np.zeros_like(weights), np.zeros_like(bias)]
        for step in range(1, config.steps + 1):
            margin = y * (x @ weights + bias)
            pull = -y * share / (1 + np.exp(np.clip(margin, -50, 50)))
            for k, (p, g) in enumerate(((weights, x.T @ pull + config.l2 * weights), (bias, pull.sum(axis=0)))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p -= (0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        weights /= spread[:, None]
    return LanguageModel(names, code, weights, bias, config)


def decode(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest codeword, score of it) by the total logistic loss over the bits."""
    loss = np.stack([np.logaddexp(0, -margins * row).sum(axis=1) for row in model.code], axis=1)
    best = loss.argmin(axis=1)
    odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return best, 1 / odds.sum(axis=1)


def predict_batch(model: LanguageModel, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    words = wa.split_words(texts)
    n, bits = len(words.starts) - 1, model.code.shape[1]
    if not model.languages or not len(words.vocab):
        return [UND] * n, np.zeros(n), np.ones(n, dtype=bool)
    sums, has = np.empty((len(words.vocab), bits + 1), dtype=np.float32), np.empty(len(words.vocab), dtype=bool)
    for i in range(0, len(words.vocab), WORDS_AT_ONCE):
        part = words.vocab.slice(i, WORDS_AT_ONCE)
        grams, owner, has[i : i + WORDS_AT_ONCE] = word_grams(part.to_pylist(), model.config)
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(part) + 1))
        sums[i : i + WORDS_AT_ONCE, :bits] = wa.segment_sum(model.weights[grams[order]], starts)
        sums[i : i + WORDS_AT_ONCE, bits] = np.diff(starts)
    letters = wa.segment_sum(has[words.codes].astype(np.int64), words.starts) > 0
    totals = np.zeros((n, bits + 1), dtype=np.float64)
    for k in range(bits + 1):
        totals[:, k] = wa.segment_sum(sums[:, k].astype(np.float64)[words.codes], words.starts)
    seen = totals[:, bits:]
    margins = (totals[:, :bits] / np.maximum(seen, 1) + model.bias) * (seen / (seen + model.config.doubt))
    margins = np.clip(margins, -model.config.largest_margin, model.config.largest_margin)
    best, score = decode(model, margins)
    names = [model.languages[b] if ok else UND for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
    score = np.where(letters, score, 0.0)
    return names, score, score < model.config.ambiguous_below


def fit(documents: DataFrame, config: LanguageIdConfig = LanguageIdConfig()) -> LanguageModel:
    """Learn from the text and non-null lang of documents that are not held out."""
    known = documents.where(~samples.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    n = known.select("lang").distinct().count()
    sample = samples.sample_by_class(known, "lang", min(config.rows_per_language, max(1, config.max_rows // max(1, n))))
    rows = samples.sampled(documents.where(F.col("lang").isNotNull()), sample, "lang").select("lang", "_h", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (p.slice(i, 256) for p in wa.slices(batch, ["text"]) for i in range(0, p.num_rows, 256)):
                x = text_features(piece.column("text").to_pylist(), config)
                at = [np.flatnonzero(row).astype(np.int32) for row in x]
                packed = [pa.array([a.tobytes() for a in at], pa.binary()), pa.array([row[a].tobytes() for row, a in zip(x, at, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([piece.column("lang"), piece.column("_h"), *packed], names=["lang", "_h", "at", "share"])
        wa.give_back()

    found = sorted(rows.mapInArrow(features, "lang string, _h long, at binary, share binary").collect(), key=lambda r: (r["_h"], r["lang"], bytes(r["at"]), bytes(r["share"])))
    x = np.zeros((len(found), config.buckets), dtype=np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["share"], np.float32)
    return train_features(x, [r["lang"] for r in found], config)


def predict(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``documents`` with lang_pred, score and ambiguous; all other columns are carried along untouched."""
    schema = T.StructType([f for f in documents.schema.fields if f.name not in ("lang_pred", "score", "ambiguous")])
    carried = documents.select(*schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in wa.slices(batch, [text]):
                names, score, ambiguous = predict_batch(model, wa.texts_of(piece, text))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], names=[*piece.schema.names, "lang_pred", "score", "ambiguous"])
        wa.give_back()

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return carried.mapInArrow(run, T.StructType([*schema.fields, *added]))
