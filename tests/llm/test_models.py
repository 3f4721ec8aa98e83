"""Classifiers: held-out accuracy on made-up languages, and the odd cases."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklight.llm import language_id as li
from tracklight.llm import samples
from tracklight.llm import toxicity as tx
from tracklight.llm import word_arrays as wa

SYLLABLES = {"xx": ["the", "ing", "and", "er"], "yy": ["ung", "sch", "ein", "ich"], "zz": ["ción", "que", "los", "mente"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_split_words_equals_a_regular_expression():
    texts = ["", "a", " a\tb\n", "\v\f\r x  y", "é b c"]
    words = wa.split_words(pa.array(texts, pa.large_string()))
    vocab = words.vocab.to_pylist()
    assert [[vocab[c] for c in words.codes[a:b]] for a, b in zip(words.starts[:-1], words.starts[1:], strict=True)] == [[], ["a"], ["a", "b"], ["x", "y"], ["é b", "c"]]
    assert len(wa.split_words(pa.array([], pa.large_string())).starts) == 1


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n else None for n in (0, 5, 100, 1, 0)])], names=["t"])
    assert [p.num_rows for p in wa.slices(batch, ["t"], 10)] == [2, 1, 2]


def test_language_held_out_accuracy(spark):
    rng = random.Random(5)
    rows = [(i, (lang := rng.choice("xx yy zz".split())), sentence(rng, lang, 30)) for i in range(300)]
    rows += [(1000, "xx", None), (1001, None, "the ing"), (1002, "yy", "123 !!"), (1003, None, ""), (1004, "zz", "que " * 60_000)]
    docs = spark.createDataFrame([(i, t, lang, "c") for i, lang, t in rows], "doc_id long, text string, lang string, score string")
    model = li.fit(docs, li.LanguageIdConfig(buckets=2048, steps=40))
    got = {r.doc_id: r for r in li.predict(docs, model).collect()}
    assert sum(got[i].lang_pred == lang for i, lang, _ in rows[:300]) >= 297
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "xx", "und", "und", "zz"]
    assert got[1000].score == 0 and got[1000].ambiguous and all(0 <= r.score <= 1 for r in got.values())


def test_every_language_is_in_a_sample_that_the_bound_cuts(spark):
    rows = [(100 * k + i, f"word{k} of {i}", f"l{k:02}") for k in range(12) for i in range(40)] + [(7, "again", "l00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    config = li.LanguageIdConfig(buckets=64, steps=1, rows_per_language=20, max_rows=60)
    assert li.fit(docs, config).languages == [f"l{k:02}" for k in range(12)]


def test_any_number_of_languages(spark):
    rows = [(2 * k + i, f"word{k}", f"l{k:03}") for k in range(201) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {r.lang for r in docs.where(~samples.held_out(F.col("doc_id"))).collect()}
    for most in (4000, 50):  # fewer rows than languages: one of each
        assert li.fit(docs, li.LanguageIdConfig(buckets=64, steps=1, max_rows=most)).languages == sorted(known)
    assert len(known) > 180


def test_features_made_by_tasks_give_the_model_of_the_texts(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, lang, 20), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = [r for r in docs.where(~samples.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).collect()]
    config = li.LanguageIdConfig(buckets=512, steps=10)
    want, got = li.train([r.text for r in kept], [r.lang for r in kept], config), li.fit(docs, config)
    assert got.languages == want.languages and np.allclose(got.weights, want.weights, atol=1e-4) and np.allclose(got.bias, want.bias, atol=1e-4)


def test_language_without_or_with_one_language(spark):
    docs = spark.createDataFrame([(1, "ab", "xx"), (3, "cd", "xx")], "doc_id long, text string, lang string")
    none = li.fit(docs.limit(0), li.LanguageIdConfig(buckets=64))
    assert [r.lang_pred for r in li.predict(docs, none).collect()] == ["und", "und"]
    one = li.train(["ab"], ["xx"], li.LanguageIdConfig(buckets=64))
    assert [r.lang_pred for r in li.predict(docs, one).collect()] == ["xx", "xx"]


def test_codewords_are_far_apart():
    for n in (2, 4, 12):
        code = li.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= 4


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        bad = i % 4 == 0
        words = sentence(rng, "xx", 40).split() + ([rng.choice(["idiotic", "scumbag"]) for _ in range(3)] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "xx", int(bad)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows] + [(5, 1, None), (99_999, 0, 1)], "doc_id long, quality int, toxic int")
    model = tx.fit(docs, labels, tx.ToxicityConfig(buckets=1 << 12))
    scored = tx.flag(tx.score(docs.unionByName(docs.sparkSession.createDataFrame([(-1, None, None), (-2, "", "xx")], docs.schema)), model), model)
    got = {r.doc_id: r for r in scored.collect()}
    from zlib import crc32

    held = [r for r in rows if crc32(str(r[0]).encode()) % 4 == 2]
    right = sum((got[r[0]].score >= 0.3) == bool(r[3]) for r in held)
    assert len(held) > 150 and right >= 0.97 * len(held)
    assert got[-1].score == got[-2].score and 0 <= got[-1].score <= 1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tx.fit(docs, labels, tx.ToxicityConfig(buckets=64))
    assert tx.score(docs, model).where(F.col("score").between(0, 1)).count() == 1


def plain_grams(text, config):
    """The buckets of a text's n-grams, word by word, in plain Python."""
    mix = lambda x: int(wa.mix64(np.array([x], dtype=np.uint64))[0])
    out = []
    for word in text.split():
        points = [" ", *word.lower(), " "]
        letter = [c.isalpha() for c in points]
        points = [ord(c) if a else 32 for c, a in zip(points, letter, strict=True)]
        for n in config.orders:
            for i in range(len(points) - n + 1):
                own = letter[i : i + n]
                if not any(own) or (n > 2 and not all(own[1:-1])):
                    continue
                h = n
                for c in points[i : i + n]:
                    h = mix((h * 0x9E3779B97F4A7C15 + c) % 2**64)
                out.append(h % config.buckets)
    return out


def test_language_decoding_equals_brute_force():
    """Margins, loss-weighted decoding and the flag of ambiguity, one text at a time. The blank between words counts once."""
    rng = random.Random(8)
    config = li.LanguageIdConfig(buckets=512, orders=(1, 2, 3), steps=30)
    texts = [sentence(rng, lang, 25) for lang in SYLLABLES for _ in range(20)]
    model = li.train(texts, [lang for lang in SYLLABLES for _ in range(20)], config)
    asked = [*texts[::7], "the", "ung que", "a1b 2 c-d É", "", "12 34", "the " * 3000, "ing\tver\nmente"]
    names, score, ambiguous = li.predict_batch(model, pa.array(asked, pa.large_string()))
    for k, text in enumerate(asked):
        grams = plain_grams(text, config)
        if not any(c.isalpha() for c in text):
            assert (names[k], score[k], bool(ambiguous[k])) == ("und", 0, True)
            continue
        margins = sum((model.weights[g].astype(float) for g in grams), np.zeros(model.code.shape[1])) / len(grams) + model.bias
        margins = np.clip(margins * len(grams) / (len(grams) + config.doubt), -config.largest_margin, config.largest_margin)
        loss = {lang: sum(np.log1p(np.exp(-m * b)) for m, b in zip(margins, row, strict=True)) for lang, row in zip(model.languages, model.code, strict=True)}
        best = min(loss, key=loss.get)
        want = 1 / sum(np.exp(loss[best] - x) for x in loss.values())
        assert names[k] == best and score[k] == pytest.approx(want, rel=1e-3) and bool(ambiguous[k]) == (score[k] < 0.5)


def plain_score(model, text):
    """The network's output for one text, word by word."""
    config = model.config
    words = text.split()
    ids = tx.word_ids(words, config)
    vectors = [sum((model.embedding[i].astype(float) for i in row if model.known[i]), np.zeros(config.size)) + model.embedding[0] * sum(not model.known[i] for i in row) for row in ids]
    pooled = []
    for width, filters, bias in zip(config.widths, model.filters, model.filter_bias, strict=True):
        for f in range(config.filters):
            at = [sum(vectors[i + k] @ filters[k][:, f] for k in range(width) if i + k < len(words)) + bias[f] for i in range(len(words))]
            pooled.append(max([0.0, *at]))
    return 1 / (1 + np.exp(-np.clip(np.dot(pooled, model.out) + model.bias, -40, 40)))


def test_prediction_hashes_the_words_of_a_slice_in_parts(monkeypatch):
    """The n-grams of all distinct words of a slice are never in memory together, and parts change nothing."""
    rng = np.random.default_rng(3)
    words = ["".join(w) for w in rng.choice(list("abcdefghij"), size=(60_000, 9)).tolist()]
    texts = pa.array([" ".join(words[i : i + 600]) for i in range(0, len(words), 600)], pa.large_string())
    model = li.train(["abc def ghi", "jih gfe dcb"], ["x", "y"])
    tracemalloc.start()
    parts = li.predict_batch(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    monkeypatch.setattr(li, "WORDS_AT_ONCE", len(words))
    whole = li.predict_batch(model, texts)
    assert parts[0] == whole[0] and (parts[1] == whole[1]).all() and (parts[2] == whole[2]).all()


def test_toxicity_scores_equal_a_plain_forward_pass():
    rng = random.Random(9)
    texts = [sentence(rng, "xx", rng.randint(5, 40)) + (" Idiotic! scumbag" if i % 3 == 0 else "") for i in range(90)]
    model = tx.train(texts, [int(i % 3 == 0) for i in range(90)], [1.0] * 90, tx.ToxicityConfig(buckets=1 << 10, least_steps=50, epochs=2))
    asked = [*texts[:12], "", " \n", "idiotic", "scumbags, IDIOTIC", "the " * 2000 + "scumbag"]
    got = tx.score_words(model, wa.split_words(pa.array(asked, pa.large_string())))
    for text, score in zip(asked, got.tolist(), strict=True):
        assert score == pytest.approx(plain_score(model, text), rel=1e-3, abs=1e-5)
    assert got[-1] > 0.5 and got[12] == got[13] < 0.5  # a word is heard in a very long text; no words, no toxicity


def test_toxicity_learns_from_few_labelled_texts():
    rng = random.Random(10)
    bad = ["idiotic", "scumbag", "moron", "vermin", "wretch"]
    make = lambda toxic: " ".join(sentence(rng, "xx", 80).split() + [rng.choice(bad) for _ in range(2 * toxic)])
    labels = [int(i % 9 == 0) for i in range(270)]
    model = tx.train([make(t) for t in labels], labels, [1.0] * 270, tx.ToxicityConfig(buckets=1 << 14))
    asked = [make(1) for _ in range(40)] + [make(0) for _ in range(200)]
    found = tx.score_words(model, wa.split_words(pa.array(asked, pa.large_string()))) >= 0.3
    assert found[:40].sum() >= 36 and found[40:].sum() <= 4


def test_columns_named_like_a_result_are_replaced(spark):
    docs = spark.createDataFrame([(1, "the ing", "xx", "s", True, "l")], "doc_id long, text string, lang string, score string, ambiguous boolean, lang_pred string")
    model = li.train(["the ing", "ung sch"], ["xx", "yy"], li.LanguageIdConfig(buckets=64, steps=5))
    assert li.predict(docs, model).columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"]
    scored = tx.score(docs, tx.train(["a"], [0], [1.0], tx.ToxicityConfig(buckets=64)))
    assert scored.columns == ["doc_id", "text", "lang", "ambiguous", "lang_pred", "score"] and scored.first().score < 0.01


def test_samples_are_the_least_hashes_and_their_bytes_are_bounded(spark):
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else "cold") for i in range(2000)] + [(7, "hot"), (5000, "rare"), (None, "cold")]
    known = spark.createDataFrame(rows, "doc_id long, label string")
    hashed = {r.doc_id: r.h for r in known.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect()}
    for per_class in (1, 40, 10_000):
        got = samples.sample_by_class(known, "label", per_class).collect()
        for label in ("hot", "cold", "rare"):
            own = sorted((hashed[i], i is not None, i or 0) for i, c in rows if c == label)
            assert sorted((hashed[r.doc_id], r.doc_id is not None, r.doc_id or 0) for r in got if r.label == label) == own[:per_class]
            assert {r.class_rows for r in got if r.label == label} == {len(own)}
        assert {r.label for r in got} == {"hot", "cold", "rare"}
    texts = known.where("doc_id IS NOT NULL").select("doc_id", F.when(F.col("doc_id") == 8, F.repeat(F.lit("x"), 5000)).otherwise(F.repeat(F.lit("y"), 100)).alias("text"))
    taken = samples.sample_texts(texts, samples.sample_by_class(known.where("doc_id IS NOT NULL"), "label", 10_000), "label", 10_000, 60_000)
    sizes = {c: [len(r["text"]) for r in taken if r["label"] == c] for c in ("hot", "cold", "rare")}
    assert sizes == {"hot": [100] * 200, "cold": [100] * 200, "rare": [100]}  # a third of the bytes each; the long text is left out
    assert samples.sample_texts(texts.limit(0), samples.sample_by_class(known, "label", 5), "label", 10, 1000) == []


def test_calibration_sees_no_text_of_training():
    texts = [f"text {i % 200}" for i in range(600)]
    parts = tx.parts_of(texts)
    assert {tx.TRAINING, tx.STOPPING, tx.CALIBRATION} == set(parts.tolist())
    assert all((parts[i::200] == parts[i]).all() for i in range(200))  # copies are in one part
    assert set(tx.parts_of(texts[:59]).tolist()) == {tx.TRAINING}


def test_toxicity_learns_from_all_labelled_texts(spark):
    """A bad word that only the texts of the largest hashes hold, which a sample of 3,000 per class would leave out."""
    rng = random.Random(12)
    ids = spark.range(13_200).withColumnRenamed("id", "doc_id").withColumn("h", F.xxhash64("doc_id")).collect()
    bad = lambda i, h: "" if i % 2 else "vermin" if h > 0.4 * 2**63 else "scumbag"
    rows = [(r.doc_id, f"{sentence(rng, 'xx', 5)} {bad(r.doc_id, r.h)} {sentence(rng, 'xx', 3)}", "xx") for r in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i, *_ in rows], "doc_id long, quality int, toxic int")
    model = tx.fit(docs, labels, tx.ToxicityConfig(buckets=1 << 12))
    asked = ["the vermin ing", "erer scumbag and", "the ing and er"]
    assert (tx.score_words(model, wa.split_words(pa.array(asked, pa.large_string()))) >= 0.3).tolist() == [True, True, False]
    found = tx.flag(tx.score(docs, model), model).where(samples.held_out(F.col("doc_id"))).agg(F.avg(((F.col("score") >= 0.3) == (F.col("doc_id") % 2 == 0)).cast("int")), F.avg((F.col("flagged") == (F.col("doc_id") % 2 == 0)).cast("int"))).first()
    assert min(found) >= 0.98 and set(model.thresholds) == {"xx"}


def test_tasks_count_and_calibrate_as_the_driver_does(spark):
    rng = random.Random(13)
    texts = [sentence(rng, "xx", rng.randint(0, 30)) + " idiotic" * (i % 5 == 0) for i in range(700)]
    y = [int(i % 5 == 0) for i in range(700)]
    config = tx.ToxicityConfig(buckets=1 << 10, least_steps=50, epochs=2)
    rows = spark.createDataFrame([(t, c, ["xx", "yy", None][i % 3]) for i, (t, c) in enumerate(zip(texts, y, strict=True))], "text string, toxic int, lang string").repartition(5)
    words = wa.split_words(pa.array(texts, pa.large_string()))
    want = tx._texts_with(words, tx.word_ids(words.vocab.to_pylist(), config), np.array(y), config)
    assert (tx.count_words(rows, config) == want).all()
    assert [r.part for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tx._part(F.col("t")).alias("part")).collect()] == tx.parts_of(texts).tolist()
    model = tx.train(texts, y, [1.0] * 700, config)
    scored = spark.createDataFrame([(["xx", "yy", "zz"][i % 3], c, float(s)) for i, (c, s) in enumerate(zip(y, np.random.default_rng(1).permutation(700).tolist(), strict=True))], "lang string, toxic int, score double")

    def plain(own):
        cuts = sorted({s for _, s in own} | {0.0}, reverse=True)
        f1 = [2 * sum(c for c, s in own if s >= at) / (sum(s >= at for _, s in own) + sum(c for c, _ in own)) for at in cuts[:-1]]
        best = f1.index(max(f1))
        return (cuts[best] + cuts[best + 1]) / 2

    all_scored = scored.collect()
    assert tx.thresholds_of(scored, config) == {lang: pytest.approx(plain([(r.toxic, r.score) for r in all_scored if r.lang == lang])) for lang in ("xx", "yy", "zz")}
    again = tx._from_table(model, tx._table_of(model))
    assert (tx.score_words(again, words) == tx.score_words(model, words)).all()


def test_words_are_hashed_together_as_one_by_one():
    from zlib import crc32

    words = ["", "--", "The", "(Idiotic!)", "abc", "abcd", "İstanbul!", "«Ünïcode»", "a" * 64, "b" * 65, "ß" * 40, "ÉÉÉÉ", "日本語の文", "x«"]
    config = tx.ToxicityConfig()
    for row, w in zip(tx.word_ids(pa.array(words), config).tolist(), words, strict=True):
        w, mask = w.lower().strip(tx.PUNCTUATION), config.buckets - 1
        assert row == [crc32(w.encode()) & mask, *(crc32(f"{n}{w[:n]}".encode()) & mask if len(w) >= n else 0 for n in config.prefixes)]
    assert tx.word_ids([], config).shape == (0, 4)
