"""Order MinHash near-dedup, banded alignment and exact search against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklight.llm import alignment as al
from tracklight.llm import exact_search as xs
from tracklight.llm import near_dedup as nd
from tracklight.llm import word_arrays as wa


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(0, 14))
def test_distance_within_equals_plain_dynamic_programming(a, b, limit):
    want = plain_distance(a, b)
    assert al.distance_within(a, b, limit) == (want if want <= limit else None)


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    edit = lambda t, share: [rng.choice(words) if rng.random() < share else w for w in t]
    bases = [text(rng.randint(40, 160)) for _ in range(30)]
    passage = text(60)
    docs = [" ".join(b) for b in bases]
    docs += [" ".join(edit(rng.choice(bases), rng.choice([0.01, 0.03, 0.08, 0.5]))) for _ in range(80)]
    docs += [" ".join(text(40) + passage + text(40)) for _ in range(20)]
    docs += [docs[0]] * 15 + ["", "", "one two", "one two", "  ", None, None]
    return docs


def test_classes_equal_brute_force(spark):
    docs = corpus()
    rows = [(1000 - 3 * i, t, "x") for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(7)
    got = {r.doc_id: r.class_id for r in nd.near_classes(df).collect()}
    known = [(i, t, al.WORDS.findall(t)) for i, t, _ in rows if t is not None]
    parent = {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (i, t, a) in enumerate(known):
        for j, u, b in known[p + 1 :]:
            near = a and b and al.distance_within(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)) is not None
            if t == u or near:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i, _, _ in rows}
    kept = nd.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i, _, _ in rows}) and kept.columns == df.columns


def test_copies_that_are_alike_only_through_an_original_of_middle_id(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    original = fresh(150)
    docs = {500: original}
    for i in [*range(1, 151), *range(901, 1051)]:
        at = 15 + 17 * rng.randrange(8)
        docs[i] = original[:at] + fresh(30) + original[at:]
    frame = fresh(60)
    docs.update({2000 + i: fresh(25) + frame + fresh(25) for i in range(60)})  # one passage in common, not alike
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in nd.near_classes(rows, nd.NearDedupConfig(shard=16)).collect()}
    assert got == {i: i if i >= 2000 else 1 for i in docs}


def test_no_pair_of_a_bucket_is_lost_beside_its_leader(spark):
    """Two texts that are alike meet others' leader, which is like neither."""
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs = {i: fresh(100) for i in range(40)}
    docs.update({100 + i: [*docs[i][:90], *fresh(10)] for i in range(40)})
    texts = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string")
    made = nd.sketch(texts, nd.NearDedupConfig()).withColumnRenamed("doc_id", "node").withColumn("entries", F.array(F.col("node"), F.lit(7).cast("long"), F.lit(7).cast("long"))).cache()
    bucket = made.select(F.lit(1).cast("long").alias("bucket"), F.explode(F.array(F.lit(1).cast("short"), F.lit(2).cast("short"))).alias("band"), F.col("node").alias("member"), F.col("n_words").cast("int").alias("n_words"))
    bucket = bucket.withColumn("bucket", F.col("band").cast("long"))
    none = spark.createDataFrame([], "node long, label long")
    for shard in (1000, 16):
        got = sorted(map(tuple, nd.apart_pairs(bucket, none, made, nd.NearDedupConfig(shard=shard)).collect()))
        assert got == [(i, 100 + i) for i in range(40)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_no_similar_pair_is_excluded_by_the_bound(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([5, 60, 3000]))]
    base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 30, 400, 2000]))]
    texts = [[rng.choice(vocabulary) if rng.random() < share else w for w in base if rng.random() > cut] for share, cut in ((0, 0), (0.1, 0), (0.15, 0.05), (0, 0.18), (0.3, 0), (0.9, 0))]
    words = wa.split_words(pa.array([" ".join(t) for t in texts], pa.large_string()))
    bins = nd.word_bins(words, nd.word_hashes(words), 64)
    every, none = np.arange(6), np.zeros(6, dtype=bool)
    p, q = nd.near_enough(every, words.lengths, none, bins, every, every, 0.8)
    kept = set(zip(p.tolist(), q.tolist(), strict=True))
    for i in range(6):
        for j in range(i + 1, 6):
            if al.similar_words(texts[i], texts[j], 0.8):
                assert (i, j) in kept


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_classes(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "word " * 30_000)], "doc_id long, text string")
    got = sorted(str((r.doc_id, r.class_id)) for r in nd.near_classes(rows).collect())
    assert got == sorted(map(str, [(None, None), (None, None), (1, 1), (1, 1), (2, 2)]))


def test_rows_that_share_an_id_keep_all_links(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = fresh(80), fresh(80), fresh(80)
    near = lambda t: " ".join([*t[:75], *fresh(5)])
    rows = [("k1", " ".join(a)), ("k1", " ".join(b)), ("k2", near(a)), ("k3", near(b)), ("k4", " ".join(c)), ("k5", None), ("k1", None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id string, text string, node string, label string").repartition(3)
    got = sorted((r.doc_id, r.class_id) for r in nd.near_classes(df).collect())
    assert got == [("k1", "k1")] * 3 + [("k2", "k1"), ("k3", "k1"), ("k4", "k4"), ("k5", "k5")]
    assert sorted(r.doc_id for r in nd.keep_one(df).collect()) == ["k1", "k1", "k1", "k4", "k5"] and nd.keep_one(df).columns == df.columns


@pytest.mark.parametrize(("share", "least"), [(0.05, 1.0), (0.1, 0.99), (0.15, 0.95), (0.19, 0.9)])
def test_recall_of_pairs_that_pass_the_alignment(share, least):
    """Pairs of texts of 300 words, a share of them replaced here and there, that agree in an entry."""
    rng, found, n = random.Random(11), 0, 400
    config = nd.NearDedupConfig()
    texts = []
    for _ in range(n):
        base = [f"w{rng.randrange(30_000)}" for _ in range(300)]
        places = set(rng.sample(range(300), int(300 * share)))
        texts += [" ".join(base), " ".join(f"x{rng.randrange(30_000)}" if i in places else w for i, w in enumerate(base))]
    words = wa.split_words(pa.array(texts, pa.large_string()))
    entries = nd.sketches_of(words, nd.word_hashes(words), config)
    found = sum(bool((entries[i] == entries[i + 1]).any()) for i in range(0, len(texts), 2))
    assert found >= least * n, found / n


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(400)]
    vectors += [(400 + i, vectors[7][1]) for i in range(60)]  # ties
    vectors += [(900, None), (901, [float("nan")] + [0.0] * 11), (902, [float("inf")] * 12), (903, [None] + [1.0] * 11), (904, [1.0, 2.0]), (950, []), (1000, [0.5] * 12), (1000, [0.5] * 12)]
    df = spark.createDataFrame([(i, v, "c") for i, v in vectors], "vec_id long, embedding array<double>, score string").select("vec_id", "score", xs.quantise(F.col("embedding")).alias("v"))
    found = xs.search(df, df.where("vec_id % 50 = 0"), xs.SearchConfig(shard_rows=64, block_cells=48, probe=2))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    usable = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q, v in usable.items():
        if q % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in usable.items() if i != q))[:5]
            assert got[q] == [(i, -s) for s, i in scores]
    assert xs.search(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1, 10**8])
def test_huge_components_stay_exact(spark, scale):
    rows = spark.createDataFrame([(0, [5 * scale, scale]), (1, [4 * scale, -9 * scale]), (2, [scale, scale]), (9, [3 * scale, -2 * scale])], "vec_id long, v array<long>")
    got = xs.search(rows, rows.where("vec_id = 9"), xs.SearchConfig(k=2)).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(9, 1, 1, 30 * scale**2), (9, 2, 0, 13 * scale**2)]


@pytest.mark.parametrize("filled", [1.0, 0.15])
def test_max_score_skips_postings_and_keeps_the_results(filled):
    """Dense vectors and sparse ones, shard after shard, against all scores; ties and repeated ids included."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(3000, 40)) * 256 * (rng.random((3000, 40)) < filled)).astype(np.int64)
    x[100:140] = x[99]
    ids = np.arange(3000)
    ids[2000:2010] = 7  # one id with several vectors
    config, counts = xs.SearchConfig(shard_rows=500), {}
    for i in range(60):
        q = x[i].astype(np.float64) if i else np.zeros(40)
        best = xs.Best(5)
        for at in range(0, 3000, 500):
            shard = xs.Shard(ids[at : at + 500], np.ascontiguousarray(x[at : at + 500].T).astype(np.float64), config)
            xs.max_score(i, q, shard, best, counts)
        scores = {}
        for v, s in zip(ids.tolist(), (x @ q.astype(np.int64)).tolist(), strict=True):
            if v != i:
                scores[v] = max(s, scores.get(v, s))
        want = sorted(scores.items(), key=lambda r: (-r[1], r[0]))[:5]
        assert list(zip(best.ids.tolist(), best.scores.astype(np.int64).tolist(), strict=True)) == want
    assert counts["read"] < (0.85 if filled == 1 else 0.7) * counts["all"], counts


def test_texts_that_share_many_buckets_are_joined_once(spark):
    """60 texts that are like no other share 20 buckets: joins make a row per text or per group, not one for each text of each group."""
    rng, bands = random.Random(12), 20
    texts = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))) for i in range(60)], "doc_id long, text string")
    common = F.array(*[F.lit(1000 + b).cast("long") for b in range(bands)])
    made = nd.sketch(texts, nd.NearDedupConfig()).withColumnRenamed("doc_id", "node").withColumn("entries", common).cache()
    rows = made.select("node", "n_words", F.posexplode("entries").alias("band", "entry")).select(F.col("entry").alias("bucket"), F.col("band").cast("short").alias("band"), F.col("node").alias("member"), F.col("n_words").cast("int").alias("n_words"), F.lit(60).cast("long").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = nd.apart_pairs(rows, spark.createDataFrame([], "node long, label long"), made, nd.NearDedupConfig())
        assert found.collect() == []
        todo, made_by_joins = [found._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
            if "Join" in node.nodeName():
                made_by_joins.append(node.metrics().apply("numOutputRows").value())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert made_by_joins and max(made_by_joins) <= 60, made_by_joins


def _of_nodes(df, name):
    """The counts of rows made by the nodes of that name in the plan of ``df``, which has run without adaptive execution."""
    todo, made = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if name in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
    return made


@pytest.mark.parametrize("shard", [1024, 8])
def test_pairs_of_a_bucket_are_all_found_and_its_members_dealt_once(spark, shard):
    """Texts of 40 to 200 words that share buckets: a bucket of a shard's members deals each of them once, and no size of shard loses or repeats a pair."""
    rng, bands, config = random.Random(13), 10, nd.NearDedupConfig(shard=shard)
    words = []
    for i in range(90):
        fresh = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 200))]
        words.append(fresh if i % 3 == 0 or not i else [w if rng.random() > 0.05 else f"x{rng.randrange(10**6)}" for w in words[i - i % 3]][: rng.randrange(85, 101) * len(words[i - i % 3]) // 100])
    keys = [[1000 * b + (i % 3 if b % 2 else rng.randrange(3)) for b in range(bands)] for i in range(len(words))]
    made = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    made = nd.sketch(made, config).withColumnRenamed("doc_id", "node").drop("entries").join(spark.createDataFrame(list(enumerate(keys)), "node long, entries array<long>"), "node").cache()
    rows = made.select("node", "n_words", F.posexplode("entries").alias("band", "bucket")).select("bucket", F.col("band").cast("short").alias("band"), F.col("node").alias("member"), F.col("n_words").cast("int").alias("n_words"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = nd.apart_pairs(rows, spark.createDataFrame([(4, 3), (3, 3)], "node long, label long"), made, config)
        got = [tuple(r) for r in found.collect()]
        dealt = _of_nodes(found, "Generate")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    near = {(i, j) for j in range(90) for i in range(j) if i // 3 == j // 3 and set(keys[i]) & set(keys[j]) and nd.alignment.similar_words(words[i], words[j], config.similarity)} - {(3, 4)}
    assert len(got) == len(set(got)) and near <= set(got) and len(near) > 20 and (3, 4) not in got
    assert shard == 8 or max(dealt) == 90 * bands, dealt
