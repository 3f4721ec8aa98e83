"""SentencePiece against the library, token rollups, mixing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracklight.llm import mixing as mx
from tracklight.llm import query_tables
from tracklight.llm import token_counts as tc
from tracklight.llm.common import new_path
from tracklight.llm.sentencepieces import encode, model

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(1)
    parts = [*"abetn ▁\n\t.=-h0", "th", "he", "in", " the", "é", "日", "ing", "\x00", "🤦🏼", "  ", " "]
    texts = ["", " ", "  a  b ", "a\nb\tc", "ﬁ ½ Ⅳ é", "a▁b", "</s> <s> <unk> <0x41>", " " * 50 + "x", "abab" * 9, "thethe" * 7, "=" * 40, "x" * 5000, "\n\n \n", "word " * 20_000]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(600)]


def test_ids_and_text_equal_the_library():
    sp, texts = sentencepiece.SentencePieceProcessor(model_file=PATH), odd_texts()
    for text, (ids, n, decoded) in zip(texts, model(PATH).encode_texts(texts), strict=True):
        want = sp.encode(text, add_eos=True)
        assert ids == " ".join(map(str, want)) and n == len(want) and decoded == sp.decode(want), text[:60]


def test_encode_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, "a b", "x"), (2, None, None), (2, "", "y")], "doc_id long, text string, ids string")
    got = encode(rows, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in got.collect()) == [(1, 3, "a b"), (2, 1, ""), (2, 1, "")]
    assert encode(rows.limit(0), PATH).count() == 0


def change(op, tokens, old=None, source="s", lang="en", version="v1", old_version=None):
    return (op, source, lang, version, tokens, old, old_version)


CHANGES = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long, old_tokenizer string"


def test_rollup_commits_each_batch_once(spark):
    rollup = tc.Rollup(spark, new_path(spark, "test-rollup"))
    assert rollup.read().count() == 0
    first = spark.createDataFrame([change("insert", 5), change("insert", 7), change("insert", None, source=None), change("insert", 3, lang="de")], CHANGES)
    second = spark.createDataFrame([change("delete", 5), change("revise", 9, 7, version="v2", old_version="v1"), change("delete", 3, lang="de")], CHANGES)
    assert rollup.commit(first, 0) and rollup.commit(second, 1) and not rollup.commit(first, 0) and not rollup.commit(second, 1)
    assert rollup.commit(first.limit(0), 2)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.read().collect()}
    assert got == {("s", "en", "v2"): (1, 9), (None, "en", "v1"): (1, 0)}
    with pytest.raises(Exception, match="unknown change"):
        rollup.commit(spark.createDataFrame([change("upsert", 1)], CHANGES), 3)
    assert not rollup.committed(3)


def test_snapshots_and_writers_that_meet(spark):
    rollup = tc.Rollup(spark, new_path(spark, "test-rollup"))
    batch = spark.createDataFrame([change("insert", 5)], CHANGES)
    show = lambda: [(r.n_docs, r.n_tokens) for r in rollup.read().collect()]
    for i in range(3):
        assert rollup.commit(batch, i)
    assert rollup.snapshot() and show() == [(3, 15)]
    rollup.clear()
    assert show() == [(3, 15)] and rollup.committed(1) and not rollup.commit(batch, 1)
    assert rollup.commit(batch, 3) and rollup.snapshot() and show() == [(4, 20)]
    assert not rollup._publish(tc.totals(tc.signed(batch)), "batch_id=3")  # a writer that saw no commit comes second
    assert not rollup._publish(rollup.read().withColumn("part", F.lit("totals")), "snapshot=1") and show() == [(4, 20)]
    assert rollup._numbers("_draft-") == []
    rollup.commit(spark.createDataFrame([change("delete", 50)], CHANGES), 9)
    assert show() == [(3, -30)]


def test_counts_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, "s", "en", "don't stop\tnow!"), (2, "s", "en", None), (3, None, None, " ")], "doc_id long, source string, lang string, text string")
    got = {(r.doc_id, r.tokenizer): r.tokens for r in tc.count_documents(rows).collect()}
    assert got == {(1, "words-1"): 3, (1, "pieces-1"): 6, (2, "words-1"): 0, (2, "pieces-1"): 0, (3, "words-1"): 0, (3, "pieces-1"): 0}


def targets_of(spark, sizes):
    """Targets of one-document sources s0, s1, ... of these sizes, and of a null source for the last."""
    rows = [(i, f"s{i}" if i < len(sizes) - 1 or len(sizes) == 1 else None, i, n, 1) for i, n in enumerate(sizes)]
    keys = spark.createDataFrame(rows, "doc_id long, source string, _mix_hash long, _mix_size long, m long").repartition(5)
    return [r.target for r in sorted(mx.source_targets(keys, mx.MixConfig()).collect(), key=lambda r: (r.source is None, r.source))]


def test_targets_share_the_excess(spark):
    assert targets_of(spark, [10, 1000]) == [30.0, 980.0]
    assert targets_of(spark, []) == [] and targets_of(spark, [0, 10]) == [0.0, 10.0]
    assert targets_of(spark, [100, 100, 100]) == pytest.approx([187.5, 75.0, 37.5])
    # 9 sources: the weights repeat; the first fills up, and its excess fills up the fourth
    got = targets_of(spark, [10, 900, 900, 100, 900, 900, 900, 900, 900])
    assert got[0] == 30 and got[3] == 300 and sum(got) == pytest.approx(6410) and got[1] == pytest.approx(2 * got[2]) and got[6] == pytest.approx(5 * got[2])


def documents(spark):
    rng = random.Random(2)
    rows = [(i, f"s{i % 3}" if i % 17 else None, "w " * rng.choice([0, 1, 5, 50, 400])) for i in range(3000)]
    rows += [(1, "s0", "w " * 50)] * 500 + [(None, "s1", "w " * 7)] * 300 + [(None, "s1", "w " * 9), (9000, "tiny", "w w"), (9001, "empty", None), (9002, "empty", "")]
    return spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], "doc_id long, source string, text string, taken string, mean int, tilt int, m int").repartition(5)


def test_mix_meets_its_targets(spark):
    docs = documents(spark)
    sized = mx.sized_documents(docs).cache()
    plan = mx.plan_copies(sized, mx.MixConfig(group_rows=500)).cache()
    assert plan.count() == docs.count() and plan.where("_mix_copies > 3 OR _mix_copies < 0").count() == 0
    for r in plan.groupBy("source", "_mix_target").agg(F.sum(F.col("_mix_size") * F.col("_mix_copies")).alias("taken")).collect():
        assert abs(r.taken - r._mix_target) <= 0.02 * r._mix_target + 2, r
    again = mx.plan_copies(sized.repartition(3), mx.MixConfig(group_rows=500))
    of_item = lambda p: sorted(map(str, p.select("doc_id", "source", "_mix_size", "_mix_copies").collect()))
    assert of_item(plan) == of_item(again)
    mixed = mx.mix(docs, mx.MixConfig(group_rows=500))
    assert mixed.columns == docs.columns
    assert mixed.count() == plan.agg(F.sum("_mix_copies")).first()[0]
    assert mx.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("alike", [150, 200, 300])
def test_rows_that_are_alike_get_exactly_their_copies(spark, alike):
    rows = [(7, "a", "w " * 9, 1)] * alike + [(None, "b", "w w", 2)] * alike + [(k, "abc"[k % 3], "w " * (k % 40 + 1), 3) for k in range(200)]
    docs, got = spark.createDataFrame(rows, "doc_id long, source string, text string, _id int"), []
    for parts in (1, 3):
        plan = mx.plan_copies(mx.sized_documents(docs.repartition(parts))).cache()
        got.append(sorted(map(str, plan.select("doc_id", "source", "_mix_size", "_mix_copies", "_id").collect())))
        for r in plan.groupBy("source", "_mix_target").agg(F.sum(F.col("_mix_size") * F.col("_mix_copies")).alias("taken"), F.max("_mix_size").alias("most")).collect():
            assert abs(r.taken - r._mix_target) <= 0.5 * r.most + 1, r
        of_item = plan.where("doc_id = 7 AND source = 'a'").select("_mix_copies").distinct().collect()
        assert len(of_item) <= 2
    assert got[0] == got[1]


def test_deletes_of_shared_ids_equal_the_sql(spark, tmp_path):
    """The registered query against its SQL where ids and texts are shared, null and repeated."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, "A b"), (2, "A b"), (2, "B"), (3, "B"), (3, "B"), (None, "A b"), (4, None), (4, "C d e"), (None, None)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, f"s{(i or 0) % 2}", "en", t) for i, t in rows], "doc_id long, source string, lang string, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    name = ("source", "lang", "tokenizer", "n_docs", "n_tokens")
    got = query_tables.op2_token_counts(spark, str(tmp_path)).select(*name).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT {', '.join(name)} FROM ({query_tables.OP2_SQL})").fetchall())


def test_rates_solve_the_dual(spark):
    """Each source's multiplier against one found by bisection, in plain Python."""
    rng = random.Random(7)
    sizes = {f"s{k}": [rng.randint(1, 300 * (k + 1)) for _ in range(400)] for k in range(4)}
    rows = [(100_000 * k + i, s, i, n, 1) for k, (s, own) in enumerate(sizes.items()) for i, n in enumerate(own)]
    keys = spark.createDataFrame(rows, "doc_id long, source string, _mix_hash long, _mix_size long, m long")
    config = mx.MixConfig()
    targets = mx.source_targets(keys, config).collect()
    got = {r.source: r for r in mx.solve(keys, spark.createDataFrame(targets), config).collect()}
    assert sum(got[r.source].tilt is not None for r in targets) >= 2
    for r in targets:
        if r.target == 3 * r.source_size:
            assert got[r.source].tilt is None
            continue
        own, mean = sizes[r.source], sum(sizes[r.source]) / 400
        words = lambda tilt: sum(n * min(3.0, math.exp(max(-60, min(60, tilt * n / mean)))) for n in own)  # noqa: B023, E731
        low, high = -60.0, 60.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if words(middle) < r.target else (low, middle)
        assert got[r.source].tilt == pytest.approx(high, rel=1e-5, abs=1e-7), r
        assert words(got[r.source].tilt) == pytest.approx(r.target, rel=1e-6)
