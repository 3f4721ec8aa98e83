"""The stages of the corpus pipeline, one by one and together, on small tables with the odd cases."""

import random

import pytest

import corpus_pipeline as cp
from tracklight.functions import tables

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _id long, taken int"
SYLLABLES = {"xx": ["the", "ing", "and", "er", "st"], "yy": ["ung", "sch", "ein", "ich", "ver"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents():
    """Rows (doc_id, text, lang, source)."""
    rng = random.Random(3)
    rows = [(i, sentence(rng, lang, 60) + "\n" + sentence(rng, lang, 20), lang if i % 9 else None, f"s{i % 3}") for i in range(120) for lang in [("xx", "yy")[i % 2]]]
    passage = "\n".join(sentence(rng, "xx", 12) for _ in range(30))
    rows += [(200 + i, f"{sentence(rng, 'xx', 20)}\n{passage}\n{sentence(rng, 'xx', 20)}", "xx", "s0") for i in range(4)]  # one passage in four documents
    words = rows[0][1].split(" ")
    rows += [(300, rows[0][1], "xx", "s1"), (301, " ".join([*words[:40], "changed", *words[41:]]), "xx", "s1")]  # copies of document 0
    rows += [(400, None, "xx", "s0"), (401, "", "xx", None), (402, "123 456", None, "s0"), (None, sentence(rng, "xx", 50), "xx", None), (5, rows[5][1], "yy", "s2"), (500, sentence(rng, "yy", 20_000), "yy", "s2")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "c", 1, 2) for r in documents()], SCHEMA).repartition(4)


@pytest.mark.parametrize(("name", "stage"), cp.STAGES)
def test_stage_of_an_empty_table(spark, docs, name, stage):
    out = stage(spark, docs.limit(0), "")
    assert out.count() == 0 and (name == "encoding" or out.columns == list(cp.COLUMNS))


def test_language_stage_keeps_clean_documents(spark, docs):
    out = {r.doc_id: r for r in cp.identify_language(spark, docs, "").collect()}
    assert {400, 401, 402}.isdisjoint(out) and {*range(120), 500, None} <= out.keys()
    assert out[0].lang == "xx" and out[9].lang == "yy"  # known before only for others


def test_line_stage_takes_the_passage_out_of_all_but_the_first(spark, docs):
    out = cp.dedup_lines(spark, docs, "").collect()
    assert len(out) == len(documents()) - 1  # 300 has nothing that document 0 has not
    by_id = {r.doc_id: r for r in out}
    passage = documents()[120][1].split("\n")[10:20]
    assert all(line in by_id[200].text for line in passage)
    assert all(line not in by_id[i].text for i in (201, 202, 203) for line in passage)
    assert 300 not in by_id and sum(r.doc_id == 5 for r in out) == 2 and by_id[400].text is None


def test_near_stage_keeps_one_of_each_class(spark, docs):
    out = [r.doc_id for r in cp.dedup_near(spark, docs, "").collect()]
    assert {300, 301}.isdisjoint(out) and {0, 400, 401, 402, 500, None} <= set(out) and out.count(5) == 2


def test_mixing_stage_repeats_whole_documents(spark, docs):
    out = [(r.doc_id, r.text) for r in cp.mix_sources(spark, docs, "").collect()]
    assert set(out) <= {r[:2] for r in documents()} and max(map(out.count, set(out))) <= 6  # document 5 stands twice
    again = [(r.doc_id, r.text) for r in cp.mix_sources(spark, docs, "").collect()]
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_encoding_stage_decodes_to_the_text(spark, docs):
    pytest.importorskip("public_tokenizers")
    out = cp.encode(spark, docs, "")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"]
    assert sorted((str(r.doc_id), r.decoded) for r in out.collect()) == sorted((str(r[0]), r[1] or "") for r in documents())


def test_the_stages_together(spark, docs, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs.select(*cp.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    out = cp.run(spark, str(tmp_path))
    rows = out.collect()
    kept = {r.doc_id for r in rows}
    assert {300, 301, 400, 401, 402}.isdisjoint(kept) and kept <= {r[0] for r in documents()}
    texts = {}
    for doc_id, text, *_ in documents():
        texts.setdefault(doc_id, set()).add(text)
    assert all(any(set(r.decoded.split("\n")) <= set(t.split("\n")) for t in texts[r.doc_id]) for r in rows)
    assert all(r.n_tokens == len(r.ids) and r.ids[-1] == 2 for r in rows)


def test_scratch_tables_go_and_the_rest_stays(spark):
    df = spark.range(3).toDF("a")
    outer = tables.materialize(df, "test")
    with tables.scratch(spark):
        inner = tables.materialize(df, "test")
        assert inner.count() == 3
    assert outer.count() == 3
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist|PATH_NOT_FOUND"):
        inner.collect()
