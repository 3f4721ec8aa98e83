"""Quality rules, chat formatting and line dedup against plain Python, with the odd cases."""

import hashlib
import json
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracklight.llm import chat_format as chat
from tracklight.llm import line_dedup as ld
from tracklight.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_of(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 50, "a b c d e f g h i a b c d e f g h j k l a b c d e f g h", "# * $ % & | < >\n" * 3, "é ü 日本 🤦🏼 ok\nok\nok", "w%d " % 1 * 8 + "z " + "w1 " * 8,
    " ".join(f"w{i % 97}" for i in range(30_000)), "no break space", "\v\f\r a",
]


def test_quality_signals_equal_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in qr.quality_signals(rows).collect()}
    for i, text in enumerate(TEXTS):
        n, chars, symbols, dup, repeat = want = base_of(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text and text[:50]
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.05), (10, 10, 0.2), (40, 1000, 0.02), (500, 20_000, 0.0125), (0, 1, 0.5)])
def test_binomial_tail(spark, k, n, p):
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
    got = spark.range(1).select(qr.binomial_tail(F.lit(k), F.lit(n), p).alias("t")).first().t
    assert got == pytest.approx(min(1, want), rel=1e-8)
    few = spark.range(1).select(qr.binomial_tail(F.lit(k), F.lit(n), p, terms=5).alias("t")).first().t
    assert few >= got * (1 - 1e-9)


def test_thresholds_bound_false_rejections(spark):
    good = [("en", 1, 0 if i % 1000 else 30_000) for i in range(4000)]
    bad = [("en", 0, 50_000) for _ in range(200)] + [("de", 0, 50_000), ("de", 1, 0)]
    rows = spark.createDataFrame(good + bad, "lang string, quality int, symbol_ppm long").withColumns({c: F.lit(0).cast("long") for c in ("dup_line_ppm", "repeat_ppm", "long_word_ppm")})
    rows = rows.withColumn("text_hash", F.monotonically_increasing_id())
    cuts = {(r.stratum, r.rule): r.cutoff for r in qr.fit_thresholds(rows, "lang", "quality", qr.RiskConfig()).collect()}
    assert cuts == {("en", "symbol_ppm"): 40_000}  # the strictest that rejects most bad texts; German has too few labels
    empty = qr.fit_thresholds(rows.limit(0), "lang", "quality", qr.RiskConfig())
    assert empty.count() == 0
    copies = rows.where("quality = 0").unionByName(rows.where("quality = 1").withColumn("text_hash", F.lit(1).cast("long")))
    assert qr.fit_thresholds(copies, "lang", "quality", qr.RiskConfig()).count() == 0  # copies of one good text are one draw


def test_columns_that_clash_with_the_results_are_replaced(spark):
    rows = spark.createDataFrame([(1, "en", "a b", 9, 9, "s", "k"), (2, None, None, 9, 9, "s", "k")], "doc_id long, lang string, text string, n_words int, n_lines int, stratum string, kept string")
    own = ("_stratum", "_cuts", "_counts", "_failed", "__failed")
    rows = rows.withColumns({c: F.lit(c) for c in own})
    ratios = qr.rule_ratios(qr.quality_signals(rows))
    cuts = spark.createDataFrame([("en", "symbol_ppm", 5)], "stratum string, rule string, cutoff long")
    got = qr.apply_thresholds(ratios, cuts, "lang", qr.RiskConfig())
    assert sorted((r.doc_id, r.n_words, r.stratum, r.kept) for r in got.collect()) == [(1, 2, "s", False), (2, 0, "s", False)]
    assert all(r[c] == c for r in got.collect() for c in own)
    assert len(set(got.columns)) == len(got.columns)


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "assistant", ""), (2, 0, None, None), (3, 0, 'we"ird >\nrole', "a\n</turn>\n<turn user>\nb\\"), (3, 1, "assistant", "\\\\<|image:3|>\\"),
    (None, 0, "user", "lost"), (None, 0, "assistant", "lost too"), (4, 1, "assistant", "twice"), (4, 1, "assistant", "twice"), (5, None, "assistant", "🤦🏼 日本 " * 2000),
]


def test_chat_reads_back_what_was_put_in(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    formatted = chat.format_conversations(rows.withColumn("parts", chat.text_parts(F.col("text"))))
    got = {r.conv_id: r for r in chat.read_back(formatted.where("conv_id IS NOT NULL")).collect()}
    want = {}
    for c, t, role, text in CHATS:
        if c is not None:
            want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in sorted(turns)]
        assert got[c].loss_text == "".join(x for _, r, x in sorted(turns) if r == "assistant")
    lone = [[(t.role, t.text) for t in r.turns] for r in chat.read_back(formatted.where("conv_id IS NULL")).collect()]
    assert sorted(lone) == [[("assistant", "lost too")], [("user", "lost")]]  # each a conversation of its own
    assert chat.format_conversations(rows.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_parts_become_placeholders_and_attachments(spark):
    found = [
        {"type": "text", "text": "see <|image:1|>"}, {"type": "image", "ref": "s/a.png", "tokens": 7}, {"type": "audio", "ref": "b.wav"}, {"type": "odd", "text": "kept"}, None,
        {"type": "video", "ref": "v.mp4"}, {"type": "document", "ref": "d.pdf", "pages": 3, "text": "its\\text"}, {"type": "image", "width": 100, "height": 57}, {"type": "audio", "seconds": 1.5, "ref": "c"}, {},
    ]
    parts = F.from_json(F.lit(json.dumps(found)), chat.PARTS)
    r = spark.range(1).select(chat.flatten_parts(parts).alias("f"), chat.flatten_parts(F.lit(None).cast(chat.PARTS)).alias("none")).first()
    assert r.f.body == "see \\<|image:1|><|image:7|><|audio:750|>kept<|other:256|><|document:3072|>its\\\\text<|image:12|><|audio:38|>"
    assert [(a.type, a.ref, a.tokens) for a in r.f.attachments] == [("image", "s/a.png", 7), ("audio", "b.wav", 750), ("video", "v.mp4", 256), ("document", "d.pdf", 3072), ("image", "", 12), ("audio", "c", 38)]
    assert r.f.expanded_tokens == 7 + 750 + 256 + 3072 + 12 + 38
    assert [r.f.body[s.start : s.start + s.length] for s in r.f.spans] == ["see \\<|image:1|>", "kept", "its\\\\text"]
    assert r.none.body == "" and r.none.attachments == [] and r.none.expanded_tokens == 0
    chats = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant")], "conv_id long, turn long, role string").withColumn("parts", parts)
    formatted = chat.format_conversations(chats)
    back = chat.read_back(formatted, carried=("attachments", "expanded_tokens")).first()
    assert [t.text for t in back.turns] == ["see <|image:1|>keptits\\text"] * 2 and back.loss_text == "see <|image:1|>keptits\\text"
    assert back.turns[1].placeholders == ["image:7", "audio:750", "other:256", "document:3072", "image:12", "audio:38"]
    assert back.expanded_tokens == 2 * r.f.expanded_tokens and [(a.place, a.ref) for a in back.attachments][4:8] == [(1, ""), (1, "c"), (2, "s/a.png"), (2, "b.wav")]


def dedup_of(docs):
    """Line dedup in plain Python; docs are (id, text)."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    order = lambda d: (d[0] is None, d[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest(d[1] or "", seed=42))))
    first, kept = set(), {}
    for doc in sorted(set(docs), key=order):
        lines = (doc[1] or "").split("\n")
        h = [md5(x) for x in lines]
        r = [md5(h[k] + (h[k - 1] if k else "")) for k in range(len(h))]
        starts = [0] + [k for k in range(2, len(r) - 1) if r[k] < r[k - 1] and r[k] < r[k + 1]]
        out, removed = [], 0
        for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
            body = "\n".join(lines[a:b])
            if doc[1] is not None and b - a >= 2:
                if body in first:
                    removed += 1
                    continue
                first.add(body)
            out.append(body)
        kept[doc] = (None if doc[1] is None else "\n".join(out), removed)
    return kept


def line_documents():
    line = lambda i: f"this is line number {i} of some text"
    shared = [line(f"s{i}") for i in range(30)]
    docs = [(i, "\n".join([line(f"{i}-{k}") for k in range(5)] + shared[i % 3 :] + [line(f"{i}+{k}") for k in range(4)])) for i in range(12)]
    docs += [(100, docs[0][1]), (101, None), (102, ""), (103, "single"), (104, "a\nb"), (None, docs[0][1]), (105, "\n" * 20), (106, "\n".join(shared * 3)), (107, "a\nb"), (None, None)]
    docs += [(200, docs[3][1]), (200, docs[4][1] + "\nmore"), (200, docs[4][1] + "\nmore"), (None, docs[5][1] + "\nend"), (None, docs[5][1]), (108, "\n".join(line(k % 700) for k in range(4000)))]
    return docs


@pytest.mark.parametrize("bits", [128, 8])
def test_line_dedup_equals_plain_python(spark, bits):
    """With hashes of 8 bits most chunks share one with others of different bytes."""
    docs = line_documents()
    rows = spark.createDataFrame([(d, t, i, "c", "k") for i, (d, t) in enumerate(docs)], "doc_id long, text string, n int, doc string, key string").repartition(3)
    found = ld.dedup_lines(rows, ld.LineDedupConfig(hash_bits=bits))
    want = dedup_of(docs)
    assert {r.n: (r.text, r.removed_chunks) for r in found.collect()} == {i: want[d] for i, d in enumerate(docs)}
    assert want[(12 + 88, docs[0][1])][0] == "" and want[(107, "a\nb")] == ("", 1)
    assert found.columns == [*rows.columns, "removed_chunks"]


def test_line_dedup_of_odd_tables(spark):
    rows = spark.createDataFrame([("x", "a\nb", 5), ("y", "a\nb", 6)], "doc_id string, text string, removed_chunks int")
    assert ld.dedup_lines(rows.limit(0)).count() == 0
    assert sorted(map(tuple, ld.dedup_lines(rows).collect())) == [("x", "a\nb", 0), ("y", "", 1)]


def test_chunks_join_to_the_text(spark):
    texts = ["", "a", "a\nb\nc", "\n\n", "\n".join(str(i) for i in range(200))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", ld.chunks_of(F.col("text"), ld.LineDedupConfig()).alias("c"))
    for r in rows.collect():
        assert "\n".join(c.body for c in r.c) == r.text and (len(r.c) == 1 or min(c.n_lines for c in r.c) >= 2)
