"""Periodic runs against a search for all periods."""

import random
import re

import numpy as np
import pytest

from tracklight.llm import word_runs as wr


def plain(words, least=6, exponent=4):
    """All runs (start, length, period), period by period."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def made_up(rng):
    kinds, n = rng.choice([1, 2, 3, 50]), rng.choice([0, 1, 5, 8, 30, 90])
    words = [rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        for i in range(a, n):
            words[i] = words[a + (i - a) % p]
    if n > 20 and rng.random() < 0.3:
        a, p = rng.randrange(n - 10), rng.randint(1, 3)
        words[a:a] = [words[a + x % p] for x in range(rng.randint(4, 20))]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_a_slice_are_those_of_every_text(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = [made_up(rng) for _ in range(rng.randint(0, 6))]
        words, starts = np.array([w for t in texts for w in t], dtype=np.int64), np.cumsum([0] + [len(t) for t in texts])
        config = wr.RunConfig(chunk=rng.choice([3, 10, 1 << 20]))
        got = list(zip(*(x.tolist() for x in wr.find(words, starts, config)), strict=True))
        assert got == sorted((int(starts[k]) + s, int(starts[k]) + s + n, q) for k, t in enumerate(texts) for s, n, q in plain(t))


def test_grammar_derives_the_text_and_gets_short():
    words = np.tile(np.arange(37), 64)
    g = wr.repair(words, np.array([0, len(words)]))

    def derive(symbol):
        at = symbol - g.terminals
        return [symbol] if at < 0 else derive(g.left[at]) + derive(g.right[at])

    assert [w for s in g.symbols for w in derive(s)] == words.tolist()
    assert len(g.symbols) <= 16 and len(g.left) < 120  # 2368 words
    assert all(words[f] == derive(s + g.terminals)[0] for s, f in enumerate(g.first))


def test_documents_of_all_kinds(spark):
    long = " ".join(f"w{i}" for i in range(30_000)) + " x y z" * 5_000
    texts = [None, "", " \n\t ", "a " * 6, "a " * 5, "b a a a a a a a c", "the cat " * 3 + "the", "the cat " * 4, "\u00a0a\u2003a " * 6, long, long]
    df = spark.createDataFrame([(i, t, "kept", 1) for i, t in enumerate(texts)], "doc_id long, text string, codes string, runs int").repartition(2)
    got = {r.doc_id: r for r in wr.collapse_runs(df).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = [(30_000, 15_000, 3)] if i >= 9 else plain(words)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert [tuple(r) for r in got[i].runs] == want and got[i].codes == "kept"
        assert got[i].text == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert wr.collapse_runs(df.where("false")).count() == 0


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError):
        wr.RunConfig(min_exponent=2)
