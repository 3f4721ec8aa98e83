"""Verdicts on urls: parts, rules, words of names, and naive Bayes in plain Python."""

import itertools
import math
import random

from tracklight.llm import url_filter as uf

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
WORDS = ["free", "bets", "casino", "win", "garden", "tools", "news", "the", "best"]


def judged(spark, urls, texts=("the best free garden tools win news",), rules=RULES, config=None):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, word string")
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = uf.judge(pages, docs, spark.createDataFrame(rules, "verdict string, host string, path string"), config or uf.UrlConfig())
    return {r.page_id: r for r in found.collect()}


def test_parts_and_rules(spark):
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "HTTPS://A.Example.NET/de/?q#f": ("a.example.net", "/de/", "net/", "block"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://a.net": ("a.net", "", None, "allow"),
        "http://xnet/": ("xnet", "/", None, "allow"),
        "http://example.com/de/x://y": ("example.com", "/de/x://y", "example.com/de/", "block"),
        "http://b.example.com/dex": ("b.example.com", "/dex", None, "allow"),
        "ftp://\u00c4.org/fr/\n?x": ("\u00c4.org", "/fr/\n", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://?x": ("", "", None, "allow"),
        "http://" + "q" * 20_000 + ".net/" + "r" * 20_000: ("q" * 20_000 + ".net", "/" + "r" * 20_000, "net/", "block"),
    }
    got = judged(spark, [*cases, "http://a.example.net/en/1"])
    for i, want in enumerate([*cases.values(), cases["http://a.example.net/en/1"]]):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want and got[i].word == "x"


def test_names_run_together_are_split_and_judged(spark):
    good = [f"http://{a}{b}.com/news" for a, b in itertools.permutations(("garden", "tools", "the", "best"), 2)]
    bad = ["http://free-bets.com/win", "http://casino-win.com/win", "http://bets-free.com/casino"]
    got = judged(spark, [*good, *bad, "http://freebets.com/x", "http://wincasinofree.com/win", "http://gardenbest.com/news"], rules=RULES[:1])
    words = [got[i].host_words for i in range(len(good) + len(bad), len(got))]
    assert words == ["free bets com", "win casino free com", "garden best com"]
    assert [got[i].verdict for i in range(len(got))] == ["allow"] * len(good) + ["block"] * 5 + ["allow"]


def test_segmentation_against_all_splits():
    rng, letter, unknown = random.Random(3), round(-uf.UNIT * math.log(26)), round(uf.UNIT * math.log(1e-4))
    for _ in range(200):
        piece = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        known = {w: -rng.randint(1, 9_000_000) for w in {piece[i:j] for i, j in itertools.combinations(range(len(piece) + 1), 2)} if rng.random() < 0.4}
        edges = [(i, j - i, known[piece[i:j]]) for i, j in itertools.combinations(range(len(piece) + 1), 2) if piece[i:j] in known]
        cost = lambda w: max(known.get(w, -math.inf), unknown + letter * len(w))  # noqa: E731, B023
        splits = []
        for cuts in itertools.product((0, 1), repeat=len(piece) - 1):
            at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(piece)]
            splits.append(sum(cost(piece[a:b]) for a, b in itertools.pairwise(at)))
        assert sum(map(cost, uf.viterbi(piece, edges, unknown, letter))) == max(splits)


def test_scores_are_those_of_naive_bayes(spark):
    urls = ["http://free-bets.com/win/1", "http://casino-win.org/win", "http://garden.com/news/9", "http://news.org/news/the", "http://tools.com/", "http://tools.com/win"]
    got = judged(spark, urls, rules=RULES[:1])
    bad = {"free-bets.com": True, "casino-win.org": True, "garden.com": False, "news.org": False, "tools.com": False}
    own = {r.host: r.host_words.split() for r in got.values()}
    walked = {}
    for r in got.values():
        walked.setdefault(r.host, set()).update(w for w in r.path.replace("/", " ").split() if not w.isdigit())
    kinds = ([(w, bad[h]) for h, ws in own.items() for w in ws], [(w, bad[h]) for h, ws in walked.items() for w in ws])

    def odds(rows, word):
        v = len({w for w, _ in rows})
        share = lambda b: (sum(1 for w, x in rows if w == word and x == b) + 1) / (sum(1 for _, x in rows if x == b) + v)
        return math.log(share(True) / share(False))

    for r in got.values():
        total = math.log(3 / 4) + sum(odds(kinds[0], w) for w in own[r.host]) + sum(odds(kinds[1], w) for w in set(r.path.replace("/", " ").split()) if not w.isdigit())
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-4


def test_empty_tables(spark):
    assert judged(spark, []) == {}
    only = judged(spark, ["http://a.com/"], texts=[None])[0]
    assert only.verdict == "allow" and only.host_words == "a com"
