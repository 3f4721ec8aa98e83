"""Verdicts on urls: rules for hosts and paths, and for the rest naive Bayes over the words that their names are made of.

Names of hosts run words together. A name's letters are split by the most likely sequence of words (Viterbi) under a
unigram model, which mixes the words of all documents with those of names that are spelled apart: by hyphens, or as last labels.
Letters in no word are one unknown word as long as they follow each other. The lexicon is a table: substrings of the
distinct names meet the counted words in a join, and what a name is made of comes back to it, so neither vocabulary
nor hosts are bounded by a task's memory.

Naive Bayes learns from hosts: one is a bad example if a part of its name, between other characters than letters, is
among ``terms``, and else a good one. Every host counts once for a word of its name, and once for a word that stands in
any of its paths, so a host with most of the pages weighs no more than others. A url's score is the posterior
probability of ``block``; logarithms are whole millionths, so that sums do not depend on their order.

Defined results: a host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path
follows up to ``?``, ``#`` or the end; a null url, and one without ``://``, has an empty host and path. A rule fits its host
and all hosts under it, if the path starts with the rule's; the longest rule wins, of equal ones that with the longer
host, then ``allow``. Without any bad or any good example only the rest of the formula decides, which is even odds on
empty tables, and even odds are ``allow``. Repeated rows get the same verdict each; other columns, of whatever name, are
carried along, but for those of the result's names, which are replaced; ``_url_`` starts this module's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import let, materialize

LETTERS = r"[^\p{L}]+"
UNIT = 1_000_000  # scores are whole millionths of natural logarithms


@dataclass(frozen=True)
class UrlConfig:
    terms: tuple = ("adult", "porn", "sex", "casino", "poker", "bet", "bets", "gambling", "pills", "viagra", "ads", "adserver", "banner", "popup", "spam", "malware", "phishing", "torrent", "warez")
    longest_word: int = 24  # letters
    text_share: float = 0.5  # of the unigram model; the rest is that of names spelled apart
    unknown: float = 1e-4  # probability of an unknown word, besides one in ``alphabet`` per letter
    alphabet: int = 26
    threshold: float = 0.5


def millionths(value: Column) -> Column:
    return F.round(UNIT * F.log(value)).cast("long")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path."""
    pattern, text, upper = r"(?s)^.*?://([^/?#]*)([^?#]*)", F.coalesce(F.col(url), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.withColumns({"host": F.translate(F.regexp_extract(text, pattern, 1), upper, upper.lower()), "path": F.regexp_extract(text, pattern, 2)})


def pieces_of(name: Column) -> Column:
    """The stretches of letters of a name, in lower case."""
    return F.filter(F.split(F.lower(name), LETTERS), lambda x: x != "")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, _url_rules): the rules (verdict, host, path) of each host and of those above it, longest first."""
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1  # a number
    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, deepest)
    above = let(labels, lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.reverse(F.slice(x, 1, i)), ".")))
    own = rules.select(F.col("host").alias("_url_above"), F.concat("host", "path").alias("rule"), "verdict", F.col("path").alias("start"), F.length("host").alias("n"))
    found = hosts.select("host", F.explode(F.array_distinct(above)).alias("_url_above")).join(own, "_url_above")
    ordered = F.struct((-F.length("rule")).alias("length"), (-F.col("n")).alias("n"), "verdict", "rule", "start")
    return found.groupBy("host").agg(F.array_sort(F.collect_set(ordered)).alias("_url_rules"))


def lexicon(texts: DataFrame, hosts: DataFrame, config: UrlConfig, text: str = "text") -> DataFrame:
    """(word, weight): the unigram model in millionths. Counts cover all words of all texts; hosts are distinct."""
    words = texts.select(F.explode(F.split(F.lower(F.col(text)), LETTERS)).alias("word")).where(F.length("word").between(1, config.longest_word))
    of_text = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "url-words")
    labels = hosts.select(F.posexplode(F.split("host", r"\.")).alias("at", "label"), F.size(F.split("host", r"\.")).alias("n"))
    apart = labels.select(pieces_of(F.col("label")).alias("p"), (F.col("at") + 1 == F.col("n")).alias("last")).where("size(p) > 1 OR last").select(F.explode("p").alias("word"))
    terms = hosts.sparkSession.createDataFrame([(t,) for t in config.terms], "word string")
    of_names = materialize(apart.unionByName(terms).where(F.length("word") <= config.longest_word).groupBy("word").agg(F.count(F.lit(1)).alias("m")), "url-names")
    text_total = of_text.agg(F.sum("n").alias("text_total"))  # a row each
    both = of_text.join(of_names, "word", "full_outer").join(F.broadcast(text_total)).join(F.broadcast(of_names.agg(F.sum("m").alias("name_total"))))
    share = config.text_share * F.coalesce(F.col("n") / F.col("text_total"), F.lit(0.0)) + (1 - config.text_share) * F.coalesce(F.col("m") / F.col("name_total"), F.lit(0.0))
    return both.select("word", millionths(share).alias("weight"))


def viterbi(piece: str, edges: list, unknown: int, letter: int) -> list[str]:
    """The best words of a piece. ``edges`` are (start, length, weight) of its known words; all weights are whole.

    Ties go to the longer last word; a stretch of unknown letters costs ``unknown`` once and ``letter`` for each.
    """
    ends: dict = {}
    for start, length, weight in edges:
        ends.setdefault(start + length, []).append((length, weight))
    best, back, open_, length_open = [0], [0], None, 0
    for i in range(1, len(piece) + 1):
        fresh = best[i - 1] + unknown
        if open_ is None or fresh > open_:
            open_, length_open = fresh, 0
        open_, length_open = open_ + letter, length_open + 1
        score, length = max([(open_, length_open), *[(best[i - n] + w, n) for n, w in ends.get(i, ())]])
        best.append(score)
        back.append(length)
    out, i = [], len(piece)
    while i:
        out.append(piece[i - back[i] : i])
        i -= back[i]
    return out[::-1]


def segment(pieces: DataFrame, words: DataFrame, config: UrlConfig) -> DataFrame:
    """(piece, words) for distinct pieces of names: the substrings that are words come from a join with the lexicon."""
    rows = materialize(pieces.select("piece").withColumn("id", F.monotonically_increasing_id()), "url-names")
    most = config.longest_word
    cuts = let(F.split("piece", ""), lambda c: F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.array_join(F.slice(c, i, most), "")))
    ahead = rows.select("id", F.posexplode(cuts).alias("start", "ahead"))  # what follows each letter, as far as a word may go
    spans = ahead.select("id", "start", F.explode(F.transform(F.sequence(F.lit(1), F.length("ahead")), lambda n: F.substring(F.col("ahead"), F.lit(1), n))).alias("word"))
    known = spans.join(words, "word").groupBy("id").agg(F.collect_list(F.struct("start", F.length("word").alias("length"), "weight")).alias("edges"))
    rows = rows.join(known, "id", "left").drop("id")
    unknown, letter = round(UNIT * math.log(config.unknown)), round(-UNIT * math.log(config.alphabet))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [[(e["start"], e["length"], e["weight"]) for e in row or ()] for row in batch.column("edges").to_pylist()]
            split = [viterbi(p, e, unknown, letter) for p, e in zip(batch.column("piece").to_pylist(), edges, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(split, pa.list_(pa.string()))], names=["piece", "words"])

    return rows.mapInArrow(run, "piece string, words array<string>")


def _spell(names: DataFrame, key: str, split: DataFrame) -> DataFrame:
    """(key, words): the words of all pieces of each distinct name, in order."""
    rows = names.select(key, F.posexplode(pieces_of(F.col(key))).alias("at", "piece")).join(split, "piece")
    ordered = F.array_sort(F.collect_list(F.struct("at", "words")))  # a name's pieces
    return names.join(rows.groupBy(key).agg(F.flatten(F.transform(ordered, lambda x: x["words"])).alias("words")), key, "left").select(key, F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def fit(hosts: DataFrame, visits: DataFrame, shapes: DataFrame, config: UrlConfig) -> tuple[DataFrame, DataFrame]:
    """((kind, word, odds), one row of the prior odds) of naive Bayes. ``hosts`` and ``shapes`` have words; ``visits`` are distinct (host, shape)."""
    bad = F.arrays_overlap(pieces_of(F.col("host")), F.array(*[F.lit(t) for t in config.terms]))
    labelled = hosts.select("host", "words", F.coalesce(bad, F.lit(False)).alias("bad"))
    of_hosts = labelled.select(F.lit("host").alias("kind"), F.explode("words").alias("word"), "bad")
    paths = visits.join(shapes, "shape").select("host", F.explode("words").alias("word")).distinct()
    of_paths = paths.join(labelled.select("host", "bad"), "host").select(F.lit("path").alias("kind"), "word", "bad")
    counts = materialize(of_hosts.unionByName(of_paths).groupBy("kind", "word").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")), "url-counts")
    totals = counts.groupBy("kind").agg(F.sum("b").alias("bs"), F.sum("g").alias("gs"), F.count(F.lit(1)).alias("v"))  # two rows
    ratio = ((F.col("b") + 1) / (F.col("bs") + F.col("v"))) / ((F.col("g") + 1) / (F.col("gs") + F.col("v")))
    prior = labelled.agg(millionths((F.count_if("bad") + 1) / (F.count_if(~F.col("bad")) + 1)).alias("prior"))
    return counts.join(F.broadcast(totals), "kind").select("kind", "word", millionths(ratio).alias("odds")), prior


def _odds(names: DataFrame, key: str, model: DataFrame, kind: str, name: str) -> DataFrame:
    """(key, words, ``name``): the sum of the odds of a name's words, each as often as it stands there."""
    rows = names.select(key, F.explode("words").alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("times"))
    sums = rows.join(model.where(F.col("kind") == kind), "word").groupBy(key).agg(F.sum(F.col("times") * F.col("odds")).alias(name))
    return names.join(sums, key, "left").select(key, "words", F.coalesce(name, F.lit(0)).alias(name))


def judge(pages: DataFrame, texts: DataFrame, rules: DataFrame, config: UrlConfig = UrlConfig(), url: str = "url", text: str = "text") -> DataFrame:
    """``pages`` with host, path, rule, score, verdict and host_words. ``rules`` has verdict, host, path; ``texts`` gives the words of the language."""
    parts = with_parts(pages.drop("host", "path", "rule", "score", "verdict", "host_words"), url).withColumn("_url_shape", F.array_join(F.array_distinct(pieces_of(F.col("path"))), " "))
    visits = materialize(parts.select("host", F.col("_url_shape").alias("shape")).distinct(), "url-visits")
    hosts, shapes = materialize(visits.select("host").distinct(), "url-hosts"), materialize(visits.select("shape").distinct(), "url-shapes")
    pieces = hosts.select(F.explode(pieces_of(F.col("host"))).alias("piece")).union(shapes.select(F.explode(pieces_of(F.col("shape"))))).distinct()
    split = materialize(segment(pieces, lexicon(texts, hosts, config, text), config), "url-pieces")
    spelled, walked = materialize(_spell(hosts, "host", split), "url-host-words"), materialize(_spell(shapes, "shape", split), "url-path-words")
    model, prior = fit(spelled, visits, walked, config)
    model = materialize(model, "url-model")
    of_hosts = _odds(spelled, "host", model, "host", "_url_host_odds").join(host_rules(hosts, rules), "host", "left").withColumnRenamed("words", "_url_words")
    of_paths = _odds(walked, "shape", model, "path", "_url_path_odds").select(F.col("shape").alias("_url_shape"), "_url_path_odds")
    rows = parts.join(materialize(of_hosts, "url-host-odds"), "host").join(materialize(of_paths, "url-path-odds"), "_url_shape").join(F.broadcast(prior))  # one row
    fitting = F.filter("_url_rules", lambda r: F.startswith(F.col("path"), r["start"]))
    rows = rows.withColumn("_url_rule", F.get(fitting, F.lit(0))).withColumn("score", 1 / (1 + F.exp(-(F.col("prior") + F.col("_url_host_odds") + F.col("_url_path_odds")) / UNIT)))
    guess = F.when(F.col("score") > config.threshold, "block").otherwise("allow")
    kept = [c for c in parts.columns if not c.startswith("_url_")]
    return rows.select(*kept, F.col("_url_rule.rule").alias("rule"), "score", F.coalesce("_url_rule.verdict", guess).alias("verdict"), F.array_join("_url_words", " ").alias("host_words"))
