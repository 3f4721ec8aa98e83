"""Quality rules with risk-controlled thresholds.

``quality_signals`` computes counts of every text natively. ``fit_thresholds`` chooses, for each rule and
stratum, the strictest cutoff of a fixed grid that wrongly rejects few good texts: on a labelled holdout with n
good texts of which k fail a cutoff, the cutoff is allowed if P(Bin(n, alpha) <= k) <= delta / tests, the exact
one-sided binomial bound on the false rejection rate, corrected by Bonferroni for all tests made. alpha is shared
out among the rules, so that a text which passes all of them is wrongly rejected at a rate of alpha at most.
Among the allowed cutoffs the one that rejects most bad texts wins; a rule that has none does not apply.

Defined results: a null text has no words and fails the base rule; a document whose stratum is null is of the
stratum of nulls; a stratum without labels, or with too few, has no thresholds and keeps what passes the base
rule; labels of unknown documents and null labels count for nothing; repeated rows are judged one by one, and a
document with several labels is used with each; copies of a text count once per stratum and label, near copies
each for itself. Other columns are carried along, but for those named like a result, which are replaced. No Python
runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import NOT_WORD, broadcast_if_small, free_name, let, materialize

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
SIGNALS = ("text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


@dataclass(frozen=True)
class RiskConfig:
    alpha: float = 0.05  # largest false rejection rate of good texts in a stratum
    delta: float = 0.05  # probability that the bound fails anywhere
    #: rule -> cutoffs, in millionths; a text fails the rule when its ratio is above the cutoff
    grid: dict = field(
        default_factory=lambda: {
            "symbol_ppm": [2_000, 5_000, 10_000, 20_000, 40_000, 60_000, 80_000, 100_000, 150_000, 200_000, 300_000],
            "dup_line_ppm": [50_000, 100_000, 150_000, 200_000, 300_000, 400_000, 500_000, 700_000],
            "repeat_ppm": [5_000, 10_000, 20_000, 50_000, 100_000, 150_000, 200_000, 250_000],
            "long_word_ppm": [5_500_000, 6_000_000, 6_500_000, 7_000_000, 8_000_000, 10_000_000, 15_000_000],
        }
    )
    max_strata_broadcast: int = 10_000


def _repeat_words(words: Column) -> Column:
    """Number of words inside windows of WINDOW words that stand twice or more in the text.

    Hashes of the windows show whether any can repeat; only then are the windows whose hash repeats compared as
    strings. Positions of repeated windows are sorted, and each adds what the next does not cover.
    """
    hashed = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))

    def same_neighbour(key):
        def mark(s):
            return F.filter(s, lambda x, i: (F.get(s, i - 1)[key] == x[key]) | (F.get(s, i + 1)[key] == x[key]))

        return mark

    def exact(ws, hs):
        by_hash = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("k"), i.alias("at"))))
        near = let(by_hash, same_neighbour("k"))
        by_text = F.array_sort(F.transform(near, lambda x: F.struct(F.array_join(F.slice(ws, x["at"] + 1, WINDOW), " ").alias("k"), x["at"].alias("at"))))
        places = F.array_sort(F.transform(let(by_text, same_neighbour("k")), lambda x: x["at"]))
        covered = lambda ps: F.aggregate(F.transform(ps, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(ps, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
        return let(places, covered)

    def of(ws):
        def decide(hs):
            return F.when(F.size(F.array_distinct(hs)) < F.size(hs), exact(ws, hs)).otherwise(F.lit(0))

        return F.when(F.size(ws) > WINDOW, let(hashed(ws), decide)).otherwise(F.lit(0))

    return of(words)


def quality_signals(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` without its text, with the ``SIGNALS`` (long) and base_failed; columns of these names are replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    counts = let(
        F.filter(F.split(body, NOT_WORD), lambda w: w != ""),
        lambda ws: F.struct(F.size(ws).alias("n_words"), _repeat_words(ws).alias("n_repeat_words")),
    )
    held = free_name(documents, "_counts")
    out = documents.select(
        *[c for c in documents.columns if c not in (text, *SIGNALS, "base_failed")],
        counts.alias(held),
        F.xxhash64(body).alias("text_hash"),
        F.length(F.regexp_replace(body, NOT_WORD, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        let(lines, lambda ls: F.size(ls)).cast("long").alias("n_lines"),
    )
    n, r = F.col(held)["n_words"].cast("long"), F.col(held)["n_repeat_words"].cast("long")
    return out.select("*", n.alias("n_words"), r.alias("n_repeat_words"), ((n < 20) | (100 * r > 30 * n)).alias("base_failed")).drop(held)


def rule_ratios(signals: DataFrame) -> DataFrame:
    """Adds the rules' ratios in millionths, as longs so that every run agrees; columns of their names are replaced."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.expr(f"{a} * 1000000L div {b}")).otherwise(F.lit(0)).cast("long")
    ratios = ("symbol_ppm", "dup_line_ppm", "repeat_ppm", "long_word_ppm")
    return signals.select(
        *[c for c in signals.columns if c not in ratios],
        ratio("n_symbols", "word_chars").alias("symbol_ppm"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ppm"),
        ratio("n_repeat_words", "n_words").alias("repeat_ppm"),
        ratio("word_chars", "n_words").alias("long_word_ppm"),
    )


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - sum((F.log(x + i) for i in range(1, 8)), F.log(x))


def binomial_tail(k: Column, n: Column, p: float, terms: int = 2000) -> Column:
    """P(Bin(n, p) <= k), from its largest term downwards; beyond ``terms`` terms a geometric bound is added.

    Exact up to rounding while k <= terms, and never below the true value otherwise. Null when n is 0.
    """
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    step = lambda i: i / (n - i + 1) * ((1 - p) / p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(a, j):
        term = a["term"] * step(k - j + 1)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    last = F.least(k, F.lit(float(terms))).cast("int")
    summed = F.aggregate(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), start, add)
    rest = let(summed, lambda s: s["total"] + F.when(k > terms, F.when(step(k - terms) < 1, s["term"] / (1 - step(k - terms))).otherwise(F.lit(float("inf")))).otherwise(F.lit(0.0)))
    return F.when(n > 0, F.when(k >= n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * rest)))


def fit_thresholds(labelled: DataFrame, stratum: str, label: str, config: RiskConfig) -> DataFrame:
    """(stratum, rule, cutoff, n_good, k_good, bound): the chosen cutoffs.

    ``labelled`` has the ratios, text_hash and a label of 0 or 1. Copies of a text are one draw, as the bound counts
    independent ones: a text counts once per stratum and label.
    """
    ratios = list(config.grid)
    labelled = labelled.groupBy(F.col(stratum).alias("stratum"), F.col(label).alias("label"), "text_hash").agg(*[F.first(c).alias(c) for c in ratios])
    grid = [(rule, int(c)) for rule, cutoffs in config.grid.items() for c in cutoffs]
    failing = [F.count_if((F.col(rule) > c) & (F.col("label") == good)).alias(f"f{good}_{i}") for i, (rule, c) in enumerate(grid) for good in (0, 1)]
    counts = materialize(labelled.groupBy("stratum").agg(F.count_if(F.col("label") == 1).alias("n_good"), *failing), "quality-counts")
    tests, share = max(1, counts.count()) * len(grid), config.alpha / len(config.grid)
    cells = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).cast("long").alias("cutoff"), F.col(f"f1_{i}").alias("k_good"), F.col(f"f0_{i}").alias("k_bad")) for i, (rule, c) in enumerate(grid)]))
    cells = counts.select("stratum", "n_good", cells.alias("cell")).select("stratum", "n_good", "cell.*")
    allowed = cells.where(F.col("k_bad") > 0).withColumn("bound", binomial_tail(F.col("k_good"), F.col("n_good"), share)).where(F.col("bound") <= config.delta / tests)
    best = F.max_by(F.struct("cutoff", "k_good", "n_good", "bound"), F.struct("k_bad", "cutoff"))
    return allowed.groupBy("stratum", "rule").agg(best.alias("b")).select("stratum", "rule", "b.*")


def apply_thresholds(ratios: DataFrame, thresholds: DataFrame, stratum: str, config: RiskConfig) -> DataFrame:
    """Adds failed_rules (array) and kept, in place of columns of these names. ``thresholds`` should be materialized."""
    of, cuts, found = (free_name(ratios, n) for n in ("_stratum", "_cuts", "_failed"))
    wide = thresholds.groupBy(F.col("stratum").alias(of)).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias(cuts))
    joined = ratios.join(broadcast_if_small(wide, config.max_strata_broadcast), F.col(stratum).eqNullSafe(F.col(of)), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(rule) > F.col(cuts)[rule], F.lit(rule)) for rule in config.grid]))
    kept = [c for c in ratios.columns if c not in ("failed_rules", "kept")]
    return joined.select(*kept, failed.alias(found)).select(*kept, F.col(found).alias("failed_rules"), (~F.col("base_failed") & (F.size(found) == 0)).alias("kept"))
