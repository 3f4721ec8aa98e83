"""Mixing sources to target weights by entropy balancing.

A source with weight w is to give w / (sum of weights) of all words, at most ``max_copies`` times its own; what
exceeds that is shared out again by weight. Within a source, documents get rates r = min(max_copies,
exp(lambda * size / mean size)): the rates nearest to 1 in relative entropy, under the cap, whose words meet the
target. The convex dual in lambda is solved by Newton iterations kept inside a bracket; each iteration is one
distributed aggregation over the pre-aggregated sizes, for all sources at once. Rates become whole copies by
rounding that carries the words over- or undershot from larger to smaller documents, in groups of bounded size,
which hold ids, sizes and hashes of the texts only.

Targets and multipliers are tables with a row per source; the driver sees one row of sums at a time.

Defined results: sizes are words, a null text has none; a null source is a source of its own, last in order;
documents of size 0 are taken once and give no words; a source whose target is its cap takes every document
``max_copies`` times. Sums are exact decimals, so that reruns agree. Rows equal in id, source and text are rounded
as one item; if their copies do not divide evenly, exactly so many of them get one more, whichever those are. Other columns, of whatever
name, are carried along; the columns that start with ``_mix_`` are this module's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklight.functions.tables import dense_index
from tracklight.llm.common import materialize, n_words


@dataclass(frozen=True)
class MixConfig:
    weights: tuple = (5, 2, 1)  # repeat along the sources in code point order, null last
    max_copies: int = 3
    iterations: int = 40
    tolerance: float = 1e-7  # of the target, for the words of the real-valued rates
    group_rows: int = 20_000  # documents that are rounded together


SCALE = 1 << 30  # rates are whole multiples of 1 / SCALE where they are summed
KEY = ["doc_id", "source", "_mix_hash", "_mix_size"]
PLACES = 33  # bits of the place within a partition in monotonically_increasing_id


def sized_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``_mix_size``, their number of words, and ``_mix_hash``, a hash of the text."""
    return documents.withColumns({"_mix_size": n_words(F.col(text)), "_mix_hash": F.xxhash64(text)})


def _join(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join on equality of the columns, nulls included."""
    names = {c: f"_mix_on_{c}" for c in columns}
    same = F.lit(True)
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def source_weights(keys: DataFrame, config: MixConfig) -> DataFrame:
    """(source, source_size, n_docs, weight): one row per source, weighted by its place in the order of sources."""
    totals = keys.groupBy("source").agg(F.sum(F.col("_mix_size") * F.col("m")).alias("source_size"), F.sum("m").alias("n_docs"))
    ordered = materialize(totals.orderBy(F.asc_nulls_last("source")).withColumn("id", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("id", PLACES)
    parts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row per partition
    place = F.col("before") + F.col("id").bitwiseAND((1 << PLACES) - 1)
    weights = F.array(*[F.lit(float(w)) for w in config.weights])
    placed = ordered.join(parts, part == F.col("part"))
    return placed.select("source", "source_size", "n_docs", F.element_at(weights, (F.pmod(place, F.lit(len(config.weights))) + 1).cast("int")).alias("weight"))


def source_targets(keys: DataFrame, config: MixConfig) -> DataFrame:
    """(source, source_size, n_docs, target): the sum of sizes by weight, none above the cap; the excess goes to the others by weight."""
    sources = materialize(source_weights(keys, config).withColumn("full", F.lit(False)), "mix-weights")
    most = F.col("source_size") * config.max_copies
    while True:
        sums = sources.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(F.col("full"), most)).alias("given"), F.sum(F.when(~F.col("full"), F.col("weight").cast("decimal(20,9)"))).alias("weight"),
            F.count_if(~F.col("full")).alias("free"),
        ).first()
        left, weight = float((sums["total"] or 0) - (sums["given"] or 0)), float(sums["weight"] or 1)
        share = F.lit(left) * F.col("weight") / F.lit(weight)
        over = ~F.col("full") & (share > most)
        if not sums["free"] or not sources.where(over).limit(1).count():
            break
        sources = materialize(sources.withColumn("full", F.col("full") | over), "mix-weights")
    return sources.select("source", "source_size", "n_docs", F.when(F.col("full"), most.cast("double")).otherwise(share).alias("target"))


def rate(size: Column, mean: Column, tilt: Column, config: MixConfig) -> Column:
    """The tilted rate, in whole units of 1 / SCALE."""
    power = F.least(F.greatest(tilt * (size / mean), F.lit(-60.0)), F.lit(60.0))
    return F.floor(F.least(F.lit(float(config.max_copies)), F.exp(power)) * SCALE).cast("long")


def solve(keys: DataFrame, targets: DataFrame, config: MixConfig) -> DataFrame:
    """``targets`` with mean and tilt (null where every document is taken max_copies times)."""
    counts = materialize(keys.where("_mix_size > 0").groupBy("source", F.col("_mix_size").alias("size")).agg(F.sum("m").alias("n")), "mix-sizes")
    targets = targets.withColumn("mean", F.col("source_size") / F.greatest(F.col("n_docs"), F.lit(1)))
    open_ = (F.col("target") < F.col("source_size") * config.max_copies) & (F.col("source_size") > 0)
    start = {"tilt": F.lit(0.0), "low": F.lit(-60.0), "high": F.lit(60.0), "done": F.lit(False)}
    state = materialize(targets.where(open_).select("source", "target", "mean").withColumns(start), "mix-state")
    for _ in range(config.iterations):
        active = state.where(~F.col("done"))
        if not active.limit(1).count():
            break
        joined = _join(counts, active, ["source"])
        r = rate(F.col("size"), F.col("mean"), F.col("tilt"), config)
        words = (F.col("n") * F.col("size")).cast("decimal(20,0)")
        slope = F.when(r < config.max_copies * SCALE, words * F.floor(r * (F.col("size") / F.col("mean"))).cast("long"))
        found = joined.groupBy("source").agg(F.sum(words * r).cast("decimal(38,0)").alias("taken"), F.sum(slope).cast("decimal(38,0)").alias("slope"))
        found = found.select("source", (F.col("taken").cast("double") / SCALE).alias("taken"), (F.coalesce("slope", F.lit(0)).cast("double") / SCALE).alias("slope"))
        after = _join(state, found, ["source"], "left")
        gap = F.coalesce("taken", F.lit(0.0)) - F.col("target")
        met = F.abs(gap) <= config.tolerance * F.col("target")
        low, high = F.when(gap > 0, F.col("low")).otherwise(F.col("tilt")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - gap / F.col("slope"))
        inside = F.coalesce((newton > low) & (newton < high), F.lit(False))
        step = F.when(inside, newton).otherwise((low + high) / 2)
        still = ~F.col("done") & ~met
        state = materialize(
            after.select(
                "source", "target", "mean", F.when(still, step).otherwise(F.col("tilt")).alias("tilt"), F.when(still, low).otherwise(F.col("low")).alias("low"),
                F.when(still, high).otherwise(F.col("high")).alias("high"), (~still | (step == F.col("tilt"))).alias("done"),
            ),
            "mix-state",
        )
    tilts = state.select("source", F.format_string("%.11e", "tilt").cast("double").alias("tilt"))  # twelve digits, as the last ones may differ between processors
    return materialize(_join(targets, tilts, ["source"], "left"), "mix-solved")


def round_group(sizes, units, counts, cap: int) -> list[int]:
    """Copies of one group's items, all rows of an item together, in the order given (largest first is best).

    Each row gets its rate rounded down or up, so that the words taken so far stay nearest to the words that the
    rates have asked for so far; a group misses its words by half of its last document at most.
    """
    out, asked, taken = [], 0.0, 0.0
    for size, unit, rows in zip(sizes.tolist(), units.tolist(), counts.tolist(), strict=True):
        low = unit // SCALE
        asked += rows * size * (unit / SCALE)
        more = 0
        if unit > low * SCALE and low < cap:
            more = min(rows, max(0, math.ceil((asked - taken - rows * size * low) / size - 0.5)))
        out.append(int(rows * low + more))
        taken += size * out[-1]
    return out


def plan_items(keys: DataFrame, config: MixConfig) -> DataFrame:
    """``KEY``, m, and _mix_source_size, _mix_target, _mix_rate, ``taken``: the copies of all m rows of an item.

    Items are rounded in groups of one source, dealt by hash into groups of ``group_rows`` or so.
    """
    solved = solve(keys, source_targets(keys, config), config)
    rated = _join(keys, solved, ["source"])
    size = F.col("_mix_size")
    units = F.when(size == 0, F.lit(SCALE)).when(F.col("tilt").isNull(), F.lit(config.max_copies * SCALE)).otherwise(rate(size, F.col("mean"), F.col("tilt"), config))
    salts = F.ceil(F.col("n_docs") / config.group_rows).cast("long")
    rated = rated.select(*KEY, "m", F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"), units.cast("long").alias("units"), F.pmod(F.xxhash64("doc_id", "_mix_hash"), salts).alias("salt"))

    def rounding(group):
        group = group.sort_values(["_mix_size", "doc_id", "_mix_hash"], ascending=[False, True, True], kind="stable")
        return group.assign(taken=round_group(group["_mix_size"], group["units"], group["m"], config.max_copies))

    rounded = rated.groupBy("source", "salt").applyInPandas(rounding, rated.withColumn("taken", F.lit(0).cast("long")).schema)
    return rounded.withColumn("_mix_rate", F.col("units") / SCALE).drop("units", "salt")


def plan_copies(sized: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """``sized`` (of ``sized_documents``) with _mix_source_size, _mix_target, _mix_rate and _mix_copies."""
    keys = materialize(sized.groupBy(*KEY).agg(F.count(F.lit(1)).alias("m")), "mix-items")
    plan = plan_items(keys, config).withColumnsRenamed({"m": "_mix_m", "taken": "_mix_taken"})
    found = _join(sized, plan, KEY)
    m, taken = F.col("_mix_m"), F.col("_mix_taken")

    def planned(rows: DataFrame, more: Column) -> DataFrame:
        return rows.select(*sized.columns, "_mix_source_size", "_mix_target", "_mix_rate", (F.floor(taken / m) + more.cast("int")).cast("int").alias("_mix_copies"))

    if not keys.where("m > 1").limit(1).count():
        return planned(found, F.lit(0))
    alike = found.where("_mix_m > 1").withColumn("_mix_row", F.monotonically_increasing_id())  # sorted in ranges, so many alike rows are no one task's
    alike = dense_index(alike, [*map(F.col, KEY), F.col("_mix_row")], "_mix_place")
    ranked = _join(alike, alike.groupBy(*KEY).agg(F.min("_mix_place").alias("_mix_first")), KEY)
    return planned(found.where("_mix_m = 1"), F.lit(0)).unionByName(planned(ranked, F.col("_mix_place") - F.col("_mix_first") < taken % m))


def mix(documents: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mixed documents: every row as often as its copies say, with the columns of ``documents``."""
    plan = plan_copies(sized_documents(documents), config).where(F.col("_mix_copies") > 0)
    copies = plan.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return copies.select(*documents.columns)
