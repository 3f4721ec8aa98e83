"""As-of joins, interval joins and clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklight.schema import DAY


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], strict: bool = False, bucket: int | None = None) -> DataFrame:
    """``left`` with the ``values`` of the last right row of the same ``by`` whose ``on`` is not after the left's.

    With ``strict``, right rows at the same moment do not count. Both sides meet in one sorted pass: no range join, and
    no row is paired with more than one other. Right rows that tie are ordered by their values; those without ``on``
    never count. With ``bucket``, a length in the unit of ``on`` (a number), a key is passed over in pieces of that
    length, each of which begins with the last value before it: a hot key is divided among tasks, and what one
    task sees of a key as a whole is one row per piece.
    """
    left_type, marks = left.select(F.struct(*left.columns)).schema[0].dataType, F.struct(*[F.col(v) for v in values])
    value_type = right.select(marks).schema[0].dataType
    none = lambda t: F.lit(None).cast(t)
    piece = (F.floor(F.col(on) / bucket) if bucket else F.lit(0).cast("long")).alias("_piece")
    rows = left.select(*by, piece, F.col(on).alias("_at"), F.lit(1).alias("_kind"), F.struct(*left.columns).alias("_row"), none(value_type).alias("_value"))
    known = right.where(F.col(on).isNotNull()).select(*by, piece, F.col(on).alias("_at"), F.lit(2 if strict else 0).alias("_kind"), none(left_type).alias("_row"), marks.alias("_value"))
    both = rows.unionByName(known)
    if bucket:
        last = known.groupBy(*by, "_piece").agg(F.max(F.struct("_at", "_value")).alias("_end"))
        pieces = rows.select(*by, "_piece").distinct().unionByName(last, allowMissingColumns=True).groupBy(*by, "_piece").agg(F.max("_end").alias("_end"))
        carried = F.last("_end", ignorenulls=True).over(W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
        begin = pieces.withColumn("_begin", carried).where(F.col("_begin").isNotNull() & F.col("_piece").isNotNull())
        both = both.unionByName(begin.select(*by, "_piece", none(rows.schema["_at"].dataType).alias("_at"), F.lit(-1).alias("_kind"), none(left_type).alias("_row"), F.col("_begin._value").alias("_value")))
    order = W.partitionBy(*by, "_piece").orderBy("_at", "_kind", "_value").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_value", ignorenulls=True).over(order)).where("_kind = 1")
    return found.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def next_after(left: DataFrame, right: DataFrame, left_at: str, right_at: str, by: list[str], values: list[str], bucket: int = 30 * DAY) -> DataFrame:
    """``left`` with the ``values`` of the first right row of the same ``by`` that is strictly later; of several at one
    moment, those that come first in the order of ``values``. The columns of time are timestamps."""
    first = right.groupBy(*by, right_at).agg(F.min(F.struct(*values)).alias("_first"))
    turned = first.select(*by, (-F.unix_micros(right_at)).alias("_turned"), *[F.col(f"_first.{v}").alias(v) for v in values])
    return asof_join(left.withColumn("_turned", -F.unix_micros(left_at)), turned, "_turned", by, values, strict=True, bucket=bucket).drop("_turned")


def sums_before(rows: DataFrame, by: list[str], at: str, value: str, name: str, bucket: int = 7 * DAY) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same ``by`` that are strictly earlier.

    Two levels: sums of pieces of time, which a key has few of, and sums within a piece; so a hot key is divided among tasks.
    ``value`` should be a whole number.
    """
    keyed = rows.withColumn("_piece", F.floor(F.unix_micros(at) / bucket))
    pieces = keyed.groupBy(*by, "_piece").agg(F.sum(value).alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*by, "_piece").orderBy(F.unix_micros(at)).rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = keyed.withColumn("_inside", inside).join(pieces.select(*by, "_piece", earlier.alias("_earlier")), [*by, "_piece"])
    return joined.withColumn(name, F.col("_inside") + F.col("_earlier")).drop("_piece", "_inside", "_earlier")


def counts_before(rows: DataFrame, by: list[str], order: list[str], counts: dict[str, Column], bucket: int = 7 * DAY) -> DataFrame:
    """``rows`` with, for each name of ``counts``, the sum of that whole number over the rows of the same ``by`` that come
    before in ``order``, whose first column is a timestamp without nulls and whose last tells all rows apart.

    A key is passed over in pieces of time, each of which begins with the sums of those before it, so a hot key is
    divided among tasks.
    """
    named = {n: f"_n{i}" for i, n in enumerate(counts)}
    keyed = rows.select("*", F.floor(F.unix_micros(order[0]) / bucket).alias("_piece"), *[counts[n].cast("long").alias(c) for n, c in named.items()], F.lit(1).alias("_kind"))
    pieces = keyed.groupBy(*by, "_piece").agg(*[F.sum(c).alias(c) for c in named.values()])
    earlier = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    begin = pieces.select(*by, "_piece", F.lit(0).alias("_kind"), *[F.sum(c).over(earlier).alias(c) for c in named.values()])
    inside = W.partitionBy(*by, "_piece").orderBy("_kind", *order).rowsBetween(W.unboundedPreceding, -1)
    summed = keyed.unionByName(begin, allowMissingColumns=True).withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in named.items()})
    return summed.where("_kind = 1").drop("_piece", "_kind", *named.values())


def range_join(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, bucket: int = 7 * DAY) -> DataFrame:
    """Pairs of points and spans with start <= at < end, all in microseconds, inner.

    Spans are spread over the buckets that they touch, so the join has an equality on (by, bucket) and hot keys
    are divided by time as well.
    """
    spread = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))))
    keyed = points.withColumn("_bucket", F.floor(F.col(at) / bucket))
    joined = keyed.join(spread, [*by, "_bucket"])
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def ticks(spark: SparkSession, start: str, end: str, step: str) -> DataFrame:
    """Moments from start to end, both included, as column ``as_of``."""
    return spark.sql(f"SELECT explode(sequence(timestamp '{start}', timestamp '{end}', interval {step})) AS as_of")


def before(seconds_or_days: float, at: Column) -> Column:
    """``at`` less a number of days."""
    return F.timestamp_micros((F.unix_micros(at) - int(seconds_or_days * DAY)).cast("long"))


def previous_action(events: DataFrame, actor: str = "actor", at: str = "observed_at") -> DataFrame:
    """``events`` with ``previous_at``: the actor's last action strictly before, ties left out."""
    order = W.partitionBy(actor).orderBy(F.unix_micros(at)).rangeBetween(W.unboundedPreceding, -1)
    return events.withColumn("previous_at", F.max(at).over(order))
