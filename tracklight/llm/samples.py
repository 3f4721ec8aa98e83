"""Bounded samples of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklight.llm.common import broadcast_if_small, materialize


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_by_class(labelled: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each class, with ``class_rows``: how many there are.

    ``labelled`` has doc_id and the label. Rows are taken by the hash of their id, the same in every run. Ranges of
    hashes are counted first; only rows of the ranges up to the last that is needed meet in a task to be ranked.
    """
    rows = labelled.select("doc_id", label, F.xxhash64("doc_id").alias("_h")).withColumn("_range", F.shiftright("_h", 52))  # 4096 ranges
    mine = W.partitionBy(label)
    before = F.coalesce(F.sum("_in").over(mine.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_in")).select(label, "_range", before.alias("_before"), F.sum("_in").over(mine).alias("class_rows"))
    last = materialize(ranges.where(F.col("_before") < per_class).groupBy(label).agg(F.max("_range").alias("_last"), F.max("class_rows").alias("class_rows")), "sample-ranges")
    near = rows.join(broadcast_if_small(last, 100_000), label).where("_range <= _last")  # a row per class
    order = mine.orderBy("_h", "doc_id")
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class).select(label, "doc_id", "class_rows")


def sampled(documents: DataFrame, sample: DataFrame, label: str, also: tuple[str, ...] = ()) -> DataFrame:
    """text, label, class_rows, _h (a hash of the id) and the columns ``also`` of the sampled documents; the caller bounds the sample, by class.

    Of documents that share an id one text is taken.
    """
    ids = sample.dropDuplicates(["doc_id", label])
    on = ["doc_id", label] if label in documents.columns else ["doc_id"]
    taken = F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), *also)).alias("_t")
    found = documents.select(*on, "text", *also).join(F.broadcast(ids), on).groupBy("doc_id", label, "class_rows").agg(taken)
    return found.select("_t.*", label, "class_rows", F.xxhash64("doc_id").alias("_h"))


def sample_texts(documents: DataFrame, sample: DataFrame, label: str, rows: int, most_bytes: int, also: tuple[str, ...] = ()) -> list:
    """The rows of ``sampled``, at most ``rows``, which bounds the broadcast; a larger sample is refused, not cut.

    Their texts hold ``most_bytes`` in UTF-8 at most, each class an equal share: texts over a hundredth of the share are
    left out, and of the others those of the smallest hashes are taken until the share is full.
    """
    found = materialize(sampled(documents, sample, label, also).withColumn("_bytes", F.octet_length("text")), "sample")
    classes, n = found.agg(F.countDistinct(label), F.count(F.lit(1))).first()
    if n > rows:
        raise ValueError(f"the sample has more than {rows} rows")
    share = most_bytes // max(1, classes)
    fitting = found.where(F.col("_bytes") <= share // 100)
    upto = F.sum("_bytes").over(W.partitionBy(label).orderBy("_h").rangeBetween(W.unboundedPreceding, 0))
    last = fitting.select(label, "_h", upto.alias("_upto")).where(F.col("_upto") <= share).groupBy(label).agg(F.max("_h").alias("_last"))
    taken = fitting.join(last, label).where("_h <= _last").drop("_last", "_bytes").collect()
    return sorted(taken, key=lambda r: (r["_h"], r["text"]))
