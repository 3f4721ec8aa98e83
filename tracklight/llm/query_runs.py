"""Query of the detection of periodic runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklight.llm import word_runs
from tracklight.llm.catalogue import query
from tracklight.llm.common import let, table, words_of


def wrapped(text: Column, doc_id: Column) -> Column:
    """The text, whose words repeat from some place on if the id's checksum says so (one in ten); other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        return let(F.struct((g % n).cast("int").alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).cast("int").alias("p")), lambda at: F.array_join(
            F.transform(words, lambda w, i: F.when(i < at["a"], w).otherwise(F.get(words, at["a"] + (i - at["a"]) % at["p"]))), " "))

    return F.when(doc_id.isNotNull() & (h % 10 == 0), let(words_of(text), lambda words: F.when(F.size(words) > 0, repeated(words)).otherwise(""))).otherwise(text)


@query("op12_word_runs")
def op12_word_runs(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", wrapped(F.col("text"), F.col("doc_id")).alias("text"))
    found = word_runs.collapse_runs(documents)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.start")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.period")).alias("period"),
        F.floor(1000 * F.col("_b.length") / -F.col("_b.period")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
