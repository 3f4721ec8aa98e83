"""Line dedup by content-defined chunks of lines.

A text is split into lines; each line is hashed, and a rolling hash covers ``window`` lines at a time. A chunk
starts where the rolling hash is less than at the line before and the line after, so boundaries depend on nearby
lines only and survive shifts; every chunk but that of a one-line text has two lines or more. Multi-line chunks
that stand elsewhere too are removed, but for the first occurrence by document and place.

The work goes in three passes over the texts. The first writes a hash of every multi-line chunk; only hashes that
come twice go on. The second groups the chunks with those hashes by their bytes, which tells apart chunks that
share a hash. The third drops, by their places, the occurrences that are not the first of their bytes.

Defined results: documents are in the order of their ids, null ids last; documents that share an id, or have none,
are in the order of a hash of their texts. Rows equal in id and text are one document, and each gets its result. A
null text stays null and an empty one empty; one-line texts have no multi-line chunk and stay as they are. A text
may end up empty. Other columns, of whatever name, are carried along; a column ``removed_chunks`` is replaced. No
Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import let, materialize


@dataclass(frozen=True)
class LineDedupConfig:
    window: int = 2  # lines under the rolling hash
    hash_bits: int = 128  # of a chunk; fewer only make more chunks share a hash


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def chunk_starts(lines: Column, config: LineDedupConfig) -> Column:
    """Numbers (from 0) of the lines that start chunks, ascending."""

    def starts(rolled):
        def is_start(i):
            here = F.get(rolled, i)
            return (here < F.get(rolled, i - 1)) & (here < F.get(rolled, i + 1))

        inner = F.sequence(F.lit(2), F.size(rolled) - 2)
        return F.when(F.size(rolled) >= 4, F.concat(F.array(F.lit(0)), F.filter(inner, is_start))).otherwise(F.array(F.lit(0)))

    def rolling(hashed):
        return F.transform(hashed, lambda h, i: F.md5(F.concat(h, *[F.coalesce(F.get(hashed, i - k), F.lit("")) for k in range(1, config.window)])))

    return let(let(F.transform(lines, F.md5), rolling), starts)


def chunks_of(text: Column, config: LineDedupConfig) -> Column:
    """array of struct(body, n_lines) whose bodies, joined by newlines, are the text."""

    def cut(lines):
        def pieces(starts):
            def piece(s, i):
                end = F.coalesce(F.get(starts, i + 1), F.size(lines))
                return F.struct(F.array_join(F.slice(lines, s + 1, end - s), "\n").alias("body"), (end - s).alias("n_lines"))

            return F.transform(starts, piece)

        return let(chunk_starts(lines, config), pieces)

    return let(lines_of(text), cut)


def _documents(documents: DataFrame) -> DataFrame:
    """(row, doc, text): the row as it is, and what names and orders its document."""
    key = F.struct(F.col("doc_id").isNull().alias("lost"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    return documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("row"), key.alias("doc"), F.col("text"))


def _hash(body: Column, config: LineDedupConfig) -> Column:
    return F.substring(F.unhex(F.sha2(body, 256)), 1, config.hash_bits // 8)


def hashed_chunks(docs: DataFrame, config: LineDedupConfig) -> DataFrame:
    """(key, doc, place): the hash of every multi-line chunk and where it stands."""

    def hashes(chunks):
        numbered = F.transform(chunks, lambda c, i: F.struct(F.when(c["n_lines"] >= 2, _hash(c["body"], config)).alias("key"), i.alias("place")))
        return F.filter(numbered, lambda c: c["key"].isNotNull())

    found = docs.where("text IS NOT NULL").select("doc", F.explode(let(chunks_of(F.col("text"), config), hashes)).alias("c"))
    return found.select("c.key", "doc", "c.place")


def _among(docs: DataFrame, some: DataFrame) -> DataFrame:
    """``docs`` with ``maybe``: false only where the document is certainly none of ``some`` (doc).

    That is read from 2 ** 24 bits, one for each hash of a document, held as 2 ** 18 words at most, which bounds the
    broadcast. Texts of the others need no shuffle.
    """
    place = F.pmod(F.xxhash64("doc"), F.lit(1 << 24))
    marks = lambda df: df.withColumn("_place", place).withColumns({"_word": F.shiftright("_place", 6), "_bit": F.expr("shiftleft(1L, int(_place & 63))")})
    words = materialize(marks(some.select("doc")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "line-bits")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    return marks(docs).join(F.broadcast(words), "_word", "left").withColumn("maybe", maybe).drop("_place", "_word", "_bit", "_bits")


def with_bodies(docs: DataFrame, chunks: DataFrame, config: LineDedupConfig) -> DataFrame:
    """``chunks`` (key, doc, place) with their bodies, taken from the texts again."""
    of_doc = chunks.groupBy("doc").agg(F.collect_set(F.struct("place", "key")).alias("wanted"))
    texts = _among(docs.select("doc", "text"), chunks).where("maybe").select(F.col("doc").alias("_of"), "text").join(of_doc, F.col("_of") == F.col("doc"))
    bodies = let(chunks_of(F.col("text"), config), lambda cs: F.transform("wanted", lambda w: F.struct(w["key"].alias("key"), w["place"].alias("place"), cs[w["place"]]["body"].alias("body"))))
    return texts.select("doc", F.explode(bodies).alias("c")).select("c.key", "doc", "c.place", "c.body")


def later_chunks(docs: DataFrame, config: LineDedupConfig) -> DataFrame:
    """(doc, place) of the chunks whose bytes stand in an earlier document, or earlier in their own."""
    chunks = materialize(hashed_chunks(docs, config), "line-chunks")
    at = F.struct("doc", "place")
    # a written table, so that the join with it is one of two plain shuffles, which Spark splits where a key is hot
    firsts = materialize(chunks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).where("n > 1").drop("n"), "line-firsts")
    repeated = materialize(chunks.join(firsts, "key"), "line-repeated")
    compared = with_bodies(docs, repeated, config).groupBy("key", "body").agg(F.count(F.lit(1)).alias("n"))
    shared = materialize(compared.groupBy("key").agg(F.count(F.lit(1)).alias("bodies")).where("bodies > 1").select("key"), "line-shared")
    later = repeated.join(shared, "key", "left_anti").where(at > F.col("first")).select("doc", "place")
    if shared.limit(1).count():  # hashes that chunks of different bytes share
        told = materialize(with_bodies(docs, repeated.join(shared, "key", "left_semi"), config), "line-told")
        later = later.union(told.join(told.groupBy("key", "body").agg(F.min(at).alias("first")), ["key", "body"]).where(at > F.col("first")).select("doc", "place"))
    return later


def dedup_lines(documents: DataFrame, config: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """``documents`` with their texts less repeated chunks, and ``removed_chunks`` (int)."""
    docs = _documents(documents)
    gone = materialize(later_chunks(docs, config).groupBy("doc").agg(F.collect_set("place").alias("gone")), "line-gone")

    def cleaned(chunks):
        kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(chunks) - 1), F.col("gone")))
        return F.array_join(F.transform(F.when(F.size(kept) > 0, kept), lambda i: chunks[i]["body"]), "\n")

    told = _among(docs, gone)
    rows = told.where("maybe").join(gone.withColumnRenamed("doc", "_of"), F.col("doc") == F.col("_of"), "left").drop("_of", "maybe")
    rows = rows.unionByName(told.where("NOT maybe").drop("maybe"), allowMissingColumns=True)
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.coalesce(let(chunks_of(F.col("text"), config), cleaned), F.lit("")))
    out = rows.select("row", text.alias("_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("_removed"))
    kept = [c for c in documents.columns if c != "removed_chunks"]
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in kept], F.when(F.col("_removed") > 0, F.col("_removed")).otherwise(F.lit(0)).alias("removed_chunks"))
