"""Token counts as delta-maintained rollups.

A change row inserts, deletes or revises the token count of one document under one tokenizer version. Each becomes
signed deltas: +1 document and +tokens for an insert, the negatives for a delete, and for a revision the old count
taken out and the new one put in (under its old and its new key, if they differ). A batch is summed by source,
language and tokenizer version and committed under its id: the totals are the sum of all committed batches, as
the deltas are additive. A batch id that is committed already is left alone, so a batch may be delivered again.

``Rollup`` keeps one Parquet folder per batch, and snapshots of all batches before them, so that a read sums one
snapshot and few batches. A folder is renamed into place when it is whole, which is the commit.

Defined results: a null text has 0 tokens; null sources and languages are groups of their own; a null count is
0; an operation other than insert, delete and revise is refused with an error; repeated rows count each time;
groups whose documents and tokens both come to 0 are not listed. Deletes are taken as they come: what was never
inserted drives a total below 0, and the insert that follows mends it. Other columns are ignored.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm.common import n_words

KEYS = ("source", "lang", "tokenizer")
STATE = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Tokenizer version -> count of a text: words, and words with their punctuation split off.
TOKENIZERS = {
    "words-1": n_words,
    "pieces-1": lambda text: F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]")), F.lit(0)).cast("long"),
}


def count_documents(documents: DataFrame, text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and tokenizer version: doc_id, source, lang, the columns ``also``, tokenizer, tokens. One pass over the texts."""
    counts = F.explode(F.array(*[F.struct(F.lit(name).alias("tokenizer"), count(F.col(text)).alias("tokens")) for name, count in TOKENIZERS.items()]))
    return documents.select("doc_id", "source", "lang", *also, counts.alias("c")).select("doc_id", "source", "lang", *also, "c.tokenizer", "c.tokens")


def signed(changes: DataFrame) -> DataFrame:
    """Deltas of change rows: op, source, lang, tokenizer, tokens and, for a revision, old_tokens and old_tokenizer.

    The old source and language of a revision are its source and language.
    """

    def delta(sign: int, tokenizer: str, tokens: str) -> Column:
        return F.struct(F.col(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"), (sign * F.coalesce(F.col(tokens), F.lit(0))).cast("long").alias("n_tokens"))

    parts = (
        F.when(F.col("op") == "insert", F.array(delta(1, "tokenizer", "tokens")))
        .when(F.col("op") == "delete", F.array(delta(-1, "tokenizer", "tokens")))
        .when(F.col("op") == "revise", F.array(delta(-1, "old_tokenizer", "old_tokens"), delta(1, "tokenizer", "tokens")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(F.col("op"), F.lit("null")))))
    )
    return changes.select("source", "lang", F.explode(parts).alias("d")).select("source", "lang", "d.*")


def totals(deltas: DataFrame) -> DataFrame:
    found = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return found.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


class Rollup:
    """A rollup kept in ``path``, which driver and executors can both reach.

    ``batch_id=N`` holds the totals of one batch; ``snapshot=N`` those of all batches that were committed when it was
    made, with their ids. Folders are written elsewhere and renamed into place, which fails if another writer was
    first: so a folder is whole once it can be seen, and is never changed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = self._hadoop.Path(self.path)

    def _publish(self, df: DataFrame, name: str) -> bool:
        """Write ``df`` as the folder ``name``; False if there is one already."""
        draft, at = f"{self.path}/_draft-{uuid.uuid4().hex}", f"{self.path}/{name}"
        df.write.partitionBy(*[c for c in df.columns if c == "part"]).parquet(draft)
        conf = self.spark._jsc.hadoopConfiguration()
        context = self._hadoop.FileContext.getFileContext(self._at.toUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(self._hadoop.Path(draft), self._hadoop.Path(at), options)
        except Py4JJavaError as error:
            context.delete(self._hadoop.Path(draft), True)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()) or self._exists(at):
                return False
            raise
        return True

    def _exists(self, path: str) -> bool:
        at = self._hadoop.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _numbers(self, kind: str) -> list[int]:
        """Of the folders ``kind=N`` the numbers, ascending."""
        fs = self._at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(self._at)] if fs.exists(self._at) else []
        return sorted(int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}="))

    def _state(self) -> tuple[int | None, set[int]]:
        """(number of the last snapshot, ids of the batches in it)."""
        snapshots = self._numbers("snapshot")
        if not snapshots:
            return None, set()
        ids = self.spark.read.schema("id long").parquet(f"{self.path}/snapshot={snapshots[-1]}/part=ids")
        return snapshots[-1], {r["id"] for r in ids.collect()}  # one number per batch

    def committed(self, batch_id: int) -> bool:
        return self._exists(f"{self.path}/batch_id={int(batch_id)}") or int(batch_id) in self._state()[1]

    def commit(self, changes: DataFrame, batch_id: int) -> bool:
        """Apply a batch of changes once. False if the batch is committed already. Fits ``foreachBatch``."""
        return not self.committed(batch_id) and self._publish(totals(signed(changes)), f"batch_id={int(batch_id)}")

    def _sum(self, last: int | None, batches: list[int]) -> DataFrame:
        groups = [[f"{self.path}/batch_id={n}" for n in batches], [f"{self.path}/snapshot={last}/part=totals"] if last is not None else []]
        found = self.spark.createDataFrame([], STATE)
        for folders in filter(None, groups):
            found = found.unionByName(self.spark.read.schema(STATE).parquet(*folders))
        return totals(found)

    def read(self) -> DataFrame:
        """The totals of all committed batches: the last snapshot and the batches that came after it."""
        last, known = self._state()
        return self._sum(last, [n for n in self._numbers("batch_id") if n not in known])

    def snapshot(self) -> bool:
        """Sum up what is committed, so that reads stay short. False if another writer did so meanwhile."""
        last, known = self._state()
        new = [n for n in self._numbers("batch_id") if n not in known]
        kept = self._sum(last, new).withColumn("id", F.lit(None).cast("long")).withColumn("part", F.lit("totals"))
        listed = self.spark.createDataFrame([(i,) for i in sorted(known | set(new))], "id long")
        rows = kept.unionByName(listed.withColumn("part", F.lit("ids")), allowMissingColumns=True)
        return self._publish(rows, f"snapshot={0 if last is None else last + 1}")

    def clear(self) -> None:
        """Delete the batches of the last snapshot. Not while readers from before the snapshot are at work."""
        fs = self._at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for n in set(self._numbers("batch_id")) & self._state()[1]:
            fs.delete(self._hadoop.Path(f"{self.path}/batch_id={n}"), True)
