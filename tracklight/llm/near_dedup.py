"""Near-duplicate detection by order MinHash, with candidates verified by banded alignment.

Each text is sketched: its five-word shingles are labelled by their occurrence, and each of ``entries`` hash
functions picks the ``picks`` labelled shingles with the least hashes; the picked shingles, in the order of the
text, make an entry. Two texts agree in an entry with about their similarity to the power of ``picks``, less if
they order their passages differently. Texts that agree in any entry are candidates. Texts are similar if the
word-level edit distance is (1 - ``similarity``) of the longer one's words at most.

Exact copies are put together first, and only one text of them is compared. A bucket of texts with one entry in
common has a leader, the member that meets most texts over all its buckets. First each member is compared with a few
of its buckets' leaders, so a group of copies is joined through its original with work that grows with the members;
the buckets of ``led`` entries are enough for that. Members that this leaves apart are compared with other members
of their buckets, taken by hash. Then every pair of any bucket whose classes are not joined yet is compared too, but
for those that a bound on their distance excludes: texts differ by as many edits as their counts of words, dealt
over ``bins``, differ on one side. Big buckets are divided by lengths, and into blocks of pairs. Classes are the connected
components of the similar pairs, labelled by their least id, the same as if every pair of a bucket had been
compared; nothing is capped.

Chance of missing a pair in all entries: below 1e-20 at a Jaccard similarity of 0.8; at the least similarity that
the alignment accepts, 20 % of the words changed here and there, about one in ten (README).

Defined results: null texts are alike to nothing, nor to each other; empty texts, and texts without words, are
copies of what equals them exactly; texts of under five words have one shingle. Rows that share an id are one
document, which joins the classes of all its texts; documents with a null id are their own class (class_id null).
Ids may be of any type that has an order. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklight.llm import alignment
from tracklight.llm import word_arrays as wa
from tracklight.llm.common import free_name, materialize


@dataclass(frozen=True)
class NearDedupConfig:
    shingle: int = 5
    entries: int = 64
    led: int = 16  # entries whose buckets compare members with leaders first
    picks: int = 2
    similarity: float = 0.8
    seed: int = 5
    leaders: int = 4  # that each member is compared with first, at most,
    second: int = 8  # and then, if that did not put it in their class
    bins: int = 512
    shard: int = 1024  # members of a bucket on one side of a block of pairs


ODD = np.uint64(0x9E3779B97F4A7C15)
LARGEST = np.uint64(2**64 - 1)


def word_hashes(words: wa.Words) -> np.ndarray:
    """The hash of each distinct word."""
    return np.array([xxhash.xxh64_intdigest(w) for w in words.vocab.to_pylist()], dtype=np.uint64)


def word_bins(words: wa.Words, hashes: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` bytes per text: how many of its words fall into each, 255 at most."""
    of_text = np.repeat(np.arange(len(words.lengths)), words.lengths) * bins
    of_word = (wa.mix64(hashes) % np.uint64(bins)).astype(np.int64)
    counts = np.bincount(of_text + of_word[words.codes], minlength=len(words.lengths) * bins)
    return np.minimum(counts, 255).astype(np.uint8).reshape(len(words.lengths), bins)


def labelled_shingles(words: wa.Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle, hash of it with its occurrence, where each text's shingles start)."""
    of_word = hashes[words.codes] if len(hashes) else np.empty(0, np.uint64)
    lengths = words.lengths
    counts = np.where(lengths == 0, 0, np.maximum(lengths - size + 1, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(words.starts[:-1] - starts[:-1], counts) + np.arange(starts[-1])  # the first word of each shingle
    ends = np.repeat(words.starts[1:], counts)
    plain = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        inside = at + k < ends
        plain = plain * ODD + np.where(inside, of_word[np.minimum(at + k, max(len(of_word) - 1, 0))] if len(of_word) else 0, 0).astype(np.uint64)
    plain = wa.mix64(plain)
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    key = plain ^ wa.mix64(text + np.uint64(1))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.empty(0, bool)
    nth = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.empty(0, np.int64)
    occurrence = np.empty(len(key), dtype=np.uint64)
    occurrence[order] = nth.astype(np.uint64)
    return plain, wa.mix64(plain + occurrence * ODD), starts


def sketches_of(words: wa.Words, hashes: np.ndarray, config: NearDedupConfig) -> np.ndarray:
    """One row of entries (int64) per text; texts without words get zeros."""
    plain, labelled, starts = labelled_shingles(words, hashes, config.shingle)
    factors = wa.mix64(np.arange(1, config.entries + 1, dtype=np.uint64) * ODD + np.uint64(config.seed)) | np.uint64(1)
    out = np.zeros((len(starts) - 1, config.entries), dtype=np.uint64)
    step = max(1, config.entries)
    for i in range(len(starts) - 1):
        own, shown = labelled[starts[i] : starts[i + 1]], plain[starts[i] : starts[i + 1]]
        if not len(own):
            continue
        part = step if len(own) < 100_000 else 1  # bounds the memory of very long texts
        for s in range(0, config.entries, part):
            hashed = own[None, :] * factors[s : s + part, None]  # the shingles' hashes are mixed well already
            rows, places = np.arange(len(hashed)), []
            for _ in range(min(config.picks, len(own))):
                best = hashed.argmin(axis=1)
                places.append(best)
                hashed[rows, best] = LARGEST
            entry = np.zeros(len(hashed), dtype=np.uint64)
            for place in np.sort(np.stack(places), axis=0):
                entry = wa.mix64(entry * ODD + shown[place])
            out[i, s : s + part] = entry
    return out.view(np.int64)


def sketch(documents: DataFrame, config: NearDedupConfig) -> DataFrame:
    """(doc_id, digest, entries, n_words, bins): digest is null for null texts, entries for null texts and those without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in wa.slices(batch, ["text"], 3 << 20):
                words = wa.split_words(wa.texts_of(piece, "text"))
                hashes = word_hashes(words)
                entries = sketches_of(words, hashes, config)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(entries) + 1, dtype=np.int32) * config.entries), pa.array(entries.ravel()))
                flat = pc.if_else(pa.array(words.lengths > 0), flat, pa.scalar(None, flat.type))
                bins = pa.array([row.tobytes() for row in word_bins(words, hashes, config.bins)], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("digest"), flat, pa.array(words.lengths, pa.int64()), bins], names=names)
        wa.give_back()

    names = ["doc_id", "digest", "entries", "n_words", "bins"]
    fields = [documents.schema["doc_id"], T.StructField("digest", T.BinaryType()), T.StructField("entries", T.ArrayType(T.LongType())), T.StructField("n_words", T.LongType()), T.StructField("bins", T.BinaryType())]
    return documents.select("doc_id", "text", digest_of("text").alias("digest")).mapInArrow(run, T.StructType(fields))


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def verify(pairs: DataFrame, texts: DataFrame, config: NearDedupConfig) -> DataFrame:
    """The pairs (leader, member) that are similar. ``texts`` has (node, text), once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in wa.slices(batch, ["_left", "_right"]):
                kept, last, words = [], None, []
                for a, b in zip(piece.column("_left").to_pylist(), piece.column("_right").to_pylist(), strict=True):
                    if a != last:  # the pairs of a leader follow one another
                        last, words = a, alignment.words_of(a)
                    kept.append(alignment.similar_words(words, alignment.words_of(b), config.similarity))
                yield pa.RecordBatch.from_arrays([piece.column("leader"), piece.column("member")], names=["leader", "member"]).filter(pa.array(kept, pa.bool_()))
        wa.give_back()

    joined = pairs.join(texts.select(F.col("node").alias("member"), F.col("text").alias("_right")), "member")
    joined = joined.join(texts.select(F.col("node").alias("leader"), F.col("text").alias("_left")), "leader")
    return joined.select("leader", "member", "_left", "_right").mapInArrow(run, "leader long, member long")


def shared_buckets(sketches: DataFrame) -> DataFrame:
    """(bucket, band, member, n_words, n): the members of the buckets that have ``n`` of them, 2 or more."""
    rows = sketches.where("entries IS NOT NULL").select(F.col("node").alias("member"), F.col("n_words").cast("int").alias("n_words"), F.posexplode("entries").alias("band", "entry"))
    rows = rows.select(F.xxhash64("band", "entry").alias("bucket"), F.col("band").cast("short").alias("band"), "member", "n_words")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialize(rows.join(sizes, "bucket").select("bucket", "band", "member", "n_words", "n"), "near-buckets")


def led_pairs(rows: DataFrame, config: NearDedupConfig) -> DataFrame:
    """(leader, member), ``leaders`` of each member at most: those of its buckets' leaders that meet most texts.

    The leader of a bucket is the member that has most neighbours over all its buckets.
    """
    rows = rows.where(F.col("band") < config.led)
    met = rows.groupBy("member").agg(F.sum("n").alias("met"))
    ranked = materialize(rows.join(met, "member").select("bucket", "band", "member", "met"), "near-ranked")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("met", -F.col("member"))).alias("m")).select("bucket", (-F.col("m.col2")).alias("leader"), F.col("m.met").alias("leads"))
    led = ranked.join(leaders, "bucket").where("member <> leader").groupBy("member", (F.col("band") % config.leaders).alias("part")).agg(F.max(F.struct("leads", -F.col("leader"))).alias("m"))
    return led.select((-F.col("m.col2")).alias("leader"), "member").distinct()


def _steps(rows: DataFrame, config: NearDedupConfig) -> Column:
    """Lengths by steps of the factor that lengths of similar texts may differ by."""
    return F.floor(F.log("n_words") / (1.0001 * -math.log(config.similarity))).cast("int")


def strayed_pairs(rows: DataFrame, labels: DataFrame, config: NearDedupConfig) -> DataFrame:
    """(leader, member), ``second`` of each member at most: members whose class is not that of a leader taken by hash, of all buckets and of like length.

    Few members of a group of copies differ from all leaders that met most; other members are likely to link them.
    """
    named = labels.select(F.col("node").alias("member"), F.col("label").alias("class"))
    rows = rows.join(named, "member", "left").select("bucket", "band", "member", _steps(rows, config).alias("step"), F.coalesce("class", "member").alias("class"))
    rows = materialize(rows, "near-strayed")
    taken = F.max(F.struct(F.xxhash64("member", "bucket").alias("h"), F.col("member").alias("leader"), F.col("class").alias("leads"))).alias("m")
    chosen = rows.groupBy("bucket", "step").agg(taken, F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most")
    met = rows.join(chosen.select("bucket", "step", "m.*"), ["bucket", "step"]).where(F.col("class") != F.col("leads"))
    kept = met.groupBy("member", (F.col("band") % config.second).alias("part")).agg(F.max(F.struct("h", "leader")).alias("m"))
    return kept.select(F.col("m.leader").alias("leader"), "member").distinct()


def near_enough(classes: np.ndarray, lengths: np.ndarray, low: np.ndarray, bins: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (p of ``left``, q of ``right``) of different classes whose distance may be within the limit; each once if the sides are the same.

    Texts differ by as many edits as the words that one has more of, bin by bin. Products of the counts' roots, which
    are no less than the words in common, exclude most pairs at once; the rest is counted. Pairs of two ``low`` texts
    are another group's.
    """
    found, same = [], left is right
    roots, totals = np.sqrt(bins[right], dtype=np.float32), bins.sum(axis=1, dtype=np.int64)
    for start in range(0, len(left), 128):
        p = left[start : start + 128]
        longest = np.maximum(lengths[p][:, None], lengths[right][None, :])
        limit = ((1 - least) * longest + 1e-9).astype(np.int64)
        fits = (classes[p][:, None] != classes[right][None, :]) & (np.abs(lengths[p][:, None] - lengths[right][None, :]) <= limit) & ~(low[p][:, None] & low[right][None, :])
        if same:
            fits &= np.arange(start, start + len(p))[:, None] < np.arange(len(right))[None, :]
        common = np.sqrt(bins[p], dtype=np.float32) @ roots.T
        fits &= np.maximum(totals[p][:, None], totals[right][None, :]) - common <= limit + 0.01 + 1e-5 * longest
        i, j = np.nonzero(fits)
        for k in range(0, len(i), 4096):
            own, other, most = p[i[k : k + 4096]], right[j[k : k + 4096]], limit[i[k : k + 4096], j[k : k + 4096]]
            shared = np.minimum(bins[own], bins[other]).sum(axis=1, dtype=np.int64)
            near = np.maximum(totals[own], totals[other]) - shared <= most
            found.append((own[near], other[near]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def apart_pairs(rows: DataFrame, labels: DataFrame, sketches: DataFrame, config: NearDedupConfig) -> DataFrame:
    """(leader, member): all pairs of a bucket of ``rows`` (bucket, band, member, n_words, and optionally n, its size) whose classes differ, less those that are certainly not similar.

    A pair comes from the first entry that it has in common, once.

    A bucket of a shard's members is one group. Lengths of similar texts differ by a factor of ``similarity`` at most,
    so a bigger bucket falls into groups by steps of that factor: a text meets those of its own step, and as a ``low``
    one those of the next. A member takes along its words' counts and the names of its own groups' buckets.
    """
    named = labels.select(F.col("node").alias("member"), F.col("label").alias("class"))
    if "n" not in rows.columns:
        rows = rows.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket")
    rows = materialize(rows.join(named, "member", "left").select("bucket", "band", "member", "n_words", "n", F.coalesce("class", "member").alias("class")), "near-apart")
    big, cells = F.col("n") > config.shard, F.ceil(F.col("n") / config.shard).cast("int")  # cells hold about a shard's members of the bucket, fewer of a group
    step = F.when(big, _steps(rows, config)).otherwise(0)
    rows = rows.select("bucket", "band", "member", "class", "n_words", step.alias("own"), F.explode(F.when(big, F.array(step, step + 1)).otherwise(F.array(step))).alias("step"), cells.alias("cells"), F.pmod(F.xxhash64("member"), cells).cast("int").alias("cell"))
    rows = rows.withColumn("low", F.col("own") < F.col("step"))
    by = ["bucket", "step"]
    held = F.collect_list(F.struct("member", "class", "n_words", "low")).alias("held")
    parts = rows.groupBy(*by, "band", "cells", "cell").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.min("low").alias("only_low"), F.count(F.lit(1)).alias("n"), held)
    mixed = parts.groupBy(*by).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("only_low").alias("only_low"), F.sum("n").alias("n")).where("least <> most AND NOT only_low")
    rows = parts.drop("n").join(mixed.select(*by, F.ceil(F.col("n") / config.shard).cast("int").alias("shards")), by)
    rows = rows.select(*by, "band", "shards", F.floor(F.col("cell") * F.col("shards") / F.col("cells")).cast("int").alias("shard"), F.inline("held"))
    # a member is in two groups for each entry at most; in those alone can it share an entry with another class
    rows = rows.groupBy("member", "class", "n_words").agg(F.collect_list(F.struct(*by, "band", "shards", "shard", "low")).alias("places"))
    rows = rows.join(sketches.select(F.col("node").alias("member"), "bins"), "member")
    rows = rows.select("member", "class", "n_words", "bins", F.col("places.band").alias("bands"), F.col("places.bucket").alias("buckets"), F.inline("places"))
    alone = F.when(F.col("shards") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("shards") - 1))
    rows = rows.withColumn("other", F.explode(alone))
    block = [*by, "band", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j")]
    held = F.struct("member", "class", "n_words", "low", "shard", "bins", "bands", "buckets")
    blocks = rows.select(*block, held.alias("held")).groupBy(*by, "band", "i", "j").agg(F.collect_list("held").alias("held"), F.count(F.lit(1)).alias("n")).where("n > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a block at a time
                i, j, band = (batch.column(c)[row].as_py() for c in ("i", "j", "band"))
                held = batch.column("held")[row].values
                member, classes, lengths, shard = (held.field(c).to_numpy() for c in ("member", "class", "n_words", "shard"))
                low = held.field("low").to_numpy(zero_copy_only=False)
                bins = np.frombuffer(b"".join(held.field("bins").to_pylist()), dtype=np.uint8).reshape(-1, config.bins)
                left = np.flatnonzero(shard == i)
                right = left if i == j else np.flatnonzero(shard == j)
                p, q = near_enough(classes, lengths.astype(np.int64), low, bins, left, right, config.similarity)
                at = np.repeat(np.arange(len(member)), held.field("bands").value_lengths().to_numpy()), held.field("bands").flatten().to_numpy()
                known, buckets = np.zeros((len(member), config.entries), bool), np.zeros((len(member), config.entries), np.int64)
                known[at], buckets[at] = True, held.field("buckets").flatten().to_numpy()
                shared = lambda a, b: known[a] & known[b] & (buckets[a] == buckets[b])  # noqa: B023, E731
                first = np.concatenate([np.empty(0, bool), *(shared(p[k : k + 4096], q[k : k + 4096]).argmax(axis=1) == band for k in range(0, len(p), 4096))])
                p, q = p[first], q[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(member[p], member[q])), pa.array(np.maximum(member[p], member[q]))], names=["leader", "member"])
        wa.give_back()

    return blocks.select("band", "i", "j", "held").mapInArrow(run, "leader long, member long")


def similar_pairs(wanted_texts: Callable[[DataFrame], DataFrame], sketches: DataFrame, joined: DataFrame, config: NearDedupConfig) -> tuple[DataFrame, DataFrame]:
    """(links, labels) between different texts. ``sketches`` has each text once, and is materialized.

    links has (leader, member), verified; labels has (node, label) of what links and ``joined`` (a, b) connect.
    ``wanted_texts`` gives (node, text) of some nodes.
    """
    rows = shared_buckets(sketches)
    texts = materialize(wanted_texts(rows.select(F.col("member").alias("node")).distinct()), "near-texts")
    ordered = lambda pairs: pairs.select(F.least("leader", "member").alias("leader"), F.greatest("leader", "member").alias("member"))
    links, edges, labels, tried = None, joined, None, None
    for choose in (lambda: led_pairs(rows, config), lambda: strayed_pairs(rows, labels, config), lambda: apart_pairs(rows, labels, sketches, config)):
        pairs = ordered(choose()).distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["leader", "member"], "left_anti"), "near-pairs")
        if labels is not None and not pairs.limit(1).count():
            continue
        found = materialize(verify(pairs, texts, config), "near-links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        edges = edges.union(found.select("leader", "member"))
        labels = components(edges)
    return links, labels


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of the connected component of every node that ``edges`` (a, b) name.

    Labels pass along edges and to the labels' own labels until none changes; each round is one written table.
    """
    edges = materialize(edges.union(edges.select("b", "a")), "near-edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("label")), "near-labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        jumped = labels.select(F.col("a").alias("label"), F.col("label").alias("jump"))
        after = labels.join(heard, "a", "left").join(jumped, "label", "left")
        least = F.least("label", F.coalesce("heard", "label"), F.coalesce("jump", "label"))
        after = materialize(after.select("a", least.alias("label"), (least < F.col("label")).alias("changed")), "near-labels")
        labels = after.select("a", "label")
        if not after.where("changed").limit(1).count():
            return labels.withColumnRenamed("a", "node")


def near_classes(documents: DataFrame, config: NearDedupConfig = NearDedupConfig()) -> DataFrame:
    """(doc_id, class_id, n_links) of every row of ``documents`` (doc_id, text).

    A node is a distinct text. class_id is the least doc_id of the class; n_links counts the verified links of the
    document's texts with others.
    """
    documents = documents.select("doc_id", "text")
    made = materialize(sketch(documents, config).withColumn("row", F.monotonically_increasing_id()), "near-sketches")
    known = made.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    firsts = materialize(known.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id")), "near-firsts")
    members = materialize(known.select("doc_id", "digest").join(firsts, "digest").select("doc_id", "node", "first_id").distinct(), "near-members")
    distinct = materialize(known.join(firsts.select("node"), F.col("row") == F.col("node")).select("node", "entries", "n_words", "bins"), "near-distinct")

    def wanted_texts(nodes: DataFrame) -> DataFrame:
        places = nodes.join(firsts, "node").withColumnRenamed("first_id", "doc_id")
        return documents.withColumn("digest", digest_of("text")).join(places, ["digest", "doc_id"]).select("node", "text").dropDuplicates(["node"])

    several = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    joined = members.join(several, "doc_id").where("node > a").select("a", F.col("node").alias("b"))
    links, labels = similar_pairs(wanted_texts, distinct, materialize(joined, "near-joined"), config)
    named = materialize(labels.join(firsts, "node").select("node", "label", "first_id"), "near-named")
    classes = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    ends = links.select(F.col("leader").alias("node")).unionAll(links.select("member")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    of_node = materialize(named.join(classes, "label").join(ends, "node", "left").select("node", "class_id", "n_links"), "near-classes")
    of_doc = members.join(of_node, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("class_id", "first_id")).alias("class_id"), F.sum("n_links").alias("n_links"))
    return made.select("doc_id").join(of_doc, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(documents: DataFrame, config: NearDedupConfig = NearDedupConfig()) -> DataFrame:
    """``documents`` less those that are in the class of a lesser id; of rows that share an id, all stay."""
    other = free_name(documents, "_gone")
    gone = near_classes(documents, config).where("class_id < doc_id").select(F.col("doc_id").alias(other)).distinct()
    return documents.join(gone, F.col("doc_id") == F.col(other), "left_anti")
