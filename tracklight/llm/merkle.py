"""Merkle manifest of a table: a digest per row, a tree per source, one root over all of them, proofs for rows.

Trees are built by time-forward processing. Nodes carry labels (level, place); a queue ordered by label hands every
node the digests of its children, the node hashes them and sends the result on to its parent. The sweep back runs
in the opposite order: a node gets the path from itself to the root, and sends each child that path with the
child's siblings before it, until the leaves have theirs.

The queue is external: leaves are numbered along their source, and a block of ``fan ** block_levels`` of them in a row
is one message box. Spark's sorted shuffle brings a box's messages together, spilling where it must; inside a box a
heap of bounded size keeps the order of the labels. A block's top is a leaf of the next tier, so a source of n rows
takes log(n) / (block_levels log(fan)) tiers, however large its share of the table is; a tier's result is written, so
lost executors cost a tier's tasks at most. The driver sees one number per tier.

Defined results: a row's digest covers the columns given, each as byte count, colon and value, null as ``-``; rows
of a source are ordered by id (null first), equal ids by digest; rows equal in all of it are leaves of their own.
A node of one child is the digest of that child's; a source of one row is that row's digest. Sources are ordered by
their UTF-8 bytes, null first. An empty table has no rows and no root. Other columns, of whatever name, are carried
along.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklight.functions.tables import dense_index
from tracklight.llm.common import materialize


@dataclass(frozen=True)
class MerkleConfig:
    fan: int = 3
    block_levels: int = 7  # 2187 leaves in a block

    @property
    def block(self) -> int:
        return self.fan**self.block_levels


NODES = "_mk_tree long, _mk_at long, _mk_digest string, _mk_n long"
PATH = "array<string>"


def encoded(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def hashed(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(count: int, trees_nodes: int, config: MerkleConfig) -> int:
    """How many levels a block of ``count`` nodes is reduced by, in a tier whose tree has ``trees_nodes`` nodes."""
    if trees_nodes > config.block:
        return config.block_levels
    levels = 0
    while count > 1:
        count, levels = -(-count // config.fan), levels + 1
    return levels


def forward(digests: list[str], levels: int, fan: int) -> list[list[str]]:
    """The digests of every level of a block, from its leaves to its top: the queue hands nodes their children's by label."""
    out = [digests, *[[] for _ in range(levels)]]
    queue = [((1, i // fan), i, d) for i, d in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    while queue:
        label, got = queue[0][0], []
        while queue and queue[0][0] == label:
            got.append(heapq.heappop(queue)[2])
        level, place = label
        made = hashed(got)
        out[level].append(made)
        if level < levels:
            heapq.heappush(queue, ((level + 1, place // fan), place, made))
    return out


def backward(made: list[list[str]], fan: int) -> list[tuple]:
    """For every leaf of a block its path to the block's top, nearest first, as nested pairs ((before, after), rest).

    Labels come in descending order: every node's path is there when its children ask for it.
    """
    top = len(made) - 1
    paths: list = [None] * len(made[0])
    queue = [(-top, -i, ()) for i in range(len(made[top]))]
    heapq.heapify(queue)
    while queue:
        level, place, path = heapq.heappop(queue)
        level, place = -level, -place
        if level == 0:
            paths[place] = path
            continue
        below = made[level - 1][place * fan : (place + 1) * fan]
        for k in range(len(below)):
            step = ("".join(below[:k]), "".join(below[k + 1 :]))
            heapq.heappush(queue, (-(level - 1), -(place * fan + k), (step, path)))
    return paths


def steps(path: tuple) -> list[str]:
    """Before and after of every level, in turn."""
    out = []
    while path:
        out += path[0]
        path = path[1]
    return out


def climb(nodes: DataFrame, config: MerkleConfig) -> list[DataFrame]:
    """The tiers of all trees: the given nodes, then the tops of their blocks, until every tree has one node left.

    Nodes are _mk_tree, _mk_at (their place, from 0 without gaps), _mk_digest, _mk_n (the nodes of their tree).
    """
    tiers = [nodes]
    block, most = config.block, nodes.agg(F.max("_mk_n")).first()[0] or 0

    def top(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_mk_at", kind="stable")
        n = int(group["_mk_n"].iloc[0])
        made = forward(group["_mk_digest"].tolist(), levels_of(len(group), n, config), config.fan)
        return pd.DataFrame({"_mk_tree": [group["_mk_tree"].iloc[0]], "_mk_at": [int(group["_mk_at"].iloc[0]) // block], "_mk_digest": made[-1], "_mk_n": [-(-n // block)]})

    while most > 1:
        blocks = tiers[-1].select("_mk_tree", "_mk_at", "_mk_digest", "_mk_n").groupBy("_mk_tree", F.floor(F.col("_mk_at") / block))
        tiers.append(materialize(blocks.applyInPandas(top, NODES), "merkle-tier"))
        most = -(-most // block)
    return tiers


def _descend(nodes: DataFrame, above: DataFrame, added: dict, config: MerkleConfig, finish) -> DataFrame:
    """``nodes`` with the columns ``added`` (name to type), which ``finish(rows, paths)`` gives as lists.

    ``above`` has the path of every block's top: _mk_tree, _mk_block, _mk_path (before and after of every level, in
    turn). A path is shuffled once per block, not once per node.
    """
    block, names = config.block, nodes.columns
    keyed = nodes.withColumn("_mk_block", F.floor(F.col("_mk_at") / block))

    def run(group: pa.Table, top: pa.Table) -> pa.Table:
        group = group.sort_by("_mk_at")
        rest = top.column("_mk_path")[0].as_py()
        digests = group.column("_mk_digest").to_pylist()
        made = forward(digests, levels_of(len(digests), group.column("_mk_n")[0].as_py(), config), config.fan)
        group = group.select(names)
        for (name, kind), values in zip(added.items(), finish(group, [steps(p) + rest for p in backward(made, config.fan)]), strict=True):
            group = group.append_column(name, pa.array(values, pa.list_(pa.string()) if kind == PATH else pa.string()))
        return group

    schema = T.StructType([*nodes.schema.fields, *[T.StructField(n, T.ArrayType(T.StringType()) if k == PATH else T.StringType()) for n, k in added.items()]])
    return keyed.groupBy("_mk_tree", "_mk_block").cogroup(above.groupBy("_mk_tree", "_mk_block")).applyInArrow(run, schema)


def _proofs(rows: pa.Table, paths: list) -> tuple[list, list]:
    proofs, folded = [], []
    for path, digest in zip(paths, rows.column("_mk_shown").to_pylist(), strict=True):
        proofs.append(hashed(path))
        for k in range(0, len(path), 2):
            digest = hashed((path[k], digest, path[k + 1]))
        folded.append(digest)
    return proofs, folded


def paths_of(tiers: list[DataFrame], above: DataFrame, config: MerkleConfig) -> DataFrame:
    """(_mk_tree, _mk_block, _mk_path) for the blocks of the lowest tier, from the paths of the trees' roots."""
    for tier in reversed(tiers[1:]):
        found = _descend(tier.select("_mk_tree", "_mk_at", "_mk_digest", "_mk_n"), above, {"_mk_path": PATH}, config, lambda rows, paths: (paths,))
        above = materialize(found.select("_mk_tree", F.col("_mk_at").alias("_mk_block"), "_mk_path"), "merkle-paths")
    return above


def number_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with _mk_tree, _mk_at, _mk_n; a row per source with _mk_tree, its place among the sources, and _mk_n).

    Leaves are _mk_kept, _mk_source, _mk_order, _mk_digest, _mk_shown.
    """
    spread = leaves.withColumn("_mk_row", F.monotonically_increasing_id())  # rows that are alike still go to several ranges
    order = [F.col("_mk_source").asc_nulls_first(), F.col("_mk_order").asc_nulls_first(), F.col("_mk_digest"), F.col("_mk_row")]
    placed = materialize(dense_index(spread, order, "_mk_place"), "merkle-leaves")
    per = placed.groupBy(F.col("_mk_source").alias("_mk_name")).agg(F.min("_mk_place").alias("_mk_first"), F.count(F.lit(1)).alias("_mk_n"))
    sources = materialize(dense_index(per, [F.col("_mk_first")], "_mk_tree"), "merkle-sources")
    found = placed.join(sources, F.col("_mk_source").eqNullSafe(F.col("_mk_name")))
    at = (F.col("_mk_place") - F.col("_mk_first")).alias("_mk_at")
    return found.select("_mk_kept", "_mk_digest", "_mk_shown", "_mk_tree", at, "_mk_n"), sources


def manifest(leaves: DataFrame, digest: str = "leaf", shown: str | None = None, source: str = "source", order: str = "doc_id", config: MerkleConfig = MerkleConfig()) -> DataFrame:
    """``leaves`` with subroot, root, proof_sha256, folded_root and verified.

    ``proof_sha256`` is the digest of the siblings' digests on the way to the root, level by level, left to right.
    ``folded_root`` starts from the digest in the column ``shown``, that of the row as it is found now (by default
    the leaf itself), and climbs with the siblings of the manifest; ``verified`` says whether it is the root. Columns
    of these names are replaced.
    """
    added = ("subroot", "root", "proof_sha256", "folded_root", "verified")
    kept = F.struct(*[F.col(c) for c in leaves.columns if c not in added])
    named = leaves.select(kept.alias("_mk_kept"), F.col(source).alias("_mk_source"), F.col(order).alias("_mk_order"), F.col(digest).alias("_mk_digest"), F.col(shown or digest).alias("_mk_shown"))
    numbered, sources = number_leaves(named)
    numbered = materialize(numbered, "merkle-numbered")
    tiers = climb(numbered, config)
    subroots = materialize(tiers[-1].select("_mk_tree", F.col("_mk_digest").alias("subroot")), "merkle-subroots")
    count = sources.agg(F.count(F.lit(1)).alias("_mk_n"))
    trunk = subroots.join(F.broadcast(count)).select(F.lit(0).cast("long").alias("_mk_tree"), F.col("_mk_tree").alias("_mk_at"), F.col("subroot").alias("_mk_digest"), "_mk_n")  # one row
    upper = climb(materialize(trunk, "merkle-trunk"), config)
    root = materialize(upper[-1].select(F.col("_mk_digest").alias("root")), "merkle-root")
    start = lambda df, tree: df.select(tree.alias("_mk_tree"), F.lit(0).cast("long").alias("_mk_block"), F.array().cast(PATH).alias("_mk_path"))
    above = paths_of([upper[0], *upper], start(root, F.lit(0).cast("long")), config)
    above = above.select(F.col("_mk_block").alias("_mk_tree"), F.lit(0).cast("long").alias("_mk_block"), "_mk_path")
    below = paths_of(tiers, above, config)
    proven = _descend(numbered, below, {"_mk_proof": "string", "_mk_folded": "string"}, config, _proofs)
    found = proven.join(subroots, "_mk_tree").join(F.broadcast(root))  # one row
    return found.select("_mk_kept.*", "subroot", "root", F.col("_mk_proof").alias("proof_sha256"), F.col("_mk_folded").alias("folded_root"), (F.col("_mk_folded") == F.col("root")).alias("verified"))
