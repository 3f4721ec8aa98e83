"""The Merkle manifest against a plain tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracklight.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows, fan):
    """rows: (source, id, leaf, shown). Per row: (subroot, root, proof, folded)."""

    def build(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][k : k + fan]) for k in range(0, len(out[-1]), fan)])
        return out

    key = lambda s: (s is not None, (s or "").encode())
    sources = sorted({r[0] for r in rows}, key=key)
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[s] = (own, build([r[2] for r in own]))
    top = build([trees[s][1][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for i, row in enumerate(trees[s][0]):
            proof, digest = "", row[3]
            for made, place in ((trees[s][1], i), (top, n)):
                for level in made[:-1]:
                    at = place // fan * fan
                    before, after = "".join(level[at:place]), "".join(level[place + 1 : at + fan])
                    proof, digest, place = proof + before + after, H(before, digest, after), place // fan
            out.append((s, row[1], row[2], trees[s][1][-1][0], top[-1][0], H(proof), digest, digest == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan, levels", [(3, 2), (2, 3), (3, 7)])
def test_manifest_is_that_of_a_plain_tree(spark, fan, levels):
    rng = random.Random(fan)
    sizes = {"é": 1, "": 2, None: 3, "hot": 120, "z": 28, "a": 9, "b": 10}
    rows = []
    for s, n in sizes.items():
        for i in range(n):
            leaf = H(str(s), str(i))
            rows.append((s, i if i else None, leaf, H("other") if rng.random() < 0.2 else leaf))
    rows += [rows[-1]] * 4 + [("hot", 5, H("same id"), H("same id"))]  # repeated rows, and an id of two rows
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string, shown string")
    df = df.withColumns({"root": F.lit("replaced"), "_id": F.lit(1), "n": F.lit(2), "digest": F.col("doc_id")})
    got = merkle.manifest(df, shown="shown", config=merkle.MerkleConfig(fan, levels)).collect()
    assert sorted(((r.source, r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str) == plain(rows, fan)
    assert {(r["_id"], r.n) for r in got} == {(1, 2)} and all(r.digest == r.doc_id for r in got)


def test_empty_and_single(spark):
    schema = "source string, doc_id long, leaf string"
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(None, None, H("x"))], schema)).first()
    assert (one.subroot, one.root, one.proof_sha256, one.verified) == (H("x"), H("x"), H(""), True)


def test_row_digest_covers_nulls_and_long_texts(spark):
    text = "ä\n" * 400_000
    df = spark.createDataFrame([(1, None, text), (None, "", "-")], "doc_id long, source string, text string")
    got = {r.d for r in df.select(merkle.row_digest(F.col("doc_id"), F.col("source"), F.col("text")).alias("d")).collect()}
    assert got == {H("1:1", "-", f"{3 * 400_000}:", text), H("-", "0:", "1:-")}
