"""Merkle manifests against trees built in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sievework.llm.merkle import folded, hexed, merkle_manifest, proof_digest

FIELDS = ("doc_id", "source", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests, fan_out):
    """The root, and per leaf the other digests of its runs from below."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = range(i - i % fan_out, min(len(level), i - i % fan_out + fan_out))
            proofs[leaf] += [level[j] for j in run if j != i]
        level = [h(*level[i : i + fan_out]) for i in range(0, len(level), fan_out)]
        at = [i // fan_out for i in at]
    return level[0], proofs


def brute(rows, fan_out):
    """A line per row: id, leaf, subroot, root, digest of the proof."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {}
    for g in order:
        leaves = sorted(((r["doc_id"] is None, r["doc_id"] or 0, h(*[enc(r[f]) for f in FIELDS])) for r in groups[g]))
        found[g] = leaves, *tree([x[2] for x in leaves], fan_out)
    root, upper = tree([found[g][1] for g in order], fan_out)
    return root, sorted(
        (str(None if missing else doc), leaf, found[g][1], root, h(*proof, *upper[k]))
        for k, g in enumerate(order) for (missing, doc, leaf), proof in zip(found[g][0], found[g][2])
    )


@pytest.fixture(scope="module")
def rows(spark, documents, odd):
    made = documents.select("doc_id", "source", "lang", "text").limit(45)
    strange = odd.select("doc_id", "source", F.when(F.col("doc_id") > 3, F.lit("ü")).alias("lang"), "text")
    lone = spark.createDataFrame([(77, None, "only", "")], "doc_id long, source string, lang string, text string")
    return made.unionByName(strange).unionByName(lone).withColumn("tree", F.lit("clash")).withColumn("index", F.lit(1)).withColumn("key", F.lit("k"))


@pytest.mark.parametrize("fan_out", [2, 3])
def test_manifest(rows, fan_out):
    root, want = brute(rows.collect(), fan_out)
    changed = {"text": F.when(F.col("doc_id") == 77, F.lit("tampered")).otherwise(F.col("text"))}
    made = merkle_manifest(rows, FIELDS, "doc_id", "lang", changed, fan_out)
    made = made.withColumn("proof", proof_digest(F.col("path"))).withColumn("again", hexed(folded(F.col("altered"), F.col("path"))))
    got = made.collect()
    assert sorted((str(r["key"]), r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == want
    assert all((r["again"] == root) == (r["key"] != 77) for r in got)
    assert any(r["key"] == 77 and r["subroot"] == r["leaf"] for r in got)


def test_one_row_and_none(rows, empty):
    one = merkle_manifest(rows.filter("doc_id = 77"), FIELDS, "doc_id", "lang").collect()
    assert [(r["leaf"], r["subroot"], r["path"]) for r in one] == [(r["root"], r["root"], []) for r in one] and len(one) == 1
    none = merkle_manifest(rows.limit(0), FIELDS, "doc_id", "lang")
    assert none.count() == 0 and none.columns == ["key", "leaf", "subroot", "root", "altered", "path"]
