import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from logtide.llm.merkle import build_manifest, verify_documents

from .conftest import SCHEMA


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    """Expected rows; of one doc_id, leaves go by their digests."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        claim = leaf(doc_id, source, lang, n + 1 if changed and n is not None else n, text)
        groups.setdefault(lang, []).append((doc_id, leaf(doc_id, source, lang, n, text), claim))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {g: tree([r[1] for r in groups[g]]) for g in names}
    top, out = tree([trees[g][-1][0] for g in names]), []
    for k, g in enumerate(names):
        for i, (doc_id, own, claim) in enumerate(groups[g]):
            folded, proof = claim, []
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    beside = level[at ^ 1 : (at ^ 1) + 1]
                    folded = digest(*beside, folded) if at & 1 else digest(folded, *beside)
                    proof += beside
                    at >>= 1
            root = top[-1][0]
            out.append((doc_id, own, trees[g][-1][0], root, digest(*proof), folded, folded == root))
    return sorted(out, key=str)


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    made = [(rng.choice([None, k, k, k]), rng.choice(["", "t\xe9xt", None, f"{k}"]), rng.choice(langs), rng.choice(["s", None]), rng.choice([None, k])) for k in range(n)]
    return made + made[:3]


def changed():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


@pytest.mark.parametrize("n, langs, stride", [(1, ["en"], 8), (40, [None, "de", "en", "\xe9"], 1), (300, ["en", "en", "en", "fr"], 2), (600, ["en", None], 8), (2500, ["en"], 10), (30, [f"l{k}" for k in range(20)], 2)])
def test_matches_brute_force(spark, n, langs, stride):
    rows = rows_of(n, langs)
    docs = spark.createDataFrame(rows, SCHEMA)
    names = [*docs.columns, "Text", "start", "at", "tree"]
    docs = docs.selectExpr("*", "1 AS a1", "2 AS a2", "3 AS a3", "4 AS a4").toDF(*names).repartition(3)
    got = sorted((tuple(r) for r in verify_documents(docs, changed(), stride).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_long(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert verify_documents(none, changed()).count() == 0
    rows = [(7, "x" * 3_000_000, "en", "s", 3_000_000), (8, "y", "en", "s", 1)]
    assert sorted((tuple(r) for r in verify_documents(spark.createDataFrame(rows, SCHEMA), changed()).collect()), key=str) == brute(rows)


def test_many_groups_and_upper_nodes_join_without_broadcast(spark):
    rows = [(k, f"{k}", f"l{k % 9}", "s", k) for k in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "lang", F.unhex(F.sha2("text", 256)).alias("digest"), F.unhex(F.sha2("text", 256)).alias("start"))
    few, many = (build_manifest(docs, "lang", "doc_id", stride=2, few=n) for n in (0, 1000))
    assert few.nodes.exceptAll(many.nodes).count() == 0 and few.nodes.count() == many.nodes.count() > 200
    # No upper node row is met by more than 2**stride leaves.
    below = few.leaves.groupBy("tree", "block").count()
    assert below.agg(F.max("count")).first()[0] <= 4
    assert few.nodes.filter("step > 0").groupBy("step", "tree", "at").count().filter("count > 1").count() == 0
