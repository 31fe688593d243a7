import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.llm.cover_lce import COVERS, CoverLCE
from logtide.llm.periodic_runs import find_runs, periodic_runs, strongest


def brute(w, least=6):
    n, best = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 4 * p):
                best.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in best.items())


def hard_texts(rng):
    yield from ([], [1], [1] * 5, [1] * 6, [1, 2] * 4, [1, 2] * 4 + [1], [1, 2, 3] * 4, [1] * 40 + [2] * 40, [1, 1, 2] * 9 + [1, 1, 1] * 9)
    for _ in range(150):
        base = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 12))]
        text = [rng.randrange(4) for _ in range(rng.randrange(30))] + (base * 20)[: rng.randrange(1, 140)]
        yield text + [rng.randrange(2) for _ in range(rng.randrange(60))]


@pytest.mark.parametrize("v", sorted(COVERS))
def test_extensions(v):
    rng = np.random.default_rng(v)
    pairs = {(a - b) % v for a in COVERS[v] for b in COVERS[v]}
    assert pairs == set(range(v))
    for k in (1, 2, 9, 60, 400):
        words = np.append(rng.integers(0, 2, k), 7)
        words[: k // 2] = 1
        lce = CoverLCE(words, v)
        i, j = np.triu_indices(len(words), 1)
        want = [next((t for t in range(len(words)) if b + t >= len(words) or words[a + t] != words[b + t])) for a, b in zip(i, j)]
        assert lce(i, j).tolist() == want


@pytest.mark.parametrize("flush", [1, 50, 1 << 20])
def test_runs_match_brute_force(flush):
    texts = list(hard_texts(random.Random(2)))
    words = np.array([x for t in texts for x in t], np.int64)
    owner, *run = find_runs(words, np.array([len(t) for t in texts]), flush=flush)
    for k, text in enumerate(texts):
        assert list(zip(*[x[owner == k].tolist() for x in run])) == brute(text), text


def test_operator(spark, make_docs):
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{x}" for x in t)) for k, t in enumerate(hard_texts(rng))] + [(None, None), (None, "a b c\td"), (3, ""), (3, ""), (9, "x " * 30_000)]
    got = periodic_runs(make_docs(rows)).withColumn("best", strongest(F.col("runs")))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed, tuple(r.best) if r.best else None) for r in got.collect())
    want = []
    for doc_id, text in rows:
        words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        runs = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        want.append((doc_id is None, doc_id or 0, len(words), sorted(runs, key=lambda r: (r[0], r[2])), " ".join(w for i, w in enumerate(words) if i not in gone), best))
    assert got == sorted(want)


def test_empty_table(spark, make_docs):
    assert periodic_runs(make_docs([(1, "a")]).limit(0)).count() == 0
