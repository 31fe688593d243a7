import hashlib
import random
import re
from collections import defaultdict

import pytest

from logtide.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from logtide.llm.mixing import apply_mix, mix_sources

EDGE = [(1, "a b"), (2, "ab"), (3, " a\tb\n "), (4, None), (5, ""), (6, " \n"), (7, "long " * 4000), (8, "long " * 4000), (9, "a b"), (None, "ab"), (2, "ab")]


def brute_dedup(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, k))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            i = rows[m[3]][0]
            out.append((i, rows[best[3]][0], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("runs", [1, 7, 512])
def test_exact_duplicates(make_docs, runs):
    got = exact_duplicates(make_docs(EDGE).repartition(3), runs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(brute_dedup(EDGE), key=key)
    for sha in {r["text_sha256"] for r in got}:
        assert sum(r["kept"] for r in got if r["text_sha256"] == sha) == 1


def test_drop_keeps_columns_and_one_of_repeats(make_docs):
    docs = make_docs(EDGE)
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r[0], r[1]) for r in out.collect()) == [(3, " a\tb\n "), (6, " \n"), (7, "long " * 4000), (9, "a b")]


def test_empty(make_docs):
    docs = make_docs([])
    assert exact_duplicates(docs).count() == 0 and drop_exact_duplicates(docs).count() == 0
    assert mix_sources(docs).count() == 0 and apply_mix(docs).count() == 0


def targets_by_rounds(sizes, weights, share, ceiling):
    """Repeated sharing, as stated: cap, share the excess by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        pot = total - sum(capped.values())
        want = {s: pot * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if want[s] > ceiling * sizes[s]]
        if not over:
            return {**capped, **want}
        capped |= {s: ceiling * sizes[s] for s in over}


def test_mix_targets_and_budgets(make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", None, "hot", "hot", "hot", "Z", "é"])) for i in range(900)]
    rows += [(900, None, "a"), (901, "x " * 5000, "b"), (902, "", "empty"), (5, "same id again", "a")]
    got = mix_sources(make_docs(rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets_by_rounds(sizes, (3, 1, 2), 1.5, 2.0)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(0 <= want[s] - taken[s] < 1 for s in want)
    # Full epochs first, then a prefix in key order with one cut document at most.
    for s in want:
        part = [r for r in sorted((r for r in got if r["source"] == s and r["size"]), key=lambda r: (r["sample_key"], r["doc_id"], r["size"]))]
        fractions = [(r["taken"] - r["epochs"] * r["size"]) / r["size"] for r in part]
        assert fractions == sorted(fractions, reverse=True) and sum(0 < f < 1 for f in fractions) <= 1
    assert sorted(map(tuple, mix_sources(make_docs(rows).repartition(5)).select("doc_id", "size", "taken").collect()), key=str) == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=str)


def test_apply_mix_gives_the_words(make_docs):
    rows = [(i, f" a{i}  b{i}\nc{i} ", "s" if i % 3 else "t") for i in range(60)] + [(60, None, "s")]
    docs = make_docs(rows)
    out = apply_mix(docs)
    assert out.columns == docs.columns
    n = sum(len((t or "").split()) for t in (r[1] for r in out.collect()))
    assert n == sum(r["taken"] for r in mix_sources(docs).collect())
