import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from logtide.llm.classifier import FactorisationMachine, features, fit_quality_model, score_quality
from logtide.llm.ngram_join import drop_near_duplicates, ngram_components, shingles
from logtide.llm.quality_rules import quality_rules


def brute_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        k = min(n, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and both * den >= (len(sets[a]) + len(sets[b]) - both) * num:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, words, copies, edits):
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_ngram_components(make_docs, n, num, den):
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(40)]
    texts = []
    for k in range(12):
        base = [f"w{k}_{j % 37}" for j in range(rng.randrange(20, 160))]
        texts += list(family(rng, base, 12, 6))
    texts += [" ".join(passage + [f"u{k}{j}" for j in range(rng.randrange(0, 8))]) for k in range(40)]
    # A chain: each differs a little from the one before.
    chain = [f"c{j}" for j in range(120)]
    for k in range(15):
        chain[k * 8] = f"x{k}"
        texts.append(" ".join(chain))
    texts += ["", None, "One", "one", "a b", "A  B", "a b c", "É a b", "é a b", "long word " * 3000, "LONG word " * 3000, " "]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_components(rows, n, num, den)
    got = ngram_components(make_docs(rows).repartition(5), n, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    kept = drop_near_duplicates(make_docs(rows), n=n, num=num, den=den)
    assert {r[0] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_ngram_crowded_passages(make_docs):
    """A passage that many unlinked documents share; the order changes, the links do not."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(2))
    passage = " ".join(word() for _ in range(12))
    texts = [" ".join(word() for _ in range(rng.randrange(10, 60))) + " " + passage for _ in range(50)]
    texts += [t.replace("ab", "zz", 1) for t in texts[:15]] + [passage] * 3 + [passage + " end"]
    rows = list(enumerate(texts))
    want = brute_components(rows, 3, 80, 100)
    for crowd in (1, 4, 1000):
        got = ngram_components(make_docs(rows), 3, 80, 100, sketch_bits=8, crowd=crowd).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_ngram_edges(make_docs):
    got = ngram_components(make_docs([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A b c d")]), 3, 90, 100).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == [("1", 1), ("1", 1), ("2", 1), ("None", None)]
    assert ngram_components(make_docs([])).count() == 0
    assert len(shingles("a b a b a b", 3)) == 2


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = Counter(x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(k - 1 for k in lines.values()), len(covered)


def clean(rng, n):
    return "\n".join(" ".join(["The" if rng.random() < 0.1 else rng.choice(["then", "of", "and", "stone", "river", "walking", "house"]) + rng.choice(["", "s", "er", "ing"]) for _ in range(rng.randrange(8, 20))]) + "." for _ in range(n))


def test_quality_counts_and_verdicts(make_docs):
    rng = random.Random(9)
    rows = [(i, clean(rng, rng.randrange(4, 30)), rng.choice(["a", "hot", "hot"]), rng.choice(["en", "de", None])) for i in range(400)]
    junk = {400: "WIN!! BIG!! NOW!! " * 40, 401: " ".join(f"w{k}$$$ ***" for k in range(80)), 402: " | ".join(f"cell{k}" for k in range(200))}
    shouted = {403: " ".join(f"SHOUT{chr(65 + k % 26)}{chr(65 + k // 26)}!!" for k in range(120))}
    rows += [(i, t, "hot", "en") for i, t in {**junk, **shouted}.items()]
    rows += [(404, None), (405, ""), (406, "a b c"), (407, "same line of the text here\n" * 30), (408, "  # * \n#\n#\n \n"), (409, " lead\ttail \r\n" * 3), (410, clean(rng, 4000))]
    got = {r["doc_id"]: r for r in quality_rules(make_docs(rows)).collect()}
    for row in rows:
        r, want = got[row[0]], brute_counts(row[1])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, row[0]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert all(got[i]["kept"] for i in range(400)) and got[410]["kept"]
    assert not any(got[i]["kept"] for i in (*junk, *shouted))
    assert quality_rules(make_docs([])).count() == 0


def test_quality_outlier_alone_in_its_source(make_docs):
    """A small (lang, source) is judged by its whole language, a small language by the whole table."""
    rng = random.Random(11)
    shout = " ".join(f"SHOUT{chr(65 + k % 26)}{chr(65 + k // 26)}!!" for k in range(120))
    rows = [(i, clean(rng, rng.randrange(8, 30)), "a", "en") for i in range(150)]
    rows += [(150, shout, "z", "en"), (151, shout, "q", "fi"), (152, shout, None, "en"), (153, shout, "a", None), (154, shout, "b", None)]
    rows += [(160, clean(rng, 12), "y", "en"), (161, clean(rng, 12), "y", "sv"), (162, clean(rng, 12), None, "en")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(make_docs(rows)).collect()}
    assert [i for i in range(150, 155) if got[i]] == []
    assert all(got[i] for i in (*range(150), 160, 161, 162))


def test_factorisation_machine_identity():
    """The linear-time score equals the sum over all pairs."""
    rng = np.random.default_rng(1)
    m = FactorisationMachine(64, 0.3, rng.normal(size=64 + 18), rng.normal(size=(64 + 18, 3)), np.zeros(18), np.ones(18))
    text = "Some words, and more words!\n| a | b |"
    at, x, stats = features(text, 64)
    at, x = m._row(at, x, np.asarray(stats))
    raw = m.bias + m.weights[at] @ x + sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(m.score(text) - 1 / (1 + np.exp(-raw))) < 1e-9


def test_classifier_held_out(spark, make_docs):
    rng = random.Random(3)
    rows = [(i, clean(rng, 6) if i % 3 else " ".join(f"X{rng.randrange(99)}!! |" for _ in range(60))) for i in range(300)] + [(900, None), (901, "")]
    docs = make_docs(rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300) if not held(i)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in score_quality(docs, fit_quality_model(docs, labels)).collect()}
    right = [out[i]["predicted"] == int(i % 3 > 0) for i in range(300) if held(i)]
    assert len(right) > 40 and np.mean(right) > 0.95 and 0 <= out[900]["score"] <= 1 and out[900]["score"] == out[901]["score"]
    one = fit_quality_model(docs, labels.filter("quality = 1"))
    assert len({round(r["score"], 9) for r in score_quality(docs, one).collect()}) == 1
    assert score_quality(make_docs([]), one).count() == 0
