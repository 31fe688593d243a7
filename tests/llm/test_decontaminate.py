import random
import re

import pytest

from logtide.llm.decontaminate import decontaminate, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def brute(docs, items, window):
    known = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            known.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for key, owners in known.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i : i + len(key)]) == key:
                    hit.update(range(i, i + len(key)))
                    found |= owners
        out.append((doc_id, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.stop)], r["items"]) for r in df.collect()), key=str)


def tables(spark, make_docs):
    rng = random.Random(5)
    vocab = ["a", "b", "C", "d\xe9", "7", "\xc9t\xe9", "zz"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "\n", ", ", "-", "_"]) for _ in range(n))
    items = [(k, text(rng.randrange(1, 14))) for k in range(12)] + [(3, text(9)), (None, text(6)), (40, None), (41, ""), (42, "!?"), (43, "a b"), (44, "A b")]
    docs = [(k, text(rng.randrange(0, 60))) for k in range(60)] + [(None, text(40)), (None, None), (5, ""), (5, "a b"), (7, "A,B"), (8, text(4000)), (9, "a"), (9, "a")]
    return make_docs(docs), docs, spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("window", [2, 4, 10])
def test_matches_brute_force(spark, make_docs, window):
    df, docs, bench, items = tables(spark, make_docs)
    assert told(find_contamination(df, bench, window)) == brute(docs, items, window)


def test_blocks_give_the_same(spark, make_docs):
    df, docs, bench, items = tables(spark, make_docs)
    assert told(find_contamination(df, bench, 4, max_bytes=60)) == brute(docs, items, 4)


def test_empty_tables(spark, make_docs):
    df, docs, bench, _ = tables(spark, make_docs)
    assert all(not r[2] and not r[3] for r in told(find_contamination(df, bench.limit(0))))
    assert find_contamination(df.limit(0), bench).count() == 0


def test_removal(spark, make_docs):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = make_docs([(1, "Start. One, two three FOUR! End."), (2, "clean text"), (3, None), (None, "one two three four"), (2, "clean text")])
    spans = decontaminate(docs, bench, "spans", window=3)
    assert spans.columns == docs.columns
    assert sorted([(r[0], r[1]) for r in spans.collect()], key=str) == sorted([(1, "Start. ! End."), (2, "clean text"), (2, "clean text"), (3, None), (None, "")], key=str)
    whole = decontaminate(docs, bench, "documents", window=3)
    assert sorted([r[0] for r in whole.collect()], key=str) == [2, 2, 3]
    with pytest.raises(ValueError):
        decontaminate(docs, bench, "words")
