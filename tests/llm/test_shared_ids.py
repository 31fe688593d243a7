"""Different documents under one null or repeated doc_id keep fates of their own."""

import random

import corpus_pipeline
from logtide.llm.line_dedup import dedup_lines
from logtide.llm.mixing import apply_mix, mix_sources

from .test_models_and_joins import clean


def test_quality_judges_each_row(spark, make_docs):
    rng = random.Random(5)
    good = [(None, clean(rng, 12)), (7, clean(rng, 12))]
    rows = [(i, clean(rng, 12)) for i in range(100, 160)] + good + [(None, "few words"), (None, None), (7, "WIN!! BIG!! NOW!! " * 40)]
    docs = make_docs(rows)
    out = corpus_pipeline.quality(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in out.collect()), key=str) == sorted(rows[:62], key=str)


def test_mix_takes_each_row(make_docs):
    rows = [(None if i % 2 else i // 20, "w " * (1 + i % 9), "s" if i % 3 else "t") for i in range(90)]
    docs = make_docs(rows)
    n = sum(len((r[1] or "").split()) for r in apply_mix(docs).collect())
    assert n == sum(r["taken"] for r in mix_sources(docs).collect())


def test_line_dedup_keeps_unique_lines(make_docs):
    same = "one and the same line of seven"
    rows = [(1, same), (None, "a first line that nobody else has"), (None, f"{same}\nsomething of its own stands here"), (2, f"{same}\nleft alone"), (2, "unlike\nall")]
    got = sorted(((r["doc_id"], r["text"]) for r in dedup_lines(make_docs(rows)).collect()), key=str)
    want = [(1, ""), (None, rows[1][1]), (None, rows[2][1]), (2, "left alone"), (2, "unlike\nall")]
    assert got == sorted(want, key=str)
