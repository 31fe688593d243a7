import random

import corpus_pipeline
from logtide.llm.oracles import ORACLES
from logtide.llm.queries import QUERIES

from ..oracle import assert_same, connect
from .test_models_and_joins import brute_components, clean


def test_stages_take_effect(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, clean(rng, 12), rng.choice(["a", "b"])) for i in range(120)]
    rows += [(200, rows[3][1] + " "), (201, rows[4][1].replace("river", "rivet", 1)), (202, "WIN!! BIG!! NOW!! " * 40), (203, None), (204, "few words")]
    docs = make_docs(rows, extra=False)
    left = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, "")
        left[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {i for i, _ in left["quality_rules"]}
    assert {202, 203, 204}.isdisjoint(kept) and set(range(120)) <= kept
    assert 3 not in {i for i, _ in left["exact_dedup"]} and 200 in {i for i, _ in left["exact_dedup"]}
    want = brute_components(left["exact_dedup"], 5, 8, 10)
    assert {i for i, _ in left["ngram_jaccard_join"]} == {i for i, (_, c) in want.items() if i == c}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in left["source_mixing"]}


def test_queries_match_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = connect(sf)
    for name in ("op1_exact_dedup", "op3_source_mixing", "op4_chat_format", "op8_ngram_jaccard", "op10_line_dedup"):
        assert_same(QUERIES[name](spark, sf), con, ORACLES[name])
