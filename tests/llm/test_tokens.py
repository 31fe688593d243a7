import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logtide.llm.packing import fill_window, pack_documents, pack_lengths
from logtide.llm.token_store import DirectCodes, read_token_set, unpack, write_token_set
from logtide.llm.tokens import default_tokenizer, tokenizer

TEXTS = ["", None, "Hello world!", "ÉTÉ Straße ΣΑΣ İstanbul", "a b　c", "x" * 5000, "it's don't I'LL", "<|startoftext|> <|endoftext|>", "\x00\x1c\x1f tab\tnl\n", "日本語 テスト 12,345", "é ̈ a", "word " * 6000, "Foo, BAR! x1. (a). <|ENDOFTEXT|>", "Ünïcode, straße; ÿ! Ǆ ẞ"]


def plain_ids(text):
    return tokenizer(default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_remembered_words_change_nothing(text):
    assert list(tokenizer(default_tokenizer()).encode(text)) == plain_ids(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=1500), st.data())
def test_direct_codes(ids, data):
    codes = DirectCodes.from_row(DirectCodes.encode(np.array(ids, np.uint32)).to_row())
    i = data.draw(st.integers(0, len(ids) - 1))
    j = data.draw(st.integers(i, len(ids)))
    assert codes[i] == ids[i] and codes.slice(i, j).tolist() == ids[i:j]


def test_token_set_round_trip(spark, make_docs, tmp):
    rows = [(100 - k, t) for k, t in enumerate(TEXTS)] + [(None, "nothing"), (95, "again")]
    write_token_set(make_docs(rows).repartition(4), f"{tmp}/t", segment_tokens=500)
    got = sorted(read_token_set(spark, f"{tmp}/t").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r["start"] == start and unpack(r["ids"])[-1] == 1 and r["n_tokens"] == len(unpack(r["ids"]))
        start += r["n_tokens"]
    want = Counter(zlib.crc32(np.array([*plain_ids(t), 1], "<u4").tobytes()) for _, t in rows)
    assert Counter(r["ids_crc32"] for r in got) == want
    write_token_set(make_docs([]), f"{tmp}/e")
    assert read_token_set(spark, f"{tmp}/e").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=7), st.integers(0, 60))
def test_fill_window_is_the_best_sum(counts, capacity):
    sums = {0}
    for n, k in counts.items():
        sums |= {s + n * j for s in sums for j in range(k + 1)}
    chosen = fill_window(counts, capacity)
    assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= capacity) and all(k <= counts[n] for n, k in chosen.items())


def test_pack_lengths_places_each_once():
    lengths = [int(x) for x in np.random.default_rng(2).integers(1, 4097, 400)]
    windows = pack_lengths(lengths, 4096)
    assert sorted(i for w in windows for i in w) == list(range(400)) and all(sum(lengths[i] for i in w) <= 4096 for w in windows)
    assert sum(lengths) / (4096 * len(windows)) > 0.95


def test_pack_documents(make_docs):
    rows = list(enumerate(TEXTS)) + [(2, "Hello world!"), (None, "no id")]
    got = pack_documents(make_docs(rows).repartition(3), group_pieces=5).collect()
    pieces = {}
    for r in got:
        assert zlib.crc32(unpack(r["ids"]).astype("<u4").tobytes()) == r["ids_crc32"] and len(unpack(r["ids"])) == r["length"]
        pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq in pieces.values():
        end = 0
        for offset, length in sorted(seq):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(len(plain_ids(t)) + 1 for _, t in rows)
    assert sum(r["length"] for r in got) == total
    long = sorted((r for r in got if r["doc_id"] == 11), key=lambda r: r["start"])
    assert np.concatenate([unpack(r["ids"]) for r in long]).tolist() == [*plain_ids(TEXTS[11]), 2]
    assert pack_documents(make_docs([])).count() == 0
