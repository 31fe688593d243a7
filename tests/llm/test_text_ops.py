import hashlib
import pathlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.llm.chat_format import format_conversations, parse, read_back
from logtide.llm.line_dedup import dedup_lines
from logtide.llm.sharding import layout, shard_documents

CONV = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\n", " ", "a", "é", "$1", "\\\\</s>", "\r\n", "</s", ">"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "[/INST]\nx", None]), "".join(rng.choices(bits, k=rng.randrange(0, 9))) if rng.random() > 0.05 else None) for c in range(150) for t in range(4)]
    rows += [(900, 0, "assistant", "x" * 300_000), (901, 0, "user", ""), (901, 0, "user", ""), (None, None, None, None)]
    formatted = format_conversations(spark.createDataFrame(rows, CONV))
    got = {r["conv_id"]: r for r in read_back(formatted).collect()}
    order = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=order)
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(t[2] or "", t[3] or "") for t in turns]
        assert got[conv]["loss_text"] == "".join(t[3] or "" for t in turns if t[2] == "assistant")
    assert format_conversations(spark.createDataFrame([], CONV)).count() == 0


def test_parser_rejects_loose_control_strings(spark):
    row = spark.range(1).select(parse(F.lit("<s>[INST] user [/INST]\na [INST] b\n</s>")).alias("t")).first()["t"]
    assert row[0]["text"] is None


def brute_lines(rows, words_per_edit=6):
    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < words_per_edit or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    lines = sorted({(d is not None, d or 0, i, tuple(x.split())) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.split()})
    gone = {(a[0], a[1], a[2]) for k, a in enumerate(lines) if any(near(a[3], b[3]) for b in lines[:k])}
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        out.append((d, "\n".join(x for i, x in enumerate(parts) if (d is not None, d or 0, i) not in gone), len(parts)))
    return out


def test_line_dedup_matches_brute_force(make_docs):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 14))] for _ in range(25)]

    def line():
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(x) + 1)
            what = rng.randrange(3)
            if what == 0:
                x.insert(k, "new")
            elif x and k < len(x):
                x[k : k + 1] = [] if what == 1 else ["sub"]
        return rng.choice(["", " "]) + "  ".join(x)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(0, 6)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "\n\n"), (None, "one two three four five six"), (83, "one two three four five six"), (84, "w " * 3000), (85, "w " * 2999)]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"]) for r in dedup_lines(make_docs(rows)).collect()), key=str)
    assert got == sorted(brute_lines(rows), key=str)
    assert dedup_lines(make_docs([])).count() == 0


def test_line_dedup_moves_only_what_may_meet(spark, make_docs):
    """Lines without a partner are told where they are read: neither their texts nor their variants are shuffled or kept."""
    rng = random.Random(6)
    rows = [(i, "\n".join(" ".join(f"{rng.randrange(16**6):06x}" for _ in range(25)) for _ in range(10))) for i in range(2000)]
    rows += [(2000, rows[0][1].split("\n")[3] + "\nleft alone"), (2001, rows[1][1].replace(rows[1][1].split(" ")[4], "other"))]
    docs = make_docs(rows).localCheckpoint()
    local, root = spark.conf.get("spark.local.dir"), f"{spark.conf.get('spark.checkpoint.dir')}/logtide/{spark.sparkContext.applicationId}"
    shuffled = lambda: {p: p.stat().st_size for p in pathlib.Path(local).rglob("shuffle_*.data")}
    kept = lambda: {p.name for p in pathlib.Path(root).glob("lines-*")}
    had, known = shuffled(), kept()
    got = {r["doc_id"]: r["n_dropped"] for r in dedup_lines(docs).collect()}
    assert {k: v for k, v in got.items() if v} == {2000: 1, 2001: 10}
    assert sum(n for p, n in shuffled().items() if p not in had) < sum(len(t) for _, t in rows)
    assert {name.split("-")[1] for name in kept() - known} == {"dropped"}


@pytest.mark.parametrize("shards", [8, 40, 43])
def test_sharding(make_docs, shards):
    rows = [(i, "x" * (i % 50)) for i in range(4000)] + [(4000, None), (4001, "é"), (None, "a"), (7, "again")]
    got = shard_documents(make_docs(rows), shards).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], shards) or shards < 40
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(shards))
    texts = {i: t for i, t in rows if i != 7}
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16 for r in got if r["doc_id"] != 7)
    counts = np.array([len(v) for v in by.values()])
    assert counts.std() < 4 * np.sqrt(len(rows) / shards)
    assert sorted(s.shard for s in layout(shards)) == list(range(shards))
    assert shard_documents(make_docs([])).count() == 0


def test_hash_is_portable(make_docs):
    """The shard of a document can be recomputed anywhere from md5 draws."""
    import math

    def unit(*parts):
        return (int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    tree = layout(40)

    def place(doc):
        nodes = tree
        for level in ("region", "rack", "shard"):
            weights = {}
            for s in nodes:
                weights[getattr(s, level)] = weights.get(getattr(s, level), 0) + s.weight
            best = min(weights, key=lambda c: -math.log(unit(str(doc), f"{level}{c}")) / weights[c])
            nodes = [s for s in nodes if getattr(s, level) == best]
        return nodes[0].shard

    got = shard_documents(make_docs([(i, "t") for i in range(200)])).collect()
    assert all(r["shard"] == place(r["doc_id"]) for r in got)
