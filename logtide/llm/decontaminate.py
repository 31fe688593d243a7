"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The windows of the benchmark become a :class:`WindowIndex`: the benchmark's vocabulary, its texts as word numbers, and
the 64-bit hash of each distinct window in order, behind a bitmap that turns most words away.  It is broadcast.
Documents are scanned where they are read, in Arrow batches, without a shuffle: words get the vocabulary's numbers,
rolling hashes are looked up, and every hit is verified word number by word number, so that a hash never decides.

The benchmark is measured first.  Up to ``max_bytes`` of text it is one index.  A larger one is cut into blocks of that
size by a hash of the item; each block is an index of its own, documents are scanned once a block, and the spans of a
document are merged.  Neither the driver nor a task ever holds more than one block.

Defined results: ASCII letters count in lower case; a word is a run of digits, letters and characters beyond ASCII;
a null or empty text, or one without words, has no words, and an item of this kind no window; an item shorter than a
window is one window; repeated items or windows count once for each different item id; a null item id counts as an item with an empty
name; every row of ``docs`` gives one row, repeated or null ids included; texts of any length are scanned whole; extra
columns, whatever their names, are ignored by the search and kept by the removal; an empty table on either side gives no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship_package
from .common import pick, stage
from .word_arrays import chunks, split_words, word_bytes

#: What separates words is every ASCII character but digits and letters.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_IS_WORD = word_bytes(GAPS)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOUND = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


class WindowIndex:
    """Windows of ``window`` consecutive words of benchmark texts, and where texts have fewer words, the whole text."""

    def __init__(self, items: list[str], texts: list[str | None], window: int = 10):
        words, counts = split_words(pa.array(texts, pa.string()), _IS_WORD, lower=True)
        coded = words.dictionary_encode()
        self.vocabulary, self.words = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.cumsum(counts) - counts
        # A text of n words has windows at 0 .. n - window, or one of n words at 0.
        number = np.where(counts > 0, np.maximum(counts - window, 0) + 1, 0)
        owner = np.repeat(np.arange(len(counts)), number)
        at = firsts[owner] + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        length = np.minimum(counts, window)[owner]
        self.names, item = np.unique(np.array(items, object), return_inverse=True) if len(items) else (np.array([], object), np.zeros(0, np.int64))
        self.seed = 0
        while not self._index(at, length, item[owner]):
            self.seed += 1

    def _index(self, at: np.ndarray, length: np.ndarray, item: np.ndarray) -> bool:
        """Distinct windows by hash, and the items of each; False where two different windows share a hash."""
        self.lengths = np.unique(length).tolist()
        rolled = {m: self.hashes(self.words, m) for m in self.lengths}
        hashed = np.zeros(len(at), np.uint64)
        for m in self.lengths:
            hashed[length == m] = rolled[m][at[length == m]]
        order = np.argsort(hashed, kind="stable")
        hashed, at, length, item = hashed[order], at[order], length[order], item[order]
        new = np.append(True, hashed[1:] != hashed[:-1]) if len(hashed) else np.zeros(0, bool)
        which = np.cumsum(new) - 1
        self.keys, self.at, self.length = hashed[new], at[new], length[new]
        if not (np.array_equal(length, self.length[which]) and self._same(self.words, at, which).all()):
            return False
        pairs = np.unique(np.stack([which, item], 1), axis=0)
        self.items, self.item_starts = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.keys) + 1))
        self.bits = max(10, (8 * len(self.keys)).bit_length())
        self.marks = np.zeros(1 << self.bits, bool)
        self.marks[self.keys >> np.uint64(64 - self.bits)] = True
        return True

    def hashes(self, words: np.ndarray, m: int) -> np.ndarray:
        """Hash of the ``m`` words from every position on, joined from hashes of powers of two; the last m - 1 are void."""
        x = (words + 1 + (self.seed << 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        base, done, out = 0xD6E8FEB86659FD93, 0, np.full(len(x), m, np.uint64)
        power = x  # the hash of ``width`` words
        for k in range(m.bit_length()):
            width = 1 << k
            if m & width:
                out[: max(0, len(x) - done)] += power[done:] * np.uint64(pow(base, done, 1 << 64))
                done += width
            grown = power.copy()
            grown[: max(0, len(x) - width)] += power[width:] * np.uint64(pow(base, width, 1 << 64))
            power = grown
        return (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)

    def _same(self, words: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether the words at ``at`` are those of window ``which``."""
        same, length = np.ones(len(at), bool), self.length[which]
        for t in range(int(length.max()) if len(length) else 0):
            more = np.flatnonzero(same & (length > t))
            same[more] = words[at[more] + t] == self.words[self.at[which[more]] + t]
        return same

    def occurrences(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, position, window) of every window in the documents of ``counts`` words, behind one another."""
        ends, found = np.cumsum(counts), []
        for m in self.lengths:
            hashed = self.hashes(words, m)
            at = np.flatnonzero(self.marks[hashed >> np.uint64(64 - self.bits)])
            which = np.minimum(np.searchsorted(self.keys, hashed[at]), len(self.keys) - 1)
            doc = np.searchsorted(ends, at, side="right")
            good = (self.keys[which] == hashed[at]) & (self.length[which] == m) & (at + m <= ends[np.minimum(doc, len(ends) - 1)])
            doc, at, which = doc[good], at[good], which[good]
            same = self._same(words, at, which)
            found.append((doc[same], at[same], which[same]))
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [[]] * 3))

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Number of words of each text, its hit spans (in words, apart from one another), and its items in order of their names."""
        words, counts = split_words(texts, _IS_WORD, lower=True)
        coded = words.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        numbers = known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        doc, at, which = self.occurrences(numbers, counts)
        edge = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + self.length[which], 1)
        hit = np.cumsum(edge)[:-1] > 0
        firsts = np.cumsum(counts) - counts
        starts, stops = hit.copy(), hit.copy()
        starts[1:] &= ~hit[:-1]
        stops[:-1] &= ~hit[1:]
        full = firsts[counts > 0]
        starts[full], stops[full[1:] - 1] = hit[full], hit[full[1:] - 1]
        starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        owner = np.searchsorted(np.cumsum(counts), starts, side="right")
        spans = _lists(owner, len(counts), pa.StructArray.from_arrays([pa.array(starts - firsts[owner]), pa.array(stops - firsts[owner])], ["start", "stop"]))
        number = self.item_starts[which + 1] - self.item_starts[which]
        item = self.items[np.repeat(self.item_starts[which] - (np.cumsum(number) - number), number) + np.arange(number.sum())]
        pairs = np.unique(np.stack([np.repeat(doc, number), item], 1), axis=0)
        return counts, spans, _lists(pairs[:, 0], len(counts), pa.array(self.names[pairs[:, 1]].tolist(), pa.string()))


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """``values``, which are in the order of their ``owner``, as one list for each of n owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _scan(docs: DataFrame, items: DataFrame, window: int, extra: str = "") -> DataFrame:
    """Scan of (doc_id, text, ...) against the items (item_id, text) of one block, which are collected and broadcast."""
    spark = docs.sparkSession
    block = items.toArrow()
    index = WindowIndex(block.column(0).to_pylist(), block.column(1).to_pylist(), window)
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                counts, spans, names = shared.value.scan(part.column(1))
                rest = [part.column(k) for k in range(2, part.num_columns)]
                yield pa.record_batch([part.column(0), pa.array(counts), spans, names, *rest], ["doc_id", "n_words", "spans", "items", *part.schema.names[2:]])

    return docs.mapInArrow(run, _FOUND + extra)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = 1 << 24) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (words that a benchmark window covers, as ranges that do not
    touch), items (ids of the items with occurring windows, as strings in order)."""
    ship_package(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    items = pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    items = items.filter(F.col("text").isNotNull()).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0))).first()[0]
    n_blocks = -(-total // max_bytes)
    if n_blocks <= 1:
        return _scan(rows, items, window)
    # Rows are numbered in a table, so that every scan names them alike.
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "scanned")
    items = stage(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))), "items")
    scans = [_scan(rows, items.filter(F.col("block") == b).drop("block"), window, ", row long") for b in range(n_blocks)]
    hits = stage(_union([s.filter(F.size("items") > 0) for s in scans[1:]]), "hits")
    first = scans[0].select("*", F.lit(True).alias("main"))
    both = first.unionByName(hits.withColumn("main", F.lit(False)))
    # At most one row a block for each document.
    merged = both.groupBy("row").agg(
        F.max_by("doc_id", "main").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.select("doc_id", "n_words", _merge_spans(F.col("spans")).alias("spans"), "items")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _merge_spans(spans: Column) -> Column:
    """Spans that overlap or touch as one."""
    empty = F.lit(None).cast("array<struct<start:long,stop:long>>")

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))
        return F.when(F.size(done) == 0, F.array(span)).when(span["start"] <= last["stop"], joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.coalesce(empty, F.array().cast("array<struct<start:long,stop:long>>")), add)


def _without(text: str, spans: list[dict]) -> str:
    """``text`` less the characters from the first to the last word of each span."""
    words = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : words[s["start"]][0]])
        at = words[s["stop"] - 1][1]
    return "".join([*kept, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", window: int = 10) -> DataFrame:
    """``docs`` less the hit words (``mode="spans"``) or less the documents with hits (``"documents"``), other columns unchanged.

    Removal of spans cuts the text from the first to the last hit word and leaves what is around.
    """
    if mode not in ("spans", "documents"):
        raise ValueError(f"mode is spans or documents, not {mode!r}")
    ship_package(docs.sparkSession)
    flat = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    at_id, at_text = (docs.columns.index(n) for n in ("doc_id", "text"))
    numbered = stage(flat.withColumn("__row", F.monotonically_increasing_id()), "documents")
    ids = numbered.select(F.col("__row").alias("doc_id"), F.col(f"__c{at_text}").alias("text"))
    hits = stage(find_contamination(ids, benchmark, window).filter(F.size("items") > 0).select(F.col("doc_id").alias("__row"), "spans"), "contaminated")
    if mode == "documents":
        return numbered.join(hits, "__row", "left_anti").drop("__row").toDF(*docs.columns)
    cut = F.udf(_without, "string", useArrow=True)
    joined = numbered.join(hits, "__row", "left").drop("__row")
    text = F.col(f"__c{at_text}")
    # Only texts with hits reach Python.
    return joined.filter("spans is null").drop("spans").unionByName(
        joined.filter("spans is not null").withColumn(f"__c{at_text}", cut(text, "spans")).drop("spans")
    ).toDF(*docs.columns)
