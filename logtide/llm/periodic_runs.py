"""Periodic run detection: runs of words that repeat with a period, by common extensions on a harmonic grid.

A run of period p and length at least 4p covers four points of the grid of multiples of p, which hold one word.  The
grids of all periods have n + n/2 + n/3 + ... points, and few of them hold four equal words.  Documents with such a
place are kept; for them :class:`CoverLCE` answers how far the text agrees with itself p words on, forwards and (from
the reversed text) backwards, which gives the run in full.  The texts of an Arrow batch are searched together, behind
one another, each with an end mark that equals nothing, so that no run crosses documents.

Of one stretch, only the smallest period counts.  (A longer period of it is a multiple of the smallest by Fine and
Wilf's theorem, and gives the same stretch.)

Defined results: a null or empty text has no words and no runs; repeated rows and repeated or null ids give one row
each; a text of any length is searched whole, in its task, in memory proportional to its words; extra columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship_package
from .common import SPACE_CHARS, pick
from .cover_lce import CoverLCE
from .word_arrays import chunks, split_words, word_bytes

#: A run repeats its period four times at least.
MIN_EXPONENT = 4
_FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _grid(words: np.ndarray, periods: range) -> Iterator[tuple[int, np.ndarray]]:
    """(p, grid points that hold the same word as the next three points of the grid of p)."""
    for p in periods:
        points = words[::p]
        same = points[1:] == points[:-1]
        yield p, p * np.flatnonzero(same[2:] & same[1:-1] & same[:-2])


def find_runs(words: np.ndarray, counts: np.ndarray, min_length: int = 6, flush: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of every run, by document, start and period.

    ``words`` are numbers from 0, those of ``counts`` documents behind one another.
    """
    n, none = len(words), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    longest = int(counts.max(initial=0))
    likely = np.zeros(len(counts), bool)
    for p, at in _grid(words, range(1, longest // MIN_EXPONENT + 1)):
        likely[doc[at][doc[at] == doc[at + 3 * p]]] = True
    if not likely.any():
        return none, none, none, none
    # Likely documents behind one another, each before a mark of its own, and a mark at the front for the way back.
    chosen = np.flatnonzero(likely)
    size = counts[chosen]
    firsts = np.cumsum(size + 1) - size
    text = np.empty(int(size.sum()) + len(chosen) + 1, np.int64)
    marks = np.append(0, firsts + size)
    text[marks] = int(words.max()) + 1 + np.arange(len(marks))
    inner = np.ones(len(text), bool)
    inner[marks] = False
    text[inner] = words[likely[doc]]
    ahead, behind, last = CoverLCE(text), CoverLCE(text[::-1].copy()), len(text) - 1
    found: list[np.ndarray] = []

    def extend(p: np.ndarray, at: np.ndarray) -> None:
        """Find the runs of the waiting places (by p, then place), one place a run if it lies within an earlier run."""
        while len(at):
            lead = np.append(True, (p[1:] != p[:-1]) | (at[1:] != at[:-1] + p[1:]))
            i, q = at[lead], p[lead]
            back = behind(last - (i + q - 1), last - (i - 1))
            start, stop = i - back, i + q + ahead(i, i + q)
            long = stop - start >= np.maximum(min_length, MIN_EXPONENT * q)
            found.append(np.stack([start, stop - start, q])[:, long])
            # Four points within a stretch just measured belong to it.
            which = np.cumsum(lead) - 1
            rest = ~lead & (at + 3 * p >= stop[which])
            p, at = p[rest], at[rest]

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for p, at in _grid(text, range(1, int(size.max()) // MIN_EXPONENT + 1)):
        waiting.append((np.full(len(at), p), at))
        if sum(len(a) for _, a in waiting) > flush:
            extend(*map(np.concatenate, zip(*waiting)))
            waiting = []
    if waiting:
        extend(*map(np.concatenate, zip(*waiting)))
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort([period, length, start])
    start, length, period = start[order], length[order], period[order]
    least = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.zeros(0, bool)
    start, length, period = start[least], length[least], period[least]
    owner = np.searchsorted(firsts, start, side="right") - 1
    order = np.lexsort([period, start, owner])
    owner, start, length, period = owner[order], start[order], length[order], period[order]
    return chosen[owner], start - firsts[owner], length, period


def _search(texts: pa.Array, min_length: int, is_word: np.ndarray) -> list[pa.Array]:
    words, counts = split_words(texts, is_word)
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner, start, length, period = find_runs(numbers, counts, min_length)
    runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
    offsets = np.searchsorted(owner, np.arange(len(counts) + 1)).astype(np.int32)
    first = (np.cumsum(counts) - counts)[owner] + start
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, first + period, 1)
    np.subtract.at(edge, first + length, 1)
    kept = np.cumsum(edge)[:-1] == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(counts)])]
    left = words.filter(pa.array(kept)) if not kept.all() else words
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), left), " ")
    return [pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), runs), text]


def periodic_runs(docs: DataFrame, min_length: int = 6) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start word, length, period; by start, then period) and
    collapsed, the words joined by single spaces less those that a run holds after its first period."""
    ship_package(docs.sparkSession)
    is_word = word_bytes(SPACE_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                yield pa.record_batch([part.column(0), *_search(part.column(1), min_length, is_word)], ["doc_id", "n_words", "runs", "collapsed"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND)


def strongest(runs: F.Column) -> F.Column:
    """The run of greatest length / period, compared exactly; of equal ones the first, then the one of smallest period."""

    def order(a: F.Column, b: F.Column) -> F.Column:
        ratio = b["length"] * a["period"] - a["length"] * b["period"]
        by = F.when(ratio != 0, ratio).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
        return F.signum(by).cast("int")

    return F.when(F.size(runs) > 0, F.get(F.array_sort(runs, order), F.lit(0)))
