"""Packing by minimum bin slack.

Documents longer than a window are cut into whole windows and a remainder.  Pieces are packed within groups that a
hash of the staged piece number deals out evenly, also where many rows share an id or have none: each window takes the longest remaining piece and then the multiset of
remaining lengths that comes closest to filling it, found by a subset-sum dynamic programme over bitsets (bit ``s``
of a big integer says that ``s`` tokens can be filled) and read back with counts per length.  Only each group's last
windows can stay short, so padding vanishes as groups grow.

Groups see lengths, never tokens: the pieces with their ids are a staged table, and the plan joins it by piece.

Defined results: null text counts as empty (a document of just its end id); a null doc_id stays null; repeated rows
are packed each, and pieces of equal length go by doc_id, start and number; an empty table gives an empty result; a
text of any length is cut into as many windows as it takes; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship_package
from .common import pick, stage
from .token_store import pack, with_end
from .tokens import default_tokenizer, tokenizer
from .word_arrays import chunks, release

_PIECES = "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def fill_window(counts: dict[int, int], capacity: int, order: list[int] | None = None) -> dict[int, int]:
    """Of a multiset of lengths, the part whose sum comes closest to ``capacity``: {length: how many}.

    ``order`` has the lengths of ``counts`` in descending order, where the caller keeps them.
    """
    order = sorted(counts, reverse=True) if order is None else order
    reach, mask, full = 1, (1 << capacity + 1) - 1, 1 << capacity
    steps: list[tuple[int, int, int]] = []
    for at in range(bisect_left(order, -capacity, key=lambda n: -n), len(order)):
        length = order[at]
        left, k = min(counts[length], capacity // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << length * k & mask
            left, k = left - k, k * 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            chosen[length] = chosen.get(length, 0) + k
    return chosen


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of positions into ``lengths``; each starts with the longest piece left."""
    left: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        left.setdefault(n, []).append(i)
    counts = {n: len(v) for n, v in left.items()}
    order = sorted(counts, reverse=True)
    windows = []
    while order:
        longest = order[0]
        counts[longest] -= 1
        take = fill_window(counts, capacity - longest, order) if longest < capacity else {}
        take[longest] = take.get(longest, 0) + 1
        counts[longest] += 1
        for n, k in take.items():
            counts[n] -= k
            if not counts[n]:
                order.remove(n)
        windows.append([left[n].pop() for n in sorted(take, reverse=True) for _ in range(take[n])])
    return windows


def token_pieces(docs: DataFrame, window: int = 4096, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode ``docs`` and cut each into pieces of at most ``window`` tokens."""
    path = tokenizer_path or default_tokenizer()
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, next_piece = tokenizer(path).encode_array, TaskContext.get().partitionId() << 33
        for batch in (part for whole in batches for part in chunks(whole, 1, 1 << 22)):
            ids, lens = with_end(*encode(batch.column(1)), end_id)
            # Document k is cut into n[k] pieces; ``at`` is where a piece begins within its document.
            n, ends = -(-lens // window), np.cumsum(lens)
            doc, last = np.repeat(np.arange(len(lens)), n), np.cumsum(n)
            at = (np.arange(len(doc)) - np.repeat(last - n, n)) * window
            size = np.minimum(window, lens[doc] - at)
            first = (ends - lens)[doc] + at
            parts = [ids[a:b] for a, b in zip(first.tolist(), (first + size).tolist())]
            columns = [
                pa.array(next_piece + np.arange(len(doc))), batch.column(0).take(pa.array(doc)), pa.array(at), pa.array(size),
                pa.array([zlib.crc32(x.astype("<u4", copy=False)) for x in parts], pa.int64()), pa.array(lens[doc]),
                pa.array([pack(x) for x in parts], pa.binary()),
            ]
            next_piece += len(doc)
            yield pa.record_batch(columns, [c.split()[0] for c in _PIECES.split(", ")])
        release()

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def pack_documents(
    docs: DataFrame, window: int = 4096, tokenizer_path: str | None = None, end_id: int = 2, group_pieces: int = 4096, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, ``with_ids``, ids.

    ``group_pieces`` is the number of pieces that are packed together, about; a group is one task's work.
    """
    pieces = stage(token_pieces(docs, window, tokenizer_path, end_id), "pieces")
    groups = -(-max(1, pieces.select("piece").count()) // group_pieces)

    def plan(key, pdf: pd.DataFrame) -> pd.DataFrame:
        # By start and id, so that the plan does not depend on the order in which the rows arrive.
        pdf = pdf.sort_values(["length", "doc_id", "start", "piece"], kind="stable").reset_index(drop=True)
        windows = pack_lengths(pdf["length"].tolist(), window)
        order = np.array([i for w in windows for i in w], np.int64)
        lens = pdf["length"].to_numpy()[order]
        number = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        ends = np.cumsum(lens)
        first = np.concatenate([[True], number[1:] != number[:-1]])
        offset = (ends - lens) - np.maximum.accumulate(np.where(first, ends - lens, 0))
        out = pdf.iloc[order]
        return pd.DataFrame({"piece": out["piece"].to_numpy(), "sequence_id": (int(key[0]) << 32) + number, "offset": offset})

    lengths = pieces.select("piece", "doc_id", "start", "length", F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("g"))
    placed = lengths.groupBy("g").applyInPandas(plan, "piece long, sequence_id long, offset long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if with_ids else [])
    return pieces.select("piece", *columns).join(placed, "piece").select(*columns[:5], "sequence_id", "offset", *columns[5:])
