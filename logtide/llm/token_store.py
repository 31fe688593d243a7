"""Token ids in a binary format with random access: directly addressable codes.

An id is split into chunks of 8 bits.  Level 0 holds the low chunk of every id; a continuation bitmap marks the ids
that go on, and level 1 holds the next chunk of just those, and so on.  A rank directory (ones before every block of
512 bits) turns the position of an id in one level into its position in the next, so that any token is reached by a
few array look-ups, without decoding a block.

Layout.  A token set is a folder of Parquet files of segments, ordered by document id.  A segment holds whole
documents (one of any length, or several up to ``segment_tokens``): its file number, its place in the file, the
token offset within the file, document ids and lengths, and per level the chunks, the bitmap and the directory.
File offsets come from a table with one row per file.  Spark's writers commit the files, so a lost executor leaves
no half-written one, and any store that Spark reaches will do.

Defined results: null text counts as empty, and a document without tokens has just its end id; null ids come first;
rows that share an id (repeated ones, too) follow one another by number of tokens, then by a hash of the ids, so that
reruns agree; a text of any length is one document of one segment; extra columns, whatever their names, are ignored;
an empty table gives an empty token set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shipping import ship_package
from .common import pick, stage
from .tokens import default_tokenizer, tokenizer
from .word_arrays import chunks, release

CHUNK_BITS = 8
RANK_BITS = 512
_TOKENS = "doc_id long, n_tokens long, ids binary"
_SEGMENTS = (
    "file int, segment int, file_offset long, n_docs int, n_tokens long, doc_ids binary, null_ids binary, doc_lens binary, "
    "levels array<struct<chunks:binary,more:binary,ranks:binary>>"
)


class DirectCodes:
    """A sequence of unsigned ids in directly addressable codes."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def encode(cls, ids: np.ndarray) -> DirectCodes:
        levels, rest = [], ids.astype(np.uint64)
        while True:
            more = rest >> np.uint64(CHUNK_BITS) != 0
            ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
            ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<i8")
            levels.append(((rest & np.uint64(0xFF)).astype(np.uint8), np.packbits(more, bitorder="little"), ranks))
            if not more.any():
                return cls(levels)
            rest = rest[more] >> np.uint64(CHUNK_BITS)

    def _rank(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a level's bitmap."""
        _, more, ranks = self.levels[level]
        block = i // RANK_BITS
        bits = np.unpackbits(more[block * RANK_BITS // 8 : (i + 7) // 8], bitorder="little")[: i - block * RANK_BITS]
        return int(ranks[block]) + int(bits.sum())

    def __getitem__(self, i: int) -> int:
        """The id at position ``i``: one bit test and one rank a level."""
        value = 0
        for level, (chunks, more, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            if not more[i // 8] >> (i % 8) & 1:
                return value
            i = self._rank(level, i)
        raise ValueError("a code ends with a set continuation bit")

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids of positions start..stop-1, decoded level by level."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where = np.arange(len(out))
        for level, (chunks, more, _) in enumerate(self.levels):
            if start >= stop:
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            bits = np.unpackbits(more[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            start = self._rank(level, start)
            where = where[bits]
            stop = start + len(where)
        return out

    def to_row(self) -> list[dict]:
        return [{"chunks": c.tobytes(), "more": m.tobytes(), "ranks": r.tobytes()} for c, m, r in self.levels]

    @classmethod
    def from_row(cls, levels: list[dict]) -> DirectCodes:
        return cls([(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<i8")) for x in levels])


def encode_texts(docs: DataFrame, tokenizer_path: str | None = None, end_id: int | None = 1) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 16-bit where all fit, else 32-bit: see ``unpack``)."""
    path = tokenizer_path or default_tokenizer()
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_array
        for batch in (part for whole in batches for part in chunks(whole, 1, 1 << 22)):
            ids, lens = with_end(*encode(batch.column(1)), end_id)
            ends = np.cumsum(lens)
            out = [pack(ids[a:b]) for a, b in zip((ends - lens).tolist(), ends.tolist())]
            yield pa.record_batch([batch.column(0), pa.array(lens), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids"])
        release()

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _TOKENS)


def with_end(ids: np.ndarray, lens: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents behind one another, and their numbers, with ``end_id`` after each."""
    return (ids, lens) if end_id is None else (np.insert(ids, np.cumsum(lens), end_id), lens + 1)


def pack(ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" if small else b"\x04") + ids.astype("<u2" if small else "<u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"\x02" else "<u4", offset=1).astype(np.uint32)


def write_token_set(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int | None = 1, segment_tokens: int = 1 << 18) -> None:
    """Encode ``docs`` and write the token set, in ascending doc_id order, under ``path``."""
    encoded = stage(encode_texts(docs, tokenizer_path, end_id), "tokens")
    # Range partitioning samples the staged table; nothing is encoded twice.  Rows of one id, which may be many, are
    # told apart by what they hold, so that they spread over files in an order that reruns repeat.
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("ids_key")]
    encoded = encoded.withColumn("ids_key", F.xxhash64("ids"))
    ordered = encoded.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([
            ("file", pa.int32()), ("segment", pa.int32()), ("file_offset", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()),
            ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("doc_lens", pa.binary()),
            ("levels", pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())]))),
        ])
        file, segment, offset = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            row = {
                "file": file, "segment": segment, "file_offset": offset, "n_docs": len(ids), "n_tokens": held,
                "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "null_ids": bytes(i is None for i in ids),
                "doc_lens": np.array([len(p) for p in parts], "<i8").tobytes(),
                "levels": DirectCodes.encode(np.concatenate(parts)).to_row(),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                codes = unpack(data.as_py())
                if ids and held + len(codes) > segment_tokens:
                    yield flush()
                    offset, segment, ids, parts, held = offset + held, segment + 1, [], [], 0
                ids.append(doc_id)
                parts.append(codes)
                held += len(codes)
        if ids:
            yield flush()

    ordered.mapInArrow(build, _SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_token_set(spark: SparkSession, path: str, broadcast_files: int = 500_000, with_ids: bool = True) -> DataFrame:
    """The documents of a token set, read from its files: doc_id, start, n_tokens, ids_crc32 and, ``with_ids``, ids
    (see ``unpack``)."""
    ship_package(spark)
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    files = segments.groupBy("file").agg(F.max(F.col("file_offset") + F.col("n_tokens")).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    # One row of two numbers per file of the set; a set of more files than that joins by shuffle.
    if segments.select("file").distinct().count() <= broadcast_files:
        base = F.broadcast(base)
    rows = segments.join(base, "file").select("base", "file_offset", "doc_ids", "null_ids", "doc_lens", "levels")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                lens = np.frombuffer(row["doc_lens"], "<i8")
                ends = np.cumsum(lens)
                ids = DirectCodes.from_row(row["levels"]).slice(0, int(ends[-1])).astype("<u4")
                cuts = list(zip((ends - lens).tolist(), ends.tolist()))
                gone = np.frombuffer(row["null_ids"], np.uint8).astype(bool)
                columns = [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=gone),
                    pa.array(ends - lens + row["base"] + row["file_offset"]),
                    pa.array(lens),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in cuts], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([pack(ids[a:b]) for a, b in cuts], pa.binary()))
                yield pa.record_batch(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(decode, schema)
