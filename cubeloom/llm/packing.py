"""Operator 4: best-fit packing of token sequences, planned on the histogram of piece lengths.

Pieces above a third of the capacity fit at most twice in a bin: the longest
is matched, again and again, with the longest other one that fits.  Smaller
pieces, longest first, go to the tightest gap that takes them.  Pieces of
one length are alike, so the plan is made for whole counts at a time, from a
histogram of at most ``capacity`` rows; its size does not grow with the
corpus.  It is a list of intervals: of the pieces of a length, numbers lo to
hi go to sequences base, base + 1, ... at one offset.  Pieces are numbered
within their length in parallel, dealt over ``BLOCKS`` blocks, so a length
that many pieces share is no hot spot.

A null or empty text is the end token alone.  Repeated rows are pieces of
their own; pieces of equal length are placed by their number in it.  A text of
any length is cut into pieces; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import chunks, column_of, materialize, only
from .ids import encoder

BLOCKS = 256
CHUNK = 12 << 20


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all of the capacity but the first, which takes the rest."""
    rest = n % capacity
    return ([rest] if rest else []) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, and the ids themselves if wanted."""

    def run(batches):
        own = encoder(path, by_word=False)
        for part in chunks(batches, text_column, CHUNK):
            ids, starts = own.encode(column_of(part, text_column))
            rows, piece, begin, length, crc, raw = [], [], [], [], [], []
            for row, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                at = 0
                for k, n in enumerate(cut_lengths(len(whole), capacity)):
                    data = whole[at : at + n].tobytes()
                    rows.append(row), piece.append(k), begin.append(at), length.append(n), crc.append(zlib.crc32(data))
                    if with_ids:
                        raw.append(data)
                    at += n
            columns = [column_of(part, id_column).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names=[id_column, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = docs.schema[id_column].dataType.simpleString()
    return only(docs, id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, lo, hi, first sequence, offset) that place every piece."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n > capacity or n <= 0 for n in left):
        raise ValueError("a piece is longer than the capacity, or empty")
    used: dict[int, int] = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def place(n: int, count: int, base: int, offset: int) -> None:
        out.append((n, used[n], used[n] + count, base, offset))
        used[n] += count
        left[n] -= count

    def leave(gap: int, base: int, count: int) -> None:
        if gap:
            gaps.setdefault(gap, []).append((base, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for i, a in enumerate(large):
        for b in large[i:]:
            if a + b > capacity:
                continue
            while left[a] and left[b]:
                count = left[a] // 2 if a == b else min(left[a], left[b])
                if not count:
                    break
                place(a, count, sequences, 0)
                place(b, count, sequences, a)
                leave(capacity - a - b, sequences, count)
                sequences += count
            if not left[a]:
                break
        if left[a]:
            count = left[a]
            place(a, count, sequences, 0)
            leave(capacity - a, sequences, count)
            sequences += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g, runs in gaps.items() if g >= n and runs), default=0)
            if gap:
                base, size = gaps[gap].pop()
                count = min(size, left[n])
                if count < size:
                    gaps[gap].append((base + count, size - count))
            else:
                # new bins, each filled with as many pieces of this length as fit
                fits = capacity // n
                count, base, gap = -(-left[n] // fits), sequences, capacity
                sequences += count
            place(n, count, base, capacity - gap)
            leave(gap - n, base, count)
    return out


def numbered(pieces: DataFrame, id_column: str) -> DataFrame:
    """``pieces`` with ``_number``, from 0 within each length."""
    block = F.pmod(F.xxhash64(id_column, "piece"), F.lit(BLOCKS)).cast("int")
    dealt = pieces.withColumn("_block", block)
    # at most capacity * BLOCKS rows, so small enough to broadcast at any input size
    counts = dealt.groupBy("length", "_block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.Window.partitionBy("length").orderBy("_block").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("length", "_block", before.alias("_before"))
    within = F.row_number().over(W.Window.partitionBy("length", "_block").orderBy(id_column, "piece", "start", "ids_crc32"))
    return dealt.withColumn("_within", within).join(F.broadcast(bases), ["length", "_block"]).withColumn("_number", F.col("_before") + F.col("_within") - 1).drop("_block", "_within", "_before")


def pack(pieces: DataFrame, capacity: int, id_column: str = "doc_id") -> DataFrame:
    """``pieces`` (any columns, a ``length`` among them) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    steps = sorted(plan(histogram, capacity))
    table = spark.sparkContext.broadcast([np.array(c, dtype=np.int64) for c in (zip(*steps) if steps else [[]] * 5)])

    def run(batches):
        lengths, lo, _, base, offset = table.value
        keys = (lengths << 44) + lo
        for batch in batches:
            n, number = (np.asarray(column_of(batch, c)).astype(np.int64) for c in ("length", "_number"))
            at = np.searchsorted(keys, (n << 44) + number, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, c) for c in names] + [pa.array(base[at] + number - lo[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"]
            )

    names = pieces.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered(pieces, id_column).select(*[f"`{c}`" for c in names], "_number").mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts, cut the long ones, pack all pieces."""
    return pack(materialize(token_pieces(docs, path, end_id, capacity, id_column, text_column, with_ids)), capacity, id_column)
