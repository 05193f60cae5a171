"""Operator 10: token ids as canonical length-limited Huffman blocks.

The code is made from the counts of all ids (at most one count a vocabulary
entry reaches the driver), limited to ``LONGEST`` bits by package-merge and
put in canonical order.  Documents lie in ascending id order in blocks of
whole documents; a block is decoded on its own: it holds the ids before it,
its documents' lengths, the bits, and the bit offset of every
``CHECKPOINT``-th id.  Decoding looks up ``LONGEST`` bits at a time in a
table, all checkpoints of a block side by side.

A stored table is a folder: ``blocks`` (a Parquet row a block) and ``code``
(the length of each id's code).  A null or empty text is the end id alone;
rows with equal ids keep their own places, ordered by text.  An empty table
gives an empty store.  Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, column_of, materialize, only
from .ids import encoder

LONGEST = 20
CHECKPOINT = 128
BLOCK_IDS = 1 << 17
CHUNK = 12 << 20


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits by package-merge; 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError("more symbols than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    # level by level: the coins of this level merged with pairs of the level below
    levels = []
    packed = np.zeros(0, np.int64)
    for _ in range(longest):
        both = np.concatenate([weights, packed])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weights))  # which of the sorted entries are coins
        merged = both[rank]
        merged = merged[: len(merged) // 2 * 2]
        packed = merged[0::2] + merged[1::2]
    # the first 2n - 2 entries of the last level; each package stands for two entries a level below
    take = 2 * len(weights) - 2
    depth = np.zeros(len(weights) + 1, np.int64)
    for coins in reversed(levels):
        n = int(coins[:take].sum())
        depth[0] += 1
        depth[n] -= 1
        take = 2 * (take - n)
    lengths[order] = np.cumsum(depth)[:-1]
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    code, last = 0, 0
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of all ids, and the bit offset of every checkpoint."""
    n = lengths.astype(np.uint8)[ids]
    ends = np.cumsum(n, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    starts = ends - n
    # a code of at most 32 bits lies in the 64 bits from the 32-bit word of its first bit on; codes share no bit, so sums put them together
    word = starts >> 5
    window = codes.astype(np.uint64)[ids] << (np.uint64(64) - n - (starts & 31).astype(np.uint64))
    words = np.zeros(total // 32 + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(first):
        words[word[first]] = np.add.reduceat(window >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(window & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], starts[::CHECKPOINT]


class Decoder:
    def __init__(self, lengths: np.ndarray, longest: int = LONGEST):
        codes = canonical(lengths)
        self.longest = longest
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        # an id and, in the low five bits, the length of its code
        if longest > 31 or len(lengths) > 1 << 27:
            raise ValueError("codes or ids are too long for the table")
        self.table = np.zeros(1 << longest, np.uint32)
        span = (1 << (longest - lengths[used])).astype(np.int64)
        self.table[: int(span.sum())] = np.repeat((used << 5 | lengths[used]).astype(np.uint32), span)
        assert not len(used) or int(codes[used[0]]) == 0

    def decode(self, data: bytes, checkpoints: np.ndarray, count: int) -> np.ndarray:
        raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
        words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        out = np.zeros((CHECKPOINT, len(checkpoints)), np.uint32)
        at = np.array(checkpoints, dtype=np.int64)
        last, low, shift = len(words) * 8 - 1, np.uint32(31), np.uint32(32 - self.longest)
        for step in range(min(CHECKPOINT, count)):
            peek = words[at >> 3]
            peek <<= (at & 7).astype(np.uint32)
            peek >>= shift
            entry = self.table[peek]
            out[step] = entry
            entry &= low
            at += entry
            np.minimum(at, last, out=at)
        return (out >> np.uint32(5)).T.reshape(-1)[:count]


def token_blocks(docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Blocks of whole documents in ascending order: _part, _before (ids of the part before it), doc ids, lengths, ids.

    Ids take two bytes where the vocabulary allows it, else four.  A part's last row has no documents but
    the ``counts`` of its ids, so that nothing is read twice for them.
    """
    salt = F.xxhash64(text_column)  # deals out the rows of one id
    ordered = only(docs, id_column, text_column).repartitionByRange(F.col(id_column), salt).sortWithinPartitions(F.col(id_column), salt, F.col(text_column))

    def run(batches):
        own = encoder(path, by_word=True)
        part, before = TaskContext.get().partitionId(), 0
        size = max(own.tokenizer.get_vocab_size(), end_id + 1)
        total = np.zeros(size, np.int64)
        for rows in chunks(batches, text_column, CHUNK):
            ids, starts = own.encode(column_of(rows, text_column))
            n = np.diff(starts) + 1
            total += np.bincount(ids, minlength=size)
            total[end_id] += len(n)
            ids = np.insert(ids.astype("<u2" if size <= 1 << 16 else "<u4"), starts[1:], end_id)
            ends = np.cumsum(n)
            first = 0
            while first < len(n):
                base = int(ends[first] - n[first])
                last = max(first + 1, int(np.searchsorted(ends, base + BLOCK_IDS, side="right")))
                count = int(ends[last - 1]) - base
                keys = column_of(rows, id_column).slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([before], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), keys),
                        pa.array([n[first:last]], pa.list_(pa.int64())),
                        pa.array([ids[base : base + count].tobytes()], pa.binary()),
                        pa.array([None], pa.binary()),
                    ],
                    names=names,
                )
                before, first = before + count, last
        used = np.flatnonzero(total)
        if len(used):
            counts = np.stack([used, total[used]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([None], pa.list_(keys.type)), pa.array([None], pa.list_(pa.int64())), pa.array([None], pa.binary()), pa.array([counts], pa.binary())], names=names)

    names = ["_part", "_before", "doc_ids", "lengths", "ids", "counts"]
    kind = docs.schema[id_column].dataType.simpleString()
    return ordered.mapInArrow(run, f"_part int, _before bigint, doc_ids array<{kind}>, lengths array<bigint>, ids binary, counts binary")


def write_store(docs: DataFrame, out: str, path: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode whole texts and write the store at ``out``."""
    spark = docs.sparkSession
    blocks = materialize(token_blocks(docs, path, end_id, id_column, text_column))

    def count(batches):
        for batch in batches:
            for data in column_of(batch, "counts").to_pylist():
                used, n = np.frombuffer(data, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n)], names=["id", "n"])

    # one row an id of the vocabulary, and one a partition
    counted = blocks.where("counts is not null").select("counts").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    blocks = blocks.where("counts is null")
    sizes = blocks.groupBy("_part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).orderBy("_part").collect()
    part_base, total = {}, 0
    for r in sizes:
        part_base[r["_part"]] = total
        total += r["n"]
    used, n = np.asarray(counted.column("id")), np.asarray(counted.column("n"))
    counts = np.zeros(int(used.max()) + 1 if len(used) else 1, np.int64)
    counts[used] = n
    lengths = code_lengths(counts)
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths), part_base))

    def encode(batches):
        lengths, codes, bases = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                raw = column_of(one, "ids")[0].as_py()
                ids = np.frombuffer(raw, f"<u{len(raw) // int(np.asarray(column_of(one, 'lengths').flatten()).sum())}")
                data, checkpoints = encode_bits(ids, lengths, codes)
                start = bases[column_of(one, "_part")[0].as_py()] + column_of(one, "_before")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([start], pa.int64()), column_of(one, "doc_ids"), column_of(one, "lengths"), pa.array([checkpoints], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                    names=["start", "doc_ids", "lengths", "checkpoints", "bits"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    blocks.mapInArrow(encode, f"start bigint, doc_ids array<{kind}>, lengths array<bigint>, checkpoints array<bigint>, bits binary").write.mode("overwrite").parquet(f"{out}/blocks")
    spark.createDataFrame([(lengths.astype("<u1").tobytes(),)], "lengths binary").coalesce(1).write.mode("overwrite").parquet(f"{out}/code")


def read_store(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document in the store."""
    blocks = spark.read.parquet(f"{out}/blocks")
    lengths = np.frombuffer(spark.read.parquet(f"{out}/code").first()["lengths"], "<u1").astype(np.int64)
    shared = spark.sparkContext.broadcast(lengths)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                n = np.asarray(column_of(one, "lengths").flatten())
                ids = decoder.decode(column_of(one, "bits")[0].as_py(), np.asarray(column_of(one, "checkpoints").flatten()), int(n.sum())).astype("<u4")
                ends = np.cumsum(n)
                pieces = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                columns = [column_of(one, "doc_ids").flatten(), pa.array(column_of(one, "start")[0].as_py() + ends - n), pa.array(n), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.binary())] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return blocks.select("start", "doc_ids", "lengths", "checkpoints", "bits").mapInArrow(decode, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
