"""Helpers that the training-data operators share.

Words are maximal runs of characters other than space and U+0009..U+000D.
Every helper treats a null text as a text without words.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
CHUNK_BYTES = 8 << 20
#: Stands for a missing id where ids are whole numbers.
NO_ID = -(1 << 63)
#: Separators between words, as a Java and Python character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a local one in local mode only."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="cubeloom-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cubeloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def materialize_and_free(df: DataFrame) -> DataFrame:
    """``materialize``, with the shuffles of the write deleted as it ends, not when the driver happens to collect them."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return materialize(df)
    finally:
        conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_kept: tuple | None = None


def kept(key, make):
    """What a Python worker keeps between tasks: one thing at a time, so that operators that follow each other don't add up."""
    global _kept
    if _kept is None or _kept[0] != key:
        _kept = None
        _kept = (key, make())
    return _kept[1]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_column(text: Column) -> Column:
    """Array of words, on the JVM side."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, whatever the optimiser inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """Cut record batches into slices of at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if isinstance(batch, pa.Table):
            batch = batch.combine_chunks().to_batches()[0]
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < len(sizes):
            yield batch.slice(start)
        pa.default_memory_pool().release_unused()


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and where the words of each text start (one entry more than texts)."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate([[0], np.cumsum(real)])
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64))])
    return flat.filter(pa.array(real)), before[ends].astype(np.int64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    distinct = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return distinct[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.uint64)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words; ``len(hashes) - n + 1`` of them."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = mix(out + hashes[i : i + count] + _ODD)
    return out


def shingle_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their offsets.

    A text of fewer than ``n`` words has its whole word sequence as its only
    shingle; a text without words has none.
    """
    words, starts = split_words(texts, lower=True)
    hashes = word_hashes(words)
    grams = gram_hashes(hashes, n)
    sets = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            sets.append(gram_hashes(hashes[a:b], int(b - a)))
        else:
            sets.append(grams[:0])
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offsets


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """Just these columns; a document table may carry others under any name."""
    return docs.select(*(column(c) for c in columns))


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct, so that no name can clash with a helper's."""
    return F.struct(*(column(c) for c in docs.columns))


def with_text(docs: DataFrame, text_column: str, text: Column) -> Column:
    """The struct column ``row`` of ``whole_row`` with another text."""
    return F.struct(*((text if c == text_column else F.col("row").getField(c)).alias(c) for c in docs.columns))
