"""A stored BM25 index with block maxima, and top-k search that skips blocks.

Building reads the texts twice, for their mean length and for their terms.
Postings are packed where a block of documents is read, and the index has

* ``postings``: for each (term, block of documents) one row, in folders by term
  hash: how many documents hold the term, the most that it adds to one of them
  but for the term's own weight (its idf), and, in columns that are read for few
  blocks only, the documents, how often each has the term and how long it is;
* ``totals``: the number of documents and their mean length.

Blocks are the same documents for every term, so the maxima of a query's terms
bound the score of every document of a block.  A search scores the most
promising blocks first, takes the k-th score so far as the query's threshold,
and reads the postings of those other blocks only whose bound reaches it.  A
block's scores are one product of its queries' terms with its postings, of
which the k best a query go on.  No text is read at query time, and nothing but
stated queries meets the index.  A block is a run of documents as they are
read, so the corpus must be a table or another source whose partitions can be
read again alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.stems import STOP_WORDS, stem

K1, B = 0.9, 0.4
#: Documents of a block, folders of the postings, blocks that are scored before there is a threshold.
BLOCK, FOLDERS, FIRST = 64, 64, 2
#: Tasks that a folder of the postings is written by.
SPREAD = 4

_TERM_BYTES = np.full(256, 32, np.uint8)
_TERM_BYTES[48:58], _TERM_BYTES[97:123] = np.arange(48, 58), np.arange(97, 123)
CHUNK = 8 << 20


def terms(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def _spaced(texts: pa.Array) -> pa.Array:
    texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    _, offsets, data = pa.concat_arrays([texts]).buffers()
    if not data:
        return texts
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(_TERM_BYTES[np.frombuffer(data, np.uint8)])])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes of text at most (column 1), or of one text."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(sizes // CHUNK)) + 1, [batch.num_rows]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Document and code of each term in turn, and the terms of the codes."""
    lists = pc.ascii_split_whitespace(_spaced(texts))
    flat, lengths = lists.flatten(), np.asarray(pc.list_value_length(lists), np.int64)
    real = np.asarray(pc.binary_length(flat), np.int64) > 0
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return np.repeat(np.arange(len(lengths)), lengths)[real], np.asarray(coded.indices, np.int64), coded.dictionary


def _stems(doc: np.ndarray, code: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``_coded`` terms as stems, without stop words."""
    stems = pa.array([None if w in STOP_WORDS else stem(w) for w in words.to_pylist()], pa.string()).dictionary_encode()
    of = np.asarray(pc.fill_null(stems.indices, -1), np.int64)[code]
    return doc[of >= 0], of[of >= 0], stems.dictionary


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        doc, code, words = _coded(part.column(1))
        n = max(1, len(words))
        pairs, tf = np.unique(doc * n + code, return_counts=True)
        of, total = pairs // n, np.bincount(doc, minlength=part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), words.take(pa.array(pairs % n)).cast(pa.string()), pa.array(tf), pa.array(total[of])], names=["doc_id", "term", "tf", "length"])


def _words(texts: pa.Array) -> int:
    """Terms of all texts: bytes of a term that follow none of its text."""
    spaced = _spaced(texts)
    offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    inside = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] != 32
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = np.unique(offsets[:-1][np.diff(offsets) > 0] - offsets[0])
    return int(starts.sum() + (inside[firsts] & ~starts[firsts]).sum())


def _sizes(english: bool):
    """Documents and terms of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            words = len(_stems(*_coded(part.column(1)))[0]) if english else _words(part.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([words])], names=["docs", "words"])

    return run


def _pack(english: bool, block: int, k1: float, b: float):
    """Postings of each block of documents, packed by term; ``most`` is without the term's idf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for part in _parts(batches):
            doc, code, words = _coded(part.column(1))
            if english:
                doc, code, words = _stems(doc, code, words)
            length, n = np.bincount(doc, minlength=part.num_rows), max(1, len(words))
            # by block, term and document; a document's terms are counted once
            keys, tf = np.unique((doc // block * n + code) * block + doc % block, return_counts=True)
            heads = np.flatnonzero(np.diff(keys // block, prepend=-1))
            offsets = pa.array(np.append(heads, len(keys)), pa.int32())
            of = keys // block // n * block + keys % block
            avg = part.column(2)[0].as_py()
            adds = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[of] / avg)) if len(keys) else np.zeros(0)
            group = keys[heads] // block
            lists = (part.column(0).take(pa.array(of)), pa.array(tf, pa.int32()), pa.array(length[of], pa.int32()))
            out = [
                words.take(pa.array(group % n)).cast(pa.string()), pa.array(at + group // n), pa.array(np.diff(np.append(heads, len(keys))), pa.int64()),
                pa.array(np.maximum.reduceat(adds, heads) if len(heads) else adds), *(pa.ListArray.from_arrays(offsets, x) for x in lists),
            ]
            at += -(-part.num_rows // block)
            rows = pa.RecordBatch.from_arrays(out, names=["term", "block", "n", "most", "docs", "tf", "length"])
            for a in range(0, rows.num_rows, 1 << 15):
                yield rows.slice(a, 1 << 15)

    return run


#: Queries of one product with a block.
ASKED = 256


def _score(k: int, k1: float, b: float):
    """The k best documents of a block for each of its queries, and those that only rounding may put beside them."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows, queries = rows.combine_chunks(), queries.combine_chunks()
        found, docs = [], pa.array([], rows.schema.field("docs").type.value_type)
        if rows.num_rows and queries.num_rows:
            lists = rows["docs"].combine_chunks()
            at = np.repeat(np.arange(rows.num_rows), np.asarray(pc.list_value_length(lists), np.int64))
            coded = lists.flatten().dictionary_encode()
            docs = coded.dictionary
            tf, length = (np.asarray(rows[c].combine_chunks().flatten(), float) for c in ("tf", "length"))
            parts = np.zeros((rows.num_rows, len(docs)))
            parts[at, np.asarray(coded.indices)] = np.asarray(rows["idf"])[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / rows["avg_length"][0].as_py()))
            asked = queries["terms"].combine_chunks()
            of = np.repeat(np.arange(queries.num_rows), np.asarray(pc.list_value_length(asked), np.int64))
            term = np.asarray(pc.fill_null(pc.index_in(asked.flatten(), value_set=rows["term"].combine_chunks()), -1), np.int64)
            for a in range(0, queries.num_rows, ASKED):
                mine = (of >= a) & (of < a + ASKED) & (term >= 0)
                holds = np.zeros((min(ASKED, queries.num_rows - a), rows.num_rows))
                holds[of[mine] - a, term[mine]] = 1
                scores = holds @ parts
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.zeros(len(scores))
                q, d = np.nonzero((scores > 0) & (scores >= least[:, None] - 2e-6))
                found.append((a + q, d, scores[q, d]))
        q, d, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        best = queries.select(["query_id", "block"]).take(pa.array(q))
        return pa.table({"query_id": best["query_id"], "block": best["block"], "doc_id": docs.take(pa.array(d)), "score": score})

    return run


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(stem)


def term_counts(corpus: DataFrame, english: bool = False) -> DataFrame:
    """``doc_id, term, tf, length``; with ``english``, stop words go and stems are counted together."""
    kind = corpus.schema["doc_id"].dataType.simpleString()
    counted = corpus.select("doc_id", "text").mapInArrow(_count, f"doc_id {kind}, term string, tf long, length long")
    if not english:
        return counted
    kept = counted.where(~F.col("term").isin(*STOP_WORDS)).withColumn("term", stemmed("term")).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    return kept.withColumn("length", F.sum("tf").over(Window.partitionBy("doc_id")))


def asked_terms(queries: DataFrame, english: bool = False) -> DataFrame:
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return asked.where(~F.col("term").isin(*STOP_WORDS)).withColumn("term", stemmed("term")).distinct() if english else asked


def idf() -> Column:
    return F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def weigh(postings: DataFrame, totals: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``part``: what a term adds to a document's score; ``postings`` has term, tf, length and df."""
    part = idf() * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return postings.join(totals).withColumn("part", part)


def corpus_totals(corpus: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: documents, those without terms too, and their mean length."""
    words = counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
    return corpus.agg(F.count("*").alias("n_docs")).join(words).select("n_docs", (F.col("words") / F.greatest("n_docs", F.lit(1))).alias("avg_length"))


def _folder(folders: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(folders))


def build(corpus: DataFrame, path: str, english: bool = False, block: int = BLOCK, folders: int = FOLDERS, k1: float = K1, b: float = B) -> Index:
    """Write the index of ``corpus`` (doc_id, text) to ``path``."""
    spark = corpus.sparkSession
    kind = corpus.schema["doc_id"].dataType.simpleString()
    corpus = corpus.select("doc_id", "text")
    sizes = corpus.mapInArrow(_sizes(english), "docs long, words long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "words")))
    sizes.select(F.col("docs").alias("n_docs"), (F.col("words") / F.greatest("docs", F.lit(1))).alias("avg_length")).coalesce(1).write.parquet(f"{path}/totals")
    totals = spark.read.parquet(f"{path}/totals")
    packed = corpus.join(totals.select("avg_length")).mapInArrow(_pack(english, block, k1, b), f"term string, block long, n long, most double, docs array<{kind}>, tf array<int>, length array<int>")
    dealt = packed.withColumn("folder", _folder(folders)).repartition("folder", F.pmod(F.xxhash64("block"), F.lit(SPREAD)))
    dealt.sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{path}/postings")
    return Index(spark, path, english, folders, k1, b)


class Index:
    """An index that ``build`` wrote."""

    def __init__(self, spark: SparkSession, path: str, english: bool = False, folders: int = FOLDERS, k1: float = K1, b: float = B):
        self.spark, self.path, self.english, self.folders, self.k1, self.b = spark, path, english, folders, k1, b

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _scores(self, asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
        """Whole scores of the k best documents of each of these (query, block) that hold an asked term."""
        weights = asked.select("folder", "term", "idf").distinct()
        # an inner join: a semi join would be moved below the join with the few terms
        found = self.table("postings").select("folder", "term", "block", "docs", "tf", "length").join(weights, ["folder", "term"]).join(blocks.select("block").distinct(), "block")
        wanted = blocks.join(asked.groupBy("query_id").agg(F.collect_list("term").alias("terms")), "query_id")
        of = lambda df, name: df.schema[name].dataType
        kinds = f"query_id {of(wanted, 'query_id').simpleString()}, block long, doc_id {of(found, 'docs').elementType.simpleString()}, score double"
        rows = found.join(self.table("totals").select("avg_length")).select("block", "term", "idf", "docs", "tf", "length", "avg_length")
        scored = rows.groupBy("block").cogroup(wanted.select("block", "query_id", "terms").groupBy("block")).applyInArrow(_score(k, self.k1, self.b), kinds)
        return scored.withColumn("score", F.round("score", 6))

    def bounds(self, queries: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
        """The asked terms with their idf, and for each (query, block) the most that a document there can score."""
        asked = asked_terms(queries, self.english).withColumn("folder", _folder(self.folders))
        met = keep(self.table("postings").select("folder", "term", "block", "n", "most").join(asked.select("folder", "term").distinct(), ["folder", "term"], "left_semi"))
        df = met.groupBy("folder", "term").agg(F.sum("n").alias("df")).join(self.table("totals"))
        asked = keep(asked.join(df, ["folder", "term"]).select("query_id", "folder", "term", idf().alias("idf")))
        return asked, met.join(asked, ["folder", "term"]).groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))

    def search(self, queries: DataFrame, k: int = 7, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """(query_id, doc_id, score, rank) of the best k, ties by doc_id; ``keep`` may persist or write what is used twice."""
        asked, bounds = self.bounds(queries, keep)
        bounds = keep(bounds)
        first = bounds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))).where(F.col("place") <= FIRST)
        scored = keep(self._scores(asked, first.select("query_id", "block"), k))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        threshold = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(threshold, "query_id", "left").where("least IS NULL OR bound + 1e-6 >= least")
        both = ranked.select("query_id", "doc_id", "score").unionByName(self._scores(asked, rest.select("query_id", "block"), k).select("query_id", "doc_id", "score"))
        return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def reach(self, queries: DataFrame, k: int = 7) -> DataFrame:
        """For each query: blocks that hold a term, and those whose bound reaches the k-th score."""
        _, bounds = self.bounds(queries)
        least = self.search(queries, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        return bounds.join(least, "query_id").groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("least").isNull() | (F.col("bound") + 1e-6 >= F.col("least"))).alias("n_reached"))
