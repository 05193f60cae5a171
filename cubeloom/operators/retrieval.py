"""Retrieval: BM25 over a postings table, nearest vectors, and example samplers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import search


def _k_best(k: int):
    """The k best (query_id, doc_id, score) of a task for each query, as batches pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if best is None else pa.concat_tables([best, pa.Table.from_batches([batch])])
            rows = rows.sort_by([("query_id", "ascending"), ("score", "descending"), ("doc_id", "ascending")]).combine_chunks()
            if rows.num_rows:
                codes = np.asarray(rows["query_id"].combine_chunks().dictionary_encode("encode").indices)
                starts = np.flatnonzero(np.diff(codes, prepend=-1))
                place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
                best = rows.filter(pa.array(place < k))
        if best is not None:
            yield from best.to_batches()

    return run


def bm25(corpus: DataFrame, queries: DataFrame, k: int = 7, k1: float = search.K1, b: float = search.B) -> DataFrame:
    """(query_id, doc_id, score, rank): Lucene-style idf, no stemming, by one scan of the texts.

    ``corpus`` has doc_id and text, ``queries`` query_id and text; every row of
    the queries is asked.  Terms are counted where a text is read, and only
    postings of asked terms go further: by document, so that a task has whole
    scores and hands on its k best a query.  ``search.build`` is for many
    searches.
    """
    counts = search.term_counts(corpus)
    asked = search.asked_terms(queries)
    wanted = asked.select("term").distinct()
    postings = counts.join(wanted, "term", "left_semi")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    totals = search.corpus_totals(corpus, counts)
    weighed = search.weigh(postings.join(df, "term"), totals, k1, b).select("term", "doc_id", "part").repartition("doc_id")
    scores = weighed.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    best = scores.select("query_id", "doc_id", "score").mapInArrow(_k_best(k), scores.select("query_id", "doc_id", "score").schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def multi_hop(corpus: DataFrame, queries: DataFrame, rewrite, hops: int = 2, k: int = 7) -> DataFrame:
    """The union of ``hops`` retrievals; ``rewrite`` makes the next queries from (queries, found)."""
    found = None
    for hop in range(hops):
        one = bm25(corpus, queries, k).withColumn("hop", F.lit(hop + 1))
        found = one if found is None else found.unionByName(one)
        if hop + 1 < hops:
            queries = rewrite(queries, one)
    return found


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.sqrt(dot(v, v)))


#: Probes of one product; probes and vectors of a task; vectors of one product.
BLOCK, ASKED, AGAINST, CHUNK = 256, 1 << 15, 1 << 14, 1 << 12
_NULL = -1e290


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths (-1: null, or with a null number) and the numbers as 64-bit floats end to end, by id."""
    table = table.sort_by("vec_id")
    lists = table.column("embedding").combine_chunks()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), -1), np.int64)
    flat = lists.flatten()
    if flat.null_count:
        of = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
        holed = np.isin(of, of[np.asarray(pc.is_null(flat))])
        lengths[np.unique(of[holed])] = -1
        flat = flat.filter(pa.array(~holed))
    return np.asarray(table.column("vec_id"), np.int64), lengths, flat.to_numpy(zero_copy_only=False).astype(float)


def _products(p: np.ndarray, p_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Dot products of two runs of vectors; ``_NULL`` where one is null or the lengths differ, and above all others where one is no number."""
    if (p_len == p_len[0]).all() and (b_len == p_len[0]).all() and p_len[0] > 0:
        scores = p.reshape(len(p_len), -1) @ b.reshape(len(b_len), -1).T
    else:
        scores = np.full((len(p_len), len(b_len)), _NULL)
        for w in np.intersect1d(p_len[p_len >= 0], b_len):
            some = lambda v, n: v[np.repeat(n == w, np.maximum(n, 0))].reshape(int((n == w).sum()), w)  # noqa: B023, E731
            scores[np.ix_(p_len == w, b_len == w)] = some(p, p_len) @ some(b, b_len).T
    return scores if np.isfinite(p).all() and np.isfinite(b).all() else np.nan_to_num(scores, nan=-_NULL)


def _least(scores: np.ndarray, k: int) -> np.ndarray:
    """A number for each row that k scores or more reach: the k-th largest of the maxima of groups."""
    groups = max(64, 2 * k)
    wide = scores.shape[1] // groups
    if not wide:
        return np.full(len(scores), -np.inf)
    most = scores[:, : groups * wide].reshape(len(scores), groups, wide).max(axis=2)
    return np.partition(most, groups - k, axis=1)[:, groups - k]


def _best_of(k: int, block: int):
    """The k best of a tile of vectors for each probe of a tile, by score to six places and then by id.

    Vectors come by id, so that one that only equals the k-th best so far is
    out; few scores reach the bound, and only those are rounded and sorted.
    """

    def run(asked: pa.Table, against: pa.Table) -> pa.Table:
        probes, p_len, p_data = _matrix(asked)
        ids, b_len, b_data = _matrix(against)
        p_at, b_at = (np.concatenate([[0], np.cumsum(np.maximum(n, 0))]) for n in (p_len, b_len))
        out = []
        for i in range(0, len(probes), block):
            mine = probes[i : i + block]
            n = len(mine)
            best, best_id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
            for j in range(0, len(ids), CHUNK):
                theirs = ids[j : j + CHUNK]
                scores = _products(p_data[p_at[i] : p_at[i + n]], p_len[i : i + n], b_data[b_at[j] : b_at[j + len(theirs)]], b_len[j : j + CHUNK])
                first, last = np.searchsorted(theirs, mine), np.searchsorted(theirs, mine, "right")
                for r in np.flatnonzero(first < last):
                    scores[r, first[r] : last[r]] = -np.inf
                reach = np.maximum(_least(scores, k) - 1.1e-6, best[:, -1] + 0.4e-6)
                row, col = np.nonzero(scores >= reach[:, None])
                found = scores[row, col]
                found = np.copysign(np.floor(np.abs(found) * 1e6 + 0.5) / 1e6, found)
                rows = np.concatenate([np.repeat(np.arange(n), k), row])
                all_scores, all_ids = np.concatenate([best.ravel(), found]), np.concatenate([best_id.ravel(), theirs[col]])
                order = np.lexsort((all_ids, -all_scores, rows))
                starts = np.searchsorted(rows[order], np.arange(n))
                order = order[(starts[:, None] + np.arange(k)).ravel()]
                best, best_id = all_scores[order].reshape(n, k), all_ids[order].reshape(n, k)
            real = np.isfinite(best)
            out.append((np.repeat(mine, k)[real.ravel()], best_id[real], best[real]))
        probe, neighbour, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        score = np.where(score > -_NULL / 2, np.nan, score)
        return pa.table({"probe": probe, "neighbour": neighbour, "score": pa.array(score, mask=score < _NULL / 2)})

    return run


def knn_blocks(vectors: DataFrame, probes: DataFrame, k: int = 3, block: int = BLOCK, text: str | None = None) -> DataFrame:
    """Exact nearest vectors of many probes: matrix products of ``block`` probes with some thousand vectors, of which the best k of each probe go on.

    ``vectors`` and ``probes`` have vec_id (a whole number) and embedding.
    With a ``text`` column, equal texts among the vectors count once, under
    the least id.  Both sides are dealt into tiles of a fixed size by the hash
    of the id, and a task meets two tiles, so its memory is bounded; a vector
    is sent once for each tile of the other side.  Scores have six places and
    ties go by id; a null vector, or one of another length, has a null score
    and comes last.
    """
    pool = vectors if text is None else vectors.groupBy(text).agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("v")).select("v.*")
    tiles = lambda df, size, name: df.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias(name))
    dealt = tiles(vectors, AGAINST, "bs").join(tiles(probes, ASKED, "ps"))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = probes.dropna(subset=["vec_id"]).join(dealt).select(own("ps").alias("p"), every("bs").alias("b"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    against = pool.dropna(subset=["vec_id"]).join(dealt).select(every("ps").alias("p"), own("bs").alias("b"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    met = asked.groupBy("p", "b").cogroup(against.groupBy("p", "b")).applyInArrow(_best_of(k, block), "probe long, neighbour long, score double")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "neighbour")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(vectors: DataFrame, probes: DataFrame, k: int = 3) -> DataFrame:
    """Exact nearest vectors by dot product: a stated probe set against all rows, by ``knn_blocks``."""
    return knn_blocks(vectors, probes, k)


def mmr(candidates: DataFrame, k: int = 3, diversity: float = 0.3) -> DataFrame:
    """Maximal marginal relevance over each probe's candidates (probe, neighbour, score, embedding)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "neighbour"], ascending=[False, True])
        v = np.stack(frame["embedding"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        relevance, chosen = frame["score"].to_numpy(dtype=float), []
        while len(chosen) < min(k, len(frame)):
            near = (v @ v[chosen].T).max(axis=1) if chosen else np.zeros(len(v))
            gain = (1 - diversity) * relevance - diversity * near
            gain[chosen] = -np.inf
            chosen.append(int(np.argmax(gain)))
        out = frame.iloc[chosen][["probe", "neighbour"]].copy()
        out["rank"] = range(1, len(chosen) + 1)
        return out

    return candidates.groupBy("probe").applyInPandas(run, "probe bigint, neighbour bigint, rank int")


def sample_examples(vectors: DataFrame, probes: DataFrame, k: int = 3, diversity: float = 0.3) -> DataFrame:
    """Nearest ten times k candidates, then MMR."""
    near = knn(vectors, probes, 10 * k)
    return mmr(near.join(vectors.select(F.col("vec_id").alias("neighbour"), "embedding"), "neighbour").select("probe", "neighbour", "score", "embedding"), k, diversity)


def overlap_similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of two non-negative vectors."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    least, most = F.zip_with(a, b, lambda x, y: F.least(x, y).cast("double")), F.zip_with(a, b, lambda x, y: F.greatest(x, y).cast("double"))
    return F.coalesce(F.try_divide(total(least), total(most)), F.lit(0.0))


def hybrid(a: Column, b: Column, alpha: float = 0.5) -> Column:
    return alpha * a + (1 - alpha) * b


def random_examples(examples: DataFrame, queries: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k examples a query in an order that only the seed and the two ids decide."""
    pairs = examples.crossJoin(queries)
    order = Window.partitionBy("query_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "query_id", "example_id")), "example_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "example_id", "rank")
