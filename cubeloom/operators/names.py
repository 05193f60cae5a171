"""Close names by trigram indexes of tiles.

Wanted names and the names of a scope are dealt into tiles of a fixed size.  A
task meets two tiles: it indexes the names of one by their trigrams, counts
what each wanted name shares with them along the index, and hands on the k
nearest.  No pair of names is a row, and no list of names is gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.hints import LEAST, NEAREST, trigrams

#: Wanted names and names of a task, groups whose maxima bound the k-th similarity.
WANTED, NAMES, GROUPS = 1 << 13, 1 << 14, 64


def _coded(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the values of two columns under one coding."""
    both = pa.concat_arrays([*a.chunks, *b.chunks]).dictionary_encode()
    codes = np.asarray(both.indices, np.int64)
    return codes[: len(a)], codes[len(a) :], len(both.dictionary)


def _nearest(scope: list[str], k: int, least: float):
    def run(asked: pa.Table, names: pa.Table) -> pa.Table:
        names = names.sort_by([("position", "ascending"), ("name", "ascending")])
        names = pa.concat_tables([names.filter(pc.is_null(names["position"])), names.filter(pc.is_valid(names["position"]))])
        mine, theirs, n_low = _coded(asked["low"], names["low"])
        a_grams, b_grams, n_grams = _coded(pc.list_flatten(asked["g"]), pc.list_flatten(names["g"]))
        n_a, n_b = (np.asarray(pc.list_value_length(t["g"]), np.int64) for t in (asked, names))
        a_at = np.concatenate([[0], np.cumsum(n_a)])
        order = np.argsort(b_grams, kind="stable")
        holders, starts = np.repeat(np.arange(len(n_b)), n_b)[order], np.searchsorted(b_grams[order], np.arange(n_grams + 1))
        wide = len(n_b) // max(GROUPS, k)
        rows, places, found = [], [], []
        for i in range(len(n_a) if len(n_b) else 0):
            lists = [holders[starts[g] : starts[g + 1]] for g in a_grams[a_at[i] : a_at[i + 1]]]
            shared = np.bincount(np.concatenate(lists), minlength=len(n_b))
            near = shared / (n_a[i] + n_b - shared)
            near[theirs == mine[i]] = 0.0
            reach = np.partition(near[: max(GROUPS, k) * wide].reshape(-1, wide).max(axis=1), -k)[-k] if wide else 0.0
            some = np.flatnonzero((near > least) & (near >= reach))
            some = some[np.lexsort((some, -near[some]))[:k]]
            rows.append(np.full(len(some), i)), places.append(some), found.append(near[some])
        rows, places, found = (np.concatenate(c) if c else np.zeros(0) for c in (rows, places, found))
        left, right = asked.select([*scope, "wanted"]).take(pa.array(rows, pa.int64())), names.select(["name", "position"]).take(pa.array(places, pa.int64()))
        return pa.table([*left.columns, *right.columns, pa.array(found, pa.float64())], names=[*scope, "wanted", "name", "position", "similarity"])

    return run


def close_names(wanted: DataFrame, names: DataFrame, scope: list[str] | None = None, k: int = NEAREST, least: float = LEAST) -> DataFrame:
    """``scope, wanted, name, similarity, rank`` of the k nearest names above ``least``.

    ``wanted`` has the scope's columns and ``wanted``; ``names`` has them,
    ``name`` and ``position``, which breaks ties.  A name that differs in case
    only is not its own neighbour; null names are none.
    """
    scope = scope or []
    a = wanted.select(*scope, "wanted").dropna(subset=["wanted"]).distinct()
    b = names.dropna(subset=["name"]).groupBy(*scope, "name").agg(F.min("position").alias("position"))
    tiles = lambda df, size, n: df.groupBy(*scope).agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias(n))
    a_tiles, b_tiles = tiles(wanted, WANTED, "as"), tiles(names, NAMES, "bs")
    dealt = a_tiles.join(b_tiles, scope) if scope else a_tiles.join(b_tiles)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    again = [F.col(c).alias(c) for c in scope]
    a = (a.join(dealt, scope) if scope else a.join(dealt)).select(*again, own("wanted", "as").alias("a"), every("bs").alias("b"), F.col("wanted").alias("wanted"), F.lower("wanted").alias("low"), trigrams(F.col("wanted")).alias("g"))
    b = (b.join(dealt, scope) if scope else b.join(dealt)).select(*again, every("as").alias("a"), own("name", "bs").alias("b"), F.col("name").alias("name"), F.col("position").alias("position"), F.lower("name").alias("low"), trigrams(F.col("name")).alias("g"))
    kinds = StructType([*(a.schema[c] for c in [*scope, "wanted"]), b.schema["name"], b.schema["position"], StructField("similarity", DoubleType())])
    scored = a.groupBy(*scope, "a", "b").cogroup(b.groupBy(*scope, "a", "b")).applyInArrow(_nearest(scope, k, least), kinds)
    order = Window.partitionBy(*scope, "wanted").orderBy(F.desc("similarity"), "position", "name")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*scope, "wanted", "name", "similarity", "rank")
