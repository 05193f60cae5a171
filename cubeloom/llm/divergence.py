"""How far the sources of each language differ in their words, all sums exact.

Terms are the maximal runs of A-Z, a-z and characters from U+0080 on, with A-Z
lower-cased.  A language keeps the terms that at least ``MIN_DOCS`` of its
documents hold: V of them.  A group is a (language, source); a group or a whole
language in which a kept term occurs ``count`` times, and all of them N times,
gives it ``p = 1 + floor(1000000000 * (count + 2) / (N + 2 * V))``, also at
count 0, where p is called z.  Two such numbers differ by
``f(p, q) = floor((p - q) * (p - q) / (p + q))``.

The sum of f over all kept terms is taken apart for each pair of groups:

* ``V * f(z, z')``, as if no term occurred in either;
* what the occurrences in one group change against z' of the other, which
  depends on the count alone, so equal counts of a group are taken together;
* what terms in *both* groups change beyond that.  Terms of many groups
  (heavy) are laid out as dense tiles of terms by groups in numpy; terms of at
  most ``LIGHT`` groups give one correction for each pair of their postings.

Each part is whole numbers, and the pair's value is their sum.  No task holds
more than a tile, or the postings of one light term.

Null text, language and source read as ''.  Repeated rows are documents of
their own; equal values rank by item; an empty table gives no rows; a group
without terms has pairs, and a language without kept terms has pairs of 0.
Texts of any length are handled; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, column, column_of, materialize, split_words

#: A kept term is in so many documents of its language.
MIN_DOCS = 10
#: Terms of at most so many groups are light: at most LIGHT * (LIGHT - 1) / 2 corrections each.
LIGHT = 12
#: A dense tile has about so many terms, and so many groups a side.
TILE_TERMS, TILE_GROUPS = 4096, 64
#: Ranks of part ``term``.
TOP = 10

_TERM_BYTES = np.arange(256, dtype=np.uint8)
_TERM_BYTES[:128] = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)]


def only_terms(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and a space for every other character below U+0080."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    if not data:
        return texts
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(_TERM_BYTES[np.frombuffer(data, np.uint8)])])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group, added up within a chunk of texts."""
    for batch in chunks(batches):
        words, starts = split_words(only_terms(column_of(batch, "text")))
        if not len(words):
            continue
        coded = words.dictionary_encode()
        langs, sources = (pc.fill_null(column_of(batch, c), "").dictionary_encode() for c in ("lang", "source"))
        group = np.asarray(langs.indices, np.int64) * len(sources.dictionary) + np.asarray(sources.indices, np.int64)
        n_words = len(coded.dictionary)
        doc = np.repeat(np.arange(len(group)), np.diff(starts))
        in_doc, times = np.unique(doc * n_words + np.asarray(coded.indices, np.int64), return_counts=True)
        keys, at = np.unique(group[in_doc // n_words] * n_words + in_doc % n_words, return_inverse=True)
        of = keys // n_words
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary))), coded.dictionary.take(pa.array(keys % n_words)).cast(pa.string()),
                pa.array(np.bincount(at, weights=times).astype(np.int64)), pa.array(np.bincount(at).astype(np.int64)),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def share(count: str, total: str) -> str:
    """SQL of ``1 + floor(1000000000 * count / total)`` in three steps, so that no product passes 64 bits; null for a total of 0."""
    of = f"nullif({total}, 0)"
    rest = f"(1000 * ({count}) % {of})"
    last = f"(1000 * {rest} % {of})"
    return f"(1 + 1000000 * (1000 * ({count}) div {of}) + 1000 * (1000 * {rest} div {of}) + (1000 * {last} div {of}))"


def differ(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tile(rows: pa.Table) -> pa.Table:
    """For the pairs of groups of one tile: what its terms in both groups change beyond what each changes alone."""
    numbers = lambda name: np.asarray(rows.column(name), np.int64)
    order = lambda name: np.unique(np.asarray(rows.column(name).to_pylist(), dtype=object), return_inverse=True)
    (sources, at), (terms, line), tile = order("source"), order("term"), numbers("tile")
    z, side = np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
    z[at], side[at] = numbers("z"), tile
    p = np.tile(z, (len(terms), 1))
    p[line, at] = numbers("p")
    across = rows.column("tile_a")[0].as_py() != rows.column("tile_b")[0].as_py()
    a_of, b_of, gained = [], [], []
    for g in range(len(sources)):
        others = np.arange(g + 1, len(sources))
        others = others[side[others] != side[g]] if across else others
        own = p[:, g : g + 1]
        sums = (_f(own, p[:, others]) - _f(own, z[others]) - _f(z[g], p[:, others])).sum(axis=0) + len(terms) * _f(z[g], z[others])
        a_of += [sources[g]] * len(others)
        b_of += sources[others].tolist()
        gained += sums.tolist()
    lang = pa.array([rows.column("lang")[0].as_py()] * len(gained), pa.string())
    return pa.table([lang, pa.array(a_of, pa.string()), pa.array(b_of, pa.string()), pa.array(gained, pa.int64())], names=["lang", "a", "b", "value"])


def audit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", min_docs: int = MIN_DOCS, light: int = LIGHT, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources (``pair``) and the words that mark a source (``term``)."""
    named = docs.select(column(text_column).alias("text"), column(lang_column).alias("lang"), column(source_column).alias("source"))
    counted = named.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = materialize(
        counted.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "n_groups": F.count("*").over(of_term), "first": (F.col("source") == F.min("source").over(of_term)).cast("long")})
        .where(F.col("lang_docs") >= min_docs)
        .drop("docs", "lang_docs")
    )
    groups = _groups(named, kept)
    postings = kept.join(groups, ["lang", "source"]).withColumn("p", F.expr(share("n + 2", "total + 2 * v")))

    marks = postings.withColumn("q", F.expr(share("lang_n + 2", "lang_total + 2 * v"))).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), differ("p", "q").alias("value"))
    parts = _pair_parts(postings, groups, light).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = parts.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(marks).where(F.col("rank") <= top))


def _groups(named: DataFrame, kept: DataFrame) -> DataFrame:
    """Every group with its N, its language's N and V, and its z."""
    all_groups = named.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    joined = all_groups.join(sizes, ["lang", "source"], "left").na.fill(0, ["total", "firsts"])
    langs = joined.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("v"), F.count("*").alias("n_sources"))
    return materialize(joined.join(langs, "lang").drop("firsts").withColumn("z", F.expr(share("2", "total + 2 * v"))))


def _pair_parts(postings: DataFrame, groups: DataFrame, light: int) -> DataFrame:
    """``lang, a, b, value`` with a < b: partial sums, of which each pair has several."""
    one, other = (groups.select("lang", F.col("source").alias(name), F.col("z").alias(f"z_{name}"), "v") for name in ("a", "b"))
    bare = one.join(other.drop("v"), "lang").where("a < b").select("lang", "a", "b", F.when(F.col("v") == 0, F.lit(0)).otherwise(F.col("v") * differ("z_a", "z_b")).alias("value"))

    counts = postings.groupBy("lang", "source", "p", "z").agg(F.count("*").alias("k"))
    alone = (
        counts.join(other.drop("v"), "lang").where("source <> b")
        .select("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), (F.col("k") * (differ("p", "z_b") - differ("z", "z_b"))).alias("value"))
    )

    lists = postings.where(F.col("n_groups").between(2, light)).groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "z"))).alias("l"))
    paired = lists.select("lang", "l", F.posexplode("l").alias("i", "x")).select("lang", "x", F.explode(F.expr("slice(l, i + 2, size(l))")).alias("y"))
    met = differ("x.p", "y.p") - differ("x.p", "y.z") - differ("x.z", "y.p") + differ("x.z", "y.z")
    sparse = paired.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), met.alias("value"))

    tiles = F.ceil(F.col("n_sources") / TILE_GROUPS).cast("int")
    heavy = postings.where(F.col("n_groups") > light).select(
        "lang", "source", "term", "p", "z", tiles.alias("tiles"), F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile"), F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / TILE_TERMS)).alias("block"),
    )
    heavy = heavy.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    heavy = heavy.select("lang", "source", "term", "p", "z", "tile", "block", F.least("tile", "with").alias("tile_a"), F.greatest("tile", "with").alias("tile_b"))
    dense = heavy.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(_tile, "lang string, a string, b string, value long")
    return bare.unionByName(alone).unionByName(sparse).unionByName(dense)
