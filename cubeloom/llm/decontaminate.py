"""Operator 6: benchmark decontamination by size-partitioned MinHash containment.

A test item is the set of its distinct five-word shingles (lower-cased A-Z).
Items are partitioned by set size.  An item of n shingles is contained in a
document when at least ceil(t n) of them occur there, so any
k = n - ceil(t n) + 1 of them must include one that occurs: the sketch of an
item is its k smallest hashes (its bottom-k MinHash), with k taken from the
size partition, and no contained item is missed at any document length.

Documents are probed with the sketches only.  The documents that meet a
sketch, and no others, are read again, and the whole sets of a document and of
each item that it met are compared: exact shingle containment.

An item with fewer than five words is one shingle, its whole word sequence,
and is contained in documents that have the same whole sequence.  Null and
empty texts, and items without words, match nothing.  Rows that share an id
are one item or document for each distinct text.  A share of exactly the
threshold is contained; of several texts of one id the best counts.  Without
items or documents nothing is found.  Texts of any length are read whole, one
row's array at a time; other columns may have any name, and ids any name too.

DataFrame functions only.  The sketches are broadcast only when they have at
most ``BROADCAST_SHINGLES`` hashes; a larger benchmark is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, let, lower_ascii, materialize, whole_row, words_column

SHINGLE = 5
THRESHOLD = 0.75
BROADCAST_SHINGLES = 200_000


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of a text's shingles."""

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        whole = F.array(F.xxhash64(F.concat(F.lit("\n"), F.array_join(w, " "))))
        return F.when(F.size(w) >= n, windows).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(words_column(lower_ascii(text)), of)


def sketches(items: DataFrame, id_column: str, text_column: str, threshold: float) -> DataFrame:
    """item_id, _item, its sorted _set of _n hashes, and _sketch, the least of them."""
    sets = (
        items.select(column(id_column).alias("item_id"), F.xxhash64(column(id_column), column(text_column)).alias("_item"), F.sort_array(F.array_distinct(shingle_hashes(column(text_column)))).alias("_set"))
        .where(F.size("_set") > 0)
        .dropDuplicates(["item_id", "_item"])
    )
    n = F.size("_set")
    # the size partition decides the sketch length
    return sets.select("item_id", "_item", n.alias("_n"), "_set", F.slice("_set", 1, n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1).alias("_sketch"))


def containments(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row for each document text (_doc) and item text that it contains: doc_id, item_id, _n and n_shared."""
    held = materialize(sketches(items, item_id, item_text, threshold))
    probe = held.select("_item", F.explode("_sketch").alias("_hash"))
    bound = F.broadcast if probe.count() <= BROADCAST_SHINGLES else (lambda x: x)
    named = docs.select(column(id_column).alias("doc_id"), F.xxhash64(column(id_column), column(text_column)).alias("_doc"), column(text_column).alias("_text")).where(F.col("_text").isNotNull())
    met = named.select("_doc", F.explode(shingle_hashes(F.col("_text"))).alias("_hash")).join(bound(probe.select("_hash").distinct()), "_hash")
    candidates = materialize(met.distinct().join(bound(probe), "_hash").select("_doc", "_item").distinct())
    # only documents that met a sketch are read again
    sets = named.join(candidates.select("_doc").distinct(), "_doc", "left_semi").dropDuplicates(["_doc"]).select("doc_id", "_doc", F.array_distinct(shingle_hashes(F.col("_text"))).alias("_have"))
    pairs = candidates.join(sets, "_doc").join(held.select("item_id", "_item", "_n", "_set"), "_item")
    shared = F.size(F.array_intersect("_set", "_have")).cast("bigint")
    return pairs.select("doc_id", "_doc", "item_id", "_item", "_n", shared.alias("n_shared")).where(F.col("n_shared") >= F.ceil(F.col("_n") * F.lit(threshold) - 1e-9))


def contained_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each document and item that it contains: doc_id, item_id, n_shingles, n_shared."""
    found = containments(docs, items, **options)
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(F.col("_n").cast("bigint").alias("n"), "n_shared"), F.struct(F.col("n_shared") / F.col("_n"), "_n")).alias("best")).select(
        "doc_id", "item_id", F.col("best.n").alias("n_shingles"), F.col("best.n_shared").alias("n_shared")
    )


def clean(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that contain a test item."""
    dirty = materialize(containments(docs, items, id_column, text_column, **options).select("_doc").distinct())
    rows = docs.select(whole_row(docs).alias("row"), F.xxhash64(column(id_column), column(text_column)).alias("_doc"))
    return rows.join(dirty, "_doc", "left_anti").select("row.*")
