"""Mix sources to target shares by systematic sampling.

Sources, ordered by code point with null last, weigh ``WEIGHTS`` in turn.  They
share the size of the whole table by weight; a source's target stops at
``MOST`` times its size, and what is above goes to the others by weight until
none is above.  All documents of a source have the same expected number of
copies, target / size.  In the order of (size, id) these are summed from the
source's start, a random offset below one is added, and a document is taken
once for each whole number that its interval crosses.

Since sizes only grow along that order, the words taken differ from the target
by less than the source's largest document, and a document is taken at most
``MOST`` times.  The arithmetic is in whole numbers of 2**-31 copies.

Positions come from a range sort: rows are numbered within their partition,
and a table of one row for each partition and source gives what stands before.
No key meets in one task, not even rows that are equal in everything.

A null text has size 0; a document of size 0 takes nothing; equal rows count
each; an empty table gives no rows; if every size is 0, so are all targets.
The null source is one of its own, and '' another.  Other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, column, materialize

WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more often.
MOST = 3
#: One copy in the unit that positions are counted in.
UNIT = 1 << 31


def source_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """One row a source: ``source_size, target, copies`` (expected, in units) and ``shift`` (the offset).

    A source is capped if its cap per weight is at most what the sources not
    capped before it get per weight, going by cap per weight.  The windows are
    over the table of sources, not over documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    step = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", step)
    lcm = 1
    for w in weights:
        lcm *= w
    before = Window.orderBy(F.col("source_size") * F.expr(f"{lcm} div w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    wide = lambda c: c.cast("decimal(38,0)")
    left = sources.withColumns({
        "left_size": F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "left_w": F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    left = left.withColumn("capped", most * wide(F.col("source_size")) * F.col("left_w") <= wide(F.col("w")) * F.col("left_size"))
    # the first source that is not capped tells what all that are not capped get per weight
    level = left.withColumn("level", F.max(F.when(~F.col("capped"), F.struct("left_w", "left_size"))).over(all_rows))
    size, per = F.col("level.left_size"), F.col("level.left_w")
    exact = F.expr(f"cast(w as decimal(38,0)) * {UNIT} * level.left_size div (cast(level.left_w as decimal(38,0)) * source_size)")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\n")))), 1, 7), 16, 10).cast("long") * 8
    return level.select(
        "source", "source_size",
        F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(F.col("w") * size / per).alias("target"),
        F.when(F.col("capped"), F.lit(most * UNIT)).otherwise(exact).alias("copies"), offset.alias("shift"),
    )


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """Each document with ``size, source_size, target`` (its source's), ``copies`` and ``taken`` (words, copies counted)."""
    size = F.coalesce(F.regexp_count(column(text_column), F.lit(WORD_CLASS)), F.lit(0)).cast("long")
    sized = materialize(docs.select(column(id_column).alias("doc_id"), column(source_column).alias("source"), size.alias("size")))
    ordered = sized.withColumn("tie", F.monotonically_increasing_id())
    keys = ("source", "size", "doc_id", "tie")
    numbered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    numbered = materialize(numbered.drop("tie"))
    runs = numbered.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = source_plan(sized, weights, most, seed)
    runs = runs.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.part", "r.source", "r.first", "r.before", "source_size", "target", "copies", "shift")
    placed = numbered.alias("d").join(runs.alias("r"), (F.col("d.part") == F.col("r.part")) & F.col("d.source").eqNullSafe(F.col("r.source"))).select("d.doc_id", "d.size", "source_size", "target", "copies", "shift", (F.col("at") - F.col("first") + F.col("before")).alias("i"))
    part = F.expr(f"copies % {UNIT}")
    crossed = F.when(F.expr(f"(shift + (i % {UNIT}) * (copies % {UNIT})) % {UNIT}") + part >= UNIT, 1).otherwise(0)
    times = F.expr(f"copies div {UNIT}") + crossed
    return placed.select("doc_id", "size", "source_size", "target", times.alias("copies"), (times * F.col("size")).alias("taken"))
