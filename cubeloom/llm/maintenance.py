"""Maintain a joined, grouped view through batches of inserts and deletes.

The view joins lines, sales, clients and vendors, where client and vendor are
of one region, and gives for each (region, part) the number of lines, the sum
and least of their revenues, and the numbers of distinct clients and items.

Change logs come as tables whose rows carry ``born`` and ``dead``: the batch
that inserts the row (-1: it is there before batch 0) and the one that deletes
it (the number of batches: it stays).  One pass of merge joins turns the logs of
the tables into the log of the *materialised join*: a joined row is born with
the last of its parts and dies with the first.  From there on every batch costs
what it changes:

* **sums**: a batch adds its lines and revenues and takes away those that die;
* **counted ids**: each (group, id) has a row with its count, which a batch
  moves; an id that leaves zero or comes to it changes the distinct number;
* **least revenue**: each group keeps a buffer of its ``k`` least revenues with
  their counts, and a bound up to which it knows all of them.  A batch applies
  the changes up to that bound, in one Spark job for all groups.  A buffer
  that has run empty, while there may be revenues beyond its bound, is filled
  again from the counted revenues of the materialised join.

Nothing that grows with the input is broadcast or goes through one task: hot
clients, sales and vendors are left to Spark's skew join, and hot groups are
added up before the shuffle.  What is sorted by group is a buffer and as much
of each task's changes as can enter it.

Rows with a null key join nothing.  Lines without amount, or whose sale has no
date, or whose client or vendor has no nation with a region, are in no group.
A null id is no item; a null discount makes a revenue null, and the line counts
without one.  Equal rows count each; empty tables give no rows; clashing names
of other columns do not matter, as only the named ones are read.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Revenues that a group's buffer keeps.
K = 16
#: Parts of a group that are cut down to a buffer's length before they meet.
SALTS = 4
GROUP = ("region", "part")


def intervals(name: Column, batches: int = 7) -> list[Column]:
    """``born`` and ``dead`` of a row by the checksum of its name; without a name it is always there."""
    h = F.crc32(name)
    a, d = h % batches, F.floor(h / batches) % batches
    return [F.when(a < d, a).otherwise(-1).cast("int").alias("born"), F.when(a < d, d).otherwise(batches).cast("int").alias("dead")]


def join_log(lines: DataFrame, sales: DataFrame, clients: DataFrame, vendors: DataFrame) -> DataFrame:
    """The log of the joined rows.

    ``lines``: sale_id, vendor_id, item_id, revenue; ``sales``: sale_id,
    client_id, part; ``clients``: client_id, region; each with born and dead;
    ``vendors``: vendor_id, region.  Merge joins, as every side grows with the
    input; rows whose lives don't meet go at each step.
    """

    def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        right = right.withColumnsRenamed({"born": "_born", "dead": "_dead"}).hint("merge")
        both = left.join(right, on).withColumns({"born": F.greatest("born", "_born"), "dead": F.least("dead", "_dead")})
        return both.where("born < dead").drop("_born", "_dead")

    sold = meet(sales.dropna(subset=["part"]), clients.dropna(subset=["region"]), ["client_id"])
    placed = meet(lines, sold, ["sale_id"]).drop("sale_id")
    return placed.join(vendors.dropna(subset=["region"]).hint("merge"), ["vendor_id", "region"]).select(*GROUP, "client_id", "item_id", "revenue", "born", "dead")


def _moved(batch: int, by: Column | None = None) -> Column:
    """What a batch adds to a sum over the log: its born rows less its dead ones."""
    return F.coalesce(F.sum(((F.col("born") == batch).cast("long") - (F.col("dead") == batch).cast("long")) * (1 if by is None else by)), F.lit(0))


def _steps(batches: int) -> range:
    return range(-1, batches)


def _name(kind: str, batch: int) -> str:
    return f"{kind}{batch + 1}"


def id_changes(log: DataFrame, column: str, kind: str, batches: int) -> DataFrame:
    """By group, how each batch changes the number of distinct ids, from a table of counted ids."""
    counted = log.dropna(subset=[column]).groupBy(*GROUP, column).agg(*(_moved(b).alias(_name("c", b)) for b in _steps(batches)))
    there = lambda b: (reduce(add, (F.col(_name("c", i)) for i in range(-1, b + 1))) > 0).cast("long") if b >= -1 else F.lit(0)
    return counted.groupBy(*GROUP).agg(*(F.sum(there(b) - there(b - 1)).alias(_name(kind, b)) for b in _steps(batches)))


def _least(rows: DataFrame, k: int) -> DataFrame:
    """Buffers of ``region, part, revenue, n, bound``: a null revenue only brings its group's old bound."""
    summed = rows.groupBy(*GROUP, "revenue").agg(F.sum("n").alias("n"), F.max("bound").alias("bound")).where("n > 0 OR revenue IS NULL")
    near = summed.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("revenue"), F.lit(SALTS)), F.lit(0)))
    for keys in ((*GROUP, "salt"), GROUP):  # what a hot group sends to one task is first cut down by salts
        near = near.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("revenue").asc_nulls_first()))).where(F.col("place") <= k + 2)
    known = F.array_sort(F.collect_list(F.when(F.col("revenue").isNotNull(), F.struct("revenue", "n"))))
    found = near.groupBy(*GROUP).agg(known.alias("known"), F.max("bound").alias("bound"))
    cut = F.when(F.size("known") > k, F.element_at("known", k)["revenue"]).otherwise(F.col("bound"))
    return found.select(*GROUP, F.slice("known", 1, k).alias("known"), cut.alias("bound")).where("bound IS NOT NULL OR size(known) > 0")


def _rows_of(buffers: DataFrame) -> DataFrame:
    bounds = buffers.select(*GROUP, F.lit(None).cast("long").alias("revenue"), F.lit(0).cast("long").alias("n"), "bound")
    return bounds.unionByName(buffers.select(*GROUP, F.explode("known").alias("x")).select(*GROUP, "x.revenue", "x.n", F.lit(None).cast("long").alias("bound")))


def step(buffers: DataFrame, revenues: DataFrame, batch: int, k: int) -> tuple[DataFrame, int]:
    """The buffers after a batch, and how many groups were filled again from the materialised join."""
    moved = F.col(_name("c", batch))
    changes = revenues.where(moved != 0).select(*GROUP, "revenue", moved.alias("n")).join(buffers.select(*GROUP, F.col("bound").alias("limit")), list(GROUP), "left")
    inside = changes.where("limit IS NULL OR revenue <= limit").select(*GROUP, "revenue", "n", F.lit(None).cast("long").alias("bound"))
    after = materialize(_least(_rows_of(buffers).unionByName(inside), k))
    empty = after.where("size(known) = 0")
    refills = empty.count()
    if not refills:
        return after, 0
    now = reduce(add, (F.col(_name("c", b)) for b in range(-1, batch + 1)))
    full = revenues.join(empty.select(*GROUP), list(GROUP), "left_semi").select(*GROUP, "revenue", now.alias("n"), F.lit(None).cast("long").alias("bound"))
    filled = materialize(after.where("size(known) > 0").unionByName(_least(full, k)))
    discard(after)
    return filled, refills


def maintain(lines: DataFrame, sales: DataFrame, clients: DataFrame, vendors: DataFrame, batches: int = 7, k: int = K) -> DataFrame:
    """``batch, region, part, n_lines, revenue, min_revenue, n_clients, n_items`` of the nonempty groups after each batch; inputs as in ``join_log``."""
    log = materialize(join_log(lines, sales, clients, vendors))
    sums = log.groupBy(*GROUP).agg(*(c for b in _steps(batches) for c in (_moved(b).alias(_name("l", b)), _moved(b, F.col("revenue")).alias(_name("r", b)))))
    wide = sums.join(id_changes(log, "client_id", "u", batches), list(GROUP), "left").join(id_changes(log, "item_id", "i", batches), list(GROUP), "left")
    so_far = lambda kind, b: reduce(add, (F.coalesce(_name(kind, i), F.lit(0)) for i in range(-1, b + 1)))
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("batch"), so_far("l", b).alias("n_lines"), so_far("r", b).alias("revenue"), so_far("u", b).alias("n_clients"), so_far("i", b).alias("n_items")) for b in range(batches))))
    states = wide.select(*GROUP, each.alias("x")).select("x.batch", *GROUP, "x.n_lines", "x.revenue", "x.n_clients", "x.n_items").where("n_lines > 0")

    revenues = materialize(log.dropna(subset=["revenue"]).groupBy(*GROUP, "revenue").agg(*(_moved(b).alias(_name("c", b)) for b in _steps(batches))))
    buffers = materialize(_least(revenues.where(F.col(_name("c", -1)) > 0).select(*GROUP, "revenue", F.col(_name("c", -1)).alias("n"), F.lit(None).cast("long").alias("bound")), k))
    least = []
    for b in range(batches):
        buffers, _ = step(buffers, revenues, b, k)
        least.append(buffers.select(F.lit(b).alias("batch"), *GROUP, F.element_at("known", 1)["revenue"].alias("min_revenue")))
    return states.join(reduce(DataFrame.unionByName, least), ["batch", *GROUP], "left").select("batch", *GROUP, "n_lines", "revenue", "min_revenue", "n_clients", "n_items")
