"""A cube on disk: one Parquet folder a table, merges with a policy, appends and partial overwrites by a single writer."""

from __future__ import annotations

import warnings
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as predicate_functions
from ..operators.prefix import numbered
from ..plans.schema import KEYS, TABLES, VERSION, config_key
from .scratch import written


class OnConflict(Enum):
    ERROR = "error"
    REPLACE = "replace"
    SKIP = "skip"
    WARN = "warn"


#: Folders of a table; a replacement writes anew those of them that hold a changed key.
BUCKETS = 16


class CubeStore:
    """Tables under ``root``, each in folders by a hash of its key; one writer at a time.

    New rows are appended to their folders.  A replacement or deletion writes
    the folders that it touches anew, and no others.  Ids of new rows come from
    counts of partitions, not from one sorted list.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, buckets: int = BUCKETS):
        self.spark, self.root, self.read_only, self.buckets = spark, root.rstrip("/"), read_only, buckets
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in KEYS[name])), F.lit(self.buckets)).cast("int").alias("bucket")

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name]))

    def _read(self, name: str) -> DataFrame:
        if not self._fs.exists(self._path(name)):
            return self.spark.createDataFrame([], TABLES[name]).withColumn("bucket", F.lit(0))
        return self.spark.read.schema(T.StructType([*TABLES[name], T.StructField("bucket", T.IntegerType())])).parquet(f"{self.root}/{name}")

    def table(self, name: str) -> DataFrame:
        return self._read(name).drop("bucket")

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")
        by = rows.withColumn("bucket", self._bucket(name)).repartition("bucket")
        by.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows whose keys are known to be new."""
        self._write(name, self._shaped(name, rows), "append")

    def rewrite(self, name: str, gone: DataFrame, rows: DataFrame | None = None, on: list[str] | None = None) -> None:
        """Take away the rows whose columns ``on`` (the key) are in ``gone``, and add ``rows``; only the folders that either touches are written."""
        if self.read_only:
            raise PermissionError("the store is read-only")
        on = on or list(KEYS[name])
        old = self._read(name)
        rows = self._shaped(name, rows) if rows is not None else self.spark.createDataFrame([], TABLES[name])
        gone = gone.select(*on).distinct()
        touched = old.join(gone, on, "left_semi").select("bucket").unionByName(rows.select(self._bucket(name))).distinct()
        kept = old.join(touched, "bucket", "left_semi").join(gone, on, "left_anti").drop("bucket")
        after = written(kept.unionByName(rows))
        emptied = [r["bucket"] for r in touched.join(after.select(self._bucket(name)).distinct(), "bucket", "left_anti").collect()]  # at most as many as there are folders
        self._write(name, after, "overwrite")
        for b in emptied:
            self._fs.delete(self._path(f"{name}/bucket={b}"), True)

    def merge(self, name: str, rows: DataFrame, policy: OnConflict = OnConflict.ERROR) -> None:
        """Insert rows by the table's key; what is already there decides by the policy.  Equal keys among the new rows count once."""
        keys, old = list(KEYS[name]), self.table(name)
        rows = self._shaped(name, rows).dropDuplicates(keys)
        if policy is OnConflict.REPLACE:
            self.rewrite(name, rows, rows)
            return
        if policy in (OnConflict.ERROR, OnConflict.WARN):
            there = rows.join(old, keys, "left_semi").count()
            if there and policy is OnConflict.ERROR:
                raise ValueError(f"{name}: a key is already there")
            if there:
                warnings.warn(f"{name}: {there} rows are already there and stay as they are", stacklevel=2)
        self.append(name, written(rows.join(old.select(*keys), keys, "left_anti")))

    def get_or_create_configs(self, wanted: DataFrame) -> DataFrame:
        """(key, config_id) of func lists; unseen ones get the next ids in one batch, the first meta stays."""
        keyed = lambda df: df.withColumn("key", config_key(F.col("func_ids")))
        fresh = keyed(wanted).dropDuplicates(["key"]).join(keyed(self.table("config")).select("key"), "key", "left_anti")
        made = self.next_ids("config", "config_id", fresh, "key")
        self.append("config", written(made if "meta" in made.columns else made.withColumn("meta", F.lit("{}"))))
        return keyed(self.table("config")).join(keyed(wanted).select("key").distinct(), "key", "left_semi").select("key", "config_id", "func_ids")

    def tag_phase(self, execution_ids: DataFrame, phase: str) -> None:
        """Add a tag to executions that lack it."""
        tags = F.coalesce("phase_ids", F.array().cast("array<string>"))
        lacking = self.table("execution").join(execution_ids.select("execution_id").distinct(), "execution_id", "left_semi").where(~F.array_contains(tags, phase))
        marked = written(lacking.withColumn("phase_ids", F.concat(tags, F.array(F.lit(phase)))))
        self.rewrite("execution", marked, marked)

    def sync_features(self, features: DataFrame, memberships: DataFrame) -> None:
        """Upsert features and replace their label memberships exactly."""
        self.merge("feature", features, OnConflict.REPLACE)
        self.rewrite("feature_label_membership", features, memberships.dropDuplicates(list(KEYS["feature_label_membership"])), on=["feature_id"])

    def seed_predicates(self, predicates: dict[str, Column], dataset: str | None = None, only: list[str] | None = None) -> None:
        """Values of predicates for the stored queries, replacing those of the same names."""
        self.merge("predicate", written(predicate_functions.seed(self.table("query"), predicates, dataset, only)), OnConflict.REPLACE)

    def next_ids(self, name: str, column: str, rows: DataFrame, order: str) -> DataFrame:
        """``rows`` with ids after the table's greatest, in an order."""
        top = self.table(name).agg(F.coalesce(F.max(column), F.lit(0)).alias("top")).first()["top"]
        return numbered(rows.drop(column), [order], column, top + 1)

    def version(self) -> int:
        return VERSION
