"""From raw documents to packed training sequences, in five written stages.

Each stage works on all that its predecessor kept, and all but the last return
the columns of ``documents``, whatever others come along and however they are
named.  A table without rows gives one without rows at every stage; null and
empty texts are clean, have no lines and no near duplicates, and are packed as
one closing mark each; equal rows are judged alike, and one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import decontaminate, jaccard, lines, packing, toxicity
from cubeloom.llm.common import materialize, table
from cubeloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier clean than toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=tuple(docs.columns))
    return scored.where("predicted = 0").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that recur across documents; n_chars follows the text."""
    kept = lines.drop_recurring_lines(docs, copies=True)
    old = lambda c: F.col("row").getField(c)
    count = F.when(F.col("n_removed") > 0, F.char_length(old("text")).cast(docs.schema["n_chars"].dataType)).otherwise(old("n_chars"))
    return kept.select(*((count if c == "n_chars" else old(c)).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: The first stage learns a classifier, which SQL cannot express; ``tests/llm/test_pipeline.py`` runs every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
