"""Readers of benchmark files into the query table's shape: query_id, dataset, content, meta (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import hash_lines
from ..plans.schema import query_key


def first_text(*columns: Column) -> Column:
    """The first that is not null or blank."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns))


def as_queries(rows: DataFrame, dataset: str, content: Column, context: Column, meta: dict[str, Column]) -> DataFrame:
    packed = F.to_json(F.struct(*(c.alias(k) for k, c in meta.items())))
    out = rows.select(query_key(F.lit(dataset), context.cast("string"), content).alias("query_id"), F.lit(dataset).alias("dataset"), content.alias("content"), packed.alias("meta"))
    return out.where(F.coalesce(F.trim("content"), F.lit("")) != "")


def _optional(rows: DataFrame, *names: str) -> list[Column]:
    return [F.col(f"`{n}`") for n in names if n in rows.columns] or [F.lit(None).cast("string")]


def read_table_questions(spark: SparkSession, path: str, dataset: str = "wtq", split: str = "dev") -> DataFrame:
    """JSON lines with question, answers and a table."""
    rows = spark.read.json(path)
    answers = first_text(*[F.to_json(F.struct(c.alias("a"))) for c in _optional(rows, "answers", "answer")])
    return as_queries(rows, dataset, rows["question"], _optional(rows, "table", "table_id", "id")[0], {"split": F.lit(split), "gold_answers": answers})


def read_statements(spark: SparkSession, path: str, split: str = "dev") -> DataFrame:
    """Statements over tables of '#'-separated lines."""
    rows = spark.read.json(path)
    return as_queries(rows, "tab_fact", rows["statement"], rows["table_text"], {"split": F.lit(split), "gold_label": rows["label"], "table": hash_lines(rows["table_text"])})


def with_history(turns: DataFrame, sequence: str, position: str, question: str, answer: str) -> DataFrame:
    """Each turn with all turns of its sequence at a smaller position."""
    w = Window.partitionBy(sequence).orderBy(position).rangeBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("history", F.collect_list(F.struct(F.col(question).alias("question"), F.col(answer).alias("answer"))).over(w))


def read_sequences(spark: SparkSession, path: str, split: str = "dev") -> DataFrame:
    """A TSV of sequential questions: id, annotator, position, question, table_file, answers."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    rows = rows.withColumn("position", F.col("position").cast("int")).withColumn("sequence_id", F.concat_ws("-", "id", "annotator"))
    rows = with_history(rows, "sequence_id", "position", "question", "answer_text")
    return as_queries(rows, "sqa", rows["question"], F.concat_ws(":", "sequence_id", "position"), {"split": F.lit(split), "position": rows["position"], "history": rows["history"], "gold_answer": rows["answer_text"]})


def read_privacy(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """Requests with terms that must not leak, under any of the usual names."""
    rows = spark.read.json(path)
    content = first_text(*_optional(rows, "user_query", "query", "prompt"))
    terms = first_text(*_optional(rows, "pii_units", "pii", "forbidden_terms"))
    return as_queries(rows, "pupa", content, F.lit(""), {"split": F.lit(split), "reference": first_text(*_optional(rows, "target_response", "reference", "response")), "forbidden_terms": F.filter(F.split(terms, r"\|\|"), lambda t: F.trim(t) != "")})


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """``title | text`` passages of a JSON lines corpus."""
    rows = spark.read.json(path)
    body = F.array_join(rows["text"], "") if dict(rows.dtypes)["text"].startswith("array") else rows["text"]
    return rows.select(F.concat_ws(" | ", "title", body).alias("passage")).where("passage <> ''")


def read_jsonl(spark: SparkSession, path: str, dataset: str, content: str, context: tuple[str, ...], keep: tuple[str, ...], split: str) -> DataFrame:
    """Any JSON lines benchmark: the content field, the fields that make it unique, and fields to keep."""
    rows = spark.read.json(path)
    return as_queries(rows, dataset, F.col(content), F.concat_ws(":", *(F.col(c).cast("string") for c in context)) if context else F.lit(""), {"split": F.lit(split), **{k: F.col(k) for k in keep if k in rows.columns}})


def reservoir(rows: DataFrame, n: int, key: str, seed: int | None = None) -> DataFrame:
    """The first n rows by key, or n in an order that a seed decides, given back in key order."""
    order = F.col(key) if seed is None else F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.orderBy(order, key).limit(n).orderBy(key)


def failed_predictions(cubes: list, scorer: str) -> DataFrame:
    """Wrong, non-empty predictions of several cubes, distinct by (query, normalized SQL) with counts and models."""
    from ..functions.scalars import sql_text

    out = None
    for cube in cubes:
        rows = cube.all_scores(scorer=scorer).where((F.col("score") == 0) & (F.coalesce(F.trim("prediction"), F.lit("")) != "")).select("query_id", "model", sql_text(F.col("prediction")).alias("wrong"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("query_id", "wrong").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


# -- readers that need a line's number, a nested table or a database -----------

# The kinds of question that are answered in text, and the kind that asks for a plot.
TEXT_QTYPES = ("FactChecking", "NumericalReasoning", "DataAnalysis")
PLOT_QTYPE = "Visualization"
VARIANTS = ("DP", "TCoT", "SCoT", "PoT")


def numbered_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines with their line number as ``source_line``, going on through the files of a folder; the schema is inferred where none is given."""
    from .numbered import numbered_lines

    shape = schema or spark.read.json(path).schema
    lines = numbered_lines(spark, path, across=True).where(F.trim("value") != "")
    return lines.select(F.col("line").alias("source_line"), F.from_json("value", shape).alias("j")).select("source_line", "j.*")


def _table_of(rows: DataFrame) -> Column:
    """header, rows and name of a table given as columns and data, in JSON or as a struct."""
    table = rows["table"] if dict(rows.dtypes)["table"].startswith("struct") else F.from_json(rows["table"], "columns array<string>, data array<array<string>>")
    return F.struct(table["columns"].alias("header"), table["data"].alias("rows"), _optional(rows, "chart_type")[0].alias("name"))


def read_table_bench(spark: SparkSession, path: str, split: str = "test", revision: str | None = None, instruction_types: tuple[str, ...] | None = None, plots: bool = False) -> DataFrame:
    """Questions over tables by kind; the line is part of a question's identity, as the file repeats some.  Without an answer the response's final answer is gold."""
    from ..functions.scorers import final_answer

    rows = numbered_json(spark, path)
    rows = rows.where(F.col("qtype").isin(*TEXT_QTYPES, *([PLOT_QTYPE] if plots else [])))
    wanted = [t.strip() for t in instruction_types or () if t.strip()]
    if wanted:
        rows = rows.where(F.col("instruction_type").isin(wanted))
    kind, response = (F.coalesce(_optional(rows, c)[0], F.lit("")) for c in ("instruction_type", "response"))
    gold = F.coalesce(_optional(rows, "answer")[0].cast("string"), final_answer(response), F.lit(""))
    line = F.col("source_line").cast("string")
    meta = {"gold_answer": gold, "qtype": F.col("qtype"), "qsubtype": F.col("qsubtype"), "instruction_type": kind, "split": F.lit(split), "dataset_revision": F.lit(revision or "main"), "source_line": F.col("source_line"), "_raw": F.struct(F.col("id").alias("id"), _table_of(rows).alias("table"))}
    return as_queries(rows, "tablebench", F.col("question"), F.concat_ws(":", F.lit(split), F.lit(revision or "main"), kind, line, F.col("id").cast("string")), meta)


def read_verbatim_prompts(spark: SparkSession, path: str, variant: str = "TCoT", split: str = "test", revision: str | None = None, plots: bool = False) -> DataFrame:
    """Questions with the prompt that the benchmark wrote for a variant."""
    if variant not in VARIANTS:
        raise ValueError(f"a variant is one of {', '.join(VARIANTS)}")
    rows = numbered_json(spark, path)
    rows = rows.where(F.col("qtype").isin(*TEXT_QTYPES, *([PLOT_QTYPE] if plots else [])))
    line = F.col("source_line").cast("string")
    meta = {
        "gold_answer": F.col("answer"), "qtype": F.col("qtype"), "qsubtype": F.col("qsubtype"), "chart_type": F.coalesce(_optional(rows, "chart_type")[0], F.lit("")), "instruction_type": F.coalesce(_optional(rows, "instruction_type")[0], F.lit(variant)),
        "split": F.lit(split), "variant": F.lit(variant), "dataset_revision": F.lit(revision or "main"), "instruction": F.col("instruction"), "source_line": F.col("source_line"), "_raw": F.struct(F.col("id").alias("id"), F.col("table").alias("table")),
    }
    context = F.concat_ws(":", F.lit(split), *([F.lit(revision)] if revision else []), F.lit(variant), line, F.col("id").cast("string"))
    keyed = as_queries(rows.withColumn("_q", F.col("question")).withColumn("question", F.concat(F.lit(f"{variant}::"), F.col("question"))), "tablebench_repro", F.col("question"), context, meta)
    return keyed.withColumn("content", F.expr(f"substring(content, {len(variant) + 3})"))


def literal_json(text: Column) -> Column:
    """Python literals of strings, numbers, lists and dictionaries as JSON text: quotes, None, True and False outside strings are put right."""

    def one(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(2), F.length(piece) - 2)
        quoted = F.concat(F.lit('"'), F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(piece, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
        return F.when(piece.startswith("'"), quoted).when(piece.startswith('"'), piece).otherwise(bare)

    pieces = F.regexp_extract_all(text, F.lit(r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|[^'"]++"""), F.lit(0))
    return F.array_join(F.transform(pieces, one), "")


def read_hierarchical(spark: SparkSession, path: str, split: str = "dev") -> DataFrame:
    """Questions over tables with merged headers; nested fields come as Python literals or as JSON text."""
    rows = numbered_json(spark, path)
    parsed = lambda c: F.coalesce(literal_json(_optional(rows, c)[0].cast("string")), F.lit("{}"))
    plain = lambda c, default: F.coalesce(_optional(rows, c)[0].cast("string"), F.lit(default))
    raw = F.struct(F.col("question"), F.col("answer").cast("string").alias("answer"), parsed("table_content").alias("table_content"), parsed("linked_cells").alias("linked_cells"), plain("aggregation", "none").alias("aggregation"))
    meta = {"gold_answer": F.col("answer").cast("string"), "split": F.lit(split), "table_id": plain("table_id", ""), "table_source": plain("table_source", ""), "aggregation": plain("aggregation", "none"), "_raw": raw}
    return as_queries(rows, "hitab", F.col("question"), F.concat_ws(":", F.lit(split), (F.col("source_line") - 1).cast("string")), meta)


def read_claims(spark: SparkSession, path: str, split: str = "test", hops: int = 3, seed: int = 1, n: int | None = None) -> DataFrame:
    """Claims with the titles that support them; for test and train only those of so many hops, the first n in an order that the seed decides."""
    rows = spark.read.option("multiLine", True).json(path)
    chosen = split.lower() in ("test", "train")
    rows = rows.where(F.col("num_hops") == hops) if chosen else rows
    source = first_text(*_optional(rows, "uid"), *_optional(rows, "hpqa_id"))
    rows = rows.withColumn("_source", source).where(F.coalesce(F.trim("claim"), F.lit("")) != "")
    if n is not None:
        order = F.md5(F.concat_ws(":", F.lit(str(0 if split.lower() == "train" else seed)), "_source", "claim"))
        rows = rows.orderBy(order, "_source").limit(n) if chosen else rows.limit(n)
    meta = {"split": F.lit(split), "source_id": F.col("_source"), "supporting_facts": F.col("supporting_facts"), "label": F.col("label"), "num_hops": F.col("num_hops")}
    made = as_queries(rows.withColumn("_uid", _optional(rows, "uid")[0].cast("string")), "hover_context", F.col("claim"), F.concat_ws(":", F.lit(split), "_source"), meta)
    return made.withColumn("query_id", F.coalesce(F.when(F.get_json_object("meta", "$.source_id").isNotNull() & F.lit("uid" in rows.columns), F.get_json_object("meta", "$.source_id")), "query_id"))


def read_sql_questions(spark: SparkSession, path: str, schemas: DataFrame, dataset: str = "bird", split: str = "dev") -> DataFrame:
    """Questions for databases (a JSON array) with the reference SQL and the schema of their database; ``schemas`` is ``databases.schema_text``."""
    rows = spark.read.option("multiLine", True).json(path)
    text = lambda *names: F.coalesce(first_text(*_optional(rows, *names)), F.lit(""))
    rows = rows.withColumns({"_sql": text("SQL", "query"), "_level": text("difficulty"), "_hint": text("evidence"), "_qid": first_text(*_optional(rows, "question_id"))})
    rows = rows.withColumn("_qid", F.coalesce("_qid", F.substring(F.md5(F.concat_ws(":", "question", "_sql")), 1, 8)))
    rows = rows.join(schemas.select(F.col("db").alias("db_id"), "schema"), "db_id", "left")
    meta = {"db_id": F.col("db_id"), "gold_sql": F.col("_sql"), "difficulty": F.col("_level"), "evidence": F.col("_hint"), "split": F.lit(split), "_raw": F.struct(F.col("_qid").alias("question_id"), F.coalesce("schema", F.lit("")).alias("schema"))}
    return as_queries(rows, dataset, F.col("question"), F.concat_ws(":", F.lit(split), "db_id", "_qid"), meta)


def read_multi_hop(spark: SparkSession, path: str, split: str = "dev") -> DataFrame:
    """Multi-hop questions with their passages; rows without an answer are kept, those without a question are not."""
    rows = spark.read.json(path)
    keep = {k: _optional(rows, k)[0] for k in ("context", "answer", "supporting_facts", "level", "type")}
    source = first_text(*_optional(rows, "id", "_id"))
    return as_queries(rows.withColumn("_source", source), "hotpotqa_context", F.col("question"), F.concat_ws(":", F.lit(split), "_source"), {"split": F.lit(split), "source_id": source, **keep})
