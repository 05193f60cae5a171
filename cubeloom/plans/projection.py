"""A deterministic experiment cube over the TPC-H-like test tables.

The SQL is the same for Spark and for the oracle: integer arithmetic on ids
decides scores, errors, gaps, latency and tags.  ``{documents}`` and
``{labels}`` stand for the tables.
"""

from __future__ import annotations

CONFIGS = """
SELECT * FROM (VALUES
 (CAST(1 AS BIGINT), '', 'base', 'f0'), (2, 'feat_a', 'add_one_feature', 'f0,fa'), (3, 'feat_b', 'add_one_feature', 'f0,fb'),
 (4, 'feat_c', 'add_one_feature', 'f0,fc'), (5, '', 'coalition', 'f0,fa,fb'), (6, '', 'leave_one_out', 'f0,fb,fc')
) AS t(config_id, canonical_id, kind, funcs)"""

FEATURES = """
SELECT * FROM (VALUES ('hf_a', 'feat_a', 'table_qa', 'fa', 'style'), ('hf_b', 'feat_b', 'table_qa', 'fb', 'style'), ('hf_c', 'feat_c', 'text_qa', 'fc', 'reason'), ('hf_d', 'feat_d', 'text_qa', 'fd', 'reason')
) AS t(feature_id, canonical_id, task, funcs, label_id)"""

CONFIG_FEATURES = """
SELECT * FROM (VALUES (CAST(2 AS BIGINT), 'hf_a'), (3, 'hf_b'), (4, 'hf_c'), (5, 'hf_a'), (5, 'hf_b'), (6, 'hf_b'), (6, 'hf_c')) AS t(config_id, feature_id)"""

FUNCS = """
SELECT * FROM (VALUES
 ('f0', 'set_format', '{"style": "plain"}'),
 ('fa', 'insert_node', '{"node_type": "section", "parent_id": "__root__", "payload": {"title": "Rules", "ordinal": 1, "is_system": true}}'),
 ('fb', 'insert_node', '{"node_type": "rule", "parent_id": "fa", "payload": {"content": "Think first", "ordinal": 2}}'),
 ('fc', 'insert_node', '{"node_type": "input_field", "parent_id": "__root__", "payload": {"name": "question", "description": "the question"}}'),
 ('fd', 'insert_node', '{"node_type": "output_field", "parent_id": "__root__", "payload": {"name": "answer", "description": "the answer"}}')
) AS t(func_id, func_type, params)"""

QUERIES = """
SELECT CAST(doc_id AS VARCHAR(20)) AS query_id, source AS dataset, text AS content, lang, n_chars,
 CASE doc_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' WHEN 2 THEN 'test' WHEN 3 THEN '' END AS split,
 CASE WHEN doc_id % 3 = 0 THEN 'Counting' WHEN doc_id % 3 = 1 THEN 'Causal' ELSE 'Lookup' END AS qtype, doc_id,
 CONCAT('{{"doc":{{"n_chars":', CAST(COALESCE(n_chars, 0) AS VARCHAR(20)), ',"odd key":"', COALESCE(source, ''), '"}}', CASE doc_id % 4 WHEN 0 THEN ',"gold_answer":null' WHEN 1 THEN ',"gold_answer":"g1"' ELSE '' END,
  CASE doc_id % 3 WHEN 0 THEN ',"_raw":{{"answers":["x","y"]}}' WHEN 1 THEN ',"_raw":{{"note":1}}' ELSE '' END, CASE WHEN doc_id % 8 < 7 THEN CONCAT(',"answer":', CAST(doc_id % 10 AS VARCHAR(20))) ELSE '' END,
  ',"flag":', CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END, '}}') AS meta
FROM {documents}"""

PREDICATES = """
SELECT query_id, 'lang' AS name, lang AS value FROM ({queries}) q
UNION ALL SELECT query_id, 'is_long', CASE WHEN n_chars >= 1500 THEN 'true' ELSE 'false' END FROM ({queries}) q
UNION ALL SELECT query_id, 'bucket', CAST(doc_id % 4 AS VARCHAR(20)) FROM ({queries}) q WHERE doc_id % 7 <> 0
UNION ALL SELECT query_id, 'n_chars', CAST(n_chars AS VARCHAR(20)) FROM ({queries}) q
UNION ALL SELECT query_id, 'language', lang FROM ({queries}) q
UNION ALL SELECT CAST(doc_id AS VARCHAR(20)), 'quality', CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END FROM {labels} l WHERE quality IS NOT NULL"""

EXECUTIONS = """
SELECT d.doc_id * 20 + c.config_id * 2 + m.m AS execution_id, c.config_id, CAST(d.doc_id AS VARCHAR(20)) AS query_id, m.model,
 CAST(50 + (d.doc_id * 31 + c.config_id * 17 + m.m * 7) % 400 AS DOUBLE) AS latency_ms, 100 + d.doc_id % 57 AS prompt_tokens, 10 + (d.doc_id * c.config_id) % 23 AS completion_tokens,
 CASE WHEN (d.doc_id + 3 * c.config_id) % 41 = 0 THEN 'timeout' WHEN (d.doc_id + c.config_id) % 59 = 0 THEN '' END AS error,
 CONCAT('p', CAST(d.doc_id % 3 AS VARCHAR(20)), CASE WHEN c.config_id % 2 = 0 THEN ',final' ELSE '' END) AS phases,
 TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(d.doc_id * 7 + c.config_id AS INT) AS created_at,
 CASE WHEN (d.doc_id + c.config_id) % 4 = 0 THEN CONCAT('Final Answer: ', CAST(d.doc_id % 9 AS VARCHAR(20))) WHEN (d.doc_id + c.config_id) % 4 = 1 THEN 'print(''Final Answer: x'')' WHEN (d.doc_id + c.config_id) % 4 = 2 THEN 'plain text' ELSE '' END AS raw_response,
 CAST((d.doc_id * c.config_id) % 10 AS VARCHAR(20)) AS prediction, d.doc_id
FROM {documents} d CROSS JOIN ({configs}) c CROSS JOIN (SELECT * FROM (VALUES (0, 'alpha'), (1, 'beta')) AS t(m, model)) m
WHERE (d.doc_id * 7 + c.config_id * 3 + m.m) % 13 <> 0"""

EVALUATIONS = """
SELECT execution_id * 2 AS eval_id, execution_id, 'exact' AS scorer, CASE WHEN error IS NOT NULL AND error <> '' THEN 0.0E0 WHEN (doc_id * (config_id + 2) + config_id) % 7 < 2 + config_id % 3 THEN 1.0E0 ELSE 0.0E0 END AS score,
 CONCAT('{{"ECR@1": ', CASE WHEN doc_id % 6 = 0 THEN 'false' ELSE 'true' END, ', "output_mode": "', CASE WHEN config_id % 2 = 0 THEN 'python_exec' ELSE 'plain' END, '"}}') AS metrics
FROM ({executions}) e WHERE (doc_id + config_id) % 17 <> 0
UNION ALL SELECT execution_id * 2 + 1, execution_id, 'soft', CASE WHEN (doc_id + config_id) % 29 = 0 THEN NULL ELSE ((doc_id * 13 + config_id * 7) % 11) / 10.0E0 END, '{{}}' FROM ({executions}) e"""

ORDER = ("configs", "features", "config_features", "funcs", "queries", "predicates", "executions", "evaluations")
_RAW = {"configs": CONFIGS, "features": FEATURES, "config_features": CONFIG_FEATURES, "funcs": FUNCS, "queries": QUERIES, "predicates": PREDICATES, "executions": EXECUTIONS, "evaluations": EVALUATIONS}


def text(name: str, documents: str, labels: str) -> str:
    """The SQL of one projected table, with the tables it needs put in."""
    sql = _RAW[name]
    if name == "funcs":
        return sql
    parts = {"documents": documents, "labels": labels}
    if "{configs}" in sql:
        parts["configs"] = CONFIGS
    if "{queries}" in sql:
        parts["queries"] = text("queries", documents, labels)
    if "{executions}" in sql:
        parts["executions"] = text("executions", documents, labels)
    return sql.format(**parts)


def ctes() -> str:
    """``WITH`` clause of the projected cube for the oracle."""
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({text(name, 'documents', 'labels')})" for name in ORDER)


# -- a design of many edits, features and configurations, over parts, suppliers and customers ----------------

_EDITS = "CONCAT('u', CAST(2 * {0} AS VARCHAR(20)), CASE WHEN {0} % 3 = 0 THEN CONCAT(',u', CAST(2 * {0} + 1 AS VARCHAR(20))) ELSE '' END)"
_A, _B = "(c_custkey % 8 + 1)", "(c_custkey % 7 + 2)"
DESIGN = {
    "funcs": """
SELECT CONCAT('u', CAST(p_partkey AS VARCHAR(20))) AS func_id, CASE WHEN p_partkey % 5 = 0 THEN 'set_format' ELSE 'insert_node' END AS func_type,
 CASE p_partkey % 5 WHEN 0 THEN '{"style": "plain"}'
  WHEN 1 THEN CONCAT('{"node_type": "section", "parent_id": "__root__", "payload": {"title": "', p_name, '", "ordinal": ', CAST(p_size AS VARCHAR(20)), ', "is_system": true}}')
  WHEN 2 THEN CONCAT('{"node_type": "rule", "parent_id": "u', CAST(p_partkey - 1 AS VARCHAR(20)), '", "payload": {"content": "', p_type, '", "ordinal": ', CAST(p_size AS VARCHAR(20)), '}}')
  WHEN 3 THEN CONCAT('{"node_type": "input_field", "parent_id": "__root__", "payload": {"name": "', p_brand, '", "description": "', p_name, '"}}')
  ELSE CONCAT('{"node_type": "output_field", "parent_id": "__root__", "payload": {"name": "', p_brand, '"}}') END AS params
FROM @part""",
    "features": f"""
SELECT CONCAT('h', CAST(s_suppkey AS VARCHAR(20))) AS feature_id, CONCAT('feat_', CAST(s_suppkey AS VARCHAR(20))) AS canonical_id, CASE WHEN s_nationkey % 2 = 0 THEN 'table_qa' ELSE 'text_qa' END AS task, {_EDITS.format("s_suppkey")} AS funcs, CASE WHEN s_acctbal < 5000 THEN 'style' ELSE 'reason' END AS label_id
FROM @supplier""",
    "configs": f"""
SELECT c_custkey AS config_id, CASE WHEN c_custkey % 6 = 0 THEN CONCAT('feat_', CAST({_A} AS VARCHAR(20))) ELSE '' END AS canonical_id,
 CASE WHEN c_custkey = 1 THEN 'base' WHEN c_custkey % 3 = 0 THEN 'add_one_feature' WHEN c_custkey % 3 = 1 THEN 'coalition' ELSE 'leave_one_out' END AS kind,
 CASE WHEN c_custkey = 1 THEN 'u1' WHEN c_custkey % 3 = 0 THEN CONCAT('u1,', {_EDITS.format(_A)}) WHEN c_custkey % 3 = 1 AND {_A} <> {_B} THEN CONCAT('u1,', {_EDITS.format(_A)}, ',', {_EDITS.format(_B)}) ELSE CONCAT('u1,', {_EDITS.format(_B)}) END AS funcs
FROM @customer""",
    "config_features": f"""
SELECT c_custkey AS config_id, CONCAT('h', CAST({_A} AS VARCHAR(20))) AS feature_id FROM @customer WHERE c_custkey > 1 AND c_custkey % 3 < 2
UNION ALL SELECT c_custkey, CONCAT('h', CAST({_B} AS VARCHAR(20))) FROM @customer WHERE c_custkey > 1 AND c_custkey % 3 = 1 AND {_A} <> {_B}""",
}
DESIGN_TABLES = {"funcs": ("part",), "features": ("supplier",), "configs": ("customer",), "config_features": ("customer",)}


def design_ctes() -> str:
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql.replace('@', '')})" for name, sql in DESIGN.items())
