"""All registered queries of the engine's own operators, and their SQL oracles.

Every query runs an operator of the library over the projected cube or over
whole tables; each oracle is written for itself in SQL.  Doubles are rounded
to six places on both sides.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hints, profile, sql_structure
from .functions import predicates as P
from .functions import scalars as S
from .functions import scorers as G
from .functions import tables as R
from .operators import adaptive, compare, confidence, design, effect, inventory, names, resolve, retrieval, routing, search
from .plans import explorer as X
from .plans import projection
from .plans.cube import Cube, designed, projected
from .plans.pipeline import Pipeline, feature_predicate_table
from .plans.query import ExecutionQuery
from .sources import benchmarks, databases, numbered, scratch
from .streaming import monitor, scoring

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
CTES = projection.ctes()
M, SC = "alpha", "exact"
CLEAN = "qs AS MATERIALIZED (SELECT e.config_id, e.query_id, e.model, v.scorer, v.score FROM evaluations v JOIN executions e USING (execution_id) WHERE coalesce(e.error, '') = '' AND v.score IS NOT NULL)"
ONE = f"{CLEAN}, s AS MATERIALIZED (SELECT * FROM qs WHERE model = '{M}' AND scorer = '{SC}')"
MEANS = f"{ONE}, pm AS MATERIALIZED (SELECT config_id, name AS predicate_name, value AS predicate_value, avg(score) AS m, count(*) AS n FROM s JOIN predicates USING (query_id) GROUP BY ALL)"
ALL = f"a AS MATERIALIZED (SELECT e.*, v.eval_id, v.score, v.metrics FROM evaluations v JOIN executions e USING (execution_id) WHERE model = '{M}' AND scorer = '{SC}')"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def on_cube(name: str, run: Callable[[Cube], DataFrame], sql: str | None = None) -> None:
    """Register a query on the projected cube; ``sql`` follows the cube's CTEs."""
    _QUERIES[name] = lambda spark, sf_dir: rounded(run(projected(spark, sf_dir)))
    if sql is not None:
        _SQL[name] = f"{CTES}{', ' if ' AS MATERIALIZED (' in sql.split('SELECT')[0] or sql.split('SELECT')[0].strip() else ''} {sql}"


def on_design(name: str, run: Callable[[Cube], DataFrame], sql: str) -> None:
    """Register a query on the cube of many configurations."""
    _QUERIES[name] = lambda spark, sf_dir: rounded(run(designed(spark, sf_dir)))
    _SQL[name] = f"{projection.design_ctes()}{', ' if ' AS (' in sql.split('SELECT')[0] else ''} {sql}"


def on_tables(name: str, run: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None = None) -> None:
    """Register a query on the plain tables."""
    _QUERIES[name] = lambda spark, sf_dir: rounded(run(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")))
    if sql is not None:
        _SQL[name] = sql


def at(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


AT = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"

# -- views and scans ----------------------------------------------------------
on_cube("view_query_scores", lambda c: c.query_scores(), f"{CLEAN} SELECT * FROM qs")
on_cube("view_scored_executions", lambda c: c.scored_executions(M, SC, "lang"), f"{ONE} SELECT s.*, name AS predicate_name, value AS predicate_value FROM s JOIN predicates USING (query_id) WHERE name = 'lang'")
on_cube("view_predicate_means", lambda c: c.per_config_predicate_means(), f"{CLEAN} SELECT config_id, model, scorer, name AS predicate_name, value AS predicate_value, round(avg(score), 6) AS avg_score, count(*) AS n FROM qs JOIN predicates USING (query_id) GROUP BY ALL")
on_cube("view_feature_effect", lambda c: c.feature_effect().groupBy("canonical_id", "task", "dataset", "model", "scorer").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score")),
        "SELECT canonical_id, task, dataset, model, scorer, count(*) AS n, round(avg(score), 6) AS avg_score FROM evaluations v JOIN executions e USING (execution_id) JOIN config_features USING (config_id) JOIN features USING (feature_id) JOIN queries q ON q.query_id = e.query_id GROUP BY ALL")
on_cube("view_label_effect", lambda c: c.feature_label_effect().groupBy("label_id", "qtype", "scorer").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score")),
        "SELECT label_id, qtype, scorer, count(*) AS n, round(avg(score), 6) AS avg_score FROM evaluations v JOIN executions e USING (execution_id) JOIN config_features USING (config_id) JOIN features USING (feature_id) JOIN queries q ON q.query_id = e.query_id GROUP BY ALL")
on_cube("view_label_predicate_effect", lambda c: c.feature_label_predicate_effect().where("predicate_name = 'quality'").groupBy("label_id", "predicate_value").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score")),
        "SELECT label_id, value AS predicate_value, count(*) AS n, round(avg(score), 6) AS avg_score FROM evaluations v JOIN executions e USING (execution_id) JOIN config_features USING (config_id) JOIN features USING (feature_id) JOIN predicates p ON p.query_id = e.query_id WHERE name = 'quality' GROUP BY ALL")
_NODE = "SELECT func_id, params->>'$.parent_id' AS parent_id, {} FROM funcs WHERE func_type = 'insert_node' AND params->>'$.node_type' = '{}'"
on_design("view_section", lambda c: c.section_view().select("func_id", "parent_id", "title", "ordinal"), _NODE.format("params->>'$.payload.title' AS title, params->>'$.payload.ordinal' AS ordinal", "section"))
on_design("view_rule", lambda c: c.rule_view(), _NODE.format("params->>'$.payload.content' AS content, params->>'$.payload.ordinal' AS ordinal", "rule"))
on_design("view_input_field", lambda c: c.input_field_view(), _NODE.format("params->>'$.payload.name' AS name, params->>'$.payload.description' AS description", "input_field"))
on_design("view_output_field", lambda c: c.output_field_view(), _NODE.format("params->>'$.payload.name' AS name, params->>'$.payload.description' AS description", "output_field"))

# -- the query builder --------------------------------------------------------
_IDS = ("execution_id", "config_id", "query_id", "model")
_E = "SELECT execution_id, config_id, query_id, model FROM executions e WHERE "


def _builder(name: str, build: Callable[[ExecutionQuery], ExecutionQuery], where: str) -> None:
    on_cube(f"query_{name}", lambda c: build(ExecutionQuery(c)).columns(_IDS).df(), _E + where)


_builder("phase", lambda q: q.phase("final").config(2), "list_contains(string_split(phases, ','), 'final') AND config_id = 2")
_builder("phases", lambda q: q.phases(["p0", "p2"]).config(3), "list_has_any(string_split(phases, ','), ['p0', 'p2']) AND config_id = 3")
_builder("config_model", lambda q: q.configs([1, 5]).models(["beta"]).configs([]), "config_id IN (1, 5) AND model = 'beta'")
_builder("queries", lambda q: q.queries(["3", "7", "11"]), "query_id IN ('3', '7', '11')")
_builder("has_all_funcs", lambda q: q.has_all_funcs(["fa", "fb"]).model(M), "config_id IN (SELECT config_id FROM configs WHERE list_has_all(string_split(funcs, ','), ['fa', 'fb'])) AND model = 'alpha'")
_builder("has_any_func", lambda q: q.has_any_func(["fc"]).model(M), "config_id IN (SELECT config_id FROM configs WHERE list_contains(string_split(funcs, ','), 'fc')) AND model = 'alpha'")
_builder("has_feature", lambda q: q.has_feature("feat_a").has_feature("feat_b").model(M), "config_id IN (SELECT config_id FROM config_features JOIN features USING (feature_id) WHERE canonical_id IN ('feat_a', 'feat_b') GROUP BY 1 HAVING count(*) = 2) AND model = 'alpha'")
_builder("has_any_feature", lambda q: q.has_any_feature(["feat_a", "feat_c"]).model(M), "config_id IN (SELECT config_id FROM config_features JOIN features USING (feature_id) WHERE canonical_id IN ('feat_a', 'feat_c')) AND model = 'alpha'")
_builder("predicate", lambda q: q.predicate("lang", "fr").predicate("quality").config(1), "config_id = 1 AND EXISTS (FROM predicates p WHERE p.query_id = e.query_id AND name = 'lang' AND value = 'fr') AND EXISTS (FROM predicates p WHERE p.query_id = e.query_id AND name = 'quality')")
_builder("errors", lambda q: q.with_error(), "coalesce(error, '') <> ''")
_builder("no_errors", lambda q: q.without_error().config(4), "coalesce(error, '') = '' AND config_id = 4")
on_cube("query_where_score", lambda c: ExecutionQuery(c).scorer("soft").where_score(">=", 0.9).columns([*_IDS, "score"]).df(), "SELECT execution_id, config_id, query_id, model, round(score, 6) AS score FROM executions JOIN evaluations USING (execution_id) WHERE scorer = 'soft' AND score >= 0.9")
on_cube("query_scorer_left_join", lambda c: ExecutionQuery(c).scorer(SC).config(1).columns(["execution_id", "score"]).df(), f"SELECT e.execution_id, score FROM executions e LEFT JOIN evaluations v ON v.execution_id = e.execution_id AND scorer = '{SC}' WHERE config_id = 1")
on_cube("query_order_limit", lambda c: ExecutionQuery(c).model(M).columns(["execution_id", "latency_ms"]).order_by("latency_ms DESC", "execution_id").limit(25).df(), f"SELECT execution_id, latency_ms FROM executions WHERE model = '{M}' ORDER BY latency_ms DESC, execution_id LIMIT 25")
on_cube("query_count", lambda c: ExecutionQuery(c).phase("p1").count_df(), "SELECT count(*) AS n FROM executions WHERE list_contains(string_split(phases, ','), 'p1')")
on_cube("query_agg_avg", lambda c: ExecutionQuery(c).model(M).scorer(SC).agg(["config_id"]), f"{ALL} SELECT e.config_id, round(avg(v.score), 6) AS avg_score, count(*) AS n FROM executions e LEFT JOIN evaluations v ON v.execution_id = e.execution_id AND scorer = '{SC}' WHERE model = '{M}' GROUP BY 1")
on_cube("query_agg_global", lambda c: ExecutionQuery(c).agg([], "max", "latency_ms"), "SELECT max(latency_ms) AS max_latency_ms, count(*) AS n FROM executions")
on_cube("query_agg_count", lambda c: ExecutionQuery(c).agg(["model", "config_id"], "count", "*"), "SELECT model, config_id, count(*) AS count_all, count(*) AS n FROM executions GROUP BY ALL")
on_cube("call_cache_uncached", lambda c: inventory.uncached(c, 2, M), f"SELECT query_id FROM queries WHERE query_id NOT IN (SELECT query_id FROM executions WHERE config_id = 2 AND model = '{M}')")
on_cube("unevaluated", lambda c: inventory.unevaluated(c, SC), f"SELECT execution_id, config_id, query_id, model FROM executions WHERE execution_id NOT IN (SELECT execution_id FROM evaluations WHERE scorer = '{SC}')")

# -- inventories --------------------------------------------------------------
on_cube("scores_by_config", lambda c: inventory.scores_by_config(c, M, SC), f"{ALL} SELECT config_id, count(*) AS n, round(avg(score), 6) AS avg_score, min(score) AS min_score, max(score) AS max_score FROM a GROUP BY 1")
on_cube("scores_by_config_dataset", lambda c: inventory.scores_by_config(c, M, SC, dataset="src0"), f"{ALL} SELECT config_id, count(*) AS n, round(avg(score), 6) AS avg_score, min(score) AS min_score, max(score) AS max_score FROM a JOIN queries USING (query_id) WHERE dataset = 'src0' GROUP BY 1")
on_cube("stats", inventory.stats, " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {t}" for n, t in (("func", "funcs"), ("query", "queries"), ("config", "configs"), ("execution", "executions"), ("evaluation", "evaluations"), ("predicate", "predicates"))))
on_cube("config_progress", lambda c: inventory.config_progress(c, M), f"SELECT config_id, coalesce(d, 0) AS done, t AS total, t - coalesce(d, 0) AS remaining FROM configs LEFT JOIN (SELECT config_id, count(DISTINCT query_id) AS d FROM executions WHERE model = '{M}' GROUP BY 1) USING (config_id), (SELECT count(*) AS t FROM queries)")
on_cube("list_models", lambda c: inventory.list_models(c).select("model", "n", at("first_at"), at("last_at")), f"SELECT model, n, {AT.format('first_at')}, {AT.format('last_at')} FROM (SELECT model, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM executions GROUP BY 1)")
on_cube("list_scorers", inventory.list_scorers, "SELECT scorer, count(*) AS n, round(avg(score), 6) AS avg_score FROM evaluations GROUP BY 1")
on_cube("list_phases", lambda c: inventory.list_phases(c).select("phase", "n", at("first_at"), at("last_at"), F.array_join("models", ",").alias("models")), f"SELECT phase, n, {AT.format('first_at')}, {AT.format('last_at')}, models FROM (SELECT phase, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM (SELECT unnest(string_split(phases, ',')) AS phase, created_at, model FROM executions) GROUP BY 1)")
on_cube("list_datasets", lambda c: inventory.list_datasets(c).select("dataset", "n_queries", F.array_join(F.transform(F.map_entries("splits"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("splits")),
        "SELECT dataset, sum(n)::BIGINT AS n_queries, string_agg(concat(split, '=', n), ',' ORDER BY split) AS splits FROM (SELECT dataset, coalesce(split, '') AS split, count(*) AS n FROM queries GROUP BY ALL) GROUP BY 1")
on_cube("list_predicates", inventory.list_predicates, "SELECT name, count(DISTINCT value) AS n_values, count(DISTINCT query_id) AS n_queries FROM predicates GROUP BY 1")
on_design("list_features", lambda c: inventory.list_features(c, "text_qa").select("feature_id", "canonical_id", "task"), "SELECT feature_id, canonical_id, task FROM features WHERE task = 'text_qa'")
on_design("list_configs", lambda c: inventory.list_configs(c).select("config_id", "kind", "canonical_id", "n_funcs"), "SELECT config_id, kind, canonical_id, len(string_split(funcs, ','))::INT AS n_funcs FROM configs")
on_design("list_configs_features", lambda c: inventory.list_configs_with_features(c).select("config_id", F.array_join("features", ",").alias("features")), "SELECT config_id, coalesce(f, '') AS features FROM configs LEFT JOIN (SELECT config_id, string_agg(canonical_id, ',' ORDER BY feature_id) AS f FROM config_features JOIN features USING (feature_id) GROUP BY 1) USING (config_id)")
on_design("list_configs_func_types", inventory.list_configs_with_func_types, "SELECT config_id, func_type, count(*) AS n FROM (SELECT config_id, unnest(string_split(funcs, ',')) AS func_id FROM configs) JOIN funcs USING (func_id) GROUP BY ALL")
on_cube("configs_detailed", lambda c: X.list_configs_detailed(c, SC).select("config_id", "label", "n_executions", "n_queries", "models", "features", "avg_score", at("first_at")),
        f"""SELECT config_id, coalesce(nullif(features, ''), kind) AS label, n_executions, n_queries, models, features, round(avg_score, 6) AS avg_score, {AT.format("first_at")} FROM configs
        LEFT JOIN (SELECT config_id, count(*) AS n_executions, count(DISTINCT query_id) AS n_queries, string_agg(DISTINCT model, ',' ORDER BY model) AS models, min(created_at) AS first_at FROM executions GROUP BY 1) USING (config_id)
        LEFT JOIN (SELECT config_id, avg(score) AS avg_score FROM evaluations JOIN executions USING (execution_id) WHERE scorer = '{SC}' GROUP BY 1) USING (config_id)
        LEFT JOIN (SELECT config_id, string_agg(canonical_id, ',' ORDER BY canonical_id) AS features FROM config_features JOIN features USING (feature_id) GROUP BY 1) USING (config_id)""")  # fmt: skip
on_cube("predicate_fields", X.predicate_fields, "SELECT name, count(DISTINCT query_id) AS n_queries, count(DISTINCT value) AS n_values, array_to_string(list_sort(list(DISTINCT value))[1:8], '|') AS samples FROM predicates GROUP BY 1")
on_tables("meta_fields", lambda t: X.meta_fields(t("events"), "props").select("key", "n_rows", F.array_join("samples", "|").alias("samples")), "SELECT key, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT left(v, 80)))[1:8], '|') AS samples FROM (SELECT unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT props->>key AS v) GROUP BY 1")
on_cube("dataset_scope", lambda c: X.dataset_scope(c, True), f"{CLEAN} SELECT dataset, CASE WHEN coalesce(split, '') = '' THEN '(no split)' ELSE split END AS split, count(*) AS n_queries FROM queries WHERE query_id IN (SELECT query_id FROM qs) GROUP BY ALL")

# -- comparison ---------------------------------------------------------------
_PAIR = f"{ONE}, p AS (SELECT a.query_id, a.score AS a, b.score AS b FROM (SELECT * FROM s WHERE config_id = 1) a FULL JOIN (SELECT * FROM s WHERE config_id = 2) b USING (query_id))"
on_cube("score_diff", lambda c: compare.score_diff(c, 1, 2, M, SC),
        f"""{ONE}, x AS (SELECT query_id, score AS a FROM s WHERE config_id = 1), y AS (SELECT query_id, score AS b FROM s WHERE config_id = 2), j AS (SELECT * FROM x JOIN y USING (query_id))
        SELECT (SELECT count(*) FROM x) AS n_a, (SELECT count(*) FROM y) AS n_b, count(*) AS n_shared, round(avg(a), 6) AS avg_a, round(avg(b), 6) AS avg_b, round(avg(b - a), 6) AS avg_delta, count(*) FILTER (b > a) AS n_up, count(*) FILTER (b < a) AS n_down, count(*) FILTER (a = b) AS n_agree FROM j""")  # fmt: skip
_J = f"{ONE}, j AS (SELECT t.config_id, query_id, b.score AS base_score, t.score AS target_score FROM s t JOIN s b USING (query_id) WHERE b.config_id = 1 AND t.config_id <> 1)"
on_cube("flips_many", lambda c: compare.flips(c, 1, [2, 3, 5], M, SC), f"{_J} SELECT config_id AS target_config_id, query_id, base_score, target_score, CASE WHEN target_score > base_score THEN 'up' ELSE 'down' END AS direction FROM j WHERE config_id IN (2, 3, 5) AND base_score <> target_score")
_SAID = f"(SELECT query_id, max(prediction) FILTER (config_id = {{0}}) AS base_prediction, max(prediction) FILTER (config_id = {{1}}) AS target_prediction FROM executions WHERE model = '{M}' AND config_id IN ({{0}}, {{1}}) GROUP BY 1)"
for _way, _f, _b, _t in (("down", compare.harm_cases, 2, 3), ("up", compare.help_cases, 1, 2)):
    on_cube(f"{'harm' if _way == 'down' else 'help'}_cases", lambda c, f=_f, b=_b, t=_t: f(c, b, t, M, SC), f"{_J.replace('b.config_id = 1 AND t.config_id <> 1', f'b.config_id = {_b} AND t.config_id <> {_b}')} SELECT config_id AS target_config_id, query_id, base_score, target_score, '{_way}' AS direction, base_prediction, target_prediction, dataset FROM j JOIN {_SAID.format(_b, _t)} USING (query_id) JOIN queries USING (query_id) WHERE config_id = {_t} AND target_score {'<' if _way == 'down' else '>'} base_score")
on_cube("add_one_deltas", lambda c: compare.add_one_deltas(c, 1, M, SC), f"{_J} SELECT c.config_id, canonical_id, count(j.query_id) AS n_shared, round(coalesce(avg(target_score - base_score), 0), 6) AS avg_delta, count(*) FILTER (target_score > base_score) AS n_up, count(*) FILTER (target_score < base_score) AS n_down FROM configs c LEFT JOIN j USING (config_id) WHERE kind = 'add_one_feature' GROUP BY ALL")
on_cube("feature_effect_ranking", lambda c: compare.feature_effect_ranking(c, M, SC), f"{ALL} SELECT canonical_id, round(avg(score), 6) AS avg_score, count(*) AS n FROM a JOIN config_features USING (config_id) JOIN features USING (feature_id) GROUP BY 1")
on_cube("predicate_slice", lambda c: compare.predicate_slice(c, M, SC, "lang", [1, 2]), f"{MEANS} SELECT config_id, '{M}' AS model, '{SC}' AS scorer, predicate_name, predicate_value, round(m, 6) AS avg_score, n FROM pm WHERE predicate_name = 'lang' AND config_id IN (1, 2)")

# -- explorer -----------------------------------------------------------------
on_cube("slice_scores", lambda c: X.slice_scores(c, M, SC, ["qtype", "split"], base=1, limit=None),
        f"""{ONE}, g AS (SELECT config_id, qtype, CASE WHEN coalesce(split, '') = '' THEN '(no split)' ELSE split END AS split, count(*) AS n, avg(score) AS m, count(*) FILTER (score = 1) AS n_correct, count(*) FILTER (score = 0) AS n_wrong FROM s JOIN queries USING (query_id) GROUP BY ALL)
        SELECT config_id, qtype, split, n, round(m, 6) AS avg_score, n_correct, n_wrong, round(m - max(CASE WHEN config_id = 1 THEN m END) OVER (PARTITION BY qtype, split), 6) AS delta FROM g""")  # fmt: skip
on_cube("slice_by_predicate", lambda c: X.slice_scores(c, M, SC, ["predicate.is_long"], filters=[("predicate.lang", "in", ["en", "de"]), ("predicate.n_chars", ">", 800)], config_ids=[2, 3], base=1, limit=None),
        f"""{ONE}, f AS (SELECT s.*, l.value AS v FROM s JOIN predicates l ON l.query_id = s.query_id AND l.name = 'is_long' JOIN predicates g ON g.query_id = s.query_id AND g.name = 'lang' AND g.value IN ('en', 'de') JOIN predicates n ON n.query_id = s.query_id AND n.name = 'n_chars' AND n.value::DOUBLE > 800),
        g AS (SELECT config_id, v AS predicate_is_long, count(*) AS n, avg(score) AS m, count(*) FILTER (score = 1) AS n_correct, count(*) FILTER (score = 0) AS n_wrong FROM f WHERE config_id IN (1, 2, 3) GROUP BY ALL),
        d AS (SELECT *, m - max(CASE WHEN config_id = 1 THEN m END) OVER (PARTITION BY predicate_is_long) AS delta FROM g)
        SELECT config_id, predicate_is_long, n, round(m, 6) AS avg_score, n_correct, n_wrong, round(delta, 6) AS delta FROM d WHERE config_id <> 1""")  # fmt: skip
on_cube("label_analysis", lambda c: X.label_analysis(c, M, SC, 1), f"{ALL}, r AS (SELECT DISTINCT label_id, config_id, query_id, score FROM a JOIN config_features USING (config_id) JOIN features USING (feature_id)), b AS (SELECT avg(score) AS m FROM a WHERE config_id = 1) SELECT label_id, 'implements' AS role, count(DISTINCT config_id) AS n_configs, count(DISTINCT query_id) AS n_queries, count(*) AS n, round(avg(score), 6) AS avg_score, round(any_value(m), 6) AS base_avg, round(avg(score) - any_value(m), 6) AS delta FROM r, b GROUP BY 1")
on_cube("compare_configs", lambda c: X.compare_configs(c, 1, 3, M, SC, [("dataset", "!=", "src1"), ("score", ">=", 0)]), f"{ONE} SELECT query_id, dataset, a.score AS base_score, b.score AS target_score, CASE WHEN b.score > a.score THEN 'up' WHEN b.score < a.score THEN 'down' ELSE 'same' END AS direction FROM s a JOIN s b USING (query_id) JOIN queries USING (query_id) WHERE a.config_id = 1 AND b.config_id = 3 AND dataset <> 'src1'")
_CE = f"{ONE}, j AS (SELECT query_id, dataset, a.score AS base_score, b.score AS target_score, CASE WHEN b.score > a.score THEN 'up' WHEN b.score < a.score THEN 'down' ELSE 'same' END AS direction FROM s a JOIN s b USING (query_id) JOIN queries USING (query_id) WHERE a.config_id = 2 AND b.config_id = 3)"
on_cube("comparison_examples", lambda c: X.comparison_examples(c, 2, 3, M, SC, "down", 20), f"{_CE} SELECT * FROM j WHERE direction = 'down' ORDER BY query_id LIMIT 20")
on_cube("comparison_examples_compat", lambda c: X.comparison_examples(c, 2, 3, M, SC, "down", 20, compat=True), f"{_CE} SELECT * FROM (SELECT * FROM j ORDER BY query_id LIMIT 20) WHERE direction = 'down'")
on_cube("examples", lambda c: X.examples(c, M, SC, [("split", "is_not_empty")]), f"{ALL} SELECT config_id, query_id, score, prediction, CASE WHEN length(raw_response) > 80 THEN left(raw_response, 80) || '...' ELSE raw_response END AS response FROM a JOIN queries USING (query_id) WHERE coalesce(split, '') <> '' ORDER BY score NULLS FIRST, config_id, query_id LIMIT 50")
on_cube("execution_artifact", lambda c: X.execution_artifact(c, 42), "SELECT e.execution_id, config_id, query_id, model, dataset, prediction, error, arg_min(scorer, eval_id) AS scorer, round(arg_min(coalesce(score, -1), eval_id), 6) AS score FROM executions e JOIN queries USING (query_id) JOIN evaluations USING (execution_id) WHERE e.execution_id = 42 GROUP BY ALL")
on_cube("diagnostics", lambda c: X.diagnostics(c, M, SC),
        f"""{ALL}, x AS (SELECT score, unnest([['ecr', coalesce(nullif(metrics->>'$."ECR@1"', ''), '(missing)')], ['output_mode', coalesce(metrics->>'$.output_mode', '(missing)')], ['error_state', CASE WHEN coalesce(error, '') = '' THEN 'ok' ELSE 'error' END],
        ['response_pattern', CASE WHEN coalesce(error, '') <> '' THEN 'execution_error' WHEN NOT regexp_matches(raw_response, '\\S') THEN 'empty_response' WHEN raw_response LIKE 'Final Answer%' THEN 'bare_final_answer_line' WHEN raw_response LIKE 'print(%' THEN 'prints_final_answer' WHEN contains(raw_response, '```py') THEN 'python_fenced_block' WHEN trim(prediction) <> '' THEN 'has_prediction' ELSE 'unclassified' END]]) AS p FROM a)
        SELECT p[1] AS histogram, p[2] AS bucket, count(*) AS n, round(avg(score), 6) AS avg_score FROM x GROUP BY ALL""")  # fmt: skip
on_cube("plan_delete", lambda c: X.plan_delete(c, [M], [2], [("dataset", "=", "src3")]), f"SELECT count(DISTINCT e.execution_id) AS n_executions, count(eval_id) AS n_evaluations, count(DISTINCT query_id) AS n_queries FROM executions e JOIN queries USING (query_id) LEFT JOIN evaluations v ON v.execution_id = e.execution_id WHERE model = '{M}' AND config_id = 2 AND dataset = 'src3'")
on_cube("recent", X.recent, "SELECT execution_id, config_id, query_id, model FROM executions ORDER BY created_at DESC, execution_id DESC LIMIT 20")
on_cube("recent_errors", X.errors, "SELECT execution_id, config_id, query_id, model, error FROM executions WHERE coalesce(error, '') <> '' ORDER BY created_at DESC, execution_id DESC LIMIT 20")

# -- fields below the queries' meta -------------------------------------------
_META = "SELECT query_id, meta->>'$.doc.\"odd key\"' AS odd, (meta->>'$.doc.n_chars')::DOUBLE AS size, meta->>'$.flag' AS flag, json_exists(meta, '$.answer') AS has_answer FROM queries"
on_cube("slice_by_meta", lambda c: X.slice_scores(c, M, SC, ["query.meta.doc.odd key", "split"], [("query.meta.doc.n_chars", ">", 800), ("query.meta.flag", "=", True), ("query.meta.answer", "is_not_empty")], limit=None),
        f"""{ONE}, m AS ({_META}) SELECT config_id, odd AS query_meta_doc_odd_key, CASE WHEN coalesce(split, '') = '' THEN '(no split)' ELSE split END AS split, count(*) AS n, round(avg(score), 6) AS avg_score, count(*) FILTER (score = 1) AS n_correct, count(*) FILTER (score = 0) AS n_wrong
        FROM s JOIN m USING (query_id) JOIN queries USING (query_id) WHERE size > 800 AND flag = 'true' AND has_answer GROUP BY ALL""")  # fmt: skip
_OPS = {
    "eq": (("query.meta.answer", "eq", 3), "meta->>'$.answer' = '3'"), "=": (("query.query_id", "=", "17"), "query_id = '17'"), "ne": (("query.meta.gold_answer", "ne", "g1"), "meta->>'$.gold_answer' <> 'g1'"), "!=": (("dataset", "!=", "src1"), "dataset <> 'src1'"),
    "in": (("query.meta.answer", "in", [1, 2]), "meta->>'$.answer' IN ('1', '2')"), "in_nothing": (("dataset", "in", []), "false"), "<": (("query.meta.doc.n_chars", "<", 700), "(meta->>'$.doc.n_chars')::DOUBLE < 700"),
    "<=": (("score", "<=", 0), "score <= 0"), ">": (("predicate.n_chars", ">", 1200), "query_id IN (SELECT query_id FROM predicates WHERE name = 'n_chars' AND value::DOUBLE > 1200)"), ">=": (("score", ">=", 1), "score >= 1"),
    "is_empty": (("query.meta.gold_answer", "is_empty"), "coalesce(meta->>'$.gold_answer', '') = ''"), "is_not_empty": (("split", "is_not_empty"), "coalesce(split, '') <> ''"),
}
on_cube("filter_operators", lambda c: functools.reduce(DataFrame.unionByName, (X.scored(c, M, SC, [f]).agg(F.lit(name).alias("filter"), F.count("*").alias("n"), F.avg("score").alias("avg_score")) for name, (f, _) in _OPS.items())),
        f"{ONE} " + " UNION ALL ".join(f"SELECT '{name}' AS filter, count(*) AS n, round(avg(score), 6) AS avg_score FROM s JOIN queries USING (query_id) WHERE {where}" for name, (_, where) in _OPS.items()))
_GOLD = " ".join(f"WHEN {cond}json_exists(meta, '{p}') THEN CASE WHEN json_type(meta, '{p}') <> 'NULL' THEN meta->>'{p}' END" for cond, p in [("json_type(meta, '$._raw') = 'OBJECT' AND ", f"$._raw.{k}") for k in ("answers", "answer", "gold", "gold_answer")] + [("", f"$.{k}") for k in ("gold_answer", "gold_answers", "answer", "answers", "label")])
on_cube("gold_answers", lambda c: c.query.select("query_id", X.gold_answer(F.col("meta")).alias("gold"), F.get_json_object(X.compact_meta(F.col("meta")), "$.answer").alias("answer"), X.meta_value(X.compact_meta(F.col("meta")), "_raw").alias("raw")), f"SELECT query_id, CASE {_GOLD} END AS gold, meta->>'$.answer' AS answer, NULL::VARCHAR AS raw FROM queries")
on_cube("dataset_scope_rows", lambda c: X.dataset_scope(c, True, M, SC, compat=True), f"{ONE} SELECT dataset, CASE WHEN coalesce(split, '') = '' THEN '(no split)' ELSE split END AS split, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries FROM queries JOIN s USING (query_id) GROUP BY ALL")
on_cube("query_meta_fields", lambda c: X.meta_fields(c.query.select(X.compact_meta(F.col("meta")).alias("meta")), "meta").select("key", "n_rows"), "SELECT key, count(*) AS n_rows FROM (SELECT unnest(json_keys(meta)) AS key FROM queries) WHERE key <> '_raw' GROUP BY 1")

on_cube("base_means", lambda c: X.base_means(c, M, SC, 1, "predicate.lang"), f"{ONE}, b AS (SELECT value, score FROM s JOIN predicates USING (query_id) WHERE config_id = 1 AND name = 'lang') SELECT value, count(*) AS n, round(avg(score), 6) AS avg_score FROM b GROUP BY 1 UNION ALL SELECT '(all)', count(*), round(avg(score), 6) FROM s WHERE config_id = 1")
on_cube("plan_delete_preview", lambda c: X.plan_delete_preview(c, [M], [2, 3], [("query.meta.flag", "=", True), ("dataset", "!=", "src3")]), f"SELECT execution_id, config_id, e.query_id, model, error FROM executions e JOIN queries q ON q.query_id = e.query_id WHERE model = '{M}' AND config_id IN (2, 3) AND meta->>'$.flag' = 'true' AND dataset <> 'src3' ORDER BY 1 LIMIT 20")

# -- effects ------------------------------------------------------------------
_LIFT = f"{MEANS}, lift AS MATERIALIZED (SELECT c.canonical_id, t.predicate_name, t.predicate_value, t.m AS target_mean, b.m AS base_mean, t.m - b.m AS lift, t.n AS n_target, coalesce(b.n, 0) AS n_base FROM pm t JOIN configs c USING (config_id) LEFT JOIN pm b ON b.config_id = 1 AND b.predicate_name = t.predicate_name AND b.predicate_value = t.predicate_value WHERE c.kind = 'add_one_feature')"
_DID = f"{_LIFT}, ref AS (SELECT predicate_name, min(predicate_value) AS reference FROM lift GROUP BY 1 HAVING count(DISTINCT predicate_value) = 2), dd AS MATERIALIZED (SELECT l.*, reference, lift - max(CASE WHEN predicate_value = reference THEN lift END) OVER (PARTITION BY canonical_id, l.predicate_name) AS did FROM lift l LEFT JOIN ref USING (predicate_name))"
_NO_N = "predicate_name <> 'n_chars'"
_lift = lambda c: effect.lift_simple(c, 1, M, SC).where(_NO_N)
on_cube("lift_simple", _lift, f"{_LIFT} SELECT canonical_id, predicate_name, predicate_value, round(target_mean, 6) AS target_mean, round(base_mean, 6) AS base_mean, round(lift, 6) AS lift, n_target, n_base FROM lift WHERE {_NO_N}")
on_cube("lift_marginal", lambda c: effect.lift_marginal(c, M, SC, "lang"),
        f"""{MEANS}, h AS (SELECT f.canonical_id, pm.*, EXISTS (FROM config_features k WHERE k.config_id = pm.config_id AND k.feature_id = f.feature_id) AS has FROM pm, features f WHERE predicate_name = 'lang'),
        g AS (SELECT canonical_id, predicate_name, predicate_value, avg(m) FILTER (has) AS t, avg(m) FILTER (NOT has) AS b, count(*) FILTER (has) AS n_target, count(*) FILTER (NOT has) AS n_base FROM h GROUP BY ALL)
        SELECT canonical_id, predicate_name, predicate_value, round(t, 6) AS target_mean, round(b, 6) AS base_mean, n_target, n_base, round(t - b, 6) AS lift FROM g WHERE n_target > 0 AND n_base > 0""")  # fmt: skip
on_cube("did", lambda c: effect.did(_lift(c)).select("canonical_id", "predicate_name", "predicate_value", "reference", "lift", "did"), f"{_DID} SELECT canonical_id, predicate_name, predicate_value, reference, round(lift, 6) AS lift, round(did, 6) AS did FROM dd WHERE {_NO_N}")
on_cube("did_given_reference", lambda c: effect.did(_lift(c), {"lang": "en"}).where("predicate_name = 'lang'").select("canonical_id", "predicate_value", "did"), f"{_LIFT} SELECT canonical_id, predicate_value, round(lift - max(CASE WHEN predicate_value = 'en' THEN lift END) OVER (PARTITION BY canonical_id), 6) AS did FROM lift WHERE predicate_name = 'lang'")
on_cube("rank_effects", lambda c: effect.rank(_lift(c), sort_by="lift", top_k=6, min_effect=0.01, require_sign="positive").select("canonical_id", "predicate_name", "predicate_value", "lift"), f"{_LIFT} SELECT canonical_id, predicate_name, predicate_value, round(lift, 6) AS lift FROM lift WHERE {_NO_N} AND lift > 0 AND abs(lift) >= 0.01 ORDER BY lift DESC, canonical_id, predicate_name, predicate_value LIMIT 6")
on_cube("rank_pair_gate", lambda c: effect.rank(_lift(c), min_lift_in_pair=0.02).select("canonical_id", "predicate_name", "predicate_value", "lift"), f"{_LIFT}, w AS (SELECT *, max(lift) OVER (PARTITION BY canonical_id, predicate_name) AS t FROM lift) SELECT canonical_id, predicate_name, predicate_value, round(lift, 6) AS lift FROM w WHERE {_NO_N} AND t > 0.02")
on_cube("feature_profile", lambda c: effect.feature_profile(effect.did(_lift(c)).where("predicate_name in ('lang', 'is_long', 'quality')")),
        f"""{_DID}, r AS (SELECT *, row_number() OVER (PARTITION BY canonical_id, predicate_name ORDER BY coalesce(abs(did), 0) DESC, predicate_value) AS r FROM dd WHERE predicate_name IN ('lang', 'is_long', 'quality')), f AS (SELECT * FROM r WHERE r = 1),
        g AS (SELECT canonical_id, max(did) FILTER (predicate_name = 'lang') AS did_lang, max(did) FILTER (predicate_name = 'is_long') AS did_is_long, max(did) FILTER (predicate_name = 'quality') AS did_quality, max(abs(did)) AS max_abs_did, avg(did) AS breadth_mean, count(*) FILTER (did >= 0.01) AS up, count(*) FILTER (did <= -0.01) AS down FROM f GROUP BY 1)
        SELECT canonical_id, round(did_lang, 6) AS did_lang, round(did_is_long, 6) AS did_is_long, round(did_quality, 6) AS did_quality, 0::BIGINT AS n_sig_slices, round(max_abs_did, 6) AS max_abs_did, round(breadth_mean, 6) AS breadth_mean,
        CASE WHEN up + down = 0 THEN 'null' WHEN up > 0 AND down > 0 THEN 'mixed' WHEN up + down <= 2 THEN 'selective' ELSE 'broad' END AS classification FROM g""")  # fmt: skip
on_cube("predicate_overlap", lambda c: effect.predicate_overlap(c, 0.2), "p AS (SELECT DISTINCT * FROM predicates), z AS (SELECT name, value, count(*) AS k FROM p GROUP BY ALL), j AS (SELECT a.name AS name_a, a.value AS value_a, b.name AS name_b, b.value AS value_b, count(*) AS n_shared FROM p a JOIN p b ON a.query_id = b.query_id AND a.name < b.name GROUP BY ALL) SELECT name_a, value_a, name_b, value_b, n_shared, round(n_shared / (x.k + y.k - n_shared), 6) AS jaccard FROM j JOIN z x ON x.name = name_a AND x.value = value_a JOIN z y ON y.name = name_b AND y.value = value_b WHERE n_shared / (x.k + y.k - n_shared) >= 0.2")
on_cube("predicate_kinds", effect.predicate_kinds, "SELECT name, CASE WHEN bool_and(try_cast(value AS DOUBLE) IS NOT NULL) THEN 'numeric' ELSE 'categorical' END AS kind, count(DISTINCT value) AS n_values FROM predicates GROUP BY 1")
def _replicated(keys: str, rows: str, resamples: int, level: float) -> str:
    """Replicates by the same hash: weights of every unit and resample, then a difference of weighted means for each."""
    mean = lambda arm: f"sum(value * w) FILTER (arm = {arm}) / nullif(sum(w) FILTER (arm = {arm}), 0)"
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return f"""r AS MATERIALIZED ({rows}), u AS MATERIALIZED (SELECT unit, b, {confidence.weight_sql("unit", "b::UBIGINT")} AS w FROM (SELECT DISTINCT unit FROM r), range({resamples}) t(b)),
        m AS MATERIALIZED (SELECT {keys}, b, {mean(1)} - {mean(0)} AS d FROM r JOIN u USING (unit) GROUP BY ALL), k AS (SELECT {keys} FROM r GROUP BY ALL HAVING count(*) FILTER (arm = 0) >= 2 AND count(*) FILTER (arm = 1) >= 2),
        ci AS (SELECT {keys}, round(quantile_cont(d, {lo:.6f}), 6) AS ci_lo, round(quantile_cont(d, {hi:.6f}), 6) AS ci_hi, round(avg((d > 0)::INT), 6) AS p_gt_zero FROM m JOIN k USING ({keys}) WHERE d IS NOT NULL GROUP BY ALL)"""


def _unit(named: str) -> str:
    return f"('0x' || md5({named})[1:8])::UBIGINT AS unit"


_K3 = "canonical_id, predicate_name, predicate_value"
_TARGETS = "s t JOIN configs c USING (config_id) JOIN predicates p USING (query_id)"


def _paired(names: str) -> str:
    arm = "SELECT canonical_id, name AS predicate_name, value AS predicate_value, {} AS arm, {} , {} AS value FROM {} JOIN s b USING (query_id) WHERE b.config_id = 1 AND kind = 'add_one_feature' AND name IN ({})"
    return " UNION ALL ".join(arm.format(a, _unit("query_id"), v, _TARGETS, names) for a, v in ((1, "t.score"), (0, "b.score")))


def _apart(names: str) -> str:
    return f"""SELECT canonical_id, name, value, 1, {_unit("concat('1:', query_id)")}, t.score FROM {_TARGETS} WHERE kind = 'add_one_feature' AND name IN ({names})
        UNION ALL SELECT x.canonical_id, name, value, 0, {_unit("concat('0:', query_id)")}, score FROM s JOIN predicates p USING (query_id) JOIN (SELECT DISTINCT c.canonical_id, p.name, p.value FROM {_TARGETS} WHERE kind = 'add_one_feature') x USING (name, value) WHERE config_id = 1 AND name IN ({names})"""


_LIFTS2 = "predicate_name in ('lang', 'is_long')"
on_cube("paired_bootstrap", lambda c: confidence.attach_ci(_lift(c).where(_LIFTS2), c, 1, M, SC, resamples=100).select(*confidence.KEYS, "lift", "ci_lo", "ci_hi", "p_gt_zero"),
        f"""{_LIFT}, {_replicated(_K3, _paired("'lang', 'is_long'"), 100, 0.95)} SELECT {_K3}, round(lift, 6) AS lift, ci_lo, ci_hi, p_gt_zero FROM lift LEFT JOIN ci USING ({_K3}) WHERE {_LIFTS2}""")
_HELD = f"SELECT {_K3}, has::INT AS arm, {_unit('''concat(has::INT, ':', config_id)''')}, m AS value FROM h"
on_cube("marginal_bootstrap", lambda c: confidence.attach_ci(effect.lift_marginal(c, M, SC, "bucket"), c, 1, M, SC, resamples=100, method="marginal").select(*confidence.KEYS, "lift", "ci_lo", "ci_hi", "p_gt_zero"),
        f"""{MEANS}, h AS MATERIALIZED (SELECT f.canonical_id, pm.*, EXISTS (FROM config_features k WHERE k.config_id = pm.config_id AND k.feature_id = f.feature_id) AS has FROM pm, features f WHERE predicate_name = 'bucket'),
        {_replicated(_K3, _HELD, 100, 0.95)},
        lift AS (SELECT {_K3}, avg(m) FILTER (has) - avg(m) FILTER (NOT has) AS lift FROM h GROUP BY ALL HAVING count(*) FILTER (has) > 0 AND count(*) FILTER (NOT has) > 0)
        SELECT {_K3}, round(lift, 6) AS lift, ci_lo, ci_hi, p_gt_zero FROM lift LEFT JOIN ci USING ({_K3})""")  # fmt: skip
on_cube("mixed_bootstrap", lambda c: confidence.with_interval(confidence.replicates(confidence.paired_arms(c, 1, M, SC).where("predicate_name = 'lang'").unionByName(confidence.unpaired_arms(c, 1, M, SC).where("predicate_name = 'is_long'")), confidence.KEYS, 100), 0.8),
        f"""{ONE}, {_replicated(_K3, _paired("'lang'") + " UNION ALL " + _apart("'is_long'"), 100, 0.8)} SELECT * FROM ci""")


def _deltas_for_bootstrap(c: Cube) -> DataFrame:
    rows = c.scored_executions(M, SC, "is_long")
    base = rows.where("config_id = 1").select("query_id", F.col("score").alias("b"))
    return rows.where("config_id = 2").join(base, "query_id").select("predicate_value", "query_id", (F.col("score") - F.col("b")).alias("delta"))


_DELTAS = "FROM s t JOIN s b USING (query_id) JOIN predicates p USING (query_id) WHERE t.config_id = 2 AND b.config_id = 1 AND p.name = 'is_long'"
_DELTA_ROWS = f"SELECT p.value AS predicate_value, 1 AS arm, {_unit('query_id')}, t.score - b.score AS value {_DELTAS} UNION ALL SELECT p.value, 0, {_unit('query_id')}, 0 {_DELTAS}"
on_cube("hashed_bootstrap", lambda c: confidence.hashed_bootstrap(_deltas_for_bootstrap(c), ["predicate_value"], resamples=40),
        f"{ONE}, {_replicated('predicate_value', _DELTA_ROWS, 40, 0.9)} SELECT * FROM ci")
_QUERIES["pipeline_effects"] = lambda spark, sf: rounded(Pipeline(projected(spark, sf)).source(M, SC).scope(1).effect().filter(min_effect=0.01).rank("lift", 10).run().select("canonical_id", "predicate_name", "predicate_value", "lift", "did"))
_SQL["pipeline_effects"] = f"{CTES}, {_DID} SELECT canonical_id, predicate_name, predicate_value, round(lift, 6) AS lift, round(did, 6) AS did FROM dd WHERE {_NO_N} AND abs(lift) >= 0.01 ORDER BY lift DESC, canonical_id, predicate_name, predicate_value LIMIT 10"

# -- matching of sets ---------------------------------------------------------
on_design("find_config_by_features", lambda c: resolve.find_config_by_features(c, ["feat_3", "feat_5"]), "SELECT config_id FROM config_features JOIN features USING (feature_id) GROUP BY 1 HAVING count(*) = 2 AND bool_and(canonical_id IN ('feat_3', 'feat_5'))")
on_design("near_configs", lambda c: resolve.near_configs(c, ["feat_3", "feat_7", "feat_9"], 12),
          "w AS (SELECT feature_id FROM features WHERE canonical_id IN ('feat_3', 'feat_7', 'feat_9')), g AS (SELECT config_id, count(*) AS held, count(*) FILTER (feature_id IN (SELECT feature_id FROM w)) AS shared FROM config_features GROUP BY 1), d AS (SELECT config_id, 3 - shared AS missing, held - shared AS extra FROM g WHERE shared > 0) SELECT *, row_number() OVER (ORDER BY missing + extra, config_id)::INT AS rank FROM d QUALIFY rank <= 12")
on_design("configs_containing_features", resolve.configs_containing_features, "SELECT f.canonical_id, c.config_id FROM features f, configs c WHERE list_has_all(string_split(c.funcs, ','), string_split(f.funcs, ','))")
on_design("simple_effect_configs", lambda c: resolve.simple_effect_configs(c, 1),
          """x AS (SELECT config_id, canonical_id, kind, list_sort(list_filter(string_split(funcs, ','), lambda f: f <> 'u1')) AS extra, (SELECT list_sort(list(feature_id)) FROM config_features k WHERE k.config_id = c.config_id) AS ids FROM configs c WHERE config_id <> 1),
          f AS (SELECT canonical_id AS c, feature_id, list_sort(list_filter(string_split(funcs, ','), lambda f: f <> 'u1')) AS fx FROM features),
          w AS (SELECT c, config_id, 1 AS way FROM f JOIN x ON ids = [feature_id] UNION ALL SELECT c, config_id, 2 FROM f JOIN x ON kind = 'add_one_feature' AND canonical_id = c UNION ALL SELECT c, config_id, 3 FROM f JOIN x ON fx = extra)
          SELECT c AS canonical_id, config_id, way FROM w QUALIFY row_number() OVER (PARTITION BY c ORDER BY way, config_id) = 1""")
on_design("base_like_features", lambda c: resolve.base_like_features(c, 5), "SELECT f.canonical_id FROM features f, configs c WHERE c.config_id = 5 AND list_has_all(string_split(c.funcs, ','), string_split(f.funcs, ','))")
on_design("equal_func_sets", lambda c: resolve.same_funcs(c).select("n", "first_config"), "SELECT count(*) AS n, min(config_id) AS first_config FROM configs GROUP BY list_sort(string_split(funcs, ','))")

# -- adaptive -----------------------------------------------------------------
_NAMES = ["lang", "is_long"]
_D = f"{ALL}, w AS (SELECT q.query_id, coalesce(max(value) FILTER (name = 'lang'), '') AS lang, coalesce(max(value) FILTER (name = 'is_long'), '') AS is_long FROM queries q LEFT JOIN predicates p ON p.query_id = q.query_id GROUP BY 1), pr AS (SELECT config_id, array_to_string(list_sort(list_filter(string_split(funcs, ','), lambda x: x <> 'f0')), '+') AS primitive_id FROM configs WHERE config_id <> 1), d AS MATERIALIZED (SELECT t.query_id, primitive_id, t.config_id, b.score AS baseline_score, t.score AS primitive_score, t.score - b.score AS delta, w.lang, w.is_long FROM a t JOIN pr USING (config_id) JOIN a b ON b.query_id = t.query_id AND b.config_id = 1 JOIN w ON w.query_id = t.query_id)"
_delta = lambda c: adaptive.build_delta_table(c, 1, M, SC, _NAMES)
on_cube("predicate_table", lambda c: adaptive.predicate_table(c, ["lang", "quality"]), "SELECT q.query_id, coalesce(max(value) FILTER (name = 'lang'), '') AS lang, coalesce(max(value) FILTER (name = 'quality'), '') AS quality FROM queries q LEFT JOIN predicates p ON p.query_id = q.query_id GROUP BY 1")
on_cube("delta_table", _delta, f"{_D} SELECT * FROM d")
on_cube("delta_predicate_types", lambda c: adaptive.predicate_types(_delta(c).join(adaptive.predicate_table(c, ["n_chars"]), "query_id"), ["lang", "n_chars"]), "SELECT * FROM (VALUES ('lang', 'categorical'), ('n_chars', 'numerical')) AS t(name, type)")
_CELLS = f"{_D}, l AS (SELECT primitive_id, delta, unnest(['lang', 'is_long']) AS predicate_name, unnest([lang, is_long]) AS predicate_value FROM d), tt AS (SELECT primitive_id, count(*) AS n_total FROM d GROUP BY 1), cells AS MATERIALIZED (SELECT primitive_id, predicate_name, predicate_value, count(*) AS n, avg(delta) AS mean, stddev_samp(delta) AS std, any_value(n_total) AS n_total FROM l JOIN tt USING (primitive_id) WHERE predicate_value <> '' GROUP BY ALL)"
on_cube("summarize_cells", lambda c: adaptive.summarize_cells(_delta(c), _NAMES), f"{_CELLS} SELECT primitive_id, predicate_name, predicate_value, n, round(mean, 6) AS mean, round(std, 6) AS std, round(CASE WHEN n > 1 THEN std / sqrt(n) ELSE 'inf'::DOUBLE END, 6) AS se, round(n / n_total, 6) AS coverage FROM cells")
_SLOPES = "x AS (SELECT primitive_id, n_chars::DOUBLE AS x, delta AS y FROM d JOIN queries USING (query_id)), g AS (SELECT primitive_id, count(*) AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM x GROUP BY 1)"
_slopes = lambda c: adaptive.regressions(adaptive.build_delta_table(c, 1, M, SC, ["n_chars"]), "n_chars")
# a two-sided p below 0.05 is a z beyond 1.959964
on_cube("classify_primitives", lambda c: adaptive.classify_primitives(_delta(c), adaptive.summarize_cells(_delta(c), _NAMES), _slopes(c)),
        f"""{_CELLS}, {_SLOPES}, z AS (SELECT primitive_id, abs(sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) > 1.959964 AS bent FROM g WHERE n >= 10 AND sxx > 0),
        s AS (SELECT primitive_id, bool_or(n >= 50 AND mean > 0.02) AND bool_or(n >= 50 AND mean < -0.02) AS split FROM cells GROUP BY 1), whole AS (SELECT primitive_id, avg(delta) AS m, count(*) AS n FROM d GROUP BY 1)
        SELECT primitive_id, round(m, 6) AS global_mean, n AS global_n, CASE WHEN n < 30 THEN 'undetermined' WHEN coalesce(split, false) OR coalesce(bent, false) THEN 'gated' WHEN m > 0.02 THEN 'always_on' WHEN m < -0.02 THEN 'always_off' ELSE 'undetermined' END AS kind
        FROM whole LEFT JOIN s USING (primitive_id) LEFT JOIN z USING (primitive_id)""")  # fmt: skip
on_cube("pick_target_cells", lambda c: adaptive.pick_target_cells(adaptive.summarize_cells(_delta(c), _NAMES)),
        f"""{_CELLS}, grid AS (SELECT * FROM (SELECT DISTINCT primitive_id FROM cells), (SELECT DISTINCT predicate_name, predicate_value FROM cells)),
        t AS (SELECT primitive_id, predicate_name, predicate_value, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 2.0 WHEN n = 1 THEN abs(mean) + 1.0 ELSE abs(mean) + std / sqrt(n) END AS priority FROM grid LEFT JOIN cells USING (primitive_id, predicate_name, predicate_value))
        SELECT primitive_id, predicate_name, predicate_value, n, round(priority, 6) AS priority FROM t WHERE priority >= 0.01 ORDER BY round(priority, 12) DESC, 1, 2, 3 LIMIT 10""")  # fmt: skip
on_cube("regression_on_predicate", lambda c: adaptive.regressions(adaptive.build_delta_table(c, 1, M, SC, ["n_chars"]), "n_chars").select("primitive_id", "n", (F.col("slope") * 1e6).alias("slope_e6"), (F.col("se") * 1e6).alias("se_e6")),
        f"""{_D}, x AS (SELECT primitive_id, n_chars::DOUBLE AS x, delta AS y FROM d JOIN queries USING (query_id)), g AS (SELECT primitive_id, count(*) AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM x GROUP BY 1)
        SELECT primitive_id, n, round(sxy / sxx * 1e6, 6) AS slope_e6, round(sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) * 1e6, 6) AS se_e6 FROM g""")  # fmt: skip
on_cube("stratified_sample", lambda c: adaptive.stratified_sample(c.query.select("query_id", "dataset"), "dataset", "query_id", 100, 7), "z AS (SELECT dataset, greatest(1, floor(100 * count(*) / (SELECT count(*) FROM queries)))::BIGINT AS quota FROM queries GROUP BY 1), r AS (SELECT query_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY md5('7:' || query_id), query_id) AS r FROM queries) SELECT query_id, dataset FROM r JOIN z USING (dataset) WHERE r <= quota")
on_cube("targeted_plan", lambda c: adaptive.targeted_plan(c, c.spark.createDataFrame([("fa", "lang", "de"), ("fb", "is_long", "true")], "primitive_id string, predicate_name string, predicate_value string"), M, c.spark.createDataFrame([("fa", 2), ("fb", 3)], "primitive_id string, config_id bigint"), 5),
        f"""cells AS (SELECT * FROM (VALUES ('fa', 'lang', 'de', 2::BIGINT), ('fb', 'is_long', 'true', 3)) AS t(primitive_id, predicate_name, predicate_value, config_id)), w AS (SELECT cells.*, query_id FROM cells JOIN predicates p ON p.name = predicate_name AND p.value = predicate_value WHERE NOT EXISTS (FROM executions e WHERE e.config_id = cells.config_id AND e.query_id = p.query_id AND model = '{M}')),
        r AS (SELECT *, row_number() OVER (PARTITION BY primitive_id, predicate_name, predicate_value ORDER BY md5('0:' || query_id), query_id) AS r FROM w) SELECT primitive_id, config_id, predicate_name, predicate_value, query_id FROM r WHERE r <= 5""")  # fmt: skip
on_design("trim_plan", lambda c: adaptive.trim_plan(c.config.select("config_id", (F.col("config_id") % 7 + 1).alias("size")), "config_id", "size", 500).select("config_id", "granted"), "b AS (SELECT config_id, config_id % 7 + 1 AS size, coalesce(sum(config_id % 7 + 1) OVER (ORDER BY config_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM configs) SELECT config_id, least(size, 500 - before)::BIGINT AS granted FROM b WHERE before < 500")
on_cube("cohorts", lambda c: adaptive.cohorts(c, ["lang", "quality"], min_size=5, max_queries=8), "w AS (SELECT query_id, max(value) FILTER (name = 'lang') || '|' || max(value) FILTER (name = 'quality') AS cohort FROM predicates GROUP BY 1), z AS (SELECT cohort FROM w WHERE cohort IS NOT NULL GROUP BY 1 HAVING count(*) >= 5), r AS (SELECT cohort, query_id, row_number() OVER (PARTITION BY cohort ORDER BY md5('0:' || query_id), query_id) AS r FROM w JOIN z USING (cohort)) SELECT cohort, query_id FROM r WHERE r <= 8")
on_cube("cross_plan", lambda c: adaptive.cross_plan(c.config.select("config_id", F.when(F.col("config_id") % 2 == 0, "en").otherwise("fr").alias("cohort")), adaptive.cohorts(c, ["lang"])), "SELECT cohort, config_id, query_id FROM (SELECT config_id, CASE WHEN config_id % 2 = 0 THEN 'en' ELSE 'fr' END AS cohort FROM configs) JOIN (SELECT value AS cohort, query_id FROM predicates WHERE name = 'lang') USING (cohort)")
on_cube("routing_oracle_gain", lambda c: routing.oracle_gain(_delta(c)), f"{_D}, b AS (SELECT query_id, max(delta) AS m FROM d GROUP BY 1) SELECT round(avg(greatest(0, m)), 6) AS oracle_gain, count(*) AS n_queries FROM b")
_ROUTE = "CASE lang WHEN 'en' THEN 'feat_a' WHEN 'de' THEN 'feat_b' WHEN 'fr' THEN 'no such edit' END"
on_cube("routes_evaluated", lambda c: routing.evaluate_routes(_delta(c).select("query_id", "lang").distinct().select("query_id", F.expr(_ROUTE).alias("route")), _delta(c)),
        f"""{_D}, r AS (SELECT DISTINCT query_id, {_ROUTE} AS route FROM d), g AS (SELECT r.query_id, route, coalesce(d.delta, 0) AS delta FROM r LEFT JOIN d ON d.query_id = r.query_id AND d.primitive_id = route), b AS (SELECT query_id, max(delta) AS m FROM d GROUP BY 1), o AS (SELECT avg(greatest(0, m)) AS g, count(*) AS n FROM b),
        t AS (SELECT avg(delta) AS gain, count(route) AS n_routed, count(*) FILTER (route IS NULL) AS n_base FROM g) SELECT round(gain, 6) AS routing_gain, n_routed, n_base, round(g, 6) AS oracle_gain, n AS n_queries, round(gain / g, 6) AS ratio FROM t, o""")
on_cube("rank_second", lambda c: effect.rank(_lift(c), sort_by="n_target", sort_secondary=[("lift", True)], top_k=12).select("canonical_id", "predicate_name", "predicate_value", "n_target"), f"{_LIFT} SELECT canonical_id, predicate_name, predicate_value, n_target FROM lift WHERE {_NO_N} ORDER BY n_target DESC, lift, canonical_id, predicate_name, predicate_value LIMIT 12")
on_cube("routing_gain", lambda c: routing.evaluate_routing(routing.fit_routing(_delta(c), _NAMES, leaf=20), _delta(c)))
on_cube("design_frame", lambda c: design.to_frame(c.spark, design.generate("add_one", base=["f0"], items=["fa", "fb", "fc"])).select("config_id", "label", F.array_join("func_ids", ",").alias("funcs")), "SELECT * FROM (VALUES (1::BIGINT, 'base', 'f0'), (2, 'add:fa', 'f0,fa'), (3, 'add:fb', 'f0,fb'), (4, 'add:fc', 'f0,fc')) AS t(config_id, label, funcs)")

# -- predicates and scalar functions ------------------------------------------
def _all_predicates(t) -> DataFrame:
    text = F.col("text")
    return P.extract(t("benchmark"), "item_id", P.task_predicates("table", text) | P.task_predicates("sql", text, evidence=text, difficulty=F.lit(" Simple")) | P.task_predicates("fact", text) | P.task_predicates("sequential", text, F.lit(2), F.lit(1)))


# Fixed values, written out for the other engine.
_SQL_WORDS = {
    "has_aggregation": "total|sum|average|mean|count|how many|number of|all|every|combined|altogether",
    "has_superlative": "most|least|highest|lowest|best|worst|largest|smallest|greatest|fewest|maximum|minimum|top|bottom|longest|shortest|oldest|newest|first|last",
    "has_comparison": r"(more|less|greater|fewer|higher|lower|better|worse|bigger|smaller|longer|shorter|older|newer|earlier|later)\s+than",
    "has_temporal": r"before|after|during|between|year|month|day|date|season|century|decade|when|january|february|march|april|may|june|july|august|september|october|november|december|\d{4}",
    "has_negation": "not|no|never|neither|none|nobody|nothing|nowhere|nor|without|didn''t|doesn''t|don''t|wasn''t|weren''t|isn''t|aren''t|hasn''t|haven''t|hadn''t|won''t|wouldn''t|couldn''t|shouldn''t",
    "has_arithmetic": "difference|subtract|add|multiply|divide|ratio|percent|percentage|how much more|how much less|how many more|how many fewer",
    "has_filter": r"(which|where|who|what)\b.*\b(with|in|at|from|for|on|during|after|before)",
    "is_count": "how many",
    "q_asks_count": "how many|count|number of|total number",
    "q_asks_max_min": "highest|lowest|most|least|maximum|minimum|greatest|smallest|top|best|worst|largest|biggest|fewest",
    "q_asks_ratio": "percentage|percent|ratio|proportion|share|rate|fraction",
    "q_asks_list": "list|name all|show all|give me all|find all|what are the",
    "q_asks_comparison": "more than|less than|greater than|higher than|lower than|at least|at most|between.*and|exceed|above|below",
    "q_asks_distinct": r"different|unique|distinct|types?\s+of|kinds?\s+of|categories\s+of",
    "q_asks_temporal": "born|before|after|since|until|during|older|younger|earliest|latest|recent",
    "has_numeric_claim": r"\d+\.?\d*",
    "has_reference": "those|that|these|them|they|it|its|their|the same|which one|which ones|above|previous|mentioned",
}
_is = lambda name: rf"regexp_matches(text, '(?i)\b({_SQL_WORDS[name]})\b')"
_yes = lambda name: f"CASE WHEN {_is(name)} THEN 'yes' ELSE 'no' END"
_OPERATION = f"CASE WHEN {_is('is_count')} THEN 'count' WHEN {_is('has_superlative')} THEN 'superlative' WHEN {_is('has_arithmetic')} THEN 'arithmetic' WHEN {_is('has_comparison')} THEN 'comparison' WHEN {_is('has_aggregation')} THEN 'aggregation' ELSE 'lookup' END"
_LENGTH = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"
_BASE = {n: _yes(n) for n in list(_SQL_WORDS)[:8]} | {"operation_type": _OPERATION, "question_length": f"{_LENGTH}::VARCHAR"}
_ALL = _BASE | {n: _yes(n) for n in _SQL_WORDS if n.startswith("q_asks_")}
_ALL |= {"has_evidence": "CASE WHEN trim(text) <> '' THEN 'yes' ELSE 'no' END", "difficulty": "'simple'", "long_question": f"CASE WHEN {_LENGTH} >= 30 THEN 'yes' ELSE 'no' END"}
_ALL |= {f"tabfact_{n}": v for n, v in _BASE.items()} | {"tabfact_statement_length": f"{_LENGTH}::VARCHAR", "tabfact_has_numeric_claim": _yes("has_numeric_claim")}
_ALL |= {f"sqa_{n}": v for n, v in _BASE.items()} | {"sqa_position": "'2'", "sqa_n_history": "'1'", "sqa_has_reference": _yes("has_reference")}
_ALL["sqa_operation_type"] = f"CASE WHEN {_OPERATION} = 'lookup' AND {_is('has_reference')} THEN 'follow_up' ELSE {_OPERATION} END"
on_tables("question_predicates", _all_predicates, " UNION ALL ".join(f"SELECT item_id, '{n}' AS name, {v} AS value FROM benchmark" for n, v in _ALL.items()))
on_tables("normalize_answer", lambda t: t("benchmark").select("item_id", S.normalize_answer(F.col("text")).alias("answer")), r"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[ \t\r\n]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS answer FROM benchmark")
on_tables("text_preview", lambda t: t("documents").select("doc_id", S.preview(F.col("text"), 60).alias("preview")), "SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS preview FROM documents")
on_tables("split_answers", lambda t: t("part").select("p_partkey", F.array_join(S.split_answers(F.concat_ws(",", "p_name", "p_brand")), "/").alias("answers")), "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(concat_ws(',', p_name, p_brand), ','), lambda x: trim(x)), lambda x: x <> ''), '/') AS answers FROM part")
_MESSAGES = ["no such table: x", "No such column: y", "ambiguous column name: z", "near q: syntax error", "Timeout of 30 s", "database is locked"]
on_tables("sql_error_kinds", lambda t: t("events").select("event_id", S.sql_error_kind(F.get(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 7).cast("int"))).alias("kind")),
          "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'table_not_found' WHEN 1 THEN 'column_not_found' WHEN 2 THEN 'ambiguous_column' WHEN 3 THEN 'syntax_error' WHEN 4 THEN 'timeout' WHEN 5 THEN 'execution_error' END AS kind FROM events")
on_tables("trigram_similarity", lambda t: t("nation").alias("a").join(t("nation").alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(F.col("a.n_nationkey").alias("x"), F.col("b.n_nationkey").alias("y"), S.trigram_similarity(F.col("a.n_name"), F.col("b.n_name")).alias("similarity")),
          "WITH g AS (SELECT n_nationkey, n_regionkey, list_distinct(list_transform(range(1, length('  ' || n_name || ' ') - 1), lambda i: substr('  ' || lower(n_name) || ' ', i, 3))) AS t FROM nation) SELECT a.n_nationkey AS x, b.n_nationkey AS y, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity FROM g a JOIN g b USING (n_regionkey)")
on_tables("hash_line_table", lambda t: t("benchmark").select("item_id", R.hash_lines(F.translate("text", ",", "#")).alias("t")).select("item_id", F.size("t.header").alias("n_cols"), F.size("t.rows").alias("n_rows")), "WITH l AS (SELECT item_id, list_filter(string_split(replace(text, ',', '#'), chr(10)), lambda x: trim(x) <> '') AS l FROM benchmark) SELECT item_id, len(string_split(l[1], '#'))::INT AS n_cols, (len(l) - 1)::INT AS n_rows FROM l")


def _nation_table(t) -> DataFrame:
    rows = t("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.array(F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), "n_name"))).alias("rows"))
    return rows.select("n_regionkey", F.struct(F.array(F.lit("key"), F.lit("name")).alias("header"), F.col("rows").alias("rows")).alias("t"))


_NATION = "WITH r AS (SELECT n_regionkey, list_sort(list([lpad(n_nationkey::VARCHAR, 2, '0'), n_name])) AS r FROM nation GROUP BY 1) "
on_tables("table_markdown", lambda t: _nation_table(t).select("n_regionkey", R.markdown(F.col("t")).alias("md")), _NATION + "SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(r, lambda x: '| ' || x[1] || ' | ' || x[2] || ' |'), chr(10)) AS md FROM r")
on_tables("table_csv", lambda t: _nation_table(t).select("n_regionkey", R.csv(F.col("t")).alias("csv")), _NATION + "SELECT n_regionkey, 'key,name' || chr(10) || array_to_string(list_transform(r, lambda x: x[1] || ',' || x[2]), chr(10)) AS csv FROM r")
on_tables("table_html", lambda t: _nation_table(t).select("n_regionkey", R.html(F.col("t")).alias("html")), _NATION + "SELECT n_regionkey, '<table><tr><th>key</th><th>name</th></tr>' || array_to_string(list_transform(r, lambda x: '<tr><td>' || x[1] || '</td><td>' || x[2] || '</td></tr>'), '') || '</table>' AS html FROM r")
on_tables("table_structure", lambda t: _nation_table(t).select("n_regionkey", *(c.alias(n) for n, c in P.table_structure(F.col("t.rows"), F.col("t.header")).items())), _NATION + "SELECT n_regionkey, len(r)::INT AS n_rows, 2 AS n_cols, 1 AS n_numeric_cols, 'yes' AS has_numeric_cols, CASE WHEN 2 / len(r) > 0.5 THEN 'wide' WHEN 2 / len(r) < 0.1 THEN 'tall' ELSE 'balanced' END AS t_shape FROM r")
on_tables("table_annotate_types", lambda t: _nation_table(t).select("n_regionkey", F.array_join(R.annotate_types(F.col("t"))["header"], ",").alias("header")), "SELECT DISTINCT n_regionkey, 'key (int),name (str)' AS header FROM nation")

# -- scorers ------------------------------------------------------------------
_GOLD = "SELECT e.execution_id, prediction, CAST(doc_id % 10 AS VARCHAR) AS gold, raw_response FROM executions e WHERE model = 'alpha' AND config_id = 2"
_gold = lambda c: c.execution.where("model = 'alpha' and config_id = 2").select("execution_id", "prediction", (F.col("query_id").cast("bigint") % 10).cast("string").alias("gold"), "raw_response")
on_cube("score_exact_match", lambda c: _gold(c).select("execution_id", G.exact_match(F.col("prediction"), F.col("gold")).alias("score")), f"g AS ({_GOLD}) SELECT execution_id, (prediction = gold)::DOUBLE AS score FROM g")
on_cube("score_denotation", lambda c: _gold(c).select("execution_id", G.denotation(F.concat("prediction", F.lit(".0, "), F.col("execution_id") % 3), F.concat(F.lit('["'), F.col("execution_id") % 3, F.lit('", "'), F.col("gold"), F.lit('"]'))).alias("score")),
        f"g AS ({_GOLD}), v AS (SELECT execution_id, list_sort(list_distinct([prediction, (execution_id % 3)::VARCHAR])) AS p, list_sort(list_distinct([(execution_id % 3)::VARCHAR, gold])) AS w FROM g) SELECT execution_id, (p = w)::INT::DOUBLE AS score FROM v")
on_cube("score_close_number", lambda c: _gold(c).select("execution_id", G.close_number(F.col("prediction"), F.col("gold")).alias("score")), f"g AS ({_GOLD}) SELECT execution_id, (abs(prediction::DOUBLE - gold::DOUBLE) <= 0.1 * abs(gold::DOUBLE))::INT::DOUBLE AS score FROM g")
on_tables("score_fact", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", G.fact_accuracy(F.when(F.col("l_returnflag") == "R", "Refuted.").when(F.col("l_returnflag") == "A", "yes").otherwise("maybe"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("score")), "SELECT l_orderkey, l_linenumber, (CASE l_returnflag WHEN 'R' THEN l_linestatus <> 'F' WHEN 'A' THEN l_linestatus = 'F' ELSE false END)::INT::DOUBLE AS score FROM lineitem")
on_tables("score_token_f1", lambda t: t("part").select("p_partkey", G.token_f1(F.col("p_name"), F.col("p_type")).alias("f1")),
          r"WITH n AS (SELECT p_partkey, list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[!-/:-@\[-`{-~]', '', 'g'), '[ \t\r\n]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')) AS p, list_filter(regexp_split_to_array(regexp_replace(lower(p_type), '[!-/:-@\[-`{-~]', '', 'g'), '[ \t\r\n]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')) AS g FROM part) SELECT p_partkey, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) = len(g))::INT::DOUBLE ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) / (len(p) + len(g)) END, 6) AS f1 FROM n")


def _baskets(t) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_partkey") % 5).cast("string")).alias("found"), F.collect_set((F.col("l_suppkey") % 5).cast("string")).alias("gold"))


_BASKETS = "WITH b AS (SELECT l_orderkey, list(DISTINCT (l_partkey % 5)::VARCHAR) AS found, list(DISTINCT (l_suppkey % 5)::VARCHAR) AS gold FROM lineitem GROUP BY 1) "
on_tables("score_retrieval", lambda t: _baskets(t).select("l_orderkey", *(c.alias(n) for n, c in G.retrieval(F.col("found"), F.col("gold")).items())), _BASKETS + "SELECT l_orderkey, list_has_all(found, gold)::INT::DOUBLE AS score, round(len(list_intersect(gold, found)) / len(gold), 6) AS recall FROM b")
on_tables("score_schema_link", lambda t: _baskets(t).select("l_orderkey", *(c.alias(n) for n, c in G.schema_link(F.col("found"), F.col("gold")).items())), _BASKETS + "SELECT l_orderkey, round(h / len(found), 6) AS precision, round(h / len(gold), 6) AS recall, round(CASE WHEN h = 0 THEN 0 ELSE 2 * (h / len(found)) * (h / len(gold)) / (h / len(found) + h / len(gold)) END, 6) AS f1 FROM (SELECT *, len(list_intersect(found, gold)) AS h FROM b)")
_SAYS = "CASE c_custkey % 3 WHEN 0 THEN CONCAT('The ', LOWER(c_name), '!') WHEN 1 THEN CONCAT(c_name, ' of ', LOWER(c_mktsegment)) ELSE c_mktsegment END"
on_tables("score_privacy", lambda t: t("customer").select("c_custkey", *(c.alias(n) for n, c in G.privacy(F.expr(_SAYS), F.col("c_name"), F.array(F.lit("0001"), F.col("c_mktsegment"))).items())),
          f"WITH x AS (SELECT c_custkey, {_SAYS} AS p, c_custkey % 3 = 0 AS same, c_mktsegment FROM customer) SELECT c_custkey, contains(lower(p), '0001') OR contains(lower(p), lower(c_mktsegment)) AS leaked, (same AND NOT (contains(lower(p), '0001') OR contains(lower(p), lower(c_mktsegment))))::INT::DOUBLE AS score FROM x")
on_tables("score_execution_match", lambda t: G.same_rows(t("nation").select("n_regionkey", "n_name"), t("nation").where("n_regionkey <> 2").select("n_regionkey", "n_name")), "SELECT count(*) FILTER (n_regionkey = 2) AS left_only, 0::BIGINT AS right_only FROM nation")
on_cube("failed_predictions", lambda c: benchmarks.failed_predictions([c], SC), f"SELECT query_id, prediction AS wrong, count(*) AS n, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM executions JOIN evaluations USING (execution_id) WHERE scorer = '{SC}' AND score = 0 GROUP BY ALL")
_ROUGE = "CONCAT_WS(' ', p_name, p_type, p_name, CASE WHEN p_partkey % 2 = 0 THEN LOWER(p_type) END)"
on_tables("score_rouge_l", lambda t: t("part").select("p_partkey", G.rouge_l(F.expr(_ROUGE), F.expr("CONCAT_WS(' ', p_type, SUBSTRING_INDEX(p_name, ' ', -1), p_type, SUBSTRING_INDEX(p_name, ' ', 1))")).alias("score")),
          f"""WITH x AS (SELECT p_partkey, string_split({_ROUGE}, ' ') AS p, [p_type, split_part(p_name, ' ', 2), p_type, split_part(p_name, ' ', 1)] AS g FROM part),
          m AS (SELECT *, unnest(range(16)) AS bits FROM x), s AS (SELECT *, list_filter([CASE WHEN bits & 1 > 0 THEN g[1] END, CASE WHEN bits & 2 > 0 THEN g[2] END, CASE WHEN bits & 4 > 0 THEN g[3] END, CASE WHEN bits & 8 > 0 THEN g[4] END], lambda v: v IS NOT NULL) AS sub FROM m),
          f AS (SELECT p_partkey, any_value(len(p)) AS n, max(len(sub)) AS l FROM s WHERE concat('  ', array_to_string(p, '  '), '  ') LIKE concat('%', array_to_string(list_transform(sub, lambda v: ' ' || v || ' '), '%'), '%') GROUP BY 1) SELECT p_partkey, round(2.0 * l / (n + 4), 6) AS score FROM f""")  # fmt: skip

_RIGHT = "CONCAT(CAST(CAST(o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,1)) AS VARCHAR(30)), ', ', CAST(o_orderkey % 7 AS VARCHAR(20)), '%, ', o_orderstatus)"
_SAID2 = "CONCAT(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30)), ',0.0', CAST(o_orderkey % 5 AS VARCHAR(20)), CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CONCAT(' , ', o_orderstatus) END)"
_HALF = "(floor(CAST(o_totalprice AS DECIMAL(18,2)) * 10 + 0.5) = floor(CAST(o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,1)) * 10 + 0.5))"
on_tables("score_answers_match", lambda t: t("orders").select("o_orderkey", G.answers_match(F.expr(_SAID2), F.expr(_RIGHT)).alias("score")),
          f"SELECT o_orderkey, round(({_HALF}::INT + (o_orderkey % 7 = o_orderkey % 5)::INT + (o_orderkey % 11 <> 0)::INT) / 3.0, 6) AS score FROM orders")
on_tables("score_answers_near", lambda t: t("orders").select("o_orderkey", G.answers_near(F.expr("CONCAT(CAST(o_orderkey % 100 AS VARCHAR(20)), ', ', o_orderstatus)"), F.expr("CONCAT(CAST(o_custkey % 100 AS VARCHAR(20)), ', F')")).alias("score")),
          "SELECT o_orderkey, round(((abs(o_orderkey % 100 - o_custkey % 100) <= 0.1 * CASE WHEN o_custkey % 100 = 0 THEN 1 ELSE o_custkey % 100 END)::INT + (o_orderstatus = 'F')::INT) / 2.0, 6) AS score FROM orders")
_QTYPE, _QSUB = "CASE p_partkey % 4 WHEN 0 THEN 'FactChecking' WHEN 1 THEN 'NumericalReasoning' ELSE 'DataAnalysis' END", "CASE p_partkey % 3 WHEN 0 THEN 'TrendForecasting' WHEN 1 THEN 'ImpactAnalysis' ELSE 'CausalAnalysis' END"
on_tables("score_table_answer", lambda t: t("part").select("p_partkey", G.table_answer(F.expr(_QTYPE), F.expr(_QSUB), F.expr("CONCAT('The ', p_size, '.')"), F.expr("CAST(CASE WHEN p_partkey % 5 < 2 THEN p_size ELSE p_size + 1 END AS VARCHAR(20))")).alias("score")),
          f"WITH x AS (SELECT p_partkey, {_QTYPE} AS q, {_QSUB} AS s, p_size AS p, CASE WHEN p_partkey % 5 < 2 THEN p_size ELSE p_size + 1 END AS g FROM part) SELECT p_partkey, CASE WHEN q = 'DataAnalysis' AND s = 'TrendForecasting' THEN abs(p - g) <= 0.1 * g ELSE p = g END::INT::DOUBLE AS score FROM x")

# -- retrieval, windows and sources -------------------------------------------
_BM25 = """WITH tk AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents), z AS (SELECT count(*) AS nd, avg(len(t)) AS al FROM tk),
          q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark),
          p AS (SELECT term, doc_id, l, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM tk) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
          s AS (SELECT query_id, doc_id, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * l / al))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), z GROUP BY ALL),
          r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, rank::INT AS rank FROM r WHERE rank <= 7"""
on_tables("bm25", lambda t: retrieval.bm25(t("documents").select("doc_id", "text"), t("benchmark").select(F.col("item_id").alias("query_id"), "text")).select("query_id", "doc_id", "rank"), _BM25)


def _by_index(t) -> DataFrame:
    corpus = t("documents").select("doc_id", "text")
    return search.build(corpus, scratch.fresh_path(corpus.sparkSession, "index")).search(t("benchmark").select(F.col("item_id").alias("query_id"), "text"), keep=scratch.written).select("query_id", "doc_id", "rank")


on_tables("bm25_index", _by_index, _BM25)
on_tables("knn", lambda t: retrieval.knn(t("embeddings"), t("embeddings").where("vec_id % 100 = 0")).select("probe", "neighbour", "rank"),
          "WITH s AS (SELECT p.vec_id AS probe, v.vec_id AS neighbour, round(list_sum(list_transform(range(1, len(p.embedding) + 1), lambda i: p.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)), 6) AS score FROM embeddings p, embeddings v WHERE p.vec_id % 100 = 0 AND p.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, neighbour) AS rank FROM s) SELECT probe, neighbour, rank::INT AS rank FROM r WHERE rank <= 3")
_PROBES = """WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings),
    c AS MATERIALIZED (SELECT * FROM (SELECT p.vec_id AS probe, e.vec_id AS n, e.v, e.l, round(list_dot_product(p.v, e.v), 6) AS s, row_number() OVER (PARTITION BY p.vec_id ORDER BY round(list_dot_product(p.v, e.v), 6) DESC, e.vec_id) AS r FROM e p, e WHERE p.vec_id % 100 = 0 AND p.vec_id <> e.vec_id) WHERE r <= 30),
    one AS (SELECT * FROM c WHERE r = 1),
    two AS (SELECT c.* FROM c JOIN one a USING (probe) WHERE c.n <> a.n QUALIFY row_number() OVER (PARTITION BY probe ORDER BY 0.7 * c.s - 0.3 * list_dot_product(c.v, a.v) / (c.l * a.l) DESC, c.r) = 1),
    three AS (SELECT c.* FROM c JOIN one a USING (probe) JOIN two b USING (probe) WHERE c.n <> a.n AND c.n <> b.n QUALIFY row_number() OVER (PARTITION BY probe ORDER BY 0.7 * c.s - 0.3 * greatest(list_dot_product(c.v, a.v) / (c.l * a.l), list_dot_product(c.v, b.v) / (c.l * b.l)) DESC, c.r) = 1)
    SELECT probe, n AS neighbour, 1::INT AS rank FROM one UNION ALL SELECT probe, n, 2 FROM two UNION ALL SELECT probe, n, 3 FROM three"""
on_tables("example_mmr", lambda t: retrieval.sample_examples(t("embeddings"), t("embeddings").where("vec_id % 100 = 0")), _PROBES)
on_tables("overlap_similarity", lambda t: t("part").select("p_partkey", retrieval.hybrid(retrieval.overlap_similarity(F.array(F.col("p_size").cast("double"), F.lit(10.0)), F.array(F.lit(20.0), F.col("p_retailprice"))), F.lit(0.5)).alias("score")), "SELECT p_partkey, round(0.5 * (least(p_size, 20) + least(10, p_retailprice)) / (greatest(p_size, 20) + greatest(10, p_retailprice)) + 0.25, 6) AS score FROM part")
on_tables("random_examples", lambda t: retrieval.random_examples(t("nation").select(F.col("n_nationkey").alias("example_id")), t("region").select(F.col("r_regionkey").alias("query_id")), 3, 5), "WITH r AS (SELECT r_regionkey AS query_id, n_nationkey AS example_id, row_number() OVER (PARTITION BY r_regionkey ORDER BY md5('5:' || r_regionkey || ':' || n_nationkey), n_nationkey) AS rank FROM region, nation) SELECT query_id, example_id, rank::INT AS rank FROM r WHERE rank <= 3")
on_tables("conversation_history", lambda t: benchmarks.with_history(t("conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", F.size("history").alias("n"), F.array_join(F.transform("history", lambda h: h["question"]), ",").alias("roles")), "SELECT c.conv_id, c.turn, count(p.conv_id)::INT AS n, coalesce(string_agg(p.role, ',' ORDER BY p.turn), '') AS roles FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn < c.turn GROUP BY ALL")
on_tables("reservoir", lambda t: benchmarks.reservoir(t("orders").select("o_orderkey"), 50, "o_orderkey", 3), "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY md5('3:' || o_orderkey), o_orderkey LIMIT 50) ORDER BY 1")
on_tables("query_ids", lambda t: t("benchmark").select("item_id", benchmarks.query_key(F.lit("bench"), F.lit("c"), F.col("text")).alias("query_id")), "SELECT item_id, substr(sha256('bench:c:' || trim(text, ' ')), 1, 16) AS query_id FROM benchmark")

# -- structure of SQL text, on statements that each part's key and size make -----
_STATEMENT = """CONCAT('SELECT ', CASE WHEN p_partkey % 5 = 0 THEN 'DISTINCT ' ELSE '' END, SUBSTRING('t.c1, t.c2, t.c3, t.c4, t.c5, t.c6, t.c7', 1, CAST(4 + 6 * (p_partkey % 7) AS INT)), CASE WHEN p_partkey % 3 = 0 THEN ', count(*)' ELSE '' END,
 ' FROM tab', CAST(p_partkey % 4 AS VARCHAR(20)), ' AS t', CASE WHEN p_size % 3 >= 1 THEN ' JOIN "odd join" u1 ON t.id = u1.id' ELSE '' END, CASE WHEN p_size % 3 = 2 THEN ' LEFT JOIN more ON t.id = more.id' ELSE '' END,
 CASE p_partkey % 4 WHEN 1 THEN ' WHERE t.a = 1' WHEN 2 THEN ' WHERE t.a LIKE ''%or not (select%'' AND t.b BETWEEN 1 AND 2 AND t.c IS NOT NULL' WHEN 3 THEN ' WHERE t.a IN (SELECT b FROM v WHERE c IN (SELECT d FROM w))' ELSE '' END,
 CASE p_size % 5 WHEN 0 THEN ' GROUP BY t.a HAVING count(*) > 1' WHEN 1 THEN ' ORDER BY t.a LIMIT 5' WHEN 2 THEN ' UNION SELECT 1' WHEN 3 THEN ' -- union (comment' ELSE ')' END)"""
_PLANTED = {
    "has_join": "s % 3 >= 1", "has_subquery": "k % 4 = 3", "has_nested_subquery": "k % 4 = 3", "has_union": "s % 5 = 2", "has_limit": "s % 5 = 1", "has_distinct": "k % 5 = 0", "has_where": "k % 4 > 0", "has_group_by": "s % 5 = 0",
    "has_having": "s % 5 = 0", "has_order_by": "s % 5 = 1", "has_aggregation": "k % 3 = 0 OR s % 5 = 0", "has_like": "k % 4 = 2", "has_between": "k % 4 = 2", "has_in": "k % 4 = 3", "multi_join": "s % 3 = 2",
    "multi_table": "1 + s % 3 + CASE WHEN k % 4 = 3 THEN 2 ELSE 0 END >= 3", "many_conditions": "k % 4 = 2", "wide_select": "k % 7 + 1 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END >= 5", "has_string_op": "k % 4 = 2", "has_null_check": "k % 4 = 2", "has_not": "k % 4 = 2",
}


def _statements(t) -> DataFrame:
    # a small file of keys is much work: more tasks than the file has splits
    part = t("part").select("p_partkey", "p_size")
    return part.repartition(4 * part.sparkSession.sparkContext.defaultParallelism, "p_partkey").select("p_partkey", F.expr(_STATEMENT).alias("sql"))


def _sql_flags(t) -> DataFrame:
    yes = F.array_compact(F.array(*(F.when(c == "yes", F.lit(n)) for n, c in sql_structure.flags(F.col("w"), "").items())))
    walked = _statements(t).select("p_partkey", sql_structure.walked(F.col("sql")).alias("w"))
    return walked.select("p_partkey", F.array_join(F.array_sort(yes), ",").alias("flags"))


def _sql_names(t) -> DataFrame:
    aliases = F.array_sort(F.transform(F.map_entries("n.aliases"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    named = _statements(t).select("p_partkey", sql_structure.names(F.col("sql")).alias("n"))
    return named.select("p_partkey", F.array_join("n.tables", ",").alias("tables"), F.array_join(aliases, ",").alias("aliases"), F.size("n.columns").alias("n_columns"))


on_tables("sql_structure_flags", _sql_flags, f"""WITH x AS (SELECT p_partkey AS k, p_size AS s FROM part) SELECT k AS p_partkey, CASE WHEN s % 5 = 4 THEN '' ELSE array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _PLANTED.items())}], lambda v: v IS NOT NULL)), ',') END AS flags FROM x""")
on_tables("sql_structure_names", _sql_names,
          """WITH x AS (SELECT p_partkey AS k, p_size AS s FROM part) SELECT k AS p_partkey, CASE WHEN s % 5 = 4 THEN '' ELSE array_to_string(list_sort(list_filter([concat('tab', k % 4), CASE WHEN s % 3 >= 1 THEN 'odd join' END, CASE WHEN s % 3 = 2 THEN 'more' END, CASE WHEN k % 4 = 3 THEN 'v' END, CASE WHEN k % 4 = 3 THEN 'w' END], lambda v: v IS NOT NULL)), ',') END AS tables,
          CASE WHEN s % 5 = 4 THEN '' ELSE concat('t=tab', k % 4, CASE WHEN s % 3 >= 1 THEN ',u1=odd join' ELSE '' END) END AS aliases,
          CASE WHEN s % 5 = 4 THEN 0 ELSE (k % 7 + 1 + CASE s % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END + CASE k % 4 WHEN 0 THEN CASE WHEN s % 5 < 2 THEN 1 ELSE 0 END WHEN 2 THEN 3 ELSE 1 END) END::INT AS n_columns FROM x""")  # fmt: skip

# -- databases, numbered lines and readers, on files that Spark makes of the tables -----
_DATABASES = {"trade": ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"), "shop": ("clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps"), "corpus": ("documents", "benchmark", "labels", "conversations", "pages")}
_KEYS = [("trade", a, f"{p}_{k}", b, f"{q}_{k}") for a, p, k, b, q in (("nation", "n", "regionkey", "region", "r"), ("orders", "o", "custkey", "customer", "c"), ("lineitem", "l", "orderkey", "orders", "o"), ("lineitem", "l", "partkey", "part", "p"), ("lineitem", "l", "suppkey", "supplier", "s"))] + [
    ("trade", "customer", "c_nationkey", "nation", "n_nationkey"), ("trade", "supplier", "s_nationkey", "nation", "n_nationkey"), ("shop", "sales", "client_id", "clients", "client_id"), ("shop", "sale_lines", "sale_id", "sales", "sale_id"), ("corpus", "labels", "doc_id", "documents", "doc_id"),
]


def _dbs(t) -> databases.Databases:
    first = t("region")
    return databases.from_tables(first.sparkSession, {db: {name: first if name == "region" else t(name) for name in names} for db, names in _DATABASES.items()}, _KEYS)


_DB_COLUMNS = "c AS MATERIALIZED (SELECT CASE " + " ".join(f"WHEN table_name IN ({', '.join(repr(n) for n in names)}) THEN '{db}'" for db, names in _DATABASES.items()) + " END AS db, table_name, column_name, column_index, data_type FROM duckdb_columns() WHERE NOT internal)"
_DB_SIZES = "z AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{db}' AS db, '{n}' AS table_name, count(*) AS n FROM {n}" for db, names in _DATABASES.items() for n in names) + ")"
_DB_KEYS = "k AS (SELECT * FROM (VALUES " + ", ".join(f"('{db}', {sum(x[0] == db for x in _KEYS)})" for db in _DATABASES) + ") AS t(db, n_keys))"
_DB_TESTS = {
    "complex_schema": "n_tables >= 10", "deep_schema": "n_columns >= 55", "fk_rich": "n_keys >= n_tables", "data_large": "n_rows >= 100000", "giant_table": "most >= 50000", "wide_tables": "n_columns >= 8 * n_tables", "has_date_col": "dates > 0", "has_real_col": "reals >= 2",
    "text_heavy": "2 * texts >= n_columns", "has_special_cols": "false", "many_tables": "n_tables >= 8", "ambiguous_cols": "n_names < n_columns", "col_has_space": "false", "col_has_hyphen": "false",
}
on_tables("database_flags", lambda t: databases.flags(_dbs(t)), f"""WITH {_DB_COLUMNS}, {_DB_SIZES}, {_DB_KEYS},
    a AS (SELECT db, count(*) AS n_columns, count(DISTINCT lower(column_name)) AS n_names, count(*) FILTER (data_type = 'TIMESTAMP' OR regexp_matches(lower(column_name), 'date|time|year|month|day|created|updated|born|opened|closed|start|end')) AS dates, count(*) FILTER (data_type IN ('DOUBLE', 'FLOAT')) AS reals, count(*) FILTER (data_type = 'VARCHAR') AS texts FROM c WHERE db IS NOT NULL GROUP BY 1),
    b AS (SELECT db, count(*) AS n_tables, sum(n) AS n_rows, max(n) AS most FROM z GROUP BY 1)
    SELECT db, {", ".join(f"CASE WHEN {test} THEN 'yes' ELSE 'no' END AS {name}" for name, test in _DB_TESTS.items())} FROM a JOIN b USING (db) JOIN k USING (db)""")
on_tables("database_schema_text", lambda t: databases.schema_text(_dbs(t)), f"""WITH {_DB_COLUMNS}, b AS (SELECT db, table_name, 'CREATE TABLE `' || table_name || '` (' || chr(10) || string_agg('    `' || column_name || '` ' || data_type, ',' || chr(10) ORDER BY column_index) || chr(10) || ');' AS block FROM c WHERE db IS NOT NULL GROUP BY db, table_name)
    SELECT db, string_agg(block, chr(10) || chr(10) ORDER BY table_name) AS schema FROM b GROUP BY 1""")
on_tables("database_neighbours", lambda t: databases.neighbours(_dbs(t), t("region").limit(0).sparkSession.createDataFrame([("trade", "Orders"), ("shop", "clients"), ("corpus", "none")], "db string, table string")), "SELECT * FROM (VALUES ('trade', 'orders'), ('trade', 'customer'), ('trade', 'lineitem'), ('shop', 'clients'), ('shop', 'sales')) AS t(db, \"table\")")


def _stored(rows: DataFrame, key: str, text: bool = False) -> str:
    """Rows as JSON lines, or as text, in files that follow the key's order."""
    path = scratch.fresh_path(rows.sparkSession, "lines")
    ordered = rows.repartitionByRange(5, key).sortWithinPartitions(key)
    (ordered.select(F.col(key).cast("string")).write.text if text else ordered.write.json)(path)
    return path


on_tables("numbered_lines", lambda t: numbered.numbered_lines(t("orders").sparkSession, _stored(t("orders").select("o_orderkey"), "o_orderkey", text=True), across=True).select(F.col("value").cast("long").alias("o_orderkey"), "line"), "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS line FROM orders")
_BENCH_ROWS = """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'FactChecking' WHEN 1 THEN 'DataAnalysis' WHEN 2 THEN 'Visualization' ELSE 'NumericalReasoning' END AS qtype, p_type AS qsubtype, CONCAT('what is ', p_brand, '?') AS question, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS answer,
 CASE WHEN p_partkey % 2 = 0 THEN 'DP' ELSE 'TCoT' END AS instruction_type, CONCAT('Final Answer: no', CHR(10), 'Final Answer: ', p_brand) AS response, CONCAT('About ', p_name) AS instruction"""


def _bench_file(t) -> tuple:
    rows = t("part")
    made = rows.sparkSession.sql(_BENCH_ROWS.replace("{", "{{").replace("}", "}}") + " FROM {part}", part=rows).withColumn("table", F.struct(F.array(F.lit("c")).alias("columns"), F.array(F.array("question")).alias("data")))
    return rows.sparkSession, _stored(made, "id")


_BENCH = f"WITH b AS (SELECT *, row_number() OVER (ORDER BY id) AS line FROM ({_BENCH_ROWS} FROM part))"
_KEY16 = "substr(sha256({}), 1, 16)"
_at = lambda df, *names: df.select("query_id", *(F.get_json_object("meta", f"$.{n}").alias(n) for n in names))
on_tables("read_table_bench", lambda t: _at(benchmarks.read_table_bench(*_bench_file(t), instruction_types=("TCoT",)), "gold_answer", "qtype", "source_line"),
          f"""{_BENCH} SELECT {_KEY16.format("concat('tablebench:test:main:', instruction_type, ':', line, ':', id, ':', question)")} AS query_id, coalesce(answer, split_part(question, ' ', 3)[:-2]) AS gold_answer, qtype, line::VARCHAR AS source_line FROM b WHERE instruction_type = 'TCoT' AND qtype <> 'Visualization'""")
on_tables("read_verbatim_prompts", lambda t: _at(benchmarks.read_verbatim_prompts(*_bench_file(t), variant="PoT", plots=True), "instruction", "variant", "source_line"),
          f"""{_BENCH} SELECT {_KEY16.format("concat('tablebench_repro:test:PoT:', line, ':', id, ':PoT::', question)")} AS query_id, instruction, 'PoT' AS variant, line::VARCHAR AS source_line FROM b""")
on_tables("read_hierarchical", lambda t: _at(benchmarks.read_hierarchical(*_bench_file(t)), "gold_answer", "aggregation", "_raw.table_content"),
          f"""{_BENCH} SELECT {_KEY16.format("concat('hitab:dev:', line - 1, ':', question)")} AS query_id, answer AS gold_answer, 'none' AS aggregation, '{{}}' AS "_raw.table_content" FROM b""")
on_tables("read_multi_hop", lambda t: _at(benchmarks.read_multi_hop(*_bench_file(t)), "answer", "source_id"), f"""{_BENCH} SELECT {_KEY16.format("concat('hotpotqa_context:dev:', id, ':', question)")} AS query_id, answer, id::VARCHAR AS source_id FROM b""")

# -- larger tables, profiles, hints, close names ------------------------------
_COLS = ["name", "type", "size", "price"]


def _part_table(t) -> DataFrame:
    cells = F.array("p_name", "p_type", F.col("p_size").cast("string"), F.concat(F.lit("$"), F.col("p_retailprice").cast("string")))
    rows = t("part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("c")))).alias("rows"))
    return rows.select("p_brand", F.struct(F.array(*map(F.lit, _COLS)).alias("header"), F.transform("rows", lambda r: r["c"]).alias("rows")).alias("t"))


_STAT = """concat('{0} (', CASE WHEN count(DISTINCT {1}) <= 5 THEN concat('str, ', count(DISTINCT {1}), ' values: ', string_agg(DISTINCT {1}, ', ' ORDER BY {1})) WHEN count(DISTINCT {1}) = count({1}) THEN 'str, all unique' ELSE concat('str, ', count(DISTINCT {1}), ' unique') END, ')')"""
_NUMBERS = """concat('{0} ({2}, ', CASE WHEN count(DISTINCT {1}) <= 5 THEN concat(count(DISTINCT {1}), ' values: ', string_agg(DISTINCT {1}::VARCHAR, ', ' ORDER BY {1}::VARCHAR)) ELSE concat('range ', min({1}), '–', max({1}), ', ', count(DISTINCT {1}), ' unique') END, ')')"""
on_tables("table_column_stats", lambda t: _part_table(t).select("p_brand", R.column_stats(F.col("t")).alias("summary")),
          f"SELECT p_brand, concat('Columns: ', {_STAT.format('name', 'p_name')}, '; ', {_STAT.format('type', 'p_type')}, '; ', {_NUMBERS.format('size', 'p_size', 'int')}, '; ', {_NUMBERS.format('price', 'p_retailprice', 'float')}) AS summary FROM part GROUP BY 1")
_ASKED = "Which small or large green thing of size 12 or 37, type economy or promo, is cheap?"
_SCORED = f"""WITH x AS (SELECT p_brand, p_partkey, [p_name, p_type, p_size::VARCHAR, '$' || p_retailprice::VARCHAR] AS c FROM part), s AS (SELECT *, 3 * len(list_filter(c, lambda v: length(trim(v)) > 2 AND contains(lower('{_ASKED}'), lower(trim(v)))))
    + len(list_intersect(list_distinct(regexp_extract_all(lower(array_to_string(c, ' ')), '\\w+')), list_distinct(regexp_extract_all(lower('{_ASKED}'), '\\w+')))) AS score FROM x),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS r FROM s)"""
_names = lambda c: F.array_join(F.transform(c["rows"], lambda r: F.concat(r[0], F.lit("/"), r[3])), ",")
_SHOWN = "concat(c[1], '/', c[4])"
on_tables("table_filter_rows", lambda t: _part_table(t).select("p_brand", _names(R.filter_rows(F.col("t"), F.lit(_ASKED), 7)).alias("kept"), _names(R.filter_rows(F.col("t"), F.lit(_ASKED), 3, "head")).alias("head")),
          f"{_SCORED} SELECT p_brand, string_agg({_SHOWN}, ',' ORDER BY p_partkey) FILTER (r <= 7) AS kept, array_to_string(list({_SHOWN} ORDER BY p_partkey)[1:3], ',') AS head FROM r GROUP BY 1")
on_tables("table_sort_rows", lambda t: _part_table(t).select("p_brand", _names(R.sort_rows(F.col("t"), F.lit(_ASKED))).alias("rows")), f"{_SCORED} SELECT p_brand, string_agg({_SHOWN}, ',' ORDER BY r) AS rows FROM r GROUP BY 1")
on_tables("column_profile", lambda t: profile.profile(t("orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority", F.lit("").alias("nothing")), "o_orderkey").select("column", "kind", "n", "n_unique", "summary"),
          """WITH o AS (SELECT *, round(o_totalprice, 2) AS p, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) SELECT 'o_orderkey' AS "column", 'int' AS kind, count(*) AS n, count(DISTINCT o_orderkey) AS n_unique, concat('o_orderkey (int, range ', min(o_orderkey), '–', max(o_orderkey), ', ', count(DISTINCT o_orderkey), ' unique)') AS summary FROM o
          UNION ALL SELECT 'o_orderstatus', 'str', count(*), count(DISTINCT o_orderstatus), concat('o_orderstatus (str, ', count(DISTINCT o_orderstatus), ' values: ', string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus), ')') FROM o
          UNION ALL SELECT 'o_totalprice', 'float', count(*), count(DISTINCT p), concat('o_totalprice (float, range ', min(p), '–', max(p), ', ', count(DISTINCT p), ' unique)') FROM o
          UNION ALL SELECT 'o_orderdate', 'date', count(*), count(DISTINCT d), concat('o_orderdate (date, ', count(DISTINCT d), ' unique)') FROM o
          UNION ALL SELECT 'o_orderpriority', 'str', count(*), count(DISTINCT o_orderpriority), concat('o_orderpriority (str, ', count(DISTINCT o_orderpriority), ' values: ', string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority), ')') FROM o
          UNION ALL SELECT 'nothing', 'str', 0, 0, 'nothing (empty)'""")  # fmt: skip


def _typed(t) -> DataFrame:
    rows = t("lineitem").select(F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("price"), F.concat(F.col("l_linenumber").cast("string"), F.lit("%")).alias("share"), F.when(F.col("l_quantity") > 1, F.col("l_quantity").cast("string")).otherwise("one").alias("mixed"), "l_returnflag")
    made = profile.typed(rows)
    kinds = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.try_sum(F.col(c).try_cast("double")).alias("total")) for c, k in made.dtypes))
    return made.agg(kinds.alias("x")).select(F.explode("x").alias("x")).select("x.column", "x.kind", "x.total")


on_tables("typed_columns", _typed, """SELECT 'price' AS "column", 'double' AS kind, round(sum(round(l_extendedprice, 2)), 6) AS total FROM lineitem UNION ALL SELECT 'share', 'bigint', sum(l_linenumber)::DOUBLE FROM lineitem
          UNION ALL SELECT 'mixed', 'string', round(sum(l_quantity) FILTER (l_quantity > 1), 6) FROM lineitem UNION ALL SELECT 'l_returnflag', 'string', NULL""")
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda i: substr(lower({0}), i, 3)))"
on_tables("close_names", lambda t: names.close_names(t("vendors").select(F.col("name").alias("wanted")), t("clients").select("name", F.col("client_id").alias("position"))).select("wanted", "name", "similarity", "rank"),
          f"""WITH a AS (SELECT DISTINCT name AS wanted, {_GRAMS.format("name")} AS g FROM vendors WHERE name IS NOT NULL), b AS (SELECT name, min(client_id) AS position, any_value({_GRAMS.format("name")}) AS g FROM clients WHERE name IS NOT NULL GROUP BY 1),
          j AS (SELECT wanted, name, position, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS s FROM a, b WHERE lower(wanted) <> lower(name)), r AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY s DESC, position, name) AS rank FROM j WHERE s > 0.1)
          SELECT wanted, name, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 3""")
_HINT_SCHEMA = "CREATE TABLE orders (id INT, total REAL, customer_id INT REFERENCES customer(id));\nCREATE TABLE customer (id INT, full_name TEXT);"
_HINTED = """CASE o_orderkey % 4 WHEN 0 THEN CONCAT('no such table: ', o_orderstatus, 'orders') WHEN 1 THEN 'no such column: c.fullname' WHEN 2 THEN 'ambiguous column name: id' ELSE CONCAT('near "', o_orderpriority, '": syntax error') END"""
on_tables("error_hints", lambda t: t("orders").select("o_orderkey", hints.error_hint(F.expr(_HINTED), F.lit(_HINT_SCHEMA), F.lit("SELECT c.fullname FROM customer AS c")).alias("hint")),
          """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('Table ''', o_orderstatus, 'orders'' not found. Similar tables: orders.') WHEN 1 THEN 'Column ''c.fullname'' not found. Similar columns: full_name. Available in c: id, full_name.'
          WHEN 2 THEN 'Column ''id'' exists in multiple tables: orders, customer. Qualify with table name or alias.' ELSE concat('near "', o_orderpriority, '": syntax error') END AS hint FROM orders""")
_BOTH = "CASE WHEN p_size % 3 = 0 THEN 'none' WHEN p_size % 3 = 1 THEN CONCAT('Top', 'K_', p_brand) ELSE CONCAT('sum_', p_type) END"
on_tables("hierarchical_predicates", lambda t: P.seed(t("part").select(F.col("p_partkey").alias("query_id"), "*"), P.hierarchical_predicates(F.col("p_name"), F.expr(_BOTH), F.concat(F.lit("src "), F.when(F.col("p_size") > 25, "WikiPedia").otherwise("NSF table"))), only=["hitab_agg_type", "hitab_table_source", "hitab_question_length"]),
          """SELECT p_partkey AS query_id, 'hitab_agg_type' AS name, CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'ranking' ELSE CASE WHEN contains(lower(p_type), 'diff') THEN 'comparison' ELSE 'other' END END AS value FROM part UNION ALL SELECT p_partkey, 'hitab_table_source', CASE WHEN p_size > 25 THEN 'wikipedia' ELSE 'statistical_report' END FROM part
          UNION ALL SELECT p_partkey, 'hitab_question_length', len(list_filter(string_split(p_name, ' '), lambda w: w <> ''))::VARCHAR FROM part""")
on_tables("bench_predicates", lambda t: P.seed(t("part").select(F.col("p_partkey").alias("query_id"), "*"), P.bench_predicates(F.col("p_name"), F.nullif(F.col("p_type"), F.col("p_type")), F.col("p_brand")), only=["qtype", "qsubtype"]), "SELECT p_partkey AS query_id, 'qtype' AS name, 'unknown' AS value FROM part UNION ALL SELECT p_partkey, 'qsubtype', p_brand FROM part")
on_cube("per_query_scores", lambda c: inventory.per_query_scores(c, 2, "lang", M, SC), f"{ONE} SELECT value AS predicate_value, query_id, score FROM s JOIN predicates USING (query_id) WHERE config_id = 2 AND name = 'lang'")
on_cube("samples_per_group", lambda c: inventory.samples_per_group(c.query.select("query_id", "dataset", "split", "doc_id"), ["dataset", "split"], 2, "doc_id").select("group_key", "place", "query_id"),
        "SELECT concat('dataset=', dataset, '__split=', coalesce(nullif(split, ''), 'unknown')) AS group_key, row_number() OVER (PARTITION BY dataset, coalesce(split, '') ORDER BY doc_id)::INT AS place, query_id FROM queries QUALIFY place <= 2")
on_cube("feature_predicate_table", lambda c: feature_predicate_table(c, M, SC, base=1, task="table_qa", metric="did", min_effect=0.01, include_unmatched=True, predicates=("lang", "is_long")).select("canonical_id", "predicate_name", "predicate_value", "lift", "did"),
        f"""{_DID}, y AS (SELECT canonical_id, predicate_name, predicate_value, round(lift, 6) AS lift, round(did, 6) AS did FROM dd JOIN features USING (canonical_id) WHERE task = 'table_qa' AND predicate_name IN ('lang', 'is_long') AND abs(did) >= 0.01)
        SELECT * FROM y UNION ALL SELECT canonical_id, NULL, NULL, NULL, NULL FROM features WHERE task = 'table_qa' AND canonical_id NOT IN (SELECT canonical_id FROM y)""")

on_tables("knn_all", lambda t: retrieval.knn_blocks(t("embeddings").withColumn("text", F.col("embedding")), t("embeddings"), block=128, text="text").select("probe", "neighbour", "rank"),
          """WITH d AS (SELECT min(vec_id) AS vec_id, embedding FROM embeddings GROUP BY embedding), s AS (SELECT p.vec_id AS probe, v.vec_id AS neighbour, round(list_sum(list_transform(range(1, len(p.embedding) + 1), lambda i: p.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)), 6) AS score FROM embeddings p, d v WHERE p.vec_id <> v.vec_id),
          r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, neighbour) AS rank FROM s) SELECT probe, neighbour, rank::INT AS rank FROM r WHERE rank <= 3""")  # fmt: skip


def _streamed_scores(c: Cube) -> DataFrame:
    """Executions arrive in two deliveries that overlap, and each is scored by a run of its own."""
    rows = c.execution.where("model = 'alpha'").select("execution_id", "config_id", "query_id", "model", "prediction", "error", "created_at")
    gold = scratch.written(c.query.select("query_id", (F.col("doc_id") % 10).cast("string").alias("gold")))
    arrived, out, checkpoint = (scratch.fresh_path(c.spark, n) for n in ("arrived", "scores", "scoring"))
    for delivery in (F.col("config_id") <= 4, F.col("config_id") >= 3):
        rows.where(delivery).write.mode("append").parquet(arrived)
        scoring.run_available(scoring.scored(scoring.execution_stream(c.spark, arrived), gold, G.exact_match, "em", "3650 days"), out, checkpoint)
    return c.spark.read.parquet(out).select("execution_id", "scorer", "score")


on_cube("streamed_scores", _streamed_scores, "SELECT execution_id, 'em' AS scorer, CASE WHEN coalesce(error, '') <> '' THEN 0.0 ELSE (prediction = (doc_id % 10)::VARCHAR)::INT END::DOUBLE AS score FROM executions WHERE model = 'alpha'")

# -- monitoring ---------------------------------------------------------------
_QUERIES["monitor_overall"] = lambda spark, sf: rounded(monitor.overall(monitor.events(spark, sf)).select("n", "avg_score", at("first_at"), at("last_at")))
_SQL["monitor_overall"] = "SELECT count(*) AS n, round(avg(value), 6) AS avg_score, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events"
on_cube("monitor_by_config", lambda c: inventory.progress_by_config(c, SC, 1000), f"SELECT config_id, model, count(*) AS done, round(100.0 * count(*) / 1000, 6) AS pct, count(*) FILTER (coalesce(error, '') <> '') AS errors, round(avg(score), 6) AS avg_score FROM executions e LEFT JOIN evaluations v ON v.execution_id = e.execution_id AND scorer = '{SC}' GROUP BY ALL")
_DAILY = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS config, count(*) AS n, round(avg(value), 6) AS avg_score FROM events GROUP BY ALL"
_QUERIES["monitor_daily"] = lambda spark, sf: rounded(monitor.daily(monitor.events(spark, sf)))
_SQL["monitor_daily"] = _DAILY
_QUERIES["stream_daily"] = lambda spark, sf: rounded(monitor.run_to_end(monitor.daily(monitor.events(spark, sf, stream=True)), f"daily_{abs(hash(sf)) % 10**9}"))
_SQL["stream_daily"] = _DAILY
_QUERIES["stream_by_config"] = lambda spark, sf: rounded(monitor.run_to_end(monitor.by_config(monitor.events(spark, sf, stream=True)), f"configs_{abs(hash(sf)) % 10**9}"))
_SQL["stream_by_config"] = "SELECT event_type AS config, count(*) AS n, round(avg(value), 6) AS avg_score FROM events GROUP BY 1"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
