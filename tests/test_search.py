"""The stored index against a plain count, and the stems."""

import math
import random
import re

import pytest

from cubeloom.functions.stems import stem
from cubeloom.operators import retrieval, search

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return {i: " ".join(rng.choices(WORDS, weights=range(1, 41), k=rng.randint(1, 30))) + ("; RARE!" if i % 97 == 0 else "") for i in range(600)} | {600: None, 601: "", 602: "- ?"}


def by_hand(texts, query, k):
    docs = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in texts.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    scores = dict.fromkeys(docs, 0.0)
    for term in set(re.findall("[a-z0-9]+", query.lower())):
        df = sum(term in d for d in docs.values())
        for i, d in docs.items():
            if tf := d.count(term):
                scores[i] += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len(d) / mean))
    return sorted(((round(s, 6), i) for i, s in scores.items() if s), key=lambda x: (-x[0], x[1]))[:k]


def test_index_gives_the_scores_of_a_scan_and_skips_blocks(spark, texts, tmp_path):
    corpus = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index = search.build(corpus, f"file://{tmp_path}/index", block=16, folders=4)
    asked = {1: "rare w3", 2: "w39 w38 w0", 3: "nothing known", 4: "w7"}
    queries = spark.createDataFrame([*asked.items(), (5, None)], "query_id long, text string")
    got = {}
    for r in index.search(queries, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.doc_id))
    for q, text in asked.items():
        want = by_hand(texts, text, 5)
        assert [(s, i) for _, s, i in sorted(got.get(q, []))] == want
    reach = {r.query_id: r for r in index.reach(queries, k=5).collect()}
    assert reach[1].n_reached < reach[1].n_blocks / 2, "blocks without the rare word are not read"


def test_english_counts_stems_without_stop_words(spark):
    corpus = spark.createDataFrame([(1, "The cats are hoping"), (2, "a cat hopes; CATS!"), (3, "the")], "doc_id long, text string")
    got = {(r.doc_id, r.term): (r.tf, r.length) for r in search.term_counts(corpus, english=True).collect()}
    assert got == {(1, "cat"): (1, 2), (1, "hope"): (1, 2), (2, "cat"): (2, 3), (2, "hope"): (1, 3)}


@pytest.mark.parametrize("word,want", [
    ("consistency", "consist"), ("consolation", "consol"), ("knightly", "knight"), ("generously", "generous"), ("skies", "sky"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("happy", "happi"),
    ("agreed", "agre"), ("by", "by"), ("sensibility", "sensibl"), ("communism", "communism"), ("replacement", "replac"), ("youth", "youth"), ("controlling", "control"),
])
def test_stems(word, want):
    assert stem(word) == want


def test_a_scan_hands_on_the_best_of_each_task(spark, texts, tmp_path):
    corpus = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = {1: "rare w3", 2: "w39 w38 w0", 3: "nothing known", 4: "w7"}
    spark.createDataFrame([*asked.items(), (5, None)], "query_id long, text string").write.parquet(f"file://{tmp_path}/queries")
    found = retrieval.bm25(corpus, spark.read.parquet(f"file://{tmp_path}/queries"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.doc_id))
    for q, text in asked.items():
        assert [(s, i) for _, s, i in sorted(got.get(q, []))] == by_hand(texts, text, 5)
    assert "hashpartitioning(query_id" in plan and "hashpartitioning(query_id#" not in plan.split("MapInArrow", 1)[1], "scores of all documents are not shuffled by query"


def test_postings_are_packed_where_a_block_is_read(spark, tmp_path):
    texts = [(i, f"common w{i % 5} w{i % 5} only{i}") for i in range(40)] + [(40, None), (41, " .. ")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/corpus")
    index = search.build(spark.read.parquet(f"file://{tmp_path}/corpus"), f"file://{tmp_path}/index", block=10, folders=2)
    rows = index.table("postings").where("term = 'common' OR term = 'w3'").orderBy("term", "block").collect()
    assert [(r.term, r.n, len(r.docs)) for r in rows] == [("common", 10, 10)] * 4 + [("w3", 2, 2)] * 4, "one row for each term and block"
    assert all(list(r.tf) == [2, 2] and list(r.length) == [4, 4] for r in rows[4:])
    assert index.table("totals").first().asDict() == {"n_docs": 42, "avg_length": 160 / 42}
    found = index.search(spark.createDataFrame([(1, "w3 only8"), (2, "common")], "query_id long, text string"), k=3)
    assert [(r.query_id, r.doc_id) for r in found.orderBy("query_id", "rank").collect()] == [(1, 8), (1, 3), (1, 13), (2, 0), (2, 1), (2, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(docs" not in plan and "FlatMapCoGroupsInArrow" in plan, "no (query, document, term) is a row"


def test_words_are_counted_as_they_are_split(spark):
    import pyarrow as pa

    texts = ["a b", "", None, "c", "-", " d;e ", "É9x", "Ab"]
    for part in (pa.array(texts), pa.array(texts).slice(3, 4), pa.array(["", None])):
        assert search._words(part) == len(search._coded(part)[0])
