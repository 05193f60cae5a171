"""Every stage of the corpus pipeline: what it drops, what it leaves alone, and tables with awkward columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
AWKWARD = ["score", "predicted", "passages", "row", "text_", "_doc", "_t", "h", "id", "n_removed", "__n_removed", "__cubeloom_h", "a.b", "a`b"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, and the planted texts by kind."""
    rng = random.Random(5)
    curse = ["vilegrub", "rotfiend", "scumlord"]
    texts, toxic = {}, {}
    for i in range(120):
        texts[i] = words(rng, 60)
        toxic[i] = i % 3 == 0
        if toxic[i]:
            texts[i] += " " + " ".join(rng.choice(curse) for _ in range(12))
    passage, item = words(rng, 40), words(rng, 30)
    for i in (200, 201):
        texts[i] = words(rng, 60) + "\n" + passage + "\n" + words(rng, 60)
    texts[300] = texts[1]
    texts[301] = texts[2] + " tail"
    texts[400] = words(rng, 80) + " " + item.upper() + " " + words(rng, 80)
    texts[500], texts[501] = None, ""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(t)) for i, t in toxic.items()], "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, toxic, passage


def after(spark, corpus, stage, docs):
    return {r.doc_id: r for r in STAGES[stage](spark, docs, corpus[0]).collect()}


def documents(spark, corpus):
    return spark.read.parquet(f"{corpus[0]}/documents.parquet")


def test_toxic_documents_go(spark, corpus):
    kept = after(spark, corpus, "toxicity", documents(spark, corpus))
    assert set(kept) == {i for i in corpus[1] if not corpus[2].get(i, False)}


def test_recurring_passages_go_and_the_first_stays(spark, corpus):
    kept = after(spark, corpus, "line dedup", documents(spark, corpus))
    assert set(kept) == set(corpus[1])
    assert [corpus[3] in kept[i].text for i in (200, 201)].count(True) == 1
    assert all(kept[i].text == t for i, t in corpus[1].items() if i not in (200, 201))
    assert all(r.text is None or r.n_chars == len(r.text) for r in kept.values())


def test_one_of_each_near_duplicate_stays(spark, corpus):
    kept = after(spark, corpus, "n-gram Jaccard join", documents(spark, corpus))
    assert set(kept) == set(corpus[1]) - {300, 301}


def test_contaminated_documents_go(spark, corpus):
    kept = after(spark, corpus, "benchmark decontamination", documents(spark, corpus))
    assert set(kept) == set(corpus[1]) - {400}


def test_packed_ids_are_those_of_the_library(spark, corpus):
    import struct
    import zlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.tokenizer_path("byte_bpe_50k.json"))
    rows = STAGES["best-fit packing"](spark, documents(spark, corpus), corpus[0]).collect()
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in corpus[1].items()}
    got = {(r.doc_id, r.start): r for r in rows}
    for i, ids in want.items():
        at = 0
        while at < len(ids):
            r = got.pop((i, at))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
    assert not got


def test_all_stages_follow_each_other(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus[0]).collect()
    clean = {i for i in corpus[1] if not corpus[2].get(i, False)} - {300, 301, 400}
    assert {r.doc_id for r in rows} == clean


@pytest.mark.parametrize("stage", list(STAGES))
def test_any_column_name_and_an_empty_table(spark, corpus, stage):
    docs = documents(spark, corpus)
    wide = docs.select("*", *(F.lit(k).alias(name) for k, name in enumerate(AWKWARD)))
    out = STAGES[stage](spark, wide, corpus[0])
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(r[name] == k for r in rows for k, name in enumerate(AWKWARD))
    else:
        assert out.count() > 0
    assert STAGES[stage](spark, wide.limit(0), corpus[0]).count() == 0
