"""Null ids and texts, empty texts, repeated rows, empty tables and extra columns, for every operator."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from cubeloom.llm import decontaminate, huffman, jaccard, lines, packing, pii, quality, substrings, tokens, toxicity
from cubeloom.llm.common import materialize
from cubeloom.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, length int, key string"
LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, LONG, "en", "s", 1, 0.5, 3, "k"),
    (1, LONG, "en", "s", 1, 0.5, 3, "k"),
    (2, None, None, None, None, None, None, None),
    (None, "a lone text", None, "s", 2, 0.1, 1, None),
    (3, "", "en", None, 0, None, None, None),
    (4, " \t\n\x0b ", "en", "s", 5, None, None, None),
    (5, LONG.upper() + " tail", "de", "s", 6, None, None, None),
    (6, "x " * 20000, "de", "s", 6, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_token_counts(docs, none):
    path = tokenizer_path("piece_bpe_32k.model")
    got = by_id(tokens.token_counts(docs, path))
    assert got[2][0].n_tokens == 0 == got[3][0].n_tokens and len(got[1]) == 2 and got[6][0].n_tokens >= 20000
    assert tokens.token_counts(none, path).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (6, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, keep=tuple(docs.columns)).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sorted(map(str, (r.row.score for r in got))) == sorted(str(r[5]) for r in ROWS), "another column named score is left as it is"
    assert sum(r.row.doc_id == 1 for r in got) == 2 and all(r.row.text is None for r in got if r.row.doc_id == 2)
    empty = toxicity.fit(none, labels.limit(0))
    assert toxicity.score(none, empty).count() == 0


def test_quality(docs, none):
    got = by_id(quality.judge(docs))
    assert got[2][0].n_words == 0 and got[2][0].base_failed and not got[2][0].kept
    assert got[6][0].n_repeat_words == 20000 and not got[6][0].kept
    assert got[1][0].n_words == 60 and not got[1][0].base_failed
    assert quality.judge(none).count() == 0


def test_packing(docs, none):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path, capacity=64).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.length for r in rows if r.doc_id == 2) == 1
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64
    assert packing.pack_documents(none, path).count() == 0


def test_pii(docs, none):
    got = by_id(pii.pseudonymize(docs, b"key"))
    assert got[2][0].text is None and got[3][0].text == "" and len(got[1]) == 2
    assert pii.pseudonymize(none, b"key").count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10, 30))), (2, None), (3, ""), (None, "a lone text"), (1, " ".join(f"w{i}" for i in range(10, 30)))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == {(1, 1), (5, 1), (None, None)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    assert decontaminate.contained_items(none, items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(ROWS)


def test_decontamination_reads_any_names_and_long_texts(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, long), (2, long[: len(long) // 2]), (3, None), (4, "one two three four five six seven eight")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "`a.b` long, `the text` string, item_id string, _hash int")
    items = spark.createDataFrame([(1, "v29990 v29991 v29992 v29993 v29994 v29995", 5), (2, "two THREE four five six", 5), (3, "one two three four five nine ten eleven twelve thirteen", 5)], "`i.d` long, text string, _doc int")
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contained_items(docs, items, id_column="a.b", text_column="the text", item_id="i.d").collect()}
    assert got == {(1, 1, 2, 2), (4, 2, 1, 1)}


def test_substrings(docs, none):
    got = by_id(substrings.remove_repeats(docs))
    assert [r.n_removed for r in got[1]] == [60, 60] and got[1][0].kept == ""
    assert got[5][0].n_removed == 0 and got[5][0].kept == LONG.upper() + " tail"
    assert got[2][0].n_words == 0 and got[2][0].kept == "" and got[6][0].n_removed == 20000
    assert substrings.remove_repeats(none).count() == 0


def test_jaccard(docs, none):
    got = by_id(jaccard.near_duplicates(docs))
    assert [r.component_id for r in got[1]] == [1, 1] and got[5][0].component_id == 1
    assert got[2][0].n_shingles == 0 and got[2][0].component_id == 2 and got[6][0].n_shingles == 1
    assert got[None][0].n_shingles == 1 and got[None][0].component_id is None
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6]
    assert jaccard.near_duplicates(none).count() == 0


def line_rows(df):
    """The documents of a line dedup by id, with n_lines and n_removed."""
    out = {}
    for r in df.select("row.*", "n_lines", "n_removed").collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_lines(docs, none, spark):
    rows = [(i, f"own {chr(97 + i)} line here and more of it\nCopyright notice number {i} of all\nend {chr(97 + i)}{chr(98 + i)} of this text") for i in range(12)]
    own = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.lit(1)).withColumn("__places", F.lit(0))
    got = line_rows(lines.drop_recurring_lines(own))
    assert all(("Copyright" in got[i][0].text) == (i == 0) and got[i][0].n_removed == (i > 0) and got[i][0].n_lines == 3 for i, _ in rows), "the first keeps the notice"
    for copies in (False, True):
        got = line_rows(lines.drop_recurring_lines(docs, copies=copies))
        assert got[2][0].text is None and got[2][0].n_lines == 0 and got[1][0].text == LONG and len(got[1]) == 2
        assert lines.drop_recurring_lines(none, copies=copies).count() == 0


@pytest.mark.parametrize("copies", [False, True])
def test_a_template_of_one_document_stays(spark, copies):
    alone = [(1, "\n".join(f"the value of this field is given as name{chr(97 + i)}" for i in range(12)) + "\nmy own end"), (2, "some other words that nobody else has")]
    got = line_rows(lines.drop_recurring_lines(spark.createDataFrame(alone, "doc_id bigint, text string"), copies=copies))
    assert all(r[0].n_removed == 0 for r in got.values())


def test_binary_output(spark, docs, none, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    huffman.write_store(docs, f"file://{tmp_path}/s", path)
    rows = sorted(huffman.read_store(spark, f"file://{tmp_path}/s", with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6]
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert rows[3].n_tokens == 1
    huffman.write_store(none, f"file://{tmp_path}/e", path)
    assert huffman.read_store(spark, f"file://{tmp_path}/e").count() == 0


def test_boilerplate_goes_whatever_share_it_holds(spark):
    notice = "All of this notice may be kept by whoever reads it and wants to\nas long as nobody takes away the name of its first author here"
    rows = [(i, notice + "\n" + " ".join(f"own{chr(97 + i)}{chr(97 + j)}" for j in range(9))) for i in range(12)]
    copies = [(100 + i, " ".join(f"w{chr(97 + j)}{chr(97 + k)}" for j in range(9) for k in range(9)) + "\nshared line of copies and of nothing else\n" + "v" * (i + 1)) for i in range(12)]
    got = {i: r[0] for i, r in line_rows(lines.drop_recurring_lines(spark.createDataFrame(rows + copies, "doc_id bigint, text string"), copies=True)).items()}
    assert all(got[i].n_removed == 2 and got[i].text == t.split("\n")[2] for i, t in rows)
    assert all(got[i].n_removed == 0 and got[i].text == t for i, t in copies), "near copies of one text are one document"


def test_a_leaf_has_several_templates(spark):
    name = lambda i: f"name{chr(97 + i)}"
    own = lambda i: f"\nown{chr(97 + i)} end{chr(98 + i)}"
    first = [(i, "we are very glad that this page was read by you" + own(i)) for i in range(14)]
    second = [(50 + i, f"we are very sorry but {name(i)} has left for some days" + own(i)) for i in range(12)]
    alone = [(99, "we are very far from any of the other sentences here\nend")]
    got = {i: r[0] for i, r in line_rows(lines.drop_recurring_lines(spark.createDataFrame(first + second + alone, "doc_id bigint, text string"), copies=True)).items()}
    assert all(got[i].n_removed == 1 for i, _ in first + second)
    assert got[99].n_removed == 0


def test_long_lines_recur_in_few_documents(spark):
    passage = " ".join(f"said{chr(97 + j)}" for j in range(25))
    middle, short = "all rights are reserved here", "thank you"
    own = lambda i: " ".join(f"own{chr(97 + i)}{chr(97 + j)}" for j in range(30))
    rows = [(i, "\n".join([passage] * (i < 2) + [middle] * (i < 3) + [short] + [own(i)])) for i in range(9)]
    rows += [(20 + i, " ".join(f"copy{chr(97 + j)}" for j in range(60)) + "\nend" * i) for i in range(2)]
    got = {i: r[0] for i, r in line_rows(lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), copies=True)).items()}
    assert all(got[i].text.endswith("\n".join([short, own(i)])) for i in range(9))
    assert [sum(line in r.text.split("\n") for r in got.values()) for line in (passage, middle, short)] == [1, 1, 9], "one of its texts keeps it"
    assert all(got[i].n_removed == 0 for i in (20, 21)), "near copies keep their lines"


def test_lines_are_masked_and_split_once(spark, capsys):
    odd = {"a  b": "a b", "\ta b1 \r": "a <*>", " x1y  2 z ": "<*> <*> z", "plain line": "plain line", " \t\x0b\x0c\r": None, "": None, "7": "<*>", "a\x0bb": "a b", "ends ": "ends", " ": " "}
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(odd)], "doc_id bigint, text string")
    keyed = lines.keyed_lines(docs, "doc_id", "text", False)
    assert {r._id: (r._m, r._n) for r in keyed.collect()} == {i: (m, len(m.split(" "))) for i, m in enumerate(odd.values()) if m is not None}
    capsys.readouterr()
    keyed.explain()
    plan = capsys.readouterr().out
    assert plan.count("regexp_replace(") == 2, "the filter does not mask every line once more"
    lines.drop_recurring_lines(docs).select("row.text", "n_lines").explain()
    assert capsys.readouterr().out.count("split(") == 1, "no split within the lambda over the lines"


def rounds_by_hand(rows):
    """Templates of (leaf, h, docs, lo, hi, words) by the rounds of lines.templates."""
    part_of, alive, found = {}, {}, {}
    for leaf, h, docs, lo, hi, w in rows:
        n, differ = len(w), len(w) - math.ceil(lines.SIMILARITY * len(w) - 1e-9)
        width = max((n - lines.DEPTH) // (differ + 1), 1)
        cut = [(leaf,)] if n - lines.DEPTH <= differ else [(leaf, i, *w[lines.DEPTH + i * width : n if i == differ else lines.DEPTH + (i + 1) * width]) for i in range(differ + 1)]
        part_of[leaf, h], alive[leaf, h] = set(cut), ((docs, h), lo, hi, w)
    while True:
        parts = collections.defaultdict(list)
        for x in alive:
            for p in part_of[x]:
                parts[p].append(x)
        parts = {p: xs for p, xs in parts.items() if len(xs) > 1 and min(alive[x][1] for x in xs) < max(alive[x][2] for x in xs)}
        if not parts:
            return found
        leads = collections.defaultdict(set)
        for xs in parts.values():
            for x in xs:
                leads[x].add(max(xs, key=lambda y: alive[y][0]))
        heads = {x for x in leads if leads[x] == {x}}
        fits = lambda x, y: sum(a == b for a, b in zip(alive[x][3], alive[y][3])) >= lines.SIMILARITY * len(alive[x][3]) - 1e-9
        done = {x: x[1] for x in heads}
        for x in set(leads) - heads:
            if near := [y for y in leads[x] & heads if fits(x, y)]:
                done[x] = max(near, key=lambda y: alive[y][0])[1]
        found |= done
        alive = {x: alive[x] for x in leads if x not in done}


def test_templates_of_leaves_and_of_joins_are_those_of_the_rounds(spark):
    rng = random.Random(3)
    texts = [(i, "\n".join("one two six " + " ".join(rng.choices("abcd", [8, 3, 1, 1], k=n)) for n in rng.choices([2, 5, 9], k=5))) for i in range(30)]
    keyed = lines.keyed_lines(spark.createDataFrame(texts, "doc_id bigint, text string"), "doc_id", "text", False).cache()
    variants = keyed.groupBy("_leaf", "_h", "_n").agg(F.countDistinct("_u").alias("docs"), F.min("_u").alias("_lo"), F.max("_u").alias("_hi")).cache()
    held = variants.join(keyed.select("_leaf", "_h", "_m").distinct(), ["_leaf", "_h"])
    want = rounds_by_hand([(r._leaf, r._h, r.docs, r._lo, r._hi, r._m.split(" ")) for r in held.collect()])
    assert len(want) > 50 and len(set(want.values())) > 12
    for most in (0, 12, 1000):
        got = lines.templates(keyed, variants, leaf_lines=most).collect()
        assert {(r._leaf, r._h): r._template for r in got} == want and len(got) == len(want), most


def test_more_templates_in_a_leaf_are_no_more_tables(spark, monkeypatch):
    written = []
    monkeypatch.setattr(lines, "materialize", lambda df: written.append(1) or materialize(df))
    tables = []
    for k in (2, 14):
        # all share a segment, none agree: each round finds one template
        texts = [(i, "one two six same " + " ".join(f"{chr(97 + i)}{chr(97 + j)}" for j in range(9))) for i in range(k)]
        written.clear()
        assert line_rows(lines.drop_recurring_lines(spark.createDataFrame(texts, "doc_id bigint, text string"))).keys() == set(range(k))
        tables.append(len(written))
    assert tables[0] == tables[1]


def test_texts_are_sketched_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(lines, "materialize", lambda df: plans.append(df) or materialize(df))
    texts = spark.createDataFrame([(i, " ".join(f"v{j}" for j in range(40)) + " end" * (i % 2)) for i in range(4)] + [(9, None), (10, "")], "doc_id bigint, text string")
    assert lines.copy_classes(texts, texts.select(F.xxhash64("text").alias("_u")).distinct()).count() == 2
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 1, "no filter sketches the texts before the join"
