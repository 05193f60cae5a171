"""The methods against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubeloom.llm import huffman, ids, jaccard, packing, pii, quality, substrings, tokens, toxicity
from cubeloom.llm.queries import tokenizer_path

TEXTS = [
    "", " ", "  a  b", "a   b\n\n  c ", "x <|endoftext|> y", "don't 'S it's we'LL", "日本 語テ\t\tキスト 🎉🎉", "a\x1c b \x85 c", "é ́x ǅ İ ſ", "  x    y", "a\n b \n c", "tab\t x", "▁x y", "<0x0A>\n", "one two, three. four!!",
]


def test_viterbi_counts_equal_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokens.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    n, _ = tokens.UnigramCounter(pieces).count(pa.array(TEXTS))
    assert n.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in TEXTS]


@pytest.mark.parametrize("name,by_word", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_equal_the_library(name, by_word):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(name))
    found, starts = ids.Encoder(tokenizer_path(name), by_word).encode(pa.array(TEXTS))
    assert [found[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_packing_plan_places_everything_once(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins, seen = {}, {n: set() for n in counts}
    for n, lo, hi, base, offset in packing.plan(counts, 64):
        for k in range(lo, hi):
            assert k not in seen[n]
            seen[n].add(k)
            bins.setdefault(base + k - lo, []).append((offset, n))
    assert all(seen[n] == set(range(c)) for n, c in counts.items())
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    least = -(-sum(lengths) // 64)
    assert len(bins) <= max(least, int(1.5 * least) + 1, sum(1 for n in lengths if 2 * n > 64))


def test_maximal_segments_are_those_of_the_definition():
    rng = random.Random(0)
    model = toxicity.Model(weight=np.zeros(1), certainty=np.zeros(1))
    for _ in range(200):
        w = np.array([rng.choice([-3.0, -2.0, -1.0, 1.0, 2.0, 3.0]) for _ in range(rng.randint(0, 14))])

        def recurse(a, b):
            best = max(((w[i:j].sum(), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,), key=lambda x: (x[0], x[1], -x[2]) if len(x) > 1 else (0,))
            if len(best) == 1 or best[0] <= 0:
                return []
            return [*recurse(a, best[2]), (best[2], best[3], best[0]), *recurse(best[3], b)]

        got = model.segments(w)
        assert [round(s, 9) for *_, s in got] == [round(s, 9) for *_, s in recurse(0, len(w))]


def test_huffman_round_trip_and_limit():
    rng = np.random.default_rng(0)
    symbols = (rng.zipf(1.3, 20000) % 3000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(symbols))
    assert abs((2.0 ** -lengths[lengths > 0]).sum() - 1) < 1e-12 and lengths.max() <= huffman.LONGEST
    decoder = huffman.Decoder(lengths)
    for n in (0, 1, 127, 128, 129, 20000):
        data, checkpoints = huffman.encode_bits(symbols[:n], lengths, huffman.canonical(lengths))
        assert (decoder.decode(data, checkpoints, n) == symbols[:n]).all()
    assert huffman.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32]), 3).max() == 3
    assert huffman.code_lengths(np.array([0, 5])).tolist() == [0, 1]


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 100, 1000):
        assert sorted(pii.permute(i, size, b"k", "t") for i in range(size)) == list(range(size))


def test_pseudonyms_keep_format_and_link():
    text = "Call +1 (974) 555-3436 or write Ann.b7@mail.example.com, card 4929348385146306, ip 144.137.247.239, born 1987-02-28, IBAN DE89 3704 0044 0532 0130 00, id 219-09-9999."
    new = lambda t, key=b"k": pii.pseudonymize_text(t, lambda kind, value: pii.pseudonym(kind, value, key))
    out, spans = new(text)
    assert sorted(k for *_, k in spans) == ["card", "date", "email", "iban", "ip", "phone", "ssn"]
    for a, b, kind in spans:
        assert text[a:b] not in out
    assert len(new(out)[1]) == len(spans), "pseudonyms are valid again"
    assert new(text)[0] == out and new(text, b"other")[0] != out
    assert new("4929 3483 8514 6306")[0].replace(" ", "") in out
    for clean in ("4929348385146307", "1.2.3", "version 3.0", "300.1.1.1", "2021-13-40", "n = 1234567"):
        assert new(clean) == (clean, [])


def test_super_kmers_cover_every_window_once():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 4, n).astype(np.uint64) for n in (0, 34, 35, 36, 200, 500)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = np.concatenate(texts)
    first, n, lead = substrings.super_kmers(words, starts, np.zeros(0, np.uint64))
    windows = [i for a, k in zip(first, n) for i in range(a, a + k)]
    assert windows == [s + i for s, e in zip(starts[:-1], starts[1:]) for i in range(max(0, e - s - 34))]
    found = {}
    for a, k, m in zip(first, n, lead):
        for i in range(a, a + k):
            assert found.setdefault(words[i : i + 35].tobytes(), m) == m, "equal windows have one minimiser"


def brute(texts, n=35):
    where = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append((d, i))
    hit = [set() for _ in texts]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                hit[d].update(range(i, i + n))
    return [" ".join(w for i, w in enumerate(t.split()) if i not in hit[d]) for d, t in enumerate(texts)]


@pytest.mark.parametrize("held", [substrings.HELD_BYTES, 3000])
def test_repeats_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(substrings, "HELD_BYTES", held)
    rng = random.Random(2)
    passage = [rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(60)]
    texts = []
    for i in range(30):
        own = [f"u{i}x{j}" for j in range(rng.randint(0, 40))]
        texts.append(" ".join(own + passage[rng.randint(0, 10) : rng.randint(30, 60)] + [f"v{i}"] + own[:5] + ["same"] * (i * 5)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.kept for r in substrings.remove_repeats(docs).collect()}
    assert [got[i] for i in range(30)] == brute(texts)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    origin, texts = [f"w{i}" for i in range(80)], []
    for i in range(60):
        t = list(origin if i % 3 else origin[:50])
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            t[rng.randrange(len(t))] = f"m{rng.randint(0, 400)}"
        texts.append(" ".join(t[: rng.randint(60, 80)]))
    texts += ["", "a b", "A  b", "a b c d e"]
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [(len(s), r) for s, r in zip(sets, root)]


def test_em_finds_the_junk_class():
    n = len(quality.RULES)
    clean, junk = (1,) * n, (-1, -1, -1) + (1,) * (n - 3)  # two rules at least see a defect
    odds, ratio = quality.fit([(clean, 900), (junk, 100)])
    posterior = lambda v: odds + sum(ratio[r][v[r]] for r in range(n))
    assert posterior(clean) > 0 > posterior(junk)
    assert quality.fit([])[0] == 0.0


def test_values_followed_by_a_short_group_are_found():
    new = lambda t: pii.pseudonymize_text(t, lambda kind, value: pii.pseudonym(kind, value, b"k"))
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    for text, value in [
        (f"{card} 123", card), ("4111-1111-1111-1111 12/27", "4111-1111-1111-1111"), (f"2024 {card}.", card), (f"{card} {card[:4]} 5", card), ("3782 822463 10005", "3782 822463 10005"),
        (f"{iban} EUR", iban), (f"{iban} PAID BY", iban), (iban.replace(" ", "") + " EUR", iban.replace(" ", "")),
    ]:
        out, spans = new(text)
        at = text.index(value)
        assert [(a, b) for a, b, _ in spans] == [(at, at + len(value))], text
        assert out[:at] == text[:at] and out[at + len(value) :] == text[at + len(value) :] and out != text
    assert new("4111 1111 1111 1112 123") == ("4111 1111 1111 1112 123", [])


def test_windows_are_hashed_in_few_steps_and_compared_where_hashes_meet(monkeypatch):
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(40)]
    texts = [[f"w{x}" for x in rng.integers(0, 50, 60)] + (passage if i % 3 == 0 else []) for i in range(12)]
    strings, weights = [" ".join([*t, ""]).encode() for t in texts], np.ones(12, np.int64)
    want = [(i, 60 + j) for i in range(0, 12, 3) for j in range(40 - substrings.WINDOW + 1)]
    mixed = []
    real = substrings.mix
    monkeypatch.setattr(substrings, "mix", lambda x: mixed.append(len(x)) or real(x))
    found = substrings.repeated_windows(strings, weights)
    assert list(zip(*(x.tolist() for x in found))) == want
    assert 0 < sum(mixed) < 9 * sum(map(len, texts)), "a window is put together from runs that double"
    # windows of one hash are told apart by their words
    monkeypatch.setattr(substrings, "_window_keys", lambda codes: np.zeros(len(codes) - substrings.WINDOW + 1, np.uint64))
    assert list(zip(*(x.tolist() for x in substrings.repeated_windows(strings, weights)))) == want


def test_window_shuffle_is_freed_before_the_texts_travel(spark, monkeypatch):
    monkeypatch.setattr(substrings, "frequent_grams", lambda docs: np.zeros(0, np.uint64))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short")], "doc_id bigint, text string")

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.length()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    kept = substrings.remove_repeats(docs)
    assert not files() - before and spark.conf.get(key) == was
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in kept.collect()} == {1: (60, 60, ""), 2: (61, 60, "end"), 3: (1, 0, "short")}
