"""Weak supervision: counts against plain Python, and what EM may and may not decide."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubeloom.llm import quality

N = len(quality.RULES)
CLEAN = (1,) * N


def votes(**bad):
    return tuple(bad.get(name, 1) for name in quality.RULES)


def logit(fitted, v):
    odds, ratio = fitted
    return odds + sum(r[x] for r, x in zip(ratio, v))


PATTERNS = st.lists(st.tuples(st.tuples(*[st.sampled_from((-1, 0, 1))] * N), st.integers(1, 10**6)), min_size=1, max_size=25)


@settings(max_examples=80, deadline=None)
@given(PATTERNS)
def test_a_text_without_a_bad_vote_is_never_bad(patterns):
    fitted = quality.fit(patterns)
    assert logit(fitted, CLEAN) >= 0 and all(logit(fitted, v) >= 0 for v, _ in patterns if min(v) >= 0)


@settings(max_examples=40, deadline=None)
@given(PATTERNS)
def test_verdicts_do_not_change_with_the_size(patterns):
    small, large = quality.fit(patterns), quality.fit([(v, 1000 * n) for v, n in patterns])
    for v, _ in patterns:
        assert abs(logit(small, v) - logit(large, v)) < 1e-6


@settings(max_examples=40, deadline=None)
@given(PATTERNS)
def test_the_objective_only_rises(patterns):
    history = []
    quality.fit(patterns, rounds=60, history=history)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))


def test_rare_lone_votes_of_many_rules_drop_nothing_else():
    patterns = [(CLEAN, 900), *((votes(**{r: -1}), 50) for r in ("symbols", "lines"))]
    assert logit(quality.fit(patterns), CLEAN) > 2
    assert quality.fit([])[0] == 0.0


def test_a_noisy_rule_is_overruled_and_junk_is_not():
    junk = votes(symbols=-1, symbol_words=-1, letters=-1)
    noisy = votes(lines=-1)
    fitted = quality.fit([(CLEAN, 8000), (junk, 700), (noisy, 900), (votes(windows=-1, variety=-1, lines=-1), 300)])
    assert logit(fitted, junk) < -5 and logit(fitted, noisy) > 1 and logit(fitted, CLEAN) > 3
    assert logit(fitted, votes(windows=-1, variety=-1, lines=-1)) < -3


WORDS = [a + b + c for a in ("har", "win", "sil", "qui", "let", "gar", "nor", "pa") for b in ("bo", "te", "ve", "ri", "mo", "la") for c in ("ur", "nd", "st", "th", "ck", "per", "len")]


def clean(rng, n=80):
    return " ".join(rng.choice(WORDS) + str(i % 9 if i % 17 == 0 else "") for i in range(n)) + "."


def counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n_symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), n_symbols, len(lines) - len(set(lines)), len(repeated)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(7)
    rows = [(i, clean(rng)) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(WORDS) + rng.choice(["###", "$$$", "&&&"]) for _ in range(80))) for i in range(25)]
    rows += [(2000 + i, "\n".join([*(clean(rng, 12) for _ in range(8)), *(["Seen here"] * 5)])) for i in range(20)]
    rows += [(3000, None), (3001, ""), (3002, "short text"), (3003, "\n \n"), (3004, "the same three " * 60), (3005, "日本 語 テ " * 30 + "\x1c x\x85y"), (3005, "日本 語 テ " * 30 + "\x1c x\x85y")]
    return rows, {i: [] for i, _ in rows}, spark.createDataFrame([(i, t, 9, "clash") for i, t in rows], "`a.b` long, text string, n_words int, posterior string")


def test_counts_and_verdicts(planted):
    rows, got, df = planted
    for r in quality.judge(df, id_column="a.b").collect():
        got[r["a.b"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, text in rows:
        for r in got[i]:
            n, chars, symbols, dup, repeated = counts(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
            assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and not (r.kept and r.base_failed)
    kept = {i for i, rs in got.items() if rs[0].kept}
    assert {i for i, _ in rows if i < 300} <= kept, "clean texts stay"
    assert not kept & set(range(1000, 1025)), "texts of symbols go"
    lone = {i for i in range(2000, 2020) if got[i][0].vote_lines == -1 and [getattr(got[i][0], f"vote_{r}") for r in quality.RULES].count(-1) == 1}
    assert len(lone) == 20 and lone <= kept, "a vote that no other rule supports is overruled"
