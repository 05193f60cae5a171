"""Operator 3: quality by weak supervision, in DataFrame functions only.

Each rule looks at counts of a text and votes good (1) or bad (-1), or
abstains (0); each defect (symbols, repetition, shouting, odd words) is looked
at by two rules or more.  Expectation-maximisation over the table of vote
patterns finds how often each rule votes bad on good and on bad texts, and a
text is kept when its posterior probability of being good is one half or more.
A bad vote that no other rule supports is overruled when the rule often votes
bad on texts that all others call good.

The model is a class of good and one of bad texts, in each of which the rules
vote independently; abstaining says nothing.  Its priors are shares of the
corpus, so a corpus and a thousand copies of it get the same verdicts.  Two
order constraints hold throughout: at least half of the texts are good, and no
rule votes bad on good texts more often than on bad ones.  So a text without a
bad vote is always kept, whatever the table.

A text is a null or a string; a null has no words.  Texts under ``MIN_WORDS``
words, or with over half of their words in repeated three-word windows, fail
the base rule and are never kept.  A posterior of exactly one half keeps.
Equal rows are judged alike and count each; an empty table gives no rows; only
the named columns are read, whatever others are called; a text is read whole,
as one row's arrays, however long it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, let, materialize, words_column

MIN_WORDS = 50
BLANK, VISIBLE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS, UPPER, BANGS, LETTERS = r"[#*$%&|<>]+", r"[A-Z]+", r"!+", r"\p{L}+"

#: The test of a bad vote, and of a good one.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols > 0.04 * word_chars", "n_symbols < 0.02 * word_chars"),
    "symbol_words": ("n_symbol_words > 0.10 * n_words", "n_symbol_words < 0.04 * n_words"),
    "letters": ("n_letters < 0.80 * word_chars", "n_letters > 0.90 * word_chars"),
    "shouting": ("n_upper > 0.40 * word_chars", "n_upper < 0.15 * word_chars"),
    "bangs": ("n_bangs > 0.30 * n_words", "n_bangs < 0.05 * n_words"),
    "lines": ("n_dup_lines > 0.30 * n_lines", "n_dup_lines <= 0.10 * n_lines"),
    "windows": ("n_repeat_words > 0.30 * n_words", "n_repeat_words < 0.10 * n_words"),
    "variety": ("n_distinct < 0.30 * n_words", "n_distinct > 0.45 * n_words"),
    "word_length": ("word_chars < 2.5 * n_words or word_chars > 15 * n_words", "word_chars between 3.2 * n_words and 10 * n_words"),
}


def _repeat_words(w: Column) -> Column:
    """Words within three-word windows that occur twice or more: sort windows, mark equal neighbours, add up what they cover."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))

    def places(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)

    return F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(let(F.sort_array(windows), lambda s: let(places(s), covered)))


def measures(text: Column) -> Column:
    """A struct of the counts of one text."""
    text = F.coalesce(text, F.lit(""))
    strip = lambda marks: (F.char_length(text) - F.char_length(F.regexp_replace(text, marks, ""))).cast("bigint")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(VISIBLE))
    counted_lines = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    counted_words = let(
        words_column(text),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"), F.size(F.filter(w, lambda x: x.rlike(SYMBOLS))).cast("bigint").alias("n_symbol_words"), _repeat_words(w).alias("n_repeat_words")),
    )
    return F.struct(
        counted_words.alias("w"),
        counted_lines.alias("l"),
        F.char_length(F.regexp_replace(text, BLANK, "")).cast("bigint").alias("word_chars"),
        strip(SYMBOLS).alias("n_symbols"),
        strip(UPPER).alias("n_upper"),
        strip(BANGS).alias("n_bangs"),
        strip(LETTERS).alias("n_letters"),
    )


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The counts and the votes of every row."""
    m = docs.select(column(id_column), measures(column(text_column)).alias("m"))
    flat = m.select(column(id_column), "m.w.*", "m.l.*", "m.word_chars", "m.n_symbols", "m.n_upper", "m.n_bangs", "m.n_letters")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    votes = [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).alias(f"vote_{name}") for name, (bad, good) in RULES.items()]
    return flat.select("*", failed.alias("base_failed"), *votes)


#: Prior beliefs, each a mean and how much it weighs as a share of the corpus: of texts that are good, and of bad votes on good and on bad texts.
GOOD, ALARM, HIT = (0.9, 0.2), (0.01, 0.2), (0.3, 0.02)


def _rate(bad: float, votes: float, prior: tuple[float, float]) -> float:
    return (bad + prior[0] * prior[1]) / (votes + prior[1])


def _rates(patterns: list[tuple[tuple[int, ...], float]], posterior: list[float]) -> tuple[float, list[tuple[float, float]]]:
    """The share of good texts, and each rule's rates of bad votes on good and on bad texts: the most likely ones that keep the order constraints."""
    good = sum(p * n for p, (_, n) in zip(posterior, patterns))
    share = max(0.5, (good + GOOD[0] * GOOD[1]) / (1.0 + GOOD[1]))
    rates = []
    for r in range(len(RULES)):
        at = lambda vote, side: sum((p if side else 1 - p) * n for p, (v, n) in zip(posterior, patterns) if v[r] == vote)  # noqa: B023, E731
        (ab, ag), (hb, hg) = ((at(-1, side), at(1, side)) for side in (True, False))
        alarm, hit = _rate(ab, ab + ag, ALARM), _rate(hb, hb + hg, HIT)
        if alarm > hit:  # the order constraint binds: one rate for both
            alarm = hit = (ab + hb + ALARM[0] * ALARM[1] + HIT[0] * HIT[1]) / (ab + ag + hb + hg + ALARM[1] + HIT[1])
        rates.append((alarm, hit))
    return share, rates


def _sides(votes: tuple[int, ...], share: float, rates: list[tuple[float, float]]) -> tuple[float, float]:
    """Log-likelihoods of a pattern among good and among bad texts."""
    good, bad = math.log(share), math.log(1 - share)
    for vote, (alarm, hit) in zip(votes, rates):
        if vote:
            good += math.log(alarm if vote < 0 else 1 - alarm)
            bad += math.log(hit if vote < 0 else 1 - hit)
    return good, bad


def objective(patterns: list[tuple[tuple[int, ...], float]], share: float, rates: list[tuple[float, float]]) -> float:
    """What EM raises in every round: log-likelihood and log-priors, for counts that sum to one."""
    beta = lambda rate, prior: prior[1] * (prior[0] * math.log(rate) + (1 - prior[0]) * math.log(1 - rate))
    total = beta(share, GOOD) + sum(beta(a, ALARM) + beta(h, HIT) for a, h in rates)
    for votes, n in patterns:
        good, bad = _sides(votes, share, rates)
        top = max(good, bad)
        total += n * (top + math.log(math.exp(good - top) + math.exp(bad - top)))
    return total


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500, history: list[float] | None = None) -> tuple[float, list[dict[int, float]]]:
    """EM over (votes, count): log prior odds, and each rule's log-likelihood ratio by vote.

    It starts from the belief that two bad votes make a text bad and one
    leaves it open.  ``history`` gets the objective after each round.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return 0.0, [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in RULES]
    shares = [(v, n / total) for v, n in patterns]
    posterior = [{0: 0.97, 1: 0.5}.get(v.count(-1), 0.03) for v, _ in shares]
    for _ in range(rounds):
        share, rates = _rates(shares, posterior)
        if history is not None:
            history.append(objective(shares, share, rates))
        sides = [_sides(v, share, rates) for v, _ in shares]
        new = [1.0 / (1.0 + math.exp(max(-500.0, min(500.0, bad - good)))) for good, bad in sides]
        moved = max(abs(a - b) for a, b in zip(new, posterior))
        posterior = new
        if moved < 1e-10:
            break
    share, rates = _rates(shares, posterior)
    return math.log(share / (1 - share)), [{-1: math.log(alarm / hit), 0: 0.0, 1: math.log((1 - alarm) / (1 - hit))} for alarm, hit in rates]


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts, base_failed, the votes, ``posterior`` and ``kept`` of every row."""
    rows = materialize(features(docs, id_column, text_column))
    names = [f"vote_{r}" for r in RULES]
    # what fails the base rule is decided; of the rest, at most 3 ** len(RULES) patterns reach the driver, whatever the corpus
    counted = rows.where("not base_failed").groupBy(*names).count().collect()
    prior, ratio = fit(sorted((tuple(r[c] for c in names), r["count"]) for r in counted))
    logit = F.lit(prior)
    for name, table in zip(names, ratio):
        logit = logit + F.when(F.col(name) < 0, table[-1]).when(F.col(name) > 0, table[1]).otherwise(table[0])
    posterior = 1 / (1 + F.exp(-logit))
    return rows.withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
