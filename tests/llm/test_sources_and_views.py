"""Source divergence, mixing and view maintenance against brute force, with their edges."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cubeloom.llm import divergence, maintenance, mixing

EXTRA = "doc_id bigint, text string, lang string, source string, term string, n bigint, part int, `a.b` int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, 1, 2) for r in rows], EXTRA)


# -- divergence ----------------------------------------------------------------


def audit_by_hand(rows, min_docs, top):
    docs = defaultdict(list)
    for _, text, lang, source in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        docs[lang or "", source or ""].append(Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)))
    out = []
    for lang in {k[0] for k in docs}:
        groups = {s: sum(c, Counter()) for (x, s), c in docs.items() if x == lang}
        held = Counter(t for (x, _), cs in docs.items() if x == lang for c in cs for t in c)
        kept = [t for t, n in held.items() if n >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [("term", t, f(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for rows_ in (pairs, terms):
                ranked = sorted(rows_, key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, i + 1) for i, r in enumerate(ranked) if r[0] == "pair" or i < top]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"wörd{chr(97 + i)}" if i % 3 else f"W{chr(97 + i)}X" for i in range(26)] + ["日本", "é", "Straße"]
    rows = []
    for i in range(400):
        source = rng.choice(["s0"] * 6 + [f"s{k}" for k in range(1, 16)] + [None, ""])
        few = words[: 5 + len(source or "") * 3 + ord((source or "a")[-1]) % 9]
        rows.append((i, " ".join(rng.choices(few, k=rng.randint(0, 60))) + " 12-x_y", rng.choice(["en", "en", "en", "de", None]), source))
    return [*rows, (400, None, "en", "only null"), (401, "", "fr", "alone"), (402, "!!", "fr", "other"), (3, rows[3][1], rows[3][2], rows[3][3])]


@pytest.mark.parametrize("light,tile_groups", [(12, 64), (2, 3), (100, 64)])
def test_audit(spark, corpus, light, tile_groups, monkeypatch):
    monkeypatch.setattr(divergence, "TILE_GROUPS", tile_groups)
    monkeypatch.setattr(divergence, "TILE_TERMS", 7)
    got = divergence.audit(documents(spark, corpus), light=light)
    assert sorted(map(tuple, got.collect())) == audit_by_hand(corpus, 10, 10)


def test_audit_edges(spark):
    assert divergence.audit(documents(spark, []).limit(0)).count() == 0
    same = [(i, "Same same words", "en", "a" if i % 2 else "b") for i in range(20)]
    got = sorted(map(tuple, divergence.audit(documents(spark, same)).collect()))
    assert got == audit_by_hand(same, 10, 10) and [r[4] for r in got if r[2] == "pair"] == [0, 0]
    long = [(i, "x" * 300_000 + " " + "y " * 50_000, "en", f"s{i % 2}") for i in range(10)]
    assert sorted(map(tuple, divergence.audit(documents(spark, long)).collect())) == audit_by_hand(long, 10, 10)


def test_share_is_exact_for_large_counts(spark):
    cases = [(2, 7), (10**14, 3 * 10**14 + 1), (123456789012345, 999999999999999), (5, 0)]
    got = spark.createDataFrame(cases, "c long, t long").select(F.expr(divergence.share("c", "t")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * c // t if t else None for c, t in cases]


# -- mixing --------------------------------------------------------------------


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: Fraction(3 * sizes[s]) if s in capped else Fraction(rest * weight[s], w) for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def mixed(spark, rows):
    return mixing.mix(documents(spark, rows)).collect()


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 400]), "en", rng.choice([None, "", "a", "b", "b", "b", "b", "b", "c", "d"])) for i in range(900)]
    rows += [(5000, "huge " * 30_000, "en", "b"), (5001, None, "en", "a"), (7, "twice again", "en", "c"), (7, "twice again", "en", "c")]
    got = mixed(spark, rows)
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "size", "source_size", "target", "copies", "taken"]
    source_of, sizes, taken, largest = {r[0]: r[3] for r in rows}, Counter(), Counter(), Counter()
    for _, text, _, s in rows:
        sizes[s] += len((text or "").split())
        largest[s] = max(largest[s], len((text or "").split()))
    want = targets_by_hand(sizes)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - float(want[s])) < 1e-6
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1 for s in sizes)
    assert Counter(map(tuple, mixed(spark, rows[::-1]))) == Counter(map(tuple, got)), "another order of rows gives the same mix"


def test_mix_without_words_or_rows(spark):
    assert mixed(spark, []) == []
    assert [(r.size, r.target, r.taken) for r in mixed(spark, [(1, None, "en", "a"), (2, " ", "en", None)])] == [(0, 0.0, 0)] * 2
    assert [(r.target, r.taken) for r in mixed(spark, [(1, "one source", "en", None)] * 3)] == [(6.0, 2)] * 3


# -- view maintenance ----------------------------------------------------------

LIFE = ", born int, dead int"


def view_by_hand(lines, sales, clients, vendors, batches):
    out = []
    for b in range(batches):
        live = lambda rows: [r for r in rows if r[-2] <= b < r[-1]]  # noqa: E731, B023
        groups = defaultdict(list)
        for (s, v, item, rev, *_), (s2, c, part, *_), (c2, region, *_), (v2, region2) in itertools.product(live(lines), live(sales), live(clients), vendors):
            if None not in (s, c, v, region, part) and s == s2 and c == c2 and v == v2 and region == region2:
                groups[region, part].append((rev, c, item))
        for (region, part), rows in groups.items():
            revs = [r[0] for r in rows if r[0] is not None]
            out.append((b, region, part, len(rows), sum(revs), min(revs, default=None), len({r[1] for r in rows}), len({r[2] for r in rows} - {None})))
    return sorted(out, key=str)


def run_view(spark, lines, sales, clients, vendors, batches, k):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = maintenance.maintain(
        make(lines, "sale_id long, vendor_id long, item_id long, revenue long" + LIFE), make(sales, "sale_id long, client_id long, part long" + LIFE), make(clients, "client_id long, region int" + LIFE),
        make(vendors, "vendor_id long, region int"), batches, k,
    )
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("k,seed", [(1, 0), (2, 1), (16, 2)])
def test_view(spark, k, seed):
    rng = random.Random(seed)
    some = lambda n: rng.choice([None, *range(n), *range(n)])

    def life():
        a, d = rng.randrange(5), rng.randrange(5)
        return (a, d) if a < d else (-1, 5)

    clients = [(c, some(2), *life()) for c in range(5)] + [(None, 1, -1, 5)]
    sales = [(s, some(5), some(2), *life()) for s in range(12)]
    vendors = [(v, some(2)) for v in range(3)]
    lines = [(some(12), some(3), some(4), rng.choice([None, 5, 5, *range(3, 30)]), *life()) for _ in range(60)]
    lines += lines[:9]
    assert run_view(spark, lines, sales, clients, vendors, 5, k) == view_by_hand(lines, sales, clients, vendors, 5)


def test_buffers_run_empty_and_are_filled_again(spark):
    # each batch deletes the two least revenues of one group, which is more than a buffer of two can stand
    rows = [(1, 1, r, -1, r // 2) for r in range(10)]
    revenues = spark.createDataFrame([(1, 1, r, *(int(b == -1) - int(b == r // 2) for b in range(-1, 5))) for r in range(10)], "region int, part long, revenue long, " + ", ".join(f"c{i} long" for i in range(6)))
    buffers = maintenance._least(revenues.select("region", "part", "revenue", F.col("c0").alias("n"), F.lit(None).cast("long").alias("bound")), 2)
    refills, least = [], []
    for b in range(5):
        buffers, n = maintenance.step(buffers, revenues, b, 2)
        refills.append(n)
        least.append([r.known[0].revenue for r in buffers.collect()])
    assert rows and refills == [1, 1, 1, 1, 0] and least == [[2], [4], [6], [8], []]


def test_view_edges(spark):
    assert run_view(spark, [], [], [], [], 3, 2) == []
    one = [(1, 1, None, 7, -1, 2)], [(1, 1, 19000, 0, 3)], [(1, 4, -1, 3)], [(1, 4)]
    assert run_view(spark, *one, 3, 2) == [(0, 4, 19000, 1, 7, 7, 1, 0), (1, 4, 19000, 1, 7, 7, 1, 0)]


def test_lives_follow_the_checksum(spark):
    names = ["c7", "s12", "l5:2", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(*maintenance.intervals(F.col("n"))).collect()
    for n, r in zip(names, got):
        h = zlib.crc32(n.encode()) if n else 0
        a, d = h % 7, h // 7 % 7
        assert (r.born, r.dead) == ((a, d) if n and a < d else (-1, 7))
