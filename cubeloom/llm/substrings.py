"""Operator 7: exact removal of repeated word windows by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one text.  Its minimiser is the
least of its ``GRAM``-word grams in a fixed order (leftmost of equal ones), so
equal windows have equal minimisers at equal places.  Consecutive windows
with the same minimiser travel as one packed string of words to the
minimiser's bucket, where sorting counts the windows exactly: windows are
sorted by a hash, and equal neighbours are compared word by word.

The order puts the most frequent grams last (a table of at most
``FREQUENT`` grams, counted over all texts), so only windows that lie wholly
within frequent passages meet under a frequent minimiser, and there equal
strings are joined before the shuffle.  A string that is met twice is known
to be repeated at once and is not held; only single strings wait for the end
of their bucket, and a bucket beyond ``HELD_BYTES`` is counted in passes over
ranges of the window hash from a scratch file.  So no bucket has to fit
in memory.

Null texts have no words and keep null digests of no words (the empty
string).  Texts under ``WINDOW`` words keep all.  Repeated rows repeat all
their windows.  Ids are whole numbers.  An empty table gives no rows; other
columns are not read; a text of any length is one stream of windows.
"""

from __future__ import annotations

import pickle
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, chunks, column_of, gram_hashes, materialize_and_free, mix, split_words, word_hashes

WINDOW = 35
GRAM = 3
CHUNK = 8 << 20
#: Grams in the table of frequent ones, and occurrences in one chunk that make a gram a candidate.
FREQUENT = 1 << 16
CANDIDATE = 8
HELD_BYTES = 24 << 20


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent grams of the corpus."""

    def run(batches):
        for part in chunks(batches, "text", CHUNK):
            words, starts = split_words(column_of(part, "text"))
            grams = gram_hashes(word_hashes(words), GRAM)
            if not len(grams):
                continue
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            found, n = np.unique(grams[owner[: len(grams)] == owner[GRAM - 1 :]], return_counts=True)
            keep = n >= CANDIDATE
            yield pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(n[keep])], names=["gram", "n"])

    top = docs.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(FREQUENT).select("gram").toArrow()
    return np.sort(np.asarray(top.column("gram"), dtype=np.int64).view(np.uint64)) if top.num_rows else np.zeros(0, np.uint64)


def super_kmers(hashes: np.ndarray, starts: np.ndarray, frequent: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer of texts laid end to end."""
    grams = gram_hashes(hashes, GRAM)
    span = window - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(grams) < span:
        return none, none, none.view(np.uint64)
    order = mix(grams) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        order |= (frequent[at] == grams).astype(np.uint64) << np.uint64(63)
    # leftmost least of spans that double
    place, width = np.arange(len(order)), 1
    while width < span:
        step = min(width, span - width)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(order[left] <= order[right], left, right)
        width += step
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first = np.flatnonzero(owner[: len(place)] == owner[window - 1 :])
    if not len(first):
        return none, none, none.view(np.uint64)
    lead = place[first]
    new = np.concatenate([[True], (lead[1:] != lead[:-1]) | (first[1:] != first[:-1] + 1)])
    heads = np.flatnonzero(new)
    return first[heads], np.diff(np.append(heads, len(first))), grams[lead[heads]]


_PACKED = pa.schema([("minimiser", pa.int64()), ("packed", pa.binary()), ("places", pa.binary())])
_PLACE = np.dtype([("id", "<i8"), ("h", "<i8"), ("start", "<i4")])


def _pack(frequent):
    """Map side: packed super-k-mers, equal ones of a chunk joined, with the places where each stands."""

    def run(batches):
        for part in chunks(batches, "text", CHUNK):
            words, starts = split_words(column_of(part, "text"))
            first, n, minimiser = super_kmers(word_hashes(words), starts, frequent.value)
            if not len(first):
                continue
            spaced = pc.binary_join_element_wise(words, pa.scalar("", words.type), pa.scalar(" ", words.type))
            offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
            data = memoryview(spaced.buffers()[2])
            strings = [bytes(data[a:b]) for a, b in zip(offsets[first].tolist(), offsets[first + n + WINDOW - 1].tolist())]
            owner = np.searchsorted(starts, first, side="right") - 1
            places = np.zeros(len(first), _PLACE)
            places["id"], places["h"] = np.asarray(column_of(part, "id"))[owner], np.asarray(column_of(part, "h"))[owner]
            places["start"] = first - starts[owner]
            # equal strings together
            codes = pa.array(strings, pa.binary()).dictionary_encode()
            code = np.asarray(codes.indices)
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1], [True]]))
            leads = order[edges[:-1]]
            out = [
                pa.array(minimiser[leads].view(np.int64)),
                pa.array([strings[i] for i in leads.tolist()], pa.binary()),
                pa.array([places[order[a:b]].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary()),
            ]
            whole = pa.RecordBatch.from_arrays(out, schema=_PACKED)
            for at in range(0, whole.num_rows, 8192):
                yield whole.slice(at, 8192)

    return run


def _windows(strings: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words, where each string starts, the first word of every window, and its string."""
    words, starts = split_words(pa.array(strings, pa.large_binary()).cast(pa.large_string()))
    owner = np.repeat(np.arange(len(strings)), np.diff(starts))
    first = np.flatnonzero(owner[: len(owner) - WINDOW + 1] == owner[WINDOW - 1 :])
    return words, starts, first, owner[first]


def _window_keys(codes: np.ndarray) -> np.ndarray:
    """A hash of the window that starts at each word, put together from runs of 1, 2, 4, ... words."""
    run, width, out, done = mix(codes.astype(np.uint64) + np.uint64(1)), 1, None, 0
    while True:
        if WINDOW & width:
            out = run if out is None else mix(out[: len(out) - width] * np.uint64(3) + run[done:][: len(out) - width])
            done += width
        if done == WINDOW:
            return out
        run, width = mix(run[:-width] * np.uint64(3) + run[width:]), 2 * width


def repeated_windows(strings: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and place of each window that is met twice or more; a string counts ``weights`` times."""
    words, starts, first, owner = _windows(strings)
    if not len(first):
        return first, first
    codes = np.asarray(words.dictionary_encode().indices).astype(np.int64)
    keys = _window_keys(codes)[first]
    order = np.argsort(keys, kind="stable")
    first, keys, owner = first[order], keys[order], owner[order]
    equal = keys[1:] == keys[:-1]
    same = equal.copy()
    # words are compared only where neighbours have one hash
    near = np.flatnonzero(equal)
    a, b, alike = first[near], first[near + 1], np.ones(len(near), bool)
    for i in range(WINDOW):
        alike &= codes[a + i] == codes[b + i]
    same[near] = alike
    for key in np.unique(keys[1:][equal & ~same]):  # different windows under one hash: sort those by their words
        a, b = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
        rows = codes[first[a:b, None] + np.arange(WINDOW)]
        inner = np.lexsort(rows.T[::-1])
        first[a:b], owner[a:b] = first[a:b][inner], owner[a:b][inner]
        same[a : b - 1] = (rows[inner][1:] == rows[inner][:-1]).all(axis=1)
    run = np.concatenate([[0], np.cumsum(~same)])
    again = np.bincount(run, weights=weights[owner])[run] > 1
    found = np.sort(first[again])
    string = np.searchsorted(starts, found, side="right") - 1
    return string, found - starts[string]


def _ranges(places: np.ndarray, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(places["id"].copy()), pa.array(places["h"].copy()), pa.array(places["start"].astype(np.int64) + a), pa.array(places["start"].astype(np.int64) + b)], names=["id", "h", "a", "b"])


def _covered(string: np.ndarray, window: np.ndarray, places: list[bytes | None]):
    """Word ranges covered by repeated windows of the strings that still have their place."""
    held = np.array([p is not None for p in places], dtype=bool)
    use = held[string]
    string, window = string[use], window[use]
    if not len(string):
        return
    heads = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (window[1:] != window[:-1] + 1)]))
    tails = np.append(heads[1:], len(string)) - 1
    where = np.frombuffer(b"".join(places[i] for i in string[heads].tolist()), _PLACE)
    yield _ranges(where, window[heads], window[tails] + WINDOW)


class _Scratch:
    """One bucket that is too large to hold: its strings lie in a file and are counted by ranges of a 128-bit window hash."""

    def __init__(self):
        self.file, self.sizes, self.windows = tempfile.TemporaryFile(), [], 0

    def add(self, rows: list[tuple[bytes, int, bytes | None]]) -> None:
        data = pickle.dumps(rows)
        self.file.write(data)
        self.sizes.append(len(data))
        self.windows += sum(max(0, r[0].count(b" ") - WINDOW + 1) for r in rows)

    def batches(self):
        self.file.seek(0)
        for size in self.sizes:
            yield pickle.loads(self.file.read(size))

    def ranges(self):
        classes = max(1, -(-self.windows * 48 // HELD_BYTES))
        for c in range(classes):
            keys, weights, where = [], [], []
            for k, rows in enumerate(self.batches()):
                words, starts, first, owner = _windows([r[0] for r in rows])
                h = word_hashes(words)
                one, two = gram_hashes(h, WINDOW)[first], gram_hashes(mix(h ^ np.uint64(0x5DEECE66D)), WINDOW)[first]
                mine = one % np.uint64(classes) == np.uint64(c)
                keys.append(np.rec.fromarrays([one[mine], two[mine]], names="one,two"))
                weights.append(np.array([r[1] for r in rows], dtype=np.int64)[owner[mine]])
                where.append(np.stack([np.full(int(mine.sum()), k), owner[mine], (first - starts[owner])[mine]]))
            key, weight, at = np.concatenate(keys), np.concatenate(weights), np.concatenate(where, axis=1)
            order = np.lexsort((key["two"], key["one"]))
            key = key[order]
            run = np.concatenate([[0], np.cumsum((key["one"][1:] != key["one"][:-1]) | (key["two"][1:] != key["two"][:-1]))]) if len(key) else np.zeros(0, np.int64)
            again = order[np.bincount(run, weights=weight[order])[run] > 1] if len(key) else np.zeros(0, np.int64)
            hit = at[:, np.sort(again)]
            for k, rows in enumerate(self.batches()):
                mine = hit[0] == k
                string, window = hit[1][mine], hit[2][mine]
                order = np.lexsort((window, string))
                yield from _covered(string[order], window[order], [r[2] for r in rows])


def _count(batches):
    """Reduce side: rows sorted by minimiser; buckets are counted together up to a size."""
    held: dict[bytes, list] = {}  # the buckets that are complete or under way: string, weight, its place while it is single
    size, now, scratch = 0, None, None

    def count():
        strings = list(held)
        return _covered(*repeated_windows(strings, np.array([v[0] for v in held.values()], dtype=np.int64)), [v[1] for v in held.values()]) if strings else iter(())

    group: dict[bytes, list] = {}
    group_size = 0
    for batch in batches:
        for minimiser, packed, places in zip(*(column_of(batch, c).to_pylist() for c in ("minimiser", "packed", "places"))):
            if minimiser != now:
                if scratch:
                    scratch.add([(s, *v) for s, v in group.items()])
                    yield from scratch.ranges()
                    scratch = None
                else:
                    held |= group
                    size += group_size
                    if size > HELD_BYTES:
                        yield from count()
                        held, size = {}, 0
                now, group, group_size = minimiser, {}, 0
            known = group.get(packed)
            times = len(places) // _PLACE.itemsize
            if known is None:
                if times > 1:
                    yield _whole(packed, places)
                group[packed] = [min(times, 2), places if times == 1 else None]
                group_size += len(packed) + 200
            else:
                if known[1] is not None:
                    yield _whole(packed, known[1])
                yield _whole(packed, places)
                known[0], known[1] = 2, None
            if group_size > HELD_BYTES:
                scratch = scratch or _Scratch()
                scratch.add([(s, *v) for s, v in group.items()])
                group, group_size = {}, 0
    if scratch:
        scratch.add([(s, *v) for s, v in group.items()])
        yield from scratch.ranges()
    else:
        held |= group
    yield from count()


def _whole(packed: bytes, places: bytes) -> pa.RecordBatch:
    """All words of a string; each is followed by a space."""
    return _ranges(np.frombuffer(places, _PLACE), 0, packed.count(b" "))


def _joined(batches, rows: int = 20_000):
    """Small record batches put together."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _cut(batches):
    """Texts with their ranges: the words that stay."""
    for part in chunks(batches, "text", CHUNK):
        words, starts = split_words(column_of(part, "text"))
        edge = np.zeros(len(words) + 1, np.int64)
        a, b = column_of(part, "a"), column_of(part, "b")
        base = np.repeat(starts[:-1], np.asarray(pc.fill_null(pc.list_value_length(a), 0)))
        np.add.at(edge, base + np.asarray(a.flatten()), 1)
        np.add.at(edge, base + np.asarray(b.flatten()), -1)
        stay = np.cumsum(edge)[:-1] == 0
        n = np.diff(starts)
        before = np.concatenate([[0], np.cumsum(stay)])
        kept = before[starts[1:]] - before[starts[:-1]]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(before[starts], pa.int32()), words.filter(pa.array(stay)).cast(pa.string())), " ")
        yield pa.RecordBatch.from_arrays([column_of(part, "id"), column_of(part, "h"), pa.array(n), pa.array(n - kept), texts], names=["id", "h", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's id, n_words, n_removed and kept text (words joined by one space)."""
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    # rows are known by id and a hash of the text: equal rows are treated alike anyway
    one = docs.select(
        F.coalesce(F.col(f"`{id_column}`").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(f"`{text_column}`")).alias("h"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text")
    )
    frequent = spark.sparkContext.broadcast(frequent_grams(one.select("text")))
    packed = one.mapInArrow(_pack(frequent), "minimiser bigint, packed binary, places binary")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * one.rdd.getNumPartitions())
    counted = packed.repartition(buckets, "minimiser").sortWithinPartitions("minimiser").mapInArrow(lambda b: _joined(_count(b)), "id bigint, h bigint, a bigint, b bigint")
    found = materialize_and_free(counted)
    ranges = found.groupBy("id", "h").agg(F.collect_set(F.struct("a", "b")).alias("r")).select("id", "h", F.col("r.a").alias("a"), F.col("r.b").alias("b"))
    cut = one.join(ranges, ["id", "h"], "left").select("id", "h", "text", "a", "b").mapInArrow(_cut, "id bigint, h bigint, n_words bigint, n_removed bigint, kept string")
    return cut.select(F.when(F.col("id") != NO_ID, F.col("id")).cast(kind).alias(id_column), "n_words", "n_removed", "kept")
