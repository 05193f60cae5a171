"""Operator 2: toxic passages by maximum-scoring segment search.

Every word has a log-odds weight with an informative Dirichlet prior (the
distribution of its features in the labelled rows that weights are learnt
from, not in the whole corpus); features are the word and its stems (its
first characters), counted once a document and hashed into a table of fixed
size, and a word takes the weight of its most significant feature.  A linear scan finds all maximal scoring segments of
a text (Ruzzo and Tompa).  Their scores are calibrated by the extreme-value
law of maximal segments: the expected number of segments of score S in n clean
words is K n exp(-lambda S).  Evidence over all significant segments becomes a
probability by a logistic fit on labelled rows that the weights have not seen.

Bounds: labels are learnt from at most ``MAX_LABELLED`` rows a class, the
lowest by hash of their id; the model is three arrays of ``FEATURES`` numbers.
Null and empty texts have no segments and take the score of no evidence.
Repeated labels of a document count once, as toxic if any says so; equal texts
take equal scores.  Ties of two features go to the word itself, then to its
shorter stem.  Very long texts are scanned in linear time.  With no labelled
row of a class nothing is learnt from, every score is that of no evidence; an
empty table gives an empty result.  Other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, column, column_of, discard, kept, materialize, only, split_words, whole_row

#: Labelled rows learnt from, of each class; documented bound.
MAX_LABELLED = 40_000
#: Size of the hashed feature table: the bound on everything broadcast.
FEATURES = 1 << 19
STEMS = (4, 5, 6)
#: Total mass of the Dirichlet prior, in documents.
PRIOR_MASS = 20.0
#: A feature counts when the root of its log-likelihood ratio is this high.
SIGNIFICANT = 5.0
#: Words whose weights a worker remembers.
KNOWN_WORDS = 400_000
#: Part of the labelled rows that only calibrate.
CALIBRATE_OF = 3


def fold_of(doc_id) -> object:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string")) % 5


def feature_arrays(words: list[str]):
    """Feature table entries of many words, as (places of the words, entries): the words themselves, and their stems of each length."""
    digest = xxhash.xxh3_64_intdigest
    some = [i for i, w in enumerate(words) if w]
    yield np.array(some, np.int64), np.fromiter((digest("=" + words[i]) for i in some), dtype=np.uint64, count=len(some)) % np.uint64(FEATURES)
    for n in STEMS:
        stems: dict[str, int] = {}  # many words share a stem
        at = [i for i in some if len(words[i]) >= n]
        code = np.fromiter((stems.setdefault(words[i][:n], len(stems)) for i in at), dtype=np.int64, count=len(at))
        hashed = np.fromiter(map(digest, stems), dtype=np.uint64, count=len(stems)) % np.uint64(FEATURES)
        yield np.array(at, np.int64), hashed[code]


class _Known:
    """Weights of words met before; the older half goes when there are more than ``KNOWN_WORDS``."""

    def __init__(self):
        self.new: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def values(self, words: list[str], learn):
        if len(self.new) > KNOWN_WORDS // 2:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = []
        for word in words:
            if word not in new:
                if word in old:
                    new[word] = old[word]
                else:
                    missing.append(word)
        new.update(zip(missing, learn(missing)))
        return map(new.__getitem__, words)


def _clean(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct lower-case words without surrounding marks, and the code of each word."""
    coded = pc.utf8_trim(pc.utf8_lower(words), "!?.,;:*#$%&|<>\"'()[]{}-_").dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices)


@dataclass
class Model:
    weight: np.ndarray  # float32 by feature
    certainty: np.ndarray  # |z| by feature
    decay: float = 1.0  # lambda
    k: float = 0.1
    bias: float = 0.0
    slope: float = 1.0

    def __post_init__(self):
        self.stamp = zlib.crc32(self.certainty.tobytes(), zlib.crc32(self.weight.tobytes()))

    def word_weights(self, words: list[str]) -> np.ndarray:
        """Weights of distinct words; a worker remembers those of ``KNOWN_WORDS`` words."""
        known = kept(("toxicity", self.stamp), _Known)
        return np.fromiter(known.values(words, self._learn), dtype=np.float64, count=len(words))

    def _learn(self, words: list[str]) -> list[float]:
        """Each word's weight: that of its most significant feature, the word itself before a shorter stem."""
        best, sure = np.full(len(words), self.base), np.full(len(words), np.nextafter(SIGNIFICANT, 0.0))
        for at, feature in feature_arrays(words):
            certainty = self.certainty[feature]
            better = certainty > sure[at]
            best[at[better]], sure[at[better]] = self.weight[feature[better]], certainty[better]
        return best.tolist()

    #: Weight of a word that says nothing: passages end where such words pile up.
    base: float = -0.25

    def segments(self, weights: np.ndarray) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (start, end, score) of a weight sequence, in linear time."""
        total = np.concatenate([[0.0], np.cumsum(weights)])
        stack: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
        for i in np.flatnonzero(weights > 0).tolist():
            start, left, right = i, total[i], total[i + 1]
            end = i + 1
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= left:
                    j -= 1
                if j < 0 or stack[j][3] >= right:
                    # what lies after j starts no lower than this one: it stays as it is
                    stack.append((start, end, left, right))
                    break
                start, left = stack[j][0], stack[j][2]
                del stack[j:]
        return [(a, b, r - l) for a, b, l, r in stack]

    def evidence(self, segments, n_words: int) -> float:
        """Sum over the significant segments of the nats by which each beats chance in so many words."""
        expected = math.log(max(n_words, 1) * self.k + 1e-12)
        return sum(max(0.0, self.decay * s - max(expected, 0.0)) for _, _, s in segments)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.bias + self.slope * math.log1p(evidence)))))


def _weights_by_text(model: Model, texts: pa.Array):
    words, starts = split_words(texts)
    distinct, codes = _clean(words)
    each = model.word_weights(distinct)[codes]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield each[a:b]


def labelled_sample(labels: DataFrame, id_column: str = "doc_id", label_column: str = "toxic") -> DataFrame:
    """At most ``MAX_LABELLED`` rows a class outside the held-out fold: the lowest by hash of the id."""
    rows = (
        only(labels, id_column, label_column)
        .where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & (fold_of(F.col(id_column)) != 0))
        .groupBy(id_column)
        .agg(F.max(label_column).cast("int").alias("_y"))
        .withColumn("_rank", F.xxhash64(id_column))
    )
    parts = [rows.where(F.col("_y") == y).orderBy("_rank", id_column).limit(MAX_LABELLED) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).select(id_column, "_y", F.pmod("_rank", F.lit(CALIBRATE_OF)).alias("_part"))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Learn weights, extreme-value constants and the logistic calibration."""
    spark = docs.sparkSession
    rates = (
        only(labels, id_column, label_column)
        .where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & (fold_of(F.col(id_column)) != 0))
        .groupBy(F.when(F.col(label_column) == 1, 1).otherwise(0).alias("y")).count().collect()
    )
    seen = {r["y"]: r["count"] for r in rates}
    sample = labelled_sample(labels, id_column, label_column)
    # at most 2 * MAX_LABELLED rows of three numbers: the broadcast side has a fixed bound
    keys = sample.select(column(id_column).alias("_id"), "_y", "_part")
    texts = docs.select(column(id_column).alias("_id"), column(text_column).alias("text"))
    rows = materialize(texts.join(F.broadcast(keys), "_id").select("text", "_y", "_part"))

    def count(batches):
        table = np.zeros((2, FEATURES), np.int32)
        n = np.zeros(2, np.int64)
        for part in chunks(batches, "text"):
            y, group = (np.asarray(column_of(part, c)) for c in ("_y", "_part"))
            words, starts = split_words(column_of(part, "text"))
            distinct, codes = _clean(words)
            owner = np.repeat(np.arange(len(y)), np.diff(starts))
            listed = list(feature_arrays(distinct))
            place, entry = (np.concatenate([x[k] for x in listed]).astype(np.int64) for k in (0, 1))
            width = np.bincount(place, minlength=len(distinct))
            first = np.concatenate([[0], np.cumsum(width)])
            flat = entry[np.argsort(place, kind="stable")]
            # each word of each document once, then each feature of each document once
            pairs = np.unique(owner * max(len(distinct), 1) + codes)
            pairs = pairs[(group != 0)[pairs // max(len(distinct), 1)]]
            of, word = np.divmod(pairs, max(len(distinct), 1))
            times = width[word]
            at = np.repeat(first[word], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            marks = np.unique(np.repeat(of, times) * FEATURES + flat[at])
            for label in (0, 1):
                use = (y == label) & (group != 0)
                n[label] += int(use.sum())
                table[label] += np.bincount(marks[use[marks // FEATURES]] % FEATURES, minlength=FEATURES).astype(np.int32)
        for label in (0, 1):
            at = np.flatnonzero(table[label])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label, np.int32)), pa.array(at.astype(np.int32)), pa.array(table[label, at].astype(np.int64)), pa.array(np.full(len(at), 0, np.int64))], names=["y", "feature", "n", "docs"])
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([n[label]], pa.int64())], names=["y", "feature", "n", "docs"])

    counted = rows.mapInArrow(count, "y int, feature int, n bigint, docs bigint").groupBy("y", "feature").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toArrow()
    table, n = np.zeros((2, FEATURES)), np.zeros(2)
    y, at, c, d = (np.asarray(counted.column(k)) for k in ("y", "feature", "n", "docs"))
    table[y[at >= 0], at[at >= 0]] = c[at >= 0]
    for label, docs_seen in zip(y[at < 0].tolist(), d[at < 0].tolist()):
        n[label] = docs_seen
    model = _weights(table, n)
    if min(n) == 0:
        return model

    calibration = rows.where("_part = 0")

    def measured(model: Model) -> tuple[np.ndarray, ...]:
        """Class, words, best segment and evidence of each of at most 2 * MAX_LABELLED / CALIBRATE_OF rows, whatever their length."""
        shared = spark.sparkContext.broadcast(model)

        def measure(batches):
            for part in chunks(batches, "text"):
                found, n = [], []
                for w in _weights_by_text(shared.value, column_of(part, "text")):
                    segments = shared.value.segments(w)
                    found.append((max((s for *_, s in segments), default=0.0), shared.value.evidence(segments, len(w))))
                    n.append(len(w))
                best, evidence = (np.array([x[k] for x in found], dtype=np.float64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([column_of(part, "_y").cast(pa.int32()), pa.array(n, pa.int64()), pa.array(best), pa.array(evidence)], names=["y", "n", "best", "evidence"])

        out = calibration.mapInArrow(measure, "y int, n bigint, best double, evidence double").toArrow()
        return tuple(np.asarray(out.column(c)) for c in ("y", "n", "best", "evidence"))

    _extreme_values(model, *measured(model)[:3])
    y, _, _, evidence = measured(model)
    _logistic(model, y, evidence, seen)
    discard(rows)
    return model


def _weights(table: np.ndarray, n: np.ndarray) -> Model:
    """Log-odds of the classes' document rates with a Dirichlet prior, and the root of the likelihood ratio."""
    whole, documents = table.sum(axis=0), max(n.sum(), 1.0)
    rate = whole / documents
    smooth = (table + PRIOR_MASS * rate) / (n[:, None] + PRIOR_MASS)
    weight = np.log(np.maximum(smooth[1], 1e-12)) - np.log(np.maximum(smooth[0], 1e-12))
    ratio = np.zeros(FEATURES)
    for label in (0, 1):
        m = max(n[label], 1.0)
        for k, p in ((table[label], rate), (n[label] - table[label], 1 - rate)):
            ratio += np.where(k > 0, k * np.log(np.maximum(k / m, 1e-12) / np.maximum(p, 1e-12)), 0.0)
    weight[whole == 0] = 0.0
    return Model(weight=np.clip(weight, -2.0, 6.0).astype(np.float32), certainty=np.sqrt(2 * np.maximum(ratio, 0)).astype(np.float32))


def _extreme_values(model: Model, y, n, best) -> None:
    """lambda and K from the best segments of clean rows (Gumbel moments)."""
    clean = (y == 0) & (n > 0)
    if clean.sum() >= 10 and best[clean].std() > 0:
        spread = best[clean].std()
        model.decay = float(math.pi / (math.sqrt(6.0) * spread))
        centre = best[clean] - np.log(n[clean]) / model.decay
        model.k = float(math.exp(model.decay * centre.mean() - 0.5772156649))
        model.k = min(max(model.k, 1e-6), 1.0)
        model.decay = min(max(model.decay, 0.05), 5.0)


def _logistic(model: Model, y, evidence, seen) -> None:
    """The probability of a toxic label by the log of the evidence."""
    x = np.log1p(evidence)
    # the sample is dealt by class: each class counts as often as among all labelled rows
    share = {label: (seen.get(label, 0) / max((y == label).sum(), 1)) for label in (0, 1)}
    weight = np.array([share[int(v)] for v in y])
    weight = weight / weight.sum() * len(weight)
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a + b * x, -40, 40)))
        g = np.array([np.sum(weight * (y - p)) - 1e-3 * a, np.sum(weight * (y - p) * x) - 1e-3 * b])
        h = weight * p * (1 - p)
        hess = np.array([[h.sum() + 1e-3, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    model.bias, model.slope = float(a), float(b)


def score(docs: DataFrame, model: Model, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (a struct of the columns ``keep``), score, predicted and the passages (first word, end word, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(whole_row(only(docs, *keep)).alias("row"), column(text_column).alias("text"))

    def run(batches):
        for part in chunks(batches, "text"):
            scores, spans = [], []
            for w in _weights_by_text(shared.value, column_of(part, "text")):
                found = shared.value.segments(w)
                scores.append(shared.value.probability(shared.value.evidence(found, len(w))))
                chance = max(math.log(max(len(w), 1) * shared.value.k + 1e-12), 0.0)
                spans.append([{"start": a, "end": b, "score": float(s)} for a, b, s in found if shared.value.decay * s > chance])
            p = np.array(scores, dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [column_of(part, "row"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                names=["row", "score", "predicted", "passages"],
            )

    span = T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("score", T.DoubleType())
    schema = T.StructType().add("row", rows.schema["row"].dataType).add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("passages", T.ArrayType(span))
    return rows.mapInArrow(run, schema)
