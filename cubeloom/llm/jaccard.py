"""Operator 8: exact n-gram Jaccard join and its components, by set-relation skipping.

A document is the set of its distinct five-word shingles.  An inverted index
over packed blocks gives every shingle's document frequency.  A shingle that
no other set holds can never be shared, so a set of n shingles of which c are
shared links with nothing when c < t n, and two sets overlap in no more than
the lesser c.  The remaining sets, one for each group of equal ones, are
indexed by the prefix of their rarest shingles.

Two relations spare comparisons.  Index skipping: an index list is cut into
blocks by set size and a probe reads only the blocks of linkable sizes, and in
them only entries whose position leaves room for the overlap.  Answer
skipping: every set is first compared with one leader, the set of its lists
with the largest shared part; what is linked through leaders needs no further
comparison, and of two sets with the same leader the overlap is at most
min(o1, o2) + min(c1 - o1, c2 - o2), from their answers with the leader.
Everything left over between different components is compared exactly.

Equal sets are one class; a class of any size is one entry of the index.
Sets without a shingle (null, empty and blank texts) link with nothing.  Fewer
than five words make one shingle of all of them.  Repeated ids and null ids
keep a row each; a component's id is its least id that is not null.  A share of
exactly the threshold links.  An empty table gives no rows; other columns are
not read; a text of any length is one set of 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, column, column_of, discard, materialize, shingle_sets, whole_row
from .components import connected_components

SHINGLE = 5
#: The threshold as a fraction, so that tests are exact.
PERCENT = 75
CHUNK = 16 << 20
#: Postings a bucket of the inverted index should have.
BUCKET_POSTINGS = 1_000_000


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as byte planes, compressed."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).reshape(-1))
        at += n * size
    return out


def least_overlap(n: int) -> int:
    """Shingles that any set linked with one of n must share with it."""
    return -(-PERCENT * n // 100)


def runs(keys: np.ndarray):
    """(start, end) of runs of equal values."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)
    return zip(edges[:-1].tolist(), edges[1:].tolist())


def by_key(batches, *keys):
    """Rows of a sorted partition, a list for each value of the keys."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


#: A member's set size, signature, id, hash of its text, and whether it has an id.
_MEMBER = (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.uint8)
_BLOB = "bucket int, base bigint, kind int, data binary"


def _index_blocks(buckets: int):
    """Map side: a block of documents becomes one packed posting list a bucket, and its documents' ids, sizes and signatures."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for rows in chunks(batches, "text", CHUNK):
            base = (part << 36) + seen
            seen += rows.num_rows
            hashes, offsets = shingle_sets(column_of(rows, "text"), SHINGLE)
            n = np.diff(offsets)
            sigs = np.array([xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], dtype="V16")
            first = {}
            leads = np.array([first.setdefault(s.tobytes(), i) == i for i, s in enumerate(sigs)], dtype=bool)
            owner = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            use = leads[owner]
            hashes, owner = hashes[use], owner[use]
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            # buckets are ranges of the hash, so each holds a slice
            bounds = np.searchsorted(hashes, (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64))
            edges = np.concatenate([[0], bounds, [len(hashes)]])
            out = [(b, base, 0, pack(hashes[x:y], owner[x:y])) for b, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if y > x]
            sig = np.frombuffer(sigs.tobytes(), np.uint64).reshape(-1, 2) if len(sigs) else np.zeros((0, 2), np.uint64)
            ids = column_of(rows, "id")
            real = np.asarray(ids.is_valid()).astype(np.uint8)
            out.append((int((base >> 36) + seen) % buckets, base, 1, pack(n.astype(np.int64), sig[:, 0].copy(), sig[:, 1].copy(), np.asarray(ids.fill_null(0)), np.asarray(column_of(rows, "h")), real)))
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "base", "kind", "data"), o)) for o in out], schema=_schema)

    _schema = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
    return run


def _frequencies(batches):
    """Reduce side of one bucket: postings of shingles in two sets or more go back to their blocks, with the frequency."""
    schema = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
    for (bucket,), rows in by_key(batches, "bucket"):
        out = [r for r in rows if r["kind"] == 1]
        lists = [(r["base"], *unpack(r["data"], np.uint64, np.uint32)) for r in rows if r["kind"] == 0]
        if lists:
            hashes = np.concatenate([h for _, h, _ in lists])
            block = np.repeat(np.arange(len(lists), dtype=np.int32), [len(h) for _, h, _ in lists])
            owner = np.concatenate([o for _, _, o in lists])
            order = np.argsort(hashes, kind="stable")
            new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
            rank = np.cumsum(new) - 1
            df = np.bincount(rank)
            shared = df[rank] > 1
            order, rank = order[shared], rank[shared]
            back = np.argsort(block[order], kind="stable")
            order, rank = order[back], rank[back]
            for a, b in runs(block[order]):
                data = pack(rank[a:b].astype(np.uint32), owner[order[a:b]], np.minimum(df[rank[a:b]], 65535).astype(np.uint16))
                out.append({"bucket": bucket, "base": lists[int(block[order[a]])][0], "kind": 0, "data": data})
        for at in range(0, len(out), 256):
            yield pa.RecordBatch.from_pylist(out[at : at + 256], schema=schema)


def _members(batches):
    """Ids' places: row key, set size, signature and id of every document."""
    for batch in batches:
        for base, data in zip(column_of(batch, "base").to_pylist(), column_of(batch, "data").to_pylist()):
            n, s1, s2, ids, h, real = unpack(data, *_MEMBER)
            columns = [pa.array(np.full(len(n), base)), pa.array(base + np.arange(len(n))), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(ids, mask=real == 0), pa.array(h)]
            yield pa.RecordBatch.from_arrays(columns, names=["base", "key", "n", "s1", "s2", "id", "h"])


def _shared_sets(batches):
    """One block: the sets that may link, with their shared shingles and the prefix of their index entries."""
    for (base,), rows in by_key(batches, "base"):
        n = unpack(next(r["data"] for r in rows if r["kind"] == 1), *_MEMBER)[0]
        heads = np.zeros(len(n), bool)
        heads[[r["bucket"] for r in rows if r["kind"] == 2]] = True
        tokens, owners, dfs = [], [], []
        for r in rows:
            if r["kind"] == 0:
                rank, owner, df = unpack(r["data"], np.uint32, np.uint32, np.uint16)
                tokens.append((np.int64(r["bucket"]) << 32) | rank.astype(np.int64))
                owners.append(owner)
                dfs.append(df)
        if not tokens:
            continue
        token, owner, df = np.concatenate(tokens), np.concatenate(owners), np.concatenate(dfs)
        c = np.bincount(owner, minlength=len(n))
        live = heads & (100 * c >= PERCENT * n) & (n > 0)
        use = live[owner]
        token, owner, df = token[use], owner[use], df[use]
        order = np.lexsort((token, df, owner))
        token, owner = token[order], owner[order]
        out = []
        for a, b in runs(owner):
            i = int(owner[a])
            alone = int(n[i]) - (b - a)
            prefix = int(n[i]) - least_overlap(int(n[i])) + 1 - alone
            if prefix > 0:
                own = np.sort(token[a:b])
                out.append({"key": int(base) + i, "n": int(n[i]), "c": b - a, "prefix": token[a : a + prefix].tolist(), "tokens": pack(np.diff(own, prepend=0))})
        for at in range(0, len(out), 2000):
            yield pa.RecordBatch.from_pylist(out[at : at + 2000], schema=pa.schema([("key", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())]))


def _overlaps(batches):
    """Exact overlap of each pair of packed shared sets."""
    for batch in batches:
        x, y = (column_of(batch, c).to_pylist() for c in ("tx", "ty"))
        last, set_y, o = None, None, np.zeros(len(x), np.int64)
        for i, (a, b) in enumerate(zip(x, y)):
            if b != last:
                last, set_y = b, np.cumsum(unpack(b, np.int64)[0])
            set_x = np.cumsum(unpack(a, np.int64)[0])
            at = np.minimum(np.searchsorted(set_y, set_x), len(set_y) - 1)
            o[i] = int((set_y[at] == set_x).sum())
        yield pa.RecordBatch.from_arrays([column_of(batch, "x"), column_of(batch, "y"), pa.array(o)], names=["x", "y", "o"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, o, linked) of candidate pairs (x, y)."""
    left = sets.select(F.col("key").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("key").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    joined = pairs.select("x", "y").join(left, "x").join(right, "y")
    measured = joined.select("x", "y", "tx", "ty").mapInArrow(_overlaps, "x bigint, y bigint, o bigint")
    sizes = sets.select("key", "n")
    sized = measured.join(sizes.select(F.col("key").alias("x"), F.col("n").alias("nx")), "x").join(sizes.select(F.col("key").alias("y"), F.col("n").alias("ny")), "y")
    return sized.select("x", "y", "o", (100 * F.col("o") >= PERCENT * (F.col("nx") + F.col("ny") - F.col("o"))).alias("linked"))


def _size_block(n):
    """Blocks of an index list: linked sets lie in the same block or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / PERCENT)) + 1e-9).cast("int")


def _packed_index(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, int]:
    """The written index: packed postings of shared shingles (kind 0) and packed members (kind 1) by block."""
    one = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.xxhash64(F.col(f"`{text_column}`")).alias("h"), F.col(f"`{text_column}`").alias("text"))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * one.rdd.getNumPartitions())
    blobs = one.mapInArrow(_index_blocks(buckets), _BLOB)
    return materialize(blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_frequencies, _BLOB)), buckets


def _candidates_by_leader(postings: DataFrame) -> DataFrame:
    """(x, y): each set with the leader of its lists that has the largest shared part."""
    fits = (100 * F.least("n", "lead.n") >= PERCENT * F.greatest("n", "lead.n")) & (F.col("lead.key") != F.col("key"))
    return postings.where(fits).groupBy("key").agg(F.max(F.struct("lead.part", "lead.key")).alias("best")).select(F.col("key").alias("x"), F.col("best.key").alias("y"))


def _candidates_between(postings: DataFrame, answers: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y) from lists that touch several components: not yet known, and not excluded by size, position or the leaders' answers."""
    known = answers.select(F.col("x").alias("key"), F.col("y").alias("leader"), "o")
    entries = (
        postings.select("token", "key", "n", "c", "pos")
        .join(labels.select(F.col("node").alias("key"), "root"), "key", "left")
        .join(known, "key", "left")
        .select("token", "key", "n", "c", "pos", F.coalesce("root", "key").alias("root"), F.coalesce("leader", "key").alias("leader"), F.coalesce("o", "c").alias("o"))
    )
    entries = materialize(entries)
    roots = entries.groupBy("token", "root").agg(F.count("*").alias("k"))
    main = roots.groupBy("token").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root")).alias("top")).where("roots > 1").select("token", F.col("top.root").alias("main"))
    lists = materialize(entries.join(main, "token"))
    block = lists.withColumn("block", _size_block(F.col("n")))
    probes = block.where("root <> main").withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    x, y = probes.alias("x"), block.alias("y")
    c = lambda side, name: F.col(f"{side}.{name}")
    total = c("x", "n") + c("y", "n")
    need = F.ceil(F.lit(PERCENT) * total / F.lit(100.0 + PERCENT) - 1e-9)
    room = 1 + F.least(c("x", "n") - 1 - c("x", "pos"), c("y", "n") - 1 - c("y", "pos"))
    bound = F.when(c("x", "leader") == c("y", "leader"), F.least(c("x", "o"), c("y", "o")) + F.least(c("x", "c") - c("x", "o"), c("y", "c") - c("y", "o"))).otherwise(F.least(c("x", "c"), c("y", "c")))
    met = x.join(y, (c("x", "token") == c("y", "token")) & (c("x", "block") == c("y", "block")))
    met = met.where(
        (c("x", "root") != c("y", "root"))
        & ((c("y", "root") == c("y", "main")) | (c("x", "key") < c("y", "key")))
        & (c("x", "leader") != c("y", "key"))
        & (c("y", "leader") != c("x", "key"))
        & (100 * F.least(c("x", "n"), c("y", "n")) >= PERCENT * F.greatest(c("x", "n"), c("y", "n")))
        & (F.least(c("x", "c"), c("y", "c")) >= need)
        & (room >= need)
        & (bound >= need)
    )
    return met.select(c("x", "key").alias("x"), c("y", "key").alias("y")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's id, n_shingles, component_id, class_id (its group of equal sets), class_size, and _h, the xxhash64 of its text.  The id is a whole number."""
    kind = docs.schema[id_column].dataType.simpleString()
    indexed, buckets = _packed_index(docs, id_column, text_column)
    members = materialize(indexed.where("kind = 1").mapInArrow(_members, "base bigint, key bigint, n bigint, s1 bigint, s2 bigint, id bigint, h bigint"))
    classes = materialize(members.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("key", "base")).alias("head"), F.min("id").alias("least_id"), F.count("*").alias("size")))
    heads = classes.select((F.col("head.key") - F.col("head.base")).cast("int").alias("bucket"), F.col("head.base").alias("base"), F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("data"))
    sets = indexed.unionByName(heads).repartition(buckets, "base").sortWithinPartitions("base").mapInArrow(_shared_sets, "key bigint, n bigint, c bigint, prefix array<bigint>, tokens binary")
    sets = materialize(sets)

    entries = sets.select("key", "n", "c", F.posexplode("prefix").alias("at", "token")).withColumn("pos", F.col("n") - F.col("c") + F.col("at"))
    lists = entries.groupBy("token").agg(F.count("*").alias("k"), F.max(F.struct((F.col("c") / F.col("n")).alias("part"), "key", "n")).alias("lead")).where("k > 1").drop("k")
    postings = materialize(entries.join(lists, "token").select("token", "key", "n", "c", "pos", "lead"))

    answers = materialize(verify(_candidates_by_leader(postings), sets))
    first = answers.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = connected_components(first)
    more = materialize(verify(_candidates_between(postings, answers, labels), sets)).where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    if not more.isEmpty():
        labels = connected_components(first.unionByName(more))

    rooted = classes.select("n", "s1", "s2", F.col("head.key").alias("node"), "least_id", "size").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("n", "s1", "s2", "root", "component_id", F.col("least_id").alias("class_id"), F.col("size").alias("class_size"))
    out = members.join(named, ["n", "s1", "s2"], "left")
    return out.select(
        F.col("id").cast(kind).alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).cast(kind).alias("component_id"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("class_id")).cast(kind).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.col("h").alias("_h"),
        F.coalesce("root", -1 - F.col("key")).alias("_group"),
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one of least id; rows without words stay."""
    found = near_duplicates(docs, id_column, text_column)
    rows = docs.select(whole_row(docs).alias("row"), column(id_column).alias("id"), F.xxhash64(column(text_column)).alias("h"), column(text_column).alias("text"))
    kept = found.groupBy("_group").agg(F.min(F.struct(column(id_column).isNull().alias("none"), column(id_column).alias("id"), F.col("_h").alias("h"))).alias("k")).select("k.id", "k.h").distinct()
    left = rows.alias("r").join(kept.alias("k"), F.col("r.id").eqNullSafe(F.col("k.id")) & F.col("r.h").eqNullSafe(F.col("k.h")), "left_semi")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = left.where(worded).dropDuplicates(["id", "h"])
    return once.unionByName(left.where(~worded)).select("row.*")
