"""Operator 9: line dedup by a log-template tree of fixed depth.

A line's tokens are its words; a token with a digit is a variable field and
becomes ``<*>``.  The tree's levels are the number of tokens and the leading
``DEPTH`` tokens.  A leaf has as many templates as its lines need: lines that
agree with a template at ``SIMILARITY`` of the places or more are its
instances, their other places being variable too, and lines that agree with
no template so far form further ones, the most frequent first.

A template recurs when its instances, taken together, lie in enough distinct
documents: two for 20 words or more, three for 3 words or more, ``MIN_DOCS``
for shorter lines, which meet by chance.  Its lines are dropped from every
document but the first (the least id), so that no passage is lost.

With ``copies`` a template is counted over classes of copies instead, so that a
text and its copies are left whole for a near-duplicate operator.  Lines of
``MIN_DOCS`` classes or more are dropped everywhere; below that the class of
least hash keeps them.  Equal texts are one class, and so
are texts linked by a 5-shingle Jaccard of ``COPY_JACCARD``, as estimated from
the ``SKETCH`` least hashes of both (exact for sets that small).  Candidates
are texts with two neighbouring hashes of the ``BANDS`` least in common, each
compared with one leader; only texts that hold a line of a recurring template
are sketched.

Null texts stay null and have no lines; lines without a word stay; equal rows
are treated alike; rows without an id are one document; rows that share an id
are one document with several texts; an empty table gives an empty one.  Ids
are whole numbers.  Ties between lines of equal frequency go by a hash.  Other
columns may have any name.  DataFrame functions only; joins are by shuffle at
every size, so that the plan does not change as the tables grow.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, SPACE_CLASS, column, discard, let, materialize, only, whole_row, with_text
from .components import connected_components
from .decontaminate import shingle_hashes

DEPTH = 3
SIMILARITY = 0.7
MIN_DOCS = 10
COPY_JACCARD = 0.75
SKETCH = 128
BANDS = 32
#: Least words of a line, and the documents (or classes of copies) that its template must lie in; shorter lines need MIN_DOCS.
LEAST_DOCS = ((20, 2), (3, 3))
FIELD = "<*>"
#: A leaf of at most so many lines and words finds its templates in one row.
LEAF_LINES = 4000
LEAF_WORDS = 1 << 19


def masked(lines: DataFrame) -> DataFrame:
    """``lines`` with _m for _line: words joined by one space, tokens with a digit as a field."""
    line = F.col("_line")
    # lines without a word go by the line as it was read: a filter on _m would be pushed below and mask every line again
    some = lines.where(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    # most lines stay as they are, which one look at their characters tells
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | line.rlike(r"[\x09-\x0D0-9]")
    spaced = F.trim(F.regexp_replace(line, SPACE_CLASS + "+", " "))
    return some.select("*", F.when(odd, F.regexp_replace(spaced, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(line).alias("_m")).drop("_line")



def keyed_lines(docs: DataFrame, id_column: str, text_column: str, copies: bool) -> DataFrame:
    """Every line with a word: _id, _t (its text's hash), _u (its unit), _pos, _m, _n words, _leaf, and _h, 60 bits of its MD5."""
    text = column(text_column)
    # hashed before the lines are dealt out, once a text
    texts = only(docs, *dict.fromkeys([id_column, text_column])).select(row_id(id_column).alias("_id"), F.xxhash64(text).alias("_t"), text.alias("_text"))
    rows = texts.select("_id", "_t", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    n = F.octet_length("_m") - F.octet_length(F.replace("_m", F.lit(" "), F.lit(""))) + 1
    lines = masked(rows).withColumn("_n", n.cast("int"))
    h = F.conv(F.substring(F.md5("_m"), 1, 15), 16, 10).cast("bigint")
    return lines.select(
        "_id", "_t", F.col("_t" if copies else "_id").alias("_u"), "_pos", "_n", F.xxhash64("_n", F.substring_index("_m", " ", DEPTH)).alias("_leaf"), h.alias("_h"), "_m"
    )


def row_id(id_column: str) -> Column:
    return F.coalesce(column(id_column).cast("bigint"), F.lit(NO_ID))


LINE = ["_leaf", "_h"]


def segments(words: Column, leaf: Column, differ: Column) -> Column:
    """Hashes of the ``differ`` + 1 segments of a line's words beyond the leading ones; one for the whole leaf if there are fewer words than that."""
    n = F.size(words)
    width = F.greatest(F.floor((n - DEPTH) / (differ + 1)), F.lit(1)).cast("int")
    # the last segment takes what is left over; each is cut from the words directly, a copy of them all a segment would cost their square
    segment = lambda i: F.xxhash64(leaf, i, F.slice(words, DEPTH + i * width + 1, F.when(i == differ, n).otherwise(width)))
    return F.when(n - DEPTH <= differ, F.array(F.xxhash64(leaf))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), differ), segment)))


def agree(w: Column, v: Column) -> Column:
    return F.size(F.filter(F.zip_with(w, v, lambda x, y: x == y), lambda x: x)) >= F.lit(SIMILARITY) * F.size(w) - 1e-9


def templates(keyed: DataFrame, variants: DataFrame, leaf_lines: int = LEAF_LINES, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """_leaf, _h and _template (a line's _h) of the lines that share a leaf with another line of another unit.

    Lines that agree differ in at most m places beyond the leading ones, so of
    m + 1 segments of those places one is equal.  In each round the lines that
    are the most frequent of all their segments are templates, every other
    line joins the most frequent of them that it agrees with, and the rest go
    on, until no segment is left that holds lines of two units.

    Leaves do not depend on each other.  One of at most ``leaf_lines`` lines
    and ``leaf_words`` words takes all its rounds in one row, since their
    number grows with the table; a larger one takes rounds of joins until what
    is left of it is that small.
    """
    across = (F.count("*") > 1) & (F.min("_lo") < F.max("_hi"))
    small = ((F.count("*") <= leaf_lines) & (F.sum(F.col("_n").cast("bigint")) <= leaf_words)).alias("_small")
    several = materialize(variants.where(F.col("_n") > DEPTH).groupBy("_leaf").agg(across.alias("_across"), small).where("_across").drop("_across"))
    open_ = materialize(variants.join(several.hint("merge"), "_leaf"))
    # each line's words are taken from one document; a line stands there more than once at times
    held = keyed.select(*LINE, F.col("_u").alias("_lo"), "_m").join(open_.hint("merge"), [*LINE, "_lo"]).dropDuplicates([*LINE, "_lo"])
    differ = F.col("_n") - F.ceil(F.lit(SIMILARITY) * F.col("_n") - 1e-9).cast("int")
    words = materialize(held.select(*LINE, "_n", "docs", "_lo", "_hi", F.split("_m", " ").alias("_w"), differ.alias("_differ"), "_small"))
    discard(several, open_)
    found, written = [], [words]
    large = lambda lines: lines.where("not _small").drop("_small")
    while not (texts := large(written[-1])).isEmpty():
        # a segment without lines of two units never has them again, so those of the lines that are left can be cut anew in each round
        cut = materialize(texts.select(*LINE, "_lo", "_hi", F.struct("docs", "_h").alias("_rank"), F.explode(segments(F.col("_w"), F.col("_leaf"), F.col("_differ"))).alias("_part")))
        leads = materialize(cut.groupBy("_part").agg(F.max("_rank").alias("_lead"), across.alias("_across")).where("_across").drop("_across"))
        met = materialize(cut.join(leads.hint("merge"), "_part").select(*LINE, "_rank", "_lead"))
        discard(cut, leads)
        heads = materialize(met.groupBy(*LINE).agg(F.min(F.col("_lead") == F.col("_rank")).alias("_first")).where("_first").select(*LINE))
        led = heads.select("_leaf", F.col("_h").alias("_l"))
        pairs = met.where("_lead <> _rank").select(*LINE, "_lead", F.col("_lead._h").alias("_l")).distinct().join(led.hint("merge"), ["_leaf", "_l"], "left_semi")
        fits = pairs.join(texts.select(*LINE, "_w").hint("merge"), LINE).join(texts.select("_leaf", F.col("_h").alias("_l"), F.col("_w").alias("_v")).hint("merge"), ["_leaf", "_l"])
        fits = materialize(fits.where(agree(F.col("_w"), F.col("_v"))).select(*LINE, "_lead"))
        joined = fits.groupBy(*LINE).agg(F.max("_lead").alias("_lead")).select(*LINE, F.col("_lead._h").alias("_template"))
        done = materialize(joined.unionByName(heads.select(*LINE, F.col("_h").alias("_template"))))
        discard(heads, fits)
        found.append(done)
        left = materialize(met.select(*LINE).distinct().join(done.hint("merge"), LINE, "left_anti"))
        discard(met)
        # only the words of lines that are still in question travel, fewer in each round
        texts = materialize(texts.join(left.hint("merge"), LINE, "left_semi"))
        discard(left)
        sizes = materialize(texts.groupBy("_leaf").agg(small))
        written.append(materialize(texts.join(sizes.hint("merge"), "_leaf")))
        discard(texts, sizes)
    ready = functools.reduce(DataFrame.unionByName, [lines.where("_small").drop("_small") for lines in written])
    found.append(materialize(templates_of_leaves(ready)))
    discard(*written)
    return functools.reduce(DataFrame.unionByName, found)


def templates_of_leaves(lines: DataFrame) -> DataFrame:
    """What the rounds of ``templates`` find, a leaf being one row; a line is its place in ``_s``, the most frequent first."""
    line = lambda i: F.get("_s", i)
    first, rest = lambda part: F.get(part, F.lit(0)), lambda part: F.slice(part, 2, F.size(part))
    # a line and its template in one number
    pair = lambda i, lead: F.shiftleft(i.cast("bigint"), 32).bitwiseOR(lead.cast("bigint"))
    of, lead = lambda p: F.shiftright(p, 32).cast("int"), lambda p: p.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")

    # whether each line is among some; looked up by place, as lines are asked for once a segment
    marks = lambda some: F.transform(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: F.array_contains(some, i))

    def across(parts: Column) -> Column:
        two = lambda p: F.array_min(F.transform(p, lambda i: line(i)["_lo"])) < F.array_max(F.transform(p, lambda i: line(i)["_hi"]))
        return F.filter(parts, lambda p: (F.size(p) > 1) & two(p))

    def parts(cut: Column) -> Column:
        """The lines of each segment, from (segment, line) in order."""
        starts = F.filter(F.sequence(F.lit(0), F.size(cut) - 1), lambda k: (k == 0) | (F.get(cut, k)["part"] != F.get(cut, k - 1)["part"]))
        return let(starts, lambda s: F.transform(s, lambda k, j: F.transform(F.slice(cut, k + 1, F.coalesce(F.get(s, j + 1), F.size(cut)) - k), lambda x: x["i"])))

    def go_on(state: Column, found: Column) -> Column:
        left = lambda done: F.transform(state["parts"], lambda p: F.filter(p, lambda i: ~F.get(done, i)))
        done = let(F.transform(found, of), marks)
        return F.struct(let(done, lambda done: across(left(done))).alias("parts"), F.concat(state["found"], found).alias("found"))

    def joins(state: Column, heads: Column) -> Column:
        """Each line that agrees with a head of one of its segments, with the most frequent of these."""
        led = let(marks(heads), lambda marks: F.filter(state["parts"], lambda p: F.get(marks, first(p))))
        met = F.array_distinct(F.flatten(F.transform(led, lambda p: F.transform(rest(p), lambda i: pair(i, first(p))))))
        fits = F.sort_array(F.filter(met, lambda p: agree(line(of(p))["_w"], line(lead(p))["_w"])))
        return let(fits, lambda f: F.filter(f, lambda p, k: (k == 0) | (of(p) != of(F.get(f, k - 1)))))

    def round_(state: Column) -> Column:
        heads = F.array_except(F.transform(state["parts"], first), F.flatten(F.transform(state["parts"], rest)))
        found = let(heads, lambda heads: F.concat(F.transform(heads, lambda i: pair(i, i)), joins(state, heads)))
        return let(found, lambda found: go_on(state, found))

    leaves = lines.groupBy("_leaf", "_differ").agg(F.sort_array(F.collect_list(F.struct("docs", "_h", "_lo", "_hi", "_w")), asc=False).alias("_s"))
    cut = F.transform("_s", lambda x, i: F.transform(segments(x["_w"], F.col("_leaf"), F.col("_differ")), lambda part: F.struct(part.alias("part"), i.alias("i"))))
    start = F.struct(across(let(F.sort_array(F.flatten(cut)), parts)).alias("parts"), F.array().cast("array<bigint>").alias("found"))
    # each round finds one template at least
    end = F.aggregate(F.sequence(F.lit(1), F.size("_s")), start, lambda state, _: F.when(F.size(state["parts"]) > 0, round_(state)).otherwise(state))
    found = leaves.select("_leaf", F.explode(F.transform(end["found"], lambda p: F.struct(line(of(p))["_h"].alias("_h"), line(lead(p))["_h"].alias("_template")))).alias("_f"))
    return found.select("_leaf", "_f._h", "_f._template")


def least_docs(n: Column, min_docs: int = MIN_DOCS) -> Column:
    """Documents, or classes of copies, that a template of ``n`` words must lie in."""
    out = F.lit(min_docs)
    for words, docs in reversed(LEAST_DOCS):
        out = F.when(n >= words, F.least(F.lit(docs), F.lit(min_docs))).otherwise(out)
    return out


def copy_classes(docs: DataFrame, texts: DataFrame, text_column: str = "text") -> DataFrame:
    """_u and _class of those of the ``texts`` (_u, a text's xxhash64) that are copies of another."""
    text = column(text_column)
    one = only(docs, text_column).select(F.xxhash64(text).alias("_u"), text.alias("_text")).join(texts.hint("merge"), "_u", "left_semi")
    sketch = F.slice(F.sort_array(F.array_distinct(shingle_hashes(F.col("_text")))), 1, SKETCH)
    # each text is sketched once; a filter on the sketch before it is written would be pushed below the join and sketch all documents
    written = materialize(one.dropDuplicates(["_u"]).select("_u", sketch.alias("_s")))
    least = written.where(F.size("_s") > 0)
    places = F.sequence(F.lit(0), F.least(F.size("_s"), F.lit(BANDS)) - 1)
    bands = materialize(least.select("_u", F.explode(F.transform(places, lambda i: F.xxhash64(F.get("_s", i), F.get("_s", i + 1)))).alias("_band")))
    leads = materialize(bands.groupBy("_band").agg(F.min("_u").alias("_lead"), F.count("*").alias("k")).where("k > 1").drop("k"))
    pairs = materialize(bands.join(leads.hint("merge"), "_band").where("_u <> _lead").select("_u", "_lead").distinct())
    discard(bands, leads)
    met = pairs.join(least.hint("merge"), "_u").join(least.select(F.col("_u").alias("_lead"), F.col("_s").alias("_r")).hint("merge"), "_lead")
    union = F.slice(F.sort_array(F.array_union("_s", "_r")), 1, SKETCH)
    alike = let(union, lambda u: F.size(F.array_intersect(F.array_intersect(u, F.col("_s")), F.col("_r"))) / F.size(u))
    edges = materialize(met.where(alike >= COPY_JACCARD).select(F.col("_u").alias("a"), F.col("_lead").alias("b")))
    discard(pairs, written)
    return connected_components(edges).select(F.col("node").alias("_u"), F.col("root").alias("_class"))


def recurring(keyed: DataFrame, docs: DataFrame, text_column: str, copies: bool, min_docs: int = MIN_DOCS) -> DataFrame:
    """_id, _t and _pos of the lines to drop."""
    pairs = materialize(keyed.select(*LINE, "_n", "_u").distinct())
    variants = materialize(pairs.groupBy(*LINE, "_n").agg(F.count("*").alias("docs"), F.min("_u").alias("_lo"), F.max("_u").alias("_hi")))
    shared = templates(keyed, variants)
    lines = materialize(variants.join(shared.hint("merge"), LINE, "left").select(*LINE, "_n", "docs", "_lo", "_hi", F.coalesce("_template", "_h").alias("_template")))
    discard(variants)
    # units are counted one by one only where the sum of the lines' counts leaves it open
    key, enough = ["_leaf", "_template"], least_docs(F.col("_n"), min_docs)
    sums = lines.groupBy(*key, "_n").agg(F.max("docs").alias("most"), F.sum("docs").alias("sum"), (F.min("_lo") < F.max("_hi")).alias("two"), F.min("_lo").alias("_first")).where(F.col("sum") >= enough)
    sums = materialize(sums.withColumn("sure", (F.col("most") >= enough) | ((enough <= 2) & F.col("two"))))
    unsure = lines.join(sums.where("not sure").select(*key).hint("merge"), key, "left_semi").select(*LINE, "_template")
    counted = pairs.select(*LINE, "_u").join(materialize(unsure).hint("merge"), LINE).select(*key, "_u").distinct().groupBy(*key).agg(F.count("*").alias("k"))
    kept = sums.where("sure").select(*key, "_n", "_first").unionByName(sums.where("not sure").join(counted.hint("merge"), key).where(F.col("k") >= enough).select(*key, "_n", "_first"))
    kept = materialize(kept)
    discard(sums)
    gone = materialize(lines.select(*LINE, "_template").join(kept.hint("merge"), key))
    discard(lines, kept)
    places = keyed.select("_id", "_t", "_u", "_pos", *LINE)
    if not copies:
        return places.join(gone.select(*LINE, "_first").hint("merge"), LINE).where("_u <> _first").select("_id", "_t", "_pos")
    held = materialize(pairs.select(*LINE, "_u").join(gone.hint("merge"), LINE).select(*key, "_n", "_u").distinct())
    classes = materialize(copy_classes(docs, held.select("_u").distinct(), text_column))
    held = materialize(held.join(classes.hint("merge"), "_u", "left").select(*key, "_n", F.coalesce("_class", "_u").alias("_class")).distinct())
    counts = held.groupBy(*key, "_n").agg(F.count("*").alias("k"), F.min("_class").alias("_first")).where(F.col("k") >= enough)
    firsts = materialize(counts.select(*key, F.when(F.col("k") < min_docs, F.col("_first")).alias("_first")))
    drop = materialize(gone.select(*LINE, "_template").join(firsts.hint("merge"), key).select(*LINE, "_first"))
    found = places.join(drop.hint("merge"), LINE).join(classes.hint("merge"), "_u", "left")
    return found.where(~F.coalesce("_class", "_u").eqNullSafe(F.col("_first"))).select("_id", "_t", "_pos")


def drop_recurring_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = MIN_DOCS, copies: bool = False) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, recurring lines gone from the text), n_lines and n_removed of each row."""
    # written with the masked text: its column is read again only for leaves of several lines
    keyed = materialize(keyed_lines(docs, id_column, text_column, copies))
    places = recurring(keyed, docs, text_column, copies, min_docs).groupBy("_id", "_t").agg(F.collect_set("_pos").alias("_places"))
    text = column(text_column)
    rows = docs.select(whole_row(docs).alias("row"), text.alias("_text"), row_id(id_column).alias("_id"), F.xxhash64(text).alias("_t"))
    joined = rows.join(places.hint("shuffle_hash"), ["_id", "_t"], "left")
    # split once a text: inside the lambda it would be split anew for every line that stays
    kept = let(F.split("_text", "\n"), lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_places")), lambda i: F.get(lines, i)))
    text_left = F.when(F.col("_places").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("_places").isNull(), 0).otherwise(F.size("_places")).cast("bigint")
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    return joined.select(with_text(docs, text_column, text_left).alias("row"), n_lines.alias("n_lines"), removed.alias("n_removed"))
