"""The registered queries of the training-data operators, and their SQL.

Each query applies its operator, with production parameters, to the whole of
its tables and returns the digest columns of its contract.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, huffman, jaccard, lines, maintenance, mixing, packing, pii, quality, substrings, tokens, toxicity
from .common import shared_dir, table

#: The key of the registered query only; a caller gives its own.
DEMO_KEY = b"cubeloom demonstration key"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("row.doc_id", (toxicity.fold_of(F.col("row.doc_id")) == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymize(table(spark, sf_dir, "documents"), DEMO_KEY)
    return found.select("doc_id", "text", "n_found", F.array_join(F.array_sort(F.transform("spans", lambda s: s["kind"])), ",").alias("kinds"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "n_lines", "n_removed", F.sha2("row.text", 256).alias("kept_sha256"))


def op10_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/cubeloom-store-{uuid.uuid4().hex}"
    huffman.write_store(table(spark, sf_dir, "documents"), out, tokenizer_path("word_bpe_49k.json"))
    return huffman.read_store(spark, out)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_view_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    cents = lambda c: F.floor(100 * F.col(c) + 0.5)
    named = lambda prefix, *ids: maintenance.intervals(F.concat(F.lit(prefix), *ids))
    regions = read("nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_regionkey").alias("region"))
    lines = read("sale_lines").dropna(subset=["sale_id", "vendor_id", "amount"]).select(
        "sale_id", "vendor_id", "item_id", (cents("amount") * (100 - cents("discount"))).alias("revenue"),
        *named("l", F.col("sale_id").cast("string"), F.lit(":"), F.col("line_no").cast("string")),
    )
    sales = read("sales").dropna(subset=["sale_id", "client_id", "sold_at"]).select("sale_id", "client_id", F.unix_date(F.to_date("sold_at")).cast("long").alias("part"), *named("s", F.col("sale_id").cast("string")))
    clients = read("clients").dropna(subset=["client_id"]).join(regions, "nation_id").select("client_id", "region", *named("c", F.col("client_id").cast("string")))
    vendors = read("vendors").dropna(subset=["vendor_id"]).join(regions, "nation_id").select("vendor_id", "region")
    return maintenance.maintain(lines, sales, clients, vendors)


_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(source: str, key: str) -> str:
    """Distinct shingles of each row of a table, as text."""
    words = _WORDS.format(text=_LOWER.format(text="text"))
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [chr(10) || array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT {key}, {words} AS w FROM {source} WHERE text IS NOT NULL)"""


OP6_SQL = f"""
WITH d AS ({_shingles("documents", "doc_id")}), b AS ({_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY 1),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_shared FROM shared JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_shingles
"""

def _template_rounds(rounds: int) -> str:
    """The rounds in which lines find their template, written out; none is left to find after so many on the tables of the SQL check."""
    out = []
    for k in range(rounds):
        out.append(f"""
leads{k} AS MATERIALIZED (SELECT part, max((docs, h)) AS lead FROM s{k} GROUP BY 1 HAVING count(*) > 1 AND min(lo) < max(hi)),
met{k} AS MATERIALIZED (SELECT s{k}.*, lead FROM s{k} JOIN leads{k} USING (part)),
heads{k} AS MATERIALIZED (SELECT leaf, h FROM met{k} GROUP BY 1, 2 HAVING bool_and(lead = (docs, h))),
pairs{k} AS (SELECT DISTINCT a.leaf, a.h, a.lead, b.h AS l FROM met{k} a JOIN heads{k} b ON a.leaf = b.leaf AND a.lead[2] = b.h WHERE a.h <> b.h),
fits{k} AS (SELECT p.leaf, p.h, p.lead FROM pairs{k} p JOIN open x ON x.leaf = p.leaf AND x.h = p.h JOIN open y ON y.leaf = p.leaf AND y.h = p.l
  WHERE len(list_filter(range(1, len(x.t) + 1), lambda i: x.t[i] = y.t[i])) >= {lines.SIMILARITY} * len(x.t) - 1e-9),
done{k} AS MATERIALIZED (SELECT leaf, h, max(lead)[2] AS template FROM fits{k} GROUP BY 1, 2 UNION ALL SELECT leaf, h, h FROM heads{k}),
s{k + 1} AS MATERIALIZED (SELECT part, leaf, h, docs, lo, hi FROM met{k} ANTI JOIN done{k} USING (leaf, h)),""")
    return "".join(out) + "\nfound AS (" + " UNION ALL ".join(f"SELECT * FROM done{k}" for k in range(rounds)) + ")"


_NEED = f"CASE {' '.join(f'WHEN n >= {words} THEN {docs}' for words, docs in lines.LEAST_DOCS)} ELSE {lines.MIN_DOCS} END"

OP9_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
m0 AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS p FROM l),
m AS (SELECT doc_id, pos, regexp_replace(p, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM m0 WHERE p <> ''),
k AS (SELECT doc_id, pos, string_split(m, ' ') AS t, len(string_split(m, ' ')) AS n, ('0x' || md5(m)[1:15])::BIGINT AS h FROM m),
leafed AS MATERIALIZED (SELECT *, concat(n, ' ', array_to_string(t[1:{lines.DEPTH}], ' ')) AS leaf FROM k),
variants AS MATERIALIZED (SELECT leaf, h, n, any_value(t) AS t, count(DISTINCT doc_id) AS docs, min(doc_id) AS lo, max(doc_id) AS hi FROM leafed GROUP BY 1, 2, 3),
open AS MATERIALIZED (SELECT *, (n - ceil({lines.SIMILARITY} * n - 1e-9))::INT AS differ FROM variants
  WHERE n > {lines.DEPTH} AND leaf IN (SELECT leaf FROM variants GROUP BY 1 HAVING count(*) > 1 AND min(lo) < max(hi))),
wide AS (SELECT *, greatest(floor((n - {lines.DEPTH}) / (differ + 1)), 1)::INT AS width FROM open),
s0 AS MATERIALIZED (SELECT unnest(list_distinct(CASE WHEN n - {lines.DEPTH} <= differ THEN [leaf] ELSE list_transform(range(0, differ + 1),
    lambda i: concat(leaf, chr(10), i, chr(10), array_to_string(t[{lines.DEPTH} + i * width + 1:CASE WHEN i = differ THEN n ELSE {lines.DEPTH} + (i + 1) * width END], ' '))) END)) AS part, leaf, h, docs, lo, hi FROM wide),
{_template_rounds(8)},
named AS (SELECT l.doc_id, l.pos, l.n, l.leaf, coalesce(template, l.h) AS template FROM leafed l LEFT JOIN found USING (leaf, h)),
counted AS (SELECT leaf, template, min(doc_id) AS lead FROM named GROUP BY leaf, template, n HAVING count(DISTINCT doc_id) >= {_NEED}),
per_doc AS (SELECT doc_id, list(pos) AS places FROM named JOIN counted USING (leaf, template) WHERE doc_id <> lead GROUP BY 1)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN places IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(places, i)), lambda i: string_split(text, chr(10))[i]), chr(10)) END) AS kept_sha256
FROM documents LEFT JOIN per_doc USING (doc_id)
"""


OP7_SQL = f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
keyed AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM win),
again AS (SELECT s FROM keyed GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i + k AS p FROM keyed SEMI JOIN again USING (s), range(0, 35) AS r(k)),
places AS (SELECT doc_id, p FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT * FROM places ANTI JOIN hit USING (doc_id, p)) JOIN w USING (doc_id) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = f"""
WITH RECURSIVE s AS MATERIALIZED ({_shingles("documents", "doc_id")}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 75 * (nx.n + ny.n - o)),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1) USING (doc_id)
"""


OP11_SQL = rf"""
WITH d AS MATERIALIZED (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, {_LOWER.format(text="coalesce(text, '')")} AS text FROM documents),
t AS MATERIALIZED (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
v AS MATERIALIZED (SELECT lang, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1) USING (lang)),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
n AS MATERIALIZED (SELECT lang, source, coalesce(n, 0) AS n FROM g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2) USING (lang, source)),
p AS MATERIALIZED (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (n.n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 2)) // (v.n + 2 * v.v) AS q
  FROM n JOIN v USING (lang) JOIN kept k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every QUALIFY part = 'pair' OR rank <= {divergence.TOP}
"""

_UNIT = mixing.UNIT

OP12_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY 1),
x AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::HUGEINT AS left_size, (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::HUGEINT AS left_w
  FROM s WINDOW before AS (ORDER BY source_size * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, 3 * source_size * left_w <= w * left_size AS capped FROM x),
z AS (SELECT y.*, l.left_size AS a, l.left_w AS b FROM y LEFT JOIN (SELECT left_size, left_w FROM y WHERE NOT capped ORDER BY left_w DESC LIMIT 1) l ON true),
p AS MATERIALIZED (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (w * a)::DOUBLE / b::DOUBLE END AS target,
  CASE WHEN capped THEN 3 * {_UNIT}::HUGEINT ELSE (w * {_UNIT}::HUGEINT * a) // (b * source_size) END AS copies, ('0x' || md5('mix:' || coalesce(source, chr(10)))[1:7])::BIGINT * 8 AS shift FROM z),
i AS (SELECT d.*, source_size, target, copies, shift, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS i FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * ((shift + (i + 1) * copies) // {_UNIT} - (shift + i * copies) // {_UNIT}))::BIGINT AS taken FROM i
"""


def _born_and_dead(name: str) -> str:
    shift = "lambda u, k: CASE WHEN u % 2 = 1 THEN xor(3988292384, u >> 1) ELSE u >> 1 END"
    h = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({name}, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), {shift}))"
    return f"(SELECT CASE WHEN h % 7 < (h // 7) % 7 THEN [h % 7, (h // 7) % 7] ELSE [-1, 7] END FROM (SELECT xor({h}, 4294967295) AS h))"


OP13_SQL = f"""
WITH c AS MATERIALIZED (SELECT client_id, n_regionkey AS region, {_born_and_dead("concat('c', client_id)")} AS life FROM clients JOIN nation ON nation_id = n_nationkey WHERE client_id IS NOT NULL AND n_regionkey IS NOT NULL),
s AS MATERIALIZED (SELECT sale_id, client_id, (sold_at::DATE - DATE '1970-01-01')::BIGINT AS part, {_born_and_dead("concat('s', sale_id)")} AS life FROM sales WHERE sold_at IS NOT NULL AND sale_id IS NOT NULL),
l AS MATERIALIZED (SELECT sale_id, vendor_id, item_id, floor(100 * amount + 0.5)::BIGINT * (100 - floor(100 * discount + 0.5)::BIGINT) AS revenue, CASE WHEN line_no IS NULL THEN [-1, 7] ELSE {_born_and_dead("concat('l', sale_id, ':', line_no)")} END AS life FROM sale_lines WHERE amount IS NOT NULL AND sale_id IS NOT NULL),
v AS (SELECT vendor_id, n_regionkey AS region FROM vendors JOIN nation ON nation_id = n_nationkey),
j AS MATERIALIZED (SELECT region, part, client_id, item_id, revenue, greatest(c.life[1], s.life[1], l.life[1]) AS born, least(c.life[2], s.life[2], l.life[2]) AS dead FROM l JOIN s USING (sale_id) JOIN c USING (client_id) JOIN v USING (vendor_id, region))
SELECT b::INT AS batch, region, part, count(*) AS n_lines, sum(revenue)::BIGINT AS revenue, min(revenue) AS min_revenue, count(DISTINCT client_id) AS n_clients, count(DISTINCT item_id) AS n_items
FROM j JOIN range(7) r(b) ON born <= b AND b < dead GROUP BY 1, 2, 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op8_ngram_jaccard": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_mix_sources": OP12_SQL, "op13_view_maintenance": OP13_SQL}
