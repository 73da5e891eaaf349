"""One query for each operator, with production parameters over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecube.llm.collocations import collocations
from tidecube.llm.common import table, written
from tidecube.llm.decontaminate import find_copies
from tidecube.llm.hash_search import nearest
from tidecube.llm.html_extract import extract_articles
from tidecube.llm.ngram_join import link_ngrams
from tidecube.llm.packing import pack
from tidecube.llm.pii import find_pii, joined
from tidecube.llm.preferences import format_preferences, neighbours
from tidecube.llm.prefix_trie import prefix_trie, turn_labels
from tidecube.llm.quality_rules import judge_quality
from tidecube.llm.suffix_dedup import remove_repeats
from tidecube.llm.token_files import new_folder, read_records, write_records
from tidecube.llm.url_filters import Rule, filter_urls

URL_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    out = format_preferences(turns, neighbours(turns))
    return out.withColumns({c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))) for c in ("chosen_spans", "rejected_spans")})


OP2_SQL = r"""
WITH c AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.turns AS a, b.turns AS b,
             len(list_filter(generate_series(1, least(len(a.turns), len(b.turns))), lambda i: a.turns[1:i] = b.turns[1:i])) AS n_prefix
      FROM c a JOIN c b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0),
r AS (SELECT *, a[n_prefix + 1:] AS ca, b[n_prefix + 1:] AS cb FROM p),
s AS (SELECT chosen_id, rejected_id, n_prefix,
  array_to_string(list_transform(a[1:n_prefix], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS prompt,
  array_to_string(list_transform(ca, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS chosen,
  array_to_string(list_transform(cb, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS rejected,
  ca, cb FROM r)
SELECT chosen_id, rejected_id, n_prefix, prompt, chosen, rejected,
  coalesce(array_to_string(list_transform(list_filter(generate_series(1, len(ca)), lambda i: ca[i].role = 'assistant'),
    lambda i: (coalesce(list_sum(list_transform(ca[1:i-1], lambda t: length(t.role) + length(t.text) + 13)), 0) + length(ca[i].role) + 5)::BIGINT || ':' ||
         (coalesce(list_sum(list_transform(ca[1:i-1], lambda t: length(t.role) + length(t.text) + 13)), 0) + length(ca[i].role) + 5 + length(ca[i].text) + 7)::BIGINT), ','), '') AS chosen_spans,
  coalesce(array_to_string(list_transform(list_filter(generate_series(1, len(cb)), lambda i: cb[i].role = 'assistant'),
    lambda i: (coalesce(list_sum(list_transform(cb[1:i-1], lambda t: length(t.role) + length(t.text) + 13)), 0) + length(cb[i].role) + 5)::BIGINT || ':' ||
         (coalesce(list_sum(list_transform(cb[1:i-1], lambda t: length(t.role) + length(t.text) + 13)), 0) + length(cb[i].role) + 5 + length(cb[i].text) + 7)::BIGINT), ','), '') AS rejected_spans
FROM s
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _rules = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_ngrams(table(spark, sf_dir, "documents"))


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    flat, ends = np.asarray(ids.values).astype("<u4"), np.asarray(ids.offsets)
    return pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], pa.int64())


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_records(table(spark, sf_dir, "documents"), new_folder(spark), end_id=2, special=True)
    return read_records(spark, manifest, binary=True).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


def pii_digest(found: DataFrame) -> DataFrame:
    """n_email, n_ip, n_card, n_phone and base_sha256 are of base spans alone; spans has the added ones as well."""
    base = F.filter("spans", lambda x: x["base"])
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rows = found.select("doc_id", "spans", base.alias("base"))
    return rows.select("doc_id", number("email"), number("ip"), number("card"), number("phone"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), end_id=0, special=True, binary=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("component")


OP10_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
j AS (
  SELECT u.*, (SELECT max_by(struct_pack(rule := rhost || rpath, verdict := r.verdict), length(rhost || rpath))
               FROM r WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)) AS m
  FROM u)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM j
"""


def rebuilt(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """labels of each conversation c of ids: the first h turns of conversation c - c % 5, then c's own after its first h, with
    h = crc32(c) % 9."""
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    cols = ["conv_id", "pos", "a", "b", "n_bytes"]
    own = labels.where((F.col("conv_id") % 5 == 0) | (F.col("pos") > h)).select(*cols)
    heads = labels.where("pos <= 8").withColumnRenamed("conv_id", "base")
    others = ids.where("conv_id % 5 <> 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.alias("h"))
    return own.unionByName(others.join(heads, "base").where("pos <= h").select(*cols))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    labels, ids = written(turn_labels(conversations), "labels"), conversations.select("conv_id").where("conv_id is not null").distinct()
    return prefix_trie(rebuilt(labels, ids), ids)


OP11_SQL = r"""
WITH c AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda s, x:
        list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384)), 4294967295), 4294967295) % 9 AS h FROM c),
r AS (SELECT h.conv_id, CASE WHEN h.conv_id % 5 = 0 THEN h.turns ELSE list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) END AS turns
      FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(turns) AS length, unnest(generate_series(0, len(turns))) AS depth, turns FROM r),
n AS (SELECT min(conv_id) AS conv_id, depth, turns[1:depth] AS path, count(*) AS n_convs, max(CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(turns[depth].text)) END) AS size,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
      FROM p GROUP BY depth, turns[1:depth]),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
full_n AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
up AS (SELECT unnest(list_transform(generate_series(0, depth), lambda d: path[1:d])) AS path, n_children, n_convs, size FROM full_n),
sums AS (SELECT path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM up GROUP BY path)
SELECT a.conv_id, a.depth::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children::BIGINT AS n_children, s.n_leaves, s.saved_tokens, a.ends_sha256
FROM full_n a JOIN sums s USING (path) LEFT JOIN full_n b ON a.depth = b.depth + 1 AND b.path = a.path[1:a.depth - 1]
"""


def op12_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT c.*, unnest(generate_series(1, k - 1)) AS cut FROM c),
s AS (SELECT t.lang, t.k, t.phrase, t.a, t.ws, t.cut, x.a AS l, y.a AS r, (2000000::HUGEINT * t.a) // (x.a::HUGEINT + y.a) AS score
      FROM cuts t JOIN f x ON x.lang = t.lang AND x.phrase = array_to_string(t.ws[1:t.cut], ' ')
                  JOIN f y ON y.lang = t.lang AND y.phrase = array_to_string(t.ws[t.cut + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (SELECT lang, a, unnest(flatten(list_transform(generate_series(2, k - 1), lambda m: list_transform(generate_series(1, k - m + 1), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase
          FROM c WHERE k > 2),
most AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score::BIGINT AS score
FROM best b JOIN n USING (lang) LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase
WHERE NOT coalesce(100::HUGEINT * m.most >= 80::HUGEINT * b.a, false)
QUALIFY rank <= 2000
"""


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_preferences": op2_preferences,
        "op3_decontamination": op3_decontamination,
        "op4_quality_rules": op4_quality_rules,
        "op5_html_extraction": op5_html_extraction,
        "op6_ngram_join": op6_ngram_join,
        "op7_token_files": op7_token_files,
        "op8_pii": op8_pii,
        "op9_packing": op9_packing,
        "op10_url_filters": op10_url_filters,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_hash_search": op12_hash_search,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    # The SQL of op10 holds while no page carries a canonical link or a refresh, as in these tables.
    return {"op2_preferences": OP2_SQL, "op10_url_filters": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_collocations": OP13_SQL}
