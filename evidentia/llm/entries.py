"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import chat, flatgraph, htmltext, langid, mips, mixing, negatives, pieces, quality, secrets, simhash, substring, trie
from evidentia.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("policy")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mips.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.near_duplicates(table(spark, sf_dir, "embeddings"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy decides, from the failure bits of all documents."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that the fixed patterns give."""
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def source_mix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected tokens of each domain after the mix of op8, against its targets."""
    _, _, found = mixing.solved(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mixing.WEIGHTS, 1.0, mixing.MAX_RATE)
    return found.report(spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_quality_rules, op3_exact_top_k, op4_sentencepiece, op5_substring_dedup, op6_secret_scan, op7_chat_format, op8_source_mixing, op9_language_id, op10_html_extraction, op11_hard_negatives, op12_prefix_trie, op13_embedding_near_dedup, quality_ablations, secret_base_spans, source_mix_totals)}


def oracle_sql() -> dict[str, str]:
    parts = []
    for p in quality.POLICIES.values():
        parts += [f"SELECT '{p.version}' AS policy, '{r}' AS rule, count(*) FILTER (failed & {p.mask} <> 0) AS n_rejected, count(*) FILTER (failed & {quality.BIT[r]} <> 0) AS n_failing, count(*) FILTER (failed & {p.mask} = {quality.BIT[r]}) AS n_by_it_alone FROM ledger" for r in p.rules]
    return {"op2_quality_rules": OP2_SQL, "op3_exact_top_k": OP3_SQL, "op5_substring_dedup": OP5_SQL, "op7_chat_format": OP7_SQL, "secret_base_spans": SECRET_BASE_SQL, "op11_hard_negatives": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_embedding_near_dedup": OP13_SQL, "quality_ablations": f"WITH ledger AS ({OP2_SQL})\n" + "\nUNION ALL ".join(parts)}


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS c FROM p WHERE i + 4 <= len(w)),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest(range(5)) AS k) WHERE c > 1 GROUP BY r),
s AS (SELECT r, w[i] AS x, i - row_number() OVER (PARTITION BY r, w[i] ORDER BY i) AS island FROM p),
m AS (SELECT r, max(n) AS max_run FROM (SELECT r, x, island, count(*) AS n FROM s GROUP BY r, x, island) GROUP BY r),
a AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(text, '\p{Lu}')) AS n_upper,
             len(regexp_extract_all(text, '\p{L}')) AS n_letters, len(list_filter(w, lambda x: x = '|')) AS n_bars, coalesce(max_run, 0) AS max_run
      FROM w LEFT JOIN c USING (r) LEFT JOIN m USING (r)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
             CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN n_letters >= 40 AND 10 * n_upper > 7 * n_letters THEN 8 ELSE 0 END
             + CASE WHEN 10 * n_bars > 3 * n_words THEN 16 ELSE 0 END + CASE WHEN max_run >= 10 THEN 32 ELSE 0 END
             + CASE WHEN n_lines >= 8 AND 2 * n_dup_lines > n_lines THEN 64 ELSE 0 END
             + CASE WHEN n_words > 0 AND (word_chars > 25 * n_words OR word_chars < 2 * n_words) THEN 128 ELSE 0 END AS failed FROM a)
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars, cast(n_symbols AS bigint) AS n_symbols,
       cast(n_dup_lines AS bigint) AS n_dup_lines, cast(n_repeat_words AS bigint) AS n_repeat_words, base_failed, failed = 0 AS kept, cast(failed AS bigint) AS failed
FROM f
"""

OP3_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding::double[], lambda x: floor(256 * x)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) AS score FROM (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 50 = 0) q JOIN e ON e.vec_id <> q.vec_id AND len(e.v) = len(q.v))
SELECT query_id, cast(rank AS int) AS rank, vec_id, cast(score AS bigint) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (SELECT r, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END AS k FROM p),
c AS (SELECT r, i, word, coalesce(k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1, false) AS again FROM x),
g AS (SELECT r, i, word, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
t AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""

OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, i, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, role)),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?(?:INST|SYS|ROLE)\]|\[/TURN\]')) AS n, length(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?(?:INST|SYS|ROLE)\]|\[/TURN\]')) AS m FROM t)
SELECT conv_id, cast(count(*) AS bigint) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       cast(3 + sum(CASE role WHEN 'user' THEN n + 15 WHEN 'assistant' THEN n + 4 WHEN 'system' THEN n + 11 ELSE m + n + 20 END) AS bigint) AS formatted_chars FROM e GROUP BY conv_id
"""

_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRET_BASE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, 'assign' AS kind, 1 AS k, regexp_extract_all(t, '{_ASSIGN}') AS m, string_split_regex(t, '{_ASSIGN}') AS p FROM d
      UNION ALL SELECT r, 'access', 2, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
      UNION ALL SELECT r, 'hex', 3, regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d),
s AS (SELECT r, kind, k, m, p, unnest(range(1, len(m) + 1)) AS i FROM m),
a AS (SELECT r, kind, k, m[i] AS x, cast(list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS bigint) AS b FROM s
      WHERE CASE k WHEN 1 THEN length(regexp_extract(m[i], '{_ASSIGN}', 1)) >= 12 WHEN 2 THEN length(m[i]) >= 18 ELSE length(m[i]) >= 16 END),
g AS (SELECT r, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3, string_agg(concat(kind, ':', b, ':', b + length(x)), ',' ORDER BY b, k) AS spans FROM a GROUP BY r)
SELECT doc_id, coalesce(n1, 0) AS n_assign, coalesce(n2, 0) AS n_access, coalesce(n3, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)
"""

OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::double[], lambda x: floor(256 * x)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, cast(list_dot_product(a.v, e.v) AS bigint) AS score
      FROM (SELECT DISTINCT vec_id, label, v FROM e WHERE vec_id % 100 = 0) a JOIN e ON e.vec_id <> a.vec_id AND len(e.v) = len(a.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, cast(rank AS int) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

#: CRC-32 of the decimal digits: a step of eight shifts for each digit.
OP12_SQL = """
WITH t AS (SELECT conv_id, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS content, strlen(coalesce(text, '')) AS bytes,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS donor,
             xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
                             lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384::bigint))), 4294967295::bigint) % 9 AS h FROM n),
p AS (SELECT c.conv_id, donor, h, least(h, coalesce(n.n, 0)) AS taken FROM c LEFT JOIN n ON n.conv_id = c.donor),
r AS (SELECT p.conv_id, k AS depth, content, bytes FROM p JOIN t ON t.conv_id = p.donor AND k <= taken
      UNION ALL SELECT p.conv_id, k - h + taken, content, bytes FROM p JOIN t ON t.conv_id = p.conv_id AND k > h),
x AS (SELECT conv_id, depth, bytes, string_agg(content, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, string_agg(content, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM r
      UNION ALL SELECT conv_id, 0, 0, '', NULL FROM n),
m AS (SELECT *, min(conv_id) OVER (PARTITION BY prefix) AS node, max(depth) OVER (PARTITION BY conv_id) AS length FROM x),
g AS (SELECT depth, prefix, min(conv_id) AS conv_id, any_value(above) AS above, any_value(bytes) AS bytes, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256 FROM m GROUP BY depth, prefix),
k AS (SELECT coalesce(above, '') AS prefix, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (prefix)),
s AS (SELECT m.node AS conv_id, m.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
      FROM f JOIN m ON m.conv_id = f.conv_id AND m.depth <= f.depth GROUP BY m.node, m.depth)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, cast(n_leaves AS bigint) AS n_leaves, cast(saved_tokens AS bigint) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.conv_id = f.conv_id AND s.depth = f.depth LEFT JOIN f u ON f.depth > 0 AND u.prefix = coalesce(f.above, '')
"""

OP13_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, embedding::double[] AS v FROM embeddings),
g AS (SELECT * FROM e WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
w AS (SELECT r AS a, r AS b FROM e UNION SELECT w.a, l.b FROM w JOIN l ON l.a = w.b),
c AS (SELECT w.a AS r, min(e.vec_id) AS component_id FROM w JOIN e ON e.r = w.b GROUP BY w.a),
n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, cast(coalesce(n_links, 0) AS bigint) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM e JOIN c USING (r) LEFT JOIN n USING (r)
"""
