"""The queries opN_<name> over whole tables with production parameters, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from commitlens.llm import url_filters
from commitlens.llm.common import table
from commitlens.llm.conversation_repair import damaged, repair
from commitlens.llm.decontamination import contamination
from commitlens.llm.exact_dedup import exact_dedup
from commitlens.llm.html_extraction import extract_articles
from commitlens.llm.line_dedup import line_dedup
from commitlens.llm.lm_scoring import score_texts
from commitlens.llm.mixing import mix
from commitlens.llm.ngram_join import ngram_components
from commitlens.llm.sharding import SHARD_BYTES, shard_assignments
from commitlens.llm.spelling_variants import spelling_variants
from commitlens.llm.token_counts import token_counts
from commitlens.llm.toxicity import toxicity_scores, train


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_assignments(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.train(url_filters.labelled_urls(spark))).drop("score")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_line_dedup, op3_html_extraction, op4_toxicity, op5_lm_scoring, op6_token_counts, op7_ngram_jaccard_join, op8_mixing, op9_exact_dedup, op10_sharding, op11_spelling_variants, op12_url_filters, op13_conversation_repair)}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, p FROM (
  SELECT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0))),
lens AS (SELECT DISTINCT k FROM win),
spot AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens)),
hit AS (SELECT doc_id, i, spot.k, item_id FROM spot JOIN win ON spot.p = win.p AND spot.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP9_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, row_number() OVER w = 1 AS kept, s AS text_sha256
FROM t WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)"""

OP10_SQL = f"""
WITH r AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h, coalesce(strlen(text), 0) AS b FROM documents),
l AS (SELECT doc_id, h, b, d, h // (1::BIGINT << (60 - d)) AS p FROM r, (SELECT unnest(range(0, 25)) AS d)),
s AS (SELECT d, p, sum(b) AS sb FROM l GROUP BY ALL HAVING sum(b) <= {SHARD_BYTES} OR count(*) = 1),
f AS (SELECT l.doc_id, l.h, l.b, min(l.d) AS depth, arg_min(sb, l.d) AS sb FROM l JOIN s ON l.d = s.d AND l.p = s.p GROUP BY ALL)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(h), 60, '0'), 1, depth) END AS shard, CAST(depth AS INT) AS depth, CAST(b AS BIGINT) AS n_bytes, CAST(sb AS BIGINT) AS shard_bytes FROM f"""


#: CRC-32 in SQL: its table by the rule of the polynomial, and a fold over the bytes of a text.
CRC_TABLE = "t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"
CRC = "xor(list_reduce(list_concat([4294967295], {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
BYTES = "list_transform(range(1, length({hex}), 2), lambda i: CAST('0x' || substr({hex}, i, 2) AS BIGINT))"

OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
r AS (SELECT doc, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM o GROUP BY 1, 2),
x AS (SELECT w, k, hex(encode(doc || ':' || w)) AS hx FROM r),
c AS (SELECT w, k, {CRC.format(bytes=BYTES.format(hex="hx"))} AS h FROM x, t),
d AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS w, k FROM c),
v AS (SELECT w AS word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(w) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
g AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT x.word, y.word AS other FROM g x JOIN g y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word UNION SELECT g.word, v.word FROM g JOIN v ON g.a || g.b = v.word UNION SELECT v.word, g.word FROM g JOIN v ON g.a || g.b = v.word),
m AS (SELECT e.word, count(*) AS n_near, min({{'n': -y.n, 'w': y.word}}) AS best FROM e JOIN v y ON e.other = y.word GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 5 * v.n THEN best.w END AS form, CASE WHEN -best.n >= 5 * v.n THEN -best.n END AS form_n FROM v LEFT JOIN m USING (word)),
up AS (SELECT word, word AS at, form AS nxt FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON up.nxt = f.word)
SELECT f.word, f.n, f.form, up.at AS root, f.n_near, f.form_n FROM f JOIN up ON f.word = up.word AND up.nxt IS NULL"""

STEP = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {0: "CASE i WHEN 's' THEN s1 WHEN 'u' THEN s2 END", 1: "CASE i WHEN 'u' THEN s2 END", 2: "CASE i WHEN 'a' THEN s3 END", 3: "CASE i WHEN 'u' THEN s2 END"}
_way = "{{'c': {s}.c + {price}, 'a': '{letter}' || {s}.a}}".format
_base = ", ".join(f"list_min([{_way(s=f's{q}', price=4, letter='D')}] || CASE WHEN must THEN [] ELSE [{_way(s=f's{STEP[q]}', price='3 + m', letter='R')}] END || CASE WHEN must OR ({KEEP[q]}) IS NULL THEN [] ELSE [{_way(s=f'({KEEP[q]})', price='m', letter='K')}] END) AS b{q}" for q in range(4))
_closed = ", ".join(f"list_min([b{q}, {_way(s=f'b{STEP[q]}', price=3, letter='I')}, {_way(s=f'b{STEP[STEP[q]]}', price=6, letter='II')}]) AS s{q}" for q in range(4))
#: The same DP with the audit itself as the second part of the cost.
OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS key, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS hx FROM conversations),
h AS (SELECT o.*, {CRC.format(bytes=BYTES.format(hex="hx"))} % 20 AS h FROM o, t),
d AS (SELECT key, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS again FROM h WHERE h <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, again) AS k, left(role, 1) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z FROM d),
f AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(i) OVER (PARTITION BY key ORDER BY k) || i AS pair FROM k),
n AS (SELECT key, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
dp AS (SELECT key, n AS k, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': 6::BIGINT, 'a': 'II'}} AS s1, {{'c': 3::BIGINT, 'a': 'I'}} AS s2, {{'c': 0::BIGINT, 'a': ''}} AS s3 FROM n
 UNION ALL SELECT key, k - 1, {_closed} FROM (SELECT key, k, {_base} FROM (SELECT dp.*, f.i, f.fault IN ('blank', 'duplicate') AS must, CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END AS m FROM dp JOIN f ON dp.key = f.key AND dp.k = f.k))),
a AS (SELECT key, s0.c AS cost, s0.a AS audit FROM dp WHERE k = 0),
l AS (SELECT key, p, audit[p] AS e, len(regexp_replace(left(audit, p), 'I', '', 'g')) AS at, len(regexp_replace(left(audit, p), 'D', '', 'g')) AS nth FROM (SELECT key, audit, unnest(range(1, len(audit) + 1)) AS p FROM a)),
w AS (SELECT l.*, f.role, f.text, max(l.e = 'K' AND f.i = 's' AND l.nth = 1) OVER (PARTITION BY l.key) AS sys FROM l LEFT JOIN f ON l.key = f.key AND l.at = f.k AND l.e <> 'I'),
s AS (SELECT key, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (nth - CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM w WHERE e <> 'D' GROUP BY 1)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT key, conv_id FROM o) c LEFT JOIN n USING (key) LEFT JOIN a USING (key) LEFT JOIN s USING (key)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op9_exact_dedup": OP9_SQL, "op10_sharding": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op13_conversation_repair": OP13_SQL}
